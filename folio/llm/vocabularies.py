"""Ids of public tokenizers for texts of any length and content."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

#: White space of Unicode (fixed values), which the pattern of the byte-level vocabulary tells from the rest.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pattern's look-ahead goes back over a run of white space; runs of so many characters are encoded as the one piece that they are.
LONG_RUN = re.compile(f"[{SPACE}]{{1000,}}")
#: Texts above so many characters are encoded in parts, which end before a blank that follows a word.
PART = 1 << 20
CUT = re.compile("(?<=[^ \u2581]) (?=[^ \u2581])")


def byte_level(ranks_path: str, special: tuple[str, int] | None = None) -> Callable[[str], list[int]]:
    """The byte-level BPE of a file of ranks as a function text -> ids; special: a string that is a token of its own, and its id.

    All but the last character of a run of white space, or all of one at the end, is one
    piece by the pattern; long runs are given to the merges as such, and the pattern sees
    what is between them.
    """
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(text: str) -> list[int]:
        if len(text) < 1000 or not (run := LONG_RUN.search(text)):
            return coder.encode_ordinary(text)
        ids, at = [], 0
        while run:
            last = run.end() if run.end() == len(text) else run.end() - 1
            if run.start() > at:
                ids += coder.encode_ordinary(text[at : run.start()])
            ids += coder._encode_single_piece(text[run.start() : last])
            at = last
            run = LONG_RUN.search(text, run.end())
        return ids + coder.encode_ordinary(text[at:])

    if special is None:
        return plain

    def split(text: str) -> list[int]:
        if special[0] not in text:
            return plain(text)
        first, *rest = text.split(special[0])
        ids = plain(first)
        for part in rest:
            ids.append(special[1])
            ids += plain(part)
        return ids

    return split


def pieces(model_path: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """(function text -> ids, bytes of each id) of a sentencepiece model with byte fallback, which sets a blank before the text.

    In such a vocabulary blanks come first in a piece, so a part of a text that begins with
    a blank after a word has the same pieces alone as in the text.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    table = []
    for i in range(model.vocab_size()):
        name = model.id_to_piece(i)
        table.append(bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("\u2581", " ").encode())
    if any(" " in p.decode(errors="replace").lstrip(" ") for p in table):
        raise ValueError("a piece has a blank after a word")

    def encode(text: str) -> list[int]:
        if len(text) <= PART:
            return model.encode(text)
        ids, at = [], 0
        while at < len(text):
            cut = CUT.search(text, at + PART)
            end = cut.start() if cut else len(text)
            # the model adds the blank that the part begins with
            ids += model.encode(text[at:end])
            at = end + 1
        return ids

    return encode, table


def byte_table(json_path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary in the format of the tokenizers library."""
    import json

    # printable characters stand for themselves, the other bytes for those from 256 on, in order
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    with open(json_path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    ids = dict(vocabulary["model"]["vocab"])
    table = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        table[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return table
