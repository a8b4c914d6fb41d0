import duckdb

from folio.llm import queries
from folio.llm import url_filter as op


def link(*hosts):
    return "".join(f'<a href="http://{h}/x">l</a>' for h in hosts)


PAGES = [
    (1, "http://A.example.org/es/1?q", None), (2, "https://example.org/en/12", ""), (3, "http://good.org/", link("neutral.net", "neutral.net", "GOOD.org")),
    (4, "http://neutral.net/p", link("friend.net")), (5, "http://friend.net", None), (6, "http://bad.com/de/x", link("other.io")), (7, "http://bad.com/en/y", None),
    (8, "http://linker.io/a#f", '<A HREF=//bad.com/z>'), (9, "http://second.io/b", link("linker.io")), (10, None, None), (11, "no scheme", "x"), (12, "http://xorg/", None),
    (13, "http://com/fr/", None), (14, "x://y://z.org/fr", None), (15, "http://lonely.io/", None), (8, "http://linker.io/a#f", '<A HREF=//bad.com/z>'),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, rank string")


def test_rules_and_parts(spark):
    got = {r["page_id"]: r for r in op.judge(frame(spark)).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2]["rule"] == "example.org/en/1" and got[13]["rule"] == "com/fr/" and got[3]["rule"] == "org/"
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in (10, 11)] == [("", "", None, "allow")] * 2
    assert got[12]["rule"] is None and (got[14]["host"], got[14]["path"]) == ("y:", "//z.org/fr")
    assert (got[5]["path"], got[8]["path"]) == ("", "/a")


def test_trust_goes_along_links_and_distrust_against_them(spark):
    got = {r["page_id"]: r for r in op.judge(frame(spark)).collect()}
    assert got[4]["trust"] > 0 and got[5]["trust"] > 0 and got[4]["verdict"] == "allow"
    assert got[7]["verdict"] == "block" and got[8]["verdict"] == "block" and got[9]["verdict"] == "block"
    assert got[9]["distrust"] < got[8]["distrust"] and got[15]["verdict"] == "allow"


def test_sql_says_the_same(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    cols = ["page_id", "host", "path", "rule", "verdict"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.op10_sql()})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in op.judge(frame(spark)).select(*cols).collect())


def test_empty_table(spark):
    assert op.judge(frame(spark, [])).count() == 0


def test_ranks_settle_on_deep_and_round_graphs(spark):
    """A chain of 13 hosts from a seed, and a ring, against ranks walked until nothing changes."""
    hosts = ["good.org"] + [f"h{i}.io" for i in range(12)]
    ring = {"h11.io": ["r0.io"], "r0.io": ["r1.io"], "r1.io": ["r0.io", "end.io"]}
    out = {a: [b] for a, b in zip(hosts, hosts[1:])} | ring
    rows = [(i, f"http://{h}/", link(*out.get(h, []))) for i, h in enumerate([*hosts, "r0.io", "r1.io", "end.io"])]
    got = {r["host"]: r["trust"] for r in op.judge(frame(spark, rows)).collect()}
    want, before = {"good.org": 15 * op.UNIT // 100}, None
    while want != before:
        part = {}
        for a, bs in out.items():
            for b in bs:
                part[b] = part.get(b, 0) + want.get(a, 0) // len(bs)
        before, want = want, {h: (15 * op.UNIT * (h == "good.org") + 85 * part.get(h, 0)) // 100 for h in {"good.org", *part}}
    assert got == {h: want.get(h, 0) for h in got} and min(got.values()) > 0
