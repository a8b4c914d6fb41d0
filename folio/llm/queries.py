"""One query for each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import alignment, exact_dedup, language_id, media, mixing, negatives, packing, repeats, sharding, simhash, superkmers, url_filter, warc

SHARD_LIMIT = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(pages(spark, sf_dir), shard_bytes=4 << 20, file_bytes=1 << 20)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir), with_media=False).drop("media", "peaks")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, taken, sources = mixing.mix_by_weight(documents(spark, sf_dir))
    plan = spark.createDataFrame(sources, "s string, source_size long, target double")
    rows = mixing.taken_of(sizes, taken)
    return rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", "taken", "shard", "position")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(language_id.learned_rows(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 3 == 1
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), SHARD_LIMIT)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir)).drop("loss")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(pages(spark, sf_dir)).select("page_id", "host", "path", "rule", "verdict")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.drop_windows(documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir))


DEALT = (
    op1_exact_dedup,
    op2_warc,
    op3_media,
    op4_mixing,
    op5_repeats,
    op6_simhash,
    op7_language_id,
    op8_sharding,
    op9_packing,
    op10_url_filter,
    op11_negatives,
    op12_superkmers,
    op13_alignment,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in DEALT}

OP1_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g USING (text)
"""

OP2_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN p.page_id > g.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id > g.first THEN g.first END AS refers_to
FROM p LEFT JOIN g USING (d)
"""


def op8_sql(limit: int = SHARD_LIMIT) -> str:
    return f"""
WITH r AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT * FROM r WHERE n_bytes <= {limit}),
l AS (SELECT d, h >> (60 - d) AS p, sum(n_bytes) AS b, count(*) AS c FROM s, (SELECT CAST(unnest(range(0, 41)) AS INT) AS d) GROUP BY ALL),
leaf AS (SELECT l.d, l.p, l.b, l.c FROM l LEFT JOIN l u ON u.d = l.d - 1 AND u.p = (l.p >> 1)
         WHERE l.b <= {limit} AND (l.d = 0 OR u.b > {limit}))
SELECT s.doc_id, s.n_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(p), d, '0') END AS shard, CAST(d AS INT) AS depth,
       CAST(b AS BIGINT) AS shard_bytes, CAST(c AS BIGINT) AS shard_rows, false AS oversized
FROM s JOIN leaf ON leaf.p = (s.h >> (60 - leaf.d))
"""


def op10_sql(rounds: int = url_filter.ROUNDS) -> str:
    """The rules by joins and the two walks written out round by round, in whole numbers."""
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in url_filter.RULES)
    url = url_filter.URL.replace("'", "''")
    link = url_filter.LINK.replace("'", "''")
    lower = f"translate({{}}, '{url_filter.UPPER}', '{url_filter.LOWER}')"
    ctes = [
        f"rules(v, rule, h, p) AS (VALUES {rules})",
        f"r AS (SELECT page_id, {lower.format(f'''coalesce(regexp_extract(url, '{url}', 1), '')''')} AS host, coalesce(regexp_extract(url, '{url}', 2), '') AS path, html FROM pages)",
        "m AS (SELECT DISTINCT host, path, max_by(rule, length(rule)) AS rule, max_by(v, length(rule)) AS v "
        "FROM (SELECT DISTINCT host, path FROM r) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)",
        "j AS (SELECT page_id, r.host, r.path, rule, v FROM r LEFT JOIN m USING (host, path))",
        "n AS (SELECT host, count(*) FILTER (v = 'allow') AS a, count(*) FILTER (v = 'block') AS b FROM j WHERE host <> '' GROUP BY host)",
        f"e0 AS (SELECT host AS src, {lower.format('dst')} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS dst FROM r))",
        "e AS (SELECT src, dst, count(*) AS w FROM e0 WHERE src <> '' AND src <> dst GROUP BY src, dst)",
        "fwd AS (SELECT src, dst, w, sum(w) OVER (PARTITION BY src) AS whole FROM e)",
        "bwd AS (SELECT dst AS src, src AS dst, w, sum(w) OVER (PARTITION BY dst) AS whole FROM e)",
    ]
    for name, column, edges in (("t", "a", "fwd"), ("d", "b", "bwd")):
        ctes.append(f"{name}s AS (SELECT host, CAST({url_filter.UNIT} AS HUGEINT) * {column} // (SELECT sum({column}) FROM n) AS seed FROM n WHERE {column} > 0)")
        ctes.append(f"{name}0 AS (SELECT host, seed AS rank FROM {name}s)")
        for i in range(rounds):
            ctes.append(f"{name}g{i} AS (SELECT dst AS host, sum(CAST(rank AS HUGEINT) * w // whole) AS got FROM {edges} JOIN {name}{i} ON src = {name}{i}.host GROUP BY dst)")
            ctes.append(
                f"{name}{i + 1} AS (SELECT host, ({100 - url_filter.DAMPING} * coalesce(seed, 0) + {url_filter.DAMPING} * coalesce(got, 0)) // 100 AS rank "
                f"FROM {name}s FULL JOIN {name}g{i} USING (host))"
            )
    return "WITH " + ",\n".join(ctes) + (
        f"\nSELECT page_id, j.host, path, rule, coalesce(v, CASE WHEN coalesce(d{rounds}.rank, 0) > coalesce(t{rounds}.rank, 0) THEN 'block' ELSE 'allow' END) AS verdict "
        f"FROM j LEFT JOIN t{rounds} ON t{rounds}.host = j.host LEFT JOIN d{rounds} ON d{rounds}.host = j.host"
    )


OP11_SQL = """
WITH p AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM p a JOIN p b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
g AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT g.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
             CAST(row_number() OVER (PARTITION BY g.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank
      FROM g JOIN s ON s.anchor_id = g.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(l) AS word, unnest(range(len(l))) AS i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS l FROM d)),
s AS (SELECT r, i, word, string_agg(word, ' ') OVER here AS run, count(*) OVER here AS n FROM w
      WINDOW here AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
c AS (SELECT r, i, word, n = 35 AND count(*) OVER (PARTITION BY n, run) > 1 AS again FROM s),
g AS (SELECT r, i, word, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
k AS (SELECT r, count(*) AS n, count(*) FILTER (gone) AS m, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(m, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op2_warc": OP2_SQL, "op8_sharding": op8_sql(), "op10_url_filter": op10_sql(), "op11_negatives": OP11_SQL, "op12_superkmers": OP12_SQL}
