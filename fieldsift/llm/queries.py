"""Queries of the pipeline operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsift.llm.bpe import round_trip
from fieldsift.llm.exact_dedup import exact_dedup
from fieldsift.llm.importance import resample
from fieldsift.llm.mixing import mix_report
from fieldsift.llm.nearest import nearest
from fieldsift.llm.norm_search import top_products
from fieldsift.llm.passages import passage_groups
from fieldsift.llm.secret_scan import find_secrets
from fieldsift.llm.shared import table
from fieldsift.llm.simhash import near_groups
from fieldsift.llm.token_file import read_tokens, write_tokens
from fieldsift.llm.toxicity import score_toxicity
from fieldsift.llm.vector_codes import compress
from fieldsift.llm.warc import archive


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "found.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(*write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def op13_norm_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mixing": op4_mixing,
    "op5_secrets": op5_secrets,
    "op6_warc": op6_warc,
    "op7_token_file": op7_token_file,
    "op8_simhash": op8_simhash,
    "op9_passages": op9_passages,
    "op10_bpe": op10_bpe,
    "op11_importance": op11_importance,
    "op12_vector_codes": op12_vector_codes,
    "op13_norm_search": op13_norm_search,
}

_OP3 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""

_OP4 = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (
  SELECT *, 3 * source_size AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM s),
r AS (SELECT *, cap::DOUBLE / weight AS ratio FROM p),
l AS (
  SELECT *,
         (sum(source_size) OVER () -
          coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
f AS (SELECT first(level ORDER BY ratio, place) AS share FROM l WHERE level <= ratio),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, share * weight) AS target
  FROM l, f),
w AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM t),
c AS (
  SELECT d.*, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS same
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN upto <= budget OR (upto - same <= budget AND upto - budget < budget - (upto - same))
                             THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""

_OP6 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
l AS (SELECT payload_digest, payload_bytes, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM p LEFT JOIN l USING (payload_digest, payload_bytes)
"""

# The CRC-32 of a feature by a table of single-byte steps, made from its polynomial.
_OP11 = r"""
WITH z AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
d AS (
  SELECT row_number() OVER () AS n, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
df AS (
  SELECT n, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM d),
bf AS (
  SELECT unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM b),
h AS (
  SELECT feature,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(feature))),
               lambda i: ('0x' || substr(hex(encode(feature)), 2 * i + 1, 2))::BIGINT)),
             lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM (FROM df SELECT feature UNION ALL FROM bf)), z),
s AS (SELECT bucket, count(*) AS s FROM df JOIN h USING (feature) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN h USING (feature) GROUP BY bucket),
g AS (
  SELECT range AS bucket,
         floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT count(*) FROM df) + 10000))::DOUBLE
                         / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM bf) + 10000))::DOUBLE))::BIGINT AS gain
  FROM range(10000) LEFT JOIN s ON s.bucket = range LEFT JOIN t ON t.bucket = range),
w AS (
  SELECT n, count(*) AS n_features, sum(gain)::BIGINT AS total
  FROM df JOIN h USING (feature) JOIN g USING (bucket) GROUP BY n),
c AS (
  SELECT d.n, doc_id, len(words) AS size, coalesce(n_features, 0) AS n_features,
         CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
         ('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS u
  FROM d LEFT JOIN w USING (n)),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((u + 0.5) / 4294967296)))::BIGINT AS score FROM c),
r AS (
  SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM e WHERE size >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score,
       CASE WHEN place <= 25 * able // 100 THEN place END AS rank
FROM e LEFT JOIN r USING (n)
"""


def _op12() -> str:
    """Six rounds over (part, vector) and (part, entry) rows."""
    rounds = []
    for r in range(7):
        last = f"c{r - 1}" if r else "c"
        rounds.append(f"""
n{r} AS (
  SELECT row, p.part, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d
  FROM (SELECT row, p.part, entry, list_sum(list_transform(range(1, 9), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))::BIGINT AS d
        FROM p JOIN {last} AS c USING (part)) AS p
  GROUP BY row, p.part)""")
        if r < 6:
            # Whole-number division that goes down.
            sums = ", ".join(
                f"((sum(p.x[{i}]) - (sum(p.x[{i}]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT" for i in range(1, 9)
            )
            rounds.append(f"""
c{r} AS (
  SELECT part, entry, coalesce(u.x, c.x) AS x
  FROM {last} AS c LEFT JOIN (
    SELECT part, entry, [{sums}] AS x FROM n{r} JOIN p USING (row, part) GROUP BY part, entry) AS u USING (part, entry))""")
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
         list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT row, part, x[8 * part + 1 : 8 * part + 8] AS x FROM v, range(8) AS r(part)),
c AS (SELECT part, row - 1 AS entry, x FROM p WHERE row <= 16),{",".join(rounds)},
f AS (
  SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM n6 GROUP BY row),
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS digest FROM c5)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256
FROM f JOIN v USING (row), b
"""


_OP13 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, place::INT AS rank, vec_id, score FROM r WHERE place <= 20
"""

ORACLES: dict[str, str] = {
    "op3_exact_dedup": _OP3,
    "op4_mixing": _OP4,
    "op6_warc": _OP6,
    "op11_importance": _OP11,
    "op12_vector_codes": _op12(),
    "op13_norm_search": _OP13,
}
