"""The pipeline's run against a plain one, stage by stage, on a small corpus."""

import hashlib
import re
from collections import Counter
from itertools import combinations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

import corpus_pipeline as pipeline
from fieldsift.llm import bpe, toxicity
from fieldsift.llm.queries import ORACLES

SF = "/root/testdata/sf0.01"
LIBRARY = Tokenizer.from_file(bpe.VOCABULARY)
WHITE = " \t\n\x0b\x0c\r"


def fingerprint(text):
    words = [w for w in re.split(f"[{WHITE}]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_exact(rows):
    best = {}
    for r in rows:
        text = r["text"] or ""
        key = re.sub(f"[{WHITE}]", "", text)
        order = (-len(text), r["doc_id"])
        if key not in best or order < best[key][0]:
            best[key] = (order, r)
    return [r for _, r in best.values()]


def plain_near(rows):
    group = {r["doc_id"]: r["doc_id"] for r in rows}
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in rows}
    links = [(i, j) for i, j in combinations(sorted(prints), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            least = min(group[i], group[j])
            changed |= group[i] != least or group[j] != least
            group[i] = group[j] = least
    return [r for r in rows if group[r["doc_id"]] == r["doc_id"]]


def plain_mix(rows):
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"])  # noqa: F841
    sql = ORACLES["op4_mixing"].replace("(size * (whole", "least(3, (whole")
    found = duckdb.sql(sql).fetchall()
    columns = [c[0] for c in duckdb.sql(sql).description]
    times = {r[columns.index("doc_id")]: r[columns.index("taken")] for r in found}
    return [r for r in rows for _ in range(times[r["doc_id"]])]


def plain_codes(rows):
    out = Counter()
    for r in rows:
        ids = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), back))
        out[(r["doc_id"], len(ids), *digests)] += 1
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A driver table with planted copies and odd rows, and its labels."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = docs.orderBy(F.desc("n_chars"), "doc_id").first()
    words = long.text.split()
    near = " ".join([*words[:5], "other", *words[6:]])
    odd = [
        (9001, None), (9002, ""), (9003, " \n "), (9004, long.text), (9005, long.text.replace(" ", "  ")), (9006, near),
        (9007, "same few words"), (9008, "same  few words"), (9009, "samefewwords"), (9010, "w " * 30_000), (9011, "w " * 30_001),
    ]
    planted = [(i, t, None if i % 3 == 0 else "en", None if i % 2 else "odd", 1) for i, t in odd]
    rows = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    names = ["found", "gone", "mark", "mix_whole", "row_id"]
    for name in names:
        rows = rows.withColumn(name, F.lit(name))
    rows.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_run_equals_plain_stages(spark, corpus):
    docs, labels = (spark.read.parquet(f"{corpus}/{t}.parquet") for t in ("documents", "labels"))
    rows = [r.asDict() for r in docs.collect()]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    grammar = toxicity.fit(texts, labels)
    finder = grammar.finder()
    clean = [r for r in rows if grammar.score(grammar.features(r["text"] or "", finder)) < 0.5]
    assert 0 < len(rows) - len(clean) < len(rows) / 3
    exact = plain_exact(clean)
    near = plain_near(exact)
    mixed = plain_mix(near)
    assert len(clean) > len(exact) > len(near) and len(mixed) != len(near)
    found = Counter(tuple(r) for r in pipeline.run(spark, corpus).collect())
    assert found == plain_codes(mixed)


def test_stages_keep_columns_and_planted_rows(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, kept = docs.columns, []
    for name, apply in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(apply(spark, docs, corpus).toArrow())
        assert docs.columns == columns, name
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert {9001, 9007, 9010} <= kept[0]
    assert not {9001, 9002, 9004, 9007, 9009} & kept[1] and {9003, 9005, 9008, 9010, 9011} <= kept[1]
    assert len({9010, 9011} & kept[2]) == 1


def test_empty_documents(spark, corpus, tmp_path):
    folder = str(tmp_path)
    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{corpus}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    assert pipeline.run(spark, folder).count() == 0
