"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldsift.llm import importance


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features_of(text):
    words = words_of(text)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(rows, target, share=25, least=20, size=10_000, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % size
    have, want = [0] * size, [0] * size
    for table, out in ((rows, have), ([(0, t) for t in target], want)):
        for _, text in table:
            for f in features_of(text):
                out[bucket(f)] += 1
    s_all, t_all = sum(have), sum(want)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size)))) for s, t in zip(have, want)]
    found = []
    for i, text in rows:
        own = features_of(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append([i, len(own), weight, score, None, len(words_of(text))])
    able = sorted((r for r in found if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: share * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in found), key=repr)


ODD = [None, "", " .,;", "A b", "É É É", "x" * 200 + " " + "x" * 200, "ﬁ½ \x7f tail\x00NUL", "Ünïcödé wörds " * 30, "w " * 30_000]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = [f"w{rng.randrange(400)}" for _ in range(300)] + ["Straße", "naïve", "the", "THE", "日本"]
    texts = [" ,".join(rng.choices(vocabulary, k=rng.randrange(1, 90))) for _ in range(300)]
    made = list(enumerate([*ODD, *texts]))
    return [*made, made[20], made[20], (21, "another text"), (None, texts[3]), (None, texts[4])]


def test_resample_equals_plain(spark, rows):
    target = [t for _, t in rows[40:60]] + [None, ""]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("place", F.lit(1))
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    found = [tuple(r) for r in importance.resample(df.repartition(5), aim).collect()]
    wanted = plain(rows, target)
    assert sorted(found, key=repr) == wanted
    other = importance.resample(df, aim, share=60, least_words=3, buckets=70_000, seed=8)
    assert sorted(map(tuple, other.collect()), key=repr) == plain(rows, target, 60, 3, 70_000, 8)
    drawn = importance.draw(df, aim)
    assert drawn.columns == df.columns
    assert {r.doc_id for r in drawn.collect()} == {r[0] for r in wanted if r[4]} - {None}


def test_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert importance.resample(df.limit(0), df).count() == 0
    found = importance.resample(df, df.limit(0)).collect()
    assert sorted(map(tuple, found), key=repr) == plain(rows, [])


def test_payloads_do_not_depend_on_the_dictionary(rows, monkeypatch):
    texts = [(t or "").encode() for _, t in rows]
    wanted = [[zlib.crc32(w.encode()) for w in words_of(t)] for _, t in rows]
    for limit, piece in ((importance.LIMIT, importance.PIECE), (50, 100), (1, 7)):
        monkeypatch.setattr(importance, "PIECE", piece)
        dictionary = importance.Dictionary(limit)
        for _ in range(2):
            own, crc, _, _ = importance.runs(texts, dictionary)
            assert [crc[own == i].tolist() for i in range(len(texts))] == wanted
        assert len(dictionary.places) <= max(limit, 0) or limit == importance.LIMIT
    assert dictionary.automaton is None or limit == importance.LIMIT


def test_compose():
    rng = random.Random(1)
    pairs = [(rng.randbytes(rng.randrange(20)), rng.randbytes(rng.choice([0, 1, 5, 300, 70_000]))) for _ in range(50)]
    left, right = (np.array([zlib.crc32(p[i]) for p in pairs], np.uint32) for i in (0, 1))
    found = importance.compose(left, right, np.array([len(b) for _, b in pairs]))
    assert found.tolist() == [zlib.crc32(a + b) for a, b in pairs]
