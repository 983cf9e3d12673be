"""SimHash, passages, tokens, secrets and toxicity against plain versions."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from fieldsift.llm import bpe, passages, pretokens, secret_scan, simhash, token_file, toxicity

LIBRARY = Tokenizer.from_file(bpe.VOCABULARY)
TEXTS = [
    "", None, "one", "two words", "The cat's here, they'll stay 12 34½!", " lead  and   trail ", "a<|endoftext|> b<|endoftext|>",
    "漢字 かな 🙂🙂 ñandú \x85 \x1c x", "՘ new ꟒ letters", "ab" * 3000, " " * 500, "x\n\n\ny\t z",
]


def fuzz(n, seed=7):
    rng = random.Random(seed)
    letters = "aeiou stnrl'’\n\t  éßα漢🙂123½Ⅷ_-<|>.,"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(n)]


def frame(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.withColumn("ids", F.lit(1)).withColumn("n", F.lit(1)).withColumn("row_id", F.lit(9))


def test_pieces_split_like_the_library():
    split = LIBRARY.pre_tokenizer.pre_tokenize_str
    points = [*range(0, 0x3000, 3), *range(0x2000, 0x2070), 0x558, 0xA7D2, 0x1F642, 0x323B0]
    for text in [f"a{c}1{c}.{c} {c}{c}b" for c in map(chr, points)] + fuzz(300):
        assert pretokens.pieces(text) == [text[a:b] for _, (a, b) in split(text)]


def test_bpe_equals_library(spark):
    texts = TEXTS + fuzz(200)
    df = frame(spark, texts).unionByName(frame(spark, ["again"]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = {r.doc_id: r for r in bpe.round_trip(df).collect()}
    assert len(rows) == len(texts) + 1
    for i, text in enumerate(texts):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.round_trip(df.limit(0)).count() == 0
    own = bpe.decode(bpe.encode(df)).collect()
    assert {r.doc_id: r.text for r in own if r.doc_id is not None} == {i: t or "" for i, t in enumerate(texts)}


def test_token_file(spark):
    texts = TEXTS + fuzz(60)
    df = frame(spark, texts).repartition(5)
    rows = sorted(token_file.read_tokens(*token_file.write_tokens(df)).collect(), key=lambda r: r.doc_id)
    start = 0
    for text, r in zip(texts, rows, strict=True):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    twice = df.unionByName(df).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    again = token_file.read_tokens(*token_file.write_tokens(twice)).collect()
    assert len(again) == 2 * len(texts) and len({r.start for r in again}) == len(again)
    assert token_file.read_tokens(*token_file.write_tokens(df.limit(0))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 4, 1000])
def test_pack_and_unpack(n):
    ranks = (np.random.default_rng(n).integers(0, 1 << 32, n) >> np.random.default_rng(1).integers(0, 33, n)).astype(np.uint32)
    control, data = token_file.pack(ranks)
    assert len(control) == -(-n // 4) and np.array_equal(token_file.unpack(control, data, n), ranks)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    name = {i: i for i in fps}
    for _ in fps:
        for i, j in combinations(fps, 2):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                name[i] = name[j] = min(name[i], name[j])
    return name


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 1])
def test_simhash_equals_plain(spark, bucket):
    rng = random.Random(3)
    texts = [*TEXTS, "Two  WORDS", "\u000b", "É A"]
    base = [rng.choice("abcdefgh") * 3 + str(i) for i in range(120)]
    for k in range(25):
        words = list(base)
        words[rng.randrange(120)] = f"new{k}"
        texts.append(" ".join(words))
    df = frame(spark, texts)
    found = {r.doc_id: r for r in simhash.near_groups(df, bucket=bucket).collect()}
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    wanted = plain_components(fps)
    assert {i: r.fingerprint for i, r in found.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in found.items()} == wanted
    kept = {r.doc_id for r in simhash.drop_near_copies(df).collect()}
    assert kept == set(wanted.values())
    nameless = df.withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id")))
    assert simhash.near_groups(nameless.unionByName(nameless)).count() == 2 * len(texts)
    assert simhash.near_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [64, 1])
def test_links_of_close_fingerprints(spark, bucket):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(30)}
    fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in list(fps) for _ in range(3)}
    fps = dict(enumerate(sorted(fps)))
    rows = [(simhash._signed(f), i) for i, f in fps.items()]
    from fieldsift.llm.components import components

    found = components(simhash.links(spark.createDataFrame(rows, "fp long, rep long"), bucket)).collect()
    wanted = plain_components(fps)
    groups = {r.node: r.component for r in found}
    assert {i: groups.get(i, i) for i in fps} == wanted


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(11)
    passage, line = words(rng, 60), "licensed under the usual terms of this very house".split()
    edited = list(passage)
    edited[30] = "other"
    texts = [words(rng, 200) for _ in range(40)]
    for i in (3, 7, 9):
        texts[i] = texts[i][:50] + passage + texts[i][50:]
    texts[12] = texts[12] + edited
    for i in range(20, 40):
        texts[i] = texts[i] + line
    texts[30] = list(texts[25])
    texts += [words(rng, 20)] * 2 + [[], words(rng, 46), words(rng, 50)]
    df = frame(spark, [" ".join(t) for t in texts] + [None])
    found = {r.doc_id: r for r in passages.passage_groups(df).collect()}
    assert len(found) == len(texts) + 1
    linked = {i for i, r in found.items() if r.n_links}
    assert linked == {3, 7, 9, 12, 25, 30}
    assert {found[i].class_id for i in (3, 7, 9, 12)} == {3} and found[30].class_id == 25
    for i in (7, 9):
        start, end = map(int, found[i].spans.split(":"))
        assert start <= 50 and end >= 110 and end - start < 90
    assert found[30].spans == f"0:{len(texts[30])}"
    assert all(r.class_id == i and not r.spans for i, r in found.items() if i not in linked)
    twice = df.unionByName(df.withColumn("doc_id", F.lit(None).cast("long")))
    assert passages.passage_groups(twice).count() == 2 * len(found)
    assert passages.passage_groups(df.limit(0)).count() == 0


def test_windows_hold_the_least_hash():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 1 << 62, 500).astype(np.uint64)
    place = passages.centres(hashes)
    n = passages.LENGTH
    cut = hashes & ~passages._PLACE
    assert place.tolist() == [i + int(np.argmin(cut[i : i + n])) for i in range(len(hashes) - n + 1)]
    parts = [hashes[:100], hashes[100:110], hashes[110:400], hashes[400:]]
    owner, key, places = passages.keys_of(parts)
    for i, part in enumerate(parts):
        alone = sorted(zip(*(x.tolist() for x in passages.keys(part)), strict=True))
        assert alone == sorted(zip(key[owner == i].tolist(), places[owner == i].tolist(), strict=True))


def test_secrets(spark):
    rng = random.Random(1)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    token = "".join(rng.choice(alnum) for _ in range(200))
    texts = [
        None, "", "PassWord = 'abcdef' é token:abc", "AKIA" + "Q" * 16 + " AKIAQ", "0123456789abcdef01234567", "api-key=1234567",
        "apikey: x=secret=abc", f"see {token} there", "a" * 30 + "1", "secret=token: abcdefgh", "/usr/local/share/doc/readme_2024_final_version",
    ]
    df = frame(spark, texts)
    found = {r.doc_id: r for r in secret_scan.find_secrets(df).collect()}
    counts = {i: (r.n_assign, r.n_access, r.n_hex, r.n_random) for i, r in found.items()}
    assert counts[2] == (1, 0, 0, 0) and found[2].spans == "assign:0:18"
    assert counts[3] == (0, 1, 0, 0) and counts[4] == (0, 0, 1, 0) and counts[5][0] == 0 and counts[6][0] == 1
    assert counts[7] == (0, 0, 0, 1) and found[7].spans == f"random:4:{4 + len(token)}"
    assert counts[8] == (0, 0, 1, 0)  # 31 characters of 0-9a-f
    assert counts[9] == counts[10] == counts[0] == counts[1] == (0, 0, 0, 0)
    assert found[2].base_sha256 == hashlib.sha256(b"assign:0:18").hexdigest()
    assert found[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secret_scan.find_secrets(df.limit(0)).count() == 0


def test_base_spans_equal_plain_patterns():
    pattern = r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    rng = random.Random(4)
    parts = ["password", "Token", "API_KEY", "ſecret", "=", ": ", "'", "abcdef", "ab", "AKIA", "Z9" * 9, "deadbeef", "é", " "]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(30))
        wanted = [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 6]
        wanted += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        wanted += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert secret_scan.base_spans(text) == sorted(wanted)


def test_battery_tells_random_from_regular():
    rng = np.random.default_rng(0)
    passed = [secret_scan.looks_random(*secret_scan.battery(rng.integers(0, 62, 40), 62)) for _ in range(200)]
    assert np.mean(passed) > 0.97
    assert not secret_scan.looks_random(*secret_scan.battery(np.arange(40), 62))
    assert not secret_scan.looks_random(*secret_scan.battery(np.zeros(40, int), 62))


def identifiers(rng, n):
    """Ordinary names, paths and dates of 20 signs and more, and some words."""
    words = ["".join(rng.choice(["ka", "le", "mon", "tri", "sa", "per", "o", "ning", "ex", "ful"]) for _ in range(rng.randrange(1, 5))) for _ in range(900)]
    out = []
    for _ in range(n):
        some = rng.choices(words, k=40)
        names = ["".join(map(str.capitalize, some[:6])) + str(rng.randrange(100)), "_".join(some[6:11]) + "_2024", "/".join(some[11:16]) + "/v2",
                 "".join(some[16:21]).upper() + "7"]
        out.append(" ".join(some[21:] + [x for x in names if len(x) >= 20]))
    return out


def test_few_ordinary_strings_are_secrets(spark):
    rng = random.Random(12)
    texts = identifiers(rng, 6000)
    tested = sum(len(list(secret_scan.tested_strings(t, secret_scan.base_spans(t)))) for t in texts)
    found = secret_scan.find_secrets(frame(spark, texts)).agg(F.sum("n_random")).first()[0]
    assert tested > 15_000 and found <= 0.0005 * tested
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted = {}
    for i in range(0, 6000, 20):
        token = "".join(rng.choices(alnum, k=rng.choice([40, 48, 64])))
        planted[i] = f"random:{len(texts[i]) + 1}:{len(texts[i]) + 1 + len(token)}"
        texts[i] += f" {token} end"
    spans = {(r.doc_id, s) for r in secret_scan.find_secrets(frame(spark, texts)).collect() for s in r.spans.split(",") if "random" in s}
    right = spans & set(planted.items())
    assert len(spans - right) <= 0.02 * len(spans) and len(right) >= 0.75 * len(planted)


def test_secrets_of_very_long_and_repeated_rows(spark):
    rng = random.Random(3)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    token = "".join(rng.choices(alnum, k=120))
    long = "ordinary words of a text " * 40_000 + token + " and more"
    df = frame(spark, [long, long, "words"])
    df = df.unionByName(df.filter("doc_id = 0"))
    rows = secret_scan.find_secrets(df).collect()
    assert sorted(r.n_random for r in rows) == [0, 1, 1, 1]
    assert {r.spans for r in rows if r.n_random} == {f"random:{25 * 40_000}:{25 * 40_000 + 120}"}


def test_decoys_look_like_their_strings():
    for body in ("aB3dE6gH1jK4mN7pQ0sT", "abc_def_123_ghi_456_x", "QWERTY0123456789QWERTY==", "deadbeef0123456789ab1"):
        made = secret_scan.decoy(body, ["some", "ordinary", "words"])
        assert len(made) == len(body) and any(c.isdigit() for c in made)
        assert made.islower() == body.islower() and ("_" in made) == ("_" in body)


def plain_clause(grammar, words):
    """The five rules as one loop with a flag each."""
    total, negated, threat, target, reported = 0.0, 0, False, False, False
    for word in words:
        negated = max(0, negated - 1)
        weight = grammar.insult(word)
        if weight:
            total += weight * (toxicity.NEGATED if negated else 1.0)
        elif word in toxicity.NEGATIONS:
            negated = toxicity.REACH + 1
        elif word in toxicity.THREATS:
            threat = not negated
        elif word in toxicity.TARGETS:
            target = True
            if threat:
                total, threat = total + toxicity.THREAT, False
        elif word in toxicity.REPORTS:
            reported = True
    return total * (toxicity.AIMED if target else 1.0) * (toxicity.REPORTED if reported else 1.0)


def test_composed_table_equals_the_rules():
    grammar = toxicity.Grammar({"foo": 2.0, "foob": 3.5, "kill ": 1.5})
    rng = random.Random(9)
    words = ["foo", "foobar", "kill", "hurt", "you", "them", "not", "never", "said", "a", "walk", "kills"]
    for _ in range(3000):
        clause = rng.choices(words, k=rng.randrange(0, 14))
        assert grammar.clause(clause) == pytest.approx(plain_clause(grammar, clause))
    states = len(toxicity.COMPOSED.arcs)
    assert 16 < states <= (toxicity.REACH + 2) * 2 * 2 * 2


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 500 and np.mean([r.predicted == r.toxic for r in rows]) > 0.97
    crc = {r.doc_id for r in rows}
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in crc)


def test_toxicity_odd_rows(spark):
    df = frame(spark, ["", None, "fine words", "x" * 100_000]).withColumn("toxic_score", F.lit(1))
    labels = spark.createDataFrame([(1, None), (2, 0), (2, 0)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(df, labels).collect()
    assert len(rows) == 4 and all(r.predicted == 0 for r in rows)
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and kept.count() == 4
    assert toxicity.score_toxicity(df.limit(0), labels.limit(0)).count() == 0


def test_clause_grammar():
    grammar = toxicity.Grammar({"foo": 4.0, "foolish ": 2.0})
    plain = grammar.clause("what a fool".split())
    assert plain == 4.0 and grammar.clause("not a fool".split()) < plain < grammar.clause("you fool".split())
    assert grammar.clause("they said fool".split()) < grammar.clause("they are fool".split())
    assert grammar.clause("i will kill you".split()) > 0 == grammar.clause("i never kill you".split())


def test_aligned_stretches_match_a_plain_comparison():
    rng = np.random.default_rng(5)
    n = passages.LENGTH
    own, other = [], []
    for i in range(300):
        a = rng.integers(0, 40 if i % 3 == 0 else 1 << 32, rng.integers(n - 2, 2 * n + 1)).astype("<u4")
        b = a[: rng.integers(n - 2, len(a) + 1)].copy()
        for at in rng.integers(0, len(b), rng.integers(0, 12)):
            b[at] = rng.integers(0, 1 << 32)
        if i % 4 == 0:
            b = np.insert(b, rng.integers(0, len(b)), 7)[: 2 * n]
        own.append(a)
        other.append(b.astype("<u4"))
    for a, b, hit in zip(own, other, passages.compare(own, other), strict=True):
        end = min(len(a), len(b))
        plain = passages.jaccard(a[:end], b[:end])
        good = np.flatnonzero(plain >= passages.SIMILAR)
        assert (hit is not None) == (len(good) > 0)
        if hit:
            assert hit[:2] == (good[0], good[-1])
            assert abs(hit[2] - plain.max()) < 1e-12
    assert passages.compare([], []) == []
