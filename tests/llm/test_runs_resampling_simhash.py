"""Periodic runs, importance resampling and SimHash groups against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tarnwell.llm import importance_resampling as I
from tarnwell.llm import periodic_runs as R
from tarnwell.llm import simhash_dedup as S
from tarnwell.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "ab"), (4, "ab"), (5, "x y " * 30_000), (6, "é ü é ü é ü é ü"), (None, "no id at all"), (None, None), (7, "  a b \x0b c")]


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# Periodic runs


def brute_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and (length := j - i + q) >= max(6, 4 * q) and not any(words[i + d : j + q] == words[i : j + q - d] for d in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    away = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in away)


def kernel(texts):
    _, codes, bounds = R.coded_words(pa.array(texts))
    out = [[] for _ in texts]
    for t, *run in R.periodic_runs(codes, bounds).tolist():
        out[t].append(tuple(run))
    return out


@settings(deadline=None, max_examples=200)
@given(st.lists(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 9)), max_size=6), min_size=1, max_size=4))
def test_runs_of_small_alphabets(parts):
    texts = [" ".join("".join(block * times for block, times in p)) for p in parts]
    assert kernel(texts) == [brute_runs(t.split()) for t in texts]


def test_long_periods_between_other_words():
    rng = random.Random(1)
    texts = []
    for q in (1, 2, 3, 7, 8, 31, 64, 129):
        block = [f"w{rng.randrange(10)}" for _ in range(q)]
        head, tail = ([f"h{rng.randrange(4)}" for _ in range(rng.randrange(40))] for _ in "ab")
        texts.append(" ".join(head + (block * 7)[: 4 * q + rng.randrange(2 * q + 3)] + tail))
    texts.append(" ".join(["one two"] * 3 + ["one"]))  # 3 1/2 periods are no run
    assert kernel(texts) == [brute_runs(t.split()) for t in texts]


def test_a_long_text_of_one_word_takes_linear_time():
    runs = kernel([" ".join(["same"] * 300_000)])[0]
    assert runs == [(0, 300_000, 1)]


def test_find_runs_of_odd_texts(spark, texts):
    out = R.find_runs(texts(ODD))
    rows = out.collect()
    assert len(rows) == len(ODD) and {"size", "kept", "row"} <= set(out.columns) and out.columns.count("n_words") == 1
    wanted = Counter()
    for doc, text in ODD:
        words = WORD.findall(text or "")
        runs = [(0, 60_000, 2)] if doc == 5 else brute_runs(words)
        wanted[doc, len(words), tuple(runs), collapsed(words, runs)] += 1
    assert Counter((r.doc_id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed) for r in rows) == wanted
    assert all(r.size == "b" for r in rows)
    assert R.find_runs(texts([])).count() == 0
    with pytest.raises(ValueError):
        R.find_runs(texts([]), periods=3)


def periodic(words, doc):
    h = zlib.crc32(str(doc).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_periodic_runs_query(spark, docs):
    found = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(found) == len(docs)
    for doc, text in docs:
        words = periodic(WORD.findall(text or ""), doc)
        r, runs = found[doc], brute_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, 1000 * best[1] // best[2] if runs else None), doc
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{q}\n" for a, b, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()


def test_made_periodic_of_odd_rows(spark, texts):
    rows = [*ODD, *((i, "a b c d e f g h i j k l m n o p") for i in range(100, 160))]
    got = texts(rows).select("doc_id", "text", R.made_periodic(F.col("text"), F.col("doc_id")).alias("made")).collect()
    for r in got:
        words = WORD.findall(r.text or "")
        assert WORD.findall(r.made or "") == (words if r.doc_id is None else periodic(words, r.doc_id))


# Importance resampling


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in [*words, *map(" ".join, zip(words, words[1:]))]]


def brute_resample(docs, target):
    known = [(doc, *brute_features(t)) for doc, t in docs]
    s, t = Counter(b for *_, own in known for b in own), Counter(b for x in target for b in brute_features(x)[1])
    all_s, all_t = s.total(), t.total()
    out = []
    for doc, n, own in known:
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in own]
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gains) // len(gains) if gains else 0
        out.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = {id(r): i + 1 for i, r in enumerate(able[: 25 * len(able) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in out]


def test_importance_resampling_query(spark, docs):
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    found = {r.doc_id: (r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in QUERIES["op12_importance_resampling"](spark, SF).collect()}
    assert found == {r[0]: r for r in brute_resample(docs, target)}


def test_resample_odd_tables(spark, texts):
    rows = [*ODD, *((10 + i % 5, f"word {i // 5} " * 12) for i in range(40)), *((None, "many words here " * 9),) * 3]
    target = texts([(1, "word 3 word 4"), (2, None)])
    out = I.resample(texts(rows), target)
    assert "text" not in out.columns and out.columns.count("score") == 1 and all(r.size == "b" for r in out.collect())
    found = Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in out.collect())
    wanted = brute_resample(rows, ["word 3 word 4", None])
    drop = lambda some: Counter((*k[:4],) for k in some.elements())
    assert drop(found) == drop(Counter(wanted)) and sorted(r[4] for r in found if r[4]) == sorted(r[4] for r in wanted if r[4])
    assert {r for r in found if r[4]} == {r for r in wanted if r[4]}  # repeated rows are told apart by nothing
    assert I.resample(texts([]), target).count() == 0
    none = I.resample(texts(rows), texts([])).collect()
    assert len(none) == len(rows)


def test_places_follow_the_whole_order(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("v"))
    got = [(r._place, r._row.k, r._row.v) for r in I.numbered(rows.repartition(7), F.col("k").desc(), F.col("v")).collect()]
    got.sort()
    assert [g[0] for g in got] == list(range(1, 5001)) and [(-g[1], g[2]) for g in got] == sorted((-g[1], g[2]) for g in got)


# SimHash


def brute_print(text):
    words = WORD.findall(lower(text))
    hashes = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most):
    """Least id of each row's component; None where no row of it has an id."""
    arr = np.array([p for _, p in prints], dtype=np.uint64)
    label = list(range(len(arr)))
    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= most):
            a, b = label[i], label[j]
            if a != b:
                label = [a if x == b else x for x in label]
    return [min((d for (d, _), x in zip(prints, label) if x == mine and d is not None), default=None) for mine in label]


def test_simhash_query(spark, docs):
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op13_simhash_dedup"](spark, SF).collect()}
    prints = [(d, brute_print(t)) for d, t in docs]
    assert found == {d: (f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints, 2))}
    assert len({c for _, c in found.values()}) < len(docs)


def test_majority_of_many_hashes():
    rng = np.random.default_rng(3)
    counts = np.array([0, 1, 2, 254, 255, 256, 0, 1021, 5000])
    hashes = rng.integers(0, 1 << 63, counts.sum(), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, counts.sum(), dtype=np.uint64)
    at, wanted = 0, []
    for n in counts:
        own = hashes[at : at + n].tolist()
        wanted.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > n))
        at += n
    assert S.majority_bits(hashes, counts).tolist() == wanted


def test_simhash_odd_tables(spark, texts):
    rows = [*ODD, (8, "A B"), (9, "a  b"), (10, "one two three four")]
    out = S.simhash_groups(texts(rows))
    got = out.collect()
    assert "text" not in out.columns and all(r.size == "b" for r in got)
    prints = [(d, brute_print(t)) for d, t in rows]
    wanted = Counter((d, p, c) for (d, p), c in zip(prints, brute_components(prints, 2)))
    assert Counter((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in got) == wanted
    assert S.simhash_groups(texts([])).count() == 0
    alone = S.simhash_groups(texts([(None, "a b c"), (None, "a b c")])).collect()
    assert [r.component_id for r in alone] == [None, None]


@pytest.mark.parametrize(("most", "bucket_rows"), [(1, 64), (2, 32), (2, 4096), (3, 128)])
def test_close_pairs_in_hot_buckets(spark, most, bucket_rows):
    """Clouds of prints around a few centres share almost all keys: buckets are cut again and again, and no pair is lost."""
    rng = random.Random(most)
    prints = set()
    for centre in (rng.getrandbits(64) for _ in range(3)):
        near = rng.sample(range(64), 14)
        prints |= {centre ^ sum(1 << b for b in rng.sample(near, rng.randrange(6))) for _ in range(300)}
    prints |= {rng.getrandbits(64) for _ in range(200)}
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    table = spark.createDataFrame([(signed(p),) for p in prints], "bits long")
    found = [(r.u, r.v) for r in S.close_pairs(table, most=most, bucket_rows=bucket_rows).collect()]
    ordered = sorted(map(signed, prints))
    arr = np.array([p % (1 << 64) for p in ordered], dtype=np.uint64)
    wanted = {(ordered[i], ordered[i + 1 + int(j)]) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= most)}
    assert len(found) == len(set(found)) and set(found) == wanted and len(wanted) > 500


def test_pigeonring_keys_miss_no_pair():
    rng = random.Random(5)
    for most in (1, 2, 3):
        ring = S.Ring(0, most)
        for _ in range(2000):
            differ = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, most + 1)))
            assert any(not differ & k and all((differ & bits).bit_count() <= least for bits, least in chain) for k, chain in zip(ring.keys, ring.chains))
