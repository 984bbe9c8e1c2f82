"""Trained operators: held-out accuracy, probabilities that add up, exact round trips."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import language_id as N
from tarnwell.llm import pseudo_likelihood as L
from tarnwell.llm import quality_classifier as Q
from tarnwell.llm import token_output as T

SF = "/root/testdata/sf0.001"


def test_language_on_held_out_documents(spark):
    found = N.op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert len(held) > 20 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_language_edge_cases(spark, texts):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog are here with them", "en"), ("der Hund und die Katze sind mit ihnen hier", "de"), ("le chat et le chien sont avec eux ici", "fr"), ("русский текст о кошке", "ru")] * 8)]
    model = N.train(texts(train), learn_from=F.lit(True))
    docs = texts([(0, None), (1, ""), (2, "12 %%"), (3, "и кошка"), (4, "le chat et eux " * 30_000), (5, "und die"), (5, "und die")])
    found = sorted(N.identify(docs, model).collect(), key=lambda r: r.doc_id)
    assert [r.lang_pred for r in found] == ["und", "und", "und", "ru", "fr", "de", "de"] and found[0].score == 0
    empty = N.train(texts([(1, None, "en"), (2, "x", None)]), learn_from=F.lit(True))
    assert {r.lang_pred for r in N.identify(docs, empty).collect()} == {"und"}
    assert N.identify(texts([]), model).count() == 0


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    side = F.pmod(F.xxhash64(F.lit("test"), "doc_id"), F.lit(3))
    model = Q.train(docs, labels.where(side > 0))
    found = Q.classify(docs, model).join(labels.where(side == 0), "doc_id").select("quality", "score", "kept").collect()
    good, bad = [r for r in found if r.quality == 1], [r for r in found if r.quality == 0]
    assert len(bad) > 5 and np.mean([r.kept for r in good]) > 0.97 and np.mean([not r.kept for r in bad]) > 0.8


def test_quality_edge_cases(spark, texts):
    rows = [(None, None), (1, ""), (2, "%%% " * 50_000), (3, "plain words"), (3, "plain words")]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    assert Q.train(texts(rows), labels) is None
    assert {r.score for r in Q.classify(texts(rows), None).collect()} == {0.5}
    both = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    model = Q.train(texts(rows), both)
    assert model is not None and all(0 <= r.score <= 1 for r in Q.classify(texts(rows), model).collect())
    assert Q.classify(texts([]), model).count() == 0


def two_kinds(n, seed=0):
    """Documents of two kinds that differ in a few of their words and in their source, most of the time."""
    rng = np.random.default_rng(seed)
    words = [["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(300)] for _ in range(3)]
    rows = []
    for i in range(n):
        kind = i % 2
        own = [str(rng.choice(words[kind if rng.random() < 0.35 else 2])) for _ in range(60)]
        rows.append((i, " ".join(own), None, f"s{kind if rng.random() < 0.9 else 1 - kind}"))
    return rows


def test_co_training_uses_all_documents(spark, texts):
    docs = texts(two_kinds(800))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    share = {}
    for rounds in (0, 3):
        model = Q.train(docs, labels, rounds=rounds, give=0.3, sure=0.75)
        share[rounds] = np.mean([(r.p_text > 0.5) == (r.doc_id % 2 == 1) for r in Q.classify(docs, model).collect() if r.doc_id >= 40])
    assert share[3] > share[0] + 0.01 and share[3] > 0.8, share
    again = Q.train(docs.repartition(7), labels, rounds=3, give=0.3, sure=0.75)
    assert (again.text[0] == model.text[0]).all() and (again.meta[0] == model.meta[0]).all() and again.combined == model.combined


def test_bounds_of_what_is_sure():
    rng = np.random.default_rng(4)
    margin = rng.normal(0, 1, 5000)
    bins, n = np.unique(np.floor(margin / Q._BIN).astype(int), return_counts=True)
    low, high = Q.sure_bounds(dict(zip(bins.tolist(), n.tolist())), (0.1, 0.2), (-np.inf, np.inf))
    assert (low, high) == (-np.inf, np.inf)  # nothing is beyond such doubt
    low, high = Q.sure_bounds(dict(zip(bins.tolist(), n.tolist())), (0.1, 0.2), (0.0, 0.0))
    assert 0.1 <= np.mean(margin < low) < 0.11 and 0.2 <= np.mean(margin >= high) < 0.21


def small_net(seed=1, size=50):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, size).astype(float)
    return L.Net.start(counts), counts, rng


def test_probabilities_add_up():
    net, counts, rng = small_net()
    table = net.table(counts)
    around = rng.integers(0, net.size + 1, (7, 2 * L.WINDOW))
    total = sum(net.probabilities(table, around, np.full(7, w)).astype(float) for w in range(net.size))
    assert np.allclose(total, 1, atol=1e-4) and np.allclose(table.sum(axis=0), 1, atol=1e-4)


def test_gradient_equals_differences():
    net, counts, rng = small_net()
    for w in net.weights():
        w[...] = rng.normal(0, 0.5, w.shape)
    net.emb[net.size] = 0
    net = L.Net(net.size, *[w.astype(np.float64) for w in net.weights()], net.counts)
    table = net.table(counts).astype(np.float64)
    around, ids, weight = rng.integers(0, net.size + 1, (40, 2 * L.WINDOW)), rng.integers(0, net.size, 40), rng.integers(1, 4, 40).astype(float)
    learner = L.Learner(net, table, 0.1)
    ((rows, emb), *rest), share = learner.gradients(around, ids, weight)
    loss = lambda: -(np.log(learner.net.probabilities(table, around, ids)) * weight).sum() / weight.sum()
    whole = np.zeros_like(net.emb)
    whole[rows] = emb
    for w, g in zip(learner.net.weights(), [whole, *rest]):
        for at in [tuple(int(rng.integers(0, n)) for n in w.shape) for _ in range(6)]:
            if w is learner.net.emb and at[0] == net.size:
                continue
            kept, step = w[at], 1e-5
            w[at] = kept + step
            up = loss()
            w[at] = kept - step
            down = loss()
            w[at] = kept
            assert abs((up - down) / 2 / step - g[at]) < 1e-5 + 1e-3 * abs(g[at])
    assert np.allclose(share.sum(axis=1), 1)


def test_contexts_stay_in_their_text():
    around = L.contexts(np.arange(6), np.array([0, 2, 2, 6]), 99)
    assert around.tolist() == [[99, 99, 1, 99], [99, 0, 99, 99], [99, 99, 3, 4], [99, 2, 4, 5], [2, 3, 5, 99], [3, 4, 99, 99]]


def test_pseudo_likelihood(spark, texts):
    rows = [(i, "the dog saw the cat and the cat saw the dog " * 5 + f"x{i}") for i in range(60)] + [(60, None), (61, ""), (62, "unseen"), (63, "cat the the and dog saw dog cat " * 5), (64, "the dog " * 40_000), (62, "unseen"), (65, " \n")]
    model = L.train(texts(rows), bucket_tokens=500)
    assert abs(model.net.counts.sum() - sum(len((t or "").split()) for _, t in rows)) < 1  # every token of every text has fallen to some distribution
    found = L.score(texts(rows), model).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and by[0].mean_log_likelihood > by[62].mean_log_likelihood
    assert [(by[i].n_tokens, by[i].log_likelihood, by[i].mean_log_likelihood) for i in (60, 61, 65)] == [(0, 0.0, None)] * 3 and by[62].n_tokens == 1 and by[64].n_tokens == 80_000
    words, bounds = L.token_hashes(pa.array([rows[0][1]]))
    ids, _ = L.ids_of(words, model.known, model.ids, model.groups)
    wanted = np.log(model.net.probabilities(model.table, L.contexts(ids, bounds, model.size), ids).astype(float)).sum()
    assert abs(by[0].log_likelihood - wanted) < 1e-3
    empty = L.train(texts([]))
    assert L.score(texts([]), empty).count() == 0 and {r.log_likelihood for r in L.score(texts([(1, None)]), empty).collect()} == {0.0}


def test_rare_words_have_shares(spark, texts):
    rows = [(i, f"common words stand here {'rareone' if i % 3 == 0 else 'raretwo'} only{i}") for i in range(30)] + [(30, "rareone raretwo"), (31, None)]
    model = L.vocabulary(texts(rows), "text", words=4, groups=8)
    assert len(model.known) == 4 and model.all_counts.sum() == sum(len((t or "").split()) for _, t in rows)
    shares = {np.uint64(r.word % 2**64): r.log_share for r in model.rare.collect()}
    left = np.exp(model.unseen)  # what is left for words not seen, and the shares, add up to one in each group
    for word, share in shares.items():
        left[int(word % np.uint64(8))] += np.exp(share)
    assert len(shares) == 32 and np.allclose(left[model.unseen < 0], 1)
    model = L.train(texts(rows), model=model)
    docs = texts([(0, "rareone common rareone raretwo"), (1, "zzqx1 common zzqx1 zzqx2"), (0, "rareone common rareone raretwo")])
    found = {r.doc_id: r for r in L.score(docs, model).collect()}
    words, bounds = L.token_hashes(pa.array(["rareone common rareone raretwo"]))
    ids, odd = L.ids_of(words, model.known, model.ids, 8)
    wanted = np.log(model.net.probabilities(model.table, L.contexts(ids, bounds, model.size), ids).astype(float)).sum() + sum(shares[w] for w in words[odd])
    assert odd.sum() == 3 and abs(found[0].log_likelihood - wanted) < 1e-4 and found[0].log_likelihood > found[1].log_likelihood


def test_most_frequent_words(spark):
    rng = np.random.default_rng(6)
    rows = [(int(w), int(n)) for w, n in zip(rng.integers(-(2**63), 2**63 - 1, 3000), rng.zipf(1.5, 3000).clip(1, 10**6))]
    counted = spark.createDataFrame(rows, "word long, n long")
    ranked = sorted(rows, key=lambda r: (-r[1], r[0]))
    for words in (1, 10, 500, 1500, 2999, 3000, 5000):
        assert [(r.word, r.n) for r in L.most_frequent(counted, words)] == ranked[:words], words
    assert L.most_frequent(counted.where("false"), 5) == []


def test_context_beats_word_frequencies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = F.pmod(F.xxhash64(F.lit("held"), "text"), F.lit(4)) == 0
    means = []
    for parts in (1, 16):
        table = docs.where(~held).repartition(parts)
        model = L.train(table, bucket_tokens=100_000, scout_tokens=100_000)
        tokens = L.token_table(docs.where(held), model)
        found = L.score(docs.where(held), model, tokens=tokens).agg(F.sum("log_likelihood").alias("s"), F.sum("n_tokens").alias("n")).first()
        means.append(found.s / found.n)
    # Word frequencies alone: the same groups and shares, without the network.
    share = np.log((model.all_counts + 1) / (model.all_counts.sum() + model.size))
    alone = L.Model(model.known, model.ids, model.groups, model.all_counts, model.rare, model.unseen)
    alone.net = L.Net.start(model.all_counts)
    alone.table = np.repeat(np.exp(share)[:, None], L.MIXTURE, axis=1).astype(np.float32)
    found = L.score(docs.where(held), alone, tokens=tokens).agg(F.sum("log_likelihood").alias("s"), F.sum("n_tokens").alias("n")).first()
    assert abs(means[0] - means[1]) < 1e-9, means  # however the table lies
    assert means[0] > found.s / found.n + 0.3, (means, found.s / found.n)


def test_averages_in_levels(spark):
    rows = [(c, p, float(p % 3 + 1), np.full(4, p, dtype="<f4").tobytes()) for p in range(150) for c in range(2)]
    mean, n = L.average(spark.createDataFrame(rows, "chunk int, part long, n double, weights binary"))
    wanted = sum(p * (p % 3 + 1) for p in range(150)) / sum(p % 3 + 1 for p in range(150))
    assert len(mean) == 8 and np.allclose(mean, wanted, rtol=1e-4) and n == sum(p % 3 + 1 for p in range(150))


TEXTS = ["", " ", "a  b", "\tx", "\t", "x \n y", "it's. it's, 's.", "a\0b c", "<|endoftext|> a <|endoftext|>.", "word\n", "word\n\nx  ", "é à ü, ñ. 12,3 4.", "a .b ,c", "\x1c a", "Wort,\nWort. Wort", "日本 語。 x", "x" * 5000, "a b " * 9000]


def test_pieces_encode_as_whole_texts():
    of, rng = T.Encoder(T.vocabulary()), np.random.default_rng(3)
    odd = ["a", "b", " ", " ", "\n", "\t", ".", ",", "'s", "1", "é", "\x1c", "<|endoftext|>", "  ", "\r", "語", "\u00a0", "-", "\ue000"]
    random_texts = ["".join(rng.choice(odd, rng.integers(0, 14))) for _ in range(4000)]
    for part in (TEXTS, TEXTS[::-1], [None, "a", None], [], random_texts):
        ids, sizes = of.encode(pa.array(part, type=pa.string()))
        ends = np.cumsum(sizes)
        assert len(sizes) == len(part) and len(ids) == sum(sizes)
        for given, n, end in zip(part, sizes, ends):
            assert ids[end - n : end].tolist() == of.tokenizer.encode(given or "", add_special_tokens=False).ids, given[:40]


@pytest.mark.parametrize("longest", [4, 7, 16])
def test_code_lengths(longest):
    rng = np.random.default_rng(longest)
    counts = np.concatenate((rng.integers(1, 2 ** rng.integers(1, 20, 12)), np.zeros(3, dtype=int)))
    lengths = T.code_lengths(counts, longest)
    used = lengths[counts > 0].astype(int)
    assert used.max() <= longest and used.min() >= 1 and (lengths[counts == 0] == 0).all() and abs((0.5**used).sum() - 1) < 1e-9
    if longest == 16:  # plain Huffman, if its codes are short enough
        import heapq

        heap, cost = [int(c) for c in counts[counts > 0]], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a + b
            heapq.heappush(heap, a + b)
        assert int((used * counts[counts > 0]).sum()) == cost


def test_blocks_decode_alone():
    rng = np.random.default_rng(9)
    docs = [rng.zipf(1.4, n).clip(0, 499).astype(np.uint16) for n in (1, 5000, 17, 1024, 2049)]
    lengths = T.code_lengths(np.bincount(np.concatenate(docs), minlength=500), 12)
    shard = T.build_shard([(i, len(d), p, m) for i, (d, (p, m)) in enumerate(zip(docs, T.pack(docs, lengths, T.canonical_codes(lengths)[1])))], 11, lengths)
    start = 11
    for d, (i, at, ids) in zip(docs, T.read_shard(shard)):
        assert at == start and (ids == d).all()
        start += len(d)
    payload, marks = T.pack([docs[1]], lengths, T.canonical_codes(lengths)[1])[0]
    alone = T.unpack(payload, np.frombuffer(marks, dtype="<u8")[2:3], np.array([T.BLOCK]), lengths)
    assert (alone == docs[1][2 * T.BLOCK : 3 * T.BLOCK]).all()


def test_round_trip(spark, texts, tmp_path):
    rows = [(7 * i % 31 - 5, t) for i, t in enumerate(TEXTS)] + [(None, "none"), (2**60, None), (3, "again"), (3, "again")]
    T.write_tokens(texts(rows), f"file://{tmp_path}/out", tokenizer=T.vocabulary(), shard_tokens=4000)
    assert len(list((tmp_path / "out").glob("*.huff"))) > 2
    found = sorted(T.read_tokens(spark, f"file://{tmp_path}/out").collect(), key=lambda r: r.start)
    of, start = T.encoder(T.vocabulary()).tokenizer, 0
    ids = lambda t: [*of.encode(t or "", add_special_tokens=False).ids, 2]
    wanted = sorted(((d is not None, d or 0, len(ids(t)), zlib.crc32(np.array(ids(t), dtype="<u4").tobytes())) for d, t in rows), key=lambda r: r[:3])
    for (known, doc, n, crc), r in zip(wanted, found, strict=True):
        assert (r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) == (known, doc, start, n, crc)
        start += n
    T.write_tokens(texts([]), f"file://{tmp_path}/none", tokenizer=T.vocabulary())
    assert T.read_tokens(spark, f"file://{tmp_path}/none").count() == 0


def test_hot_id_has_several_shards(spark, texts, tmp_path):
    rows = [(None, f"row {i} without id") for i in range(300)] + [(7, f"row {i} of seven") for i in range(300)] + [(i, f"one {i}") for i in range(20)]
    T.write_tokens(texts(rows), f"file://{tmp_path}/out", tokenizer=T.vocabulary(), shard_tokens=200)
    found = sorted(T.read_tokens(spark, f"file://{tmp_path}/out").collect(), key=lambda r: r.start)
    assert len(list((tmp_path / "out").glob("*.huff"))) > 12
    assert [(r.doc_id is not None, r.doc_id or 0) for r in found] == sorted((d is not None, d or 0) for d, _ in rows)
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)]).tolist()[:-1]
    of = T.encoder(T.vocabulary()).tokenizer
    crc = lambda t: zlib.crc32(np.array([*of.encode(t, add_special_tokens=False).ids, 2], dtype="<u4").tobytes())
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.ids_crc32) for r in found)) == sorted((d is None, d or 0, crc(t)) for d, t in rows)


def test_pipeline_stages(spark, texts):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, seen = docs, []
    for name, stage in C.STAGES:
        after = stage(spark, before, SF)
        path = f"{T.new_folder(spark, 'test')}"
        after.write.parquet(path)
        seen.append((name, spark.read.parquet(path)))
        assert name == "token_output" or after.columns == docs.columns
        before = seen[-1][1]
    kept = {name: {r.doc_id for r in rows.select("doc_id").collect()} for name, rows in seen}
    assert kept["token_output"] == kept["mixing"] <= kept["decontamination"] <= kept["jaccard_join"] <= kept["language_id"]
    joined = {r.doc_id: r for r in C.jaccard_join(seen[0][1]).collect()}
    assert kept["jaccard_join"] == {r.class_id for r in joined.values()}
    whole = seen[3][1].select("text").collect()
    last = seen[4][1].collect()
    assert len(last) == len(whole) and sum(r.n_tokens for r in last) == sum(len(T.encoder(T.vocabulary()).tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in whole)


ODD_ROWS = [(1, None), (2, ""), (3, "12"), (None, "some words"), (4, "some words"), (4, "some words"), (5, "x y z " * 60_000)]


def test_pipeline_stages_compose_unwritten(spark, texts):
    """Stages over the unwritten output of those before them, on rows whose columns clash with the operators', and with labels to learn languages from."""
    import corpus_pipeline as C

    languages = [(100 + i, f"plain english words about thing {i} and some more", "en") for i in range(30)] + [(200 + i, f"einige deutsche wörter über ding {i} und noch mehr", "de") for i in range(30)]
    out = odd = texts([*((*r, "en") for r in ODD_ROWS), *languages])
    sizes = []
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == odd.columns
        rows = out.collect()
        sizes.append(len(rows))
        for r in rows:  # a user's columns stay what they are
            assert (r.n_words, r.score, r.size, r.kept, r.spans, r.text_hash, r._row, r.row) == (7, "a", "b", "c", "d", "e", "f", "n")
        assert {r.doc_id for r in rows} >= {4, 5}
    assert sizes[0] == 64 and sizes[1] < 64 and min(sizes) > 40  # null, empty and letterless texts go; copies and near copies are one


def test_pipeline_without_labels_or_rows(spark, texts):
    """Nothing to learn languages from is no reason to lose documents; empty tables stay empty."""
    import corpus_pipeline as C

    odd = texts(ODD_ROWS)
    kept = C.language_id(spark, odd, SF)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((d or 0, t or "") for d, t in ODD_ROWS)
    empty = texts([])
    for _, stage in C.STAGES[:-1]:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_labels_of_absent_ids_do_not_cost_the_model(spark, texts):
    rows = [(i, ("good clear sentence about rivers and hills " if i % 2 else "buy now click win $$$ ### ") * (3 + i % 4), "en", "web", 100) for i in range(200)]
    labels = spark.range(0, 200).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality").union(spark.range(10_000, 210_000).selectExpr("id", "cast(id % 2 AS int)"))
    model = Q.train(texts(rows), labels, labelled_rows=100)
    assert model is not None
    found = {r.doc_id: r.kept for r in Q.classify(texts(rows), model).select("doc_id", "kept").collect()}
    assert np.mean([found[i] == bool(i % 2) for i in range(200)]) > 0.95
