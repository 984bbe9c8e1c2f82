"""Masked pseudo-likelihood: a bidirectional window network predicts every token from the words on both sides.

Tokens are lower-cased words, known by 64-bit hashes. The corpus's most frequent words have ids of their own; all others share ``groups`` ids by their hash, and a
word's probability is its group's times its share in the group, from the counts of all words of the corpus. The network sums position-scaled embeddings
of the ``WINDOW`` tokens on either side and weighs ``MIXTURE`` distributions over all ids by what it makes of them, so that the probabilities of the
masked token add up to one. The sum of the log-probabilities of all tokens of a text is its pseudo-log-likelihood.

Training: distinct texts lie in buckets by their hash, whatever the table's partitions. One task learns from a bounded sample where to begin. From there every bucket takes
gradient steps over all its tokens and counts, for each distribution, the share of every token that falls to it; weights are averaged, and counts added, in a
tree of small groups. Copies of a text count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, discard, documents, free_name, give_back, runs_of, small_batches, text_words, written

WINDOW, DIM, MIXTURE = 2, 16, 16
#: A vector of weights and counts is averaged in chunks of this length, of at most ``FAN_IN`` buckets at a time.
CHUNK, FAN_IN = 1 << 16, 64


@dataclass
class Net:
    """Weights of the network, and ``counts`` (ids by distributions) of the tokens that fell to each distribution.

    Id ``size`` stands for places outside the text.
    """

    size: int
    emb: np.ndarray
    pos: np.ndarray
    bias: np.ndarray
    gate: np.ndarray
    gate_b: np.ndarray
    counts: np.ndarray

    @staticmethod
    def start(counts: np.ndarray, seed: int = 11) -> Net:
        """Small random weights; every distribution is the corpus's own, but for noise that tells them apart."""
        rng, size = np.random.default_rng(seed), len(counts)
        noise = rng.normal(0, 0.3, (size, MIXTURE))
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        net = Net(size, normal(0.5, size + 1, DIM), normal(0.5, 2 * WINDOW, DIM) + 1, np.zeros(DIM, np.float32), normal(0.5, DIM, MIXTURE), np.zeros(MIXTURE, np.float32), np.zeros((size, MIXTURE)))
        net.emb[size] = 0
        net.counts[:] = counts[:, None] * np.exp(noise) / MIXTURE
        return net

    def weights(self) -> list[np.ndarray]:
        return [self.emb, self.pos, self.bias, self.gate, self.gate_b]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in (*self.weights(), self.counts)])

    def like(self, flat: np.ndarray) -> Net:
        """A network of this shape from a flat vector."""
        out, at = [], 0
        for w in (*self.weights(), self.counts):
            out.append(flat[at : at + w.size].reshape(w.shape).astype(w.dtype))
            at += w.size
        return Net(self.size, *out)

    def table(self, all_counts: np.ndarray, smooth: float = 1000.0) -> np.ndarray:
        """Probability of every id under every distribution: its counts, and ``smooth`` tokens more that are dealt out as the corpus's are."""
        share = (all_counts + 1.0) / (all_counts.sum() + len(all_counts))
        return ((self.counts + smooth * share[:, None]) / (self.counts.sum(axis=0) + smooth)).astype(np.float32)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = self.emb.take(around[:, 0], axis=0) * self.pos[0]
        for k in range(1, 2 * WINDOW):
            h += self.emb.take(around[:, k], axis=0) * self.pos[k]
        h += self.bias
        return np.tanh(h, out=h)

    def mixture(self, h: np.ndarray) -> np.ndarray:
        a = h @ self.gate + self.gate_b
        a -= a.max(axis=1, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(axis=1, keepdims=True)
        return a

    def probabilities(self, table: np.ndarray, around: np.ndarray, ids: np.ndarray) -> np.ndarray:
        mixed = self.mixture(self.hidden(around))
        mixed *= table.take(ids, axis=0)
        return mixed.sum(axis=1)


def contexts(ids: np.ndarray, bounds: np.ndarray, outside: int) -> np.ndarray:
    """The tokens on both sides of every token of texts that stand one after another; ``outside`` beyond a text's ends."""
    n = len(ids)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.arange(n)
    out = np.full((n, 2 * WINDOW), outside, dtype=np.int32)
    for column, step in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        own = place[(place + step >= bounds[text]) & (place + step < bounds[text + 1])]
        out[own, column] = ids[own + step]
    return out


class Learner:
    """Adagrad on minibatches of the negative log-probability; tokens have weights."""

    def __init__(self, net: Net, table: np.ndarray, rate: float, sums: list[np.ndarray] | None = None):
        self.net = Net(net.size, *[w.copy() for w in net.weights()], np.zeros_like(net.counts))
        self.table, self.rate = table, rate
        self.sums = [s.copy() for s in sums] if sums else [np.full(w.shape, 1e-3, dtype=np.float32) for w in net.weights()]

    def gradients(self, around: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> tuple[list, np.ndarray]:
        """Of the mean loss: rows of emb and their gradients, then those of the other weights; and each token's shares of the distributions."""
        net, n = self.net, len(ids)
        h = net.hidden(around)
        gate = net.mixture(h)
        share = gate * self.table[ids]
        share /= share.sum(axis=1, keepdims=True)
        d = (gate - share) * (weight / weight.sum())[:, None].astype(np.float32)
        dh = (d @ net.gate.T) * (1 - h * h)
        own = around.T.ravel()
        pulled = (dh[None] * net.pos[:, None]).reshape(-1, DIM)
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        rows, emb = own[order[first]], np.add.reduceat(pulled[order], first, axis=0)
        if rows[-1] == net.size:
            rows, emb = rows[:-1], emb[:-1]
        pos = np.stack([(dh * net.emb.take(around[:, k], axis=0)).sum(axis=0) for k in range(2 * WINDOW)])
        return [(rows, emb), pos, dh.sum(axis=0), h.T @ d, d.sum(axis=0)], share

    def step(self, around: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Gives each token's shares of the distributions."""
        ((rows, emb), *rest), share = self.gradients(around, ids, weight)
        sums = self.sums[0][rows] + emb * emb
        self.sums[0][rows] = sums
        self.net.emb[rows] -= self.rate * emb / np.sqrt(sums)
        for w, s, g in zip(self.net.weights()[1:], self.sums[1:], rest, strict=True):
            s += g * g
            w -= self.rate * g / np.sqrt(s)
        return share

    def count(self, ids: np.ndarray, share: np.ndarray, weight: np.ndarray) -> None:
        for k in range(MIXTURE):
            self.net.counts[:, k] += np.bincount(ids, weights=share[:, k] * weight, minlength=self.net.size)


def learn(learner: Learner, ids: np.ndarray, bounds: np.ndarray, copies: np.ndarray, batch_size: int, seed: int) -> None:
    """Steps over all tokens of some texts, in a seeded order."""
    around, weight = contexts(ids, bounds, learner.net.size), np.repeat(copies, np.diff(bounds)).astype(np.float64)
    order = np.random.default_rng(seed).permutation(len(ids))
    around, ids, weight, share = around[order], ids[order], weight[order], np.empty((len(ids), MIXTURE), dtype=np.float32)
    for at in range(0, len(ids), batch_size):
        own = slice(at, at + batch_size)
        share[own] = learner.step(around[own], ids[own], weight[own])
    learner.count(ids, share, weight)


@dataclass
class Model:
    """``known``: hashes of the most frequent words, sorted, and ``ids`` their ids (from 0 by frequency); groups of all others follow.

    ``all_counts``: tokens by id. ``rare`` holds word (hash) and log_share (in its group) of all other words, ``unseen`` the log_share of a word that the corpus lacks.
    """

    known: np.ndarray
    ids: np.ndarray
    groups: int
    all_counts: np.ndarray
    rare: DataFrame | None
    unseen: np.ndarray
    net: Net | None = None
    table: np.ndarray | None = field(default=None, repr=False)

    @property
    def size(self) -> int:
        return len(self.known) + self.groups


def ids_of(words: np.ndarray, known: np.ndarray, ids: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words by their hashes, and which of them have none of their own."""
    at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
    own = known[at] == words if len(known) else np.zeros(len(words), dtype=bool)
    group = len(known) + (words % np.uint64(groups)).astype(np.int64)
    return np.where(own, ids[at] if len(ids) else 0, group).astype(np.int64), ~own


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_words(pc.utf8_lower(texts.cast(pa.string())))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (texts,) in chunks(batches):
        words, n = np.unique(token_hashes(texts)[0], return_counts=True)
        yield pa.record_batch({"word": pa.array(words.astype(np.int64)), "n": pa.array(n.astype(np.int64))})
    give_back()


def most_frequent(counted: DataFrame, words: int) -> list:
    """The first ``words`` rows of (word, n) by n, ties by word. A histogram tells which rows can be among them, so that no more come to the driver, however many tasks there are."""
    steps = F.floor(F.log2("n") * 16)
    sizes = sorted(((r["step"], r["size"]) for r in counted.groupBy(steps.alias("step")).agg(F.count("*").alias("size")).collect()), reverse=True)
    held, last = 0, None
    for step, size in sizes:
        if held + size >= words:
            last = (step, size, words - held)
            break
        held += size
    if last is None:
        found = counted.collect()
    else:
        step, size, need = last
        found = counted.where(steps > step).collect()
        share = 1.0 if step >= 64 else min(1.0, 1.5 * need / size + 1e-6)
        while True:  # a step below 16 is one number; its words come by their hash
            rest = counted.where((steps == step) & (F.col("word") <= int(-(2**63) + share * (2**64 - 1)))).collect() if share < 1 else counted.where(steps == step).collect()
            if len(rest) >= need:
                break
            share = min(1.0, 2 * share)
        found += rest
    return sorted(found, key=lambda r: (-r["n"], r["word"]))[:words]


def vocabulary(docs: DataFrame, text_col: str, words: int, groups: int) -> Model:
    """Ids of the most frequent words, ties by hash, and counts by id; all words of all texts are counted.

    In a group of N tokens and D words a word that occurs n times has the share (n + 1) / (N + D + 1), so that one part is left for words not seen. The
    table of shares is not collected.
    """
    counted = written(docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull()).mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = most_frequent(counted, words)
    hashes = np.array([r["word"] for r in top], dtype=np.int64).astype(np.uint64)
    order = np.argsort(hashes)
    model = Model(hashes[order], order, groups, np.zeros(len(top) + groups), None, np.zeros(groups))
    model.all_counts[: len(top)] = [r["n"] for r in top]
    if len(top) < words:
        return model
    least = top[-1]
    others = counted.where((F.col("n") < least["n"]) | ((F.col("n") == least["n"]) & (F.col("word") > least["word"]))).withColumn("group", _group_of("word", groups))
    totals = others.groupBy("group").agg(F.sum("n").alias("all"), F.count("*").alias("words"))
    for r in totals.collect():
        model.all_counts[len(top) + r["group"]] = r["all"]
        model.unseen[r["group"]] = -np.log(r["all"] + r["words"] + 1)
    model.rare = others.join(F.broadcast(totals), "group").select("word", F.log((F.col("n") + 1) / (F.col("all") + F.col("words") + 1)).alias("log_share"))
    return model


def _group_of(word: str, groups: int):
    """The group of a hash, which is a signed number here and an unsigned one in :func:`ids_of`; ``groups`` is a power of two, so that both agree."""
    return F.pmod(F.col(word), F.lit(groups)).cast("int")


def _tokens(held):
    """(key, ids, rare) of (key, text): ids as unsigned 32-bit integers, and the hashes of tokens whose word has no id of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, groups = held.value
        for keys, texts in chunks(batches, 4 << 20):
            words, bounds = token_hashes(texts)
            own, odd = ids_of(words, known, ids, groups)
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(own.astype("<u4"))])
            rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(odd))[bounds].astype(np.int32)), pa.array(words[odd].astype(np.int64)))
            yield pa.record_batch({"key": keys, "ids": raw, "rare": rare})
        give_back()

    return run


def token_table(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Distinct texts: key (hash), copies, ids and rare. Null texts have no row."""
    held = docs.sparkSession.sparkContext.broadcast((model.known, model.ids, model.groups))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(_tokens(held), "key long, ids binary, rare array<long>")
    copies = docs.where(F.col(text_col).isNotNull()).groupBy(F.xxhash64(text_col).alias("key")).agg(F.count("*").alias("copies"))
    return written(rows.dropDuplicates(["key"]).join(copies, "key"), "tokens")


def _texts(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = [np.frombuffer(i, dtype="<u4") for i in rows["ids"]]
    return np.concatenate(ids).astype(np.int64), np.append(0, np.cumsum([len(i) for i in ids])), rows["copies"].to_numpy()


def scout(net: Net, counts: np.ndarray, ids: np.ndarray, bounds: np.ndarray, copies: np.ndarray, epochs: int, batch_size: int = 512, rate: float = 0.5, piece: int = 40_000, keep: float = 0.9) -> tuple[Net, list[np.ndarray]]:
    """The network, and sums of squared gradients, after some epochs over a few texts; distributions follow after every ``piece`` tokens, and forget."""
    sums = held = None
    cuts = np.unique(np.append(np.searchsorted(bounds, np.arange(0, bounds[-1], piece)), len(bounds) - 1))
    for epoch in range(epochs):
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            learner = Learner(net, net.table(counts), rate, sums)
            learn(learner, ids[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], copies[a:b], batch_size, epoch)
            net, sums = learner.net, learner.sums
            held = net.counts if held is None else keep * held + net.counts
            net.counts = held
    return net, sums


def _scout(held, tokens: int, epochs: int):
    """Where to begin, from the first ``tokens`` tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, counts = held.value
        kept, n = [], 0
        for batch in batches:
            kept.append(batch)
            n += sum(map(len, batch["ids"])) // 4
            if n >= tokens:
                break
        if not n:
            return
        net, sums = scout(net, counts, *_texts(pd.concat(kept)), epochs)
        flat = np.concatenate([net.flat(), *[s.ravel() for s in sums]])
        yield pd.DataFrame({"chunk": range(-(-len(flat) // CHUNK)), "weights": [flat[i : i + CHUNK].astype("<f4").tobytes() for i in range(0, len(flat), CHUNK)]})

    return run


def _trainer(held, batch_size: int, memory: int = 1 << 18):
    """Every bucket learns from its texts and gives its weights and counts (as shares of its tokens) in chunks, with the number of tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, table, sums = held.value
        now, learner, n, kept, size = None, None, 0, [], 0

        def take() -> None:
            nonlocal kept, size, n
            if size:
                texts = _texts(pd.concat(kept))
                learn(learner, *texts, batch_size, size)
                n += int((np.diff(texts[1]) * texts[2]).sum())
            kept, size = [], 0

        def give() -> pd.DataFrame:
            learner.net.counts /= max(1, n)
            flat = learner.net.flat()
            return pd.DataFrame({"chunk": range(-(-len(flat) // CHUNK)), "part": now, "n": float(n), "weights": [flat[i : i + CHUNK].astype("<f4").tobytes() for i in range(0, len(flat), CHUNK)]})

        for batch, starts in runs_of(batches, ["bucket"]):
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                bucket = int(batch["bucket"].iloc[a])
                if bucket != now:
                    take()
                    if n:
                        yield give()
                    now, learner, n = bucket, Learner(net, table, 0.1, sums), 0
                for i in range(a, b, 256):
                    kept.append(batch.iloc[i : min(b, i + 256)])
                    size += sum(map(len, kept[-1]["ids"])) // 4
                    if size >= memory:
                        take()
        if now is not None:
            take()
            if n:
                yield give()
        give_back()

    return run


def _average(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("part")
    n = group["n"].to_numpy()
    mean = sum(np.frombuffer(w, dtype="<f4").astype(np.float64) * k for w, k in zip(group["weights"], n, strict=True)) / n.sum()
    return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "part": [group["part"].iloc[0] // FAN_IN], "n": [n.sum()], "weights": [mean.astype("<f4").tobytes()]})


def average(trained: DataFrame) -> tuple[np.ndarray, float] | None:
    """Mean of all buckets' vectors by tokens, and the number of tokens; at most ``FAN_IN`` of them meet in one group of one level."""
    now = written(trained, "weights")
    while True:
        most = now.agg(F.max("part")).first()[0]
        if most is None:
            return None
        after = written(now.groupBy("chunk", F.floor(F.col("part") / FAN_IN).alias("_group")).applyInPandas(_average, now.schema), "weights")
        discard(now)
        now = after
        if most < FAN_IN:
            rows = sorted(now.collect(), key=lambda r: r["chunk"])
            discard(now)
            return np.concatenate([np.frombuffer(r["weights"], dtype="<f4") for r in rows]), rows[0]["n"]


@small_batches
def train(docs: DataFrame, *, text_col: str = "text", words: int = 31_744, groups: int = 1024, scout_tokens: int = 400_000, epochs: int = 4, bucket_tokens: int = 4 << 20, batch_size: int = 2048, tokens: DataFrame | None = None, model: Model | None = None) -> Model:
    """A model that has counted all words and has learned from every token of every text.

    ``words`` is the number of words with ids of their own (fewer if there are fewer), ``groups`` (a power of two) that of the groups of all others. The first steps, from
    ``scout_tokens`` tokens (or a text more), only set where all buckets begin. Nulls, empty texts and texts of white space teach nothing; very long texts are learned from whole;
    copies count as often as they occur. The model does not depend on how the table lies in partitions. ``model`` and ``tokens`` are the results of :func:`vocabulary` and :func:`token_table`,
    if at hand.
    """
    spark: SparkSession = docs.sparkSession
    model = model or vocabulary(docs, text_col, words, groups)
    tokens = tokens or token_table(docs, model, text_col)
    total = model.all_counts.sum()
    net = Net.start(model.all_counts)
    model.net, model.table = net, net.table(model.all_counts)
    if not total:
        return model
    part = max(1, int(total // (2 * scout_tokens)))
    first = tokens.where((F.pmod(F.xxhash64(F.lit("scout"), "key"), F.lit(part)) == 0) & (F.octet_length("ids") > 0)).orderBy("key").select("ids", "copies")
    held = spark.sparkContext.broadcast((net, model.all_counts))
    rows = sorted(first.coalesce(1).mapInPandas(_scout(held, scout_tokens, epochs), "chunk int, weights binary").collect(), key=lambda r: r["chunk"])
    sums = None
    if rows:
        flat = np.concatenate([np.frombuffer(r["weights"], dtype="<f4") for r in rows])
        n = len(net.flat())
        net, at, sums = net.like(flat[:n]), n, []
        for w in net.weights():
            sums.append(flat[at : at + w.size].reshape(w.shape))
            at += w.size
    held = spark.sparkContext.broadcast((net, net.table(model.all_counts), sums))
    buckets = max(1, int(total // bucket_tokens))
    dealt = tokens.select(F.pmod(F.xxhash64(F.lit("bucket"), "key"), F.lit(buckets)).cast("int").alias("bucket"), "key", "ids", "copies").where(F.octet_length("ids") > 0)
    dealt = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key")
    found = average(dealt.mapInPandas(_trainer(held, batch_size), "chunk int, part long, n double, weights binary"))
    if found:
        net = net.like(found[0])
        net.counts *= found[1]
    model.net, model.table = net, net.table(model.all_counts)
    return model


def _scorer(held):
    """Log-probability of all tokens of each text, but for shares in groups."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, table = held.value
        for batch in batches:
            lengths = np.array([len(i) // 4 for i in batch["ids"]], dtype=np.int64)
            sums, at, ends = np.zeros(len(batch)), 0, np.cumsum(lengths)
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 18), side="right")))
                ids, bounds, _ = _texts(batch.iloc[at:to])
                around, logs = contexts(ids, bounds, net.size), np.empty(len(ids))
                for i in range(0, len(ids), 8192):
                    logs[i : i + 8192] = np.log(net.probabilities(table, around[i : i + 8192], ids[i : i + 8192]))
                sums[at:to] = np.diff(np.append(0, np.cumsum(logs))[bounds])
                at = to
            yield pd.DataFrame({"key": batch["key"], "n_tokens": lengths, "sum": sums})
        give_back()

    return run


@small_batches
def score(docs: DataFrame, model: Model, *, text_col: str = "text", tokens: DataFrame | None = None) -> DataFrame:
    """``docs`` with n_tokens (long), log_likelihood (sum over all tokens of the whole text) and mean_log_likelihood.

    A text without words (null, empty, white space) has sum 0 and a null mean. Copies have equal scores; very long texts are scored whole. Columns of these names
    are replaced. ``tokens`` is the result of :func:`token_table` for ``docs``, if at hand.
    """
    spark = docs.sparkSession
    tokens = tokens or token_table(docs, model, text_col)
    held = spark.sparkContext.broadcast((model.net, model.table))
    scored = written(tokens.select("key", "ids", "copies").mapInPandas(_scorer(held), "key long, n_tokens long, sum double"), "scored")
    odd = tokens.select("key", F.explode("rare").alias("word"))
    unseen = spark.createDataFrame([(g, float(v)) for g, v in enumerate(model.unseen)], "group int, unseen double")
    share = odd.withColumn("group", _group_of("word", model.groups)).join(F.broadcast(unseen), "group")
    share = share.join(model.rare, "word", "left").withColumn("unseen", F.coalesce("log_share", "unseen")) if model.rare is not None else share
    rare = share.groupBy("key").agg(F.sum("unseen").alias("rare"))
    key, n, total = (free_name(docs, c) for c in ("key", "n", "total"))
    whole = written(scored.join(rare, "key", "left").select(F.col("key").alias(key), F.col("n_tokens").alias(n), (F.col("sum") + F.coalesce("rare", F.lit(0.0))).alias(total)), "scores")
    discard(scored)
    found = docs.withColumn(key, F.xxhash64(text_col)).join(whole, key, "left")
    found = found.withColumns({"n_tokens": F.coalesce(n, F.lit(0).cast("long")), "log_likelihood": F.coalesce(total, F.lit(0.0))}).drop(key, n, total)
    return found.withColumn("mean_log_likelihood", F.try_divide("log_likelihood", "n_tokens"))


def op2_pseudo_likelihood(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = vocabulary(docs, "text", 31_744, 1024)
    tokens = token_table(docs, model)
    scored = score(docs, train(docs, model=model, tokens=tokens), tokens=tokens).drop("text")
    return scored
