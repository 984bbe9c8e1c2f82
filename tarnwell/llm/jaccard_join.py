"""Similarity join of word n-gram sets by chosen paths.

Documents with equal sets are one node. In every run a node of n shingles chooses those whose hash lies below 1 / (threshold * n); each chosen shingle is
a bucket. A bucket over ``block`` nodes whose mean similarity is low is split again by shingles chosen with another hash; small buckets, those of high
mean similarity and those at the last level are compared by brute force, in tiles of two blocks. Two sets over the threshold share a bucket of one run with a
probability that has a lower bound, and runs repeat until that bound reaches the target recall.

Brute force first compares 64-bin one-permutation sketches; nodes with no partner far below the threshold leave. Shingle sets are then
computed again from the texts of the remaining nodes and compared exactly. A pair that meets in several buckets counts in the first of them, so that
links are counted once although no list of pairs is made.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, discard, documents, give_back, mix64, runs_of, small_batches, spread, structs, text_words, written
from .components import components

LEVELS = 3
BINS = 64
_MULT = np.uint64(0x9E3779B97F4A7C15)


def runs_for(recall: float, threshold: float, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold, nested sets, has met at the last level with probability ``recall`` or more."""
    share = (1 - math.exp(-1)) * (1 - math.exp(-2)) ** (levels - 1)
    return math.ceil(math.log(1 - recall) / math.log(1 - share))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct 64-bit hashes of all windows of ``width`` words; a shorter text of at least one word is one window."""
    words, bounds = text_words(texts)

    def windows(part: np.ndarray, wide: int) -> np.ndarray:
        found = np.zeros(max(0, len(part) - wide + 1), dtype=np.uint64)
        for k in range(wide):
            found = found * _MULT + part[k : k + len(found)] + np.uint64(k + 1)
        return mix64(found)

    whole = windows(words, width)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out.append(np.unique(whole[a : b - width + 1]) if b - a >= width else windows(words[a:b], b - a) if b > a else words[:0])
    return out


def sketch(found: np.ndarray) -> np.ndarray:
    """Least hash of each of ``BINS`` ranges, 16 bits; 0 for none."""
    at = np.searchsorted(found, np.arange(BINS, dtype=np.uint64) << np.uint64(58))
    ends = np.append(at[1:], len(found))
    values = ((found[np.minimum(at, len(found) - 1)] >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.uint16)
    return np.where(ends > at, np.maximum(values, 1), 0).astype("<u2")


def choose(found: np.ndarray, runs: int, threshold: float, level: int) -> np.ndarray:
    """The shingles chosen at a level in all runs, as run << 32 | 32 bits of the shingle. Deeper levels choose twice as many as the first.

    Shingles are hashes already, so a multiplication gives each level an order of its own. A run chooses those that fall into a range of it; the ranges of
    different runs begin at equal distances and, but for small sets, are disjoint, which only helps runs to find what others miss.
    """
    place = found * (mix64(np.array([level + 1], dtype=np.uint64) * _MULT) | np.uint64(1))
    step = (1 << 64) // runs
    wide = min(int((2.0 if level else 1.0) / (threshold * max(1, len(found))) * 2.0**64), (1 << 64) - 1)
    if wide <= step:
        run = place // np.uint64(step)
        at = np.flatnonzero((place - run * np.uint64(step) < np.uint64(wide)) & (run < np.uint64(runs)))
        run = run[at]
    else:
        run, at = np.nonzero(place[None] - (np.arange(runs, dtype=np.uint64) * np.uint64(step))[:, None] < np.uint64(wide))
    return (run.astype(np.uint64) << np.uint64(32) | found[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _signatures(width: int, runs: int, threshold: float):
    shape = pa.struct([("node", pa.binary()), ("n", pa.int64()), ("sketch", pa.binary()), ("l0", pa.list_(pa.int64()))])
    none = (b"", 0, b"", np.zeros(0, dtype=np.int64))

    def sign(texts: pa.Array) -> pa.Array:
        return structs([(_name(found), len(found), sketch(found).tobytes(), choose(found, runs, threshold, 0)) if len(found) else none for found in shingle_sets(texts, width)], shape)

    return lambda: sign


def _next_picks(width: int, runs: int, threshold: float):
    shape = pa.struct([("node", pa.binary()), *((f"l{k}", pa.list_(pa.int64())) for k in range(1, LEVELS))])

    def picks(texts: pa.Array) -> pa.Array:
        return structs([(_name(found), *(choose(found, runs, threshold, k) for k in range(1, LEVELS))) for found in shingle_sets(texts, width)], shape)

    return lambda: picks


def _name(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else b""


def _sets_of(width: int):
    shape = pa.struct([("node", pa.binary()), ("set", pa.binary())])

    def sets(texts: pa.Array) -> pa.Array:
        return structs([(_name(found), found.tobytes()) for found in shingle_sets(texts, width)], shape)

    return lambda: sets


def _labels(linked: np.ndarray) -> np.ndarray:
    """Least index reachable from every index of a symmetric boolean matrix. Each row is read once."""
    label = np.full(len(linked), -1)
    for i in range(len(linked)):
        if label[i] < 0:
            label[i], front = i, np.array([i])
            while len(front):
                reached = np.zeros(len(linked), dtype=bool)
                for at in range(0, len(front), 256):
                    reached |= linked[front[at : at + 256]].any(axis=0)
                front = np.flatnonzero(reached & (label < 0))
                label[front] = i
    return label


def _alike(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, threshold: float, least: float) -> np.ndarray:
    """Which pairs of two lists of sketches, each in order of set size, may be similar: sizes within the threshold, and ``least`` of their bins agree."""
    out = np.zeros((len(a), len(b)), dtype=bool)
    for i in range(0, len(a), 32):
        low, high = np.searchsorted(sizes_b, [threshold * sizes_a[i] - 1e-9, sizes_a[min(i + 32, len(a)) - 1] / threshold + 1e-9])
        for j in range(int(low), int(high), 256):
            x, y = a[i : i + 32, None, :], b[None, j : min(j + 256, int(high))]
            same = np.count_nonzero((x == y) & (x != 0), axis=2)
            out[i : i + 32, j : j + y.shape[1]] = same >= least * np.count_nonzero((x | y) != 0, axis=2)
    return out


def _candidates(threshold: float, least: float):
    """From (path, ti, tj, side, node, n, sketch) to (cid, node, entry): groups of nodes linked by their sketches.

    cid tells the group by its members, so that the same group of other buckets gets the same. Its last two bits: 0 all pairs, 2 and 3 the two
    sides of which only pairs across count.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, starts in runs_of(batches, ["path", "ti", "tj"]):
            nodes, sides, sizes = batch["node"].to_list(), batch["side"].to_numpy(), batch["n"].to_numpy()
            cross = (batch["ti"] != batch["tj"]).to_numpy()
            prints = np.frombuffer(b"".join(batch["sketch"]), dtype="<u2").reshape(-1, BINS)
            rows = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b - a < 2:
                    continue
                order = a + np.argsort(sizes[a:b], kind="stable")
                if cross[a]:
                    left, right = order[sides[order] == 0], order[sides[order] == 1]
                    linked = np.zeros((b - a, b - a), dtype=bool)
                    linked[np.ix_(left - a, right - a)] = _alike(prints[left], prints[right], sizes[left], sizes[right], threshold, least)
                    linked |= linked.T
                else:
                    linked = np.zeros((b - a, b - a), dtype=bool)
                    linked[np.ix_(order - a, order - a)] = _alike(prints[order], prints[order], sizes[order], sizes[order], threshold, least)
                    linked |= linked.T
                    np.fill_diagonal(linked, False)
                alive = np.flatnonzero(linked.any(axis=1))
                if not len(alive):
                    continue
                label = _labels(linked[np.ix_(alive, alive)])
                for root in np.unique(label):
                    own = sorted((nodes[a + i], int(sides[a + i])) for i in alive[label == root])
                    name = hashlib.blake2b(b"".join(x + bytes([s]) for x, s in own) + bytes([int(cross[a])]), digest_size=8).digest()
                    cid = int.from_bytes(name, "little", signed=True) & ~3
                    rows += [(cid, x, cid | (2 + s if cross[a] else 0)) for x, s in own]
            yield pd.DataFrame(rows, columns=["cid", "node", "entry"]).astype({"cid": "int64", "entry": "int64"})
        give_back()

    return find


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    m = len(sets)
    if m == 2:
        c = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), c], [c, len(sets[1])]], dtype=np.float64)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((m, m), dtype=np.float32)
    for at in range(0, int(column.max(initial=-1)) + 1, 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        x = np.zeros((m, min(4096, int(column[b - 1]) - at + 1)), dtype=np.float32)
        x[owner[a:b], column[a:b] - at] = 1
        total += x @ x.T
    np.fill_diagonal(total, [len(s) for s in sets])
    return total


def _verified(threshold: float):
    """From (cid, node, entry, set, copies, entries) to (node, links, root): exact links, each counted in the first group where both stand."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, starts in runs_of(batches, ["cid"]):
            rows = []
            nodes, entries, copies = batch["node"].to_list(), batch["entry"].to_numpy(), batch["copies"].to_numpy()
            all_entries, sets = batch["entries"].to_list(), [np.frombuffer(s, dtype=np.uint64) for s in batch["set"]]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                own = sets[a:b]
                size = np.array([len(s) for s in own], dtype=np.float64)
                both, linked = overlaps(own), np.empty((b - a, b - a), dtype=bool)
                for i in range(0, b - a, 256):
                    linked[i : i + 256] = both[i : i + 256] >= threshold * (size[i : i + 256, None] + size[None, :] - both[i : i + 256]) - 1e-9
                del both
                if entries[a] & 2:
                    linked &= (entries[a:b, None] & 1) != (entries[None, a:b] & 1)
                np.fill_diagonal(linked, False)
                if not linked.any():
                    continue
                cid = int(entries[a]) >> 2
                before = [{int(e) for e in all_entries[i] if int(e) >> 2 < cid} for i in range(a, b)]
                counted = linked.copy()
                keys = {key: i for i, key in enumerate(sorted(set().union(*before)))}
                if keys:
                    held = np.zeros((b - a, len(keys)), dtype=np.float32)
                    other = np.zeros_like(held)  # where the partner has to stand
                    for i, mine in enumerate(before):
                        for e in mine:
                            held[i, keys[e]] = 1
                            partner = e if not e & 2 else e ^ 1
                            if partner in keys:
                                other[i, keys[partner]] = 1
                    counted &= (held @ other.T) == 0
                label = _labels(linked)
                links = counted @ copies[a:b]
                rows += [(nodes[a + i], int(links[i]), nodes[a + label[i]]) for i in np.flatnonzero(linked.any(axis=1))]
            yield pd.DataFrame(rows, columns=["node", "links", "root"]).astype({"links": "int64"})
        give_back()

    return verify


def _leaves(nodes: DataFrame, picks_of: Callable[[DataFrame], DataFrame], block: int, dense: float) -> DataFrame:
    """(path, n, node): buckets to compare by brute force. ``picks_of`` gives the picks of deeper levels of the nodes in a table."""
    run = F.col("pick").bitwiseAND(F.lit(-(1 << 32)))
    rows = nodes.select("node", F.explode("l0").alias("pick")).select("node", run.alias("run"), F.xxhash64("pick").alias("path"))
    done, picks, used = [], None, []
    for level in range(LEVELS):
        sizes = rows.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") >= 2)
        here = written(rows.join(sizes, "path"), f"paths{level}")
        used.append(here)
        if level == LEVELS - 1 or not here.where(F.col("n") > block).take(1):
            done.append(here)
            break
        # Mean similarity of a large bucket: how far its members' sketches agree with that of its least member.
        large = here.where(F.col("n") > block).join(nodes.select("node", "sketch"), "node")
        first = large.groupBy("path").agg(F.min(F.struct("node", "sketch"))["sketch"].alias("of"))
        bins = [F.substring("sketch", 2 * k + 1, 2) == F.substring("of", 2 * k + 1, 2) for k in range(0, BINS, 4)]
        mean = large.join(first, "path").groupBy("path").agg((F.sum(sum((b.cast("int") for b in bins), F.lit(0))) / (F.count("*") * len(bins))).alias("mean"))
        split = written(mean.where(F.col("mean") < dense).select("path"), "split")
        used.append(split)
        done.append(here.join(split, "path", "left_anti"))
        members = here.join(split, "path", "left_semi")
        if picks is None:
            picks = written(picks_of(members.select("node").distinct()), "picks")
            used.append(picks)
        # A member goes on with its own picks of the same run only; they are unfolded after the join.
        own = members.join(picks.select("node", F.col(f"l{level + 1}").alias("_own")), "node")
        own = own.select("node", "run", "path", F.explode(F.filter("_own", lambda p: p.bitwiseAND(F.lit(-(1 << 32))) == F.col("run"))).alias("pick"))
        rows = own.select("node", "run", F.xxhash64("path", "pick").alias("path"))
    leaves = written(reduce(DataFrame.unionByName, [d.select("path", "n", "node") for d in done]), "leaves")
    for table in used:
        discard(table)
    return _pooled(leaves, block)


def _pooled(leaves: DataFrame, block: int) -> DataFrame:
    """``leaves`` (path, n, node) in which buckets over ``block`` nodes that are connected by common nodes are one, if that makes no more pairs.

    A group of near copies fills a bucket for every shingle that they share. Pooled, its nodes go to tiles once and not once a bucket, and all pairs of every bucket are still pairs.
    """
    large = leaves.where(F.col("n") > block)
    if not large.take(1):
        return leaves
    least = large.groupBy("node").agg(F.min("path").alias("v"))
    edges = large.join(least, "node").select(F.col("path").alias("u"), "v").distinct()
    roots = components(edges).select(F.col("node").alias("path"), "root")
    buckets = large.select("path", "n").distinct().join(roots, "path", "left").select("path", "n", F.coalesce("root", "path").alias("root"))
    buckets = written(buckets, "buckets")
    # A row a bucket, so this is small; broadcast, as a bucket's rows would meet in one task.
    pools = written(large.drop("n").join(F.broadcast(buckets.select("path", "root")), "path").select("root", "node").distinct(), "pools")
    sizes = pools.groupBy("root").agg(F.count("*").alias("n")).join(buckets.groupBy("root").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs")), "root")
    fewer = written(sizes.where(F.col("n").cast("double") * F.col("n") <= F.col("pairs")).select("root", "n"), "fewer")
    gone = buckets.join(F.broadcast(fewer.select("root")), "root", "left_semi").select("path")
    kept = leaves.join(F.broadcast(gone), "path", "left_anti")
    one = pools.join(F.broadcast(fewer), "root").select(F.col("root").alias("path"), "n", "node")
    out = written(kept.unionByName(one), "leaves")
    for table in (leaves, buckets, pools, fewer):
        discard(table)
    return out


@small_batches
def jaccard_join(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", width: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = 1024, dense: float = 0.4) -> DataFrame:
    """``id_col``, class_id, n_links (long), node and text_hash of every row of ``docs``.

    class_id is the least id of the connected group of similar documents (its own for a document without partner; null if all
    ids of the group are null); n_links the number of other rows whose shingle sets reach the threshold, copies counted singly. Texts
    without words (null, empty, white space) are similar to nothing; very long texts are compared whole. Repeated rows are copies of each other. Other
    columns are not looked at, whatever their names.
    """
    runs = runs_for(recall, threshold)
    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_text"))
    signed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("text_hash"), chunked(_signatures(width, runs, threshold), "node binary, n long, sketch binary, l0 array<long>")(F.col(text_col)).alias("s"))
    signed = written(signed.select("_id", "text_hash", "s.*"), "signatures")
    nodes = written(signed.where(F.col("n") > 0).groupBy("node").agg(F.min("_id").alias("first_id"), F.count("*").alias("copies"), F.min("text_hash").alias("text_hash"), *[F.first(c).alias(c) for c in ("n", "sketch", "l0")]), "nodes")
    rows = written(signed.select("_id", "text_hash", "node"), "rows")
    discard(signed)

    def picks_of(some: DataFrame) -> DataFrame:
        wanted = nodes.join(some, "node", "left_semi").select("text_hash")
        found = texts.join(spread(wanted), "text_hash", "left_semi").select(chunked(_next_picks(width, runs, threshold), "node binary, " + ", ".join(f"l{k} array<long>" for k in range(1, LEVELS)))(F.col("_text")).alias("s"))
        return found.select("s.*").dropDuplicates(["node"])

    leaves = _leaves(nodes, picks_of, block, dense)
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = leaves.withColumns({"k": blocks, "b": F.pmod(F.xxhash64("node", "path"), blocks).cast("int")})
    tiles = placed.select("path", "node", "b", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    tiles = tiles.select("path", "node", F.least("b", "j").alias("ti"), F.greatest("b", "j").alias("tj"), (F.col("b") > F.col("j")).cast("int").alias("side"))
    keys = ["path", "ti", "tj"]
    sorted_ = tiles.distinct().join(nodes.select("node", "n", "sketch"), "node").repartition(*keys).sortWithinPartitions(*keys, "node")
    found = sorted_.mapInPandas(_candidates(threshold, threshold * 0.65), "cid long, node binary, entry long").distinct()
    members = written(found, "members")
    discard(leaves)
    alive = members.groupBy("node").agg(F.collect_set("entry").alias("entries")).join(nodes.select("node", "copies", "text_hash"), "node")
    alive = written(alive, "alive")
    sets = texts.join(spread(alive.select("text_hash").distinct()), "text_hash", "left_semi").select(chunked(_sets_of(width), "node binary, set binary")(F.col("_text")).alias("s")).select("s.*")
    sets = written(sets.groupBy("node").agg(F.first("set").alias("set")), "sets")
    grouped = members.join(alive.select("node", "entries", "copies"), "node").join(sets, "node").repartition("cid").sortWithinPartitions("cid", "node")
    links = written(grouped.mapInPandas(_verified(threshold), "node binary, links long, root binary"), "links")
    for table in (sets, members, alive):
        discard(table)
    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    classes = nodes.select("node", "first_id", "copies").join(roots, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = written(classes, "classes")
    for table in (nodes, links):
        discard(table)
    least = classes.where(F.col("links").isNotNull()).groupBy("root").agg(F.min("first_id").alias("least"))
    # Only nodes of several rows or with links are joined back; any other row is its own class.
    known = classes.where((F.col("copies") > 1) | F.col("links").isNotNull()).join(least, "root", "left")
    known = known.select("node", F.coalesce("least", "first_id").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("_id", "text_hash", "node").join(known, "node", "left")
    return out.select(F.col("_id").alias(id_col), F.when(F.col("n_links").isNull(), F.col("_id")).otherwise(F.col("class")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "node", "text_hash")


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id", "n_links")
