"""Near-duplicates by SimHash fingerprints, searched with the pigeonring principle.

A fingerprint has 64 bits; two documents link if theirs differ in at most ``most`` bits. The bits are cut into ``most + 1``
segments on a ring. If all segments together differ in at most ``most`` bits, some segment starts a chain in which the first l
segments, for every l, differ in at most l * most / (most + 1) bits: the first one not at all, the first two in one bit at most
(so that one half of the second is equal too), and so on. A fingerprint is therefore indexed once for each segment and half of the
next one, pairs within a bucket are pruned by the chain's further budgets, and only what is left gets the full Hamming check.

Equal fingerprints are one row from the start. A bucket of more than ``bucket_rows`` fingerprints is never compared whole: all of
it agrees in the key's bits, so the same principle cuts the other bits into a ring again, until buckets are small or so few bits
are left that no bucket can be large. That is exact, and no bucket, however hot, comes to one task.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import chunked, documents, packed, spread, written
from .components import components
from .periodic_runs import coded_words

_ONES = np.uint64(0x0101010101010101)


def shingle_hashes(texts: pa.Array, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of ``width`` words of the texts, lower-cased A-Z, and how many each text has. Fewer words are one shingle, none have none."""
    words, _, bounds = coded_words(pc.ascii_lower(texts.cast(pa.string())))
    if not len(words):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], type=pa.int32()), words), " ")[0].as_buffer().to_pybytes()
    stops = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1) - 1
    starts = np.append(0, stops[:-1] + 1)
    n = np.diff(bounds)
    counts = np.where(n > 0, np.maximum(1, n - width + 1), 0)
    first = np.repeat(bounds[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    last = np.minimum(first + width, np.repeat(bounds[1:], counts)) - 1
    pieces = map(joined.__getitem__, map(slice, starts[first].tolist(), stops[last].tolist()))
    return np.fromiter(map(xxh64_intdigest, pieces, repeat(seed)), dtype=np.uint64, count=len(first)), counts


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each of consecutive groups of ``counts`` hashes the number with a bit set where over half of the group have it; 0 for an empty group."""
    out = np.zeros(len(counts), dtype=np.uint64)
    own = np.flatnonzero(counts)
    if not len(own):
        return out
    # Eight counters to a word: blocks of at most 255 hashes keep each within its byte.
    blocks = -(-counts[own] // 255)
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = np.repeat(np.cumsum(counts[own]) - counts[own], blocks) + 255 * nth
    heads = np.cumsum(blocks) - blocks
    for low in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(low)) & _ONES, starts)
        of_byte = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), heads, axis=0)
        for byte in range(8):
            out[own] |= (2 * of_byte[:, byte] > counts[own]).astype(np.uint64) << np.uint64(8 * byte + low)
    return out


def fingerprints(docs: DataFrame, *, text_col: str = "text", width: int = 3, seed: int = 42, name: str = "fingerprint") -> DataFrame:
    """``docs`` with the SimHash of each text as a (signed) long; 0 for null and empty texts. A column of that name is replaced."""

    def start():
        return lambda texts: pa.array(majority_bits(*shingle_hashes(texts, width, seed)).view(np.int64))

    out = docs.select(packed(docs, (name,)).alias("_row"), chunked(start, "long")(F.col(text_col)).alias("_bits"))
    return out.select("_row.*", F.col("_bits").alias(name))


class Ring:
    """Where chains may start on a ring of segments of the bits outside ``fixed``: for each start and half of the next segment the bits of the key, and
    the budgets of the chain beyond it, as (bits, most differing)."""

    def __init__(self, fixed: int, most: int):
        free = [b for b in range(64) if not fixed >> b & 1]
        cut = [round(i * len(free) / (most + 1)) for i in range(most + 2)]
        segments = [free[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        bits = lambda some: sum(1 << b for b in some)
        self.keys: list[int] = []
        self.chains: list[list[tuple[int, int]]] = []
        for i in range(most + 1):
            ring = [segments[(i + j) % (most + 1)] for j in range(most + 1)]
            chain = [(bits(sum(ring[:n], [])), n * most // (most + 1)) for n in range(2, most + 1)]
            second = ring[1] if most else []
            for half in (second[: len(second) // 2], second[len(second) // 2 :])[: 2 if most else 1]:
                self.keys.append(fixed | bits(ring[0]) | bits(half))
                self.chains.append(chain)


def _longs(values: list[int]) -> Column:
    """An array of unsigned 64-bit numbers, as the longs of the same bits."""
    return F.from_json(F.lit(str([n - (1 << 64) if n >> 63 else n for n in values])), "array<long>")


def close_pairs(prints: DataFrame, *, most: int = 2, bucket_rows: int = 4096) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints (a table with one long column ``bits``, without repeats) that differ in 1 to ``most`` bits, each once.

    Each fingerprint has few such partners whatever its buckets hold; buckets are searched as the module says.
    """
    found = []
    fixed, rows = [0], prints.select("bits", F.lit(0).alias("of"))
    while True:
        rings = [Ring(f, most) for f in fixed]
        keys = [k for ring in rings for k in ring.keys]
        per = len(rings[0].keys)
        few = 64 - min(k.bit_count() for k in keys) <= max(most + 1, bucket_rows.bit_length() - 1)  # bits that are left to tell the prints of a bucket apart
        masks = _longs(keys)
        at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: F.col("of") * per + i)).alias("m")
        indexed = rows.select("bits", at).select("bits", "m", F.col("bits").bitwiseAND(F.element_at(masks, F.col("m") + 1)).alias("key"))
        cool, hot = indexed, None
        if not few:
            hot = written(indexed.groupBy("m", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select("m", "key"), "simhash-hot")
            hot = spread(hot) if hot.take(1) else None
        if hot is not None:
            cool = indexed.join(hot, ["m", "key"], "left_anti")
        a, b = cool.select("m", "key", F.col("bits").alias("u")), cool.select(F.col("m").alias("m2"), F.col("key").alias("key2"), F.col("bits").alias("v"))
        differ = F.col("u").bitwiseXOR(F.col("v"))
        meets = (F.col("m") == F.col("m2")) & (F.col("key") == F.col("key2")) & (F.col("u") < F.col("v"))
        for n in range(len(rings[0].chains[0])):
            along = _longs([ring.chains[i][n][0] for ring in rings for i in range(per)])
            meets &= F.bit_count(differ.bitwiseAND(F.element_at(along, F.col("m") + 1))) <= rings[0].chains[0][n][1]
        found.append(written(a.join(b, meets & (F.bit_count(differ) <= most)).select("u", "v").distinct(), "simhash-pairs"))
        if hot is None:
            break
        fixed, rows = keys, written(indexed.join(hot, ["m", "key"], "left_semi").select("bits", F.col("m").alias("of")), "simhash-rows")
    return found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).distinct()


def simhash_groups(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", width: int = 3, seed: int = 42, most: int = 2, bucket_rows: int = 4096) -> DataFrame:
    """``docs`` without their texts, with fingerprint (long) and component_id: the smallest id reachable over links of at most ``most`` differing bits, its own included.

    Shingles are runs of ``width`` words (ASCII white space between them), lower-cased A-Z, repeats included. Null and empty texts have fingerprint 0 and link
    like any other; a text of fewer words is one shingle; very long ones are hashed whole. Repeated rows and ties link as equal fingerprints do. A null id takes part and passes links on, but
    is never the smallest unless its component has no other. An empty table gives none. Columns of these names are replaced, others stay.
    """
    names = ("fingerprint", "component_id", text_col)
    own = docs.select(packed(docs, names).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    marked = written(fingerprints(own, text_col="_text", width=width, seed=seed, name="_bits").drop("_text"), "simhash")
    prints = written(marked.groupBy(F.col("_bits").alias("bits")).agg(F.min("_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    pairs = close_pairs(prints.select("bits"), most=most, bucket_rows=bucket_rows)
    roots = components(pairs)
    rooted = prints.join(roots, F.col("bits") == F.col("node"), "left").select("bits", "least", "n", "root")
    # Prints without links stand for themselves, so only linked ones are grouped.
    linked = rooted.select("bits", "n", F.coalesce("root", "bits").alias("root"), "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    known = written(linked.join(least, "root").select("bits", "n", "component_id"), "simhash-known")
    # Prints of more than a thousandth of all rows are fewer than a thousand: their rows stay where they are.
    total = marked.count()
    frequent = known.where(F.col("n") * 1000 > total)
    heavy = marked.join(F.broadcast(frequent.select("bits", "component_id")), F.col("_bits") == F.col("bits"), "left")
    found = F.col("bits").isNotNull()
    rest = heavy.where(~found).select("_row", "_bits").join(known.where(F.col("n") * 1000 <= total).select("bits", "component_id"), F.col("_bits") == F.col("bits"))
    return heavy.where(found).select("_row", "_bits", "component_id").unionByName(rest.select("_row", "_bits", "component_id")).select("_row.*", F.col("_bits").alias("fingerprint"), "component_id")


def op13_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = simhash_groups(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
