"""Importance resampling of a corpus towards a target distribution, by hashed n-grams.

A text becomes UTF-8 bytes; one 256-byte table lower-cases A-Z and blanks separators, and ``bytes.split`` yields its words. The
CRC-32 of a run of words seeds that of the run with one word more, so n-grams are never joined; the hash modulo the number of
buckets is a feature. Counters reduce the features of a slice of texts, each task adds its slices up and hands on one count a bucket.

A bucket's gain is the logarithm of how much more frequent it is in the target than in the corpus, a document's weight the mean
gain of its features. Documents are drawn without replacement by weight plus Gumbel noise that only a seed and the id decide.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, give_back, packed, sliced, slices, sql_crc32, structs, written
from .decontaminate import SQL_WORDS, split_normal

_WEIGHED = "n_words long, n_features long, weight long"
_WEIGHED_ARROW = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def gram_hashes(words: list[bytes], longest: int) -> Iterator[list[int]]:
    """CRC-32 of all runs of 1, 2, .. ``longest`` words, joined by one space."""
    ends = list(map(crc32, words))
    for n in range(1, longest + 1):
        yield ends
        ends = list(map(crc32, words[n:], map(crc32, repeat(b" "), ends)))


def feature_counts(docs: DataFrame, *, text_col: str = "text", longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """How often each bucket occurs in all texts: bucket, n (long). Buckets that do not occur are left out; null and empty texts have no features."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                found = Counter()
                for text in part.to_pylist():
                    for hashes in gram_hashes(split_normal(text), longest):
                        found.update(hashes)
                at = np.fromiter(found.keys(), dtype=np.int64, count=len(found)) % buckets
                np.add.at(total, at, np.fromiter(found.values(), dtype=np.int64, count=len(found)))
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["bucket", "n"])
        give_back()

    rows = docs.select(F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's frequency in the target to that in the corpus, one added to every count, rounded down. The driver holds one number a bucket."""
    of = lambda counts: {r["bucket"]: r["n"] for r in counts.collect()}
    s, t = of(corpus), of(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t.get(b, 0) + 1) * (all_s + buckets) / ((s.get(b, 0) + 1) * (all_t + buckets))))
    return np.array([gain(b) for b in range(buckets)], dtype=np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, *, text_col: str = "text", longest: int = 2) -> DataFrame:
    """``docs`` with n_words, n_features and weight (the mean gain of the features, rounded down; 0 without any). Columns of these names are replaced."""
    names = ("n_words", "n_features", "weight")

    def start():
        def weights(texts: list[bytes | None]) -> pa.Array:
            rows = []
            for text in texts:
                words = split_normal(text)
                n = held = 0
                for hashes in gram_hashes(words, longest):
                    n += len(hashes)
                    held += int(gains[np.array(hashes, dtype=np.int64) % len(gains)].sum())
                rows.append((len(words), n, held // n if n else 0))
            return structs(rows, _WEIGHED_ARROW)

        return weights

    found = docs.select(packed(docs, names).alias("_row"), sliced(start, _WEIGHED)(F.col(text_col).cast("binary")).alias("_found"))
    return found.select("_row.*", *[F.col("_found")[c].alias(c) for c in names])


def noise(seed: int, doc_id: Column) -> Column:
    """Thousandths of a Gumbel draw from the first 32 bits of the digest of seed and id, rounded down (long)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` as a struct ``_row`` with their place (1, 2, 3, ..) in ``order``: ranges of the order are sorted side by side and written, and each
    then starts behind the rows of those before it. A third of all rows may be equal in the first key as long as later ones tell them apart."""
    at = F.monotonically_increasing_id()  # the partition above 33 bits of the place within it
    ranges = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.struct("*").alias("_row"), at.alias("_at")), "ranges")
    part = F.shiftright("_at", 33)
    sizes = ranges.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    return ranges.join(F.broadcast(starts), part == F.col("_part")).select("_row", (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("_place"))


def draw(weighed: DataFrame, *, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """A table from :func:`weigh` with score (weight and noise) and rank: of the rows with ``least_words`` words at least, ``percent`` % (rounded down) have the highest scores and are
    drawn, ranked 1, 2, 3, .. from the highest on; all other ranks are null. Ties go to the smaller id, a null id last; repeated rows follow each other.

    All columns are sorted along, so take what you need with you and leave texts behind. Columns score and rank are replaced.
    """
    rows = weighed.select(packed(weighed, ("score", "rank")).alias("_own"), (F.col("weight") + noise(seed, F.col(id_col))).alias("score"), F.col(id_col).alias("_id"), (F.col("n_words") >= least_words).alias("_able"))
    able = F.col("_able")
    drawn = percent * rows.where(able).count() // 100
    ranked = numbered(rows.where(able).drop("_able"), F.col("score").desc(), F.col("_id").asc_nulls_last())
    ranked = ranked.select("_row._own", "_row.score", F.when(F.col("_place") <= drawn, F.col("_place")).alias("rank"))
    rest = rows.where(~able).select("_own", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest).select("_own.*", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", longest: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """``docs`` without their texts, with n_words, n_features, weight, score and rank (null if not drawn).

    Counts cover all texts of both tables, whole. A null or empty text has no features, weight 0 and is never drawn; very long ones are
    read as they are; an empty table gives no rows, an empty target equal gains for unseen buckets. Repeated rows count and are drawn each for itself. A null id
    draws as the empty one. Columns of these names are replaced, others stay.
    """
    gains = bucket_gains(*(feature_counts(t, text_col=text_col, longest=longest, buckets=buckets) for t in (docs, target)), buckets)
    weighed = written(weigh(docs, gains, text_col=text_col, longest=longest).drop(text_col), "weighed")
    return draw(weighed, percent=percent, least_words=least_words, seed=seed, id_col=id_col)


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    found = resample(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
b AS (SELECT {SQL_WORDS} AS w FROM benchmark),
df AS (SELECT doc_id, unnest(w) AS f FROM d UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
bf AS (SELECT unnest(w) AS f FROM b UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM b)),
k AS (SELECT f, {sql_crc32('f')} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf)),
s AS (SELECT bucket, count(*) AS n FROM df JOIN k USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN k USING (f) GROUP BY bucket),
g AS (SELECT u.bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM df) + 10000) AS DOUBLE) / CAST((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM bf) + 10000) AS DOUBLE))) AS BIGINT) AS gain
      FROM (SELECT DISTINCT bucket FROM k) u LEFT JOIN s ON u.bucket = s.bucket LEFT JOIN t ON u.bucket = t.bucket),
x AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS held FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY doc_id),
y AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(CAST((held - ((held % n_features) + n_features) % n_features) // n_features AS BIGINT), 0) AS weight,
             CAST('0x' || substr(sha256('7:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
      FROM d LEFT JOIN x ON d.doc_id = x.doc_id),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM z)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= 25 * (SELECT count(*) FROM z WHERE n_words >= 20) // 100 THEN place END AS rank
FROM r
"""
