"""Benchmark decontamination with an Aho-Corasick automaton over test questions and answers.

Texts are normalised (A-Z lower-cased; words are runs of digits, a-z and non-ASCII characters) and scanned once.
Each benchmark item is cut into windows of ``width`` consecutive words; a shorter item is one window. Every word of
a document inside an occurrence of a window is hit, and the spans of hit words are mapped back to the original text.

The windows of all items reach the executors in blocks of ``block_bytes`` characters at most; an automaton takes some 45 times as many bytes. One block holds any
usual benchmark (it is then one automaton and one scan); a larger benchmark takes one more automaton and one more scan a block, one block after another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, packed, written

#: ASCII to lower case; what is no word character becomes a space. Bytes from 0x80 on belong to words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_RESULT = "n_words long, n_hit long, _items array<string>, spans array<struct<start:int,stop:int>>, _hits binary"


def split_normal(text: bytes | None) -> list[bytes]:
    """Normalised words of a text in UTF-8; none for null."""
    return text.translate(_TABLE).split() if text else []


def normal_words(text: str | None) -> list[bytes]:
    """Normalised words as UTF-8; none for null."""
    return split_normal(text.encode("utf-8", "surrogatepass") if text else None)


def windows(text: str | None, width: int) -> list[str]:
    """Distinct windows of one item, each with a space before and after every word (one character a byte)."""
    words = normal_words(text)
    found = {b" " + b" ".join(words[i : i + width]) + b" " for i in range(max(1, len(words) - width + 1))} if words else ()
    return sorted(w.decode("latin-1") for w in found)


def benchmark_windows(items: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """One row per window and item: window string, item string."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, item) for item, text in zip(batch["item"], batch["text"], strict=True) for w in windows(text, width)]
            yield pd.DataFrame(rows, columns=["window", "item"])

    known = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return known.mapInPandas(cut, "window string, item string").distinct()


@lru_cache(maxsize=1)
def _automaton(rows: tuple[tuple[str, str], ...]):
    by_window: dict[str, list[str]] = {}
    for window, item in rows:
        by_window.setdefault(window, []).append(item)
    found = ahocorasick.Automaton()
    for window, ids in by_window.items():
        found.add_word(window, (len(window), tuple(ids)))
    if by_window:
        found.make_automaton()
    return found


def scan_text(automaton, text: str | None, before: bytes | None = None) -> tuple[int, int, list[str], list[tuple[int, int]], bytes]:
    """Words, hit words, items and spans of one text; ``before``: hit words of earlier blocks."""
    words = normal_words(text)
    hits = np.frombuffer(before, dtype=np.uint8).copy() if before else None
    items: set[str] = set()
    if words and len(automaton):
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        found = list(automaton.iter(line))
        if found:
            ends = np.array([e for e, _ in found])
            starts = ends - np.array([n for _, (n, _) in found]) + 1
            gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 32)
            change = np.bincount(np.searchsorted(gaps, starts), minlength=len(words) + 1) - np.bincount(np.searchsorted(gaps, ends), minlength=len(words) + 1)
            now = (np.cumsum(change)[: len(words)] > 0).astype(np.uint8)
            hits = now if hits is None else hits | now
            for _, (_, ids) in found:
                items.update(ids)
    if hits is None:
        return len(words), 0, [], [], b""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hits, [0]))))
    places = [m.span() for m in _WORD.finditer(text)]
    spans = [(places[a][0], places[b - 1][1]) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return len(words), int(hits.sum()), sorted(items), spans, hits.tobytes()


def _blocks(found: DataFrame, block_bytes: int) -> Iterator:
    """The number of blocks, then each block's windows; which block a window is in depends on its hash alone."""
    total = found.agg(F.sum(F.length("window") + F.length("item"))).first()[0] or 0
    n = -(-total * 5 // (block_bytes * 4)) if total > block_bytes else 1
    yield n
    for i in range(n):
        part = found if n == 1 else found.where(F.pmod(F.xxhash64("window"), F.lit(n)) == i)
        yield tuple(sorted((r["window"], r["item"]) for r in part.collect()))


def _either(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Words hit in any of several blocks."""
    for each in batches:
        yield pd.Series([reduce(np.bitwise_or, [np.frombuffer(h, dtype=np.uint8) for h in hits]).tobytes() for hits in each])


def _scanner(held):
    def scan(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(held.value)
        for texts, before in batches:
            yield pd.DataFrame([scan_text(automaton, t, b) for t, b in zip(texts, before, strict=True)], columns=["n_words", "n_hit", "_items", "spans", "_hits"])
        give_back()

    return scan


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items (long), items (array of ids as strings, sorted), items_sha256 (of the ids joined by commas),
    spans (start and stop in characters of the original text) and contaminated.

    Null and empty texts have no words and are never contaminated; very long ones are scanned whole; an empty table or benchmark gives no hit. Items without words or id match nothing. Repeated rows
    are scanned each for itself. Columns of ``docs`` with one of these names are replaced.
    """
    spark, names = docs.sparkSession, ("n_words", "n_hit", "n_items", "items", "items_sha256", "spans", "contaminated")
    blocks = _blocks(benchmark_windows(items, item_col, item_text_col, width), block_bytes)
    out = docs.select(packed(docs, names).alias("_row"), F.col(text_col).alias("_text"))
    of = lambda rows, before: F.pandas_udf(_scanner(spark.sparkContext.broadcast(rows)), _RESULT)(F.col("_text"), before)
    if (n := next(blocks)) == 1:
        out = out.withColumn("_found", of(next(blocks), F.lit(None).cast("binary"))).withColumn("_items", F.col("_found")["_items"])
    else:
        # Each block's hits are written before the next block's automaton is made; texts without hits leave nothing.
        hit = []
        for rows in blocks:
            found = docs.select(F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text")).withColumn("_found", of(rows, F.lit(None).cast("binary")))
            hit.append(written(found.where(F.col("_found.n_hit") > 0).select("_key", "_found._items", "_found._hits").dropDuplicates(["_key"]), "hits"))
        own = reduce(DataFrame.unionByName, hit).groupBy("_key").agg(F.flatten(F.collect_list("_items")).alias("_items"), F.collect_list("_hits").alias("_each"))
        own = written(own.withColumn("_before", F.pandas_udf(_either, "binary")("_each")).drop("_each"), "hits")
        out = out.withColumn("_key", F.xxhash64("_text")).join(own, "_key", "left").withColumn("_found", of((), F.col("_before")))
        out = out.withColumn("_items", F.coalesce("_items", F.array().cast("array<string>")))
    ids = F.array_sort(F.array_distinct("_items"))
    out = out.select("_row", "_found", ids.alias("_ids"))
    made = {"n_words": F.col("_found")["n_words"], "n_hit": F.col("_found")["n_hit"], "n_items": F.size("_ids").cast("long"), "items": F.col("_ids"), "items_sha256": F.sha2(F.array_join("_ids", ","), 256), "spans": F.col("_found")["spans"], "contaminated": F.col("_found")["n_hit"] > 0}
    return out.select("_row.*", *[c.alias(k) for k, c in made.items()])


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = rf"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, s, dw.k, item FROM dw JOIN iw ON dw.win = iw.win AND dw.k = iw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT doc_id, s, k FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
