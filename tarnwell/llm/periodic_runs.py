"""Maximal periodic runs of words in each text, by seeds on diagonals that are extended.

A run of smallest period q and at least four periods (six words) repeats every word but its last q at lag q, so two places of its
text q words apart agree over 3q words or more. Periods are taken in classes [L, 2L): the k-grams of the least guaranteed overlap
(k = 3L words, 5 for period 1) are indexed, and an occurrence is paired with the next one in the same document. No k-gram is
shorter than a period, so within a run of smallest period q the next occurrence is exactly q words on: these pairs find every run,
number no more than the words of a text, and make no pair of a multiple of q. A pair is a seed on the diagonal of its lag; it is
extended word by word to both sides, and a table of the furthest covered place of each lag suppresses seeds that an extension has
already covered. A class whose k-grams do not repeat within a document ends the search there, as longer ones cannot.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunked, documents, mix64, packed, sql_crc32, word_array

RUNS = "array<struct<start:long,length:long,period:long>>"
_FOUND = f"n_words long, runs {RUNS}, collapsed string"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts, one after another, a number that stands for each word, and where each text begins (and the last one ends)."""
    split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
    words = split.flatten()
    bounds = np.append(0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)))
    real = pc.greater(pc.binary_length(words), 0)  # leading and trailing space leaves empty parts
    if not pc.all(real).as_py():
        words, bounds = words.filter(real), np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[bounds]
    return words, words.dictionary_encode().indices.to_numpy(zero_copy_only=False), bounds


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values of ``a`` and ``b`` are equal."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differs = a[at : at + step] != b[at : at + step]
        if differs.any():
            return min(n, at + int(differs.argmax()))
        at, step = at + step, 4 * step
    return n


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64(left * _ODD + right)


def periodic_runs(codes: np.ndarray, bounds: np.ndarray, *, least: int = 6, periods: int = 4) -> np.ndarray:
    """Rows (text, start, length, period), ordered, of all maximal runs of at least ``least`` words and ``periods`` (4 or more) periods."""
    sizes = np.diff(bounds)
    live = np.flatnonzero(sizes >= least)
    found, long = [], 1  # periods from long up to 2 * long - 1
    while len(live := live[sizes[live] >= periods * long]):
        n = sizes[live]
        text = np.repeat(np.arange(len(live)), n)
        place = np.arange(len(text)) + np.repeat(bounds[live] - np.cumsum(n) + n, n)  # in codes
        stop = np.repeat(np.cumsum(n), n)
        k = (periods - 1) * long if long > 1 else max(least - 1, periods - 1)
        window = _windows(mix64(codes[place].astype(np.uint64) + np.uint64(1)), k)
        at = np.flatnonzero(np.arange(len(text)) + k <= stop)
        keys = mix64(window[at] + mix64(text[at].astype(np.uint64)))
        order = np.argsort(keys, kind="stable")
        again = keys[order[1:]] == keys[order[:-1]]
        first, second = at[order[:-1][again]], at[order[1:][again]]
        lag = second - first
        seeds = (lag >= long) & (lag < 2 * long) & (periods * lag <= n[text[first]])
        found += _extended(codes, bounds, place[first[seeds]], lag[seeds], live[text[first[seeds]]], least, periods)
        live, long = live[np.unique(text[first])], 2 * long
    rows = np.array(found, dtype=np.int64).reshape(-1, 4)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` words from each place on, by doubling; near the end of a text it reaches into the next ones."""
    after = lambda values, n: np.append(values[n:], np.zeros(min(n, len(values)), dtype=values.dtype))
    out, held, power, size = None, 0, words, 1
    while held < k:
        if k & size:
            out = power if out is None else _join(power, after(out, size))
            held += size
        power, size = _join(power, after(power, size)) if held < k else power, 2 * size
    return out


def _extended(codes: np.ndarray, bounds: np.ndarray, seeds: np.ndarray, lags: np.ndarray, texts: np.ndarray, least: int, periods: int) -> list[tuple]:
    """Seeds (places in ``codes`` that agree with those ``lags`` on) extended to maximal runs."""
    order = np.lexsort((seeds, lags))
    seeds, lags, texts = seeds[order], lags[order], texts[order]
    heads = np.ones(len(seeds), dtype=bool)  # of neighbours on a diagonal only the first can be news
    heads[1:] = (lags[1:] != lags[:-1]) | (seeds[1:] != seeds[:-1] + 1)
    furthest, found = {}, []
    for at, lag, text in zip(seeds[heads].tolist(), lags[heads].tolist(), texts[heads].tolist(), strict=True):
        if at < furthest.get(lag, 0):
            continue
        begin, end = int(bounds[text]), int(bounds[text + 1])
        right = _agree(codes[at : end - lag], codes[at + lag : end])
        left = _agree(codes[begin:at][::-1], codes[begin + lag : at + lag][::-1])
        furthest[lag] = at + right
        if left + right + lag >= max(least, periods * lag):
            found.append((text, at - left - begin, left + right + lag, lag))
    return found


def _start(least: int, periods: int) -> Callable[[], Callable[[pa.Array], pa.Array]]:
    def start():
        def each(texts: pa.Array) -> pa.Array:
            words, codes, bounds = coded_words(texts)
            rows = periodic_runs(codes, bounds, least=least, periods=periods)
            ends = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
            runs = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in rows[:, 1:].T], names=["start", "length", "period"]))
            n = np.diff(bounds)
            if len(rows):
                change = np.zeros(len(words) + 1, dtype=np.int64)
                from_ = bounds[rows[:, 0]] + rows[:, 1]
                np.add.at(change, from_ + rows[:, 3], 1)
                np.add.at(change, from_ + rows[:, 2], -1)
                kept = np.cumsum(change[:-1]) == 0
                words, bounds = words.filter(pa.array(kept)), np.append(0, np.cumsum(kept))[bounds]
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), words), " ")
            return pa.StructArray.from_arrays([pa.array(n), runs, collapsed], names=["n_words", "runs", "collapsed"])

        return each

    return start


def find_runs(docs: DataFrame, *, text_col: str = "text", least: int = 6, periods: int = 4) -> DataFrame:
    """``docs`` with n_words, runs (array of start, length and period in words, by start and period) and collapsed (the words that no run repeats, one space between).

    Runs are maximal stretches of smallest period q of at least ``least`` words and ``periods`` (4 or more) times q. Words end at ASCII white space. A null or
    empty text has no words, no runs and an empty collapsed text; very long ones are searched whole, in time that grows with their words; repeated rows are
    searched each for itself; an empty table gives none. Columns of ``docs`` with one of these names are replaced, others stay. Nothing is shuffled.
    """
    if periods < 4 or least < 1:
        raise ValueError("periods from 4 on, least from 1 on")
    names = ("n_words", "runs", "collapsed")
    found = docs.select(packed(docs, names).alias("_row"), chunked(_start(least, periods), _FOUND)(F.col(text_col)).alias("_found"))
    return found.select("_row.*", *[F.col("_found")[c].alias(c) for c in names])


def made_periodic(text: Column, doc_id: Column) -> Column:
    """The query's input: the words of a tenth of the texts (by CRC-32 of the id) repeat a block of them from some word on. Other texts, and those without id, stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def blocks(given: Column) -> Column:
        words, a = given["words"], given["a"]
        rest = F.size(words) - a
        p = (1 + F.floor(rest / (3 + g % 8))).cast("int")
        times = F.ceil(rest / p).cast("int")
        return F.array_join(F.concat(F.slice(words, 1, a), F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), 1, rest)), " ")

    # One-element arrays bind what an expression uses more than once.
    of = F.transform(F.array(word_array(text)), lambda w: F.struct(w.alias("words"), (g % F.size(w)).cast("int").alias("a")))
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.transform(of, blocks)[0]).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", made_periodic(F.col("text"), F.col("doc_id")).alias("text"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("early"), (-r["period"]).alias("short"))))
    found = find_runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, start, period = F.col("best")["length"], -F.col("best")["early"], -F.col("best")["short"]
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Every pair of equal 5-grams of a document up to a quarter of its words apart; stretches of a lag, and none that a smaller period covers.
OP11_SQL = rf"""
WITH o AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {sql_crc32('CAST(doc_id AS VARCHAR)')} AS h FROM documents),
pa AS (SELECT *, len(w) AS n, h // 10 AS g FROM o),
pb AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM pa),
pc AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM pb),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM pc),
k AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + 5], ' ') AS gram FROM (SELECT doc_id, n, w, unnest(range(0, n - 4)) AS i FROM d WHERE n >= 6)),
m AS (SELECT x.doc_id, x.n, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS b, max(i) + 5 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM m) GROUP BY doc_id, q, isle),
r AS (SELECT doc_id, b, e - b AS l, q FROM s WHERE e - b >= greatest(6, 4 * q) AND NOT EXISTS (SELECT 1 FROM s z WHERE z.doc_id = s.doc_id AND z.q < s.q AND z.b <= s.b AND z.e >= s.e)),
c AS (SELECT doc_id, unnest(range(b + q, b + l)) AS i FROM r),
t AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256
      FROM (SELECT doc_id, unnest(range(0, n)) AS i, unnest(w) AS word FROM d) v WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = v.doc_id AND c.i = v.i) GROUP BY doc_id),
u AS (SELECT doc_id, count(*) AS n_runs, arg_max({{'b': b, 'l': l, 'q': q}}, {{'l': l, 'b': -b, 'q': -q}}) AS best, sha256(string_agg(b || ',' || l || ',' || q || chr(10), '' ORDER BY b, q)) AS runs_sha256 FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.b AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period, CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli,
       coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM d LEFT JOIN u ON d.doc_id = u.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
