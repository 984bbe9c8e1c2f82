"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule rejects a document. Each rule's cost (seconds) and selectivity (share of rows rejected) are measured on a bounded sample; rules then run in
the order of rejections per cost, and a row that one rule rejects is not evaluated by those after it (a ``CASE`` stops at its first hit).
The order changes how much is computed, never which rows are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, free_name, packed, word_array, written

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``reject`` is a boolean column; null counts as false."""

    name: str
    reject: Column


def text_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long) of every whole text.

    A null text counts as an empty one: all features are 0. Columns of these names are replaced.
    n_lines counts lines that hold a word. n_repeat_words counts words in 3-word windows found twice or more; windows are told
    apart by a 64-bit hash of their words. Very long texts are looked at whole, repeated rows each for itself.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    df = df.select(packed(df, made).alias("_row"), F.col(text_col).alias("_text"))
    text, text_col = F.coalesce(F.col("_text"), F.lit("")), "_text"
    df = df.withColumns({"_words": word_array(F.col(text_col)), "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    n = F.size("_words")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i"))))
    df = df.withColumns({
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_words": n.cast("long"),
        "_grams": F.sort_array(grams),
    }).drop("_words", "_lines")
    # Sorted by hash, windows found twice are neighbours.
    twice = F.zip_with("_grams", F.slice("_grams", 2, F.greatest(F.size("_grams"), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    marked = F.transform(F.flatten(F.filter(twice, lambda x: x.isNotNull())), lambda i: F.array(i, i + 1, i + 2))
    repeats = F.size(F.array_distinct(F.flatten(marked)))
    df = df.withColumn("n_repeat_words", F.when(F.col("_grams").isNull(), F.lit(0)).otherwise(repeats).cast("long"))
    return df.select("_row.*", *made)


def base_rules() -> list[Rule]:
    return [Rule("few_words", F.col("n_words") < 50), Rule("repeats", 100 * F.col("n_repeat_words") > 50 * F.col("n_words"))]


def corpus_rules(text_col: str = "text") -> list[Rule]:
    """Rules for prose of any language that puts spaces between words; they expect the columns of :func:`text_features`."""
    text, n = F.col(text_col), F.greatest(F.col("n_words"), F.lit(1))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("duplicate_lines", (F.col("n_dup_lines") >= 3) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("few_letters", 10 * F.length(F.regexp_replace(text, r"\P{L}+", "")) < 7 * F.col("word_chars")),
        Rule("ellipsis_lines", 10 * F.regexp_count(text, F.lit(r"(?m)(\.\.\.|…)[ \t]*$")) > 3 * F.col("n_lines")),
        Rule("placeholder", F.regexp_like(text, F.lit(r"(?i)lorem ipsum"))),
    ]


def measure(sample: DataFrame, rules: Sequence[Rule], *, times: int = 16, runs: int = 3) -> dict[str, tuple[float, float]]:
    """Seconds a row and share of rows rejected, of each rule by itself.

    Every row is judged ``times`` times over. The first run of a rule warms it up and is not counted; the least time of the others counts, less that of a
    run that judges nothing. Features are part of the result, so that all rules have them for nothing.
    """
    again = free_name(sample, "again")
    many = sample.withColumn(again, F.explode(F.sequence(F.lit(1), F.lit(times))))
    rows = max(1, sample.count())

    def timed(reject: Column) -> tuple[float, int]:
        taken = []
        for _ in range(runs):
            began = time.perf_counter()
            rejected = many.agg(F.count_if(reject)).first()[0]
            taken.append(time.perf_counter() - began)
        return min(taken[1:] or taken), rejected

    nothing, _ = timed(F.col(again) < 0)
    out = {}
    for rule in rules:
        seconds, rejected = timed(rule.reject)
        out[rule.name] = (max(seconds - nothing, 1e-6) / (rows * times), rejected / (rows * times))
    return out


def cascade_order(rules: Sequence[Rule], measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """Most rejections per cost first; ties by name."""
    return sorted(rules, key=lambda r: (-measured[r.name][1] / max(measured[r.name][0], 1e-12), r.name))


def quality_cascade(df: DataFrame, rules: Sequence[Rule], *, features: Callable[[DataFrame], DataFrame] = lambda df: df, sample_rows: int = 2000, seed: int = 7) -> DataFrame:
    """``features(df)``, which adds what rules look at, with kept (no rule rejects the row) and rejected_by (the first rule of the cascade that does, else null).

    The sample only orders the rules: about ``sample_rows`` rows, taken by a seeded draw over all rows. All rows are judged by all rules
    until one rejects them. An empty table keeps the given order. rejected_by follows the measured order, so it may name another of
    several failing rules in another run; kept does not change. Very long texts and repeated rows are judged like any other, a rule that gives null does not reject.
    """
    if len(rules) > 1:
        total = df.count()
        sample = written(features(df.sample(min(1.0, sample_rows / max(total, 1)), seed)), "rules-sample")
        rules = cascade_order(rules, measure(sample, rules))
    first = F.lit(None).cast("string")
    for rule in reversed(rules):
        first = F.when(rule.reject, F.lit(rule.name)).otherwise(first)
    return features(df).withColumn("rejected_by", first).withColumn("kept", F.col("rejected_by").isNull())


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    bad = reduce(Column.__or__, [rule.reject for rule in base_rules()])
    judged = quality_cascade(documents(spark, sf_dir).select("doc_id", "text"), [Rule("base", F.col("base_failed")), *corpus_rules()], features=lambda df: text_features(df).withColumn("base_failed", bad))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, s, w[s] || ' ' || w[s + 1] || ' ' || w[s + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d)),
r AS (SELECT doc_id, s FROM g WHERE (doc_id, gram) IN (SELECT (doc_id, gram) FROM g GROUP BY doc_id, gram HAVING count(*) > 1)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([s, s + 1, s + 2]) AS p FROM r) GROUP BY doc_id),
f AS (SELECT d.doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN n ON d.doc_id = n.doc_id),
b AS (SELECT *, greatest(n_words, 1) AS n, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n OR n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n OR word_chars > 15 * n
            OR 10 * length(regexp_replace(text, '\P{L}+', '', 'g')) < 7 * word_chars
            OR 10 * len(regexp_extract_all(text, '(?m)(\.\.\.|…)[ \t]*$')) > 3 * n_lines OR regexp_matches(text, '(?i)lorem ipsum')) AS kept
FROM b
"""
