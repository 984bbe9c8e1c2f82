"""Hierarchical language identification: the family first, then one-versus-one linear support vector machines within it.

Texts become hashed counts of letter n-grams (two, three and four UTF-8 bytes, lower-cased), square-rooted and scaled to length one.
One-versus-rest machines choose the family; within it every pair of languages has a machine of its own, and the language with
the most votes wins, ties by summed margins. Margins become probabilities by a logistic slope fitted on the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, free_name, sliced, structs

#: Families of closely related languages (ISO 639-1). A language that is in none is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "tr", "uz"),
    "semitic": ("ar", "he", "mt"),
}
UNDETERMINED = "und"
DIM = 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 97 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Hashed n-gram counts of the whole text, float32 of length ``DIM``. Other ASCII than letters is a space; runs of spaces are one."""
    line = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LOWER).split()) + b" "
    a = np.frombuffer(line, dtype=np.uint8).astype(np.uint32)
    two = a[:-1] * np.uint32(256) + a[1:]
    three = two[:-1] * np.uint32(256) + a[2:]
    total = np.zeros(DIM, dtype=np.int64)
    for grams in (two * np.uint32(0x9E3779B1), three * np.uint32(0x85EBCA6B), (three[:-1] * np.uint32(31) + a[3:]) * np.uint32(0xC2B2AE35)):
        total += np.bincount(grams >> np.uint32(20), minlength=DIM)
    found = np.sqrt(total.astype(np.float32))
    return found / max(float(np.linalg.norm(found)), 1e-12)


def fit_svm(x: np.ndarray, y: np.ndarray, *, c: float = 10.0, rounds: int = 120) -> tuple[np.ndarray, float, float]:
    """Weights, bias and logistic slope of a linear machine with squared hinge loss; ``y`` is +1 or -1. Classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    w_ahead, b_ahead, t = w, b, 1.0
    step = 1.0 / (1.0 + 2 * c * 2)
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ w_ahead + b_ahead)) * weight * y
        w_new = w_ahead - step * (w_ahead - 2 * c * (slack @ x))
        b_new = b_ahead + step * 2 * c * float(slack.sum())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w_ahead, b_ahead = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new.astype(np.float32), b_new, t_new
    margin, slope = y * (x @ w + b), 1.0
    for _ in range(30):  # Newton steps for the slope, held away from certainty
        p = 1 / (1 + np.exp(-slope * margin))
        grad = float((weight * (p - 1) * margin).sum()) + 1e-3 * slope
        slope = float(np.clip(slope - grad / (float((weight * p * (1 - p) * margin**2).sum()) + 1e-3), 0.1, 50))
    return w, b, slope


@dataclass
class Model:
    """Machines of one fitted classifier; ``languages`` by family."""

    languages: dict[str, list[str]] = field(default_factory=dict)
    families: list[str] = field(default_factory=list)
    family_machines: list[tuple[np.ndarray, float, float]] = field(default_factory=list)
    pairs: dict[str, list[tuple[int, int, np.ndarray, float, float]]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """Language and score of one text: probability of its family times that of the language within it."""
        if not self.families:
            return UNDETERMINED, 0.0
        at, score = 0, 1.0
        if len(self.families) > 1:
            p = np.array([_logistic(s * (float(x @ w) + b)) for w, b, s in self.family_machines])
            at = int(p.argmax())
            score = float(p[at] / max(p.sum(), 1e-12))
        names = self.languages[family := self.families[at]]
        if len(names) > 1:
            votes, sums = np.zeros(len(names)), np.zeros(len(names))
            for i, j, w, b, s in self.pairs[family]:
                p = _logistic(s * (float(x @ w) + b))
                votes[i if p >= 0.5 else j] += 1
                sums[i] += p
                sums[j] += 1 - p
            best = int(np.lexsort((-np.arange(len(names)), sums, votes))[-1])
            return names[best], score * float(sums[best] / (len(names) - 1))
        return names[0], score


def _logistic(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit(x: np.ndarray, langs: list[str], families: Mapping[str, tuple[str, ...]] = FAMILIES) -> Model:
    family_of = {lang: name for name, members in families.items() for lang in members}
    model = Model()
    for lang in sorted(set(langs)):
        model.languages.setdefault(family_of.get(lang, f"only {lang}"), []).append(lang)
    model.families = sorted(model.languages)
    own, names = np.array([family_of.get(lang, f"only {lang}") for lang in langs]), np.array(langs)
    if len(model.families) > 1:
        model.family_machines = [fit_svm(x, np.where(own == f, 1.0, -1.0).astype(np.float32)) for f in model.families]
    for f, members in model.languages.items():
        model.pairs[f] = []
        for i, j in combinations(range(len(members)), 2):
            rows = (names == members[i]) | (names == members[j])
            model.pairs[f].append((i, j, *fit_svm(x[rows], np.where(names[rows] == members[i], 1.0, -1.0).astype(np.float32))))
    return model


def train(docs: DataFrame, *, learn_from: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 400, rows_at_most: int = 6000, most_languages: int = 1000) -> Model:
    """Fit on a bounded sample: at most ``per_language`` labelled rows of each language and ``rows_at_most`` in all, but up to 20 of each language.

    Labels are counted over all rows; a draw by the hash of id and text then thins every language to its bound, so no language is gathered whole. Repeated rows
    are one. Rows with null label or without letters teach nothing; of more than ``most_languages`` labels the rarest are not learned. Without any labelled row
    every text is undetermined.
    """
    labelled = docs.where(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not counts:
        return Model()
    each = min(per_language, max(20, rows_at_most // len(counts)))
    share = F.create_map(*[v for lang, n in counts.items() for v in (F.lit(lang), F.lit(min(1.0, 1.2 * each / n)))])
    draw = F.pmod(F.xxhash64(F.lit("train"), F.col(id_col), F.col(text_col)), F.lit(1 << 40)) / float(1 << 40)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, float]] = set()
        for batch in batches:
            new = [key not in seen and not seen.add(key) for key in zip(batch["lang"], batch["draw"], strict=True)]
            known = batch[new]
            known = known[[has_letter(t) for t in known["text"]]]
            yield pd.DataFrame({"lang": known["lang"], "draw": known["draw"], "x": [features(t).astype("<f2").tobytes() for t in known["text"]]})

    drawn = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw")).where(F.col("draw") < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    rows = drawn.mapInPandas(extract, "lang string, draw double, x binary").dropDuplicates(["lang", "draw"]).collect()
    rows.sort(key=lambda r: (r["draw"], r["lang"], r["x"]))
    kept, taken = [], dict.fromkeys(counts, 0)
    for row in rows:
        if taken[row["lang"]] < each:
            taken[row["lang"]] += 1
            kept.append(row)
    if not kept:
        return Model()
    return fit(np.stack([np.frombuffer(r["x"], dtype="<f2").astype(np.float32) for r in kept]), [r["lang"] for r in kept])


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred (a learned language; ``und`` for null or letterless texts) and score (0 to 1; 0 for ``und``).

    Only the whole text is looked at, however long; repeated rows get equal results, an empty table none; equal votes go by the sum of probabilities, then to the first language in order. Columns of these two names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own, shape = held.value, pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
        return lambda texts: structs([own.predict(features(t)) if has_letter(t) else (UNDETERMINED, 0.0) for t in texts], shape)

    name = free_name(docs, "found")
    found = docs.withColumn(name, sliced(start, "lang_pred string, score double")(F.col(text_col)))
    return found.withColumns({c: F.col(name)[c] for c in ("lang_pred", "score")}).drop(name)


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the documents, by the CRC-32 of the id as text, is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 4 == 2


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = identify(docs.withColumn("held_out", held_out()), train(docs, learn_from=~held_out()))
    return found.select("doc_id", "held_out", "lang_pred", "score")
