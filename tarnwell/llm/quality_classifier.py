"""Quality classifier by co-training on two views of a document: its text, and its page metadata.

Each view has a linear machine, first fitted on a bounded sample of labelled rows. In every round both machines look at all documents, and each hands those
it is surest of to the other as pseudo-labels: how many is a share of the corpus, and the bound of their margins comes from a histogram over all of it. The
other machine then takes gradient steps over all that it was handed and the labelled rows. At the end each view's margin is calibrated on labelled rows
that neither has learned from, a logistic combination of both is fitted there, and all documents are scored.

Features and weights are rounded to integers, and sums of integers do not depend on their order: a model is the same however the table lies in partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, free_name, small_batches, written
from .language_id import fit_svm

TEXT_DIM, STATS, META_DIM = 1024, 12, 256
#: Features of the text are whole numbers up to 255; this is one of each.
_SCALE = np.concatenate((np.full(TEXT_DIM, 1 / 1020), np.full(STATS, 1 / 255)))
#: Weights and slacks are multiples of these in sums over the corpus.
_WEIGHT, _SLACK = 2.0**-20, 2.0**-10
#: Bins of a margin's histogram.
_BIN = 1 / 64


def text_view(text: str | None) -> np.ndarray:
    """Hashed byte n-grams of the whole text and shares of what junk has much of, as bytes; null is an empty text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    out = np.zeros(TEXT_DIM + STATS)
    if not raw:
        return out.astype(np.uint8)
    a = np.frombuffer(raw, dtype=np.uint8)
    low = np.where((a >= 65) & (a <= 90), a + 32, a).astype(np.uint32)
    two = low[:-1] * np.uint32(256) + low[1:]
    three = two[:-1] * np.uint32(256) + low[2:]
    counts = np.bincount((two * np.uint32(0x9E3779B1)) >> np.uint32(22), minlength=TEXT_DIM) + np.bincount((three * np.uint32(0x85EBCA6B)) >> np.uint32(22), minlength=TEXT_DIM)
    grams = np.sqrt(counts)
    out[:TEXT_DIM] = grams / max(float(np.linalg.norm(grams)), 1e-9)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    letter = ((low >= 97) & (low <= 122)) | (a >= 128)
    digit, space = (a >= 48) & (a <= 57), (a == 32) | ((a >= 9) & (a <= 13))
    out[TEXT_DIM:] = (
        min(1.0, np.log10(len(words) + 1) / 4), letter.mean(), digit.mean(), (~(letter | digit | space)).mean(), ((a >= 65) & (a <= 90)).mean(), len(set(words)) / n,
        sum(x == y for x, y in zip(words, words[1:])) / n, 1 - len(set(lines)) / max(1, len(lines)), sum(len(w) == 1 and not w.isalnum() for w in words) / n,
        min(1.0, sum(map(len, words)) / n / 20), sum(w[-1] in ".!?" for w in words) / n, min(1.0, len(lines) / n),
    )
    return np.clip(np.rint(out / _SCALE), 0, 255).astype(np.uint8)


def meta_view(values: Sequence[object]) -> np.ndarray:
    """Hashed categories of all metadata, 0 or 1; numbers fall into bins of their logarithm. A null is a category of its own."""
    out = np.zeros(META_DIM, dtype=np.uint8)
    for i, v in enumerate(values):
        if isinstance(v, (int, float, np.number)) and not isinstance(v, bool):
            v = None if v != v else f"2^{int(np.log2(abs(v) + 1))}"
        out[zlib.crc32(f"{i}:{v}".encode()) % META_DIM] = 1
    return out


def _scaled(view: int, x: np.ndarray) -> np.ndarray:
    """Features as the machines see them."""
    return x * (0.5 if view else _SCALE)


def margins(view: int, x: np.ndarray, machine: tuple[np.ndarray, float]) -> np.ndarray:
    """Exact margins of rows of features: both these and the rounded weights are whole numbers."""
    whole = np.rint(_scaled(view, machine[0].astype(np.float64)) / _WEIGHT)
    return (x.astype(np.float64) @ whole) * _WEIGHT + machine[1]


@dataclass
class Model:
    text: tuple[np.ndarray, float]
    meta: tuple[np.ndarray, float]
    #: Slope and offset of each view's calibration, then weights of both logits and an offset.
    calibration: tuple[tuple[float, float], tuple[float, float]]
    combined: tuple[float, float, float]

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities by the text, by the metadata, and by both."""
        logits = [a * margins(view, x, machine) + c for view, (x, machine, (a, c)) in enumerate(zip((text, meta), (self.text, self.meta), self.calibration, strict=True))]
        u, v, o = self.combined
        return _sigmoid(logits[0]), _sigmoid(logits[1]), _sigmoid(u * logits[0] + v * logits[1] + o)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; classes weigh alike; the last weight is the offset."""
    x = np.column_stack((x, np.ones(len(x))))
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = _sigmoid(x @ w)
        grad = x.T @ (weight * (p - (y > 0))) + ridge * w
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


def _views(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Features of rows whose last columns are the text and then the metadata; what stands before is kept."""
    for batch in batches:
        at = batch.columns.get_loc("_text")
        kept = {c: batch[c] for c in batch.columns[:at]}
        yield pd.DataFrame(kept | {"x": [text_view(t).tobytes() for t in batch["_text"]], "z": [meta_view(v).tobytes() for v in batch[batch.columns[at + 1 :]].itertuples(index=False)]})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(v, dtype=np.uint8) for v in column])


def _histogram(machines):
    """How many rows have a margin in each bin, of both views."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                bins = [np.unique(np.floor(margins(i, _matrix(batch[c]), machines[i]) / _BIN).astype(np.int64), return_counts=True) for i, c in enumerate("xz")]
                yield pd.concat([pd.DataFrame({"view": i, "bin": b, "n": n}) for i, (b, n) in enumerate(bins)])

    return run


def _chosen(machines, bounds):
    """Rows that a view is sure of, with by_text and by_meta: 1, -1 or 0 for not sure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = [margins(i, _matrix(batch[c]), machines[i]) for i, c in enumerate("xz")]
                batch["by_text"], batch["by_meta"] = ((m >= high).astype(np.int32) - (m < low).astype(np.int32) for m, (low, high) in zip(found, bounds, strict=True))
                yield batch[(batch["by_text"] != 0) | (batch["by_meta"] != 0)]

    return run


def _slopes(machines):
    """Sums of slack times features over pseudo-labelled rows: view, label, dim (the last one for the offset), value (whole number)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for view, (column, given) in enumerate((("x", "by_meta"), ("z", "by_text"))):
                for label in (1, -1):
                    own = batch[batch[given] == label]
                    if len(own):
                        x = _matrix(own[column])
                        slack = np.rint(np.maximum(0, 1 - label * margins(view, x, machines[view])) / _SLACK)
                        now = np.append(slack @ x.astype(np.float64), slack.sum()).astype(np.int64)
                        total[view, label] = total.get((view, label), 0) + now
        for (view, label), value in total.items():
            yield pd.DataFrame({"view": view, "label": label, "dim": np.arange(len(value)), "value": value})

    return run


def sure_bounds(bins: dict[int, int], shares: tuple[float, float], doubt: tuple[float, float]) -> tuple[float, float]:
    """Margins (low, high): rows below low are surely bad, rows from high on surely good: each a share of all rows, up to the end of the bin that fills it, and beyond its ``doubt``."""
    total, order = sum(bins.values()), sorted(bins)
    low, high, held = doubt[0], doubt[1], 0
    for b in order:
        held += bins[b]
        if held >= shares[0] * total:
            low = min(low, (b + 1) * _BIN)
            break
    held = 0
    for b in reversed(order):
        held += bins[b]
        if held >= shares[1] * total:
            high = max(high, b * _BIN)
            break
    return low, high


def cotrain(pool: DataFrame, x: np.ndarray, z: np.ndarray, y: np.ndarray, *, rounds: int = 3, steps: int = 10, give: float = 0.15, sure: float = 0.9, c: float = 10.0) -> Model:
    """Fit on labelled rows (features x, z; ``y`` +1 or -1) and all rows of ``pool`` (x, z binary).

    A third of each class of the labelled rows is kept for the calibration (a class of fewer than three rows is calibrated on what was learned from). In round r of
    ``rounds`` a view hands over the surest ``give * r`` of each class's part of the pool that it holds with probability ``sure`` or more.
    """
    nth = np.zeros(len(y), dtype=np.int64)
    for label in (1, -1):
        nth[y == label] = np.arange((y == label).sum())
    aside = nth % 3 == 2
    learn = ~aside
    check = aside if len(set(y[aside])) == 2 else np.ones(len(y), dtype=bool)
    own = [(x[learn], y[learn]), (z[learn], y[learn])]
    machines = [fit_svm(_scaled(i, v).astype(np.float32), t.astype(np.float32), c=c)[:2] for i, (v, t) in enumerate(own)]
    good = float((y > 0).mean())
    for turn in range(1, rounds + 1):
        found: list[dict[int, int]] = [{}, {}]
        for r in pool.mapInPandas(_histogram(machines), "view int, bin long, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).collect():
            found[r["view"]][r["bin"]] = r["n"]
        if not found[0]:
            break
        bounds = []
        for i, (v, t) in enumerate(own):
            slope, offset = _logistic(margins(i, v, machines[i])[:, None], t)
            edge = np.log(sure / (1 - sure))
            doubt = sorted(((-edge - offset) / slope, (edge - offset) / slope)) if slope > 1e-6 else (-np.inf, np.inf)
            bounds.append(sure_bounds(found[i], (give * turn * (1 - good), give * turn * good), tuple(doubt)))
        chosen = written(pool.mapInPandas(_chosen(machines, bounds), "x binary, z binary, by_text int, by_meta int"), "chosen")
        sizes = {(r["by_text"], r["by_meta"]): r["n"] for r in chosen.groupBy("by_text", "by_meta").agg(F.count("*").alias("n")).collect()}
        handed = [{label: sum(n for k, n in sizes.items() if k[1 - view] == label) for label in (1, -1)} for view in (0, 1)]
        if not sizes:
            break
        now, before, t = machines, machines, 1.0
        for _ in range(steps):
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead = [(w + (t - 1) / after * (w - v), b + (t - 1) / after * (b - u)) for (w, b), (v, u) in zip(now, before, strict=True)]
            sums = chosen.mapInPandas(_slopes(ahead), "view int, label int, dim int, value long").groupBy("view", "label", "dim").agg(F.sum("value").alias("value")).collect()
            before, now, t = now, _step(ahead, own, handed, sums, c), after
        machines = now
        discard(chosen)
    margin = [margins(i, v[check], machines[i]) for i, v in enumerate((x, z))]
    fits = [_logistic(m[:, None], y[check]) for m in margin]
    logits = np.column_stack([a * m + b for m, (a, b) in zip(margin, fits, strict=True)])
    u, v, o = _logistic(logits, y[check])
    return Model(*machines, tuple((float(a), float(b)) for a, b in fits), (float(u), float(v), float(o)))


def _step(machines, own, handed, sums, c: float) -> list[tuple[np.ndarray, float]]:
    """One step down the squared hinge loss of labelled rows and of those handed over, which weigh half as much; classes weigh alike."""
    out = []
    for view, ((w, b), (x, y)) in enumerate(zip(machines, own, strict=True)):
        slope = np.zeros(len(w) + 1)
        for label in (1, -1):
            rows = x[y == label]
            slack = np.maximum(0, 1 - label * margins(view, rows, (w, b)))
            slope += label / 2 / max(1, len(rows)) * np.append(_scaled(view, slack @ rows.astype(np.float64)), slack.sum())
            value = np.zeros(len(w) + 1)
            for r in sums:
                if r["view"] == view and r["label"] == label:
                    value[r["dim"]] = r["value"] * _SLACK
            slope += label / 4 / max(1, handed[view][label]) * np.append(_scaled(view, value[:-1]), value[-1])
        rate = 1 / (1 + 8 * c)
        out.append((w - rate * (w - 2 * c * slope[:-1]), b + rate * 2 * c * float(slope[-1])))
    return out


def _draw(id_col: str, *more: str) -> Column:
    return F.xxhash64(F.lit("co"), F.col(id_col), *map(F.col, more))


@small_batches
def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", meta_cols: Sequence[str] = ("source", "lang", "n_chars"), labelled_rows: int = 3000, rounds: int = 3, give: float = 0.15, sure: float = 0.9) -> Model | None:
    """Fit on at most ``labelled_rows`` labelled documents (half of each class at most) and, by pseudo-labels, on all documents.

    Labelled ids are drawn by their hash before texts are looked at, and rows of an id by that of id and text, so that no text is shuffled. Labels other
    than 0 and 1 are none; of several labels of one id the largest stands; a null id has none. Repeated rows, nulls, empty and very long texts take part like any other.
    Without labels of both classes, or without a document of each, there is no model.
    """
    half = labelled_rows // 2
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    # Labels of ids that the table lacks teach nothing and must not fill the draw.
    known = known.join(docs.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi")
    known = written(known.withColumn("_draw", _draw("_id")), "labels")
    ids = reduce(DataFrame.unionByName, [known.where(F.col("_label") == k).orderBy("_draw", "_id").limit(2 * half) for k in (0, 1)])
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *meta_cols)
    rows = own.join(F.broadcast(written(ids.drop("_draw"), "drawn")), "_id").select("_label", _draw("_id", "_text").alias("_draw"), "_text", *meta_cols)
    rows = written(rows.mapInPandas(_views, "_label int, _draw long, x binary, z binary"), "labelled")
    found = [r for k in (0, 1) for r in rows.where(F.col("_label") == k).orderBy("_draw", "x", "z").limit(half).collect()]
    for table in (known, rows):
        discard(table)
    found.sort(key=lambda r: (r["_draw"], r["x"], r["z"]))
    y = np.array([1.0 if r["_label"] == 1 else -1.0 for r in found])
    if len(set(y)) < 2:
        return None
    x, z = (np.stack([np.frombuffer(r[k], dtype=np.uint8) for r in found]) for k in "xz")
    pool = written(docs.select(F.col(text_col).alias("_text"), *meta_cols).mapInPandas(_views, "x binary, z binary"), "views")
    model = cotrain(pool, x, z, y, rounds=rounds, give=give, sure=sure)
    discard(pool)
    return model


@small_batches
def classify(docs: DataFrame, model: Model | None, *, text_col: str = "text", meta_cols: Sequence[str] = ("source", "lang", "n_chars"), least: float = 0.5) -> DataFrame:
    """``docs`` with p_text, p_meta, score (0 to 1; 0.5 without a model) and kept (score of ``least`` or more).

    Nulls, empty and very long texts and repeated rows are scored like any other, from the whole text. Columns of these names are replaced, but may be among ``meta_cols``.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        own = held.value
        for texts, metas in batches:
            out = []
            for at in range(0, len(texts), 512):
                part = texts.iloc[at : at + 512]
                if own is None:
                    out.append(np.full((len(part), 3), 0.5))
                else:
                    x = np.stack([text_view(t) for t in part])
                    z = np.stack([meta_view(v) for v in metas.iloc[at : at + 512].itertuples(index=False)])
                    out.append(np.column_stack(own.scores(x, z)))
            yield pd.DataFrame(np.vstack(out) if out else np.zeros((0, 3)), columns=["p_text", "p_meta", "score"])

    name = free_name(docs, "found")
    found = docs.withColumn(name, F.pandas_udf(score, "p_text double, p_meta double, score double")(F.col(text_col), F.struct(*meta_cols)))
    found = found.withColumns({c: F.col(name)[c] for c in ("p_text", "p_meta", "score")}).drop(name)
    return found.withColumn("kept", F.col("score") >= least)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).select("doc_id", "p_text", "p_meta", "score", "kept")
