"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins. Shallow trees are boosted in turn, one feature at a time, and
add up to one lookup table per feature; then the pairs of features whose residuals help most get
tables of their own. A score is a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugarline.llm.common import bound_rows, id_bucket, small_batches

FEATURES = (
    "log_words", "word_length", "long_words", "distinct_words", "top_word", "next_equal", "lines",
    "repeated_lines", "letters", "capitals", "digits", "marks", "symbols", "pipes", "exclamations",
    "non_ascii", "sentence_ends", "repeated_triples",
)
#: Byte classes (fixed values): each row is counted once per text.
CLASSES = {
    "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "small": b"abcdefghijklmnopqrstuvwxyz",
    "digits": b"0123456789",
    "symbols": b"#*$%&<>{}[]\\^~_=+@/",
    "pipes": b"|",
    "exclamations": b"!",
    "sentence_ends": b".?;:",
    "commas": b",'\"()-",
}


def _class_table() -> tuple[list[str], np.ndarray]:
    names = ["other", *CLASSES, "non_ascii"]
    table = np.zeros(256, np.uint8)
    table[128:] = names.index("non_ascii")
    for name, members in CLASSES.items():
        table[list(members)] = names.index(name)
    return names, table


NAMES, TABLE = _class_table()


def text_features(text: str) -> list[float]:
    """Figures of one whole text; all 0 for an empty one."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.lower().split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), max(len(data), 1)
    counts = np.bincount(TABLE[np.frombuffer(data, np.uint8)], minlength=len(NAMES))
    part = {name: counts[i] / size for i, name in enumerate(NAMES)}
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    triples = set(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        sum(len(w) > 12 for w in tally) / len(tally),
        len(tally) / n,
        max(tally.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(lines) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        part["small"],
        part["capitals"],
        part["digits"],
        part["commas"],
        part["symbols"],
        part["pipes"],
        part["exclamations"],
        part["non_ascii"],
        part["sentence_ends"],
        1 - len(triples) / max(n - 2, 1),
    ]


@dataclass
class Model:
    """``edges``: cut points of each feature; ``tables``: one value per bin; ``pairs``: (i, j,
    table of coarse bins)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    coarse: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for i, j, table in self.pairs:
            total += table[_coarse(bins[:, i], self.edges[i], self.coarse), _coarse(bins[:, j], self.edges[j], self.coarse)]
        return 1 / (1 + np.exp(-total))


def _coarse(bins: np.ndarray, edges: np.ndarray, coarse: int) -> np.ndarray:
    return bins * coarse // (len(edges) + 1)


def _stump(bins: np.ndarray, size: int, gradient: np.ndarray, hessian: np.ndarray, depth: int = 2) -> np.ndarray:
    """A regression tree of ``depth`` on one binned feature, as a table of one value per bin."""
    g = np.bincount(bins, gradient, size)
    h = np.bincount(bins, hessian, size)
    out = np.zeros(size)

    def split(a: int, b: int, left: int) -> None:
        value = lambda i, j: g[i:j].sum() / (h[i:j].sum() + 1.0)
        if left and b - a > 1:
            gl, hl = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
            gr, hr = g[a:b].sum() - gl, h[a:b].sum() - hl
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1)
            cut = int(gain.argmax())
            if gain[cut] > g[a:b].sum() ** 2 / (h[a:b].sum() + 1) + 1e-9:
                split(a, a + cut + 1, left - 1)
                split(a + cut + 1, b, left - 1)
                return
        out[a:b] = value(a, b)

    split(0, size, depth)
    return out


def fit(x: np.ndarray, y: np.ndarray, cycles: int = 80, rate: float = 0.1, bins: int = 32, pairs: int = 6, coarse: int = 8) -> Model:
    """Cyclic boosting on the logistic loss: first all features in turn, then the best pairs."""
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, j], quantiles)) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Model(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], [], coarse)
    if not len(y) or len(set(y)) < 2:
        return model
    cells = model.bins(x)
    total = np.full(len(y), model.base)
    for _ in range(cycles):
        for j in range(x.shape[1]):
            p = 1 / (1 + np.exp(-total))
            table = rate * _stump(cells[:, j], len(edges[j]) + 1, y - p, p * (1 - p))
            model.tables[j] += table
            total += table[cells[:, j]]
    rough = np.stack([_coarse(cells[:, j], edges[j], coarse) for j in range(x.shape[1])], axis=1)

    def cell_step(i: int, j: int, p: np.ndarray) -> tuple[np.ndarray, float]:
        at = rough[:, i] * coarse + rough[:, j]
        g = np.bincount(at, y - p, coarse * coarse)
        h = np.bincount(at, p * (1 - p), coarse * coarse)
        return (g / (h + 2.0)).reshape(coarse, coarse), float((g**2 / (h + 2.0)).sum())

    p = 1 / (1 + np.exp(-total))
    gains = sorted(
        ((cell_step(i, j, p)[1], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True
    )[:pairs]
    model.pairs = [(i, j, np.zeros((coarse, coarse))) for _, i, j in gains]
    for _ in range(cycles // 4):
        for i, j, table in model.pairs:
            step = rate * cell_step(i, j, 1 / (1 + np.exp(-total)))[0]
            table += step
            total += step[rough[:, i], rough[:, j]]
    return model


def features(text: Column) -> Column:
    """The figures of a text as an array; a null text counts as empty."""

    @F.pandas_udf("array<double>")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([text_features(t or "") for t in texts], dtype=object)

    return compute(text)


def train(docs: DataFrame, labels: DataFrame, rows: int = 6000) -> Model:
    """Fit on the ``rows`` labelled texts with the smallest id hashes.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality. Null ids, texts and labels are
    passed over; of repeated labels of an id the smallest counts. Features are computed where the
    texts are; the driver gets the features of at most ``rows`` texts.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = bound_rows(known, [F.xxhash64("doc_id"), F.col("doc_id")], rows)
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    found = texts.join(chosen, "doc_id").select("quality", features(F.col("text")).alias("x")).toPandas()
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    y = found["quality"].to_numpy(float)
    order = np.lexsort([*x.T, y])  # the same sums whatever the order of arrival
    return fit(x[order], (y[order] >= 0.5).astype(float))


def scored(text: Column, model: Model) -> Column:
    """The model's probability of label 1 for a text; a null text counts as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([text_features(t or "") for t in texts], float).reshape(len(texts), len(FEATURES))
            yield pd.Series(model.score(x))

    return score(text)


def predicted(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``.

    Learns from labels of documents whose id's checksum leaves another remainder than ``fold``. A
    null id is in no fold. Repeated rows get equal results; extra columns are ignored; without any
    usable label every score is one half; no rows give no result.
    """
    mine = labels.where(id_bucket(F.col("doc_id"), folds) != fold)
    model = train(docs, mine)
    return docs.select(
        "doc_id",
        F.coalesce(id_bucket(F.col("doc_id"), folds) == fold, F.lit(False)).alias("held_out"),
        scored(F.col("text"), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, fold: int = 1, folds: int = 3) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns."""
    small_batches(docs.sparkSession)
    mine = labels.where(id_bucket(F.col("doc_id"), folds) != fold)
    return docs.where(scored(F.col("text"), train(docs, mine)) >= least)
