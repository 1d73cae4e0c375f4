"""Language identification by error-correcting output codes.

Each language has a codeword of bits. One linear classifier per bit works on hashed character
n-grams; loss-weighted decoding picks the language whose codeword costs least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugarline.llm.common import blocks, bound_rows, id_bucket

#: Hash buckets of the n-grams of one and the same order.
BUCKETS = 1 << 12
ORDERS = (1, 2, 3)
UNKNOWN = "und"


def codewords(classes: int, least_bits: int = 15) -> np.ndarray:
    """Codewords of +1 and -1, one row per class, far apart from each other.

    Up to five classes get the exhaustive code (every split of the classes into two sets); more get
    the random code with the largest smallest distance of 200 tries with a fixed seed.
    """
    if classes <= 1:
        return np.ones((classes, 1), np.int8)
    if classes <= 5:
        splits = np.arange(1, 1 << (classes - 1))
        bits = (splits[None, :] >> np.arange(classes)[:, None]) & 1
        return np.where(bits == 1, 1, -1).astype(np.int8)
    rng = np.random.default_rng(7)
    width = max(least_bits, 4 * int(np.ceil(np.log2(classes))))
    best, best_distance = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), size=(classes, width))
        code = code[:, np.abs(code.sum(0)) < classes]
        agree = code.astype(int) @ code.T.astype(int)
        np.fill_diagonal(agree, -code.shape[1])
        if (code.shape[1] - agree.max()) / 2 > best_distance:
            best, best_distance = code, (code.shape[1] - agree.max()) / 2
    return best


def gram_buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram order: the bucket of every n-gram, and the index of its text.

    Texts are lower-cased, and everything but letters counts as a blank. N-grams do not cross
    texts; a text shorter than the order has none of it.
    """
    joined = "".join(f" {t} " for t in texts).lower()
    lengths = np.array([len(f" {t} ".lower()) for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    known, place = np.unique(codes, return_inverse=True)
    letters = np.array([chr(c).isalpha() for c in known])
    codes = np.where(letters, known, 32).astype(np.uint32)[place]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    for order in ORDERS:
        n = len(codes) - order + 1
        if n <= 0:
            continue
        value = codes[:n].copy()
        for k in range(1, order):
            value = value * np.uint32(0x01000193) ^ codes[k : n + k]
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x2C1B3C6D)
        value ^= value >> np.uint32(12)
        inside = np.arange(n) + order <= ends[:n]
        yield (value % np.uint32(BUCKETS))[inside].astype(np.int64), owner[:n][inside]


def shares(texts: list[str]) -> np.ndarray:
    """Shares of the n-gram buckets of each text, as a dense row."""
    out = np.zeros((len(texts), BUCKETS * len(ORDERS)), np.float32)
    for k, (bucket, owner) in enumerate(gram_buckets(texts)):
        counts = np.bincount(owner * BUCKETS + bucket, minlength=len(texts) * BUCKETS).reshape(len(texts), -1)
        out[:, k * BUCKETS : (k + 1) * BUCKETS] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    return out


@dataclass(frozen=True)
class Model:
    """``weights`` has a row per bucket and a column per bit, ``bias`` one value per bit."""

    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), len(self.bias)), np.float32)
        step = 256
        for i in range(0, len(texts), step):
            out[i : i + step] = shares(texts[i : i + step]) @ self.weights + self.bias
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best class, its score from 0 to 1, and whether the decision is ambiguous.

        The loss of a class is the logistic loss of its codeword's bits, each weighted by how sure
        its classifier is. A decision is ambiguous if the runner-up costs less than a quarter of a
        bit more.
        """
        agree = margins[:, None, :] * self.code[None, :, :]
        sure = np.abs(margins) / np.maximum(np.abs(margins).sum(1, keepdims=True), 1e-9)
        loss = (np.logaddexp(0, -agree) * sure[:, None, :]).sum(2) * self.code.shape[1]
        best = loss.argmin(1)
        score = np.exp(-(loss - loss.min(1, keepdims=True)))
        score = 1 / score.sum(1)
        ranked = np.sort(loss, axis=1)
        close = ranked[:, 1] - ranked[:, 0] < 0.25 if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return best, score, close


def fit(texts: list[str], labels: list[str], rounds: int = 150) -> Model:
    """One logistic classifier per bit, by gradient descent with momentum on all texts at once."""
    languages = tuple(sorted(set(labels)))
    code = codewords(len(languages))
    if not languages:
        return Model((), code, np.zeros((BUCKETS * len(ORDERS), 1), np.float32), np.zeros(1, np.float32))
    x = np.vstack([shares(texts[i : i + 256]) for i in range(0, len(texts), 256)])
    place = np.array([languages.index(v) for v in labels])
    goal = code[place].astype(np.float32)
    # Every language weighs the same
    weight = (1 / np.bincount(place, minlength=len(languages)))[place].astype(np.float32)[:, None] / len(languages)
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    b = np.zeros(code.shape[1], np.float32)
    step_w, step_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        gradient = -goal * weight / (1 + np.exp(goal * (x @ w + b)))
        step_w = 0.9 * step_w - 4.0 * (x.T @ gradient + 1e-5 * w)
        step_b = 0.9 * step_b - 4.0 * gradient.sum(0)
        w, b = w + step_w, b + step_b
    return Model(languages, code, w, b)


def train(docs: DataFrame, per_language: int = 300, most_chars: int = 20_000) -> Model:
    """Fit on at most ``per_language`` texts of each language of ``docs`` (doc_id, text, lang).

    The texts are those with the smallest hashes of id and text, so the choice does not depend on the
    partitioning and copies do not crowd it; texts over ``most_chars`` are not used for learning.
    Null texts and languages are passed over.
    """
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= most_chars)
    )
    order = [F.xxhash64("doc_id", "text"), F.col("text")]
    rows = bound_rows(usable, order, per_language, by=["lang"]).toPandas()
    rows = rows.sort_values(["lang", "text"])
    return fit(rows["text"].tolist(), rows["lang"].tolist())


def identify(text: Column, model: Model) -> Column:
    """Struct of lang_pred, score and ambiguous for a text.

    ``und`` with score 0 if the text is null or has no letter, or if the model knows no language.
    """

    @F.pandas_udf("struct<lang_pred: string, score: double, ambiguous: boolean>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = [t or "" for t in texts]
            out = pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "ambiguous": True}, index=range(len(texts)))
            readable = [i for i, t in enumerate(texts) if model.languages and any(c.isalpha() for c in t)]
            for a, b in blocks([texts[i] for i in readable]):
                rows = readable[a:b]
                best, score, close = model.decode(model.margins([texts[i] for i in rows]))
                out.iloc[rows, 0] = np.array(model.languages, object)[best]
                out.iloc[rows, 1] = score.astype(float)
                out.iloc[rows, 2] = close
            yield out

    return predict(text)


def predicted(docs: DataFrame, fold: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous for each row of ``docs``.

    Learns from the documents whose id's checksum leaves another remainder than ``fold``. A null id
    is in no fold and is not learned from. Repeated rows get equal results; extra columns are
    ignored; no rows give no result.
    """
    model = train(docs.where(id_bucket(F.col("doc_id"), folds) != fold))
    return docs.select(
        "doc_id",
        F.coalesce(id_bucket(F.col("doc_id"), folds) == fold, F.lit(False)).alias("held_out"),
        identify(F.col("text"), model).alias("found"),
    ).select("doc_id", "held_out", "found.*")
