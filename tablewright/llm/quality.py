"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import small_batches
from tablewright.llm.textvec import IS_SPACE, chunks, lay_out, mix, runs, segment_hashes

BITS = 18
#: Labelled documents that the weights are trained on, at most.
SAMPLE = 4000
#: Passes over them, and updates that training takes at least: few documents are passed over more often.
EPOCHS, LEAST_STEPS = 4, 12_000
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
#: 0 white space, 1 part of a word, 2 punctuation.
KIND = np.where(IS_SPACE, 0, 2).astype(np.int8)
SAME = np.uint64(0x5EED5A3E5A3E5EED)
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of each text: one- and two-word grams hashed to 2^BITS places, damped counts of unit length.

    A run of punctuation is a word of its own. A word that is the one before it again counts as the word SAME, so that
    repetition is a gram whatever it repeats.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    shift = np.uint64(64 - BITS)
    for _, part in chunks(texts):
        buf, at = lay_out(part)
        starts, ends = runs(KIND[buf])
        words = segment_hashes(buf, starts, ends)
        first = np.searchsorted(starts, at)
        again = np.zeros(len(words), bool)
        again[1:] = words[1:] == words[:-1]
        again[first[first < len(words)]] = False
        words = np.where(again, SAME, words)
        pairs = mix(words[:-1] * np.uint64(31) + words[1:])
        one, two = (words >> shift).astype(np.int64), (pairs >> shift).astype(np.int64)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            i, n = np.unique(np.concatenate((one[a:b], two[a : max(a, b - 1)])), return_counts=True)
            v = np.sqrt(n)
            out.append((i, v / max(1e-12, np.sqrt((v * v).sum()))))
    return out


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = np.array([self.bias + float(self.weights[i] @ v) for i, v in features(texts)])
        return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 5) -> QualityModel:
    """FTRL-proximal, one document at a time; the last place is the bias, which isn't regularised."""
    n = 1 << BITS
    z, g2 = np.zeros(n + 1), np.zeros(n + 1)
    order = np.random.RandomState(seed)

    def weights(i: np.ndarray) -> np.ndarray:
        l1 = np.where(i == n, 0.0, L1)
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((BETA + np.sqrt(g2[i])) / ALPHA + L2))

    rows = [(np.append(i, n), np.append(v, 1.0)) for i, v in rows]
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // len(rows))) if rows else 0):
        for k in order.permutation(len(rows)):
            i, v = rows[k]
            w = weights(i)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ v, -35, 35))) - labels[k]) * v
            z[i] += g - (np.sqrt(g2[i] + g * g) - np.sqrt(g2[i])) / ALPHA * w
            g2[i] += g * g
    w = weights(np.arange(n + 1))
    return QualityModel(w[:n].astype(np.float32), float(w[n]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Train on a bounded sample of labelled documents: the `sample` ids with the least hash, one row of each. Of several
    labels of an id the least counts, of several rows the one whose text has the least hash."""
    own = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    own = own.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    own = own.orderBy(F.xxhash64("id", F.lit("quality")), "id").limit(sample)  # bounded, so it may be broadcast
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(own), "id")
    chosen = chosen.withColumn("h", F.xxhash64("text")).withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("h"))).filter("nth = 1")
    small_batches(docs)

    def reduce(batches):
        for pdf in batches:
            f = features(pdf.text.tolist())
            yield pd.DataFrame({"id": pdf.id, "y": pdf.y, "i": [i.astype(np.int32) for i, _ in f], "v": [v.astype(np.float32) for _, v in f]})

    got = chosen.select("id", F.col("y").cast("int").alias("y"), "text").mapInPandas(reduce, "id long, y int, i array<int>, v array<float>").toPandas()
    got = got.iloc[np.lexsort((got.y.to_numpy(), got.id.to_numpy()))] if len(got) else got
    rows = [(np.asarray(i, np.int64), np.asarray(v, float)) for i, v in zip(got.i, got.v, strict=True)]
    return train(rows, got.y.to_numpy(float) if len(got) else np.zeros(0))


def classify(
    docs: DataFrame, labels: DataFrame, train_on=None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 from `threshold` on).

    `train_on`: a Column of labels that says which rows may be learned from (all, if None). Every text is read whole. A
    null or empty text is scored by the bias alone; without any labels every score is 0.5. Repeated rows get equal
    scores; other columns pass through, but for `score` and `predicted`, which are replaced.
    """
    model = fit(docs, labels if train_on is None else labels.filter(train_on), id_col, text_col, label_col)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()))

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    out = docs.select(*rest, score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
