"""Language identification: nearest of several clustered centroids per language, by cosine of TF-IDF n-gram vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import small_batches
from tablewright.llm.textvec import trim

DIMS = 1 << 13
#: Labelled documents that the centroids are fitted to, for each language at most about.
SAMPLE = 500
#: Languages at most; a column with more values is refused.
MOST_LANGUAGES = 1000
CLUSTERS = 4
#: A document is rejected when its cosine to the nearest centroid is below this part of the least cosine that the
#: centroid's own training documents have.
SLACK = 0.25
LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that aren't lower-case letters become a space; all bytes of longer characters stay.
TO_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def grams(text: str) -> np.ndarray:
    """Counts of the hashed two- and three-byte n-grams of the lower-cased text."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(TO_LETTERS) + b" ", np.uint8).astype(np.uint32)
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = (two[:-1] << np.uint32(8)) | b[2:] | np.uint32(1 << 24)
    spread = lambda v: (v * np.uint32(2654435761)) >> np.uint32(32 - 13)
    out = np.bincount(spread(three), minlength=DIMS)
    out += np.bincount(spread(two[two != 0x2020]), minlength=DIMS)
    return out


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors; the term frequency is damped by a square root."""
    m = np.zeros((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        m[i] = np.sqrt(grams(t))
    m *= idf
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def clusters(m: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from well separated rows; returns unit centroids."""
    chosen = [int(np.argmin(m @ m.mean(0)))]
    while len(chosen) < min(k, len(m)):
        chosen.append(int(np.argmin((m @ m[chosen].T).max(1))))
    c = m[chosen]
    for _ in range(rounds):
        own = (m @ c.T).argmax(1)
        c = np.stack([m[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    least: np.ndarray
    owner: np.ndarray
    languages: list[str]

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        n = len(texts)
        lang, score, rejected = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
        for a in range(0, n, 256):
            part = [(i, t) for i, t in enumerate(texts[a : a + 256], a) if isinstance(t, str) and LETTER.search(t)]
            if not part or not self.languages:
                continue
            at = np.array([i for i, _ in part])
            cos = vectors([t for _, t in part], self.idf) @ self.centroids.T
            near = cos.argmax(1)
            best = np.stack([cos[:, self.owner == j].max(1) for j in range(len(self.languages))], 1)
            p = np.exp((best - best.max(1, keepdims=True)) / 0.05)
            lang[at] = np.array(self.languages, object)[best.argmax(1)]
            score[at] = 1.0 / p.sum(1)
            rejected[at] = cos[np.arange(len(at)), near] < self.least[near]
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": rejected})


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Fit centroids to a bounded sample of labelled rows, at most 2 * `sample` of each language and about `sample` of a large
    one, chosen by a hash of id and text; of rows equal in both, or of one null id, no more than that either.

    Raises ValueError if there are more than MOST_LANGUAGES languages. Tasks reduce the sampled texts to sparse counts of
    at most DIMS entries, whatever their length.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values")
    if not counts:
        return LanguageModel(np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0), np.zeros(0, int), [])
    part = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, sample / n)))])
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("id", "text", F.lit("language")), F.lit(1 << 30)))
    chosen = rows.filter(F.col("h") / F.lit(float(1 << 30)) < part[F.col("lang")])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))  # tasks send on 2 * sample rows of a language at most
    chosen = chosen.withColumn("nth", nth).filter(F.col("nth") <= 2 * sample).select("lang", "id", "text")
    small_batches(labelled)

    def count(batches):
        for pdf in batches:
            found = [grams(t) for t in pdf.text]
            yield pd.DataFrame({"lang": pdf.lang, "id": pdf.id, "i": [np.flatnonzero(g).astype(np.int32) for g in found], "n": [g[g > 0].astype(np.int32) for g in found]})

    got = chosen.mapInPandas(count, "lang string, id long, i array<int>, n array<int>").toPandas().sort_values(["lang", "id"], kind="stable")
    m = np.zeros((len(got), DIMS), np.float32)
    for k, (i, n) in enumerate(zip(got.i, got.n, strict=True)):
        m[k, np.asarray(i, int)] = np.asarray(n)
    idf = (np.log((1 + len(m)) / (1 + (m > 0).sum(0))) + 1).astype(np.float32)
    m = np.sqrt(m) * idf
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    languages = sorted(set(got.lang))
    cents, owner, least = [], [], []
    for j, lang in enumerate(languages):
        own = m[(got.lang == lang).to_numpy()]
        c = clusters(own, CLUSTERS)
        cos = own @ c.T
        for k in range(len(c)):
            mine = cos[cos.argmax(1) == k, k]
            least.append(SLACK * float(mine.min()) if len(mine) else 0.0)
            owner.append(j)
        cents.append(c)
    return LanguageModel(idf, np.concatenate(cents).astype(np.float32), np.array(least), np.array(owner), languages)


def predicted(model: LanguageModel, text: Column) -> Column:
    """struct(lang_pred, score, rejected) of a text column."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = model.predict(texts.tolist())
        trim()
        return out

    # else a filter on the result is planned below it and has the classifier evaluated once more
    return run.asNondeterministic()(text)


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with a struct column `language`: lang_pred, score (0 to 1) and rejected, learned from `labelled`.

    Every text is read whole. A null text, or one without a letter, is `und`, score 0 and rejected; so is every text
    if nothing is learned. Otherwise lang_pred is the nearest centroid's language, even where the distance rejects the
    document. Ties go to the language that sorts first. Repeated rows get equal results; other columns pass through.
    """
    model = fit(labelled, id_col, text_col, lang_col)
    small_batches(docs)
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "language"], predicted(model, F.col(text_col)).alias("language"))
