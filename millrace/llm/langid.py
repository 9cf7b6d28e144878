"""Language identification with string kernels.

A text is the set of its character n-grams of all lengths up to three (the blended
spectrum), and the kernel of two texts is the number of n-grams they share over the
geometric mean of the numbers they have. The kernel is approximated from landmark
texts by Nyström's method: the features of a text are its kernels with the landmarks
times the inverse root of the landmarks' own kernel matrix. A ridge regression for
each language against the rest gives the scores. Scoring a batch of texts is one
product of its n-gram presence matrix with that of the landmarks, and one with the
coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.tables import written

UNKNOWN = "und"
# The sample that the classifier is fitted on: so many texts of each language, of which
# so many are landmarks. Everything else covers all documents.
SAMPLE_PER_LANGUAGE = 300
LANDMARKS_PER_LANGUAGE = 16
RIDGE = 1e-2
ORDER = 3
_BATCH = 64
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter or combines with one, else a blank."""
    if not _LETTERS:
        import unicodedata

        table = np.full(0x110000, 32, dtype=np.uint64)
        for point in range(0x110000):
            if unicodedata.category(chr(point))[0] in "LM":
                table[point] = point
        _LETTERS.append(table)
    return _LETTERS[0]


def ngrams(text: str) -> np.ndarray:
    """The sorted distinct n-grams of a text as numbers; a letter takes 21 bits.

    Lower case; what is no letter is a blank, and blanks are one. A text without a
    letter has none.
    """
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    blank = points == 32
    points = points[~(blank & np.r_[False, blank[:-1]])]
    if len(points) == 0 or (len(points) == 1 and points[0] == 32):
        return np.zeros(0, dtype=np.uint64)
    found, codes = [np.unique(points)], points
    for _ in range(ORDER - 1):
        if len(codes) < 2:
            break
        codes = (codes[:-1] << np.uint64(21)) | points[len(points) - len(codes) + 1 :]
        found.append(np.unique(codes))
    return np.concatenate(found)


@dataclass
class Landmarks:
    """Landmark texts as a presence matrix over their own n-grams."""

    grams: np.ndarray
    presence: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> "Landmarks":
        sets = [ngrams(t) for t in texts]
        grams = np.unique(np.concatenate(sets)) if sets else np.zeros(0, dtype=np.uint64)
        presence = np.zeros((len(grams), len(sets)), dtype=bool)
        for k, own in enumerate(sets):
            presence[np.searchsorted(grams, own), k] = True
        return cls(grams, presence, np.array([len(s) for s in sets], dtype=np.float64))

    def kernels(self, texts: list[str]) -> np.ndarray:
        """Kernels of each text with each landmark: products of presence matrices, batch by batch."""
        matrix = self.presence.astype(np.float32)
        out = np.zeros((len(texts), matrix.shape[1]))
        for start in range(0, len(texts), _BATCH):
            part = texts[start : start + _BATCH]
            rows = np.zeros((len(part), len(self.grams)), dtype=np.float32)
            sizes = np.ones(len(part))
            for k, text in enumerate(part):
                own = ngrams(text)
                sizes[k] = max(1, len(own))
                at = np.searchsorted(self.grams, own)
                at[at == len(self.grams)] = 0
                rows[k, at[self.grams[at] == own]] = 1
            out[start : start + _BATCH] = (rows @ matrix) / np.sqrt(np.outer(sizes, np.maximum(self.sizes, 1)))
        return out


@dataclass
class Model:
    landmarks: Landmarks
    languages: list[str]
    coefficients: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and the score, 0 to 1, of each text."""
        known = [k for k, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known and self.languages:
            kernels = self.landmarks.kernels([texts[k] for k in known])
            values = np.c_[kernels, np.ones(len(known))] @ self.coefficients
            best = values.argmax(axis=1)
            for k, b, value in zip(known, best, values.max(axis=1)):
                names[k], scores[k] = self.languages[b], min(1.0, max(0.0, value))
        return names, scores


def fit(texts: list[str], languages: list[str], n_landmarks: int = LANDMARKS_PER_LANGUAGE) -> Model:
    """Fit on a sample in memory; the first ``n_landmarks`` of each language are the landmarks."""
    names = sorted(set(languages))
    taken = {name: 0 for name in names}
    landmark_texts = []
    for text, name in zip(texts, languages):
        if taken[name] < n_landmarks:
            taken[name] += 1
            landmark_texts.append(text)
    landmarks = Landmarks.of(landmark_texts)
    if not names:
        return Model(landmarks, [], np.zeros((1, 0)))
    own = landmarks.kernels(landmark_texts)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    usable = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, usable] / np.sqrt(values[usable])
    features = np.c_[landmarks.kernels(texts) @ root, np.ones(len(texts))]
    labels = np.array(languages)[:, None] == np.array(names)[None]
    # Languages weigh alike, however many texts of each there are.
    weight = 1.0 / labels.sum(axis=0)[labels.argmax(axis=1)]
    penalty = np.eye(features.shape[1]) * RIDGE
    penalty[-1, -1] = 1e-9
    weighted = features * weight[:, None]
    solved = np.linalg.solve(weighted.T @ features + penalty * weight.mean(), weighted.T @ labels)
    return Model(landmarks, names, np.r_[root @ solved[:-1], solved[-1:]])


def training_sample(
    docs: DataFrame, trainable: Column, per_language: int, id_col: str, text_col: str, lang_col: str
) -> DataFrame:
    """``per_language`` texts of each language: those of the smallest hashes of id and text.

    The texts are drawn in two steps, so that no language is sorted whole: a share of
    each, three times what is wanted by its count, and the smallest hashes of those.
    """
    usable = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).filter(F.coalesce(trainable, F.lit(False)) & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    drawn = (
        usable.withColumn("_draw", draw)
        .join(F.broadcast(counts.withColumnRenamed("lang", "_lang")), F.col("lang") == F.col("_lang"))
        .filter(F.col("_draw") * F.col("_n") <= 3.0 * per_language)
        .filter(F.col("text").rlike(r"\p{L}"))
    )
    order = Window.partitionBy("lang").orderBy("_draw", "doc_id", F.xxhash64("text"))
    return (
        drawn.select("lang", "text", F.row_number().over(order).alias("_place"))
        .filter(F.col("_place") <= per_language)
    )


def train(
    docs: DataFrame,
    trainable: Column,
    per_language: int = SAMPLE_PER_LANGUAGE,
    n_landmarks: int = LANDMARKS_PER_LANGUAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row with the fitted model. ``trainable`` is a condition on ``doc_id``, ``text`` and ``lang``."""
    sample = training_sample(docs, trainable, per_language, id_col, text_col, lang_col)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        rows = pd.concat(frames) if frames else pd.DataFrame({"lang": [], "text": [], "_place": []})
        rows = rows.sort_values(["_place", "lang"], kind="stable")
        model = fit(list(rows["text"]), list(rows["lang"]), n_landmarks)
        marks = model.landmarks
        yield pd.DataFrame(
            {
                "languages": [model.languages],
                "grams": [marks.grams.tobytes()],
                "presence": [np.packbits(marks.presence).tobytes()],
                "sizes": [marks.sizes.tobytes()],
                "coefficients": [model.coefficients.tobytes()],
            }
        )

    # The sample is bounded by a parameter, so one task may hold it.
    return written(
        sample.repartition(1).mapInPandas(
            solve, "languages array<string>, grams binary, presence binary, sizes binary, coefficients binary"
        )
    )


def load(row) -> Model:
    grams, sizes = np.frombuffer(row["grams"], dtype=np.uint64), np.frombuffer(row["sizes"])
    bits = np.unpackbits(np.frombuffer(row["presence"], dtype=np.uint8), count=len(grams) * len(sizes))
    languages = list(row["languages"])
    coefficients = np.frombuffer(row["coefficients"]).reshape(len(sizes) + 1, len(languages))
    return Model(Landmarks(grams, bits.reshape(len(grams), len(sizes)).astype(bool), sizes), languages, coefficients)


def predicted(model_row, text: Column) -> Column:
    """A struct of ``lang_pred`` and ``score`` for a text column.

    ``model_row`` is the row of ``train``, ``None`` if there was nothing to learn from.
    """
    packed = model_row.asDict() if model_row else None
    held: list[Model] = []

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(load(packed) if packed else fit([], []))
        values = [t if isinstance(t, str) else None for t in texts]
        names: list[str] = []
        scores = [np.zeros(0)]
        for start in range(0, len(values), 256):
            some_names, some_scores = held[0].predict(values[start : start + 256])
            names += some_names
            scores.append(some_scores)
        return pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores)})

    return predict(text)


def identify(
    docs: DataFrame,
    trainable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, and so is every
    text if there is nothing to learn from. Rows that repeat get a row each. Columns
    other than the three named are not looked at.
    """
    # Of bounded size: landmarks and coefficients.
    row = train(docs, trainable, per_language, id_col=id_col, text_col=text_col, lang_col=lang_col).first()
    found = docs.select(F.col(id_col).alias("doc_id"), predicted(row, F.col(text_col)).alias("_found"))
    return found.select("doc_id", "_found.lang_pred", "_found.score")
