"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased, everything but letters becomes one space, and character
n-grams (n = 1 to 3) are hashed into ``BUCKETS`` features.  Document frequencies
are counted over every document that may be learned from.  The weights are
trained with follow-the-regularised-leader, whose elastic-net penalties leave most
of them at zero, and a temperature is fitted on documents kept out of training.

Bounds: about ``PER_CLASS`` documents of each of the ``MOST_LANGUAGES`` most frequent
labels are drawn by a hash of their id for training; features are computed where the
documents are, and only they go to the task that trains.  The model has ``BUCKETS`` weights per language and is the
only thing that reaches the driver.

Defined results: a null text and a text without a letter are ``und`` with score
0, and so is every text if nothing could be learned; ties go to the language that
sorts first; rows that repeat an id are predicted separately; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
LENGTHS = (1, 2, 3)
PER_CLASS = 1000
MOST_LANGUAGES = 64
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
#: Every so many sampled documents one is kept out of training to fit the temperature.
CALIBRATION_EVERY = 5
UNKNOWN = "und"
_LETTER = "_has_letter"
_UNIT = 1 << 30
#: Characters that are hashed at a time, so that a very long text needs little memory.
_WINDOW = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(_letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")].any())


def gram_counts(text: str) -> np.ndarray:
    """Occurrences per bucket of the n-grams of a whole text; all zero without a letter."""
    counts = np.zeros(BUCKETS, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return counts
    codes = np.where(letter, codes, 32).astype(np.uint32)
    inner = np.ones(len(codes), bool)
    inner[1:] = letter[1:] | letter[:-1]  # of a run of other characters one space stays
    codes = codes[inner]
    codes = codes[int(codes[0] == 32):len(codes) - int(codes[-1] == 32)]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    reach = max(LENGTHS) - 1
    for at in range(0, len(codes), _WINDOW):
        part = codes[at:at + _WINDOW + reach]
        for n in LENGTHS:
            starts = min(_WINDOW, len(codes) - at, len(part) - n + 1)
            if starts <= 0:
                continue
            mixed = np.full(starts, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                mixed = (mixed ^ part[k:k + starts]) * np.uint32(0x85EBCA6B)
                mixed ^= mixed >> np.uint32(15)
            counts += np.bincount((mixed * np.uint32(0xC2B2AE35)) >> np.uint32(16), minlength=BUCKETS)
    return counts


def _features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    values = (1 + np.log(counts[at])) * idf[at]
    size = np.sqrt(values @ values)
    return at, values / size if size else values


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        at, values = _features(text, self.idf)
        if not len(at):
            return UNKNOWN, 0.0
        shares = _softmax(values @ self.weights[at] / self.temperature)
        best = int(np.argmax(shares))
        return self.languages[best], float(shares[best])


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (buckets x classes) by per-coordinate FTRL-proximal with L1 and L2 penalties."""
    z = np.zeros((BUCKETS, classes))
    n = np.zeros((BUCKETS, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, values, label in examples:
            w = weights(z[at], n[at])
            error = _softmax(values @ w)
            error[label] -= 1
            gradient = np.outer(values, error)
            grown = n[at] + gradient ** 2
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return weights(z, n)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden section over its logarithm.

    The targets are smoothed by one unseen error, else labels without any error would push every score to 1.
    """
    if not len(labels) or scores.shape[1] < 2:
        return 1.0
    target = np.full(scores.shape, 1 / (len(labels) + 2) / (scores.shape[1] - 1))
    target[np.arange(len(labels)), labels] = 1 - 1 / (len(labels) + 2)

    def loss(t: float) -> float:
        return -(target * np.log(np.maximum(_softmax(scores / np.exp(t)), 1e-300))).sum()

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def is_held_out(doc_id: Column) -> Column:
    """Documents that training must not see: a third, by the checksum of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_language_model(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = PER_CLASS,
    most_languages: int = MOST_LANGUAGES,
) -> LanguageModel:
    """Learn from the labelled documents that are not held out, at most about ``per_class`` of each language.

    A column with more labels than ``most_languages`` is not one of languages; the most frequent ones are learned.
    """
    import pyarrow as pa

    learnable = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).where(F.col("id").isNotNull() & ~is_held_out(F.col("id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BUCKETS, np.int64)
        seen = 0
        for batch in batches:
            for text in batch.column(0):
                found += gram_counts(text.as_py()) > 0
                seen += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(found[at], seen))], names=["bucket", "docs"]
        )

    counted = learnable.select("text").mapInArrow(frequencies, "bucket bigint, docs bigint")
    rows = counted.groupBy("bucket").agg(F.sum("docs").alias("docs")).collect()  # at most one row per bucket
    found = {r["bucket"]: r["docs"] for r in rows}
    total = found.pop(-1, 0)
    idf = np.full(BUCKETS, np.log(1 + total) + 1)
    for bucket, n in found.items():
        idf[bucket] = np.log((1 + total) / (1 + n)) + 1

    counts = learnable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    sizes = {r["lang"]: r["count"] for r in counts}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], idf, np.zeros((BUCKETS, 0)), 1.0)
    unit = F.pmod(F.xxhash64("id"), F.lit(_UNIT))
    shares = docs.sparkSession.createDataFrame(
        [(lang, i, min(_UNIT, -(-per_class * _UNIT // sizes[lang]))) for i, lang in enumerate(languages)],
        "lang string, label int, share bigint")  # at most most_languages rows
    sample = learnable.withColumn("unit", unit).join(F.broadcast(shares), "lang").where("unit < share").select(
        "unit", F.col("id").cast("string").alias("id"), "label", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_features(text.as_py(), idf) for text in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([at.astype(np.int32) for at, _ in found], pa.list_(pa.int32())),
                 pa.array([values for _, values in found], pa.list_(pa.float64()))],
                names=["unit", "id", "label", "buckets", "values"])

    drawn_rows = sample.mapInArrow(
        features, "unit bigint, id string, label int, buckets array<int>, values array<double>")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = []
        for batch in batches:
            for unit, key, label, at, values in zip(*(batch.column(k) for k in range(5))):
                if len(at):
                    drawn.append((unit.as_py(), key.as_py(), at.values.to_numpy(), values.values.to_numpy(), label.as_py()))
        drawn.sort(key=lambda x: x[:2])
        kept_out = drawn[::CALIBRATION_EVERY] if len(drawn) > 10 * CALIBRATION_EVERY else []
        rest = [x for i, x in enumerate(drawn) if not kept_out or i % CALIBRATION_EVERY]
        weights = train_ftrl([x[2:] for x in rest], len(languages))
        scores = np.array([values @ weights[at] for _, _, at, values, _ in kept_out])
        heat = fit_temperature(scores, np.array([x[4] for x in kept_out], int))
        at = np.flatnonzero(weights.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array([*weights[at].tolist(), [heat]], pa.list_(pa.float64()))],
            names=["bucket", "weights"],
        )

    # The sample is bounded by per_class and most_languages; only its features go to the one task that trains.
    model = drawn_rows.repartition(1).mapInArrow(train, "bucket bigint, weights array<double>").collect()
    weights, heat = np.zeros((BUCKETS, len(languages))), 1.0
    for row in model:
        if row["bucket"] < 0:
            heat = row["weights"][0]
        else:
            weights[row["bucket"]] = row["weights"]
    return LanguageModel(languages, idf, weights, heat)


def predict_languages(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", kept: list[str] | None = None
) -> DataFrame:
    """The ``kept`` columns (all, if not given) of every row with lang_pred and score."""
    kept = docs.columns if kept is None else kept
    return _judged(docs, model, text_col, kept).drop(_LETTER)


def _judged(docs: DataFrame, model: LanguageModel, text_col: str, kept: list[str]) -> DataFrame:
    """The ``kept`` columns with lang_pred, score and, whatever the model knows, whether the text has a letter."""
    import pyarrow as pa

    names = [f"c{i}" for i in range(len(kept))]
    rows = docs.select(F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the buckets and the languages
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [text.as_py() for text in batch.column(0)]
            found = [model.predict(text) for text in texts]
            # A score above zero takes a letter.
            letter = [f[1] > 0 or has_letter(text) for f, text in zip(found, texts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array(letter, pa.bool_())],
                names=[*names, "lang_pred", "score", _LETTER],
            )

    out = rows.mapInArrow(predict, f"{kinds}, lang_pred string, score double, {_LETTER} boolean")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, kept)], "lang_pred", "score", _LETTER)


def keep_known(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str | None = None,
    wanted: list[str] | None = None, least_score: float = 0.0, correct: bool = False,
) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and, where ``wanted`` names languages, is in one of them.

    A text is of another language if the model says so with a score of ``least_score`` or more; a model that could
    learn nothing says nothing.  Where ``lang_col`` is given, its nulls are filled with the prediction; with ``correct``
    so are the labels of texts that the model says with ``least_score`` or more to be of another language.
    """
    columns = docs.columns
    named = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)])
    judged = _judged(named, model, f"k{columns.index(text_col)}", named.columns)
    keeps = F.col(_LETTER)
    if wanted is not None and model.languages:
        keeps = keeps & (F.col("lang_pred").isin(list(wanted)) | (F.col("score") < least_score))
    said = F.when(F.col("score") > 0, F.col("lang_pred"))
    sure = F.when(F.col("score") >= least_score, said) if correct else F.lit(None).cast("string")
    return judged.where(keeps).select(*[
        (F.coalesce(sure, F.col(f"k{i}"), said) if c == lang_col else F.col(f"k{i}")).alias(c)
        for i, c in enumerate(columns)])
