"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over every training text. Weights are trained with the follow-the-regularised-leader rule and
an elastic-net penalty on a bounded sample (``per_language`` texts of each language, by hash of the id), of which every fifth
text is kept back to fit the temperature that calibrates the probabilities. The model is small: 2^15 hashed n-grams times the
number of languages; it scores every whole text where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 15
DIMENSION = 1 << BITS
CHUNK = 1 << 20
#: Training texts of each language.
PER_LANGUAGE = 1_500
MAX_LANGUAGES = 1_000
UNDETERMINED = "und"
_MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


@cache
def _letters() -> np.ndarray:
    """Code point to its lower-case letter, 32 for everything that is no letter."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def ngram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams of the letters and gaps of a text; None if it has no letter."""
    counts, found = np.zeros(DIMENSION, dtype=np.int64), False
    gap = [np.uint32(32)]
    for at in range(0, len(text), CHUNK):
        part = text[max(0, at - 2): at + CHUNK]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        c = _letters()[points]
        found = found or bool((c != 32).any())
        first, last = at == 0, at + CHUNK >= len(text)
        if last and not found:
            return None
        # a gap before and after the text; what a chunk repeats of the one before is not counted again
        fresh = 0 if first else min(at, 2) + (at == 1)
        c = np.concatenate((gap if first or at == 1 else [], c, gap if last else [])).astype(np.uint32)
        one = c * _MIX[0]
        two = one[:-1] ^ (c[1:] * _MIX[1] + np.uint32(1))
        three = two[:-1] ^ (c[2:] * _MIX[2] + np.uint32(2))
        for h, skip in ((one, fresh), (two, max(0, fresh - 1)), (three, 0)):
            h = h[skip:]
            counts += np.bincount((h ^ (h >> np.uint32(15))) * _MIX[0] >> np.uint32(32 - BITS), minlength=DIMENSION)
    return counts if found else None


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index = np.flatnonzero(counts)
        value = np.log1p(counts[index]) * self.idf[index]
        return index, np.append(value / max(np.sqrt((value ** 2).sum()), 1e-12), 1.0)

    def logits(self, counts: np.ndarray) -> np.ndarray:
        index, value = self.features(counts)
        return value[:-1] @ self.weights[index] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text) if text and self.languages else None
        if counts is None:
            return UNDETERMINED, 0.0
        z = self.logits(counts) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def follow_leader(
    data: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02,
    l2: float = 0.02, passes: int = 4, seed: int = 5,
) -> np.ndarray:
    """FTRL-proximal with elastic net; ``data`` holds feature indices, values (the last: bias) and the class."""
    z = np.zeros((DIMENSION + 1, classes))
    n = np.zeros_like(z)

    def weights(rows):
        raw = -(z[rows] - np.sign(z[rows]) * l1) / ((beta + np.sqrt(n[rows])) / alpha + l2)
        return np.where(np.abs(z[rows]) <= l1, 0.0, raw)

    random = np.random.default_rng(seed)
    for _ in range(passes):
        for i in random.permutation(len(data)):
            index, value, label = data[i]
            rows = np.append(index, DIMENSION)
            w = weights(rows)
            logits = value @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            g = value[:, None] * p[None, :]
            n_new = n[rows] + g ** 2
            z[rows] += g - (np.sqrt(n_new) - np.sqrt(n[rows])) / alpha * w
            n[rows] = n_new
    return weights(np.arange(DIMENSION + 1))


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the smallest mean cross entropy on a fine grid. Targets are smoothed by one in ``n + 2``, so
    that a few texts told apart without error do not make the model certain."""
    if not len(labels):
        return 1.0
    n, classes = logits.shape
    targets = np.full(logits.shape, 1 / (n + 2) / max(1, classes - 1))
    targets[np.arange(n), labels] = 1 - 1 / (n + 2)

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - (targets * z).sum(axis=1)).mean())

    return min(np.exp(np.linspace(np.log(0.05), np.log(20), 241)).tolist(), key=loss)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts with letters and, per hashed n-gram, of texts that have it. ``texts`` has the one column of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSION + 1, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                counts = ngram_counts(text.as_py() or "")
                if counts is not None:
                    total[:-1] += counts > 0
                    n += 1
        total[-1] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    rows = texts.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMENSION + 1, dtype=np.int64)
    for r in rows:
        out[r["slot"]] = r["n"]
    return int(out[-1]), out[:-1]


def train(
    docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """Learns from the texts and languages of the rows of ``docs`` for which ``learn`` holds and the language is known."""
    known = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("x"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"),
    )
    sizes = known.groupBy("l").count().orderBy("l").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [r["l"] for r in sizes]
    if not languages:
        return LanguageModel([], np.zeros(DIMENSION), np.zeros((DIMENSION + 1, 0)), 1.0)
    n, df = document_frequencies(known.select("t"))
    model = LanguageModel(languages, np.log((1 + n) / (1 + df)) + 1, np.zeros((DIMENSION + 1, len(languages))), 1.0)
    at = F.pmod(F.xxhash64(F.lit("sample"), "x", "t"), F.lit(1_000_000))
    share = {r["l"]: min(1_000_000, int(1_000_000 * 1.2 * per_language / r["count"]) + 1) for r in sizes}
    limit = F.lit(0)
    for language, s in share.items():
        limit = F.when(F.col("l") == language, F.lit(s)).otherwise(limit)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for place, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts = ngram_counts(text)
                if counts is not None:
                    index, value = model.features(counts)
                    rows.append((place, label, index.astype("<i4").tobytes(), value.astype("<f4").tobytes()))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                names=["place", "label", "i", "v"],
            )

    sample = known.withColumn("at", at).where(F.col("at") < limit).select("at", "l", "t")
    sample = sample.mapInArrow(featurise, "place long, label string, i binary, v binary").collect()
    number = {s: k for k, s in enumerate(languages)}
    taken, data, back = dict.fromkeys(languages, 0), [], []
    for r in sorted(sample, key=lambda r: (r["place"], r["i"])):
        if taken[r["label"]] >= per_language:
            continue
        taken[r["label"]] += 1
        row = (np.frombuffer(r["i"], dtype="<i4"), np.frombuffer(r["v"], dtype="<f4").astype(np.float64), number[r["label"]])
        (back if taken[r["label"]] % 5 == 0 else data).append(row)
    model.weights = follow_leader(data, len(languages))
    logits = np.array([v[:-1] @ model.weights[i] + model.weights[-1] for i, v, _ in back])
    model.temperature = _temperature(logits, np.array([c for *_, c in back]))
    model.weights = model.weights.astype(np.float32)
    return model


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; only the text is read.

    NULL texts and texts without a letter are ``und`` with score 0, as is everything if no language was learned. Equal texts
    get equal results; the score is the calibrated probability of the predicted language.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
            ], names=["doc_id", "lang_pred", "score"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"doc_id {id_type}, lang_pred string, score double")
