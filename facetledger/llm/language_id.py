"""Language of whole texts: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training documents. The weights are fitted by follow-the-regularised-leader
with elastic-net penalties on a bounded sample of each language (``per_language`` rows, and no more after
``per_language * limit_bytes`` bytes; longer texts only where texts of up to ``limit_bytes`` are too few), which leaves most weights at zero; a temperature fitted on other sampled rows calibrates the scores. The languages are a closed
set, so the model is a table of n-gram buckets by languages that every task gets.

Defined results: ``und`` with score 0 if a text is null or has no letter, or if no language was learned; ties go to the
first language by name; repeated rows get equal results; a null id is never learned from and not held out; extra columns
are kept unless they are named like the operator's own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetledger.llm.sample import remainder, sample_ids, with_texts
from facetledger.llm.text import slices

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
PER_LANGUAGE = 600
SLICE = 1 << 20  # bytes of text whose n-grams are held at a time
LIMIT_BYTES = 64 << 10
MIN_SCORE = 0.5
OWN = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The code point of each letter or mark, and a space for all else; beyond the basic plane all count as one letter."""
    return np.array([i if unicodedata.category(chr(i))[0] in "LM" else 32 for i in range(1 << 16)], np.uint32)


def gram_buckets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each size the bucket of the n-gram at each character, and where each text begins. A text is lower-cased and
    put between spaces, other characters than letters become spaces; bucket ``BUCKETS`` takes what has a run of spaces."""
    padded = [f" {t.lower()} " for t in texts]
    first = np.concatenate(([0], np.cumsum([len(t) for t in padded])))
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = _letters()[np.minimum(codes, 0xFFFF)]
    space = codes == 32
    value, empty, out = np.zeros(len(codes), np.uint32), space.copy(), []
    for size in range(1, max(SIZES) + 1):
        shifted = np.zeros(len(codes), np.uint32)
        shifted[: len(codes) - size + 1] = codes[size - 1 :]
        value = (value + shifted) * np.uint32(0x9E3779B1)
        value ^= value >> np.uint32(15)
        if size > 1:
            empty[: len(codes) - size + 1] |= space[size - 2 : len(codes) - 1] & space[size - 1 :]
        if size in SIZES:
            bucket = ((value * np.uint32(0x85EBCA6B)) >> np.uint32(17)).astype(np.uint16)
            bucket[empty] = BUCKETS
            out.append(bucket)
    return out, first


def gram_counts(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text how often each bucket occurs."""
    buckets, first = gram_buckets(texts)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        joint = np.concatenate([x[a : max(a, b - n + 1)] for n, x in zip(SIZES, buckets, strict=True)])
        yield np.bincount(joint, minlength=BUCKETS + 1)[:BUCKETS]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets by languages
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        x = counts * self.idf
        norm = np.sqrt(np.dot(x, x))
        return (x @ self.weights) / norm + self.bias if norm else self.bias.copy()

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        p = softmax(self.logits(counts).astype(np.float64) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs. Each task adds up its own texts; at most one row a bucket and task moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                for counts in gram_counts([t or "" for t in part.column("text").to_pylist()]):
                    seen[:BUCKETS] += counts > 0
                    seen[BUCKETS] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in rows:
        found[bucket] = n
    return found[:BUCKETS], int(found[BUCKETS])


def fit_weights(rows: list[tuple[np.ndarray, np.ndarray, int]], n_labels: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader over sparse rows (places, values, label): each coordinate has its own rate, the l1
    penalty keeps a weight at zero until its gradients add up to more."""
    z, n = np.zeros((BUCKETS + 1, n_labels)), np.zeros((BUCKETS + 1, n_labels))

    def weight(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, label = rows[k]
            w = weight(at)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weight(np.arange(BUCKETS + 1))
    return w[:BUCKETS], w[BUCKETS]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, between 1/50 and 50, by golden sections of its logarithm. A small penalty
    on the logarithm keeps it finite when every row is told right."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-300).mean() + 0.01 * t * t
    low, high, ratio = -np.log(50), np.log(50), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, limit_bytes: int = LIMIT_BYTES) -> Model | None:
    """Learns from text and non-null lang of the documents whose remainder by 4 is not 2; those with remainder 3 calibrate
    (and teach a language that has no others). None if there is no such document."""
    learned = docs.where((remainder(4) != 2) & F.col("lang").isNotNull())
    ids = sample_ids(learned, learned, "lang", per_language, limit_bytes)
    sample = with_texts(learned, ids).select("doc_id", "lang", "text", remainder(4).alias("part"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                found = list(gram_counts(part.column("text").to_pylist()))
                at = [np.flatnonzero(c) for c in found]
                arrays = [pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([c[a].astype("<u4").tobytes() for c, a in zip(found, at, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("part"), *arrays], names=["doc_id", "lang", "part", "places", "counts"])

    rows = sorted(sample.mapInArrow(grams, "doc_id long, lang string, part long, places binary, counts binary").collect())
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    seen, total = document_frequencies(learned)
    idf = np.where(seen > 0, np.log((1 + total) / (1 + seen)) + 1, 0.0)
    vectors = []
    for r in rows:
        at = np.frombuffer(r.places, "<u2").astype(np.int64)
        x = np.frombuffer(r.counts, "<u4") * idf[at]
        norm = np.sqrt(np.dot(x, x)) or 1.0
        vectors.append((np.append(at, BUCKETS), np.append(x / norm, 1.0), languages.index(r.lang)))
    taught = {r.lang for r in rows if r.part != 3}
    fitted = [v for v, r in zip(vectors, rows, strict=True) if r.part != 3 or r.lang not in taught]
    weights, bias = fit_weights(fitted, len(languages))
    model = Model(languages, idf.astype(np.float32), weights.astype(np.float32), bias.astype(np.float32))
    held = [v for v, r in zip(vectors, rows, strict=True) if r.part == 3]
    logits = np.array([x[:-1] @ weights[at[:-1]] + bias for at, x, _ in held]).reshape(len(held), len(languages))
    model.temperature = fit_temperature(logits, np.array([v[2] for v in held], int))
    return model


def _predictor(shared, names: list[str], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                lettered = part.column("_lettered").to_pylist()
                texts = [t if has and model else "" for t, has in zip(part.column("text").to_pylist(), lettered, strict=True)]
                found = [model.predict(c) if t else ("und", 0.0) for t, c in zip(texts, gram_counts(texts), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in names] + [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=schema.names,
                )

    return run


def predict(docs: DataFrame, model: Model | None, columns: list[str] | None = None) -> DataFrame:
    """Documents with ``lang_pred`` and ``score``, the calibrated probability of that language, from the text alone."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [c for c in (columns or docs.columns) if c not in {*OWN.fieldNames(), "_lettered"}]
    schema = T.StructType([f for f in docs.schema.fields if f.name in names] + OWN.fields)
    names = [f.name for f in schema.fields if f.name in names]
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    read = docs.select(*names, *([] if "text" in names else ["text"]), lettered.alias("_lettered"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return read.mapInArrow(_predictor(shared, names, to_arrow_schema(schema)), schema)


def keep_identified(docs: DataFrame, model: Model | None, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language the model tells with a score of ``min_score`` at least, with their own columns."""
    own = [c for c in docs.columns if c in OWN.fieldNames()]
    hidden = docs.withColumnsRenamed({c: f"_own_{c}" for c in own})
    kept = predict(hidden, model).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).drop(*OWN.fieldNames())
    return kept.withColumnsRenamed({f"_own_{c}": c for c in own}).select(*docs.columns)
