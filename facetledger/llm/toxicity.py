"""Toxic spans and document scores from a linear-chain conditional random field.

Labels are per document, so tokens are labelled first: in a document marked toxic a token is toxic if one of its features
(the word, or its first bytes) is far commoner in toxic than in other documents; all other tokens are clean. A two-state
chain over sentences is fitted to those tokens. For every document, forward-backward marginals give the probability of
each token, spans where it is at least one half, and a document score calibrated on sampled documents that the chain was
not fitted on. Fitting takes a bounded sample (``per_label`` rows of each label, and
no more after ``per_label * limit_bytes`` bytes; longer texts only where texts of up to ``limit_bytes`` are too few).

Defined results: a text without words is scored like any document in which no token is toxic; without labelled rows every
score is 0; a document with several labels counts as toxic if one of them is; repeated rows get equal results; extra
columns are kept unless they are named like the operator's own. Offsets are bytes of the UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetledger.llm.sample import remainder, sample_ids, with_texts
from facetledger.llm.text import ALNUM, buffer_of, byte_class, find_words, mix, slices

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)
PER_LABEL = 1200
LIMIT_BYTES = 32 << 10
THRESHOLD = 0.7
BREAKS = byte_class((0x0A, 0x0A), (0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))  # line end ! . ?
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("probability", T.DoubleType())])
OWN = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", T.ArrayType(SPAN))])


@dataclass
class Tokens:
    """Feature buckets (one column a feature), sentence and text of each token, and its bytes in the joint buffer."""

    features: np.ndarray
    sentence: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    words = find_words(data, offsets, ALNUM)
    n = len(words.hashes)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    padded = np.concatenate((low, np.zeros(8, np.uint8)))
    lengths = words.ends - words.starts
    head = np.zeros(n, np.uint64)
    columns = [words.hashes]
    for k in range(max(PREFIXES)):
        head |= np.where(k < lengths, padded[words.starts + k], 0).astype(np.uint64) << np.uint64(8 * k)
        if k + 1 in PREFIXES:
            columns.append(mix(head ^ np.uint64((k + 1) << 56)))
    features = np.stack([(c >> np.uint64(46)).astype(np.int32) for c in columns], 1)
    breaks = np.concatenate(([0], np.cumsum(BREAKS[data])))[words.starts] if n else np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = breaks[1:] != breaks[:-1]
    new[words.first[(words.first > 0) & (words.first < n)]] = True
    return Tokens(features, np.cumsum(new) - 1, words.first, words.starts, words.ends)


@dataclass
class Chain:
    """Weights of the toxic state against the clean one by feature, and of the four transitions and two starts."""

    weights: np.ndarray
    transitions: np.ndarray
    starts: np.ndarray
    score_weights: np.ndarray | None = None

    def marginals(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Probability of the toxic state for each token, sums of pair probabilities by transition, of starts by state,
        and the log of the partition function, over all sentences."""
        n = len(tokens.sentence)
        if not n:
            return np.zeros(0), np.zeros((2, 2)), np.zeros(2), 0.0
        emission = np.exp(np.clip(self.weights[tokens.features].sum(1, dtype=np.float64), -30, 30))
        first = np.flatnonzero(np.concatenate(([True], tokens.sentence[1:] != tokens.sentence[:-1])))
        lengths = np.diff(np.concatenate((first, [n])))
        order = np.argsort(-lengths, kind="stable")
        first, lengths = first[order], lengths[order]
        move, start = np.exp(self.transitions), np.exp(self.starts)
        alpha, beta, scale = np.empty((n, 2)), np.ones((n, 2)), np.empty(n)
        live = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")  # sentences longer than each step
        for t in range(int(lengths[0])):
            at = first[: live[t]] + t
            if t == 0:
                clean, toxic = np.full(len(at), start[0]), start[1] * emission[at]
            else:
                a = alpha[at - 1]
                clean = a[:, 0] * move[0, 0] + a[:, 1] * move[1, 0]
                toxic = (a[:, 0] * move[0, 1] + a[:, 1] * move[1, 1]) * emission[at]
            total = clean + toxic
            scale[at], alpha[at, 0], alpha[at, 1] = total, clean / total, toxic / total
        for t in range(int(lengths[0]) - 2, -1, -1):
            at = first[: live[t + 1]] + t
            b, e, s = beta[at + 1], emission[at + 1], scale[at + 1]
            beta[at, 0] = (move[0, 0] * b[:, 0] + move[0, 1] * e * b[:, 1]) / s
            beta[at, 1] = (move[1, 0] * b[:, 0] + move[1, 1] * e * b[:, 1]) / s
        posterior = alpha * beta
        posterior /= posterior.sum(1, keepdims=True)
        pairs = np.zeros((2, 2))
        inner = np.flatnonzero(tokens.sentence[1:] == tokens.sentence[:-1])
        if len(inner):
            after = np.stack((beta[inner + 1, 0], beta[inner + 1, 1] * emission[inner + 1]), 1) / scale[inner + 1][:, None]
            pairs = move * (alpha[inner].T @ after)
        return posterior[:, 1], pairs, posterior[first].sum(0), float(np.log(scale).sum())

    def document_features(self, tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
        """For each text: a constant, the log-odds of its likeliest token, the log of the expected number of toxic tokens."""
        texts = len(tokens.first) - 1
        most, expected = np.full(texts, 1e-4), np.zeros(texts)
        some = np.flatnonzero(np.diff(tokens.first))
        if len(some):
            most[some] = np.clip(np.maximum.reduceat(toxic, tokens.first[some]), 1e-4, 1 - 1e-4)
            expected[some] = np.add.reduceat(np.where(toxic > 1e-3, toxic, 0), tokens.first[some])
        return np.stack((np.ones(texts), np.log(most / (1 - most)), np.log1p(expected)), 1)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.score_weights, -30, 30)))


def token_labels(tokens: Tokens, toxic: np.ndarray, certainty: float = 15.0, odds: float = 2.5) -> np.ndarray:
    """Which tokens of toxic texts are labelled toxic: those with a feature whose log-odds over the sampled texts are at
    least ``odds`` and too many to be chance (likelihood-ratio statistic of ``certainty`` at least). A feature counts once
    for each pair of words around it, so that copies of a text don't make its words suspect."""
    texts = tokens.text_of()
    word = tokens.features[:, 0].astype(np.uint64)
    around = np.concatenate(([0], word, [0])).astype(np.uint64)
    context = mix((around[:-2] << np.uint64(20)) ^ around[2:]) & ~np.uint64(BUCKETS - 1)
    seen, total = np.zeros((2, BUCKETS)), np.zeros(2)
    for label in (0, 1):
        own = toxic[texts] == label
        total[label] = len(np.unique(context[own] | word[own]))
        for column in tokens.features[own].T:
            places = np.unique(context[own] | column.astype(np.uint64)) & np.uint64(BUCKETS - 1)
            seen[label] += np.bincount(places.astype(np.int64), minlength=BUCKETS)
    ratio = np.log((seen[1] + 0.1) / (total[1] + 1)) - np.log((seen[0] + 0.1) / (total[0] + 1))
    both, share = seen.sum(0), total[1] / max(1, total.sum())
    surprise = 2 * sum(x * np.log(np.maximum(x, 1) / np.maximum(both * q, 1e-9)) for x, q in ((seen[1], share), (seen[0], 1 - share)))
    marked = (ratio > odds) & (surprise > certainty)
    return marked[tokens.features].any(1) & (toxic[texts] == 1)


def fit_chain(tokens: Tokens, labels: np.ndarray, rounds: int = 30, rate: float = 0.5, penalty: float = 1e-4) -> Chain:
    """Adaptive gradient ascent on the log-likelihood of the token labels."""
    y = labels.astype(np.int64)
    inner = tokens.sentence[1:] == tokens.sentence[:-1]
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[:-1][inner], y[1:][inner]), 1)
    first = np.concatenate(([True], ~inner))
    starts = np.bincount(y[first], minlength=2).astype(float)
    base = np.log((y.sum() + 1) / (len(y) + 2))
    used, column = np.unique(tokens.features, return_inverse=True)
    column = column.reshape(tokens.features.shape)
    wanted = np.bincount(column[labels].ravel(), minlength=len(used))
    weights = np.zeros(BUCKETS)
    chain = Chain(weights, np.log((pairs + 1) / (pairs + 1).sum(1, keepdims=True)), np.array([0.0, base]))
    weights[used] = -0.5
    squares = [np.full(len(used), 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)]
    for _ in range(rounds):
        p, pair_sums, start_sums, _ = chain.marginals(tokens)
        expected = np.bincount(column.ravel(), np.repeat(p, column.shape[1]), minlength=len(used))
        steps = [wanted - expected - penalty * len(y) * weights[used] / 100, pairs - pair_sums, starts - start_sums]
        for square, step in zip(squares, steps, strict=True):
            square += step * step
        weights[used] += rate * steps[0] / np.sqrt(squares[0])
        chain.transitions = chain.transitions + rate * 0.2 * steps[1] / np.sqrt(squares[1])
        chain.starts = chain.starts + rate * 0.2 * steps[2] / np.sqrt(squares[2])
    return chain


def fit_scores(features: np.ndarray, toxic: np.ndarray, rounds: int = 50, penalty: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton's method with an l2 penalty; a likelier token never lowers the score."""
    w = np.zeros(features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (toxic - p) - penalty * w
        hessian = (features * (p * (1 - p))[:, None]).T @ features + penalty * np.eye(len(w))
        w = w + np.linalg.solve(hessian, gradient)
    w[1:] = np.maximum(w[1:], 0)
    return w


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, limit_bytes: int = LIMIT_BYTES) -> Chain | None:
    """Learns from labelled documents whose remainder by 3 is not 1: the chain from those with remainder 0, the score
    from those with remainder 2 (from all of them if one part lacks a label). None without labelled documents."""
    part = remainder(3)
    known = labels.select("doc_id", "toxic").where((part != 1) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = None
    for k in (0, 2):
        some = sample_ids(docs, known.where(part == k), "toxic", per_label, limit_bytes).withColumn("part", F.lit(k))
        ids = some if ids is None else ids.unionByName(some)
    rows = sorted(with_texts(docs, ids).select("doc_id", "part", "toxic", "text").collect())
    if not rows:
        return None

    def tokens_and_labels(chosen: list) -> tuple[Tokens, np.ndarray]:
        return tokens_of(*buffer_of(pa.array([r.text for r in chosen], pa.string()))), np.array([int(r.toxic) for r in chosen])

    both = lambda chosen: len({r.toxic for r in chosen}) == 2
    parts = [[r for r in rows if r.part == k] for k in (0, 2)]
    parts = [p if both(p) else rows for p in parts]
    tokens, toxic = tokens_and_labels(parts[0])
    chain = fit_chain(tokens, token_labels(tokens, toxic))
    tokens, toxic = tokens_and_labels(parts[1])
    chain.score_weights = fit_scores(chain.document_features(tokens, chain.marginals(tokens)[0]), toxic)
    chain.weights = chain.weights.astype(np.float32)
    return chain


def spans_of(tokens: Tokens, toxic: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[dict]]:
    """Runs of tokens of a sentence that are toxic with probability one half at least: text of each, and its span."""
    at = np.flatnonzero(toxic >= 0.5)
    if not len(at):
        return at, []
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (tokens.sentence[at[1:]] != tokens.sentence[at[:-1]])
    begin = np.flatnonzero(new)
    last = at[np.append(begin[1:], len(at)) - 1]
    text = np.searchsorted(tokens.first, at[begin], "right") - 1
    most = np.maximum.reduceat(toxic[at], begin)
    rows = zip((tokens.starts[at[begin]] - offsets[text]).tolist(), (tokens.ends[last] - offsets[text]).tolist(), most.tolist(), strict=True)
    return text, [dict(zip(SPAN.fieldNames(), r, strict=True)) for r in rows]


def _scorer(shared, names: list[str], schema: pa.Schema, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            for part in slices(batch):
                data, offsets = buffer_of(part.column("text"))
                spans: list[list] = [[] for _ in range(part.num_rows)]
                scores = np.zeros(part.num_rows)
                if chain is not None:
                    tokens = tokens_of(data, offsets)
                    toxic = chain.marginals(tokens)[0]
                    scores = chain.scores(chain.document_features(tokens, toxic))
                    for text, span in zip(*spans_of(tokens, toxic, offsets), strict=True):
                        spans[text].append(span)
                own = [pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(spans, schema.field("spans").type)]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + own, names=schema.names)

    return run


def score(docs: DataFrame, chain: Chain | None, threshold: float = THRESHOLD, columns: list[str] | None = None) -> DataFrame:
    """Documents with ``score``, ``predicted`` (1 from ``threshold`` on) and the offending ``spans``, from the text alone."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [c for c in (columns or docs.columns) if c not in OWN.fieldNames()]
    schema = T.StructType([f for f in docs.schema.fields if f.name in names] + OWN.fields)
    names = [f.name for f in schema.fields if f.name in names]
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    read = docs.select(*names, *([] if "text" in names else ["text"]))
    return read.mapInArrow(_scorer(shared, names, to_arrow_schema(schema), threshold), schema)
