"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals give document scores.

Labels are of documents. Words are labelled from them: a word of a toxic document is toxic if it, or one of its prefixes, occurs
in toxic documents far more often than in clean ones. A two-state chain is trained on these words; its
emission weights are on hashed features of the lower-cased word, so prefixes carry over to words never seen.
Forward-backward marginals of all words of a text are summed up, and a logistic curve, fitted on labelled documents that the chain
was not trained on, turns the sum and the largest marginal into the score.

Training takes place in one task on a bounded sample of labelled rows; scoring has no shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm import words
from llm.session import ready

#: Labelled documents of each class, and words of all of them, that training uses at most.
SAMPLE_ROWS = 3_000
SAMPLE_WORDS = 1_500_000
#: A text with more than SAMPLE_WORDS / LONG_TEXT words is scored, but not learned from; of a class that has only such texts a piece of each is.
LONG_TEXT = 50
FEATURE_BITS = 18
PREFIXES = (4, 5, 6)
#: A feature marks words of toxic documents if its log odds, and the excess of its toxic contexts over chance in deviations, reach these.
LEAST_LOG_ODDS = 2.0
LEAST_DEVIATIONS = 5.0
STEPS = 25
#: Words of a segment of the chain: segments are multiplied out side by side.
SEGMENT = 64
#: Words whose marginals are formed at once, about; only a single longer text exceeds it.
BLOCK_WORDS = 1 << 17
#: Parts in which features are counted.
LABEL_PARTS = 8

_U = np.uint64


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features (words x features), first word of each text, start and end byte of each word."""
    low = words.lowered(data)
    starts, ends, first = words.find_words(low, bounds, words.PUNCTUATION)
    columns = [words.hash_spans(low, starts, ends)]
    columns += [words.mix(words.hash_spans(low, starts, np.minimum(starts + n, ends)) + _U(n)) for n in PREFIXES]
    return np.stack([(c >> _U(64 - FEATURE_BITS)).astype(np.uint32) for c in columns], axis=1), first, starts, ends


def blocks(first: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """The words of whole texts, and the first word of each of them, in blocks; every word is in one block."""
    cuts = np.searchsorted(first, np.arange(0, first[-1] + BLOCK_WORDS, BLOCK_WORDS)).clip(max=len(first) - 1)
    for s, e in zip(cuts[:-1], cuts[1:]):
        if first[s] < first[e]:
            yield slice(first[s], first[e]), first[s:e + 1] - first[s]


@dataclass
class Chain:
    """Emission weights of state 1 (state 0 has none), their bias, and log transition weights."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray

    def emissions(self, found: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(sum(self.weights[column] for column in found.T) + self.bias, -30, 30))

    def passes(self, emission: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward vectors of every word (each scaled to sum 1).

        Texts are cut into segments. The products of all segments are formed side by side, then carried along each text, then
        spread inside the segments; so the number of steps is a segment's length plus the longest text's segments.
        """
        count = np.diff(first)
        pieces = -(-count // SEGMENT)
        begin = np.concatenate([[0], np.cumsum(pieces)])
        text = np.repeat(np.arange(len(count)), pieces)
        start = first[text] + SEGMENT * (np.arange(len(text)) - begin[text])
        at = start[:, None] + np.arange(SEGMENT)
        inside = at < first[text + 1][:, None]
        e = np.ones((*at.shape, 2))
        e[..., 1] = np.where(inside, emission[np.minimum(at, max(0, len(emission) - 1))], 1.0) if len(emission) else 1.0
        move, stay = np.exp(self.moves), np.eye(2)
        step = lambda k: np.where(inside[:, k, None, None], move[None] * e[:, k, None, :], stay[None])
        product = np.broadcast_to(stay, (len(text), 2, 2)).copy()
        for k in range(SEGMENT):
            product = product @ step(k)
            product /= product.sum(axis=(1, 2), keepdims=True)
        enter, leave = np.full((len(text), 2), 0.5), np.full((len(text), 2), 0.5)
        for k in range(1, int(pieces.max(initial=0))):
            now = begin[:-1][pieces > k] + k
            v = (enter[now - 1, None, :] @ product[now - 1])[:, 0]
            enter[now] = v / v.sum(axis=1, keepdims=True)
        for k in range(2, int(pieces.max(initial=0)) + 1):
            now = begin[1:][pieces >= k] - k
            v = (product[now + 1] @ leave[now + 1, :, None])[..., 0]
            leave[now] = v / v.sum(axis=1, keepdims=True)
        forward, backward = np.empty((*at.shape, 2)), np.empty((*at.shape, 2))
        v = enter
        for k in range(SEGMENT):
            v = (v[:, None, :] @ step(k))[:, 0]
            v /= v.sum(axis=1, keepdims=True)
            forward[:, k] = v
        v = leave
        for k in range(SEGMENT - 1, -1, -1):
            backward[:, k] = v
            v = (step(k) @ v[..., None])[..., 0]
            v /= v.sum(axis=1, keepdims=True)
        return forward[inside], backward[inside]

    def marginals(self, found: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The probability of state 1 of every word."""
        out = np.empty(len(found))
        for own, at in blocks(first):
            forward, backward = self.passes(self.emissions(found[own]), at)
            both = forward * backward
            out[own] = both[:, 1] / np.maximum(both.sum(axis=1), 1e-300)
        return out

    def slope(self, found: np.ndarray, first: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The slope of the log likelihood of the labels, in the order of ``params``.

        A text starts from either state alike: its first word has a move from a state that no label tells.
        """
        inner, opens = _inner(first), first[:-1][np.diff(first) > 0]
        emission = self.emissions(found)
        forward, backward = self.passes(emission, first)
        both = forward * backward
        gap = label - both[:, 1] / both.sum(axis=1)
        state = np.stack([np.ones(len(label)), emission], axis=1) * backward
        pair = forward[inner - 1, :, None] * np.exp(self.moves)[None] * state[inner, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        moves = np.bincount(2 * label[inner - 1] + label[inner], minlength=4) - pair.sum(axis=0).ravel()
        start = np.exp(self.moves)[None] * state[opens, None, :]
        moves = moves - (start / start.sum(axis=(1, 2), keepdims=True)).sum(axis=0).ravel()
        told = np.exp(self.moves) / np.exp(self.moves).sum(axis=0)  # where a known first state comes from
        moves += (told * np.bincount(label[opens], minlength=2)[None]).ravel()
        return np.concatenate([sum(np.bincount(column, gap, len(self.weights)) for column in found.T), [gap.sum()], moves])

    def params(self) -> np.ndarray:
        return np.concatenate([self.weights, [self.bias], self.moves.ravel()])


def _inner(first: np.ndarray) -> np.ndarray:
    """Words that follow a word of their text."""
    opens = np.zeros(first[-1], bool)
    opens[first[:-1][np.diff(first) > 0]] = True
    return np.flatnonzero(~opens)


def word_labels(found: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which words are toxic, from the documents' labels.

    A feature is counted once per word that stands before it, so that copies of a document count little more than one.
    """
    text, low = np.repeat(np.arange(len(toxic)), np.diff(first)), _U((1 << FEATURE_BITS) - 1)
    before = np.concatenate([np.zeros(1, np.uint32), found[:-1, 0]])[:len(found)]
    context = words.mix(before.astype(_U) + _U(31)) & ~low
    seen = np.zeros((2, 1 << FEATURE_BITS), np.int64)
    for y in (0, 1):
        for part in range(LABEL_PARTS):  # features in parts, which bounds the pairs held at once
            at, column = np.nonzero((found % LABEL_PARTS == part) & (toxic[text] == y)[:, None])
            pairs = np.unique(context[at] | found[at, column])
            seen[y] += np.bincount((pairs & low).astype(np.int64), minlength=1 << FEATURE_BITS)
    all_clean, all_toxic = int(seen[0].sum()), int(seen[1].sum())
    odds = np.log((seen[1] + 0.5) / (all_toxic + 1)) - np.log((seen[0] + 0.5) / (all_clean + 1))
    both, share = seen[0] + seen[1], all_toxic / (all_clean + all_toxic)
    deviations = (seen[1] - both * share) / np.sqrt(np.maximum(both, 1) * share * (1 - share))
    marks = (odds >= LEAST_LOG_ODDS) & (deviations >= LEAST_DEVIATIONS)
    return marks[found].any(axis=1) & (toxic[text] == 1)


def train_chain(found: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = STEPS) -> Chain:
    """Maximum likelihood with a small ridge, by Adam on the whole sample."""
    size = 1 << FEATURE_BITS
    rate = np.clip(label.mean(), 1e-4, 0.5)
    chain = Chain(np.zeros(size), float(np.log(rate / (1 - rate))), np.zeros((2, 2)))
    params = chain.params()
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        slope = -0.05 * params
        for own, at in blocks(first):
            slope += chain.slope(found[own], at, label[own])
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        params = params + 0.4 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        chain = Chain(params[:size], float(params[size]), params[size + 1:].reshape(2, 2))
    return chain


def summary(marginal: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: 1, log of 1 + the expected number of toxic words, the largest marginal, log of 1 + the number of words."""
    sums = np.concatenate([[0.0], np.cumsum(marginal)])
    most = np.zeros(len(first) - 1)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        most[some] = np.maximum.reduceat(marginal, first[:-1][some])
    return np.stack([np.ones(len(most)), np.log1p(np.maximum(0.0, sums[first[1:]] - sums[first[:-1]])), most, np.log1p(np.diff(first))], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 0.05 * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        change = np.linalg.solve(curve, slope)
        beta = beta + np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-8:
            break
    return beta


@dataclass
class Model:
    """A chain and a curve; without toxic or clean examples the score is ``prior``."""

    chain: Chain | None
    curve: np.ndarray | None
    prior: float

    def score(self, marginal: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary(marginal, first) @ self.curve, -30, 30)))


def _within(size: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Whether each text is learned from: a class has half of SAMPLE_WORDS and what the other leaves; single long texts are passed over."""
    short = size <= SAMPLE_WORDS // LONG_TEXT
    words_of = [int(size[short & (toxic == y)].sum()) for y in (0, 1)]
    kept = short.copy()
    for y in (0, 1):
        own = short & (toxic == y)
        kept[own] = np.cumsum(size[own]) <= SAMPLE_WORDS - min(words_of[1 - y], SAMPLE_WORDS // 2)
    return kept


def _piece(text: str) -> str:
    """As many words as a text to learn from may have, in a row from a place that follows from the text's hash."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words.find_words(data, np.array([0, len(data)]))
    most = max(1, SAMPLE_WORDS // LONG_TEXT)
    if len(starts) <= most:
        return text
    first = int(words.hash_spans(data, starts[:1], ends[-1:])[0] % _U(len(starts) - most + 1))
    return data[starts[first]:ends[first + most - 1]].tobytes().decode()


def _trained(texts: list[str], toxic: np.ndarray, shares: tuple[float, float]) -> Model:
    """``shares``: of clean and toxic among all labelled rows, which the sample doesn't keep."""
    if len(np.unique(toxic)) < 2:
        return Model(None, None, shares[1])
    def sizes() -> np.ndarray:
        return np.concatenate([np.diff(words.find_words(data, bounds)[2]) for _, _, data, bounds in words.slices(pa.array(texts, pa.string()))])

    kept = _within(sizes(), toxic)
    if len(np.unique(toxic[kept])) < 2:  # a class of long texts only
        texts = [_piece(x) if toxic[i] not in toxic[kept] else x for i, x in enumerate(texts)]
        kept = _within(sizes(), toxic)
    texts, toxic = [x for x, k in zip(texts, kept) if k], toxic[kept]
    found, first = [], [np.zeros(1, np.int64)]
    for _, _, data, bounds in words.slices(pa.array(texts, pa.string())):
        f, own, _, _ = features(data, bounds)
        found.append(f)
        first.append(own[1:] + first[-1][-1])
    found, first = np.concatenate(found), np.concatenate(first)
    text = np.repeat(np.arange(len(toxic)), np.diff(first))
    order = np.zeros(len(toxic), int)
    for y in (0, 1):  # two thirds of each class for the chain
        order[toxic == y] = np.arange((toxic == y).sum())
    fold = order % 3 > 0 if min((toxic == 0).sum(), (toxic == 1).sum()) >= 9 else np.ones(len(toxic), bool)

    def part(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return found[keep[text]], np.concatenate([[0], np.cumsum(np.diff(first)[keep])]), toxic[keep]

    f, at, y = part(fold)
    label = word_labels(f, at, y).astype(np.int64)
    if not label.any():
        return Model(None, None, shares[1])
    chain = train_chain(f, at, label)
    f, at, y = part(~fold) if not fold.all() else (f, at, y)
    weight = np.where(y == 1, shares[1] / max(1, (y == 1).sum()), shares[0] / max(1, (y == 0).sum())) * len(y)
    return Model(chain, fit_curve(summary(chain.marginals(f, at), at), y.astype(float), weight), shares[1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", seed: int = 11,
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the labelled rows; nulls are passed over, of repeated labels the largest counts.

    The sample holds ``sample_rows`` documents of each class, the first by a seeded hash of the key; of rows with one key the least
    text. If every sampled text of a class is longer than what is learned from, a piece of each of them is, from a place that follows
    from its hash. Without rows of both classes, or without words that tell them apart, every score is the share of toxic labels.
    """
    spark = ready(docs.sparkSession)
    one = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("toxic"))
    total = {r.toxic: r["count"] for r in one.groupBy("toxic").count().collect()}
    share = total.get(1, 0) / max(1, sum(total.values()))
    sample = None
    for y in (0, 1):
        rows = one.where(F.col("toxic") == y).withColumn("draw", F.xxhash64(F.lit(seed), "key")).orderBy("draw", "key").limit(sample_rows)
        sample = rows if sample is None else sample.unionByName(rows)
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(sample), "key") \
        .groupBy("key").agg(F.first("toxic").alias("toxic"), F.first("draw").alias("draw"), F.min("text").alias("text"))  # one row of a key

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "key", "text"])
        return pd.DataFrame({"model": [pickle.dumps(_trained(pdf["text"].tolist(), pdf["toxic"].to_numpy(), (1 - share, share)))]})

    found = texts.withColumn("task", F.lit(0)).groupBy("task").applyInPandas(train, "model binary").first()
    return pickle.loads(bytes(found.model)) if found else Model(None, None, share)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, expected, spans) of every row: spans are runs of words with a marginal of 0.5 or more.

    ``spans`` has start and end (exclusive) in code points; ``expected`` is the expected number of toxic words. A null or empty
    text has no words and gets the score of zero toxic words. Null keys and repeated rows stay. Other columns are not used.
    """
    shipped = ready(docs.sparkSession).sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            for at, end, data, bounds in words.slices(batch.column(1)):
                n = end - at
                value, expected, spans = np.full(n, model.prior), np.zeros(n), pa.nulls(n, _SPANS)
                if model.chain is not None:
                    found, first, starts, ends = features(data, bounds)
                    marginal = model.chain.marginals(found, first)
                    value = model.score(marginal, first)
                    expected = np.expm1(summary(marginal, first)[:, 1])
                    spans = _spans(data, bounds, marginal >= 0.5, first, starts, ends)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(value), pa.array(expected), spans], ["key", "score", "expected", "spans"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType()),
                           T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(scored, schema).withColumnRenamed("key", key)


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, all columns as they are; no shuffle.

    Null, empty and blank texts have the score of zero words, as in ``score``, and are judged by it. Repeated rows are judged alike; null
    keys and columns of any name stay. An empty table gives an empty result.
    """
    shipped = ready(docs.sparkSession).sparkContext.broadcast(model)
    at_text = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            for at, end, data, bounds in words.slices(batch.column(at_text)):
                if model.chain is None:
                    value = np.full(end - at, model.prior)
                else:
                    found, first, _, _ = features(data, bounds)
                    value = model.score(model.chain.marginals(found, first), first)
                yield batch.slice(at, end - at).filter(pa.array(value < threshold))

    return docs.mapInArrow(clean, docs.schema)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _spans(data: np.ndarray, bounds: np.ndarray, hit: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    opens = hit.copy()
    opens[1:] &= ~hit[:-1]
    edge = first[:-1][np.diff(first) > 0]
    opens[edge] = hit[edge]
    begin = np.flatnonzero(opens)
    stop = np.append(begin[1:], len(hit))
    runs = np.concatenate([[0], np.cumsum(hit)])
    last = begin + (runs[stop] - runs[begin]) - 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text = np.searchsorted(first, begin, "right") - 1
    base = points[bounds[text]]
    fields = [pa.array((points[x] - base).astype(np.int32)) for x in (starts[begin], ends[last])]
    offsets = np.searchsorted(begin, first).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "end"]))
