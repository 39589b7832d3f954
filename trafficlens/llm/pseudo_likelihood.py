"""Masked pseudo-likelihood of documents under a two-sided window network, in numpy.

Tokens are lower-cased words: the most frequent of the whole corpus have their own number,
others share buckets by hash.  The network sees two tokens to each side of a masked one, a
vector for each place and token; their sum through tanh gives the hidden state, and a
softmax over classes times one over the class' members the probability of the masked token.
Classes, members and buckets grow as the fourth root of the distinct words.

A word of a bucket has the bucket's probability times its own within the bucket, from the
counts of all words: n of the bucket's N + (T + 1) / 2, where T distinct words were counted;
one never counted has 1/2 of that, so unseen words share (T + 1) / 2.  Counts of the most frequent
:data:`HELD_TABLE` words are at hand where documents are scored; those of others are joined.
A document's score is the sum of the log probabilities of all its words.

Counting and training cover every part of the corpus and grow with it: word counts are of all
documents, and in each round every task trains a copy of the network on those of its
documents whose hash falls in the round's share (one in ``share``); there are at least as many
rounds as shares, so every document is trained on.  Copies are averaged, weighted by their
tokens, chunk by chunk in Spark.

Edge cases: null and empty texts have no tokens, a sum of 0 and a null mean; places beyond
either end are a token of their own; with no words at all the network stays as it began;
repeated rows score alike; columns named like the operator's own are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import byte_sizes, materialize, slices

SIDE, HIDDEN, CLASSES, MEMBERS, BUCKETS = 2, 16, 32, 32, 64
VOCAB = CLASSES * MEMBERS  # the least
PLACES = [k for k in range(-SIDE, SIDE + 1) if k]
BATCH, HELD_WORDS, HELD_TABLE, CHUNKS = 8192, 1 << 22, 1 << 20, 64
NEAR = 80  # exponentials of scores no further from 0 than this, and their sums, are floats
FIXED = 1 << 32  # logarithms are added as whole numbers, so that their order is nothing


@dataclass
class Network:
    inputs: np.ndarray  # places, tokens and one for beyond the ends, hidden
    bias: np.ndarray
    by_class: np.ndarray
    class_bias: np.ndarray
    by_member: np.ndarray
    member_bias: np.ndarray

    @classmethod
    def fresh(cls, classes: int = CLASSES, members: int = MEMBERS) -> Network:
        rng = np.random.default_rng(7)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, dtype=np.float32)
        return cls(draw(len(PLACES), classes * members + 1, HIDDEN), zero(HIDDEN), draw(HIDDEN, classes), zero(classes), draw(classes, HIDDEN, members), zero(classes, members))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in vars(self).values()])

    @classmethod
    def of(cls, flat: np.ndarray, classes: int = CLASSES, members: int = MEMBERS) -> Network:
        like, out, at = cls.fresh(classes, members), [], 0
        for x in vars(like).values():
            out.append(flat[at : at + x.size].astype(np.float32).reshape(x.shape).copy())
            at += x.size
        return cls(*out)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = np.tile(self.bias, (len(context), 1))
        for k in range(len(PLACES)):
            h += self.inputs[k, context[:, k]]
        return np.tanh(h)

    def near(self) -> tuple[bool, list[bool]]:
        """Whether no score of a class, and none of each class' members, can pass :data:`NEAR`: hidden values are within 1."""
        members = np.abs(self.by_member).sum(1) + np.abs(self.member_bias)
        return bool((np.abs(self.by_class).sum(0) + np.abs(self.class_bias)).max() < NEAR), (members.max(1) < NEAR).tolist()

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        members = self.member_bias.shape[1]
        order = np.argsort((target // members).astype(np.uint16), kind="stable")  # so that a class' rows are a slice
        h, cls, member = self.hidden(context[order]), target[order] // members, target[order] % members
        near, near_in = self.near()
        score = h @ self.by_class + self.class_bias
        own = score[np.arange(len(cls)), cls]
        held = own - _log_total(score, near)
        for c, a, b in _slices(cls):
            score = h[a:b] @ self.by_member[c] + self.member_bias[c]
            own = score[np.arange(b - a), member[a:b]]
            held[a:b] += own - _log_total(score, near_in[c])
        out = np.empty_like(held)
        out[order] = held
        return out

    def gradients(self, context: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log probability, in the order of the fields."""
        n, members = len(target), self.member_bias.shape[1]
        order = np.argsort((target // members).astype(np.uint16), kind="stable")
        context, target = context[order], target[order]
        h, cls, member = self.hidden(context), target // members, target % members
        near, near_in = self.near()
        d = _softmax(h @ self.by_class + self.class_bias, near)
        d[np.arange(n), cls] -= 1
        d /= n
        by_member, member_bias = np.zeros_like(self.by_member), np.zeros_like(self.member_bias)
        back = d @ self.by_class.T
        for c, a, b in _slices(cls):
            e = _softmax(h[a:b] @ self.by_member[c] + self.member_bias[c], near_in[c])
            e[np.arange(b - a), member[a:b]] -= 1
            e /= n
            by_member[c], member_bias[c] = h[a:b].T @ e, e.sum(0)
            back[a:b] += e @ self.by_member[c].T
        back *= 1 - h * h
        inputs = np.zeros_like(self.inputs)
        small = np.uint16 if inputs.shape[1] < 1 << 16 else np.int64  # the narrow ones are sorted by radix
        for k in range(len(PLACES)):
            order = np.argsort(context[:, k].astype(small), kind="stable")
            keys = context[order, k]
            starts = _starts(keys)
            inputs[k, keys[starts]] = np.add.reduceat(back[order], starts, axis=0)
        return [inputs, back.sum(0), h.T @ d, d.sum(0), by_member, member_bias]


def _softmax(x: np.ndarray, near: bool) -> np.ndarray:
    if not near:
        x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def _log_total(x: np.ndarray, near: bool) -> np.ndarray:
    """The logarithm of the sum of each row's exponentials; ``x`` is used up."""
    if near:
        return np.log(np.exp(x, out=x).sum(1))
    top = x.max(1)
    x -= top[:, None]
    np.exp(x, out=x)
    return top + np.log(x.sum(1))


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of sorted keys start."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _slices(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of each run of sorted keys."""
    starts = _starts(keys)
    yield from zip(keys[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=False)


def descend(net: Network, batches: Iterator[tuple[np.ndarray, np.ndarray]], rate: float = 0.15) -> int:
    """Adagrad over (context, target) batches, in place; the number of targets."""
    fields, squares, seen = list(vars(net).values()), None, 0
    for context, target in batches:
        grads = net.gradients(context, target)
        squares = squares or [np.full_like(g, 1e-6) for g in grads]
        for x, g, s in zip(fields, grads, squares, strict=True):
            s += g * g
            x -= rate * g / np.sqrt(s)
        seen += len(target)
    return seen


def sides(distinct: int) -> int:
    """Classes, and members of each, for a corpus of so many distinct words."""
    return max(CLASSES, math.ceil(1.6 * distinct**0.25))


class Numbering:
    """Word hashes to token numbers: own numbers by frequency, then buckets."""

    def __init__(self, frequent: np.ndarray, side: int = CLASSES) -> None:
        self.order = np.argsort(frequent)
        self.sorted = frequent[self.order]
        self.side, self.beyond, self.buckets = side, side * side, BUCKETS * side // CLASSES
        self.shift = self.beyond - self.buckets

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = (self.shift + ((hashes & np.uint64(0xFFFFFFFF)) % np.uint64(self.buckets)).astype(np.int64)).astype(np.int32)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            known = self.sorted[at] == hashes
            out[known] = self.order[at[known]]
        return out


class Within:
    """Log probabilities of words within their buckets: those of a table at once, of others up to the count."""

    def __init__(self, words: np.ndarray, n: np.ndarray, whole: bool, bucket_n: np.ndarray, bucket_words: np.ndarray) -> None:
        order = np.argsort(words)
        self.words, self.log_n, self.whole = words[order], np.log(n[order]), whole
        self.log_total = np.log(bucket_n + (bucket_words + 1) / 2)

    def __call__(self, hashes: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities, and marks of words whose count must still be joined."""
        log_n, known = np.full(len(hashes), np.log(0.5) if self.whole else 0.0), np.zeros(len(hashes), dtype=bool)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known = self.words[at] == hashes
            log_n[known] = self.log_n[at[known]]
        return log_n - self.log_total[bucket], ~known & (not self.whole)


@dataclass
class Model:
    number: Numbering
    net: Network
    within: Within
    others: DataFrame  # (word, n) of words outside the table of ``within``


def contexts(tokens: np.ndarray, rows: np.ndarray, beyond: int = VOCAB) -> np.ndarray:
    """The tokens at :data:`PLACES` of each position within its row."""
    n = len(tokens)
    out = np.full((n, len(PLACES)), beyond, dtype=np.int32)
    for k, place in enumerate(PLACES):
        if abs(place) < n:
            to, source = (slice(-place, None), slice(None, place)) if place < 0 else (slice(None, -place), slice(place, None))
            same = rows[to] == rows[source]
            out[to, k] = np.where(same, tokens[source], beyond)
    return out


def _scanned(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, textscan.Spans]]:
    texts = batch.column(at)
    for a, b in slices(byte_sizes(texts), 1 << 20):
        yield a, b, textscan.words(*textscan.buffer_of(texts.slice(a, b - a), lower=True))


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n): hashes of the words of all documents, and how often they occur."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for _, _, spans in _scanned(batch, 0):
                held.append(spans.hash)
                total += len(spans.hash)
                if total >= HELD_WORDS:
                    yield counted(held)
                    held, total = [], 0
        if total:
            yield counted(held)

    return docs.select(text_col).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, text_col: str, held: int) -> tuple[Numbering, Within, DataFrame]:
    counts = materialize(word_counts(docs, text_col), "word-counts")
    by_n = sorted(((r.n, r.words) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    distinct, least, tabled = sum(w for _, w in by_n), 1 << 62, 0
    for n, words in by_n:
        if tabled + words > held:
            break
        tabled, least = tabled + words, n
    table = counts.where(F.col("n") >= least).toArrow()  # at most ``held`` rows
    words, n = table["word"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.lexsort((words, -n))
    words, n = words[order], n[order]
    side = sides(distinct)
    own = side * side - BUCKETS * side // CLASSES
    number = Numbering(words[:own], side)
    bucket_n, bucket_words = np.zeros(number.buckets), np.zeros(number.buckets)
    rest = counts.where(F.col("n") < least)
    bucket = (F.col("word").bitwiseAND(F.lit(0xFFFFFFFF)) % number.buckets).cast("int")
    for row in rest.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        bucket_n[row.b], bucket_words[row.b] = row.n, row.words
    at = number(words[own:]) - number.shift
    bucket_n += np.bincount(at, weights=n[own:], minlength=number.buckets)
    bucket_words += np.bincount(at, minlength=number.buckets)
    return number, Within(words[own:], n[own:], tabled == distinct, bucket_n, bucket_words), rest


def train(docs: DataFrame, text_col: str = "text", rounds: int = 2, share: int = 2, held: int = HELD_TABLE) -> Model:
    if rounds < share:
        raise ValueError("fewer rounds than shares would leave documents untrained")
    number, within, others = vocabulary(docs, text_col, held)
    net, context = Network.fresh(number.side, number.side), docs.sparkSession.sparkContext
    for r in range(rounds):
        given = context.broadcast((number, net))  # a third of a MB, and more as the vocabulary grows

        def run(batches: Iterator[pa.RecordBatch], given=given, r=r) -> Iterator[pa.RecordBatch]:
            number, net = given.value
            own = Network.of(net.flat(), number.side, number.side)

            def drawn() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for batch in batches:
                    for _, _, spans in _scanned(batch, 0):
                        first = np.minimum(spans.row_start[:-1], max(0, len(spans.hash) - 1))
                        if not len(spans.hash):
                            continue
                        mark = textscan.mix(spans.hash[first] + np.diff(spans.row_start).astype(np.uint64))
                        taken = (mark % np.uint64(share) == np.uint64(r % share))[spans.row]
                        tokens = number(spans.hash[taken])
                        around = contexts(tokens, spans.row[taken], number.beyond)
                        order = np.random.default_rng(r).permutation(len(tokens))
                        for i in range(0, len(order), BATCH):
                            yield around[order[i : i + BATCH]], tokens[order[i : i + BATCH]]

            seen = descend(own, drawn())
            if seen:
                parts = np.array_split(own.flat().astype("<f4"), CHUNKS)
                yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([seen] * CHUNKS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "seen", "weights"])

        def average(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["seen", "weights"])
            mean = np.average(np.array([np.frombuffer(w, dtype="<f4") for w in rows.weights]), axis=0, weights=rows.seen)
            return pd.DataFrame({"chunk": rows.chunk.iloc[:1], "weights": [mean.astype("<f4").tobytes()]})

        copies = docs.select(text_col).mapInArrow(run, "chunk int, seen bigint, weights binary")
        parts = copies.groupBy("chunk").applyInPandas(average, "chunk int, weights binary").collect()  # the size of one network
        if parts:
            net = Network.of(np.concatenate([np.frombuffer(p.weights, dtype="<f4") for p in sorted(parts, key=lambda p: p.chunk)]), number.side, number.side)
    return Model(number, net, within, others)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, log_likelihood, mean_log_likelihood) of each document."""
    given = docs.sparkSession.sparkContext.broadcast((model.number, model.net, model.within))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, net, within = given.value
        for batch in batches:
            for a, b, spans in _scanned(batch, 1):
                tokens = number(spans.hash)
                around = contexts(tokens, spans.row, number.beyond)
                each = np.concatenate([net.log_probability(around[i : i + BATCH], tokens[i : i + BATCH]) for i in range(0, len(tokens), BATCH)] or [np.zeros(0)]).astype(np.float64)
                shared = np.flatnonzero(tokens >= number.shift)
                inside, open_ = within(spans.hash[shared], tokens[shared] - number.shift)
                each[shared] += inside
                asked = shared[open_]
                starts = np.concatenate(([0], np.cumsum(np.bincount(spans.row[asked], minlength=b - a))))
                n = np.diff(spans.row_start)
                total = np.bincount(spans.row, weights=each, minlength=b - a).astype(np.float64)
                others = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(spans.hash[asked].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(total), others], names=[id_col, "n_tokens", "log_likelihood", "_others"])

    inner = docs.select(F.col(id_col), F.col(text_col))
    scored = inner.mapInArrow(run, f"`{id_col}` {inner.schema[0].dataType.simpleString()}, n_tokens bigint, log_likelihood double, _others array<bigint>")
    total = F.col("log_likelihood")
    if not model.within.whole:
        scored = materialize(scored.withColumn("_row", F.monotonically_increasing_id()), "likelihoods")
        counted = scored.select("_row", F.explode("_others").alias("word")).join(model.others, "word", "left")
        more = counted.groupBy("_row").agg(F.sum(F.round(F.log(F.coalesce("n", F.lit(0.5))) * FIXED).cast("bigint")).alias("_more"))
        scored = scored.drop("_others").join(more, "_row", "left")
        total = total + F.coalesce("_more", F.lit(0)) / FIXED
    out = scored.select(id_col, "n_tokens", total.alias("log_likelihood"))
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def rate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score(docs, train(docs, text_col), id_col, text_col)
