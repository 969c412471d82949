"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (0) or abstain (-1) on each document.  Expectation-maximisation over the counts of vote patterns
estimates how often each labeller is right and how much text is good; the counts cover all documents
and are bounded by the number of patterns.  The posterior labels of a bounded sample train a linear scorer over hashed
words and text statistics, which then scores every document in one pass.  No human label is read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_words, text_slices

#: Documents that the linear scorer is fitted on: a share of all, picked by hash, that makes about so many.
SAMPLE = 6_000
BUCKETS = 1 << 14
#: Where EM starts, and what it takes for having seen on as many documents as make up BELIEF of all, at least one: the share of good text,
#: and P(abstain, bad, good) in bad and in good text, of labellers that vote for both and of those that only vote for bad.  It
#: says which class is the good one, and decides where votes say nothing.
PRIOR = 0.85
BOTH = ((0.35, 0.25, 0.40), (0.38, 0.02, 0.60))
ONLY_BAD = ((0.75, 0.25, 0.0), (0.98, 0.02, 0.0))
BELIEF = 0.01
#: What labellers are taken to be: in good text a vote for bad is no likelier than this.  Without it, text that only one of
#: them knows for bad is taken for its mistakes.
MOST = 0.005


#: Each with where EM starts.
LABELLERS = {
    "length": BOTH, "sentences": BOTH, "case": ONLY_BAD, "lower": ONLY_BAD, "symbols": ONLY_BAD, "letters": ONLY_BAD, "repeats": ONLY_BAD, "variety": ONLY_BAD,
}

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 0xC3)  # a lead byte of two or more stands for a letter
_MARK = np.isin(_BYTES, list(b"!%&*$#@|<>{}~^=_"))
_FOREIGN = _BYTES >= 0xCE  # lead bytes beyond the Latin blocks
_STOP = _BYTES == ord(".")
_CHAR = (_BYTES < 0x80) | (_BYTES >= 0xC0)


def parsed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Words per text, the text and the number of each word, and the distinct words."""
    flat, starts = flat_words(texts, bytes(range(256)))
    coded = flat.dictionary_encode()
    words = np.diff(starts)
    return words, np.repeat(np.arange(len(words)), words), coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def votes(texts: pa.Array, words_of: tuple | None = None) -> np.ndarray:
    """(texts, labellers): what each labeller says of each whole text."""
    words, owner, code, names = words_of or parsed(texts)
    some, v = np.maximum(words, 1), max(1, len(names))
    cell = np.sort(owner * v + code)  # faster than np.unique, which hashes
    distinct = np.bincount(cell[np.append(cell[1:] != cell[:-1], True)] // v, minlength=len(words)) if len(cell) else np.zeros(len(words))
    same = np.zeros(len(code), bool)
    same[1:] = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner, same, len(words)) / some
    plain = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(plain.buffers()[1], np.int32, len(plain) + 1, plain.offset * 4).astype(np.int64)
    data = plain.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)

    def count(kind: np.ndarray) -> np.ndarray:
        c = np.add.reduceat(np.append(kind[raw], False).view(np.uint8), ends[:-1] - ends[0], dtype=np.int64)
        return np.where(ends[1:] > ends[:-1], c, 0)  # of an empty text it gives the next byte

    chars, letters = np.maximum(count(_CHAR), 1), count(_LETTER)
    upper, stops = count(_UPPER) / np.maximum(letters, 1), count(_STOP) / some

    def vote(bad: np.ndarray, good: np.ndarray | bool = False) -> np.ndarray:
        return np.where(bad, 0, np.where(good, 1, -1))

    latin = 2 * count(_FOREIGN) <= letters  # other scripts have other stops, and no lower case that bytes tell

    return np.stack(
        [
            vote(words < 8, words >= 60),
            vote(latin & (stops < 0.005), (stops >= 0.03) & (stops <= 0.4)),
            vote(upper > 0.3),
            vote(latin & (count(_LOWER) / chars < 0.4)),
            vote(count(_MARK) / chars > 0.02),
            vote(letters / chars < 0.65),
            vote(repeats > 0.05),
            vote((words >= 30) & (distinct / some < 0.3)),
        ],
        1,
    )


def pattern_number(v: np.ndarray) -> np.ndarray:
    return ((v + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300, start: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """EM over vote patterns: the share of good documents, and P(vote | class) as (labeller, class, vote + 1).

    Votes, abstentions included, are independent given the class.  Share and probabilities are estimated from all documents and, with the
    weight of BELIEF, from where EM starts; only P(bad | good text) is held at MOST.
    """
    start = np.array(list(LABELLERS.values())) if start is None else start
    weight = max(1.0, BELIEF * counts.sum())
    share = np.array([1 - PRIOR, PRIOR])
    good, p, last = PRIOR, np.maximum(start, 1e-9), None
    is_vote = np.stack([patterns == v - 1 for v in range(3)], 2).astype(float)  # (patterns, labellers, votes)
    for _ in range(rounds):
        post = posterior(patterns, good, p)
        w = np.stack([(1 - post) * counts, post * counts])
        total = w.sum(1) + weight * share
        good = float(total[1] / total.sum())
        seen = np.einsum("cp,pjv->jcv", w, is_vote)
        p = np.maximum((seen + weight * share[:, None] * start) / total[:, None], 1e-9)
        p[:, 1, 1] = np.minimum(p[:, 1, 1], MOST)
        if last is not None and np.abs(p - last).max() < 1e-9:
            break
        last = p
    return good, p


def posterior(patterns: np.ndarray, good: float, p: np.ndarray) -> np.ndarray:
    """P(good | votes) of each pattern."""
    d = np.full(len(patterns), np.log(good / (1 - good)))
    for j in range(patterns.shape[1]):
        d += np.log(p[j, 1] / p[j, 0])[patterns[:, j] + 1]
    return 1 / (1 + np.exp(-np.clip(d, -60, 60)))


def accuracies(good: float, p: np.ndarray) -> np.ndarray:
    """How often each labeller is right when it votes."""
    right = good * p[:, 1, 2] + (1 - good) * p[:, 0, 1]
    return right / (good * p[:, 1, 1:].sum(1) + (1 - good) * p[:, 0, 1:].sum(1))


class LinearScorer:
    """Logistic regression over hashed words (share of the text's words, square root) and four statistics."""

    def __init__(self):
        self.w = np.zeros(BUCKETS + 5)

    @staticmethod
    def features(texts: pa.Array, words_of: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, buckets and values of the hashed words of the texts, and their dense statistics."""
        n, owner, code, words = words_of or parsed(texts)
        table = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) % BUCKETS for w in words), np.int64, len(words))
        cell, times = np.unique(owner * BUCKETS + table[code], return_counts=True)
        rows, cols = cell // BUCKETS, cell % BUCKETS
        size = np.maximum(n, 1)
        values = np.sqrt(times / size[rows])
        upper = np.fromiter((len(w) > 1 and w == w.upper() and w != w.lower() for w in words), bool, len(words))
        odd = np.fromiter((not w.strip(".,;:?'\"()-").isalpha() for w in words), bool, len(words))
        same = np.zeros(len(code), bool)
        same[1:] = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
        mean = lambda x: np.bincount(owner, x, len(n)) / size
        dense = np.stack([mean(upper[code]), mean(odd[code]), mean(same), np.minimum(np.log1p(n) / 8, 1.5), np.ones(len(n))], 1)
        return rows, cols, values, dense

    def logits(self, texts: pa.Array, words_of: tuple | None = None) -> np.ndarray:
        rows, cols, values, dense = self.features(texts, words_of)
        return np.bincount(rows, values * self.w[cols], len(dense)) + dense @ self.w[BUCKETS:]


def weak_labels(docs: DataFrame, text: str = "text") -> tuple[float, np.ndarray]:
    """What estimate() makes of the votes on all of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "__text"):
            k, n = np.unique(pattern_number(votes(batch.column("__text"))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], names=["k", "n"])

    counted = docs.select(F.col(text).alias("__text")).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    seen = counted.orderBy("k").collect()  # 3 ** labellers rows at most
    if not seen:
        return PRIOR, np.maximum(np.array(list(LABELLERS.values())), 1e-9)
    every = np.array(list(product((-1, 0, 1), repeat=len(LABELLERS))))
    place = dict(zip(pattern_number(every).tolist(), every))
    return estimate(np.array([place[r["k"]] for r in seen]), np.array([r["n"] for r in seen], float))


def score_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Score every row: (key, score, label_probability, kept).

    label_probability is the posterior of the votes, score the linear scorer's probability of good text, kept
    score >= threshold.  A null or empty text is judged as a text without words.  Repeated rows are scored one
    by one and count as often; a null key is scored like any other.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("__text"))
    good, p = weak_labels(rows, "__text")
    n = docs.count()
    share = min(1.0, sample / n) if n else 1.0
    # about `sample` rows; the bound is on what the hash picks, so no sort of texts is needed
    chosen = rows.where(F.pmod(F.xxhash64(key, "__text"), F.lit(1 << 40)) < int(share * (1 << 40))).select("__text")
    model = LinearScorer()

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "__text"):
            y = posterior(votes(batch.column("__text")), good, p)
            r, c, v, d = LinearScorer.features(batch.column("__text"))
            cut = pa.array(np.searchsorted(r, np.arange(len(d) + 1)).astype(np.int32))
            dense = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(y), pa.ListArray.from_arrays(cut, pa.array(c.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(v.astype(np.float32))), dense],
                names=["y", "c", "v", "d"],
            )

    got = chosen.mapInArrow(featured, "y double, c array<int>, v array<float>, d array<double>").toArrow()  # bounded by the sample
    model = fit_features(model, got)
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(sent.value)
        for batch in text_slices(batches, "__text"):
            words_of = parsed(batch.column("__text"))
            z = m.logits(batch.column("__text"), words_of)
            y = posterior(votes(batch.column("__text"), words_of), good, p)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500)))), pa.array(y, pa.float64())], names=[key, "score", "label_probability"])

    scored = rows.mapInArrow(apply, f"{key} {dict(docs.dtypes)[key]}, score double, label_probability double")
    return scored.withColumn("kept", F.col("score") >= threshold)


def fit_features(model: LinearScorer, rows: pa.Table, rounds: int = 150) -> LinearScorer:
    """Fit on the sample's features: gradient descent with a step size for each weight, on soft labels; deterministic."""
    n = rows.num_rows
    if not n:
        return model
    rows = rows.combine_chunks()
    y = rows.column("y").to_numpy()
    lists = rows.column("c").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    r = np.repeat(np.arange(n), size)
    c = lists.flatten().to_numpy().astype(np.int64)
    v = rows.column("v").combine_chunks().flatten().to_numpy().astype(float)
    dense = rows.column("d").combine_chunks().flatten().to_numpy().reshape(n, -1)
    sum_sq = np.full(len(model.w), 1e-6)
    for _ in range(rounds):
        z = np.bincount(r, v * model.w[c], n) + dense @ model.w[BUCKETS:]
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.concatenate([np.bincount(c, v * e[r], BUCKETS), e @ dense]) / n
        grad[:BUCKETS] += 1e-4 * model.w[:BUCKETS]
        sum_sq += grad * grad
        model.w -= 0.2 * grad / np.sqrt(sum_sq)
    return model
