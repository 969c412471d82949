"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary text, are interpolated with absolute discounting: bigrams down to the words of
their class, and these down to one shared distribution of both classes together, that of continuation counts: in how many
different contexts a word stands, N1+(. w).  Words outside the vocabulary are counted as one unknown word.  Two more models
spell the words that documents of their class hold: characters after the ORDER - 1 before them, down to shared continuation counts of
characters, so a word that no row has shown is known by its stem.  A toxic text is an ordinary one but for a few words: a text's
features are the difference of its log-likelihoods per token by words, and by spelling the log-likelihood, summed over tokens, of
SHARE of them being of the toxic model against none.  A logistic curve fitted on other labelled rows turns both into a score in 0..1.

The models are fitted on a bounded sample of labelled rows (SAMPLE per class, the smallest hashes of their ids), and
every row of the input is scored in one pass without a shuffle; what workers get is bounded by MAX_NGRAMS.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_WORDS, crc_mod, flat_words, text_slices

#: Labelled rows of each class that the models are fitted on at most.
SAMPLE = 4_000
#: Bigrams (and words) that a model keeps at most; the most frequent ones, those seen once never.
MAX_NGRAMS = 1_000_000
DISCOUNT = 0.75
THRESHOLD = 0.3
#: Characters (bytes) of the longest n-grams of spelling; a key holds them and their number in 64 bits, so 7 at most.
ORDER = 6
#: The share of a toxic text's tokens that spelling takes as drawn from the toxic model.
SHARE = 1e-3


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words for scoring: ASCII letters lower-cased, ASCII punctuation taken as white space."""
    return flat_words(texts, ASCII_WORDS)


def spelled(words: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of words between marks: for n = 1 to ORDER the key of the n bytes up to each byte (n << 56 | bytes), each byte's word, and
    whether it is more than the first mark."""
    marked = pc.binary_join_element_wise("\x02", words.cast(pa.string()), "\x03", "")
    n = len(marked)
    offsets = np.frombuffer(marked.buffers()[1], np.int32, n + 1, marked.offset * 4).astype(np.int64)
    byte = np.frombuffer(marked.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.int64) if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    at = np.arange(len(byte)) - (offsets[:-1] - offsets[0])[owner]
    keys, key = [], np.zeros(len(byte), np.int64)
    for o in range(ORDER):
        before = np.ones(len(byte), np.int64)
        before[o:] = byte[: len(byte) - o]
        key = key | np.where(at < o, 1, before) << 8 * o
        keys.append(key | (o + 1) << 56)
    return keys, owner, at > 0


@dataclass
class Spelling:
    """Class-conditional models of characters.  keys: sorted; arrays hold a row for ordinary, one for toxic: the discounted mass of a seen
    n-gram after its first n - 1 characters (of one character: its shared probability), and the weight of backing off after the n-gram."""

    keys: np.ndarray
    mass: np.ndarray
    back: np.ndarray

    def ratios(self, words: pa.Array) -> np.ndarray:
        """Log-likelihood difference of each word."""
        keys, owner, inner = spelled(words)
        if not len(owner) or not len(self.keys):
            return np.zeros(len(words))
        p, last = np.full((2, len(owner)), 1 / 256), None
        for key in keys:
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            at[self.keys[at] != key] = -1
            if last is not None:
                context = np.roll(last, 1)
                p *= np.where(context < 0, 1, self.back[:, context])
                p += np.where(at < 0, 0, self.mass[:, at])
            else:
                p = np.where(at < 0, p, self.mass[:, at])
            last = at
        return np.bincount(owner[inner], np.log(p[1] / p[0])[inner], len(words))


def fit_spelling(keys: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> Spelling:
    """The models from counts of n-grams; the order of rows does not matter."""
    order = np.argsort(keys)
    keys, n = keys[order], np.stack([n0, n1]).astype(float)[:, order]
    mass, back = np.zeros(n.shape), np.ones(n.shape)
    edge = np.searchsorted(keys, np.arange(1, ORDER + 2) << 56).tolist()
    for o in range(1, ORDER):
        mine, above = slice(edge[o], edge[o + 1]), slice(edge[o - 1], edge[o])
        context = o << 56 | (keys[mine] & (1 << 56) - 1) >> 8
        at = np.searchsorted(keys[above], context)
        has = at < edge[o] - edge[o - 1]
        has[has] = keys[above][at[has]] == context[has]
        at = at[has]
        for c in (0, 1):
            own = n[c, mine][has]
            total = np.bincount(at, own, edge[o] - edge[o - 1])
            m = np.maximum(own - DISCOUNT, 0) / np.maximum(total[at], 1)
            mass[c, np.flatnonzero(has) + edge[o]] = m
            back[c, above] = np.maximum(1 - np.bincount(at, m, len(total)), 1e-9)
    ones, twos = slice(edge[0], edge[1]), slice(edge[1], edge[2])
    follows = np.bincount(np.searchsorted(keys[ones], 1 << 56 | keys[twos] & 255), minlength=edge[1] - edge[0] + 1)[: edge[1] - edge[0]]
    shared = np.maximum(follows - DISCOUNT, 0) / max(1, follows.sum())
    mass[:, ones] = shared + (1 - shared.sum()) / 256
    return Spelling(keys, mass, back)


@dataclass
class KneserNeyPair:
    """words: the vocabulary, what follows its numbers is the unknown word; arrays hold a row for ordinary, one for toxic.

    pairs: sorted keys of kept bigrams, context number << 32 | word number.
    """

    words: list[str]
    p: np.ndarray  # (2, V + 1): P(w | ordinary), P(w | toxic)
    back: np.ndarray  # (2, V + 1): weight of backing off after a context
    pairs: np.ndarray
    pair_p: np.ndarray  # (2, pairs): discounted mass of a seen bigram
    slope: np.ndarray | float = 1.0  # of both features
    bias: float = 0.0
    spelling: Spelling | None = None

    def features(self, texts: pa.Array, values: pa.Array | None = None) -> np.ndarray:
        """Two rows: the log-likelihood difference per token of each text by words, and what its words' spelling says."""
        flat, starts = tokens(texts)
        coded = flat.dictionary_encode()
        r = np.zeros(len(coded.dictionary))
        for i in range(0, len(r) if self.spelling else 0, 8_000):  # bounds the memory of a worker
            r[i : i + 8_000] = self.spelling.ratios(coded.dictionary[i : i + 8_000])
        each = np.log1p(SHARE * np.expm1(np.minimum(r, 50)))[coded.indices.to_numpy()]
        n = np.diff(starts)
        return np.stack([self.ratios(flat, starts, values), np.bincount(np.repeat(np.arange(len(n)), n), each, len(n))])

    def ratios(self, flat: pa.Array, starts: np.ndarray, values: pa.Array | None = None) -> np.ndarray:
        """Log-likelihood difference per token of each text by its words; 0 for a text without tokens."""
        v = len(self.words)
        code = pc.index_in(flat, value_set=pa.array(self.words, pa.string()) if values is None else values)
        code = pc.fill_null(code, v).to_numpy(zero_copy_only=False).astype(np.int64)
        context = np.empty_like(code)
        context[1:] = code[:-1]
        first = starts[:-1][starts[:-1] < len(code)]
        context[first] = v  # a text starts after an unknown word
        key = context << 32 | code
        at = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
        hit = self.pairs[at] == key if len(self.pairs) else np.zeros(len(key), bool)
        total = self.back[:, context] * self.p[:, code]
        total[:, hit] += self.pair_p[:, at[hit]]
        n = np.diff(starts)
        diff = np.bincount(np.repeat(np.arange(len(n)), n), np.log(total[1]) - np.log(total[0]), len(n))
        return diff / np.maximum(n, 1)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.broadcast_to(self.slope, 2) @ features + self.bias, -500, 500)))


def fit_pair(words: list[tuple], bigrams: list[tuple], rest: tuple[int, int, int] = (0, 0, 0)) -> KneserNeyPair:
    """The models from counts.  words: (word, n0, n1, k), tokens of either class and how many words stand before it in both; bigrams:
    (first, second, n0, n1); rest: n0, n1 and k of all other words, which are the unknown word.  The order of rows does not matter.
    """
    names = ("b", "n0", "n1", "k"), ("a", "b", "n0", "n1")
    tables = [pa.table(dict(zip(n, zip(*rows) if rows else [[]] * 4))) for n, rows in zip(names, (words, bigrams))]
    return fit_tables(*tables, rest)


def fit_tables(words: pa.Table, bigrams: pa.Table, rest: tuple[int, int, int] = (0, 0, 0)) -> KneserNeyPair:
    """The same of tables: words (b, n0, n1, k) and bigrams (a, b, n0, n1)."""
    words = words.sort_by("b") if len(words) else words
    vocab = words.column("b").combine_chunks().cast(pa.string())
    v = len(vocab)
    counts = np.stack([words.column(c).to_numpy().astype(float) for c in ("n0", "n1", "k")], 1)
    *count, follows = np.append(counts, [rest], axis=0).T
    shared = np.maximum(follows - DISCOUNT, 0) / max(1.0, follows.sum())
    shared += (1 - shared.sum()) / (v + 1)
    mass = [np.maximum(n - DISCOUNT, 0) / max(1.0, n.sum()) for n in count]
    p = np.stack([m + (1 - m.sum()) * shared for m in mass])
    ends = [pc.fill_null(pc.index_in(bigrams.column(c).cast(pa.string()), value_set=vocab), -1).to_numpy().astype(np.int64) for c in ("a", "b")]
    key = ends[0] << 32 | ends[1]
    order = np.argsort(key, kind="stable")
    order = order[(np.minimum(*ends) >= 0)[order]]
    pairs = key[order]
    back, pair_p = np.ones((2, v + 1)), np.zeros((2, len(pairs)))
    for c in (0, 1) if len(pairs) else ():
        n, head = bigrams.column(f"n{c}").to_numpy()[order].astype(float), np.maximum(count[c][pairs >> 32], 1)
        pair_p[c] = np.minimum(np.maximum(n - DISCOUNT, 0) / head, 1)
        back[c, :v] = np.maximum(1 - np.bincount(pairs >> 32, pair_p[c], v), 1e-9)
    return KneserNeyPair(vocab.to_pylist(), p, back, pairs, pair_p)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and bias by Newton steps on standardised features, a row each, lightly regularised."""
    if not x.shape[1]:
        return np.ones(len(x)), 0.0
    mean, scale = x.mean(1, keepdims=True), x.std(1, keepdims=True)
    scale[scale == 0] = 1.0
    z = np.concatenate([(x - mean) / scale, np.ones((1, x.shape[1]))])
    ridge = np.array([0.1] * len(x) + [0.01])
    w = np.zeros(len(ridge))
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(w @ z, -30, 30)))
        grad = z @ (q - y) + ridge * w
        hess = (z * (q * (1 - q))) @ z.T + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    slope = w[:-1] / scale[:, 0]
    return slope, float(w[-1] - slope @ mean[:, 0])


def training_sample(labels: DataFrame, key: str = "doc_id", held_out: tuple[int, int] = (4, 2), per_class: int = SAMPLE) -> tuple[list, float]:
    """Labelled rows outside the held-out fold as (key, y), and the log odds by which the sample differs from all of those.

    Of either class at most per_class, those with the smallest hash.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull())
    known = known.where(crc_mod(key, held_out[0]) != held_out[1]).groupBy(key).agg(F.max("toxic").alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return [], 0.0
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(per_class) for y in (0, 1)]
    odds = math.log(n[1] / n[0]) - math.log(min(n[1], per_class) / min(n[0], per_class))
    return [(r[key], r["y"]) for p in parts for r in p.collect()], odds  # at most 2 * per_class ids


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", held_out: tuple[int, int] = (4, 2), per_class: int = SAMPLE) -> KneserNeyPair:
    """Fit both models and the logistic curve: three quarters of the sample for the counts, one for the curve.

    Without labelled rows of both classes the model knows nothing and every score is the same, 0.5.
    """
    spark = docs.sparkSession
    chosen, odds = training_sample(labels, key, held_out, per_class)
    if not chosen:
        return KneserNeyPair([], np.ones((2, 1)), np.ones((2, 1)), np.zeros(0, np.int64), np.zeros((2, 0)), 0.0, 0.0)
    kind = labels.schema[key].dataType.simpleString()
    ids = spark.createDataFrame(chosen, f"{key} {kind}, y int")
    rows = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(ids), key)
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(4)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            y = batch.column("y").to_numpy(zero_copy_only=False)
            flat, starts = tokens(batch.column("text"))
            coded = flat.dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(y)), np.diff(starts))
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            cell = np.concatenate([code[inner] << 32 | code[inner + 1], code | np.int64(-1) << 32])
            doc = np.concatenate([owner[inner], owner])
            keys, where = np.unique(cell, return_inverse=True)
            own = np.unique(where * np.int64(len(y)) + doc)  # once for each document
            cls, own_cls = y[doc].astype(bool), y[own % len(y)].astype(bool)
            n = [np.bincount(where, m, len(keys)) for m in (~cls, cls)] + [np.bincount(own // len(y), m, len(keys)) for m in (~own_cls, own_cls)]
            names = coded.dictionary
            head = pa.array(np.where(keys < 0, 0, keys >> 32), mask=keys < 0)
            yield pa.RecordBatch.from_arrays(
                [names.take(head), names.take(pa.array(keys & 0xFFFFFFFF)), *[pa.array(x.astype(np.int64)) for x in n]], names=["a", "b", *sums]
            )

    sums = ["n0", "n1", "d0", "d1"]
    counted = rows.where("fold != 0").select("text", "y").mapInArrow(count, "a string, b string, " + ", ".join(f"{x} long" for x in sums))
    counted = counted.groupBy("a", "b").agg(*[F.sum(x).alias(x) for x in sums]).cache()  # bounded by the sample
    most = [(F.col("n0") + F.col("n1")).desc(), "a", "b"]
    own = [F.coalesce(F.sum(F.when(F.col("a").isNull(), F.col(x))), F.lit(0)).alias(x) for x in sums]
    every = counted.groupBy("b").agg(*own, F.count("a").alias("k"))

    def kept(df: DataFrame, order: list = most) -> pa.Table:
        """The most frequent MAX_NGRAMS rows, as far as there are more; the order of rows does not matter."""
        if df.count() > MAX_NGRAMS:
            df = df.orderBy(*order).limit(MAX_NGRAMS)
        return df.toArrow()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "b", 200_000):
            keys, owner, _ = spelled(batch.column("b"))
            key, where = np.unique(np.concatenate(keys), return_inverse=True)
            n = [np.bincount(where, np.tile(batch.column(c).to_numpy()[owner], ORDER), len(key)).astype(np.int64) for c in ("d0", "d1")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, *n)], names=["key", "d0", "d1"])

    repeated = F.col("d0") + F.col("d1") > 1
    words = kept(every.where(repeated).withColumn("a", F.lit(None).cast("string"))).select(["b", "n0", "n1", "k"])
    total = every.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("n0", "n1", "k")]).first()
    bigrams = kept(counted.where("a is not null").where(repeated).drop("d0", "d1"))
    grams = counted.where("a is null").select("b", "d0", "d1").mapInArrow(spell, "key long, d0 long, d1 long")
    grams = kept(grams.groupBy("key").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1")), [(F.col("d0") + F.col("d1")).desc(), "key"])
    counted.unpersist()
    model = fit_tables(words, bigrams, tuple(t - (pc.sum(words.column(c)).as_py() or 0) for c, t in zip(("n0", "n1", "k"), total)))
    model.spelling = fit_spelling(*[grams.column(c).to_numpy() for c in ("key", "d0", "d1")])
    del words, bigrams, grams
    sent = spark.sparkContext.broadcast(pickle.dumps(model))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(sent.value)
        values = pa.array(m.words, pa.string())
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([*map(pa.array, m.features(batch.column("text"), values)), batch.column("y")], names=["x", "z", "y"])

    got = rows.where("fold = 0").select("text", "y").mapInArrow(measure, "x double, z double, y int").collect()  # bounded by the sample
    x, y = np.array([(r["x"], r["z"]) for r in got], float).reshape(-1, 2).T, np.array([r["y"] for r in got], float)
    order = np.lexsort([y, *x])
    model.slope, model.bias = fit_logistic(x[:, order], y[order]) if len(set(y)) == 2 else (1.0, 0.0)
    model.bias += odds  # the sample may hold another share of either class than the input
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", held_out: tuple[int, int] = (4, 2), threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """Score every row of docs: (key, held_out, score, predicted), or with keep all columns of docs plus these, which replace
    columns of docs with their names.

    held_out marks the fold (crc32 of the id modulo held_out[0]) that training never sees; a null key is in no
    fold, and held_out is then null.  A null or empty text, or one without a word, has features of 0 and
    the score of that.  Labels other than 0 and 1 are ignored; of several labels of an id the largest counts.
    Repeated rows are scored one by one.  Label, language, source and id never enter a score.
    """
    model = train(docs, labels, key, text, held_out)
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(sent.value)
        values = pa.array(m.words, pa.string())
        for batch in text_slices(batches, "__text"):
            score = m.scores(m.features(batch.column("__text"), values))
            back = [c for c in batch.schema.names if c != "__text" or keep and text in own]
            yield pa.RecordBatch.from_arrays([*map(batch.column, back), pa.array(score)], names=[*back, "__score"])

    new = ("held_out", "score", "predicted")
    own = [c for c in docs.columns if c == key or c.lower() not in new] if keep else [key]
    rest = [c for c in own if c != text]  # the text goes to the workers once
    rows = docs.select(*rest, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if keep and text in own or f.name != "__text")
    scored = rows.mapInArrow(apply, f"{fields}, __score double")
    return scored.select(
        *[F.col("__text").alias(c) if c == text else F.col(c) for c in own],
        (crc_mod(key, held_out[0]) == held_out[1]).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= threshold).cast("int").alias("predicted"),
    )
