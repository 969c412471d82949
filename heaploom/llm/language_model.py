"""LM scoring with a weighted backoff automaton.

A bigram model with absolute discounting, smoothed down to discounted unigrams, becomes an automaton: the root state, and a state for
every context word with a bigram that was seen twice or more; a state has arcs for all of these bigrams and a failure arc, with the
backoff weight, to the root, whose arcs are all words and one unknown word.  A text is read once from left to right: the
state is carried from token to token and log10 probabilities add up.

Counts cover the whole training corpus; words are shuffled by word, bigrams by a hash of the pair.  States and arcs grow with the
corpus and are distributed tables.  Workers get a cache of the hot ones, bounded by relative frequencies and not by the corpus:
words (and bigrams of them) that make up at least HEAD (ARC) of all tokens, so at most 1 / HEAD (1 / ARC) of them.  A traversal notes
which rarer words and which pairs outside the cache a text takes, and joins on the word and on (context, word) add their weights.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, flat_words, mix64, text_slices, written

#: The end of a text, counted as a token; no word holds a line feed.
END = "\n"
#: Words and arcs that workers hold, by share of all tokens; the rest is joined.
HEAD = 2e-6
ARC = 1e-6
#: Bigrams seen less often have no arc.
LEAST = 2
#: Tokens to a bucket of pairs, which one task holds at once; their number grows with the corpus.
BUCKET = 2_000_000


def sequence(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens, END being the last, the number of each token of all texts in a row, an end after each, and where each
    text's begin."""
    flat, starts = flat_words(texts)
    coded = flat.dictionary_encode()
    n = len(starts) - 1
    code = np.full(len(flat) + n, len(coded.dictionary), np.int64)
    code[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(starts))] = coded.indices.to_numpy()
    return pa.concat_arrays([coded.dictionary, pa.array([END], pa.string())]), code, starts + np.arange(n + 1)


def runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


@dataclass
class Automaton:
    """The cache of hot states and arcs.  words: head words; states are numbered like their words, the root is len(words) and comes last.

    root: log10 weight of the root's arc to each head word; fail: of each state's failure arc (root: 0), which leaves out
    all arcs of the state; arcs: sorted keys state << 32 | word of the hot ones, with log10 weights.
    """

    words: list[str]
    root: np.ndarray
    fail: np.ndarray
    is_state: np.ndarray
    arcs: np.ndarray
    weights: np.ndarray

    def read(self, code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One traversal of coded texts (rare words: len(words)): log10 weights by token, without what rare words and
        arcs outside the cache add; and which tokens took a cached arc."""
        v = len(self.words)
        state = np.full(len(code), v, np.int64)
        state[1:] = np.where(self.is_state[code[:-1]], code[:-1], v)
        state[starts[:-1]] = v
        out = self.fail[state] + self.root[code]
        key = state << 32 | code
        asked = np.flatnonzero(state < v)
        cached = np.zeros(len(code), bool)
        if len(self.arcs) and len(asked):
            at = np.minimum(np.searchsorted(self.arcs, key[asked]), len(self.arcs) - 1)
            hit = self.arcs[at] == key[asked]
            out[asked[hit]] = self.weights[at[hit]]
            cached[asked[hit]] = True
        return out, cached


def word_keys(words: pa.Array, head: pa.Array, salt: int) -> np.ndarray:
    """An integer for each word: its number in head, or a hash below 0."""
    import xxhash

    out = pc.fill_null(pc.index_in(words, value_set=head), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    rare = np.flatnonzero(out < 0)
    hashes = (xxhash.xxh3_64_intdigest(w, salt) for w in words.take(pa.array(rare)).to_pylist())
    out[rare] = (np.fromiter(hashes, np.uint64, len(rare)) | np.uint64(1 << 63)).view(np.int64)
    return out


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(mix64(a.view(np.uint64)) + b.view(np.uint64))


def in_order(keys: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in the order of unsigned numbers, and codes that number them so: a sort of codes is then one of keys."""
    order = np.argsort(keys.view(np.uint64), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return keys[order], rank[code]


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit numbers, the first one rising (unsigned): its differences and the rest by byte planes, compressed."""
    first, *rest = columns
    first = np.diff(first.view(np.uint64), prepend=np.uint64(0))
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T) for x in (first, *rest)]
    return pa.compress(b"".join(x.tobytes() for x in planes), "zstd", asbytes=True)


def unpacked(part: pa.Table, columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of all blobs of part(m, data) in a row, and the row of part that each number comes from."""
    sizes = part.column("m").to_numpy()
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(columns)]
    for m, blob in zip(sizes.tolist(), part.column("data").to_pylist()):
        raw = pa.decompress(blob, decompressed_size=8 * m * columns, codec="zstd")
        planes = np.frombuffer(raw, np.uint8).reshape(columns, 8, m)
        for i in range(columns):
            x = np.ascontiguousarray(planes[i].T).view(np.uint64).ravel()
            out[i].append((x if i else np.cumsum(x, dtype=np.uint64)).view(np.int64))
    return [np.concatenate(x) for x in out], np.repeat(np.arange(len(sizes)), sizes)


def dealt(a: np.ndarray, b: np.ndarray, buckets: int, *more: np.ndarray) -> list[pa.Array]:
    """(bucket, m, data): pairs in the order of a, and what goes with them, as a blob a bucket."""
    bucket = (pair_hash(a, b) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
    columns = [x[order] for x in (a, b, *more)]
    cut = runs(bucket[order])
    ends = np.append(cut[1:], len(order))
    blobs = [packed([x[i:j] for x in columns]) for i, j in zip(cut.tolist(), ends.tolist())]
    return [pa.array(bucket[order][cut].astype(np.int32)), pa.array((ends - cut).astype(np.int32)), pa.array(blobs, pa.binary())]


def summed_pairs(part: pa.Table) -> pa.Table:
    """(bucket, a, b, n) of one bucket: how often each pair occurs, from LEAST times on."""
    (a, b, n), _ = unpacked(part, 3)
    h = pair_hash(a, b)
    order = np.argsort(h)
    same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    if (~same & (h[order][1:] == h[order][:-1])).any():  # two pairs with one hash
        order = np.lexsort((b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    first = np.flatnonzero(np.append(True, ~same))
    n = np.add.reduceat(n[order], first)
    kept = n >= LEAST
    a, b = a[order][first][kept], b[order][first][kept]
    bucket = np.full(len(a), part.column("bucket")[0].as_py(), np.int32)
    return pa.table({"bucket": bucket, "a": a, "b": b, "n": n[kept]})


def found_pairs(a: np.ndarray, b: np.ndarray, arc_a: np.ndarray, arc_b: np.ndarray) -> np.ndarray:
    """Where each pair is among the arcs, -1 for those without an arc."""
    h, arc_h = pair_hash(a, b), pair_hash(arc_a, arc_b)
    order = np.argsort(arc_h)
    arc_h, out = arc_h[order], np.full(len(a), -1, np.int64)
    at = np.searchsorted(arc_h, h)
    todo = np.arange(len(a))
    while len(todo):  # more than once only for pairs with one hash
        todo = todo[at[todo] < len(order)]
        todo = todo[arc_h[at[todo]] == h[todo]]
        arc = order[at[todo]]
        hit = (arc_a[arc] == a[todo]) & (arc_b[arc] == b[todo])
        out[todo[hit]] = arc[hit]
        todo = todo[~hit]
        at[todo] += 1
    return out


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c): how often each token occurs; summed in workers first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words, code, _ = sequence(batch.column("text"))
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(code, minlength=len(words)))], names=["word", "c"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def counted_pairs(docs: DataFrame, words: list[str], salt: int, buckets: int, text: str = "text") -> DataFrame:
    """(bucket, a, b, n): all pairs of neighbouring tokens that occur LEAST times or more; summed in workers first."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(words))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = pa.array(pickle.loads(sent.value), pa.string())
        for batch in text_slices(batches):
            words, code, starts = sequence(batch.column("text"))
            key, code = in_order(word_keys(words, head, salt), code)
            after = np.ones(len(code), bool)
            after[starts[:-1]] = False  # a text's first token follows nothing
            at = np.flatnonzero(after)
            cell = np.sort(code[at - 1] << 32 | code[at])
            first = runs(cell)
            n = np.diff(np.append(first, len(cell)))
            cell = cell[first]
            blobs = dealt(key[cell >> 32], key[cell & 0xFFFFFFFF], buckets, n.astype(np.int64))
            yield pa.RecordBatch.from_arrays(blobs, names=["bucket", "m", "data"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(pairs, "bucket int, m int, data binary")
    return rows.groupBy("bucket").applyInArrow(summed_pairs, "bucket int, a long, b long, n long")


def train(docs: DataFrame, counts: DataFrame, total: int, distinct: int, text: str = "text") -> tuple[Automaton, dict]:
    """The automaton for counts of docs, as a cache and what it does not hold: the root's weights for rarer words, log10((c - D) / N),
    and unknown; rare(word, c, k, fail), rarer words, their keys and failure weights; arcs(bucket, a, b, more), all
    arcs outside the cache and what each adds to the failure arc's and the root's weight.
    """
    spark = docs.sparkSession
    once = {r["c"]: r["n"] for r in counts.where("c <= 2").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2 = once.get(1, 0), once.get(2, 0)
    discount = min(0.9, max(0.1, n1 / max(1, n1 + 2 * n2)))
    unknown = discount * distinct / total if total else 1.0
    head = counts.where(F.col("c") >= F.lit(HEAD * total)).orderBy("word").collect()  # at most 1 / HEAD rows
    words = [r["word"] for r in head]
    c = np.array([r["c"] for r in head], float)
    v = len(words)
    buckets = 1 + total // BUCKET
    tail = counts.where(F.col("c") < F.lit(HEAD * total))
    salt = 0
    while True:
        def keyed(batches: Iterator[pa.RecordBatch], salt: int = salt) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = word_keys(batch.column("word"), pa.array([], pa.string()), salt)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=["word", "c", "k"])

        pairs = written(counted_pairs(docs, words, salt, buckets, text), "pairs")
        states = written(pairs.groupBy("a").agg((F.sum("n") - F.lit(discount) * F.count("*")).alias("own")), "states")
        by_key = tail.select("word", "c").mapInArrow(keyed, "word string, c long, k long")
        by_key = by_key.groupBy("k").agg(F.first("c").alias("c"), F.count("*").alias("same"))
        fail = F.log10(F.greatest(1 - F.coalesce("own", F.lit(0.0)) / F.col("c"), F.lit(1e-12)))
        rare = written(by_key.join(states.withColumnRenamed("a", "k"), "k", "left").select("c", "k", "same", fail.alias("fail")), "rare")
        if rare.where("same > 1").isEmpty():
            break
        discard(pairs, states, rare)  # two words with one key: other keys
        salt += 1
    got = states.where("a >= 0").collect()  # head words only
    left = np.ones(v + 1)
    a = np.array([r["a"] for r in got], np.int64)
    left[a] = np.maximum(1 - np.array([r["own"] for r in got], float) / c[a], 1e-12)
    is_state = np.zeros(v + 1, bool)
    is_state[a] = True
    p_root = (c - discount) / max(1, total)
    hot = (F.col("a") >= 0) & (F.col("b") >= 0) & (F.col("n") >= F.lit(float(ARC * total)))
    kept = pairs.where(hot).select((F.shiftleft("a", 32).bitwiseOR(F.col("b"))).alias("k"), "n").orderBy("k").collect()  # at most 1 / ARC rows
    arcs = np.array([r["k"] for r in kept], np.int64)
    n = np.array([r["n"] for r in kept], float)
    p_arc = np.maximum(n - discount, 0) / c[arcs >> 32] + left[arcs >> 32] * p_root[arcs & 0xFFFFFFFF] if len(arcs) else n
    model = Automaton(words, np.append(np.log10(p_root), 0.0), np.log10(left), is_state, arcs, np.log10(p_arc))
    sent = spark.sparkContext.broadcast(pickle.dumps((c, left)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rest = pickle.loads(sent.value)
        size = np.append(size, 0.0)  # for rare words
        for batch in batches:
            a, b, n, ca, fail, cb = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("a", "b", "n", "ca", "fail", "cb"))
            ca, cb = np.where(a < 0, ca, size[np.maximum(a, -1)]), np.where(b < 0, cb, size[np.maximum(b, -1)])
            off = np.where(a < 0, 10**fail, rest[np.maximum(a, -1)]) * (cb - discount) / total
            more = np.log10(1 + (n - discount) / ca / off)
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("a"), batch.column("b"), pa.array(more)], names=["bucket", "a", "b", "more"])

    # head words have their numbers from the broadcast; their arcs are spread by bucket, which matches no key
    cold = pairs.where(~hot)
    for end, of in (("a", [F.col("c").cast("double").alias("ca"), "fail"]), ("b", [F.col("c").cast("double").alias("cb")])):
        cold = cold.withColumn("k", F.when(F.col(end) < 0, F.col(end)).otherwise(F.col("bucket").cast("long"))).join(rare.select("k", *of), "k", "left").drop("k")
    cold = written(cold.mapInArrow(weigh, "bucket int, a long, b long, more double"), "arcs")
    discard(pairs, states)
    return model, {"discount": discount, "unknown": unknown, "rare": rare, "arcs": cold, "salt": salt, "buckets": buckets}


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: tuple[int, int] = (10, 0)) -> DataFrame:
    """Score every whole text: (key, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row.

    Learns from rows whose crc32(key as text) modulo held_out[0] is not held_out[1] (null keys are learnt from,
    their held_out is null).  base_score is the add-0.1 unigram log10 probability, score that of the
    automaton; an end token closes every text, so null and empty texts have one token.  Repeated rows count and are scored one by one.
    With nothing to learn from, every token is unknown, base_score is 0 per token and so is score.
    """
    spark = docs.sparkSession
    fold = crc_mod(key, held_out[0]) == held_out[1]
    learn = docs.where(~F.coalesce(fold, F.lit(False)))
    counts = written(word_counts(learn, text), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model, rest = train(learn, counts, total, distinct, text)
    head = {r["word"]: r["c"] for r in counts.where(F.col("c") >= F.lit(HEAD * total)).collect()}  # at most 1 / HEAD
    size = np.append([float(head[w]) for w in model.words], 0.0)
    denominator = total + 0.1 * (distinct + 1)
    discard(counts)
    sent = spark.sparkContext.broadcast(pickle.dumps((model, np.append(np.log10((size[:-1] + 0.1) / denominator), 0.0))))
    salt, buckets = rest["salt"], rest["buckets"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text, and rows that hold a slice's pairs outside the cache, with the number of their text in the slice."""
        automaton, base = pickle.loads(sent.value)
        v, values = len(automaton.words), pa.array(automaton.words, pa.string())
        for batch in text_slices(batches, "__text"):
            words, code, starts = sequence(batch.column("__text"))
            number = pc.fill_null(pc.index_in(words, value_set=values), v).to_numpy(zero_copy_only=False).astype(np.int64)
            key, code = in_order(word_keys(words, values, salt), code)
            number = np.sort(number)  # of head words, the key; all others have larger keys
            n = len(starts) - 1
            owner = np.repeat(np.arange(n), np.diff(starts))
            weight, cached = automaton.read(number[code], starts)
            rare = number[code] == v
            cell = np.sort(owner[rare] << 32 | code[rare])
            first = runs(cell)
            times = np.diff(np.append(first, len(cell)))
            cell = cell[first]
            cut = pa.array(np.searchsorted(cell >> 32, np.arange(n + 1)).astype(np.int32))
            row = batch.column("__row").to_numpy()
            cached[starts[:-1]] = True  # a text's first token follows nothing
            open_ = np.flatnonzero(~cached)
            pair = code[open_ - 1] << 32 | code[open_]
            order = np.argsort(pair)
            pair, open_ = pair[order], open_[order]
            blobs = dealt(key[pair >> 32], key[pair & 0xFFFFFFFF], buckets, row[owner[open_]] - row[0])
            m = len(blobs[0])
            types = {"__key": batch.column("__key").type, "__fold": pa.bool_()} | dict.fromkeys(("n", "known"), pa.int64())
            types |= dict.fromkeys(("base", "score"), pa.float64()) | dict.fromkeys(("rare", "times"), pa.list_(pa.int64()))
            pairs = dict(zip(("bucket", "m", "data"), blobs)) | {"__row": pa.array(np.full(m, row[0]))}
            yield pa.RecordBatch.from_arrays([pairs[c] if c in pairs else pa.nulls(m, types[c]) for c in columns], names=columns)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((mix64(row) % np.uint64(buckets)).astype(np.int32)),
                    *[batch.column(c) for c in ("__key", "__row", "__fold")],
                    pa.array(np.diff(starts)),
                    pa.array(np.bincount(owner, ~rare, n).astype(np.int64)),
                    pa.array(np.bincount(owner, base[number[code]], n)),
                    pa.array(np.bincount(owner, weight, n)),
                    pa.ListArray.from_arrays(cut, pa.array(key[cell & 0xFFFFFFFF])),
                    pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int64))),
                    *[pa.nulls(n, pairs[c].type) for c in ("m", "data")],
                ],
                names=columns,
            )

    def meet(part: pa.Table, arcs: pa.Table) -> pa.Table:
        """The pairs of one bucket meet its arcs: what these add, by text; rows of texts pass."""
        text = part.filter(pc.is_null(part.column("m"))).select(columns[1:-2])
        part = part.filter(pc.is_valid(part.column("m")))
        text = text.append_column("at", pa.nulls(len(text), pa.list_(pa.int32()))).append_column("more", pa.nulls(len(text), pa.list_(pa.float64())))
        if not len(part) or not len(arcs):
            return text
        (a, b, at), owner = unpacked(part, 3)
        arc = found_pairs(a, b, *[arcs.column(c).to_numpy() for c in ("a", "b")])
        hit = np.flatnonzero(arc >= 0)
        cell, where = np.unique(owner[hit] << 32 | at[hit], return_inverse=True)
        more = np.bincount(where, arcs.column("more").to_numpy()[arc[hit]], len(cell))
        cut = pa.array(np.searchsorted(cell >> 32, np.arange(len(part) + 1)).astype(np.int32))
        lists = {"at": pa.array((cell & 0xFFFFFFFF).astype(np.int32)), "more": pa.array(more)}
        met = {"__row": part.column("__row").combine_chunks()} | {c: pa.ListArray.from_arrays(cut, x) for c, x in lists.items()}
        met = [met[f.name] if f.name in met else pa.nulls(len(part), f.type) for f in text.schema]
        return pa.concat_tables([text, pa.table(met, schema=text.schema)])

    def by_text(part: pa.Table) -> pa.Table:
        """What arcs outside the cache add to the texts of one slice."""
        at = pc.list_flatten(part.column("at")).to_numpy()
        total, n = np.bincount(at, pc.list_flatten(part.column("more")).to_numpy()), np.bincount(at)
        return pa.table({"__row": part.column("__row")[0].as_py() + np.flatnonzero(n), "s3": total[n > 0]})

    rows = docs.select(F.col(key).alias("__key"), F.monotonically_increasing_id().alias("__row"), fold.alias("__fold"), F.col(text).alias("__text"))
    kind = dict(docs.dtypes)[key]
    fields = f"__key {kind}, __row long, __fold boolean, n long, known long, base double, score double, rare array<long>, times array<long>"
    columns = ["bucket", "__key", "__row", "__fold", "n", "known", "base", "score", "rare", "times", "m", "data"]
    noted = rows.mapInArrow(read, f"bucket int, {fields}, m int, data binary")
    noted = noted.groupBy("bucket").cogroup(rest["arcs"].groupBy("bucket")).applyInArrow(meet, f"{fields}, at array<int>, more array<double>")
    noted = written(noted, "passes")
    discard(rest["arcs"])
    passed = noted.where("at is null")
    arcs = noted.where("size(at) > 0").select("__row", "at", "more").groupBy("__row").applyInArrow(by_text, "__row long, s3 double")
    taken = passed.select("__row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("__row", F.col("x.rare").alias("k"), F.col("x.times").alias("t"))
    met = taken.join(rest["rare"], "k", "left")
    c = F.col("c")
    zero = F.lit(0.0)
    if total:
        base_w = F.log10((F.coalesce(c, F.lit(0)) + 0.1) / F.lit(float(denominator)))
        arc_w = F.when(c.isNotNull(), F.log10((c - F.lit(rest["discount"])) / F.lit(float(total)))).otherwise(F.log10(F.lit(rest["unknown"])))
    else:
        base_w = arc_w = zero
    added = met.groupBy("__row").agg(
        F.sum(F.when(c.isNotNull(), F.col("t")).otherwise(0)).alias("k2"), F.sum(F.col("t") * base_w).alias("b2"), F.sum(F.col("t") * (arc_w + F.coalesce("fail", zero))).alias("s2")
    )
    def plus(a: str, b: str) -> Column:
        return F.col(a) + F.coalesce(F.col(b), F.lit(0))

    return passed.drop("rare", "times", "at", "more").join(added, "__row", "left").join(arcs, "__row", "left").select(
        F.col("__key").alias(key),
        F.col("__fold").alias("held_out"),
        F.col("n").alias("n_tokens"),
        plus("known", "k2").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        plus("base", "b2").alias("base_score"),
        (plus("score", "s2") + F.coalesce("s3", zero)).alias("score"),
    )
