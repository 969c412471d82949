"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and benchmark items are sequences of words.  A CGK walk reads a sequence from a start and copies the word it
stands on to the output at every step, stepping on by a random bit of (step, word); sequences that differ by
few edits fall into step again, so their outputs differ in few places: edit distance becomes Hamming distance.  An LSH
key samples SAMPLED places of the output.  Items are grouped by length; the windows of a group have its items' size and
start at every word of every text.  Keys are repeated, over several walks, until altered copies of the
items, with as many edits as count as a leak, are found at the target recall.  The walks of long items lose each other too often for
that; a group that misses the target with MAX_KEYS keys is found by pieces as well: of an item cut into one piece more
than edits are allowed, one piece at least is unaltered, so every leak holds one whole, and nothing is lost.  A found pair is verified by the exact edit distance
of the item to the best stretch of words around the window.

A window with more words that no item of the group holds than edits are allowed is no candidate (a bound; it loses
nothing), so walks are taken from few starts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ASCII_WORDS, flat_words, mix64, text_slices

#: Edits allowed, as a percentage of an item's words (15 words: 2, 40 words: 6).
EDIT_PERCENT = 15
TARGET_RECALL = 0.99
#: Altered copies of a group's items, at least, that its keys have to find.
TRIALS = 1_000
SAMPLED = 3
WALKS = 8
#: Keys of a group at most; a group that they don't find at the target recall is looked for by pieces, which lose nothing.
MAX_KEYS = 64
#: Items that one pass over the documents looks for; more are searched for in blocks.
BLOCK_ITEMS = 20_000
#: Longest item of a group over its shortest.
SPAN = 1.25


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of a text: ASCII letters lower-cased, ASCII punctuation taken as white space."""
    return flat_words(texts, ASCII_WORDS)


def edits(m: int) -> int:
    return m * EDIT_PERCENT // 100


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of item to any stretch of text, and where the first best stretch ends (exclusive).

    Myers' bit-parallel recurrence over words with a free start and a free end.
    """
    m = len(item)
    where: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text.tolist()):
        eq = where.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += bool(ph & last) - bool(mh & last)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class Group:
    """Items of like length with their LSH keys: (walk, places in its output, sorted keys, their items)."""

    items: np.ndarray
    least: int
    most: int
    steps: int
    keys: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    recall: float = 0.0
    holds: np.ndarray | None = None  # which words its items hold
    pieces: tuple[int, np.ndarray, np.ndarray, np.ndarray] | None = None  # words of a piece, sorted keys, items, places in them


def walk(words: np.ndarray, starts: np.ndarray, number: int, places: np.ndarray) -> np.ndarray:
    """The CGK outputs at the sorted places, of the walk of this number from each start: (starts, places).

    The random bit of a step and a word is a bit of a hash of walk, step // 64 and word.
    """
    at, out, wanted = starts.copy(), np.empty((len(starts), len(places)), np.int64), 0
    own = np.arange(int(words.max(initial=0)) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(int(places[-1]) + 1):
        if j % 64 == 0:
            bits = mix64(own + np.uint64(number << 32 | j // 64))
        w = words[at]
        while wanted < len(places) and places[wanted] == j:
            out[:, wanted] = w
            wanted += 1
        at += (bits[w] >> np.uint64(j % 64) & np.uint64(1)).astype(np.int64)
    return out


def piece_keys(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` words from each word on, as far as there are so many."""
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(out)].astype(np.uint64))
    return out


def key_of(sampled: np.ndarray) -> np.ndarray:
    """Sampled words as one number; words are numbered below 2 ** 21."""
    key = sampled[:, 0].copy()
    for i in range(1, sampled.shape[1]):
        key = key << 21 | sampled[:, i]
    return key


def altered(item: np.ndarray, rng: np.random.Generator, v: int) -> np.ndarray:
    """The item after edits(len(item)) random replacements, insertions or deletions of words."""
    x = item.tolist()
    for _ in range(edits(len(item))):
        i, kind = int(rng.integers(0, len(x) + 1)), int(rng.integers(0, 3))
        new = int(rng.integers(0, v))
        if kind == 0:
            x[min(i, len(x) - 1)] = new
        elif kind == 1:
            x.insert(i, new)
        elif len(x) > 1:
            del x[min(i, len(x) - 1)]
    return np.array(x, np.int64)


def equal_keys(asked: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in asked and in the sorted keys of all equal pairs."""
    lo, hi = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
    hit = np.flatnonzero(hi > lo)
    times = (hi - lo)[hit]
    return np.repeat(hit, times), np.repeat(lo[hit] - np.cumsum(times) + times, times) + np.arange(times.sum())


class BenchmarkIndex:
    """The LSH tables of a block of items.  Word 0 is the foreign word."""

    def __init__(self, items: list[tuple[int, str]], target: float = TARGET_RECALL):
        self.ids = [i for i, _ in items]
        flat, starts = words_of(pa.array([t for _, t in items], pa.string()))
        coded = flat.dictionary_encode()
        self.vocabulary = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy().astype(np.int64) + 1
        self.words = [code[a:b] for a, b in zip(starts, starts[1:])]
        rng = np.random.default_rng(20240)
        v = len(self.vocabulary) + 1
        sizes = np.array([len(w) for w in self.words])
        self.top = int(2 * sizes.max(initial=1)) + 1
        self.groups: list[Group] = []
        left = np.argsort(sizes, kind="stable")
        left = left[sizes[left] > 0]
        while len(left):
            least = int(sizes[left[0]])
            mine = left[sizes[left] <= max(least, int(least * SPAN))]
            left = left[len(mine) :]
            self.groups.append(self._group(mine, least, int(sizes[mine].max()), rng, v, target))

    def _group(self, mine: np.ndarray, least: int, most: int, rng: np.random.Generator, v: int, target: float) -> Group:
        g = Group(mine, least, most, max(1, int(1.6 * least)))
        g.holds = np.zeros(v, bool)
        g.holds[np.concatenate([self.words[i] for i in mine])] = True
        pad = [np.zeros(2 * most + 2, np.int64)]
        text = np.concatenate([x for i in mine for x in (self.words[i], *pad)])
        starts = np.cumsum([0] + [len(self.words[i]) + len(pad[0]) for i in mine[:-1]])
        rng2 = np.random.default_rng(7)
        picked = rng2.choice(mine, min(len(mine), 200), replace=False)
        trial, origin = [], []
        for i in picked:
            for _ in range(-(-TRIALS // len(picked))):
                trial.append(altered(self.words[i], rng2, v))
                origin.append(int(np.flatnonzero(mine == i)[0]))
        # a copy in a text is followed by other words, which the walks must not have reached
        t_text = np.concatenate([x for t in trial for x in (t, rng2.integers(0, v, len(pad[0])))])
        t_starts = np.cumsum([0] + [len(t) + len(pad[0]) for t in trial[:-1]])
        found = np.zeros(len(trial), bool)
        while len(g.keys) < MAX_KEYS and (not g.keys or found.mean() < target):
            w = len(g.keys) % WALKS
            places = np.sort(rng.integers(0, g.steps, SAMPLED))
            key = key_of(walk(text, starts, w, places))
            tried = key_of(walk(t_text, t_starts, w, places))
            found |= tried == key[np.array(origin)]
            order = np.argsort(key, kind="stable")
            g.keys.append((w, places, key[order], mine[order]))
            if len(g.keys) >= WALKS and 1 - (1 - found.mean()) ** (MAX_KEYS / len(g.keys)) < target:
                break  # more keys, found as often as these, would not do
        g.recall = float(found.mean())
        if g.recall < target:
            g.keys = []
            size = min(len(self.words[i]) // (edits(len(self.words[i])) + 1) for i in mine)
            keys, items, offsets = [], [], []
            for i in mine:
                own = piece_keys(self.words[i], size)[: size * (edits(len(self.words[i])) + 1) : size]
                keys.append(own)
                items.append(np.full(len(own), i))
                offsets.append(size * np.arange(len(own)))
            keys, items, offsets = map(np.concatenate, (keys, items, offsets))
            order = np.argsort(keys, kind="stable")
            g.pieces = size, keys[order], items[order], offsets[order]
        return g

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """(start, item, place of a match) of windows with a key or a piece of an item, in order, over a row of texts in this
        index's numbers."""
        n = len(words)
        padded = np.concatenate([words, np.zeros(self.top + 1, np.int64)])
        found = [np.zeros((3, 0), np.int64)]
        for g in self.groups:
            if g.pieces is not None:
                size, keys, items, offsets = g.pieces
                where, first = equal_keys(piece_keys(words, size), keys)
                found.append(np.stack([where - offsets[first], items[first], where]))  # may begin before the text
                continue
            k = edits(g.most)
            foreign = np.concatenate([[0], np.cumsum(~g.holds[words], dtype=np.int32)])
            # an altered copy is at least this long, and each of its edits brings one foreign word at most
            reach = np.minimum(np.arange(n) + max(1, g.least - k), n)
            starts = np.flatnonzero((foreign[reach] - foreign[:n] <= k) & g.holds[words])
            for part in np.array_split(starts, max(1, len(starts) // 100_000)):
                if not len(part):
                    continue
                for w in range(WALKS):
                    own = [x for x in g.keys if x[0] == w]
                    if not own:
                        continue
                    places = np.unique(np.concatenate([x[1] for x in own]))
                    out = walk(padded, part, w, places)
                    for _, at, keys, items in own:
                        where, first = equal_keys(key_of(out[:, np.searchsorted(places, at)]), keys)
                        found.append(np.stack([part[where], items[first], part[where]]))
        every = np.concatenate(found, axis=1)
        every = every[:, np.lexsort(every[::-1])]
        new = np.ones(every.shape[1], bool)
        new[1:] = (every[:, 1:] != every[:, :-1]).any(0)
        return every[:, new]

    def leaks(self, texts: pa.Array, values: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, distance, end) of verified leaks: the least distance of each pair, end as a word of the text."""
        flat, starts = words_of(texts)
        words = pc.fill_null(pc.index_in(flat, value_set=values), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        at, items, match = self.candidates(words)
        owner = np.searchsorted(starts, match, "right") - 1
        best: dict[tuple[int, int], tuple[int, int]] = {}
        seen: dict[tuple[int, int], int] = {}
        for s, i, d in zip(at.tolist(), items.tolist(), owner.tolist()):
            item = self.words[i]
            k = edits(len(item))
            lo, hi = max(int(starts[d]), s - k), min(int(starts[d + 1]), s + len(item) + 2 * k)
            if seen.get((d, i), -1) >= hi:  # the stretch has been read for an earlier window
                continue
            # windows that overlap are verified together, a window ahead
            hi = min(int(starts[d + 1]), hi + len(item))
            seen[d, i] = hi
            distance, end = best_stretch(item, words[lo:hi])
            if distance <= k and (distance, lo + end) < best.get((d, i), (k + 1, 0)):
                best[d, i] = distance, lo + end
        for (d, i), (distance, end) in sorted(best.items()):
            yield d, i, distance, end - int(starts[d])


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Leaks of benchmark items in docs: (key, item, distance, end_word), a row per row of docs and item.

    A leak is a stretch of words within edits(m) word edits of the item's m words; items may be of any length, their ids of any type.  Null and empty texts, and items without words,
    have none; equal items each leak; repeated rows and rows with a null key are searched one by one.  An item
    repeated with the same id gives a row per copy's text that leaks.  Other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[key], dict(benchmark.dtypes)[item]
    fields = f"{key} {kinds[0]}, {item} {kinds[1]}, distance long, end_word long"
    id_type = to_arrow_type(benchmark.schema[item].dataType)
    known = benchmark.select(F.col(item).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    blocks = max(1, -(-known.count() // BLOCK_ITEMS))
    out = None
    for b in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()  # about BLOCK_ITEMS
        index = BenchmarkIndex([(r["i"], r["t"]) for r in rows])
        sent = spark.sparkContext.broadcast(pickle.dumps(index))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = pickle.loads(sent.value)
            values = pa.array(own.vocabulary, pa.string())
            for batch in text_slices(batches, "__text"):
                got = list(own.leaks(batch.column("__text"), values))
                d = pa.array([x[0] for x in got], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__key").take(d), pa.array([own.ids[x[1]] for x in got], id_type), *[pa.array([x[j] for x in got], pa.int64()) for j in (2, 3)]],
                    names=[key, item, "distance", "end_word"],
                )

        part = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(search, fields)
        out = part if out is None else out.unionByName(part)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that hold a leak; rows with a null key stay."""
    bad = find_leaks(docs, benchmark, key, text).select(key).distinct()
    return docs.join(bad, key, "left_anti")
