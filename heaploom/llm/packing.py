"""Best-fit packing of token sequences by swap-based local search.

Documents are tokenised once, in workers, and cut into pieces only where they exceed the sequence length.  Pieces
are dealt by a hash of their document into groups of bounded expected size; each group is packed by itself: a
best-fit start, then exchanges between underfull bins that raise the sum of squared fills until bins run empty.
A group loses a bin at most against packing all pieces together, so the loss is one bin in thousands.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, text_slices, written

CAPACITY = 2048
#: Expected pieces of a group; groups are made by a hash, so none grows with the input.
GROUP_PIECES = 5_000
#: Givers tried in a row, from the emptiest bin on, before the search ends.
STUCK = 50
#: Distinct words whose ids a worker keeps; beyond it the memory starts anew, the ids stay the same.
MEMO_WORDS = 500_000
#: Bytes of text encoded at once; a distinct word is looked up once for each.
SLICE = 2_000_000
#: The settings of a tokenizers file whose words cut_words() finds.
WORD_RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
#: Texts that cut_words() takes.  1C-1F, 7F to A0 are white space or nothing to some engines only; AA, B5 and BA are letters without
#: case, and B2, B3, B9 and BC to BE are numbers.
PLAIN = r"^[\x00-\x1b\x20-\x7e\x{a1}-\x{a9}\x{ab}-\x{b1}\x{b4}\x{b6}-\x{b8}\x{bb}\x{bf}-\x{ff}]*$"
_SPACES, _LETTERS, _DIGITS, _MARKS = range(4)
_KIND = np.array(
    [
        _SPACES if b == 32 or 9 <= b <= 13 else _DIGITS if 48 <= b <= 57 else _LETTERS if 97 <= b | 32 <= 122 or b >= 128 else _MARKS
        for b in range(256)
    ],
    np.uint8,
)


class WordTokenizer:
    """Ids of a tokenizers file; where the file cuts words by the known rules (WORD_RULES), distinct words are encoded once and remembered.

    A text is then cut into words here only if it lies in characters (ASCII and Latin-1) whose lower case, white space and classes
    are the same to the library's regular expressions and to ours; all other texts, texts that hold a special token, and all
    texts where a file has other rules, are given to the library whole.
    """

    def __init__(self, path: str, eos: int | None = 0):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.eos = [] if eos is None else [eos]
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        special = [t["content"] for t in rules["added_tokens"]]
        # a special token that is normalised, or that takes white space beside it, is looked for otherwise than by its letters
        simple = not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in rules["added_tokens"])
        self.by_word = simple and all(rules[k] == v for k, v in WORD_RULES.items()) and not rules["model"].get("dropout")
        self.special = "|".join(map(re.escape, special))
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros(1 << 16, "<u4")  # ids of all remembered words in a row
        self.ends = np.zeros(1 << 16, np.int64)  # where those of each word end there; word 0 has none
        self.ends_at, self.used = 1, 0

    def _learn(self, words: list[str]) -> None:
        """Encode words, each a single match of the pattern, as one text; a word's ids are those with its number."""
        for a in range(0, len(words), 500):
            part = words[a : a + 500]
            got = self.tok.encode(" ".join(part), add_special_tokens=False)
            ends = np.searchsorted(np.array(got.word_ids), np.arange(len(part)), "right")
            while self.used + len(got.ids) > len(self.table):
                self.table = np.append(self.table, np.zeros_like(self.table))
            while self.ends_at + len(part) > len(self.ends):
                self.ends = np.append(self.ends, np.zeros_like(self.ends))
            self.table[self.used : self.used + len(got.ids)] = got.ids
            self.ends[self.ends_at : self.ends_at + len(part)] = ends + self.used
            self.place.update(zip(part, range(self.ends_at, self.ends_at + len(part))))
            self.used += len(got.ids)
            self.ends_at += len(part)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids begin (one more entry than texts)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pa.array(np.full(len(texts), not self.by_word))
        if self.by_word:
            odd = pc.invert(pc.match_substring_regex(texts, PLAIN))
            odd = pc.or_(odd, pc.match_substring_regex(texts, self.special)) if self.special else odd
        words, starts = cut_words(pc.if_else(odd, "", texts))
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        place = [self.place.get(w, 0) for w in names]
        new = [w for w, at in zip(names, place) if not at]
        if new:
            if self.ends_at + len(new) > MEMO_WORDS:
                self.forget()
                new = names
            self._learn(new)
            place = [self.place[w] for w in names]
        place = np.array(place, np.int64)
        begin, size = self.ends[place - 1], self.ends[place] - self.ends[place - 1]
        code = coded.indices.to_numpy()
        each = size[code]
        after = np.concatenate([[0], np.cumsum(each)])
        ids = self.table[np.arange(after[-1]) + np.repeat(begin[code] - after[:-1], each)]
        bounds = after[starts]
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        if not whole and len(self.eos) == 1:  # the end token is put in behind every text at once
            return np.insert(ids, bounds[1:], self.eos[0]), bounds + np.arange(len(bounds))
        pieces, at = [], [0]
        own = dict(zip(whole, self.tok.encode_batch([texts[i].as_py() for i in whole], add_special_tokens=False)))
        for i in range(len(texts)):
            mine = own[i].ids if i in own else ids[bounds[i] : bounds[i + 1]]
            pieces += [np.asarray(mine, np.uint32), np.array(self.eos, np.uint32)]
            at.append(at[-1] + len(mine) + len(self.eos))
        return np.concatenate(pieces) if pieces else np.zeros(0, np.uint32), np.array(at)


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All matches of the pattern in the lower-cased texts in a row, and where each text's begin; texts match PLAIN.

    Works on the bytes of all texts at once: a word begins where the class of bytes changes, every digit is a word, and
    an apostrophe that begins a run of marks takes the letters of a contraction with it.
    """
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4)
    data, starts = texts.buffers()[2], (offsets - offsets[0]).astype(np.int64)
    raw = data.slice(int(offsets[0]), int(starts[-1])).to_pybytes() if data is not None else b""
    raw = np.frombuffer(raw.translate(ASCII_LOWER) + b"   ", np.uint8).copy()
    size = len(raw) - 3
    kind = _KIND[raw]
    second = np.flatnonzero((raw >= 0x80) & (raw < 0xC0))
    if len(second):
        x, latin = raw[second], raw[second - 1] == 0xC3
        sign = latin & ((x == 0x97) | (x == 0xB7))
        raw[second[latin & (x < 0x9F) & ~sign]] += 0x20
        kind[second] = np.where(latin & ~sign, _LETTERS, _MARKS)
        kind[second - 1] = kind[second]
    begins = np.ones(size + 3, bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGITS)
    first = np.zeros(size + 3, bool)
    first[starts] = True
    begins |= first
    begins[second] = False
    quote = np.flatnonzero(raw[:size] == ord("'"))
    quote = quote[begins[quote] & ~first[quote + 1]]
    b, c = raw[quote + 1], raw[quote + 2]
    two = np.isin(b, np.frombuffer(b"stmd", np.uint8))
    e, ll = ord("e"), ord("l")
    three = ~first[quote + 2] & (((b == ord("r")) | (b == ord("v"))) & (c == e) | (b == ll) & (c == ll))
    begins[quote[two | three] + 1] = False
    begins[quote[two] + 2] = True
    begins[quote[three] + 3] = True
    edges = np.flatnonzero(begins[: size + 1]).astype(np.int32)
    if not len(edges) or edges[-1] != size:
        edges = np.append(edges, np.int32(size))
    words = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(raw))
    full = kind[edges[:-1]] != _SPACES
    return words.filter(pa.array(full)), np.searchsorted(edges[:-1][full], starts)


def _worker_tokenizer(path: str, eos: int | None) -> WordTokenizer:
    """One per worker process, so that later tasks find the words that earlier ones have encoded."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_heaploom", {})
    if (path, eos) not in kept:
        kept[path, eos] = WordTokenizer(path, eos)
    return kept[path, eos]


def token_pieces(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    eos: int | None = 0, with_ids: bool = False,
) -> DataFrame:
    """A row per piece: key, __doc (number of the row), piece, start, length, ids_crc32 and, if wanted, ids."""
    fields = f"{key} {dict(docs.dtypes)[key]}, __doc long, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        fields += ", ids array<int>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = _worker_tokenizer(tokenizer, eos)
        for batch in text_slices(batches, text, SLICE, tokenizers=True):
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            flat, bounds = tok.encode(batch.column(text))
            for i in range(batch.num_rows):
                whole = flat[bounds[i] : bounds[i + 1]]
                for k, a in enumerate(range(0, len(whole), capacity)):
                    part = whole[a : a + capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(at),
                    batch.column("__doc").take(at),
                    pa.array(piece, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                    *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []),
                ],
                names=[key, "__doc", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])],
            )

    narrow = docs.select(F.col(key), F.monotonically_increasing_id().alias("__doc"), F.col(text).alias(text))
    return narrow.mapInArrow(cut, fields)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of piece numbers: pieces from long to short, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if free > n:
            insort(room, (free - n, b))
    return bins


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty bins by exchanges between underfull bins, each of which raises the sum of squared fills.

    The emptiest bin gives, and the other underfull bins take: a document moves to a bin with room for it; or a
    document of the giver changes places with a shorter one, or with two that are shorter together, so that the
    taker fills up and the giver drains.  Ends when the number of bins is the least possible for the total length, or no
    exchange is left for any giver.
    """
    n = lengths.tolist()
    least = -(-int(lengths.sum()) // capacity)
    fill = [sum(n[i] for i in b) for b in bins]
    count = len(bins)
    room = sorted((capacity - f, k) for k, f in enumerate(fill) if f < capacity)  # underfull bins by free space

    def changed(k: int, by: int) -> None:
        room.pop(bisect_left(room, (capacity - fill[k], k))) if fill[k] < capacity else None
        fill[k] += by
        if bins[k] and fill[k] < capacity:
            insort(room, (capacity - fill[k], k))

    stuck = 0
    while count > least and stuck < min(len(room), STUCK):
        giver = room[-1 - stuck][1]  # the emptiest that has not failed since the last exchange
        found = _exchange(giver, bins, fill, room, n, capacity)
        if found is None:
            stuck += 1
            continue
        stuck = 0
        taker, out, back = found
        gain = sum(n[i] for i in out) - sum(n[i] for i in back)
        bins[giver] = [i for i in bins[giver] if i not in out] + back
        bins[taker] = [i for i in bins[taker] if i not in back] + out
        changed(taker, gain)
        changed(giver, -gain)
        count -= not bins[giver]
    return [b for b in bins if b]


def _exchange(giver: int, bins: list, fill: list, room: list, n: list[int], capacity: int) -> tuple | None:
    """(taker, documents it gets, documents it gives): the exchange that drains the giver most; None without any."""
    mine = sorted(bins[giver], key=lambda i: -n[i])
    for i in mine:  # move one into the fullest bin that has room
        at = bisect_left(room, (n[i], -1))
        while at < len(room) and room[at][1] == giver:
            at += 1
        if at < len(room) and fill[room[at][1]] >= fill[giver]:
            return room[at][1], [i], []
    best, most = None, 0
    for free, k in reversed(room):  # from the most room on: no later bin gains more than its free space
        if free <= most:
            break
        if k == giver or fill[k] < fill[giver]:
            continue
        theirs = sorted(bins[k], key=lambda i: n[i])
        sizes = [n[i] for i in theirs]
        for i in mine:
            x = bisect_left(sizes, n[i] - free)  # one for one
            if x < len(sizes) and n[i] - sizes[x] > most:
                best, most = (k, [i], [theirs[x]]), n[i] - sizes[x]
            for x in range(len(sizes)):  # two for one
                if 2 * sizes[x] >= n[i]:
                    break
                y = bisect_left(sizes, n[i] - free - sizes[x], x + 1)
                if y < len(sizes) and n[i] - sizes[x] - sizes[y] > most:
                    best, most = (k, [i], [theirs[x], theirs[y]]), n[i] - sizes[x] - sizes[y]
    return best


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset there of each piece."""
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, members in enumerate(local_search(lengths, best_fit(lengths, capacity), capacity)):
        at = 0
        for i in members:
            seq[i], offset[i] = b, at
            at += int(lengths[i])
    return seq, offset


def pack_documents(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    eos: int | None = 0, with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens, a row per piece.

    Columns: key, piece, start, length, ids_crc32, (ids,) sequence_id, offset.  tokenizer is the path of a
    tokenizers file, the same on every worker.  A null or empty text is the end token alone (without one it has no
    piece).  Rows with equal keys, repeated rows and null keys are packed as rows of their own; other columns are
    ignored; an empty table gives an empty result.  Pieces of full length are sequences by themselves.
    """
    pieces = written(token_pieces(docs, tokenizer, key, text, capacity, eos, with_ids), "pieces")
    full = pieces.where(F.col("length") == capacity)
    rest = pieces.where(F.col("length") < capacity)
    groups = -(-rest.count() // GROUP_PIECES) or 1
    # sequences are numbered inside a group; full ones follow after all groups
    kind = dict(docs.dtypes)[key]
    room = 1 << 20
    narrow = rest.select("__doc", "piece", "length", F.pmod(F.xxhash64("__doc", "piece"), F.lit(groups)).alias("__group"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__doc", "piece"], kind="stable").reset_index(drop=True)
        seq, offset = pack_lengths(rows["length"].to_numpy(), capacity)
        return pd.DataFrame(
            {"__doc": rows["__doc"], "piece": rows["piece"], "sequence_id": seq + rows["__group"] * room, "offset": offset}
        )

    placed = narrow.groupBy("__group").applyInPandas(pack, "__doc long, piece int, sequence_id long, offset long")
    out = [F.col(key).cast(kind).alias(key), "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    alone = full.select(
        *out,
        F.lit(0).cast("long").alias("offset"),
        (F.lit(groups * room) + F.monotonically_increasing_id()).alias("sequence_id"),
    )
    joined = rest.join(placed, ["__doc", "piece"]).select(*out, "offset", "sequence_id")
    cols = [key, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset"]
    return joined.select(cols).unionByName(alone.select(cols))
