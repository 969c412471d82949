"""Shared pieces of the corpus operators: cut points in the shared folder, tokens as Arrow arrays, components."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import discard, written

#: A-Z to a-z, all other bytes as they are; one byte to one byte, so offsets into a text buffer stay valid.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The same, and every ASCII byte that is no letter or digit becomes a space.
ASCII_WORDS = bytes(
    b if b >= 128 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
#: Bytes of text that are tokenised at once in a worker, whatever the size of the batch that Spark sends.
SLICE_BYTES = 4_000_000


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys at most that meet() sends to every worker.
HOT = 10_000


def meet(rows: DataFrame, wanted: DataFrame, on: list[str], total: int) -> DataFrame:
    """Rows joined with wanted, a row per key with c, how many of all `total` rows have the key; c is left out.

    Keys that make up a share of 1 / HOT of all rows are HOT at most: these are sent to every worker, so the rows of
    a very common key are met where they stand; all others are shuffled.  The plan is the same at every size.
    """
    hot = F.col("c") * HOT >= F.lit(total)
    often = F.broadcast(wanted.where(hot).drop("c"))  # HOT rows at most
    seldom = wanted.where(~hot).drop("c").hint("merge")
    rest = rows.join(often.select(*on), on, "left_anti").join(seldom, on)
    return rows.join(often, on).unionByName(rest)


def free_name(columns: list[str], name: str) -> str:
    """A name that begins no column's name."""
    while any(c.lower().startswith(name) for c in columns):
        name += "_"
    return name


def crc_mod(col: Column | str, n: int) -> Column:
    """crc32 of the decimal text of an integer key, modulo n (null key: null)."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.crc32(c.cast("string").cast("binary")) % F.lit(n)).cast("int")


def give_back() -> None:
    """Return freed memory of a worker to the system: workers live on between the stages of a job."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def text_slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES, tokenizers: bool = False
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no slice but one of a single row holds more than `most` bytes of text, or so.

    What a tokenizer remembers in this worker is dropped, except for callers that tokenise.
    """
    if not tokenizers and "tokenizers" in sys.modules:
        vars(sys.modules["tokenizers"]).pop("_heaploom", None)
        give_back()
    try:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cut = np.cumsum(size) // most
            edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), n]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    yield batch.slice(a, b - a)
    finally:
        give_back()


def flat_words(texts: pa.Array, table: bytes = ASCII_LOWER) -> tuple[pa.Array, np.ndarray]:
    """Words (runs of bytes other than ASCII white space) of all texts in a row, and where each text's words begin.

    Text i has words[starts[i]:starts[i + 1]]; a null text has none.  table maps bytes beforehand.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4)
    data = texts.buffers()[2]
    raw = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if data is not None else b""
    plain = pa.StringArray.from_buffers(
        n, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(raw.translate(table))
    )
    lists = pc.ascii_split_whitespace(plain)
    flat, ends = lists.values, lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    keep = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), keep[ends].astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(mul)
        x ^= x >> np.uint64(31)
    return x


def hashed_words(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; every distinct word is hashed once."""
    import xxhash

    if not len(flat):
        return np.zeros(0, np.uint64)
    coded = flat.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64)
    return table[coded.indices.to_numpy()]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (node, component), component the smallest node reachable.

    Alternating large-star and small-star steps: each step is one or two grouped shuffles over links and a hub's
    links are never gathered into one array; every round is written to the shared folder.  Nodes without a link
    to another node are not returned.  Null ends are dropped.
    """
    x = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v")
    edges = written(x.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    while True:
        # large star: every larger neighbour of a node gets the node's smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, written(large.distinct(), "cc")
        discard(old)
        # small star: every smaller neighbour of a node, and the node, get the smallest of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
