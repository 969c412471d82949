"""Heap blocks: referrers and chains of them, traces, report diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import frame_path, frame_text

# Frames of allocators, stripped from the start of traces.
ALLOCATORS = [
    "malloc (",
    "replace_malloc",
    "replace_calloc",
    "replace_realloc",
    "replace_memalign",
    "replace_posix_memalign",
    "malloc_zone_malloc",
    "moz_xmalloc",
    "moz_xcalloc",
    "moz_xrealloc",
    "operator new(",
    "operator new[](",
    "g_malloc",
    "g_slice_alloc",
    "callocCanGC",
    "reallocCanGC",
    "vpx_malloc",
    "vpx_calloc",
    "vpx_realloc",
    "vpx_memalign",
    "js_malloc",
    "js_calloc",
    "js_realloc",
    "pod_malloc",
    "pod_calloc",
    "pod_realloc",
    "nsTArrayInfallibleAllocator::Malloc",
    "???",
]
MOST_FRAMES = 24
# End of fixed values.
WORD = 8


def referrers(blocks: DataFrame, addr: str) -> DataFrame:
    """(addr, req, alloc, offsets): blocks that hold the address, and at which bytes."""
    at = blocks.select("addr", "req", "alloc", F.posexplode("contents").alias("pos", "to")).where(F.col("to") == addr)
    return at.groupBy("addr", "req", "alloc").agg(F.array_sort(F.collect_list((F.col("pos") * WORD).cast("long"))).alias("offsets"))


def element_offsets(rows: DataFrame, key: str, array: str) -> DataFrame:
    """(key, value, offset): every element with its byte offset."""
    return rows.select(key, F.posexplode(array).alias("pos", "value")).select(key, "value", (F.col("pos") * WORD).cast("long").alias("offset"))


def referrer_chain(blocks: DataFrame, addr: str, most: int = 1000) -> tuple[list[str], str]:
    """Follow the only referrer from block to block: the chain, and why it ends (none, several, loop or limit)."""
    chain = [addr]
    for _ in range(most):
        found = referrers(blocks, chain[-1]).select("addr").limit(2).collect()
        if not found:
            return chain, "none"
        if len(found) > 1:
            return chain, "several"
        if found[0]["addr"] in chain:
            return chain, "loop"
        chain.append(found[0]["addr"])
    return chain, "limit"


def block_info(blocks: DataFrame, addr: str) -> DataFrame:
    """(offset, value, to_req): the words of a block, with the size of the block each points at."""
    words = blocks.where(F.col("addr") == addr).select(F.posexplode("contents").alias("pos", "value"))
    to = blocks.select(F.col("addr").alias("value"), F.col("req").alias("to_req"))
    return words.join(to, "value", "left").select((F.col("pos") * WORD).cast("long").alias("offset"), "value", "to_req")


def trace_frames(traces: DataFrame, frames: DataFrame, length: int = 150) -> DataFrame:
    """(trace, frames): the frames of each trace in order, trimmed for print."""
    named = traces.join(frames, "frame").groupBy("trace").agg(F.array_sort(F.collect_list(F.struct("pos", frame_text("text", length).alias("t")))).alias("f"))
    return named.select("trace", F.transform("f", lambda x: x["t"]).alias("frames"))


def without_allocators(frames: Column | str, patterns: list[str] = ALLOCATORS) -> Column:
    """Frames from the first on that names no allocator; a trace of allocators only stays whole."""
    f = F.col(frames) if isinstance(frames, str) else frames
    alloc = lambda x: _any(x, patterns)
    first = F.aggregate(
        F.transform(f, lambda x, i: F.when(alloc(x), F.lit(1 << 30)).otherwise(i)), F.lit(1 << 30), lambda a, x: F.least(a, x)
    )
    return F.when(first == 1 << 30, f).otherwise(F.slice(f, first + 1, F.greatest(F.size(f), F.lit(1))))


def _any(x: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.contains(x, F.lit(p))
    return out


def limit_frames(frames: Column | str, most: int | None = None) -> Column:
    f = F.col(frames) if isinstance(frames, str) else frames
    if most is None:
        return f
    if not 1 <= most <= MOST_FRAMES:
        raise ValueError(f"{most} is not in 1..{MOST_FRAMES}")
    return F.slice(f, 1, most)


def without_boring(frames: Column | str, pattern: str) -> Column:
    """Frames that the pattern does not match at their start, wherever they stand."""
    f = F.col(frames) if isinstance(frames, str) else frames
    return F.filter(f, lambda x: ~F.regexp_like(x, F.lit(f"^(?:{pattern})")))


def report_diff(old: DataFrame, new: DataFrame, top: int = 4) -> DataFrame:
    """(frames, blocks, bytes): stacks that grew from old to new (num_blocks, num_bytes, frames), the most first.

    A stack is known by the paths of its frames; of repeated stacks the last record counts.
    """

    def keyed(r: DataFrame) -> DataFrame:
        key = F.array_join(F.transform("frames", frame_path), "{")
        order = "record" if "record" in r.columns else "num_bytes"
        return r.groupBy(key.alias("stack")).agg(F.max_by(F.struct("num_blocks", "num_bytes", "frames"), order).alias("x"))

    n, o = keyed(new), keyed(old).select("stack", F.col("x").alias("y"))
    both = n.join(o, "stack", "left")
    grown = both.select(
        F.col("x.frames").alias("frames"),
        (F.col("x.num_blocks") - F.coalesce("y.num_blocks", F.lit(0))).alias("blocks"),
        (F.col("x.num_bytes") - F.coalesce("y.num_bytes", F.lit(0))).alias("bytes"),
    )
    return grown.where("bytes > 0").orderBy(F.desc("bytes"), F.array_join("frames", "{")).limit(top)


def block_graph_bytes(graph: DataFrame) -> DataFrame:
    """(bytes): two words and one per reference, for each block."""
    return graph.agg(F.sum((F.size("contents") + 2) * WORD).cast("long").alias("bytes"))


def find_blocks(live: DataFrame, size: int, pattern: str, depth: int) -> DataFrame:
    """(block, frame_depth): blocks of a size with a matching frame at most so deep, by depth."""
    at = live.where(F.col("req") == size).select("block", F.posexplode("frames").alias("pos", "frame"))
    hit = at.where(F.col("frame").rlike(pattern) & (F.col("pos") <= depth))
    return hit.groupBy("block").agg(F.min("pos").alias("frame_depth")).orderBy("frame_depth", "block")


def typed_stacks(live: DataFrame, types: DataFrame) -> DataFrame:
    """(block, type): the types one of whose patterns is in a frame of the block's trace; types are few and sent to all."""
    t = types.select("type", F.explode("patterns").alias("p"))
    f = live.select("block", F.explode("frames").alias("frame"))
    return f.join(F.broadcast(t), F.contains(F.col("frame"), F.col("p"))).select("block", "type").distinct()
