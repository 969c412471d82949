"""Heap-block reports: JSON with blocks and stack traces, brace-structured and divider-structured text, raw block graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.labels import address, block_list, plain_int
from ..plans.cut import written
from ..schema import DMD
from .lines import fill_down, read_lines, sum_above

# What the report formats say.
JSON_VERSION = 4
BLOCKS_LINE = r"^~?([0-9,]+) blocks? in heap block record.*"
BYTES_LINE = r"^~?([0-9,]+) bytes \(~?[0-9,]+ requested"
OLD_BLOCKS_LINE = r"^Unreported: ~?([0-9,]+) blocks? in stack trace record [0-9,]+ of [0-9,]+$"
OLD_BYTES_LINE = r"^ ~?([0-9,]+) bytes \(~?[0-9,]+ requested / ~?[0-9,]+ slop\)$"
# End of fixed values.


def _json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, depth, section, text, version, net, quotes): the objects of a JSON report one by one, without a task that sees the whole.

    Text is cut before each `{`.  Counted over the pieces above, quotes tell which cuts fell into a string, and brackets how deep a piece lies;
    the last key of the outer object before a piece is its section, with `[` if its value is an array.  Pieces of one
    string or of one object of a section are joined again: text is an object of a section, and what follows it.  version is what follows
    that key in the outer object; net and quotes count brackets and quotes.
    """
    pieces = read_lines(spark, path, start="{").withColumn("quotes", F.length(F.regexp_replace("value", r'(?s)\\.|[^"\\]+', "")))
    pieces = sum_above(pieces, "quotes_above", F.col("quotes"))
    within = F.col("quotes_above") % 2 == 1
    whole = F.when(within, F.concat(F.lit('"'), "value")).otherwise(F.col("value"))
    bare = F.regexp_replace(whole, r'(?s)("\w+"\s*:)|"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\z)', "$1")  # keys and brackets stay
    net = F.length(F.regexp_replace("bare", r"[^{\[]", "")) - F.length(F.regexp_replace("bare", r"[^}\]]", ""))
    pieces = pieces.withColumn("bare", bare).withColumn("net", net)
    pieces = sum_above(pieces, "depth", F.col("net"))
    tail = r'"(\w+)"\s*:\s*(\[?)\s*$'
    array = F.regexp_extract("bare", tail, 2)
    last = ((F.col("quotes_above") + F.col("quotes")) % 2 == 0) & F.col("bare").rlike(tail) & (F.col("depth") + F.col("net") == 1 + F.length(array))
    pieces = fill_down(pieces, {"section": F.when(last, F.concat(F.regexp_extract("bare", tail, 1), array))}, above=True)
    opens = ~within & F.col("value").startswith("{")
    deep = F.col("depth") + opens.cast("int") - 1  # brackets to close until the outer object goes on
    closed = F.when(deep > 0, F.concat(F.lit(r"[^}]*\}"), F.repeat(F.lit(r"[^}\]]*[}\]]"), (deep - 1).cast("int")))).otherwise("")
    rest = F.call_function("regexp_extract", "bare", F.concat(F.lit("(?s)^"), closed, F.lit("(.*)$")), F.lit(1))
    pieces = pieces.withColumn("version", F.regexp_extract(rest, r'"version"\s*:\s*(-?\d+)', 1).try_cast("int"))
    first = opens & (F.col("depth") <= F.when(F.col("section").endswith("["), 2).otherwise(1))
    pieces = sum_above(pieces.drop("bare").withColumn("first", first.cast("int")), "object", F.col("first"))
    return pieces.groupBy("log_id", (F.col("object") + F.col("first")).alias("object")).agg(
        F.min_by("depth", "ord").alias("depth"),
        F.min_by("section", "ord").alias("section"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), "").alias("text"),
        F.max("version").alias("version"),
        F.sum("net").alias("net"),
        F.sum("quotes").alias("quotes"),
    )


def read_dmd_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """blocks(addr, req, alloc, contents), traces(trace, pos, frame), frames(frame, text) of a report, gzipped or not.

    Fails for another version, for sampled reports, whose blocks have no addresses, and for a report that is cut off.  A report may be a
    folder of part files; blocks are read one by one, the trace table and the frame table each as one row.
    """
    objects = written(_json_objects(spark, path), "objects")
    sample = F.when((F.col("depth") == 1) & (F.col("section") == "invocation"), F.from_json("text", "sampleBelowSize int")["sampleBelowSize"])
    heads = objects.groupBy("log_id").agg(
        F.max("version").alias("version"), F.max(sample).alias("sample"), F.sum("net").alias("net"), F.sum("quotes").alias("quotes")
    ).collect()  # a row per report
    for head in heads or [None]:
        if head is None or head["version"] != JSON_VERSION or head["net"] or head["quotes"] % 2:
            raise ValueError(f"report version {head and head['version']}, not a whole one of {JSON_VERSION}")
        if (head["sample"] or 1) > 1:
            raise ValueError("sampled reports have no addresses")

    def table(section: str, depth: int, kind: str) -> DataFrame:
        mine = objects.where((F.col("section") == section) & (F.col("depth") == depth) & F.col("text").startswith("{"))
        return mine.select(F.from_json("text", kind).alias("b"))

    fields = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(DMD)}
    blocks = table("blockList[", 2, fields["blockList"].removeprefix("array<").removesuffix(">")).select(
        address("b.addr").alias("addr"),
        "b.req",
        "b.alloc",
        F.transform(F.coalesce("b.contents", F.array().cast("array<string>")), address).alias("contents"),
    )
    traces = table("traceTable", 1, fields["traceTable"]).select(F.explode("b").alias("trace", "ids"))
    frames = table("frameTable", 1, fields["frameTable"]).select(F.explode("b").alias("frame", "text"))
    return {"blocks": blocks, "traces": traces.select("trace", F.posexplode("ids").alias("pos", "frame")), "frames": frames}


def _records(lines: DataFrame, start: str, starts) -> DataFrame:
    """Lines with the ord of the record line above them."""
    return fill_down(lines, {start: F.when(starts, F.col("ord"))}).where(F.col(start).isNotNull())


def read_diff_report(spark: SparkSession, path: str, section: str = "Unreported", boring: str | None = None) -> DataFrame:
    """(record, num_blocks, num_bytes, frames) of the brace format: records `section {`, with numbers, and frames in `Allocated at {`.

    Frames that match boring (at their start) are left out.
    """
    lines = read_lines(spark, path).where(~F.col("value").startswith("#") & ~F.col("value").rlike(r"^\w*$"))
    value = F.trim("value")
    depth_mark = F.when(value.endswith("{"), F.trim(F.expr("rtrim('{', value)"))).when(value.endswith("}"), F.lit("}"))
    owned = _records(lines, "record", value.rlike(r"^[^{]*\{$") & value.startswith(section))
    inner = fill_down(owned, {"scope": depth_mark}).withColumn("t", value)
    data = inner.where(~F.col("t").endswith("{") & ~F.col("t").endswith("}"))
    in_trace = F.trim("scope").startswith("Allocated at")
    frame = in_trace if boring is None else in_trace & ~F.col("t").rlike(f"^(?:{boring})")
    numbers = F.trim("scope").startswith(section)
    return data.groupBy("log_id", "record").agg(
        F.max(F.when(numbers & F.col("t").rlike(BLOCKS_LINE), plain_int(F.regexp_extract("t", BLOCKS_LINE, 1)))).alias("num_blocks"),
        F.max(F.when(numbers & F.col("t").rlike(BYTES_LINE), plain_int(F.regexp_extract("t", BYTES_LINE, 1)))).alias("num_bytes"),
        F.transform(F.array_sort(F.collect_list(F.when(frame, F.struct("ord", "t")))), lambda x: x["t"]).alias("frames"),
    ).drop("log_id")


def read_live_report(spark: SparkSession, path: str) -> DataFrame:
    """(record, block, req, frames) of `Live {` records: a row for each block of the record's block list."""
    lines = read_lines(spark, path).where(~F.col("value").startswith("#") & ~F.col("value").rlike(r"^\w*$"))
    value = F.trim("value")
    owned = _records(lines, "record", value.rlike(r"^Live[^{]*\{$"))
    inner = fill_down(owned, {"scope": F.when(value.endswith("{") | value.endswith("}"), value)}).withColumn("t", value)
    data = inner.where(~F.col("t").endswith("{") & ~F.col("t").endswith("}"))
    rec = data.groupBy("log_id", "record").agg(
        F.max_by(block_list("t"), F.when(block_list("t").isNotNull(), F.col("ord"))).alias("blocks"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("scope").startswith("Allocated at"), F.struct("ord", "t")))), lambda x: x["t"]).alias("frames"),
    )
    return rec.select("record", F.explode("blocks").alias("b"), "frames").select("record", F.col("b.addr").alias("block"), F.col("b.req").alias("req"), "frames")


def read_divider_report(spark: SparkSession, path: str, divider: str | None = None, sections: tuple[str, ...] = ("Unreported",)) -> DataFrame:
    """(record, num_blocks, num_bytes, frames) of the divider format: a section's name stands between two dividers.

    Numbers may have thousands commas.
    """
    lines = read_lines(spark, path).where(~F.col("value").startswith("#"))
    is_div = F.col("value") == divider if divider else F.col("value").rlike("^[-=]{10,}$")
    wanted = F.lit(False)
    for s in sections:
        wanted = wanted | F.col("value").startswith(s)
    named = fill_down(lines, {"above": F.when(is_div, F.col("ord"))})
    title = (F.col("ord") == F.col("above") + 1) & ~is_div & (F.trim("value") != "") & ~F.col("value").rlike(OLD_BLOCKS_LINE)
    named = fill_down(named, {"section": F.when(title, F.when(wanted, "1").otherwise("0"))})
    rows = named.where((F.col("section") == "1") & ~is_div & ~title)
    owned = _records(rows, "record", F.col("value").rlike(OLD_BLOCKS_LINE))
    inner = fill_down(owned, {"trace_from": F.when(F.trim("value") == "Allocated at", F.col("ord"))})
    t = F.trim("value")
    frame = (F.col("trace_from") > F.col("record")) & (F.col("ord") > F.col("trace_from")) & (t != "")
    return inner.groupBy("log_id", "record").agg(
        F.max(F.when(F.col("value").rlike(OLD_BLOCKS_LINE), plain_int(F.regexp_extract("value", OLD_BLOCKS_LINE, 1)))).alias("num_blocks"),
        F.max(F.when(F.col("value").rlike(OLD_BYTES_LINE), plain_int(F.regexp_extract("value", OLD_BYTES_LINE, 1)))).alias("num_bytes"),
        F.transform(F.array_sort(F.collect_list(F.when(frame, F.struct("ord", t.alias("t"))))), lambda x: x["t"]).alias("frames"),
    ).drop("log_id")


def read_block_graph(spark: SparkSession, path: str, distinct: bool = False) -> DataFrame:
    """(block, contents): the words of each line; distinct drops repeated ones."""
    w = F.split(F.trim("value"), r"\s+")
    rest = F.slice("w", 2, F.greatest(F.lit(0), F.size("w") - 1))
    rows = read_lines(spark, path).where(F.trim("value") != "").select(w.alias("w"))
    return rows.select(F.col("w")[0].alias("block"), (F.array_distinct(rest) if distinct else rest).alias("contents"))


def read_stack_types(spark: SparkSession, path: str) -> DataFrame:
    """(type, patterns): `<type>` lines, each followed by its patterns."""
    lines = read_lines(spark, path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    head = F.when(F.col("value").startswith("<"), F.regexp_extract("value", "^<(.*)>", 1))
    owned = fill_down(lines, {"type": head}).where(~F.col("value").startswith("<"))
    return owned.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]).alias("patterns"))
