"""Garbage-collector logs: current format, compartment format, zones and arenas, strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import is_gray_label, string_length, string_text, string_type
from ..model import DumpTables
from ..plans.cut import written
from .cc_log import weak_maps_of
from .lines import fill_down, read_lines, sections

# The line formats of garbage-collector logs.
NODE = r"^((?:0x)?[a-fA-F0-9]+) (?:(B|G|W) )?(.*)$"
EDGE = r"^> ((?:0x)?[a-fA-F0-9]+) (?:(B|G|W) )?(.*)$"
ROOT = r"^((?:0x)?[a-fA-F0-9]+) (?:(B|G|W) )?(.*)$"
COMP_NODE = r"^(0x[a-fA-F0-9]+) (0x[a-fA-F0-9]+) (.*)$"
COMP_ROOT = r"^(0x[a-fA-F0-9]+) (.*)$"
COMP_EDGE = r"^> (0x[a-fA-F0-9]+) (.*)$"
ZONE = r"^# zone (0x[a-fA-F0-9]+)$"
COMPARTMENT = r"^# compartment (.+) \[in zone ((?:0x)?[a-fA-F0-9]+)\]$"
ARENA = r"^# arena allockind=(\d+) size=(\d+)"
# End of fixed values.


def ordered_roots(rows: DataFrame, version: str = "current", last_wins: bool = False) -> DataFrame:
    """(addr, is_black, label, ord): roots are gray from the first gray-looking label on; the first (or last)
    row of an address counts.  rows: addr, label, ord."""
    switch = rows.where(is_gray_label("label", version)).agg(F.min("ord").alias("switch"))
    marked = rows.join(F.broadcast(switch)).withColumn("is_black", F.col("switch").isNull() | (F.col("ord") < F.col("switch")))
    pick = F.max_by if last_wins else F.min_by
    one = marked.groupBy("addr").agg(pick(F.struct("is_black", "label", "ord"), "ord").alias("x"))
    return one.select("addr", "x.is_black", "x.label", "x.ord")


def read_gc_log(spark: SparkSession, path: str, version: str = "current") -> DumpTables:
    """Parse a log: roots and weak maps above the separator, nodes and edges below.  Text is latin-1."""
    lines = written(sections(read_lines(spark, path, "ISO-8859-1")), "gc-lines")
    value = F.col("value")
    head = lines.where((F.col("section") == 0) & ~F.col("is_mark") & ~value.startswith("#"))
    body = lines.where((F.col("section") == 1) & ~F.col("is_mark") & ~value.startswith("#"))
    roots = head.where(value.rlike(ROOT)).select(
        F.regexp_extract("value", ROOT, 1).alias("addr"), F.regexp_extract("value", ROOT, 3).alias("label"), "ord"
    )
    is_node = value.rlike(NODE) & ~value.startswith(">")
    nodes = body.where(is_node).select(
        F.regexp_extract("value", NODE, 1).alias("addr"),
        F.nullif(F.regexp_extract("value", NODE, 2), F.lit("")).alias("color"),
        F.regexp_extract("value", NODE, 3).alias("label"),
        "ord",
    )
    owned = fill_down(body, {"src": F.when(is_node, F.regexp_extract("value", NODE, 1))})
    edges = owned.where(value.rlike(EDGE)).select(
        "src", F.regexp_extract("value", EDGE, 1).alias("dst"), F.regexp_extract("value", EDGE, 3).alias("label"), "ord"
    )
    bad = head.where(~value.rlike(ROOT) & ~value.startswith("WeakMapEntry")).unionByName(body.where(~is_node & ~value.rlike(EDGE)))
    return DumpTables(
        nodes=written(nodes, "nodes"),
        edges=written(edges, "edges"),
        weak_maps=weak_maps_of(head),
        roots=ordered_roots(roots, version),
        corrupt=bad.where(value != "").select("ord", "value"),
    )


def read_gc_compartment_log(spark: SparkSession, path: str) -> DumpTables:
    """The older three-section format: nodes have a compartment in place of a colour; an address's last root counts."""
    lines = written(sections(read_lines(spark, path, "ISO-8859-1")), "comp-lines")
    value = F.col("value")
    part = lambda n: lines.where((F.col("section") == n) & ~F.col("is_mark") & ~value.startswith("#"))
    roots = part(1).where(value.rlike(COMP_ROOT)).select(
        F.regexp_extract("value", COMP_ROOT, 1).alias("addr"), F.regexp_extract("value", COMP_ROOT, 2).alias("label"), "ord"
    )
    is_node = value.rlike(COMP_NODE) & ~value.startswith(">")
    nodes = part(2).where(is_node).select(
        *[F.regexp_extract("value", COMP_NODE, i).alias(n) for i, n in ((1, "addr"), (2, "compartment"), (3, "label"))], "ord"
    )
    owned = fill_down(part(2), {"src": F.when(is_node, F.regexp_extract("value", COMP_NODE, 1))})
    edges = owned.where(value.rlike(COMP_EDGE)).select(
        "src", F.regexp_extract("value", COMP_EDGE, 1).alias("dst"), F.regexp_extract("value", COMP_EDGE, 2).alias("label"), "ord"
    )
    return DumpTables(nodes=nodes, edges=edges, roots=ordered_roots(roots, "compartment", last_wins=True))


def compartment_names(spark: SparkSession, path: str) -> DataFrame:
    """(compartment, name): the first section of the compartment format."""
    lines = sections(read_lines(spark, path, "ISO-8859-1")).where("section = 0 and not is_mark")
    rows = lines.where(F.col("value").rlike(COMP_ROOT))
    return rows.select(F.regexp_extract("value", COMP_ROOT, 1).alias("compartment"), F.regexp_extract("value", COMP_ROOT, 2).alias("name"))


def read_zones(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """zones(zone), compartments(zone, compartment), arenas(zone, arena_no, alloc_kind, thing_size, num_things) from the
    comment lines below the roots."""
    lines = written(sections(read_lines(spark, path, "ISO-8859-1")).where("section >= 1 and not is_mark"), "zone-lines")
    value = F.col("value")
    zone = F.when(value.rlike(ZONE), F.regexp_extract("value", ZONE, 1))
    arena = F.when(value.rlike(ARENA), F.col("ord")).when(value.rlike(ZONE), F.lit(-1))
    owned = written(fill_down(lines, {"zone": zone, "arena_no": arena}), "zones")
    heads = owned.where(value.rlike(ARENA)).select(
        "zone", "arena_no",
        F.regexp_extract("value", ARENA, 1).cast("int").alias("alloc_kind"), F.regexp_extract("value", ARENA, 2).cast("int").alias("thing_size"),
    )
    things = owned.where(value.rlike(NODE) & ~value.startswith("#") & ~value.startswith(">") & (F.col("arena_no") >= 0))
    things = things.groupBy("arena_no").agg(F.count("*").alias("num_things"))
    arenas = heads.join(things, "arena_no", "left").withColumn("num_things", F.coalesce("num_things", F.lit(0)))
    return {
        "zones": owned.where(value.rlike(ZONE)).select("zone"),
        "compartments": owned.where(value.rlike(COMPARTMENT)).select(
            F.regexp_extract("value", COMPARTMENT, 2).alias("zone"), F.regexp_extract("value", COMPARTMENT, 1).alias("compartment")
        ),
        "arenas": arenas.select("zone", "arena_no", "alloc_kind", "thing_size", "num_things"),
    }


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """(addr, color, type, length, truncated, text) of string nodes; ropes and substrings are none."""
    node = r"^((?:0x)?[a-fA-F0-9]+) (B|G|W) (string <.*)$"
    lines = read_lines(spark, path, "ISO-8859-1").where(F.col("value").rlike(node))
    rows = lines.select(*[F.regexp_extract("value", node, i).alias(n) for i, n in ((1, "addr"), (2, "color"), (3, "label"))])
    rows = rows.select(
        "addr", "color", string_type("label").alias("type"), string_length("label").alias("length"),
        F.col("label").contains(" (truncated)>").alias("truncated"), string_text("label").alias("text"),
    )
    return rows.where("type is not null")
