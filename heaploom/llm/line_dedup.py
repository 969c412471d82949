"""Line dedup: lines spread over many sites are boilerplate and go, but for their first copy.

A HyperLogLog sketch of sites per line hash is merged by aggregation, map side first.  The sketch counts
occupied registers, never more than there are sites, so an estimate that needs `sites` occupied registers is
proof enough; lines on at least that many rows whose estimate stays below it are near the threshold and get
an exact distinct count.  The decision is therefore exact.

The copies of a very common line are met where they stand (meet), those of all others are shuffled.  Texts are shuffled once, to
the numbers of the lines that they lose.  The plan is the same at every size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, meet, written

#: A line on this many distinct sites or more is boilerplate.
SITES = 5
#: Relative error of the sketch; it gives 128 registers.
ERROR = 0.1
REGISTERS = 128

_SPACE = " \t\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without white space (ASCII) at its ends."""
    return F.trim(line, F.lit(_SPACE))


def spread(lines: DataFrame, sites: int = SITES) -> tuple[DataFrame, int]:
    """Boilerplate lines, (h1, h2, c, first_doc) of lines (h1, h2, site, doc) on at least `sites` sites, and the rows of all lines.

    A null site counts as one site of its own.  c counts rows, first_doc is the smallest doc.
    """
    seen = lines.groupBy("h1", "h2").agg(
        F.count("*").alias("c"),
        F.approx_count_distinct("site", ERROR).alias("about"),
        F.min("doc").alias("first_doc"),
    )
    # the least estimate that `sites` occupied registers give, in the range where the sketch counts linearly
    certain = math.ceil(REGISTERS * math.log(REGISTERS / (REGISTERS - sites)) - 0.5) if sites < REGISTERS // 2 else None
    seen = written(seen.where(F.col("c") >= sites), "spread")
    total = lines.count()
    is_sure = F.col("about") >= certain if certain is not None else F.lit(False)
    near = seen.where(~is_sure).select("h1", "h2", "c", "first_doc")
    exact = meet(lines.select("h1", "h2", "site"), near.select("h1", "h2", "c"), ["h1", "h2"], total).select("h1", "h2", "site").distinct()
    exact = exact.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("h1", "h2")
    found = seen.where(is_sure).select(near.columns).unionByName(near.join(exact, ["h1", "h2"], "left_semi"))
    out = written(found, "boilerplate")
    discard(seen)
    return out, total


def remove_boilerplate(
    docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES, keep_first: bool = True
) -> DataFrame:
    """docs with boilerplate lines taken out of text, plus n_lines and n_removed; a row for every row.

    Lines are cut at line feeds and compared without white space at their ends; empty lines never go.  With keep_first, the
    document with the smallest key keeps a line (all its copies there), so nothing is lost from the corpus; of
    rows with equal keys all keep it, and a null key never does.  A null text stays null with 0 lines; a text
    whose lines all go becomes empty.  Repeated rows on one site do not spread a line.  Other columns stay as they are,
    but for such that are called n_lines or n_removed, which are replaced.
    """
    own = docs.columns
    mine = free_name(own, "__gone")
    # rows are told apart by what decides their result, so equal rows may share a number
    marks = {f"{mine}1": F.xxhash64(key, text), f"{mine}2": F.hash(text, key)}
    rows = docs.select(F.col(key).alias("doc"), F.col(site).cast("string").alias("site"), *[c.alias(k) for k, c in zip(("r1", "r2"), marks.values())], F.split(F.col(text), "\n", -1).alias("__l"))
    line = line_key(F.col("__x"))
    lines = (
        rows.select("doc", "site", "r1", "r2", F.posexplode("__l").alias("at", "__x"))
        .select("doc", "site", "r1", "r2", "at", line.alias("line"))
        .where("line != ''")
        .select(
            "doc", "r1", "r2", "at",
            F.coalesce(F.concat(F.lit("s"), "site"), F.lit("n")).alias("site"),
            F.xxhash64("line").alias("h1"),
            F.hash("line", F.lit(1)).alias("h2"),
        )
    )
    lines = written(lines, "lines")
    bad, total = spread(lines, sites)
    hit = meet(lines.drop("site"), bad, ["h1", "h2"], total)
    if keep_first:
        hit = hit.where("doc is null or first_doc is null or doc != first_doc")
    # what each row loses: bounded by its own lines
    gone = hit.groupBy(*[F.col(r).alias(k) for r, k in zip(("r1", "r2"), marks)]).agg(F.collect_set("at").alias(mine))
    gone = written(gone, "gone")
    discard(lines, bad)
    joined = docs.withColumns(marks).join(gone.hint("merge"), list(marks), "left")
    lines_col = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines_col, lambda x, i: ~F.array_contains(F.col(mine), i))
    new = F.when(F.col(mine).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines_col)).cast("long")
    removed = F.when(F.col(mine).isNull(), 0).otherwise(F.size(mine)).cast("long")
    rest = [F.col(c) for c in own if c not in (text, "n_lines", "n_removed")]
    return joined.select(*rest, new.alias(text), n.alias("n_lines"), removed.alias("n_removed"))
