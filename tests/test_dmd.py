"""Heap-block reports: own fixtures."""

import gzip
import json

import pytest

from heaploom.operators import blocks
from heaploom.sources import dmd

REPORT = {
    "version": 4,
    "invocation": {"sampleBelowSize": 1},
    "blockList": [
        {"addr": "0x10", "req": 32, "alloc": "A", "contents": ["0", "20", "0x20"]},
        {"addr": "20", "req": 16, "alloc": "B", "contents": ["30"]},
        {"addr": "30", "req": 8, "alloc": "A"},
        {"addr": "40", "req": 8, "alloc": "B", "contents": ["50"]},
        {"addr": "50", "req": 8, "alloc": "B", "contents": ["40"]},
    ],
    "traceTable": {"A": ["f1", "f2"], "B": ["f1"]},
    "frameTable": {"f1": "#00: malloc (x)", "f2": "#01: main (y)"},
}

BRACE = """# comment
Unreported {
  ~2 blocks in heap block record 1 of 2
  ~1,024 bytes (~1,000 requested / ~24 slop)
  Allocated at {
    one /local/x.cpp:1
    two /local/y.cpp:2
  }
}

Unreported {
  1 block in heap block record 2 of 2
  10 bytes (10 requested / 0 slop)
  Allocated at {
    three /local/z.cpp:3
  }
}
"""

LIVE = """Live {
  blocks (requested bytes / slop bytes): 0xa (16 / 0) 0xb (8 / 8)
  Allocated at {
    make thing
  }
}
"""

OLD = """# a toy run of a garden program
options: none
------------------------------------------------------------------
Unreported stack trace records
------------------------------------------------------------------

Unreported: ~6 blocks in stack trace record 1 of 2
 ~3,072 bytes (~3,000 requested / ~72 slop)
 75.00% of the heap (75.00% cumulative);  80.00% of unreported (80.00% cumulative)
 Allocated at
   plant the seeds
   dig the bed

Unreported: 3 blocks in stack trace record 2 of 2
 48 bytes (40 requested / 8 slop)
 25.00% of the heap (100.00% cumulative);  20.00% of unreported (100.00% cumulative)
 Allocated at
   water the bed

------------------------------------------------------------------
Reported stack trace records
------------------------------------------------------------------
"""


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_json(spark, tmp_path):
    plain, packed = tmp_path / "dmd.json", tmp_path / "dmd.json.gz"
    plain.write_text(json.dumps(REPORT))
    packed.write_bytes(gzip.compress(json.dumps(REPORT).encode()))
    for p in (plain, packed):
        r = dmd.read_dmd_json(spark, str(p))
        b = r["blocks"]
        assert [tuple(x["offsets"]) for x in blocks.referrers(b, "20").collect()] == [(8, 16)]
        assert blocks.referrer_chain(b, "30") == (["30", "20", "10"], "none")
        assert blocks.referrer_chain(b, "40")[1] == "loop"
        assert rows(blocks.block_info(b, "10").fillna({"to_req": -1}), "offset", "value", "to_req") == [(0, "0", -1), (8, "20", 16), (16, "20", 16)]
        traces = {x["trace"]: x["frames"] for x in blocks.trace_frames(r["traces"], r["frames"]).collect()}
        assert traces["A"] == ["malloc (x)", "main (y)"]
        assert traces and blocks.trace_frames(r["traces"], r["frames"]).select(blocks.without_allocators("frames").alias("f"), "trace").where("trace = 'A'").first()["f"] == ["main (y)"]
    plain.write_text(json.dumps(REPORT | {"version": 3}))
    with pytest.raises(ValueError):
        dmd.read_dmd_json(spark, str(plain))
    with pytest.raises(ValueError):
        blocks.limit_frames("frames", 25)


def test_text_reports(spark, tmp_path):
    (tmp_path / "new").write_text(BRACE)
    (tmp_path / "old").write_text(BRACE.replace("1,024", "24"))
    (tmp_path / "live").write_text(LIVE)
    (tmp_path / "oldest").write_text(OLD)
    new, old = (dmd.read_diff_report(spark, str(tmp_path / n)) for n in ("new", "old"))
    assert rows(new, "num_blocks", "num_bytes") == [(1, 10), (2, 1024)]
    diff = blocks.report_diff(old, new).collect()
    assert [(r["bytes"], len(r["frames"])) for r in diff] == [(1000, 2)]
    assert rows(dmd.read_live_report(spark, str(tmp_path / "live")), "block", "req") == [("0xa", 16), ("0xb", 8)]
    live = dmd.read_live_report(spark, str(tmp_path / "live"))
    assert rows(blocks.find_blocks(live, 16, "make", 3), "block", "frame_depth") == [("0xa", 0)]
    got = dmd.read_divider_report(spark, str(tmp_path / "oldest"))
    assert rows(got, "num_blocks", "num_bytes") == [(3, 48), (6, 3072)]
    assert sorted(len(r["frames"]) for r in got.collect()) == [1, 2]
    (tmp_path / "g").write_text("a b c b\nb\n")
    graph = dmd.read_block_graph(spark, str(tmp_path / "g"))
    assert blocks.block_graph_bytes(graph).first()["bytes"] == (5 + 2) * 8
    (tmp_path / "t").write_text("# x\n<T>\nmake\nother\n\n<U>\nnone\n")
    types = dmd.read_stack_types(spark, str(tmp_path / "t"))
    assert rows(blocks.typed_stacks(live, types), "block", "type") == [("0xa", "T"), ("0xb", "T")]


def test_json_report_in_pieces(spark, tmp_path):
    """Braces, brackets and quotes in strings, any order of sections, nested values, one line or many, part files; no task sees the whole."""
    odd = dict(REPORT, other={"a": {"b": [1, {"version": 9}]}, "s": "}]{["})
    odd["frameTable"] = {"f1": 'x::{lambda("}\\\\", [{")} "traceTable": {', "f2": ': {', "{}": "a\\\\\\", "é": '"'}
    odd["traceTable"] = {"A": ["f1", "{}"], "B": []}
    odd["blockList"] = [{"x": {"y": [{}]}, **b} for b in REPORT["blockList"]] + [{"addr": "0x60", "req": 1, "alloc": '{["', "z": {}}]
    turned = {k: odd[k] for k in reversed(odd)}
    for i, (report, indent) in enumerate([(odd, None), (turned, 1)]):
        text = json.dumps(report, indent=indent, ensure_ascii=False)
        path = tmp_path / f"r{i}.json"
        path.write_text(text)
        folder = tmp_path / f"parts{i}"
        folder.mkdir()
        lines = text.splitlines(keepends=True)
        for k in range(3):
            (folder / f"part-0000{k}-x.txt").write_text("".join(lines[k * len(lines) // 3 : (k + 1) * len(lines) // 3]))
        for p in (path, folder):
            r = dmd.read_dmd_json(spark, str(p))
            assert {x["frame"]: x["text"] for x in r["frames"].collect()} == odd["frameTable"]
            assert {(x["trace"], x["pos"], x["frame"]) for x in r["traces"].collect()} == {("A", 0, "f1"), ("A", 1, "{}")}
            got = {x["addr"]: (x["req"], x["alloc"], x["contents"]) for x in r["blocks"].collect()}
            assert len(got) == 6 and got["10"] == (32, "A", ["0", "20", "20"]) and got["60"] == (1, '{["', [])
    (tmp_path / "cut.json").write_text(json.dumps(REPORT)[:-2])
    with pytest.raises(ValueError):
        dmd.read_dmd_json(spark, str(tmp_path / "cut.json"))


def test_block_report_is_no_single_row(spark, tmp_path, monkeypatch):
    """The report of the queries is written over part files, and its blocks reach the reader as rows of their own."""
    from heaploom import log_queries

    seen = []
    keep = dmd._json_objects
    monkeypatch.setattr(dmd, "_json_objects", lambda s, p: seen.append((p, keep(s, p))) or seen[-1][1])
    n = log_queries._block_report(spark, "/root/testdata/sf0.001")["blocks"].count()
    path, objects = seen[0]
    assert n == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert objects.where("section = 'blockList['").count() == n and spark.read.text(path).count() == n + 3
    report = json.loads("".join(r["value"] for r in sorted(spark.read.text(path).selectExpr("value", "_metadata.file_path p", "monotonically_increasing_id() i").collect(), key=lambda r: (r["p"], r["i"]))))
    assert len(report["blockList"]) == n and len(report["traceTable"]) == 25


def test_block_report_traces_meets_no_whole_report(spark, monkeypatch):
    """Traces equal the tables', and no row that is written for them, of the report or by its reader, holds more than a small part of the report."""
    from pyspark.sql import functions as F

    from heaploom import log_queries

    paths, tables, read, cut = [], [], dmd.read_dmd_json, getattr(dmd, "written", None)
    monkeypatch.setattr(dmd, "read_dmd_json", lambda s, p: paths.append(p) or read(s, p))
    monkeypatch.setattr(dmd, "written", lambda df, name: tables.append(cut(df, name)) or tables[-1], raising=False)
    d = "/root/testdata/sf0.001"
    got = rows(log_queries.block_report_traces(spark, d), "trace", "frames")
    regions = {r["r_regionkey"]: r["r_name"] for r in spark.read.parquet(f"{d}/region.parquet").collect()}
    nations = spark.read.parquet(f"{d}/nation.parquet").collect()
    assert got == sorted((f"T{n['n_nationkey']}", f"{regions[n['n_regionkey']]} (x.cpp:1)|main (y.cpp:2)") for n in nations)
    for texts in [spark.read.text(paths[0]).select("value"), *[t.select("text") for t in tables]]:
        longest, total = texts.select(F.length(texts.columns[0]).alias("n")).agg(F.max("n"), F.sum("n")).first()
        assert longest * 50 < total
    assert len(tables) == 1
