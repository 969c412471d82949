"""Explicit schemas of the typed tables; nothing is ever inferred."""

NODES = "addr string, kind string, rc int, marked boolean, label string, ord long"
GC_NODES = "addr string, color string, label string, ord long"
EDGES = "src string, dst string, label string, ord long"
WEAK_MAPS = "map string, key string, key_delegate string, value string, ord long"
INCR_ROOTS = "addr string, ord long"
RESULTS = "addr string, tag string, known int, ord long"
GC_ROOTS = "addr string, is_black boolean, label string, ord long"
DMD = (
    "version int, invocation struct<sampleBelowSize:int>, "
    "blockList array<struct<addr:string,req:bigint,alloc:string,contents:array<string>>>, "
    "traceTable map<string,array<string>>, frameTable map<string,string>"
)
