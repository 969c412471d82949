"""URL filters: pattern rules indexed by their rarest literal token.

Native: only DataFrame functions.  A rule is a literal host suffix and path prefix, or a free pattern with the
literal tokens that any matching URL must hold.  Each rule is filed under one of its tokens, the one that the
fewest URLs of the input hold; a URL's tokens fetch the rules filed under them, and only the regular expressions
of those rules run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: host, path prefix, verdict; the longest rule that fits decides.
HOST_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Patterns for URLs that no host rule decides: regular expression over the host, one literal token, verdict.
HOST_PATTERNS = [
    (r"(^|\.)cheap-pills\.", "cheap-pills", "block"),
    (r"(^|\.)spam-farm\.", "spam-farm", "block"),
    (r"(^|\.)casino\.", "casino", "block"),
]
DEFAULT_VERDICT = "allow"
#: Rules up to this number are kept as a literal map in the plan; beyond it the index is joined by a shuffle.
INLINE_RULES = 2_000
#: The token of rules that hold no literal; every URL has it.
ANY = "*"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null or without ://: empty."""
    rest = F.substring_index(F.substring_index(F.substring_index(_after(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    after = _after(url)
    length = F.length(F.substring_index(F.substring_index(F.substring_index(after, "/", 1), "?", 1), "#", 1))
    rest = after.substr(length + 1, F.length(after))
    return F.substring_index(F.substring_index(rest, "?", 1), "#", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def compile_rules(host_rules, host_patterns) -> list[dict]:
    """Rules as records: name, verdict, rank (longer wins, then the longer host, then block), tokens, expressions.

    A host rule's tokens are its host labels and the path segments closed on both sides by /; a path rule must
    start with /.  rank is below 0 for patterns: they count only where no host rule fits.
    """
    out = []
    for host, path, verdict in host_rules:
        host = host.lower()
        tokens = [f"h:{x}" for x in host.split(".") if x] + [f"p:{x}" for x in path.split("/")[1:-1] if x]
        out.append(
            {
                "name": host + path,
                "verdict": verdict,
                "rank": [len(host + path), len(host), int(verdict == "block")],
                "tokens": tokens or [ANY],
                "host_re": rf"(?s)(^|\.){_quoted(host)}\z" if host else "(?s)^",
                "path_re": rf"(?s)\A{_quoted(path)}",
                "named": True,
            }
        )
    for n, (pattern, token, verdict) in enumerate(host_patterns):
        out.append(
            {
                "name": pattern,
                "verdict": verdict,
                "rank": [-1 - n, 0, 0],
                "tokens": [f"h:{token}"] if token else [ANY],
                "host_re": pattern,
                "path_re": "(?s)^",
                "named": False,
            }
        )
    return out


def url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, parts, F.array(F.lit(ANY))))


def rarest_tokens(urls: DataFrame, rules: list[dict]) -> dict[str, str]:
    """The token under which each rule is filed: the one held by the fewest URLs, then the smallest.

    The frequencies are counted over all URLs; only tokens that occur in rules are counted, so the result is
    bounded by the rules.
    """
    wanted = sorted({t for r in rules for t in r["tokens"]})
    if len(wanted) <= INLINE_RULES:
        held = F.array_intersect("__tokens", F.array(*map(F.lit, wanted)))
        counts = urls.select(F.explode(held).alias("t"))
    else:
        index = urls.sparkSession.createDataFrame([(t,) for t in wanted], "t string")
        counts = urls.select(F.explode("__tokens").alias("t")).join(index, "t", "left_semi")
    seen = {r["t"]: r["n"] for r in counts.groupBy("t").agg(F.count("*").alias("n")).collect()}
    return {r["name"]: min(r["tokens"], key=lambda t: (seen.get(t, 0), t)) for r in rules}


def filter_urls(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    host_rules=HOST_RULES,
    host_patterns=HOST_PATTERNS,
    default: str = DEFAULT_VERDICT,
) -> DataFrame:
    """Judge each row's URL: (key, host, path, rule, verdict), one row per input row.

    rule is the deciding host rule as host and path, else null; verdict is its verdict, else that of the first
    fitting pattern, else default.  Null, empty and malformed URLs have empty host and path and get default
    (unless a rule without a host and path exists).  Rows with equal keys are judged one by one; other columns of
    pages are ignored, so clashing names do no harm.  An empty table gives an empty result.
    """
    rules = compile_rules(host_rules, host_patterns)
    u = pages.select(F.col(key).alias(key), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    u = u.withColumn("__tokens", url_tokens(F.col("host"), F.col("path")))
    filed = rarest_tokens(u, rules)
    kinds = "array<struct<rank:array<int>,name:string,verdict:string,host_re:string,path_re:string,named:boolean>>"
    if len(rules) <= INLINE_RULES:
        found = _found_inline(u, rules, filed, kinds)
    else:
        found = _found_joined(u, rules, filed)
    best = F.col("__best")
    return found.select(
        key,
        "host",
        "path",
        F.when(best["named"], best["name"]).alias("rule"),
        F.coalesce(best["verdict"], F.lit(default)).alias("verdict"),
    )


def _record(r: dict) -> Column:
    return F.struct(
        F.array(*map(F.lit, r["rank"])).alias("rank"),
        *[F.lit(r[k]).alias(k) for k in ("name", "verdict", "host_re", "path_re", "named")],
    )


def _found_inline(u: DataFrame, rules: list[dict], filed: dict[str, str], kinds: str) -> DataFrame:
    """The index as a literal map: no join and no shuffle; every row fetches its candidates in place."""
    if not rules:
        return u.withColumn("__best", F.lit(None).cast(kinds[6:-1]))
    by: dict[str, list[dict]] = {}
    for r in rules:
        by.setdefault(filed[r["name"]], []).append(r)
    index = F.create_map(*[x for t, rs in sorted(by.items()) for x in (F.lit(t), F.array(*map(_record, rs)))])
    fetched = F.flatten(
        F.transform(F.col("__tokens"), lambda t: F.coalesce(F.element_at(index, t), F.array().cast(kinds)))
    )
    fits = F.filter(
        fetched, lambda r: F.regexp_like(F.col("host"), r["host_re"]) & F.regexp_like(F.col("path"), r["path_re"])
    )
    return u.withColumn("__best", F.array_max(fits))


def _found_joined(u: DataFrame, rules: list[dict], filed: dict[str, str]) -> DataFrame:
    """The index as a table joined on the token.  Only tokens of the index are exploded, and each URL is salted
    over its host so that one frequent token does not meet in one task."""
    from .common import written

    spark: SparkSession = u.sparkSession
    salts = 32
    rows = [
        (filed[r["name"]], r["rank"], r["name"], r["verdict"], r["host_re"], r["path_re"], r["named"]) for r in rules
    ]
    schema = "t string, rank array<int>, name string, verdict string, host_re string, path_re string, named boolean"
    index = spark.createDataFrame(rows, schema).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    u = written(u.withColumn("__row", F.monotonically_increasing_id()), "urls")
    asked = u.select("__row", "host", "path", F.explode("__tokens").alias("t"))
    asked = asked.withColumn("s", F.pmod(F.xxhash64("__row"), F.lit(salts)).cast("int"))
    hit = asked.join(index, ["t", "s"]).where("regexp_like(host, host_re) and regexp_like(path, path_re)")
    record = F.struct("rank", "name", "verdict", "host_re", "path_re", "named")
    best = hit.groupBy("__row").agg(F.max(record).alias("__best"))
    return u.join(best, "__row", "left")
