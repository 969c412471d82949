"""The queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kd_shards import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import remove_boilerplate

    out = remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_graph import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"))


QUERIES = {
    "op7_quality": op7_quality,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op1_decontamination": op1_decontamination,
    "op5_jaccard_join": op5_jaccard_join,
    "op2_line_dedup": op2_line_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op8_toxicity": op8_toxicity,
    "op6_packing": op6_packing,
    "op9_url_filters": op9_url_filters,
    "op10_kd_shards": op10_kd_shards,
}

ORACLES = {
    "op4_embedding_dedup": r"""
WITH RECURSIVE raw AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), v AS (
  SELECT vec_id, x, list_max(list_transform(x, lambda c: abs(c))) AS most,
         x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AS finite
  FROM raw
), scaled AS (
  SELECT vec_id, list_transform(x, lambda c: c / most) AS x FROM v WHERE finite AND most > 0
), good AS (
  SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM scaled
), links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id <> q.vec_id
  WHERE len(p.x) = len(q.x) AND list_dot_product(p.x, q.x) / (p.norm * q.norm) >= 0.95
), reach(vec_id, c) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.vec_id
), comp AS (
  SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)
""",
    "op5_jaccard_join": r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM toks WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM (SELECT x.doc_id AS xa, y.doc_id AS yb, count(*) AS o FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN size a ON a.doc_id = p.xa JOIN size b ON b.doc_id = p.yb
  WHERE 100 * p.o >= 75 * (a.n + b.n - p.o)
), reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.doc_id
)
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM documents d LEFT JOIN size USING (doc_id)
JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
""",
    "op2_line_dedup": r"""
WITH cut AS (
  SELECT doc_id, coalesce(source, chr(1)) AS site, unnest(string_split(text, chr(10))) AS raw,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents
), lines AS (
  SELECT doc_id, site, pos, raw, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM cut
), bad AS (
  SELECT line, min(doc_id) AS first_doc FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 5
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE b.line IS NOT NULL AND b.first_doc <> l.doc_id) AS n_removed,
         string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL OR b.first_doc = l.doc_id) AS text
  FROM lines l LEFT JOIN bad b ON b.line = l.line GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(k.text, '')) END AS text_md5
FROM documents d LEFT JOIN kept k USING (doc_id)
""",
    "op9_url_filters": r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages
), cut AS (
  SELECT page_id, regexp_extract(after, '^[^/?#]*') AS raw_host,
         regexp_extract(substr(after, length(regexp_extract(after, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM parts
), urls AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut
), judged AS (
  SELECT page_id, host, path,
    CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/'
    END AS rule
  FROM urls
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
       WHEN rule IS NOT NULL THEN 'block'
       WHEN host LIKE 'cheap-pills.%' OR host LIKE '%.cheap-pills.%' THEN 'block'
       WHEN host LIKE 'spam-farm.%' OR host LIKE '%.spam-farm.%' THEN 'block'
       WHEN host LIKE 'casino.%' OR host LIKE '%.casino.%' THEN 'block'
       ELSE 'allow' END AS verdict
FROM judged
""",
}
