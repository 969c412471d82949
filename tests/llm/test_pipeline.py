"""The pipeline's stages on the smallest tables: what each keeps, drops and returns."""

import corpus_pipeline
from heaploom.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == columns
            sizes.append(out.count())
        else:
            assert out.select("doc_id").distinct().count() == docs.count()
        docs = out
    assert sizes[1] == sizes[2] and sizes == sorted(sizes, reverse=True)
    assert set(queries.ORACLES) <= set(queries.QUERIES)
