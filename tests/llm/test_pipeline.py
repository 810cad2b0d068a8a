"""The pipeline's stages one after another against plain versions of their decisions."""

import corpus_pipeline
from subpanel.llm import decontaminate, quality
from subpanel.llm.common import written
from tests.llm.test_operators import plain_components, plain_simhash


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "packing"]
    good = written(stages["quality_classifier"](spark, docs, sf_dir), "t1")
    assert good.columns == docs.columns
    assert {r["doc_id"] for r in quality.classify(docs).where("kept").collect()} == {r["doc_id"] for r in good.collect()}
    single = written(stages["simhash_near_dedup"](spark, good, sf_dir), "t2")
    groups = plain_components({r["doc_id"]: plain_simhash(r["text"]) for r in good.collect()})
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({*groups.values()})
    short = written(stages["substring_dedup"](spark, single, sf_dir), "t3")
    assert all(r["n_chars"] == len(r["text"]) for r in short.collect()) and short.columns == docs.columns
    clean = written(stages["benchmark_decontamination"](spark, short, sf_dir), "t4")
    scan = decontaminate.scanner(decontaminate.benchmark_windows(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    stay = {r["doc_id"] for r in short.collect() for n, hit, *_ in [scan(r["text"])] if not (hit and 20 * hit >= n)}
    assert {r["doc_id"] for r in clean.collect()} == stay
    assert {r["doc_id"] for r in stages["packing"](spark, clean, sf_dir).collect()} == stay
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == stay
