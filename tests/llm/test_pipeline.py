"""Every stage of the pipeline against plain Python, each on what its predecessor kept."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.fixtures import awkward_docs
from tests.llm.test_documents import check_packing
from tests.llm.test_pairs import kept_rows
from tillbook.llm import mixing
from tillbook.session import stored


def _folder(spark, tmp_path, docs) -> str:
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).filter("doc_id is not null").distinct()
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_stages_on_awkward_rows(spark, tmp_path):
    private = spark.createDataFrame([(9001, "Write to und.34@mail7.example.com or call +1 (499) 555-6503 now please", "src1")], "doc_id long, text string, source string")
    sf_dir = _folder(spark, tmp_path, awkward_docs(spark).unionByName(private, allowMissingColumns=True))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.select("doc_id", "text").collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
        if name == "best-fit packing":
            check_packing(out.collect(), docs.collect())
            break
        assert out.columns == columns
        after = out.select("doc_id", "text").collect()
        if name == "quality classifier":
            # All labels are 1: nothing may go.
            assert Counter(after) == Counter(before)
        elif name == "n-gram Jaccard join":
            want = kept_rows([tuple(r) for r in before])
            got = list(map(tuple, after))
            assert len(got) == len(set(got)) == len(want) and all(any(g in some for g in got) for some in want.values())
        elif name == "PII surrogates":
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
            changed = {r.doc_id: r.text for r in after}
            assert "und.34" not in changed[9001] and "555-6503" not in changed[9001]
            assert all(changed[r.doc_id] == r.text for r in before if r.doc_id not in (None, 9001))
        else:
            copies = Counter()
            for r in mixing.plan_mix(docs).collect():
                copies[r.doc_id] += r.copies
            assert Counter(r.doc_id for r in after) == +copies
        docs, before = out, after


def test_no_documents(spark, tmp_path):
    sf_dir = _folder(spark, tmp_path, awkward_docs(spark).limit(0))
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
