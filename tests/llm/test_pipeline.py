"""The pipeline's stages against plain computations on the smallest tables."""

import corpus_pipeline
from test_similar import plain_classes

from tidewell.llm import decontam
from tidewell.session import table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, FOLDER).cache()
        assert out.columns == names and {r["doc_id"] for r in out.select("doc_id").collect()} <= before
        if name == "near_dedup":
            rows = sorted(docs.select("doc_id", "text").collect())
            first = {}
            for k, c in enumerate(plain_classes([r["text"] for r in rows])):
                first.setdefault(c, rows[k]["doc_id"])
            assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(first.values())
        if name == "decontamination":
            assert decontam.contamination(out, table(spark, FOLDER, "benchmark")).filter("size(hits) > 0").count() == 0
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    rows = sorted(last.collect(), key=lambda r: r["start"])
    assert len(rows) == docs.count() and [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))


def test_empty_tables(spark):
    none = table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, FOLDER).count() == 0


def test_run_repeats(spark):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) for _ in range(2))
    assert a == b and a
