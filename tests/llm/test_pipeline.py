import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from samplewright.llm import decontamination, line_dedup, packing, simhash, toxicity
from samplewright.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


def test_registered():
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {q.split("_")[0] for q in __spark_entry__.queries()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]


def test_every_stage_against_its_operator(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    columns = docs.columns
    by = dict(corpus_pipeline.STAGES)

    def stage(name, d):
        out = by[name](spark, d, sf)
        assert name == "packing" or out.columns == columns and out.dtypes == docs.dtypes
        return spark.createDataFrame(out.collect(), out.schema)

    model = toxicity.fit(docs, table(spark, sf, "labels"))
    scores = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()}
    one = stage("toxicity", docs)
    assert {r.doc_id for r in one.collect()} == {d for d, s in scores.items() if s < 0.3}

    two = stage("line_dedup", one)
    found = line_dedup.repeated_lines(one)
    texts = {r.d: (r.t, r.n_lines_removed) for r in found.select(F.col("row.doc_id").alias("d"), line_dedup.cleaned(found).alias("t"), "n_lines_removed").collect()}
    assert {r.doc_id: r.text for r in two.collect()} == {d: t for d, (t, n) in texts.items() if not n or t.strip()}
    assert all(r.n_chars == len(r.text) for r in two.collect() if texts[r.doc_id][1])

    three = stage("near_duplicates", two)
    roots = {r.component_id for r in simhash.near_duplicates(two).collect()}
    assert {r.doc_id for r in three.collect()} == roots and three.count() == len(roots)

    four = stage("decontamination", three)
    leaks = {r.doc_id for r in decontamination.contained_items(three, table(spark, sf, "benchmark")).collect()}
    assert {r.doc_id for r in four.collect()} == roots - leaks

    five = stage("packing", four)
    assert sorted(map(tuple, five.collect()), key=str) == sorted(map(tuple, packing.pack(four).collect()), key=str)


def test_run(spark):
    rows = __spark_entry__.queries()["pipeline"](spark, SF_DIR).collect()
    assert rows and all(r.doc_id is not None for r in rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_messy_rows_and_empty_tables(spark, messy, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = messy(["some text that stays here", "some text that stays here", "other"])
    out = stage(spark, docs, SF_DIR)
    assert stage(spark, empty, SF_DIR).count() == 0
    kept = {r.doc_id for r in out.collect()}
    if name != "packing":
        assert out.columns == empty.columns
    if name == "near_duplicates":
        assert 0 in kept and 1 not in kept and kept >= {2, 100, 103, 104, 105} and not kept & {101, 102}
    elif name == "toxicity":  # two of the ids have labels in the test table
        model = toxicity.fit(docs, table(spark, SF_DIR, "labels"))
        scores = docs.select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()
        assert kept == {r.doc_id for r in scores if r.s < 0.3}
    else:
        assert kept == {r.doc_id for r in docs.collect()}
