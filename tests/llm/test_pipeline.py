"""The registered corpus queries over small tables, and the pipeline stage by stage."""

import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import bpe, decontaminate, jaccard, line_dedup, quality
from tidemark.llm._shared import table

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(entry.CORPUS.ORACLE_SQL))
def test_queries_give_what_their_sql_gives(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    got, wanted = entry.queries()[name](spark, SMALL).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    order = sorted(wanted.columns)
    assert sorted(got.columns) == order
    assert sorted(map(str, got[order].itertuples(index=False, name=None))) == sorted(map(str, wanted[order].itertuples(index=False, name=None)))


def test_all_ten_operators_and_the_pipeline_are_registered():
    names = list(entry.CORPUS.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 11)) and "pipeline" in names


def test_each_stage_does_its_work_on_what_came_before(spark):
    docs = table(spark, SMALL, "documents")
    labels, benchmark = table(spark, SMALL, "labels"), table(spark, SMALL, "benchmark")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, SMALL).persist()
    assert good.columns == COLUMNS
    scores = quality.scored(docs, quality.fit(docs, labels)).where("score >= 0.3")
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scores.collect()}
    lines = stages["line_dedup"](spark, good, SMALL).persist()
    assert lines.columns == COLUMNS and lines.where(F.length("text") != F.col("n_chars")).isEmpty()
    gone = {(r._doc, i) for r in line_dedup.removals(good).collect() for i in r._gone}
    want = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if (r.doc_id, i) not in gone) for r in good.collect() if any((r.doc_id, i) not in gone for i in range(len(r.text.split("\n"))))}
    assert {r.doc_id: r.text for r in lines.collect()} == want
    one = stages["ngram_jaccard_join"](spark, lines, SMALL).persist()
    classes = {r.component_id for r in jaccard.classes_of(lines).collect()}
    assert one.columns == COLUMNS and sorted(r.doc_id for r in one.collect()) == sorted(classes)
    clean = stages["benchmark_decontamination"](spark, one, SMALL).persist()
    bad = {r.doc_id for r in decontaminate.report(one, benchmark).where("contaminated").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - bad
    coded = {r.doc_id: r for r in stages["byte_bpe"](spark, clean, SMALL).collect()}
    lib = bpe.codec(*bpe.ranks_and_pattern()).raw
    for r in clean.collect():
        assert coded[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, lib.encode_ordinary(r.text))).encode()).hexdigest()
    assert sorted(coded) == sorted(r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect())


def odd_documents(spark):
    first = "a line of many plain words that stands in two documents\n"
    one, two = first + "and a second line of the one with words of its own", first + "rivers mountains forests meadows and birds up north fill another sentence"
    rows = [(1, one, "en", "s", 5, 0.5, "x", 1, "y"), (2, two, None, None, None, None, None, None, None), (2, two, None, None, None, None, None, None, None), (3, None, "en", "s", None, 0.1, "x", 2, "y"), (4, "", "en", "s", 0, 0.1, "x", 2, "y"), (None, "nameless " * 2000, "en", "s", 1, 0.1, "x", 2, "y"), (5, "---", "en", "s", 3, 0.1, "x", 2, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digit double, items string, _gone int, _set_id string")


def test_stages_take_nulls_repeats_empty_tables_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(quality, "THRESHOLD", 0.0)
    monkeypatch.setattr(quality.keep_good, "__defaults__", (0.0,))
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        names, kept = docs.columns, docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, SMALL)
            assert kept.columns == names, name
        ids = sorted(str(r.doc_id) for r in kept.collect())
        assert ids == (["1", "2", "3", "4", "5", "None"] if docs.count() else [])
        coded = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL)
        assert coded.count() == len(ids) and coded.where("n_tokens < 0").isEmpty()
