"""The stages of the pipeline, alone and in a row."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rallygrid.llm.labelled import training_ids

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def folder(tmp_path, labels):
    for f in os.listdir(SMALL):
        if f != "labels.parquet":
            os.symlink(f"{SMALL}/{f}", tmp_path / f)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("which", ["empty", "held out", "none fits", "none calibrates"])
def test_without_usable_quality_labels_all_documents_stay(which, spark, docs, tmp_path):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").union(docs.select("doc_id", F.lit(1), F.lit(0)))
    usable = training_ids(labels, "quality", (3, 1), 1_000_000)
    kept = {
        "empty": labels.limit(0), "held out": labels.join(usable, "doc_id", "left_anti"),
        "none fits": labels.join(usable.where("half = 1"), "doc_id", "left_semi"), "none calibrates": labels.join(usable.where("half = 0"), "doc_id", "left_semi"),
    }[which]
    sf_dir = folder(tmp_path, kept)
    assert rows(corpus_pipeline.quality(spark, docs, sf_dir)) == rows(docs)
    if which == "empty":
        assert rows(corpus_pipeline.toxicity(spark, docs, sf_dir)) == rows(docs)


def test_stages_and_run(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids, left = {r.doc_id for r in docs.select("doc_id").collect()}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, left, sf_dir).localCheckpoint()
        assert done.columns == docs.columns
        found = {r.doc_id for r in done.select("doc_id").collect()}
        assert found and found <= ids and (name != "line_dedup" or found == ids)
        ids, left = found, done
    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(corpus_pipeline.packing(spark, left, sf_dir)) != {}


LINE = "This line is long enough to count as shared by many documents."


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank, long and repeated texts, repeated rows and names that clash with the stages' own."""
    long = " ".join(f"word{k % 977}" for k in range(20_000))
    plain = "\n".join(" ".join(f"plain{k * n % 83}" for k in range(12)) + "." for n in range(1, 9))
    texts = [None, "", " \t\n ", "one two", long, plain, plain, plain.replace("plain48 ", "other "), f"{LINE}\nown"]
    rows = [(i, t, "en", None, 1, 2, 0.5, 0.25, "a", 1, 2) for i, t in enumerate(texts)]
    rows += [(100 + i, f"{LINE}\nline {i}", None, 0, *[None] * 7) for i in range(6)]
    rows += [rows[5], (None, plain, *[None] * 9), (None, None, *[None] * 9)]
    names = "n_chars int, n_lines int, n_dropped int, score double, _score double, `a.b` string, key int, length int"
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, {names}")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, odd, name, stage, tmp_path):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality", "toxic")
    sf_dir = folder(tmp_path, labels.union(odd.where("doc_id IS NOT NULL").select("doc_id", F.lit(1), F.lit(0)).distinct()))
    none = stage(spark, odd.limit(0), sf_dir)
    assert none.count() == 0
    done = stage(spark, odd, sf_dir)
    if name == "packing":
        assert {r.doc_id for r in done.collect()} == {r.doc_id for r in odd.collect()} and none.columns == done.columns
        return
    assert done.columns == odd.columns == none.columns and done.dtypes[:2] == odd.dtypes[:2]
    got, had = rows(done), rows(odd)
    if name == "line_dedup":
        assert sorted(r[2:3] + r[4:] for r in got.elements() if r[0] is not None and r[0] < 100) == sorted(r[2:3] + r[4:] for r in had.elements() if r[0] is not None and r[0] < 100)
        texts = {r[0]: r[1] for r in got}
        assert len(texts) == len({r[0] for r in had}) and sum(got.values()) == sum(had.values())
        assert texts[100] == "line 0" and texts[105] == f"{LINE}\nline 5" and texts[8] == "own"
        assert all(r[3] == len(r[1]) for r in got)
        return
    assert got <= had
    if name == "near_dedup":
        gone = {r[0] for r in had} - {r[0] for r in got}
        assert gone == {6, 7, *range(101, 106)} and got[next(r for r in had if r[0] == 5)] == 2 and sum(r[0] is None for r in got) == 2
