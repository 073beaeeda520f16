"""Each stage on what the one before kept, and the queries on the smallest tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roadpulse.llm.common import documents as read_documents
from roadpulse.llm.mixing import mix
from tests.llm.test_llm_dedup import ASCII, brute_force
from tests.llm.test_llm_text_models import junk, prose
from tests.oracle_check import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, documents, written):
    rng = random.Random(3)
    rows = [(i, junk(rng) if i % 6 == 0 else prose(rng, "en", rng.randint(12, 60)), "en", rng.choice("abc")) for i in range(240)]
    good = [r for r in rows if r[0] % 6]
    rows += [(300 + i, r[1].upper(), "en", "a") for i, r in enumerate(good[:20])]  # copies
    rows += [(400 + i, r[1] + " added", "en", "b") for i, r in enumerate(good[20:60])]  # near copies
    rows += [(500, None, None, None), (501, "", "en", "c")]
    marks = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    sf_dir = written(documents=documents(rows), labels=marks)
    docs, kept = read_documents(spark, sf_dir), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), f"test-{name}")
        kept[name] = docs.collect()
        if name != "tokenizing":
            assert docs.columns == COLUMNS
    ids = lambda name: [r["doc_id"] for r in kept[name]]
    assert sum(i % 6 == 0 and i < 240 for i in ids("quality")) <= 2
    assert len({i for i, *_ in rows if i >= 240 or i % 6} - set(ids("quality"))) <= 4
    last = {}
    for r in kept["quality"]:
        text = (r["text"] or "").translate(ASCII)
        last[text] = max(last.get(text, r["doc_id"]), r["doc_id"])
    assert sorted(ids("exact_dedup")) == sorted(last.values())
    classes = brute_force([(r["doc_id"], r["text"]) for r in kept["exact_dedup"]])
    assert sorted(ids("near_dedup")) == sorted(i for i, c in classes.items() if c[2])
    copies = {r["doc_id"]: r["copies"] for r in mix(documents([tuple(r)[:4] for r in kept["near_dedup"]])).collect()}
    assert sorted(ids("mixing")) == sorted(i for i, n in copies.items() for _ in range(n))
    assert sorted(ids("tokenizing")) == sorted(ids("mixing"))


def test_columns_named_like_results_pass_all_stages(spark, documents, written):
    """Columns of the table that a stage's result is named like keep their own values; empty tables pass too."""
    rng = random.Random(4)
    clashing = ["kept", "keep_id", "group_size", "text_sha256", "score", "accepted", "log_weight", "copies"]
    docs = documents([(i, prose(rng, "en", 30), "en", "a") for i in range(30)]).withColumns({c: F.concat(F.lit(c), "doc_id") for c in clashing})
    marks = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    sf_dir = written(documents=docs, labels=marks)
    columns, docs = docs.columns, read_documents(spark, sf_dir)
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = corpus_pipeline.stored(stage(spark, rows, sf_dir), f"clash-{name}")
            assert rows.columns == columns
            assert all(r[c] == f"{c}{r['doc_id']}" for r in rows.collect() for c in clashing)
        assert corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).count() == rows.count()


@needs_tables
@pytest.mark.parametrize("name", sorted(corpus_pipeline.SQL))
def test_query_equals_sql(spark, name):
    assert compare(corpus_pipeline.QUERIES[name](spark, SF), connect(SF), corpus_pipeline.SQL[name]) is None


def test_every_operator_and_the_pipeline_is_registered():
    names = set(corpus_pipeline.QUERIES)
    assert {n.split("_")[0] for n in names} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}
    import __spark_entry__

    assert names <= set(__spark_entry__.queries())
