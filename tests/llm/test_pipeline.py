import collections
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from moodlake.llm.queries import QUERIES, SQL
from tests.llm import test_ngram_join, test_suffix_dedup
from tests.llm.conftest import words
from tests.llm.test_ngram_join import WORD

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def stages(spark):
    """The rows after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialized(stage(spark, docs, SF), "stage")
        out.append((name, docs))
    return out


def test_filters_keep_rows_as_they_are(stages):
    frames = [{r["doc_id"]: r for r in df.collect()} for _, df in stages[:4]]
    columns = stages[0][1].columns
    for (name, df), before, after in zip(stages[1:4], frames, frames[1:]):
        assert df.columns == columns, name
        assert after and all(before[k] == r for k, r in after.items()), name
    assert len(frames[1]) < len(frames[0]) and len(frames[2]) < len(frames[1])


def test_one_document_of_each_class(stages):
    before, after = (df.select("doc_id", "text").collect() for _, df in stages[2:4])
    rows = [(r["doc_id"], r["text"]) for r in before]
    assert sorted({c for c, _, _ in test_ngram_join.brute(rows)}) == sorted(r["doc_id"] for r in after)


def test_repeats_are_cut_and_all_words_packed(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3][1].collect()}
    after = {r["doc_id"]: r for r in stages[4][1].collect()}
    assert stages[4][1].columns == stages[0][1].columns and before.keys() == after.keys()
    kept = test_suffix_dedup.brute(list(before.values()), 200)
    for k, (_, removed, _, left) in zip(before, kept):
        assert after[k]["text"] == (left.decode("utf-8", "ignore") if removed else before[k])
        assert not removed or after[k]["n_chars"] == len(after[k]["text"])
    words = collections.Counter()
    for r in stages[5][1].collect():
        words[r["doc_id"]] += r["n_words"]
    assert words == {k: len(WORD.findall(r["text"] or "")) for k, r in after.items()}


def test_stages_take_odd_rows(spark, odd_docs):
    """Every stage runs over nulls, blanks, copies and repeated rows, and over an empty table."""
    names = ["score", "keep", "class_id", "_text", "row", "kept", "p", "spans", "class_key", "n_removed", "doc_p"]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"clash {c}").alias(c) for c in names])
    for start in (docs, docs.limit(0)):
        current = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, current, SF)
            assert out.columns == docs.columns
            assert all(r[c] == f"clash {c}" for r in out.select(names).collect() for c in names)
            current = corpus_pipeline.materialized(out, "stage")
        assert corpus_pipeline.STAGES[-1][1](spark, current, SF).count() >= current.count()


def test_one_row_of_each_class_whatever_its_ids(spark):
    """Rows that share an id, and rows without one, are told apart by their class, not by their id."""
    rng = random.Random(3)
    a, b, c = (words(rng, 80) for _ in range(3))
    rows = [(1, a), (1, a + " tail"), (None, b), (None, b), (None, b + " end"), (7, c), (3, c), (None, c), (3, c), (9, ""), (9, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    out = corpus_pipeline.keep_one_of_each_class(spark, docs, SF)
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, a), (None, b), (3, c), (9, ""), (9, ""), (None, None)], key=str)


def test_registered(spark):
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n for n in names if n.startswith("op")} == set(QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    for t in ("documents", "pages", "embeddings", "conversations"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    got = QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    want = duckdb.sql(SQL[name]).df()[list(got.columns)]
    order = list(got.columns)
    assert got.sort_values(order).astype(str).values.tolist() == want.sort_values(order).astype(str).values.tolist()
