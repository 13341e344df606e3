"""Golden unit cases for the scalar functions (values computed independently)."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from moodlake.functions import decode, text, timefns, vectors
from moodlake.operators import sentiment, symbols
from moodlake.plans import serving
from tests.conftest import SF01

# A slice of the symbol seed large enough for the golden rows.
SEED = ["AAPL", "MSFT", "GOOGL", "AMZN", "META", "BRK.B", "V", "MA", "COST", "LOW", "UPS", "INTC"]


def _one(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_candidate_tokens(spark):
    cases = {
        "$AAPL beats; apple up": ["AAPL", "BEATS", "APPLE", "UP"],
        "metal groups advisable flowers": ["METAL", "ROUPS", "SABLE", "OWERS"],
        "xGOOGL V8 8V": ["GOOGL", "V"],
        "BRK.B and Berkshire": ["BRK", "B", "AND", "SHIRE"],
        "low cost, ma said": ["LOW", "COST", "MA", "SAID"],
        "": [],
    }
    df = _one(spark, [(k,) for k in cases], "t string")
    got = {r.t: r.c for r in df.select("t", text.candidate_symbols("t").alias("c")).collect()}
    assert got == cases


def test_extract_symbols_golden(spark):
    cases = {
        "$AAPL beats; apple up": ["AAPL"],
        "metal groups advisable flowers": ["LOW", "META", "UPS", "V"],
        "xGOOGL V8 8V": ["GOOGL", "V"],
        "BRK.B and Berkshire": ["BRK.B"],
        "low cost, ma said": ["COST", "LOW", "MA"],
    }
    rows = [(k,) for k in cases] + [(None,), ("",)]
    df = symbols.extract_symbols(_one(spark, rows, "text string"), "text", SEED)
    got = {r.text: r.tickers for r in df.collect()}
    for k, v in cases.items():
        assert got[k] == v, k
    assert got[None] == [] and got[""] == []


def test_extract_symbols_caps_at_five_sorted(spark):
    df = symbols.extract_symbols(_one(spark, [("apple microsoft google amazon nvidia tesla",)], "text string"),
                                 "text", SEED)
    assert df.first().tickers == ["AAPL", "AMZN", "GOOGL", "MSFT", "NVDA"]


def test_extract_symbols_dataframe_dictionary_and_join_path(spark):
    dim = spark.createDataFrame([(s,) for s in SEED], "symbol string")
    docs = _one(spark, [(1, "$AAPL beats; apple up"), (2, "metal groups advisable flowers")], "id long, text string")
    lit_path = {r.id: r.tickers for r in symbols.extract_symbols(docs, "text", dim).collect()}
    join_path = {r.id: r.tickers for r in symbols.extract_symbols_join(docs, "text", dim).collect()}
    assert lit_path == join_path == {1: ["AAPL"], 2: ["LOW", "META", "UPS", "V"]}


def test_symbol_keys_multiword(spark):
    dim = spark.createDataFrame([("Home Depot",), ("AAPL",)], "symbol string")
    keys = {r.key: r.symbol for r in symbols.symbol_keys(dim).collect()}
    assert keys == {"HOME DEPOT": "Home Depot", "HOME": "Home Depot", "DEPOT": "Home Depot", "AAPL": "AAPL"}


def test_text_hash_golden(spark):
    df = _one(spark, [("Buy  $AAPL\tNOW",), ("buy $aapl now",), ("Café A",)], "t string")
    got = [r.h for r in df.select(text.text_hash("t").alias("h")).collect()]
    assert got == ["28ac9fb12a97041dbf1e3c33f6177816"] * 2 + ["5edfb6064bf6163b1c5ddf4b1c6ce6f6"]


def _py_hash(t):
    return hashlib.md5("".join(t.lower().split()).encode()).hexdigest()


def _py_candidates(t):
    return [c.lstrip("$") for c in re.findall(r"\$?[A-Z]{1,5}\b", t.upper())]


def test_python_cross_check_on_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select(
        "doc_id", "text", text.text_hash("text").alias("h"), text.candidate_symbols("text").alias("c")).collect()
    assert len(docs) == 1000
    bad_hash = [r.doc_id for r in docs if r.h != _py_hash(r.text)]
    bad_cand = [r.doc_id for r in docs if r.c != _py_candidates(r.text)]
    assert bad_hash == [] and bad_cand == []


def test_weighted_sentiment_golden(spark):
    rows = [("2024-01-01 00:00:01", "X", 1, 10, 5), ("2024-01-01 00:00:02", "X", -1, -3, None),
            ("2024-01-01 00:00:03", "X", 0, 0, 1), ("2024-01-01 00:00:04", "X", None, 99, 99)]
    df = spark.createDataFrame(rows, "created_at string, ticker string, stance short, score int, comments int") \
        .withColumn("created_at", F.col("created_at").cast("timestamp"))
    r = sentiment.sentiment_buckets(df).first()
    assert (r.n_posts, r.pos_ct, r.neu_ct, r.neg_ct) == (3, 1, 1, 1)
    assert math.isclose(r.vw_sentiment, 0.428812553, abs_tol=1e-9)


def test_softmax_and_stance(spark):
    df = _one(spark, [([0.1, 2.0, -1.0],), ([1.0, 1.0, 0.0],)], "x array<double>")
    rows = df.select(decode.softmax("x").alias("p")).select(
        "p", decode.argmax_stance("p").alias("s")).collect()
    p, s = rows[0].p, rows[0].s
    e = [math.exp(v) for v in (0.1, 2.0, -1.0)]
    expected = [v / sum(e) for v in e]  # 0.124707475, 0.833781013, 0.041511512
    for a, b in zip(p, expected):
        assert math.isclose(a, b, abs_tol=1e-12)
    assert s == 0 and math.isclose(sum(p), 1.0)
    assert rows[1].s == -1  # tie takes the lowest index


def test_feed_dates(spark):
    df = _one(spark, [("Mon, 01 Jan 2024 00:00:07 +0530",), ("Mon, 01 Jan 2024 00:00:07 GMT",), ("garbage",)], "d string")
    got = [r.t for r in df.select(F.date_format(timefns.feed_timestamp("d"), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()]
    assert got == ["2023-12-31 18:30:07", "2024-01-01 00:00:07", None]


def test_latency_empty_is_zero(spark):
    df = spark.createDataFrame([], "id long, ingested_at timestamp, classified_at timestamp, is_backfill boolean")
    assert serving.pipeline_latency_p95(df, as_of="2024-01-01 00:00:00").first().p95_latency_sec == 0.0


def test_vector_distances(spark):
    df = _one(spark, [([0.0, 3.0], [4.0, 0.0]), ([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    r = df.select(vectors.l2_distance("a", "b").alias("d"), vectors.cosine_distance("a", "b").alias("c")).collect()
    assert r[0].d == pytest.approx(5.0) and r[0].c == pytest.approx(1.0)
    assert r[1].c is None and r[2].d is None


def test_feed_date_variants(spark):
    cases = {
        "Mon, 1 Jan 2024 00:07 GMT": "2024-01-01 00:07:00.000",          # one-digit day, no seconds
        "Mon, 01 Jan 24 00:07:05 GMT": "2024-01-01 00:07:05.000",        # two-digit year
        "Mon, 01 Jan 2024 00:07:05 -0100": "2024-01-01 01:07:05.000",
        "2024-01-01T00:00:07Z": "2024-01-01 00:00:07.000",
        "2024-01-01T00:00:07.123Z": "2024-01-01 00:00:07.123",           # fraction of a second
        "2024-01-01T02:00:07.5+02:00": "2024-01-01 00:00:07.500",
    }
    df = _one(spark, [(k,) for k in cases], "d string")
    got = {r.d: r.t for r in df.select("d", F.date_format(timefns.feed_timestamp("d"), "yyyy-MM-dd HH:mm:ss.SSS")
                                       .alias("t")).collect()}
    assert got == cases


def test_candidate_boundary_is_pythons(spark):
    """Edge cases where Java's Unicode \\b and Python's re disagree: the tokens
    must be what Python's re finds (the reference tokenises in Python)."""
    texts = ["ABC² x", "ABCÉ y", "ABC٣ DEF", "Ⅻ ABCⅫ", "$$AAPL", "$A$B", "ABC_D",
             "ABCDEFGHIJ KLMNO PQ", "straße"]
    py = re.compile(r"\$?([A-Z]{1,5})\b")
    df = _one(spark, [(t,) for t in texts], "t string")
    got = {r.t: list(r.c) for r in df.select("t", text.candidate_symbols("t").alias("c")).collect()}
    for t in texts:
        assert got[t] == py.findall(t.upper()), t
