"""Declared schemas (no inference anywhere in the engine)."""

from pyspark.sql import types as T

TICKERS = T.StructType([
    T.StructField("symbol", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("aliases", T.StringType(), True),
])

PROBS = T.StructType([
    T.StructField("neg", T.DoubleType(), True),
    T.StructField("neu", T.DoubleType(), True),
    T.StructField("pos", T.DoubleType(), True),
])

POSTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("external_id", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("ingested_at", T.TimestampType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("body", T.StringType(), True),
    T.StructField("url", T.StringType(), True),
    T.StructField("subreddit", T.StringType(), True),
    T.StructField("score", T.IntegerType(), True),
    T.StructField("comments", T.IntegerType(), True),
    T.StructField("tickers", T.ArrayType(T.StringType(), False), False),
    T.StructField("stance", T.ShortType(), True),
    T.StructField("probs", PROBS, True),
    T.StructField("model_ver", T.StringType(), True),
    T.StructField("txt_hash", T.StringType(), True),
    T.StructField("embedding", T.ArrayType(T.FloatType(), False), True),
    T.StructField("classified_at", T.TimestampType(), True),
    T.StructField("is_backfill", T.BooleanType(), True),
])

TICKER_POSTS = T.StructType([
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("post_id", T.LongType(), False),
    T.StructField("ticker", T.StringType(), False),
    T.StructField("stance", T.ShortType(), True),
    T.StructField("score", T.IntegerType(), True),
    T.StructField("comments", T.IntegerType(), True),
])

SENTIMENT = T.StructType([
    T.StructField("bucket", T.TimestampType(), False),
    T.StructField("ticker", T.StringType(), False),
    T.StructField("n_posts", T.LongType(), False),
    T.StructField("vw_sentiment", T.DoubleType(), True),
    T.StructField("pos_ct", T.LongType(), True),
    T.StructField("neu_ct", T.LongType(), True),
    T.StructField("neg_ct", T.LongType(), True),
])

# Listing record as landed by a poller (one JSON object per line).
LISTING = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("selftext", T.StringType(), True),
    T.StructField("url", T.StringType(), True),
    T.StructField("channel", T.StringType(), True),
    T.StructField("score", T.IntegerType(), True),
    T.StructField("num_comments", T.IntegerType(), True),
    T.StructField("created_utc", T.DoubleType(), True),
    T.StructField("listing", T.StringType(), True),
    T.StructField("pos", T.IntegerType(), True),
])

# RSS <item> as landed XML (Atom entries map title/link/id/summary/published/updated).
FEED_ITEM = T.StructType([
    T.StructField("title", T.StringType(), True),
    T.StructField("link", T.StringType(), True),
    T.StructField("guid", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("pubDate", T.StringType(), True),
    T.StructField("updated", T.StringType(), True),
    T.StructField("feed", T.StringType(), True),
    T.StructField("pos", T.IntegerType(), True),
])

# Atom <entry> as landed XML; <link href="..."/> is read through its attribute.
ATOM_ENTRY = T.StructType([
    T.StructField("title", T.StringType(), True),
    T.StructField("link", T.StructType([T.StructField("_href", T.StringType(), True)]), True),
    T.StructField("id", T.StringType(), True),
    T.StructField("summary", T.StringType(), True),
    T.StructField("published", T.StringType(), True),
    T.StructField("updated", T.StringType(), True),
    T.StructField("feed", T.StringType(), True),
    T.StructField("pos", T.IntegerType(), True),
])
