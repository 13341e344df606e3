"""Domain-shaped views of the driver tables (the fixtures of FIXTURES.md).

Each overlay is a pure projection of a given table: every row of the source
table is kept, so the work of every query built on it grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from moodlake.functions.text import body_of, title_of
from moodlake.session import table_path


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def scored_mentions(events: DataFrame) -> DataFrame:
    """O1: ticker_posts rows (created_at, post_id, ticker, stance, score, comments)."""
    eid = F.col("event_id")
    return events.select(
        F.col("ts").alias("created_at"),
        eid.alias("post_id"),
        F.col("event_type").alias("ticker"),
        F.when(eid % 4 == 0, 1).when(eid % 4 == 1, 0).when(eid % 4 == 2, -1).cast("short").alias("stance"),
        (F.floor("value").cast("int") - F.lit(20)).alias("score"),
        F.when(eid % 5 != 0, F.regexp_extract("props", "([0-9]+)", 1).cast("int")).alias("comments"),
    )


def posts_meta(events: DataFrame) -> DataFrame:
    """O2: queue / latency columns of posts (id, created_at, ingested_at, stance,
    classified_at, is_backfill)."""
    eid = F.col("event_id")
    scored = eid % 4 != 3
    return events.select(
        eid.alias("id"),
        F.col("event_type").alias("source"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("ingested_at"),
        F.when(scored, F.when(eid % 4 == 0, 1).when(eid % 4 == 1, 0).otherwise(-1)).cast("short").alias("stance"),
        F.when(scored, F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (eid % 30).cast("int")))
         .alias("classified_at"),
        F.when(eid % 17 == 0, F.lit(True)).alias("is_backfill"),
    )


def posts_text(documents: DataFrame) -> DataFrame:
    """O3: posts with text (id, source, external_id, created_at, title, body)."""
    return documents.select(
        F.col("doc_id").alias("id"),
        F.col("source"),
        F.col("doc_id").cast("string").alias("external_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))).alias("created_at"),
        title_of("text").alias("title"),
        body_of("text").alias("body"),
    )


def arrivals(documents: DataFrame) -> DataFrame:
    """O4: every document arrives twice, in polls k = doc_id % 3 and 3 - doc_id % 3
    (copy 'a' / 'b'); the first write per key is the smallest k, then copy."""
    p = posts_text(documents)
    a = p.withColumn("k", (F.col("id") % 3).cast("int")).withColumn("copy", F.lit("a"))
    b = p.withColumn("k", (F.lit(3) - F.col("id") % 3).cast("int")).withColumn("copy", F.lit("b"))
    return a.unionByName(b)


def logits(embeddings: DataFrame) -> DataFrame:
    """O5: 3-class logits from the first three embedding dimensions."""
    e = F.col("embedding")
    return embeddings.select(F.col("vec_id").alias("id"),
                             F.array(*[F.element_at(e, i).cast("double") for i in (1, 2, 3)]).alias("logits"))


def listings(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O7: 'new' = turn < 2 and 'hot' = turn >= 1 listings of one channel per conversation."""
    base = conversations.select(
        F.col("conv_id").cast("string").alias("channel"),
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("role").alias("title"),
        F.col("text").alias("selftext"),
        F.concat(F.lit("https://forum.example/"), F.col("conv_id").cast("string"), F.lit("/"),
                 F.col("turn").cast("string")).alias("url"),
        F.col("turn").cast("int").alias("pos"),
        F.col("turn").cast("int").alias("score"),
        F.length("text").cast("int").alias("num_comments"),
        (F.lit(1704067200.0) + F.col("conv_id") * 60 + F.col("turn")).alias("created_utc"),
    )
    new = base.where(F.col("pos") < 2).withColumn("listing", F.lit("new"))
    hot = base.where(F.col("pos") >= 1).withColumn("listing", F.lit("hot"))
    return new, hot


# FIXED VALUES (fixture O6): small dictionaries that hit the invented prose.
O6_WHITELIST = ("THE", "IN", "OF", "NTION", "IT", "A", "WITH", "EN")
O6_STOPLIST = ("A", "IT")
O6_KEYWORDS = (("nti", "NTI"), ("intel", "INTC"), ("étion", "ETN"))


def symbols_from_parts(part: DataFrame) -> DataFrame:
    """O10: the symbol dimension (distinct brands)."""
    return part.select(F.col("p_brand").alias("symbol")).distinct()


def feed_xml_items(documents: DataFrame) -> DataFrame:
    """O8 rows as they are landed: one <item> per O3 post (every post; the
    description is the whole body). guid is missing for every fifth post and
    pubDate for every seventh; dates alternate numeric offset and zone name."""
    p = posts_text(documents)
    pid = F.col("id")
    ts = F.col("created_at").cast("timestamp")
    date = F.when(pid % 3 == 1, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(
        F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss Z"))
    return p.select(
        F.col("title"),
        F.concat(F.lit("https://news.example/p/"), pid.cast("string")).alias("link"),
        F.when(pid % 5 != 0, F.concat(F.lit("urn:post:"), pid.cast("string"))).alias("guid"),
        F.col("body").alias("description"),
        F.when(pid % 7 != 0, date).alias("pubDate"),
        F.lit(None).cast("string").alias("updated"),
        F.col("source").alias("feed"),
        pid.cast("int").alias("pos"),
    )


def atom_xml_entries(documents: DataFrame) -> DataFrame:
    """O8 as an Atom feed: one <entry> per O3 post with <link href>, RFC 3339
    dates. id is missing for every fifth post, published for every seventh and
    updated (one hour after the post) for every fourteenth, so each fallback
    level occurs."""
    p = posts_text(documents)
    pid = F.col("id")
    ts = F.col("created_at").cast("timestamp")
    fmt = "yyyy-MM-dd'T'HH:mm:ssXXX"
    return p.select(
        F.col("title"),
        F.struct(F.concat(F.lit("https://news.example/p/"), pid.cast("string")).alias("_href")).alias("link"),
        F.when(pid % 5 != 0, F.concat(F.lit("urn:post:"), pid.cast("string"))).alias("id"),
        F.col("body").alias("summary"),
        F.when(pid % 7 != 0, F.date_format(ts, fmt)).alias("published"),
        F.when(pid % 14 != 0, F.date_format(ts + F.make_dt_interval(F.lit(0), F.lit(1)), fmt)).alias("updated"),
        F.col("source").alias("feed"),
        pid.cast("int").alias("pos"),
    )


def listing_json_lines(documents: DataFrame) -> DataFrame:
    """O9 landed lines: one JSON listing record per O3 post; every eleventh line
    is cut in half (a torn write) and must be quarantined, not lost."""
    p = posts_text(documents)
    pid = F.col("id")
    rec = F.to_json(F.struct(
        pid.cast("string").alias("id"), F.col("title"), F.col("body").alias("selftext"),
        F.concat(F.lit("https://forum.example/"), pid.cast("string")).alias("url"),
        F.col("source").alias("channel"), (pid % 97).cast("int").alias("score"),
        (pid % 13).cast("int").alias("num_comments"),
        (F.unix_seconds(F.col("created_at").cast("timestamp"))).cast("double").alias("created_utc"),
        F.lit("new").alias("listing"), pid.cast("int").alias("pos")))
    line = F.when(pid % 11 == 10, F.substr(rec, F.lit(1), (F.length(rec) / 2).cast("int"))).otherwise(rec)
    return p.select(line.alias("value"))


def torn_vectors(embeddings: DataFrame) -> DataFrame:
    """O11: post vectors where every ninth one lost its last dimension and every
    thirteenth is missing (NULL) — input for the fixed-size vector guard."""
    vid, e = F.col("vec_id"), F.col("embedding")
    vec = (F.when(vid % 13 == 12, F.lit(None).cast("array<float>"))
           .when(vid % 9 == 8, F.slice(e, 1, F.size(e) - 1)).otherwise(e))
    return embeddings.select(vid.alias("id"), vec.alias("embedding"), "label")


def benchmark_keywords(benchmark: DataFrame) -> DataFrame:
    """O12: a large keyword dictionary (keyword, symbol) derived from the benchmark
    passages: every distinct lower-case ASCII word is a keyword, and its own symbol in upper case."""
    w = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return benchmark.select(w.alias("keyword")).distinct().select("keyword", F.upper("keyword").alias("symbol"))


def conversation_symbols(conversations: DataFrame) -> DataFrame:
    """O13: a large symbol dimension derived from the conversation turns: every
    distinct candidate token (the linking regex) of their text is a symbol."""
    from moodlake.functions.text import candidate_symbols
    return (conversations.select(F.explode(candidate_symbols("text")).alias("symbol"))
            .distinct())


def _xml_text(c):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def malformed_feed_lines(documents: DataFrame) -> DataFrame:
    """O8c: the O3 posts as raw <item> XML, one item per line; the title of every
    thirteenth item carries an unclosed tag, every seventeenth item a
    non-numeric <pos>, and every nineteenth lost its closing tag (in the middle of a
    file or at its end): all must be quarantined, every other item kept."""
    p = posts_text(documents)
    pid = F.col("id")
    title = F.when(pid % 13 == 12, F.concat(F.lit("<b>"), _xml_text(F.col("title")))).otherwise(_xml_text(F.col("title")))
    pos = F.when(pid % 17 == 16, F.lit("n/a")).otherwise(pid.cast("string"))
    item = F.concat(
        F.lit("<item><title>"), title, F.lit("</title><link>https://news.example/p/"), pid.cast("string"),
        F.lit("</link><guid>urn:post:"), pid.cast("string"), F.lit("</guid><description>"), _xml_text(F.col("body")),
        F.lit("</description><feed>"), F.col("source"), F.lit("</feed><pos>"), pos, F.lit("</pos>"),
        F.when(pid % 19 == 18, F.lit("")).otherwise(F.lit("</item>")))
    return p.select(item.alias("value"))


def late_posts_text(documents: DataFrame) -> DataFrame:
    """O14: O3 posts out of event-time order: every tenth lies three days behind its poll, every fifteenth three weeks,
    and one in 500 is dated ten years ahead (``polled_at`` keeps the poll's time)."""
    pid = F.col("id")
    shift = F.when(pid % 500 == 7, 3650).when(pid % 15 == 4, -21).when(pid % 10 == 3, -3).otherwise(0)
    return (posts_text(documents).withColumn("polled_at", F.col("created_at"))
            .withColumn("created_at", F.col("created_at") + F.make_dt_interval(shift)))


def feed_date_strings(documents: DataFrame) -> DataFrame:
    """O15: one feed date per document, in the layouts that feeds use (the minute of its O3 post)."""
    ts = F.col("created_at").cast("timestamp")
    layouts = ["EEE, dd MMM yyyy HH:mm:ss Z", "EEEE, d MMM yyyy HH:mm 'GMT'", "d MMM yy HH:mm:ss Z", "dd MMM yyyy HH:mm:ss",
               "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd'T'HH:mm:ssZ", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd"]
    pick = F.col("id") % (len(layouts) + 1)
    text = F.lit("no date")
    for i, layout in enumerate(layouts):
        text = F.when(pick == i, F.date_format(ts, layout)).otherwise(text)
    return posts_text(documents).select("id", text.alias("date"))


def land_polls(df: DataFrame, path: str, time_col: str, span_seconds: int, origin: str,
               redeliver: bool = True, fmt: str = "parquet", files_per_poll: int = 2) -> int:
    """Land ``df`` into ``path`` as successive polls — one append job per poll,
    in event-time order, ``files_per_poll`` files each — where every poll also
    re-sends the rows of the previous one (``redeliver``). Returns the poll count.

    For queries with a watermark: the file source orders files by modification time, so polls must be separate jobs.
    The rows are first written once to a staging table partitioned by poll (in the shared checkpoint folder)."""
    from moodlake.session import scratch_dir

    spark = df.sparkSession
    stage = scratch_dir(spark, "poll_stage")
    df.withColumn("__poll", _poll(time_col, span_seconds, origin)).write.partitionBy("__poll").parquet(stage)
    staged = spark.read.parquet(stage)
    n = staged.agg(F.max("__poll")).first()[0]
    n = 0 if n is None else int(n) + 1
    for i in range(n):
        cond = (F.col("__poll") == i) | ((F.col("__poll") == i - 1) if redeliver else F.lit(False))
        (staged.where(cond).drop("__poll").repartition(files_per_poll)
         .write.mode("append").format(fmt).save(path))
    return n


def land_all_polls(df: DataFrame, path: str, time_col: str, span_seconds: int, origin: str, fmt: str = "json") -> int:
    """Land ``df`` in one job, a folder per poll, where every poll also re-sends the rows of the previous one; read it with
    ``recursiveFileLookup``. For the live path, whose result does not depend on the order of the files. Returns the rows landed.

    A row is shuffled once, to the task of its poll, and sent twice from there; files are compressed, a few per poll."""
    landed = Observation()
    rows = df.withColumn("__poll", _poll(time_col, span_seconds, origin)).repartition("__poll")
    (rows.withColumn("__poll", F.explode(F.array("__poll", F.col("__poll") + 1))).observe(landed, F.count(F.lit(1)).alias("n"))
     .write.partitionBy("__poll").format(fmt).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").save(path))
    return landed.get["n"]


def _poll(time_col: str, span_seconds: int, origin: str):
    return F.floor((F.unix_micros(F.col(time_col).cast("timestamp"))
                    - F.unix_micros(F.lit(origin).cast("timestamp"))) / F.lit(span_seconds * 1_000_000)).cast("long")
