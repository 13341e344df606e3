"""File sources: symbol seed (CSV), feed items (XML), listing records (JSON).

All readers use declared schemas and read record by record: files are split by
byte range, and every landed record is either a row or a quarantined record
(``_corrupt_record``), which ``split_quarantine`` separates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodlake import schemas
from moodlake.functions.dictionaries import FEED_SOURCE, LISTING_SOURCE
from moodlake.functions.text import post_text, text_hash
from moodlake.functions.timefns import as_of_col, epoch_timestamp, feed_timestamp
from moodlake.operators.ingest import ARRIVAL

CORRUPT = "_corrupt_record"


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Symbol dimension from a CSV with header symbol,name,aliases."""
    return (spark.read.schema(schemas.TICKERS).option("header", True).option("mode", "PERMISSIVE")
            .csv(path).select("symbol", "name", "aliases").where(F.col("symbol").isNotNull()))


def _arrival(df: DataFrame) -> list[str]:
    """The arrival column where the source has one: mappings carry it through."""
    return [c for c in (ARRIVAL,) if c in df.columns]


def _atom_as_items(raw: DataFrame) -> DataFrame:
    extra = [c for c in (CORRUPT, ARRIVAL) if c in raw.columns]
    return raw.select("title", F.col("link._href").alias("link"), F.col("id").alias("guid"),
                      F.col("summary").alias("description"), F.col("published").alias("pubDate"),
                      "updated", "feed", "pos", *extra)


def feed_records(lines: DataFrame, atom: bool = False) -> DataFrame:
    """Chunks of feed documents (column ``value``) that each begin behind an opening ``<item`` (Atom: ``<entry``) ->
    one row per item, parsed on its own with ``from_xml`` in PERMISSIVE mode against the declared schema.

    An item without its closing tag, in the middle of a file or torn off at its end, is a chunk without it; that and
    a malformed item are kept with ``_corrupt_record`` set, and never take another item along. What stands before a
    file's first item is no item. Atom entries are normalised to the item columns."""
    tag = "entry" if atom else "item"
    sch = T.StructType(list((schemas.ATOM_ENTRY if atom else schemas.FEED_ITEM).fields)
                       + [T.StructField(CORRUPT, T.StringType(), True)])
    chunks = lines.where(F.col("value").rlike(r"^(\s[^<>]*)?/?>")).select(F.concat(F.lit(f"<{tag}"), "value").alias("raw"), *_arrival(lines))
    end = F.instr("raw", f"</{tag}>")
    item = F.when(end > 0, F.substr("raw", F.lit(1), end + F.lit(len(tag) + 2)))
    r = F.from_xml("item", sch, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    parsed = chunks.withColumn("item", item).select("raw", "item", r.alias("r"), *_arrival(lines))
    corrupt = F.when(F.col("item").isNull(), F.col("raw")).otherwise(F.col("r")[CORRUPT])
    parsed = parsed.select(*[F.col("r")[f.name].alias(f.name) for f in sch.fields if f.name != CORRUPT], corrupt.alias(CORRUPT), *_arrival(lines))
    return _atom_as_items(parsed) if atom else parsed


def _feed_separator(atom: bool) -> str:
    return "<entry" if atom else "<item"


def read_feed_records(spark: SparkSession, path: str, atom: bool = False) -> DataFrame:
    """Every landed feed record, malformed ones flagged in ``_corrupt_record``
    (separate them with ``split_quarantine``)."""
    return feed_records(spark.read.option("lineSep", _feed_separator(atom)).text(path), atom)


def read_feed_items(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Well-formed RSS items (``row_tag="entry"``: Atom entries) with the declared
    schema, so a guid carrying attributes is read as its text. The malformed
    ones are the other side of ``split_quarantine(read_feed_records(...))``."""
    recs = read_feed_records(spark, path, atom=row_tag == "entry")
    return recs.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_atom_entries(spark: SparkSession, path: str, row_tag: str = "entry") -> DataFrame:
    """Landed Atom entries, normalised to the feed-item columns: id -> guid,
    summary -> description, published -> pubDate, link@href -> link, so
    ``feed_posts`` applies the same fallbacks (id, link, ''; published,
    updated, ingest time) to both feed formats."""
    return read_feed_items(spark, path, row_tag)


def stream_feed_items(spark: SparkSession, path: str, atom: bool = False,
                      max_files_per_trigger: int | None = None, with_corrupt: bool = False) -> DataFrame:
    """Landed feed XML as a stream: each new document is read record by record and
    parsed like the batch reader (well-formed records only, unless
    ``with_corrupt`` keeps the flagged ones for a quarantine sink)."""
    r = spark.readStream
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    recs = feed_records(r.option("lineSep", _feed_separator(atom)).text(path), atom)
    return recs if with_corrupt else recs.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def feed_posts(items: DataFrame, ingested_at=None, fallback_to_ingest: bool = True) -> DataFrame:
    """Feed items -> posts rows: external_id = guid, else link, else '';
    created_at = published, else updated, else the ingest time (or NULL when
    ``fallback_to_ingest`` is off, so the caller can quarantine it)."""
    ing = as_of_col(ingested_at)
    created = F.coalesce(feed_timestamp("pubDate"), feed_timestamp("updated"))
    if fallback_to_ingest:
        created = F.coalesce(created, ing)
    title = F.coalesce(F.col("title"), F.lit(""))
    body = F.coalesce(F.col("description"), F.lit(""))
    return items.select(
        F.lit(FEED_SOURCE).alias("source"),
        F.coalesce(F.col("guid"), F.col("link"), F.lit("")).alias("external_id"),
        created.alias("created_at"),
        ing.alias("ingested_at"),
        title.alias("title"), body.alias("body"),
        F.coalesce(F.col("link"), F.lit("")).alias("url"),
        F.lit(1).alias("score"),
        F.col("feed"), F.col("pos"), *_arrival(items),
    ).withColumn("txt_hash", text_hash(post_text()))


def listing_records(lines: DataFrame) -> DataFrame:
    """Lines (column ``value``) of listing JSON -> records; a line that does not parse is kept in ``_corrupt_record``."""
    sch = T.StructType(list(schemas.LISTING.fields) + [T.StructField(CORRUPT, T.StringType(), True)])
    r = F.from_json("value", sch, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.where(F.length(F.trim("value")) > 0).select(r.alias("r"), *_arrival(lines)).select("r.*", *_arrival(lines))


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Landed listing records (JSON lines); bad lines kept in ``_corrupt_record``."""
    return listing_records(spark.read.text(path))


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows): two filters on one parse expression, nothing is stored in between."""
    bad = F.col(CORRUPT).isNotNull()
    return df.where(~bad).drop(CORRUPT), df.where(bad).select(CORRUPT)


def listing_posts(records: DataFrame, ingested_at=None) -> DataFrame:
    """Listing records -> posts rows (engagement kept, event time from epoch seconds)."""
    return records.select(
        F.lit(LISTING_SOURCE).alias("source"),
        F.col("id").alias("external_id"),
        epoch_timestamp("created_utc").cast("timestamp_ntz").alias("created_at"),
        as_of_col(ingested_at).alias("ingested_at"),
        F.col("title"), F.col("selftext").alias("body"), F.col("url"),
        F.col("channel").alias("subreddit"),
        F.col("score"), F.col("num_comments").alias("comments"),
        F.col("listing"), F.col("pos"), *_arrival(records),
    ).withColumn("txt_hash", text_hash(post_text()))


def feed_poll(items: DataFrame, cap: int | None = None, poll: tuple[str, ...] = ()) -> DataFrame:
    """All landed feed entries; with a ``cap``, the first ``cap`` of every feed and poll by position (``poll``: the
    columns that tell polls apart)."""
    if cap is None:
        return items
    from moodlake.operators.text_ops import per_source_cap
    return per_source_cap(items, ["feed", *poll], "pos", cap).drop("rank")


def listing_poll(records: DataFrame, backfill: bool = False, since=None, cap: int | None = None,
                 poll: tuple[str, ...] = ()) -> DataFrame:
    """All landed listing records, for a backfill those of the 'new' listing; with a ``cap``, the first ``cap`` of
    every channel, listing and poll by position. ``since`` optionally keeps only records created after that time."""
    out = records.where(F.col("listing") == "new") if backfill else records
    if cap is not None:
        from moodlake.operators.text_ops import per_source_cap
        out = per_source_cap(out, ["channel", "listing", *poll], "pos", cap).drop("rank")
    if since is not None:
        out = out.where(epoch_timestamp("created_utc") > as_of_col(since))
    return out
