"""What the operators share: reading tables, text keys, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodlake.session import scratch_dir, ship_package

#: Text bytes that a kernel works on at once inside a task.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """What the operators rely on: UTC, Arrow batches bounded in bytes (a batch of very long texts must
    not fill a worker's memory), and this package in the workers."""
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialized(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder (``spark.checkpoint.dir``) and read back:
    cuts the lineage with files that survive a lost executor."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows written once to the shared folder in buckets of ``keys``: every later join on the keys reads its buckets
    and moves only the other side. For rows that are grouped by the keys already, a bucket is one file."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    table_name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(shuffle_partitions(spark), *keys).option("path", path).format("parquet").saveAsTable(table_name)
    out = spark.table(table_name)
    spark.sql(f"DROP TABLE {table_name}")               # the entry only: the files at a given path stay
    return out


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: two 64-bit hashes with different seeds."""
    return [F.xxhash64(text).alias("c1"), F.xxhash64(F.lit(1), text).alias("c2")]


def distinct_texts(texts: DataFrame) -> DataFrame:
    """One row per distinct text: c1, c2, text, copies, stored in buckets of the key, as texts are joined again and
    again and should be shuffled once. ``texts`` holds a column ``text``; copies are combined before the shuffle, so a
    text that a third of all rows hold reaches its reducer once per map task. A null text counts as empty."""
    t = texts.select(F.coalesce("text", F.lit("")).alias("text"))
    return bucketed(t.select(*text_key(F.col("text")), "text").groupBy("c1", "c2")
                    .agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), ["c1", "c2"], "texts")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, ends) of an Arrow string or binary column without nulls, uncopied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], (offsets[1:] - offsets[0]).astype(np.int64)


def byte_chunks(ends: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (a longer text is a range of its own)."""
    lo = 0
    while lo < len(ends):
        begin = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, begin + most, side="right")))
        yield lo, hi
        lo = hi


def as_batch(columns: dict[str, np.ndarray | list | pa.Array], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns[k] if isinstance(columns[k], pa.Array) else pa.array(columns[k], type=t) for k, t in types.items()],
        schema=pa.schema(list(types.items())))


def with_text_columns(docs: DataFrame, kernel: Callable[[pa.Array], Iterator[pa.RecordBatch]],
                      ddl: str, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the columns that ``kernel`` makes of the whole texts (null: empty).

    ``kernel`` gets an Arrow array of texts and yields batches of the new columns for rows in order.
    ``keep``: the columns of ``docs`` to keep (default all; those that ``ddl`` names are replaced)."""
    new = [x.strip().split(" ")[0] for x in ddl.split(";")]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    rest = [c for c in kept if c != "text"]
    rows = docs.select(F.struct(F.lit(True).alias("_"), *rest).alias("row"), F.col("text").cast("string").alias("text"))
    carried = "text" in kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, text, done = batch.column("row"), batch.column("text"), 0
            for out in kernel(text.fill_null("")):
                n = out.num_rows
                arrays = [row.slice(done, n), *([text.slice(done, n)] if carried else []), *out.columns]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", *["text"] * carried, *out.schema.names])
                done += n

    kind = rows.schema["row"].dataType.simpleString()
    made = rows.mapInArrow(run, f"row {kind}, {'text string, ' * carried}{ddl.replace(';', ',')}")
    return made.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in kept], *new)


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_docs: int) -> DataFrame:
    """doc_id, text and label of at most ``max_docs`` labelled documents. Documents are chosen by a hash of
    their id among labels of 0 or 1 (of repeated labels the greatest counts for ``toxic``, the least for others); of rows
    that share an id the least text counts, so an id that very many rows have is one row all the same."""
    of = (F.max if label == "toxic" else F.min)(label)
    sample = F.broadcast(                               # at most max_docs rows of 12 bytes
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(of.alias(label))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.first(label).alias(label)))
