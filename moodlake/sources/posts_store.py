"""The posts table as a Parquet dataset partitioned by created_date.

Parquet has no MERGE, so insert-if-absent is an anti join against the stored
keys followed by an append. The rows to append are checkpointed first (to the
shared ``spark.checkpoint.dir``): the returned "new rows" frame then does not
re-evaluate against the table it has just grown, and a lost executor only
re-runs tasks of a job whose output commit is atomic.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodlake.functions.timefns import as_of_col
from moodlake.operators.ingest import POST_KEY, insert_new, split_null_keys

PARTITION_COL = "created_date"


def with_partition(df: DataFrame) -> DataFrame:
    return df.withColumn(PARTITION_COL, F.to_date("created_at"))


#: Bytes of a merged file.
FILE_BYTES = 256 << 20
#: Sizes that a row group's filter may have: halves of a megabyte, of which the one that fits its keys is stored.
BLOOM_SIZES = 15
BLOOM_COLUMNS = ("id", "external_id")


def with_blooms(writer, columns=BLOOM_COLUMNS):
    """A Parquet writer whose files hold a Bloom filter of each of ``columns`` per row group: ids are hashes, so their
    min/max skip nothing, but a point lookup reads only the row groups that may hold the id. A filter is as large as the
    keys of its row group need, so a day of few posts does not store a filter for many."""
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.candidates.number#{c}", str(BLOOM_SIZES))
    return writer


class PostsStore:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path = spark, path
        self.schema = T.StructType(list(schema.fields) + [T.StructField(PARTITION_COL, T.DateType(), True)])

    def read(self) -> DataFrame:
        """The stored rows; an empty frame only when nothing was written yet. Any
        other failure propagates: treating an unreadable store as empty would
        make insert-if-absent insert every post again."""
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def insert(self, batch: DataFrame, key=POST_KEY, order=("k",), prepare=None) -> DataFrame:
        """Append the batch's new rows; return exactly those rows.

        ``prepare`` (linking, scoring, embedding) runs once, on the rows that are new. Rows with a NULL in the key, and
        rows that ``prepare`` marks in a boolean column ``__reject``, go to ``rejected()`` instead."""
        new = insert_new(self.read(), with_partition(batch), key, order, prune_col=PARTITION_COL)
        if prepare is not None:
            new = with_partition(prepare(new.drop(PARTITION_COL)))
        names = [f.name for f in self.schema.fields]
        reject = F.coalesce("__reject", F.lit(False)) if "__reject" in new.columns else F.lit(False)
        staged = new.select(*names, reject.alias("__reject")).checkpoint(eager=True)
        kept = staged.where(~F.col("__reject")).select(*names)
        with_blooms(_sorted_by_time(kept).write.mode("append")).partitionBy(PARTITION_COL).parquet(self.path)
        self._reject(staged.where("__reject").drop(PARTITION_COL, "__reject"))
        self._reject(split_null_keys(batch, key)[1])
        return kept.drop(PARTITION_COL)

    def _reject(self, rows: DataFrame) -> None:
        cols = [f.name for f in self.schema.fields if f.name in rows.columns]
        rows = rows.select(F.to_json(F.struct(*cols)).alias("record"), F.current_timestamp().alias("rejected_at"))
        if not rows.isEmpty():
            rows.write.mode("append").parquet(f"{self.path}_rejected")

    def rejected(self) -> DataFrame:
        """The rows that inserts refused, as JSON, once per attempt."""
        try:
            return self.spark.read.schema("record string, rejected_at timestamp").parquet(f"{self.path}_rejected")
        except Exception as e:  # noqa: BLE001 - nothing was refused yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "record string, rejected_at timestamp")

    def scan(self, start=None, end=None) -> DataFrame:
        """Rows with start <= created_at < end; the matching created_date predicate
        is added so whole partitions are skipped (PartitionFilters)."""
        df = self.read()
        if start is not None:
            s = as_of_col(start)
            df = df.where((F.col(PARTITION_COL) >= F.to_date(s)) & (F.col("created_at") >= s))
        if end is not None:
            e = as_of_col(end)
            df = df.where((F.col(PARTITION_COL) <= F.to_date(e)) & (F.col("created_at") < e))
        return df.drop(PARTITION_COL)


def _sorted_by_time(df: DataFrame) -> DataFrame:
    """Range partitioning on created_at (sampled bounds) gives each task a few
    consecutive days — few files per task — and splits even a hot day across
    tasks; rows sorted by time inside files let Parquet min/max statistics skip
    row groups."""
    return df.repartitionByRange("created_at").sortWithinPartitions("created_at")


def write_partitioned(df: DataFrame, path: str) -> None:
    """Time-partitioned storage of a fact table (layout of ``_sorted_by_time``)."""
    with_blooms(_sorted_by_time(with_partition(df)).write.mode("overwrite")).partitionBy(PARTITION_COL).parquet(path)


def read_dates(spark: SparkSession, path: str, dates: list, schema: T.StructType) -> DataFrame | None:
    """The rows of some dates of a date-first dataset, listing only their folders; None when none of them exists."""
    files = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    there = [p for p in (f"{path}/{PARTITION_COL}={d}" for d in sorted(dates)) if files(p).getFileSystem(conf).exists(files(p))]
    return spark.read.schema(schema).option("basePath", path).parquet(*there) if there else None


def store_dates(spark: SparkSession, path: str) -> list[str]:
    """The dates a date-first dataset holds: one listing of its first level."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = files.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(files):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(files)]
    return [n.split("=", 1)[1] for n in names if n.startswith(f"{PARTITION_COL}=")]


def compact_closed_dates(spark: SparkSession, path: str, before, key=POST_KEY) -> int:
    """Merge the batch folders of every date before ``before`` (of the live store, ``created_date=D/batch_id=N``) into the
    folder of the date's newest batch; returns how many dates were merged.

    Run it for dates that no running batch still writes to. A date gets a file per FILE_BYTES of its folders, so a hot day is
    merged by many tasks. The merged rows are staged first, then put in place, then the
    older folders go; a run that died in between is repeated, as copies of a post (the same key) are merged into one."""
    from moodlake.operators.ingest import first_write
    from moodlake.session import scratch_dir

    files = spark._jvm.org.apache.hadoop.fs.Path
    fs = files(path).getFileSystem(spark._jsc.hadoopConfiguration())
    batches = {}
    for d in store_dates(spark, path):
        if d < str(before):
            names = [x.getPath().getName() for x in fs.listStatus(files(f"{path}/{PARTITION_COL}={d}"))]
            batches[d] = sorted(int(n.split("=", 1)[1]) for n in names if n.startswith("batch_id="))
    batches = {d: b for d, b in batches.items() if len(b) > 1}
    if not batches:
        return 0
    n_files = {d: 1 + fs.getContentSummary(files(f"{path}/{PARTITION_COL}={d}")).getLength() // FILE_BYTES for d in batches}
    sizes = spark.createDataFrame([(dt.date.fromisoformat(d), n) for d, n in n_files.items()], f"{PARTITION_COL} date, __files long")
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/{PARTITION_COL}={d}" for d in batches])
    newest = rows.groupBy(PARTITION_COL).agg(F.max("batch_id").alias("__newest"))
    merged = first_write(rows, [*key, PARTITION_COL], ("batch_id",)).join(newest.join(sizes, PARTITION_COL), PARTITION_COL)
    stage = scratch_dir(spark, "compacted")
    (merged.withColumn("batch_id", F.col("__newest").cast("long")).withColumn("__file", F.pmod(F.xxhash64(*key), F.col("__files")))
     .repartition(sum(n_files.values()), PARTITION_COL, "__file").drop("__newest", "__files", "__file")
     .write.partitionBy(PARTITION_COL).parquet(stage))
    (with_blooms(spark.read.parquet(stage).write.mode("overwrite")).option("partitionOverwriteMode", "dynamic")
     .partitionBy(PARTITION_COL, "batch_id").parquet(path))
    for d, own in batches.items():
        for b in own[:-1]:
            fs.delete(files(f"{path}/{PARTITION_COL}={d}/batch_id={b}"), True)
    return len(batches)
