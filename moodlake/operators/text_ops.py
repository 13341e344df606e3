"""Text-table operators: hashing, exact-duplicate groups, per-source caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodlake.functions.text import post_text, text_hash


def with_text_hash(posts: DataFrame, out: str = "txt_hash") -> DataFrame:
    return posts.withColumn(out, text_hash(post_text()))


def exact_duplicate_groups(hashed: DataFrame, hash_col: str = "txt_hash") -> DataFrame:
    """Hashes shared by more than one post: n and the first id. One hash
    aggregation with map-side partial counts, so a hash held by a third of all
    rows is reduced in every map task before the shuffle."""
    return (hashed.groupBy(hash_col)
            .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
            .where(F.col("n") > 1))


class DuplicateIndex:
    """Posts' text hashes stored in buckets of the hash, so groups of new posts with stored ones are found without moving
    the stored side: only the new posts are shuffled, to the buckets. The index is a folder; a session that opens it makes
    a catalog entry of its own for it."""

    def __init__(self, spark, path: str, buckets: int, id_type: str = "bigint"):
        import uuid

        self.spark, self.buckets = spark, buckets
        self.table = f"duplicate_index_{uuid.uuid4().hex[:12]}"
        spark.sql(f"CREATE TABLE {self.table} (id {id_type}, txt_hash STRING) USING parquet "
                  f"CLUSTERED BY (txt_hash) INTO {int(buckets)} BUCKETS LOCATION '{path}'")

    def insert(self, hashed: DataFrame) -> None:
        """Adds posts (id, txt_hash), a file per bucket. Call it with posts that are new."""
        (hashed.select("id", "txt_hash").repartition(self.buckets, "txt_hash").sortWithinPartitions("txt_hash")
         .write.insertInto(self.table))

    def stored(self) -> DataFrame:
        return self.spark.table(self.table)

    def groups(self) -> DataFrame:
        """Every group of equal texts, as ``exact_duplicate_groups``: aggregated bucket by bucket."""
        return exact_duplicate_groups(self.stored())

    def groups_with(self, hashed: DataFrame) -> DataFrame:
        """txt_hash, n, first_id of the groups that new posts (not inserted yet) form among themselves and with stored ones."""
        new = (hashed.groupBy("txt_hash").agg(F.count(F.lit(1)).alias("new_n"), F.min("id").alias("new_id"))
               .repartition(self.buckets, "txt_hash"))
        old = self.stored().groupBy("txt_hash").agg(F.count(F.lit(1)).alias("old_n"), F.min("id").alias("old_id"))
        return (new.join(old, "txt_hash", "left")
                .select("txt_hash", (F.col("new_n") + F.coalesce("old_n", F.lit(0))).alias("n"), F.least("new_id", "old_id").alias("first_id"))
                .where(F.col("n") > 1))

    def close(self) -> None:
        """Drops the catalog entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def per_source_cap(df: DataFrame, by, order, cap: int) -> DataFrame:
    """First ``cap`` rows per group by ``order`` (row_number <= cap). Catalyst plans a
    partial WindowGroupLimit before the shuffle, so no group sends more than
    ``cap`` rows per map task, however hot."""
    by = [by] if isinstance(by, str) else list(by)
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*by).orderBy(*[F.col(o) for o in order])
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= cap)
