"""URL filter: rules first, then exact membership in a list by a cascade of Bloom filters.

Level 0 encodes the listed keys; of all other keys of the corpus, those that pass it by mistake are encoded in
level 1; the listed keys that pass level 1 by mistake in level 2, and so on until no mistake is left. As the
key universe is complete, the first level that a key fails tells exactly whether it is listed, and pages are
judged by looking up bits, without a join. Only DataFrame functions run here, no Python.

A filter is an array of 64-bit words that reaches the tasks as a scalar subquery. Its size follows from the listed
keys (at most 29 bits each). A list too long for filters of ``MAX_FILTER_BYTES`` is split by a hash of the key into
partitions with a cascade each: pages are written once in folders by that hash, and each folder is judged by its own
cascade, so a task holds the filters of one partition, and a host that very many pages have is still read by many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodlake.llm.common import materialized, prepare
from moodlake.session import scratch_dir

#: Bytes of one filter that may be sent to every task.
MAX_FILTER_BYTES = 32 << 20

# FIXED VALUES: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Host labels of the block list, and characters of html under which a host's pages are thin on average.
LISTED_LABELS = ["casino-win", "cheap-pills", "spam-farm"]
THIN_HTML = 3000
#: Fewest false positives that a level aims at, and the bits that a key then takes.
_LEAST_RATE = 1e-6
_KEY_BITS = -math.log(_LEAST_RATE) / math.log(2) ** 2


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z in lower case; then up to ``?``
    or ``#``. Both empty for a null url or one without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(whole, pattern, 2)


def apply_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path begins the
    url's; null where none fits."""
    rule = verdict = None
    for said, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = (F.when if rule is None else rule.when)(fits, F.lit(rule_host + rule_path))
        verdict = (F.when if verdict is None else verdict.when)(fits, F.lit(said))
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def _bit(key: Column, level: int, j: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.lit(j), key), F.lit(bits).cast("long"))


class Level:
    """One Bloom filter: its words in the shared folder, and the test of a key."""

    def __init__(self, keys: DataFrame, level: int, n: int, rate: float):
        spark = keys.sparkSession
        self.level = level
        self.hashes = max(1, round(-math.log2(rate)))
        self.bits = 64 * max(1, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
        spots = keys.select(F.explode(F.array(*[_bit(F.col("key"), level, j, self.bits) for j in range(self.hashes)])).alias("bit"))
        words = (spots.select(F.shiftright("bit", 6).alias("at"),
                              F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("word"))
                 .unionByName(spark.range(self.bits // 64).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("word")))
                 .groupBy("at").agg(F.bit_or("word").alias("word")))
        # one row of at most MAX_FILTER_BYTES
        self.words = materialized(words.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))),
                                                        lambda x: x["word"]).alias("words")), f"level{level}")

    def passes(self, key: Column) -> Column:
        words = self.words.scalar()
        out = None
        for j in range(self.hashes):
            bit = _bit(key, self.level, j, self.bits)
            word = F.get(words, F.shiftright(bit, 6).cast("int"))
            one = F.call_function("getbit", word, bit.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
            out = one if out is None else out & one
        return out


def build_cascade(universe: DataFrame, listed: DataFrame) -> list[Level]:
    """Levels that tell the listed keys exactly among the universe's (column ``key`` in both; nulls and repeats
    are dropped). No level when nothing is listed."""
    marks = listed.filter("key IS NOT NULL").select("key").distinct().withColumn("listed", F.lit(True))
    left = materialized(universe.filter("key IS NOT NULL").select("key").distinct().join(marks, "key", "left")
                        .select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "keys")
    levels: list[Level] = []
    while True:
        inside = len(levels) % 2 == 0
        n = {r["listed"]: r["n"] for r in left.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
        own, others = n.get(inside, 0), n.get(not inside, 0)
        if not own:
            return levels
        # level 0 lets through about as many other keys as are listed, later levels half of them
        rate = min(0.5, max(own / max(others, 1) * math.sqrt(0.5), _LEAST_RATE)) if not levels else 0.5
        level = Level(left.filter(F.col("listed") == inside), len(levels), own, rate)
        levels.append(level)
        left = materialized(left.filter((F.col("listed") == inside) | level.passes(F.col("key"))), "keys")
        if left.filter(F.col("listed") != inside).isEmpty():
            return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: the first level it fails decides."""
    out = None
    for i, level in enumerate(levels):
        fails = ~level.passes(key)
        out = (F.when if out is None else out.when)(fails, F.lit(i % 2 == 1))
    return F.lit(False) if out is None else out.otherwise(F.lit(len(levels) % 2 == 1))


def partitions(listed: DataFrame) -> int:
    """Into how many partitions a list goes, for filters of at most ``MAX_FILTER_BYTES`` (with room for uneven ones)."""
    n = listed.filter("key IS NOT NULL").agg(F.count_distinct("key")).first()[0]
    return max(1, math.ceil(1.2 * n * _KEY_BITS / 8 / MAX_FILTER_BYTES))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict: the longest fitting rule's, else block for a host in ``listed``
    (column ``key``) and allow for others. All rows and columns stay; columns of the new names are replaced. A null url,
    or one without ``://``, has an empty host and path; repeated rows stay, and an empty table gives no rows."""
    spark = pages.sparkSession
    prepare(spark)
    new = ["host", "path", "rule", "verdict"]
    kept = [c for c in pages.columns if c not in new]
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.struct(*kept).alias("row"), host.alias("host"), path.alias("path"))
    rule, said = apply_rules(F.col("host"), F.col("path"), RULES if rules is None else rules)

    def judged(own: DataFrame, levels: list[Level]) -> DataFrame:
        method = F.when(is_listed(F.col("host"), levels), F.lit("block")).otherwise(F.lit("allow"))
        return own.select("row.*", "host", "path", rule.alias("rule"), F.coalesce(said, method).alias("verdict"))

    n = partitions(listed)
    if n == 1:
        return judged(rows, build_cascade(rows.select(F.col("host").alias("key")), listed))
    part = lambda key: F.pmod(F.xxhash64(F.lit(-1), key), F.lit(n)).cast("int")
    folder = scratch_dir(spark, "pages-by-host")
    rows.withColumn("part", part(F.col("host"))).write.partitionBy("part").parquet(folder)
    staged = spark.read.schema(rows.withColumn("part", F.lit(0)).schema).parquet(folder)
    marks = materialized(listed.filter("key IS NOT NULL").select("key", part(F.col("key")).alias("part")), "listed")
    out = None
    for i in range(n):
        own = staged.filter(F.col("part") == i).drop("part")
        done = judged(own, build_cascade(own.select(F.col("host").alias("key")), marks.filter(F.col("part") == i)))
        out = done if out is None else out.unionByName(done)
    return out


def listed_hosts(pages: DataFrame, labels: list[str] = LISTED_LABELS, thin: int = THIN_HTML) -> DataFrame:
    """The block list (column ``key``): hosts that have one of the labels, and hosts whose pages hold fewer than ``thin``
    characters of html on average (a null html counts as empty)."""
    host, _ = url_parts(F.col("url"))
    sites = (pages.select(host.alias("key"), F.coalesce(F.length("html"), F.lit(0)).alias("size"))
             .groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    spam = F.arrays_overlap(F.split("key", r"\."), F.array(*map(F.lit, labels)))
    return sites.filter(spam | (F.col("size") < thin * F.col("n"))).select("key")
