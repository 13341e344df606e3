"""Symbol linking: text -> up to five ticker symbols.

Two matchers, both evaluated inside the row as built-in expressions (no Python,
no shuffle) for small dictionaries: whitelist membership of candidate tokens (hash-set intersection
against a literal array) and keyword containment in the lower-cased text.
Dictionaries are parameters; a DataFrame dimension is size-checked before it
is turned into literals, larger dimensions take an explode + join path, and larger
keyword dictionaries a join on rare grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodlake.functions.dictionaries import FEED_SOURCE, KEYWORDS, MAX_SYMBOLS, STOPLIST
from moodlake.functions.text import candidate_symbols

# Above this many whitelist keys the literal-array form is replaced:
# array_intersect hashes the literal side once per row, so its cost per row
# grows with the dictionary. Up to MAX_BROADCAST_KEYS the key map is broadcast
# and probed in O(1) per candidate without any shuffle; beyond it the
# candidates are exploded and joined to the key map.
MAX_LITERAL_KEYS = 2_000
MAX_BROADCAST_KEYS = 1_000_000


def symbol_keys(tickers: DataFrame) -> DataFrame:
    """(key, symbol): upper(symbol) plus every whitespace-separated part of the
    symbol longer than two characters, upper-cased. A key claimed by several
    symbols maps to the smallest symbol (deterministic)."""
    sym = F.col("symbol")
    whole = tickers.select(F.upper(sym).alias("key"), sym.alias("symbol"))
    parts = (tickers.select(F.explode(F.split(F.trim(F.lower(sym)), r"\s+")).alias("part"), sym.alias("symbol"))
             .where(F.length("part") > 2)
             .select(F.upper("part").alias("key"), "symbol"))
    return (whole.unionByName(parts).where(F.col("key").isNotNull() & (F.length("key") > 0))
            .groupBy("key").agg(F.min("symbol").alias("symbol")))


def _str_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


_HELD: dict = {}


def _version(keys: DataFrame) -> tuple:
    """What tells the contents of a key map apart: one aggregation, a row to the driver."""
    h = F.xxhash64("key", "symbol")
    return tuple(keys.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def whitelist_from(tickers: DataFrame, limit: int = MAX_LITERAL_KEYS) -> dict[str, str] | None:
    """The key map of a symbol dimension if it is provably bounded (at most ``limit`` keys); None means: use the join
    path. It is collected when its content has changed: a live query asks again with every micro-batch."""
    keys = symbol_keys(tickers)
    version = _version(keys)
    if version[0] > limit:
        return None
    at = (tickers.sparkSession.sparkContext.applicationId, "whitelist")
    if _HELD.get(at, (None, None))[0] != version:
        head = keys.toPandas()  # Arrow batches: compact even near the bound
        _HELD[at] = (version, dict(zip(head["key"], head["symbol"])))
    return _HELD[at][1]


def whitelist_hits_broadcast(cands: Column, key_map: dict[str, str], stoplist=()) -> Column:
    """Large-dictionary form of ``whitelist_hits``: the key map is broadcast once
    (loaded once per Python worker) and an Arrow-batched pandas UDF probes it
    with each row's candidate tokens — only the candidate array crosses to
    Python, and nothing is shuffled (the join form shuffles every text twice)."""
    import pandas as pd
    from pyspark.sql import SparkSession
    from pyspark.sql.functions import pandas_udf

    bc = _broadcast(SparkSession.getActiveSession(), key_map, frozenset(stoplist))

    def hits(cands):
        m = bc.value
        return pd.Series([sorted({m[c] for c in cs if c in m}) if cs is not None else [] for cs in cands])

    hits.__annotations__ = {"cands": pd.Series, "return": pd.Series}  # real types, not postponed strings
    # distinct tokens only cross to Python (a text repeats its words many times)
    return pandas_udf(hits, "array<string>")(F.array_distinct(cands))


def _broadcast(spark, key_map: dict[str, str], stoplist: frozenset):
    """The broadcast of a key map, made once per session and map; the one it replaces is released."""
    at = (spark.sparkContext.applicationId, "broadcast")
    held = _HELD.get(at)
    if held is None or held[1] != stoplist or (held[0] is not key_map and held[0] != key_map):
        if held is not None:
            held[2].unpersist()
        sent = spark.sparkContext.broadcast({k: v for k, v in key_map.items() if k not in stoplist})
        held = _HELD[at] = (key_map, stoplist, sent)
    return held[2]


def whitelist_hits(cands: Column, whitelist, stoplist=STOPLIST) -> Column:
    """Distinct candidates that are whitelist keys and not stop words, mapped to symbols."""
    wl = whitelist if isinstance(whitelist, dict) else {k: k for k in whitelist}
    if len(wl) > MAX_LITERAL_KEYS:
        return whitelist_hits_broadcast(cands, wl, stoplist)
    keys = sorted(k for k in wl if k not in set(stoplist))
    hits = F.array_intersect(cands, _str_array(keys))
    if all(wl[k] == k for k in keys):
        return hits
    m = F.map_from_arrays(_str_array(keys), _str_array([wl[k] for k in keys]))
    return F.transform(hits, lambda k: F.element_at(m, k))


# Above this many keywords the in-row CASE list (one substring scan of the text
# per keyword, and a generated method that outgrows codegen) is replaced by the
# rare-gram join. 64 keeps the default dictionary in whole-stage codegen.
MAX_LITERAL_KEYWORDS = 64
# Characters of a gram, and into how many parts each gram's texts are dealt.
GRAM = 3
GRAM_SALTS = 16
# Most characters of keywords and symbols that are sent to every task; the join with a larger dictionary is a shuffle.
MAX_BROADCAST_CHARS = 32 << 20
# One text in so many tells how rare a gram is (which texts are read for that changes the cost, never a link).
GRAM_SAMPLE = 32
# Characters of a longer keyword's gram in a broadcast dictionary.
LONG_GRAM = GRAM + 1
# Most characters that a token is made of; a dictionary of more has tokens of anything but white space.
MAX_ALPHABET = 512


def keyword_pairs(keywords) -> list[tuple[str, str]]:
    """(keyword, symbol) pairs of a list; empty ones mean nothing and are left out."""
    return [(k, s) for k, s in keywords if k and s]


def keyword_hits(lower_text: Column, keywords=KEYWORDS) -> Column:
    """Symbols whose keyword occurs as a substring of the lower-cased text.
    One CASE per keyword inside array(), NULLs removed with array_except (not
    array_compact, which is a lambda filter): no lambda, so the expression
    stays inside whole-stage codegen. For a few keywords; ``keyword_links`` takes dictionaries of any size."""
    keywords = keyword_pairs(keywords)
    if not keywords:
        return F.array().cast("array<string>")
    hits = F.array(*[F.when(F.contains(lower_text, F.lit(k)), F.lit(s)) for k, s in keywords])
    return F.array_except(hits, F.array(F.lit(None).cast("string")))


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text, found in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(" + "." * size + "))"), F.lit(1)))


def _gram_rows(texts: DataFrame, sizes: list[int], *carried: str) -> DataFrame:
    grams = _grams(F.col("__lt"), sizes[0])
    for n in sizes[1:]:
        grams = F.concat(grams, _grams(F.col("__lt"), n))
    return texts.select("__t1", "__t2", *carried, F.explode(grams).alias("__gram"))


def _unit_rows(texts: DataFrame, sizes: list[int], token: str | None, has: dict) -> DataFrame:
    """(__t1, __t2, __kind, __unit, __gram): what the keywords that the dictionary ``has`` are looked for in. Kind 0, the
    distinct runs of up to ``GRAM`` characters; 1, the distinct tokens (runs that match ``token``) with their distinct runs of
    ``LONG_GRAM``; 2, the text itself with those of its own, for longer keywords with white space. The short runs are those
    of the tokens, unless a short keyword has white space."""
    text, grams, tokens, kinds = F.col("__lt"), F.col("__grams"), F.col("__tokens"), []
    if token:
        texts = texts.withColumn("__tokens", F.array_distinct(F.regexp_extract_all(text, F.lit(token), F.lit(0))))
    if has["short_tight"] or has["short_spaced"]:
        if has["short_spaced"]:
            runs, ends = _grams(text, GRAM), lambda n, k: F.array(F.substring(text, -k, n))
        else:
            runs = F.array_distinct(F.regexp_extract_all(F.array_join(tokens, " "), F.lit(r"(?=(\S{%d}))" % GRAM), F.lit(1)))
            ends = lambda n, k: F.transform(tokens, lambda t: F.substring(t, -k, n))
        texts, all_runs = texts.withColumn("__grams", runs), [grams]
        for n in sizes:     # shorter runs begin a longer one, but for those at the end
            all_runs += [F.transform(grams, lambda g: F.substring(g, 1, n)), *[ends(n, k) for k in range(n, GRAM)]]
        kinds.append((0, F.array_distinct(F.concat(*all_runs))))
    if has["long_tight"]:
        kinds.append((1, tokens))
    if has["long_spaced"]:
        kinds.append((2, F.array(text)))
    # outer explodes: from a plain one Catalyst infers a filter, below which the array would be made a second time
    kinds = F.explode_outer(F.array(*[F.struct(F.lit(k).alias("kind"), u.alias("units")) for k, u in kinds])).alias("__k")
    units = (texts.select("__t1", "__t2", kinds)
             .select("__t1", "__t2", F.col("__k.kind").alias("__kind"), F.explode_outer("__k.units").alias("__unit")))
    own = F.when(F.col("__kind") == 0, F.array("__unit")).otherwise(_grams(F.col("__unit"), LONG_GRAM))
    return units.select("__t1", "__t2", "__kind", "__unit", F.explode_outer(own).alias("__gram"))


def _token_pattern(keywords: DataFrame) -> str:
    """What a token of these keywords (without white space) is: a run of the characters that they are made of, so a keyword
    that a text holds is in one of its tokens."""
    chars = [r[0] for r in keywords.select(F.explode(F.regexp_extract_all("keyword", F.lit("(?s)."), F.lit(0))).alias("c"))
             .distinct().limit(MAX_ALPHABET + 1).collect()]
    return r"\S+" if len(chars) > MAX_ALPHABET else "[" + "".join(sorted(f"\\x{{{ord(c):x}}}" for c in chars)) + "]+"


def _broadcast_links(texts: DataFrame, kw: DataFrame, sizes: list[int]) -> DataFrame:
    """``keyword_links`` with a dictionary of a checked size. A keyword of up to ``GRAM`` characters is one of the text's
    runs (of its tokens' runs, which are fewer). A longer one is looked for in the text's distinct tokens (one with white space: in the text), those that hold
    its rarest run of ``LONG_GRAM``; so no text is gone through once per keyword. All of a text's rows stay in its task."""
    spaced, short = F.col("keyword").rlike(r"\s"), F.length("keyword") <= GRAM
    has = kw.agg(F.bool_or(short & ~spaced).alias("short_tight"), F.bool_or(short & spaced).alias("short_spaced"),
                 F.bool_or(~short & ~spaced).alias("long_tight"), F.bool_or(~short & spaced).alias("long_spaced")).first().asDict()
    if not any(has.values()):
        return texts.limit(0).select("__t1", "__t2", F.array().cast("array<string>").alias("symbols"))
    token = _token_pattern(kw.where(~spaced)) if has["short_tight"] or has["long_tight"] else None
    longer = kw.where(~short).select("keyword", F.when(spaced, 2).otherwise(1).alias("__kind")).distinct()
    rows = lambda some: _unit_rows(some, sizes, token, has)
    common = (rows(texts.where(F.pmod("__t1", F.lit(GRAM_SAMPLE)) == 0)).where("__kind > 0")
              .groupBy("__kind", "__gram").agg(F.count(F.lit(1)).alias("__rows")))
    keyed = (longer.withColumn("__gram", F.explode(_grams(F.col("keyword"), LONG_GRAM))).join(common, ["__kind", "__gram"], "left")
             .groupBy("keyword", "__kind").agg(F.min(F.struct(F.coalesce("__rows", F.lit(0)), "__gram"))["__gram"].alias("__gram")))
    met = kw.where(short).select("keyword", F.lit(0).alias("__kind"), F.col("keyword").alias("__gram")).distinct()
    found = (rows(texts).join(F.broadcast(met.unionByName(keyed).join(kw, "keyword")), ["__kind", "__gram"])
             .where((F.col("__kind") == 0) | F.contains("__unit", "keyword")))
    return found.groupBy("__t1", "__t2").agg(F.collect_set("symbol").alias("symbols"))


def keyword_links(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(__t1, __t2, symbols) of distinct lower-cased texts (__t1, __t2, __lt) that hold keywords (keyword, symbol) as
    substrings: a join on rare grams, for dictionaries and texts of any size.

    A dictionary of a checked size is broadcast to the texts (``_broadcast_links``). With a larger one both sides are
    shuffled: each keyword is keyed by its rarest run of three characters (a shorter one by itself), texts explode their
    distinct runs, meet the keywords on them, and longer keywords are verified with ``contains``; a run that very many
    texts hold is dealt into ``GRAM_SALTS`` parts on the texts' side, and few keywords have none that is rarer. Nothing is
    collected but which lengths under three occur, how large the dictionary is, and of a broadcast one its characters."""
    kw = (keywords.select(F.col("keyword").cast("string"), F.col("symbol").cast("string"))
          .where((F.length("keyword") > 0) & (F.length("symbol") > 0)).distinct())
    short = [r[0] for r in kw.where(F.length("keyword") < GRAM).select(F.length("keyword").alias("n")).distinct().orderBy("n").collect()]
    size = kw.agg(F.sum(F.length("keyword") + F.length("symbol"))).first()[0] or 0
    if size <= MAX_BROADCAST_CHARS:
        return _broadcast_links(texts, kw, short)
    own = kw.select("keyword", F.explode(F.when(F.length("keyword") < GRAM, F.array("keyword"))
                                         .otherwise(_grams(F.col("keyword"), GRAM))).alias("__gram")).distinct()
    sampled = texts.where(F.pmod("__t1", F.lit(GRAM_SAMPLE)) == 0)
    common = _gram_rows(sampled, [GRAM]).groupBy("__gram").agg(F.count(F.lit(1)).alias("__texts"))
    keyed = (own.join(common, "__gram", "left").groupBy("keyword")
             .agg(F.min(F.struct(F.coalesce("__texts", F.lit(0)), "__gram"))["__gram"].alias("__gram")))
    keyed = keyed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(GRAM_SALTS - 1))))
    rows = _gram_rows(texts, [GRAM, *short]).withColumn("__salt", F.pmod("__t2", F.lit(GRAM_SALTS)).cast("int"))
    pairs = rows.join(keyed, ["__gram", "__salt"]).select("__t1", "__t2", "keyword")
    whole = pairs.where(F.length("keyword") <= GRAM)        # the gram is the keyword
    longer = (pairs.where(F.length("keyword") > GRAM).join(texts, ["__t1", "__t2"])
              .where(F.contains("__lt", "keyword")).select("__t1", "__t2", "keyword"))
    return (whole.unionByName(longer).join(kw, "keyword").groupBy("__t1", "__t2")
            .agg(F.collect_set("symbol").alias("symbols")))


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit(1), text).alias("__t2")]


def with_keyword_symbols(df: DataFrame, text_col: str, keywords, out: str) -> DataFrame:
    """Adds ``out``: the symbols whose keyword the lower-cased text holds (unordered). A short list of pairs is tested in
    the row; a longer one, or a dictionary DataFrame, is joined: each distinct text once, its symbols coming back by its
    128-bit hash, so no id is needed and copies are one text."""
    lt = F.lower(F.col(text_col))
    if not isinstance(keywords, DataFrame):
        pairs = keyword_pairs(keywords)
        if len(pairs) <= MAX_LITERAL_KEYWORDS:
            return df.withColumn(out, keyword_hits(lt, pairs))
        keywords = df.sparkSession.createDataFrame(pairs, "keyword string, symbol string")
    texts = (df.where(F.length(text_col) > 0).select(*_text_key(lt), lt.alias("__lt"))
             .groupBy("__t1", "__t2").agg(F.first("__lt").alias("__lt")))
    links = keyword_links(texts, keywords).withColumnRenamed("symbols", out)
    joined = df.drop(out).withColumns(dict(zip(("__t1", "__t2"), _text_key(lt)))).join(links, ["__t1", "__t2"], "left")
    return joined.withColumn(out, F.coalesce(out, F.array().cast("array<string>"))).drop("__t1", "__t2")


def finish(symbols: Column, max_symbols: int = MAX_SYMBOLS) -> Column:
    """Deterministic truncation: the first `max_symbols` of the sorted distinct set."""
    return F.slice(F.sort_array(F.array_distinct(symbols)), 1, max_symbols)


def extract_symbols(df: DataFrame, text_col: str = "text", whitelist=None, stoplist=STOPLIST,
                    keywords=KEYWORDS, max_symbols: int = MAX_SYMBOLS, out: str = "tickers",
                    id_col: str = "id") -> DataFrame:
    """Add ``out`` = linked symbols of ``text_col``. ``whitelist`` is a key list, a
    key->symbol dict or a symbol DataFrame (column ``symbol``)."""
    if isinstance(whitelist, DataFrame):
        wl = whitelist_from(whitelist, MAX_BROADCAST_KEYS)  # bounded collect: at most the limit + 1 keys
        if wl is None:
            return extract_symbols_join(df, text_col, whitelist, stoplist, keywords, max_symbols, out, id_col)
        whitelist = wl
    t = F.col(text_col)
    staged = with_keyword_symbols(df, text_col, keywords, f"__kw_{out}")
    wl_hits = whitelist_hits(candidate_symbols(t), whitelist or {}, stoplist)
    linked = F.when(t.isNull() | (F.length(t) == 0), F.array().cast("array<string>")).otherwise(
        finish(F.concat(wl_hits, F.col(f"__kw_{out}")), max_symbols))
    return staged.withColumn(out, linked).drop(f"__kw_{out}")


def extract_symbols_join(df: DataFrame, text_col: str, tickers: DataFrame, stoplist=STOPLIST,
                         keywords=KEYWORDS, max_symbols: int = MAX_SYMBOLS, out: str = "tickers",
                         id_col: str = "id") -> DataFrame:
    """Large-dictionary form: links depend on the text alone, so each distinct text's candidates are exploded once and
    joined to the key map (Spark chooses broadcast or shuffle join from statistics), and the links return to the rows by
    the text's 128-bit hash. No unique or non-NULL id is needed, and copies of one text are one text."""
    t = F.col(text_col)
    key = _text_key(t)
    keys = symbol_keys(tickers).where(~F.col("key").isin(list(stoplist)))
    toks = (df.where(t.isNotNull()).select(*key, F.explode(F.array_distinct(candidate_symbols(text_col))).alias("key"))
            .distinct().join(keys, "key").groupBy("__t1", "__t2").agg(F.collect_set("symbol").alias(out + "__wl")))
    base = with_keyword_symbols(df, text_col, keywords, out + "__kw").withColumn("__t1", key[0]).withColumn("__t2", key[1])
    joined = base.join(toks, ["__t1", "__t2"], "left")
    wl = F.coalesce(F.col(out + "__wl"), F.array().cast("array<string>"))
    linked = F.when(t.isNull() | (F.length(t) == 0), F.array().cast("array<string>")).otherwise(
        finish(F.concat(wl, F.col(out + "__kw")), max_symbols))
    return joined.withColumn(out, linked).drop(out + "__kw", out + "__wl", "__t1", "__t2")


def fan_out(posts: DataFrame, feed_engagement: bool = False) -> DataFrame:
    """One ticker_posts row per (post, linked symbol); posts without symbols drop out
    (explode emits nothing for an empty list — no separate filter, which Catalyst
    would push below the projection and so evaluate the linking twice).
    Feed posts carry score 1 / comments 0, listing posts their own engagement."""
    p = posts
    score = F.lit(1).cast("int") if feed_engagement else F.col("score").cast("int")
    comments = F.lit(0).cast("int") if feed_engagement else F.col("comments").cast("int")
    stance = F.col("stance").cast("short") if "stance" in posts.columns else F.lit(None).cast("short")
    # explode_outer + a filter on the generated column: a plain explode makes
    # Catalyst infer size(tickers) > 0 and push it below the projection that
    # computes tickers, evaluating the whole linking expression twice.
    return (p.select(F.col("created_at"), F.col("id").alias("post_id"), F.explode_outer("tickers").alias("ticker"),
                     stance.alias("stance"), score.alias("score"), comments.alias("comments"))
            .where(F.col("ticker").isNotNull()))


def with_feed_engagement(posts: DataFrame) -> DataFrame:
    """Engagement per row: a feed post (its source says so, or it has neither score nor comments) counts as score 1 and
    comments 0; a listing post keeps its own."""
    score = F.col("score").cast("int") if "score" in posts.columns else F.lit(None).cast("int")
    comments = F.col("comments").cast("int") if "comments" in posts.columns else F.lit(None).cast("int")
    feed = score.isNull() & comments.isNull()
    if "source" in posts.columns:
        feed = feed | (F.col("source") == F.lit(FEED_SOURCE))
    return posts.withColumn("score", F.when(feed, F.lit(1)).otherwise(score)) \
        .withColumn("comments", F.when(feed, F.coalesce(comments, F.lit(0))).otherwise(comments))


def posts_with_symbol(posts: DataFrame, symbols) -> DataFrame:
    """Posts whose symbol list mentions any of ``symbols``."""
    if isinstance(symbols, str):
        return posts.where(F.array_contains("tickers", symbols))
    return posts.where(F.arrays_overlap("tickers", _str_array(symbols)))


def write_fanout_index(ticker_posts: DataFrame, path: str) -> None:
    """Store the fan-out as the symbol index: range-partitioned and sorted by
    (ticker, created_at), so a lookup of one symbol reads only the row groups
    whose min/max cover it (a hot symbol still spans many files)."""
    (ticker_posts.repartitionByRange("ticker", "created_at").sortWithinPartitions("ticker", "created_at")
     .write.mode("overwrite").parquet(path))


def posts_with_symbol_indexed(posts: DataFrame, fanout_index: DataFrame, symbol: str,
                              partition_col: str = "created_date") -> DataFrame:
    """Posts mentioning ``symbol`` through the stored fan-out instead of a scan of
    every post's symbol list: the symbol filter reaches the index scan, and the
    semi join on (partition column, id) lets dynamic partition pruning read
    only the posts partitions of the dates where the symbol occurs."""
    hits = (fanout_index.where(F.col("ticker") == F.lit(symbol))
            .select(F.col("post_id").alias("id"), F.to_date("created_at").alias(partition_col)))
    return posts.join(hits, ["id", partition_col], "left_semi")
