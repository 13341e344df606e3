"""Large-dictionary keyword linking (a join on rare grams) equals the in-row CASE form
and a brute-force substring test, overlapping keywords included."""

from pyspark.sql import functions as F

from moodlake.functions.dictionaries import KEYWORDS
from moodlake.operators import symbols as SY
from moodlake.plans import overlays as O
from tests.conftest import SF001, SF01


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")


def _links(df, keywords, col="text"):
    return {r.id: sorted(r.k) for r in SY.with_keyword_symbols(df, col, keywords, "k").select("id", "k").collect()}


def test_join_equals_case_form(spark):
    docs = _docs(spark, SF01)
    pairs = list(KEYWORDS) + list(O.O6_KEYWORDS)
    case = _links(docs, pairs)
    joined = _links(docs, spark.createDataFrame(pairs, "keyword string, symbol string"))
    assert case == joined and any(joined.values())


def test_join_equals_brute_force_on_derived_dictionary(spark):
    kw = O.benchmark_keywords(spark.read.parquet(f"{SF001}/benchmark.parquet"))
    pairs = [(r.keyword, r.symbol) for r in kw.collect()]
    assert len(pairs) > SY.MAX_LITERAL_KEYWORDS  # the size switch picks the join
    docs = _docs(spark, SF001)
    got = _links(docs, kw)
    assert got == _links(docs, pairs)
    for r in docs.collect():
        assert got[r.id] == sorted({s for k, s in pairs if k in (r.text or "").lower()})


def test_overlapping_nested_and_odd_keywords(spark, monkeypatch):
    """Every sampled text, or none, tells the grams' rarity: the links are the same."""
    rows = [(0, "A pineapple pie"), (1, ""), (2, None), (3, "applesauce"), (4, "xéé日本 a%b_c.d\nnew\nline"), (5, "a pineapple pie"), (6, "aa")]
    df = spark.createDataFrame(rows, "id long, text string")
    pairs = [("apple", "AAPL"), ("pineapple", "PINE"), ("app", "APP"), ("pie", "PIE"), ("sauce", "SAUCE"), ("p", "P"), ("éé", "E"), ("日本 a%", "J"),
             ("_c.d\nn", "NL"), ("e\n", "NO"), ("aaa", "AAA"), ("", "ALL"), (None, "X"), ("an", None), ("apple", "SECOND")]
    want = {i: sorted({s for k, s in pairs if k and s and k in (t or "").lower()}) for i, t in rows}
    table = spark.createDataFrame(pairs, "keyword string, symbol string")
    for sample in (1, 1 << 40):
        monkeypatch.setattr(SY, "GRAM_SAMPLE", sample)
        assert _links(df, table) == want
    assert _links(df, table.limit(0)) == {i: [] for i, _ in rows}
    assert _links(df.limit(0), table) == {}


def test_a_gram_in_every_text_is_dealt_out(spark):
    """Texts that share a run of characters meet its keyword in many parts, and no text or dictionary is collected."""
    df = spark.range(4000).select("id", F.concat(F.lit("the common words "), F.hex(F.xxhash64("id"))).alias("text"))
    kw = spark.createDataFrame([("the", "THE"), ("common w", "CW"), ("zzzz", "Z")], "keyword string, symbol string")
    texts = df.select(*SY._text_key(F.col("text")), F.col("text").alias("__lt"))
    rows = SY._gram_rows(texts, [3]).where("__gram = 'the'").withColumn("s", F.pmod("__t2", F.lit(SY.GRAM_SALTS)))
    sizes = [r["count"] for r in rows.groupBy("s").count().collect()]
    assert len(sizes) == SY.GRAM_SALTS and max(sizes) < 2 * 4000 / SY.GRAM_SALTS
    assert set(map(tuple, _links(df, kw).values())) == {("CW", "THE")}
    plan = SY.with_keyword_symbols(df, "text", kw, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_extract_symbols_switches_by_dictionary_size(spark):
    docs = _docs(spark, SF001)
    big = [(f"zzq{i}", f"S{i}") for i in range(SY.MAX_LITERAL_KEYWORDS)] + [("the", "THE")]
    out = SY.extract_symbols(docs, "text", {}, (), big)
    small = SY.extract_symbols(docs, "text", {}, (), [("the", "THE")])
    assert "Join" in out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in small._jdf.queryExecution().executedPlan().toString()
    norm = lambda df: sorted((r.id, tuple(r.tickers)) for r in df.select("id", "tickers").collect())
    assert norm(out) == norm(small)


def test_whitelist_tiers_agree(spark, monkeypatch):
    """literal array (small), broadcast key map (large) and explode + join (beyond
    the broadcast bound) give the same links on a data-derived whitelist."""
    from moodlake.functions.text import post_text

    posts = O.posts_text(spark.read.parquet(f"{SF001}/documents.parquet")).withColumn("text", post_text())
    dim = O.conversation_symbols(spark.read.parquet(f"{SF001}/conversations.parquet"))
    assert dim.count() > SY.MAX_LITERAL_KEYS

    def links(df):
        return sorted((r.id, tuple(r.tickers)) for r in df.select("id", "tickers").collect())

    broadcast = SY.extract_symbols(posts, "text", dim, O.O6_STOPLIST, O.O6_KEYWORDS)
    assert "ArrowEvalPython" in broadcast._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in broadcast._jdf.queryExecution().executedPlan().toString()
    joined = SY.extract_symbols_join(posts, "text", dim, O.O6_STOPLIST, O.O6_KEYWORDS)
    monkeypatch.setattr(SY, "MAX_LITERAL_KEYS", 10 ** 6)
    literal = SY.extract_symbols(posts, "text", dim, O.O6_STOPLIST, O.O6_KEYWORDS)
    assert links(broadcast) == links(joined) == links(literal)
    assert sum(1 for _, t in links(broadcast) if t) > 0


def test_whitelist_is_collected_when_it_changes(spark, monkeypatch):
    dim = spark.createDataFrame([("AAA",), ("BBB",)], "symbol string")
    first = SY.whitelist_from(dim)
    assert SY.whitelist_from(spark.createDataFrame([("BBB",), ("AAA",)], "symbol string")) is first
    assert SY.whitelist_from(dim.limit(1)) is not first
    assert SY.whitelist_from(dim, 1) is None


def test_join_tier_needs_no_id_and_runs_in_the_live_path(spark, monkeypatch):
    from moodlake.functions.text import post_text
    from moodlake.session import scratch_dir
    from moodlake.streaming import pipeline as ST

    posts = O.posts_text(spark.read.parquet(f"{SF001}/documents.parquet")).withColumn("text", post_text())
    dim = O.conversation_symbols(spark.read.parquet(f"{SF001}/conversations.parquet"))
    expect = sorted((r.id, tuple(r.tickers)) for r in SY.extract_symbols(posts, "text", dim, O.O6_STOPLIST, O.O6_KEYWORDS).collect())
    nameless = posts.withColumn("key", F.col("id")).withColumn("id", F.lit(None).cast("long"))
    got = SY.extract_symbols_join(nameless, "text", dim, O.O6_STOPLIST, O.O6_KEYWORDS).collect()
    assert sorted((r.key, tuple(r.tickers)) for r in got) == expect

    stored = {}
    for tier in ("broadcast", "join"):
        if tier == "join":
            monkeypatch.setattr(SY, "MAX_BROADCAST_KEYS", 10)
        land = scratch_dir(spark, "tier_land")
        O.land_all_polls(posts, land, "created_at", 3600, "2024-01-01 00:00:00")
        q, paths = ST.start_live_pipeline(spark, land, posts.schema, scratch_dir(spark, "tier_out"),
                                          lambda df: SY.extract_symbols(df, "text", dim, O.O6_STOPLIST, O.O6_KEYWORDS),
                                          trigger={"availableNow": True}, reader_options={"recursiveFileLookup": "true"})
        q.awaitTermination(600)
        assert q.exception() is None
        stored[tier] = sorted((r.id, tuple(r.tickers)) for r in spark.read.parquet(paths["posts"]).collect())
    assert stored["join"] == stored["broadcast"] == [x for x in expect if x[1]]


def test_broadcast_dictionary_moves_no_grams(spark, monkeypatch):
    """With a dictionary of a checked size, texts are shuffled once and their runs and candidates not at all; a larger one
    is shuffled, and links the same."""
    docs = _docs(spark, SF001)
    kw = O.benchmark_keywords(spark.read.parquet(f"{SF001}/benchmark.parquet"))

    def links():
        texts = docs.where(F.length("text") > 0).select(*SY._text_key(F.lower("text")), F.lower("text").alias("__lt"))
        texts = texts.groupBy("__t1", "__t2").agg(F.first("__lt").alias("__lt"))
        out = SY.keyword_links(texts, kw)
        return out._jdf.queryExecution().executedPlan().toString(), {(r[0], r[1]): sorted(r[2]) for r in out.collect()}
    plan, found = links()
    assert "BroadcastHashJoin" in plan and "__salt" not in plan
    top = plan.index("BroadcastHashJoin")
    assert "Exchange hashpartitioning" not in plan[:top]
    monkeypatch.setattr(SY, "MAX_BROADCAST_CHARS", 10)
    plan, same = links()
    assert "__salt" in plan and found == same and any(found.values())


def test_no_text_is_gone_through_once_per_keyword(spark, monkeypatch):
    """Longer keywords are verified in tokens; only those with white space in whole texts. The links are those of a plain
    substring test, whatever the keywords are made of."""
    plans = []
    plain = SY.keyword_links

    def links(texts, keywords):
        out = plain(texts, keywords)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out
    monkeypatch.setattr(SY, "keyword_links", links)
    texts = ["", None, "x", "ab", "abc", "pineapples, ananas", "the pine apple\nof apples", "naïve étions 日本語文字列 x", "a-b_c.d/e[f]^g\\h]i",
             "tab\there  two", "𝒳𝒴𝒵𝒲 end", "applé apple", "日本語 文字列", "ends with pie", "e", "APPLES and ÉTION", "a\u00a0bcde"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    tight = ["apple", "pineapple", "ananas", "éti", "étion", "e", "ie", "pie", "日本", "日本語文", "c.d/e[f]", "^g\\h", "]i", "𝒴𝒵", "𝒳𝒴𝒵𝒲", "ab", "abc", "x", "a\u00a0bcd"]
    spaced = ["pine apple", "apple\nof", "tab\there", "  two", "e t", "with pie", "語 文字"]
    for keywords in (tight, tight + spaced, spaced, ["e", "ab"], ["e", "apple", "日本語文"], ["ab", "e\n", "apple"], ["s o", "d"], ["pie", "éti"]):
        table = spark.createDataFrame([(k, k.upper()) for k in keywords], "keyword string, symbol string")
        want = {i: sorted({k.upper() for k in keywords if k in (t or "").lower()}) for i, t in enumerate(texts)}
        for most in (512, 3):                           # tokens of the keywords' characters, or of anything but white space
            monkeypatch.setattr(SY, "MAX_ALPHABET", most)
            assert _links(df, table) == want
            assert "Contains(__lt" not in plans[-1] and "Contains(__unit" in plans[-1]


def test_short_runs_are_those_of_the_tokens(spark):
    """A text's short runs are made of its distinct tokens: a word that it repeats is gone through once."""
    df = spark.createDataFrame([(0, "ab abc abcd ab 12 zzz abcd"), (1, "1 b"), (2, "__"), (3, "bc")], "id long, text string")
    texts = df.select(*SY._text_key(F.col("text")), F.col("id"), F.col("text").alias("__lt"))
    has = {"short_tight": True, "short_spaced": False, "long_tight": False, "long_spaced": False}
    rows = SY._unit_rows(texts, [1, 2], "[a-d]+", has).join(texts, ["__t1", "__t2"]).where("__unit <> ''")
    got = {i: sorted(r["__unit"] for r in rows.where(F.col("id") == i).collect()) for i in range(4)}
    assert got == {0: ["a", "ab", "abc", "b", "bc", "bcd", "c", "cd", "d"], 1: ["b"], 2: [], 3: ["b", "bc", "c"]}
