"""Registered queries of the operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodlake.llm import (ball_tree, conversation_repair, decision_list, ngram_join, packing, quality_bayes, sentencepiece_codec,
                          suffix_dedup, token_files, toxicity, url_cascade, whitening, window_sketch)
from moodlake.llm.common import table
from moodlake.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document (five words, similarity 0.8)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.near_duplicates(docs).select("doc_id", "class_id", "n_links", "class_size")


SQL["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 10 * shared >= 8 * (a.n + b.n - shared)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, l.y FROM reach JOIN l ON l.x = reach.other
), links AS (
  SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY x
)
SELECT reach.doc_id, min(other) AS class_id, coalesce(any_value(n_links), 0) AS n_links, count(*) AS class_size
FROM reach LEFT JOIN links ON links.doc_id = reach.doc_id GROUP BY reach.doc_id"""


@register
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document (count and checksum), and whether they decode to its whole text."""
    import public_tokenizers
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
                                          keep=["doc_id"])


@register
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rule and learned verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    rules = decision_list.train(docs, table(spark, sf_dir, "labels"))
    judged = decision_list.judge(docs, rules, keep=["doc_id"])
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, *[c for c in decision_list.STATS if c not in first])


@register
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in sequences of 2,048 words, none with two of a source or duplicate cluster."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@register
def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the files they were written to."""
    import public_tokenizers
    path = scratch_dir(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, path)


@register
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document covered by 200-byte strings that start elsewhere too."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of a quarter of the ids are never learned from."""
    docs = table(spark, sf_dir, "documents")
    crf = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return (toxicity.score(docs, crf, spans=True, keep=["doc_id"])
            .select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted",
                    F.size("spans").alias("n_spans")))


@register
def op8_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest inner products of every hundredth vector with all others."""
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL["op8_exact_topk_search"] = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


@register
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from its text, its source (as host) and its language within it (as path)."""
    docs = table(spark, sf_dir, "documents")
    model = quality_bayes.train(docs, table(spark, sf_dir, "labels"))
    return quality_bayes.score(docs, F.col("source"), F.col("lang"), model, keep=["doc_id"])


@register
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = table(spark, sf_dir, "pages")
    return url_cascade.filter_urls(pages.select("page_id", "url"), url_cascade.listed_hosts(pages)).drop("url")


SQL["op10_url_filters"] = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
         coalesce(length(html), 0) AS size
  FROM pages
), listed AS (
  SELECT host FROM parts GROUP BY host
  HAVING list_has_any(string_split(host, '.'), ['casino-win', 'cheap-pills', 'spam-farm']) OR avg(size) < 3000
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN host IN (SELECT host FROM listed) THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled"""


@register
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every conversation, damaged beforehand."""
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversations, conversation_repair.damage(conversations))


SQL["op11_conversation_repair"] = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv,
         string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS chars
  FROM conversations
), lots AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN chars]), lambda c, b:
      list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS lot
  FROM keyed
), damaged AS (
  SELECT conv, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
         CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN lot = 3 THEN [1, 2] ELSE [1] END) FROM lots WHERE lot <> 0)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i,
         trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM damaged
), judged AS (
  SELECT *, CASE WHEN solid = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         left(role, 1) AS f, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS before FROM ordered
), facts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (i > 1 AND before || f NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM judged GROUP BY conv
), walk AS (
  SELECT conv, 0::BIGINT AS i, {c: 0, a: '', o: NULL::VARCHAR} AS s0, NULL::STRUCT(c INT, a VARCHAR, o VARCHAR) AS s1,
         NULL::STRUCT(c INT, a VARCHAR, o VARCHAR) AS s2, NULL::STRUCT(c INT, a VARCHAR, o VARCHAR) AS s3 FROM facts
  UNION ALL
  SELECT conv, i, d0,
         list_min([d1, CASE WHEN keep AND f = 's' AND s0 IS NOT NULL THEN {c: s0.c + e, a: s0.a || 'K', o: concat_ws(nl, s0.o, own)} END]),
         list_min([d2,
           CASE WHEN keep AND s0 IS NOT NULL THEN {c: s0.c + uc, a: s0.a || ue, o: concat_ws(nl, s0.o, ul)} END,
           CASE WHEN keep AND s1 IS NOT NULL THEN {c: s1.c + uc, a: s1.a || ue, o: concat_ws(nl, s1.o, ul)} END,
           CASE WHEN keep AND s3 IS NOT NULL THEN {c: s3.c + uc, a: s3.a || ue, o: concat_ws(nl, s3.o, ul)} END,
           CASE WHEN keep AND s2 IS NOT NULL THEN {c: s2.c + 5 + uc, a: s2.a || 'I' || ue, o: concat_ws(nl, s2.o, 'assistant:', ul)} END]),
         list_min([d3,
           CASE WHEN keep AND s2 IS NOT NULL THEN {c: s2.c + ac, a: s2.a || ae, o: concat_ws(nl, s2.o, al)} END,
           CASE WHEN keep AND s0 IS NOT NULL THEN {c: s0.c + 5 + ac, a: s0.a || 'I' || ae, o: concat_ws(nl, s0.o, 'user:', al)} END,
           CASE WHEN keep AND s1 IS NOT NULL THEN {c: s1.c + 5 + ac, a: s1.a || 'I' || ae, o: concat_ws(nl, s1.o, 'user:', al)} END,
           CASE WHEN keep AND s3 IS NOT NULL THEN {c: s3.c + 5 + ac, a: s3.a || 'I' || ae, o: concat_ws(nl, s3.o, 'user:', al)} END])
  FROM (
    SELECT w.conv, j.i, w.s0, w.s1, w.s2, w.s3, chr(10) AS nl, j.fault NOT IN ('b', 'd') AS keep, j.f, j.role || ':' || j.text AS own,
           CASE WHEN j.fault = 't' THEN 5 ELSE 0 END AS e,
           e + CASE WHEN j.f = 'u' THEN 0 ELSE 1 END AS uc, CASE WHEN j.f = 'u' THEN 'K' ELSE 'R' END AS ue,
           CASE WHEN j.f = 'u' THEN own ELSE 'user:' || j.text END AS ul,
           e + CASE WHEN j.f = 'a' THEN 0 ELSE 1 END AS ac, CASE WHEN j.f = 'a' THEN 'K' ELSE 'R' END AS ae,
           CASE WHEN j.f = 'a' THEN own ELSE 'assistant:' || j.text END AS al,
           CASE WHEN w.s0 IS NOT NULL THEN {c: w.s0.c + 2, a: w.s0.a || 'D', o: w.s0.o} END AS d0,
           CASE WHEN w.s1 IS NOT NULL THEN {c: w.s1.c + 2, a: w.s1.a || 'D', o: w.s1.o} END AS d1,
           CASE WHEN w.s2 IS NOT NULL THEN {c: w.s2.c + 2, a: w.s2.a || 'D', o: w.s2.o} END AS d2,
           CASE WHEN w.s3 IS NOT NULL THEN {c: w.s3.c + 2, a: w.s3.a || 'D', o: w.s3.o} END AS d3
    FROM walk w JOIN judged j ON j.conv = w.conv AND j.i = w.i + 1)
), best AS (
  SELECT w.conv, list_min([s0, s3,
      CASE WHEN s2 IS NOT NULL THEN {c: s2.c + 5, a: s2.a || 'I', o: concat_ws(chr(10), s2.o, 'assistant:')} END,
      CASE WHEN s1 IS NOT NULL THEN {c: s1.c + 10, a: s1.a || 'II', o: concat_ws(chr(10), s1.o, 'user:', 'assistant:')} END]) AS r
  FROM walk w JOIN facts f ON f.conv = w.conv AND f.n = w.i
)
SELECT k.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate,
       coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal, CAST(coalesce(b.r.c, 0) AS BIGINT) AS cost,
       coalesce(b.r.a, '') AS audit, sha256(coalesce(b.r.o, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM keyed) k LEFT JOIN facts f ON f.conv = k.conv LEFT JOIN best b ON b.conv = k.conv"""


@register
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the eight components of largest variance, scaled to unit variance."""
    embeddings = table(spark, sf_dir, "embeddings")
    model = whitening.fit(embeddings)
    return whitening.long_form(whitening.transform(embeddings, model, keep=["vec_id"]), model)


@register
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document covered by windows of 35 words that start elsewhere too."""
    return (window_sketch.remove_windows(table(spark, sf_dir, "documents"), keep=["doc_id"])
            .select("doc_id", "n_words", "n_removed", "kept_sha256"))


SQL["op13_substring_dedup"] = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT r, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS k
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT r, list(DISTINCT j) AS js FROM (SELECT r, unnest(range(i, i + 35)) AS j FROM twice) GROUP BY r
), kept AS (
  SELECT doc_id, len(ws) AS n, coalesce(len(js), 0) AS removed,
         array_to_string(list_filter(ws, lambda x, j: js IS NULL OR NOT list_contains(js, j)), ' ') AS t
  FROM w LEFT JOIN gone ON gone.r = w.r
)
SELECT doc_id, n AS n_words, removed AS n_removed, sha256(t) AS kept_sha256 FROM kept"""
