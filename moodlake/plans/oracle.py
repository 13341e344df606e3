"""DuckDB oracle SQL for every registered query (same column names)."""

from __future__ import annotations

from moodlake.plans.catalog import CLOSED_AS_OF, METRICS_AS_OF, SERIES_AS_OF, SERIES_TICKER, TEXT_AS_OF

O1 = """tp AS (
  SELECT ts AS created_at, event_id AS post_id, event_type AS ticker,
         CAST(CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN -1 END AS SMALLINT) AS stance,
         CAST(floor(value) AS INT) - 20 AS score,
         CASE WHEN event_id % 5 <> 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) END AS comments
  FROM events)"""

W = "(1 + ln(1 + greatest(coalesce(score, 0), 0) + coalesce(comments, 0)))"


def _buckets(width: str) -> str:
    return f"""SELECT time_bucket(INTERVAL {width}, created_at) AS bucket, ticker,
         count(*) AS n_posts,
         sum(CASE WHEN stance = 1 THEN 1 WHEN stance = -1 THEN -1 ELSE 0 END * {W}) / nullif(sum({W}), 0) AS vw_sentiment,
         CAST(sum(CAST(stance = 1 AS INT)) AS BIGINT) AS pos_ct,
         CAST(sum(CAST(stance = 0 AS INT)) AS BIGINT) AS neu_ct,
         CAST(sum(CAST(stance = -1 AS INT)) AS BIGINT) AS neg_ct
  FROM tp WHERE stance IS NOT NULL GROUP BY 1, 2"""


V10 = f"WITH {O1}, v AS ({_buckets('10 SECOND')})"
R = "round(vw_sentiment, 9) AS vw_sentiment"
VCOLS = f"bucket, ticker, n_posts, {R}, pos_ct, neu_ct, neg_ct"
SCOLS = f"bucket, {R}, n_posts, pos_ct, neu_ct, neg_ct"

O2 = """pm AS (
  SELECT event_id AS id, event_type AS source, ts AS created_at, ts AS ingested_at,
         CAST(CASE WHEN event_id % 4 <> 3 THEN CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END END AS SMALLINT) AS stance,
         CASE WHEN event_id % 4 <> 3 THEN ts + to_seconds(CAST(event_id % 30 AS BIGINT)) END AS classified_at,
         CASE WHEN event_id % 17 = 0 THEN true END AS is_backfill
  FROM events)"""

O3 = """pt AS (
  SELECT doc_id AS id, source, CAST(doc_id AS VARCHAR) AS external_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at,
         split_part(text, chr(10), 1) AS title,
         substr(text, length(split_part(text, chr(10), 1)) + 2) AS body
  FROM documents)"""


def _ts(s: str) -> str:
    return f"TIMESTAMP '{s}'"


SQL: dict[str, str] = {
    "sentiment_buckets_10s": f"{V10} SELECT {VCOLS} FROM v",
    "sentiment_buckets_1h": f"WITH {O1}, v AS ({_buckets('1 HOUR')}) SELECT {VCOLS} FROM v",
    "sentiment_buckets_7d": f"WITH {O1}, v AS ({_buckets('7 DAY')}) SELECT {VCOLS} FROM v",
    "sentiment_closed_buckets": f"""{V10} SELECT {VCOLS} FROM v
        WHERE bucket + INTERVAL 10 SECOND <= {_ts(CLOSED_AS_OF)} - INTERVAL 10 SECOND
          AND bucket >= {_ts(CLOSED_AS_OF)} - INTERVAL 24 HOUR""",
    "sentiment_series": f"""{V10} SELECT {SCOLS} FROM v
        WHERE ticker = '{SERIES_TICKER}' AND bucket > {_ts(SERIES_AS_OF)} - INTERVAL 24 HOUR ORDER BY bucket DESC""",
    "sentiment_latest": f"""{V10} SELECT {SCOLS} FROM v WHERE ticker = '{SERIES_TICKER}' ORDER BY bucket DESC LIMIT 1""",
    "sentiment_latest_all": f"""{V10} SELECT ticker, bucket, {R}, n_posts, pos_ct, neu_ct, neg_ct
        FROM v QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY bucket DESC) = 1""",
    "chart_feed": f"""{V10} SELECT strftime(bucket, '%H:%M:%S') AS time, round(vw_sentiment, 9) AS sentiment, n_posts AS posts
        FROM v WHERE ticker = '{SERIES_TICKER}' AND bucket > {_ts(SERIES_AS_OF)} - INTERVAL 24 HOUR ORDER BY bucket""",
    "pipeline_count_5m": f"""WITH {O2} SELECT count(*) AS last_5m_count FROM pm
        WHERE ingested_at > {_ts(METRICS_AS_OF)} - INTERVAL 5 MINUTE""",
    "pipeline_latency_p95": f"""WITH {O2} SELECT CAST(coalesce(round(CAST(quantile_cont(
            date_diff('microsecond', ingested_at, classified_at) / 1e6, 0.95) AS DECIMAL(38,9)), 2), 0) AS DOUBLE) AS p95_latency_sec
        FROM pm WHERE classified_at IS NOT NULL AND classified_at > {_ts(METRICS_AS_OF)} - INTERVAL 10 MINUTE
          AND ingested_at > {_ts(METRICS_AS_OF)} - INTERVAL 10 MINUTE AND NOT coalesce(is_backfill, false)""",
    "pipeline_metrics": f"""WITH {O2},
        a AS (SELECT CAST(coalesce(round(CAST(quantile_cont(date_diff('microsecond', ingested_at, classified_at) / 1e6, 0.95)
                     AS DECIMAL(38,9)), 2), 0) AS DOUBLE) AS p95_latency_sec
              FROM pm WHERE classified_at IS NOT NULL AND classified_at > {_ts(METRICS_AS_OF)} - INTERVAL 10 MINUTE
                AND ingested_at > {_ts(METRICS_AS_OF)} - INTERVAL 10 MINUTE AND NOT coalesce(is_backfill, false)),
        b AS (SELECT count(*) AS last_5m_count FROM pm WHERE ingested_at > {_ts(METRICS_AS_OF)} - INTERVAL 5 MINUTE)
        SELECT p95_latency_sec, last_5m_count, 32 AS batched_avg_size FROM a, b""",
    "unscored_queue": f"""WITH {O2} SELECT id, source, created_at, ingested_at FROM pm
        WHERE stance IS NULL AND created_at > {_ts(METRICS_AS_OF)} - INTERVAL 24 HOUR AND NOT coalesce(is_backfill, false)
        ORDER BY ingested_at DESC, id LIMIT 32""",
    "recent_sample": f"""WITH {O3} SELECT id, coalesce(title, '') || ' ' || coalesce(body, '') AS text FROM pt
        WHERE created_at > {_ts(TEXT_AS_OF)} - INTERVAL 1 DAY ORDER BY id LIMIT 10000""",
}


# --- text, hashing and symbol linking -------------------------------------

from moodlake.functions.dictionaries import WHITESPACE_CLASS  # noqa: E402
from moodlake.plans.overlays import O6_KEYWORDS, O6_STOPLIST, O6_WHITELIST  # noqa: E402

TEXT = "(coalesce(title, '') || ' ' || coalesce(body, ''))"
HASH = f"md5(regexp_replace(lower({TEXT}), '{WHITESPACE_CLASS}', '', 'g'))"
# DuckDB: no look-ahead and an ASCII \b, and upper('ß') keeps one code point.
CANDS = "regexp_extract_all(upper(replace(@T, 'ß', 'ss')), '\\$?([A-Z]{1,5})(?:[^\\p{L}\\p{N}_]|$)', 1)"


def _lst(vals) -> str:
    return "[" + ", ".join(f"'{v}'" for v in vals) + "]::VARCHAR[]"


KW = "[" + ", ".join(f"{{'kw': '{k}', 'sym': '{s}'}}" for k, s in O6_KEYWORDS) + "]"
WL_HITS = (f"list_filter({CANDS}, lambda c: list_contains({_lst(O6_WHITELIST)}, c) "
           f"AND NOT list_contains({_lst(O6_STOPLIST)}, c))")
KW_HITS = f"list_transform(list_filter({KW}, lambda p: contains(lower(@T), p.kw)), lambda p: p.sym)"


def _link(t: str) -> str:
    return (f"array_to_string(CASE WHEN {t} IS NULL OR length({t}) = 0 THEN []::VARCHAR[] ELSE "
            f"list_slice(list_sort(list_distinct(list_concat({WL_HITS.replace('@T', t)}, {KW_HITS.replace('@T', t)}))), 1, 5) END, ',')")


LINKED = f"""{O3}, lk AS (SELECT id, source, created_at, {_link(TEXT)} AS tickers FROM pt)"""

SQL.update({
    "text_hash": f"WITH {O3} SELECT id, {HASH} AS txt_hash FROM pt",
    "exact_duplicate_groups": f"""WITH {O3}, h AS (SELECT id, {HASH} AS txt_hash FROM pt)
        SELECT txt_hash, count(*) AS n, min(id) AS first_id FROM h GROUP BY txt_hash HAVING count(*) > 1""",
    "per_source_cap": f"""WITH {O3} SELECT id, source, rank FROM (
        SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY id) AS rank FROM pt) WHERE rank <= 50""",
    "candidate_symbols": f"""SELECT doc_id AS id, array_to_string(CASE WHEN text IS NULL OR length(text) = 0
        THEN []::VARCHAR[] ELSE {CANDS.replace('@T', 'text')} END, ',') AS candidates FROM documents""",
    "extract_symbols": f"WITH {LINKED} SELECT id, tickers FROM lk",
    "keyword_symbols": f"""SELECT doc_id AS id, array_to_string(list_slice(list_sort(list_distinct(
        {KW_HITS.replace('@T', 'text')})), 1, 5), ',') AS tickers FROM documents""",
    "extract_symbols_large": f"""WITH {O3},
        wl AS (SELECT DISTINCT unnest({CANDS.replace('@T', 'text')}) AS key FROM conversations
               WHERE text IS NOT NULL AND length(text) > 0),
        c AS (SELECT id, unnest({CANDS.replace('@T', TEXT)}) AS key FROM pt),
        h AS (SELECT c.id, list(DISTINCT c.key) AS wl FROM c JOIN wl ON c.key = wl.key
              WHERE NOT list_contains({_lst(O6_STOPLIST)}, c.key) GROUP BY c.id)
        SELECT pt.id, array_to_string(CASE WHEN {TEXT} IS NULL OR length({TEXT}) = 0 THEN []::VARCHAR[] ELSE
               list_slice(list_sort(list_distinct(list_concat(coalesce(h.wl, []::VARCHAR[]),
                   {KW_HITS.replace('@T', TEXT)}))), 1, 5) END, ',') AS tickers
        FROM pt LEFT JOIN h ON pt.id = h.id""",
    "keyword_symbols_large": """WITH kw AS (
          SELECT DISTINCT w AS keyword, upper(w) AS symbol FROM (
            SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)),
        h AS (SELECT d.doc_id, list_distinct(list(k.symbol)) AS syms
              FROM documents d JOIN kw k ON contains(lower(d.text), k.keyword) GROUP BY d.doc_id)
        SELECT d.doc_id AS id, CASE WHEN h.syms IS NULL THEN ''
               ELSE array_to_string(list_slice(list_sort(h.syms), 1, 5), ',') END AS tickers
        FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id""",
    "symbol_fanout": f"""WITH {LINKED} SELECT created_at, id AS post_id, unnest(string_split(tickers, ',')) AS ticker,
        CAST(NULL AS INT) AS stance, 1 AS score, 0 AS comments FROM lk WHERE tickers <> ''""",
    "posts_with_symbol": f"WITH {LINKED} SELECT id, tickers FROM lk WHERE list_contains(string_split(tickers, ','), 'NTI')",
    "symbol_keys": """WITH s AS (SELECT DISTINCT p_brand AS symbol FROM part),
        k AS (SELECT upper(symbol) AS key, symbol FROM s
              UNION ALL
              SELECT upper(part) AS key, symbol FROM (SELECT unnest(string_split_regex(trim(lower(symbol)), '\\s+')) AS part, symbol FROM s)
              WHERE length(part) > 2)
        SELECT key, min(symbol) AS symbol FROM k WHERE key IS NOT NULL AND length(key) > 0 GROUP BY key""",
})


# --- ingest, sources and sinks --------------------------------------------

from moodlake.plans.catalog import RANGE_END, RANGE_START  # noqa: E402

ARR = f"""{O3}, arr AS (
  SELECT id, source, external_id, created_at, CAST(id % 3 AS INT) AS k, 'a' AS copy FROM pt
  UNION ALL
  SELECT id, source, external_id, created_at, CAST(3 - id % 3 AS INT) AS k, 'b' AS copy FROM pt)"""
FIRST = """SELECT id, source, external_id, created_at, k, copy FROM (
  SELECT *, row_number() OVER (PARTITION BY source, external_id, created_at ORDER BY k, copy, id) AS rn FROM {src}) WHERE rn = 1"""
LISTINGS = """lb AS (
  SELECT CAST(conv_id AS VARCHAR) AS channel, CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id,
         role AS title, text AS selftext, CAST(turn AS INT) AS pos, CAST(turn AS INT) AS score,
         CAST(length(text) AS INT) AS num_comments, 1704067200.0 + conv_id * 60 + turn AS created_utc FROM conversations),
  lst AS (SELECT *, 'new' AS listing FROM lb WHERE pos < 2 UNION ALL SELECT *, 'hot' AS listing FROM lb WHERE pos >= 1)"""
FEED_HASH = "md5(regexp_replace(lower(coalesce(title, '') || ' ' || coalesce(body, '')), '" + WHITESPACE_CLASS + "', '', 'g'))"

SQL.update({
    "dedup_first_write": f"WITH {ARR} {FIRST.format(src='arr')}",
    "insert_new_posts": f"""WITH {ARR}, b AS ({FIRST.format(src='(SELECT * FROM arr WHERE k > 0)')})
        SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM arr s WHERE s.k = 0 AND s.source = b.source
          AND s.external_id = b.external_id AND s.created_at = b.created_at)""",
    "replay_idempotent": f"WITH {ARR} {FIRST.format(src='arr')}",
    "union_listings": f"WITH {LISTINGS} SELECT channel, id, listing, pos, score FROM lst",
    "union_sources": f"""WITH {O3}, {LISTINGS},
        l1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel, id ORDER BY listing) AS rn FROM lst) WHERE rn = 1)
        SELECT 'rss' AS source, external_id, created_at, title, CAST(NULL AS VARCHAR) AS subreddit, 1 AS score,
               CAST(NULL AS INT) AS comments FROM pt
        UNION ALL
        SELECT 'reddit', id, CAST(to_timestamp(created_utc) AT TIME ZONE 'UTC' AS TIMESTAMP), title, channel, score, num_comments FROM l1""",
    "time_range_scan": f"""WITH {O2} SELECT id, created_at, CAST(stance AS INT) AS stance FROM pm
        WHERE created_at >= TIMESTAMP '{RANGE_START}' AND created_at < TIMESTAMP '{RANGE_END}'""",
    "symbol_seed": "SELECT DISTINCT p_brand AS symbol FROM part",
    "symbol_prefix": "SELECT symbol FROM (SELECT DISTINCT p_brand AS symbol FROM part) WHERE symbol LIKE 'Brand#1%' ORDER BY symbol LIMIT 20",
    "symbol_list": "SELECT symbol FROM (SELECT DISTINCT p_brand AS symbol FROM part) ORDER BY symbol LIMIT 100",
    "feed_items": f"""WITH {O3} SELECT 'rss' AS source,
          CASE WHEN id % 5 <> 0 THEN 'urn:post:' || CAST(id AS VARCHAR) ELSE 'https://news.example/p/' || CAST(id AS VARCHAR) END AS external_id,
          CASE WHEN id % 7 <> 0 THEN created_at ELSE TIMESTAMP '{TEXT_AS_OF}' END AS created_at,
          coalesce(title, '') AS title, 'https://news.example/p/' || CAST(id AS VARCHAR) AS url, 1 AS score,
          {FEED_HASH} AS txt_hash FROM pt""",
    "feed_items_atom": f"""WITH {O3} SELECT 'rss' AS source,
          CASE WHEN id % 5 <> 0 THEN 'urn:post:' || CAST(id AS VARCHAR) ELSE 'https://news.example/p/' || CAST(id AS VARCHAR) END AS external_id,
          CASE WHEN id % 7 <> 0 THEN created_at WHEN id % 14 <> 0 THEN created_at + INTERVAL 1 HOUR
               ELSE TIMESTAMP '{TEXT_AS_OF}' END AS created_at,
          coalesce(title, '') AS title, 'https://news.example/p/' || CAST(id AS VARCHAR) AS url, 1 AS score,
          {FEED_HASH} AS txt_hash FROM pt""",
    "listing_posts": f"""WITH {O3} SELECT 'reddit' AS source, CAST(id AS VARCHAR) AS external_id, created_at,
          source AS subreddit, CAST(id % 97 AS INT) AS score, CAST(id % 13 AS INT) AS comments, {FEED_HASH} AS txt_hash
        FROM pt WHERE id % 11 <> 10""",
    "quarantine_rows": f"""WITH {O3} SELECT CAST(count(*) FILTER (WHERE id % 11 = 10) AS BIGINT) AS n_quarantined,
          CAST(count(*) FILTER (WHERE id % 11 <> 10) AS BIGINT) AS n_kept FROM pt""",
})


SQL["stream_feed_items"] = SQL["feed_items"]  # the stream lands and reads the same items
SQL["feed_quarantine"] = """SELECT
    CAST(count(*) FILTER (WHERE doc_id % 13 = 12 OR doc_id % 17 = 16 OR doc_id % 19 = 18) AS BIGINT) AS n_quarantined,
    CAST(count(*) FILTER (WHERE NOT (doc_id % 13 = 12 OR doc_id % 17 = 16 OR doc_id % 19 = 18)) AS BIGINT) AS n_kept
    FROM documents"""
SQL["posts_with_symbol_indexed"] = SQL["posts_with_symbol"]  # same rows, read through the index

SQL["view_refresh"] = f"""{V10} SELECT {VCOLS} FROM v
        WHERE bucket + INTERVAL 10 SECOND <= {_ts(CLOSED_AS_OF)} - INTERVAL 10 SECOND
          AND bucket >= {_ts(CLOSED_AS_OF)} - INTERVAL 36 HOUR"""

SQL["replay_job"] = f"""WITH {O3},
    feed AS (SELECT 'rss' AS source,
               CASE WHEN id % 5 <> 0 THEN 'urn:post:' || CAST(id AS VARCHAR)
                    ELSE 'https://news.example/p/' || CAST(id AS VARCHAR) END AS external_id,
               CASE WHEN id % 7 <> 0 THEN created_at ELSE TIMESTAMP '{TEXT_AS_OF}' END AS created_at,
               {_link(TEXT)} AS tickers, 1 AS score, CAST(NULL AS INT) AS comments
             FROM pt),
    lst AS (SELECT 'reddit' AS source, CAST(id AS VARCHAR) AS external_id, created_at,
               {_link(TEXT)} AS tickers, CAST(id % 97 AS INT) AS score, CAST(id % 13 AS INT) AS comments
             FROM pt WHERE id % 11 <> 10)
    SELECT source, external_id, created_at, tickers, score, comments, true AS is_backfill
    FROM (SELECT * FROM feed UNION ALL SELECT * FROM lst) WHERE tickers <> ''"""


# --- similarity and scoring -------------------------------------------------

from moodlake.plans.catalog import BATCH_K, QUERY_POST, TORN_K, WRITEBACK_AS_OF  # noqa: E402

L2 = "list_distance({a}::DOUBLE[], {b}::DOUBLE[])"
COS = "(1 - list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]))"


def _similar(dist: str) -> str:
    d = dist.format(a="e.embedding", b="q.qv")
    return f"""WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = {QUERY_POST} LIMIT 1)
        SELECT e.vec_id AS id, e.label FROM embeddings e, q WHERE e.vec_id <> {QUERY_POST}
        ORDER BY {d} NULLS LAST, e.vec_id LIMIT 10"""


DEC = """lg AS (SELECT vec_id AS id, [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE)] AS x FROM embeddings),
  ex AS (SELECT id, [exp(x[1] - list_max(x)), exp(x[2] - list_max(x)), exp(x[3] - list_max(x))] AS e FROM lg),
  pr AS (SELECT id, [e[1] / list_sum(e), e[2] / list_sum(e), e[3] / list_sum(e)] AS p FROM ex),
  dec AS (SELECT id, p[1] AS neg, p[2] AS neu, p[3] AS pos, CAST([-1, 0, 1][list_position(p, list_max(p))] AS SMALLINT) AS stance FROM pr)"""

SQL.update({
    "vector_size_guard": """WITH o11 AS (
        SELECT vec_id AS id, CASE WHEN vec_id % 13 = 12 THEN NULL
                                  WHEN vec_id % 9 = 8 THEN embedding[1:len(embedding) - 1]
                                  ELSE embedding END AS embedding FROM embeddings)
        SELECT id, CAST(coalesce(len(embedding), -1) AS INT) AS dims,
               CASE WHEN embedding IS NULL OR len(embedding) = 64 THEN 1 ELSE 0 END AS accepted FROM o11""",
    "similar_posts": _similar(L2),
    "similar_posts_cosine": _similar(COS),
    "similar_posts_batch": f"""SELECT qid, id, round(distance, 9) AS distance, rank FROM (
        SELECT q.vec_id AS qid, c.vec_id AS id, {L2.format(a='c.embedding', b='q.embedding')} AS distance,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY {L2.format(a='c.embedding', b='q.embedding')}, c.vec_id) AS rank
        FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id
        WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL) WHERE rank <= {BATCH_K}""",
    "mean_pool": """SELECT label, CAST(pos - 1 AS INT) AS dim, round(avg(v), 9) AS value FROM (
        SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
        GROUP BY label, pos""",
    "stance_decode": f"WITH {DEC} SELECT id, round(neg, 9) AS neg, round(neu, 9) AS neu, round(pos, 9) AS pos, CAST(stance AS INT) AS stance FROM dec",
    "stance_writeback": f"""WITH {O2}, {DEC}
        SELECT pm.id, CAST(CASE WHEN pm.stance IS NULL AND dec.stance IS NOT NULL THEN dec.stance ELSE pm.stance END AS INT) AS stance,
               CASE WHEN pm.stance IS NULL AND dec.stance IS NOT NULL THEN 'finbert-onnx-v1' END AS model_ver,
               CASE WHEN pm.stance IS NULL AND dec.stance IS NOT NULL THEN TIMESTAMP '{WRITEBACK_AS_OF}' ELSE pm.classified_at END AS classified_at
        FROM pm LEFT JOIN dec ON pm.id = dec.id""",
})


def _hashed(dims: int) -> str:
    """Mean hashed word vectors: (id, dim, value) of every document with a word."""
    return f"""wd AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS w FROM documents),
      tf AS (SELECT id, w, count(*) AS n FROM wd GROUP BY id, w),
      vec AS (SELECT w, d, CAST('0x' || substr(md5(w || '#' || CAST(d // 16 AS VARCHAR)), CAST(2 * (d % 16) + 1 AS INT), 2) AS INT) / 255.0 - 0.5 AS v
              FROM (SELECT DISTINCT w FROM tf), range({dims}) r(d)),
      mv AS (SELECT id, CAST(d AS INT) AS dim, sum(n * v) / sum(n) AS value FROM tf JOIN vec USING (w) GROUP BY id, d)"""


SCORED = f"""WITH {_hashed(3)},
  lg AS (SELECT doc_id AS id, [coalesce(max(CASE WHEN dim = 0 THEN value END), 0) * 40, coalesce(max(CASE WHEN dim = 1 THEN value END), 0) * 40,
                               coalesce(max(CASE WHEN dim = 2 THEN value END), 0) * 40] AS x
         FROM documents LEFT JOIN mv ON doc_id = id GROUP BY doc_id),
  ex AS (SELECT id, [exp(x[1] - list_max(x)), exp(x[2] - list_max(x)), exp(x[3] - list_max(x))] AS e FROM lg),
  pr AS (SELECT id, [e[1] / list_sum(e), e[2] / list_sum(e), e[3] / list_sum(e)] AS p FROM ex)
  SELECT id, CAST([-1, 0, 1][list_position(p, list_max(p))] AS INT) AS stance, round(p[1], 9) AS neg, round(p[2], 9) AS neu,
         round(p[3], 9) AS pos FROM pr"""

from moodlake.plans.catalog import EMBED_DIM  # noqa: E402

SQL.update({
    "similar_posts_approx_all_cells": SQL["similar_posts_batch"],
    "similar_posts_batch_torn_all": f"""WITH v AS (
        SELECT vec_id AS id, CASE WHEN vec_id % 13 = 12 THEN NULL WHEN vec_id % 9 = 8 THEN embedding[1:len(embedding) - 1]
                                  ELSE embedding END AS e FROM embeddings),
      pairs AS (SELECT q.id AS qid, c.id, CASE WHEN len(q.e) = len(c.e) THEN {L2.format(a='c.e', b='q.e')} END AS distance
                FROM v q JOIN v c ON q.id <> c.id WHERE q.e IS NOT NULL)
      SELECT qid, id, round(distance, 9) AS distance, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance NULLS LAST, id) AS rank FROM pairs)
      WHERE rank <= {BATCH_K}""",
    "score_posts": SCORED,
    "score_posts_batch_1": SCORED,
    "embed_posts": f"""WITH {_hashed(EMBED_DIM)} SELECT doc_id AS id, CAST(d AS INT) AS dim, round(coalesce(value, 0), 9) AS value
        FROM documents CROSS JOIN range({EMBED_DIM}) r(d) LEFT JOIN mv ON doc_id = mv.id AND d = mv.dim""",
    "fanout_writeback": f"""WITH {O1}, {DEC} SELECT post_id, ticker, created_at, CAST(coalesce(tp.stance, dec.stance) AS INT) AS stance
        FROM tp LEFT JOIN dec ON tp.post_id = dec.id""",
    "probs_export": f"WITH {DEC} SELECT id, round(neg, 9) AS neg, round(neu, 9) AS neu, round(pos, 9) AS pos FROM dec",
})


# --- streaming (batch equivalents) ---------------------------------------------

SQL.update({
    "stream_sentiment": SQL["sentiment_buckets_10s"],
    "stream_late_rows": SQL["sentiment_buckets_10s"],
    "stream_dedup": "SELECT event_id, ts, event_type, round(value, 9) AS value FROM events",
    "stream_ingest": SQL["symbol_fanout"],
    "stream_insert_if_absent": SQL["symbol_fanout"],
})

SQL["stream_late_posts"] = SQL["symbol_fanout"].replace("to_minutes(doc_id) AS created_at", """to_minutes(doc_id)
           + to_days(CASE WHEN doc_id % 500 = 7 THEN 3650 WHEN doc_id % 15 = 4 THEN -21 WHEN doc_id % 10 = 3 THEN -3 ELSE 0 END) AS created_at""")
SQL["feed_dates"] = f"""WITH {O3} SELECT id, CASE WHEN id % 10 = 9 THEN NULL WHEN id % 10 = 8 THEN date_trunc('day', created_at)
    ELSE created_at END AS created_at FROM pt"""
SQL["similar_posts_batch_torn"] = SQL["similar_posts_batch_torn_all"].replace(f"rank <= {BATCH_K}", f"rank <= {TORN_K}")
SQL["view_repair"] = SQL["sentiment_buckets_10s"]
SQL["sentiment_rollup_1h"] = SQL["sentiment_buckets_1h"]

# --- bucketed duplicates, stored scores, masked pooling, sketches ---------------

from moodlake.plans.catalog import ENCODER_DIM  # noqa: E402

SQL["duplicate_groups_inserted"] = SQL["exact_duplicate_groups"]
SQL["score_store"] = SQL["score_posts"]
SQL["embed_encoder"] = f"""WITH wd AS (
      SELECT doc_id AS id, unnest(list_concat(['[cls]', '[sep]'], regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+'))) AS w FROM documents),
    tf AS (SELECT id, w, count(*) AS n FROM wd GROUP BY id, w),
    vec AS (SELECT w, d, CAST('0x' || substr(md5(w || '#0'), CAST(2 * d + 1 AS INT), 2) AS INT) / 255.0 - 0.5 AS v
            FROM (SELECT DISTINCT w FROM tf), range({ENCODER_DIM}) r(d))
    SELECT id, CAST(d AS INT) AS dim, round(sum(n * v) / sum(n), 9) AS value FROM tf JOIN vec USING (w) GROUP BY id, d"""
SQL["pipeline_latency_sketch"] = f"""WITH {O2}, l AS (
      SELECT ingested_at, classified_at, epoch_us(classified_at - ingested_at) / 1e6 AS lat FROM pm
      WHERE classified_at IS NOT NULL AND NOT coalesce(is_backfill, false)),
    recent AS (SELECT lat FROM l WHERE least(ingested_at, classified_at) > {_ts(METRICS_AS_OF)} - INTERVAL 10 MINUTE)
    SELECT (SELECT count(*) FROM recent) AS n, (SELECT quantile_disc(lat, 0.95) FROM recent) AS p95_latency_sec,
           (SELECT count(*) FROM l) AS n_all, true AS rank_within_1pct"""
SQL["similar_posts_cells"] = SQL["similar_posts_batch"]
