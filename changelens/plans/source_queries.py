"""More operators as queries: archive indexes, fetch gates, stored bodies, scans, edits of the competitor tables.

Registered beside those of queries.py, over the same stand-ins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import ship
from ..functions import patterns as P
from ..functions import payloads, urls
from ..operators import narrate
from ..sources import captures as sources
from ..sources import edits
from ..sources.store import kept
from . import analytics, evaluate, pipeline
from .queries import (
    AS_OF, CAPTURE_LOG, CHANGE_LOG, CHANGE_ROWS, _SQL_URLS, _pages, _read, _urls, capture_log, change_log, change_query, competitors, q, query, sql_fold, sql_severity,
)

# ---------------------------------------------------------------- archives


def _index_rows(spark, sf_dir) -> DataFrame:
    """events as an archive index: fourteen digits or a malformed stamp, a status as text, the event type as digest."""
    k = F.col("event_id")
    return _read(spark, sf_dir, "events").select(
        k.alias("id"), F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("url"), F.when(k % 11 == 0, "2024").otherwise(F.date_format("ts", "yyyyMMddHHmmss")).alias("timestamp"),
        F.when(k % 13 == 0, "-").when(k % 7 == 0, "404").otherwise("200").alias("statuscode"), F.col("event_type").alias("digest"),
    )


_SQL_INDEX = """WITH g AS (SELECT event_id AS id, 'u/' || user_id AS url, date_trunc('second', ts) AS "at", event_type AS digest FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 7 <> 0),
    f AS (SELECT *, lag(digest) OVER (PARTITION BY url ORDER BY g."at", id) AS old FROM g)"""


@query(_SQL_INDEX + ' SELECT id, url, "at", digest FROM f WHERE old IS NULL OR old <> digest QUALIFY row_number() OVER (PARTITION BY url ORDER BY f."at", id) <= 10')
def archive_index(spark, sf_dir):
    return sources.archive_index(_index_rows(spark, sf_dir), 10).select("id", "url", "at", "digest")


@query(_SQL_INDEX + ' SELECT id, url, "at", digest FROM f WHERE old IS NULL OR old <> digest QUALIFY row_number() OVER (PARTITION BY url ORDER BY f."at" DESC, id) <= 5')
def archive_index_newest(spark, sf_dir):
    return sources.archive_index(_index_rows(spark, sf_dir), -5).select("id", "url", "at", "digest")


_SUITE = evaluate.Suite(start="2024-01-03", end="2024-01-20", limit=12)


@query(
    f"""WITH {CAPTURE_LOG}, i AS (SELECT * FROM cap WHERE timestamp >= TIMESTAMP '2024-01-03' AND timestamp <= TIMESTAMP '2024-01-20'),
    o AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY tracked_url_id, timestamp ORDER BY id DESC) = 1),
    s AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY tracked_url_id ORDER BY timestamp) <= 6 OR row_number() OVER (PARTITION BY tracked_url_id ORDER BY timestamp DESC) <= 6),
    u AS (SELECT * FROM (SELECT *, bool_or(status_code = 200) OVER (PARTITION BY tracked_url_id) AS any_ok FROM s) WHERE NOT any_ok OR status_code = 200),
    d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY tracked_url_id, content_hash ORDER BY timestamp, id) = 1)
    SELECT tracked_url_id, min_by(id, (timestamp, id)) AS before_id, max_by(id, (timestamp, id)) AS after_id, count(*) AS n FROM d GROUP BY 1 HAVING count(*) >= 2"""
)
def evaluation_suite(spark, sf_dir):
    return evaluate.suite_pairs(capture_log(spark, sf_dir), _SUITE, url="tracked_url_id", digest="content_hash")


@query("SELECT doc_id, text AS out FROM documents")
def decoded_bodies(spark, sf_dir):
    """Bodies as bytes, in UTF-8 or, where the declared charset can hold the text, in Latin-1: read back they are the texts."""
    ship(spark)
    narrow = (F.col("doc_id") % 2 == 0) & F.col("text").rlike(r"^[\x00-\x7F\xA0-\xFF]*+\z")
    docs = _read(spark, sf_dir, "documents").select(
        "doc_id", F.when(narrow, F.encode(F.when(narrow, F.col("text")), "ISO-8859-1")).otherwise(F.encode("text", "UTF-8")).alias("body"), F.when(narrow, "iso-8859-1").alias("charset"),
    )
    return docs.select("doc_id", sources.decode_body("body", "charset").alias("out"))


@query(f"WITH {CAPTURE_LOG} SELECT id, 'url_' || tracked_url_id || '/' || strftime(timestamp, '%Y%m%d%H%M%S') || '_' || left(sha256(content_hash), 12) || '.html' AS name FROM cap")
def body_names(spark, sf_dir):
    return capture_log(spark, sf_dir).select("id", sources.body_name(F.col("tracked_url_id"), F.col("timestamp"), F.sha2(F.col("content_hash").cast("binary"), 256)).alias("name"))


# ---------------------------------------------------------------- fetching


def _robots(spark, sf_dir) -> DataFrame:
    """A robots table of three in four origins, derived from hashes of their names."""
    origins = _read(spark, sf_dir, "pages").select(urls.origin("url").alias("origin")).distinct()
    code = F.conv(F.substring(F.md5("origin"), 1, 4), 16, 10).cast("int")
    return origins.filter(code % 4 != 0).select("origin", (code % 3 != 0).alias("allowed"), F.when(code % 5 > 0, (code % 5).cast("double")).alias("crawl_delay"))


_SQL_GATE = r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS origin FROM pages),
    c AS (SELECT DISTINCT origin, CAST('0x' || substr(md5(origin), 1, 4) AS INTEGER) AS k FROM p), r AS (SELECT origin, k % 3 <> 0 AS allowed, CASE WHEN k % 5 > 0 THEN CAST(k % 5 AS DOUBLE) END AS crawl_delay FROM c WHERE k % 4 <> 0),
    g AS (SELECT page_id, url, p.origin, coalesce(allowed, TRUE) AS allowed, crawl_delay FROM p LEFT JOIN r ON p.origin = r.origin)"""


@query(_SQL_GATE + " SELECT page_id, origin, allowed, crawl_delay FROM g")
def robots_gate(spark, sf_dir):
    asked = _read(spark, sf_dir, "pages").select("page_id", "url")
    return sources.robots_gate(asked, _robots(spark, sf_dir)).select("page_id", "origin", "allowed", "crawl_delay")


@query(_SQL_GATE + " SELECT page_id, (row_number() OVER (PARTITION BY origin ORDER BY md5(url), page_id) - 1) * greatest(1.5::DOUBLE, coalesce(crawl_delay, 0.0::DOUBLE)) AS start_after FROM g WHERE allowed")
def request_schedule(spark, sf_dir):
    asked = _read(spark, sf_dir, "pages").select("page_id", "url")
    allowed = sources.robots_gate(asked, _robots(spark, sf_dir)).filter("allowed")
    return sources.schedule(allowed, 1.5, key="page_id").select("page_id", "start_after")


@query("SELECT event_id, s IN (408, 425, 429, 500, 502, 503, 504) AS again FROM (SELECT event_id, [200, 404, 408, 425, 429, 500, 501, 502, 503, 504][1 + event_id % 10] AS s FROM events)")
def retryable_statuses(spark, sf_dir):
    codes = F.array(*map(F.lit, (200, 404, 408, 425, 429, 500, 501, 502, 503, 504)))
    return _read(spark, sf_dir, "events").select("event_id", pipeline.is_retryable(F.get(codes, (F.col("event_id") % 10).cast("int"))).alias("again"))


# ---------------------------------------------------------------- scans


@query(
    f"""WITH {CAPTURE_LOG}, w AS (SELECT *, lag(id) OVER o AS previous_id, lag(content_hash) OVER o AS previous_hash FROM cap WINDOW o AS (PARTITION BY tracked_url_id ORDER BY timestamp, id))
    SELECT id, CASE WHEN status_code <> 200 THEN 'failed' WHEN previous_id IS NULL THEN 'baseline' WHEN previous_hash = content_hash THEN 'unchanged' ELSE 'changed' END AS status FROM w"""
)
def capture_states(spark, sf_dir):
    from ..operators.snapshots import with_previous

    rows = with_previous(capture_log(spark, sf_dir), ["id", "content_hash"])
    return pipeline.capture_status(rows.withColumn("error", F.when(F.col("status_code") != 200, "http_error"))).select("id", "status")


_SQL_FUNNEL = "count(*) AS raw_changes, count(*) FILTER (is_noise) AS noise_changes, count(*) FILTER (NOT is_noise) AS meaningful_changes"


@query(
    f"""WITH {CHANGE_LOG}, {CAPTURE_LOG}, u AS (SELECT tracked_url_id // 10 AS competitor_id, count(DISTINCT tracked_url_id) AS urls_scanned, count(DISTINCT tracked_url_id) FILTER (status_code <> 200) AS urls_failed FROM cap GROUP BY 1),
    t AS (SELECT *, NOT is_noise AND id % 3 = 0 AS told FROM changes),
    p AS (SELECT competitor_id // 10 AS competitor_id, competitor_id AS page, {_SQL_FUNNEL}, CASE WHEN count(*) FILTER (told) > 0 THEN count(*) FILTER (told AND relevance_score >= 70) ELSE count(*) FILTER (NOT is_noise AND relevance_score >= 70) END AS high FROM t GROUP BY 1, 2),
    m AS (SELECT competitor_id, sum(raw_changes)::BIGINT AS raw_changes, sum(noise_changes)::BIGINT AS noise_changes, sum(meaningful_changes)::BIGINT AS meaningful_changes, sum(high)::BIGINT AS high_impact_changes FROM p GROUP BY 1)
    SELECT competitor_id, urls_scanned, urls_failed, coalesce(raw_changes, 0) AS raw_changes, coalesce(noise_changes, 0) AS noise_changes, coalesce(meaningful_changes, 0) AS meaningful_changes, coalesce(high_impact_changes, 0) AS high_impact_changes,
        CASE WHEN urls_failed = urls_scanned THEN 'failed' ELSE 'completed' END AS status, CASE WHEN raw_changes > 0 THEN round(noise_changes / raw_changes * 100.0::DOUBLE, 2) ELSE 0.0 END AS noise_reduction FROM u LEFT JOIN m USING (competitor_id)"""
)
def scan_runs(spark, sf_dir):
    """Funnels of pages, where high impact counts narrated changes if there are any, merged into one run a competitor."""
    tens = F.floor(F.col("tracked_url_id") / 10).cast("long")
    captures = capture_log(spark, sf_dir).withColumns({"competitor_id": tens, "error": F.when(F.col("status_code") != 200, "http_error")})
    changes = change_log(spark, sf_dir).withColumn("tracked_url_id", F.col("competitor_id"))
    told = changes.withColumn("competitor_id", tens).withColumn("title", F.when(~F.col("is_noise") & (F.col("id") % 3 == 0), "told"))
    return pipeline.scan_runs(captures, narrate.assemble(told, ["competitor_id", "tracked_url_id"]))


@query()
def scan_changes(spark, sf_dir):
    """The scan of two captures of each page, with one in four pages unchanged: changes, narrated within the budget."""
    pages = _pages(spark, sf_dir).select(F.col("page_id").alias("tracked_url_id"), "html")
    new = F.regexp_replace(F.regexp_replace("html", "<h1>[^<]*", "<h1>Introducing AI-powered analytics, now available"), "</article>", '<p class="price">Pro plan now \\$79 per user</p></article>')
    at = lambda day: F.to_timestamp_ntz(F.lit(f"2024-01-{day} 00:00:00"))
    first = pages.select("tracked_url_id", (F.col("tracked_url_id") * 2).alias("id"), at("01").alias("timestamp"), "html")
    second = pages.select("tracked_url_id", (F.col("tracked_url_id") * 2 + 1).alias("id"), at("02").alias("timestamp"), F.when(F.col("tracked_url_id") % 4 > 0, new).otherwise(F.col("html")).alias("html"))
    both = first.unionByName(second).withColumns({"competitor_id": F.col("tracked_url_id") % 10, "url": F.concat(F.lit("p/"), F.col("tracked_url_id").cast("string")), "error": F.lit(None).cast("string")})
    got = pipeline.scan(both, competitors(spark, sf_dir).select("id", "name"), keep=kept, storing=False)
    return got.changes.select("tracked_url_id", "snapshot_id", "seq", "change_type", "category", "location", "before", "after", "noise_reason", "relevance_score", "severity", "change_key")


_CUTOFF = "2024-01-12 00:00:00"


@query(
    f"""WITH {CAPTURE_LOG}, n AS (SELECT *, row_number() OVER w = 1 OR content_hash IS DISTINCT FROM lag(content_hash) OVER w AS new, row_number() OVER w = 1 AS first FROM cap WINDOW w AS (PARTITION BY tracked_url_id ORDER BY timestamp, id)),
    r AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY tracked_url_id ORDER BY timestamp, id) AS run FROM n),
    p AS (SELECT tracked_url_id, run + 1 AS run, min_by(id, (timestamp, id)) AS previous_id FROM r GROUP BY tracked_url_id, run)
    SELECT id, tracked_url_id, CASE WHEN first THEN 'baseline' WHEN new THEN 'changed' ELSE 'unchanged' END AS status, CASE WHEN new THEN previous_id END AS previous_id FROM r LEFT JOIN p USING (tracked_url_id, run)"""
)
def incremental_scan(spark, sf_dir):
    """Captures in two scans, the second against what the first stored: each has the status and the predecessor that one scan of all would give."""
    log = capture_log(spark, sf_dir).select("id", "tracked_url_id", "timestamp", "content_hash")
    early = F.col("timestamp") < F.lit(_CUTOFF).cast("timestamp_ntz")
    first, points = pipeline.placed(log.filter(early), None)
    points = points.persist()  # stands for the stored table
    second, _ = pipeline.placed(log.filter(~early), points.select("id", "tracked_url_id", "timestamp", "content_hash", "touched_at"))
    return first.unionByName(second).select("id", "tracked_url_id", "status", "previous_id")


@query(
    f"""WITH {CHANGE_LOG}, c AS (SELECT *, CAST(CAST(detected_at AS DATE) AS VARCHAR) AS day, CAST(competitor_id AS VARCHAR) AS cid, relevance_score >= 70 AS h, detected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY AS last, detected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS week FROM changes),
    u AS (SELECT 'totals' AS report, CAST(NULL AS VARCHAR) AS key, * FROM c UNION ALL SELECT 'categories', category, * FROM c UNION ALL SELECT 'severities', severity, * FROM c UNION ALL SELECT 'timeline', day, * FROM c
        UNION ALL SELECT 'noise_reasons', noise_reason, * FROM c UNION ALL SELECT 'competitors', cid, * FROM c)
    SELECT report, key, count(*) AS total, count(*) FILTER (is_noise) AS noise, count(*) FILTER (NOT is_noise) AS meaningful, count(*) FILTER (h) AS high, count(*) FILTER (NOT is_noise AND h) AS meaningful_high, count(*) FILTER (last) AS last_total,
        count(*) FILTER (last AND NOT is_noise) AS last_meaningful, count(*) FILTER (last AND NOT is_noise AND h) AS last_meaningful_high, count(*) FILTER (week AND NOT is_noise) AS week_meaningful,
        count(*) FILTER (week AND NOT is_noise AND h) AS week_meaningful_high FROM u GROUP BY report, key"""
)
def analytics_bundle(spark, sf_dir):
    return analytics.bundle(change_log(spark, sf_dir), AS_OF, 10)


@query(
    f"""WITH {CHANGE_LOG} SELECT category, count(*) AS total, count(*) FILTER (NOT is_noise) AS meaningful, count(*) FILTER (NOT is_noise AND relevance_score >= 70) AS high_impact
    FROM changes WHERE detected_at BETWEEN TIMESTAMP '2024-01-05 06:30:00' AND TIMESTAMP '2024-01-20 18:00:00' AND competitor_id % 5 <> 0 GROUP BY category"""
)
def rollup_window(spark, sf_dir):
    """Counts of a period from a rollup that was built of half of the changes, got the other half, and lost every fifth competitor."""
    log = change_log(spark, sf_dir)
    first, second, gone = log.filter("id % 2 = 0"), log.filter("id % 2 = 1"), F.col("competitor_id") % 5 == 0
    rollup = analytics.rollup_after(analytics.daily_rollup(first), second, log.filter(gone))
    return analytics.rolled(analytics.rollup_window(rollup, log.filter(~gone), "2024-01-05 06:30:00", "2024-01-20 18:00:00"), "category")


@query(
    f"""WITH {CHANGE_LOG}, k AS (SELECT id, competitor_id, is_noise, relevance_score, CASE WHEN id % 11 = 0 THEN 'failed' WHEN id % 13 = 0 THEN 'rate_limited' ELSE 'ok' END AS said,
        row_number() OVER (PARTITION BY competitor_id, is_noise ORDER BY relevance_score DESC, id) AS rk FROM changes),
    d AS (SELECT competitor_id, min(rk) AS bad FROM k WHERE NOT is_noise AND relevance_score >= 40 AND rk <= 5 AND said <> 'ok' GROUP BY 1)
    SELECT id, CASE WHEN is_noise OR relevance_score < 40 OR rk > bad THEN 'skipped' WHEN rk <= 5 THEN said ELSE 'budget' END AS llm_status FROM k LEFT JOIN d USING (competitor_id)"""
)
def budget_gate_states(spark, sf_dir):
    """The budget gate with a provider that fails or is throttled for some changes: after that, the rest of the page is skipped."""
    said = F.when(F.col("id") % 11 == 0, "failed").when(F.col("id") % 13 == 0, "rate_limited").otherwise("ok")
    log = change_log(spark, sf_dir).withColumn("said", said)
    return narrate.budgeted(log, ["competitor_id"], 5, order="id", answer="said").select("id", "llm_status")


# ---------------------------------------------------------------- narrated payloads


@change_query(
    f"""WITH {CHANGE_ROWS}, k AS (SELECT doc_id, seq, CASE WHEN seq % 3 = 0 THEN 'failed' ELSE 'ok' END AS llm_status, seq % 5 <> 0 AS is_meaningful, before, after,
        CASE WHEN seq % 4 = 1 THEN upper(before) WHEN seq % 4 = 2 THEN 'a made-up claim' END AS cb, CASE WHEN seq % 7 > 0 THEN after ELSE 'another one' END AS ca FROM chg),
    f AS (SELECT *, {sql_fold("trim(coalesce(cb, ''))")} AS fcb, {sql_fold("trim(coalesce(ca, ''))")} AS fca, {sql_fold('trim(before)')} AS fb, {sql_fold('trim(after)')} AS fa FROM k)
    SELECT doc_id, seq, CASE WHEN llm_status = 'ok' AND NOT is_meaningful THEN 'not meaningful' WHEN NOT (fcb = '' OR contains(fb, fcb) OR (fb <> '' AND contains(fcb, fb))) OR NOT (fca = '' OR contains(fa, fca) OR (fa <> '' AND contains(fca, fa)))
        THEN 'not grounded' END AS reject_reason FROM f"""
)
def validated_payloads(rows):
    seq = F.col("seq")
    told = rows.withColumns({
        "llm_status": F.when(seq % 3 == 0, "failed").otherwise("ok"), "is_meaningful": seq % 5 != 0, "claimed_before": F.when(seq % 4 == 1, F.upper("before")).when(seq % 4 == 2, "a made-up claim"),
        "claimed_after": F.when(seq % 7 > 0, F.col("after")).otherwise("another one"),
    })
    return narrate.validate(told).select("doc_id", "seq", "reject_reason")


@query(
    f"""WITH {CHANGE_LOG}, b AS (SELECT id, CASE WHEN category = 'error' THEN 'other' ELSE category END AS category, relevance_score AS s, CASE WHEN id % 4 > 0 THEN CAST(id % 101 AS DOUBLE) END AS m FROM changes),
    f AS (SELECT id, CASE WHEN category = 'other' AND m IS NOT NULL THEN 'messaging' ELSE category END AS category, round(CASE WHEN m IS NULL THEN s ELSE greatest(0.0, least(100.0, s + greatest(-12.0, least(12.0, m - s)))) END, 2) AS relevance_score FROM b)
    SELECT *, {sql_severity('relevance_score')} AS severity FROM f"""
)
def finalised_scores(spark, sf_dir):
    payload = F.when(F.col("id") % 4 > 0, F.struct((F.col("id") % 101).cast("double").alias("relevance_score"), F.lit("messaging").alias("category")))
    rows = change_log(spark, sf_dir).select("id", F.when(F.col("category") == "error", "other").otherwise(F.col("category")).alias("category"), "relevance_score", payload.alias("payload"))
    return narrate.finalise(rows).select("id", "category", "relevance_score", "severity")


# ---------------------------------------------------------------- edits


@query(
    r"""WITH w AS (SELECT DISTINCT CASE WHEN s_suppkey % 5 = 0 THEN 'CUSTOMER#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') ELSE s_name END AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'http://127.0.0.1/' || s_suppkey ELSE 's' || s_suppkey || '.example.com' END AS url FROM supplier)
    SELECT name, 'https://' || url AS website_url, 'daily' AS tracking_frequency, TRUE AS active FROM w WHERE NOT contains(url, '127.0.0.1') AND NOT EXISTS (SELECT 1 FROM customer c WHERE lower(c.c_name) = lower(w.name))"""
)
def new_competitors(spark, sf_dir):
    k = F.col("s_suppkey")
    wanted = _read(spark, sf_dir, "supplier").select(
        F.when(k % 5 == 0, F.concat(F.lit("CUSTOMER#"), F.lpad(k.cast("string"), 9, "0"))).otherwise(F.col("s_name")).alias("name"),
        F.when(k % 4 == 0, F.concat(F.lit("http://127.0.0.1/"), k.cast("string"))).otherwise(F.concat(F.lit("s"), k.cast("string"), F.lit(".example.com"))).alias("website_url"), F.lit("").alias("description"),
    )
    return edits.new_competitors(competitors(spark, sf_dir), wanted, "2024-01-01").select("name", "website_url", "tracking_frequency", "active")


@query(
    r"""WITH w AS (SELECT DISTINCT page_id % 20 AS competitor_id, regexp_replace(url, '#.*$', '') AS url FROM pages), h AS (SELECT DISTINCT page_id % 20 AS competitor_id, regexp_replace(url, '#.*$', '') AS url FROM pages WHERE page_id % 3 = 0),
    x AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS p FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.competitor_id = w.competitor_id AND h.url = w.url))
    SELECT competitor_id, url, CASE """
    + " ".join(f"WHEN regexp_matches(p, {q('|'.join(words))}) THEN {q(name)}" for name, words in P.PAGE_TYPES)
    + " ELSE 'generic' END AS page_type, TRUE AS active FROM x"
)
def new_tracked_urls(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("competitor_id"), "page_id", "url", F.lit("").alias("label"))
    have = pages.filter(F.col("page_id") % 3 == 0).select("competitor_id", urls.normalize_url("url").alias("url"))
    return edits.new_urls(have, pages.drop("page_id"), "2024-01-01").select("competitor_id", "url", "page_type", "active")


@query("SELECT c_custkey AS id, (c_acctbal > 0) <> (c_custkey % 7 = 0) AS active, CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '2024-02-01' END AS updated_at FROM customer")
def toggled_competitors(spark, sf_dir):
    rows = competitors(spark, sf_dir).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    return edits.toggled(rows, rows.filter(F.col("id") % 7 == 0), "2024-02-01").select("id", "active", "updated_at")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'N' || c_custkey ELSE c_name END AS name, CASE WHEN c_custkey % 6 = 0 THEN c_acctbal <= 0 ELSE c_acctbal > 0 END AS active FROM customer")
def merged_competitors(spark, sf_dir):
    rows = competitors(spark, sf_dir).select("id", "name", "active")
    k = F.col("id")
    return edits.merged(rows, rows.filter(k % 3 == 0).select("id", F.concat(F.lit("N"), k.cast("string")).alias("name"), F.when(k % 6 == 0, ~F.col("active")).alias("active")))


# ---------------------------------------------------------------- functions over the tables' own content


@query("SELECT event_id, 400 + CAST(floor(value) AS BIGINT) % 110 IN (408, 425, 429, 500, 502, 503, 504) AS again FROM events WHERE value IS NOT NULL")
def retryable_by_value(spark, sf_dir):
    """Status codes taken from the values of events."""
    events = _read(spark, sf_dir, "events").filter(F.col("value").isNotNull())
    return events.select("event_id", pipeline.is_retryable(F.lit(400) + F.floor("value") % 110).alias("again"))


_SQL_VALUES = "v AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(floor(value) AS BIGINT) || '%' WHEN event_id % 3 = 1 THEN 'about ' || CAST(floor(value) AS BIGINT) || ' points' ELSE event_type END AS w FROM events WHERE value IS NOT NULL)"


@query(
    f"""WITH {_SQL_VALUES}, n AS (SELECT event_id, lower(regexp_replace(trim(w), '%+$', '')) AS t, TRY_CAST(nullif(regexp_extract(w, '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE) AS x FROM v)
    SELECT event_id, CASE t WHEN 'noise' THEN 15.0 WHEN 'low' THEN 40.0 WHEN 'medium' THEN 60.0 WHEN 'high' THEN 78.0 WHEN 'critical' THEN 92.0
        ELSE CASE WHEN x IS NULL THEN 50.0 ELSE greatest(0.0, least(100.0, CASE WHEN x > 0 AND x <= 1 THEN x * 100 ELSE x END)) END END AS score,
        CASE WHEN x IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, CASE WHEN x > 1 THEN x / 100 ELSE x END)) END AS confidence FROM n"""
)
def scores_of_values(spark, sf_dir):
    """Payload scores and confidences read from the values and types of events, as a narrator may write them."""
    whole, k = F.floor("value").cast("string"), F.col("event_id") % 3
    said = F.when(k == 0, F.concat(whole, F.lit("%"))).when(k == 1, F.concat(F.lit("about "), whole, F.lit(" points"))).otherwise(F.col("event_type"))
    return _read(spark, sf_dir, "events").filter(F.col("value").isNotNull()).select("event_id", payloads.coerce_score(said).alias("score"), payloads.coerce_confidence(said).alias("confidence"))


@query(
    _SQL_URLS + r""", x AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS nl FROM n)
    SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(nl, '^.*@', ''), ':\d*$', ''), '^\[|\]$', '', 'g')) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM x"""
)
def host_and_path(spark, sf_dir):
    url = urls.normalize_url("raw")
    return _urls(spark, sf_dir).select("page_id", urls.host(url).alias("host"), urls.path(url).alias("path"))


@query(f"WITH {CHANGE_LOG} SELECT id, name, tracking_frequency FROM competitors WHERE active")
def active_competitors(spark, sf_dir):
    return analytics.list_competitors(competitors(spark, sf_dir), active_only=True).select("id", "name", "tracking_frequency")


_NARROW = r"^[\x00-\x7F\xA0-\xFF]*+\z"
_META = '<meta charset="windows-1252">'


@query(rf"SELECT doc_id, CASE WHEN doc_id % 3 = 1 AND regexp_matches(text, '^[\x00-\x7F\x{{A0}}-\x{{FF}}]*$') AND regexp_matches(text, '[\x{{A0}}-\x{{FF}}]') THEN '{_META}' || text ELSE text END AS out FROM documents")
def undeclared_bodies(spark, sf_dir):
    """Bodies whose server declares no charset: single-byte ones, with the charset in the page or nowhere, are read by it or as cp1252."""
    narrow = F.col("text").rlike(_NARROW) & F.col("text").rlike(r"[\xA0-\xFF]")
    marked = narrow & (F.col("doc_id") % 3 == 1)
    text = F.when(marked, F.concat(F.lit(_META), "text")).otherwise(F.col("text"))
    body = F.when(narrow, F.encode(F.when(narrow, text), "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return _read(spark, sf_dir, "documents").select("doc_id", sources.decode_body(body, F.lit(None).cast("string")).alias("out"))


@query()
def repaired_payloads(spark, sf_dir):
    """Each document as a payload that breaks off at some place, repaired: whole fields are there, a cut one is left out (a first field keeps what there is of it); null where nothing can be read."""
    whole = F.to_json(F.struct("doc_id", "lang", "source", "text"))
    cut = F.left(whole, (1 + F.pmod(F.col("doc_id") * 7919, F.length(whole))).cast("int"))
    return _read(spark, sf_dir, "documents").select("doc_id", payloads.extract_json(cut).alias("payload"))
