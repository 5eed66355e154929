"""Every operator as a query over the driver's tables, with DuckDB SQL where SQL can express it.

The tables hold no capture pairs, so three stand-ins are used, the same in both engines:
* change rows: each line of a document against the same line of the document before it from the
  same source, with phrases planted by a hash so that every rule and detector has work, and a
  magnitude from that hash (change_magnitude computes the real one);
* a change log: `events` as changes, `customer` as competitors, `orders` as narrated records;
* captures: `events` by user, with the event type as content hash.
Patterns come from functions.patterns on both sides; everything around them is written twice.
DuckDB knows ASCII word borders only: its patterns search a copy of the text in which letters and
digits beyond ASCII are underscores. It has no compatibility composition, which changes nothing in
texts that are composed already, as those of the tables are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from ..arrow import spread, with_python
from ..functions import patterns as P
from ..functions import payloads, text, urls
from ..operators import classify, diff, html, narrate, noise, relevance, snapshots
from ..operators.ordered import lagged
from . import analytics, digest, evaluate

AS_OF = "2024-01-20 00:00:00"
START, END = "2024-01-05 00:00:00", "2024-01-20 00:00:00"

#: Planted at the end of lines; the empty ones leave a line as it is.
PHRASES = (
    "", "", "", "", "", "", "Rs 999/month", "Rs 1,499/month", "$49 per user billed annually", "$79 per user", "Free forever plan", "Pro plan $19 per month", "5 projects", "10 projects", "10 GB storage",
    "Introducing AI-powered analytics", "now available in beta", "We are hiring: machine learning engineer", "senior software engineer, remote", "Integrates with Slack and GitHub", "works with Salesforce webhook",
    "Trusted by 4,200 developers", "Trusted by 5,100 developers", "213 visitors online right now", "438 visitors online right now", "Copyright 2025 Acme. All rights reserved.", "Copyright 2026 Acme. All rights reserved.",
    "We use cookies", "share this on twitter", "The leading platform for teams", "built for developers", "new product launch: dashboard", "updated 2026-09-05T08:14:22Z", "3 days ago", "unlimited seats",
)
LOCATIONS = ("body", "main", "pricing", "footer", "navigation", "careers", "integrations", "header", "product", "blog", "cookie_banner")
TYPES = ("text_change", "added", "modified", "headline_change", "removed")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- SQL counterparts


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else repr(float(v)) for v in values) + "]"


_WHITE = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_collapse(x: str) -> str:
    plain = f"regexp_replace(coalesce({x}, ''), '[\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{feff}}]', '', 'g')"
    return f"trim(regexp_replace({plain}, '{_WHITE}+', ' ', 'g'))"


def sql_mask(x: str) -> str:
    for pattern, placeholder in P.DYNAMIC_TOKENS:
        x = f"regexp_replace({x}, {q(pattern)}, {q(placeholder)}, 'gi')"
    return x


def sql_fold(x: str) -> str:
    return f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


def sql_canon(x: str) -> str:
    straight = f"translate({sql_fold(sql_mask(sql_collapse(x)))}, '’‘“”–—', '''''\"\"--')"
    return f"trim(regexp_replace({straight}, '[\\s\\x{{a0}}]+', ' ', 'g'), ' .,;:!•|-')"


def sql_words(x: str) -> str:
    """A text in which RE2 finds the borders of words as Java does."""
    return f"regexp_replace({x}, '[^\\x00-\\x7F\\pP\\pS\\pZ\\pC]', '_', 'g')"


def sql_has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q('(?i)' + pattern)})"


def sql_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q('(?i)' + pattern)}))"


def sql_truncate(x: str, limit: int) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '^{_WHITE}+|{_WHITE}+$', '', 'g')"
    return f"CASE WHEN length({t}) > {limit} THEN regexp_replace(left({t}, {limit - 1}), '{_WHITE}+$', '') || '…' ELSE {t} END"


def sql_round(x: str, n: int) -> str:
    """Half up on the shortest decimal form, as Spark rounds."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {n}) AS DOUBLE)"


def sql_severity(x: str) -> str:
    return f"CASE WHEN {x} < 30 THEN 'noise' WHEN {x} < 50 THEN 'low' WHEN {x} < 70 THEN 'medium' WHEN {x} < 85 THEN 'high' ELSE 'critical' END"


# ---------------------------------------------------------------- stand-ins


def _hex(expr, a: int, n: int):
    return F.conv(F.substring(F.md5(expr), a, n), 16, 10).cast("int")


def change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seq, before, after, location, change_type, magnitude)."""
    docs = spread(_read(spark, sf_dir, "documents").select("doc_id", "source", "text")).withColumn("text", text.folded("text"))
    # Both sides meet by id, so one shuffle of the same rows serves both; documents without an id meet none.
    lines = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines")).repartition("doc_id")
    # Whole documents meet, and by shuffle: lines would be ten times the rows, and a broadcast would leave the rules with as many tasks as the scan.
    copies = Window.partitionBy("doc_id")
    then = lines.select(
        F.col("doc_id").alias("before_id"), F.col("lines").alias("old_lines"), F.max(F.size("lines")).over(copies).alias("longest"), F.row_number().over(copies.orderBy("doc_id")).alias("nth"),
    )
    both = lines.join(_previous(spark, sf_dir), "doc_id").join(then.hint("merge"), "before_id", "left")
    each = F.slice(F.arrays_zip("lines", F.coalesce("old_lines", F.array().cast("array<string>")).alias("old")), F.lit(1), F.size("lines"))
    joined = both.select("doc_id", "longest", "nth", F.size("old_lines").alias("n_old"), F.posexplode(each).alias("seq", "pair")).select("*", F.col("pair.lines").alias("line"), F.col("pair.old").alias("old"))
    # Where a doc_id repeats, a line without counterpart in any copy stands once.
    joined = joined.filter(F.col("nth").isNull() | (F.col("seq") < F.col("n_old")) | ((F.col("nth") == 1) & (F.col("seq") >= F.col("longest"))))
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("seq").cast("string"))
    phrases = F.array(*map(F.lit, PHRASES))
    planted = lambda line, a: F.trim(F.concat(F.coalesce(line, F.lit("")), F.lit(" "), F.get(phrases, _hex(key, a, 4) % len(PHRASES))))
    # Half of the rows compare a line with itself, so that small and canonical differences occur.
    old = F.when(_hex(key, 9, 1) < 8, F.col("line")).otherwise(F.col("old"))
    return joined.select(
        "doc_id", "seq", planted(old, 1).alias("before"), planted(F.col("line"), 5).alias("after"), F.get(F.array(*map(F.lit, LOCATIONS)), _hex(key, 10, 2) % len(LOCATIONS)).alias("location"),
        F.get(F.array(*map(F.lit, TYPES)), _hex(key, 12, 2) % len(TYPES)).alias("change_type"), (_hex(key, 14, 2) % 100 / 100.0).alias("magnitude"),
    )


def _previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, before_id): the document before in the same source. Ids only, as a source may hold a third of all texts."""
    ids = _read(spark, sf_dir, "documents").select("doc_id", "source")
    return lagged(ids, ["doc_id"], "source", "doc_id", "doc_id").select("doc_id", F.col("previous_doc_id").alias("before_id"))


def _sql_hex(a: int, n: int) -> str:
    return f"CAST('0x' || substr(md5(k), {a}, {n}) AS INTEGER)"


CHANGE_ROWS = f"""
    doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS before_id FROM documents),
    ln AS (SELECT doc_id, before_id, x - 1 AS seq, ls[x] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS x FROM doc)),
    jn AS (SELECT a.doc_id, a.seq, a.line, b.line AS old, a.doc_id || ':' || a.seq AS k FROM ln a LEFT JOIN ln b ON a.before_id = b.doc_id AND a.seq = b.seq),
    cht AS (SELECT doc_id, CAST(seq AS INTEGER) AS seq,
        trim(coalesce(CASE WHEN {_sql_hex(9, 1)} < 8 THEN line ELSE old END, '') || ' ' || {_list(PHRASES)}[1 + {_sql_hex(1, 4)} % {len(PHRASES)}]) AS before,
        trim(line || ' ' || {_list(PHRASES)}[1 + {_sql_hex(5, 4)} % {len(PHRASES)}]) AS after,
        {_list(LOCATIONS)}[1 + {_sql_hex(10, 2)} % {len(LOCATIONS)}] AS location, {_list(TYPES)}[1 + {_sql_hex(12, 2)} % {len(TYPES)}] AS change_type,
        CAST({_sql_hex(14, 2)} % 100 AS DOUBLE) / 100.0 AS magnitude FROM jn),
    chg AS (SELECT *, {sql_words('before')} AS wob, {sql_words('after')} AS woa, {sql_words('before')} || ' ' || {sql_words('after')} AS wox FROM cht)"""


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as stored changes."""
    score = F.round(F.least(F.col("value"), F.lit(100.0)), 2)
    reasons = F.array(*map(F.lit, ("identical", "too short", "boilerplate", "low magnitude")))
    noise_ = F.col("event_type") == "view"
    return _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("competitor_id"), F.col("event_type").alias("category"), score.alias("relevance_score"), relevance.severity(score).alias("severity"), F.col("ts").alias("detected_at"),
        noise_.alias("is_noise"), F.when(noise_, F.get(reasons, (F.col("event_id") % 4).cast("int"))).alias("noise_reason"), F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("source_url"), F.col("event_type").alias("change_type"),
    )


CHANGE_LOG = f"""
    ev AS (SELECT *, round(least(value, 100.0), 2) AS s FROM events),
    changes AS (SELECT event_id AS id, user_id AS competitor_id, event_type AS category, s AS relevance_score, {sql_severity('s')} AS severity, ts AS detected_at, event_type = 'view' AS is_noise,
        CASE WHEN event_type = 'view' THEN ['identical', 'too short', 'boilerplate', 'low magnitude'][1 + event_id % 4] END AS noise_reason, 'u/' || user_id AS source_url, event_type AS change_type FROM ev),
    competitors AS (SELECT c_custkey AS id, c_name AS name, c_acctbal > 0 AS active, CASE c_mktsegment WHEN 'BUILDING' THEN 'manual' WHEN 'MACHINERY' THEN 'hourly' WHEN 'FURNITURE' THEN 'weekly' ELSE 'daily' END AS tracking_frequency FROM customer),
    intelligence AS (SELECT id, id AS change_id, competitor_id, category, relevance_score, severity, detected_at AS created_at, CASE WHEN id % 3 = 0 THEN '' ELSE 'r/' || id END AS source_url,
        CASE WHEN id % 5 = 0 THEN 'failed' ELSE 'ok' END AS llm_status, 'T' || id AS title FROM changes WHERE NOT is_noise AND relevance_score >= 40)"""


def competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    frequency = F.when(segment == "BUILDING", "manual").when(segment == "MACHINERY", "hourly").when(segment == "FURNITURE", "weekly").otherwise("daily")
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("active"), frequency.alias("tracking_frequency"))


def intelligence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = change_log(spark, sf_dir).filter(~F.col("is_noise") & (F.col("relevance_score") >= 40))
    return rows.select(
        "id", F.col("id").alias("change_id"), "competitor_id", "category", "relevance_score", "severity", F.col("detected_at").alias("created_at"),
        F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("r/"), F.col("id").cast("string"))).alias("source_url"), F.when(F.col("id") % 5 == 0, "failed").otherwise("ok").alias("llm_status"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("title"),
    )


def capture_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as captures of one URL a user."""
    return _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("tracked_url_id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("content_hash"), F.when(F.col("event_id") % 7 == 0, 404).otherwise(200).alias("status_code"),
    )


CAPTURE_LOG = "cap AS (SELECT event_id AS id, user_id AS tracked_url_id, ts AS timestamp, event_type AS content_hash, CASE WHEN event_id % 7 = 0 THEN 404 ELSE 200 END AS status_code FROM events)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with its SQL if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def change_query(sql: str | None):
    """Register a query over change rows, with its SQL if there is one."""

    def put(f):
        def run(spark, sf_dir):
            return f(change_rows(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return query(sql)(run)

    return put


# ---------------------------------------------------------------- text


def _docs(spark, sf_dir, **columns) -> DataFrame:
    """Columns over `text`, the folded text of each document."""
    docs = spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.withColumn("text", text.folded("text")).select("doc_id", *(c.alias(k) for k, c in columns.items()))


@query(f"SELECT doc_id, {sql_collapse('text')} AS out FROM documents")
def collapse_ws(spark, sf_dir):
    return _docs(spark, sf_dir, out=text.collapse_whitespace("text"))


@query(f"SELECT doc_id, {sql_mask('text')} AS out FROM documents")
def mask_tokens(spark, sf_dir):
    return _docs(spark, sf_dir, out=text.strip_dynamic_tokens("text"))


@change_query(f"WITH {CHANGE_ROWS} SELECT doc_id, seq, {sql_canon('after')} AS out FROM chg")
def canonicalise(rows):
    return rows.select("doc_id", "seq", text.canonicalise("after").alias("out"))


@query(f"SELECT doc_id, sha256({sql_canon('text')}) AS out FROM documents")
def content_hash(spark, sf_dir):
    return _docs(spark, sf_dir, out=text.content_hash("text"))


@query(f"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '{_WHITE}+'), lambda x: x <> '')) AS INTEGER) AS out FROM documents")
def word_count(spark, sf_dir):
    return _docs(spark, sf_dir, out=text.word_count("text"))


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_collapse('x')}), lambda x: x <> ''), chr(10)) AS out FROM documents")
def normalize_lines(spark, sf_dir):
    return _docs(spark, sf_dir, out=text.normalize_text("text"))


@query(f"SELECT doc_id, {sql_truncate('text', 1200)} AS snippet, {sql_truncate(sql_collapse('text'), 160)} AS short FROM documents")
def truncate_snippet(spark, sf_dir):
    return _docs(spark, sf_dir, snippet=text.truncate("text"), short=text.shorten("text", 160))


_SECRET_TAILS = ("", " Authorization: Bearer abc.def-123", ' "api_key": "k-12345678"', " https://user:hunter2@example.com/x", " key sk-ABCDEFGH12345678 end", " sent bearer tok_123 now")


def _sql_redact(x: str) -> str:
    for pattern, put, fold in P.SECRETS:
        x = f"regexp_replace({x}, {q(pattern)}, {q(put.replace('$', chr(92)))}, '{'gi' if fold else 'g'}')"
    return x


def _secret_tail():
    return F.get(F.array(*map(F.lit, _SECRET_TAILS)), (F.col("doc_id") % len(_SECRET_TAILS)).cast("int"))


@query("SELECT doc_id, " + _sql_redact(f"text || coalesce({_list(_SECRET_TAILS)}[1 + doc_id % {len(_SECRET_TAILS)}], '')") + " AS out FROM documents")
def redact(spark, sf_dir):
    """Whole texts as they are, each with the planted tail; a row without a usable doc_id has no tail."""
    docs = spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", text.redact_secrets(F.concat("text", F.coalesce(_secret_tail(), F.lit("")))).alias("out"))


# ---------------------------------------------------------------- pages and URLs


def _pages(spark, sf_dir) -> DataFrame:
    return spread(_read(spark, sf_dir, "pages").select("page_id", "html"))


@query()
def page_titles(spark, sf_dir):
    pages = html.with_page(_pages(spark, sf_dir))
    return pages.select("page_id", "page.title")


@query()
def extract_blocks(spark, sf_dir):
    blocks = html.with_blocks(_pages(spark, sf_dir)).select("page_id", F.inline("blocks"))
    return blocks.select("page_id", "pos", "text", "location", "tag", "depth")


@query()
def block_locations(spark, sf_dir):
    return extract_blocks(spark, sf_dir).groupBy("location", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<a\\s')) AS INTEGER) AS links FROM pages")
def page_links(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit(r"<a\s")).alias("links"))


_URL_SHAPES = ("{u}", " {b}/pricing#top ", "{u}", "http://127.0.0.1/{i}", "http://10.1.2.3/jobs/{i}", "https://user:pw@{h}/x", "ftp://{h}/x", "http://printer.local/{i}", "http://169.254.169.254/latest", "https://{h}:8443/Blog/{i}", "http://93.184.216.34/product", "", "http://[::1]/{i}", "http://[fe80::1%25eth0]:8080/", "https://[fd12:3456::7]:8443/plans", "http://[2001:db8::5]/", "https://[2606:4700:4700::1111]/news/{i}", "http://[::ffff:10.0.0.1]/")


def _urls(spark, sf_dir) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("h"))
    i, out = (F.col("page_id") % len(_URL_SHAPES)).cast("int"), None
    for k, shape in enumerate(_URL_SHAPES):
        made = F.lit(shape)
        for name, value in (("{u}", F.col("url")), ("{b}", F.concat(F.col("h"))), ("{h}", F.col("h")), ("{i}", F.col("page_id").cast("string"))):
            made = F.replace(made, F.lit(name), value)
        out = F.when(i == k, made) if out is None else out.when(i == k, made)
    return pages.select("page_id", out.alias("raw"))


def _sql_shape(shape: str) -> str:
    x = q(shape)
    for name, value in (("{u}", "url"), ("{b}", "h"), ("{h}", "h"), ("{i}", "CAST(page_id AS VARCHAR)")):
        x = f"replace({x}, '{name}', {value})"
    return x


_SQL_URLS = (
    "WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h FROM pages), r AS (SELECT page_id, CASE "
    + " ".join(f"WHEN page_id % {len(_URL_SHAPES)} = {k} THEN {_sql_shape(s)}" for k, s in enumerate(_URL_SHAPES))
    + " END AS raw FROM p), n AS (SELECT page_id, CASE WHEN trim(raw) <> '' THEN regexp_replace(CASE WHEN contains(trim(raw), '://') THEN trim(raw) ELSE 'https://' || trim(raw) END, '#.*$', '') END AS url FROM r)"
)


@query(_SQL_URLS + " SELECT * FROM n")
def url_normalise(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", urls.normalize_url("raw").alias("url"))


@query(
    _SQL_URLS + r""", x AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS sc, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS nl FROM n),
    y AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(nl, '^.*@', ''), ':\d*$', ''), '^\[|\]$', '', 'g')) AS h FROM x)
    SELECT page_id, CASE WHEN url IS NULL THEN 'empty url' WHEN sc NOT IN ('http', 'https') THEN 'unsupported scheme' WHEN contains(nl, '@') THEN 'embedded credentials' WHEN h = '' THEN 'no hostname'
        WHEN h IN ('localhost', 'localhost.localdomain', 'ip6-localhost', 'ip6-loopback', 'metadata.google.internal') OR regexp_matches(h, '\.(localhost|local|internal|localdomain)$') THEN 'private hostname'
        WHEN regexp_matches(h, '^(0|10|127)\.\d+\.\d+\.\d+$|^169\.254\.\d+\.\d+$|^192\.168\.\d+\.\d+$|^172\.(1[6-9]|2\d|3[01])\.\d+\.\d+$|^(::1?|::ffff:.*|2001:db8:.*|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*)$') THEN 'private or reserved address' END AS reason FROM y"""
)
def url_safe(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", urls.unsafe_reason("raw").alias("reason"))


@query(_SQL_URLS + r" SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS origin FROM n")
def url_origin(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", urls.origin(urls.normalize_url("raw")).alias("origin"))


@query(
    _SQL_URLS
    + r", x AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS p FROM n) SELECT page_id, CASE "
    + " ".join(f"WHEN regexp_matches(p, {q('|'.join(words))}) THEN {q(name)}" for name, words in P.PAGE_TYPES)
    + " ELSE 'generic' END AS page_type FROM x"
)
def page_type(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", urls.page_type(urls.normalize_url("raw")).alias("page_type"))


@query("SELECT a.page_id, regexp_extract(a.url, '^([a-z]+://[^/?#]+)', 1) = regexp_extract(b.url, '^([a-z]+://[^/?#]+)', 1) AS same FROM pages a JOIN pages b ON b.page_id = a.page_id - 1")
def same_origin(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    other = pages.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("other"))
    return pages.join(other, "page_id").select("page_id", urls.same_origin("url", "other").alias("same"))


# ---------------------------------------------------------------- snapshots


@query(f"WITH {CAPTURE_LOG} SELECT tracked_url_id, max_by(id, (timestamp, id)) AS id FROM cap GROUP BY 1")
def latest_snapshot(spark, sf_dir):
    return snapshots.latest(capture_log(spark, sf_dir)).select("tracked_url_id", "id")


@query(f"WITH {CAPTURE_LOG} SELECT id, lag(id) OVER (PARTITION BY tracked_url_id ORDER BY timestamp, id) AS previous_id FROM cap")
def previous_snapshot(spark, sf_dir):
    return snapshots.with_previous(capture_log(spark, sf_dir), ["id"]).select("id", "previous_id")


@query(
    f"""WITH {CAPTURE_LOG}, n AS (SELECT *, content_hash IS DISTINCT FROM lag(content_hash) OVER w AS new FROM cap WINDOW w AS (PARTITION BY tracked_url_id ORDER BY timestamp, id)),
    r AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY tracked_url_id ORDER BY timestamp, id) AS run FROM n)
    SELECT min_by(id, (timestamp, id)) AS id, tracked_url_id, min_by(content_hash, (timestamp, id)) AS content_hash, max(timestamp) AS touched_at FROM r GROUP BY tracked_url_id, run"""
)
def snapshot_dedupe(spark, sf_dir):
    return snapshots.stored(capture_log(spark, sf_dir)).select("id", "tracked_url_id", "content_hash", "touched_at")


@query(
    f"""WITH {CAPTURE_LOG}, o AS (SELECT * FROM cap QUALIFY row_number() OVER (PARTITION BY tracked_url_id, timestamp ORDER BY id DESC) = 1)
    SELECT tracked_url_id, id FROM o QUALIFY row_number() OVER (PARTITION BY tracked_url_id ORDER BY timestamp) <= 5 OR row_number() OVER (PARTITION BY tracked_url_id ORDER BY timestamp DESC) <= 5"""
)
def capture_spread(spark, sf_dir):
    return snapshots.spread(capture_log(spark, sf_dir), 10, url="tracked_url_id").select("tracked_url_id", "id")


@query(
    f"""WITH {CAPTURE_LOG}, h AS (SELECT *, bool_or(status_code = 200) OVER (PARTITION BY tracked_url_id) AS any_ok FROM cap), u AS (SELECT * FROM h WHERE NOT any_ok OR status_code = 200),
    d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY tracked_url_id, content_hash ORDER BY timestamp, id) = 1)
    SELECT tracked_url_id, min_by(id, (timestamp, id)) AS before_id, max_by(id, (timestamp, id)) AS after_id, count(*) AS n FROM d GROUP BY 1 HAVING count(*) >= 2"""
)
def capture_pair(spark, sf_dir):
    return snapshots.select_pair(capture_log(spark, sf_dir), url="tracked_url_id", digest="content_hash")


@query("SELECT event_id, TRY_CAST(strptime(s, '%Y%m%d%H%M%S') AS TIMESTAMP) AS at FROM (SELECT event_id, rpad(CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y') || '0101' WHEN 1 THEN strftime(ts, '%Y%m%d') ELSE strftime(ts, '%Y%m%d%H%M%S') END, 14, '0') AS s FROM events)")
def archive_dates(spark, sf_dir):
    k = F.col("event_id") % 3
    stamp = F.when(k == 0, F.date_format("ts", "yyyy")).when(k == 1, F.date_format("ts", "yyyyMMdd")).otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    return _read(spark, sf_dir, "events").select("event_id", snapshots.parse_archive_date(stamp).cast("timestamp_ntz").alias("at"))


# ---------------------------------------------------------------- differences


@query(
    """WITH d AS (SELECT doc_id, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS old FROM documents), a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d WHERE old IS NOT NULL),
    b AS (SELECT doc_id, unnest(string_split(old, chr(10))) AS line FROM d WHERE old IS NOT NULL),
    n AS (SELECT doc_id, line, sum(x) AS net FROM (SELECT doc_id, line, 1 AS x FROM a UNION ALL SELECT doc_id, line, -1 FROM b) GROUP BY ALL) SELECT doc_id, line, CAST(net AS BIGINT) AS net FROM n WHERE net <> 0"""
)
def line_changes(spark, sf_dir):
    """Lines added (net > 0) and removed (net < 0) between consecutive documents of a source, as multisets."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text").filter(F.col("text").isNotNull())
    pairs = _previous(spark, sf_dir).filter(F.col("before_id").isNotNull()).join(docs.select(F.col("doc_id").alias("before_id")), "before_id", "left_semi")
    lines = lambda df, x: df.select("doc_id", F.explode(F.split("text", "\n")).alias("line"), F.lit(x).cast("long").alias("x"))
    old = docs.withColumnRenamed("doc_id", "before_id").join(pairs, "before_id")
    return lines(docs.join(pairs, "doc_id"), 1).unionByName(lines(old, -1)).groupBy("doc_id", "line").agg(F.sum("x").alias("net")).filter("net <> 0")


@query()
def diff_changes(spark, sf_dir):
    docs = spread(_read(spark, sf_dir, "documents").select("doc_id", "text").filter(F.col("doc_id").isNotNull()))
    # Each text gets its keys once, and one shuffle of the lines serves it as the new and as the old side.
    lines = docs.select("doc_id", diff.keyed_lines("text").alias("lines")).repartition("doc_id")
    old = lines.select(F.col("doc_id").alias("before_id"), F.col("lines").alias("before_blocks"))
    both = lines.join(_previous(spark, sf_dir), "doc_id").join(old.hint("merge"), "before_id").select(F.col("doc_id").alias("pair_id"), "before_blocks", F.col("lines").alias("after_blocks"))
    # Pairs without an old text are left out by a generator: a filter would go below the shuffle, and the two sides would be shuffled apart.
    known = both.select(F.inline(F.when(F.col("before_blocks").isNotNull(), F.array(F.struct(*both.columns)))))
    return diff.diff_keyed(known, ["pair_id"])


@change_query(None)
def word_diff(rows):
    # Python hands on what it is given, so it is given no more than is asked for.
    return diff.with_word_diff(rows.select("doc_id", "seq", "before", "after")).select("doc_id", "seq", F.to_json("segments").alias("segments"))


@change_query(
    f"""WITH {CHANGE_ROWS} SELECT doc_id, min(seq) AS seq FROM (SELECT doc_id, seq, location, left({sql_canon('before')}, 200) AS b, left({sql_canon('after')}, 200) AS a FROM chg) GROUP BY doc_id, location, b, a"""
)
def dedupe_changes(rows):
    return diff.first_of_repeats(rows, ["doc_id"]).select("doc_id", "seq")


@change_query(
    f"""WITH {CHANGE_ROWS}, t AS (SELECT doc_id, seq, CASE WHEN before <> '' THEN ['p', 'h2', 'li'][1 + seq % 3] END AS bt, CASE WHEN after <> '' THEN ['h1', 'p', 'td'][1 + (seq // 3) % 3] END AS tn,
        CASE WHEN seq % 2 = 0 THEN location ELSE 'body' END AS bl, CASE WHEN seq % 4 < 2 THEN 'main' ELSE location END AS al FROM chg)
    SELECT doc_id, seq, CASE WHEN bt IS NULL THEN 'added' WHEN tn IS NULL THEN 'removed' WHEN bt = 'h2' OR tn = 'h1' THEN 'headline_change' ELSE 'text_change' END AS change_type,
        CASE WHEN al NOT IN ('body', 'main') THEN al WHEN bl NOT IN ('body', 'main') THEN bl ELSE al END AS location FROM t"""
)
def change_types(rows):
    seq = F.col("seq")
    tags = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    before = F.when(F.col("before") != "", tags(("p", "h2", "li"), seq % 3))
    after = F.when(F.col("after") != "", tags(("h1", "p", "td"), F.floor(seq / 3) % 3))
    old, new = F.when(seq % 2 == 0, F.col("location")).otherwise("body"), F.when(seq % 4 < 2, "main").otherwise(F.col("location"))
    return rows.select("doc_id", "seq", diff.change_type(before, after).alias("change_type"), diff.merged_location(old, new).alias("location"))


_SQL_MAGNITUDE = "CASE WHEN cb = ca THEN 0.0 WHEN cb = '' OR ca = '' THEN round(least(1.0, 0.35 + length(cb || ca) / 600.0::DOUBLE), 4) ELSE round(1.0 - magnitude, 4) END"


@change_query(f"WITH {CHANGE_ROWS}, c AS (SELECT *, {sql_canon('before')} AS cb, {sql_canon('after')} AS ca FROM chg) SELECT doc_id, seq, CAST({_SQL_MAGNITUDE} AS DOUBLE) AS magnitude FROM c")
def magnitude_branches(rows):
    """How a similarity becomes a magnitude, with the planted figure for the similarity, as SQL cannot compute it."""
    return rows.select("doc_id", "seq", diff.magnitude(text.canonicalise("before"), text.canonicalise("after"), F.col("magnitude")).alias("magnitude"))


@change_query(None)
def change_magnitude(rows):
    """Size of each change by the similarity of its canonical texts."""
    keys = rows.select("doc_id", "seq", text.canonicalise("before").alias("old"), text.canonicalise("after").alias("new"))
    rated = with_python(keys, ["old", "new"], StructField("ratio", DoubleType()), diff.similarity)
    return rated.select("doc_id", "seq", diff.magnitude(F.col("old"), F.col("new"), F.col("ratio")).alias("magnitude"))


@query()
def evaluate_pairs(spark, sf_dir):
    """The core pipeline on pages against a rewritten revision of themselves."""
    return _page_changes(spark, sf_dir).select("pair_id", "seq", "change_type", "category", "location", "before", "after", "magnitude", "is_noise", "noise_reason", "relevance_score", "severity", "classifier_confidence")


def _page_changes(spark, sf_dir) -> DataFrame:
    pages = _pages(spark, sf_dir).select(F.col("page_id").alias("pair_id"), F.col("html").alias("before_html"))
    new = F.regexp_replace(F.regexp_replace("before_html", "<h1>[^<]*", "<h1>Introducing AI-powered analytics, now available"), "</article>", '<p class="price">Pro plan now \\$79 per user</p></article>')
    return evaluate.evaluate_pairs(pages.withColumn("after_html", F.regexp_replace(new, "&copy;", "&copy; 2026")))


@query()
def page_funnels(spark, sf_dir):
    return evaluate.page_funnel(_page_changes(spark, sf_dir), ["pair_id"])


# ---------------------------------------------------------------- noise

_SQL_FACTS = f"""
    f0 AS (SELECT *, {sql_canon('before')} AS cb, {sql_canon('after')} AS ca, before || ' ' || after AS blob, {sql_collapse('before')} AS wb, {sql_collapse('after')} AS wa FROM chg),
    f1 AS (SELECT *, {sql_has('wox', P.PRICE_TOKEN)} AS price FROM f0),
    facts AS (SELECT *, price OR {sql_has('wox', P.LAUNCH_WORDS)} OR {sql_has('wox', P.HIRING_WORDS)} OR (cb <> ca AND ({sql_has('wox', P.INTEGRATION_WORDS)}
        OR ({sql_has('wob', P.NOISE_PLAN_LIMIT)} AND {sql_has('woa', P.NOISE_PLAN_LIMIT)}))) AS strong, {sql_fold('blob')} AS low FROM f1)"""


def _sql_prices(x: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({x}, {q('(?i)' + P.PRICE_TOKEN)}), lambda v: {sql_fold('regexp_replace(v, ' + q('[\\s,]') + ', ' + q('') + ', ' + q('g') + ')')})))"


def _sql_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def _sql_counted(x: str) -> str:
    return sql_canon(f"regexp_replace({x}, {q(P.COUNTER_PHRASE)}, '<COUNT>', 'gi')")


_SQL_REASON = f"""CASE
    WHEN cb = ca THEN 'canonically identical (whitespace/dynamic tokens only)'
    WHEN wb = '' AND wa = '' THEN 'empty change'
    WHEN greatest(length(wb), length(wa)) < 12 AND NOT strong THEN 'content too short to be meaningful (<12 chars)'
    WHEN {sql_has('wob', P.COUNTER_PHRASE)} AND {sql_has('woa', P.COUNTER_PHRASE)} AND {_sql_counted('before')} = {_sql_counted('after')} THEN 'live counter / social-proof number churn'
    WHEN wb <> '' AND wa <> '' AND regexp_matches(wb, {q(P.NUMBER_ONLY)}) AND regexp_matches(wa, {q(P.NUMBER_ONLY)}) AND NOT price THEN 'numeric-only churn with no surrounding context'
    WHEN location IN ('navigation', 'footer', 'cookie_banner', 'advertisement', 'sidebar') AND NOT strong THEN 'boilerplate page region (' || location || ')'
    WHEN NOT strong AND {_sql_any('low', P.CHROME_PHRASES)} THEN 'generic site chrome / legal copy'
    WHEN NOT strong AND ({_sql_any('low', P.SOCIAL_VERBS)} OR ({_sql_any('low', P.SOCIAL_PLATFORMS)} AND length(low) < 60)) THEN 'social/sharing widget'
    WHEN price AND {_sql_prices('wob')} = {_sql_prices('woa')} AND magnitude < 0.45 THEN 'pricing block reworded but amounts unchanged'
    WHEN magnitude < 0.12 AND NOT strong THEN 'magnitude below threshold (' || format('{{:.2f}}', magnitude) || ' < 0.12)' END"""
NOISE = f"{CHANGE_ROWS}, {_SQL_FACTS}, nz AS (SELECT *, {_SQL_REASON} AS noise_reason FROM facts)"


@change_query(f"WITH {NOISE} SELECT doc_id, seq, noise_reason, noise_reason IS NOT NULL AS is_noise FROM nz")
def noise_reason(rows):
    return noise.filter_noise(rows).select("doc_id", "seq", "noise_reason", "is_noise")


@change_query(f"WITH {NOISE} SELECT noise_reason, count(*) AS n FROM nz WHERE noise_reason IS NOT NULL GROUP BY 1")
def noise_breakdown(rows):
    return noise.noise_breakdown(noise.filter_noise(rows), "doc_id")


@change_query(f"WITH {NOISE} SELECT count(*) AS raw, count(noise_reason) AS noise, count(*) - count(noise_reason) AS meaningful, round(count(noise_reason) * 100.0 / count(*), 2) AS noise_reduction FROM nz")
def noise_funnel(rows):
    rows = noise.filter_noise(rows).agg(F.count(F.lit(1)).alias("raw"), F.count_if("is_noise").alias("noise"), F.count_if(~F.col("is_noise")).alias("meaningful"))
    return rows.withColumn("noise_reduction", analytics.noise_reduction(F.col("noise"), F.col("raw")))


@change_query(f"WITH {CHANGE_ROWS} SELECT doc_id, seq, array_to_string({_sql_prices('woa')}, '|') AS prices FROM chg")
def price_tokens(rows):
    return rows.select("doc_id", "seq", F.array_join(noise.price_tokens(F.col("after")), "|").alias("prices"))


# ---------------------------------------------------------------- classes


def _sql_amounts(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {q('(?i)' + P.PRICE)}), lambda v: CAST(replace(regexp_extract(v, {q(P.AMOUNT)}), ',', '') AS DOUBLE))"


def _sql_limits(x: str) -> str:
    p = q("(?i)" + P.PLAN_LIMIT)
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({x}, {p}), lambda v: lower(regexp_extract(v, {p}, 2)) || '=' || lower(regexp_extract(v, {p}, 1)))))"


def _sql_partners(x: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({x}, {q('(?i)' + P.PARTNER)}), lambda v: lower(v)))"


def _b(condition: str, value: float) -> str:
    return f"CASE WHEN {condition} THEN {value!r}::DOUBLE ELSE 0.0::DOUBLE END"


_C = lambda pattern, x="wox": sql_has(x, pattern)
_SQL_CLASS = f"""
    c0 AS (SELECT *, {_sql_amounts('wob')} AS pb, {_sql_amounts('woa')} AS pa, {sql_count('woa', P.ML_ROLE)} AS ml, {sql_count('woa', P.GENERIC_ROLE)} AS gr, {sql_count('woa', P.FEATURE)} AS la,
        {_sql_limits('wob')} AS lb, {_sql_limits('woa')} AS lim, {_sql_partners('woa')} AS na, {_sql_partners('wob')} AS nb FROM chg),
    c1 AS (SELECT *, len(pb) > 0 AS hb, len(pa) > 0 AS ha, len(pb) > 0 AND len(pa) > 0 AND abs(pb[1] - pa[1]) > 1e-9 AS moved, ({_C(P.FREE_WORD, 'wob')} <> {_C(P.FREE_WORD, 'woa')}) AND (len(pb) > 0 OR len(pa) > 0) AS free,
        {_C(P.HIRING_CONTEXT)} AS hc, len(list_intersect(list_transform(lb, lambda v: string_split(v, '=')[1]), list_transform(lim, lambda v: string_split(v, '=')[1]))) > 0 AND lb <> lim AS lm, {_C(P.AI_MENTION)} AS ai,
        len(list_filter(na, lambda v: NOT list_contains(nb, v))) AS np, {_C(P.POSITIONING)} AS po FROM c0),
    c2 AS (SELECT *,
        least({_b('hb OR ha', 0.35)} + CASE WHEN moved THEN 0.45::DOUBLE WHEN hb AND NOT ha THEN 0.2::DOUBLE WHEN ha AND NOT hb THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + {_b(_C(P.BILLING_PERIOD), 0.12)} + {_b(_C(P.PLAN_NAME), 0.1)} + {_b('free', 0.3)} + {_b("location = 'pricing'", 0.15)}, 1.0::DOUBLE) AS s1,
        greatest(0.0::DOUBLE, least({_b("location = 'careers'", 0.3)} + {_b('hc', 0.25)} + {_b('ml > 0', 0.4)} + {_b('gr > 0', 0.2)} - {_b("(ml > 0 OR gr > 0) AND NOT (location = 'careers' OR hc)", 0.2)}, 1.0::DOUBLE)) AS s2,
        least(CASE WHEN la > 0 THEN least(0.38::DOUBLE + 0.10::DOUBLE * (la - 1), 0.60::DOUBLE) ELSE 0.0::DOUBLE END + {_b(_C(P.FEATURE_LIST), 0.15)} + {_b('lm', 0.40)} + {_b("change_type = 'added' AND la > 0", 0.12)} + {_b('ai', 0.15)}, 1.0::DOUBLE) AS s3,
        least({_b(_C(P.INTEGRATION), 0.35)} + {_b('np > 0', 0.35)} + {_b("location = 'integrations'", 0.2)}, 1.0::DOUBLE) AS s4,
        least({_b(_C(P.PRODUCT), 0.3)} + {_b("location IN ('product', 'main', 'header')", 0.15)} + {_b("change_type IN ('added', 'headline_change')", 0.1)} + {_b(_C(P.PRODUCT_LAUNCH), 0.25)}, 1.0::DOUBLE) AS s5,
        least({_b('po', 0.35)} + {_b("change_type = 'headline_change'", 0.3)} + {_b("location IN ('header', 'main') AND magnitude > 0.5", 0.2)}, 1.0::DOUBLE) AS s6 FROM c1),
    c3 AS (SELECT *, list_sort([s1, s2, s3, s4, s5, s6], 'DESC') AS ss, list_position([s1, s2, s3, s4, s5, s6], greatest(s1, s2, s3, s4, s5, s6)) AS best FROM c2),
    cls AS (SELECT *, ss[1] AS score, ss[1] - ss[2] AS margin, CASE WHEN ss[1] < 0.35 THEN 'other' ELSE ['pricing', 'hiring', 'features', 'integrations', 'product', 'messaging'][best] END AS category,
        CASE WHEN ss[1] < 0.35 THEN change_type ELSE ['price_change', 'hiring_signal', 'feature_change', 'integration_change', 'product_change', 'headline_change'][best] END AS new_type,
        CASE WHEN ss[1] < 0.35 THEN {sql_round('(0.3::DOUBLE + ss[1] * 0.4::DOUBLE)', 3)} ELSE {sql_round('least(0.97::DOUBLE, 0.45::DOUBLE + ss[1] * 0.45::DOUBLE + least(0.15::DOUBLE, (ss[1] - ss[2]) * 0.3::DOUBLE))', 3)} END AS confidence FROM c3)"""
CLASSES = f"{CHANGE_ROWS}, {_SQL_CLASS}"


@change_query(f"WITH {CLASSES} SELECT doc_id, seq, round(s1, 6) AS pricing, round(s2, 6) AS hiring, round(s3, 6) AS features, round(s4, 6) AS integrations, round(s5, 6) AS product, round(s6, 6) AS messaging FROM cls")
def detector_scores(rows):
    rows = classify.scores(rows)
    return rows.select("doc_id", "seq", *(F.round(f"scores.{c}", 6).alias(c) for c, _ in classify.DETECTORS))


@change_query(f"WITH {CLASSES} SELECT doc_id, seq, category, new_type AS change_type, confidence, {sql_round('score', 4)} AS detector_score, {sql_round('margin', 4)} AS detector_margin FROM cls")
def classify_changes(rows):
    rows = classify.classify(rows)
    signal = lambda name: F.try_element_at("signals", F.lit(name)).alias(name)
    return rows.select("doc_id", "seq", "category", "change_type", F.col("classifier_confidence").alias("confidence"), signal("detector_score"), signal("detector_margin"))


@change_query(f"WITH {CLASSES} SELECT doc_id, seq, array_to_string(lim, '|') AS limits FROM cls")
def plan_limits(rows):
    limits = F.transform(classify.plan_limits(F.col("after")), lambda x: F.concat(x["unit"], F.lit("="), x["value"]))
    return rows.select("doc_id", "seq", F.array_join(F.array_sort(limits), "|").alias("limits"))


@change_query(f"WITH {CLASSES} SELECT doc_id, seq, array_to_string(list_sort(list_filter(na, lambda v: NOT list_contains(nb, v))), '|') AS partners FROM cls")
def partners_new(rows):
    fresh = F.array_sort(F.array_except(classify.partners(F.col("after")), classify.partners(F.col("before"))))
    return rows.select("doc_id", "seq", F.array_join(fresh, "|").alias("partners"))


@change_query(f"WITH {CLASSES} SELECT doc_id, seq, array_to_string(list_transform(pa, lambda v: printf('%.2f', v)), '|') AS prices FROM cls")
def price_amounts(rows):
    amounts = F.transform(classify.prices(F.col("after")), lambda x: F.format_string("%.2f", x))
    return rows.select("doc_id", "seq", F.array_join(amounts, "|").alias("prices"))


# ---------------------------------------------------------------- relevance


def _sql_lookup(values: dict[str, float], x: str, default: float) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN {q(k)} THEN {v!r}::DOUBLE" for k, v in values.items()) + f" ELSE {default!r}::DOUBLE END"


def _sql_raise(base: str, condition: str, step: str) -> str:
    return f"CASE WHEN {condition} THEN least(1.0::DOUBLE, ({base}) + {step}) ELSE ({base}) END"


def _chain(base: str, *steps: tuple[str, str]) -> str:
    for condition, step in steps:
        base = _sql_raise(base, condition, step)
    return base


_ON = lambda n: f"category <> 'other' AND best = {n}" if n else "TRUE"
_SQL_SCORE = f"""
    g0 AS (SELECT *, CASE WHEN best = 1 AND moved THEN {sql_round('least(abs(pa[1] - pb[1]) / greatest(pb[1], 1e-9::DOUBLE), 5.0::DOUBLE)', 4)} ELSE 0.0::DOUBLE END AS delta, best = 1 AND free AS sfree, CASE WHEN best = 2 THEN ml ELSE 0 END AS sml,
        CASE WHEN best = 4 THEN np ELSE 0 END AS snp, best = 1 AND (hb OR ha) AND moved AS sdir, best = 3 AND {_C(P.FEATURE_LIST)} AS squant, best = 3 AND ai AS sai, best = 6 AND (po OR change_type = 'headline_change') AS spos,
        CASE WHEN best = 3 THEN la ELSE 0 END AS sla FROM cls),
    g1 AS (SELECT *,
        {_chain(_sql_lookup(relevance.BUSINESS, 'category', 0.2), ('delta > 0', 'least(0.35::DOUBLE, delta * 0.7)'), ('sfree', '0.15::DOUBLE'), ('sml >= 2', '0.15::DOUBLE'), ('snp >= 1', '0.1::DOUBLE'))} AS bus,
        {_chain(_sql_lookup(relevance.CUSTOMER, 'category', 0.15), ('sdir', '0.1::DOUBLE'), ('squant', '0.1::DOUBLE'))} AS cu0,
        {_chain(_sql_lookup(relevance.STRATEGIC, 'category', 0.2), ('sai', '0.15::DOUBLE'), ('sml > 0', '0.12::DOUBLE'), ('spos', '0.08::DOUBLE'), ('sla >= 2', '0.08::DOUBLE'))} AS str,
        {_sql_lookup(relevance.LOCATION, 'location', 1.0)} AS mul FROM g0),
    g2 AS (SELECT *, CASE WHEN location IN ('navigation', 'footer', 'cookie_banner') THEN cu0 * 0.5 ELSE cu0 END AS cus FROM g1),
    g3 AS (SELECT *, greatest(0.0, least(1.0, 0.30::DOUBLE * bus + 0.20::DOUBLE * cus + 0.20::DOUBLE * str + 0.15::DOUBLE * magnitude + 0.15::DOUBLE * confidence)) * 100.0 AS base FROM g2),
    scored AS (SELECT *, greatest(0.0, least(100.0, CASE WHEN mul > 1.0 THEN base + (100.0 - base) * least(mul - 1.0, 1.0) ELSE base * mul END)) AS raw FROM g3)"""


@change_query(f"WITH {CLASSES}, {_SQL_SCORE} SELECT doc_id, seq, category, {sql_round('raw', 2)} AS relevance_score, {sql_severity('raw')} AS severity FROM scored")
def relevance_score(rows):
    rows = relevance.score_changes(classify.classify(rows).withColumn("is_noise", F.lit(False)))
    return rows.select("doc_id", "seq", "category", "relevance_score", "severity")


@query(f"SELECT event_id, {sql_severity('least(value, 100.0)')} AS severity, least(value, 100.0) >= 70 AS high FROM events")
def severity_band(spark, sf_dir):
    s = F.least("value", F.lit(100.0))
    return _read(spark, sf_dir, "events").select("event_id", relevance.severity(s).alias("severity"), relevance.is_high_impact(s).alias("high"))


@query("SELECT event_id, round(CASE WHEN m IS NULL THEN d ELSE greatest(0.0, least(100.0, d + greatest(-12.0, least(12.0, m - d)))) END, 2) AS blended FROM (SELECT event_id, least(value, 100.0) AS d, CASE WHEN event_id % 5 > 0 THEN CAST(event_id % 101 AS DOUBLE) END AS m FROM events)")
def blend_score(spark, sf_dir):
    model = F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 101).cast("double"))
    return _read(spark, sf_dir, "events").select("event_id", relevance.blend(F.least("value", F.lit(100.0)), model).alias("blended"))


# ---------------------------------------------------------------- narration


@query(
    f"""WITH {CHANGE_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY competitor_id ORDER BY relevance_score DESC, id) AS rk FROM changes WHERE NOT is_noise)
    SELECT id, CASE WHEN relevance_score < 40 THEN 'skipped' WHEN rk > 8 THEN 'budget' ELSE 'ok' END AS llm_status FROM r UNION ALL SELECT id, 'skipped' FROM changes WHERE is_noise"""
)
def candidate_gate(spark, sf_dir):
    return narrate.budgeted(change_log(spark, sf_dir), ["competitor_id"], 8, order="id").select("id", "llm_status")


@query(
    f"""WITH {CHANGE_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY competitor_id ORDER BY relevance_score DESC, id) AS rk FROM changes WHERE NOT is_noise),
    s AS (SELECT competitor_id, CASE WHEN relevance_score < 40 THEN 4 WHEN rk > 8 THEN 2 ELSE 3 END AS o FROM r UNION ALL SELECT competitor_id, 4 FROM changes WHERE is_noise)
    SELECT competitor_id, ['rate_limited', 'failed', 'budget', 'ok', 'skipped'][1 + min(o)] AS llm_status FROM s GROUP BY 1"""
)
def worst_status(spark, sf_dir):
    return narrate.worst_status(narrate.budgeted(change_log(spark, sf_dir), ["competitor_id"], 8, order="id"), ["competitor_id"])


@change_query(
    f"""WITH {CHANGE_ROWS}, g AS (SELECT doc_id, seq, {sql_fold("trim(CASE seq % 3 WHEN 0 THEN upper(left(after, 20)) WHEN 1 THEN after || ' and more' ELSE 'something else entirely' END)")} AS a, {sql_fold('trim(before)')} AS b FROM chg)
    SELECT doc_id, seq, a = '' OR contains(b, a) OR (b <> '' AND contains(a, b)) AS grounded FROM g"""
)
def grounding_check(rows):
    claimed = F.when(F.col("seq") % 3 == 0, F.upper(F.left("after", F.lit(20)))).when(F.col("seq") % 3 == 1, F.concat("after", F.lit(" and more"))).otherwise("something else entirely")
    return rows.select("doc_id", "seq", narrate.grounded(claimed, F.col("before")).alias("grounded"))


_SCORES = ("91%", "high", "0.85", "critical", "about 40 points", "none", "140", "-5", "1", " Low ", "62.5")


@query(
    f"""WITH t AS (SELECT event_id, {_list(_SCORES)}[1 + event_id % {len(_SCORES)}] AS v FROM events), u AS (SELECT event_id, regexp_replace(trim(v), '%+$', '') AS v, v AS w FROM t),
    n AS (SELECT *, TRY_CAST(nullif(regexp_extract(v, '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE) AS x FROM u)
    SELECT event_id, CASE lower(v) WHEN 'noise' THEN 15.0 WHEN 'low' THEN 40.0 WHEN 'medium' THEN 60.0 WHEN 'high' THEN 78.0 WHEN 'critical' THEN 92.0
        ELSE CASE WHEN x IS NULL THEN 50.0 ELSE greatest(0.0, least(100.0, CASE WHEN x > 0 AND x <= 1 THEN x * 100 ELSE x END)) END END AS score,
        CASE WHEN x IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, CASE WHEN x > 1 THEN x / 100 ELSE x END)) END AS confidence FROM n"""
)
def score_coercion(spark, sf_dir):
    raw = F.get(F.array(*map(F.lit, _SCORES)), (F.col("event_id") % len(_SCORES)).cast("int"))
    return _read(spark, sf_dir, "events").select("event_id", payloads.coerce_score(raw).alias("score"), payloads.coerce_confidence(raw).alias("confidence"))


_NAMES = ("Pricing", "jobs", " partnership ", "launch", "unknown", "copy", "hiring", "")


@query(
    f"SELECT event_id, CASE WHEN t IN ({', '.join(map(q, ('pricing', 'features', 'product', 'hiring', 'integrations', 'messaging', 'other')))}) THEN t "
    + " ".join(f"WHEN t = {q(a)} THEN {q(c)}" for a, c in P.CATEGORY_ALIASES.items())
    + f" ELSE 'other' END AS category FROM (SELECT event_id, lower(trim({_list(_NAMES)}[1 + event_id % {len(_NAMES)}])) AS t FROM events)"
)
def category_coercion(spark, sf_dir):
    raw = F.get(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % len(_NAMES)).cast("int"))
    return _read(spark, sf_dir, "events").select("event_id", payloads.coerce_category(raw).alias("category"))


@query("SELECT event_id, json_extract_string(props, '$.' || (json_keys(props))[1]) AS first_value FROM events")
def payload_fields(spark, sf_dir):
    """First field of each JSON payload, through extraction and repair."""
    rows = _read(spark, sf_dir, "events").select("event_id", F.from_json(payloads.extract_json(F.concat(F.lit("Here you are: ```json "), "props", F.lit(" ```"))), "map<string,string>").alias("m"))
    return rows.select("event_id", F.get(F.map_values("m"), F.lit(0)).alias("first_value"))


@change_query(None)
def narration(rows):
    # Noise is no candidate, so it is neither classified nor scored.
    rows = relevance.score_changes(classify.classify_survivors(noise.meaningful_only(noise.filter_noise(rows))))
    told = narrate.narrate(narrate.candidates(rows).withColumn("subject", F.concat(F.lit("C"), F.col("doc_id").cast("string"))))
    return told.select("doc_id", "seq", "title", "summary", "business_impact", "recommended_action")


@change_query(
    f"""WITH {CLASSES}, {_SQL_SCORE}, c AS (SELECT *, 'C' || doc_id AS n FROM scored) SELECT doc_id, seq, CASE
        WHEN category = 'pricing' AND moved AND pa[1] > pb[1] THEN n || ' increased pricing' WHEN category = 'pricing' AND moved THEN n || ' reduced pricing' WHEN category = 'pricing' AND free THEN n || ' changed its free-tier positioning'
        WHEN category = 'pricing' THEN n || ' updated pricing' WHEN category = 'hiring' AND ml > 0 THEN n || ' opened ' || ml || ' AI/ML role' || CASE WHEN ml = 1 THEN '' ELSE 's' END
        WHEN category = 'hiring' AND gr > 0 THEN n || ' opened ' || gr || ' engineering role' || CASE WHEN gr = 1 THEN '' ELSE 's' END WHEN category = 'hiring' THEN n || ' updated its careers page'
        WHEN category = 'features' AND lm THEN n || ' changed plan entitlements' WHEN category = 'features' AND ai THEN n || ' added AI capability messaging' WHEN category = 'features' THEN n || ' announced a feature change'
        WHEN category = 'integrations' AND np > 0 THEN n || ' added ' || np || ' new integration' || CASE WHEN np = 1 THEN '' ELSE 's' END WHEN category = 'integrations' THEN n || ' updated its integrations'
        WHEN category = 'product' THEN n || ' made a product-level change' ELSE n || ' rewrote key positioning copy' END AS title FROM c WHERE category <> 'other'"""
)
def narration_title(rows):
    rows = classify.classify(rows).filter(F.col("category") != "other")
    return rows.select("doc_id", "seq", narrate.title(F.concat(F.lit("C"), F.col("doc_id").cast("string"))).alias("title"))


# ---------------------------------------------------------------- analytics

_WEEK = f"TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"


@query(
    f"""WITH {CHANGE_LOG} SELECT count(*) AS total_changes, count(*) FILTER (is_noise) AS noise_changes, count(*) FILTER (relevance_score >= 70) AS high_impact_total,
    count(*) FILTER (NOT is_noise AND detected_at >= {_WEEK}) AS changes_this_week, count(*) FILTER (NOT is_noise AND detected_at >= {_WEEK} AND relevance_score >= 70) AS high_impact_this_week,
    round(count(*) FILTER (is_noise) * 100.0::DOUBLE / count(*), 2) AS noise_reduction FROM changes"""
)
def dashboard_stats(spark, sf_dir):
    return analytics.dashboard_stats(change_log(spark, sf_dir), AS_OF)


@query(f"WITH {CHANGE_LOG} SELECT category, count(*) AS n FROM changes WHERE NOT is_noise AND detected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY GROUP BY 1")
def category_dist(spark, sf_dir):
    return analytics.category_distribution(change_log(spark, sf_dir), AS_OF, 10)


@query(f"WITH {CHANGE_LOG} SELECT severity, count(*) AS n FROM changes WHERE NOT is_noise GROUP BY 1")
def severity_dist(spark, sf_dir):
    return analytics.severity_distribution(change_log(spark, sf_dir))


@query(f"WITH {CHANGE_LOG} SELECT severity, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100.0, 2) AS share FROM changes WHERE NOT is_noise GROUP BY 1")
def severity_share(spark, sf_dir):
    return analytics.share_of_total(analytics.severity_distribution(change_log(spark, sf_dir)))


@query(f"WITH {CHANGE_LOG} SELECT CAST(CAST(detected_at AS DATE) AS VARCHAR) AS day, count(*) AS total, count(*) FILTER (NOT is_noise) AS meaningful, count(*) FILTER (NOT is_noise AND relevance_score >= 70) AS high_impact FROM changes GROUP BY 1")
def timeline(spark, sf_dir):
    return analytics.activity_timeline(change_log(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {CHANGE_LOG} SELECT strftime(detected_at, '%Y-%m-%d') AS heading, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM changes GROUP BY 1")
def day_headings(spark, sf_dir):
    return analytics.by_day_heading(change_log(spark, sf_dir))


@query(f"WITH {CHANGE_LOG} SELECT noise_reason, count(*) AS n FROM changes WHERE is_noise AND noise_reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 12")
def noise_topk(spark, sf_dir):
    return analytics.noise_reason_breakdown(change_log(spark, sf_dir))


@query(
    f"""WITH {CHANGE_LOG} SELECT p.id AS competitor_id, p.name, count(c.id) AS changes, coalesce(sum(CAST(c.relevance_score >= 70 AS INTEGER)), 0)::BIGINT AS high_impact
    FROM competitors p LEFT JOIN changes c ON c.competitor_id = p.id WHERE c.id IS NULL OR NOT c.is_noise GROUP BY 1, 2 ORDER BY changes DESC, competitor_id LIMIT 5"""
)
def top_competitors(spark, sf_dir):
    return analytics.top_competitors(competitors(spark, sf_dir), change_log(spark, sf_dir))


@query(
    f"""WITH {CHANGE_LOG} SELECT i.id, i.competitor_id, p.name AS competitor, i.category, i.relevance_score, c.change_type, coalesce(nullif(i.source_url, ''), c.source_url, '') AS source_url, i.created_at
    FROM intelligence i JOIN changes c ON c.id = i.change_id JOIN competitors p ON p.id = i.competitor_id WHERE i.relevance_score >= 60 ORDER BY i.created_at DESC, i.relevance_score DESC, i.id DESC LIMIT 20"""
)
def recent_intel(spark, sf_dir):
    rows = analytics.recent_intelligence(intelligence(spark, sf_dir), competitors(spark, sf_dir), change_log(spark, sf_dir), least=60.0)
    return rows.select("id", "competitor_id", "competitor", "category", "relevance_score", "change_type", "source_url", "created_at")


@query(f"WITH {CHANGE_LOG} SELECT max_by(llm_status, (created_at, id)) AS llm_status FROM intelligence")
def last_llm_status(spark, sf_dir):
    return analytics.last_status(intelligence(spark, sf_dir))


@query(
    f"""WITH {CHANGE_LOG} SELECT c.id, p.name AS competitor, c.severity, c.relevance_score, c.detected_at FROM changes c JOIN competitors p ON p.id = c.competitor_id
    WHERE NOT is_noise AND severity = 'high' AND relevance_score >= 72 ORDER BY c.detected_at DESC, c.relevance_score DESC, c.id DESC LIMIT 50 OFFSET 10"""
)
def list_changes(spark, sf_dir):
    rows = analytics.list_changes(change_log(spark, sf_dir), competitors(spark, sf_dir), severity="high", least=72.0, offset=10)
    return rows.select("id", "competitor", "severity", "relevance_score", "detected_at")


@query(
    f"""WITH {CHANGE_LOG}, a AS (SELECT competitor_id, count(*) AS raw_changes, count(*) FILTER (is_noise) AS noise_changes, count(*) FILTER (NOT is_noise) AS meaningful_changes,
        count(*) FILTER (NOT is_noise AND relevance_score >= 70) AS high_impact_changes, max(detected_at) FILTER (NOT is_noise) AS last_change FROM changes GROUP BY 1),
    u AS (SELECT s_suppkey % 100 AS competitor_id, count(*) AS urls, count(*) FILTER (s_acctbal > 0) AS active_urls FROM supplier GROUP BY 1), r AS (SELECT o_custkey AS competitor_id, max(o_orderdate) AS last_scan FROM orders GROUP BY 1)
    SELECT p.id, p.name, coalesce(urls, 0) AS urls, coalesce(active_urls, 0) AS active_urls, coalesce(raw_changes, 0) AS raw_changes, coalesce(noise_changes, 0) AS noise_changes, coalesce(meaningful_changes, 0) AS meaningful_changes,
        coalesce(high_impact_changes, 0) AS high_impact_changes, last_change, last_scan FROM competitors p LEFT JOIN u ON u.competitor_id = p.id LEFT JOIN a ON a.competitor_id = p.id LEFT JOIN r ON r.competitor_id = p.id"""
)
def competitor_rollup(spark, sf_dir):
    urls_ = _read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 100).alias("competitor_id"), (F.col("s_acctbal") > 0).alias("active"))
    runs = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("competitor_id"), F.col("o_orderdate").alias("finished_at"))
    return analytics.competitor_summary(competitors(spark, sf_dir).select("id", "name"), urls_, change_log(spark, sf_dir), runs)


_FUNNEL_SQL = "count(*) AS raw_changes, count(*) FILTER (is_noise) AS noise_changes, count(*) FILTER (NOT is_noise) AS meaningful_changes, count(*) FILTER (NOT is_noise AND relevance_score >= 70) AS high_impact_changes, round(count(*) FILTER (is_noise) * 100.0::DOUBLE / count(*), 2) AS noise_reduction"


@query(f"WITH {CHANGE_LOG} SELECT {_FUNNEL_SQL} FROM changes WHERE detected_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'")
def period_stats(spark, sf_dir):
    return analytics.period_stats(change_log(spark, sf_dir), START, END)


@query(f"WITH {CHANGE_LOG} SELECT {_FUNNEL_SQL} FROM changes WHERE competitor_id = 7")
def detail_funnel(spark, sf_dir):
    return analytics.detail_funnel(change_log(spark, sf_dir), 7)


@query(
    f"""WITH {CHANGE_LOG} SELECT i.id, p.name AS competitor, i.relevance_score, i.created_at FROM intelligence i JOIN competitors p ON p.id = i.competitor_id
    WHERE i.created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' ORDER BY i.relevance_score DESC, i.created_at DESC, i.id DESC LIMIT 8"""
)
def highlights(spark, sf_dir):
    return analytics.highlights(intelligence(spark, sf_dir), competitors(spark, sf_dir), START, END).select("id", "competitor", "relevance_score", "created_at")


@query(
    f"""WITH {CHANGE_LOG}, h AS (SELECT i.category FROM intelligence i JOIN competitors p ON p.id = i.competitor_id WHERE i.created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' ORDER BY i.relevance_score DESC, i.created_at DESC, i.id DESC LIMIT 8)
    SELECT CASE WHEN count(*) = 0 THEN 'No significant changes in this period' ELSE count(*) || CASE WHEN count(*) = 1 THEN ' notable change' ELSE ' notable changes' END || ' across ' || array_to_string(list_sort(list(DISTINCT category)), ', ') END AS headline FROM h"""
)
def digest_headline(spark, sf_dir):
    return digest.narrative(analytics.highlights(intelligence(spark, sf_dir), competitors(spark, sf_dir), START, END)).select("headline")


@query()
def digest_row(spark, sf_dir):
    return digest.generate(intelligence(spark, sf_dir), competitors(spark, sf_dir), change_log(spark, sf_dir), START, END)


@query(f"WITH {CHANGE_LOG} SELECT id, name, tracking_frequency FROM competitors WHERE active AND tracking_frequency <> 'manual'")
def due_competitors(spark, sf_dir):
    return analytics.due_competitors(competitors(spark, sf_dir)).select("id", "name", "tracking_frequency")


@query(
    f"""WITH {CHANGE_LOG}, l AS (SELECT competitor_id, max(detected_at) AS last FROM changes GROUP BY 1) SELECT p.id FROM competitors p LEFT JOIN l ON l.competitor_id = p.id
    WHERE active AND tracking_frequency <> 'manual' AND (last IS NULL OR last + to_minutes(CASE tracking_frequency WHEN 'hourly' THEN 60 WHEN 'daily' THEN 1440 ELSE 10080 END) <= TIMESTAMP '{AS_OF}')"""
)
def due_by_frequency(spark, sf_dir):
    runs = change_log(spark, sf_dir).select("competitor_id", F.col("detected_at").alias("finished_at"))
    return analytics.due_by_frequency(competitors(spark, sf_dir), runs, AS_OF).select("id")


@query(f"WITH {CHANGE_LOG} SELECT coalesce((SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'none'), (SELECT max(ts) FROM events)) AS last_scan")
def last_scan(spark, sf_dir):
    runs = _read(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "none").select(F.col("o_orderdate").alias("finished_at"))
    return analytics.last_scan(runs, capture_log(spark, sf_dir))


@query(f"WITH {CHANGE_LOG} SELECT (SELECT count(*) FROM competitors) AS competitors, (SELECT count(*) FROM competitors WHERE active) AS active_competitors, (SELECT count(*) FROM supplier) AS tracked_urls, (SELECT count(*) FROM events) AS snapshots")
def entity_counts(spark, sf_dir):
    return analytics.entity_counts(competitors(spark, sf_dir), _read(spark, sf_dir, "supplier"), capture_log(spark, sf_dir))


@query("SELECT event_id AS id, created_at FROM (SELECT event_id, ts AS created_at FROM events) ORDER BY created_at DESC, event_id DESC LIMIT 5")
def newest_digests(spark, sf_dir):
    return analytics.newest(_read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at")), limit=5)


@query("WITH w AS (SELECT c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS id, ' ' || upper(c_name) AS name FROM customer) SELECT w.id, w.name FROM w WHERE EXISTS (SELECT 1 FROM customer c WHERE lower(c.c_name) = lower(trim(w.name)) AND c.c_custkey <> w.id)")
def name_conflicts(spark, sf_dir):
    base = competitors(spark, sf_dir)
    wanted = base.select((F.col("id") + F.when(F.col("id") % 2 == 0, 1).otherwise(0)).alias("id"), F.concat(F.lit(" "), F.upper("name")).alias("name"))
    return analytics.name_conflicts(base, wanted)


@query(f"WITH {CHANGE_LOG}, l AS (SELECT competitor_id, category, max_by(id, id) AS analysis_id FROM intelligence GROUP BY 1, 2) SELECT c.id, l.analysis_id FROM changes c LEFT JOIN l USING (competitor_id, category)")
def change_analysis_link(spark, sf_dir):
    told = intelligence(spark, sf_dir).select("competitor_id", "category", F.col("id").alias("analysis_id"), F.col("id").alias("seq"))
    return analytics.link_analyses(change_log(spark, sf_dir), told, ["competitor_id", "category"]).select("id", F.col("analysis.analysis_id"))


@query(f"WITH {CHANGE_LOG} SELECT id FROM changes WHERE competitor_id NOT IN (SELECT id FROM competitors WHERE id % 3 = 0)")
def cascading_delete(spark, sf_dir):
    gone = competitors(spark, sf_dir).filter(F.col("id") % 3 == 0)
    return analytics.without_competitor({"changes": change_log(spark, sf_dir)}, gone)["changes"].select("id")


@query(
    f"""WITH s AS (SELECT event_id, CAST(epoch(TIMESTAMP '2024-03-01') - floor(epoch(ts)) AS BIGINT) AS s FROM events)
    SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS told FROM s"""
)
def relative_times(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", analytics.relative_time(F.col("ts"), "2024-03-01").alias("told"))


# ---------------------------------------------------------------- reports

_PAGES_SQL = (
    f"WITH {CHANGE_LOG}, pages_ AS (SELECT competitor_id, {_FUNNEL_SQL}, CASE WHEN competitor_id % 10 = 0 THEN 'failed' WHEN competitor_id % 10 = 1 THEN 'no_snapshots' ELSE 'completed' END AS status FROM changes GROUP BY 1)"
)


def _report_pages(spark, sf_dir) -> DataFrame:
    pages = evaluate.page_funnel(change_log(spark, sf_dir), ["competitor_id"])
    k = F.col("competitor_id") % 10
    return evaluate.page_status(pages.withColumns({"error": F.when(k == 0, "timeout"), "n_captures": F.when(k == 1, 1).otherwise(2)}))


@query(_PAGES_SQL + " SELECT competitor_id, status FROM pages_")
def page_status(spark, sf_dir):
    return _report_pages(spark, sf_dir).select("competitor_id", "status")


@query(
    _PAGES_SQL + " SELECT count(*) AS pages_evaluated, sum(raw_changes)::BIGINT AS raw_changes, sum(noise_changes)::BIGINT AS noise_changes, sum(meaningful_changes)::BIGINT AS meaningful_changes, sum(high_impact_changes)::BIGINT AS high_impact_changes, "
    "round(sum(noise_changes) / sum(raw_changes) * 100.0::DOUBLE, 2) AS noise_reduction FROM pages_ WHERE status = 'completed'"
)
def report_merge(spark, sf_dir):
    return evaluate.merge_report(_report_pages(spark, sf_dir))


_AS_CATEGORY = {"click": "pricing", "purchase": "features", "signup": "hiring", "error": "other", "view": "product"}


@query(
    f"WITH {CHANGE_LOG} SELECT CASE category " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in _AS_CATEGORY.items())
    + " ELSE 'messaging' END AS name, count(*) AS n FROM changes WHERE NOT is_noise AND competitor_id % 10 > 1 GROUP BY 1"
)
def category_merge(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for kv in _AS_CATEGORY.items() for x in kv))
    rows = change_log(spark, sf_dir).withColumn("category", F.coalesce(F.try_element_at(names, F.col("category")), F.lit("messaging")))
    counts = evaluate.category_counts(rows, ["competitor_id"])
    return evaluate.merge_counts(_report_pages(spark, sf_dir).join(counts, "competitor_id"))


@query(f"WITH {CHANGE_LOG} SELECT competitor_id, rank, id FROM (SELECT competitor_id, id, row_number() OVER (PARTITION BY competitor_id ORDER BY relevance_score DESC, id) AS rank FROM changes WHERE NOT is_noise) WHERE rank <= 5")
def top_changes_per_page(spark, sf_dir):
    rows = change_log(spark, sf_dir).withColumns({"seq": F.col("id"), "before": F.col("id").cast("string"), "after": F.lit(""), "evidence": F.array().cast("array<string>")})
    return evaluate.top_changes(rows, ["competitor_id"]).select("competitor_id", "rank", F.col("before").cast("long").alias("id"))


@change_query(None)
def category_counts(rows):
    rows = classify.classify_survivors(noise.filter_noise(rows))
    return evaluate.category_counts(rows, ["doc_id"]).select("doc_id", F.to_json("categories").alias("categories"))
