"""The corpus operators as queries over whole tables, with SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, exact_dedup, filter_audit, language_id, line_dedup, mixing, neighbours, packing, quality_fm, quality_rules, simhash, token_files, url_filter
from ._shared import dealt_table, fresh_path, n_words, staged, table


def _in_fold(modulus: int, fold: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == fold


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_repeated_lines(docs, min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The mix needs sizes only: whole texts are counted once and not shuffled.
    sizes = staged(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("n_words")), "mix-sizes")
    mixed = mixing.mix(sizes, size=F.col("n_words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_taken")).alias("taken"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.cascade(dealt_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality_rules.STATS, "base_failed", "kept")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(dealt_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs, carry=["doc_id"], digests=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(dealt_table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def url_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with a fetch time: they carry none, so one is derived from page_id."""
    at = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    hours = F.pmod(F.col("page_id") * 37, F.lit(8784)).cast("int")
    return table(spark, sf_dir, "pages").select("page_id", "url", (at + F.make_dt_interval(hours=hours)).alias("fetched_at"))


def url_entries(captures: DataFrame) -> DataFrame:
    """A dated block list over the hosts of the captures, derived from hashes of their names."""
    hosts = captures.select(url_filter.host_of(F.col("url")).alias("host"), F.element_at(F.filter(F.split(url_filter.path_of(F.col("url")), "/"), lambda x: x != ""), 1).alias("first")).filter(F.col("host").isNotNull()).distinct()
    rows = hosts.select(
        F.explode(
            F.array(
                F.struct(F.lit("domain").alias("kind"), F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("value")),
                F.struct(F.lit("host").alias("kind"), F.col("host").alias("value")),
                F.struct(F.lit("prefix").alias("kind"), F.concat("host", F.lit("/"), "first").alias("value")),
            )
        ).alias("e")
    ).select("e.kind", "e.value").filter(F.length("value") > 0).distinct()
    code = lambda a, n: F.conv(F.substring(F.md5(F.concat("kind", F.lit(":"), "value")), a, n), 16, 10).cast("int")
    listed = rows.withColumns({"a": code(1, 2), "b": code(3, 2), "c": code(5, 2)}).filter(F.col("a") < 96)
    day = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    plus = lambda days: day + F.make_dt_interval(days=days)
    actions = F.array(
        F.struct(F.lit("add").alias("action"), plus(F.col("b")).alias("at")),
        F.struct(F.lit("add").alias("action"), plus(F.col("b") + 10).alias("at")),
        F.struct(F.lit("remove").alias("action"), plus(F.col("b") + 20 + F.col("c")).alias("at")),
        F.struct(F.lit("add").alias("action"), plus(F.col("b") + 60 + F.col("c")).alias("at")),
    )
    kept = F.when(F.col("c") % 3 == 0, F.slice(actions, 1, 2)).when(F.col("c") % 3 == 1, F.slice(actions, 1, 3)).otherwise(actions)
    return listed.select(F.when(F.col("a") % 2 == 0, "ads").otherwise("spam").alias("list"), "kind", "value", F.explode(kept).alias("x")).select("list", "kind", "value", "x.action", "x.at")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = url_captures(spark, sf_dir)
    return url_filter.filter_urls(captures, url_entries(captures)).select("page_id", "host", "fetched_at", "blocked", "kind", "value", "list", "since")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, ~_in_fold(3, 1))
    rows = dealt_table(spark, sf_dir, "documents").select("doc_id", "text", _in_fold(3, 1).alias("held_out"))
    return language_id.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality_fm.train(docs, table(spark, sf_dir, "labels"), ~_in_fold(5, 0))
    rows = dealt_table(spark, sf_dir, "documents").select("doc_id", "text", _in_fold(5, 0).alias("held_out"))
    return quality_fm.rate(rows, machine).select("doc_id", "held_out", "score", "predicted")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, end_id=0)
    return token_files.digests(spark, path)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(dealt_table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(dealt_table(spark, sf_dir, "documents"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(dealt_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_source_mixing, op3_quality_rules, op4_simhash_dedup, op5_exact_dedup, op6_best_fit_packing,
        op7_url_filters, op8_language_id, op9_quality_classifier, op10_token_files, op11_filter_audit, op12_collocations, op13_nearest_neighbours,
    )
}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL = {
    "op1_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT r, i, ls[i] AS line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
              FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
        bad AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
        j AS (SELECT r, count(*) AS n_lines, count(bad.k) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE bad.k IS NULL) AS kept
              FROM l LEFT JOIN bad ON l.k = bad.k GROUP BY r)
        SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM j JOIN d USING (r)
    """,
    "op2_source_mixing": rf"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
                          CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#mix'), 1, 15) AS BIGINT) AS rk FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
        v AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) AS level
              FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM v) * weight) AS target FROM v),
        q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY rk, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS done
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS (SELECT q.*, e, (e * source_size + done)::DOUBLE / target AS vft FROM q, range(3) AS x(e) WHERE size > 0 AND target > 0 AND e < ceil(target / source_size)),
        m AS (SELECT *, sum(size) OVER (ORDER BY vft, coalesce(source, chr(1114111)), rk, coalesce(doc_id, -1), done ROWS UNBOUNDED PRECEDING) AS total FROM c),
        n AS (SELECT doc_id, source, done, size, count(*) AS n FROM m WHERE total <= (SELECT sum(size) FROM d) GROUP BY ALL)
        SELECT q.doc_id, q.size, source_size, target, coalesce(n.n, 0)::BIGINT * q.size AS taken
        FROM q LEFT JOIN n ON q.doc_id IS NOT DISTINCT FROM n.doc_id AND q.source IS NOT DISTINCT FROM n.source AND q.done = n.done AND q.size = n.size
    """,
    "op3_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
                          list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM documents),
        g AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS w FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) > 4)),
        two AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM g) WHERE n > 1),
        rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM two) GROUP BY r),
        m AS (SELECT doc_id, t, ls, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                     (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
                     length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^a-z]', '', 'g')) AS low,
                     length(regexp_replace(t, '[A-Za-z\x20\x09-\x0D]|[^\x00-\x7F]', '', 'g')) AS other,
                     len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS stutter
              FROM d LEFT JOIN rep USING (r)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR (10 * n_symbols > n_words AND n_symbols >= 5) OR (len(ls) >= 4 AND 10 * n_dup_lines > 4 * len(ls)) OR 10 * stutter > 3 * n_words OR (up + low >= 50 AND up > low)
                    OR (n_words >= 50 AND NOT (2 * n_words <= word_chars AND word_chars <= 15 * n_words)) OR (n_words >= 50 AND 10 * (word_chars - other) < 6 * word_chars)
                    OR (len(ls) >= 10 AND 10 * bullets > 9 * len(ls))) AS kept
        FROM b
    """,
    "op5_exact_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
        w AS (SELECT *, first(doc_id) OVER g AS keep_id, first(r) OVER g AS keep_r, count(*) OVER (PARTITION BY h) AS group_size
              FROM d WINDOW g AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST, r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        SELECT doc_id, keep_id, group_size, r = keep_r AS kept, h AS text_sha256 FROM w
    """,
    "op7_url_filters": r"""
        WITH p AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_hours(CAST((page_id * 37) % 8784 AS INTEGER)) AS fetched_at,
                          nullif(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:\[\]]+)', 1)), '\.$', ''), '') AS host,
                          list_filter(string_split(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS segs FROM pages),
        e AS (SELECT DISTINCT kind, value FROM (
                SELECT 'domain' AS kind, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS value FROM p WHERE host IS NOT NULL
                UNION ALL SELECT 'host', host FROM p WHERE host IS NOT NULL
                UNION ALL SELECT 'prefix', host || '/' || segs[1] FROM p WHERE host IS NOT NULL) WHERE value <> ''),
        c AS (SELECT *, CAST('0x' || substr(md5(kind || ':' || value), 1, 2) AS INTEGER) AS a, CAST('0x' || substr(md5(kind || ':' || value), 3, 2) AS INTEGER) AS b,
                     CAST('0x' || substr(md5(kind || ':' || value), 5, 2) AS INTEGER) AS c FROM e),
        i AS (SELECT CASE WHEN a % 2 = 0 THEN 'ads' ELSE 'spam' END AS list, kind, lower(value) AS value, TIMESTAMP '2024-01-01' + to_days(b) AS since,
                     CASE WHEN c % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_days(b + 20 + c) END AS until FROM c WHERE a < 96
              UNION ALL SELECT CASE WHEN a % 2 = 0 THEN 'ads' ELSE 'spam' END, kind, lower(value), TIMESTAMP '2024-01-01' + to_days(b + 60 + c), NULL FROM c WHERE a < 96 AND c % 3 = 2),
        k AS (SELECT page_id, url, fetched_at, host, 'domain' AS kind, array_to_string(string_split(host, '.')[x:], '.') AS value FROM (SELECT *, unnest(range(1, len(string_split(host, '.')))) AS x FROM p WHERE host IS NOT NULL AND NOT starts_with(host, '['))
              UNION ALL SELECT page_id, url, fetched_at, host, 'host', host FROM p WHERE host IS NOT NULL
              UNION ALL SELECT page_id, url, fetched_at, host, 'prefix', lower(host || '/' || array_to_string(segs[1:x], '/')) FROM (SELECT *, unnest(range(1, len(segs) + 1)) AS x FROM p WHERE host IS NOT NULL)),
        h AS (SELECT k.page_id, k.kind, k.value, i.list, i.since, row_number() OVER (PARTITION BY page_id ORDER BY CASE k.kind WHEN 'prefix' THEN 0 WHEN 'host' THEN 1 ELSE 2 END, length(k.value) DESC, k.value, i.list) AS n
              FROM k JOIN i ON k.kind = i.kind AND k.value = i.value AND i.since <= k.fetched_at AND (i.until IS NULL OR k.fetched_at < i.until))
        SELECT p.page_id, p.host, p.fetched_at, h.page_id IS NOT NULL AS blocked, h.kind, h.value, h.list, h.since FROM p LEFT JOIN h ON p.page_id = h.page_id AND h.n = 1
    """,
    "op11_filter_audit": rf"""
        WITH g AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        d AS (SELECT documents.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
        m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                     CAST(len(ws) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INTEGER) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INTEGER)
                     + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS mask
              FROM d LEFT JOIN g ON d.doc_id = g.doc_id),
        c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
        f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
        o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
        s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0) AS before FROM o, range(1, 6) AS x(k)),
        r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & before = 0 AND mask & bit = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
              FROM c, s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
               good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
    """,
    "op12_collocations": r"""
        WITH p AS (SELECT row_number() OVER () AS p, lang, piece FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
        i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
        t AS (SELECT lang, count(*) AS n FROM i GROUP BY lang),
        g AS (SELECT lang, ws[i:i + d - 1] AS g FROM i, (VALUES (1), (2), (3)) AS x(d) WHERE i + d - 1 <= len(ws)),
        f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY lang, g),
        c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= 10),
        cover AS (SELECT lang, s, max(a) AS a FROM (SELECT lang, unnest([g[1:2], g[2:3]]) AS s, a FROM c WHERE len(g) = 3) GROUP BY lang, s),
        k AS (SELECT c.* FROM c LEFT JOIN cover ON c.lang = cover.lang AND c.g = cover.s WHERE cover.a IS NULL OR 100 * cover.a < 50 * c.a),
        cut AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM k),
        s AS (SELECT cut.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a::HUGEINT * a::HUGEINT // (x.f::HUGEINT * y.f::HUGEINT))::BIGINT AS score
              FROM cut JOIN f x ON cut.lang = x.lang AND x.g = cut.g[1:k] JOIN f y ON cut.lang = y.lang AND y.g = cut.g[k + 1:len(cut.g)]),
        m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score
        FROM m JOIN t USING (lang) QUALIFY rank <= 2000
    """,
}
