"""Crafted tables through the registered queries and stages: repeated, null and text ids, many labels, IPv6 hosts, clashing and dotted columns."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from changelens.llm import _shared, exact_dedup, language_id, mixing, quality_fm, queries, token_files, url_filter

from .test_operators import DE, EN, crc, token_ids


def folder(spark, at, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_op10_starts_follow_the_files(spark, tmp_path):
    r = random.Random(2)
    texts = [" ".join(r.choice(EN.split()) for _ in range(r.randrange(30))) for _ in range(60)]
    rows = [(i % 5 if i % 11 else None, t) for i, t in enumerate(texts)] + [(2, None), (2, ""), (3, texts[0]), (3, texts[0])]
    at = folder(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = sorted(queries.op10_token_files(spark, at).collect(), key=lambda x: x.start)
    assert [x.start for x in got] == [sum(y.n_tokens for y in got[:k]) for k in range(len(got))]
    ids = [-1 if x.doc_id is None else x.doc_id for x in got]
    assert ids == sorted(ids)
    lists = token_ids([t for _, t in rows], 0)
    assert Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in got) == Counter((i, len(x), crc(x)) for (i, _), x in zip(rows, lists, strict=True))
    # The same order as in the files themselves.
    path = str(tmp_path / "files")
    token_files.write_tokens(spark.read.parquet(f"{at}/documents.parquet"), path, rows_per_file=20)
    told, n = sorted(token_files.digests(spark, path).collect(), key=lambda x: x.start), 0
    for x, y in zip(told, spark.read.parquet(path).orderBy("part", "place").collect(), strict=True):
        assert (x.start, x.n_tokens, x.ids_crc32) == (n, len(y.ids), crc(y.ids))
        n += len(y.ids)


def test_ipv6_hosts(spark):
    urls = ["http://[::1]:80/a", "http://user@[2001:DB8::1]/p/q", "http://[::ffff:1.2.3.4]", "http://a.b.com:8080/x", "http://u:p@c.com", "http://[bad/x", "http://[::2]"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string")
    assert [r.h for r in df.select("id", url_filter.host_of(F.col("url")).alias("h")).orderBy("id").collect()] == ["[::1]", "[2001:db8::1]", "[::ffff:1.2.3.4]", "a.b.com", "c.com", None, "[::2]"]
    entries = spark.createDataFrame([("l", "host", "[::1]", "add", "2024-01-01"), ("l", "prefix", "[2001:db8::1]/p", "add", "2024-01-01"), ("l", "domain", "2.3.4]", "add", "2024-01-01")], "list string, kind string, value string, action string, at string").withColumn("at", F.to_timestamp_ntz("at"))
    captures = df.withColumn("fetched_at", F.to_timestamp_ntz(F.lit("2024-02-01")))
    assert {r.id for r in url_filter.filter_urls(captures, entries).collect() if r.blocked} == {0, 1}


def test_both_ways_of_url_filters_and_exact_dedup(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    first = sorted(map(str, queries.op7_url_filters(spark, sf).collect())), sorted(map(str, queries.op5_exact_dedup(spark, sf).collect()))
    monkeypatch.setattr(url_filter, "BROADCAST_INTERVALS", -1)
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", -1)
    assert (sorted(map(str, queries.op7_url_filters(spark, sf).collect())), sorted(map(str, queries.op5_exact_dedup(spark, sf).collect()))) == first


def test_labels_of_any_number_and_shared_ids(spark):
    many = spark.createDataFrame([(i, f"{EN} {i % 1500}", f"x{i % 1500}") for i in range(6000)], "doc_id long, text string, lang string")
    model = language_id.train(many, F.lit(True), rows=600)
    assert len({x for _, own in model.families for x in own}) == 300  # the bound: rows / LEAST_ROWS
    # All rows of the commonest label share one doc_id, or have none.
    for key in (7, None):
        rows = [(key, f"{EN} {i}", "en") for i in range(900)] + [(i, f"{DE} {i}", "de") for i in range(60)]
        model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), F.lit(True), rows=80)
        assert {x for _, own in model.families for x in own} == {"en", "de"}


def test_repeated_labelled_ids_stay_bounded(spark, monkeypatch):
    rows = [(i % 2, f"{EN} {i}") for i in range(6000)]
    seen = []
    monkeypatch.setattr(quality_fm.Machine, "fit", classmethod(lambda cls, found, y: seen.append(len(found))))
    quality_fm.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int"), F.lit(True), rows=500)
    assert 350 < seen[0] < 650


def test_held_out_folds_and_scores(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    import zlib

    for name, modulus, fold in (("op8_language_id", 3, 1), ("op9_quality_classifier", 5, 0)):
        got = queries.QUERIES[name](spark, sf).collect()
        assert Counter(r.doc_id for r in got) == Counter(list(docs)) and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == fold) for r in got)


def test_text_ids(spark):
    rows = [("b", EN, "s"), ("a", EN, "s"), ("c", DE, "t"), (None, EN, "s"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    kept = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(df).collect()}
    assert kept == {("a", "a", True), ("b", "a", False), (None, "a", False), ("c", "c", True), (None, None, True)}
    assert mixing.mix(df).count() == 5 and mixing.mixed_stream(df).count() >= 3


def test_stages_keep_columns_of_any_name(spark):
    rows = [(1, EN, "en", "s", 3, "mine", 1), (1, EN, "en", "s", 3, "mine", 1), (None, DE, None, None, None, None, None), (2, None, "en", "s", 0, "x", 2), (3, "", "en", "t", 0, "x", 2), (4, "word " * 3000, "en", "t", 0, "y", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, `a.b` int").withColumns({"size": F.lit(7), "group_size": F.lit("g"), "__n": F.lit(1)})
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, df, "")
        assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString(), name
        assert {r.kept for r in out.collect()} <= {"mine", None, "x", "y"}
        assert stage(spark, df.limit(0), "").count() == 0
    quality, exact, near = (dict(corpus_pipeline.STAGES)[k](spark, df, "").collect() for k in ("quality rules", "exact dedup", "simhash near-dedup"))
    assert Counter(r.doc_id for r in quality) == Counter({1: 2, None: 1})
    assert Counter(r.doc_id for r in exact) == Counter([1, None, 2, 4]) and Counter(r.doc_id for r in near) == Counter([1, None, 2, 4])
    assert corpus_pipeline.STAGES[4][1](spark, df, "").count() >= 6


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)
            set = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

    with pytest.raises(ValueError):
        _shared.shared_dir(Fake)
    Fake.sparkContext.master = "local[4]"
    assert _shared.shared_dir(Fake)


def test_stage_tables_go_when_read(spark):
    df = _shared.staged(spark.range(5), "gone")
    file = df.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    import os

    assert os.path.exists(file)
    _shared.dropped(df)
    assert not os.path.exists(file)
