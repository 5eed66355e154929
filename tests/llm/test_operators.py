"""Each corpus operator on a small table with nulls, empty and long texts, ties, repeats and clashing columns, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from changelens.llm import exact_dedup, language_id, line_dedup, mixing, packing, quality_fm, quality_rules, simhash, token_files, url_filter
from changelens.llm.components import components, join_hot
from changelens.llm.tokenizing import Encoder, default_file

WHITE = "[ \t\n\x0b\x0c\r]"
EN = "the cat and the dog went to the river with that old boat and then the rain came over this town"
DE = "der hund und die katze gehen nicht durch den wald weil das wasser noch zu kalt ist für sie"
FR = "le chat et le chien vont dans la rivière avec les enfants pour une belle journée à la campagne"
ES = "el gato y los perros van por el río con una barca para que los niños no tengan más miedo"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, score string, ids string, row string"


def rows():
    base = [
        (0, None, None, None), (1, "", "en", "a"), (2, " \t\n ", "en", "a"), (3, EN, "en", "a"), (4, EN + " ", "en", "b"), (5, EN.upper(), "en", "b"),
        (6, EN.replace("old boat", "new boat"), "en", "b"), (7, "one\ntwo\n one \nOne\n\nthree", "en", None), (8, DE, "de", "a"), (9, FR, "fr", "a"), (10, ES, "es", "b"),
        (11, "123 456 !!!", None, "c"), (12, "one\nfour ", "en", "c"), (13, " ".join(f"w{i % 3000}" for i in range(9000)), "en", "a"), (14, "word " * 400, "en", "c"), (None, "no id here\none", "en", "c"),
    ]
    out = [(*r, len(r[1] or ""), "x", "y", "z", "i", "r") for r in base]
    return [*out, out[3], out[3], out[12]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_lines(texts, least):
    key = lambda x: re.sub(f"^{WHITE}+|{WHITE}+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    found = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    return [(len((t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if not key(x) or found[key(x)] < least)) for t in texts]


@pytest.mark.parametrize(("limit", "keys"), [(1 << 20, 500_000), (1 << 20, 1), (0, 1)])
def test_line_dedup(docs, empty, limit, keys, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", keys)
    got = line_dedup.drop_repeated_lines(docs, min_docs=3, broadcast_bytes=limit)
    assert set(docs.columns) < set(got.columns)
    expected = Counter((r[0], *x) for r, x in zip(rows(), brute_lines([r[1] for r in rows()], 3), strict=True))
    assert Counter((r.doc_id, r.n_lines, r.kept_text) for r in got.collect()) == expected
    assert any(r.n_dropped for r in got.collect())
    assert line_dedup.drop_repeated_lines(empty, 2, broadcast_bytes=limit).count() == 0


def test_perfect_hash_is_minimal_and_exact():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    table, rest = line_dedup.PerfectHash.build(keys)
    assert not len(rest) and sorted(table.index(keys)) == list(range(len(keys)))
    shard = line_dedup.Shard(*line_dedup.Shard.build(keys, keys + np.uint64(1), np.arange(len(keys))).values())
    assert (shard.documents(keys, keys + np.uint64(1)) == np.arange(len(keys))).all()
    assert not shard.documents(keys + np.uint64(5), keys).any()
    same = np.array([7, 7, 9], np.uint64)
    shard = line_dedup.Shard(*line_dedup.Shard.build(same, np.array([1, 2, 3], np.uint64), np.array([4, 5, 6])).values())
    assert shard.documents(same, np.array([2, 1, 3], np.uint64)).tolist() == [5, 4, 6]


def fill(sizes):
    """Targets by repeated resharing of what is above a cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, cap, left, out, open_ = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}, {s: 3.0 * sizes[s] for s in names}, float(sum(sizes.values())), {}, set(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > cap[s]}
        if not over:
            return out | {s: weight[s] * unit for s in open_}
        out |= {s: cap[s] for s in over}
        left -= sum(cap[s] for s in over)
        open_ -= over
    return out


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    count = lambda t: len(re.findall("[^ \t\n\x0b\x0c\r]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], count(r[1])) for r in rows())
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r["size"] * r.n_taken
        largest[r.source] = max(largest[r.source], r["size"])
        assert 0 <= r.n_taken <= 3
    targets = fill(sizes)
    for r in got:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source]
    assert sum(taken.values()) <= sum(sizes.values())
    assert all(abs(taken[s] - targets[s]) <= 2 * largest[s] for s in sizes if s != "c") and mixing.mix(empty).count() == 0
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r["size"], r.n_taken) for r in again) == Counter((r.doc_id, r["size"], r.n_taken) for r in got)
    times = [r.doc_id for r in mixing.mixed_stream(docs).collect()]
    assert len(times) == sum(r.n_taken for r in got)


def test_mixing_narrows_the_cut_like_one_sort(spark, monkeypatch):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("source"), F.lit("").alias("text"), (F.col("id") % 97 + 1).alias("n"))
    whole = {r.doc_id: r.n_taken for r in mixing.mix(many, size=F.col("n")).collect()}
    monkeypatch.setattr(mixing, "CUT_ROWS", 20)
    assert {r.doc_id: r.n_taken for r in mixing.mix(many, size=F.col("n")).collect()} == whole


def brute_repeats(words, k=5):
    at = defaultdict(list)
    for i in range(len(words) - k + 1):
        at[tuple(words[i : i + k])].append(i)
    return len({j for many in at.values() if len(many) > 1 for i in many for j in range(i, i + k)})


def test_quality_rules(docs, empty):
    got = quality_rules.cascade(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        t = r.text or ""
        words = re.findall("[^ \t\n\x0b\x0c\r]+", t)
        lines = [x for x in t.split("\n") if re.search("[^ \t\n\x0b\x0c\r]", x)]
        expected = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), brute_repeats(words))
        assert tuple(r[s] for s in quality_rules.STATS) == expected
        assert r.base_failed == (len(words) < 10 or 100 * expected[4] > 20 * len(words))
        data, s = t.encode(), expected
        assert r.kept == (not r.base_failed and not any(rule.rejects(data, s) for rule in quality_rules.RULES))
    assert {r.doc_id for r in got if r.kept} >= {3, 8, 9, 10}
    assert quality_rules.cascade(empty).count() == 0


def test_quality_order_looks_at_what_is_left():
    rules = quality_rules.RULES[:3]
    # The second rule rejects what the first does, the third another document: it comes second, though it rejects fewer.
    assert quality_rules.ordered(rules, [1.0, 1.0, 1.0], {0b011: 5, 0b001: 1, 0b100: 2, 0: 9}) == (rules[0], rules[2], rules[1])
    assert quality_rules.ordered(rules, [9.0, 1.0, 1.0], {0b011: 5, 0b001: 1, 0b100: 2}) == (rules[1], rules[2], rules[0])


def test_quality_sample_holds_base_survivors_of_the_whole_table(spark, docs):
    seconds, masks = quality_rules.estimate(docs, rows=10_000)
    judged = quality_rules.cascade(docs).collect()
    assert sum(masks.values()) == sum(not r.base_failed for r in judged) and masks.get(0, 0) == sum(r.kept for r in judged) and len(seconds) == len(quality_rules.RULES)
    many = spark.createDataFrame([(EN,)], "text string").crossJoin(spark.range(4000)).repartition(8)
    assert 60 < sum(quality_rules.estimate(many, rows=100)[1].values()) < 150


def brute_print(t):
    words = re.findall("[^ \t\n\x0b\x0c\r]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = list(range(len(prints)))
    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4 and label[i] != label[j]:
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    return label


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = [brute_print(r[1]) for r in rows()]
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in got) == Counter((r[0], p) for r, p in zip(rows(), prints, strict=True))
    label = brute_components(prints)
    least = {x: min((r[0] for r, y in zip(rows(), label, strict=True) if y == x and r[0] is not None), default=None) for x in label}
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((r[0], least[x]) for r, x in zip(rows(), label, strict=True))
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_at_every_distance(spark, request):
    rng = np.random.default_rng(11)
    prints = []
    for _ in range(120):
        base = int(rng.integers(0, 1 << 63))
        prints += [base, *(base ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in (1, 2, 3, 4, 5))]
    cluster = int(rng.integers(0, 1 << 63))
    prints += [cluster ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(300)]
    prints = sorted(set(prints))
    fps = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a variant's fingerprints span several batches
    request.addfinalizer(lambda: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"))
    roots = {r.node: r.root for r in components(simhash.links(fps)).collect()}
    label = brute_components(prints)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    least = {x: min(s for s, y in zip(signed, label, strict=True) if y == x) for x in label}
    assert [roots.get(s, s) for s in signed] == [least[x] for x in label]


def test_components_of_a_long_chain(spark):
    links = spark.range(400).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {(r.root) for r in components(links).collect()} == {0}
    assert components(links.limit(0)).count() == 0


def test_components_of_hubs(spark):
    """Two stars whose hubs hold half of all links each, one through its smallest node, one through its largest."""
    links = spark.range(1, 1500).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")).unionByName(spark.range(5000, 6500).select(F.col("id").alias("u"), F.lit(9999).cast("long").alias("v")))
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(1500), 0), **dict.fromkeys([*range(5000, 6500), 9999], 5000)}


def test_hot_keys_join_like_any_other(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 2500, 7).when(F.col("id") < 3990, F.col("id")).cast("long").alias("k"), "id")
    by_key = rows.groupBy("k").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    got, plain = join_hot(rows, by_key, "k", 4000), rows.join(by_key.drop("n"), "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() == 3990
    assert join_hot(rows.limit(0), by_key.limit(0), "k", 0).count() == 0


def test_walk_spans_every_group():
    rng = np.random.default_rng(3)
    for _ in range(40):
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 4))).astype(np.uint64)
        fps = np.unique([int(rng.choice(base)) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for _ in range(40)]).astype(np.uint64)
        label = brute_components(fps.tolist())
        found = simhash.spanning_links(fps)
        assert all(int(fps[i] ^ fps[j]).bit_count() <= 4 for i, j in found) and len(found) == len(fps) - len(set(label))
        near = list(range(len(fps)))
        for i, j in found:
            near = [near[i] if x == near[j] else x for x in near]
        assert len(set(near)) == len(set(label))


def test_exact_dedup(docs, empty):
    for digests in (True, False):
        got = exact_dedup.exact_dedup(docs, digests=digests).collect()
        groups = defaultdict(list)
        for r in rows():
            groups[re.sub(WHITE, "", r[1] or "")].append(r)
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows())
        for r in got:
            text = re.sub(WHITE, "", r.text or "")
            own = groups[text]
            keep = min(own, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
            assert (r.keep_id, r.group_size) == (keep[0], len(own))
            assert r.text_sha256 in ((hashlib.sha256(text.encode()).hexdigest(),) if digests or len(own) > 1 else (None, hashlib.sha256(text.encode()).hexdigest()))
        assert sum(r.kept for r in got) == len(groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(empty).count() == 0


def token_ids(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_file())
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_packing(docs, empty):
    got = packing.pack(docs, capacity=64).collect()
    expected = Counter()
    for r, ids in zip(rows(), token_ids([r[1] for r in rows()], 2), strict=True):
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        expected.update((r[0], k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 2
    assert packing.pack(empty).count() == 0
    assert packing.pack(docs, capacity=64, per_partition=5).count() == len(got)


def test_sum_of_squares_takes_the_smallest_sum():
    lengths = np.random.default_rng(2).integers(1, 33, 300)
    where, offset = packing.sum_of_squares(lengths, 32)
    order, used, count = np.argsort(-lengths, kind="stable"), {}, Counter()
    for i in order:
        n, b = int(lengths[i]), int(where[i])
        fits = [32 - u for u in used.values() if 32 - u >= n and u < 32]
        assert used.get(b, 0) == offset[i] and (b in used or not fits)
        total = lambda g: sum((count[x] - (x == g) + (x == g - n)) ** 2 for x in range(1, 33))
        if fits:
            assert total(32 - used[b]) == min(map(total, fits))
            count[32 - used[b]] -= 1
        used[b] = used.get(b, 0) + n
        count[32 - used[b]] += used[b] < 32
    assert max(used.values()) <= 32


def test_token_files(spark, docs, empty, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, rows_per_file=5)
    got = token_files.digests(spark, path).orderBy("start").collect()
    expected = Counter((r[0], len(ids), crc(ids)) for r, ids in zip(rows(), token_ids([r[1] for r in rows()], 0), strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    back = {r.doc_id: r.ids for r in token_files.read_tokens(spark, path, 8, 10).collect()}
    assert back == dict(zip((8, 9, 10), token_ids([DE, FR, ES], 0), strict=True))
    plan = token_files.read_lengths(spark, path)._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[-1]
    import pyarrow.parquet as pq

    # A file of one short document may have nothing to put in a dictionary.
    groups = [pq.ParquetFile(f).metadata.row_group(0) for f in (tmp_path / "tokens").glob("*.parquet")]
    columns = [g.column(i) for g in groups for i in range(g.num_columns)]
    assert any("DELTA_BINARY_PACKED" in c.encodings for c in columns if c.path_in_schema == "n_tokens")
    assert any("RLE_DICTIONARY" in c.encodings for c in columns if c.path_in_schema.startswith("ids"))
    assert all(c.has_offset_index and c.has_column_index for c in columns)
    token_files.write_tokens(empty, str(tmp_path / "none"))
    assert token_files.digests(spark, str(tmp_path / "none")).count() == 0


def test_encoder_is_exact():
    texts = ["", "  a  b\n\nc ", "don't 'sx it's'll", "é²ªµ ×÷ x", "日本 text\t!", "<|endoftext|> x", "a\n b \nc", "# ## ,,.", EN, " \n y"]
    encoder = Encoder(default_file())
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [x[:-1] for x in token_ids(texts, 0)]


def test_language_id(spark, docs, empty):
    rng = np.random.default_rng(4)
    made = [(i, " ".join(rng.permutation(t.split())), lang, "x") for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (FR, "fr"), (ES, "es")] * 40)]
    train = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    model = language_id.train(train, F.col("doc_id") < 120)
    got = {r.doc_id: r for r in language_id.identify(train.drop("lang"), model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang, _ in made)
    own = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert all((own[i].lang_pred, own[i].score) == ("und", 0.0) for i in (0, 1, 2, 11)) and own[8].lang_pred == "de"
    assert language_id.train(empty, F.lit(True)) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_quality_classifier(spark, docs, empty):
    rng = np.random.default_rng(6)
    made = [(i, " ".join(rng.permutation((EN if i % 2 else EN.replace(" ", " | ")).split(" "))), i % 2) for i in range(200)]
    train = spark.createDataFrame([x[:2] for x in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q if i != 5 else None, 0) for i, _, q in made], "doc_id long, quality int, toxic int")
    machine = quality_fm.train(train, labels, F.col("doc_id") < 150)
    got = {r.doc_id: r for r in quality_fm.rate(train, machine).collect()}
    assert np.mean([got[i].predicted == q for i, _, q in made if i >= 150]) > 0.95
    own = quality_fm.rate(docs, machine).collect()
    assert len(own) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in own)
    nothing = quality_fm.train(train, labels.limit(0), F.lit(True))
    assert {r.score for r in quality_fm.rate(docs, nothing).collect()} == {0.5} and quality_fm.rate(empty, machine).count() == 0


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.DIMS), rng.normal(size=(quality_fm.DIMS, 4)))
    at, x = np.array([3, 9, 20, 400]), rng.normal(size=4)
    pairs = sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i, j in combinations(range(4), 2))
    raw, _, _ = m.raw(at, x, np.array([0, 4]))
    assert raw[0] == pytest.approx(0.3 + m.w[at] @ x + pairs)


def test_url_filter(spark):
    stamp = lambda d: f"2024-{d}"
    entries = spark.createDataFrame(
        [("l", "domain", "bad.example", "add", stamp("02-01")), ("l", "domain", "bad.example", "add", stamp("02-05")), ("l", "domain", "bad.example", "remove", stamp("03-01")), ("l", "host", "www.ok.example", "add", stamp("01-01")),
         ("m", "prefix", "Ok.example/ads", "add", stamp("01-01")), ("l", None, "x", "add", stamp("01-01"))],
        "list string, kind string, value string, action string, at string",
    ).withColumn("at", F.to_timestamp_ntz("at"))
    asked = [
        (1, "http://a.bad.example/x", "01-31", None), (2, "http://A.bad.example:80/x", "02-01", "domain"), (3, "https://bad.example", "02-29", "domain"), (4, "http://bad.example/", "03-01", None), (5, "http://notbad.example/", "02-10", None),
        (6, "http://www.ok.example/p", "02-10", "host"), (7, "http://u@ok.example/ads/1?q", "02-10", "prefix"), (8, "http://ok.example/adsx", "02-10", None), (9, None, "02-10", None), (10, "not a url", "02-10", None), (2, "http://A.bad.example:80/x", "02-01", "domain"),
    ]
    captures = spark.createDataFrame([(i, u, stamp(d), "clash") for i, u, d, _ in asked], "page_id long, url string, fetched_at string, blocked string").withColumn("fetched_at", F.to_timestamp_ntz("fetched_at"))
    got = url_filter.filter_urls(captures, entries).collect()
    assert Counter((r.page_id, r.kind, r.blocked) for r in got) == Counter((i, k, k is not None) for i, _, _, k in asked)
    assert url_filter.filter_urls(captures.limit(0), entries).count() == 0
    assert not any(r.blocked for r in url_filter.filter_urls(captures, entries.limit(0)).collect())
