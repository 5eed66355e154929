"""The pipeline's stages in order, against the brute-force versions of its decisions."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from changelens.llm import quality_rules
from changelens.llm._shared import table

from .test_operators import brute_components, brute_print, token_ids


def test_stages_take_effect(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept[name] = docs.collect()
    first = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    good = set()
    for i, t in first.items():
        s = quality_rules.measure(t.encode(), len(t))
        if not (s[0] < 10 or 100 * s[4] > 20 * s[0] or any(r.rejects(t.encode(), s) for r in quality_rules.RULES)):
            good.add(i)
    assert {r.doc_id for r in kept["quality rules"]} == good
    groups = defaultdict(list)
    for i in good:
        groups[re.sub("[ \t\n\x0b\x0c\r]", "", first[i])].append(i)
    single = {min(g, key=lambda i: (-len(first[i]), i)) for g in groups.values()}
    assert {r.doc_id for r in kept["exact dedup"]} == single
    ids = sorted(single)
    label = brute_components([brute_print(first[i]) for i in ids])
    assert {r.doc_id for r in kept["simhash near-dedup"]} == {min(i for i, y in zip(ids, label, strict=True) if y == x) for x in set(label)}
    mixed = Counter(r.doc_id for r in kept["source mixing"])
    assert set(mixed) <= {r.doc_id for r in kept["simhash near-dedup"]} and max(mixed.values()) <= 3
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).collect()
    lengths = dict(zip(mixed, map(len, token_ids([first[i] for i in mixed], 2)), strict=True))
    assert sum(r.length for r in packed) == sum(n * lengths[i] for i, n in mixed.items())
    assert corpus_pipeline.run(spark, sf_dir).count() == len(packed)
