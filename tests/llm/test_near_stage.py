"""The near-dedup stage on null and repeated doc_ids."""

from collections import Counter

import corpus_pipeline

from .test_operators import DE, EN, FR


def test_one_row_of_each_group_stays(spark):
    # 1 and 9 repeat with different texts; the rows of FR lack ids; one copy of DE has an id.
    rows = [(1, EN), (9, EN), (9, DE), (9, DE), (1, DE + " "), (None, FR), (None, FR + " "), (None, FR), (None, DE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text.strip()) for r in got.collect()) == Counter([(1, EN), (1, DE), (None, FR)])
    assert corpus_pipeline.near_stage(spark, docs.limit(0), "").count() == 0
