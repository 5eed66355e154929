"""Texts that hold an added token, against the library's own call."""

import zlib

import numpy as np
import pytest

from changelens.llm import packing, token_files
from changelens.llm.tokenizing import default_file, encoder

TEXTS = ["a <|endoftext|> x", "<|endoftext|>", "one<|endoftext|><|endoftext|>\n two", "<|endoftext |> <|ENDOFTEXT|>", "plain words, don't", "日本 <|endoftext|> é", "", "x " * 300 + "<|endoftext|>"]


def library_ids(value):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_file()).encode(value, add_special_tokens=False).ids


def test_ids_are_those_of_the_library():
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder(default_file()).encode(TEXTS)] == [library_ids(t) for t in TEXTS]
    assert library_ids("a <|endoftext|> x") == [64, 220, 50256, 2124]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_packing_and_token_files(spark, docs, tmp_path):
    crc = lambda ids: zlib.crc32(np.asarray(ids, "<u4").tobytes())
    pieces = {(r.doc_id, r.length, r.ids_crc32) for r in packing.pack(docs, capacity=4096).collect()}
    assert pieces == {(i, len(x), crc(x)) for i, x in enumerate([*library_ids(t), 2] for t in TEXTS)}
    token_files.write_tokens(docs, str(tmp_path / "ids"))
    ids = {r.doc_id: list(r.ids) for r in token_files.read_tokens(spark, str(tmp_path / "ids")).collect()}
    assert ids == {i: [*library_ids(t), 0] for i, t in enumerate(TEXTS)}
    at, starts = 0, {}
    for i in range(len(TEXTS)):
        starts[i], at = at, at + len(ids[i])
    assert {r.doc_id: r.start for r in token_files.digests(spark, str(tmp_path / "ids")).collect()} == starts
