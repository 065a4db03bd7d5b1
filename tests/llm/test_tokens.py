import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import tokens as t

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def exact():
    with open(os.path.join(t.TOKENIZERS, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("exact", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


FIXED = ["", "a" * 3000, "ab" * 999, "<|endoftext|>", "½2 2½ ²³", "  \n\n x\t y\x1c z \x85", "don't 'll'S", "日本語のテキスト", "😀👍🏽 é é", "x　　y", "_a_1_"]


@pytest.mark.parametrize("text", FIXED)
def test_fixed(exact, text):
    v = t.vocabulary("byte_bpe_50k")
    assert v.encode(text).tolist() == exact(text)
    assert v.decode(v.encode(text).tolist()).decode() == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aenrst '\n0½")), max_size=60))
def test_equals_exact_merging(exact, text):
    assert t.vocabulary("byte_bpe_50k").encode(text).tolist() == exact(text)


def test_tables_when_full(exact, monkeypatch):
    monkeypatch.setattr(t, "MEMO", 3)
    v = t.vocabulary.__wrapped__("byte_bpe_50k")
    text = "the quick brown fox jumps over supercalifragilistic words, again and again"
    assert v.encode(text).tolist() == exact(text) and len(v._memo) <= 3


def test_dataframe(spark, exact):
    rows = [(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (None, "a", "x"), (1, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in t.encode(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(1, exact("hello world"))] * 2 + [(2, []), (3, []), (None, exact("a"))], key=str)
    assert t.encode(df.limit(0), "doc_id", "text").collect() == []
    counted = t.count_tokens(df, "text")
    assert sorted(r.tokens for r in counted.collect()) == [0, 0, 1, 2, 2] and counted.columns == ["doc_id", "ids", "tokens"]
