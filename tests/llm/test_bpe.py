import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.bpe import Codec, encode_documents

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SMALL = Codec(PATH, leaf=3, decode_leaf=2)
WHOLE = Codec(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", "'s", "'re", "'", "l", "ll", " ", "  ", "\n", "\t", "1", "23", "!", "é", "漢字", "😀", " ", " ", "<|endoftext|>", "ing", "Ver", "x" * 40]), max_size=60).map("".join))
def test_tree_equals_whole_text(text):
    want = WHOLE.flat.encode_ordinary(text)
    assert SMALL.encode(text) == want
    assert SMALL.decode(want) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_tree_equals_whole_any_text(text):
    assert SMALL.encode(text) == WHOLE.flat.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 20_000, "漢字" * 9000, " " * 20_000, "x" + " " * 9000 + "y", "!" * 15_000, "reinstatement" * 2500, "don't " * 4000, "'" * 9000 + "s", "1" * 12_000])
def test_long_runs(text):
    assert WHOLE.encode(text) == WHOLE.flat.encode_ordinary(text)
    assert Codec(PATH, leaf=500).encode(text) == WHOLE.flat.encode_ordinary(text)
    ids = WHOLE.encode(text)
    assert WHOLE.decode(ids) == SMALL.decode(ids) == text.encode()


def test_other_patterns_are_refused():
    with pytest.raises(ValueError):
        Codec(PATH, r"\S+|\s+")


def test_default_leaf_is_exceeded():
    text = " ".join(f"word{i}" for i in range(5000))
    ids = WHOLE.encode(text)
    assert len(ids) > 8 * WHOLE.decode_leaf and WHOLE.decode(ids) == text.encode()


def test_documents(spark):
    rows = [(1, "Hello  world's", "x"), (2, None, "x"), (3, "", None), (None, "abc", "x"), (1, "Hello  world's", "y"), (5, "z" * 100_000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode_documents(df, PATH, ("doc_id", "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")).collect()
    assert len(got) == 6
    for (i, text, _), r in zip(rows, got, strict=True):
        ids = WHOLE.flat.encode_ordinary(text or "")
        assert (r.doc_id, r.n_tokens, list(r.ids)) == (i, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert bytes(r.decoded) == (text or "").encode() and r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert encode_documents(df.limit(0), PATH).count() == 0
