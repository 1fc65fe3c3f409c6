from collections import Counter

import public_tokenizers
import pytest
from conftest_texts import odd_texts
from tokenizers import Tokenizer

from tidemark.llm import token_counts

FILE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "a<|endoftext|>b  <|startoftext|>'s don't I'LL 12 \x1c x y z İ é ́ <|ENDOFTEXT|>",
    "<|endoftext|>" * 3,
    "ﬁ ½ ٣ Σας ΟΔΟΣ ẞ ... !!!''' 's 'S",
    "\x00 \x85a　b c",
]


def want(rows):
    tokenizer = Tokenizer.from_file(FILE)
    n = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    return Counter((i, len((t or "").encode()), k, k > 2048) for (i, t), k in zip(rows, n, strict=True))


def got(frame):
    return Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in frame.collect())


def test_odd_texts_against_the_library(odd_docs, no_docs):
    assert got(token_counts.token_counts(odd_docs, FILE)) == want(odd_texts())
    assert token_counts.token_counts(no_docs, FILE).collect() == []


def test_special_strings_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_DOCS", 3)  # the driver's value only: tasks import their own
    rows = list(enumerate(TEXTS * 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(token_counts.token_counts(docs, FILE, buckets=3)) == want(rows)


def test_a_tokenizer_that_keeps_white_space_is_refused(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError, match="white space"):
        token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
