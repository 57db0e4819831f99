import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldloom.llm.token_counts import Counter, MergeTable, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = Counter(MergeTable(PATH))


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(4))
def test_counts_of_odd_texts(seed):
    rng = random.Random(seed)
    alphabet = "aaab tTéÉßçñ ΣσςİI'sdlmv09٣½%$.,!\n\t\x0b\x1c\x1d\x85  ​日本語한🙂é"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    assert COUNTER(texts) == library(texts)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_counts_of_any_text(text):
    assert COUNTER([text]) == library([text])


def test_long_words_and_special_strings():
    rng = random.Random(9)
    texts = ["a" * 5001, "ab" * 3000, "".join(rng.choice("etaoin") for _ in range(4000)), "x<|endoftext|>y", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> a", "", None]
    assert COUNTER(texts) == library(texts)


def test_operator(spark):
    rows = [(1, "Hello world", 5), (1, "Hello world", 5), (2, None, 5), (3, "", 5), (None, "é" * 3000, 5), (4, "x " * 100_000, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, PATH).collect()), key=repr)
    expected = [(i, len((t or "").encode()), n, n > 2048) for (i, t, _), n in zip(rows, library([r[1] for r in rows]))]
    assert got == sorted(expected, key=repr)
    assert count_tokens(df.limit(0), PATH).count() == 0
