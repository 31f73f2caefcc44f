from itertools import accumulate

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.token_counts import PrefixCounter, count_tokens, prefix_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "it's", " ", "  ", "\n", "'ll", "'re", "é", "<|endoftext|>", "<|endof", "12", "!!", "\t", " the", "日本", "\x1c", "'", "l", "😀", "###", " ", "tionthe"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=9))
def test_every_prefix_as_the_library_counts_it(library, parts):
    text = "".join(parts)
    counter = PrefixCounter.open(PATH)
    want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert counter.prefixes(text).tolist() == want
    assert counter.total(text) == want[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_any_text(library, text):
    assert PrefixCounter.open(PATH).total(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_rows(spark, library):
    long = "Ths is a long one. " * 3000 + "x" * 5000
    texts = ["a b", None, "", "same", "same", long, "n" * 600]
    docs = spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs).collect()}
    for k, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert got[k] == (len((text or "").encode()), n, n > 512)
    assert count_tokens(docs.where("false")).count() == 0
    assert count_tokens(spark.createDataFrame([(None, "x")], "doc_id bigint, text string")).collect()[0].n_tokens == 1


def test_budgets(spark, library):
    text = "The quick brown fox doesn't jump  over the lazy dog."
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in prefix_token_counts(docs, budget=7).collect()}
    kept = rows[1].kept_chars
    assert len(library.encode(text[:kept], add_special_tokens=False).ids) <= 7
    assert all(len(library.encode(text[:i], add_special_tokens=False).ids) > 7 for i in range(kept + 1, len(text) + 1))
    assert rows[2].prefix_tokens == [0] and rows[2].kept_chars == 0


def test_pieces_of_every_code_point(library):
    """Between letters, digits and signs each code point is split as the library splits it."""
    counter = PrefixCounter(PATH)
    planes = [*range(0x80, 0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE0200)]  # the others have no characters
    codes = list(map(chr, planes))
    for start in range(0, len(codes), 100):
        text = "".join(f"a{c}1 {c}!" for c in codes[start : start + 100])
        ends = [end for _, (_, end) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert ends == list(accumulate(map(len, counter.pieces(text))))


def test_prefixes_of_an_empty_table_and_of_repeats(spark):
    docs = spark.createDataFrame([(1, "ab cd"), (1, "ab cd"), (None, "")], "doc_id bigint, text string")
    rows = prefix_token_counts(docs).collect()
    assert sorted(len(r.prefix_tokens) for r in rows) == [1, 6, 6]
    assert prefix_token_counts(docs.where("false")).count() == 0


def test_a_long_text_without_a_break():
    """Near the library's own time, and nothing of it is kept."""
    import random
    import time

    from tidemark.llm.token_counts import PrefixCounter

    counter = PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    text = "".join(random.Random(1).choices("etaoinshrdlu", k=200_000))
    began = time.perf_counter()
    made = counter.piece(text)
    assert time.perf_counter() - began < 5 and not counter.known
    assert made == len(counter_library().encode(text, add_special_tokens=False).ids)


def counter_library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made
