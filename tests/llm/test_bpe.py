import random

import public_tokenizers
import tiktoken
from hypothesis import given
from hypothesis import strategies as st
from odd_rows import ODD_ROWS
from pyspark.sql import functions as F

from quorumbook.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def encoded(df, **options):
    rows = bpe.encode(df, RANKS, public_tokenizers.PATTERN, **options).withColumn(
        "again", bpe.decoded(F.col("ids"), RANKS)).collect()
    assert all(r.ids_text == ",".join(map(str, r.ids)) and r.n_tokens == len(r.ids) for r in rows)
    assert all(r.again == r.decoded for r in rows)
    return rows


def test_ids_and_round_trip_equal_the_library(odd, documents):
    more = ["<|endoftext|> 日本語 ́́ \x00\x1c\x85 " + "a" * 700, "   \n\n  x", "don't WON'T 'sx", "🙂🙃" * 9, " " * 300]
    df = odd.unionByName(documents([(100 + i, t) for i, t in enumerate(more)]))
    rows = [*ODD_ROWS, *[(100 + i, t) for i, t in enumerate(more)]]
    want = sorted(((i, LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows), key=str)
    for options in ({}, {"prepared_words": 3, "chunk_bytes": 50}):
        assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in encoded(df, **options)), key=str) == want


def test_long_words(documents):
    rng = random.Random(0)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100_000)), "é" * 30_001, "aé日" * 9000, " " * 100_001 + "x",
             "7" * 50_000, "!?" * 20_000, "ab" * 100 + " " + "c" * 201]
    rows = encoded(documents(list(enumerate(texts))))
    assert sorted((r.doc_id, r.ids, bytes(r.decoded)) for r in rows) == [
        (i, LIBRARY.encode_ordinary(t), t.encode()) for i, t in enumerate(texts)]


@given(st.text(st.sampled_from("abeinst é日0 "), max_size=60))
def test_pieces_of_a_long_word_are_those_of_the_library(word):
    ids = [RANKS[p] for p in bpe.pieces_of_long_word(word.encode(), RANKS)]
    assert ids == (LIBRARY._core_bpe.encode_single_piece(word.encode()) if word else [])


MERGES = bpe.merges(RANKS)


@given(st.lists(st.text(st.sampled_from("abeinst é日0 "), min_size=1, max_size=40), max_size=12))
def test_words_of_a_chunk_are_folded_together(words):
    ids = bpe.folded_words([w.encode() for w in words], MERGES).to_pylist()
    assert ids == [LIBRARY._core_bpe.encode_single_piece(w.encode()) for w in words]


def test_empty_table(empty):
    assert encoded(empty) == []
