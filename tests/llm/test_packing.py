import numpy as np
import public_tokenizers
import pytest
from odd_rows import ODD_ROWS
from tokenizers import Tokenizer

from quorumbook.llm.packing import binary_lengths, binary_pieces, numbered_sequences
from quorumbook.llm.wordcache import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_lengths_are_powers_of_two_and_add_up():
    for n in (1, 2, 3, 4095, 4096, 4097, 12_345):
        parts = binary_lengths(n, 4096)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 4096 for p in parts)


def test_cached_words_equal_the_tokenizer(tokenizer):
    odd = ["", "İstanbul ΣΑΣ ſ K Å", "it's I'LL ''re 12 3４ naïve café é  x y <|endoftext|> Ā ŉ", "a\x85b\x1cc \x00", "  \n\t",
           "½ ² ª º µ ˚", "日本語 текст", "a" * 5000] + [chr(c) + "b" + chr(c) for c in range(1, 0x260)]
    encoder = WordEncoder(PATH, cached_words=5)
    for text in odd * 2:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_hold_every_id_once(odd, tokenizer):
    pieces = binary_pieces(odd, PATH, longest=1024).collect()
    found = {}
    for p in sorted(pieces, key=lambda p: p.start):
        found.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for doc_id, text, *_ in ODD_ROWS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        parts = found[doc_id, len(ids)]
        whole = {}
        for p in parts:
            assert len(p.ids) == 4 * p.length and p.length & (p.length - 1) == 0 and p.length <= 1024
            whole[p.start] = np.frombuffer(p.ids, "<u4").tolist()
        assert sum(whole.values(), [])[:len(ids)] == ids or len(parts) > len(whole)  # a repeated row has its pieces twice


def test_sequences_are_numbered_without_gaps(odd):
    pieces = binary_pieces(odd, PATH, longest=64).cache()
    rows = numbered_sequences(pieces, rows_per_piece=10).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and {r.offset for r in rows} == {0}
    ordered = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in ordered] == sorted((r.length for r in rows), reverse=True)


def test_empty_table(empty):
    assert numbered_sequences(binary_pieces(empty, PATH)).collect() == []
