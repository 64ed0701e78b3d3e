import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from odd_rows import ODD_ROWS
from tokenizers import Tokenizer

from quorumbook.llm.alignment import align_tokens, link_statistics
from quorumbook.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
LIBRARY = Tokenizer.from_file(A)
LIBRARY.encode_special_tokens = True
MODEL = sentencepiece.SentencePieceProcessor(model_file=B)
LETTERS = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
LETTERS |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in LETTERS)}
BYTES = {c: b for b, c in LETTERS.items()}


def tokens(text):
    """(id, bytes) of both sides."""
    a = [(i, bytes(BYTES[c] for c in LIBRARY.id_to_token(i)))
         for i in LIBRARY.encode(f" {text}", add_special_tokens=False).ids]
    b = [(i, bytes([int(MODEL.id_to_piece(i)[3:5], 16)]) if MODEL.is_byte(i)
          else MODEL.id_to_piece(i).replace("▁", " ").encode()) for i in MODEL.encode(text)]
    return a, b


def spans(side):
    out, at = [], 0
    for i, piece in side:
        out.append((i, at, at + len(piece)))
        at += len(piece)
    return out


def by_hand(rows):
    """Every document's figures by walking over both sides, token by token."""
    found, held = [], Counter()
    for doc, text in rows:
        a, b = tokens(text) if text else ([], [])
        if b"".join(p for _, p in a) != f" {text}".encode() or b"".join(p for _, p in b) != f" {text}".encode():
            a = b = []
        a, b = spans(a), spans(b)
        groups, links, i, j, k = [], [], 0, 0, 0
        for cut in sorted({e for *_, e in a} & {e for *_, e in b}):
            mine, other = [t for t in a[i:i + 4000] if t[2] <= cut], [t for t in b[j:j + 4000] if t[2] <= cut]
            i, j = i + len(mine), j + len(other)
            groups.append(",".join(str(t[0]) for t in mine) + "|" + ",".join(str(t[0]) for t in other))
            links += [(x[0], y[0]) for x in mine for y in other if x[1] < y[2] and y[1] < x[2]]
        held.update(set(links))
        found.append((doc, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return sorted(((doc, na, nb, len(groups), len(links), sum(held[p] == best[p[0]] for p in links),
                    sum(held[p] for p in links), ";".join(groups)) for doc, na, nb, groups, links in found), key=str)


MORE = ["abc▁d", "日本語 text 日本語", "a\n\n  b\t\tc ", "<s> </s> <unk> <0x41> <|endoftext|>", "ﬁ ½ ①", "x" * 3000, "\x00a",
        "  lead", "trail  ", "🙂🙃", "é", "one two three", "one two three", "Internationalisation of tokenisation"]


@pytest.mark.parametrize("frequent,chunk", [(1 << 18, 1 << 21), (5, 30), (0, 1)])
def test_figures_equal_brute_force(odd, documents, frequent, chunk):
    df = odd.unionByName(documents([(100 + i, t) for i, t in enumerate(MORE)]))
    rows = [(r[0], r[1] if r[0] != 7 else r[1]) for r in ODD_ROWS] + [(100 + i, t) for i, t in enumerate(MORE)]
    rows = [(i, t) for i, t in rows if i != 7]  # the very long text is too long for the walk
    got = link_statistics(align_tokens(df.where("doc_id <> 7 or doc_id is null"), A, B, chunk_bytes=chunk), frequent)
    found = sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups)
                    for r in got.collect()), key=str)
    assert found == by_hand(rows)


def test_very_long_text(documents):
    text = "é 12 ß " * 30_000
    row = align_tokens(documents([(7, text)]), A, B).first()
    a, b = tokens(text)
    assert (row.n_a, row.n_b) == (len(a), len(b))
    assert row.n_links == row.n_a + row.n_b - row.n_groups == sum(row.times)
    assert ",".join(str(i) for i, _ in a) == ",".join(g.split("|")[0] for g in row.groups.split(";"))
    assert ",".join(str(i) for i, _ in b) == ",".join(g.split("|")[1] for g in row.groups.split(";"))


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_token_alignment"](spark, SMALL).collect()), key=str)
    want = [(*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in by_hand(docs)]
    assert got == sorted(want, key=str)


def test_empty_table(empty):
    assert link_statistics(align_tokens(empty, A, B)).collect() == []
