import re

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_exact_dedup import brute as brute_exact
from test_near_dedup import brute as brute_near
from test_near_dedup import near_rows
from tokenizers import Tokenizer

from quorumbook.llm.pseudonyms import ANY

STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def raw(spark, documents):
    near = [(100 + i, t, "en", s) for i, t, _, s in near_rows(4, groups=2, size=12)]
    more = [(1, "one two three four five six seven", "en", "a"), (2, "one  two three four five six seven", "en", "a"),
            (3, None, None, "a"), (4, "12 -- !", "en", "b"), (5, "card 4316522678525456 and mail x.1@mail2.example.com", "en", "b"),
            (5, "card 4316522678525456 and mail x.1@mail2.example.com", "en", "b"), (None, "no id at all here", "en", None),
            (6, "", "en", "a")]
    return documents(near + more)


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "private_values", "packing"]


def test_every_stage_does_its_work(spark, raw, tmp_path):
    docs, folder = raw, str(tmp_path)
    kept = STAGES["language"](spark, docs, folder)
    assert kept.columns == raw.columns
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(map(str, texts)) == sorted(str((r.doc_id, r.text)) for r in raw.collect() if re.search("[a-z]", r.text or ""))

    once = STAGES["exact_dedup"](spark, kept, folder)
    want = {(i, k) for i, k, *_ in brute_exact(texts) if i == k}
    assert once.columns == raw.columns and {(r.doc_id, r.doc_id) for r in once.collect()} == want

    rows = [(r.doc_id, r.text) for r in once.collect()]
    apart = STAGES["near_dedup"](spark, once, folder)
    stay = {c for i, _, c in brute_near(rows, 5) if i == c}
    assert apart.columns == raw.columns and {r.doc_id for r in apart.collect()} == stay

    private = STAGES["private_values"](spark, apart, folder)
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (apart, private))
    assert private.columns == raw.columns and before.keys() == after.keys()
    for i, text in before.items():
        found = re.findall(ANY, text)
        assert len(text) == len(after[i]) and (text == after[i]) == (not found)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    packed = STAGES["packing"](spark, private, folder).collect()
    tokens = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in after.items()}
    for i, n in tokens.items():
        assert sum(p.length for p in packed if p.doc_id == i) == n
    assert sorted(p.sequence_id for p in packed) == list(range(len(packed)))


def test_run_over_written_tables(spark, raw, tmp_path):
    raw.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars")).write.parquet(
        f"{tmp_path}/documents.parquet")
    assert {r.length & (r.length - 1) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {0}


def test_empty_table(spark, empty, tmp_path):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == []


def test_documents_without_labels_are_kept(spark, raw, tmp_path):
    for label in (None, "und"):
        docs = raw.withColumn("lang", F.lit(label).cast("string"))
        kept = STAGES["language"](spark, docs, str(tmp_path)).select("doc_id", "text").collect()
        assert sorted(map(str, kept)) == sorted(
            str(r) for r in raw.select("doc_id", "text").collect() if re.search("[a-z]", r.text or ""))
    raw.withColumn("lang", F.lit(None).cast("string")).select("doc_id", "text", "lang", "source").write.parquet(
        f"{tmp_path}/documents.parquet")
    found = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {1, 5, None} <= found and not found & {3, 4, 6}


def test_pieces_carry_the_language_of_the_text(documents, tmp_path):
    said = {"de": "der die das und ein Haus steht hier", "en": "the house that stands here is one of them"}
    rows = [(i, f"{said['de' if i % 2 else 'en']} {'xyz'[i % 3] * (i % 7 + 1)}", "de" if i % 2 else "en", "a") for i in range(300)]
    wrong, missing = (1, 2), (3, 4)
    rows = [(i, t, None if i in missing else {"de": "en", "en": "de"}[lang] if i in wrong else lang, s)
            for i, t, lang, s in rows]
    docs = documents(rows)
    kept = STAGES["language"](docs.sparkSession, docs, str(tmp_path))
    pieces = STAGES["packing"](docs.sparkSession, kept, str(tmp_path)).collect()
    assert {(p.doc_id, p.lang) for p in pieces} == {(i, "de" if i % 2 else "en") for i in range(300)}
