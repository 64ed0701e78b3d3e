import numpy as np
from odd_rows import ODD_ROWS
from pyspark.sql import functions as F

from quorumbook.llm.language import (
    fit_temperature, gram_counts, is_held_out, keep_known, predict_languages, train_language_model,
)

SMALL = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_documents_are_told_apart(spark):
    docs = spark.read.parquet(SMALL)
    found = predict_languages(docs, train_language_model(docs)).where(is_held_out(F.col("doc_id"))).collect()
    assert len(found) > 200 and np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_labels_of_held_out_documents_are_not_learned(spark):
    docs = spark.read.parquet(SMALL)
    spoilt = docs.withColumn("lang", F.when(is_held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert train_language_model(spoilt).languages == ["de", "en", "es", "fr"]


def test_odd_rows(odd):
    docs = odd.withColumn("lang_pred", F.lit("clash"))
    model = train_language_model(odd)
    found = predict_languages(docs, model, kept=["doc_id"]).collect()
    assert len(found) == len(ODD_ROWS)
    for r in found:
        if r.doc_id in (3, 4, 5, 8):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in model.languages
    kept = keep_known(docs, model)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in ODD_ROWS if r[0] not in (3, 4, 5, 8))


def test_empty_table_and_no_labels(empty, documents):
    model = train_language_model(empty)
    assert model.languages == [] and predict_languages(empty, model).collect() == []
    docs = documents([(1, "some text", None, None)])
    found = predict_languages(docs, train_language_model(docs)).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)]


def test_only_the_most_frequent_labels_are_learned(documents):
    rows = [(i, f"der Text {i} ist es" if i % 2 else f"the text {i} is it", "de" if i % 2 else "en") for i in range(80)]
    rows += [(1000 + i, f"label {i}", f"junk {i}") for i in range(50)]
    assert train_language_model(documents(rows), most_languages=2).languages == ["de", "en"]


def test_known_languages_are_kept_and_filled_in(spark, documents):
    docs = spark.read.parquet(SMALL)
    model = train_language_model(docs)
    unlabelled = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    said = {r.doc_id: r.lang_pred for r in predict_languages(docs, model, kept=["doc_id"]).collect()}
    filled = {r.doc_id: r.lang for r in keep_known(unlabelled, model, lang_col="lang").collect()}
    labels = {r.doc_id: r.lang for r in docs.collect()}
    assert filled == {i: (labels[i] if i % 2 == 0 and labels[i] else said[i]) for i in filled}
    only = {r.doc_id for r in keep_known(docs, model, wanted=["de", "fr"]).collect()}
    assert only == {i for i in filled if said[i] in ("de", "fr")} and 0 < len(only) < len(filled)
    assert {r.doc_id for r in keep_known(docs, model, wanted=["de"], least_score=1.1).collect()} == set(filled)


def test_temperature_lowers_scores_that_are_too_sure():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 3000)
    scores = rng.normal(size=(3000, 3))
    scores[np.arange(3000), labels] += 1
    assert abs(fit_temperature(scores, labels) - 1) < 0.15 and abs(fit_temperature(scores * 10, labels) - 10) < 1.5


def test_counts_of_grams():
    assert not gram_counts("12 -- \n").any()
    assert gram_counts("ab").sum() == 4 + 3 + 2 and (gram_counts("Ab") == gram_counts(" aB!!")).all()
