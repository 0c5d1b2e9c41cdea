"""The pipeline on the smallest tables: each stage's decisions against plain ones."""

import corpus_pipeline as P
from provenant.llm import secrets
from provenant.llm.common import frame

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark):
    docs = frame(spark, SF, "documents", "doc_id", "text", "lang", "source", "n_chars")
    names = [name for name, _ in P.STAGES]
    assert len(names) == 5
    languages = P.identify_language(spark, docs, SF)
    assert languages.columns == docs.columns and 0 <= docs.count() - languages.count() <= 2
    single = P.drop_near_copies(spark, languages, SF)
    texts = [r.text for r in single.collect()]
    assert single.columns == docs.columns and len(set(texts)) == len(texts)
    masked = P.mask_secrets(spark, single, SF)
    assert masked.columns == docs.columns and masked.count() == single.count()
    assert secrets.scan(masked).where("n_assign + n_access + n_hex + n_owned > 0").count() == 0
    assert masked.where("n_chars <> length(text)").count() == 0
    mixed = P.mix(spark, masked, SF)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().where("count > 2").count() == 0
    tokens = P.tokenize(spark, mixed, SF)
    assert tokens.count() == mixed.count() and tokens.where("not round_trip").count() == 0


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (3, None, "en", "s", 0), (None, "x y", None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id is not None, r.doc_id or 0) for r in P.drop_near_copies(spark, docs, SF).collect())
    assert got == [(False, 0), (True, 1), (True, 3)]
