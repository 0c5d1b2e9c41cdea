"""The language model learns from every labelled text, however many there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.llm import language_id


def test_rare_languages_of_a_large_table_are_learned(spark):
    rng = np.random.default_rng(3)
    sound = {"aa": "ka ta ra na ma".split(), "bb": "sch zug ber ung ein".split(), "cc": "ql wx yv jj qy".split()}
    rows = [(i, " ".join("".join(rng.choice(sound[lang], 3)) for _ in range(8)), lang)
            for i in range(9000) for lang in ["cc" if i % 900 == 0 else ("aa", "bb")[i % 2]]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # ids whose hash comes late, so that the smallest hashes have no text of the rare language
    late = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(language_id._DRAWS)) / language_id._DRAWS > 0.5
    table = table.where((F.col("lang") != "cc") | late)
    assert table.where("lang = 'cc'").count() >= 2
    model = language_id.train(table, "doc_id")
    assert model.languages == ["aa", "bb", "cc"]


def test_model_depends_on_rows_not_on_their_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("".join(rng.choice("ka ta ra na".split() if i % 2 else "sch zug ber".split(), 3)) for _ in range(6)), ("aa", "bb")[1 - i % 2])
            for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = (language_id.train(t, "doc_id", rows=100) for t in (table.coalesce(1), table.repartition(7)))
    assert np.allclose(a.logits, b.logits) and np.allclose(a.bias, b.bias) and a.temperature == b.temperature
    assert a.threshold == pytest.approx(b.threshold)
