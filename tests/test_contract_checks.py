"""A contract's checks read the values that were computed; plain numbers take the quick pattern and give what float() gives."""

from pyspark.sql import functions as F

from provenant.functions import text as T
from provenant.operators import contracts


def test_checks_do_not_compute_the_values_again(spark):
    rows = [("1", "P123456", "12.5"), ("2", "bad", "abc"), (None, "P123456", ""), ("4", "p 123456", " 1_0 ")]
    raw = spark.createDataFrame(rows, "contr_id string, projectid string, total_contr_amnt string").withColumn("raw_json", F.lit("{}"))
    out = contracts.apply_contract(raw, "contract_award", constants={"official_awards_url": "u"}, keep=["contr_id"])
    got = [(r.award_id, r.project_id, r.amount, r.mapping_error, r.mapping_error_field) for r in out.collect()]
    assert got == [("1", "P123456", 12.5, None, None), ("2", None, None, "MappingError", "project_id"),
                   (None, "P123456", None, "MappingError", "award_id"), ("4", "P123456", 10.0, None, None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("^P[0-9]{6}$") == 1


def test_numbers_are_pythons_floats(spark):
    texts = ["12", "1.5", "1.", ".5", "1_0", "1__0", " 2 ", "1\n", "1e5", "nan", "-3", "abc", "٣٤", "1.5.2", "٣.5", "12 "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.to_number("t").alias("n"), T.to_number_error("t").alias("bad")).collect()
    for row in got:
        try:
            want = float(row.t)
        except ValueError:
            assert row.n is None and row.bad
        else:
            assert not row.bad and (row.n == want or want != want)
