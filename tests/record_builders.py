"""Raw records and frames of them for the golden cases."""

import json

from provenant.sources.adapters import AWARD_COLUMNS, NOTICE_COLUMNS

NOTICE_VALUES = dict(zip(NOTICE_COLUMNS, (
    "n-1", "P100001", "Survey drones for coastal mapping", "Zambia", "zm", "Equipment", "Open tender",
    "2025-03-04", "2025-04-15", "Transport", "https://example.org/tender"), strict=True))
AWARD_VALUES = dict(zip(AWARD_COLUMNS, (
    "a-1", "P200002", "Bridge inspection", "Zambia", "Works", ["Northwind Works"], "98000", "2025-05-06",
    "Coastal Roads", "South", ["Transport"]), strict=True))


def notice(record_id="n-1", project_id="P100001", **changed):
    return {**NOTICE_VALUES, "id": record_id, "project_id": project_id, **changed}


def award(record_id="a-1", project_id="P200002", **changed):
    return {**AWARD_VALUES, "contr_id": record_id, "projectid": project_id, **changed}


def notices_df(spark, rows):
    data = [tuple(None if r.get(c) is None else str(r.get(c)) for c in NOTICE_COLUMNS)
            + (i, json.dumps(r, sort_keys=True)) for i, r in enumerate(rows)]
    schema = ", ".join(f"{c} string" for c in NOTICE_COLUMNS) + ", ingest_seq long, raw_json string"
    return spark.createDataFrame(data, schema)


def awards_df(spark, rows):
    arrays = ("supp_name", "mjsecname")
    data = [tuple(r.get(c) if c in arrays else (None if r.get(c) is None else str(r.get(c))) for c in AWARD_COLUMNS)
            + ("%06d" % i, json.dumps(r, sort_keys=True)) for i, r in enumerate(rows)]
    schema = ", ".join(f"{c} array<string>" if c in arrays else f"{c} string" for c in AWARD_COLUMNS) \
        + ", ingest_seq string, raw_json string"
    return spark.createDataFrame(data, schema)
