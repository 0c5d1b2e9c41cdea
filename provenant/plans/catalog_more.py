"""Registered queries, part two: joins, aggregates, feeds, evidence, retrieval
and the review workflow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EXPECTED_CONTRACTS
from ..operators import curate, drift, enrichment, evidence, readmodels, retrieval, review
from ..operators.tables import scratch_table
from ..session import scratch_path
from ..sources import adapters
from ..sources.tables import read_table
from .catalog import ISSUE_OUT, ing, register
from .oracle import AWARD_HASH, NOTICE_HASH, RUN_ID

# =============================================================================== 2.4 joins


@register("projects_with_features",
          "SELECT p.project_id, p.title, p.country, p.region, p.sector, f.notice_count, f.award_count, "
          "round(f.award_amount, 2) AS award_amount, f.linkage_status, f.quality_score "
          "FROM projects p LEFT JOIN features f USING (project_id)")
def q_projects_with_features(spark, sf, limit: int | None = None):
    """All projects with their features; with ``limit`` the first by id."""
    i = ing(spark, sf)
    f, projects = i.features(), i.projects()
    if limit is not None:  # a top-k by id before the join
        projects = projects.orderBy("project_id").limit(limit)
    return projects.join(f, "project_id", "left").select(
        "project_id", "title", "country", "region", "sector", "notice_count", "award_count",
        F.round("award_amount", 2).alias("award_amount"), "linkage_status", "quality_score")


@register("linkage_status", "SELECT project_id, linkage_status FROM features")
def q_linkage_status(spark, sf):
    return ing(spark, sf).features().select("project_id", "linkage_status")


@register("unlinked_projects",
          "SELECT DISTINCT project_id FROM notices WHERE project_id NOT IN (SELECT project_id FROM projects)")
def q_unlinked_projects(spark, sf):
    i = ing(spark, sf)
    return curate.unlinked_projects(i.notices(), i.projects())


@register("linked_projects",
          "SELECT project_id FROM (SELECT project_id FROM notices UNION SELECT project_id FROM awards) "
          "WHERE project_id IN (SELECT project_id FROM projects)")
def q_linked_projects(spark, sf):
    i = ing(spark, sf)
    return curate.linked_projects(i.notices(), i.awards(), i.projects())


PROJECT_360_ID = "P100002"


@register("project_360",
          f"SELECT p.project_id, p.title, (SELECT count(*) FROM notices WHERE project_id = '{PROJECT_360_ID}') AS notices, "
          f"(SELECT count(*) FROM awards WHERE project_id = '{PROJECT_360_ID}') AS awards, "
          f"round(f.award_amount, 2) AS award_amount, f.linkage_status FROM projects p "
          f"LEFT JOIN features f USING (project_id) WHERE p.project_id = '{PROJECT_360_ID}'")
def q_project_360(spark, sf, project_id: str = PROJECT_360_ID):
    i = ing(spark, sf)
    pid = project_id.upper()
    p = i.projects().filter(F.col("project_id") == pid).select("project_id", "title")
    n = i.notices().filter(F.col("project_id") == pid).groupBy("project_id").agg(F.count(F.lit(1)).alias("notices"))
    a = i.awards().filter(F.col("project_id") == pid).groupBy("project_id").agg(F.count(F.lit(1)).alias("awards"))
    f = i.features().filter(F.col("project_id") == pid).select("project_id", "award_amount", "linkage_status")
    return p.join(n, "project_id", "left").join(a, "project_id", "left").join(f, "project_id", "left").select(
        "project_id", "title", F.coalesce("notices", F.lit(0)).cast("long").alias("notices"),
        F.coalesce("awards", F.lit(0)).cast("long").alias("awards"),
        F.round("award_amount", 2).alias("award_amount"), "linkage_status")


def _section_sql(name: str, table: str, **columns: str) -> str:
    cols = []
    for part in readmodels.PROJECT_ROWS.split(", "):
        out, dtype = part.split(" ")
        duck = {"string": "VARCHAR", "date": "DATE", "double": "DOUBLE", "long": "BIGINT"}[dtype]
        cols.append(f"CAST({chr(39) + name + chr(39) if out == 'section' else columns.get(out, 'NULL')} AS {duck}) AS {out}")
    return (f"SELECT {', '.join(cols)} FROM {table} WHERE project_id = '{PROJECT_360_ID}' "
            f"AND EXISTS (SELECT 1 FROM projects WHERE project_id = '{PROJECT_360_ID}')")


_NAMES = {c: c for c in ("project_id", "title", "country", "official_url")}


@register("project_360_records", " UNION ALL ".join([
    _section_sql("project", "projects", record_id="project_id", region="region", sector="sector", amount="total_amount", **_NAMES),
    _section_sql("features", "features", project_id="project_id", record_id="project_id", notice_count="notice_count", award_count="award_count",
                 amount="round(award_amount, 2)", linkage_status="linkage_status", quality_score="quality_score"),
    _section_sql("notice", "notices", record_id="notice_id", category="category", sector="sector", event_date="publication_date",
                 quality_score="quality_score", **_NAMES),
    _section_sql("award", "awards", record_id="award_id", project_id="project_id", title="description", country="country", category="category",
                 supplier="supplier", event_date="signed_date", amount="amount", official_url="official_url")]))
def q_project_360_records(spark, sf, project_id: str = PROJECT_360_ID):
    i = ing(spark, sf)
    features = i.features().withColumn("award_amount", F.round("award_amount", 2))
    return readmodels.project_360(i.projects(), features, i.notices(), i.awards(), project_id)


_COS = ("list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / "
        "(sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * "
        "sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))))")
_CORPUS_SQL = """
corpus AS (
  SELECT CAST(vec_id AS VARCHAR) AS chunk_id, 'vector' AS record_type, CAST(vec_id AS VARCHAR) AS record_id,
         CAST(vec_id % 10 AS VARCHAR) AS project_id, 'L' || CAST(label AS VARCHAR) AS country,
         'https://example.org/vectors/' || CAST(vec_id AS VARCHAR) AS official_url, embedding,
         'driver-64d' AS embedding_model, label
  FROM embeddings
),
rq AS (
  SELECT e.vec_id AS query_id, e.embedding AS q_embedding, e.label AS q_label,
         CASE WHEN e.vec_id % 2 = 1 THEN 'L' || CAST(e.label AS VARCHAR) END AS country_filter,
         CAST(NULL AS VARCHAR) AS project_filter, 'driver-64d' AS q_model
  FROM embeddings e JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label) m
    ON e.vec_id = m.vec_id
  UNION ALL
  SELECT -1, embedding, label, 'L-unknown', NULL, 'driver-64d' FROM embeddings
  WHERE vec_id = (SELECT min(vec_id) FROM embeddings)
),
scored AS (
  SELECT q.query_id, q.q_label, q.country_filter, c.*, """ + _COS.format(a="c.embedding", b="q.q_embedding") + """ AS score
  FROM rq q JOIN corpus c ON c.embedding_model = q.q_model
   AND (q.country_filter IS NULL OR lower(c.country) = lower(q.country_filter))
   AND (q.project_filter IS NULL OR c.project_id = q.project_filter)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored
)
"""


def _with_corpus(select: str) -> str:
    return "," + _CORPUS_SQL + select


VECTOR_DIMENSIONS = 64


def corpus(spark, sf) -> DataFrame:
    e = read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    vid = F.col("vec_id").cast("string")
    return e.select(vid.alias("chunk_id"), F.lit("vector").alias("record_type"), vid.alias("record_id"),
                    (F.col("vec_id") % 10).cast("string").alias("project_id"),
                    F.concat(F.lit("L"), F.col("label").cast("string")).alias("country"),
                    F.concat(F.lit("https://example.org/vectors/"), vid).alias("official_url"),
                    "embedding", F.lit("driver-64d").alias("embedding_model"), "label")


def first_vector(spark, sf) -> list[float]:
    """The query vector of a single search: the first stored vector (64 floats,
    collected as the query literal; a top-1 by id, not a scan to the driver)."""
    row = read_table(spark, sf, "embeddings", "vec_id", "embedding").orderBy("vec_id").limit(1).first()
    return [float(x) for x in row["embedding"]]


def labelled_queries(spark, sf) -> DataFrame:
    """The evaluation set, derived from the data: one query per label (its
    first vector; odd ids are filtered to their own label), plus one query
    whose filter matches nothing. Its size is the number of labels."""
    e = read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    firsts = e.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select("vec_id")
    base = e.join(firsts, "vec_id").select(
        F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("q_label"),
        F.when(F.col("vec_id") % 2 == 1, F.concat(F.lit("L"), F.col("label").cast("string"))).alias("country_filter"))
    first_all = e.agg(F.min("vec_id").alias("vec_id"))
    unsupported = e.join(first_all, "vec_id").select(
        F.lit(-1).cast("long").alias("query_id"), "embedding", F.col("label").alias("q_label"),
        F.lit("L-unknown").alias("country_filter"))
    return base.unionByName(unsupported).withColumn("project_filter", F.lit(None).cast("string")) \
        .withColumn("embedding_model", F.lit("driver-64d"))


@register("query_cross_join",
          _with_corpus("SELECT chunk_id, round(" + _COS.format(a="c.embedding", b="q.embedding") + ", 4) AS score "
                       "FROM corpus c JOIN (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ON TRUE"))
def q_query_cross_join(spark, sf):
    c = corpus(spark, sf)
    # the one query vector (64 floats) becomes a literal: the corpus is scored in place
    qv = first_vector(spark, sf)
    lit = F.array(*[F.lit(float(x)) for x in qv])
    return c.select("chunk_id", F.round(retrieval.cosine(F.col("embedding"), lit), 4).alias("score"))


# --- Fixed values: country alias table (label -> atlas name) ---
COUNTRY_ALIASES = [("nation_1", "nation 1"), ("nation_2", "nation 2"), ("nation_3", "nation 3"),
                   ("nation_5", "nation 5"), ("nation_8", "nation 8"), ("nation_13", "nation 13"),
                   ("nation_21", "nation 21")]
# --- Fixed values: FX rates to USD and the region -> currency rule ---
FX_RATES = [("EUR", 1.1), ("GBP", 1.25), ("JPY", 0.0068)]
REGION_CURRENCY = [("Region 0", "USD"), ("Region 1", "EUR"), ("Region 2", "GBP"), ("Region 3", "JPY")]


def _values_sql(rows, cols, alias="t"):
    vals = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)
    return f"(VALUES {vals}) AS {alias}({', '.join(cols)})"


@register("country_conform",
          "SELECT a.atlas_id, sum(cc.records) AS records FROM "
          "(SELECT country, count(*) AS records FROM chunks WHERE regexp_replace(coalesce(country, ''), '^\\s+|\\s+$', '', 'g') <> '' GROUP BY country) cc "
          f"LEFT JOIN {_values_sql(COUNTRY_ALIASES, ['label', 'atlas_name'], 'al')} ON lower(regexp_replace(cc.country, '^\\s+|\\s+$', '', 'g')) = al.label "
          "JOIN (SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS atlas_id, lower(replace(n_name, '_', ' ')) AS atlas_name FROM nation) a "
          "ON a.atlas_name = coalesce(al.atlas_name, lower(regexp_replace(cc.country, '^\\s+|\\s+$', '', 'g'))) GROUP BY a.atlas_id")
def q_country_conform(spark, sf):
    from .catalog import country_counts
    counts = country_counts(ing(spark, sf).chunks())
    aliases = spark.createDataFrame(COUNTRY_ALIASES, "label string, atlas_name string")
    atlas = read_table(spark, sf, "nation", "n_nationkey", "n_name").select(
        F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("atlas_id"),
        F.lower(F.regexp_replace("n_name", "_", " ")).alias("atlas_name"))
    return enrichment.country_conform(counts, aliases, atlas)


@register("fx_convert",
          "SELECT w.award_id, round(w.amount, 2) AS amount, r.currency, "
          "round(CASE WHEN w.amount IS NOT NULL AND r.currency IS NOT NULL AND r.currency <> 'USD' "
          "THEN CAST(round(CAST(w.amount AS DECIMAL(20,2)) * CAST(fx.usd_rate AS DECIMAL(20,8)), 2) AS DOUBLE) "
          "ELSE w.amount END, 2) AS usd_amount "
          "FROM awards w JOIN projects p USING (project_id) "
          f"LEFT JOIN {_values_sql(REGION_CURRENCY, ['region', 'currency'], 'r')} ON p.region = r.region "
          f"LEFT JOIN {_values_sql(FX_RATES, ['currency', 'usd_rate'], 'fx')} ON r.currency = fx.currency")
def q_fx_convert(spark, sf):
    i = ing(spark, sf)
    currency = spark.createDataFrame(REGION_CURRENCY, "region string, currency string")
    rates = spark.createDataFrame(FX_RATES, "currency string, usd_rate double")
    awards = i.awards().join(i.projects().select("project_id", "region"), "project_id") \
        .join(F.broadcast(currency), "region", "left")
    return enrichment.fx_convert(awards, rates).select(
        "award_id", F.round("amount", 2).alias("amount"), "currency", F.round("usd_amount", 2).alias("usd_amount"))


INDICATORS = {"gdp": "ORDER_VALUE", "population": "ORDER_COUNT"}
_INDICATOR_SQL = ("(SELECT n.n_name AS country, year(o.o_orderdate) AS year, "
                  "CASE WHEN year(o.o_orderdate) % 5 = 0 THEN NULL ELSE round(sum(o.o_totalprice), 2) END AS gdp, "
                  "CASE WHEN year(o.o_orderdate) % 3 = 0 THEN NULL ELSE CAST(count(*) AS DOUBLE) END AS population "
                  "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey "
                  "GROUP BY n.n_name, year(o.o_orderdate))")


@register("country_context",
          "SELECT p.country, CASE WHEN regexp_matches(p.country, '(?i)region|africa$') THEN 'regional' "
          "WHEN a.country IS NULL THEN 'unavailable' ELSE 'ready' END AS context_status, "
          + ", ".join(f"CASE WHEN NOT regexp_matches(p.country, '(?i)region|africa$') AND a.country IS NOT NULL THEN {v} END AS {n}" for v, n in (
              ("a.code", "code"), ("a.region", "region"), ("a.currencies", "currencies"), ("i.gdp", "gdp"), ("i.gdp_year", "gdp_year"),
              ("i.population", "population"), ("i.population_year", "population_year")))
          + " FROM (SELECT DISTINCT country FROM projects) p LEFT JOIN "
          "(SELECT n_name AS country, upper(substr(n_name, 1, 2)) AS code, r_name AS region, c.currency AS currencies FROM nation "
          "JOIN region ON n_regionkey = r_regionkey LEFT JOIN "
          f"{_values_sql(REGION_CURRENCY, ['region', 'currency'], 'c')} ON c.region = 'Region ' || CAST(n_regionkey AS VARCHAR) "
          "WHERE n_nationkey % 6 <> 5) a ON p.country = a.country LEFT JOIN "
          "(SELECT country, arg_max(gdp, year) FILTER (gdp IS NOT NULL) AS gdp, max(year) FILTER (gdp IS NOT NULL) AS gdp_year, "
          "arg_max(population, year) FILTER (population IS NOT NULL) AS population, max(year) FILTER (population IS NOT NULL) AS population_year "
          f"FROM {_INDICATOR_SQL} GROUP BY country) i ON p.country = i.country")
def q_country_context(spark, sf):
    """Every sixth nation is left out of the attributes, as a service may not know a country."""
    i = ing(spark, sf)
    o = read_table(spark, sf, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    c = read_table(spark, sf, "customer", "c_custkey", "c_nationkey")
    n = read_table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf, "region", "r_regionkey", "r_name")
    by_year = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")) \
        .groupBy(F.col("n_name").alias("country"), F.year("o_orderdate").alias("year")) \
        .agg(F.round(F.sum("o_totalprice"), 2).alias("value"), F.count(F.lit(1)).cast("double").alias("orders"))
    long = by_year.select("country", "year", F.explode(F.array(
        F.struct(F.lit("ORDER_VALUE").alias("indicator"), F.when(F.col("year") % 5 != 0, F.col("value")).alias("value")),
        F.struct(F.lit("ORDER_COUNT").alias("indicator"), F.when(F.col("year") % 3 != 0, F.col("orders")).alias("value")))).alias("x")) \
        .select("country", "year", "x.*")
    currency = spark.createDataFrame(REGION_CURRENCY, "region string, currencies string")
    attributes = n.filter(F.col("n_nationkey") % 6 != 5).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("country"), F.upper(F.substring("n_name", 1, 2)).alias("code"), F.col("r_name").alias("region"),
        F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")).alias("_r"))
    attributes = attributes.join(F.broadcast(currency.withColumnRenamed("region", "_r")), "_r", "left").drop("_r")
    return enrichment.country_context(i.projects().select("country").distinct(), long, attributes, INDICATORS)


_PNUM = "CAST(substr(p.project_id, 2) AS BIGINT)"


@register("project_context",
          "SELECT p.project_id, CASE WHEN {n} % 11 = 0 THEN 'unavailable' ELSE 'ready' END AS context_status, "
          "CASE WHEN {n} % 11 <> 0 THEN title END AS title, "
          "CASE WHEN {n} % 11 <> 0 THEN CASE WHEN {n} % 3 = 0 THEN sector ELSE lower(sector) END END AS sector, "
          "CASE WHEN {n} % 11 <> 0 THEN d.approval END AS approval_date, "
          "CASE WHEN {n} % 11 <> 0 THEN CASE {n} % 4 WHEN 0 THEN 'Active' WHEN 1 THEN 'Closed' WHEN 2 THEN 'Pipeline' END END AS status "
          "FROM projects p LEFT JOIN (SELECT 'P' || CAST(100000 + o_custkey AS VARCHAR) AS project_id, min(CAST(o_orderdate AS DATE)) AS approval "
          "FROM orders GROUP BY o_custkey) d ON p.project_id = d.project_id".replace("{n}", _PNUM))
def q_project_context(spark, sf):
    p = ing(spark, sf).projects()
    num = F.substring("project_id", 2, 10).cast("long")
    first = read_table(spark, sf, "orders", "o_custkey", "o_orderdate").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("boardapprovaldate")) \
        .select(F.concat(F.lit("P"), (F.col("o_custkey") + 100000).cast("string")).alias("project_id"), "boardapprovaldate")
    api = p.filter(num % 11 != 0).join(first, "project_id", "left").select(
        "project_id", "boardapprovaldate",
        F.when(num % 2 == 0, F.col("title")).alias("proj_name"),
        F.col("title").alias("project_name"),
        F.when(num % 3 == 0, F.struct(F.col("sector").alias("Name"))).alias("sector1"),
        F.when(num % 3 != 0, F.lower("sector")).alias("sector_name"),
        F.when(num % 4 == 0, F.lit("Active")).when(num % 4 == 1, F.lit("Closed")).when(num % 4 == 2, F.lit("Pipeline")).alias("status"))
    return enrichment.project_context(p, api)


# =============================================================================== 2.5 aggregates

@register("project_features",
          "SELECT project_id, notice_count, award_count, supplier_count, round(award_amount, 2) AS award_amount, "
          "missing_field_ratio, linkage_status, quality_score FROM features")
def q_project_features(spark, sf):
    return ing(spark, sf).features().withColumn("award_amount", F.round("award_amount", 2))


@register("supplier_count", "SELECT project_id, supplier_count FROM features WHERE award_count > 0")
def q_supplier_count(spark, sf):
    return curate.award_summary(ing(spark, sf).awards()).select("project_id", "supplier_count")


@register("award_totals", "SELECT project_id, round(award_amount, 2) AS award_amount FROM features WHERE award_count > 0")
def q_award_totals(spark, sf):
    return curate.award_summary(ing(spark, sf).awards()).select("project_id", F.round("award_amount", 2).alias("award_amount"))


@register("disposition_counts",
          "SELECT run_id, count(*) FILTER (WHERE disposition = 'quarantined') AS quarantined, "
          "count(*) FILTER (WHERE disposition = 'rejected') AS rejected FROM dispositions GROUP BY run_id")
def q_disposition_counts(spark, sf):
    d = ing(spark, sf).dispositions()
    return d.groupBy("run_id").pivot("disposition", ["quarantined", "rejected"]).agg(F.count(F.lit(1))) \
        .select("run_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("quarantined", "rejected")])


_READ_SQL = "((SELECT count(*) FROM raw_notice) + (SELECT count(*) FROM raw_award))"
_LOADED_SQL = "((SELECT count(*) FROM loaded_notice) + (SELECT count(*) FROM loaded_award))"
_ACCOUNTING_SQL = """
SELECT '{run}' AS run_id, {read} AS records_read, sum(n) FILTER (WHERE disposition = 'loaded') AS loaded,
       sum(n) FILTER (WHERE disposition = 'quarantined') AS quarantined,
       sum(n) FILTER (WHERE disposition = 'rejected') AS rejected,
       sum(n) AS accounted, CAST({read} - sum(n) AS BIGINT) AS balance_delta,
       CASE WHEN {read} = sum(n) THEN 'balanced' ELSE 'unbalanced' END AS reconciliation_status
FROM routing
""".format(run=RUN_ID, read=_READ_SQL)


@register("record_accounting", _ACCOUNTING_SQL)
def q_record_accounting(spark, sf):
    acc = evidence.record_accounting(ing(spark, sf))
    return acc.select("run_id", "records_read", "loaded", "quarantined", "rejected", "accounted", "balance_delta",
                      "reconciliation_status")


_KEYS_SQL = ("SELECT DISTINCT unnest(json_keys(to_json(r))) AS key FROM (SELECT * EXCLUDE (ingest_seq) FROM raw_notice) r "
             "UNION SELECT DISTINCT unnest(json_keys(to_json(a))) FROM (SELECT * EXCLUDE (ingest_seq) FROM raw_award) a")


@register("schema_fingerprint",
          "SELECT sha256('[' || string_agg('\"' || key || '\"', ', ' ORDER BY key) || ']') AS schema_hash, "
          f"count(*) AS key_count FROM ({_KEYS_SQL})")
def q_schema_fingerprint(spark, sf):
    return evidence.schema_fingerprint(adapters.raw_notices(spark, sf), adapters.raw_awards(spark, sf))


@register("schema_drift",
          "SELECT key, 'added' AS change FROM (SELECT DISTINCT unnest(json_keys(to_json(a))) AS key FROM "
          "(SELECT * EXCLUDE (ingest_seq) FROM raw_award) a) WHERE key NOT IN (SELECT DISTINCT unnest(json_keys(to_json(r))) "
          "FROM (SELECT * EXCLUDE (ingest_seq) FROM raw_notice) r) UNION ALL "
          "SELECT key, 'removed' FROM (SELECT DISTINCT unnest(json_keys(to_json(r))) AS key FROM "
          "(SELECT * EXCLUDE (ingest_seq) FROM raw_notice) r) WHERE key NOT IN (SELECT DISTINCT unnest(json_keys(to_json(a))) "
          "FROM (SELECT * EXCLUDE (ingest_seq) FROM raw_award) a)")
def q_schema_drift(spark, sf):
    """Keys added / removed going from the notice feed to the award feed."""
    return evidence.schema_drift(adapters.raw_notices(spark, sf), adapters.raw_awards(spark, sf))


_HEX = "CAST(('0x' || substr(h, {s}, 15)) AS HUGEINT)"
_LISTS = ("supp_name", "mjsecname")


def _checksum_sql(kind: str, table: str, columns: list[str]) -> str:
    texts = [f"coalesce(array_to_string({c}, chr(2)), chr(0))" if c in _LISTS else f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in columns]
    return (f"SELECT '{kind}' AS record_type, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), "
            + ", ".join(f"CAST(coalesce(sum({_HEX.format(s=1 + 15 * i)}), 0) AS VARCHAR)" for i in range(4))
            + f")) AS digest, count(*) AS rows FROM (SELECT sha256(concat_ws(chr(1), {', '.join(texts)})) AS h FROM {table})")


@register("payload_checksum", _checksum_sql("notice", "raw_notice", adapters.NOTICE_COLUMNS) + " UNION ALL "
          + _checksum_sql("award", "raw_award", adapters.AWARD_COLUMNS))
def q_payload_checksum(spark, sf):
    """Both feeds, order-insensitive; a list's items are joined by U+0002."""
    out = None
    for kind, raw, columns in (("notice", adapters.raw_notices(spark, sf), adapters.NOTICE_COLUMNS),
                               ("award", adapters.raw_awards(spark, sf), adapters.AWARD_COLUMNS)):
        flat = raw.select(*[F.when(F.col(c).isNotNull(), F.array_join(c, "\u0002")).alias(c) if c in _LISTS else F.col(c) for c in columns])
        one = evidence.payload_checksum(flat, columns).select(F.lit(kind).alias("record_type"), "digest", "rows")
        out = one if out is None else out.unionByName(one)
    return out


def _two_runs(spark, sf, ledger_of):
    """Ledger rows of two runs: the first before amendments were published and without a sector, the second without a country code."""
    n, a = adapters.raw_notices(spark, sf), adapters.raw_awards(spark, sf)
    awards = a.select(F.lit("award").alias("record_type"), F.col("contr_id").alias("record_id"), "raw_json",
                      *[F.lit(None).cast("string").alias(c) for c in adapters.NOTICE_COLUMNS], F.array_join("supp_name", "\u0002").alias("supplier"))
    out = None
    for run, rows, gone in (("run-1", n.filter(F.col("procurement_method") != "AMENDED"), "sector"), ("run-2", n, "country_code")):
        kept = [c for c in adapters.NOTICE_COLUMNS if c != gone]
        notices = rows.select(F.lit("notice").alias("record_type"), F.col("id").alias("record_id"), adapters.raw_json_of(*kept).alias("raw_json"),
                              *[F.col(c) for c in adapters.NOTICE_COLUMNS], F.lit(None).cast("string").alias("supplier"))
        one = ledger_of(notices.unionByName(awards), run)
        out = one if out is None else out.unionByName(one)
    return out


_RUN_1 = "(SELECT * FROM raw_notice WHERE procurement_method <> 'AMENDED')"


@register("source_key_drift",
          f"SELECT 'notice' AS record_type, 'country_code' AS key, 'removed' AS change, count(country_code) AS before_records, 0 AS after_records FROM {_RUN_1} "
          "UNION ALL SELECT 'notice', 'sector', 'added', 0, count(sector) FROM raw_notice")
def q_source_key_drift(spark, sf):
    return drift.key_changes(_two_runs(spark, sf, drift.source_keys), "run-1", "run-2")


_DRIFT_TEXT = ["id", "project_id", "publication_date", "procurement_method"]


def _bucket_sql(table: str) -> str:
    texts = [f"coalesce({c}, chr(0))" for c in _DRIFT_TEXT]
    return ("SELECT bucket, count(*) AS records, concat_ws(':', " + ", ".join(f"CAST(sum({_HEX.format(s=1 + 15 * i)}) AS VARCHAR)" for i in range(4))
            + f") AS digest FROM (SELECT substr(sha256(coalesce(id, '')), 1, 2) AS bucket, sha256(concat_ws(chr(1), {', '.join(texts)})) AS h FROM {table}) GROUP BY bucket")


@register("source_bucket_drift",
          "SELECT 'notice' AS record_type, coalesce(b.bucket, a.bucket) AS bucket, CASE WHEN b.bucket IS NULL THEN 'added' "
          "WHEN a.bucket IS NULL THEN 'removed' ELSE 'changed' END AS change, coalesce(b.records, 0) AS before_records, "
          f"coalesce(a.records, 0) AS after_records FROM ({_bucket_sql(_RUN_1)}) b FULL JOIN ({_bucket_sql('raw_notice')}) a ON a.bucket = b.bucket "
          "WHERE a.digest IS DISTINCT FROM b.digest")
def q_source_bucket_drift(spark, sf):
    text = F.sha2(evidence.canonical_row_text([*_DRIFT_TEXT, "supplier"]), 256)
    ledger = _two_runs(spark, sf, lambda records, run: drift.source_buckets(records, run, text))
    return drift.bucket_changes(ledger, "run-1", "run-2")


@register("token_vocabulary",
          "SELECT token, CAST(CAST(('0x' || substr(sha256(token), 1, 8)) AS BIGINT) % 256 AS INTEGER) AS bucket FROM "
          "(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS token FROM chunks)")
def q_token_vocabulary(spark, sf):
    return retrieval.token_vocabulary(ing(spark, sf).chunks())


def _batch_results(spark, sf, k: int = 8):
    qs = labelled_queries(spark, sf)
    res = retrieval.semantic_search_batch(corpus(spark, sf), qs, k=k)
    return qs, res.join(qs.select("query_id", "q_label"), "query_id") \
        .withColumn("relevant", F.col("label") == F.col("q_label"))


@register("retrieval_metrics", _with_corpus(
    "SELECT round(avg(coalesce(hits, 0) / 5.0), 3) AS precision_at_5, "
    "round(avg(coalesce(1.0 / first_rank, 0.0)), 3) AS mrr, "
    "round(avg(CAST(coalesce(cited, TRUE) AS DOUBLE)), 3) AS citation_coverage, "
    "round(avg(CAST(coalesce(filtered, TRUE) AS DOUBLE)), 3) AS metadata_filter_accuracy, "
    "round(avg(CAST(hits IS NULL AS DOUBLE)), 3) AS zero_result_rate, "
    "round(sum(coalesce(dupes, 0)) / (5.0 * count(*)), 3) AS duplicate_result_rate "
    "FROM (SELECT query_id FROM rq) q LEFT JOIN ("
    "  SELECT query_id, sum(CASE WHEN label = q_label THEN 1 ELSE 0 END) AS hits, "
    "  min(CASE WHEN label = q_label THEN rank END) AS first_rank, "
    "  bool_and(starts_with(official_url, 'https://')) AS cited, "
    "  bool_and(country_filter IS NULL OR lower(country) = lower(country_filter)) AS filtered, "
    "  count(*) - count(DISTINCT record_id) AS dupes "
    "  FROM ranked WHERE rank <= 5 AND score >= 0.25 GROUP BY query_id) r USING (query_id)"))
def q_retrieval_metrics(spark, sf):
    qs, res = _batch_results(spark, sf)
    return retrieval.retrieval_metrics(res, qs, k=5)


@register("label_intersection", _with_corpus(
    "SELECT query_id, count(*) FILTER (WHERE label = q_label) AS relevant_retrieved FROM ranked "
    "WHERE rank <= 5 AND score >= 0.25 GROUP BY query_id"))
def q_label_intersection(spark, sf):
    _, res = _batch_results(spark, sf)
    return res.filter(F.col("rank") <= 5).groupBy("query_id").agg(
        F.sum(F.when(F.col("relevant"), 1).otherwise(0)).cast("long").alias("relevant_retrieved"))


# =============================================================================== 2.7 sort / limit / top-k

@register("vector_topk", _with_corpus(
    "SELECT query_id, rank, chunk_id, round(score, 4) AS score FROM ranked WHERE rank <= 5"))
def q_vector_topk(spark, sf, k: int = 5):
    res = retrieval.semantic_search_batch(corpus(spark, sf), labelled_queries(spark, sf), k=k, min_score=-2.0)
    return res.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id",
                      F.col("retrieval_score").alias("score"))


@register("semantic_search_batch", _with_corpus(
    "SELECT query_id, rank, chunk_id, record_id, round(score, 4) AS retrieval_score FROM ranked "
    "WHERE rank <= 8 AND score >= 0.25"))
def q_semantic_search_batch(spark, sf):
    res = retrieval.semantic_search_batch(corpus(spark, sf), labelled_queries(spark, sf), k=8)
    return res.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "record_id", "retrieval_score")


@register("abstention", _with_corpus(
    "SELECT q.query_id, coalesce(r.n, 0) AS result_count, coalesce(r.n, 0) = 0 AS abstained FROM rq q "
    "LEFT JOIN (SELECT query_id, count(*) AS n FROM ranked WHERE rank <= 8 AND score >= 0.25 GROUP BY query_id) r "
    "USING (query_id)"))
def q_abstention(spark, sf):
    qs = labelled_queries(spark, sf)
    res = retrieval.semantic_search_batch(corpus(spark, sf), qs, k=8)
    return retrieval.abstention(qs, res).select("query_id", "result_count", "abstained")


_ANN: dict = {}


def ann_index(spark, sf) -> DataFrame:
    """The signature index of the corpus, written once a session and tables folder."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key not in _ANN:
        _ANN[key] = retrieval.ann_index(corpus(spark, sf), scratch_path(spark, "ann-index"), VECTOR_DIMENSIONS)
    return _ANN[key]


def ann_queries(spark, sf) -> DataFrame:
    """The approximate search's query set: every vector whose id is divisible by 100."""
    e = read_table(spark, sf, "embeddings", "vec_id", "embedding").filter(F.col("vec_id") % 100 == 0)
    none = F.lit(None).cast("string")
    return e.select(F.col("vec_id").alias("query_id"), "embedding", none.alias("country_filter"), none.alias("project_filter"),
                    F.lit("driver-64d").alias("embedding_model"))


@register("ann_recall")
def q_ann_recall(spark, sf, k: int = 8):
    """Per query: how many of the exact best k the approximate search found, and the share of the corpus that it scored."""
    qs, index = ann_queries(spark, sf), ann_index(spark, sf)
    # read twice: written once
    exact = scratch_table(retrieval.semantic_search_batch(corpus(spark, sf), qs, k=k).select("query_id", "chunk_id"), "ann-exact")
    approx = retrieval.ann_search(index, qs, VECTOR_DIMENSIONS, k).select("query_id", "chunk_id")
    scored = retrieval.ann_candidates(index, qs, VECTOR_DIMENSIONS).groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))
    hits = exact.join(approx, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    totals = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    return totals.join(hits, "query_id", "left").join(scored, "query_id", "left").select(
        "query_id", "relevant", F.coalesce("hits", F.lit(0)).alias("found"), F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.round(F.coalesce("hits", F.lit(0)) / F.col("relevant"), 3).alias("recall"))


@register("ann_search")
def q_ann_search(spark, sf, k: int = 8):
    return retrieval.ann_search(ann_index(spark, sf), ann_queries(spark, sf), VECTOR_DIMENSIONS, k)


@register("hash_embed",
          "SELECT chunk_id, bucket, round(cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY chunk_id)), 5) AS weight FROM ("
          "SELECT chunk_id, CAST(CAST(('0x' || substr(sha256(token), 1, 8)) AS BIGINT) % 256 AS INTEGER) AS bucket, "
          "CAST(count(*) AS DOUBLE) AS cnt FROM (SELECT chunk_id, unnest(list_distinct(regexp_extract_all(lower(text), "
          "'[a-z0-9]{2,}'))) AS token FROM chunks) GROUP BY ALL)")
def q_hash_embed(spark, sf):
    emb = retrieval.hash_embed(ing(spark, sf).chunks())
    return emb.select("chunk_id", F.posexplode("embedding").alias("bucket", "weight")) \
        .filter(F.col("weight") > 0).select("chunk_id", "bucket", F.round(F.col("weight").cast("double"), 5).alias("weight"))


# =============================================================================== feeds

@register("issues_feed", f"SELECT {', '.join(ISSUE_OUT)} FROM issues ORDER BY run_id DESC, issue_id DESC LIMIT 500")
def q_issues_feed(spark, sf, limit: int = 500):
    return ing(spark, sf).issues().orderBy(F.col("run_id").desc(), F.col("issue_id").desc()).limit(limit) \
        .select(*ISSUE_OUT)


@register("run_quarantine",
          f"SELECT record_type, record_id, disposition, reason, ingest_seq FROM dispositions WHERE run_id = '{RUN_ID}'")
def q_run_quarantine(spark, sf):
    d = ing(spark, sf).dispositions().filter(F.col("run_id") == RUN_ID)
    return d.orderBy("record_type", "ingest_seq").select("record_type", "record_id", "disposition", "reason", "ingest_seq")


@register("run_mappings",
          f"SELECT mapping_id, mapping_version FROM (VALUES ('contract_award', '1.0.0'), ('procurement_notice', '1.1.0')) "
          "AS t(mapping_id, mapping_version)")
def q_run_mappings(spark, sf):
    m = evidence.mapping_executions(ing(spark, sf))
    return m.filter(F.col("run_id") == RUN_ID).orderBy("mapping_id").select("mapping_id", "mapping_version")


@register("project_id_universe", "SELECT project_id FROM notices UNION SELECT project_id FROM awards")
def q_project_id_universe(spark, sf):
    i = ing(spark, sf)
    return curate.project_id_universe(i.notices(), i.awards())


@register("chunk_union", "SELECT record_type, count(*) AS chunks FROM chunks GROUP BY record_type")
def q_chunk_union(spark, sf):
    return ing(spark, sf).chunks().groupBy("record_type").agg(F.count(F.lit(1)).alias("chunks"))


@register("build_chunks", "SELECT chunk_id, record_type, record_id, project_id, text, official_url, country FROM chunks")
def q_build_chunks(spark, sf):
    return ing(spark, sf).chunks()


@register("regional_label",
          "SELECT project_id, region, regexp_matches(region, '(?i)region|africa$') AS is_regional FROM projects")
def q_regional_label(spark, sf):
    return enrichment.regional_label(ing(spark, sf).projects(), "region").select("project_id", "region", "is_regional")


@register("notice_search",
          "SELECT notice_id, project_id, country, publication_date FROM notices WHERE country ILIKE '%nation\\_1%' ESCAPE '\\' "
          "ORDER BY publication_date DESC NULLS LAST, notice_id LIMIT 50 OFFSET 10")
def q_notice_search(spark, sf):
    from ..operators.readmodels import notice_search
    return notice_search(ing(spark, sf).notices(), country="nation_1", limit=50, offset=10) \
        .select("notice_id", "project_id", "country", "publication_date")


# =============================================================================== 2.11 evidence

_EVIDENCE: dict = {}


def _evidence_parts(spark, sf):
    """Per-run evidence frames (a few rows each), built once per session and
    tables folder and persisted, since gates, UAT and readiness all read them."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key not in _EVIDENCE:
        i, acc, runs, maps, g = _build_evidence_parts(spark, sf)
        _EVIDENCE[key] = (i, acc, runs.persist(), maps.persist(), g.persist())
    return _EVIDENCE[key]


def _build_evidence_parts(spark, sf):
    i = ing(spark, sf)
    landed = i.landed_facts()
    acc = evidence.record_accounting(i).persist()  # a row, read by the ledger as well
    checksum = evidence.run_checksum(i, landed)
    schema = evidence.fingerprint_of_keys(landed.select("keys"))
    runs = evidence.run_ledger(i, checksum, schema, accounting=acc)
    maps = evidence.mapping_executions(i)
    g = evidence.gates(acc, runs, maps, EXPECTED_CONTRACTS)
    return i, acc, runs, maps, g


_GATE_SQL = {
    "REC-001": f"{_READ_SQL} = {_LOADED_SQL} + (SELECT count(*) FROM dispositions)",
    "REC-002": f"{_LOADED_SQL} = (SELECT sum(n) FILTER (WHERE disposition = 'loaded') FROM routing)",
    "QUA-001": "(SELECT count(*) FROM dispositions) = (SELECT sum(n) FILTER (WHERE disposition <> 'loaded') FROM routing)",
    "MAP-001": f"(SELECT count(*) FROM (VALUES ('{NOTICE_HASH}'), ('{AWARD_HASH}')) m(h) WHERE length(h) = 64) = {EXPECTED_CONTRACTS}",
    "INT-001": f"(SELECT count(*) FROM ({_KEYS_SQL})) > 0",
    "ERR-001": "(SELECT count(*) FROM dispositions WHERE disposition = 'rejected') = 0",
}
for _gid in _GATE_SQL:
    _k = "gate_" + _gid.replace("-", "").lower()

    def _mk(gid):
        def fn(spark, sf):
            g = _evidence_parts(spark, sf)[4]
            return g.filter(F.col("gate_id") == gid).select("run_id", "gate_id", "passed")
        return fn
    register(_k, f"SELECT '{RUN_ID}' AS run_id, '{_gid}' AS gate_id, {_GATE_SQL[_gid]} AS passed")(_mk(_gid))


@register("acceptance_status",
          f"SELECT '{RUN_ID}' AS run_id, CASE WHEN (SELECT count(*) FROM dispositions WHERE disposition = 'rejected') = 0 "
          "THEN CASE WHEN (SELECT count(*) FROM dispositions WHERE disposition = 'quarantined') > 0 "
          "THEN 'accepted_with_quarantine' ELSE 'accepted' END ELSE 'blocked' END AS acceptance_status")
def q_acceptance_status(spark, sf):
    return evidence.acceptance(_evidence_parts(spark, sf)[4])


@register("migration_evidence", _ACCOUNTING_SQL.replace(
    "AS reconciliation_status",
    "AS reconciliation_status, CASE WHEN sum(n) FILTER (WHERE disposition = 'rejected') = 0 THEN "
    "'accepted_with_quarantine' ELSE 'blocked' END AS acceptance_status"))
def q_migration_evidence(spark, sf):
    i, acc, runs, maps, g = _evidence_parts(spark, sf)
    ev = evidence.migration_evidence(acc, g, maps, i.run_at)
    return ev.select("run_id", "records_read", "loaded", "quarantined", "rejected", "accounted", "balance_delta",
                     "reconciliation_status", "acceptance_status")


_QUERYABLE_SQL = (f"{_LOADED_SQL} > 0 AND (SELECT count(*) FROM notices) + (SELECT count(*) FROM awards) >= {_LOADED_SQL}")


def _uat(spark, sf):
    i, acc, runs, maps, g = _evidence_parts(spark, sf)
    ev = evidence.migration_evidence(acc, g, maps, i.run_at)
    return evidence.uat_results(ev, maps, i.dispositions(), i.notices(), i.awards())


for _n, (_sid, _sql_pass) in enumerate([
        ("UAT-001", _GATE_SQL["REC-001"]), ("UAT-002", _GATE_SQL["MAP-001"]), ("UAT-003", _GATE_SQL["QUA-001"]),
        ("UAT-004", _QUERYABLE_SQL)], start=1):
    _key = "uat00%d_" % _n + ["reconciled", "contracts", "traceability", "queryable"][_n - 1]

    def _mk_uat(sid):
        def fn(spark, sf):
            return _uat(spark, sf).filter(F.col("scenario_id") == sid).select("run_id", "scenario_id", "status")
        return fn
    register(_key, f"SELECT '{RUN_ID}' AS run_id, '{_sid}' AS scenario_id, "
                   f"CASE WHEN {_sql_pass} THEN 'passed' ELSE 'failed' END AS status")(_mk_uat(_sid))


# =============================================================================== 2.12 review workflow

_REVIEW_SQL = """,
cmds AS (
  SELECT printf('REV-%05d', user_id) AS case_id, CAST(user_id AS VARCHAR) AS record_id, ts AS cmd_ts, event_id AS cmd_seq,
         'reviewer-' || CAST(user_id % 7 AS VARCHAR) AS actor,
         CASE event_type WHEN 'signup' THEN 'assign' WHEN 'view' THEN 'start' WHEN 'click' THEN 'accept'
              WHEN 'purchase' THEN 'reject_record' WHEN 'error' THEN 'accept_short' ELSE 'unknown' END AS command
  FROM events
),
c0 AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY cmd_ts, cmd_seq) AS rn FROM cmds),
requested AS (SELECT record_id, min(issue_id) AS validation_result_id FROM issues WHERE record_type = 'notice' GROUP BY record_id),
cases AS (
  SELECT c.case_id, r.validation_result_id, CASE WHEN c.command = 'assign' THEN 'assigned' ELSE 'open' END AS opened_as,
         CASE WHEN c.command = 'assign' THEN c.actor END AS opened_for, c.actor AS opened_by, c.cmd_ts AS created_at
  FROM c0 c JOIN requested r USING (record_id) WHERE c.rn = 1
),
c1 AS (
  SELECT c0.*, k.opened_as, k.opened_for,
    max(CASE WHEN command = 'start' THEN rn END) OVER w AS last_set,
    max(CASE WHEN command = 'assign' THEN rn END) OVER w AS last_assign
  FROM c0 LEFT JOIN cases k ON k.case_id = c0.case_id WHERE c0.rn > 1 WINDOW w AS (PARTITION BY c0.case_id ORDER BY c0.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
c2 AS (SELECT *, command IN ('accept', 'reject_record') AND opened_as IS NOT NULL
       AND (last_assign IS NOT NULL OR opened_for IS NOT NULL) AS eligible FROM c1),
c3 AS (
  SELECT *, max(CASE WHEN eligible THEN rn END) OVER (PARTITION BY case_id ORDER BY rn
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_elig FROM c2
),
c4 AS (
  SELECT *, eligible AND last_set IS NOT NULL AND (last_elig IS NULL OR last_elig < last_set) AS success,
         CASE WHEN command = 'reject_record' THEN 'rejected' ELSE 'resolved' END AS outcome FROM c3
),
c5 AS (
  SELECT *, CASE WHEN success THEN outcome WHEN command = 'start' THEN 'in_review' END AS new_status FROM c4
),
c6 AS (
  SELECT *, CASE WHEN opened_as IS NOT NULL THEN coalesce(last_value(new_status IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY rn
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), opened_as) END AS from_status FROM c5
),
evaluated AS (
  SELECT *,
    CASE WHEN opened_as IS NULL THEN 'Review case not found'
         WHEN command IN ('accept', 'reject_record', 'accept_short') AND from_status <> 'in_review'
           THEN 'Case must be in review before a decision'
         WHEN command IN ('accept', 'reject_record', 'accept_short') AND last_assign IS NULL AND opened_for IS NULL
           THEN 'An assigned reviewer is required'
         WHEN command = 'accept_short' THEN 'Resolution rationale must be at least 20 characters' END AS error,
    CASE WHEN command IN ('accept', 'reject_record', 'accept_short') THEN outcome
         WHEN command = 'start' THEN 'in_review' ELSE from_status END AS next_status
  FROM c6
),
history AS (
  SELECT case_id, 'case_created' AS event_type, created_at AS occurred_at, -2 AS seq, NULL AS from_status,
         opened_as AS to_status FROM cases
  UNION ALL SELECT case_id, 'assigned', created_at, -1, 'open', 'assigned' FROM cases WHERE opened_for IS NOT NULL
  UNION ALL SELECT case_id, CASE WHEN command IN ('assign', 'start') THEN 'case_updated' ELSE 'decision_recorded' END,
         cmd_ts, cmd_seq, from_status, next_status FROM evaluated WHERE error IS NULL
),
case_state AS (
  SELECT c.case_id, c.validation_result_id,
    coalesce((SELECT arg_max(next_status, rn) FROM evaluated e WHERE e.case_id = c.case_id AND e.error IS NULL), c.opened_as) AS status,
    greatest(c.created_at, (SELECT max(cmd_ts) FROM evaluated e WHERE e.case_id = c.case_id AND e.error IS NULL)) AS updated_at,
    coalesce((SELECT arg_max(actor, rn) FROM evaluated e WHERE e.case_id = c.case_id AND e.command = 'assign'), c.opened_for)
      AS assigned_to,
    (SELECT arg_max(CASE WHEN command = 'reject_record' THEN 'reject_record' ELSE 'accept_exception' END, rn)
       FROM evaluated e WHERE e.case_id = c.case_id AND e.error IS NULL AND e.command IN ('accept', 'reject_record')) AS resolution,
    (SELECT max(cmd_ts) FROM evaluated e WHERE e.case_id = c.case_id AND e.error IS NULL
       AND e.command IN ('accept', 'reject_record')) AS decided_at
  FROM cases c
)
"""


_CASES: dict = {}


def _review_inputs(spark, sf):
    """Requests, commands and cases; the requests and cases (a row per case)
    are persisted once per session and tables folder, as every review query
    reads them several times."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key not in _CASES:
        issues = review.read_issues(ing(spark, sf).issues())
        requests, cmds = adapters.review_inputs(spark, sf, issues)
        requests = requests.persist()
        _CASES[key] = (requests, cmds, review.open_cases(requests, issues).persist())
    return _CASES[key]


def _review(spark, sf):
    _, cmds, cases = _review_inputs(spark, sf)
    return cmds, cases, review.evaluate_commands(cmds, cases)


@register("open_review_cases", _REVIEW_SQL +
          "SELECT case_id, validation_result_id, opened_as AS status, 'medium' AS priority, opened_for AS assigned_to, "
          "created_at FROM cases")
def q_open_review_cases(spark, sf):
    return _review_inputs(spark, sf)[2].drop("control_id", "opened_by", "opened_seq")


@register("review_request_errors", _REVIEW_SQL +
          "SELECT case_id, cmd_ts AS requested_at, actor, 'Validation result not found' AS error FROM c0 "
          "WHERE rn = 1 AND record_id NOT IN (SELECT record_id FROM requested)")
def q_review_request_errors(spark, sf):
    requests = _review_inputs(spark, sf)[0]
    return review.request_errors(requests, ing(spark, sf).issues()).drop("validation_result_id")


@register("review_transitions", _REVIEW_SQL +
          "SELECT case_id, cmd_seq, command, error IS NULL AS accepted, from_status, "
          "CASE WHEN error IS NULL THEN next_status END AS to_status FROM evaluated")
def q_review_transitions(spark, sf):
    return _review(spark, sf)[2].select("case_id", "cmd_seq", "command", "accepted", "from_status", "to_status")


@register("review_command_errors", _REVIEW_SQL +
          "SELECT case_id, cmd_ts, cmd_seq, actor, command, error FROM evaluated WHERE error IS NOT NULL")
def q_review_command_errors(spark, sf):
    return review.command_errors(_review(spark, sf)[2])


@register("review_current_state", _REVIEW_SQL +
          "SELECT case_id, validation_result_id, status, assigned_to, resolution, decided_at FROM case_state")
def q_review_current_state(spark, sf):
    _, cases, ev = _review(spark, sf)
    return review.current_state(cases, ev).select("case_id", "validation_result_id", "status", "assigned_to",
                                                  "resolution", "decided_at")


@register("review_event_history", _REVIEW_SQL +
          "SELECT case_id, event_type, occurred_at, seq, from_status, to_status FROM history")
def q_review_event_history(spark, sf):
    _, cases, ev = _review(spark, sf)
    return review.event_history(cases, ev).select("case_id", "event_type", "occurred_at", "seq", "from_status",
                                                  "to_status")


@register("event_transitions", _REVIEW_SQL +
          "SELECT case_id, seq, from_status, to_status, lag(to_status) OVER (PARTITION BY case_id ORDER BY occurred_at, seq) "
          "AS previous_to_status FROM history")
def q_event_transitions(spark, sf):
    _, cases, ev = _review(spark, sf)
    t = review.event_transitions(review.event_history(cases, ev))
    return t.select("case_id", "seq", "from_status", "to_status", "previous_to_status")


@register("review_progress", _REVIEW_SQL +
          "SELECT count(*) FILTER (WHERE status IN ('resolved', 'rejected')) AS completed, count(*) AS total FROM case_state")
def q_review_progress(spark, sf):
    _, cases, ev = _review(spark, sf)
    st = review.current_state(cases, ev)
    return st.agg(F.sum(F.col("status").isin("resolved", "rejected").cast("long")).alias("completed"),
                  F.count(F.lit(1)).alias("total"))


@register("review_queue_order", _REVIEW_SQL +
          "SELECT case_id, status IN ('resolved', 'rejected') AS completed FROM case_state")
def q_review_queue_order(spark, sf):
    _, cases, ev = _review(spark, sf)
    st = review.current_state(cases, ev)
    done = F.col("status").isin("resolved", "rejected")
    return st.select("case_id", done.alias("completed"), "validation_result_id") \
        .orderBy("completed", "validation_result_id").select("case_id", "completed")


QUEUE_TEXT = "nation_"


@register("review_queue_filter", _REVIEW_SQL +
          "SELECT s.case_id, s.status FROM case_state s JOIN issues i ON i.issue_id = s.validation_result_id "
          "LEFT JOIN notices n ON n.notice_id = i.record_id WHERE lower(concat_ws(' ', s.case_id, i.record_id, "
          f"n.project_id, n.country, i.control_id, n.title, s.assigned_to)) LIKE '%{QUEUE_TEXT.replace('_', '~_')}%' ESCAPE '~' "
          "AND s.status NOT IN ('resolved', 'rejected') AND s.assigned_to IS NOT NULL")
def q_review_queue_filter(spark, sf):
    from ..operators.readmodels import review_queue, review_queue_filter
    _, cases, ev = _review(spark, sf)
    i = ing(spark, sf)
    queue = review_queue(review.current_state(cases, ev), i.issues(), i.notices())
    return review_queue_filter(queue, text=QUEUE_TEXT, status="open", owner="assigned").select("case_id", "status")


@register("review_list", _REVIEW_SQL +
          "SELECT s.case_id, s.status, i.control_id, i.severity, i.record_id FROM case_state s "
          "JOIN issues i ON i.issue_id = s.validation_result_id WHERE s.status = 'in_review' "
          "ORDER BY s.updated_at DESC, s.case_id LIMIT 50")
def q_review_list(spark, sf, status: str = "in_review", limit: int = 50):
    _, cases, ev = _review(spark, sf)
    return review.review_list(review.current_state(cases, ev), ing(spark, sf).issues(), status, limit) \
        .select("case_id", "status", "control_id", "severity", "record_id")


# =============================================================================== runs, UAT feed, sign-off, readiness

@register("latest_run", f"SELECT '{RUN_ID}' AS run_id")
def q_latest_run(spark, sf):
    i, acc, runs, maps, g = _evidence_parts(spark, sf)
    ev = evidence.migration_evidence(acc, g, maps, i.run_at)
    before = ev.withColumn("run_id", F.lit("run-0009")).withColumn("generated_at", F.col("generated_at") - F.expr("INTERVAL 1 DAY"))
    return before.unionByName(ev).agg(F.max_by("run_id", F.struct("generated_at", "run_id")).alias("run_id"))


_UAT_STATUS_SQL = ("CASE WHEN " + " AND ".join([_GATE_SQL["REC-001"], _GATE_SQL["MAP-001"], _GATE_SQL["QUA-001"], _QUERYABLE_SQL])
                   + " THEN 'passed' ELSE 'failed' END")
UAT_EXECUTION_ID = "UAT-000000000001"


def _uat_execution(spark, sf):
    from .ingest import DEFAULT_RUN_AT
    return evidence.uat_execution(_uat(spark, sf), UAT_EXECUTION_ID, "release-2026.08", "staging", "QA Tester",
                                  DEFAULT_RUN_AT)


@register("uat_execution",
          f"SELECT '{UAT_EXECUTION_ID}' AS execution_id, '{RUN_ID}' AS run_id, {_UAT_STATUS_SQL} AS status, "
          "'1.0.0' AS suite_version")
def q_uat_execution(spark, sf):
    return _uat_execution(spark, sf).select("execution_id", "run_id", "status", "suite_version")


@register("uat_feed",
          f"SELECT '{UAT_EXECUTION_ID}' AS execution_id, 'release-2026.08' AS release_id, '{RUN_ID}' AS run_id, "
          f"{_UAT_STATUS_SQL} AS status")
def q_uat_feed(spark, sf, limit: int = 20):
    ex = _uat_execution(spark, sf)
    return ex.orderBy(F.col("completed_at").desc(), F.col("execution_id").desc()).limit(limit) \
        .select("execution_id", "release_id", "run_id", "status")


SIGN_OFF_COMMANDS = [("Release Owner", "Looks good"),
                     ("Release Owner", "All four acceptance scenarios were reviewed and accepted."),
                     ("Second Approver", "A second sign-off attempt for the same execution.")]


@register("uat_sign_off",
          f"SELECT '{UAT_EXECUTION_ID}' AS execution_id, {_UAT_STATUS_SQL} AS status, "
          f"CASE WHEN {_UAT_STATUS_SQL} = 'passed' THEN 'Release Owner' END AS signed_off_by")
def q_uat_sign_off(spark, sf):
    import datetime
    from .ingest import DEFAULT_RUN_AT
    ex = _uat_execution(spark, sf)
    cmds = spark.createDataFrame(
        [(UAT_EXECUTION_ID, a, n, DEFAULT_RUN_AT + datetime.timedelta(minutes=i)) for i, (a, n) in enumerate(SIGN_OFF_COMMANDS)],
        "execution_id string, approver string, note string, signed_at timestamp")
    signed, _errors = evidence.sign_off(ex, cmds)
    return signed.select("execution_id", "status", "signed_off_by")


@register("release_readiness", _REVIEW_SQL +
          f", rr AS (SELECT {_GATE_SQL['REC-001']} AS reconciled, TRUE AS validated, "
          "(SELECT bool_and(status IN ('resolved', 'rejected')) FROM case_state) AS exceptions_disposed, "
          "(SELECT coalesce(bool_and(status NOT IN ('resolved', 'rejected') OR decided_at IS NOT NULL), TRUE) "
          " FROM case_state) AS audit_complete, TRUE AS rollback_evidence, "
          f"{_UAT_STATUS_SQL} = 'passed' AS uat_signed_off) "
          f"SELECT '{RUN_ID}' AS run_id, *, CAST(reconciled AS INT) + CAST(validated AS INT) + "
          "CAST(exceptions_disposed AS INT) + CAST(audit_complete AS INT) + CAST(rollback_evidence AS INT) + "
          "CAST(uat_signed_off AS INT) AS passed_criteria, CAST(round((CAST(reconciled AS INT) + CAST(validated AS INT) + "
          "CAST(exceptions_disposed AS INT) + CAST(audit_complete AS INT) + CAST(rollback_evidence AS INT) + "
          "CAST(uat_signed_off AS INT)) * 100.0 / 6.0) AS BIGINT) AS readiness_percent FROM rr")
def q_release_readiness(spark, sf):
    import datetime
    from .ingest import DEFAULT_RUN_AT
    i, acc, runs, maps, g = _evidence_parts(spark, sf)
    _, cases, ev = _review(spark, sf)
    state = review.current_state(cases, ev)
    ex = _uat_execution(spark, sf)
    cmds = spark.createDataFrame([(UAT_EXECUTION_ID, SIGN_OFF_COMMANDS[1][0], SIGN_OFF_COMMANDS[1][1],
                                   DEFAULT_RUN_AT + datetime.timedelta(minutes=1))],
                                 "execution_id string, approver string, note string, signed_at timestamp")
    signed, _ = evidence.sign_off(ex, cmds)
    return evidence.release_readiness(acc, runs, i.notices(), state, signed)


REVIEW_DETAIL_CASE = "REV-00003"


@register("review_detail", _REVIEW_SQL +
          "SELECT s.case_id, s.status, i.control_id, i.severity, i.result, i.record_type, i.record_id, e.event_type, "
          "e.occurred_at, e.seq, e.to_status FROM case_state s JOIN issues i ON i.issue_id = s.validation_result_id "
          f"JOIN history e ON e.case_id = s.case_id WHERE s.case_id = '{REVIEW_DETAIL_CASE}'")
def q_review_detail(spark, sf, case_id: str = REVIEW_DETAIL_CASE):
    """The case with its validation result, a row per audit event in order."""
    issues = ing(spark, sf).issues()
    _, cmds, cases = _review_inputs(spark, sf)
    cases = cases.filter(F.col("case_id") == case_id)
    ev = review.evaluate_commands(cmds.filter(F.col("case_id") == case_id), cases)
    case = review.with_issue(review.current_state(cases, ev), issues)
    return case.join(review.event_history(cases, ev), "case_id").orderBy("occurred_at", "seq").select(
        "case_id", "status", "control_id", "severity", "result", "record_type", "record_id", "event_type", "occurred_at",
        "seq", "to_status")
