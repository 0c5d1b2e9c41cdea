"""Adapters: driver tables -> raw source records (notices, awards, commands).

The source feeds are not available, so raw records are derived from the
TPC-H-like tables by fixed rules (FIXTURES.md section 3). The same rules are
written as DuckDB SQL in :mod:`provenant.plans.oracle` so both engines see the
same raw population.

Scale notes: ``nation`` has a fixed 25 rows, so it is broadcast. ``customer``,
``part`` and ``supplier`` grow with the data: they are broadcast only when their
counted rows are few, and merged otherwise. Orders meet their customer before
their line items, so line items are shuffled by order and by part alone.
Variant rows (re-publications, amendments) come from one scan through
``explode`` instead of a union of three scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import lookup, read_table, spread

NOTICE_COLUMNS = ["id", "project_id", "bid_description", "country_name", "country_code",
                  "procurement_category", "procurement_method", "publication_date",
                  "deadline_date", "sector", "url"]
AWARD_COLUMNS = ["contr_id", "projectid", "contr_desc", "countryshortname", "procurement_group_desc",
                 "supp_name", "total_contr_amnt", "contr_sgn_date", "project_name", "regionname",
                 "mjsecname"]

REPUBLISH_OFFSET = 1_000_000_000
AMEND_OFFSET = 2_000_000_000


def _project_code(custkey) -> F.Column:
    """Six digits; longer numbers stay whole, so they fail the format control
    instead of meeting another customer's id."""
    return (F.lit(100000) + custkey).cast("string")


def raw_json_of(*names: str) -> F.Column:
    """Landed record text: keys in sorted order, null keys left out."""
    return F.to_json(F.struct(*[F.col(n) for n in sorted(names)]))


def raw_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                               "o_orderdate", "o_orderpriority"), "o_orderkey")
    customer = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    base = (orders.join(lookup(customer), F.col("o_custkey") == F.col("c_custkey"))
            .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")))
    k = F.col("o_orderkey")
    variants = F.filter(F.array(F.lit(0), F.when(k % 50 == 0, F.lit(1)), F.when(k % 61 == 0, F.lit(2))),
                        lambda v: v.isNotNull())
    v = base.withColumn("variant", F.explode(variants))
    variant = F.col("variant")
    rid = F.when(variant == 1, F.concat(F.lit("d"), k.cast("string"))).otherwise(k.cast("string"))
    od = F.col("o_orderdate")
    pub = (F.when(k % 37 == 0, F.lit("not-a-date"))
           .when(k % 41 == 0, F.lit(None).cast("string"))
           .when(k % 3 == 0, F.date_format(od, "dd-MMM-yyyy"))
           .when(k % 3 == 1, F.date_format(od, "yyyy-MM-dd"))
           .otherwise(F.date_format(od, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    out = v.select(
        rid.alias("id"),
        F.when(k % 23 == 0, F.lit(None).cast("string")).when(k % 23 == 1, F.lit("12"))
        .otherwise(F.concat(F.lit(" p"), _project_code(F.col("o_custkey")), F.lit(" "))).alias("project_id"),
        F.when(k % 29 == 0, F.lit(None).cast("string")).when(k % 211 == 2, F.lit("   "))
        .otherwise(F.concat(F.lit("  Supply lot "), F.col("o_orderpriority"), F.lit(" "))).alias("bid_description"),
        F.when(k % 31 == 0, F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("country_name"),
        F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("country_code"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("procurement_category"),
        F.when(variant == 2, F.lit("AMENDED")).otherwise(F.col("o_orderstatus")).alias("procurement_method"),
        pub.alias("publication_date"),
        F.date_format(F.date_add(F.to_date(od), (k % 40 - 5).cast("int")), "yyyy-MM-dd").alias("deadline_date"),
        F.col("c_mktsegment").alias("sector"),
        F.concat(F.lit("https://example.org/notice/"), rid).alias("url"),
        (k + variant.cast("long") * REPUBLISH_OFFSET).alias("ingest_seq"),
    )
    return out.withColumn("raw_json", raw_json_of(*NOTICE_COLUMNS))


def award_seq(orderkey, linenumber, partkey, suppkey) -> F.Column:
    """Sortable text key: the four columns that make a line item unique."""
    return F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 19, "0")
                              for c in (orderkey, linenumber, partkey, suppkey)])


def raw_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread(read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                           "l_extendedprice", "l_shipdate"), "l_orderkey")
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    customer = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name")
    supplier = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    placed = (orders.join(lookup(customer), F.col("o_custkey") == F.col("c_custkey"))
              .select("o_orderkey", "o_custkey", "c_mktsegment", "c_nationkey"))
    base = (li.join(placed.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(lookup(part), F.col("l_partkey") == F.col("p_partkey"))
            .join(lookup(supplier), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")))  # last: its names are not shuffled
    pk = F.col("l_partkey")
    out = base.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("contr_id"),
        F.when(F.col("l_orderkey") % 17 == 0, F.lit("bad"))
        .when(F.col("o_custkey") % 3 == 0, F.lit("unassigned"))
        .otherwise(F.concat(F.lit("P"), _project_code(F.col("o_custkey")))).alias("projectid"),
        F.col("p_name").alias("contr_desc"),
        F.col("n_name").alias("countryshortname"),
        F.col("c_mktsegment").alias("procurement_group_desc"),
        F.when(pk % 19 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("s_name"))).alias("supp_name"),
        F.when(pk % 43 == 0, F.lit("")).when(pk % 101 == 0, F.lit("abc"))
        .otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("total_contr_amnt"),
        F.date_format(F.col("l_shipdate"), "yyyy-MM-dd").alias("contr_sgn_date"),
        F.concat(F.lit("Project "), F.col("o_custkey").cast("string")).alias("project_name"),
        F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")).alias("regionname"),
        F.array(F.col("c_mktsegment")).alias("mjsecname"),
        award_seq("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ingest_seq"),
    )
    return out.withColumn("raw_json", raw_json_of(*AWARD_COLUMNS))


# Review commands derived from the event stream: one case per user, ordered
# by (ts, event_id).
# --- Fixed values: event type -> review command ---
EVENT_COMMANDS = {
    "signup": "assign",
    "view": "start",
    "click": "accept",
    "purchase": "reject_record",
    "error": "accept_short",
}
LONG_RATIONALE = "Reviewed against the official source; decision recorded."
SHORT_RATIONALE = "Too short"


def review_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> (case_id, record_id, cmd_ts, cmd_seq, actor, command, status, assigned_to,
    resolution, rationale)."""
    ev = spread(read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type"), "event_id")
    cmd = F.col("event_type")
    mapping = F.create_map(*[x for kv in EVENT_COMMANDS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    # an event of an unknown type stays in the log and is refused like any command without effect
    command = F.coalesce(mapping[cmd], F.lit("unknown"))
    actor = F.concat(F.lit("reviewer-"), (F.col("user_id") % 7).cast("string"))
    return ev.select(
        F.format_string("REV-%05d", F.col("user_id")).alias("case_id"),
        F.col("user_id").cast("string").alias("record_id"),
        F.col("ts").alias("cmd_ts"),
        F.col("event_id").alias("cmd_seq"),
        actor.alias("actor"),
        command.alias("command"),
        F.when(command == "start", F.lit("in_review")).when(command == "unknown", F.lit("unknown")).alias("status"),
        F.when(command == "assign", actor).alias("assigned_to"),
        F.when(command.isin("accept", "accept_short"), F.lit("accept_exception"))
        .when(command == "reject_record", F.lit("reject_record")).alias("resolution"),
        F.when(command.isin("accept", "reject_record"), F.lit(LONG_RATIONALE))
        .when(command == "accept_short", F.lit(SHORT_RATIONALE)).alias("rationale"),
    )


def review_inputs(spark: SparkSession, sf_dir: str, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, commands). A user's first event asks for a review of the
    notice whose id is the user's (its smallest issue id), with a reviewer when
    it is an assignment; the other events are commands of that case."""
    log = review_commands(spark, sf_dir)
    first = log.groupBy("case_id", "record_id").agg(F.min(F.struct("cmd_ts", "cmd_seq", "actor", "assigned_to")).alias("_f")) \
        .select("case_id", "record_id", "_f.*")
    of_record = issues.filter(F.col("record_type") == "notice").groupBy("record_id") \
        .agg(F.min("issue_id").alias("validation_result_id"))
    requests = first.withColumnRenamed("cmd_ts", "requested_at").join(of_record, "record_id", "left")
    # joined on the whole order key, so that a busy case is spread
    commands = log.join(first.select("case_id", "cmd_ts", "cmd_seq"), ["case_id", "cmd_ts", "cmd_seq"], "left_anti") \
        .drop("record_id")
    return requests, commands
