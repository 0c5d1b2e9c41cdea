"""Read models: filtered, ordered, paged views over the curated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def like_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def notice_search(notices: DataFrame, country: str | None = None, project_id: str | None = None,
                  limit: int = 50, offset: int = 0) -> DataFrame:
    """Country substring (case-insensitive, wildcards escaped), exact project id
    (upper-cased), newest publication first with the key as tie-breaker."""
    d = notices
    if country:
        d = d.filter(F.ilike(F.col("country"), F.lit(f"%{like_escape(country)}%"), F.lit("\\")))
    if project_id:
        d = d.filter(F.col("project_id") == project_id.upper())
    d = d.orderBy(F.col("publication_date").desc_nulls_last(), F.col("notice_id"))
    if offset:
        d = d.offset(offset)
    return d.limit(limit)


# the fields a reviewer's free text is looked up in
QUEUE_FIELDS = ["case_id", "record_id", "project_id", "country", "control_id", "title", "assigned_to"]


def review_queue(state: DataFrame, issues: DataFrame, notices: DataFrame) -> DataFrame:
    """Cases with their validation result and, if it was loaded, its notice."""
    i = issues.select(F.col("issue_id").alias("validation_result_id"), "control_id", "record_type", "record_id")
    n = notices.select(F.lit("notice").alias("record_type"), F.col("notice_id").alias("record_id"), "project_id", "country",
                       "title")
    return state.join(i, "validation_result_id").join(n, ["record_type", "record_id"], "left")


def review_queue_filter(state: DataFrame, text: str = "", status: str = "all", priority: str = "all",
                        owner: str = "all") -> DataFrame:
    """Free text over ``QUEUE_FIELDS`` of a :func:`review_queue` plus status class, priority and ownership."""
    search = text.strip().lower()
    complete = F.col("status").isin("resolved", "rejected")
    cond = F.lit(True)
    if search:
        cond = cond & F.lower(F.concat_ws(" ", *QUEUE_FIELDS)).contains(search)
    if status == "open":
        cond = cond & ~complete
    elif status == "complete":
        cond = cond & complete
    if priority != "all":
        cond = cond & (F.lower("priority") == priority)
    if owner == "assigned":
        cond = cond & F.col("assigned_to").isNotNull() & (F.col("assigned_to") != "")
    elif owner == "unassigned":
        cond = cond & (F.col("assigned_to").isNull() | (F.col("assigned_to") == ""))
    return state.filter(cond)


PROJECT_ROWS = ("section string, project_id string, record_id string, title string, country string, region string, category string, "
                "sector string, supplier string, event_date date, amount double, official_url string, notice_count long, "
                "award_count long, linkage_status string, quality_score double")


def project_360(projects: DataFrame, features: DataFrame, notices: DataFrame, awards: DataFrame, project_id: str) -> DataFrame:
    """Everything about one project as rows of four sections: the project, its features, each notice and each award.
    An unknown project has no rows, whatever notices name it. Every table is filtered by the key first."""
    pid = project_id.upper()
    own = projects.filter(F.col("project_id") == pid)

    def section(name: str, df: DataFrame, **columns: str) -> DataFrame:
        picked = df.filter(F.col("project_id") == pid).join(F.broadcast(own.select("project_id").limit(1)), "project_id", "left_semi")
        cols = []
        for part in PROJECT_ROWS.split(", "):
            out, dtype = part.split(" ")
            value = F.lit(name) if out == "section" else F.col(columns[out]) if out in columns else F.lit(None)
            cols.append(value.cast(dtype).alias(out))
        return picked.select(*cols)

    same = {c: c for c in ("project_id", "title", "country", "category", "sector", "official_url")}
    return section("project", projects, record_id="project_id", region="region", amount="total_amount",
                   **{k: v for k, v in same.items() if k != "category"}) \
        .unionByName(section("features", features, project_id="project_id", record_id="project_id", notice_count="notice_count",
                             award_count="award_count", amount="award_amount", linkage_status="linkage_status", quality_score="quality_score")) \
        .unionByName(section("notice", notices, record_id="notice_id", event_date="publication_date", quality_score="quality_score", **same)) \
        .unionByName(section("award", awards, project_id="project_id", record_id="award_id", title="description", country="country",
                             category="category", supplier="supplier", event_date="signed_date", amount="amount", official_url="official_url"))
