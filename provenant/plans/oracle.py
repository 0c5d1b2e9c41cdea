"""DuckDB SQL for the correctness oracle.

The same adapter rules and pipeline semantics, written independently as one
chain of CTEs over the pre-registered driver views. Each oracle query is
``PRELUDE`` + a final ``SELECT``; DuckDB drops the CTEs a query does not use.
"""

from __future__ import annotations

from ..config import CONTROL_CATALOG, DEFAULT_AWARDS_URL, DEFAULT_PROJECT_URL_PREFIX
from ..operators.contracts import contract

RUN_ID = "run-0001"

_PYFLOAT = (r"(?i)[\s]*[+-]?(?:(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)"
            r"(?:e[+-]?\d(?:_?\d)*)?|nan|inf|infinity)[\s]*")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _norm_date(x: str) -> str:
    s = _strip(x)
    return (f"(CASE WHEN {x} IS NULL OR {x} = '' THEN NULL ELSE CAST(coalesce("
            f"try_strptime({s}, '%d-%b-%Y'), try_strptime({s}, '%Y-%m-%d'), "
            f"try_strptime({s}, '%Y-%m-%dT%H:%M:%SZ')) AS DATE) END)")


def _norm_pid(x: str) -> str:
    sq = f"upper(regexp_replace(coalesce({x}, ''), '\\s+', '', 'g'))"
    return f"(CASE WHEN regexp_full_match({sq}, 'P[0-9]{{6}}') THEN {sq} END)"


def _miss(x: str) -> str:
    return f"({x} IS NULL OR {x} = '')"


def _catalog_values() -> str:
    rows = ", ".join("('%s', '%s', '%s', '%s')" % tuple(v.replace("'", "''") for v in r) for r in CONTROL_CATALOG)
    return f"(VALUES {rows}) AS t(control_id, name, severity, recommended_handling)"


NOTICE_HASH = contract("procurement_notice").sha256
NOTICE_VERSION = contract("procurement_notice").version
AWARD_HASH = contract("contract_award").sha256
AWARD_VERSION = contract("contract_award").version

PRELUDE = f"""
WITH
raw_notice_base AS (
  SELECT o.o_orderkey AS k, o.o_custkey, o.o_orderstatus, o.o_orderdate, o.o_orderpriority,
         c.c_mktsegment, n.n_name
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
),
raw_notice_v AS (
  SELECT b.*, v.variant,
         CASE WHEN v.variant = 1 THEN 'd' || CAST(b.k AS VARCHAR) ELSE CAST(b.k AS VARCHAR) END AS vid
  FROM raw_notice_base b, (VALUES (0), (1), (2)) AS v(variant)
  WHERE v.variant = 0 OR (v.variant = 1 AND b.k % 50 = 0) OR (v.variant = 2 AND b.k % 61 = 0)
),
raw_notice AS (
  SELECT
    vid AS id,
    CASE WHEN k % 23 = 0 THEN NULL WHEN k % 23 = 1 THEN '12'
         ELSE ' p' || CAST(100000 + o_custkey AS VARCHAR) || ' ' END AS project_id,
    CASE WHEN k % 29 = 0 THEN NULL WHEN k % 211 = 2 THEN '   '
         ELSE '  Supply lot ' || o_orderpriority || ' ' END AS bid_description,
    CASE WHEN k % 31 = 0 THEN NULL ELSE n_name END AS country_name,
    ' ' || lower(n_name) || ' ' AS country_code,
    CASE WHEN k % 7 = 0 THEN NULL ELSE o_orderpriority END AS procurement_category,
    CASE WHEN variant = 2 THEN 'AMENDED' ELSE o_orderstatus END AS procurement_method,
    CASE WHEN k % 37 = 0 THEN 'not-a-date' WHEN k % 41 = 0 THEN NULL
         WHEN k % 3 = 0 THEN strftime(o_orderdate, '%d-%b-%Y')
         WHEN k % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d')
         ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS publication_date,
    strftime(CAST(o_orderdate AS DATE) + CAST(k % 40 - 5 AS INTEGER), '%Y-%m-%d') AS deadline_date,
    c_mktsegment AS sector,
    'https://example.org/notice/' || vid AS url,
    k + variant * 1000000000 AS ingest_seq
  FROM raw_notice_v
),
raw_award AS (
  SELECT
    CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS contr_id,
    CASE WHEN l.l_orderkey % 17 = 0 THEN 'bad'
         WHEN o.o_custkey % 3 = 0 THEN 'unassigned'
         ELSE 'P' || CAST(100000 + o.o_custkey AS VARCHAR) END AS projectid,
    p.p_name AS contr_desc, n.n_name AS countryshortname, c.c_mktsegment AS procurement_group_desc,
    CASE WHEN l.l_partkey % 19 = 0 THEN CAST([] AS VARCHAR[]) ELSE [s.s_name] END AS supp_name,
    CASE WHEN l.l_partkey % 43 = 0 THEN '' WHEN l.l_partkey % 101 = 0 THEN 'abc'
         ELSE CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS total_contr_amnt,
    strftime(l.l_shipdate, '%Y-%m-%d') AS contr_sgn_date,
    'Project ' || CAST(o.o_custkey AS VARCHAR) AS project_name,
    'Region ' || CAST(n.n_regionkey AS VARCHAR) AS regionname,
    [c.c_mktsegment] AS mjsecname,
    concat_ws('-', lpad(CAST(l.l_orderkey AS VARCHAR), 19, '0'), lpad(CAST(l.l_linenumber AS VARCHAR), 19, '0'),
              lpad(CAST(l.l_partkey AS VARCHAR), 19, '0'), lpad(CAST(l.l_suppkey AS VARCHAR), 19, '0')) AS ingest_seq
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
),
n_std AS (
  SELECT r.*,
    {_norm_pid('project_id')} AS pid,
    {_norm_date('publication_date')} AS pub,
    {_norm_date('deadline_date')} AS deadline,
    {_miss('project_id')} AS m_pid, {_miss('bid_description')} AS m_bid,
    {_miss('country_name')} AS m_country, {_miss('procurement_category')} AS m_cat,
    {_miss('publication_date')} AS m_pub, {_miss('deadline_date')} AS m_dead
  FROM raw_notice r
),
n_class0 AS (
  SELECT s.*,
    concat_ws(';',
      CASE WHEN m_pid THEN 'DQ-001' END,
      CASE WHEN NOT m_pid AND pid IS NULL THEN 'DQ-002' END,
      CASE WHEN m_bid THEN 'DQ-003' END,
      CASE WHEN NOT m_pub AND pub IS NULL THEN 'DQ-004' END,
      CASE WHEN NOT m_dead AND deadline IS NULL THEN 'DQ-004' END) AS block_codes,
    round(1 - (CAST(m_pid AS INT) + CAST(m_bid AS INT) + CAST(m_country AS INT) + CAST(m_cat AS INT)
               + CAST(m_pub AS INT) + CAST(m_dead AS INT)) / 6.0, 3) AS q_score,
    sha256(concat_ws('|', coalesce(pid, 'None'), coalesce(bid_description, 'None'),
                     coalesce(CAST(pub AS VARCHAR), 'None'), coalesce(CAST(deadline AS VARCHAR), 'None'))) AS content_hash,
    CASE WHEN id IS NULL THEN 'MappingError' WHEN pid IS NULL THEN 'MappingError'
         WHEN bid_description IS NULL OR {_strip('bid_description')} = '' THEN 'MappingError' END AS mapping_error
  FROM n_std s
),
n_class AS (
  SELECT c.*, '{RUN_ID}' AS run_id, 'notice' AS record_type, coalesce(id, 'None') AS record_id,
    CASE WHEN block_codes <> '' THEN 'quarantined' WHEN mapping_error IS NOT NULL THEN 'rejected'
         ELSE 'loaded' END AS disposition,
    CASE WHEN block_codes <> '' THEN block_codes
         WHEN mapping_error IS NOT NULL THEN 'mapping_error:' || mapping_error END AS reason,
    id AS notice_id, pid AS m_project_id, {_strip('bid_description')} AS title,
    {_strip('country_name')} AS country, upper({_strip('country_code')}) AS m_country_code,
    {_strip('procurement_category')} AS category, {_strip('procurement_method')} AS method,
    pub AS publication_date_n, deadline AS deadline_date_n, {_strip('sector')} AS m_sector,
    {_strip('url')} AS official_url, q_score AS quality_score
  FROM n_class0 c
),
a_std AS (
  SELECT r.*, {_norm_pid('projectid')} AS pid FROM raw_award r
),
a_class AS (
  SELECT a.*, '{RUN_ID}' AS run_id, 'award' AS record_type, coalesce(contr_id, 'None') AS record_id,
    CASE WHEN contr_id IS NULL THEN 'MappingError' WHEN pid IS NULL THEN 'MappingError'
         WHEN total_contr_amnt IS NOT NULL AND total_contr_amnt <> ''
              AND NOT regexp_full_match(total_contr_amnt, '{_PYFLOAT}') THEN 'ValueError' END AS mapping_error,
    CASE WHEN pid IS NULL THEN 'quarantined'
         WHEN contr_id IS NULL OR (total_contr_amnt IS NOT NULL AND total_contr_amnt <> ''
              AND NOT regexp_full_match(total_contr_amnt, '{_PYFLOAT}')) THEN 'rejected'
         ELSE 'loaded' END AS disposition,
    contr_id AS award_id, pid AS project_id_n, {_strip('contr_desc')} AS description,
    {_strip('countryshortname')} AS country, {_strip('procurement_group_desc')} AS category,
    coalesce(array_to_string(supp_name, ', '), '') AS supplier,
    CASE WHEN total_contr_amnt IS NULL OR total_contr_amnt = '' THEN NULL
         ELSE TRY_CAST(replace({_strip('total_contr_amnt')}, '_', '') AS DOUBLE) END AS amount,
    {_norm_date('contr_sgn_date')} AS signed_date,
    '{DEFAULT_AWARDS_URL}' AS official_url
  FROM a_std a
),
a_class2 AS (
  SELECT *, CASE WHEN disposition = 'quarantined' THEN 'DQ-002'
                 WHEN disposition = 'rejected' THEN 'mapping_error:' || mapping_error END AS reason
  FROM a_class
),
loaded_notice AS (
  SELECT notice_id, m_project_id AS project_id, title, country, m_country_code AS country_code, category, method,
         publication_date_n AS publication_date, deadline_date_n AS deadline_date, m_sector AS sector,
         official_url, quality_score, ingest_seq
  FROM n_class WHERE disposition = 'loaded'
),
loaded_award AS (
  SELECT award_id, project_id_n AS project_id, description, country, category, supplier, amount, signed_date,
         official_url, ingest_seq, project_name, countryshortname, regionname, mjsecname
  FROM a_class2 WHERE disposition = 'loaded'
),
notices AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY ingest_seq DESC) AS rn FROM loaded_notice)
  WHERE rn = 1
),
awards AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY award_id ORDER BY ingest_seq DESC) AS rn FROM loaded_award)
  WHERE rn = 1
),
projects AS (
  SELECT project_id, project_name AS title, countryshortname AS country, regionname AS region,
         coalesce(array_to_string(mjsecname, ','), '') AS sector, CAST(0.0 AS DOUBLE) AS total_amount,
         '{DEFAULT_PROJECT_URL_PREFIX}' || project_id AS official_url
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ingest_seq ASC) AS rn FROM loaded_award)
  WHERE rn = 1
),
n_summary AS (
  SELECT project_id, count(*) AS notice_count, sum(CAST(round(quality_score * 1000) AS BIGINT)) AS q_milli
  FROM notices GROUP BY project_id
),
a_summary AS (
  SELECT project_id, count(*) AS award_count,
         count(DISTINCT CASE WHEN supplier IS NOT NULL AND supplier <> '' THEN supplier END) AS supplier_count,
         coalesce(sum(amount), 0.0) AS award_amount
  FROM awards GROUP BY project_id
),
features AS (
  SELECT coalesce(n.project_id, a.project_id) AS project_id,
         coalesce(n.notice_count, 0) AS notice_count, coalesce(a.award_count, 0) AS award_count,
         coalesce(a.supplier_count, 0) AS supplier_count, coalesce(a.award_amount, 0.0) AS award_amount,
         ((2 * (coalesce(n.notice_count, 0) * 1000 - coalesce(n.q_milli, 0)) + greatest(coalesce(n.notice_count, 0), 1))
           // (2 * greatest(coalesce(n.notice_count, 0), 1))) / 1000.0 AS missing_field_ratio,
         CASE WHEN p.project_id IS NOT NULL THEN 'linked' ELSE 'project metadata unavailable' END AS linkage_status,
         ((2 * coalesce(n.q_milli, 0) + greatest(coalesce(n.notice_count, 0), 1))
           // (2 * greatest(coalesce(n.notice_count, 0), 1))) / 1000.0 AS quality_score
  FROM n_summary n FULL OUTER JOIN a_summary a ON n.project_id = a.project_id
  LEFT JOIN projects p ON p.project_id = coalesce(n.project_id, a.project_id)
),
dup_first AS (
  SELECT run_id, content_hash, min(ingest_seq) AS first_seq FROM n_class
  WHERE disposition <> 'quarantined' GROUP BY run_id, content_hash
),
issue_raw AS (
  SELECT run_id, 'DQ-001' AS control_id, record_type, record_id, 'project_id' AS source_field,
         coalesce(project_id, 'None') AS original_value, '' AS normalized_value, CAST(ingest_seq AS VARCHAR) AS ingest_seq
  FROM n_class WHERE m_pid
  UNION ALL
  SELECT run_id, 'DQ-002', record_type, record_id, 'project_id', coalesce(project_id, 'None'), '', CAST(ingest_seq AS VARCHAR)
  FROM n_class WHERE NOT m_pid AND pid IS NULL
  UNION ALL
  SELECT run_id, 'DQ-003', record_type, record_id, 'bid_description', coalesce(bid_description, 'None'), '', CAST(ingest_seq AS VARCHAR)
  FROM n_class WHERE m_bid
  UNION ALL
  SELECT run_id, 'DQ-004', record_type, record_id, 'publication_date', coalesce(publication_date, 'None'), '', CAST(ingest_seq AS VARCHAR)
  FROM n_class WHERE NOT m_pub AND pub IS NULL
  UNION ALL
  SELECT run_id, 'DQ-004', record_type, record_id, 'deadline_date', coalesce(deadline_date, 'None'), '', CAST(ingest_seq AS VARCHAR)
  FROM n_class WHERE NOT m_dead AND deadline IS NULL
  UNION ALL
  SELECT run_id, 'DQ-005', record_type, record_id, 'deadline_date', coalesce(deadline_date, 'None'),
         CAST(deadline AS VARCHAR), CAST(ingest_seq AS VARCHAR)
  FROM n_class WHERE disposition <> 'quarantined' AND pub IS NOT NULL AND deadline IS NOT NULL AND deadline < pub
  UNION ALL
  SELECT run_id, 'DQ-006', record_type, record_id, 'procurement_category', 'None', '', CAST(ingest_seq AS VARCHAR)
  FROM n_class WHERE disposition <> 'quarantined' AND m_cat
  UNION ALL
  SELECT c.run_id, 'DQ-008', c.record_type, c.record_id, 'bid_description', coalesce(c.bid_description, 'None'), '',
         CAST(c.ingest_seq AS VARCHAR)
  FROM n_class c JOIN dup_first d ON c.run_id = d.run_id AND c.content_hash = d.content_hash
  WHERE c.disposition <> 'quarantined' AND c.ingest_seq > d.first_seq
  UNION ALL
  SELECT run_id, 'DQ-002', record_type, record_id, 'projectid', coalesce(projectid, 'None'), '', ingest_seq
  FROM a_class2 WHERE disposition = 'quarantined'
  UNION ALL
  SELECT 'curation', 'DQ-007', 'project', u.project_id, 'project_id', u.project_id, '', NULL
  FROM (SELECT DISTINCT project_id FROM notices) u
  WHERE u.project_id NOT IN (SELECT project_id FROM projects)
),
catalog AS (SELECT * FROM {_catalog_values()}),
issues AS (
  SELECT sha256(concat_ws('|', i.run_id, i.control_id, i.record_type, i.record_id, i.source_field,
                          coalesce(i.ingest_seq, ''))) AS issue_id,
         i.run_id, i.control_id, c.severity, c.name AS result, i.record_type, i.record_id, i.source_field,
         i.original_value, i.normalized_value, c.recommended_handling, i.ingest_seq
  FROM issue_raw i JOIN catalog c ON i.control_id = c.control_id
),
dispositions AS (
  SELECT run_id, record_type, record_id, disposition, reason, CAST(ingest_seq AS VARCHAR) AS ingest_seq
  FROM n_class WHERE disposition IN ('quarantined', 'rejected')
  UNION ALL
  SELECT run_id, record_type, record_id, disposition, reason, ingest_seq
  FROM a_class2 WHERE disposition IN ('quarantined', 'rejected')
),
routing AS (
  SELECT record_type, disposition, count(*) AS n FROM (
    SELECT record_type, disposition FROM n_class UNION ALL SELECT record_type, disposition FROM a_class2)
  GROUP BY record_type, disposition
),
chunks AS (
  SELECT substr(sha256('notice:' || notice_id), 1, 20) AS chunk_id, 'notice' AS record_type, notice_id AS record_id,
         project_id, coalesce(title, 'None') || ' ' || coalesce(country, 'None') || ' ' || coalesce(sector, 'None') AS text,
         official_url, country
  FROM notices
  UNION ALL
  SELECT substr(sha256('award:' || award_id), 1, 20), 'award', award_id, project_id,
         coalesce(description, 'None') || ' ' || coalesce(country, 'None') || ' ', official_url, country
  FROM awards
  UNION ALL
  SELECT substr(sha256('project:' || project_id), 1, 20), 'project', project_id, project_id,
         coalesce(title, 'None') || ' ' || coalesce(country, 'None') || ' ' || coalesce(sector, 'None'),
         official_url, country
  FROM projects
)
"""


def q(select: str) -> str:
    return PRELUDE + select
