"""Fixed values that must equal the reference behaviour for equal results.

Everything in this module is data, not logic: control names, severities and
handling texts, the field rules of the mapping contracts, the review
vocabularies, and the small thresholds used by gates and guards.
"""

from __future__ import annotations

# --- Fixed values: data-quality control catalog (id, name, severity, handling) ---
CONTROL_CATALOG = [
    ("DQ-001", "Missing project identifier", "error", "Quarantine until a valid project ID is available"),
    ("DQ-002", "Invalid project identifier format", "error", "Preserve source value and quarantine"),
    ("DQ-003", "Missing notice title", "error", "Quarantine; do not infer a title"),
    ("DQ-004", "Invalid date format", "error", "Preserve original value and quarantine"),
    ("DQ-005", "Deadline earlier than publication", "warning", "Requires human review"),
    ("DQ-006", "Missing procurement category", "info", "Retain as incomplete metadata"),
    ("DQ-007", "Incomplete project linkage", "warning", "Retain and flag for review"),
    ("DQ-008", "Potential duplicate content", "warning", "Retain canonical record and review duplicates"),
]

# --- Fixed values: accepted date formats (Python strptime spelling, in order) ---
# %d-%b-%Y, %Y-%m-%d, %Y-%m-%dT%H:%M:%SZ -> the Spark patterns below, same order.
SPARK_DATE_PATTERNS = ["d-MMM-yyyy", "yyyy-M-d", "yyyy-M-d'T'H:m:s'Z'"]
# Shape of text each pattern can parse (Python: %d 1-2 digits, %Y exactly 4).
DATE_SHAPES = [r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$", r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$",
               r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}Z$"]

# --- Fixed values: project identifier shape and quality-score fields ---
PROJECT_ID_PATTERN = r"^P[0-9]{6}$"
QUALITY_FIELDS = ["project_id", "bid_description", "country_name",
                  "procurement_category", "publication_date", "deadline_date"]

# --- Fixed values: review workflow vocabularies and guards ---
REVIEW_STATUSES = ["open", "assigned", "in_review", "resolved", "rejected"]
REVIEW_RESOLUTIONS = ["accept_exception", "remediate", "reject_record"]
REVIEW_PRIORITIES = ["low", "medium", "high", "critical"]
RETEST_STATUSES = ["pending", "passed", "failed", "not_required"]
MIN_RATIONALE_CHARS = 20

# --- Fixed values: retrieval ---
MIN_RETRIEVAL_SCORE = 0.25
HASH_EMBED_DIMENSIONS = 256
TOKEN_PATTERN = "[a-z0-9]{2,}"
ABSTAIN_MESSAGE = "Insufficient semantic evidence in the indexed scope."
ANSWER_MESSAGE = "Retrieved source records only; similarity is a ranking signal, not factual confidence."

# --- Fixed values: UAT suite ---
UAT_SUITE_VERSION = "1.0.0"
UAT_SCENARIOS = [
    ("UAT-001", "Reconciled record population",
     "Every source record is loaded, quarantined or rejected with a zero balance delta."),
    ("UAT-002", "Versioned transformation contracts",
     "Both mapping executions retain a version and SHA-256 contract fingerprint."),
    ("UAT-003", "Excluded-record traceability",
     "Quarantine and rejection totals equal their record-level disposition evidence."),
    ("UAT-004", "Trusted records are queryable",
     "The accepted notice and award population is available in the curated target tables."),
]
UAT_ENVIRONMENTS = ["development", "staging", "production"]
MIN_SIGN_OFF_NOTE_CHARS = 20
MIN_NAME_CHARS = 2
UAT_ERRORS = {
    "tester": "Tester name must contain at least 2 characters",
    "release": "Release ID must contain at least 2 characters",
    "environment": "Environment must be development, staging or production",
}
SIGN_OFF_ERRORS = {
    "approver": "Approver name must contain at least 2 characters",
    "note": "Sign-off note must contain at least 20 characters",
    "missing": "UAT execution was not found",
    "failed": "Only a passing UAT execution can be signed off",
    "signed": "UAT execution is already signed off",
}

# --- Fixed values: evidence gates (id, label) ---
GATES = [
    ("REC-001", "Record accounting balances"),
    ("REC-002", "Source and target load counts reconcile"),
    ("QUA-001", "Every excluded record is traceable"),
    ("MAP-001", "Mapping contracts are pinned"),
    ("INT-001", "Source integrity evidence is present"),
    ("ERR-001", "No transformation failures remain"),
]
EXPECTED_CONTRACTS = 2

# Official links are parameters; these neutral defaults are used by the adapters.
DEFAULT_AWARDS_URL = "https://example.org/contract-awards"
DEFAULT_PROJECT_URL_PREFIX = "https://example.org/projects/"


def _field(source, target, type_, required, transform):
    return {"source": source, "target": target, "type": type_,
            "required": required, "transform": transform}


# --- Fixed values: mapping-contract field rules (source, target, type, required, transform) ---
_NOTICE_FIELDS_V100 = [
    _field("id", "notice_id", "string", True, "to_string"),
    _field("project_id", "project_id", "string", True, "normalize_project_id"),
    _field("bid_description", "title", "string", True, "trim"),
    _field("country_name", "country", "string", False, "trim"),
    _field("country_code", "country_code", "string", False, "trim"),
    _field("procurement_category", "category", "string", False, "trim"),
    _field("procurement_method", "method", "string", False, "trim"),
    _field("publication_date", "publication_date", "date", False, "normalize_date"),
    _field("deadline_date", "deadline_date", "date", False, "normalize_date"),
    _field("sector", "sector", "string", False, "trim"),
    _field("url", "official_url", "string", False, "trim"),
    _field("$record", "raw_json", "json", True, "serialize_json"),
    _field("$computed.quality_score", "quality_score", "number", True, "to_number"),
]
_NOTICE_FIELDS_V110 = [dict(f) for f in _NOTICE_FIELDS_V100]
_NOTICE_FIELDS_V110[4] = _field("country_code", "country_code", "string", False, "uppercase")

_AWARD_FIELDS_V100 = [
    _field("contr_id", "award_id", "string", True, "to_string"),
    _field("projectid", "project_id", "string", True, "normalize_project_id"),
    _field("contr_desc", "description", "string", False, "trim"),
    _field("countryshortname", "country", "string", False, "trim"),
    _field("procurement_group_desc", "category", "string", False, "trim"),
    _field("supp_name", "supplier", "string", False, "join_list"),
    _field("total_contr_amnt", "amount", "number", False, "to_number"),
    _field("contr_sgn_date", "signed_date", "date", False, "normalize_date"),
    _field("$constant.official_awards_url", "official_url", "string", True, "identity"),
    _field("$record", "raw_json", "json", True, "serialize_json"),
]

CONTRACTS = {
    ("procurement_notice", "1.0.0"): {
        "mapping_id": "procurement_notice", "version": "1.0.0",
        "source": {"record_type": "notice"},
        "target": {"entity": "procurement_notices", "schema_version": "1.0.0"},
        "fields": _NOTICE_FIELDS_V100,
    },
    ("procurement_notice", "1.1.0"): {
        "mapping_id": "procurement_notice", "version": "1.1.0", "supersedes": "1.0.0",
        "change_note": "Normalize source country codes to uppercase before loading.",
        "source": {"record_type": "notice"},
        "target": {"entity": "procurement_notices", "schema_version": "1.0.0"},
        "fields": _NOTICE_FIELDS_V110,
    },
    ("contract_award", "1.0.0"): {
        "mapping_id": "contract_award", "version": "1.0.0",
        "source": {"record_type": "award"},
        "target": {"entity": "contract_awards", "schema_version": "1.0.0"},
        "fields": _AWARD_FIELDS_V100,
    },
}

REGISTRY = {
    "registry_version": "1.0.0",
    "mappings": {
        "procurement_notice": {"active": "1.1.0", "versions": ["1.0.0", "1.1.0"]},
        "contract_award": {"active": "1.0.0", "versions": ["1.0.0"]},
    },
}
