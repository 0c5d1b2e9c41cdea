"""provenant: a PySpark engine for auditable record migration.

Raw notice and award records are standardized by compiled mapping contracts,
checked by data-quality controls, routed to loaded / quarantined / rejected,
upserted into curated tables, summarised as per-project features and
retrieval chunks, reconciled into migration evidence, and reviewed through a
windowed state machine. Everything is expressed as DataFrame plans.
"""

__version__ = "0.1.0"
