"""Benchmark: one full migration run plus retrieval and review at $BENCH_SF_DIR.

The classified notice and award frames are checkpointed once (as a real run
does); every output is then computed in full with a ``noop`` write, so the
timings include the whole plan but no driver-side collection. Prints ONE JSON
line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from provenant.operators import evidence, retrieval, review  # noqa: E402
from provenant.operators.tables import scratch_table  # noqa: E402
from provenant.plans.catalog_more import corpus, labelled_queries  # noqa: E402
from provenant.plans.ingest import adapter_ingestion  # noqa: E402
from provenant.session import checkpoint_dir, get_spark, scratch_path  # noqa: E402
from provenant.sources import adapters  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    checkpoint_dir(spark)
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    ing = timed("ingest_classify", lambda: adapter_ingestion(spark, sf_dir, materialize=True))
    timed("curated_notices", lambda: run(ing.notices()))
    timed("curated_awards", lambda: run(ing.awards()))
    timed("projects", lambda: run(ing.projects()))
    timed("project_features", lambda: run(ing.features()))
    timed("document_chunks", lambda: run(ing.chunks()))
    ledger = scratch_path(spark, "issues")  # written, as a run writes it: the review reads the ledger
    timed("issue_ledger", lambda: ing.issues().write.parquet(ledger))
    timed("disposition_ledger", lambda: run(ing.dispositions()))

    def ev():
        acc = evidence.record_accounting(ing)
        checksum = evidence.run_checksum(ing)
        schema = evidence.schema_fingerprint(ing.classified_notices.select("raw_json"),
                                             ing.classified_awards.select("raw_json"))
        runs = evidence.run_ledger(ing, checksum, schema)
        maps = evidence.mapping_executions(ing)
        g = evidence.gates(acc, runs, maps)
        run(evidence.migration_evidence(acc, g, maps, ing.run_at))
    timed("migration_evidence", ev)
    timed("hash_embed", lambda: run(retrieval.hash_embed(ing.chunks())))
    timed("semantic_search_batch",
          lambda: run(retrieval.semantic_search_batch(corpus(spark, sf_dir), labelled_queries(spark, sf_dir))))

    def rv():
        issues = spark.read.parquet(ledger)
        requests, cmds = adapters.review_inputs(spark, sf_dir, issues)
        cases = scratch_table(review.open_cases(requests, issues), "review-cases")
        run(review.current_state(cases, review.evaluate_commands(cmds, cases)))
    timed("review_state", rv)

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "migration_run_total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
