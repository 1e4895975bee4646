"""Time the headline queries and print one JSON line.

Each query runs to completion (all rows produced, nothing kept), after one warm-up
query: the quick ones three times, of which the median counts, the matching and link
queries, which take rounds, once. Session start is not counted. Single times go to
stderr; intermediate tables are dropped after each run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tallyweave.queries import QUERIES
from tallyweave.session import build_session, drop_intermediate

QUICK = [
    "bank_summary", "t_account", "ledger_build", "classify_rules", "ledger_enriched", "ledger_nested", "override_overlay",
    "classify_rule_table", "card_settlement", "scalar_normalize", "invoice_xml", "ingest_layout2", "export_rows", "month_stats", "recon_candidates",
]
SLOW = ["recon_greedy", "recon_dense", "supplier_invoice", "receipt_greedy", "attach_greedy", "fuel_link", "coa_extract", "stream_ingest"]
REPEATS = 3


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - start
    drop_intermediate(spark)
    print(f"{name} {took:.2f}", file=sys.stderr, flush=True)
    return took


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    timed(spark, "category_counts", sf_dir)
    times = {n: statistics.median(timed(spark, n, sf_dir) for _ in range(REPEATS)) for n in QUICK}
    times |= {n: timed(spark, n, sf_dir) for n in SLOW}
    print(json.dumps({
        "metric": "total seconds over headline queries",
        "value": round(sum(times.values()), 2),
        "unit": "sec",
        "queries": {n: round(t, 3) for n, t in times.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
