"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS`` the local
threads (default: all) and ``BENCH_REPEATS`` the timed repeats (default 3; the median counts).
A query is timed from building its DataFrame to the last row: the 22 queries and the gold
aggregate are collected, the others end in a sink that drops rows.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from varve import session  # noqa: E402
from varve.plans import registry  # noqa: E402

COLLECTED = ["gold_revenue_by_nation_year", *[f"tpch_q{n:02d}" for n in range(1, 23)]]
DROPPED = [
    "silver_lineitem", "quality_keys", "quality_fk_orphans", "profile_lineitem", "fingerprint_xx",
    "scd2_from_log", "reconcile_diff", "reconcile_tolerant", "reconcile_sorted", "masked_projection",
    "corpus_rule_hits", "coverage_rollup", "scd2_apply_batches", "scd2_store", "stream_bronze", "stream_scd2",
    "suite_verdicts", "stored_rows", "quality_report", "fingerprint_md5",
]


def timed(query, spark, sf_dir: str, collect: bool) -> float:
    begin = time.perf_counter()
    df = query(spark, sf_dir)
    if collect:
        df.collect()
    else:
        df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = session.build(
        "bench", master=f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus}
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    chosen = [(n, True) for n in COLLECTED] + [(n, False) for n in DROPPED]
    for name, collect in chosen:  # warm the JVM, the code and the file cache
        timed(registry.QUERIES[name], spark, sf_dir, collect)
    times: dict[str, float] = {}
    for name, collect in chosen:
        spent = [timed(registry.QUERIES[name], spark, sf_dir, collect) for _ in range(repeats)]
        times[name] = round(statistics.median(spent), 4)
    total = sum(v for k, v in times.items() if k.startswith("tpch_"))
    print(json.dumps({
        "metric": "total of 22 queries, median of repeats", "value": round(total, 4), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "repeats": repeats, "all_queries_sec": round(sum(times.values()), 4),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
