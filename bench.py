"""Headline queries, timed. Prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) choose the data and
the local cores. Every query runs over whole tables and is written to a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import load_all  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = [
    "top_moments",
    "a1_second_scores",
    "t3_coverage_ceiling",
    "w1_rolling_baseline",
    "w2_burst_candidates",
    "w8_point_clusters",
    "w8_labelled_intervals",
    "u1_interval_union",
    "j3_overlap_join",
    "j11_cooccurrence",
    "a10_level_by_class",
    "a12_prevalence_lift",
    "a16_keyness",
    "t11_spaced_quotes",
    "t12_vector_search",
    "j10_nearest_identity",
    "w13_boundary_novelty",
    "s16_listing_entries",
    "x11_repetition_cut",
    "r2_tracks",
    "r1_rule_events",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    wanted = sys.argv[1:] or HEADLINE
    load_all()["a4_peak_confidence"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.time()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
