"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "b3_nested_enumeration",
    "d10_d13_sample_table",
    "d14_track_totals",
    "e1_whole_file",
    "e3_track_payload",
    "e7_insertion_points",
    "f3_first_seen_tags",
    "f10_nested_document",
    "g3_kth_occurrence",
    "g7_roll_up",
    "h1_name_grammars",
    "h7_recordings",
    "h15_origin",
    "i6_interleave_order",
    "j5_field_bullets",
    "j13_reconcile",
    "k1_forbidden_words",
    "k4_ipv4",
    "k7_links",
    "l1_overlap_counts",
)


def main() -> None:
    from strongroom import plans
    from strongroom.plans.registry import QUERIES
    from strongroom.session import local_session

    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "strongroom-bench")
    plans.load()
    # One pass over a small table so that the first query does not pay for starting the session.
    spark.read.parquet(f"{directory}/nation.parquet").groupBy("n_regionkey").count().collect()
    taken = {}
    for name in HEADLINE:
        started = time.time()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.time() - started, 3)
        print(name, taken[name], file=sys.stderr, flush=True)
    scale = os.path.basename(directory.rstrip("/")).removeprefix("sf")
    total = round(sum(taken.values()), 3)
    line = {"metric": "headline queries, total", "value": total, "unit": "sec", "queries": taken, "sf": scale, "cpus": cpus}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
