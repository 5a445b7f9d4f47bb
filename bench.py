"""Headline-query benchmark.

Runs the headline queries on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` and prints one JSON line. Each query is forced to
completion with the ``noop`` sink (every row computed, nothing collected).
Shuffle bytes per query come from Spark's event log, written to a fresh
scratch folder (each query runs under its own job group).
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("q_knn_demos", "q_knn_vote", "q_top_fraction", "q_clean_set", "q_encode_corpus",
            "q_demo_selection", "q_initial_round", "q_refinery_round", "q_vocab_build", "q_prompt_messages")


def run(spark, name, fn, sf_dir):
    spark.sparkContext.setJobGroup(name, name)
    t0 = time.time()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - t0


def shuffle_bytes(log_dir):
    """Shuffle bytes written per job group, summed over task-end events."""
    stage_group, out = {}, {}
    paths = sorted(p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
                   if os.path.isfile(p) and not os.path.basename(p).startswith("appstatus"))
    for path in paths:
        with open(path, encoding="utf-8") as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    group = stage_group.get(ev.get("Stage ID"))
                    m = (ev.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                    if group:
                        out[group] = out.get(group, 0) + int(m.get("Shuffle Bytes Written", 0))
    return out


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["BENCH_CPUS"] = cpus
    log_dir = tempfile.mkdtemp(prefix="labelloop-bench-events-")
    from labelloop.plans.registry import QUERIES, load_all
    from labelloop.session import get_spark
    load_all()
    spark = get_spark(master=f"local[{cpus}]", extra_conf={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false"})
    # warm-up on the smallest tables: JVM, Python workers, Arrow and pandas paths
    for name in ("q_knn_demos", "q_initial_round", "q_vocab_build"):
        run(spark, "warmup", QUERIES[name], "/root/testdata/sf0.001")
    times = {}
    for name in HEADLINE:
        times[name] = round(run(spark, name, QUERIES[name], sf_dir), 3)
    spark.stop()
    try:
        shuffled = shuffle_bytes(log_dir)
    except Exception:  # noqa: BLE001 - the timing result stands without it
        shuffled = {}
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus),
                      "shuffle_bytes": {k: shuffled.get(k, 0) for k in HEADLINE}}))


if __name__ == "__main__":
    main()
