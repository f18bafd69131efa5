"""Headline timings; prints one JSON line.

BENCH_SF_DIR  folder of the parquet tables   (default /root/testdata/sf0.1)
BENCH_CPUS    local cores                    (default 4)
"""

from __future__ import annotations

import json
import os
import time

from dayglass.plans import risk_model
from dayglass.plans.registry import QUERIES, Inputs
from dayglass.session import build_session, materialize

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")

# flagship parts first, then stand-alone operators
HEADLINES = ["q_activity_single_pass", "q_user_day", "q_hour_entropy_7d", "q_new_flags", "q_bigrams",
             "q_feature_matrix", "q_robust_baseline", "q_mahalanobis_2d", "q_peer_score", "q_forest_score",
             "q_contributions", "q_eval_report", "q_decision_events", "q_lease_outcomes", "q_resume_requests",
             "q_hash_chain", "q_verify", "q_policy_run"]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS,
                          spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        started = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - started, 3)

    drain(Inputs(spark, SF_DIR).activity)  # start executors, warm file listing

    def flagship() -> None:
        x = Inputs(spark, SF_DIR)
        scored = risk_model.run_detection(x.activity, x.directory, x.answers, x.cfg)["scored"]
        risk_model.evaluate(materialize(scored, "scored")).collect()

    timed("flagship_cold", flagship)
    timed("flagship", flagship)
    for name in HEADLINES:
        timed(name, lambda: drain(QUERIES[name](Inputs(spark, SF_DIR))))
    print(json.dumps({"metric": "flagship: events to scored, explained, evaluated sessions", "value": times["flagship"],
                      "unit": "sec", "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
