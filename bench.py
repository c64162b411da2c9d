"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from furlong.plans.registry import queries
from furlong.session import local_session

HEADLINE = ["form_table", "past_std_day", "past_rate_excluding_race", "class_features", "versions_fold", "dedupe_records", "tensor_exacta", "tensor_marginals", "strategy_by_grade", "race_difficulty", "day_bias", "auc"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    # compiles the shared operators and reads the tables once, so that the first query is not charged for the start
    queries()["past_count_day"](spark, sf).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.time()
        queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
