"""Times the headline queries in a warm session; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from daygrain.session import local_session
from daygrain.testbed.queries import QUERIES

HEADLINE = (
    "minutes_per_participant_by_sex",
    "summary_by_sex",
    "weighted_minutes_by_activity",
    "weighted_minutes_by_group",
    "participation_by_activity",
    "category_by_age_workday",
    "replicate_se_by_age_sex",
    "replicate_se_by_year",
    "sports_share_by_income",
    "category_by_incomebin_age",
    "leisure_by_state",
    "weekend_minutes_long",
    "diary_slots_5min",
    "diary_sequence_5min",
    "diary_sequence_1min",
    "demographics_full",
    "trend_cubic",
    "trend_loess",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        # every output row is produced and then dropped, nothing returns to the driver
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    # the first round starts the engine and compiles the plans; the second one is timed
    for name in HEADLINE:
        run(name)
    seconds = {name: run(name) for name in HEADLINE}
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
