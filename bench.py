"""Headline queries at one data scale; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. The first run of each query is timed
after one warm-up of the session, so that a query is not charged for starting the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import registry  # noqa: E402
from orderlore.operators import clean, fairness, profile, validate  # noqa: E402
from orderlore.plans.star import read_table  # noqa: E402
from orderlore.plans.test_views import dirty_orders  # noqa: E402
from orderlore.session import build_session, fresh_path  # noqa: E402

HEADLINES = [
    "E01", "W-AGG01", "W-AGG03", "W-AGG10", "W-FIL01", "W-TOP01", "W-TOP20", "W-TIM06", "W-CMP10", "W-GRP15", "W-ANL03",
    "W-ANL09", "W-ANL10", "W-ANL11", "P04", "P05", "P12", "V04", "V05", "C10", "C11", "B03", "B08", "F12", "R02", "R16",
    "L07", "M03", "S02", "D08",
]


_stored: dict[str, str] = {}


def _stage_profile(spark, sf_dir):
    """Acquire and profile: read, store, describe every column."""
    _stored["path"] = fresh_path(spark, "bench-raw")
    dirty_orders(spark, sf_dir).write.parquet(_stored["path"])
    return profile.profile(_raw(spark), "orders")


def _raw(spark):
    """The stored table, which each later stage reads."""
    return spark.read.parquet(_stored["path"])


def _stage_validate(spark, sf_dir):
    return validate.verdict(_raw(spark))


def _stage_clean(spark, sf_dir):
    return clean.clean(_raw(spark))


def _stage_bias(spark, sf_dir):
    return fairness.sweep(_raw(spark), ["segment", "priority", "region"], ["customer_id", "total", "balance", "points"])


STAGES = {
    "stage_acquire_profile": _stage_profile,
    "stage_validate": _stage_validate,
    "stage_clean": _stage_clean,
    "stage_bias": _stage_bias,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), app_name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag").count().collect()
    queries = registry.queries()
    runs = {**{k: queries[k] for k in HEADLINES}, **STAGES}
    times = {}
    for name, run in runs.items():
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
