"""Time the headline queries: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairlens.plans.registry import QUERIES  # noqa: E402
from pairlens.session import local_session  # noqa: E402

# The reference states times for three stages: panel build, panel imputation, pair expansion.
HEADLINES = (
    "c1_conform_codes",
    "c1_conform_by_intervals",
    "c2_group_filter",
    "d7_keep_first",
    "e2_expand_spells",
    "e4_spell_count",
    "e4_running_days",
    "e6_resolve_primary",
    "e7_ordered_max",
    "e8_time_since",
    "y1_make_pairs",
    "y1_case_control_pairs",
    "y3_event_pairs",
    "y10_mirror_pairs",
    "pair_panel",
    "i1_normal_distance",
    "i2_scale_search_orders",
    "i5_em_impute",
    "i5_unit_trends",
    "directed_replicates",
    "risk_measure",
    "k4_elastic_net_grid",
    "k11_averaged_nets",
    "k16_tuning_stability",
    "m5_downsample_curve",
    "m1_derive_features",
    "m3_stratified_split_orders",
    "m6_curve_summary",
    "k2_logit",
    "k8_forest",
    "k15_cross_validate",
    "r3_auc_orders",
    "r4_score_models",
    "r6_ensemble_weights",
    "r11_unit_risk",
)


def run(spark, sf: str, name: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINES)
    spark = local_session(cores=cores, shuffle_partitions=8, name="pairlens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the engine
    times = {n: run(spark, sf, n) for n in names}
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
