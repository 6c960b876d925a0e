"""Headline timings: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    from marquee.operators import neighbours as nb, similarity as sim
    from marquee.plans import QUERIES
    from marquee.plans.recommend_oracle import LEX
    from marquee.session import local_session, materialise
    from marquee.sources.catalogue import entries, texts

    spark = local_session(cpus, cpus)
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        return out

    # Start the JVM's code paths and the Python workers outside the clock, on the same data.
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.range(8).repartition(8).mapInPandas(lambda it: it, "id long").collect()

    run = lambda name: (lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    for name in [
        "passes_view", "films_by_word", "page_best_desc", "catalogue_stats", "relaxation_counts", "match_backlog",
        "rank_backlog", "backlog_stats", "reconcile_summary", "fuzzy_search", "open_title", "undefined_tokens",
        "dataset_fingerprint", "debounce", "progressive_lockout", "recent_items",
    ]:
        timed(name, run(name))

    features = timed("recommend_features", lambda: sim.build_features(texts(spark, sf_dir), entries(spark, sf_dir), LEX))
    cands = timed("recommend_candidates", lambda: materialise(nb.candidates(features), "bench"))
    timed("recommend_assign", lambda: materialise(nb.neighbour_slots(nb.assign(cands)), "bench"))

    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
