"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["search_page", "search_count", "facets_all", "stats_summary", "skills", "categorize", "ingest", "reject_reasons", "profile_funnel", "upsert", "housekeeping", "probe_apply", "reindex", "html_cards", "json_scan", "clean_text", "dedup_documents", "term_match"]


def calibration() -> float:
    """Seconds for a fixed loop of plain Python: tells a slow machine from slow code."""
    began = time.time()
    sum(k * k % 7 for k in range(3_000_000))
    return round(time.time() - began, 3)


def stored(spark, sf_dir: str) -> dict[str, float]:
    """Seconds for what a store answers, over a snapshot that was written before."""
    from sievelake.operators import search
    from sievelake.operators.common import scratch_folder
    from sievelake.plans import catalog
    from sievelake.sources.store import Store

    store = Store(spark, scratch_folder(spark, "bench-store"), 16)
    took = {}

    def timed(name, run):
        began = time.time()
        run()
        took[name] = round(time.time() - began, 3)

    timed("commit", lambda: store.commit(catalog.postings(spark, sf_dir)))
    key = store.commit_of().top_id
    for again in ("", "_again"):
        timed(f"search_page{again}", lambda: search.search(store.searched(catalog.MAIN), catalog.MAIN, catalog.now()).collect())
        timed(f"facets{again}", lambda: store.facets().collect())
        timed(f"stats{again}", lambda: store.stats(catalog.now()).collect())
        timed(f"detail{again}", lambda: store.by_id(key).collect())
    return took


def main() -> None:
    from sievelake.plans.catalog import QUERIES
    from sievelake.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    QUERIES["search_count"](spark, sf_dir).collect()  # the JVM's first query
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    store = stored(spark, sf_dir)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "postings_per_second_ingest": round(n / took["ingest"]), "calibration": calibration(), "store": store}))


if __name__ == "__main__":
    main()
