"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: the median of three warm runs each, one JSON line."""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from crowdlens import catalog

HEADLINE = ("attention_crossings", "counts_by_source", "trading_signals", "daily_terms", "word_screening", "theme_counts", "report_card", "lead_lag", "strategy_scorecard", "lexicon_scores", "inflections")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.time()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        took[name] = round(median(runs[1:]), 3)
    print(json.dumps({"metric": "headline queries, sum of warm medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
