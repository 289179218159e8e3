"""Time the headline queries; prints one JSON line.

Each query is written to the no-op sink, so all its rows and columns are
produced and none travel to the driver. One warm-up query starts the engine.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from marketmood.checks.queries import REGISTRY
from marketmood.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))
HEADLINE = (
    "stock_returns",
    "sentiment_labels",
    "clean_news",
    "align_news_labels",
    "build_features",
    "news_top_per_ticker",
    "split_exact",
    "nb_fit",
    "nb_predict",
    "tfidf",
    "lexicon_polarity",
    "blend_grid_search",
    "eval_metrics",
    "aggregate_daily",
    "sequence_windows",
    "return_sharpe",
)


def main() -> None:
    spark = build_session(
        "marketmood-bench",
        f"local[{CPUS}]",
        {
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["index_bars"](spark, SF_DIR).count()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS):
            started = time.time()
            REGISTRY[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.time() - started)
        seconds[name] = round(statistics.median(times), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
