"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is run to completion with the ``noop`` sink (full computation, no
collect) after one warm-up query; prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pricewire.plans import catalog  # noqa: E402
from pricewire.session import local_session  # noqa: E402

HEADLINE = [
    "label_significance", "stock_table", "label_multiclass", "clean_text", "tokenize", "word_freq",
    "vocab_topk", "doc_term_lines", "raw_corpus", "dedup_articles", "bow_counts", "ngram_counts", "tfidf",
    "chi2_scores", "mi_scores", "topic_change_prev", "topic_hist_indexed", "topic_hist_adjacent",
    "topic_features", "split_by_date", "balance_binary", "kfold_stratified", "repeated_kfold",
    "evaluate_runs", "mcnemar", "check_libsvm", "scale_minmax", "var_price_regression_n1",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    qs = catalog.queries()
    qs[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
