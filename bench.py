"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Every query runs to completion through the ``noop`` sink (full execution, no
collect to the driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from redline.plans.queries import QUERIES  # noqa: E402
from redline.plans.session import get_session  # noqa: E402

HEADLINE = [
    "corpus_clean",          # S1, T1-T6, U1
    "split_lang_counts",     # W1, A2
    "split_exact",           # W1 exact (global rank)
    "sample_per_lang",       # W3
    "lcs_pairs",             # E1
    "f05_lcs_by_lang",       # A5, A7, A8
    "f05_set_by_lang",       # A6
    "eval_identity",         # M1, M5
    "edit_table",            # E2-E4
    "label_vocab",           # A3, A4
    "tagger_fit",            # M2
    "correct_iter",          # M3, M4, E6
    "encode_seq2seq",        # F13-F16
    "few_shot_prompts",      # W4, F6-F8
    "reply_clean",           # F9-F11
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 4 * cpus))
    # warm-up: JVM, Python workers, Arrow (not timed)
    QUERIES["lcs_pairs"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
