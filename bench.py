"""Time the headline queries: `BENCH_SF_DIR`, `BENCH_CPUS`; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import queries as registry  # noqa: E402
from chatprep.session import local_session  # noqa: E402
from chatprep.sources.shared import scratch  # noqa: E402

HEADLINE = [
    "samples", "pairs_history", "pairs_messages_nested", "pairs_turns_nested", "pairs_records", "pairs_mixed",
    "vocab", "char_frequency", "encode", "decode_round_trip", "oov_report",
    "train_val_split", "pad_batches", "chat_messages", "render_chat", "pack_blocks", "pack_efficiency",
    "context_window_n2", "topk_ties", "softmax", "nucleus", "assemble_generation", "epoch_rollup", "early_stop",
    "pool_embeddings", "svd_energy", "stream_samples",
]
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(tempfile.mkdtemp(prefix="bench-"), int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    by_name = {query.__name__: query for query in registry.QUERIES}
    seconds = {}
    for name in names:
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            with scratch(spark):
                by_name[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        # The first run of a query also compiles its code.
        seconds[name] = round(min(taken), 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    line = {
        "metric": "total seconds of the headline queries, better of two runs each",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
