"""Seconds of the headline queries; prints one JSON line.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of cores.
"""

from __future__ import annotations

import json
import os
import time

from tagstream.plans import catalog
from tagstream.session import make_session

HEADLINE = [
    "extract_messages",
    "tokenise_fields",
    "checksum_valid",
    "enrich_names_enums",
    "msgtype_counts",
    "session_default_asof",
    "violation_reason",
    "group_explode",
    "group_nested",
    "redact_lines",
    "order_state_path",
    "order_latest",
    "order_identity_chain",
    "tcp_reassembly",
    "stream_counts",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = make_session(f"local[{cpus}]", "bench", shuffle_partitions=int(cpus), driver_memory="12g")
    queries, seconds = catalog.queries(), {}
    queries["msgtype_counts"](spark, d).count()  # the JVM's first use
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, d).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": d.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
