"""Times the headline queries on $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mullion import registry  # noqa: E402
from mullion.session import session  # noqa: E402

# One or more of every kind: overlay, summary, scalars, folds, nearness, pages, tables, prices, writes, feeds.
HEADLINE = ["J1", "J3", "J28", "W1", "W6", "A7", "A10", "F1", "F17", "W8", "W9", "W18", "W24", "J4", "J13", "J14", "P5", "S3",
            "X27", "X30", "X4", "A22", "J16", "J18", "X23", "M1", "M8", "T4", "X12"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench", os.environ.get("BENCH_CPUS"))
    qs, took = registry.queries(), {}
    qs["J11"](spark, sf).write.format("noop").mode("overwrite").save()  # warm the session
    for name in HEADLINE:
        t0 = time.time()
        qs[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t0, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
