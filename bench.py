"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line.

Each query is run once to warm up and then timed; the result is written to Spark's ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from spindrift.plans import clustering as cl
from spindrift.plans import pagerank as pr
from spindrift.plans.derived import edges, graph
from spindrift.session import local_session
from spindrift.timing import drained

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    spark = local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4)))
    spark.sparkContext.setLogLevel("ERROR")

    def convert(name):
        g = graph(spark, SF_DIR, name)
        return g.out_degrees().join(g.in_degrees().withColumnRenamed("degree", "in"), "id")

    queries = {f"load_{g.lower()}": lambda g=g: edges(spark, SF_DIR, g) for g in ("D1", "D2", "D3", "D4")}
    queries |= {f"convert_{g.lower()}": lambda g=g: convert(g) for g in ("D1", "D4")}
    queries |= {f"pagerank_{k}_{g.lower()}": lambda g=g, k=k: pr.pagerank(graph(spark, SF_DIR, g), k) for g in ("D1", "D4") for k in (10, 50)}
    for g in ("D2", "D3"):
        queries[f"clustering_{g.lower()}"] = lambda g=g: cl.clustering((x := graph(spark, SF_DIR, g)), x.num_vertices, 0.0)
    seconds = {}
    for name, query in queries.items():
        took = []
        for _ in range(1 + RUNS):
            begin = time.perf_counter()
            drained(query())
            took.append(time.perf_counter() - begin)
        seconds[name] = round(median(took[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
