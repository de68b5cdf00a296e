"""``python -m spindrift.cli pagerank FILE ITERATIONS`` and ``clustering FILE HINT [THRESHOLD]``: one value a line.

``--timers`` adds the seconds of each stage to the standard error.
"""

from __future__ import annotations

import argparse
import sys

import numpy as np

from spindrift import api
from spindrift.timing import Stages, drained


def single(text: str) -> float:
    """A threshold as the 32-bit float that it is rounded to."""
    return float(np.float32(text))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spindrift")
    parser.add_argument("--mode", choices=("line", "token"), default="line")
    parser.add_argument("--timers", action="store_true")
    kinds = parser.add_subparsers(dest="kind", required=True)
    rank = kinds.add_parser("pagerank")
    rank.add_argument("file")
    rank.add_argument("iterations", type=int)
    cluster = kinds.add_parser("clustering")
    cluster.add_argument("file")
    cluster.add_argument("hint", type=int)
    cluster.add_argument("threshold", type=single, nargs="?", default=single("3e-5"))
    a = parser.parse_args(args)
    stages = Stages()
    if a.timers:
        with stages("load"):
            graph = api.load(a.file, a.mode)
            drained(graph.edges)
        with stages("convert"):
            drained(graph.out_degrees())
    with stages("run"):
        if a.kind == "pagerank":
            out, name = api.pagerank_text(a.file, a.iterations, mode=a.mode), "rank"
        else:
            out, name = api.clustering(a.file, a.hint, a.threshold, mode=a.mode), "cluster"
        for r in out.orderBy("id").toLocalIterator():
            print(r[name])
    if a.timers:
        for stage, seconds in stages.seconds.items():
            print(f"{stage}: {seconds:.3f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
