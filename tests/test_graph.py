"""Hand-sized graphs with known values, readers, the command line and properties."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift import api, cli
from spindrift.functions.delta import delta_decode, delta_encode
from spindrift.operators import gas
from spindrift.operators.graph import Graph
from spindrift.operators.sequence import with_next, with_number
from spindrift.plans import clustering as cl
from spindrift.plans import derived
from spindrift.plans import pagerank as pr
from spindrift.session import settings
from spindrift.sources.edge_list import read_edges, write_edges

CLIQUES = [(a, b) for g in ((0, 1, 2), (3, 4, 5)) for a in g for b in g if a != b] + [(2, 3)]
GRAPHS = {
    "tri_tail": [(0, 1), (1, 2), (2, 0), (2, 3)],
    "gap": [(0, 2), (2, 4), (4, 0)],
    "multi_self": [(0, 1), (0, 1), (0, 0), (1, 2), (2, 0)],
    "two_cliques": CLIQUES,
    "self1": [(0, 0)],
    "one_back": [(1, 0)],
    "chain": [(0, 1), (1, 2), (2, 3), (3, 4)],
}
RANKS = {
    ("tri_tail", 1): "0.462500 0.887500 0.887500 0.462500",
    ("tri_tail", 2): "0.414687 0.430625 0.791875 0.414687",
    ("tri_tail", 50): "0.096667 0.119667 0.139217 0.096667",
    ("gap", 2): "0.778000 0.030000 0.778000 0.030000 0.778000",
    ("multi_self", 1): "1.183333 0.616667 0.900000",
    ("multi_self", 50): "0.418887 0.287394 0.294311",
    ("two_cliques", 2): "0.584583 0.584583 0.648333 1.016667 0.889167 0.889167",
    ("self1", 2): "1.000000",
    ("one_back", 1): "0.925000 0.075000",
    ("chain", 50): "0.030000 0.055500 0.077175 0.095599 0.111259",
}
LABELS = {
    "tri_tail": [0, 0, 0, 0],
    "gap": [0, 1, 0, 2, 0],
    "multi_self": [0, 1, 1],
    "two_cliques": [0, 0, 0, 1, 2, 2],
    "self1": [0],
    "one_back": [0, 1],
    "chain": [0, 0, 0, 0, 0],
}


def make(spark, name) -> Graph:
    rows = list(GRAPHS[name] if isinstance(name, str) else name)
    random.Random(1).shuffle(rows)
    return Graph(spark.createDataFrame(rows, "src long, dst long"))


def values(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize(("name", "k"), RANKS)
def test_pagerank(spark, name, k):
    assert values(pr.as_text(pr.pagerank(make(spark, name), k)), "rank") == RANKS[name, k].split()


def test_pagerank_has_no_more_parts_than_tasks_run_at_once(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(2000)]
    want = values(pr.as_text(pr.pagerank(make(spark, rows), 3)), "rank")
    with settings(spark, spark__sql__shuffle__partitions="64"):
        ranks = pr.pagerank(make(spark, rows), 3)
    assert len(ranks.inputFiles()) <= spark.sparkContext.defaultParallelism
    assert values(pr.as_text(ranks), "rank") == want


def test_pagerank_by_kernel_and_no_iterations(spark):
    g = make(spark, "multi_self")
    assert values(pr.as_text(gas.run(g, pr.PageRankKernel(3), 2)), "rank") == "1.150278 0.720556 0.574167".split()
    assert values(pr.pagerank(g, 0), "rank") == [1.0] * 3 == values(gas.run(g, pr.PageRankKernel(3), 0), "rank")


def test_single_precision_is_bit_equal(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(12), rng.randrange(12)) for _ in range(70)]
    n = max(map(max, rows)) + 1
    out = np.array([sum(s == v for s, _ in rows) for v in range(n)], np.float32)
    rank = np.ones(n, np.float32)
    for _ in range(3):
        new = []
        for v in range(n):
            acc = np.float32(0)
            for s, _ in sorted(e for e in rows if e[1] == v):
                acc = np.float32(acc + np.float32(rank[s] / out[s]))
            new.append(np.float32((1 - 0.15) * np.float64(acc) + 0.15 / n))
        rank = np.array(new, np.float32)
    got = np.array(values(pr.pagerank(make(spark, rows), 3, "f32"), "rank"), np.float32)
    assert got.tobytes() == rank.tobytes()


@pytest.mark.parametrize("name", LABELS)
def test_clustering_first_level(spark, name):
    assert values(cl.clustering(make(spark, name), 1000), "cluster") == LABELS[name]


def test_moves_and_compaction(spark):
    g = make(spark, "multi_self")
    level = cl.first_level(g)
    moves = cl.best_moves(level, 3e-5).orderBy("id").collect()
    assert [(r.parent, round(r.gain, 7)) for r in moves] == [(0, 3e-5), (1, 3e-5), (1, 0.08)]
    clusters = cl.packed(cl.roots(cl.best_moves(level, 3e-5)))
    inter, inner = cl.compact_counts(g, clusters)
    assert {(r.src, r.dst): r.weight for r in inter.collect()} == {(0, 1): 2, (1, 0): 1}
    assert {r.id: r.weight for r in inner.collect()} == {0: 1, 1: 1}
    assert g.num_edges == 5


def test_multilevel_ends_and_merges(spark):
    assert values(cl.clustering(make(spark, "one_back"), 1), "cluster") == [0, 1]
    fine = values(cl.clustering(make(spark, "two_cliques"), 1000), "cluster")
    coarse = values(cl.clustering(make(spark, "two_cliques"), 1), "cluster")
    assert len(set(coarse)) <= len(set(fine)) and sorted(set(coarse)) == list(range(len(set(coarse))))
    assert all(coarse[a] == coarse[b] for a in range(6) for b in range(6) if fine[a] == fine[b])


def test_a_round_of_roots_writes_only_what_is_not_at_its_root(spark, monkeypatch):
    rows, cut = [], cl.cut

    def counted(df, **watched):
        out = cut(df, **watched)
        rows.append(out.count())
        return out

    monkeypatch.setattr(cl, "cut", counted)
    pairs = [(2 * v, 2 * v + 1) for v in range(50, 1050)]
    ends = cl.roots(spark.createDataFrame([(v, max(v - 1, 0)) for v in range(64)] + [(b, a) for a, b in pairs] + [(a, a) for a, _ in pairs], "id long, parent long"))
    assert sum(rows) < 4000
    assert sorted(map(tuple, ends.collect())) == sorted([(v, 0) for v in range(64)] + [(v, a) for a, b in pairs for v in (a, b)])


def test_structure(spark):
    g = make(spark, "gap")
    assert (g.num_vertices, g.num_edges) == (5, 3)
    assert values(g.out_offsets(), "offset") == [0, 1, 1, 2, 2, 3]
    assert sorted(values(g.isolated(), "id")) == [1, 3] == sorted(values(g.dangling(), "id"))
    m = make(spark, "multi_self")
    assert sum(values(m.out_degrees(), "degree")) == sum(values(m.in_degrees(), "degree")) == 5
    assert sorted(map(tuple, m.reverse().reverse().edges.collect())) == sorted(GRAPHS["multi_self"])
    f = m.forward_index().collect()
    assert sorted(r.in_position for r in f) == sorted(r.out_position for r in f) == list(range(5))
    assert {r.part: r.bound for r in m.partition_bounds(2).collect()}.keys() == {0, 1, 2}
    assert [r.id for r in Graph(spark.createDataFrame([(7, 10**9)], "src long, dst long")).compact_ids()[1].orderBy("id").collect()] == [0, 1]


def test_distinct_pairs_and_isolated_vertices_are_found_in_bounded_parts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(derived, "PART_ROWS", 500)
    pairs = derived.edges(spark, sf_dir, "D2")
    assert pairs.rdd.getNumPartitions() == 12
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in pairs._jdf.queryExecution().executedPlan().toString().split("Exchange")[-1]
    assert plan(Graph(pairs).isolated()).count("FileScan") == 1
    gaps = Graph(pairs.where("dst % 7 > 0 and src > 1"))
    named = {v for r in gaps.edges.collect() for v in r}
    assert {r.id for r in gaps.isolated().collect()} == set(range(gaps.num_vertices)) - named


def test_adjacency_checks(spark):
    g = Graph.from_adjacency(spark.createDataFrame([(0, [2]), (1, []), (2, [])], "src long, dsts array<long>"))
    assert (g.num_vertices, g.num_edges) == (3, 1)
    with pytest.raises(ValueError, match="repeated"):
        Graph.from_adjacency(spark.createDataFrame([(0, [1, 1])], "src long, dsts array<long>"))


READ = [
    ("0 1\n1 2\n", [(0, 1), (1, 2)], [(0, 1), (1, 2)]),
    ("0 1\r\n\r\n1\t2\r\n", [(0, 1), (1, 2)], [(0, 1), (1, 2)]),
    ("0 1\n1 2", [(0, 1), (1, 2)], [(0, 1), (1, 2)]),
    ("\n0 1\n1 2\n", [(0, 1), (1, 2)], [(0, 1), (1, 2)]),
    ("# c\n0 1\n", [(0, 1)], [(0, 0), (0, 1)]),
    ("0 1 2\n", [(0, 1)], [(0, 1)]),
    ("0 1 1 2 ", [(0, 1)], [(0, 1), (1, 2)]),
    ("0 1 5\n1 2 7\n", [(0, 1), (1, 2)], [(0, 1), (5, 1), (2, 7)]),
    ("1.9 2\n", None, [(1, 2)]),
    ("-1 0\n", None, None),
    ("", None, None),
]


@pytest.mark.parametrize("case", range(len(READ)))
@pytest.mark.parametrize("mode", ["line", "token"])
def test_reader(spark, tmp_path, case, mode):
    text, line, token = READ[case]
    (tmp_path / "e").write_text(text)
    expected = line if mode == "line" else token
    if expected is None:
        with pytest.raises((ValueError, Exception)):
            read_edges(spark, str(tmp_path / "e"), mode).collect()
    else:
        assert sorted(map(tuple, read_edges(spark, str(tmp_path / "e"), mode).collect())) == sorted(expected)


@pytest.mark.parametrize("per_line", [1, 2, 3, 7])
def test_tokens_pair_up_across_splits_and_files_without_a_shuffle(spark, tmp_path, per_line):
    rng, want = random.Random(per_line), []
    (tmp_path / "e").mkdir()
    for name, n in (("a", 5001), ("b", 1), ("c", 1300), ("d", 0), ("f", 700)):
        tokens = [rng.randrange(10**6) for _ in range(n)]
        lines = [" ".join(map(str, tokens[i : i + per_line])) for i in range(0, n, per_line)]
        (tmp_path / "e" / name).write_text("\n".join(x + "\n" * rng.randrange(3) for x in lines))
        want += zip(tokens[::2], tokens[1::2])
    with settings(spark, spark__sql__files__maxPartitionBytes="4001", spark__sql__files__openCostInBytes="100"):
        edges = read_edges(spark, str(tmp_path / "e"), "token")
        assert spark.read.text(str(tmp_path / "e")).rdd.getNumPartitions() > 8
    assert sorted(map(tuple, edges.collect())) == sorted(want)
    assert "Exchange hashpartitioning" not in edges._jdf.queryExecution().toString()


def test_missing_file_and_round_trip(spark, tmp_path):
    with pytest.raises(ValueError):
        read_edges(spark, str(tmp_path / "none"))
    g = make(spark, "two_cliques")
    write_edges(g.edges, str(tmp_path / "out"))
    assert sorted(map(tuple, read_edges(spark, str(tmp_path / "out")).collect())) == sorted(CLIQUES)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "e").write_text("".join(f"{a} {b}\n" for a, b in GRAPHS["tri_tail"]))
    assert cli.main(["pagerank", str(tmp_path / "e"), "1"]) == 0
    assert capsys.readouterr().out.split() == RANKS["tri_tail", 1].split()
    assert cli.main(["clustering", str(tmp_path / "e"), "100"]) == 0
    assert capsys.readouterr().out.split() == list("0000")
    with pytest.raises(SystemExit):
        cli.main(["nothing", "x"])
    assert api.to_list(api.clustering(str(tmp_path / "e")), "cluster") == [0] * 4


def test_total_rank_without_dangling(spark):
    rng = random.Random(5)
    rows = [(v, rng.randrange(30)) for v in range(30) for _ in range(3)] + [(0, 29)]
    total = sum(values(pr.pagerank(make(spark, rows), 12, cut_every=5), "rank"))
    assert abs(total - (0.85**12 * 29 + 1)) < 1e-9


def test_sequence_over_ranges(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"))
    assert {r.k: r.n for r in with_number(df, ["k"], "n").collect()} == {k: k for k in range(1000)}
    assert {r.k: r.n for r in with_next(df, ["k"], "k", "n").collect()} == {k: k + 1 if k < 999 else None for k in range(1000)}


def test_delta(spark):
    df = spark.createDataFrame([([3, 5, 5, 9],), ([],), ([7],)], "x array<long>").select("x", delta_encode(F.col("x")).alias("d"))
    rows = df.select("x", "d", delta_decode(F.col("d")).alias("y")).collect()
    assert rows[0].d == [3, 2, 0, 4] and all(r.x == r.y for r in rows)
