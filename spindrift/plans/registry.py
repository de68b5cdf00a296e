"""Name -> query and name -> DuckDB SQL for the core engine, over the graphs of :mod:`derived`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift import api
from spindrift.functions.delta import delta_decode, delta_encode
from spindrift.operators import gas
from spindrift.operators.graph import Graph
from spindrift.plans import clustering as cl
from spindrift.plans import pagerank as pr
from spindrift.plans.derived import SQL, graph
from spindrift.session import shared_dir
from spindrift.sources import edge_list

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, of: str, build: Callable[[Graph], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(graph(spark, sf_dir, of))
    if sql:
        ORACLE_SQL[name] = _with(of) + sql


def _with(of: str, recursive: bool = False) -> str:
    """CTEs: d (edges), g (n vertices, m edges), v (ids), od and id_ (degrees)."""
    word = "with recursive" if recursive else "with"
    return (
        f"{word} d as ({SQL[of]}), g as (select max(greatest(src, dst)) + 1 n, count(*) m from d), v as (select unnest(range((select n from g))) id), "
        "od as (select v.id, count(d.src) degree from v left join d on d.src = v.id group by v.id), "
        "id_ as (select v.id, count(d.dst) degree from v left join d on d.dst = v.id group by v.id) "
    )


_list = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))

# --- construction -----------------------------------------------------------------------
_add("edges_scan", "D1", lambda g: g.edges, "select src, dst from d")
_add("edges_reverse", "D1", lambda g: g.reverse().edges, "select dst src, src dst from d")
_add("edges_sorted", "D1", lambda g: g.sorted_edges(), "select src, dst from d order by src, dst")
_add("vertex_spine", "D3", lambda g: g.vertices(), "select id from v")
for _g in ("D1", "D3"):
    _add(f"graph_counts_{_g.lower()}", _g, lambda g: g.counts(), "select n num_vertices, m num_edges from g")
for _g in ("D2", "D3"):
    _add(f"out_degree_{_g.lower()}", _g, lambda g: g.out_degrees(), "select id, degree from od")
    _add(f"in_degree_{_g.lower()}", _g, lambda g: g.in_degrees(), "select id, degree from id_")
    _add(f"dangling_vertices_{_g.lower()}", _g, lambda g: g.dangling(), "select id from od where degree = 0")
    _add(f"isolated_vertices_{_g.lower()}", _g, lambda g: g.isolated(), "select id from od join id_ using (id) where od.degree + id_.degree = 0")
_off = "select id, coalesce(sum(degree) over (order by id rows between unbounded preceding and 1 preceding), 0)::bigint \"offset\" from (select id, degree from {} union all select n, 0 from g)"
_add("csr_out_offsets", "D2", lambda g: g.out_offsets(), _off.format("od"))
_add("csr_in_offsets", "D2", lambda g: g.in_offsets(), _off.format("id_"))
_add("out_neighbors", "D2", lambda g: g.out_neighbors().select("id", _list("neighbors").alias("neighbors")), "select src id, string_agg(dst::varchar, ',' order by dst) neighbors from d group by src")
_add("in_neighbors", "D2", lambda g: g.in_neighbors().select("id", _list("neighbors").alias("neighbors")), "select dst id, string_agg(src::varchar, ',' order by src) neighbors from d group by dst")
_add("out_neighbors_of_vertex", "D2", lambda g: g.out_neighbors_of(3), "select dst from d where src = 3")
_add("in_neighbors_of_vertex", "D2", lambda g: g.in_neighbors_of(150), "select src from d where dst = 150")
_add(
    "forward_index", "D1", lambda g: g.forward_index().select("src", "dst", "out_position", "in_position"),
    "select src, dst, out_position, row_number() over (order by dst, src, out_position) - 1 in_position from (select src, dst, row_number() over (order by src, dst) - 1 out_position from d)",
)
for _dir, _deg in (("out", "od"), ("in", "id_")):
    _add(
        f"partition_bounds_{_dir}", "D2", lambda g, k=_dir: g.partition_bounds(4, k),
        f", o as (select id, coalesce(sum(degree) over (order by id rows between unbounded preceding and 1 preceding), 0) o from {_deg}), "
        "t as (select unnest(range(5)) part) select part, case when part = 0 then 0 when part = 4 then (select n from g) else (select count(*) from o where o < part * ((select m from g) // 4)) end bound from t",
    )
_add("adjacency", "D1", lambda g: g.adjacency().select("src", _list("dsts").alias("dsts")), "select v.id src, coalesce(string_agg(distinct dst::varchar, ',' order by dst::varchar) filter (dst is not null), '') dsts from v left join d on d.src = v.id group by v.id")
ORACLE_SQL["adjacency"] = _with("D1") + "select v.id src, coalesce(string_agg(dst::varchar, ',' order by dst), '') dsts from v left join (select distinct src, dst from d) d on d.src = v.id group by v.id"
_add("inverse_adjacency", "D1", lambda g: g.inverse_adjacency().select("src", _list("dsts").alias("dsts")))
ORACLE_SQL["inverse_adjacency"] = _with("D1") + "select v.id src, coalesce(string_agg(d.src::varchar, ',' order by d.src), '') dsts from v left join (select distinct src, dst from d) d on d.dst = v.id group by v.id"
_add("adjacency_roundtrip", "D1", lambda g: Graph.from_adjacency(g.adjacency()).edges, "select distinct src, dst from d")
_add(
    "delta_coding", "D2", lambda g: g.out_neighbors().select("id", delta_encode(F.col("neighbors")).alias("e")).select("id", _list("e").alias("deltas"), _list(delta_decode(F.col("e"))).alias("neighbors")),
    "select id, string_agg(delta::varchar, ',' order by dst) deltas, string_agg(dst::varchar, ',' order by dst) neighbors from (select src id, dst, dst - coalesce(lag(dst) over (partition by src order by dst), 0) delta from d) group by id",
)


# --- supersteps ------------------------------------------------------------------------
def _kernel(g: Graph) -> tuple[pr.PageRankKernel, DataFrame]:
    k = pr.PageRankKernel(g.num_vertices)
    return k, gas.initial(g, k)


def _sums(g: Graph) -> DataFrame:
    k, s = _kernel(g)
    folded = gas._fold(k, gas.messages(g, k, s))  # noqa: SLF001
    return g.vertices().join(folded.withColumnRenamed("dst", "id"), "id", "left").select("id", F.round(F.coalesce("folded", F.lit(0.0)), 9).alias("folded"))


_sum_sql = "select v.id, round(coalesce(sum(1.0::double / od.degree), 0), 9) folded from v left join d on d.dst = v.id left join od on od.id = d.src group by v.id"
_add("gas_init", "D1", lambda g: _kernel(g)[1].select("id", "value"), "select id, 1.0::double \"value\" from v")
_add("gas_scatter", "D1", lambda g: gas.messages(g, *_kernel(g)).select("src", "dst", F.round("message", 9).alias("message")), "select src, dst, round(1.0::double / degree, 9) message from d join od on od.id = d.src")


class _GainKernel(gas.Kernel):
    """Modularity gain as a gather that reads the receiver, with an ordered strict arg-max fold."""

    reads_dst = True

    def __init__(self, total: int, threshold: float):
        self.total, self.threshold = total, threshold

    def prepare(self, g: Graph, vertices: DataFrame) -> DataFrame:
        return cl.strengths(cl.first_level(g))

    def init(self, vertex):
        return F.struct(F.col(f"{vertex}.id").alias("cid"), F.lit(0.0).alias("gain"))

    def scatter(self, src, dst, value, vertex):
        return F.col(f"{vertex}.q")

    def gather(self, src, dst, message, dst_value, dst_vertex):
        return F.lit(2.0) * (F.lit(1) / F.lit(2.0 * self.total) - message * F.col(f"{dst_vertex}.q"))

    def zero(self, vertex):
        return F.struct(F.col(f"{vertex}.id").alias("cid"), F.lit(self.threshold).alias("gain"))

    def merge(self, acc, message, src):
        return F.when(message > acc["gain"], F.struct(src.alias("cid"), message.alias("gain"))).otherwise(acc)

    def apply(self, previous, folded, vertex):
        return F.struct(F.least(folded["cid"], F.col(f"{vertex}.id")).alias("cid"), folded["gain"].alias("gain"))


def _fold_moves(g: Graph) -> DataFrame:
    out = gas.run(g, _GainKernel(g.num_edges, 0.0), 1)
    return out.select("id", F.col("value.cid").alias("parent"), (F.round("value.gain", 12) + F.lit(0.0)).alias("gain"))


_gain = "w.src, w.dst, 2 * (1 / (2.0::double * m) - a.q * b.q) gain"
_strength = ", q as (select od.id, (od.degree + id_.degree) / (2.0::double * m) q from od join id_ using (id), g), w as (select distinct src, dst from d), gains as (select " + _gain + " from w join q a on a.id = w.src join q b on b.id = w.dst, g) "
_best = ", best as (select dst, src, gain from (select *, row_number() over (partition by dst order by gain desc, src) r from gains where gain > {t}) where r = 1), moves as (select v.id, coalesce(least(v.id, best.src), v.id) parent, coalesce(best.gain, {t}) gain from v left join best on best.dst = v.id) "
_add("gas_gather", "D1", lambda g: gas.messages(g, k := _GainKernel(g.num_edges, 0.0), gas.initial(g, k)).select("src", "dst", (F.round("message", 12) + F.lit(0.0)).alias("message")), _strength + "select d.src, d.dst, round(gain, 12) + 0::double message from d join gains on gains.src = d.src and gains.dst = d.dst")
_add("gas_sum", "D1", _sums, _sum_sql)
_add("gas_apply", "D1", lambda g: gas.superstep(g, *_kernel(g)).select("id", F.round("value", 9).alias("rank")), f"select id, round((1 - 0.15::double) * folded + 0.15::double / n, 9) rank from ({_sum_sql.replace('round(coalesce(sum(1.0::double / od.degree), 0), 9)', 'coalesce(sum(1.0::double / od.degree), 0)')}), g")
_add("gas_ordered_fold", "D3", _fold_moves, _strength + _best.format(t="0.0") + "select id, parent, round(gain, 12) + 0::double gain from moves")


# --- PageRank ------------------------------------------------------------------------
def _ranks(of: str, k: int) -> str:
    return (
        _with(of, True) + ", a as (select d.src, d.dst, 1.0::double / degree w from d join od on od.id = d.src union all select id, id, 0.0::double from v), "
        "pr(it, id, r) as (select 0, id, 1.0::double from v union all select any_value(pr.it) + 1, a.dst, 0.85::double * sum(pr.r * a.w) + 0.15::double / any_value(n) "
        f"from pr join a on a.src = pr.id, g where pr.it < {k} group by a.dst) "
    )


def _singles(of: str, k: int) -> str:
    """Ranks as 32-bit floats, added in ascending order of src, iteration by iteration."""
    sql = _with(of) + ", r0 as (select id, 1.0::real r from v) "
    for i in range(k):
        sql += (
            f", i{i} as (select d.dst id, list((r{i}.r / degree::real)::real order by d.src) l from d join od on od.id = d.src join r{i} on r{i}.id = d.src group by d.dst), "
            f"r{i + 1} as (select v.id, ((1 - 0.15::double) * coalesce(list_reduce(list_prepend(0::real, l), lambda a, x: (a + x)::real), 0::real)::double + 0.15::double / n)::real r from v left join i{i} using (id), g) "
        )
    return sql + f"select id, r::double rank from r{k}"


for _k in (1, 5, 10):
    QUERIES[f"pagerank_{_k}"] = lambda spark, sf_dir, k=_k: pr.pagerank(graph(spark, sf_dir, "D1"), k).select("id", F.round("rank", 6).alias("rank"))
    ORACLE_SQL[f"pagerank_{_k}"] = _ranks("D1", _k) + f"select id, round(r, 6) rank from pr where it = {_k}"
_add("pagerank_10_symmetric", "D4", lambda g: pr.pagerank(g, 10).select("id", F.round("rank", 6).alias("rank")))
ORACLE_SQL["pagerank_10_symmetric"] = _ranks("D4", 10) + "select id, round(r, 6) rank from pr where it = 10"
_add("pagerank_10_dangling", "D3", lambda g: pr.pagerank(g, 10).select("id", F.round("rank", 6).alias("rank")))
ORACLE_SQL["pagerank_10_dangling"] = _ranks("D3", 10) + "select id, round(r, 6) rank from pr where it = 10"
_add("pagerank_5_kernel", "D1", lambda g: gas.run(g, pr.PageRankKernel(g.num_vertices), 5).select("id", F.round("rank", 6).alias("rank")))
ORACLE_SQL["pagerank_5_kernel"] = ORACLE_SQL["pagerank_5"]
_add("pagerank_5_f32", "D1", lambda g: pr.pagerank(g, 5, "f32").select("id", F.col("rank").cast("double").alias("rank")))
ORACLE_SQL["pagerank_5_f32"] = _singles("D1", 5)
_add("pagerank_50", "D1", lambda g: pr.pagerank(g, 50).select("id", F.round("rank", 6).alias("rank")))
ORACLE_SQL["pagerank_50"] = _ranks("D1", 50) + "select id, round(r, 6) rank from pr where it = 50"
_add("pagerank_strings", "D1", lambda g: pr.as_text(pr.pagerank(g, 5)))
ORACLE_SQL["pagerank_strings"] = _ranks("D1", 5) + "select id, printf('%.6f', r) rank from pr where it = 5"


# --- clustering ---------------------------------------------------------------------
_chain = ", up(id, root, it) as (select id, parent, 0 from moves union all select up.id, moves.parent, up.it + 1 from up join moves on moves.id = up.root where moves.parent <> up.root), roots as (select id, min(root) root from up group by id) "
_label = ", labels as (select id, dense_rank() over (order by root) - 1 cluster from roots) "


def _clusters(of: str, t: str, then: str) -> str:
    return _with(of, True) + _strength + _best.format(t=t) + _chain + _label + then


def _level1(g: Graph, t: float) -> tuple[cl.Level, DataFrame]:
    level = cl.first_level(g)
    return level, cl.packed(cl.roots(cl.best_moves(level, t)))


for _g in ("D2", "D2m", "D3"):
    _n = _g.lower()
    _add(f"modularity_strength_{_n}", _g, lambda g: cl.strengths(cl.first_level(g)).select("id", F.round("q", 12).alias("q")), _strength + "select id, round(q, 12) q from q")
    _add(f"modularity_gain_{_n}", _g, lambda g: cl.gains(cl.first_level(g)).select("src", "dst", (F.round("gain", 12) + F.lit(0.0)).alias("gain")), _strength + "select src, dst, round(gain, 12) + 0::double gain from gains")
    _add(f"best_move_{_n}", _g, lambda g: cl.best_moves(cl.first_level(g), 0.0).select("id", "parent", (F.round("gain", 12) + F.lit(0.0)).alias("gain")), _strength + _best.format(t="0.0") + "select id, parent, round(gain, 12) + 0::double gain from moves")
    _add(f"changed_flag_{_n}", _g, lambda g: cl.gains(cl.first_level(g)).agg(F.coalesce(F.bool_or(F.col("gain") > 3e-5), F.lit(False)).alias("changed")), _strength + "select coalesce(bool_or(gain > 3e-5), false) changed from gains")
    _add(f"clustering_level1_{_n}", _g, lambda g: cl.clustering(g, g.num_vertices, 0.0))
    ORACLE_SQL[f"clustering_level1_{_n}"] = _clusters(_g, "0.0", "select id, cluster from labels")
_add("pointer_jump", "D3", lambda g: cl.roots(cl.best_moves(cl.first_level(g), 0.0)))
ORACLE_SQL["pointer_jump"] = _clusters("D3", "0.0", "select id, root from roots")
_add("packed_labels", "D3", lambda g: _level1(g, 0.0)[1])
ORACLE_SQL["packed_labels"] = _clusters("D3", "0.0", "select id, cluster from labels")
_add("cluster_sizes", "D3", lambda g: _level1(g, 0.0)[1].groupBy("cluster").agg(F.count("*").alias("size")))
ORACLE_SQL["cluster_sizes"] = _clusters("D3", "0.0", "select cluster, count(*) size from labels group by cluster")
_add("cluster_members", "D3", lambda g: _level1(g, 0.0)[1].groupBy("cluster").agg(_list(F.array_sort(F.collect_set("id"))).alias("members")))
ORACLE_SQL["cluster_members"] = _clusters("D3", "0.0", "select cluster, string_agg(id::varchar, ',' order by id) members from labels group by cluster")
_both = "select {} from d join labels a on a.id = d.src join labels b on b.id = d.dst where a.cluster {} b.cluster group by all"
for _g in ("D2", "D3"):
    _n = _g.lower()
    _add(f"compact_inter_{_n}", _g, lambda g: cl.compact_counts(g, _level1(g, 0.0)[1])[0])
    ORACLE_SQL[f"compact_inter_{_n}"] = _clusters(_g, "0.0", _both.format("a.cluster src, b.cluster dst, count(*) weight", "<>"))
    _add(f"compact_intra_{_n}", _g, lambda g: cl.compact_counts(g, _level1(g, 0.0)[1])[1])
    ORACLE_SQL[f"compact_intra_{_n}"] = _clusters(_g, "0.0", _both.format("a.cluster id, count(*) weight", "="))
    _add(f"compact_adjacency_{_n}", _g, lambda g: cl.compact_counts(g, _level1(g, 0.0)[1])[0].select("src", "dst"))
    ORACLE_SQL[f"compact_adjacency_{_n}"] = _clusters(_g, "0.0", _both.format("a.cluster src, b.cluster dst", "<>"))
_add("clustering_no_gain_zero", "D1", lambda g: cl.clustering(g, g.num_vertices, 3e-5))
ORACLE_SQL["clustering_no_gain_zero"] = _clusters("D1", "3e-5", "select id, case when (select count(*) from best) = 0 then 0 else cluster end cluster from labels")


def _levels(of: str, hint: int, t: str, levels: int) -> str:
    """Labels after so many levels; a level without a move, or behind ``hint`` clusters, changes nothing."""
    sql = _clusters(of, t, "")
    sql += ", a1 as materialized (select src, dst, 1::bigint w from (select distinct src, dst from d)), v1 as materialized (select od.id, od.degree + id_.degree weight from od join id_ using (id)), m1 as materialized (select id, cluster from labels), l1 as (select id, cluster from labels) "
    for k in range(2, levels + 1):
        j = k - 1
        sql += (
            f", a{k} as materialized (select x.cluster src, y.cluster dst, sum(w)::bigint w from a{j} join m{j} x on x.id = a{j}.src join m{j} y on y.id = a{j}.dst where x.cluster <> y.cluster group by all), "
            f"v{k} as materialized (select cluster id, sum(weight)::bigint weight from v{j} join m{j} using (id) group by cluster), "
            f"q{k} as materialized (select id, weight / (2.0::double * m) q from v{k}, g), "
            f"g{k} as (select src, dst, 2 * (w / (2.0::double * m) - x.q * y.q) gain from a{k} join q{k} x on x.id = src join q{k} y on y.id = dst, g), "
            f"b{k} as (select dst, src from (select *, row_number() over (partition by dst order by gain desc, src) r from g{k} where gain > {t}) where r = 1), "
            f"p{k} as materialized (select v{k}.id, coalesce(least(v{k}.id, b{k}.src), v{k}.id) parent from v{k} left join b{k} on b{k}.dst = v{k}.id), "
            f"u{k}(id, root, it) as (select id, parent, 0 from p{k} union all select u{k}.id, p{k}.parent, u{k}.it + 1 from u{k} join p{k} on p{k}.id = u{k}.root where p{k}.parent <> u{k}.root), "
            f"r{k} as (select id, min(root) root from u{k} group by id), "
            f"m{k} as materialized (select id, case when (select max(cluster) + 1 from m{j}) <= {hint} then id else dense_rank() over (order by root) - 1 end cluster from r{k}), "
            f"l{k} as materialized (select l{j}.id, m{k}.cluster from l{j} join m{k} on m{k}.id = l{j}.cluster) "
        )
    return sql + f"select id, case when (select count(*) from best) = 0 then 0 else cluster end cluster from l{levels}"


for _levels_run in (2, 3, 20):
    _name = "clustering_multilevel" if _levels_run == 20 else f"clustering_{_levels_run}_levels"
    _add(_name, "D3", lambda g, k=_levels_run: cl.clustering(g, 100, 0.0, max_levels=k))
    ORACLE_SQL[_name] = _levels("D3", 100, "0.0", _levels_run)


# --- files in, values out -----------------------------------------------------------------
def _path(g: Graph, name: str) -> str:
    return f"{shared_dir(g.spark)}/spindrift/{name}-{uuid.uuid4().hex}"


def _edge_file(g: Graph, between: str = " ") -> str:
    path = _path(g, "edges")
    g.edges.select(F.concat_ws(between, "src", "dst").alias("value")).write.text(path) if between != " " else edge_list.write_edges(g.edges, path)
    return path


def _written(g: Graph, values: DataFrame, name: str) -> DataFrame:
    """The lines that the sink writes for ``values``, and how often each stands there."""
    path = _path(g, "values")
    edge_list.write_values(values, path, name)
    return g.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("times"))


_add("edges_text_lines", "D2m", lambda g: edge_list.read_edges(g.spark, _edge_file(g)), "select src, dst from d")
_add("edges_text_tokens", "D2m", lambda g: edge_list.read_edges(g.spark, _edge_file(g, "\n"), "token"), "select src, dst from d")
_add("values_text_sink", "D2", lambda g: _written(g, g.out_degrees(), "degree"), "select degree::varchar line, count(*) times from od group by degree")
_add("pagerank_file_default", "D1", lambda g: api.pagerank(_edge_file(g)).select("id", F.round("rank", 6).alias("rank")))
ORACLE_SQL["pagerank_file_default"] = ORACLE_SQL["pagerank_50"]
_add("clustering_file_default", "D3", lambda g: api.clustering(_edge_file(g)))
ORACLE_SQL["clustering_file_default"] = _levels("D3", 100, "3e-5", 20)
