"""URL filter: rules first, and link-graph propagation for what no rule fits.

Pages give a host graph: an edge for every link of a page to another host, weighted by
the number of links.  Two personalised PageRanks run over it together, as one table
with a ``kind``: trust starts at hosts that rules allow and follows links; distrust
starts at hosts that rules block and follows links backwards (who links to the
blocked is distrusted).  A host is a seed if one verdict of rules holds for at least
``seed_share`` of its pages, with its number of such pages as weight.  Mass that leaves hosts without a link on returns
to the seeds.  A host whose distrust is above 0 and reaches ``ratio`` times its trust is
blocked; every other host is allowed.

A round sends on only what hosts got in the round before, and adds it to what they have.  Nothing is subtracted,
so distrust is exactly 0 where no blocked seed is reached.  Mass that finds no link on is not sent back to the
seeds round by round: that would multiply all of a kind's masses by one number, so they are divided by their
sum at the end instead.  No bound depends on the table's size.  Rounds go on until no host gets more than
``tolerance`` of what it has, and none gets its first, so how far a host lies from a seed is no bound.  Mass too
small for a double, some thousands of links off, counts as ``LEAST`` and not as none.

Everything is a DataFrame: links are pulled out and summed before any shuffle, joins
are on hosts, and the scores are written to the shared folder every round.

Defined cases: a null url or one without ``://`` has the empty host and path, fits no
rule and is allowed by the method; null html has no links; urls and html of any length are read whole; a host whose
distrust equals its trust is blocked; of rules that fit and are equally long the last in alphabetical order wins; repeated
rows count as often as they occur; an empty table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm import common

ALLOW, BLOCK = "allow", "block"
LEAST = 1e-300


@dataclass(frozen=True)
class Rule:
    """``place``: a host, then a path from its ``/`` on, like ``example.net/en/``."""

    verdict: str
    place: str

    @property
    def host(self) -> str:
        return self.place.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.place.partition("/")[2]


@dataclass(frozen=True)
class GraphConfig:
    damping: float = 0.85
    tolerance: float = 1e-6
    ratio: float = 1.0
    seed_share: float = 0.5


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty where there is no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def match(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of place and verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.place), r.place)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.place).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight``: links between different hosts."""
    host, _ = split_url(F.col("url"))
    links = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?(?:https?:)?(//[^"'\s>]+)"""), F.lit(1))
    found = pages.select(host.alias("src"), F.explode(links).alias("link"))
    target, _ = split_url(F.concat(F.lit(":"), F.col("link")))
    found = found.select("src", target.alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return found.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, config: GraphConfig) -> DataFrame:
    """``host, trust, distrust``; ``seeds`` has ``kind`` (allow or block), ``host``, ``mass`` (sums to 1 a kind)."""
    arcs = edges.select(F.lit(ALLOW).alias("kind"), "src", "dst", "weight").unionByName(
        edges.select(F.lit(BLOCK).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    out = arcs.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    arcs = arcs.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("total")).alias("share"))
    arcs = common.store(arcs, "arcs", number=F.count(F.lit(1)))
    state = seeds.withColumn("new", F.col("mass"))
    moving = arcs.watched["number"]
    while moving:
        # both sides are written tables, so Spark can split a host with very many links among tasks
        step = F.greatest(config.damping * F.col("new") * F.col("share"), F.lit(LEAST))
        sent = state.where("new > 0").join(arcs, ["kind", "host"]).select("kind", F.col("dst").alias("host"), step.alias("mass"), step.alias("new"))
        after = sent.unionByName(state.select("kind", "host", "mass", F.lit(0.0).alias("new")))
        after = after.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("new").alias("new"))
        after = common.store(after, "mass", moving=F.count_if(F.col("new") > config.tolerance * F.col("mass")))
        common.drop_stored(state)
        state, moving = after, after.watched["moving"]
    whole = state.groupBy("kind").agg(F.sum("mass").alias("whole"))  # two rows at most
    shares = state.join(F.broadcast(whole), "kind")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass") / F.col("whole")).otherwise(0.0))
    return shares.groupBy("host").agg(of(ALLOW).alias("trust"), of(BLOCK).alias("distrust"))


def judge(pages: DataFrame, rules: list[Rule], config: GraphConfig = GraphConfig()) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every page."""
    host, path = split_url(F.col("url"))
    urls = common.pick(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("fit", match(F.col("host"), F.col("path"), rules))
    ruled = lambda kind: F.count_if(F.col("fit.verdict") == kind).cast("double").alias(kind)
    hosts = urls.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), ruled(ALLOW), ruled(BLOCK))
    sides = hosts.unpivot(["host", "pages"], [ALLOW, BLOCK], "kind", "n")
    seeds = sides.where((F.col("n") > 0) & (F.col("n") >= config.seed_share * F.col("pages")))
    total = seeds.groupBy("kind").agg(F.sum("n").alias("total"))  # two rows at most
    seeds = common.store(seeds.join(F.broadcast(total), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("mass")), "seeds")
    scores = propagate(host_edges(common.pick(pages, "url", "html")), seeds, config)
    judged = scores.withColumn("bad", (F.col("distrust") > 0) & (F.col("distrust") >= config.ratio * F.col("trust")))
    # pages of one host may be a third of all: a join of two tables as they are, which Spark can split
    out = urls.join(common.store(judged, "judged"), "host", "left")
    verdict = F.coalesce("fit.verdict", F.when(F.col("bad"), BLOCK).otherwise(ALLOW))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), zero("trust"), zero("distrust"))
