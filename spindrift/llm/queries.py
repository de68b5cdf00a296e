"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import common

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens: one row per piece."""
    from spindrift.llm import packing

    out = packing.pack(common.table(spark, sf_dir, "documents"), packing.PackingConfig(tokenizer_path()))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@_query
def op3_viterbi_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens every document has under the pieces of a public vocabulary, read as unigram.

    The file is a BPE model: its scores are merge ranks, not log-probabilities. Counts are those of the
    ``tokenizers`` Unigram model of these pieces and not of sentencepiece with the file (README).
    """
    import public_tokenizers

    from spindrift.llm import viterbi

    return viterbi.token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


#: A document is of good quality from this score on.
QUALITY_THRESHOLD = 0.3


@_query
def op1_attention_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, by a model that never saw the held-out fifth."""
    from spindrift.llm import quality

    documents, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = quality.train(documents, labels, quality.QualityConfig(), ~quality.held_out("doc_id", 5, 0))
    return quality.score(documents, model).select(
        "doc_id",
        quality.held_out("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


@_query
def op5_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by trees that never saw the held-out quarter."""
    from spindrift.llm import langid, quality

    documents = common.table(spark, sf_dir, "documents")
    model = langid.train(documents, langid.LangConfig(), ~quality.held_out("doc_id", 4, 2))
    out = langid.predict(documents, model)
    return out.select("doc_id", quality.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@_query
def op4_link_graph_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    from spindrift.llm.urlgraph import Rule, judge

    rules = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")]
    return judge(common.table(spark, sf_dir, "pages"), rules)


@_query
def op9_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of archives in the shared folder, read back from there."""
    from spindrift.llm import warc

    path = common.new_path(spark, "warc")
    number = lambda c: F.regexp_extract(c, "^<urn:spindrift:page:(-?[0-9]+)>$", 1).try_cast("long")
    with common.workspace(spark) as keep:
        warc.write(common.table(spark, sf_dir, "pages"), path)
        found = warc.read(spark, path).select(
            number("record_id").alias("page_id"),
            "payload_bytes",
            "payload_digest",
            F.col("type").alias("record_type"),
            number("refers_to").alias("refers_to"),
            "intact",
        )
        found = keep(found, "pages")
    common.delete_path(spark, path)  # the query's answer is in the digests; warc.write keeps its archives
    return found


@_query
def op6_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more between vectors of one label, and their components."""
    from spindrift.llm import vectors

    return vectors.links(common.table(spark, sf_dir, "embeddings"), vectors.VectorConfig(threshold=0.98))


@_query
def op7_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which it holds half or more."""
    from spindrift.llm import decontaminate

    found = decontaminate.leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "item_words", "marked_words", F.size("tiles").alias("n_tiles"))


@_query
def op10_debruijn_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the words of repeated 35-word windows."""
    from spindrift.llm import substrings

    out = substrings.deduplicate(common.table(spark, sf_dir, "documents"), substrings.SubstringConfig())
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@_query
def op8_adaptive_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 5-word shingles have a similarity of 0.8 or more."""
    from spindrift.llm import jaccard

    return jaccard.similar_components(common.table(spark, sf_dir, "documents"), jaccard.JaccardConfig())


ORACLE_SQL["op9_warc_boundary_chain"] = """
with p as (
    select page_id, coalesce(html, '') as html from pages
), d as (
    select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from p
), k as (
    select *, min(page_id) over (partition by payload_digest) as keeper from d
), r as (
    select *, coalesce(payload_bytes >= 100 and page_id > keeper, false) as revisit from k
)
select page_id, payload_bytes, payload_digest,
    case when revisit then 'revisit' else 'response' end as record_type,
    case when revisit then keeper end as refers_to, true as intact
from r
"""

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

#: Components as the transitive closure of links (a, b) in both directions.
_REACH = """
), reach(a, b) as (
    select distinct a, a from links union select reach.a, links.b from reach join links on links.a = reach.b
), least as (
    select a, min(b) as least from reach group by a
)
"""

ORACLE_SQL["op6_epsilon_grid_join"] = f"""
with recursive parts as (
    select vec_id, label, embedding::double[] as v from embeddings where vec_id is not null and label is not null and embedding is not null
), usable as (
    select vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from parts
    where len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(v, v) > 0
), links as (
    select x.vec_id as a, y.vec_id as b from usable x join usable y using (label)
    where x.vec_id <> y.vec_id and len(x.u) = len(y.u) and list_dot_product(x.u, y.u) >= 0.98
{_REACH}, counts as (
    select a, count(*) as n from links group by a
)
select e.vec_id, coalesce(n, 0)::bigint as n_links, coalesce(least, e.vec_id) as component_id, coalesce(least, e.vec_id) = e.vec_id as kept
from embeddings e left join counts on counts.a = e.vec_id left join least on least.a = e.vec_id
"""

ORACLE_SQL["op8_adaptive_prefix_jaccard"] = f"""
with recursive split as (
    select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents
), sets as (
    select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [list_aggregate(w, 'string_agg', ' ')]
        else list_transform(range(1, len(w) - 3), lambda k: list_aggregate(w[k:k + 4], 'string_agg', ' ')) end)) as s from split
), classes as (
    select s, len(s) as n, row_number() over () as c from (select distinct s from sets where len(s) > 0)
), shingles as (
    select c, n, unnest(s) as shingle from classes
), pairs as (
    select x.c as a, y.c as b from shingles x join shingles y using (shingle)
    where x.c <> y.c and 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
    group by x.c, y.c, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))
), links as (
    select a, b from pairs
{_REACH}, ids as (
    select doc_id, s, c, coalesce(least, c) as root from sets join classes using (s) left join least on least.a = c
), named as (
    select root, min(doc_id) as component_id from ids group by root
)
select doc_id, len(sets.s)::bigint as n_shingles, coalesce(component_id, sets.doc_id) as component_id
from sets left join ids using (doc_id) left join named using (root)
"""

ORACLE_SQL["op10_debruijn_substring_dedup"] = f"""
with split as (
    select row_number() over () as r, doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents
), starts as (
    select r, k, list_aggregate(w[k:k + 34], 'string_agg', ' ') as seq from (select r, w, unnest(range(1, len(w) - 33)) as k from split)
), again as (
    select r, k, count(*) over (partition by seq) > 1 as again from starts
), places as (
    select r, unnest(range(1, len(w) + 1)) as k, unnest(w) as word from split
), marked as (
    select r, k, word, coalesce(bool_or(again) over (partition by r order by k rows between 34 preceding and current row), false) as gone
    from places left join again using (r, k)
), kept as (
    select r, count_if(gone) as n_removed, coalesce(string_agg(word, ' ' order by k) filter (where not gone), '') as text from marked group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
from split left join kept using (r)
"""
