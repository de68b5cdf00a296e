"""The registered queries over the small tables, against plain versions."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest

import __spark_entry__ as contract
from spindrift.llm.queries import ORACLE_SQL, QUERIES


def rows(sf_dir, sql):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con.execute(sql).fetchall()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_over_its_whole_table(spark, sf_dir, name):
    out = QUERIES[name](spark, sf_dir)
    table = {"op4": "pages", "op9": "pages", "op6": "embeddings"}.get(name.split("_")[0], "documents")
    (n,) = rows(sf_dir, f"select count(*) from {table}")[0]
    got = out.count()
    assert got >= n if name.startswith("op2") else got <= n if name.startswith("op7") else got == n


def test_held_out_columns(spark, sf_dir):
    for r in QUERIES["op5_ppm_language"](spark, sf_dir).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_archive_digests(spark, sf_dir):
    want = {i: hashlib.sha256((h or "").encode()).hexdigest() for i, h in rows(sf_dir, "select page_id, html from pages")}
    assert {r.page_id: r.payload_digest for r in QUERIES["op9_warc_boundary_chain"](spark, sf_dir).collect()} == want


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_are_the_sql_s(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = rows(sf_dir, f"select {', '.join(got.columns)} from ({ORACLE_SQL[name]})")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_hosts_and_rules_are_the_sql_s(spark, sf_dir):
    sql = """
        with u as (select page_id, case when contains(url, '://') then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*') else '' end as host, url from pages),
        p as (select page_id, coalesce(translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
            coalesce(case when contains(url, '://') then regexp_extract(substr(url, instr(url, '://') + 3 + length(host)), '^[^?#]*') else '' end, '') as path from u),
        r(rule, host, path) as (values ('net/', 'net', '/'), ('example.net/en/', 'example.net', '/en/'), ('example.com/de/', 'example.com', '/de/'), ('org/fr/', 'org', '/fr/'))
        select page_id, p.host, p.path, (select rule from r where (p.host = r.host or p.host like '%.' || r.host) and starts_with(p.path, r.path) order by length(rule) desc limit 1) from p"""
    got = QUERIES["op4_link_graph_url_filter"](spark, sf_dir).select("page_id", "host", "path", "rule").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows(sf_dir, sql)))


def test_contract_has_them_all():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries()) and set(ORACLE_SQL) <= set(contract.oracle_sql())
