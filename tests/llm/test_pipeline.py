"""The pipeline, stage by stage, against plain versions over a small corpus with every odd case."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import WORD, prose, shingles, slow_tiles

import corpus_pipeline
from spindrift.llm import quality, tokens
from spindrift.llm.queries import QUALITY_THRESHOLD, tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, n long, doc_key string"


def corpus():
    rng = random.Random(31)
    passage, item = prose(rng, 60), prose(rng, 30)
    good = [prose(rng, rng.randint(30, 120)) + "." for _ in range(40)]
    bad = ["$$$ !!! ### " * rng.randint(5, 20) for _ in range(25)]
    texts = dict(enumerate(good)) | {100 + k: t for k, t in enumerate(bad)}
    texts |= {200: good[3], 201: good[3] + " more", 202: good[3].upper(), 203: good[4]}  # exact and near copies
    texts |= {300 + k: f"{prose(rng, 25)} {passage} {prose(rng, 25)}" for k in range(4)}  # a shared passage
    texts |= {400: f"{prose(rng, 20)} {item} {prose(rng, 20)}", 401: " ".join(item.split()[15:] + item.split()[:15])}
    texts |= {500: None, 501: "", 502: " \n ", 503: "one two", 504: prose(rng, 20_000)}
    rows = [(k, t) for k, t in texts.items()] + [(5, good[5]), (6, good[9]), (None, prose(rng, 50)), (None, None)]
    labels = [(k, 1) for k in range(40)] + [(100 + k, 0) for k in range(25)] + [(100, None), (9999, 1)]
    return rows, labels, [(0, item), (1, None), (2, "")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels, items = corpus()
    at = f"file://{tmp_path_factory.mktemp('corpus')}"
    full = [(k, t, "en", "web", None if t is None else len(t), "r", 1, "d") for k, t in rows]
    spark.createDataFrame(full, COLUMNS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def one_of_each(rows):
    """Rows with an id and words: of each component the smallest id, and of that id one text."""
    free = Counter({r: n for r, n in rows.items() if r[0] is None or not shingles(r[1])})
    texts = sorted({t for (d, t) in rows if (d, t) not in free}, key=str)
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    groups = defaultdict(set)
    for d, t in rows:
        if (d, t) not in free:
            groups[find(texts.index(t))].add((d, t))
    return free, [{r for r in g if r[0] == min(d for d, _ in g)} for g in groups.values()]


def without_repeats(rows):
    words = [(d, t, WORD.findall(t or "")) for (d, t), n in rows.items() for _ in range(n)]
    times = Counter(tuple(w[k : k + 35]) for _, _, w in words for k in range(len(w) - 34))
    out = Counter()
    for d, t, w in words:
        gone = {k + i for k in range(len(w) - 34) if times[tuple(w[k : k + 35])] > 1 for i in range(35)}
        out[d, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t] += 1
    return out


def leaks(text, items):
    t = re.findall(r"[A-Za-z0-9]+", text or "")
    w = [re.findall(r"[A-Za-z0-9]+", i or "") for i in items]
    fold = lambda x: [y.lower() for y in x]
    return any(i and sum(x[2] for x in slow_tiles(fold(t), fold(i), min(5, len(i)))) >= 0.5 * len(i) for i in w)


def test_stages_are_the_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.store(stage(spark, docs, folder), name)
        assert name == "packing" or docs.columns == columns
        after[name] = docs
    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), quality.QualityConfig(), ~quality.held_out("doc_id", 5, 0))
    before = spark.read.parquet(f"{folder}/documents.parquet")
    scores = quality.score(before.select(F.struct("doc_id", "text").alias("k"), "text").select(F.xxhash64("k").alias("doc_id"), "text"), model)
    good = {r.doc_id for r in scores.where(F.col("score") >= QUALITY_THRESHOLD).collect()}
    want = Counter((r.doc_id, r.text) for r in before.withColumn("h", F.xxhash64(F.struct("doc_id", "text"))).collect() if r.h in good)
    first = pairs(after["quality_classifier"])
    assert first == want
    assert {d for d, _ in first} >= set(range(40)) and not {d for d, _ in first} & set(range(100, 125))

    second = pairs(after["ngram_jaccard_join"])
    free, groups = one_of_each(first)
    assert sum(second.values()) == sum(free.values()) + len(groups)
    assert all(sum(second[r] for r in g) == 1 for g in groups) and all(second[r] == n for r, n in free.items())

    third = pairs(after["substring_dedup"])
    assert third == without_repeats(second) and third != second

    fourth = pairs(after["benchmark_decontamination"])
    items = [t for _, t in corpus()[2]]
    assert fourth == Counter({r: n for r, n in third.items() if len(r[1] or "") > 50_000 or not leaks(r[1], items)})
    assert not {400, 401} & {d for d, _ in fourth}

    pieces = defaultdict(list)
    for r in after["packing"].collect():
        pieces[r.doc_id].append(r)
    ids = {d: Counter() for d, _ in fourth}
    t = tokens.Tokenizer(tokenizer_path())
    for (d, text), n in fourth.items():
        ids[d][hashlib.sha256(t.encode([text])[0] + np.array([1], "<u4").tobytes()).hexdigest()] += n
    for d, rows in pieces.items():
        if sum(ids[d].values()) == 1:
            whole = b"".join(r.ids for r in sorted(rows, key=lambda r: r.start))
            assert Counter([hashlib.sha256(whole).hexdigest()]) == ids[d]
    once = corpus_pipeline.run(spark, folder).agg(F.sum("length")).first()[0]
    assert once == sum(r.length for rows in pieces.values() for r in rows) == sum((len(t.encode([x])[0]) // 4 + 1) * n for (_, x), n in fourth.items())


def test_empty_table(spark, folder, tmp_path):
    at = f"file://{tmp_path}"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0
