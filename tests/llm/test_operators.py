"""The training-data operators against brute force, and their cases of null, empty, repeated and clashing rows."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.llm import bloom, common, decontaminate, jaccard, langid, packing, quality, substrings, tokens, urlgraph, vectors, viterbi, warc, words
from spindrift.llm.components import components
from spindrift.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "an er th in on re es ti or ha wh ble ing ed".split()
DOCS = "doc_id long, text string"


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus():
    rng = random.Random(11)
    base, shared = prose(rng, 120), prose(rng, 60)
    rows = [(k, prose(rng, rng.randint(1, 150))) for k in range(30)]
    rows += [(100 + k, base) for k in range(6)]
    for k in range(25):  # near copies, with more and more words changed
        w = base.split(" ")
        for p in rng.sample(range(len(w)), k // 3):
            w[p] = prose(rng, 1)
        rows.append((200 + k, " ".join(w)))
    rows += [(300 + k, prose(rng, 20) + "\n" + shared + "\t" + prose(rng, 20)) for k in range(5)]
    rows += [(400, "a " * 90), (401, "x y " * 60), (402, base.upper()), (403, " ".join(shared.split(" ")[:35])), (404, " ".join(shared.split(" ")[5:39]))]
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "one"), (504, "one"), (505, "One two"), (506, "é ß\x0bü\x0c日本 \u00a0x"), (507, prose(rng, 3000)), (None, base), (None, None)]
    rows += [(508, "w" * 70_000 + " " + prose(rng, 12_000))]
    return rows + [(300, rows[61][1]), (100, base)]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


def clashing(df):
    """The same rows with extra columns whose names the operators use themselves."""
    out = df
    for name in ("n", "row", "spans", "cls", "label", "score", "kept", "kmer", "doc_key", "ids", "component_id"):
        out = out.withColumn(name, F.lit(f"extra {name}"))
    return out


# --- words, filter, components ----------------------------------------------------------
def test_words_are_the_pattern_s():
    texts = [t for _, t in corpus()] + ["\x1c\x85a b"]
    w = words.words(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        found = [w.data[a:b].tobytes().decode() for a, b in zip(w.start[w.of[k] : w.of[k + 1]], w.end[w.of[k] : w.of[k + 1]], strict=True)]
        assert found == WORD.findall(t or "")
    seen = {}
    for a, b, h in zip(w.start, w.end, w.hash, strict=True):
        assert seen.setdefault(w.data[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)
    part = words.words(pa.array(["zz", *texts], pa.string()).slice(1))
    assert (part.hash == w.hash).all()


def test_bloom(spark):
    keys = spark.range(5000).select((F.col("id") * 7919).alias("k"))
    b = bloom.Bloom(bloom.build(keys, 5000).value)
    assert b.might_hold(np.arange(5000) * 7919).all()
    assert b.might_hold(np.arange(5000) * 7919 + 1).mean() < 0.05
    assert not bloom.Bloom(bloom.build(keys.limit(0), 0).value).might_hold(np.arange(10)).any()


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_unstable_components_are_an_error(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(chain, most_rounds=1)


# --- packing --------------------------------------------------------------------------
def test_fast_ids_are_the_library_s():
    rng = random.Random(4)
    texts = [t for _, t in corpus()] + ["a  b", "a   b\n\n c", "don't 's't", "5,000.5%", "<|endoftext|> hi", "\u3000x\u2028y", "🙂🙂 a\u0301"]
    texts += ["".join(rng.choice("ab '\n\té日1_.,🙂") for _ in range(40)) for _ in range(300)]
    t = tokens.Tokenizer(tokenizer_path())
    assert t.fast is not None
    for text, ids in zip(texts, t.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.library.encode(text or "", add_special_tokens=False).ids


def test_assignment():
    config = packing.PackingConfig("", max_tokens=64)
    rng = random.Random(1)
    for _ in range(50):
        lengths = [rng.randint(1, 200) for _ in range(rng.randint(1, 30))]
        pieces, caps = packing.assign(lengths, config)
        assert sum(caps) == sum(lengths) and all(c == 64 or c & (c - 1) == 0 for c in caps)
        for side, size in ((0, lengths), (3, caps)):
            for k, n in enumerate(size):
                at = 0
                for p in sorted((p for p in pieces if p[side] == k), key=lambda p: p[1] if side == 0 else p[4]):
                    assert (p[1] if side == 0 else p[4]) == at
                    at += p[2]
                assert at == n
    assert packing.assign([], config) == ([], [])


def test_descending_documents_go_to_the_cheapest_sequence_with_room():
    config = packing.PackingConfig("", max_tokens=64, quadratic=1 / 32)
    rng = random.Random(9)
    for _ in range(60):
        lengths = [rng.choice([1, 7, 20, 20, 40, 64, 90, 130]) for _ in range(rng.randint(1, 25))]
        pieces, caps = packing.assign(lengths, config)
        free, cost = dict(enumerate(caps)), dict.fromkeys(range(len(caps)), 0.0)
        whole = [p for d, n in enumerate(lengths) for p in [(d, 64 * k, 64) for k in range(n // 64)]]
        want = []
        for s, (d, start, n) in enumerate(whole):
            want.append((d, start, n, s, 0))
            free[s] = 0
        rest = sorted(((n % 64, d, n // 64 * 64) for d, n in enumerate(lengths) if n % 64), key=lambda r: (-r[0], r[1]))
        for n, d, start in rest:
            while n:
                room = [s for s in free if free[s] >= n]
                s = min(room, key=lambda s: (cost[s], s)) if room else max(free, key=lambda s: (free[s], -s))
                take = min(n, free[s])
                want.append((d, start, take, s, caps[s] - free[s]))
                free[s], cost[s] = free[s] - take, cost[s] + take + take * take / 32
                start, n = start + take, n - take
        assert pieces == want


def test_packing_round_trip(spark, docs):
    config = packing.PackingConfig(tokenizer_path(), max_tokens=256, block_tokens=2000)
    rows = packing.pack(clashing(docs), config).collect()
    library = tokens.Tokenizer(tokenizer_path()).library
    want = Counter((i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in corpus())
    whole = Counter()
    for i in {r.doc_id for r in rows}:
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: (r.sequence_id, r.offset))
        assert sum(r.length for r in mine) == sum(len(k[1]) // 4 * n for k, n in want.items() if k[0] == i)
        if sum(n for k, n in want.items() if k[0] == i) == 1:
            whole[i, b"".join(bytes(r.ids) for r in sorted(mine, key=lambda r: r.start))] += 1
    assert all(want[k] == 1 for k in whole)
    for s in {r.sequence_id for r in rows}:
        mine = sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset)
        assert [r.offset for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
        n = sum(r.length for r in mine)
        assert n <= 256 and n & (n - 1) == 0 and n == mine[0].sequence_capacity
    assert packing.pack(docs.limit(0), config).count() == 0


# --- token counts ---------------------------------------------------------------------
def test_counts_are_the_library_s(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer, models, normalizers

    rng = random.Random(6)
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [t for _, t in corpus()] + ["a  b", "  a   b\n\n c ", " ", "🙂🙂 a\u0301", "<s> <0x0A>", "\u2581a \u2581"]
    texts += ["".join(rng.choice("abtheing  '\n\té日1_.,🙂") for _ in range(40)) for _ in range(200)]
    small = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("\u2581", -1.0), ("\u2581a", -2.0), ("ba", -2.0), ("aba", -3.0)]
    for pieces in (viterbi.pieces_of(path), small, [(p, s - 0.5) for p, s in small]):
        counter = viterbi.UnigramCounter(pieces)
        library = Tokenizer(models.Unigram(pieces, 0, counter.byte_pieces))
        library.normalizer = normalizers.Sequence([normalizers.Prepend("\u2581"), normalizers.Replace(" ", "\u2581")])
        assert counter.by_word == (len(pieces) > 10)
        for t, (n, _) in zip(texts, counter.counts(texts), strict=True):
            assert n == len(library.encode(t or "", add_special_tokens=False).ids), t
    got = Counter((r.doc_id, r.n_tokens) for r in viterbi.token_counts(clashing(docs), path).collect())
    assert got == Counter((i, viterbi.UnigramCounter.shared(path).counts([t])[0][0]) for i, t in corpus())
    assert viterbi.token_counts(docs.limit(0), path).count() == 0


# --- quality and language -------------------------------------------------------------
def labelled(n=300):
    rng = random.Random(9)
    rows = []
    for k in range(n):
        good = rng.random() < 0.7
        parts = [prose(rng, 40) for _ in range(rng.randint(1, 5))]
        if not good:
            parts[rng.randrange(len(parts))] = " ".join(w + "&&&" for w in prose(rng, 40).split(" "))
        rows.append((k, "\n".join(parts), int(good)))
    return rows


def test_quality_on_held_out(spark):
    rows = labelled()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (None, "x")], DOCS)
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(5, None, 0), (77777, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(clashing(docs), clashing(labels), quality.QualityConfig(), ~quality.held_out("doc_id", 5, 0))
    got = {r.doc_id: r.score for r in quality.score(clashing(docs), model).collect()}
    assert len(got) == 303 and all(0 <= s <= 1 for s in got.values())
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 30 and np.mean([(got[r[0]] >= 0.5) == r[2] for r in held]) > 0.95
    kept = quality.keep_good(clashing(docs), model, 0.3)
    assert kept.columns == clashing(docs).columns
    assert {r.doc_id for r in kept.collect()} == {k for k, s in got.items() if s >= 0.3}
    # attention: weights of a bag sum to 1, and the spoilt passage of a bad document has the most
    x, count = quality.encode(pa.array([next(r[1] for r in rows if not r[2])]), 256)
    assert abs(model.bags(x, count)["a"].sum() - 1) < 1e-6


def test_features_do_not_depend_on_neighbours():
    texts = ["zz", "a", "a", None, "", "!", "a", "b c " * 200, "a"]
    x, count = quality.encode(pa.array(texts, pa.string()), 256)
    alone = [quality.encode(pa.array([t], pa.string()), 256) for t in texts]
    assert (count == np.concatenate([n for _, n in alone])).all() and (x == np.concatenate([f for f, _ in alone])).all()


def test_scores_are_a_slow_scorer_s_one_text_at_a_time(spark):
    rng = random.Random(21)
    rows = [(k, prose(rng, rng.randint(1, 200))) for k in range(60)] + [(100, None), (101, ""), (102, "?"), (103, "x" * 200_000)]
    rows += [(200 + k, t) for k, (_, t) in enumerate(rows)]  # the same texts again
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(3, 0), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels, quality.QualityConfig(epochs=2))
    w, sigmoid = model.weights, lambda x: 1 / (1 + np.exp(-x))

    def slow(text):
        data, counts = (text or "").encode(), []
        for at in range(0, max(1, len(data)), 256):
            x, before = np.zeros(257), None if at == 0 else data[at - 1]
            for b in data[at : at + 256]:
                x[quality._CLASS[b] * 16 + (quality._CLASS[before] if before is not None else 0)] += 1  # noqa: SLF001
                before = b
            n = x.sum()
            x[:256] = np.sqrt(x[:256] / max(n, 1)) * 4
            x[256] = np.log1p(n) / 4
            counts.append(x)
        h = np.tanh((np.array(counts) - model.mean) @ w["W"] + w["b"])
        s = (np.tanh(h @ w["V"]) * sigmoid(h @ w["U"])) @ w["w"]
        a = np.exp(s - s.max())
        return sigmoid((a / a.sum()) @ h @ w["c"] + w["d"])[0]

    got = {r.doc_id: r.score for r in quality.score(clashing(docs.repartition(5)), model).collect()}
    assert len(got) == len(rows) and all(abs(got[k] - slow(t)) < 1e-4 for k, t in rows)
    other = {r.doc_id: r.score for r in quality.score(docs.orderBy(F.desc("doc_id")).coalesce(1), model).collect()}
    assert all(abs(got[k] - other[k]) < 1e-5 for k in got)
    assert quality.score(docs.limit(0), model).count() == 0


def test_gradients():
    c = quality.QualityConfig(hidden=3, gate=2)
    rng = np.random.default_rng(0)
    m = quality.QualityModel(c)
    m.mean = np.zeros(quality.FEATURES)
    m.weights = {"W": rng.normal(size=(quality.FEATURES, 3)) * 0.1, "b": rng.normal(size=3), "V": rng.normal(size=(3, 2)), "U": rng.normal(size=(3, 2)), "w": rng.normal(size=2), "c": rng.normal(size=3), "d": rng.normal(size=1)}
    x, count, y = rng.normal(size=(7, quality.FEATURES)), np.array([2, 1, 4]), np.array([1.0, 0, 1])
    loss = lambda: -np.sum(y * np.log(m.bags(x, count)["p"]) + (1 - y) * np.log(1 - m.bags(x, count)["p"]))
    f = m.bags(x, count)
    g = m._gradients(x, count, f, f["p"] - y)  # noqa: SLF001
    for k, w in m.weights.items():
        at = tuple(rng.integers(0, s) for s in w.shape)
        keep, e = w[at], 1e-5
        w[at] = keep + e
        up = loss()
        w[at] = keep - e
        down = loss()
        w[at] = keep
        assert abs((up - down) / (2 * e) - g[k][at]) < 1e-4, k


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none, quality.QualityConfig())
    assert {r.score for r in quality.score(docs, model).collect()} == {1.0}


def test_code_lengths_are_ppm_s():
    rng = random.Random(3)
    train = {"x": "".join(rng.choice("abc") for _ in range(80)), "y": "".join(rng.choice("cde") for _ in range(60))}
    order, counts = 2, Counter()
    for k, t in train.items():
        padded = "\0" * order + t
        counts.update((k, padded[i : i + order + 1]) for i in range(len(t)))
    keys = sorted(counts)
    grams = np.array([int.from_bytes(g.encode(), "big") for _, g in keys])
    model = langid.build(["x", "y"], grams, np.array([0 if k == "x" else 1 for k, _ in keys]), np.array([counts[k] for k in keys], float), order)

    def slow(k, text):
        total, padded = 0.0, "\0" * order + text
        for i, b in enumerate(text):
            p, factor = None, 1.0
            for o in range(order, -1, -1):
                c = padded[i + order - o : i + order]
                seen = Counter()
                for (kk, g), n in counts.items():
                    if kk == k and g[order - o : order] == c:
                        seen[g[-1]] += n
                if not seen:
                    continue
                n, d = sum(seen.values()), len(seen)
                if b in seen:
                    p = factor * seen[b] / (n + d)
                    break
                factor *= d / (n + d)
            total -= np.log2(p if p is not None else factor / 256)
        return total

    texts = ["abcabcddz", "", "eee", "zq", "cabé"]
    texts[-1] = "cab"
    got = model.lengths(pa.array(texts))
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, [slow("x", t), slow("y", t)], atol=1e-3)


def test_training_counts_are_a_plain_count_s(spark):
    rng = random.Random(17)
    rows = [(k, "".join(rng.choice("Abc d\u00e9") for _ in range(rng.randint(0, 30))), rng.choice(["x", "y", None])) for k in range(50)]
    rows += [rows[0], (60, None, "x")]
    model = langid.train(spark.createDataFrame(rows, DOCS + ", lang string").repartition(3), langid.LangConfig(max_documents=10**6))
    counts = Counter()
    for _, t, lang in rows:
        b = (t or "").translate(UPPER).encode()
        counts.update((lang, (b"\0" * 3 + b)[i : i + 4]) for i in range(len(b)) if lang)
    keys = sorted(counts)
    want = langid.build(["x", "y"], np.array([int.from_bytes(g, "big") for _, g in keys]), np.array(["xy".index(k) for k, _ in keys]), np.array([counts[k] for k in keys], float), 3)
    texts = pa.array(["abc d", "", "éé b", "zzz", "d" * 3000])
    assert model.order == 3 and np.allclose(model.lengths(texts), want.lengths(texts))


def test_equal_code_lengths_go_to_the_smaller_name(spark):
    rows = [(k, "same text", lang) for k in range(6) for lang in ("b", "a", "c")] + [(9, "same text", None)] * 2
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    got = langid.predict(docs, langid.train(docs, langid.LangConfig())).collect()
    assert len(got) == len(rows) and {(r.lang_pred, round(r.score, 6)) for r in got} == {("a", 0.333333)}


def test_language(spark):
    rng = random.Random(8)
    words_ = {"en": "the of and to in is".split(), "de": "der die und für ist ein".split()}
    rows = [(k, " ".join(rng.choice(words_[lang]) for _ in range(12)), lang) for k in range(160) for lang in [rng.choice(["en", "de"])]]
    odd = [(900, None, "en"), (901, "123 !?", "en"), (902, "", None), (903, "the of", None), (904, "日本", None)]
    docs = spark.createDataFrame(rows + odd, DOCS + ", lang string")
    model = langid.train(clashing(docs), langid.LangConfig(), ~quality.held_out("doc_id", 4, 2))
    got = {r.doc_id: r for r in langid.predict(clashing(docs), model).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0 and got[903].lang_pred == "en"
    assert got[904].lang_pred in ("en", "de")
    assert langid.train(docs.limit(0), langid.LangConfig()) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    long = pa.array(["the of " * 200_000, "und"])
    short = model.lengths(pa.array(["the of " * 200_000]))
    assert np.allclose(model.lengths(long)[0], short[0])


# --- urls -----------------------------------------------------------------------------
def test_urls(spark):
    rules = [urlgraph.Rule("block", "net/"), urlgraph.Rule("allow", "example.net/en/"), urlgraph.Rule("block", "example.com/de/"), urlgraph.Rule("allow", "org/fr/")]
    link = lambda *hosts: " ".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [
        (0, "http://A.net/x", "", "a.net", "/x", "net/", "block"),
        (1, "https://m.example.NET/en/1?x#y", link("friend.com"), "m.example.net", "/en/1", "example.net/en/", "allow"),
        (2, "http://net", "", "net", "", None, "allow"),
        (3, "x://example.com/de/?q", "", "example.com", "/de/", "example.com/de/", "block"),
        (4, "http://notexample.com/de/", "", "notexample.com", "/de/", None, "allow"),
        (5, "http://b.org/fr/", "", "b.org", "/fr/", "org/fr/", "allow"),
        (6, None, None, "", "", None, "allow"),
        (7, "no scheme", link("a.net"), "", "", None, "allow"),
        (8, "http://spam.com/1", link("a.net", "a.net", "friend.com"), "spam.com", "/1", None, "block"),
        (9, "http://friend.com?x/y", "", "friend.com", "", None, "allow"),
        (10, "http://c.com#/net/://d.net/", "", "c.com", "", None, "allow"),
        (11, "http://É.com:80/Ä\nb?c", "", "É.com:80", "/Ä\nb", None, "allow"),
        (8, "http://spam.com/1", link("a.net"), "spam.com", "/1", None, "block"),
    ]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = sorted(map(tuple, urlgraph.judge(clashing(pages), rules).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == sorted(((r[0], *r[3:6], r[6]) for r in rows), key=str)
    assert urlgraph.judge(pages.limit(0), rules).count() == 0


def test_propagation_is_personalised_pagerank(spark):
    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "a", 1.0), ("c", "d", 3.0)]
    names = sorted({x for e in edges for x in e[:2]})
    config = urlgraph.GraphConfig(tolerance=1e-9, damping=0.6)

    def slow(arcs, seed):
        p = dict(seed)
        for _ in range(300):
            new = {n: 0.0 for n in names}
            for s, d, w in arcs:
                new[d] += p.get(s, 0) * w / sum(x[2] for x in arcs if x[0] == s)
            kept = sum(new.values())
            p = {n: config.damping * new[n] + (1 - config.damping * kept) * seed.get(n, 0) for n in names}
        return p

    seeds = spark.createDataFrame([("allow", "a", 1.0), ("block", "d", 1.0)], "kind string, host string, mass double")
    got = {r.host: r for r in urlgraph.propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), seeds, config).collect()}
    trust, distrust = slow(edges, {"a": 1.0}), slow([(d, s, w) for s, d, w in edges], {"d": 1.0})
    for n in names:
        assert abs(got[n].trust - trust[n]) < 1e-7 and abs(got[n].distrust - distrust[n]) < 1e-7


def test_verdicts_do_not_depend_on_the_table_s_size(spark):
    link = lambda host: f'<a href="http://{host}/x">'
    rows = [(0, "http://bad.net/", "")] + [(1 + k, f"http://s{k}.com/", link("bad.net")) for k in range(900)] + [(990, "http://far.com/", link("s0.com")), (991, "http://fine.com/", "")]
    local = spark.createDataFrame(rows, "page_id long, url string, html string")
    many = spark.range(1000, 2_001_000).select(F.col("id").alias("page_id"), F.lit("http://huge.net/").alias("url"), F.lit("").alias("html"))
    for pages in (local, local.unionByName(many)):
        judged = urlgraph.judge(pages, [urlgraph.Rule("block", "net/")]).where("page_id < 1000").collect()
        assert {r.page_id for r in judged if r.verdict == "allow"} == {991}


def test_distrust_reaches_every_distance(spark):
    link = lambda k: f'<a href="http://h{k}.com/x">'
    rows = [(0, "http://bad.net/", ""), (1, "http://h1.com/", '<a href="http://bad.net/">')] + [(k, f"http://h{k}.com/", link(k - 1)) for k in range(2, 18)] + [(99, "http://fine.com/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in urlgraph.judge(pages, [urlgraph.Rule("block", "net/")], urlgraph.GraphConfig(damping=0.5)).collect()}
    assert {k for k, r in got.items() if r.verdict == "allow"} == {99}
    total = sum(0.5**k for k in range(18))  # of what a hop has, half walks on and half starts again
    assert all(abs(got[k].distrust - 0.5**k / total) < 1e-5 * 0.5**k for k in range(18))


def test_long_urls_and_even_scores(spark):
    rules = [urlgraph.Rule("block", "bad/"), urlgraph.Rule("allow", "good/")]
    link = lambda h: f'<a href="http://{h}/">'
    long = "http://even/" + "p" * 100_000
    rows = [(0, "http://bad/", None), (1, "http://good/", link("even")), (2, long, link("bad") + "x" * 300_000), (3, "HTTP://" + "H" * 70_000 + "?q", ""), (None, None, None)]
    got = {r.page_id: r for r in urlgraph.judge(clashing(spark.createDataFrame(rows, "page_id long, url string, html string")), rules).collect()}
    assert len(got[2].path) == 100_001 and got[3].host == "h" * 70_000 and got[3].path == ""
    # the host takes as much trust from the good as distrust from the bad: a tie blocks
    assert got[2].trust == got[2].distrust > 0 and got[2].verdict == "block" and got[3].verdict == got[None].verdict == "allow"


# --- vectors --------------------------------------------------------------------------
def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 8))
    rows = []
    for k in range(240):
        rows.append([k, (base[k % 12] * (1 + k % 3) + rng.normal(size=8) * 0.05 * (k % 5)).astype(np.float32).tolist(), [0, 1, None][k % 7 % 3]])
    rows += [[300 + k, rows[0][1], 0] for k in range(30)]
    rows += [[400, None, 0], [401, [0.0] * 8, 0], [402, [None, *[1.0] * 7], 0], [403, [float("nan")] * 8, 0], [404, [], 0], [405, rows[0][1], None], [406, [1.0, 2.0], 0], [407, [1.0, 2.0], 0], [408, [float("inf"), *[1.0] * 7], 1]]
    # ids of several rows: equal ones, unlike ones of one label and of two, one that is no vector
    rows += [[7, rows[7][1], rows[7][2]], [9, rows[14][1], rows[9][2]], [9, rows[20][1], 1], [11, None, 0], [None, rows[0][1], 0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    for config in (vectors.VectorConfig(), vectors.VectorConfig(block=16, leaf=4)):
        got = Counter(tuple(r) for r in vectors.links(clashing(df.withColumnRenamed("label", "l")).withColumn("label", F.col("l")), config).collect())
        ok = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        n, parent = Counter(), {r[0]: r[0] for r in rows if r[0] is not None}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for (i, a), (j, b) in combinations(enumerate(rows), 2):
            if None not in (a[0], b[0], a[2]) and a[2] == b[2] and ok(a[1]) and ok(b[1]) and len(a[1]) == len(b[1]):
                u, v = np.array(a[1]), np.array(b[1])
                if u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= 0.98:
                    n[i] += 1
                    n[j] += 1
                    x, y = sorted((find(a[0]), find(b[0])))
                    parent[y] = x
        assert got == Counter((r[0], n[i], find(r[0]), find(r[0]) == r[0]) if r[0] is not None else (None, 0, None, True) for i, r in enumerate(rows))
    exact = spark.createDataFrame([[1, [1.0, 0.0], 0], [2, [3.0, 4.0], 0]], "vec_id long, embedding array<double>, label int")
    assert [r.n_links for r in vectors.links(exact, vectors.VectorConfig(threshold=0.6)).collect()] == [1, 1]
    assert vectors.links(df.limit(0)).count() == 0


# --- benchmark ------------------------------------------------------------------------
def slow_tiles(text, item, least):
    a, b, tiles = [False] * len(text), [False] * len(item), []
    while True:
        best = None
        for j in range(len(item)):
            for i in range(len(text)):
                k = 0
                while i + k < len(text) and j + k < len(item) and text[i + k] == item[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k >= least and (best is None or k > best[0]):
                    best = (k, j, i)
        if best is None:
            return sorted(tiles)
        k, j, i = best
        a[i : i + k] = b[j : j + k] = [True] * k
        tiles.append((i, j, k))


def hashes(letters):
    return words.words(pa.array([" ".join(letters)])).hash


def test_tiling():
    rng = random.Random(5)
    for _ in range(150):
        letters = "abcdef"[: rng.choice([1, 2, 6])]
        item = [rng.choice(letters) for _ in range(rng.randint(1, 20))]
        text = [rng.choice(letters) for _ in range(rng.randint(1, 30))]
        cut = rng.randrange(len(item))
        text += item[cut:] + [rng.choice(letters)] + item[:cut]
        assert sorted(decontaminate.tile(hashes(text), hashes(item), 3)) == slow_tiles(text, item, 3)


def test_tiling_of_texts_that_repeat_themselves():
    tracemalloc.start()
    tiles = decontaminate.tile(hashes(["w"] * 20_000), hashes(["w"] * 600), 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tiles == [(0, 0, 600)] and most < 50e6


def test_leaks_are_brute_force_s(spark):
    rng = random.Random(12)
    items = [(k, " ".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 3, 5, 8, 14])))) for k in range(24)]
    rows = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))) for k in range(40)]
    rows += [(100, rows[3][1]), (3, rows[3][1]), (101, ". ".join(t for _, t in items))]
    want = Counter()
    for d, text in rows:
        for k, item in items:
            t, w = re.findall("[a-d]", text), item.split()
            marked = sum(x[2] for x in slow_tiles(t, w, min(5, len(w)))) if w else 0
            if w and marked / len(w) >= 0.5:
                want[d, k, marked] += 1
    docs, bench = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for config in (decontaminate.TilingConfig(), decontaminate.TilingConfig(block_words=12)):
        assert Counter((r.doc_id, r.item_id, r.marked_words) for r in decontaminate.leaks(docs, bench, config).collect()) == want
        left = {d for d, _ in rows} - {d for d, _, _ in want}
        assert {r.doc_id for r in decontaminate.without_leaks(docs, bench, config).collect()} == left


def test_leaks(spark):
    rng = random.Random(7)
    items = [(k, prose(rng, 30)) for k in range(5)] + [(5, "a b"), (6, None), (7, "")]
    w = items[0][1].split(" ")
    rows = [(0, prose(rng, 50)), (1, prose(rng, 20) + " " + items[1][1].upper() + "! " + prose(rng, 5)), (2, " ".join(w[15:] + ["x"] + w[:15])), (3, " ".join(w[:10])), (4, None), (5, ""), (6, "a b"), (1, items[1][1]), (None, items[2][1])]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    for config in (decontaminate.TilingConfig(), decontaminate.TilingConfig(block_words=31)):
        got = decontaminate.leaks(clashing(docs), clashing(bench), config).collect()
        assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == [(1, 1), (1, 1), (2, 0), (6, 5), (None, 2)]
        assert all(r.coverage == 1 and r.marked_words in (30, 2) for r in got) and next(len(r.tiles) for r in got if r.doc_id == 2) == 2
        kept = decontaminate.without_leaks(clashing(docs), bench, config)
        assert kept.columns == clashing(docs).columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


# --- near copies ----------------------------------------------------------------------
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("config", [jaccard.JaccardConfig(), jaccard.JaccardConfig(light=2, block_rows=4, cells=1 << 12), jaccard.JaccardConfig(light=1000)])
def test_near_copies(spark, docs, config):
    rows = corpus()
    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in combinations(zip((i for i, _ in rows), sets, strict=True), 2):
        if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = sorted(map(tuple, jaccard.similar_components(clashing(docs), config).collect()), key=str)
    assert got == sorted(((i, len(s), find(i) if i is not None else None) for (i, _), s in zip(rows, sets, strict=True)), key=str)
    kept = jaccard.one_of_each(clashing(docs), config)
    assert kept.columns == clashing(docs).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in parent if find(i) == i) and ids.count(None) == 2


def test_exactly_four_fifths_is_a_link(spark):
    w = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(w[:13])), (2, " ".join([*w[:12], "x"])), (3, " ".join(w[20:32])), (4, " ".join([*w[20:31], "x"]))]  # 8 of 10, 7 of 9
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    rng = random.Random(44)
    a, b = prose(rng, 50), prose(rng, 50)
    rows = [(5, a), (5, b), (5, b), (7, a + " more"), (8, b), (9, prose(rng, 50)), (9, "")]
    got = Counter(tuple(r) for r in jaccard.one_of_each(spark.createDataFrame(rows, DOCS)).collect())
    assert got == Counter([(5, a), (5, b), rows[5], (9, "")])


def test_prefixes_share_enough():
    config, rng = jaccard.JaccardConfig(), np.random.default_rng(3)
    counts = rng.integers(1, 400, 1 << 12).astype(np.uint32)
    for _ in range(200):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64))
        b = a.copy()
        b[rng.random(len(b)) < 0.1] += np.uint64(1)
        b = np.unique(b)
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            (p, k, _), (q, m, _) = (jaccard.prefix(s, counts, 3.0, config) for s in (a, b))
            assert len(np.intersect1d(p, q)) >= min(k, m)


def test_near_copies_of_nothing(spark, docs):
    assert jaccard.similar_components(docs.limit(0)).count() == 0
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


# --- repeated passages -----------------------------------------------------------------
def test_substrings(spark, docs):
    rows = corpus()
    seen, split = Counter(), [WORD.findall(t or "") for _, t in rows]
    for w in split:
        seen.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    want = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    got = sorted(map(tuple, substrings.deduplicate(clashing(docs)).collect()), key=str)
    assert got == sorted(want, key=str) and sum(r[2] for r in want) > 1000
    full = clashing(docs).withColumn("n_chars", F.length("text").cast("long"))
    out = substrings.without_repeats(full)
    assert out.columns == full.columns
    texts = [t if not n else k for (_, t), (_, _, n, k) in zip(rows, want, strict=True)]
    assert sorted(map(str, (r.text for r in out.collect()))) == sorted(map(str, texts))
    assert substrings.deduplicate(docs.limit(0)).count() == 0


# --- archives -------------------------------------------------------------------------
def test_archives(spark, docs):
    m = warc.MAGIC
    fake = m + "WARC-Type: response\r\nWARC-Record-ID: <urn:spindrift:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(0, "http://a/", big), (1, "http://b/\r\nX: y%0A", big), (2, None, None), (3, "u", ""), (4, "v", m), (5, "w", "a" * 50), (6, "w", "a" * 50)]
    rows += [(7, "q", fake + "tail" + fake * 3 + "z" * 300), (8, "é", "é" * 3000 + fake + "ü" * 2000), (9, "r", m[:-1]), (10, "r", fake + "\r\n\r\n")]
    rows += [(11, "x", "y" * 99), (12, "x", "y" * 99), (13, "x", "y" * 100), (14, "x", "y" * 100), (15, "e", fake.replace("Length: 5", "Length: 99999")), (16, "n", "\r\n\r\n" + m * 3), (5000, "http://c", big)]
    rows += [(100 + i, f"http://h/{i}", f"p{i} " * (i % 400)) for i in range(60)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    path, old = common.new_path(spark, "test"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    warc.write(pages, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")  # records over many splits
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {r.record_id: r for r in warc.read(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(rows)
    first = {}
    for i, url, html in sorted(rows, key=lambda r: r[0]):
        data, r = (html or "").encode(), got[f"<urn:spindrift:page:{i}>"]
        digest = hashlib.sha256(data).hexdigest()
        keeper = first.setdefault(digest, i) if len(data) >= 100 else i
        assert (r.payload_bytes, r.payload_digest, r.intact) == (len(data), digest, True)
        assert (r.type, r.refers_to) == (("response", None) if keeper == i else ("revisit", f"<urn:spindrift:page:{keeper}>"))
        assert url is None or r.target_uri == url
    empty = common.new_path(spark, "test")
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_archives_with_long_headers(spark):
    urls = ["http://a/", "http://b/" + "y" * 100_000, "http://c/", "http://d/" + "%41" * 30_000, "http://e/"]
    pages = spark.createDataFrame([(k, url, f"page {k}") for k, url in enumerate(urls)], "page_id long, url string, html string").coalesce(1)
    path = common.new_path(spark, "test")
    warc.write(pages, path)
    got = {r.record_id: r for r in warc.read(spark, path).collect()}
    assert [got[f"<urn:spindrift:page:{k}>"].target_uri for k in range(5)] == urls
    assert all(r.intact and r.payload_bytes == 6 for r in got.values())


def test_archives_of_odd_pages(spark):
    long = "é" * 1_500_000
    rows = [(4, "a", "same " * 30), (4, "a", "same " * 30), (4, "b", "same " * 30), (9, "c", "same " * 30), (None, "d", "same " * 30), (None, None, None), (5, None, long), (6, "x" * 1_000_000, long)]
    path = common.new_path(spark, "test")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    got = Counter((r.record_id[20:-1], r.type, r.refers_to and r.refers_to[20:-1], r.payload_bytes, r.payload_digest, r.intact) for r in warc.read(spark, path).collect())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    keeper = {9: "4", 6: "5"}
    assert got == Counter((str(i) if i is not None else "none", "revisit" if i in keeper else "response", keeper.get(i), len((t or "").encode()), sha(t), True) for i, _, t in rows)
