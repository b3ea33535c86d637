import os
import random
import threading
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import corpus_pipeline
from thalweg.llm import decontaminate as dc
from thalweg.llm import embedding_dedup as ed
from thalweg.llm import ngram_join as nj
from thalweg.llm.common import fresh_path, scratch, shared_folder
from thalweg.llm.components import components

from .conftest import DOCS, documents


def classes_of(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(25)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    real = [(a, b) for a, b in links if a is not None and a != b]
    expected = classes_of({x for p in real for x in p}, real)
    assert {r["node"]: r["component"] for r in components(df).collect()} == expected
    assert components(df.limit(0)).count() == 0


def test_components_of_a_large_group_join_its_links_once(spark, monkeypatch):
    """Many copies that meet in stars around many hubs: what goes round is what the stars leave, not every link."""
    from thalweg.llm import components as module

    links = [(n, hub) for n in range(100, 400) for hub in range(10)] + [(1000, 1001), (1001, 1002), (1002, 1003)]
    seen, labelled = [], module._labelled
    monkeypatch.setattr(module, "_labelled", lambda once: seen.append(once.count()) or labelled(once))
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: 0 for n in [*range(10), *range(100, 400)]} | {n: 1000 for n in range(1000, 1004)}
    assert seen[0] <= 15


# ---- n-gram join


def shingles(text):
    w = (text or "").encode().split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute_join(rows, threshold=0.8):
    sets = [(d, shingles(t)) for d, t in rows]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i][1] and sets[j][1] and len(sets[i][1] & sets[j][1]) >= threshold * len(sets[i][1] | sets[j][1])]
    n = Counter(x for p in links for x in p)
    root = classes_of(range(len(sets)), links)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root[i]] = min(least.get(root[i], 2**63), 2**63 if d is None else d)
    return sorted((repr(d), n[i], least[root[i]] if least[root[i]] < 2**63 else None) for i, (d, _) in enumerate(sets))


def near_copies(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    big = [word() for _ in range(150)]
    for k in range(90):  # one group of near copies, larger than a block
        rows.append((len(rows), " ".join([*big[:60], word(), *big[60:]])))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", " ", "one", "one", "two words", "x " * 3000])]
    return rows + [(None, rows[0][1]), (None, "alone without an id at all"), (2, rows[2][1]), (2, rows[2][1])]


def test_ngram_join(frame):
    rows = near_copies()
    df = frame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, labels int, component string")
    out = nj.jaccard_classes(df, block=32).collect()
    assert sorted((repr(r["doc_id"]), r["n_links"], r["class_id"]) for r in out) == brute_join(rows)
    kept = Counter()
    for r in out:
        kept[r["class_id"]] += r["kept"]
    assert all(kept[c] == 1 for c in kept if c is not None) and len({r["rid"] for r in out}) == len(rows)
    assert nj.jaccard_classes(df.limit(0)).count() == 0


def test_threshold_is_exact(frame):
    # 24 and 20 shared of 24 + ... : similarities just at and just below 0.8
    w = [f"w{k}" for k in range(200)]
    a, b = " ".join(w[:28]), " ".join(w[:24] + ["q"])  # 24 shingles; 21 with 20 shared: 20 / 25 = 0.8
    c = " ".join(w[:24] + ["q", "r"])  # 20 / 26
    out = {r["doc_id"]: r["n_links"] for r in nj.jaccard_classes(frame([(0, a), (1, b), (2, c)], "doc_id long, text string")).collect()}
    assert out == {0: 1, 1: 2, 2: 1}


def test_prefixes_are_shortened_until_recall():
    assert nj.prefix_depth(0.8, 24, 6, 0.9995) == 5 and nj.prefix_depth(0.95, 24, 6, 0.9995) == 6 and nj.prefix_depth(0.3, 2, 6, 0.999) == 1
    d = nj.prefix_depth()
    assert 1 - (1 - 0.8**d) ** nj.TREES >= nj.RECALL


def test_depth_follows_the_data(frame):
    """Documents among many close copies are settled at longer prefixes than others."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    crowd = [" ".join([*base[:k], "x", *base[k:]]) for k in range(60)]
    pair = [f"v{k}" for k in range(200)]
    rows = [(k, t) for k, t in enumerate([*crowd, " ".join(pair), " ".join([*pair, "end"]), "nothing like the others at all"])]
    out = {r["doc_id"]: r for r in nj.jaccard_classes(frame(rows, "doc_id long, text string")).collect()}
    assert {out[k]["depth"] for k in range(60)} == {8} and out[60]["depth"] == out[61]["depth"] == 6 and out[62]["depth"] == 5
    assert all(out[k]["n_links"] == 59 for k in range(60)) and out[60]["n_links"] == 1


def test_recall_near_the_threshold(frame):
    """Pairs of similarity 0.80 to 0.85, which the forest finds hardest: all but few in ten thousand are found."""
    rng, rows = random.Random(1), []
    for k in range(700):
        base = [f"w{rng.randrange(10**9)}" for _ in range(120)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[: rng.randrange(100, 104)], *(f"z{rng.randrange(10**9)}" for _ in range(4))]))]
    rng.shuffle(rows)
    truth = {k: shingles(t) for k, t in rows}
    linked = {k // 2 for k in truth if k % 2 == 0 and len(truth[k] & truth[k + 1]) >= 0.8 * len(truth[k] | truth[k + 1])}
    out = {r["doc_id"]: r["n_links"] for r in nj.jaccard_classes(frame(rows, "doc_id long, text string")).collect()}
    found = {k // 2 for k, n in out.items() if n}
    assert len(linked) >= 500 and found <= linked and len(found) >= 0.9995 * len(linked)


def test_recall_of_chains_and_copies(frame):
    """Chains whose ends are unlike, exact copies of their links, and hot copies."""
    words = [f"c{k}" for k in range(400)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 100])) for k in range(60)]
    rows += [(100 + k, rows[k % 7][1]) for k in range(200)] + [(400, " ".join(words[:95]))]
    out = nj.jaccard_classes(frame(rows, "doc_id long, text string"), block=16).collect()
    assert sorted((repr(r["doc_id"]), r["n_links"], r["class_id"]) for r in out) == brute_join(rows)


def test_string_ids(frame):
    rows = [("b", "one two three"), ("a", "one two three"), (None, "one two three"), ("c", None)]
    out = {r["doc_id"]: (r["n_links"], r["class_id"], r["kept"]) for r in nj.jaccard_classes(frame(rows, "doc_id string, text string")).collect()}
    assert out == {"a": (2, "a", True), "b": (2, "a", False), None: (2, "a", False), "c": (0, "c", True)}


def test_large_ids_beside_null(frame):
    rows = [(2**60 + 1, "one two"), (None, "one two"), (2**60 + 3, "three")]
    out = {r["doc_id"]: r["class_id"] for r in nj.jaccard_classes(frame(rows, "doc_id long, text string", 1)).collect()}
    assert out == {2**60 + 1: 2**60 + 1, None: 2**60 + 1, 2**60 + 3: 2**60 + 3}
    vecs = [(2**60 + 1, [1.0, 0.0]), (None, [1.0, 0.0]), (2**60 + 3, [0.0, 1.0])]
    out = {r["vec_id"]: r["component_id"] for r in ed.near_vectors(frame(vecs, "vec_id long, embedding array<float>", 1)).collect()}
    assert out == {2**60 + 1: 2**60 + 1, None: 2**60 + 1, 2**60 + 3: 2**60 + 3}


def test_pairs_do_not_depend_on_parallelism(frame, restless):
    rows = near_copies(3)
    docs = frame(rows, "doc_id long, text string", 5)
    out = nj.jaccard_classes(docs, block=32).collect()
    assert sorted((repr(r["doc_id"]), r["n_links"], r["class_id"]) for r in out) == brute_join(rows)
    rows = vectors(3)
    out = ed.near_vectors(frame(rows, "vec_id long, embedding array<float>", 5)).collect()
    assert sorted((repr(r["vec_id"]), r["n_links"], r["component_id"]) for r in out) == brute_vectors(rows) and len(restless) > 20


def test_intersections():
    rng = np.random.default_rng(0)
    x, y = ([np.unique(rng.integers(0, 3000, rng.integers(1, 900)).astype(np.uint64)) for _ in range(n)] for n in (7, 5))
    assert nj.intersections(x, y).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]


# ---- embeddings


def brute_vectors(rows, threshold=0.95):
    fine = []
    for v in (r[1] for r in rows):
        ok = v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        fine.append(np.array(list(v) + [0.0] * (8 - len(v)), np.float32).astype(float) if ok else None)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if fine[i] is not None and fine[j] is not None and fine[i] @ fine[j] / np.linalg.norm(fine[i]) / np.linalg.norm(fine[j]) >= threshold]
    n, root = Counter(x for p in links for x in p), classes_of(range(len(rows)), links)
    least = {}
    for i, r in enumerate(rows):
        least[root[i]] = min(least.get(root[i], 2**63), 2**63 if r[0] is None else r[0])
    return sorted((repr(r[0]), n[i], least[root[i]] if least[root[i]] < 2**63 else None) for i, r in enumerate(rows))


def vectors(seed):
    rng, rows = np.random.default_rng(seed), []
    for _ in range(60):
        base = rng.standard_normal(8)
        for _ in range(rng.integers(1, 4)):
            rows.append((len(rows), [float(x) for x in (base + 0.08 * rng.standard_normal(8)).astype(np.float32)]))
    hub = rng.standard_normal(8)
    for _ in range(70):  # a cluster that saturates every list
        rows.append((len(rows), [float(x) for x in (hub + 0.05 * rng.standard_normal(8)).astype(np.float32)]))
    n = len(rows)
    odd = [None, [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0, 2.0], [], rows[3][1], [2 * x for x in rows[3][1]]]
    rows += [(n + k, v) for k, v in enumerate(odd)]
    return rows + [(None, rows[5][1]), rows[4], rows[4]]


@pytest.mark.parametrize("seed", [0, 1])
def test_embeddings(frame, seed):
    rows = vectors(seed)
    out = ed.near_vectors(frame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((repr(r["vec_id"]), r["n_links"], r["component_id"]) for r in out) == brute_vectors(rows)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in out)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 0.0])], [(1, [1.0]), (2, [1.0])]])
def test_few_embeddings(frame, rows):
    out = ed.near_vectors(frame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((repr(r["vec_id"]), r["n_links"], r["component_id"]) for r in out) == brute_vectors(rows)


def test_descent_finds_neighbours_without_the_audit(spark, frame):
    """Recall of the lists themselves against brute force."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    nodes = frame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, vec array<float>")
    graph = ed.NearestGraph(nodes, 600, 16, k=8, tables=2)
    graph.refine()
    u = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T - 2 * np.eye(600)
    true = {k: set(np.argsort(-sims[k])[:4].tolist()) for k in range(600)}
    got = {}
    for r in graph.lists.collect():
        got.setdefault(r["u"], set()).add(r["w"])
    assert sum(len(true[k] & got[k]) for k in true) / 2400 > 0.85


def hot_and_pairs(seed=7, hot=150, pairs=60):
    """A hot cluster first, then pairs of near copies: rows and the number of hot ones."""
    rng, rows = np.random.default_rng(seed), []
    hub = rng.standard_normal(8)
    for v in [hub + 0.05 * rng.standard_normal(8) for _ in range(hot)]:
        rows.append((len(rows), [float(x) for x in v.astype(np.float32)]))
    for _ in range(pairs):
        base = rng.standard_normal(8)
        for v in (base, base + 0.05 * rng.standard_normal(8)):
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)]))
    return rows, hot


def test_a_hot_cluster_does_not_hide_lost_pairs(frame, monkeypatch):
    """A graph that finds the hot cluster only; the audit is too small for its own links to make up for the others."""
    rows, hot = hot_and_pairs()
    found = ed.NearestGraph.found
    monkeypatch.setattr(ed.NearestGraph, "found", lambda self: found(self).limit(0).unionByName(self.nodes.where(F.element_at("vec", 1).isin([r[1][0] for r in rows[:hot]])).select(F.col("id").alias("a"), F.min("id").over(W.partitionBy(F.lit(1))).alias("b"))))
    monkeypatch.setattr(ed, "AUDIT", 40)
    monkeypatch.setattr(ed, "RESUMED", 1)
    out = ed.near_vectors(frame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((repr(r["vec_id"]), r["n_links"], r["component_id"]) for r in out) == brute_vectors(rows)


def test_tables_grow_with_the_number_of_vectors():
    for n in (100, 10_000, 51_282, 10**6, 10**7):
        bits = max(1, round(np.log2(max(2, n / ed.BUCKET))))
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** ed.tables_for(n) <= 0.001


def test_graph_finds_pairs_beside_a_hot_cluster_without_the_audit(frame):
    rows, _ = hot_and_pairs(8, 500, 500)
    nodes = frame([(k, v) for k, v in rows], "id long, vec array<float>")
    graph = ed.NearestGraph(nodes, len(rows), 8)
    graph.refine()
    label = {r["node"]: r["component"] for r in components(graph.found()).collect()}
    assert sorted((repr(k), label.get(k, k)) for k, _ in rows) == [(i, c) for i, _, c in brute_vectors(rows)]


def test_all_that_share_a_neighbour_meet(frame):
    """Pairs of near copies that only a hub knows: more of them than a list has places."""
    rng = np.random.default_rng(4)
    spokes = [v for b in rng.standard_normal((40, 8)) for v in (b, b + 0.02 * rng.standard_normal(8))]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate([*spokes, rng.standard_normal(8)])]
    graph = ed.NearestGraph.__new__(ed.NearestGraph)
    graph.nodes, graph.n, graph.dim, graph.k, graph.threshold = frame(rows, "id long, vec array<float>"), len(rows), 8, 8, 0.95
    graph.inside, graph.own, graph.links, graph.round = None, None, [], 1
    graph.lists = frame([(k, 80, 0.0, True) for k in range(80)], "u long, w long, sim double, fresh boolean")
    graph.join(graph.around())
    label = {r["node"]: r["component"] for r in components(graph.found()).collect()}
    assert all(label[k] == label[k + 1] for k in range(0, 80, 2))


def test_entries_stay_fresh_until_they_met(frame):
    rng = np.random.default_rng(6)
    nodes = frame([(k, [float(x) for x in v]) for k, v in enumerate(rng.standard_normal((200, 8)))], "id long, vec array<float>")
    graph = ed.NearestGraph(nodes, 200, 8, tables=1)
    before = {(r["u"], r["w"]) for r in graph.lists.where("fresh").collect()}
    graph.join(graph.buckets(1, 1), around=False)
    after = {(r["u"], r["w"]): r["fresh"] for r in graph.lists.collect()}
    assert before and all(after.values()) and before & set(after)


def test_saturated_vectors_search_outside_their_component(frame):
    """Two tight clusters that are linked, each of which fills the lists of its vectors, and no bucket held both of them."""
    rng = np.random.default_rng(3)
    a, b = np.linalg.qr(rng.standard_normal((16, 16)))[0][:2]
    centres = a, 0.953 * a + np.sqrt(1 - 0.953**2) * b
    x = [c + 0.004 * rng.standard_normal(16) for c in centres for _ in range(30)] + list(rng.standard_normal((100, 16)))
    nodes = frame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, vec array<float>")
    graph = ed.NearestGraph.__new__(ed.NearestGraph)
    graph.nodes, graph.n, graph.dim, graph.k, graph.threshold, graph.bucket = nodes, len(x), 16, 8, 0.95, 16
    graph.lists, graph.inside, graph.own, graph.links, graph.round, graph.used = None, None, None, [], 0, 0
    apart = graph.buckets(0, 6)
    graph.join(apart.withColumn("g2", F.col("g2") * 2 + (F.col("id") < 30).cast("int")), around=False)
    graph.refine()
    label = {r["node"]: r["component"] for r in components(graph.found()).collect()}
    assert {label[k] for k in range(60)} == {0, 30}
    label = {r["node"]: r["component"] for r in ed.outside(graph).collect()}
    assert {label[k] for k in range(60)} == {0}


def test_saturated_lists_grow(frame):
    """Lists of 8 places in clusters of 20: they grow until they hold vectors that are no links, and no block is compared."""
    rng, x = np.random.default_rng(11), []
    for c in np.linalg.qr(rng.standard_normal((16, 16)))[0][:6]:
        x += [c + 0.01 * rng.standard_normal(16) for _ in range(20)]
    nodes = frame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, vec array<float>")
    graph = ed.NearestGraph(nodes, len(x), 16)
    graph.refine()
    assert graph.saturated().count() == 120
    ed.outside(graph)
    assert graph.own is None and graph.saturated().count() == 0
    assert {r["k"] for r in graph.room.collect()} == {32}
    assert graph.pairs().count() == 6 * 20 * 19


def test_extreme_values(frame):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [1e-200, -1e-200]), (5, [5e-324, 5e-324])]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ed.near_vectors(frame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (0, 4)}


def test_fallback_is_exact(frame, monkeypatch):
    """A graph that finds nothing at all: the audit sees it, and all vectors are compared with all."""
    rows = vectors(2)
    monkeypatch.setattr(ed, "RESUMED", 0)
    monkeypatch.setattr(ed.NearestGraph, "pairs", lambda self: self.lists.select(F.col("u").alias("a"), F.col("w").alias("b")).limit(0))
    monkeypatch.setattr(ed, "outside", lambda graph: components(graph.found().limit(0)))
    out = ed.near_vectors(frame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((repr(r["vec_id"]), r["n_links"], r["component_id"]) for r in out) == brute_vectors(rows)


# ---- pipeline


def corpus(spark):
    """Documents with known fates; returns rows and what has to happen to them."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 7)))
    rows = [(k, " ".join(word() for _ in range(60)), "en", f"s{k % 3}", 1) for k in range(120)]
    item = " ".join(word() for _ in range(25))
    rows += [(200, rows[7][1], "en", "s0", 1), (201, rows[7][1] + " more", "en", "s1", 1), (202, rows[9][1] + " " + item, "en", "s2", 1), (203, None, "en", "s0", 0), (204, "123 456", "en", None, 7), (205, "", None, "s1", 0)]
    return rows, item


def test_pipeline_stages(spark, frame, tmp_path):
    rows, item = corpus(spark)
    docs = frame(rows, DOCS).withColumn("extra", F.lit(5)).withColumn("score", F.lit(0.1))
    sf = str(tmp_path / "sf")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    seen, now = {}, spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, f"test-{name}")
        stage(spark, now, sf).write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = now.collect()
        assert {"doc_id", "text", "lang", "source", "n_chars", "extra"} <= set(now.columns)
    ids = {k: {r["doc_id"] for r in v} for k, v in seen.items()}
    assert ids["language"] == set(range(120)) | {200, 201, 202}
    assert ids["near_duplicates"] == ids["language"] - {200, 201}
    assert ids["decontamination"] == ids["near_duplicates"] - {202}
    whole = {r["doc_id"]: r["text"] for r in seen["decontamination"]}
    assert all(r["text"] in whole[r["doc_id"]] or set(r["text"].split()) <= set(whole[r["doc_id"]].split()) for r in seen["mix"])
    total, mixed = (sum(len(r["text"].split()) for r in seen[k]) for k in ("decontamination", "mix"))
    assert mixed == pytest.approx(total, rel=0.02)
    assert sorted(r["text"] for r in seen["shards"]) == sorted(r["text"] for r in seen["mix"])
    out = corpus_pipeline.run(spark, sf)
    assert {"shard", "slot"} <= set(out.columns)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, seen["shards"]))


def test_pipeline_of_nothing(spark, frame, tmp_path):
    sf = str(tmp_path / "sf")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    frame([], DOCS).write.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
    frame(documents([None, ""]), DOCS).write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_pipeline_loses_no_column(spark, frame, tmp_path):
    """Columns named as those of operators, in any case, large numbers beside nulls: every stage hands them on."""
    rows, item = corpus(spark)
    docs = frame(rows, DOCS, 1).withColumns({"Score": F.lit(0.5), "lang_pred": F.lit("mine"), "coverage": F.lit(2), "contaminated": F.lit("no"), "__rid": F.lit(3), "__size": F.lit(4), "rid": F.lit(5), "row": F.lit(6), "a.b": F.lit(7)})
    docs = docs.withColumn("k", F.when(F.col("doc_id") % 2 == 0, F.lit(2**60 + 1)))
    sf = str(tmp_path / "sf")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        got = out.select("doc_id", "k", "Score", "`a.b`", "rid", "row", "__rid").distinct().collect()
        assert got and all(r["k"] == (2**60 + 1 if r["doc_id"] % 2 == 0 else None) and tuple(r)[2:] == (0.5, 7, 5, 6, 3) for r in got)
    out = corpus_pipeline.shards(spark, docs.withColumn("Shard", F.lit("x")), sf)
    assert [c for c in out.columns if c.lower() == "shard"] == ["shard"] and out.count() == len(rows)


def test_pipeline_stages_do_not_depend_on_parallelism(spark, frame, restless):
    rows, item = corpus(spark)
    docs = frame([r for r in rows if r[1]], DOCS, 5)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows if r[1]} - {200, 201}
    once = {(r["doc_id"], r["text"]) for r in corpus_pipeline.mix(spark, docs, "").collect()}
    assert once == {(r["doc_id"], r["text"]) for r in corpus_pipeline.mix(spark, docs, "").collect()}
    joined = dc.decontaminate(docs, frame([(1, item)], "item_id long, text string"), broadcast_chars=0)
    assert {r["doc_id"] for r in joined.collect() if r["contaminated"]} == {202}


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session())


def held(spark):
    return set(os.listdir(urlparse(shared_folder(spark)).path))


def test_only_what_a_result_reads_stays(spark, frame):
    before, docs = held(spark), frame(near_copies()[:40], "doc_id long, text string")
    found = nj.jaccard_classes(docs)
    assert found.count() == 40 and len(held(spark) - before) == 2
    with scratch(spark):
        nj.jaccard_classes(docs).count()
    assert len(held(spark) - before) == 2
    with pytest.raises(Exception, match="no_such_column"):
        nj.jaccard_classes(docs, id_col="no_such_column")
    assert len(held(spark) - before) == 2 and found.count() == 40


def test_two_runs_at_once(spark, frame):
    """Each of two threads joins its own documents; neither deletes what the other reads."""
    out, errors = {}, []
    docs = {k: frame(near_copies()[k : k + 60], "doc_id long, text string") for k in (0, 30)}
    classes = lambda k: sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in nj.jaccard_classes(docs[k]).collect())

    def work(k):
        try:
            out[k] = classes(k)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in docs]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and out == {k: classes(k) for k in docs}
