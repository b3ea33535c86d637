"""Chains on trees against dense linear systems."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.operators import graph, mlpe, samc
from thalweg.operators.points import euclidean
from thalweg.plans import evaluate
from thalweg.plans.chain import Chain


def random_tree(seed, n, spread=None):
    rng = random.Random(seed)
    return [(k, rng.randrange(max(0, k - (spread or k)), k), 100 + k) for k in range(1, n)]


def dense_passage(q, absorb, target):
    """One linear system per target: staying completes each row, the target's row is left out."""
    q, n = q.copy(), len(q)
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, 1 - q.sum(1) - absorb)
    rest = np.flatnonzero(np.arange(n) != target)
    t = np.linalg.solve(np.eye(n - 1) - q[np.ix_(rest, rest)], q[rest, target])
    return dict(zip(rest.tolist(), t.tolist()))


@pytest.mark.parametrize("n,spread", [(25, None), (25, 2), (12, 1)])
def test_passage_equals_dense(spark, n, spread):
    """Two chains on one tree, with staying, unequal absorption and moves that cannot be made."""
    edges = random_tree(n, n, spread)
    ids = [e for _, _, e in edges]
    up = {c: (p, e) for c, p, e in edges}
    rng, rows, q = random.Random(7), [], np.zeros((2, n - 1, n - 1))
    for k in (0, 1):
        for c, p, e in edges:
            if p in up:
                for i, j in ((e, up[p][1]), (up[p][1], e)):
                    w = 0.0 if rng.random() < 0.05 else rng.random()
                    q[k, ids.index(i), ids.index(j)] = w
    absorb = np.array([rng.choice([0.02, 0.3]) for _ in ids])
    absorb[3] = 0.0
    q = q / np.maximum(q.sum(2, keepdims=True), 1e-9) * 0.9 * (1 - absorb)[None, :, None]
    for k in (0, 1):
        rows += [(k, ids[i], ids[j], float(q[k, i, j])) for i, j in zip(*np.nonzero(q[k]))]
    tree = spark.createDataFrame(edges, "child long, parent long, edge_id long")
    gone = spark.createDataFrame([(e, float(a) if a else None) for e, a in zip(ids, absorb)], "edge_id long, absorb double")
    sites = rng.sample(ids, 8)
    found = samc.passage(tree, spark.createDataFrame(rows, "key long, i long, j long, p double"), gone, spark.createDataFrame([(s,) for s in sites], "edge_id long"), ["key"])
    found = {(r["key"], r["origin"], r["target"]): r["value"] for r in found.collect()}
    assert len(found) == 2 * 8 * 7
    for k in (0, 1):
        for target in sites:
            expected = dense_passage(q[k], absorb, ids.index(target))
            for origin in sites:
                if origin != target:
                    assert found[k, origin, target] == pytest.approx(expected[ids.index(origin)], abs=1e-10)


def test_passage_by_hand_and_failures(spark):
    # three edges in a row: from the first one always moves on, from the second either way; a fifth is lost at each
    tree = spark.createDataFrame([(3, 2, 13), (2, 1, 12), (1, 0, 11)], "child long, parent long, edge_id long")
    moves = spark.createDataFrame([(13, 12, 0.8), (12, 13, 0.4), (12, 11, 0.4), (11, 12, 0.8)], "i long, j long, p double")
    gone, sites = spark.createDataFrame([(k, 0.2) for k in (11, 12, 13)], "edge_id long, absorb double"), spark.createDataFrame([(13,), (11,)], "edge_id long")
    found = {(r["origin"], r["target"]): r["value"] for r in samc.passage(tree, moves, gone, sites).collect()}
    assert found == pytest.approx({(13, 11): 0.8 * 0.4 / (1 - 0.32), (11, 13): 0.8 * 0.4 / (1 - 0.32)})
    cut = samc.passage(tree, moves, gone, sites, max_rounds=1).collect()
    assert {r["value"] for r in cut} == {None}
    with pytest.raises(ValueError, match="settled"):
        samc.passage(tree, moves, gone, sites, max_rounds=1, max_fail=0)


def test_chain_models_equal_matrices(spark):
    """Directed and undirected variables, several models in one job, against the same steps on matrices."""
    edges = [(1, 0, 101), *((c + 1, p + 1, e + 1) for c, p, e in random_tree(5, 13))]  # one edge at the root
    ids, n = [e for _, _, e in edges], 13
    up = {c: (p, e) for c, p, e in edges}
    rng = np.random.default_rng(1)
    value = {v: rng.random(n) * 10 for v in "ab"}
    long = spark.createDataFrame([(ids[k], v, float(x[k])) for v, x in value.items() for k in range(n)], "edge_id long, var string, value double")
    models = [(0, "a", 1, 1.0, 0, 0.0, False), (0, "b", 0, 1.0, 0, 0.0, False), (1, "a", 1, 0.5, 0, 0.0, True), (1, "b", 1, 0.7, 0, 0.0, False), (2, "a", 0, 1.0, 0, 0.0, False)]
    frame = spark.createDataFrame(models, "model_id long, var string, sel int, weight double, transform int, shape double, asymmetric boolean")
    nodes = [4, 7, 9, 12, 13]
    points = spark.createDataFrame(list(enumerate(nodes)), "pt_idx long, node_id long")
    sizes = spark.createDataFrame([(v, 4.0) for v in nodes] + [(7, 8.0)], "node_id long, size double")
    response = spark.createDataFrame([(i, j, j + 1, i + 1, float(i * 1.3 + j + (i * j) % 3)) for i in range(5) for j in range(i)], "i long, j long, pop1 long, pop2 long, y double")
    tree = spark.createDataFrame(edges, "child long, parent long, edge_id long")
    chain = Chain(tree, points, sizes, response)
    found = {(r["model_id"], r["i"], r["j"]): r["value"] for r in chain.passage(frame, long).collect()}
    assert set(found) == {(m, i, j) for m in (0, 1) for i in range(5) for j in range(5) if i != j}

    adj = [(ids.index(i), ids.index(j)) for c, p, e in edges if p in up for i, j in ((e, up[p][1]), (up[p][1], e))]
    unit = lambda x: (x - x.min()) / (x.max() - x.min())

    def positive(x):
        x = unit(x)
        return np.where(x == 0, x[x > 0].min(), x)

    gone = np.zeros(n)
    for v in nodes:
        gone[ids.index(up[v][1])] = 1 / (2 * (6.0 if v == 7 else 4.0))
    for m in (0, 1):
        total = 0
        for _, v, sel, weight, _, _, directed in [x for x in models if x[0] == m and x[2]]:
            x = unit(value[v])
            total = total + weight * unit(np.array([x[j] - x[i] if directed else (x[i] + x[j]) / 2 for i, j in adj]))
        w, q = positive(1 / positive(total)), np.zeros((n, n))
        for (i, j), x in zip(adj, w):
            q[i, j] = x
        q = q / q.sum(1, keepdims=True) * (1 - gone)[:, None]
        for j, target in enumerate(nodes):
            expected = dense_passage(q, gone, ids.index(up[target][1]))
            for i, origin in enumerate(nodes):
                if i != j:
                    assert found[m, i, j] == pytest.approx(expected[ids.index(up[origin][1])], abs=1e-9)
    fits = {r["model_id"]: r for r in chain.evaluate(frame, long).collect()}
    assert fits[2]["fitness"] == float("-inf") and fits[0]["loglik"] > -100 and fits[1]["rho"] is not None
    assert chain.evaluate(frame, long, ways="mean").where("fitness > '-inf'").count() == 2
    ways = chain.transitions(frame, long).where("model_id = 0").agg(F.count("downstream"), F.count("upstream")).first()
    assert ways[0] == len(adj) // 2 and 0 < ways[1] <= len(adj) // 2


def test_edge_tree(spark):
    tree = spark.createDataFrame([(3, 2, 13), (2, 0, 12), (1, 0, 11)], "child long, parent long, edge_id long")
    assert sorted(tuple(r) for r in samc.edge_tree(tree).collect()) == [(11, 10, 11), (12, 10, 12), (13, 12, 13)]
    assert graph.adjacency(tree).count() == 2


def test_passages_are_not_stored_nor_made_for_fits(spark, monkeypatch):
    """Passages are made where they are read; a fit needs only sums of each model's pairs."""
    tree = spark.createDataFrame([(3, 1, 13), (2, 1, 12), (1, 0, 11)], "child long, parent long, edge_id long")
    moves = spark.createDataFrame([(0, 13, 11, 0.8), (0, 11, 13, 0.4), (0, 12, 11, 0.5), (0, 11, 12, 0.4)], "key long, i long, j long, p double")
    gone = spark.createDataFrame([(k, 0.2) for k in (11, 12, 13)], "edge_id long, absorb double")
    points = spark.createDataFrame([(0, 11), (1, 12), (2, 13)], "pt_idx long, edge_id long")
    names, stored = [], samc.stored
    monkeypatch.setattr(samc, "stored", lambda df, name="stored", keep=False: names.append(name) or stored(df, name, keep))
    found = {(r["origin"], r["target"]): r["value"] for r in samc.passage(tree, moves, gone, points.select("edge_id"), ["key"]).collect()}
    assert "passage" not in names and len(found) == 6
    response = spark.createDataFrame([(1, 0, 1, 2, 3.0), (2, 0, 1, 3, 5.0), (2, 1, 2, 3, 4.0)], "i long, j long, pop1 long, pop2 long, y double")
    sums = mlpe.sums_of_parts(samc.passage_parts(tree, moves, gone, points, response, ["key"]), ["key"]).first().asDict()
    x = np.array([found[12, 11], found[13, 11], found[13, 12]])
    pops = np.array([x[0] + x[1], x[0] + x[2], x[1] + x[2]])
    expected = {"key": 0, "m": 3, "n": 3, "mx": x.mean(), "sx": x.std(), "y": 12, "yy": 50, "xy0": x @ [3, 5, 4], "p1x": 2 * x.sum(), "p1y": 24, "pxx0": pops @ pops, "pxy0": pops @ [8, 7, 9], "pyy": 194, "complete": True}
    assert sums == pytest.approx(expected)


@pytest.mark.parametrize("wide,tile,models,mean", [(3, 2, 2, False), (1, 4, 32, True), (32, 512, 1, True)])
def test_passages_and_distances_are_added_up_together(spark, monkeypatch, wide, tile, models, mean):
    """Of three models, one with moves that are never made: the same sums as from a response of a row per pair."""
    edges, rng = random_tree(5, 24), np.random.default_rng(2)
    tree = spark.createDataFrame(edges, "child long, parent long, edge_id long")
    up = {c: (p, e) for c, p, e in edges}
    steps = [(i, j) for c, p, e in edges if p in up for i, j in ((e, up[p][1]), (up[p][1], e))]
    moves = spark.createDataFrame([(k, i, j, 0.0 if k == 2 and i % 5 == 0 else float(rng.random() / 9)) for k in range(3) for i, j in steps], "key long, i long, j long, p double")
    gone = spark.createDataFrame([(e, 0.2) for _, _, e in edges], "edge_id long, absorb double")
    points = spark.createDataFrame([(k, e) for k, (_, _, e) in enumerate(edges[::2])], "pt_idx long, edge_id long")
    vectors = spark.createDataFrame([(k, rng.random(3).tolist()) for k in range(len(edges[::2])) if k != 4], "id long, v array<double>")
    response = evaluate.response_pairs(euclidean(vectors), len(edges))
    monkeypatch.setattr(samc, "MODELS", models)
    by_key = lambda parts: {r["key"]: r.asDict() for r in mlpe.sums_of_parts(parts, ["key"]).collect()}
    found = by_key(samc.passage_distance_parts(tree, moves, gone, points, vectors.withColumnRenamed("id", "pt_idx"), ["key"], mean, wide=wide, tile=tile))
    expected = by_key(samc.passage_parts(tree, moves, gone, points, response, ["key"], mean))
    assert set(found) == {0, 1, 2} and all(found[k] == pytest.approx(expected[k], rel=1e-8, abs=1e-12) for k in found)
