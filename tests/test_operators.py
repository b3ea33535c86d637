import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.operators import cleaning, graph, inference, mlpe, points, surface


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# ---- graph


def path_edges(spark, n=6):
    return spark.createDataFrame([(k, k, k + 1, float(k + 1)) for k in range(n)], "edge_id long, src long, dst long, length_km double")


def random_tree(seed, n=25):
    rng = random.Random(seed)
    return [(k, k, rng.randrange(k)) for k in range(1, n)]


def brute_path(parent, a, b):
    up = lambda x: [x] + (up(parent[x]) if x in parent else [])
    return set(up(a)) ^ set(up(b))


def test_incidence_equals_paths(spark):
    edges = random_tree(3)
    parent = {c: p for _, c, p in edges}
    tree = spark.createDataFrame([(c, p, e) for e, c, p in edges], "child long, parent long, edge_id long")
    nodes = [0, 3, 9, 17, 24]
    pts = spark.createDataFrame(list(enumerate(nodes)), "pt_idx long, node_id long")
    found = {}
    for i, j, e in rows(graph.incidence(tree, pts)):
        found.setdefault((i, j), set()).add(e)
    for j, i in itertools.combinations(range(len(nodes)), 2):
        assert found.get((i, j), set()) == {e for e in brute_path(parent, nodes[i], nodes[j]) if e in parent}


def test_incidence_by_search_agrees_on_trees(spark):
    edges = spark.createDataFrame([(e, c, p, 1.0) for e, c, p in random_tree(5, 12)], "edge_id long, src long, dst long, length_km double")
    pts = spark.createDataFrame([(0, 1), (1, 7), (2, 11)], "pt_idx long, node_id long")
    tree = graph.orient(edges, 0)
    assert rows(graph.incidence_by_search(edges, pts).select("i", "j", "edge_id"), "i", "j", "edge_id") == rows(graph.incidence(tree, pts).select("i", "j", "edge_id"), "i", "j", "edge_id")


def test_shortest_paths(spark):
    edges = spark.createDataFrame([(0, 0, 1, 4.0), (1, 0, 2, 1.0), (2, 2, 1, 2.0), (3, 1, 3, 5.0)], "edge_id long, src long, dst long, length_km double")
    assert rows(graph.shortest_path_tree(edges, 0, "length").select("child", "parent", "distance"), "child") == [(1, 2, 3.0), (2, 0, 1.0), (3, 1, 8.0)]
    long_is_cheap = {c: p for c, p in rows(graph.shortest_path_tree(edges, 0).select("child", "parent"))}
    assert long_is_cheap[1] == 0
    with pytest.raises(ValueError):
        graph.assert_reached(graph.shortest_path_tree(edges, 0), spark.createDataFrame([(99,)], "n long"), 0)


def test_components(spark):
    edges = path_edges(spark).unionByName(spark.createDataFrame([(9, 50, 40, 1.0)], "edge_id long, src long, dst long, length_km double"))
    assert dict(rows(graph.components(edges))) == {**{k: 0 for k in range(7)}, 40: 40, 50: 40}
    assert not graph.is_connected(edges) and graph.is_connected(path_edges(spark))


def test_contract(spark):
    # 0 <- 1 <- 2 <- 3, and 2 <- 4 <- 5; site at 5 and 3
    tree = spark.createDataFrame([(1, 0, 11, 1.0), (2, 1, 12, 2.0), (3, 2, 13, 3.0), (4, 2, 14, 4.0), (5, 4, 15, 5.0)], "child long, parent long, edge_id long, length_km double")
    out = graph.contract(tree, spark.createDataFrame([(3,), (5,)], "n long"))
    assert rows(out, "run_id") == [(2, 2, 0, 3.0, [12, 11]), (3, 3, 2, 3.0, [13]), (5, 5, 2, 9.0, [15, 14])]
    assert rows(graph.reach_to_edge(out), "reach_id") == [(11, 2), (12, 2), (13, 3), (14, 5), (15, 5)]
    stop = graph.contract(tree, spark.createDataFrame([(3,), (5,), (1,)], "n long"))
    assert {r[0] for r in rows(stop)} == {1, 2, 3, 5}


def test_orientation_and_adjacency(spark):
    tree = graph.orient(path_edges(spark, 3), 3)
    assert rows(tree.select("child", "parent", "depth"), "child") == [(0, 1, 3), (1, 2, 2), (2, 3, 1)]
    assert rows(graph.adjacency(tree), "edge_i", "edge_j") == [(0, 1, 1), (1, 0, -1), (1, 2, 1), (2, 1, -1)]
    assert {r[2] for r in rows(graph.adjacency(tree, symmetric=True))} == {1}
    assert rows(graph.path_attributes(tree, path_edges(spark, 3), "length_km", 0))[0][1] == [1.0, 2.0, 3.0]
    assert rows(graph.diverge(tree).select("child", "parent"), "child") == [(1, 0), (2, 1), (3, 2)]


def test_origin(spark):
    e = path_edges(spark, 3).withColumn("next_down", F.when(F.col("edge_id") < 2, F.col("edge_id") + 1))
    assert graph.infer_origin(e) == 3
    with pytest.raises(ValueError):
        graph.infer_origin(e.withColumn("next_down", F.col("edge_id")))
    assert rows(graph.extend_downstream(e.where("edge_id = 0"), e, 5).select("edge_id"), "edge_id") == [(0,), (1,), (2,)]
    more = graph.buffer_points(e.where("edge_id = 1"), e, spark.createDataFrame([(1,), (2,)], "n long"), 1)
    assert rows(more.select("edge_id"), "edge_id") == [(0,), (2,)]


def test_append_edges(spark):
    ends = spark.createDataFrame([(8, 2), (7, 0)], "src long, dst long")
    more = graph.append_edges(path_edges(spark, 3), ends)
    assert rows(more.where("edge_id > 2").select("edge_id", "src", "dst", "length_km"), "edge_id") == [(3, 7, 0, None), (4, 8, 2, None)]
    assert more.count() == 5
    assert [r[0] for r in rows(graph.append_edges(path_edges(spark, 3).limit(0), ends).select("edge_id"), "edge_id")] == [0, 1]


@pytest.mark.parametrize("ring", [5, 0])
def test_search_goes_over_cycles_only(spark, monkeypatch, ring):
    """Trees that hang on a ring with a chord, a part of its own, an edge from a node to itself: the same paths as by a search
    of all, from the ring's nodes alone. Without the ring, no search."""
    rng = random.Random(4)
    pairs = [(k, rng.randrange(k)) for k in range(1, 30)] if not ring else [(k, (k + 1) % ring) for k in range(ring)] + [(0, 2), (1, 2)] + [(k, rng.randrange(k)) for k in range(ring, 30)]
    pairs += [(40, 41), (42, 41), (43, 42), (7, 7)]
    edges = spark.createDataFrame([(100 + k, a, b, rng.random() + 0.1) for k, (a, b) in enumerate(pairs)], "edge_id long, src long, dst long, length_km double")
    nodes = [3, 29, 12, 12, 0, 40, 43, 17, 25, 99, 8]
    pts = spark.createDataFrame(list(enumerate(nodes)), "pt_idx long, node_id long")
    search, started = graph._searched, []
    for weight in ("inverse", "length"):
        expected = rows(search(edges, pts, weight).where("i > j"), "i", "j", "edge_id")
        with monkeypatch.context() as m:
            m.setattr(graph, "_searched", lambda e, p, w: started.append((e.count(), p.count())) or search(e, p, w))
            assert rows(graph.incidence_by_search(edges, pts, weight), "i", "j", "edge_id") == expected and expected
    assert all(e == (7 if ring else 0) and p <= 6 for e, p in started)


def test_sampling_and_annotation(spark):
    assert graph.sample_nodes(path_edges(spark), 4, 1).distinct().count() == 4
    assert [r["EDGE_ID"] for r in graph.annotate(path_edges(spark)).orderBy("src").collect()] == list(range(6))


# ---- points


def test_snapping(spark):
    nodes = spark.createDataFrame([(k, float(k % 10), float(k // 10)) for k in range(100)], "node_id long, x double, y double")
    rng = random.Random(1)
    pts = spark.createDataFrame([(f"s{k}", rng.uniform(-3, 12), rng.uniform(-3, 12)) for k in range(40)], "sample string, lat double, long double")
    direct = rows(points.snap_nearest(pts, nodes).select("sample", "node_id"), "sample")
    assert direct == rows(points.snap_nearest(pts, nodes, cell=0.7).select("sample", "node_id"), "sample")
    with pytest.raises(ValueError):
        points.snap_nearest(pts, nodes.limit(0))


def test_snapping_of_crowds(spark):
    """Nodes in a crowd, alone, and twice on one place; points among them, far from them and without a place: candidates are
    neither shuffled nor sorted, and the nearest is that of all."""
    rng = random.Random(2)
    at = [(round(rng.gauss(5, 0.01), 4), round(rng.gauss(5, 0.01), 4)) for _ in range(300)] + [(rng.uniform(0, 50), rng.uniform(0, 50)) for _ in range(40)]
    nodes = spark.createDataFrame([(k, *c) for k, c in enumerate(at + at[:30])], "node_id long, x double, y double")
    places = [(rng.gauss(5, 0.02), rng.gauss(5, 0.02)) for _ in range(60)] + [(rng.uniform(-900, 900), rng.uniform(-60, 90)) for _ in range(30)] + [at[7], (None, 1.0), (None, None), (5.0, None)]
    pts = spark.createDataFrame([(f"s{k}", a, b) for k, (a, b) in enumerate(places)], "sample string, long double, lat double")
    whole = {f"s{k}": 0 if None in p else min(((p[0] - x) ** 2 + (p[1] - y) ** 2, n) for n, (x, y) in enumerate(at + at[:30]))[1] for k, p in enumerate(places)}
    for cell in (None, 0.3, 5.0):
        out = points.snap_nearest(pts, nodes, cell=cell)
        assert {r["sample"]: r["node_id"] for r in out.collect()} == whole
    assert "SortAggregate" not in points.snap_nearest(pts.limit(60), nodes, cell=5.0)._jdf.queryExecution().executedPlan().toString()


def test_medians_of_gaps_without_pairs(spark):
    rng = random.Random(3)
    groups = {1: [round(rng.uniform(-10, 10), 2) for _ in range(60)], 2: [round(rng.uniform(-1, 1), 1) for _ in range(41)], 4: [0.1, 0.2, 0.3, 0.1 + 0.2], 5: [7.0], 7: [rng.random() ** 9 for _ in range(33)], 8: [5.0] * 6}
    members = spark.createDataFrame([(k, v) for k, g in groups.items() for v in [*g, None]], "pt_idx long, value double")
    for offset in (0.0, 1.0):
        found = {(r["i"], r["j"]): r["value"] for r in points.gap_medians(members, offset).collect()}
        expected = {(i, j): 0.0 if i == j else float(np.median([abs(a - b) + offset for a in groups[min(i, j)] for b in groups[max(i, j)]])) for i in groups for j in groups}
        assert found == expected


def test_points_table(spark):
    snapped = spark.createDataFrame([("b", 1.0, 1.0, 5, 1.0, 1.0), ("a", 0.9, 1.0, 5, 1.0, 1.0), ("c", 0.0, 0.0, 2, 0.0, 0.0)], "sample string, long double, lat double, node_id long, x double, y double")
    assert rows(points.points_table(snapped).select("pt_idx", "label", "names"), "pt_idx") == [(0, "c", ["c"]), (1, "a", ["a", "b"])]
    assert rows(points.points_table(snapped, "last").select("label", "names"), "label")[0] == ("b", ["b"])


def test_pair_labels(spark):
    labels = rows(points.combination_labels(spark, 4), "pair_idx")
    assert [r[1] for r in labels] == [1, 1, 4, 2, 2, 3] and [r[2] for r in labels] == [2, 3, 1, 3, 4, 4]
    p = points.pairs(spark.range(4).withColumnRenamed("id", "pt_idx"))
    assert rows(p.select("pair_idx", "i", "j"), "pair_idx") == [(0, 1, 0), (1, 2, 0), (2, 2, 1), (3, 3, 0), (4, 3, 1), (5, 3, 2)]
    m = spark.createDataFrame([(i, j, float(3 * i + j + 1)) for i in range(3) for j in range(3)], "i long, j long, value double")
    assert [r["value"] for r in points.lower_triangle(m).orderBy("pair_idx").collect()] == [4, 7, 8]
    with pytest.raises(ValueError):
        points.population_labels(p, 4, "other")


# ---- likelihood


def dense(y, x, pop1, pop2, rho):
    n, m = len(set(pop1) | set(pop2)), len(y)
    z = np.zeros((n, m))
    for k, (p, q) in enumerate(zip(pop1, pop2)):
        z[p - 1, k] = z[q - 1, k] = 1
    c = rho**2 * z.T @ z
    np.fill_diagonal(c, 1)
    x = (x - x.mean()) / x.std()
    out = {}
    ci = np.linalg.inv(c)
    for name, design in (("loglik", np.column_stack((np.ones(m), x))), ("loglik_null", np.ones((m, 1)))):
        beta = np.linalg.solve(design.T @ ci @ design, design.T @ ci @ y)
        r = y - design @ beta
        ssr = r @ ci @ r
        out[name] = -m / 2 * math.log(ssr) - m / 2 * (1 + math.log(math.pi / (m / 2))) - np.linalg.slogdet(c)[1] / 2
        if len(beta) == 2:
            out["r2m"] = beta[1] ** 2 / (beta[1] ** 2 + ssr / (m - 2))
    return out


@pytest.mark.parametrize("labels", ["aligned", "reference"])
def test_likelihood_equals_dense(spark, labels):
    n, rng = 7, np.random.default_rng(2)
    ij = [(i, j) for i in range(n) for j in range(i)]
    x, y = rng.random(len(ij)), rng.random(len(ij))
    base = spark.createDataFrame([(0, k, i, j, float(a), float(b)) for k, ((i, j), a, b) in enumerate(zip(ij, x, y))], "model_id long, pair_idx long, i long, j long, x double, y double")
    df = points.population_labels(base, n, labels)
    p = df.orderBy("pair_idx").collect()
    got = mlpe.fit(df, ["model_id"]).first()
    expected = dense(y, x, [r["pop1"] for r in p], [r["pop2"] for r in p], got["rho"])
    assert got["loglik"] == pytest.approx(expected["loglik"], abs=1e-9)
    assert got["r2m"] == pytest.approx(expected["r2m"], abs=1e-9)
    assert got["delta_aic_null"] == pytest.approx(2 * (expected["loglik"] - expected["loglik_null"]) - 2, abs=1e-8)
    best = max(dense(y, x, [r["pop1"] for r in p], [r["pop2"] for r in p], r)["loglik"] for r in np.linspace(0.0001, 0.4999, 800))
    assert got["loglik"] >= best - 1e-6


def test_likelihood_edge_cases(spark):
    df = spark.createDataFrame([(0, 1, 2, 1.0, 2.0)], "model_id long, pop1 int, pop2 int, x double, y double")
    assert mlpe.fit(df, ["model_id"]).count() == 0
    flat = spark.createDataFrame([(0, 1, 2, 1.0, 2.0), (0, 1, 3, 1.0, 3.0), (0, 2, 3, 1.0, 5.0)], "model_id long, pop1 int, pop2 int, x double, y double")
    assert mlpe.fit(flat, ["model_id"]).first()["loglik"] is None


# ---- models


def model_rows(spark):
    data = [(1, -10.0, 1, 0.5, 1, 2.0, 0, 0.9, 3, 4.0, -10.0, 24.0), (2, -12.0, 1, 1.0, 2, 5.0, 1, 0.3, 1, 9.0, -12.0, 28.0), (3, float("-inf"), 0, 0.1, 0, 1.0, 0, 0.1, 0, 1.0, None, None)]
    return spark.createDataFrame(data, "model_id long, fitness double, a int, a_weight double, a_trans int, a_shape double, b int, b_weight double, b_trans int, b_shape double, loglik double, aic double")


def test_inference(spark):
    df = inference.ranked(cleaning.finite_fitness(model_rows(spark)), 0.95)
    out = {r["model_id"]: r for r in df.collect()}
    w = 1 / (1 + math.exp(-2))
    assert out[1]["akaike_weight"] == pytest.approx(w) and out[2]["acc_akaike_weight"] == pytest.approx(1)
    assert out[1]["keep"] and out[2]["keep"]
    assert dict(rows(inference.variable_importance(df, ["a", "b"]))) == pytest.approx({"a": 1.0, "b": 1 - w})
    assert dict(rows(inference.averaged_weights(df, ["a", "b"], natural=True)))["b"] == pytest.approx(0.3)
    assert [tuple(r) for r in inference.best_model(df, ["a", "b"]).collect()] == [("a", 0.5, 2.0, 1.0)]
    assert cleaning.variables_of(df) == ["a", "b"]
    assert inference.wide_models(inference.long_models(df, ["a", "b"]), ["a"]).where("model_id = 2").first()["a_shape"] == 5
    assert inference.merge_top(df, df, 5).count() == 2


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.9, 0.95, 0, 1])
def test_keep_is_up_to_and_including_the_first_over(spark, threshold):
    rng = random.Random(threshold)
    weights = [rng.random() for _ in range(12)]
    weights = [w / sum(weights) for w in weights]
    df = spark.createDataFrame([(k, -float(k), w) for k, w in enumerate(weights)], "model_id long, fitness double, akaike_weight double")
    keep = [r["keep"] for r in inference.cumulative_keep(df, threshold).orderBy("model_id").collect()]
    cum = list(itertools.accumulate(weights))
    over = [k for k, c in enumerate(cum) if c > threshold]
    expected = [True] * 12 if not 0 < threshold < 1 or not over else [k <= over[0] for k in range(12)]
    assert keep == expected


def test_cleaning(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (1.0, 6.0, None), (1.0, float("nan"), None)], "a double, c double, b double")
    assert cleaning.scrub_bad_columns(df, ["a", "b", "c", "z"]).columns == ["c"]
    for bad in (["a"], ["z"]):
        with pytest.raises(ValueError):
            cleaning.scrub_bad_columns(df, bad)
    with pytest.raises(ValueError):
        cleaning.scrub_bad_columns(df.limit(0), ["a"])
    assert cleaning.drop_empty_columns(df).columns == ["a", "c"]
    assert cleaning.columns_vary(df.select("c")) and not cleaning.columns_vary(df)
    masked = cleaning.mask_unselected(model_rows(spark), ["a", "b"]).where("model_id = 1").first()
    assert masked["b_weight"] is None and masked["a_weight"] == 0.5
    assert inference.fitness_metric("delta") == "delta_aic_null"
    with pytest.raises(ValueError):
        inference.fitness_metric("x")


# ---- surfaces, chains


def test_surface_and_unselected(spark):
    long = spark.createDataFrame([(e, "v", float(e)) for e in range(11)], "edge_id long, var string, value double")
    models = spark.createDataFrame([(0, "v", 1, 0.5, 0, 1.0), (1, "v", 0, 0.5, 0, 1.0)], "model_id long, var string, sel int, weight double, transform int, shape double")
    out = rows(surface.surfaces(models, long), "edge_id")
    assert {r[0] for r in out} == {0} and [r[2] for r in out] == pytest.approx([k / 10 for k in range(11)])
    with pytest.raises(ValueError):
        surface.predictors(long.select("edge_id", F.lit(1.0).alias("v")), {"v": "ARITH"})


def test_euclidean_by_blocks(spark, monkeypatch):
    import math

    from thalweg.operators import points

    monkeypatch.setattr(points, "BLOCK", 4)
    vectors = {k: [float(k), k * k / 7, 1.0] for k in range(11)} | {11: [1.0, None, 2.0], 12: None, 13: [1.0, 2.0], 14: [0.0, 2.0]}
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<double>")
    found = {(r["i"], r["j"]): r["value"] for r in points.euclidean(df).collect()}
    assert set(found) == {(i, j) for i in vectors for j in vectors if i > j}
    for (i, j), value in found.items():
        a, b = vectors[i], vectors[j]
        if a and b and None not in a + b and len(a) == len(b):
            assert value == pytest.approx(math.dist(a, b))
        else:
            assert value is None
    assert points.euclidean(df.limit(0)).count() == 0


def test_pairs_are_dealt_out(spark):
    """A table in one split: its pairs are made in many tasks, not in one."""
    from thalweg.operators import points

    one = spark.range(40).coalesce(1).select("id", "id").toDF("pt_idx", "node_id")
    plan = points.pairs(one)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert points.pairs(one).count() == 780


def test_medians_of_large_groups_are_counted_down(spark, monkeypatch):
    """No aggregate holds a large group; whatever the values, the result is that of F.median."""
    monkeypatch.setattr(points, "FEW", 10)
    monkeypatch.setattr(points, "BINS", 4)
    rng = random.Random(4)
    groups = [[rng.random() ** 8 for _ in range(301)], [rng.gauss(0, 1) for _ in range(300)], [0.0] * 50 + [1.0] * 50, [2.0] * 80, [3.0, 1.0], [None] * 3, [1e300, 1e-300] * 40 + [5.0], [0.0] * 90 + [1.0], [1.0, float("inf"), 7.0] * 9]
    rows = spark.createDataFrame([(k, v) for k, g in enumerate(groups) for v in g], "k long, value double")
    sizes, stored = [], points.stored
    monkeypatch.setattr(points, "stored", lambda df, *more: sizes.append(stored(df, *more)) or sizes[-1])
    found = {r["k"]: r["value"] for r in points.medians(rows, ["k"]).collect()}
    assert found == {r["k"]: r["m"] for r in rows.groupBy("k").agg(F.median("value").alias("m")).collect()}
    assert len(sizes) > 2 and sizes[-1].where("value is null and n > 0 and high < double('inf')").agg(F.max("here")).first()[0] <= 10


def test_reindexed_cells_are_not_shuffled(spark):
    from thalweg.sources.tables import reindex_matrix

    labels = spark.createDataFrame([(f"p{k:03}", k) for k in range(70)] + [(None, 70)], "label string, pt_idx long")
    cells = [(f"p{a:03}", f"p{b:03}", float(a * b)) for a in range(70) for b in range(70) if a != b and (a, b) != (3, 66)] + [("p001", "p002", 9.0), ("zz", "p001", 1.0), (None, "p001", 1.0), ("p001", None, 1.0), ("p005", "yy", 1.0)]
    matrix = spark.createDataFrame(cells, "row_label string, col_label string, value double")
    out = reindex_matrix(matrix, labels)
    grid = labels.select(F.col("label").alias("row_label"), F.col("pt_idx").alias("i")).crossJoin(labels.select(F.col("label").alias("col_label"), F.col("pt_idx").alias("j")))
    expected = grid.join(matrix, ["row_label", "col_label"], "left").select("i", "j", "value")
    assert out.exceptAll(expected).isEmpty() and expected.exceptAll(out).isEmpty() and out.count() == 71 * 71 + 1
    assert not re.search(r"SortMergeJoin \[row_label#\d+, col_label#\d+\]", out._jdf.queryExecution().toString())


@pytest.mark.parametrize("words", [1, 3])
def test_reindexed_cells_by_several_numbers_of_bits(spark, monkeypatch, words):
    """Labels that take several rows of bits for each row of the matrix."""
    from thalweg.sources import tables

    monkeypatch.setattr(tables, "WORDS", words)
    labels = spark.range(200).select(F.col("id").alias("label"), F.col("id").alias("pt_idx"))
    a, b = (labels.select(F.col("label").alias(c)) for c in ("row_label", "col_label"))
    matrix = a.join(b, (F.col("row_label") != F.col("col_label")) & (F.col("row_label") % 50 != 7)).withColumn("value", F.lit(1.0))
    out = tables.reindex_matrix(matrix, labels)
    assert out.count() == out.select("i", "j").distinct().count() == 200 * 200
    assert out.where("value is null").count() == 4 * 200 + 196
    assert out.where((F.col("i") == F.col("j")) | (F.col("i") % 50 == 7)).where("value is not null").isEmpty()


def test_incidence_of_some_edges(spark):
    from thalweg.operators.tree import TreePaths

    tree = spark.createDataFrame([(1, 0, 11), (2, 0, 12), (3, 1, 13), (4, 1, 14)], "child long, parent long, edge_id long")
    at = spark.createDataFrame([(0, 0), (1, 3), (2, 4), (3, 2), (4, 3)], "pt_idx long, node_id long")
    out = TreePaths(tree, at).incidence_of([11, 13, 99])
    assert "SortMergeJoin" not in out._jdf.queryExecution().toString()
    found = {(r["i"], r["j"]): (r["e11"], r["e13"], r["e99"]) for r in out.collect()}
    assert found == {(1, 0): (1, 1, 0), (2, 0): (1, 0, 0), (2, 1): (0, 1, 0), (3, 0): (0, 0, 0), (3, 1): (1, 1, 0), (3, 2): (1, 0, 0), (4, 0): (1, 1, 0), (4, 2): (0, 1, 0), (4, 3): (1, 1, 0)}
