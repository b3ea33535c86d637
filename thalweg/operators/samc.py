"""Movement on a directed network as an absorbing Markov chain over edges, and conditional first-passage times."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.transforms import fill_zeros, rescale_over
from ..shipping import ship
from ..storage import observed, stored, tidy
from .keys import numbered_in_order
from .points import spread, squared_distances
from .tree import BLOCK, WIDE, TreePaths, block_pairs, met, pairs_by_block, root_sums, tasks, tiles


def absorption(tree: DataFrame, sizes: DataFrame) -> DataFrame:
    """sizes: (node_id, size), several rows a node allowed -> (edge_id, absorb): 1 / (2 x mean size) on the edge that
    leaves each site."""
    mean = sizes.groupBy("node_id").agg(F.avg("size").alias("size"))
    return tree.join(mean, F.col("child") == F.col("node_id")).select("edge_id", F.try_divide(F.lit(1.0), 2 * F.col("size")).alias("absorb"))


def conductance(surface: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(edge_id, resistance) -> (edge_id, conductance) in (0, 1]: [0, 1], zeros to the least positive, inverted, and the
    same once more."""
    over = W.partitionBy(*(keys or [])).orderBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = surface.withColumn("x", rescale_over(F.col("resistance"), over)).withColumn("x", fill_zeros(F.col("x"), over)).withColumn("x", 1 / F.col("x"))
    x = x.withColumn("x", rescale_over(F.col("x"), over)).withColumn("x", fill_zeros(F.col("x"), over))
    return x.select(*(keys or []), "edge_id", F.col("x").alias("conductance"))


def transition(adjacency: DataFrame, values: DataFrame, directional: bool = False, absorb: DataFrame | None = None) -> DataFrame:
    """(edge_i, edge_j, dir) with (edge_id, conductance) -> (i, j, p): the mean of the two edges' values (their difference if
    directional, floored at zero), normalised by row to what absorption leaves."""
    a = values.select(F.col("edge_id").alias("i"), F.col("conductance").alias("vi"))
    b = values.select(F.col("edge_id").alias("j"), F.col("conductance").alias("vj"))
    moves = adjacency.select(F.col("edge_i").alias("i"), F.col("edge_j").alias("j"), "dir").join(a, "i").join(b, "j")
    raw = F.greatest(F.col("vi") - F.col("vj"), F.lit(0.0)) if directional else (F.col("vi") + F.col("vj")) / 2
    moves = moves.select("i", "j", raw.alias("w"))
    total = moves.groupBy("i").agg(F.sum("w").alias("total"))
    rows = moves.join(total, "i")
    if absorb is not None:
        rows = rows.join(absorb.select(F.col("edge_id").alias("i"), "absorb"), "i", "left")
        stay = 1 - F.coalesce("absorb", F.lit(0.0))
    else:
        stay = F.lit(1.0)
    return rows.select("i", "j", (F.coalesce(F.try_divide(F.col("w"), F.col("total")), F.lit(0.0)) * stay).alias("p"))


def neighbour_means(adjacency: DataFrame, values: DataFrame) -> DataFrame:
    """(edge_id, downstream, upstream): mean move probability each way, null where there is no such neighbour."""
    moves = adjacency.join(values, (F.col("edge_i") == F.col("i")) & (F.col("edge_j") == F.col("j")))
    return moves.groupBy(F.col("edge_i").alias("edge_id")).agg(F.avg(F.when(F.col("dir") > 0, F.col("p"))).alias("downstream"), F.avg(F.when(F.col("dir") < 0, F.col("p"))).alias("upstream"))


def move_surface(models: DataFrame, curves: DataFrame, adjacency: DataFrame) -> DataFrame:
    """models: (model_id, var, sel, weight, transform, shape, asymmetric); curves: (var, transform, shape, edge_id, value) in
    [0, 1]; adjacency: (edge_i, edge_j, dir) -> (model_id, i, j, w): the conductance of each move from edge to edge.

    A variable's resistance of a move is the mean of both edges' values, or, asymmetric, the value of the edge moved to less
    that of the edge moved from; in [0, 1] over all moves. The weighted sum of the selected variables is made a conductance:
    [0, 1], zeros to the least positive, inverted, and the same once more. A variable's moves are computed once for all
    models that share its curve and its asymmetry. Constant surfaces give nulls, models without variables no rows.
    """
    chosen = models.where("sel = 1").select("model_id", "var", "weight", "transform", F.col("shape").cast("double").alias("shape"), F.col("asymmetric").cast("boolean").alias("asymmetric"))
    kinds = chosen.select("var", "transform", "shape", "asymmetric").distinct()
    here = curves.select("var", "transform", F.col("shape").cast("double").alias("shape"), "edge_id", "value")
    a = here.select("var", "transform", "shape", F.col("edge_id").alias("i"), F.col("value").alias("vi"))
    b = here.select("var", "transform", "shape", F.col("edge_id").alias("j"), F.col("value").alias("vj"))
    curve = ["var", "transform", "shape"]
    moves = adjacency.select(F.col("edge_i").alias("i"), F.col("edge_j").alias("j")).join(a, "i").join(b, [*curve, "j"]).join(kinds, curve)
    raw = moves.withColumn("r", F.when(F.col("asymmetric"), F.col("vj") - F.col("vi")).otherwise((F.col("vi") + F.col("vj")) / 2))
    over = W.partitionBy(*curve, "asymmetric")
    one = raw.select(*curve, "asymmetric", "i", "j", rescale_over(F.col("r"), over).alias("r"))
    summed = chosen.join(one, [*curve, "asymmetric"]).groupBy("model_id", "i", "j").agg(F.sum(F.col("weight") * F.col("r")).alias("w"))
    mine = W.partitionBy("model_id")
    for inverted in (False, True):
        value = 1 / F.col("w") if inverted else F.col("w")
        summed = summed.withColumn("w", value).withColumn("w", rescale_over(F.col("w"), mine)).withColumn("w", fill_zeros(F.col("w"), mine))
    return summed


def probabilities(moves: DataFrame, absorb: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., i, j, w) with (edge_id, absorb) -> (keys..., i, j, p): by row in proportion to w, what absorption leaves."""
    total = moves.groupBy(*keys, "i").agg(F.sum("w").alias("total"))
    rows = moves.join(total, [*keys, "i"]).join(absorb.select(F.col("edge_id").alias("i"), "absorb"), "i", "left")
    return rows.select(*keys, "i", "j", (F.coalesce(F.try_divide(F.col("w"), F.col("total")), F.lit(0.0)) * (1 - F.coalesce("absorb", F.lit(0.0)))).alias("p"))


def edge_tree(tree: DataFrame) -> DataFrame:
    """tree: (child, parent, edge_id) -> (child, parent, edge_id) of edges: each edge under the next towards the root, those at
    the root under a node of their own, whose id is one below all others."""
    at = tree.select(F.col("child").alias("parent"), F.col("edge_id").alias("above"))
    none = tree.agg((F.min("edge_id") - 1).alias("none"))
    linked = tree.join(at, "parent", "left").crossJoin(F.broadcast(none))
    return linked.select(F.col("edge_id").alias("child"), F.coalesce("above", "none").alias("parent"), "edge_id")


def _chance(move, leaving):
    """Of a walk that leaves, null where none does though there is a move."""
    return F.when(move == 0, F.lit(0.0)).otherwise(F.try_divide(move, leaving))


def _settled(links: DataFrame, keys: list[str], step, tolerance: float, max_rounds: int, max_fail: int | None, name: str) -> DataFrame:
    """links with messages h, from 0 on, until none changes by more than tolerance; those that still do after max_rounds are
    null, and more than max_fail of them an error."""
    now = links.withColumn("h", F.lit(0.0)).withColumn("was", F.lit(-1.0))
    change = F.abs(F.col("h") - F.col("was"))
    for _ in range(max_rounds):
        now, seen = observed(step(now), name, change=F.max(change))
        if (seen["change"] or 0.0) <= tolerance:
            break
    open_ = F.col("h").isNull() | (change > tolerance)
    failed = now.where(open_).count()
    if max_fail is not None and failed > max_fail:
        raise ValueError(f"{failed} of the messages have not settled, {max_fail} may fail")
    return now.withColumn("h", F.when(~open_, F.col("h"))).drop("was")


#: Models whose passages are made at once.
MODELS = 32
#: What a site carries: sums over the edges from the root of the messages' logarithms, and of their failures: a message of
#: zero counts 1 there, one that has not settled LOST.
_SITE, LOST = ("log_rise", "bad_rise", "log_fall", "bad_fall"), 2**26


def _site_rows(tree: DataFrame, moves: DataFrame, absorb: DataFrame, sites: DataFrame, keys: list[str], tolerance: float, max_rounds: int, max_fail: int | None) -> tuple[DataFrame, TreePaths]:
    """The sites of each key as pairs_by_block() takes them, d being _SITE and low the same where paths meet; and their paths."""
    up_tree = stored(edge_tree(tree), "edge-tree")
    moves = stored(moves.select(*keys, "i", "j", "p"), "moves")
    leaving = moves.groupBy(*keys, F.col("i").alias("edge")).agg(F.sum("p").alias("out"))
    up = moves.select(*keys, F.col("i").alias("edge"), F.col("j").alias("above"), F.col("p").alias("up"))
    down = moves.select(*keys, F.col("j").alias("edge"), F.col("i").alias("above"), F.col("p").alias("down"))
    gone = absorb.groupBy(F.col("edge_id").alias("edge")).agg(F.first("absorb").alias("absorb"))
    pairs = up_tree.select(F.col("child").alias("edge"), F.col("parent").alias("above"))
    # every key has every edge, those that no move leaves too
    links = (moves.select(*keys).distinct().crossJoin(pairs) if keys else pairs).join(leaving, [*keys, "edge"], "left").join(gone, "edge", "left")
    links = links.withColumn("exit", F.coalesce("out", F.lit(0.0)) + F.coalesce("absorb", F.lit(0.0)))
    links = links.join(up, [*keys, "edge", "above"], "left").join(down, [*keys, "edge", "above"], "left")
    links = stored(links.fillna(0.0, ["up", "down"]).select(*keys, "edge", "above", "exit", "up", "down"), "links")

    def upwards(now):
        below = now.groupBy(*keys, F.col("above").alias("edge")).agg(F.sum(F.col("down") * F.col("h")).alias("back"))
        return now.join(below, [*keys, "edge"], "left").select(*keys, "edge", "above", "exit", "up", "down", _chance(F.col("up"), F.col("exit") - F.coalesce("back", F.lit(0.0))).alias("h"), F.col("h").alias("was"))

    rise = _settled(links, keys, upwards, tolerance, max_rounds, max_fail, "rise")
    rise = stored(rise.withColumnRenamed("h", "rise"), "rise")
    over = rise.groupBy(*keys, F.col("above").alias("edge")).agg(F.sum(F.col("down") * F.col("rise")).alias("back"))
    above = rise.join(over, [*keys, "edge"]).select(*keys, F.col("edge").alias("above"), F.col("exit").alias("exit_above"), F.col("up").alias("up_above"), "back")
    falls = stored(rise.join(above, [*keys, "above"], "left").select(*keys, "edge", "above", "down", "rise", "exit_above", "up_above", "back"), "falls")

    def downwards(now):
        there = now.select(*keys, F.col("edge").alias("above"), F.col("h").alias("h_above"))
        rest = F.col("exit_above") - (F.col("back") - F.col("down") * F.col("rise")) - F.col("up_above") * F.coalesce("h_above", F.lit(0.0))
        # at the root there is no edge to fall from
        fallen = F.when(F.col("exit_above").isNull(), F.lit(0.0)).otherwise(_chance(F.col("down"), rest))
        return now.join(there, [*keys, "above"], "left").select(*keys, "edge", "above", "down", "rise", "exit_above", "up_above", "back", fallen.alias("h"), F.col("h").alias("was"))

    both = _settled(falls, keys, downwards, tolerance, max_rounds, max_fail, "falls").withColumnRenamed("h", "fall")
    sums = []
    for c in ("rise", "fall"):
        sums.append(F.when(F.col(c) > 0, F.ln(F.col(c))).otherwise(0.0).alias(f"log_{c}"))
        sums.append(F.when(F.col(c).isNull(), F.lit(float(LOST))).when(F.col(c) == 0, 1.0).otherwise(0.0).alias(f"bad_{c}"))
    paths = TreePaths(up_tree, sites.select(F.col("edge_id").alias("pt_idx"), F.col("edge_id").alias("node_id")).distinct())
    sums = stored(root_sums(paths.tour, both.select(*keys, F.col("edge").alias("edge_id"), *sums), keys, list(_SITE)), "passage-sums")
    at = paths.ordered.select("o", "pt_idx").join(paths.between, "o").join(sums.withColumnRenamed("child", "pt_idx"), "pt_idx")
    there = sums.select(*keys, F.col("child").alias("node"), *[F.col(c).alias(f"low_{c}") for c in _SITE])
    rows = at.join(there, [*keys, "node"], "left").fillna(0.0, [f"low_{c}" for c in _SITE])
    return rows.select(*keys, "o", "pt_idx", *_SITE, "depth", *[f"low_{c}" for c in _SITE]), paths


def _chances(origin, target, low):
    """From what one end carries upwards, the other downwards, and where they meet, each (log, bad): the chance, NaN if lost."""
    bad = origin[1] - low[1] + target[1] - low[3]
    value = np.exp(origin[0] - low[0] + target[0] - low[2])
    return np.where(bad >= LOST, np.nan, np.where(bad > 0.5, 0.0, value))


@tidy
def passage(tree: DataFrame, moves: DataFrame, absorb: DataFrame, sites: DataFrame, keys: list[str] | None = None, tolerance: float = 1e-13, max_rounds: int = 10_000, max_fail: int | None = None) -> DataFrame:
    """(keys..., origin, target, value) for all ordered pairs of site edges: the probability that a walk from the origin
    reaches the target before it is absorbed.

    tree: (child, parent, edge_id); moves: (keys..., i, j, p) between edges that follow each other; absorb: (edge_id, absorb),
    absent or null is 0; sites: (edge_id). What an edge's moves and absorption leave of 1 is staying.

    Edges form a tree, so a walk passes every edge between origin and target, and the value is a product: of the chances that
    a walk from an edge ever reaches the next one, upwards and downwards. These are messages. Each follows from those of the
    edges behind it; all are updated at once, for all keys, until they settle, which takes no more rounds than the tree is
    high. Their logarithms are summed along paths as resistances are. No system is solved for a target, and no matrix made.
    Sites on branches that meet only at the root cannot reach each other: 0. Messages that do not settle: null.
    """
    keys = keys or []
    rows, paths = _site_rows(tree, moves, absorb, sites, keys, tolerance, max_rounds, max_fail)

    def both_ways(p, q, da, db, low, depth):
        value = np.concatenate((_chances(da[:2], db[2:], low), _chances(db[:2], da[2:], low)))
        return np.concatenate((p, q)), np.concatenate((q, p)), pa.array(value, mask=np.isnan(value))

    fields = {"origin": "long", "target": "long", "value": "double"}
    return pairs_by_block(rows, keys, paths.n_points, fields, both_ways, _SITE, tuple(f"low_{c}" for c in _SITE), keep=True)


@tidy
def passage_parts(tree: DataFrame, moves: DataFrame, absorb: DataFrame, points: DataFrame, response: DataFrame, keys: list[str], mean: bool = False, tolerance: float = 1e-13, max_rounds: int = 10_000, max_fail: int | None = None) -> DataFrame:
    """points: (pt_idx, edge_id); response: (i, j, pop1, pop2, y) -> the parts that mlpe.sums_of_parts() adds up, x being the
    passage from i to j, or the mean of both ways.

    A task takes two blocks of sites, with what all keys have there, and the responses between them: the places where paths
    meet are found once for all keys, and of a key's pairs only sums leave the task.
    """
    sites = points.select("edge_id").distinct()
    rows, paths = _site_rows(tree, moves, absorb, sites, keys, tolerance, max_rounds, max_fail)
    spark, lows = tree.sparkSession, tuple(f"low_{c}" for c in _SITE)
    ship(spark)
    n = tasks(spark, paths.n_points)
    left = block_pairs(rows, keys, _SITE, lows).repartition(n, "first", "second")
    placed = points.join(paths.ordered.select(F.col("pt_idx").alias("edge_id"), "o"), "edge_id")
    i, j = (placed.select(F.col("pt_idx").alias(c), F.col("o").alias(f"o_{c}")) for c in "ij")
    known = response.where("y is not null").select("i", "j", "pop1", "pop2", "y").join(i, "i").join(j, "j").where("o_i <> o_j")
    low, high = F.least("o_i", "o_j"), F.greatest("o_i", "o_j")
    block = lambda o: F.floor(o / BLOCK).cast("long")
    right = known.select(block(low).alias("first"), block(high).alias("second"), (low % BLOCK).alias("a"), (high % BLOCK).alias("b"), (F.col("o_i") > F.col("o_j")).alias("turned"), "pop1", "pop2", "y")
    schema = T.StructType([*[left.schema[k] for k in keys], T.StructField("pop", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("m", "x", "y", "xx", "yy", "xy")]])

    def work(blocks: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(blocks) and len(known):
            a, b, turned, y = (known[c].to_numpy() for c in ("a", "b", "turned", "y"))
            pops, at_pop = np.unique(known[["pop1", "pop2"]].to_numpy(), return_inverse=True)
            at_pop = at_pop.reshape(-1, 2)
            one = blocks.iloc[0]
            mid = None if pd.isna(one["mid_depth"]) else int(one["mid_depth"])
            at = met(one["first"] == one["second"], one["depth_a"], one["depth_b"], mid, a, b)
            for row in blocks.to_dict("records"):
                low = [np.concatenate((row[f"{c}_a"], row[f"{c}_b"], [] if mid is None else [row[f"mid_{c}"]]))[at] for c in lows]
                ends = [[row[f"{c}_{t}"][k] for c in _SITE] for t, k in (("a", a), ("b", b))]
                i, j = ([np.where(turned, v, u) for u, v in zip(*two)] for two in (ends, ends[::-1]))
                x = _chances(i[:2], j[2:], low)
                if mean:
                    back = _chances(j[:2], i[2:], low)
                    x = np.where(np.isnan(x), back, np.where(np.isnan(back), x, (x + back) / 2))
                fine = ~np.isnan(x)
                if not fine.any():
                    continue
                xs, ys, ps = x[fine], y[fine], at_pop[fine]
                each = lambda v: sum(np.bincount(ps[:, k], v, len(pops)) for k in (0, 1))  # noqa: E731, B023
                degree = each(np.ones(len(xs)))
                some = degree > 0
                here = {k: row[k] for k in keys}
                out.append(pd.DataFrame({**here, "pop": pops[some], "m": degree[some], "x": each(xs)[some], "y": each(ys)[some], "xx": 0.0, "yy": 0.0, "xy": 0.0}).astype({"pop": "Int64"}))
                whole = {"m": len(xs), "x": xs.sum(), "y": ys.sum(), "xx": ((xs - xs.mean()) ** 2).sum(), "yy": (ys * ys).sum(), "xy": (xs * ys).sum()}
                out.append(pd.DataFrame([{**here, "pop": None, **{k: float(v) for k, v in whole.items()}}]).astype({"pop": "Int64"}))
        return pd.concat(out) if out else pd.DataFrame({f.name: [] for f in schema})

    by = ["first", "second"]
    return stored(left.groupBy(*by).cogroup(right.repartition(n, *by).groupBy(*by)).applyInPandas(work, schema), "passage-parts", keep=True)


def _of_model(a, b, at, turned, mean):
    """Of the pairs of two tiles the passage from the point of larger number to the other (or the mean of both ways), NaN if
    lost. a, b: _SITE of the points as a column and a row; at: the same where paths meet; turned: where b's number is larger."""

    def way(up, down):
        value = np.exp(up[0] + down[2] - (at[0] + at[2]))
        if any(np.any(v) for v in (up[1], down[3], at[1], at[3])):
            bad = up[1] - at[1] + down[3] - at[3]
            value = np.where(bad >= LOST, np.nan, np.where(bad > 0.5, 0.0, value))
        return value

    there, back = way(a, b), way(b, a)
    if mean:
        return np.where(np.isnan(there), back, np.where(np.isnan(back), there, (there + back) / 2))
    return np.where(turned, back, there)


@tidy
def passage_distance_parts(tree: DataFrame, moves: DataFrame, absorb: DataFrame, points: DataFrame, vectors: DataFrame, keys: list[str], mean: bool = False, tolerance: float = 1e-13, max_rounds: int = 10_000, max_fail: int | None = None, wide: int = WIDE, tile: int = BLOCK) -> DataFrame:
    """passage_parts() where the response is the distance of the points' vectors, (pt_idx, v), one for each and of one length,
    populations are the points, and no two points are on one edge: passages and responses are made where they are added up,
    and no pair is stored, joined or shuffled.

    A task takes two of `wide` blocks of points, with what up to MODELS keys have there: the places where paths meet and the
    distances are found once for these, tile by tile, and of a key only sums by point leave the task.
    """
    spark = tree.sparkSession
    ship(spark)
    named = stored(points.join(vectors, "pt_idx").select(F.col("edge_id").alias("edge"), F.col("pt_idx").alias("pt"), "v"), "named-sites")
    rows, paths = _site_rows(tree, moves, absorb, named.select(F.col("edge").alias("edge_id")), keys, tolerance, max_rounds, max_fail)
    numbers = stored(numbered_in_order(moves.select(*keys).distinct(), *keys, column="key"), "keys")
    values = F.struct("key", F.array(*_SITE).alias("s"), F.array(*[f"low_{c}" for c in _SITE]).alias("l"))
    # every key has every site
    each = rows.join(F.broadcast(numbers), keys).groupBy(F.expr(f"key div {MODELS}").alias("some"), "o", "pt_idx", "depth").agg(F.array_sort(F.collect_list(values)).alias("x"))
    each = each.select("some", "o", F.col("pt_idx").alias("edge"), "depth", F.flatten("x.s").alias("s"), F.flatten("x.l").alias("l")).join(named, "edge").withColumnRenamed("pt", "pt_idx")
    fields = ("pt_idx", "s", "v", "depth", "l")
    given = ["some", "first", "second", "mid_depth", "mid_l", *[f"{c}_{t}" for t in "ab" for c in fields]]
    dealt = spread(block_pairs(each, ["some"], ("s", "v"), ("l",), size=max(tile, -(-paths.n_points // wide))), "some", "first", "second").select(*given)
    sums = ("m", "x", "y", "xx", "yy", "xy")
    schema = pa.schema([(c, pa.int64()) for c in ("key", "pop", "first", "second")] + [(c, pa.float64()) for c in sums])

    def run(batches):
        for batch in batches:
            col = {c: batch.column(k) for k, c in enumerate(given)}
            for r in range(batch.num_rows):
                cell = lambda c: col[c][r].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
                matrix = lambda c: np.stack(cell(c))
                some, first, second, mid = (col[c][r].as_py() for c in ("some", "first", "second", "mid_depth"))
                (ia, ib), (va, vb), (sa, sb) = ([f(f"{c}_{t}") for t in "ab"] for f, c in ((cell, "pt_idx"), (matrix, "v"), (matrix, "s")))
                na, nb, n_keys = len(ia), len(ib), sa.shape[1] // len(_SITE)
                # by key and value of _SITE
                sa, sb = (s.reshape(len(s), n_keys, len(_SITE)).transpose(1, 2, 0) for s in (sa, sb))
                low = np.concatenate((matrix("l_a"), matrix("l_b"), *([] if mid is None else [[col["mid_l"][r].as_py()]]))).reshape(-1, n_keys, len(_SITE)).transpose(1, 2, 0).copy()
                la, lb = (np.full(len(v), v.shape[1]) for v in (va, vb))
                a, b = {"depth": cell("depth_a"), "low": np.arange(na)}, {"depth": cell("depth_b"), "low": na + np.arange(nb)}
                of_a, of_b, whole = np.zeros((n_keys, 3, na)), np.zeros((n_keys, 3, nb)), np.zeros((n_keys, len(sums)))
                for s, t, x, y, at in tiles(first == second, a, b, None if mid is None else (mid, na + nb), tile):
                    gap = np.sqrt(squared_distances(va[s], la[s], vb[t], lb[t], quick=True)[x, y])
                    turned = ia[s][x] < ib[t][y]
                    inner = gap.ndim == 1  # pairs within one tile
                    for k in range(n_keys):
                        value = _of_model(sa[k][:, s][:, x], sb[k][:, t][:, y], low[k][:, at], turned, mean)
                        fine = ~np.isnan(value)
                        all_fine = fine.all()
                        got, resp, one = (value, gap, np.ones_like(gap)) if all_fine else (np.where(fine, value, 0.0), np.where(fine, gap, 0.0), fine.astype(float))
                        for c, v in enumerate((one, got, resp)):
                            of_a[k, c, s] += np.bincount(x, v, s.stop - s.start) if inner else v.sum(axis=1)
                            of_b[k, c, t] += np.bincount(y, v, t.stop - t.start) if inner else v.sum(axis=0)
                        m = one.sum()
                        if not m:
                            continue
                        was, own = whole[k, 0], got.sum() / m
                        off = (got - own) * one
                        shift = own - whole[k, 1] / was if was else 0.0
                        whole[k] += (m, got.sum(), resp.sum(), (off * off).sum() + shift * shift * was * m / (was + m), (resp * resp).sum(), (got * resp).sum())
                for k in range(n_keys):
                    if not whole[k, 0]:
                        continue
                    ids, by = np.concatenate((ia, ib)), np.concatenate((of_a[k], of_b[k]), axis=1)
                    there = by[0] > 0
                    n = int(there.sum())
                    columns = [np.append(u, v) for u, v in zip([*by[:, there], *np.zeros((3, n))], whole[k])]
                    of_pairs = lambda v: pa.array([None] * n + [v], pa.int64())  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, some * MODELS + k)), pa.array([*(ids[there] + 1), None], pa.int64()), of_pairs(first), of_pairs(second), *map(pa.array, columns)], schema=schema)

    parts = dealt.mapInArrow(run, "key long, pop long, first long, second long, " + ", ".join(f"{c} double" for c in sums))
    # what a task has of a point is added up there
    parts = parts.groupBy("key", "pop", "first", "second").agg(*[F.sum(c).alias(c) for c in sums])
    return stored(parts.join(F.broadcast(numbers), "key").select(*keys, "pop", *sums), "passage-parts", keep=True)
