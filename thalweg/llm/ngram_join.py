"""N-gram Jaccard self-join by a MinHash LSH forest, verified exactly.

Documents are sets of five-word shingles. Each has a label in every tree of the forest, a sequence of minhashes; a tree is
the trie of its labels, and a node of the trie is a prefix that documents share. The join starts from whole labels and
shortens prefixes level by level. After each level the documents that newly share a node are compared exactly, and a
document is settled, its prefixes shortened no further, when the recall that its links speak for reaches the target: a
document among many close copies soon, one without a link not before a pair at the threshold would have been found.
Groups of candidates are compared block by block, so that neither a group nor its pairs ever meet in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship
from .common import durable, map_texts, stored, sweep, tidy
from .components import components, stars

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 24, 8, 0.9995
#: Documents of a candidate group that are compared at once with as many others.
BLOCK = 128


def met(similarity, depth: int, trees: int = TREES):
    """The probability that a pair shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold is met with probability `recall`: none is shortened beyond it."""
    while depth > 1 and met(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; a text of 1 to size-1 words is one shingle."""
    words = [t.encode("utf-8", "replace").split() for t in texts]
    flat = [w for ws in words for w in ws]
    hashes = pd.util.hash_array(np.array([*flat, b""], object), categorize=False)[:-1] if flat else np.zeros(0, np.uint64)
    out, at = [], 0
    for ws in words:
        h, n = hashes[at : at + len(ws)], len(ws)
        at += n
        k = min(size, n)
        acc = np.full(max(n - k + 1, 0) if n else 0, k, np.uint64)
        for i in range(k):
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[i : i + len(acc)]
        out.append(np.unique(_mix(acc)))
    return out


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1)
    return rng.integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def minhashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), 2**32 - 1, np.uint32)
    for i in range(0, len(shingles), 1024):
        best = np.minimum(best, ((shingles[i : i + 1024, None] * a + b) >> np.uint64(32)).astype(np.uint32).min(0))
    return best


def intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets in x with sets in y, by products of 0/1 matrices over the shared elements."""
    one, other = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(one, other)
    out = np.zeros((len(x), len(y)), np.float32)
    if not len(shared):
        return out

    def places(sets, flat):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        hit = shared[col] == flat
        return row[hit], col[hit]

    (rx, cx), (ry, cy) = places(x, one), places(y, other)
    ox, oy = np.argsort(cx, kind="stable"), np.argsort(cy, kind="stable")
    rx, cx, ry, cy = rx[ox], cx[ox], ry[oy], cy[oy]
    width = 4096
    for c in range(0, len(shared), width):
        mx, my = np.zeros((len(x), min(width, len(shared) - c)), np.float32), np.zeros((len(y), min(width, len(shared) - c)), np.float32)
        i, j = np.searchsorted(cx, [c, c + width])
        mx[rx[i:j], cx[i:j] - c] = 1
        i, j = np.searchsorted(cy, [c, c + width])
        my[ry[i:j], cy[i:j] - c] = 1
        out += mx @ my.T
    return out


def _linked(rids, copies, own, blocks, sets, i, j, threshold, trees, depths):
    """(rid, links, partners, hub, weights) of the documents of two blocks (or one) that have links between them, but for
    pairs of equal `own`, which were compared before. Weights: for each depth the sum over partners of 1 / met()."""
    left, right = (np.flatnonzero(blocks == k) for k in (i, j))
    if not len(left) or not len(right):
        return []
    xs, ys = [sets[k] for k in left], [sets[k] for k in right]
    inter = intersections(xs, ys).astype(float)
    union = np.array([len(s) for s in xs])[:, None] + np.array([len(s) for s in ys])[None, :] - inter
    near = (inter >= threshold * union - 1e-6) & (own[left][:, None] != own[right][None, :])
    if not near.any():
        return []
    weights = [np.where(near, 1 / met(np.maximum(inter / union, 1e-9), d, trees), 0.0) for d in depths]
    hubs = stars(near, rids[left], rids[right])
    out = []
    for side, other, axis in ((left, right, 1), (right, left, 0)) if i != j else ((left, right, 1),):
        linked = np.flatnonzero(near.any(axis))
        matrix = near if axis else near.T
        columns = (rids[side], matrix @ copies[other], near.sum(axis), hubs[1 - axis], *(w.sum(axis) for w in weights))
        out.extend(zip(*(c[linked].tolist() for c in columns)))
    return out


def _verify(threshold, trees, depths):
    columns = ["rid", "links", "partners", "hub", *(f"w{d}" for d in depths)]

    def run(batches):
        key, held = None, []

        def close():
            if not held:
                return
            rids, copies, own, blocks = (np.array([h[i] for h in held], np.int64) for i in range(4))
            yield from _linked(rids, copies, own, blocks, [h[4] for h in held], key[1], key[2], threshold, trees, depths)
            held.clear()

        for pdf in batches:
            out = []
            for group, i, j, rid, copies, own, block, data in pdf.itertuples(index=False, name=None):
                if (group, i, j) != key:
                    out.extend(close())
                    key = (group, i, j)
                held.append((rid, copies, own, block, np.frombuffer(data, np.uint64)))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(list(close()), columns=columns)

    return run


def _met_anew(now: DataFrame, before: DataFrame | None, block: int) -> DataFrame:
    """now, before: (node, component) -> (rid, component, own, b, i, j): which documents are compared in which task.

    Only components that join several earlier ones (`own`) are compared, and of those no pair of blocks within one earlier
    component. Earlier components of half a block or more have blocks of their own, smaller ones share blocks.
    """
    own = F.col("node") if before is None else F.coalesce("old", "node")
    joined = now if before is None else now.join(before.select("node", F.col("component").alias("old")), "node", "left")
    members = durable(joined.select(F.col("node").alias("rid"), "component", own.alias("own")))
    parts = members.groupBy("component", "own").agg(F.count(F.lit(1)).alias("size"))
    large = F.col("size") >= block // 2
    whole = parts.groupBy("component").agg(F.ceil(F.coalesce(F.sum(F.when(~large, F.col("size"))), F.lit(0)) / block).alias("shared"), F.sum(F.when(large, F.ceil(F.col("size") / block)).otherwise(0)).alias("more"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = W.partitionBy("component").orderBy("own").rowsBetween(W.unboundedPreceding, -1)
    big = parts.where(large).withColumn("k", F.ceil(F.col("size") / block)).select(F.col("component").alias("c"), F.col("own").alias("o"), "k", F.coalesce(F.sum("k").over(first), F.lit(0)).alias("first"))
    placed = members.join(whole, "component").join(big, (F.col("component") == F.col("c")) & (F.col("own") == F.col("o")), "left")
    start = F.col("shared") + F.col("first")
    b = F.when(F.col("k").isNull(), F.pmod(F.xxhash64("own"), F.col("shared"))).otherwise(start + F.pmod(F.xxhash64("rid"), F.col("k")))
    dealt = placed.select("rid", "component", "own", b.alias("b"), start.alias("start"), "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shared") + F.col("more") - 1)).alias("to"))
    apart = F.col("k").isNull() | (F.col("to") < F.col("start")) | (F.col("to") >= F.col("start") + F.col("k"))
    return dealt.where(apart).select("rid", "component", "own", "b", F.least("b", "to").alias("i"), F.greatest("b", "to").alias("j"))


@tidy
def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK, rid_col: str | None = None) -> DataFrame:
    """One row per input row: rid, doc_id, n_links, class_id, kept, depth.

    Links are pairs of rows whose sets of five-word shingles (words between ASCII white space, case kept) have a Jaccard
    similarity of threshold or more. n_links: rows linked directly; class_id: the smallest doc_id reachable by links, its
    own included; kept: true for one row of each class, the first of the smallest doc_id; depth: the prefix length at which
    the document was settled. rid: rid_col, which has to be stored with the row, or else a number given here.
    Texts of one to four words are one shingle; null texts and texts without words link with nothing. Repeated rows link
    like copies. Ids are of any type that can be ordered; null ids count as larger than all others, and a class with no
    other id has a null class_id. Empty table: no rows.

    Rows of equal sets are one node with a multiplicity, found by pre-aggregation; texts are fetched by content, so nothing
    depends on how the table is split. A trie node that many share is a star around its least document, never all pairs. A
    group of candidates (a component of those stars) is cut in blocks; each pair of blocks is compared in one task by matrix
    products and gives a row per document, not per pair.

    Prefixes are shortened by two hashes at a time, the last time to the shortest that is ever needed.

    Recall of a document at a depth: (k + p) / (sum of 1 / met(similarity) over its k partners + 1), p = met(threshold).
    That is the Horvitz-Thompson estimate from the partners found, with one more partner supposed, at the threshold.
    """
    spark = docs.sparkSession
    ship(spark)
    content = [F.xxhash64(F.lit(k), F.coalesce(F.col(text_col), F.lit(""))) for k in (0, 1)]
    rid = F.monotonically_increasing_id() if rid_col is None else F.col(rid_col)

    def start():
        a, b = _coefficients(trees * depth)

        def work(texts):
            h1, h2, labels = [], [], []
            for i in range(0, len(texts), 256):
                for s in shingle_sets(texts[i : i + 256]):
                    position = np.arange(1, len(s) + 1, dtype=np.uint64)
                    sums = [int(x.sum(dtype=np.uint64).astype(np.int64)) if len(s) else None for x in (_mix(s), _mix(s * np.uint64(0x2545F4914F6CDD1D) + position))]
                    h1.append(sums[0]), h2.append(sums[1])
                    labels.append([x.tobytes() for x in minhashes(s, a, b).reshape(trees, depth)] if len(s) else None)
            return h1, h2, labels

        return work

    carried = {"rid": rid, "doc_id": F.col(id_col), "c1": content[0], "c2": content[1]}
    sketch = durable(map_texts(docs, text_col, carried, {"h1": "long", "h2": "long", "labels": "array<binary>"}, start))
    order = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("d"), F.col("rid").alias("r"))
    nodes = sketch.where("h1 is not null").groupBy("h1", "h2").agg(F.min(F.struct("rid", "c1", "c2", "labels")).alias("x"), F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = durable(nodes.select("h1", "h2", "x.*", "first", "copies"))
    own = durable(sketch.select("rid", "doc_id", "h1", "h2"), keep=True)
    del sketch
    sweep(spark)
    least = prefix_depth(threshold, trees, depth, recall)

    def key(d):
        prefix = F.substring("label", 1, 4 * d)
        return F.xxhash64("tree", prefix).alias("k1"), F.xxhash64(F.lit(7), "tree", prefix).alias("k2")

    # the tries, without the labels that share not even the shortest prefix
    labels = nodes.select("rid", F.posexplode("labels").alias("tree", "label"))
    shared = labels.select(*key(least)).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    tries = durable(labels.select("*", *key(least)).join(durable(shared), ["k1", "k2"], "left_semi").select("rid", "tree", "label"))
    nodes = durable(nodes.drop("labels"))
    del labels, shared
    sweep(spark)
    candidates = tries.select("rid").distinct().join(nodes.select("rid", "c1", "c2", "copies"), "rid")
    texts = docs.groupBy(content[0].alias("c1"), content[1].alias("c2")).agg(F.first(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).join(candidates, ["c1", "c2"])
    sets = durable(map_texts(texts, "text", {"rid": F.col("rid"), "copies": F.col("copies")}, {"data": "binary"}, lambda: lambda texts: ([s.tobytes() for s in shingle_sets(texts)],)))

    del texts, candidates
    sweep(spark)
    depths = sorted({*range(max(depth, least), least, -2), least}, reverse=True)
    groups, verified, settled = None, [], spark.createDataFrame([], "rid long, depth int")
    for d in depths:  # whole labels, two hashes less and so on, and the shortest prefix
        sweep(spark)
        at = tries.select("rid", *key(d))
        open_ = at.join(settled.select("rid", F.lit(True).alias("done")), "rid", "left")
        nodes_at = durable(open_.groupBy("k1", "k2").agg(F.min("rid").alias("hub"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("done").isNull()).alias("open")).where("n > 1 and open").select("k1", "k2", "hub"))
        spokes = at.join(nodes_at, ["k1", "k2"]).where("rid <> hub").select(F.col("rid").alias("a"), F.col("hub").alias("b"))
        if groups is not None:
            spokes = spokes.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
        now = components(spokes)
        due = _met_anew(now, groups, block).join(sets, "rid").select("component", "i", "j", "rid", "copies", "own", "b", "data")
        dealt = due.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
        fields = "rid long, links long, partners long, hub long, " + ", ".join(f"w{x} double" for x in depths)
        verified.append(durable(dealt.mapInPandas(_verify(threshold, trees, depths), fields)))
        groups, links = now, verified[0]
        for more in verified[1:]:
            links = links.unionByName(more)
        seen = links.groupBy("rid").agg(F.sum("links").alias("links"), F.sum("partners").alias("k"), F.sum(f"w{d}").alias("w"))
        enough = (F.col("k") + met(threshold, d, trees)) / (F.col("w") + 1) >= recall
        if d > least:
            settled = stored(settled.unionByName(seen.where(enough).select("rid", F.lit(d).alias("depth")).join(settled.select("rid"), "rid", "left_anti")))
    classes = components(links.select(F.col("rid").alias("a"), F.col("hub").alias("b")))
    whole = nodes.join(classes.withColumnRenamed("node", "rid"), "rid", "left").join(seen.select("rid", "links"), "rid", "left").join(settled, "rid", "left").withColumn("class", F.coalesce("component", "rid"))
    whole = durable(whole.select("h1", "h2", "first", "copies", "class", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("depth", F.lit(least)).alias("depth")))
    firsts = durable(whole.groupBy("class").agg(F.min("first").alias("top")))
    named = durable(whole.join(firsts, "class").select("h1", "h2", "top", "depth", (F.col("links") + F.col("copies") - 1).alias("n_links")), keep=True)
    joined = own.where("h1 is not null").join(named, ["h1", "h2"]).select("rid", "doc_id", "n_links", "top", "depth")
    alone = own.where("h1 is null").select("rid", "doc_id", F.lit(0).cast("long").alias("n_links"), order.alias("top"), F.lit(least).alias("depth"))
    return joined.unionByName(alone).select("rid", "doc_id", F.col("n_links").cast("long").alias("n_links"), F.col("top.d").alias("class_id"), (F.col("rid") == F.col("top.r")).alias("kept"), "depth")
