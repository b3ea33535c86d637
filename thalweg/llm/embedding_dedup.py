"""Near-duplicate embeddings by NN-descent.

A graph of each vector's best neighbours known so far starts from buckets of random projections and is refined by joining
neighbours of neighbours: vectors that meet around a common neighbour are compared, and better ones enter the lists. A list
that is saturated, full of links (cosine at the threshold or above), is enlarged, and its neighbours meet again, until it
holds a vector that is no link: then it holds all of them. Lists that are still full at the largest size belong to
components whose links are counted by comparing block with block, and they are searched on for vectors outside. An audit
compares a sample with all vectors; while it shows that links are missing, refinement goes on with further tables, and
where that does not help, all vectors are compared with all.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship
from .common import durable, stored, tidy, uniform
from .components import components

THRESHOLD, NEIGHBOURS, TABLES, BUCKET, BLOCK = 0.95, 8, 6, 48, 128
#: A saturated list is enlarged by this factor, up to so many places.
ENLARGED, MOST_NEIGHBOURS = 2, 32
#: Refinement rests when fewer than this share of all list places changed, and ends after so many rounds for an audit.
SETTLED, ROUNDS = 0.02, 4
#: Vectors of the audit (expected; more from 10,000 vectors on, up to a bound), the recall it asks for of each of them, and
#: how often refinement may be resumed for it.
AUDIT, MOST_AUDITED, RECALL, RESUMED = 400, 4096, 0.999, 4
#: Probability that a pair at the threshold is in no common bucket of all tables; block of the comparison of all with all.
APART, ALL_BLOCK = 0.0005, 1024


def _unit(vectors) -> np.ndarray:
    """Rows of length 1; scaled by powers of two first, which loses nothing, so that no square over- or underflows."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _grouped(batches, keys: list[str]):
    """Frames of equal keys out of sorted batches, one at a time."""
    held, last = [], None
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(pdf)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(k[a])
            if last is not None and key != last:
                yield last, held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(pdf.iloc[a:b])
            last = key
    if held:
        yield last, held[0] if len(held) == 1 else pd.concat(held)


def _hubs(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id in each row's component of a symmetric matrix."""
    label = ids.copy()
    while True:
        low = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(1))
        if (low == label).all():
            return label
        label = low


def _compare(threshold: float):
    """(u, w, sim, link): candidates that beat the last of u's list, as many as it has places, and links as stars around the
    least id."""

    def run(batches):
        out = []
        for _, g in _grouped(batches, ["g1", "g2"]):
            if len(g) < 2:
                continue
            ids, low, new = g["id"].to_numpy(np.int64), g["low"].to_numpy(float), g["fresh"].to_numpy(bool)
            own = g["component"].to_numpy(np.int64)
            if (own == own[0]).all():
                continue
            x = _unit(g["vec"])
            sims = x @ x.T
            np.fill_diagonal(sims, -2)
            # links between old members were reported when these first met; those within a component are counted in the end
            near, unmet = sims >= threshold, (new[:, None] | new[None, :]) & (own[:, None] != own[None, :])
            if (near & unmet).any():
                hub = _hubs(near, ids)
                at = np.flatnonzero(hub != ids)
                out.append(pd.DataFrame({"u": ids[at], "w": hub[at], "sim": 1.0, "link": True}))
            sims[~unmet] = -2
            sims[ids[:, None] == ids[None, :]] = -2
            m = min(int(g["k"].max()), len(g) - 1)
            best = np.argpartition(-sims, m - 1, axis=1)[:, :m]
            value = np.take_along_axis(sims, best, 1)
            r, c = np.nonzero(value > np.maximum(low, -1.5)[:, None])
            out.append(pd.DataFrame({"u": ids[r], "w": ids[best[r, c]], "sim": value[r, c], "link": False}))
            if len(out) > 200:
                yield pd.concat(out)
                out = []
        yield pd.concat(out) if out else pd.DataFrame({"u": [], "w": [], "sim": [], "link": []}).astype({"u": int, "w": int, "link": bool})

    return run


def _bits(n: int, bucket: int) -> int:
    return max(1, round(math.log2(max(2, n / bucket))))


def tables_for(n: int, threshold: float = THRESHOLD, bucket: int = BUCKET) -> int:
    """Tables that part a pair at the threshold everywhere with probability APART at most; grows with n."""
    together = (1 - math.acos(max(-1.0, min(threshold, 1.0))) / math.pi) ** _bits(n, bucket)
    return TABLES if together >= 1 else max(TABLES, math.ceil(math.log(APART) / math.log1p(-together)))


class NearestGraph:
    """nodes: (id, vec) -> neighbour lists (u, w, sim, fresh) and links found (a, b). Lists have k places, or as many as
    `room` (id, k) says."""

    room = None

    def __init__(self, nodes: DataFrame, n: int, dim: int, k=NEIGHBOURS, threshold=THRESHOLD, tables=None, bucket=BUCKET):
        self.nodes, self.n, self.dim, self.k, self.threshold, self.bucket = nodes, n, dim, k, threshold, bucket
        self.lists, self.inside, self.own, self.links, self.round, self.used = None, None, None, [], 0, 0
        self.seed(tables or tables_for(n, threshold, bucket))

    def seed(self, tables: int) -> None:
        """Joins the buckets of so many tables not used before, a few at a time."""
        end = self.used + tables
        while self.used < end:
            some = min(TABLES, end - self.used)
            self.join(self.buckets(self.used, some), around=False)
            self.used += some

    def buckets(self, first: int, tables: int) -> DataFrame:
        """(g1, g2, id, fresh): vectors on the same side of random planes, buckets beyond BLOCK split by a hash."""
        bits, dim = _bits(self.n, self.bucket), self.dim

        def run(batches):
            planes = [np.random.default_rng(1000 + t).standard_normal((dim, bits)) for t in range(first, first + tables)]
            for pdf in batches:
                x = _unit(pdf["vec"])
                for t, p in enumerate(planes):
                    yield pd.DataFrame({"g1": first + t, "side": (x @ p > 0) @ (1 << np.arange(bits)), "id": pdf["id"]})

        keys = durable(self.nodes.mapInPandas(run, "g1 long, side long, id long"))
        large = keys.groupBy("g1", "side").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")).where("parts > 1")
        parts = F.pmod(F.xxhash64("id", "g1"), F.coalesce("parts", F.lit(1)))
        return keys.join(durable(large), ["g1", "side"], "left").select("g1", (F.col("side") * 2**20 + parts).alias("g2"), "id", F.lit(True).alias("fresh"))

    def around(self) -> DataFrame:
        """(g1, g2, id, fresh): the neighbours of each vector, and all that it is a neighbour of.

        More than BLOCK of the latter are dealt to blocks by a hash anew each round, each with all the neighbours ahead; as
        they have not all met, they stay fresh. Blocks in which nothing is new are left out.
        """
        lists = self.lists if self.inside is None else self.lists.unionByName(self.inside)
        large = durable(lists.groupBy(F.col("w").alias("g2")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")).where("parts > 1"))
        parts = F.coalesce("parts", F.lit(1))
        ahead = lists.select(F.col("u").alias("g2"), F.col("w").alias("id"), "fresh").join(large, "g2", "left").select("g2", "id", "fresh", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        behind = lists.select(F.col("w").alias("g2"), F.col("u").alias("id"), "fresh").join(large, "g2", "left").select("g2", "id", (F.col("fresh") | (parts > 1)).alias("fresh"), F.pmod(F.xxhash64("id", F.lit(self.round)), parts).alias("part"))
        met = durable(ahead.unionByName(behind).groupBy("g2", "part", "id").agg(F.bool_or("fresh").alias("fresh")))
        awake = met.groupBy("g2", "part").agg(F.bool_or("fresh").alias("new"), F.count(F.lit(1)).alias("size")).where("new and size > 1").select("g2", "part")
        return met.join(awake, ["g2", "part"], "left_semi").select((-1 - F.col("part")).alias("g1"), "g2", "id", "fresh")

    def join(self, meetings: DataFrame, around: bool = True) -> int:
        """Compares all that meet and updates the lists; returns how many places changed.

        Only meetings around neighbours make entries of the lists old; after those in buckets, entries are as fresh as before.
        """
        nodes = self.nodes.withColumn("k", F.lit(self.k)) if self.room is None else self.nodes.join(self.room, "id", "left").withColumn("k", F.coalesce("k", F.lit(self.k)))
        if self.lists is None:
            nodes = nodes.withColumn("low", F.lit(-2.0))
        else:
            last = self.lists.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("held"), F.min("sim").alias("last"))
            nodes = nodes.join(last, "id", "left").withColumn("low", F.when(F.col("held") >= F.col("k"), F.col("last")).otherwise(-2.0))
        nodes = nodes.withColumn("component", F.col("id")) if self.own is None else nodes.join(self.own, "id", "left").withColumn("component", F.coalesce("component", "id"))
        members = meetings.join(nodes, "id").select("g1", "g2", "id", "fresh", "low", "k", "component", "vec")
        dealt = members.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "id")
        found = durable(dealt.mapInPandas(_compare(self.threshold), "u long, w long, sim double, link boolean"))
        self.links.append(found.where("link").select(F.col("u").alias("a"), F.col("w").alias("b")))
        better = found.where("not link").select("u", "w", "sim", F.lit(True).alias("fresh"))
        if self.lists is not None:
            better = better.unionByName(self.lists.withColumn("fresh", F.lit(False)) if around else self.lists)
        known = better.groupBy("u", "w").agg(F.max("sim").alias("sim"), F.bool_and("fresh").alias("fresh"))
        best = W.partitionBy("u").orderBy(F.desc("sim"), "w")
        ranked = known.withColumn("r", F.row_number().over(best))
        if self.room is None:
            ranked = ranked.where(F.col("r") <= self.k)
        else:
            ranked = ranked.join(self.room.withColumnRenamed("id", "u"), "u", "left").where(F.col("r") <= F.coalesce("k", F.lit(self.k))).drop("k")
        self.lists = stored(ranked.drop("r"))
        if around and self.inside is not None:
            self.inside = self.inside.withColumn("fresh", F.lit(False))
        self.round += 1
        return self.lists.where("fresh").count()

    def saturated(self) -> DataFrame:
        """(id, k): vectors whose list is full of links."""
        lists = self.lists.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("held"), F.min("sim").alias("last"))
        k = F.lit(self.k).alias("k")
        sized = lists.withColumn("k", k) if self.room is None else lists.join(self.room, "id", "left").withColumn("k", F.coalesce("k", k))
        return sized.where((F.col("held") >= F.col("k")) & (F.col("last") >= self.threshold)).select("id", "k")

    def enlarge(self) -> bool:
        """Gives saturated lists more places; their neighbours are to meet anew. False if there is none that may grow."""
        due = durable(self.saturated().where(F.col("k") < MOST_NEIGHBOURS).select("id", F.least(F.col("k") * ENLARGED, F.lit(MOST_NEIGHBOURS)).alias("k")))
        if due.isEmpty():
            return False
        self.room = stored(due if self.room is None else self.room.join(due.select("id"), "id", "left_anti").unionByName(due))
        self.lists = self.lists.join(due.select(F.col("id").alias("u"), F.lit(True).alias("again")), "u", "left").select("u", "w", "sim", F.coalesce("again", "fresh").alias("fresh"))
        return True

    def pairs(self) -> DataFrame:
        """(a, b): the links in lists, both ways."""
        lists = self.lists if self.inside is None else self.lists.unionByName(self.inside)
        links = lists.where(F.col("sim") >= self.threshold)
        return links.select(F.col("u").alias("a"), F.col("w").alias("b")).unionByName(links.select(F.col("w").alias("a"), F.col("u").alias("b"))).distinct()

    def leave(self, groups: DataFrame) -> None:
        """From now on lists of these vectors take only vectors outside their own vector's component.

        Neighbours inside keep leading the search (the best k, as they are now) but take no place in the list, so that a
        vector among many near ones finds those beyond them. All meet anew, since a full list took no note of others.
        """
        self.own = stored(groups.select(F.col("node").alias("id"), "component"))
        old = self.lists if self.inside is None else self.lists.unionByName(self.inside)
        ends = old.join(self.own.select(F.col("id").alias("u"), F.col("component").alias("cu")), "u", "left").join(self.own.select(F.col("id").alias("w"), F.col("component").alias("cw")), "w", "left")
        held = durable(ends.select("u", "w", "sim", F.lit(True).alias("fresh"), F.coalesce(F.col("cu") == F.col("cw"), F.lit(False)).alias("same")))
        best = W.partitionBy("u").orderBy(F.desc("sim"), "w")
        self.inside = stored(held.where("same").withColumn("r", F.row_number().over(best)).where(F.col("r") <= self.k).drop("r", "same"))
        self.lists = held.where("not same").drop("same")

    def refine(self) -> None:
        for _ in range(ROUNDS):
            if self.join(self.around()) < SETTLED * self.k * self.n:
                break

    def found(self) -> DataFrame:
        """(a, b): pairs that are linked, directly or through others."""
        out = self.links[0]
        for more in self.links[1:]:
            out = out.unionByName(more)
        lists = self.lists if self.inside is None else self.lists.unionByName(self.inside)
        return out.unionByName(lists.where(F.col("sim") >= self.threshold).select(F.col("u").alias("a"), F.col("w").alias("b")))


def _audit(nodes: DataFrame, n: int, groups: DataFrame, threshold: float, again: int = 0) -> DataFrame:
    """(a, b): all links of a sample, by comparing it with every vector.

    Half of the sample is drawn evenly from vectors, half evenly from components (vectors without links are their own), so
    that a large component does not crowd out the others. Draws are by a hash, anew for each audit.
    """
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    linked, classes = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    half = min(AUDIT * max(1.0, math.sqrt(n / 10_000)), MOST_AUDITED) / 2
    size = groups.join(sizes, "component").select(F.col("node").alias("id"), "size")
    rate = half / max(1, n) + half / max(1, n - linked + classes) / F.coalesce("size", F.lit(1))
    sample = nodes.join(size, "id", "left").where(uniform("audit", F.lit(again), F.col("id")) < rate).select("id", "vec").collect()
    if not sample:
        return nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    ids, x = np.array([r["id"] for r in sample], np.int64), _unit([r["vec"] for r in sample])

    def run(batches):
        for pdf in batches:
            y, to = _unit(pdf["vec"]), pdf["id"].to_numpy()
            for at in range(0, len(ids), 2048):
                r, c = np.nonzero(y @ x[at : at + 2048].T >= threshold)
                yield pd.DataFrame({"a": ids[at + c], "b": to[r]})

    return nodes.mapInPandas(run, "a long, b long").where("a <> b")


def _recall(truth: DataFrame, pairs: DataFrame, closed: DataFrame) -> tuple[float, float]:
    """Of audited links, the share found: the least of any vector, and over all. A link is found when a list holds it or
    both ends lie in one component of `closed` (node, component), whose links are all counted."""
    ends = truth.join(closed.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(closed.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    held = ends.join(pairs.withColumn("held", F.lit(1)), ["a", "b"], "left")
    got = F.count_if((F.col("ca") == F.col("cb")) | F.col("held").isNotNull())
    per = held.groupBy("a").agg(got.alias("got"), F.count(F.lit(1)).alias("n"))
    least, found, n = per.agg(F.min(F.col("got") / F.col("n")), F.sum("got"), F.sum("n")).first()
    return (1.0, 1.0) if least is None else (least, found / n)


def _complete(threshold: float):
    """(id, links, hub): exact links between two blocks of a component, as counts and stars."""

    def run(batches):
        out = []
        for (_, i, j), g in _grouped(batches, ["component", "i", "j"]):
            ids, copies, block = (g[c].to_numpy(np.int64) for c in ("id", "copies", "block"))
            x = _unit(g["vec"])
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            if i != j:
                near &= block[:, None] != block[None, :]
            links, hub = near @ copies, _hubs(near, ids)
            at = np.flatnonzero(links)
            out.append(pd.DataFrame({"id": ids[at], "links": links[at], "hub": hub[at]}))
            if len(out) > 200:
                yield pd.concat(out)
                out = []
        yield pd.concat(out) if out else pd.DataFrame({"id": [], "links": [], "hub": []})

    return run


def outside(graph: NearestGraph) -> DataFrame:
    """Components of links, once lists are enlarged and those that stay full were searched from outside of their component
    until none are joined any more. graph.own is then the components whose lists stay full."""
    while graph.enlarge():
        graph.seed(TABLES)
        graph.refine()
    groups = components(graph.found())
    while True:
        full = graph.saturated().where(F.col("k") >= MOST_NEIGHBOURS).select(F.col("id").alias("node"))
        if graph.own is not None:
            full = full.unionByName(graph.own.select(F.col("id").alias("node")))
        closed = durable(groups.join(groups.join(full, "node").select("component").distinct(), "component", "left_semi").select("node", "component"))
        if closed.isEmpty():
            return groups
        graph.leave(closed)
        graph.seed(TABLES)
        graph.refine()
        known, groups = groups, durable(components(graph.found()))
        if not _grown(known, groups):
            return groups


def _grown(known: DataFrame, groups: DataFrame) -> bool:
    """Whether a component of more than one vector was joined to another such."""
    parts = known.join(groups.withColumnRenamed("component", "now"), "node").groupBy("now").agg(F.count_distinct("component").alias("parts"))
    return bool(parts.where("parts > 1").limit(1).count())


@tidy
def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept, audit_recall.

    Links are pairs of rows whose cosine, in double precision, is threshold or more. n_links: rows linked directly;
    component_id: the smallest vec_id reachable by links, its own included; kept: vec_id = component_id. audit_recall: the
    share of the last audit's links that the graph had found (1 where all vectors were compared with all, or none is linked).
    Null or zero vectors and those with null or non-finite components link with nothing. Vectors shorter than the longest
    are taken as padded with zeros. Repeated rows and equal vectors are one node with a multiplicity, and linked. Ids are of
    any type that can be ordered; null ones come after all others. Empty table: no rows. Rows are numbered once, and stored.
    """
    spark = vectors.sparkSession
    ship(spark)
    vec = F.col(vector_col).cast("array<double>")
    fine = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("vec_id"), F.when(fine, F.col(vector_col)).alias("vec"))
    rows = durable(rows.withColumn("h1", F.when(F.col("vec").isNotNull(), F.xxhash64("vec"))).withColumn("h2", F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit(1), "vec"))))
    own = durable(rows.select("rid", "vec_id", "h1", "h2"), keep=True)
    ident = F.struct(F.col("vec_id").isNull().alias("no"), F.col("vec_id").alias("v"))
    equal = durable(own.where("h1 is not null").groupBy("h1", "h2").agg(F.min("rid").alias("id"), F.min(ident).alias("first"), F.count(F.lit(1)).alias("copies")))
    n, dim = equal.count(), rows.agg(F.max(F.size("vec"))).first()[0] or 0
    padded = F.concat("vec", F.array_repeat(F.lit(0).cast(vectors.schema[vector_col].dataType.elementType), F.lit(dim) - F.size("vec")))
    nodes = durable(rows.select(F.col("rid").alias("id"), padded.alias("vec")).join(equal.select("id"), "id", "left_semi"))
    recall = 1.0
    if n > 1:
        graph = NearestGraph(nodes, n, dim, k, threshold)
        known, block, none = None, BLOCK, spark.createDataFrame([], "node long, component long")
        for again in range(RESUMED + 1):
            graph.refine()
            groups = outside(graph)
            closed = none if graph.own is None else graph.own.withColumnRenamed("id", "node").drop("component").join(groups, "node")
            pairs = durable(graph.pairs())
            truth = durable(_audit(nodes, n, groups, threshold, again))
            known = truth if known is None else known.unionByName(truth)
            least, recall = _recall(known, pairs, closed)
            if least >= RECALL:
                pairs = pairs.unionByName(known).unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
                groups = durable(components(graph.found().unionByName(pairs)))
                break
            if again < RESUMED:
                graph.seed(tables_for(n, threshold))
        else:  # the graph stays below the target: all vectors against all, as one component
            groups, block, recall = nodes.select(F.col("id").alias("node"), F.lit(0).cast("long").alias("component")), ALL_BLOCK, 1.0
            closed, pairs = groups, pairs.limit(0)
        # components of which some list stays full are counted block against block, the others from their lists
        due = durable(groups.join(closed.select("node").join(groups, "node").select("component").distinct(), "component", "left_semi").select("node", "component"))
        sizes = durable(due.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")))
        met = due.withColumnRenamed("node", "id").join(sizes, "component").join(equal.select("id", "copies"), "id").join(nodes, "id")
        met = met.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        met = met.select("component", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "id", "copies", "block", "vec")
        done = durable(met.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInPandas(_complete(threshold), "id long, links long, hub long"))
        listed = pairs.join(due.select(F.col("node").alias("a")), "a", "left_anti").join(equal.select(F.col("id").alias("b"), "copies"), "b")
        links = done.select("id", "links").unionByName(listed.select(F.col("a").alias("id"), F.col("copies").alias("links"))).groupBy("id").agg(F.sum("links").alias("links"))
        reached = done.select(F.col("id").alias("a"), F.col("hub").alias("b"))
        classes = components(reached if block == ALL_BLOCK else reached.unionByName(pairs)).withColumnRenamed("node", "id")
        equal = equal.join(links, "id", "left").join(classes, "id", "left")
    else:
        equal = equal.withColumn("links", F.lit(0)).withColumn("component", F.lit(None).cast("long"))
    whole = durable(equal.select("h1", "h2", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "id").alias("class")))
    least = durable(whole.groupBy("class").agg(F.min("first").alias("top")))
    named = durable(whole.join(least, "class").select("h1", "h2", "n_links", F.col("top.v").alias("component_id")), keep=True)
    linked = own.where("h1 is not null").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = own.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(recall).alias("audit_recall"))
