"""Model search: univariate grid, tree-structured Parzen estimators, genetic algorithm. Candidates are drawn on the driver,
whole batches are evaluated as one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inference import best_per_variable

TRANSFORMS = 9
Evaluate = Callable[[DataFrame], DataFrame]
SCHEMA = "model_id long, var string, sel int, weight double, transform int, shape double"


def univariate_models(spark: SparkSession, variables: list[str], max_shape: int = 100) -> DataFrame:
    """Each variable alone, with every transform and shape."""
    grid = spark.createDataFrame([(k, v) for k, v in enumerate(variables)], "__k long, var string")
    grid = grid.withColumn("transform", F.explode(F.sequence(F.lit(0), F.lit(TRANSFORMS - 1)))).withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(max_shape))))
    number = (F.col("__k") * TRANSFORMS + F.col("transform")) * max_shape + F.col("s") - 1
    return grid.select(number.alias("model_id"), "var", F.lit(1).alias("sel"), F.lit(1.0).alias("weight"), "transform", F.col("s").cast("double").alias("shape"))


def univariate_grid(spark: SparkSession, variables: list[str], evaluate: Evaluate, max_shape: int = 100) -> tuple[DataFrame, DataFrame]:
    """All fits, and the best curve of each variable (to be fixed in a later search)."""
    models = univariate_models(spark, variables, max_shape)
    fits = models.select("model_id", F.col("var").alias("variable"), "transform", "shape").join(evaluate(models), "model_id")
    return fits, best_per_variable(fits)


@dataclass
class Space:
    """What a search may choose, per variable; `fixed` maps a variable to sel, weight, transform or shape held."""

    variables: list[str]
    max_shape: int = 100
    min_weight: float = 0.0
    fix_weight: bool = False
    fix_shape: bool = False
    fixed: dict[str, dict[str, float]] = field(default_factory=dict)

    def draw(self, rng: np.random.Generator) -> dict[str, float]:
        x = {}
        for v in self.variables:
            x |= {f"{v}.sel": float(rng.integers(2)), f"{v}.weight": 1.0 if self.fix_weight else float(rng.uniform(self.min_weight, 1)), f"{v}.transform": float(rng.integers(TRANSFORMS)), f"{v}.shape": float(rng.integers(1, self.max_shape + 1))}
        return self.settle(x)

    def settle(self, x: dict[str, float]) -> dict[str, float]:
        for v in self.variables:
            if self.fix_shape:
                x[f"{v}.transform"] = x[f"{v}.shape"] = 0.0
            for name, value in self.fixed.get(v, {}).items():
                x[f"{v}.{name}"] = float(value)
        return x

    def kinds(self) -> dict[str, tuple]:
        """Of each parameter: ("choice", n) or ("range", low, high, whole)."""
        out = {}
        for v in self.variables:
            out |= {f"{v}.sel": ("choice", 2), f"{v}.weight": ("range", self.min_weight, 1.0, False), f"{v}.transform": ("choice", TRANSFORMS), f"{v}.shape": ("range", 1.0, float(self.max_shape), True)}
        return out


def frame(spark: SparkSession, points: list[dict[str, float]], variables: list[str], first: int = 0) -> DataFrame:
    rows = [(first + k, v, int(p[f"{v}.sel"]), float(p[f"{v}.weight"]), int(p[f"{v}.transform"]), float(round(p[f"{v}.shape"]))) for k, p in enumerate(points) for v in variables]
    return spark.createDataFrame(rows, SCHEMA)


def _suggest(rng, space: Space, seen: list[tuple[float, dict]], n_startup: int, candidates: int, gamma: float, prior: float) -> dict[str, float]:
    """One point by the tree-structured Parzen estimator (Bergstra et al., 2011): for each parameter the candidate with the
    largest ratio of the density among good trials to that among the others."""
    if len(seen) < n_startup:
        return space.draw(rng)
    done = sorted(seen, key=lambda s: s[0])
    cut = max(1, min(int(np.ceil(gamma * np.sqrt(len(done)))), 25))
    good, rest, x = [p for _, p in done[:cut]], [p for _, p in done[cut:]], {}
    for name, kind in space.kinds().items():
        below, above = (np.array([p[name] for p in group]) for group in (good, rest))
        if kind[0] == "choice":
            share = lambda v, n=kind[1]: (np.bincount(v.astype(int), minlength=n) + prior) / (len(v) + prior * n)
            p, q = share(below), share(above)
            drawn = rng.choice(kind[1], candidates, p=p / p.sum())
            x[name] = float(drawn[np.argmax(p[drawn] / q[drawn])])
            continue
        low, high, whole = kind[1:]
        if high <= low:
            x[name] = low
            continue

        def mixture(v, low=low, high=high):
            centres = np.sort(np.append(v, (low + high) / 2))
            gaps = np.diff(np.concatenate(([low], centres, [high])))
            widths = np.clip(np.maximum(gaps[:-1], gaps[1:]), (high - low) / min(100, 1 + len(centres)), high - low)
            weights = np.where(centres == (low + high) / 2, prior, 1.0)
            return centres, widths, weights / weights.sum()

        def density(at, centres, widths, weights):
            return (weights * np.exp(-0.5 * ((at[:, None] - centres) / widths) ** 2) / widths).sum(1)

        b, a = mixture(below), mixture(above)
        pick = rng.choice(len(b[0]), candidates, p=b[2])
        drawn = np.clip(rng.normal(b[0][pick], b[1][pick]), low, high)
        drawn = np.round(drawn) if whole else drawn
        x[name] = float(drawn[np.argmax(density(drawn, *b) / (density(drawn, *a) + 1e-12))])
    return space.settle(x)


def tpe(spark: SparkSession, space: Space, evaluate: Evaluate, chains: int = 10, max_iter: int = 500, n_fail: int = 50, n_startup: int = 20, candidates: int = 48, gamma: float = 0.15, prior: float = 0.7, seed: int = 0) -> DataFrame:
    """Independent chains, a point each per round, all evaluated in one job; stops after n_fail rounds without a better
    global best. Returns every trial: (chain, tid, loss, metrics, and per variable v, v_weight, v_trans, v_shape).

    The driver holds the trials' parameters only (chains x rounds).
    """
    rngs = [np.random.default_rng((seed, c)) for c in range(chains)]
    seen: list[list[tuple[float, dict]]] = [[] for _ in range(chains)]
    rows, best, stalled, columns = [], np.inf, 0, ["fitness", "rho", "loglik", "r2m", "aic", "delta_aic_null"]
    for it in range(max_iter):
        points = [_suggest(rngs[c], space, seen[c], n_startup, candidates, gamma, prior) for c in range(chains)]
        got = {r["model_id"]: r for r in evaluate(frame(spark, points, space.variables)).collect()}
        before = best
        for c, p in enumerate(points):
            loss = -float(got[c]["fitness"])
            seen[c].append((loss, p))
            best = min(best, loss)
            metrics = [got[c][k] for k in columns]
            rows.append((c, it, loss, *[None if m is None else float(m) for m in metrics], *[x for v in space.variables for x in (int(p[f"{v}.sel"]), float(p[f"{v}.weight"]), int(p[f"{v}.transform"]), float(p[f"{v}.shape"]))]))
        stalled = 0 if best < before else stalled + 1
        if stalled >= n_fail:
            break
    parts = [f"`{v}` int, `{v}_weight` double, `{v}_trans` int, `{v}_shape` double" for v in space.variables]
    return spark.createDataFrame(rows, "chain long, tid long, loss double, " + ", ".join(f"{c} double" for c in columns) + ", " + ", ".join(parts))


def genetic(spark: SparkSession, space: Space, evaluate: Evaluate, population: int = 40, generations: int = 20, mutation: float = 0.2, crossover: float = 0.5, tournament: int = 3, n_fail: int = 5, seed: int = 0) -> tuple[DataFrame, dict[str, float]]:
    """Tournament selection, two-point crossover, mutation trait by trait. Returns (generation, model_id, fitness) of all
    individuals and the best point."""
    rng, names = np.random.default_rng(seed), list(space.kinds())
    pop, log, best, stalled = [space.draw(rng) for _ in range(population)], [], (-np.inf, {}), 0
    for g in range(generations):
        got = {r["model_id"]: float(r["fitness"]) for r in evaluate(frame(spark, pop, space.variables)).collect()}
        fit = [got[k] for k in range(len(pop))]
        log += [(g, k, f) for k, f in enumerate(fit)]
        top = int(np.argmax(fit))
        stalled = 0 if fit[top] > best[0] else stalled + 1
        if fit[top] > best[0]:
            best = (fit[top], dict(pop[top]))
        if stalled >= n_fail:
            break
        parents = [pop[max(rng.integers(0, len(pop), tournament), key=lambda k: fit[k])] for _ in pop]
        pop = []
        for a, b in zip(parents, parents[1:] + parents[:1]):
            child = dict(a)
            if rng.random() < crossover:
                i, j = sorted(rng.integers(0, len(names) + 1, 2))
                child |= {n: b[n] for n in names[i:j]}
            fresh = space.draw(rng)
            child |= {n: fresh[n] for n in names if rng.random() < mutation}
            pop.append(space.settle(child))
    return spark.createDataFrame(log, "generation long, model_id long, fitness double"), best[1]


def sweep(spark: SparkSession, space: Space, evaluate: Evaluate, settings: list[dict], replicates: int = 2, **fixed) -> DataFrame:
    """The best loss of a search under each setting, (setting, replicate, loss), for loss_summary()."""
    rows = []
    for k, setting in enumerate(settings):
        for r in range(replicates):
            rows.append((k, r, tpe(spark, space, evaluate, seed=r, **(fixed | setting)).agg(F.min("loss")).first()[0]))
    return spark.createDataFrame(rows, "setting long, replicate long, loss double")
