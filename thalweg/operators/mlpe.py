"""Maximum-likelihood population effects: regression of a pairwise response with correlated errors, as grouped sums.

Pairs that share a population have errors of correlation rho^2. With every pair of n populations present once, the
inverse and determinant of that correlation have a closed form in which only sums over pairs and over populations occur;
with pairs missing they follow from the eigenvalues of a matrix of populations.
So a model costs two aggregates, thousands of models go through one job, and rho is found on a grid, then zoomed in on.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import stored

RHO_LOW, RHO_HIGH = 0.0001, 0.4999


#: Populations of an incomplete set of pairs: their n x n matrix is factorised in one task, so n is bounded.
MOST_POPULATIONS = 3_000


def whole_sums(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs: (keys..., pop1, pop2, x, y) -> one row per key: m pairs, mean and deviation of x, sums of y, y y, x y."""
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("m"), F.avg("x").alias("mx"), F.stddev_pop("x").alias("sx"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(F.col("x") * F.col("y")).alias("xy0")
    )


def population_sums(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., pop, x, y, degree): for each population the sums over its pairs, and their number."""
    ends = pairs.select(*keys, "x", "y", F.explode(F.array("pop1", "pop2")).alias("pop"))
    return ends.groupBy(*keys, "pop").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.count(F.lit(1)).cast("double").alias("degree"))


def sufficient(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs: (keys..., pop1, pop2, x, y) -> one row per key with n, m and the raw sums that the likelihood needs, and whether
    each two of the n populations have a pair (`complete`)."""
    return _with_populations(whole_sums(pairs, keys), population_sums(pairs, keys), keys)


def _with_populations(whole: DataFrame, per: DataFrame, keys: list[str]) -> DataFrame:
    pops = per.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.min("degree").alias("least"), F.max("degree").alias("most"),
        F.sum("x").alias("p1x"), F.sum("y").alias("p1y"), F.sum(F.col("x") * F.col("x")).alias("pxx0"), F.sum(F.col("x") * F.col("y")).alias("pxy0"), F.sum(F.col("y") * F.col("y")).alias("pyy"),
    )
    return whole.join(pops, keys).withColumn("complete", (F.col("least") == F.col("n") - 1) & (F.col("most") == F.col("n") - 1)).drop("least", "most")


def sums_of_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """sufficient() from sums over parts of each key's pairs: (keys..., pop, m, x, y, xx, yy, xy), for each part a row for each
    of its populations with the number of its pairs and the sums of x and y, and one without a population with the sums over
    the part's pairs, xx being that of squared deviations from the part's mean."""
    c = F.col
    of_pairs = parts.where("pop is null").select(*keys, "m", "x", "y", "xx", "yy", "xy")
    whole = of_pairs.groupBy(*keys).agg(F.sum("m").alias("m"), (F.sum("x") / F.sum("m")).alias("mx"), F.sum("y").alias("y"), F.sum("yy").alias("yy"), F.sum("xy").alias("xy0"))
    gap = c("x") / c("m") - c("mx")
    spread = of_pairs.join(whole.select(*keys, "mx"), keys).groupBy(*keys).agg(F.sqrt(F.sum(c("xx") + c("m") * gap * gap) / F.sum("m")).alias("sx"))
    pops = parts.where("pop is not null").groupBy(*keys, "pop").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("m").alias("degree"))
    return _with_populations(whole.join(spread, keys), pops, keys)


def standardised(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Raw sums over all pairs -> those with x standardised (population deviation) within its key."""
    d = F.col("n") - 1  # pairs of each population
    z = lambda c: F.try_divide(c, F.col("sx"))
    return sums.select(
        *keys, "n", "m", "y", "yy", F.col("m").alias("xx"), z(F.col("xy0") - F.col("mx") * F.col("y")).alias("xy"),
        (d * d * F.col("n")).alias("p11"), F.lit(0.0).alias("p1x"), (d * F.col("p1y")).alias("p1y"),
        z(z(F.col("pxx0") - 2 * d * F.col("mx") * F.col("p1x") + d * d * F.col("mx") * F.col("mx") * F.col("n"))).alias("pxx"),
        z(F.col("pxy0") - d * F.col("mx") * F.col("p1y")).alias("pxy"), "pyy",
    )


def likelihood(df: DataFrame) -> DataFrame:
    """Adds loglik, loglik_null, slope and mse of the generalised least squares fits, with x and without, at the column rho.

    Built in steps, so that the optimiser keeps shared terms as columns. x is standardised: its cross terms with the
    intercept vanish.
    """
    c = F.col

    def product(uv, per_population, su, sv):
        # sums over populations of sums over pairs count each pair twice, hence the 4
        return (uv - c("_b") * (per_population / c("_own") - c("_b") * su * sv * 4 / (c("_own") * c("_total")))) / c("_a")

    zero, n, m = F.lit(0.0), c("n"), c("m")
    out = df.withColumn("_b", c("rho") * c("rho"))
    out = out.withColumns({"_a": 1 - 2 * c("_b"), "_own": 1 - 2 * c("_b") + c("_b") * (n - 2), "_total": 1 - 2 * c("_b") + c("_b") * (2 * n - 2)})
    out = out.withColumns(
        {
            "_11": product(m, c("p11"), m, m), "_xx": product(c("xx"), c("pxx"), zero, zero), "_1y": product(c("y"), c("p1y"), m, c("y")),
            "_xy": product(c("xy"), c("pxy"), zero, c("y")), "_yy": product(c("yy"), c("pyy"), c("y"), c("y")),
            "_det": F.ln("_total") + (n - 1) * F.ln("_own") + (m - n) * F.ln("_a"),
        }
    )
    out = out.withColumns({"_ssr0": c("_yy") - c("_1y") * c("_1y") / c("_11"), "slope": F.try_divide(c("_xy"), c("_xx"))})
    out = out.withColumn("_ssr", c("_ssr0") - c("slope") * c("_xy"))
    out = _logliks(out, m, c("_ssr"), c("_ssr0"), c("_det"))
    return out.drop(*[x for x in out.columns if x.startswith("_")])


def _logliks(out: DataFrame, m, ssr, ssr0, logdet) -> DataFrame:
    at = lambda ssr: -m / 2 * F.ln(ssr) - m / 2 * (1 + F.ln(math.pi / (m / 2))) - logdet / 2
    return out.withColumns({"loglik": at(ssr), "loglik_null": at(ssr0), "mse": ssr / (m - 2)})


def _search(sums: DataFrame, keys: list[str], scored, grid: int, zooms: int) -> DataFrame:
    """sums: one row per key -> that row with the rho of the largest likelihood and what scored() adds at it."""
    names = [x for x in sums.columns if x not in keys]
    step = (RHO_HIGH - RHO_LOW) / (grid - 1)
    here = sums.withColumn("rho", F.explode(F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: RHO_LOW + i * step)))
    for zoom in range(zooms + 1):
        best = scored(here).groupBy(*keys).agg(*[F.first(x).alias(x) for x in names], F.max_by("rho", F.struct("loglik", -F.col("rho"))).alias("rho"))
        if zoom == zooms:
            break
        low, high = F.greatest(F.col("rho") - step, F.lit(RHO_LOW)), F.least(F.col("rho") + step, F.lit(RHO_HIGH))
        here = best.select(*keys, *names, F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: low + i * (high - low) / 20)).alias("rho"))
        step = 2 * step / 20
    return scored(best)


def _metrics(out: DataFrame, keys: list[str]) -> DataFrame:
    aic, aic_null = -2 * F.col("loglik") + 4, -2 * F.col("loglik_null") + 2
    r2m = F.col("slope") * F.col("slope") / (F.col("slope") * F.col("slope") + F.col("mse"))
    return out.select(*keys, "rho", "loglik", r2m.alias("r2m"), (-aic).alias("aic"), (aic_null - aic).alias("delta_aic_null"), (-aic_null).alias("aic_null"))


def fit_sums(sums: DataFrame, keys: list[str], grid: int = 51, zooms: int = 3) -> DataFrame:
    """fit() from the raw sums of complete sets of pairs."""
    return _metrics(_search(standardised(sums, keys).where("n >= 3"), keys, likelihood, grid, zooms), keys)


def fit(pairs: DataFrame, keys: list[str], grid: int = 51, zooms: int = 3) -> DataFrame:
    """pairs: (keys..., pop1, pop2, x, y), each two populations at most once -> keys, rho, loglik, r2m, aic, delta_aic_null,
    aic_null.

    rho maximises the likelihood with x over a grid of [0.0001, 0.4999], both bounds included, zoomed in `zooms` times
    between the neighbours of the best point. The null fit uses the same rho. aic and aic_null are negated (larger is
    better), delta_aic_null is the plain difference null - model. Fewer than 3 populations, a constant x or an exact fit:
    nulls.

    Pairs without x or y are left out. Where a key then has a pair for each two of its populations the closed form is used;
    else fit_incomplete().
    """
    pairs = pairs.where("x is not null and y is not null")
    return fit_either(stored(sufficient(pairs, keys), "mlpe-sums"), lambda: pairs, keys, grid, zooms)


def fit_either(sums: DataFrame, pairs, keys: list[str], grid: int = 51, zooms: int = 3) -> DataFrame:
    """fit() from sufficient(); pairs() gives the pairs with x and y, asked for if a key lacks some."""
    whole = fit_sums(sums.where("complete").drop("complete"), keys, grid, zooms)
    partly = sums.where("not complete").select(*keys, "n")
    if partly.isEmpty():
        return whole
    return whole.unionByName(fit_incomplete(pairs().join(partly.select(*keys), keys, "left_semi"), keys, grid, zooms))


def spectra(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs -> (keys..., value, q1, qx, qy): for each key the eigenvalues of the matrix G that has each population's number
    of pairs on its diagonal and 1 where two populations have a pair, and the parts along its eigenvectors of the populations'
    numbers of pairs and sums of x and y.

    By Woodbury's identity the inverse and determinant of the errors' correlation at any rho follow from these. G depends on
    which pairs there are, not on the model: keys with the same pairs, found by a digest, share one factorisation, made in
    one task from their list of pairs; at most MOST_POPULATIONS populations.
    """
    two = F.least("pop1", "pop2").alias("a"), F.greatest("pop1", "pop2").alias("b")
    digest = [F.bit_xor(F.xxhash64(F.lit(k), *two)).alias(f"d{k}") for k in (0, 1)]
    which = stored(pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("d2"), *digest), "mlpe-patterns")
    by = ["d0", "d1", "d2"]
    one = which.groupBy(*by).agg(F.min(F.struct(*keys)).alias("one")).select(*by, "one.*")

    def factorised(pdf: pd.DataFrame) -> pd.DataFrame:
        pops, at = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
        i, j = at.reshape(-1, 2).T
        g = np.zeros((len(pops), len(pops)))
        np.add.at(g, (np.concatenate([i, j, i, j]), np.concatenate([i, j, j, i])), 1.0)
        values, vectors = np.linalg.eigh(g)
        out = pd.DataFrame({"value": values, "vector": list(vectors.T)})
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out

    ship(pairs.sparkSession)
    listed = pairs.join(one, keys).select(*by, *two)
    g = stored(listed.groupBy(*by).applyInPandas(factorised, "value double, vector array<double>, d0 long, d1 long, d2 long"), "mlpe-spectra")
    per = population_sums(pairs, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pop", "degree", "x", "y"))).alias("pops"))
    along = lambda c: F.aggregate(F.zip_with("vector", "pops", lambda v, p: v * p[c]), F.lit(0.0), lambda a, x: a + x)
    return stored(per.join(which, keys).join(g, by).select(*keys, "value", along("degree").alias("q1"), along("x").alias("qx"), along("y").alias("qy")), "mlpe-parts")


def fit_incomplete(pairs: DataFrame, keys: list[str], grid: int = 51, zooms: int = 3) -> DataFrame:
    """fit() where some populations have no pair with each other.

    The correlation's inverse and determinant take n x n matrices of populations in place of m x m ones of pairs, see
    spectra(); x no longer is at right angles to the intercept, so both coefficients are solved for.
    """
    n = population_sums(pairs, keys).groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = stored(whole_sums(pairs, keys).join(n, keys).where("n >= 3"), "mlpe-sums")
    most = sums.agg(F.max("n")).first()[0]
    if most is not None and most > MOST_POPULATIONS:
        raise ValueError(f"an incomplete set of pairs has at most {MOST_POPULATIONS} populations, not {most:.0f}")
    parts = spectra(pairs, keys)
    c = F.col
    qx = F.try_divide(c("qx") - c("mx") * c("q1"), c("sx"))
    of = {"1": c("q1"), "x": qx, "y": c("qy")}

    def scored(here: DataFrame) -> DataFrame:
        b = c("rho") * c("rho")
        a = 1 - 2 * b
        at = a + b * c("value")
        totals = [F.sum(of[u] * of[v] / at).alias(f"_p{u}{v}") for u, v in ("11", "1x", "xx", "1y", "xy", "yy")]
        per = here.join(parts, keys).groupBy(*here.columns).agg(F.sum(F.ln(at)).alias("_ln"), *totals)
        plain = {"11": c("m"), "1x": F.lit(0.0), "xx": c("m"), "1y": c("y"), "xy": F.try_divide(c("xy0") - c("mx") * c("y"), c("sx")), "yy": c("yy")}
        out = per.withColumns({f"_{uv}": (v - b * c(f"_p{uv}")) / a for uv, v in plain.items()}).withColumn("_det", (c("m") - c("n")) * F.ln(a) + c("_ln"))
        out = out.withColumn("_two", c("_11") * c("_xx") - c("_1x") * c("_1x"))
        out = out.withColumns({"slope": F.try_divide(c("_11") * c("_xy") - c("_1x") * c("_1y"), c("_two")), "_base": F.try_divide(c("_xx") * c("_1y") - c("_1x") * c("_xy"), c("_two"))})
        out = _logliks(out, c("m"), c("_yy") - c("_base") * c("_1y") - c("slope") * c("_xy"), c("_yy") - c("_1y") * c("_1y") / c("_11"), c("_det"))
        return out.drop(*[x for x in out.columns if x.startswith("_")])

    return _metrics(_search(sums, keys, scored, grid, zooms), keys)
