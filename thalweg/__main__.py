"""python -m thalweg optimise | ensemble | simulate: searches, ensembles and simulations on tables in files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import cleaning, inference, surface
from .plans import ensemble, search, simulate
from .plans.network import Network
from .sources import sinks, tables


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="thalweg", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, points: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("--network", required=True, help="edges: Parquet, TSV or .shp")
        p.add_argument("--out", required=True, help="prefix of the output folders")
        p.add_argument("--seed", type=int, default=0)
        if points:
            p.add_argument("--coords", required=True)
            p.add_argument("--vars", help="comma list or file")
            p.add_argument("--varfile", help="file of variable and aggregator")
            p.add_argument("--edge-agg", default="ARITH")
            p.add_argument("--awsum", type=float, default=0.95 if name == "ensemble" else 1.0, help="cumulative Akaike weight that is kept")
            p.add_argument("--only-keep", action="store_true")
        return p

    p = command("optimise")
    p.add_argument("--inmat", required=True, help="labelled response matrix")
    p.add_argument("--pop-agg", default="ARITH")
    p.add_argument("--fitmetric", default="loglik", choices=sorted(inference.METRICS))
    p.add_argument("--labels", default="aligned", choices=["aligned", "reference"])
    p.add_argument("--weight", default="inverse", choices=["inverse", "length"])
    p.add_argument("--max-iter", type=int, default=500)
    p.add_argument("--nfail", type=int, default=50)
    p.add_argument("--reps", type=int, default=10)
    p.add_argument("--nstart", type=int, default=20)
    p.add_argument("--ncand", type=int, default=48)
    p.add_argument("--gamma", type=float, default=0.15)
    p.add_argument("--pweight", type=float, default=0.7)
    p.add_argument("--max-shape", type=int, default=100)
    p.add_argument("--min-weight", type=float, default=0.0)
    p.add_argument("--fix-weight", action="store_true")
    p.add_argument("--fix-shape", action="store_true")
    p.add_argument("--trans-file", help="fixed curves")
    p.add_argument("--grid", action="store_true", help="fix each variable's curve by a univariate grid first")
    p.add_argument("--max-hof-size", type=int, default=100)
    p.add_argument("--sizes", help="population sizes: fits are those of Markov chains between sites")
    p.add_argument("--asymmetric", default="", help="comma list of variables that tell moves up from moves down, with --sizes")
    p = command("ensemble")
    p.add_argument("--runs", required=True, help="prefix of .HallOfFame.tsv files")
    p.add_argument("--only-best", action="store_true")
    p.add_argument("--max-keep", type=int)
    p = command("simulate", points=False)
    p.add_argument("--spec", required=True)
    p.add_argument("--reps", type=int, default=1)
    p.add_argument("--samples", type=int, default=10)
    return top


def _variables(args) -> list[str]:
    if not (args.vars or args.varfile):
        raise SystemExit("--vars or --varfile is needed")
    return tables.read_variables(args.varfile or args.vars)


def report(net: Network, ranked, variables: list[str], out: str, only_keep: bool) -> None:
    sinks.write_models(ranked, f"{out}.HallOfFame.tsv")
    sinks.write_tsv(inference.variable_importance(ranked, variables, only_keep).orderBy(F.desc("RVI")), f"{out}.varImportance.tsv")
    sinks.write_tsv(inference.averaged_weights(ranked, variables, only_kept=only_keep).orderBy(F.desc("MAW")), f"{out}.modavgWeights.tsv")
    sinks.write_tsv(inference.best_model(ranked, variables), f"{out}.bestModel.tsv")
    sinks.write_tsv(net.points, f"{out}.pointsTable.txt")
    sinks.write_tsv(net.snap_distances, f"{out}.snapDistances.txt")
    edges, pairs = ensemble.model_average(ranked, variables, surface.long_predictors(net.predictors), net.paths)
    labels = [r["label"] for r in net.points.orderBy("pt_idx").collect()]
    sinks.write_tsv(sinks.edge_resistances(edges), f"{out}.Model-Average.ResistanceEdges.tsv")
    sinks.write_tsv(sinks.matrix(surface.symmetric(pairs, net.points), labels), f"{out}.Model-Average.ResistanceMatrix.tsv")


def _fitting(spark: SparkSession, net: Network, args):
    """What evaluates candidates: path resistances, or with sizes the passage of Markov chains."""
    if not args.sizes:
        return lambda models: net.evaluate(models, args.fitmetric)
    chain, directed = net.chain(tables.read_sizes(spark, args.sizes)), [v for v in args.asymmetric.split(",") if v]
    long = surface.long_predictors(net.predictors)
    return lambda models: chain.evaluate(models.withColumn("asymmetric", F.col("var").isin(directed) if directed else F.lit(False)), long, args.fitmetric)


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("thalweg").getOrCreate()
    nodes, edges = tables.read_network(spark, args.network)
    if args.command == "simulate":
        coords, matrices = simulate.simulate(nodes, edges, tables.read_simulation(spark, args.spec), args.samples, args.reps, args.seed)
        sinks.write_tsv(coords, f"{args.out}.coords")
        for r in range(1, args.reps + 1):
            labels = [f"s{k + 1}" for k in range(args.samples)]
            sinks.write_tsv(sinks.matrix(matrices.where(F.col("replicate") == r), labels), f"{args.out}_{r}.ResistanceMatrix.tsv")
        return
    variables = _variables(args)
    methods = tables.read_methods(spark, variables, args.varfile, args.edge_agg)
    samples = tables.read_points(spark, args.coords)
    if args.command == "ensemble":
        net = Network(nodes, edges, ensemble.distinct_coordinates(samples), methods)
        ranked = ensemble.combine(ensemble.read_runs(spark, args.runs, args.only_best), args.only_keep, args.max_keep, args.awsum)
        report(net, ranked, variables, args.out, args.only_keep)
        return
    net = Network(nodes, edges, samples, methods, tables.read_matrix(spark, args.inmat), args.weight, args.labels, args.pop_agg)
    fit = _fitting(spark, net, args)
    fixed = tables.read_fixed(spark, args.trans_file) if args.trans_file else {}
    if args.grid:
        fits, best = search.univariate_grid(spark, variables, fit, args.max_shape)
        sinks.write_tsv(fits, f"{args.out}.univariateFitness.tsv")
        sinks.write_tsv(best.select("variable", "shape", "transform"), f"{args.out}.fixedParams.tsv")
        fixed |= {r["variable"]: {"transform": r["transform"], "shape": r["shape"]} for r in best.collect()}
    space = search.Space(variables, args.max_shape, args.min_weight, args.fix_weight, args.fix_shape, fixed)
    trials = search.tpe(spark, space, fit, args.reps, args.max_iter, args.nfail, args.nstart, args.ncand, args.gamma, args.pweight, args.seed)
    sinks.write_tsv(inference.generation_log(trials.withColumnRenamed("tid", "generation")).orderBy("generation"), f"{args.out}.FitnessLog.tsv")
    chosen = inference.best_per_chain(trials).withColumn("model_id", F.col("chain")).withColumn("aic", -F.col("aic")).drop("chain", "tid", "loss", "rho")
    ranked = inference.ranked(cleaning.finite_fitness(chosen), args.awsum, args.max_hof_size)
    report(net, ranked, variables, args.out, args.only_keep)
    sinks.write_tsv(net.null_model(), f"{args.out}.Null-Model.tsv")


if __name__ == "__main__":
    main()
