"""Command line: `python -m pairloom predict | train | finetune | evaluate` (or the same by spark-submit).

A dataset is a stored one (a folder of graphs, nodes and edges), an `.npz` archive or a folder of them, or a pair CSV together with
--mol-blocks (an SDF file or folder whose records' first lines are the keys), which is built once and stored beside the CSV.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.features import CLASS_NAMES, report_line
from .operators import assembly, metrics, network, perception, scoring, training
from .sources import datasets, molblocks, npz, pairs
from .sources.shared import spread


def dataset(spark: SparkSession, path: str, mol_blocks: str | None = None, rebuild: bool = False) -> datasets.Dataset:
    """The dataset of a path; see above."""
    if path.endswith(".csv"):

        def build() -> datasets.Dataset:
            if mol_blocks is None:
                raise ValueError(f"{path} needs --mol-blocks")
            found = perception.perceived(molblocks.rows(spread(molblocks.read_records(spark, mol_blocks))), hydrogens=False)
            rows = pairs.read_pairs(spark, path).withColumn("graph_id", F.sha2(F.concat_ws("\x1f", "key1", "key2", "tag"), 256))
            return assembly.build_dataset(rows, perception.atom_table(found), perception.bond_table(found), strict=False)

        return datasets.resolve(spark, path.removesuffix(".csv") + ".dataset", build, rebuild)
    if path.endswith(".npz"):
        return npz.read(spark, path)
    try:
        return datasets.resolve(spark, path)
    except FileNotFoundError:
        return npz.read(spark, path)


def labelled(data: datasets.Dataset) -> DataFrame:
    return assembly.require_rows(assembly.samples(data))


def predict(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    kind = next(k for k in ("smiles", "cas", "sdf") if getattr(args, k))
    first, second = getattr(args, kind)
    options: dict = {}
    if kind == "cas":
        if not args.cas_table:
            raise ValueError("--cas needs --cas-table (a Parquet table of cas and value)")
        options["tiers"] = [spark.read.parquet(args.cas_table)]
    if kind == "sdf":
        both = molblocks.read_records(spark, first, f"'{first}'").unionByName(molblocks.read_records(spark, second, f"'{second}'"))
        options["blocks"] = both.groupBy("mol_key").agg(F.first("block").alias("block"))
    params = network.load_params(spark, args.model, network.initial_params(args.num_classes))
    d = scoring.score_structures(spark.createDataFrame([(0, first, second)], "graph_id int, input1 string, input2 string"), params, kind, **options)
    r = d.first()
    if r.error:
        raise ValueError(r.error)
    shown = spark.createDataFrame([(i, name, float(p), i == r.pred) for i, (name, p) in enumerate(zip(CLASS_NAMES, r.probs, strict=False))], "i int, name string, share double, chosen boolean")
    lines = [x.line for x in shown.select("i", report_line(F.col("name"), F.col("share"), F.col("chosen")).alias("line")).orderBy("i").collect()]
    return [f"Molecule 1: {first} ({r.n1} atoms)", f"Molecule 2: {second} ({r.n2} atoms)", f"Prediction: {r['class']}", "Confidence:", *lines]


def train(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    rows = labelled(dataset(spark, args.data, args.mol_blocks, args.rebuild_features)).persist()
    own, held = assembly.split(rows, seed=args.seed)
    best, last, log = training.fit(own, held, network.initial_params(args.num_classes, args.seed), args.epochs, args.batch_size, args.lr, args.weight_decay, seed=args.seed, checkpoints=f"{args.save_dir}/epochs")
    return _saved(spark, args.save_dir, best, last, log)


def finetune(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    own, held = (labelled(dataset(spark, p, args.mol_blocks, args.rebuild_features)).persist() for p in (args.data, args.val_data))
    start = network.load_params(spark, args.pretrained, network.initial_params(args.num_classes))
    best, last, log = training.fit(
        own, held, start, args.epochs, args.batch_size, args.lr, args.weight_decay, args.train_layers, training.FINETUNE["weights"], drop_last=False, seed=args.seed, checkpoints=f"{args.save_dir}/epochs"
    )
    counts = network.count_params(network.params_table(spark, start), args.train_layers).first()
    return [f"Parameters: {counts.trainable} trained of {counts.total}", *_saved(spark, args.save_dir, best, last, log)]


def _saved(spark: SparkSession, folder: str, best: network.Params, last: network.Params, log: list[dict]) -> list[str]:
    network.save_params(spark, best, f"{folder}/best"), network.save_params(spark, last, f"{folder}/last")
    lines = [f"Epoch {x['epoch']}: loss {x['loss']:.4f}, validation loss {x['validation_loss']:.4f}, balanced accuracy {x['score']:.4f}, accuracy {x['accuracy']:.4f}, rate {x['rate']:.2e}" for x in log]
    return [*lines, f"Parameters saved to {folder}/best and {folder}/last"]


def evaluate(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    params = network.load_params(spark, args.model, network.initial_params(args.num_classes))
    ab, ba = (labelled(dataset(spark, p, args.mol_blocks, args.rebuild_features)) for p in (args.test_data_1, args.test_data_2))
    label = ab.select("graph_id", "label")
    scored = network.both_directions_by_position(*[network.probabilities(network.logits(s, params)) for s in (ab, ba)]).join(label, "graph_id").persist()
    datasets.write_predictions(scored, args.output)
    lines = [f"Overall Accuracy: {metrics.overall_accuracy(scored).first()[0]:.4f}", "Confusion Matrix:"]
    cells = {(r.label, r.pred): r["count"] for r in metrics.confusion_matrix(scored, None).collect()}
    classes = sorted({c for c, _ in cells})
    lines += [" ".join(f"{cells[a, b]:5d}" for b in classes) for a in classes]
    lines += [f"Class {r.label} Accuracy: {r.accuracy:.4f}" for r in metrics.present_class_accuracies(scored).orderBy("label").collect()]
    return [*lines, f"Results saved to {args.output}"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pairloom", description="Classify pairs of molecules, and train the classifier.")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, **defaults) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("--num-classes", type=int, default=4)
        if name != "predict":
            c.add_argument("--mol-blocks")
            c.add_argument("--rebuild-features", action="store_true")
            c.add_argument("--seed", type=int, default=defaults.pop("seed", 42))
        for option, value in defaults.items():
            c.add_argument("--" + option.replace("_", "-"), type=type(value), default=value)
        return c

    c = command("predict", predict)
    given = c.add_mutually_exclusive_group(required=True)
    for kind in ("smiles", "cas", "sdf"):
        given.add_argument(f"--{kind}", nargs=2)
    c.add_argument("--cas-table")
    c.add_argument("--model", default="checkpoints/best")
    # The usual settings of training and fine-tuning.
    c = command("train", train, epochs=400, batch_size=64, lr=3e-4, weight_decay=1e-4, save_dir="checkpoints")
    c.add_argument("--data", required=True)
    c = command("finetune", finetune, seed=12, epochs=50, batch_size=16, lr=3e-4, weight_decay=0.3, train_layers=3, save_dir="checkpoints")
    for option in ("--data", "--val-data", "--pretrained"):
        c.add_argument(option, required=True)
    c = command("evaluate", evaluate, output="prediction_results.csv")
    for option in ("--model", "--test-data-1", "--test-data-2"):
        c.add_argument(option, required=True)
    return p


def main(argv: list[str] | None = None) -> list[str]:
    """Runs a command; prints and returns its lines."""
    args = parser().parse_args(argv)
    lines = args.run(SparkSession.builder.appName("pairloom").getOrCreate(), args)
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main()
