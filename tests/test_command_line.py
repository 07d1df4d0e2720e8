"""The commands, end to end on small files."""

from __future__ import annotations

import pytest

from pairloom.__main__ import main, parser
from pairloom.operators import network

from .test_npz import archive
from .test_smiles import block


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model") / "params")
    network.save_params(spark, network.initial_params(seed=3), path)
    return path


def test_defaults():
    a = parser().parse_args(["finetune", "--data", "a", "--val-data", "b", "--pretrained", "c"])
    assert (a.epochs, a.batch_size, a.lr, a.weight_decay, a.seed, a.train_layers) == (50, 16, 3e-4, 0.3, 12, 3)
    a = parser().parse_args(["train", "--data", "a"])
    assert (a.epochs, a.batch_size, a.lr, a.weight_decay, a.seed) == (400, 64, 3e-4, 1e-4, 42)
    with pytest.raises(SystemExit):
        parser().parse_args(["predict", "--smiles", "C", "C", "--cas", "1", "2"])


def test_predict(spark, model, tmp_path):
    lines = main(["predict", "--smiles", "CCO", "OC(=O)CC(=O)O", "--model", model])
    assert lines[0] == "Molecule 1: CCO (9 atoms)" and lines[1].endswith("(11 atoms)") and len(lines) == 8 and sum("<--" in x for x in lines) == 1
    with pytest.raises(ValueError, match="first input"):
        main(["predict", "--smiles", "C(", "C", "--model", model])
    for name in ("a", "b"):
        (tmp_path / f"{name}.sdf").write_text(block(name, [("C", 0, 0, 0), ("O", 1, 0, 0)], [(0, 1, 1)]))
    assert main(["predict", "--sdf", str(tmp_path / "a.sdf"), str(tmp_path / "b.sdf"), "--model", model])[0].endswith("(2 atoms)")
    spark.createDataFrame([("64-17-5", "CCO")], "cas string, value string").write.parquet(str(tmp_path / "cas"))
    assert main(["predict", "--cas", "64-17-5", "64-17-5", "--cas-table", str(tmp_path / "cas"), "--model", model])[1].endswith("(9 atoms)")


def test_train_finetune_evaluate(spark, tmp_path):
    archive(tmp_path / "d.npz", 40)
    data, out = str(tmp_path / "d.npz"), str(tmp_path / "out")
    lines = main(["train", "--data", data, "--epochs", "1", "--batch-size", "16", "--save-dir", out])
    assert lines[0].startswith("Epoch 1: loss") and network.load_params(spark, f"{out}/last", network.initial_params())
    lines = main(["finetune", "--data", data, "--val-data", data, "--pretrained", f"{out}/last", "--epochs", "1", "--train-layers", "1", "--save-dir", str(tmp_path / "fine")])
    assert lines[0] == "Parameters: 260 trained of 134340"
    lines = main(["evaluate", "--model", f"{out}/last", "--test-data-1", data, "--test-data-2", data, "--output", str(tmp_path / "r.csv")])
    assert lines[0].startswith("Overall Accuracy: ") and spark.read.csv(str(tmp_path / "r.csv"), header=True).count() == 40


def test_pairs_and_blocks_become_a_dataset(spark, model, tmp_path):
    (tmp_path / "m.sdf").write_text("$$$$\n".join([block("k1", [("C", 0, 0, 0), ("O", 1, 0, 0)], [(0, 1, 1)]), block("k2", [("N", 0, 0, 0)], [])]))
    (tmp_path / "p.csv").write_text("key1,key2,x,label,tag\nk1,k2,-,1,T1\nk2,k1,-,0,T2\nk1,none,-,1,T3\n")
    args = ["evaluate", "--model", model, "--mol-blocks", str(tmp_path / "m.sdf"), "--output", str(tmp_path / "r.csv")]
    lines = main([*args, "--test-data-1", str(tmp_path / "p.csv"), "--test-data-2", str(tmp_path / "p.csv")])
    assert spark.read.csv(str(tmp_path / "r.csv"), header=True).count() == 2 and lines[-1].startswith("Results saved")


def test_parameters_that_do_not_fit(spark, model):
    with pytest.raises(ValueError, match="fc_out.weight has shape"):
        network.load_params(spark, model, network.initial_params(3))
    with pytest.raises(ValueError, match="is missing"):
        network.require_shapes({}, network.initial_params())
