from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import assembly, metrics, network, training

SMALL = {"convs": [("conv1", 3, 5), ("conv2", 5, 4)], "dense": [("fc1", 4, 4)]}


def small_params(seed=1, classes=3):
    p = network.initial_params(classes, seed, **SMALL)
    rng = np.random.default_rng(seed)
    return {k: v + 0.1 * rng.random(v.shape) for k, v in p.items()}


def graphs(count, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        n = int(rng.integers(2, 5))
        pairs = [(i, i + 1) for i in range(n - 1)]
        src, dst = np.array([p[0] for p in pairs] + [p[1] for p in pairs]), np.array([p[1] for p in pairs] + [p[0] for p in pairs])
        out.append((rng.normal(size=(n, 3)), src, dst))
    return out


def sample_frame(spark, items, labels):
    rows = [(f"g{i}", int(y), "t", x.tolist(), s.tolist(), d.tolist()) for i, ((x, s, d), y) in enumerate(zip(items, labels, strict=True))]
    return spark.createDataFrame(rows, "graph_id string, label int, tag string, x array<array<double>>, src array<int>, dst array<int>")


def test_gradient_against_differences():
    p, items = small_params(), graphs(6)
    labels, weights = np.array([0, 1, 2, 0, 1, 2]), np.array([1.0, 2.0, 1.0])
    loss = lambda q: training.batch_gradient(q, items, labels, weights, 0.0, np.random.default_rng(0))[0]
    _, _, grads, _ = training.batch_gradient(p, items, labels, weights, 0.0, np.random.default_rng(0))
    for name in training.trained_names(p):
        at = tuple(0 for _ in p[name].shape)
        up, down = ({**p, name: p[name].copy()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert grads[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6), name


def test_scores_match_numpy(spark):
    p, items = small_params(), graphs(5)
    got = {r.graph_id: r.logits for r in network.logits(sample_frame(spark, items, [0] * 5), p).collect()}
    for i, (x, s, d) in enumerate(items):
        a = np.eye(len(x))
        a[s, d] = 1
        norm = np.diag(a.sum(1) ** -0.5) @ a @ np.diag(a.sum(1) ** -0.5)
        h = x
        for k in (1, 2):
            h = norm @ h @ p[f"conv{k}.weight"] + p[f"conv{k}.bias"]
            h = np.maximum((h - p[f"bn{k}.mean"]) / np.sqrt(p[f"bn{k}.var"] + 1e-5) * p[f"bn{k}.gamma"] + p[f"bn{k}.beta"], 0)
        h = h.mean(0) @ p["fc1.weight"] + p["fc1.bias"]
        h = np.maximum((h - p["bn3.mean"]) / np.sqrt(p["bn3.var"] + 1e-5) * p["bn3.gamma"] + p["bn3.beta"], 0)
        assert np.allclose(got[f"g{i}"], h @ p["fc_out.weight"] + p["fc_out.bias"])


def test_padding_nodes_take_part_in_pooling():
    p = {"conv1.weight": np.ones((1, 1)), "conv1.bias": np.ones(1), "bn1.gamma": np.ones(1), "bn1.beta": np.zeros(1), "bn1.mean": np.zeros(1), "bn1.var": np.ones(1) - 1e-5}
    x, s, d = np.array([[1.0], [3.0]]), np.array([0, 1]), np.array([1, 0])
    assert network.pooled(p, x, s, d)[0] == pytest.approx(3.0)
    assert network.pooled(p, x, s, d, pad_to=4)[0] == pytest.approx(2.0)
    with pytest.raises(ValueError, match="does not fit"):
        network.pooled(p, x, s, d, pad_to=1)


def test_graphs_beyond_the_padded_size_follow_the_same_formula():
    p = {"conv1.weight": np.ones((1, 1)), "conv1.bias": np.ones(1), "bn1.gamma": np.ones(1), "bn1.beta": np.zeros(1), "bn1.mean": np.zeros(1), "bn1.var": np.ones(1) - 1e-5}
    x, none = np.array([[1.0], [3.0], [5.0]]), np.array([], dtype=np.int64)
    # Nodes 2, 4 and 6 behind the layer, padding nodes 1: the first graph has two nodes, the second one.
    got = network.pooled_batch(p, x, np.array([2, 1]), none, none, 1, longer="extend")
    assert got.ravel() == pytest.approx([2 + 4 - 1, 6])
    with pytest.raises(ValueError, match="does not fit"):
        network.pooled_batch(p, x, np.array([2, 1]), none, none, 1)


def test_batches_of_graphs_score_as_single_ones():
    p, items = small_params(), graphs(9)
    items[3] = (items[3][0], np.array([0, 0, 1, 1]), np.array([1, 1, 0, 1]))  # repeated edges and a loop
    sizes = np.array([len(x) for x, _, _ in items])
    first = np.cumsum(sizes) - sizes
    src, dst = (np.concatenate([g[k] + f for g, f in zip(items, first, strict=True)]) for k in (1, 2))
    got = network.pooled_batch(p, np.concatenate([x for x, _, _ in items]), sizes, src, dst, 6)
    for row, (x, s, d) in zip(got, items, strict=True):
        a, pad = network.normalised_adjacency(len(x), s, d), np.zeros((1, 3))
        for k in (1, 2):
            x, pad = (network._normed(h @ p[f"conv{k}.weight"] + p[f"conv{k}.bias"], p, k) for h in (a @ x, pad))
        assert np.allclose(row, (x.sum(axis=0) + (6 - len(x)) * pad[0]) / 6)


def test_both_orders_as_two_assemblies_and_a_join(spark, monkeypatch):
    monkeypatch.setattr(network, "NODES_AT_ONCE", 5)
    p, items = small_params(), graphs(7)
    d = sample_frame(spark, items, [0] * 7).withColumn("n1", F.lit(1)).withColumn("n2", F.size("x") - 1)
    ab, ba = (network.probabilities(network.logits(s, p, 5)) for s in (d, assembly.reversed_samples(d)))
    want = {r.graph_id: r for r in network.both_directions(ab, ba).collect()}
    scored = network.both_orders(d, p, 5)
    assert "Join" not in scored._jdf.queryExecution().toString() and "Join" not in network.evaluate(d, p)._jdf.queryExecution().toString()
    got = {r.graph_id: r for r in scored.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k].probs, want[k].probs) and got[k]["pred"] == want[k]["pred"] for k in want)


def test_a_pair_is_convolved_once_for_both_orders(spark):
    """a mean over nodes has no order, so the sides' sizes are not even asked for; nodes with many neighbours are summed as those with few."""
    p, items = small_params(), graphs(3)
    hub = (np.random.default_rng(3).normal(size=(50, 3)), np.zeros(49, dtype=int), np.arange(1, 50))
    items.append((hub[0], np.concatenate(hub[1:]), np.concatenate(hub[:0:-1])))
    got = {r.graph_id: r.probs for r in network.both_orders(sample_frame(spark, items, [0] * 4), p).collect()}
    for i, (x, s, d) in enumerate(items):
        a = network.normalised_adjacency(len(x), s, d)
        assert np.allclose(network.propagated(network.normalised_edges(np.array([len(x)]), s, d), x), a @ x)
        for k in (1, 2):
            x = network._normed(a @ x @ p[f"conv{k}.weight"] + p[f"conv{k}.bias"], p, k)
        e = np.exp(network.forward(p, x.mean(0)[None])[0])
        assert np.allclose(got[f"g{i}"], e / e.sum())


def test_parameter_table_round_trip(spark):
    p = small_params()
    q = network.read_params(network.params_table(spark, p))
    assert p.keys() == q.keys() and all(np.array_equal(p[k], q[k]) for k in p)
    table = network.params_table(spark, network.initial_params())
    assert [network.count_params(table, k).first().trainable for k in (1, 2, 3, 0)] == [260, 8644, 25412, 134340]


def test_both_directions(spark):
    ab = spark.createDataFrame([("a", [0.6, 0.4])], "graph_id string, probs array<double>")
    ba = spark.createDataFrame([("a", [0.4, 0.6])], "graph_id string, probs array<double>")
    for d in (network.both_directions(ab, ba), network.both_directions_by_position(ab, ba)):
        r = d.first()
        assert r.probs == [0.5, 0.5] and r.pred == 0


def test_training_lowers_the_loss(spark):
    items = graphs(48)
    labels = [int(x.mean() > 0) for x, _, _ in items]
    s = sample_frame(spark, items, labels)
    best, _, log = training.fit(s, s, small_params(classes=2), epochs=3, batch_size=16, rate=0.02, batches_a_step=4, drop_last=False)
    assert log[-1]["validation_loss"] < log[0]["validation_loss"] + 0.05 and len(log) == 3 and best.keys() == small_params(classes=2).keys()
    tuned = training.finetune_last_layer(s, small_params(classes=2), [1.0, 2.0], decay=0.001)
    before, after = (network.evaluate(s, q).agg(F.avg("loss")).first()[0] for q in (small_params(classes=2), tuned))
    assert after < before


def test_the_last_layer_is_scored_from_stored_features(spark):
    """neither fitting nor scoring the last layer needs the samples a second time."""
    items = graphs(12)
    s = sample_frame(spark, items, [int(x.mean() > 0) for x, _, _ in items])
    rows = training.features(s, small_params(classes=2))
    assert set(rows.columns) == {"graph_id", "label", "tag", "embedding"}
    tuned = training.fit_last_layer(rows, small_params(classes=2), decay=0.001)
    assert np.allclose(tuned["fc_out.weight"], training.finetune_last_layer(s, small_params(classes=2), decay=0.001)["fc_out.weight"])
    got, want = ({r.graph_id: r for r in d.collect()} for d in (network.evaluate_embedded(rows, tuned), network.evaluate(s, tuned)))
    assert got.keys() == want.keys() and all(np.allclose(got[k].logits, want[k].logits) and got[k].loss == pytest.approx(want[k].loss) for k in want)
    assert network.evaluate_embedded(rows.where("false"), tuned).count() == 0


def test_batches_meet_their_graphs_in_tasks_of_a_fixed_number_of_rows(spark, monkeypatch):
    """nothing but keys goes through the session's shuffle partitions."""
    monkeypatch.setattr(training, "STEPS_A_TASK", 1)
    told = {}
    monkeypatch.setattr(training, "_chained", lambda d, parts, *a: told.update(plan=d._jdf.queryExecution().executedPlan().toString(), parts=parts) or (a[0], 0.0))
    training.train_epoch(sample_frame(spark, graphs(21), [0] * 21), small_params(), training.Adam(), 1, batch_size=2)
    assert told["parts"] == 11 and "SortMergeJoin" in told["plan"]
    wide = [x for x in told["plan"].splitlines() if "Exchange hashpartitioning(" in x and "graph_id" in x]
    assert len(wide) == 2 and all(", 11)" in x for x in wide), told["plan"]


def test_steps_of_one_batch_as_a_loop_over_batches(spark, monkeypatch):
    monkeypatch.setattr(training, "STEPS_A_TASK", 2)
    monkeypatch.setattr(training, "step_gradients", lambda *a: pytest.fail("a job for each step"))
    d = sample_frame(spark, graphs(39), [i % 3 for i in range(39)]).persist()
    adam, one = training.Adam(0.01), training.Adam(0.01)
    got, loss = training.train_epoch(d, small_params(), adam, 1, batch_size=8)
    cut, p, total = {}, small_params(), []
    for r in training.cut_batches(d, 8, 43, drop_last=True).orderBy("graph_id").collect():
        cut.setdefault(int(r.batch), []).append(r)
    for k in sorted(cut):
        rows = [(np.array(r.x), np.array(r.src), np.array(r.dst)) for r in cut[k]]
        found, _, grads, stats = training.batch_gradient(p, rows, np.array([r.label for r in cut[k]]), np.ones(3), network.DROPOUT, np.random.default_rng([43, *str(k).encode()]))
        p = one.update(p, grads, training.trained_names(p))
        p |= {n: 0.9 * p[n] + 0.1 * v for n, v in stats.items()}
        total.append(found)
    assert len(total) == 4 and adam.step == 4 and loss == pytest.approx(np.mean(total))
    assert got.keys() == p.keys() and all(np.allclose(got[n], p[n]) for n in p) and all(np.allclose(adam.m[n], one.m[n]) for n in one.m)


def test_training_goes_on_from_a_checkpoint(spark, tmp_path):
    items = graphs(24)
    d = sample_frame(spark, items, [i % 3 for i in range(24)]).persist()
    run = lambda epochs, folder: training.fit(d, d, small_params(), epochs, 8, checkpoints=folder)
    best, last, log = run(3, None)
    run(2, str(tmp_path / "state"))
    again = run(3, str(tmp_path / "state"))  # only the third epoch is left
    assert [x["epoch"] for x in again[2]] == [1, 2, 3] and again[2][2]["loss"] == pytest.approx(log[2]["loss"])
    for one, other in ((best, again[0]), (last, again[1])):
        assert one.keys() == other.keys() and all(np.allclose(one[k], other[k]) for k in one)
    assert training.load_state(spark, str(tmp_path / "none")) is None
    network.save_params(spark, best, str(tmp_path / "best"))
    assert all(np.allclose(best[k], v) for k, v in network.read_params(spark.read.parquet(str(tmp_path / "best"))).items())


def test_plateau():
    p = training.Plateau(patience=1)
    assert [p.rate(x, 1.0) for x in (1.0, 1.0, 1.0, 0.5)] == [1.0, 1.0, 0.5, 1.0]


GOLDEN = [[6, 2, 2, 4], [0, 4, 3, 1], [0, 1, 5, 0], [2, 2, 4, 14]]


def expanded(spark, matrix):
    rows = [(i, j) for i, r in enumerate(matrix) for j, n in enumerate(r) for _ in range(n)]
    return spark.createDataFrame(rows, "label int, pred int")


def test_published_confusion_matrix(spark):
    d = expanded(spark, GOLDEN)
    assert metrics.overall_accuracy(d).first()[0] == 0.58
    assert [round(r.accuracy, 4) for r in metrics.class_accuracies(d).orderBy("label").collect()] == [0.4286, 0.5, 0.8333, 0.6364]
    m = metrics.macro_precision_recall_f1(d).first()
    assert (round(m.macro_precision, 6), round(m.macro_recall, 6), round(m.macro_f1, 6)) == (0.572107, 0.599567, 0.549742)
    cells = {(r.label, r["pred"]): r["count"] for r in metrics.confusion_matrix(d).collect()}
    assert [[cells[i, j] for j in range(4)] for i in range(4)] == GOLDEN


def test_absent_classes(spark):
    d = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label int, pred int")
    assert [r.accuracy for r in metrics.class_accuracies(d).orderBy("label").collect()] == [0.5, 1.0, 0.0, 0.0]
    s = metrics.accuracy_summary(d).first()
    assert s.macro_accuracy == 0.375 and round(s.overall_accuracy, 6) == 0.666667
    assert metrics.confusion_matrix(d, None).count() == 4 and metrics.confusion_matrix(d).count() == 16


def test_two_level_loss(spark):
    d = spark.createDataFrame([("1", 0, 1.0), ("1", 3, 2.0), ("2", 1, 3.0)], "batch string, label int, loss double")
    assert metrics.running_loss(d, [1, 1, 1, 2]).first()[0] == pytest.approx((5 / 3 * 2 + 3) / 3)


def test_best_epoch(spark):
    log = spark.createDataFrame([(1, 0.2), (2, 0.5), (3, 0.5), (4, 0.4)], "epoch int, score double")
    assert metrics.best_epoch(log).first().epoch == 2
    assert [r.epoch for r in metrics.improvements(log).orderBy("epoch").collect()] == [1, 2]
    assert metrics.best_epoch(log.withColumn("score", F.lit(0.0))).count() == 0
