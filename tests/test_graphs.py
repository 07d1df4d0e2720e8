from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairloom.functions.features import SCALARS
from pairloom.operators import adjacency, assembly, graphconv, molecules
from pairloom.operators import pairs as pg
from pairloom.sources import datasets


def atom(mol, idx, symbol="C", **more):
    row = dict.fromkeys(SCALARS, 0) | {"mol_key": mol, "idx": idx, "symbol": symbol, "hybridization": "SP3", "chirality": "", "x": float(idx), "y": 0.0, "z": 0.0}
    for c in ("is_donor", "is_acceptor", "is_aromatic"):
        row[c] = False
    return row | more


def bond(mol, begin, end, kind=1, ring=False, conjugated=False, length=1.5):
    return {"mol_key": mol, "begin": begin, "end": end, "type_number": kind, "length": length, "is_ring": ring, "is_conjugated": conjugated}


def frames(spark, atoms, bonds):
    empty = "mol_key string, begin int, end int, type_number int, length double, is_ring boolean, is_conjugated boolean"
    return spark.createDataFrame(atoms), spark.createDataFrame(bonds, empty) if bonds else spark.createDataFrame([], empty)


def pair(spark, *keys, label=0, tag="t"):
    return spark.createDataFrame([(f"g{i}", a, b, label, tag, tag) for i, (a, b) in enumerate(keys)], "graph_id string, key1 string, key2 string, label int, tag string, last string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_quarantine(spark):
    a, b = frames(spark, [atom("m", 0), atom("m", 1, "Si"), atom("k", 0)], [])
    d = assembly.build_dataset(pair(spark, ("m", "k"), ("k", "k")), a, b)
    assert rows(d.graphs, "graph_id") == [("g1",)]


def test_unknown_molecule_is_an_error_only_if_strict(spark):
    a, _ = frames(spark, [atom("m", 0)], [])
    with pytest.raises(Exception, match="no molecule"):
        pg.pair_graphs(pair(spark, ("m", "nowhere")), a, strict=True).collect()
    assert pg.pair_graphs(pair(spark, ("m", "nowhere")), a).count() == 0


def test_offsets_and_symmetry(spark):
    a, b = frames(spark, [atom("m", 0), atom("m", 1), atom("k", 0), atom("k", 1)], [bond("k", 0, 1)])
    g = pg.pair_graphs(pair(spark, ("m", "k")), a)
    assert rows(g, "n1", "n2", "n", "name") == [(2, 2, 4, "m&k")]
    assert rows(pg.pair_edges(g, b), "src", "dst") == [(2, 3), (3, 2)]
    assert rows(pg.pair_nodes(g, a), "node_id", "side") == [(0, 1), (1, 1), (2, 2), (3, 2)]


def test_hbonds_cross_the_molecules(spark):
    a, b = frames(spark, [atom("m", 0, "O", is_donor=True, is_acceptor=True), atom("m", 1, "H"), atom("k", 0, "N", is_acceptor=True)], [bond("m", 0, 1)])
    g = pg.pair_graphs(pair(spark, ("m", "k")), a)
    assert rows(pg.possible_hbonds(g, a, b), "src", "dst") == [(1, 2)]
    assert rows(pg.interaction_channels(g, a, b, 4), "src", "dst", "channel") == [(1, 2, 4), (2, 1, 4)]
    assert pg.interaction_channels(g, a, b, 4, hbond=False) is None
    assert rows(molecules.donors(a, b), "mol_key", "idx", "hs") == [("m", 0, [1])]


def test_pi_stacks_need_both_sides(spark):
    a, _ = frames(spark, [atom("m", 0, is_aromatic=True), atom("m", 1, is_aromatic=True), atom("k", 0)], [])
    assert pg.possible_pipi_stacks(pg.pair_graphs(pair(spark, ("m", "k")), a), a).count() == 0
    assert rows(pg.possible_pipi_stacks(pg.pair_graphs(pair(spark, ("m", "m")), a), a), "src", "dst") == [(0, 2), (0, 3), (1, 2), (1, 3)]


def test_spiro(spark):
    r = spark.createDataFrame([("m", 0, [0, 1, 2]), ("m", 1, [2, 3, 4]), ("k", 0, [0, 1, 2, 3]), ("k", 1, [2, 3, 4, 5])], "mol_key string, ring_id int, atom_ids array<int>")
    assert rows(molecules.spiro_atoms(r), "mol_key", "idx") == [("m", 2)]


@pytest.mark.parametrize(
    ("mode", "expected"),
    [
        ("OnlyCovalentBond", None), ("WithDistanceMatrix", None), ("WithBinDistanceMatrix", None),
        ("WithBondLenth", [(0, 1, 4, 1.5), (1, 0, 4, 1.5)]), ("IsRingAndConjugated", []),
        ("AllFeature", [(0, 1, 6, 1.0), (1, 0, 6, 1.0)]), ("allfeaturebin", [(0, 1, 6, 1.0), (1, 0, 6, 1.0)]),
    ],
)
def test_other_bond_types_by_mode(spark, mode, expected):
    a, b = frames(spark, [atom("g", 0), atom("g", 1)], [bond("g", 0, 1, kind=5)])
    n, b = a.withColumnsRenamed({"mol_key": "graph_id", "idx": "node_id"}), b.withColumnRenamed("mol_key", "graph_id")
    assert adjacency.invalid_graphs(b, mode).count() == (expected is None)
    assert rows(adjacency.adjacency_channels(n, b, mode), "src", "dst", "channel", "value") == (expected or [])


def test_modes(spark):
    assert sorted(adjacency.CHANNELS.values()) == [4, 5, 5, 6, 7, 14, 16]
    with pytest.raises(ValueError, match="unknown adjacency mode"):
        adjacency.mode_of("nothing")


def test_edges_with_interactions(spark):
    a, b = frames(spark, [atom("m", 0, is_aromatic=True), atom("m", 1)], [bond("m", 0, 1, kind=2)])
    d = assembly.build_dataset(pair(spark, ("m", "m")), a, b, pipi_stack=True)
    assert rows(d.edges, "src", "dst", "edge_attr") == [
        (0, 1, [0, 1, 0, 0, 0]), (0, 2, [0, 0, 0, 0, 1]), (1, 0, [0, 1, 0, 0, 0]), (2, 0, [0, 0, 0, 0, 1]), (2, 3, [0, 1, 0, 0, 0]), (3, 2, [0, 1, 0, 0, 0]),
    ]


def test_empty_dataset(spark):
    a, b = frames(spark, [atom("m", 0, "Si")], [])
    with pytest.raises(ValueError, match="No valid data"):
        assembly.require_rows(assembly.build_dataset(pair(spark, ("m", "m")), a, b).graphs)


def test_padding(spark):
    g = spark.createDataFrame([("g", 2)], "graph_id string, n int")
    n = spark.createDataFrame([("g", 0, [1.0]), ("g", 1, [2.0])], "graph_id string, node_id int, features array<float>")
    assert rows(assembly.padded_nodes(g, n, 4, 1), "node_id", "features", "mask") == [(0, [1.0], 1.0), (1, [2.0], 1.0), (2, [0.0], 0.0), (3, [0.0], 0.0)]
    with pytest.raises(Exception, match="larger than the padded size"):
        assembly.padded_nodes(g, n, 1, 1).collect()


def test_propagation(spark):
    n = spark.createDataFrame([("g", i, [float(i + 1)]) for i in range(3)], "graph_id string, node_id int, features array<double>")
    e = spark.createDataFrame([("g", 0, 1), ("g", 1, 0), ("g", 1, 2), ("g", 2, 1)], "graph_id string, src int, dst int")
    got = [round(r[0][0], 6) for r in graphconv.propagate(n, e, 1).orderBy("node_id").select("features").collect()]
    assert got == [1.316497, 2.299660, 2.316497]


def test_split_and_batches(spark):
    d = spark.range(1000).select(F.col("id").alias("graph_id"))
    train, held = assembly.split(d)
    assert train.count() + held.count() == 1000 and 60 < held.count() < 140
    b = assembly.batches(d, 16)
    assert b.count() == 1000 and b.groupBy("batch").count().agg(F.max("count")).first()[0] == 16
    assert assembly.batches(d, 16, drop_last=True).groupBy("batch").count().agg(F.min("count")).first()[0] == 16
    assert rows(b, "graph_id", "batch") == rows(assembly.batches(d, 16), "graph_id", "batch")


def test_batches_leave_out_one_part_at_most(spark):
    d = spark.range(1000).select(F.col("id").alias("graph_id"))
    sizes = sorted(r["count"] for r in assembly.batches(d, 16).groupBy("batch").count().collect())
    assert sizes == [8] + [16] * 62
    whole = assembly.batches(d, 16, drop_last=True)
    assert whole.select("graph_id").distinct().count() == whole.count() == 992
    assert assembly.batches(d.where("false"), 16, drop_last=True).count() == 0


def test_dataset_store(spark, tmp_path):
    a, b = frames(spark, [atom("m", 0), atom("m", 1)], [bond("m", 0, 1)])
    path = str(tmp_path / "d")
    with pytest.raises(FileNotFoundError):
        datasets.resolve(spark, path)
    built = datasets.resolve(spark, path, lambda: assembly.build_dataset(pair(spark, ("m", "m")), a, b))
    assert built.nodes.count() == 4
    assert datasets.resolve(spark, path).edges.count() == 4


def test_npz_import(spark, tmp_path):
    import numpy as np

    v, a = np.zeros((1, 3, 34), dtype="float32"), np.zeros((1, 3, 4, 3), dtype="float32")
    v[0, 0, 0] = 1
    a[0, 0, 2, 1] = a[0, 1, 2, 0] = 1
    np.savez(tmp_path / "d.npz", V=v, A=a, labels=np.array([2]), tags=np.array(["X"]), graph_size=np.array([2]), masks=np.ones((1, 3, 1)))
    d = datasets.read_npz(spark, str(tmp_path / "d.npz"))
    assert rows(d.graphs, "graph_id", "n", "label", "tag") == [("d.npz#0", 2, 2, "X")]
    assert rows(d.edges, "src", "dst", "edge_attr") == [(0, 1, [0, 0, 1, 0]), (1, 0, [0, 0, 1, 0])]
    assert d.nodes.count() == 2


def test_coordinates(spark):
    a, _ = frames(spark, [atom("m", 0), atom("k", 0), atom("k", 1)], [])
    other = a.where("NOT (mol_key = 'k' AND idx = 1)")
    assert rows(molecules.same_coordinates(a, other), "mol_key", "valid") == [("k", False), ("m", True)]


def test_scoring_tells_errors(spark):
    from pairloom.operators import network, scoring

    a, b = frames(spark, [atom("m", i) for i in range(3)] + [atom("k", i) for i in range(2)] + [atom("si", 0, "Si")], [bond("m", 0, 1), bond("m", 1, 2), bond("k", 0, 1)])
    p = pair(spark, ("m", "k"), ("m", "si"), ("m", "none"), (None, "k"), ("m", "m"))
    params = network.initial_params(seed=3)
    got = {r.graph_id: r for r in scoring.score_pairs(p, a, b, params, pad_to=5).collect()}
    assert {i: r.error for i, r in got.items()} == {
        "g0": None, "g1": "atoms or bonds outside the vocabularies", "g2": "no molecule: none", "g3": "no molecule: null", "g4": "more nodes than the padded size",
    }
    assert sum(got["g0"].probs) == pytest.approx(1) and got["g0"]["class"] and got["g2"].probs is None


def test_reversed_samples(spark):
    a, b = frames(spark, [atom("m", i) for i in range(3)] + [atom("k", i, "N") for i in range(2)], [bond("m", 0, 1), bond("m", 1, 2), bond("k", 0, 1)])
    whole = [assembly.samples(assembly.build_dataset(p, a, b)) for p in (pair(spark, ("m", "k")), pair(spark, ("k", "m")))]
    x, y = assembly.reversed_samples(whole[0]).first(), whole[1].first()
    edges = lambda r: sorted(zip(r.src, r.dst, strict=True))
    assert (x.n1, x.n2, x.x, edges(x)) == (y.n1, y.n2, y.x, edges(y))


def test_ranges(spark):
    from pairloom.operators import network, ranges

    rng = list(range(500)) + [7] * 5
    d = spark.createDataFrame([(x, (x * 37) % 101) for x in rng], "k int, v int").repartition(5)
    got = sorted((r.k, r.position) for r in network.with_position(d, "k").collect())
    assert [p for _, p in got] == list(range(1, 506)) and [k for k, _ in got] == sorted(rng)
    unique = d.dropDuplicates(["k"])
    top = {r.k: r.top for r in ranges.before_row(unique, "k", F.col("v"), "top", largest=True, ranges=16).collect()}
    assert all(top[k] == (max((i * 37) % 101 for i in range(k)) if k else None) for k in range(500))
    assert network.with_position(d.where("false"), "k").count() == 0


def test_places_are_dealt_by_rows_and_each_part_counts_once(spark, tmp_path, monkeypatch):
    from pairloom.plans import order_graph as og

    rows = [(k, p) for k in range(40) for p in (3, 1, 3, 2, 1)] + [(None, 1), (None, 1), (7, None), (7, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(og, "ITEMS_A_TASK", 10)
    d = og.places(spark, str(tmp_path))
    assert d.rdd.getNumPartitions() == 21  # 204 rows, though they are small enough for one
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Repartition") == 1
    got = {(r.mol_key, r.idx, r.pk, r.next_pk) for r in d.collect()}
    assert got == {(k, *r) for k in range(40) if k != 7 for r in ((0, 1, 2), (1, 2, 3), (2, 3, None))} | {(7, 0, None, 1), (7, 1, 1, 2), (7, 2, 2, 3), (7, 3, 3, None), (None, 0, 1, None)}


def test_neighbours_meet_by_molecule(spark):
    from pairloom.operators import molecules

    atoms = spark.createDataFrame([("m", 0, "C", True), ("m", 1, "H", False), ("n", 0, "O", True), (None, 0, "C", True)], "mol_key string, idx int, symbol string, is_donor boolean")
    bonds = spark.createDataFrame([("m", 0, 1), ("n", 0, 5), ("n", 0, None), ("k", 0, 1), (None, 0, 0)], "mol_key string, begin int, end int")
    d = molecules.with_neighbours(atoms, bonds)
    assert sorted(tuple(r) for r in d.collect()) == [("m", 0, "C", True, 1, "H"), ("m", 1, "H", False, 0, "C")]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_molecule_tables_keep_their_rows_a_task_whatever_the_shuffle_partitions(spark, tmp_path, monkeypatch):
    from pairloom.operators import adjacency, molecules
    from pairloom.plans import order_graph as og

    rows = [(k, (k * (5 + 2 * p) + 3 * p) % 30) for k in range(60) for p in range(4)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, k % 50, k / 7) for k in range(30)], "p_partkey long, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))

    def made():
        atoms, bonds = og.atoms(spark, str(tmp_path)), og.bonds(spark, str(tmp_path))
        nodes, own = og.molecule_graphs(spark, str(tmp_path), 5)
        return [atoms, bonds, molecules.donor_hydrogens(atoms, bonds), molecules.carbon_hydrogens(atoms, bonds), adjacency.adjacency_channels(nodes, own, "AllFeature")]

    few = [sorted(map(tuple, d.collect()), key=repr) for d in made()]
    assert all(len(r) for r in few)
    monkeypatch.setattr(og, "ITEMS_A_TASK", 10)
    for d, expected in zip(made(), few, strict=True):
        assert sorted(map(tuple, d.collect()), key=repr) == expected
        assert d.rdd.getNumPartitions() in (24, 48)  # 240 items, 10 a task (48: a union of two such tables); the session has 4 shuffle partitions


@pytest.mark.parametrize("name", ["hbond_donors", "carbon_hydrogens", "hbond_pairs", "contact_pairs", "interaction_tensor", "coo_pair_graphs"])
def test_nothing_that_grows_is_dealt_by_the_shuffle_partitions(spark, tmp_path, monkeypatch, name):
    import re

    from pairloom.plans import order_graph as og
    from pairloom.plans import queries

    rows = [(k, (k * (5 + 2 * p) + 3 * p) % 300) for k in range(200) for p in range(4)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, "3-MEDIUM") for k in range(200)], "o_orderkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(k, k % 50, k / 7) for k in range(300)], "p_partkey long, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    few = sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect()))
    assert few
    monkeypatch.setattr(og, "ITEMS_A_TASK", 40)
    d = queries.QUERIES[name](spark, str(tmp_path))
    # 800 items, 40 a task; the session has 4 shuffle partitions.
    assert set(re.findall(r"hashpartitioning\([^)]*, (\d+)\)", d._jdf.queryExecution().executedPlan().toString())) == {"20"}
    assert sorted(map(tuple, d.collect())) == few


def test_a_hydrogen_of_two_donors_is_met_once_for_each(spark):
    atoms = [atom("m", 0, "O", is_donor=True), atom("m", 1, "H"), atom("m", 2, "N", is_donor=True), atom("m", 3, "C"), atom("k", 0, "N", is_acceptor=True), atom("k", 1, "O", is_acceptor=True, is_donor=True)]
    a, b = frames(spark, atoms, [bond("m", 0, 1), bond("m", 1, 2), bond("m", 3, 1), {**bond("m", 0, 1), "end": None}])
    g = pg.pair_graphs(pair(spark, ("m", "k"), ("k", "m")), a)
    h = [("g0", 1, 4), ("g0", 1, 5), ("g1", 3, 0), ("g1", 3, 1)]
    assert rows(pg.possible_hbonds(g, a, b), "graph_id", "src", "dst") == sorted(h * 2)
    assert rows(pg.possible_contacts(g, a, b), "graph_id", "src", "dst") == h
    both = sorted(h + [(i, dst, src) for i, src, dst in h])
    assert rows(pg.interaction_channels(g, a, b, 4, contact=True), "channel", "graph_id", "src", "dst") == [(c, *r) for c in (4, 5) for r in both]
    assert rows(molecules.donors(a, b), "mol_key", "idx", "hs") == [("k", 1, []), ("m", 0, [1]), ("m", 2, [1])]


@pytest.mark.parametrize("types", [4, 5])
def test_pairs_of_whole_molecules_are_the_samples_of_the_dataset(spark, sf_dir, types):
    """F2 to F4: molecules are gathered where they are; no table of nodes or edges is dealt by graph."""
    from pairloom.plans import order_graph as og

    p, a, b = og.pairs(spark, sf_dir), og.atoms(spark, sf_dir), og.bonds(spark, sf_dir, types)
    rows = lambda d: sorted(tuple(r) for r in d.select("graph_id", "name", "n1", "n2", "n", "label", "tag", "x", "src", "dst").collect())
    want = rows(assembly.samples(assembly.build_dataset(p, a, b, strict=False, denied=["1-URGENT"])))
    linked = assembly.pair_samples(p, og.linked_atoms(spark, sf_dir, types), None, denied=["1-URGENT"])
    assert want and rows(linked) == want and rows(assembly.pair_samples(p, a, b, denied=["1-URGENT"])) == want
    plan = linked._jdf.queryExecution().optimizedPlan().toString()
    assert "node_id" not in plan and "[graph_id" not in "".join(x for x in plan.splitlines() if "Aggregate" in x)
    with pytest.raises(ValueError, match="not those of the bonds"):
        assembly.molecule_samples(a, None, "WithDistanceMatrix")


def test_a_dataset_of_linked_atoms_is_made_once(spark, sf_dir, tmp_path, monkeypatch):
    """the stored tables are those of build_dataset, from one pass; shuffle files don't outlive what is written."""
    from pairloom.plans import order_graph as og
    from pairloom.sources import datasets, shared

    seen = []
    real = shared.released
    monkeypatch.setattr(datasets, "released", lambda s: seen.append(s) or real(s))
    p = og.pairs(spark, sf_dir)
    data = assembly.linked_dataset(p, og.linked_atoms(spark, sf_dir, 5), denied=["1-URGENT"])
    datasets.save(data, str(tmp_path / "d"))
    got = datasets.load(spark, str(tmp_path / "d"))
    want = assembly.build_dataset(p, og.atoms(spark, sf_dir), og.bonds(spark, sf_dir, 5), strict=False, denied=["1-URGENT"])
    for name, key in (("graphs", ["graph_id"]), ("nodes", ["graph_id", "node_id"]), ("edges", ["graph_id", "src", "dst"])):
        rows = [[tuple(r) for r in getattr(d, name).select(*getattr(want, name).columns).orderBy(*key).collect()] for d in (got, want)]
        assert rows[0] == rows[1] and rows[0]
        assert "lineitem" not in getattr(data, name)._jdf.queryExecution().optimizedPlan().toString()
    assert seen and spark.conf.get(shared.CLEANUP, "false") == "false"
