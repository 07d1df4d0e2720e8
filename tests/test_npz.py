"""Archives by ranges: the same tables as whole archives give, and no more bytes read than a range has."""

from __future__ import annotations

import io

import numpy as np
import pytest

from pairloom.sources import datasets, npz


def archive(path, n, seed=1, compressed=False, **more):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 6, n)
    v, a = np.zeros((n, 6, 34), np.float32), np.zeros((n, 6, 4, 6), np.float32)
    for i, k in enumerate(size):
        v[i, :k] = rng.random((k, 34))
        for _ in range(k):
            x, y = rng.integers(0, k, 2)
            a[i, x, rng.integers(4), y] = 1
    arrays = {"V": v, "A": a, "labels": rng.integers(0, 4, n).astype(np.int32), "masks": np.ones((n, 6, 1), np.float32), "graph_size": size.astype(np.int32), "tags": np.array([f"tag{i}" for i in range(n)]), "subgraph_size": np.stack([size, size * 0], 1).astype(np.int32)} | more
    (np.savez_compressed if compressed else np.savez)(path, **{k: x for k, x in arrays.items() if x is not None})
    return {k: x for k, x in arrays.items() if x is not None}


def tables(data):
    return [sorted(map(str, t.collect())) for t in (data.graphs, data.nodes, data.edges)]


@pytest.mark.parametrize("compressed", [False, True])
def test_ranges_give_the_tables_of_whole_archives(spark, tmp_path, compressed):
    archive(tmp_path / "a.npz", 23, 1, compressed), archive(tmp_path / "b.npz", 5, 2, compressed)
    want = tables(datasets.read_npz(spark, str(tmp_path)))
    assert len(want[0]) == 28
    for range_bytes, slice_bytes in ((1, 1), (10_000, 3000), (1 << 30, 1 << 30)):
        d = npz.graphs(spark, str(tmp_path), range_bytes, slice_bytes)
        assert d.rdd.getNumPartitions() == (2 if compressed or range_bytes > 1 << 20 else 28 if range_bytes == 1 else 5)
        assert tables(npz.read(spark, str(tmp_path), range_bytes, slice_bytes)) == want
    assert tables(npz.read(spark, f"file://{tmp_path}/b.npz"))[0] == [x for x in want[0] if "b.npz" in x]


class Counted(io.BytesIO):
    n = 0

    def read(self, size=-1):
        data = super().read(size)
        self.n += len(data)
        return data


def test_a_range_reads_its_bytes_only(tmp_path):
    arrays = archive(tmp_path / "a.npz", 400)
    file = Counted((tmp_path / "a.npz").read_bytes())
    found = npz.members(file)
    planned = file.n
    parts = npz.planned("a", found, 20 * sum(m.row_bytes for m in found.values()))
    assert [(p.start, p.stop) for p in parts] == [(i, i + 20) for i in range(0, 400, 20)]
    file.n = 0
    got = list(npz.slices(file, found, 40, 60, 1))
    assert len(got) == 20 and file.n == 20 * sum(m.row_bytes for m in found.values())
    assert all(np.array_equal(z[k][0], arrays[k][first]) for first, z in got for k in z)
    assert planned < 0.1 * len(file.getvalue())


def test_without_sizes_of_parts_and_of_no_graphs(spark, tmp_path):
    archive(tmp_path / "a.npz", 3, subgraph_size=None)
    assert {(r.n1, r.n2) for r in npz.read(spark, str(tmp_path / "a.npz")).graphs.collect()} == {(None, None)}
    archive(tmp_path / "none.npz", 0)
    assert npz.read(spark, str(tmp_path / "none.npz")).graphs.collect() == []


def test_what_is_refused(tmp_path):
    def error(**more):
        archive(tmp_path / "x.npz", 3, **more)
        with pytest.raises(ValueError) as e, open(tmp_path / "x.npz", "rb") as f:
            npz.members(f)
        return str(e.value)

    assert "pickled" in error(tags=np.array(["a", None, 1], dtype=object))
    assert "missing" in error(V=None)
    assert "different numbers" in error(labels=np.zeros(4, np.int32))
    with pytest.raises(FileNotFoundError):
        npz.archives(str(tmp_path / "no"))
