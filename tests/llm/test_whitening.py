"""op12_whitening against numpy and exact integers."""

import math

import numpy as np
import pytest

from talkframe.llm import whitening as wh
from talkframe.llm.op12 import op12_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x string"


def run(spark, path, rows):
    spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    out = op12_whitening(spark, str(path))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return out.toPandas()


def check(got, rows, most=32):
    sound = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    n = len(sound)
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in sound], object)
    s = x.sum(axis=0)
    moved = x * n - s
    c = (moved / n).astype(float)
    cov = c.T @ c / n
    e = np.linalg.eigvalsh(cov)[::-1][:most]
    k = int((e > 1e-12 * e[0]).sum())
    assert len(got) == n * k
    assert set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-6
    dev = {}
    for (i, _), m in zip(sound, moved):
        dev.setdefault(i, []).append(int((m * m).sum()))
    first = got[got.component == 1]
    assert sorted((-1 if i != i else i, -1 if d != d else float(d)) for i, d in zip(first.vec_id, first.deviation)) == sorted(
        (-1 if i is None else i, -1 if d >= 1 << 63 else float(d)) for i, ds in dev.items() for d in ds)
    shares = got.groupby("component").explained.agg(["min", "max"])
    assert (shares["min"] == shares["max"]).all()
    assert np.allclose(shares["min"], e[:k] / np.trace(cov), rtol=1e-6)
    # the whitened rows are the centred ones times one matrix: its columns are eigenvectors over sqrt(e)
    ids = [i for i, _ in sound if i is not None and len(dev[i]) == 1]
    z = got[got.vec_id.isin(ids)].pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    at = [j for j, (i, _) in enumerate(sound) if i is not None and len(dev[i]) == 1]
    w = np.linalg.lstsq(c[at], z, rcond=None)[0]
    assert np.allclose(c[at] @ w, z, atol=1e-7)
    assert np.allclose(cov @ w, w * e[:k], atol=1e-6 * e[0])
    return k


@pytest.mark.parametrize("dims,values", [(5, 1 << 16), (40, 640)])
def test_query_against_numpy(spark, tmp_path, monkeypatch, dims, values):
    monkeypatch.setattr(wh, "BLOCK_VALUES", values)  # many small blocks, the last of a task filled up
    monkeypatch.setattr(wh, "BLOCK_COLUMNS", 17)
    rng = np.random.default_rng(dims)
    data = rng.normal(size=(150, dims)) @ rng.normal(size=(dims, dims)) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(900, None), (901, [1.0] * (dims - 1) + [None]), (902, [float("nan")] * dims), (903, [float("inf")] + [0.0] * (dims - 1)),
             rows[3], rows[3], (None, rows[4][1]), (-5, rows[5][1])]
    assert check(run(spark, tmp_path, rows), rows) == min(32, dims)


def test_rank_ends_the_components(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, [float(a), float(2 * a), float(b), 7.0]) for i, (a, b) in enumerate(rng.integers(-50, 50, (60, 2)))]
    assert check(run(spark, tmp_path, rows), rows) == 2


def test_weak_component_keeps_its_precision(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a) * 4000, float(a) * 4000 + float(b) / 64]) for i, (a, b) in enumerate(rng.integers(-50, 50, (400, 2)))]
    check(run(spark, tmp_path, rows), rows)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [])], [(1, [1.0, 2.0])] * 4])
def test_no_components(spark, tmp_path, rows):
    assert len(run(spark, tmp_path, rows)) == 0


def test_other_lengths_are_left_out(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    check(run(spark, tmp_path, rows + [(100, [1.0, 2.0]), (101, [1.0] * 4)]), rows)


def test_exact_numbers_beyond_a_long():
    big = np.array([[1 << 40, 3], [1, 2]], np.int64)
    assert wh.deviations(big).tolist() == [-1, 5]
    ids = [None, 5, -3, (1 << 62) + 1]
    dev = np.array([0, 1, (1 << 60) + 7, 9], np.int64)
    held, ih, il, dh, dl = wh.carried(ids, dev).astype(np.int64).T
    assert held.tolist() == [2, 1, 1, 1] and ((ih << 32) + il).tolist() == [0, 5, -3, (1 << 62) + 1]
    assert ((dh << 32) + dl).tolist() == dev.tolist()
