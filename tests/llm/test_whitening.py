"""Whitening against a decomposition in one place: ill-conditioned, of low rank, repeated, null and non-finite, of odd lengths."""

import numpy as np
from quire.llm import queries, whitening

RNG = np.random.default_rng(3)
BAD = [(900, None), (901, []), (902, [1.0] * 23 + [None]), (903, [float("nan")] * 24), (904, [float("inf")] + [0.0] * 23), (905, [1.0, 2.0])]


def frame(spark, rows):
    given = [(i, v, 1, "x") for i, v in rows]
    return spark.createDataFrame(given, "vec_id long, embedding array<float>, label int, component string")


def brute(rows):
    x = np.floor(np.array([np.float32(v) for _, v in rows]).astype(float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    _, sigma, right = np.linalg.svd(centred, full_matrices=False)
    kept = np.flatnonzero(sigma > 1e-10 * sigma[0])[:16]
    values = (n * x - sums) / n @ right[kept].T / (sigma[kept] / np.sqrt(n))
    return n, ((n * x - sums) ** 2).sum(axis=1), values, sigma[kept] ** 2 / np.sum(sigma**2)


def check(spark, rows, places=1e-6):
    n, deviation, values, explained = brute(rows)
    got = whitening.whitened(frame(spark, rows + BAD)).toPandas().sort_values(["vec_id", "component"], kind="stable")
    assert set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-6
    assert len(got) == len(rows) * len(explained)
    ids = [i for i, _ in rows]
    found = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    signs = np.sign((found * values).sum(axis=0))
    assert np.abs(found - values * signs).max() < places
    assert (got.groupby("vec_id")["deviation"].first().loc[ids].to_numpy() == deviation).all()
    assert np.allclose(got.groupby("component")["explained"].first().to_numpy(), explained, rtol=1e-6)


def test_plain(spark):
    rows = [(k, v.tolist()) for k, v in enumerate((RNG.normal(size=(500, 24)) * np.arange(1, 25) + 7).astype(np.float32))]
    check(spark, rows + [(2000 + k, rows[0][1]) for k in range(300)])


def test_ill_conditioned(spark):
    base = RNG.normal(size=(400, 24)) * np.logspace(0, 6, 24)
    check(spark, [(k, v.tolist()) for k, v in enumerate((base @ np.linalg.qr(RNG.normal(size=(24, 24)))[0]).astype(np.float32))], 1e-4)


def test_low_rank(spark):
    base = RNG.integers(-500, 500, size=(300, 3))
    rows = np.hstack([base / 64, base[:, :1] / 32, np.full((300, 20), 3.0)])
    check(spark, [(k, v.tolist()) for k, v in enumerate(rows.astype(np.float32))])


def test_nothing_to_whiten(spark):
    for rows in ([], BAD, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whitened(frame(spark, rows)).collect() == []
    one = whitening.whitened(frame(spark, [(1, [0.0, 1.0]), (None, [1.0, 1.0]), (1, [0.0, 1.0])])).collect()
    assert [(r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 9), r["explained"]) for r in one] == [(1, 2, 4096, 1.0, 1.0)] * 3


def test_many_partial_sums(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "ROWS", 5)
    rows = [(k, v.tolist()) for k, v in enumerate(RNG.normal(size=(60, 4)).astype(np.float32))]
    model = whitening.fit(whitening.usable(frame(spark, rows).repartition(13)))
    n, *_ = brute(rows)
    assert model.n == n and model.error < 1e-9


def test_query(spark, tmp_path):
    rows = [(k, v.tolist()) for k, v in enumerate(RNG.normal(size=(50, 24)).astype(np.float32))]
    frame(spark, rows + BAD).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.queries()["op13_embedding_whitening"](spark, str(tmp_path))
    assert got.count() == 50 * 16
    assert not got.where("identity_error > 0.0001").count()
