"""Similar vectors (p6): quantiser, recall and exactness against brute force, copies and dirty rows."""

import numpy as np
import pyarrow as pa

from chronodoc.llm import anisotropic, similar

DOCS = "id string, embedding array<double>, sequence long, vec int, cls int"


def brute(cur, k=3, wanted=0.8):
    ids = sorted(cur, key=lambda s: s.encode())
    x = np.array([cur[i] for i in ids])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 6)
    out = set()
    for a in range(len(ids)):
        order = [b for b in np.lexsort((np.arange(len(ids)), -s[a])) if b != a][:k]
        out |= {(ids[min(a, b)], ids[max(a, b)]) for b in order if s[a, b] >= wanted}
    return sorted(out)


def clustered(n, seed=3, spread=0.25, of=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // of, 64))
    return centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, 64))


def test_small_and_dirty(spark, rows):
    x = clustered(120)
    cur = {f"v{i}": list(map(float, v)) for i, v in enumerate(x)}
    for i in range(30):
        cur[f"copy{i}"] = [3.5 * y for y in cur["v0"]]  # scaled copies
    data = [(i, v, 5, 1, 1) for i, v in cur.items()] + [(i, list(map(float, np.ones(64))), 4, 1, 1) for i in list(cur)[:10]]
    nan, null = [float("nan")] + [1.0] * 63, [None] + [1.0] * 63
    data += [("n", None, 1, 1, 1), ("e", [], 1, 1, 1), ("s", [1.0] * 63, 1, 1, 1), ("z", [0.0] * 64, 1, 1, 1), ("nan", nan, 1, 1, 1), ("null", null, 1, 1, 1), (None, [1.0] * 64, 1, 1, 1)]
    data += data[:5]  # repeated rows
    df = spark.createDataFrame(data, DOCS)
    assert rows(similar.nearest_pairs(df)) == brute(cur)
    assert similar.nearest_pairs(df.limit(0)).count() == 0
    assert similar.nearest_pairs(df.where("id = 'v1'")).count() == 0


def test_recall_with_cells(spark, rows):
    x = clustered(4000, seed=9, spread=0.3)
    cur = {f"v{i}": list(map(float, v)) for i, v in enumerate(x)}
    got = set(rows(similar.nearest_pairs(spark.createDataFrame([(i, v, 1, 0, 0) for i, v in cur.items()], DOCS))))
    want = set(brute(cur))
    assert anisotropic.coarse_cells(4000) > 1 and len(want) > 3000
    assert len(got & want) / len(want) > 0.99 and len(got - want) / len(want) < 0.01


def test_exact_nearest_agrees(spark):
    x = clustered(300)
    cur = {f"v{i}": list(map(float, v)) for i, v in enumerate(x)}
    unit = similar.valid_vectors(spark.createDataFrame([(i, v, 1, 0, 0) for i, v in cur.items()], DOCS))
    got = {(min(r["id"], r["other"]), max(r["id"], r["other"])) for r in similar.exact_nearest(unit, unit, block=128).where("sim >= 0.8").collect()}
    assert sorted(got) == brute(cur)


def test_score_aware_codes_keep_inner_products_better():
    x = clustered(3000, seed=1).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    m = anisotropic.train(x, 16)
    cell = (x @ m.centres.T).argmax(1)
    aware = m.encode(x, cell)
    plain = anisotropic.Model(m.centres, m.books, 1.0).encode(x, cell)
    along = lambda c: np.abs(((x - m.decode(c, cell)) * x).sum(1)).mean()
    assert along(aware) < along(plain)
    packed, q = m.pack(aware), x[:5]
    scan = sum(m.tables(q)[:, j][:, packed[:, j]] for j in range(packed.shape[1])) + (q @ m.centres.T)[:, cell]
    assert np.allclose(scan, q @ m.decode(aware, cell).T, atol=1e-4)
    err = np.linalg.norm(x - m.decode(aware, cell), axis=1)
    assert (np.abs(scan - q @ x.T) <= err + 1e-4).all()


def test_every_pair_of_a_dense_third(spark, rows):
    rng = np.random.default_rng(4)
    for noise in (0.05, 1e-7):  # cosines of about 0.86; all cosines 1.000000, but no copies
        x = clustered(6000, seed=6, spread=0.3)
        middle = rng.normal(size=64)
        x[::3] = middle / np.linalg.norm(middle) + noise * rng.normal(size=(2000, 64))
        cur = {f"v{i}": list(map(float, v)) for i, v in enumerate(x)}
        got = rows(similar.nearest_pairs(spark.createDataFrame([(i, v, 1, 0, 0) for i, v in cur.items()], DOCS)))
        assert got == brute(cur)


def test_asks_are_not_bounded_by_a_number():
    rng = np.random.default_rng(8)
    x = rng.normal(size=64) + 0.4 * rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    m = anisotropic.train(x.astype(np.float32), 400)
    lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * 64, pa.array(x.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(x))]), lists], names=["rep", "vec"])
    placed = pa.Table.from_batches(similar._index(m)([batch]))
    home, angle = placed["unit"].to_numpy(), placed["angle"].to_numpy()
    unit, at = np.unique(home, return_inverse=True)
    low, high = (np.array([f(angle[at == i]) for i in range(len(unit))]) for f in (np.min, np.max))
    asks = pa.Table.from_batches(similar._ask(m, unit, low, high, np.arange(len(unit)), np.ones(len(unit), int), 0.8)([batch]))["asks"].to_pylist()
    s = x @ x.T
    assert all(set(at[s[i] >= 0.8]) <= set(asks[i]) for i in range(len(x)))
    assert max(len(set(at[s[i] >= 0.8])) for i in range(len(x))) > 24


def test_small_inputs_have_cells_too(spark, rows):
    assert [anisotropic.coarse_cells(n) for n in (0, 1, 2, 90, 450, 2000)] == [1, 1, 2, 18, 42, 89]
    rng = np.random.default_rng(2)
    x = clustered(450, seed=2, spread=0.3)
    x[::3] = rng.normal(size=64) + 0.4 * rng.normal(size=(150, 64))
    cur = {f"v{i}": list(map(float, v)) for i, v in enumerate(x)}
    for part in (cur, dict(list(cur.items())[:2]), dict(list(cur.items())[:7])):
        got = rows(similar.nearest_pairs(spark.createDataFrame([(i, v, 1, 0, 0) for i, v in part.items()], DOCS)))
        assert got == brute(part)


def test_two_level_cells(spark, rows, monkeypatch):
    x = clustered(3000, seed=12, spread=0.3)
    unit = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    monkeypatch.setattr(anisotropic, "ONE_LEVEL", 16)
    two = anisotropic.cell_centres(unit, 100)
    assert two.shape == (100, 64) and np.allclose(np.linalg.norm(two, axis=1), 1, atol=1e-4)
    served = lambda c: (unit @ c.T).max(1).mean()
    assert served(two) > served(anisotropic.spherical_kmeans(unit, 100)) - 0.05
    cur = {f"v{i}": list(map(float, v)) for i, v in enumerate(x[:900])}
    assert rows(similar.nearest_pairs(spark.createDataFrame([(i, v, 1, 0, 0) for i, v in cur.items()], DOCS))) == brute(cur)


def test_more_neighbours_than_three(spark, rows):
    x = clustered(400, seed=3, spread=0.25, of=40)
    cur = {f"v{i}": list(map(float, v)) for i, v in enumerate(x)}
    df = spark.createDataFrame([(i, v, 1, 0, 0) for i, v in cur.items()], DOCS)
    for k in (10, 20):
        assert rows(similar.nearest_pairs(df, k=k)) == brute(cur, k)


def test_names_tell_rows_apart():
    x = np.round(np.random.default_rng(1).normal(size=(5000, 64)), 12)
    y = x.copy()
    y[:, 7] += 1e-12
    names = similar._names(np.concatenate([x, x, y]))
    assert names[:5000] == names[5000:10000] and len(set(names)) == 10000 and {len(n) for n in names} == {32}
