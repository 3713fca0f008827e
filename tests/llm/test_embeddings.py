import numpy as np
from tables import tuples

from examlens.llm.embeddings import CollisionSpec, Projections, calibrated, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, list long, value double, dim int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 1.0, 1) for i, v in rows], SCHEMA)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1, 0, 0]), (2, [2, 0, 0]), (3, [2, 0, 0]), (4, None), (5, []), (6, [0, 0, 0]), (7, [nan, 1, 0]), (8, [inf, 1, 0]), (9, [None, 1, 0]), (10, [1, 0]), (None, [0, 1, 0]), (11, [0, 1, 0.01]), (12, [0, 0, 5]), (12, [0, 0, 5])]
    got = tuples(near_vectors(table(spark, rows)), "vec_id", "n_links", "component_id", "kept")
    want = [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (10, 0, 10, True), (None, 1, 11, False), (11, 1, 11, True), (12, 1, 12, True), (12, 1, 12, True)]
    assert got == sorted(want + [(i, 0, i, True) for i in range(4, 10)], key=repr)
    assert near_vectors(table(spark, [])).count() == 0
    assert near_vectors(table(spark, [(1, None)])).count() == 1


def test_pairs_at_the_threshold_against_brute_force(spark):
    """Pairs just above and below 0.9, chains, and a dense group with copies."""
    rng = np.random.default_rng(4)
    dim, base = 32, rng.standard_normal((500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = list(base)
    for k in range(400):
        x = base[k]
        z = rng.standard_normal(dim)
        z -= (z @ x) * x
        z /= np.linalg.norm(z)
        c = rng.uniform(0.85, 0.96)
        rows.append((c * x + np.sqrt(1 - c * c) * z) * rng.uniform(0.1, 9))
    rows += [base[3] + 0.02 * rng.standard_normal(dim) for _ in range(60)] + [base[4]] * 30
    x = np.array(rows, np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r for r in near_vectors(table(spark, list(enumerate(rows)))).collect()}
    links = np.array([got[i].n_links for i in range(len(rows))])
    assert (links <= near.sum(axis=1)).all()
    assert links.sum() >= 0.97 * near.sum()


def test_calibration_counts_collisions():
    x = np.random.default_rng(1).standard_normal((256, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    made, count = calibrated(x, 100_000, CollisionSpec())
    assert count >= 1 and made.k * made.k * 4 >= 100_000 * 16 / 4
    number, value = Projections(8, 4, 1).lists_of(x)
    assert number.shape == (256, 4) and len(set(number[0])) == 4
    one, two = (x @ d for d in Projections(8, 4, 1).directions(16))
    every = (one[:, :, None] + two[:, None, :]).reshape(256, -1)
    assert np.allclose(np.sort(value, axis=1), np.sort(every, axis=1)[:, -4:])


def planted(rng, n, dim):
    """n unit vectors and a mate for each at a cosine just above 0.9."""
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((n, dim))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return np.concatenate([x, 0.901 * x + np.sqrt(1 - 0.901**2) * z]).astype(np.float32)


def test_every_length_reaches_the_recall(spark):
    """Short vectors are as whole as the commonest length, which alone was calibrated."""
    rng = np.random.default_rng(6)
    parts = [planted(rng, 700, 64), planted(rng, 600, 8), planted(rng, 90, 3), planted(rng, 1, 2)]
    rows = [x for p in parts for x in p]
    got = {r.vec_id: r.n_links for r in near_vectors(table(spark, list(enumerate(rows)))).collect()}
    at = 0
    for p in parts:
        x = p.astype(np.float64) / np.linalg.norm(p.astype(np.float64), axis=1, keepdims=True)
        near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
        links = np.array([got[at + i] for i in range(len(p))])
        assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.98 * near.sum()
        at += len(p)


def test_unreachable_recall_is_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    assert calibrated(unit(rng.standard_normal((1024, 3))), 10_000, CollisionSpec()) is None
    monkeypatch.setattr("examlens.llm.embeddings.BLOCK", 100)
    x = planted(rng, 300, 3)
    got = [r.n_links for r in near_vectors(table(spark, list(enumerate(x))), CollisionSpec(few=10**9)).orderBy("vec_id").collect()]
    y = unit(x.astype(np.float64))
    assert got == ((y @ y.T >= 0.9).sum(axis=1) - 1).tolist()


def test_recall_of_pairs_at_the_threshold():
    assert CollisionSpec().recall >= 0.99
