import numpy as np
from pyspark.sql import functions as F

from lectern.llm.vectors import may_hold, nearest, p4_found, scan
from lectern.plans.runtime import table


def brute(x, k):
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1)[:, :k], s


def test_scan_is_exact_where_nothing_is_abandoned():
    x = np.random.default_rng(1).standard_normal((3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j, d = scan(x[:50], x, 10, 4.1, eps=50.0)
    top, _ = brute(x, 10)
    got = {}
    for a, b in zip(i, j):
        got.setdefault(a, set()).add(b)
    assert all(set(top[a]) <= got[a] for a in range(50))


def test_recall(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.standard_normal(64) + 0.6 * rng.standard_normal((40, 64)) for _ in range(60)])
    df = spark.createDataFrame([(f"w{i:05d}", [float(v) for v in r], "x") for i, r in enumerate(x)], "work_id string, vector array<float>, rank string")
    got = {(r.work_id, r.neighbour) for r in nearest(df, "work_id", "vector").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    top, _ = brute(u, 10)
    hit = sum((f"w{i:05d}", f"w{j:05d}") in got for i in range(len(x)) for j in top[i])
    assert hit >= 0.9 * top.size and len(got) == top.size


def test_query_matches_brute_force(spark, sf):
    v = [(r.work_id, r.vector) for r in table(spark, sf, "work_vectors").collect() if r.vector is not None and len(r.vector) == 64 and any(r.vector)]
    x = np.array([a for _, a in v], float)
    top, s = brute(x / np.linalg.norm(x, axis=1, keepdims=True), 10)
    want = {tuple(sorted((v[i][0], v[j][0]))) for i in range(len(v)) for j in top[i] if s[i, j] >= 0.9}
    assert {tuple(r) for r in p4_found(spark, sf).collect()} == want


def test_edge_cases(spark):
    one = [1.0] + [0.0] * 63
    rows = [("a", one), ("b", [2 * x for x in one]), ("c", None), ("d", [0.0] * 64), ("e", one[:9]), ("f", [float("nan")] + one[1:]), ("g", one), ("g", one), (None, one)]
    df = spark.createDataFrame(rows, "work_id string, vector array<float>")
    got = nearest(df, "work_id", "vector").collect()
    assert {r.work_id for r in got} == {"a", "b", "g", None} and all(abs(r.cosine - 1) < 1e-6 for r in got) and len(got) == 20
    assert nearest(df.limit(0), "work_id", "vector").count() == 0 and nearest(df.where(F.col("work_id") == "a"), "work_id", "vector").count() == 0


def test_lists_that_may_hold_near_vectors():
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    q, centre = unit(rng.standard_normal((3000, 64))), unit(rng.standard_normal((80, 64)))
    r = rng.standard_normal(q.shape)
    r = unit(r - (r * q).sum(1, keepdims=True) * q)
    x = 0.9 * q + np.sqrt(1 - 0.81) * r
    dots = q @ centre.T
    near = np.argsort(-dots, axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centre @ centre.T))
    asked = may_hold(dots, near, apart, 0.9, 64)
    place = (near == (x @ centre.T).argmax(1)[:, None]).argmax(1)
    assert asked[np.arange(len(q)), place].mean() > 0.999 and asked[:, 0].all() and asked.mean() < 0.9
    assert may_hold(dots, near, apart, -1.0, 64).all()
