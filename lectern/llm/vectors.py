"""Problem 4: the k most similar vectors of every vector.

An inverted index over unit vectors (centroids fitted on a bounded sample, every vector indexed) with an adaptive dimension scan inside
each probed list: all vectors are turned by one seeded random rotation, so that any leading block of dimensions is an unbiased sample
of the distance. The scan reads the rotated dimensions in column blocks and abandons a candidate as soon as its partial distance
rejects, at significance `eps`, the hypothesis that it is within the query's current k-th distance.

Lists are split into chunks of bounded size on both sides (data and queries), so a list that holds a third of all vectors is many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.plans.runtime import cut, table

BLOCKS = 4


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, seed: int = 11, rounds: int = 12) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


def scan(q: np.ndarray, x: np.ndarray, k: int, limit: float, eps: float = 2.1, first: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, squared distance) of up to k + 1 candidates per query within `limit` (one more, as a query may meet itself).

    The first candidates are compared in full and set each query's k-th distance; later ones pass block by block.
    """
    dim, k = x.shape[1], k + 1
    qs, cs, ds = [], [], []
    bound = np.full(len(q), limit, np.float32)
    ends = [dim * (b + 1) // BLOCKS for b in range(BLOCKS)]
    for start in range(0, len(x), first):
        part = x[start : start + first]
        if start == 0 and limit >= 4:
            i, j = np.divmod(np.arange(len(q) * len(part)), len(part))
            d = (2 - 2 * (q @ part.T)).ravel()
        else:
            head = ends[0]
            d = (q[:, :head] ** 2).sum(1)[:, None] + (part[:, :head] ** 2).sum(1)[None] - 2 * (q[:, :head] @ part[:, :head].T)
            i, j = np.nonzero(d <= (bound * (head / dim) * (1 + eps / math.sqrt(head)) ** 2)[:, None])
            d = d[i, j]
            for a, b in zip(ends, ends[1:]):
                if not len(i):
                    break
                if len(i) > len(q) * len(part) // 8 and a == ends[0]:
                    d, a, b = 2 - 2 * (q @ part.T)[i, j], dim, dim
                else:
                    d = d + ((q[i, a:b] - part[j, a:b]) ** 2).sum(1)
                share = b / dim
                keep = d <= bound[i] * (share * (1 + eps / math.sqrt(b)) ** 2 if b < dim else 1)
                i, j, d = i[keep], j[keep], d[keep]
                if b == dim:
                    break
        qs, cs, ds = [np.concatenate([*qs, i])], [np.concatenate([*cs, j + start])], [np.concatenate([*ds, d.astype(np.float32)])]
        # the k best of each query so far
        order = np.lexsort((cs[0], ds[0], qs[0]))
        qi = qs[0][order]
        begin = np.searchsorted(qi, np.arange(len(q)))
        place = np.arange(len(qi)) - begin[qi]
        order = order[place < k]
        qs, cs, ds = [qs[0][order]], [cs[0][order]], [ds[0][order]]
        full = np.bincount(qs[0], minlength=len(q)) >= k
        worst = np.full(len(q), -1, np.float32)
        np.maximum.at(worst, qs[0], ds[0])
        bound = np.where(full, np.minimum(bound, worst), bound).astype(np.float32)
    keep = ds[0] <= limit if qs else []
    return (qs[0][keep], cs[0][keep], ds[0][keep]) if qs else (np.empty(0, int),) * 3


def may_hold(dots: np.ndarray, near: np.ndarray, apart: np.ndarray, min_cosine: float, dim: int, sigmas: float = 4.0) -> np.ndarray:
    """Which of the lists `near` (nearest first) may hold a vector within `min_cosine` of each query? dots: the lists' cosines with the queries,
    apart: distances of the centroids.

    A vector x = c q + s r, r of length 1 at right angles to q, is in another list than q's nearest only if r leans to that centroid by so
    much as q leans away from it; r in a random direction does so within some standard deviations."""
    if min_cosine <= 0:
        return np.ones(near.shape, bool)
    gap = np.take_along_axis(dots, near[:, :1], 1) - np.take_along_axis(dots, near, 1)
    reach = sigmas * math.sqrt(max(0.0, 1 - min_cosine**2) / max(1, dim - 1))
    return min_cosine * gap <= reach * apart[near[:, :1], near] + 1e-6


def nearest(df: DataFrame, key: str, vector: str, k: int = 10, dim: int = 64, min_cosine: float = -1.0, probes: int = 16, probe_share: float = 0.16, sample_rows: int = 20_000, chunk: int = 2048) -> DataFrame:
    """(key, neighbour, rank, cosine): the k most similar vectors of every vector by cosine, those of at least min_cosine only.

    Null, all-zero, non-finite vectors and those of another length than `dim` take no part, as queries or as answers. Rows with equal
    keys are different vectors; equal similarities rank in no particular, but in a repeatable order. Other columns are ignored.
    There are about sqrt(n) / 2 lists, fitted on at most `sample_rows` vectors or four for each list; each query probes `probes` of them
    or the share `probe_share`, whichever is more, as a fixed number would find less the more lists there are; with a `min_cosine` only
    those of them that may hold a vector so near (`may_hold`).
    An empty table gives no rows.
    """
    spark = df.sparkSession
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("v"), norm.alias("norm")).where((F.size("v") == dim) & (F.col("norm") > 0) & (F.col("norm") < float("inf")) & ~F.isnan("norm"))
    rows = rows.where(~F.exists("v", lambda x: x.isNull()))
    n = rows.count()
    schema = "key string, neighbour string, rank int, cosine double"
    if n < 2:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    turn = rotation(dim)

    def unit(v: pd.Series, norms: pd.Series) -> np.ndarray:
        return ((np.stack(v.to_numpy()).astype(np.float64) / norms.to_numpy()[:, None]) @ turn).astype(np.float32)

    lists = max(1, round(math.sqrt(n) / 2))
    sample_rows = max(sample_rows, 4 * lists)
    share = min(1.0, 1.5 * sample_rows / n)
    picked = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample_rows).toPandas()
    lists = min(lists, len(picked))
    centre = centroids(unit(picked["v"], picked["norm"]), lists) if lists else np.zeros((1, dim), np.float32)
    lists = len(centre)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centre @ centre.T))
    probed = min(max(probes, math.ceil(probe_share * lists)), lists)

    def place(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                u = unit(p["v"], p["norm"])
                dots = u @ centre.T
                near = np.argsort(-dots, axis=1, kind="stable")[:, :probed]
                asked = may_hold(dots, near, apart, min_cosine, dim)
                yield pd.DataFrame({"n": p["n"], "key": p["key"], "u": [x.tobytes() for x in u], "list": near[:, 0].astype("int32"), "probes": [x[a] for x, a in zip(near.astype("int32"), asked)]})

    # the number given to a row holds from here on, because it is written
    base = cut(rows.withColumn("n", F.monotonically_increasing_id()).mapInPandas(place, "n long, key string, u binary, list int, probes array<int>"))
    size = {r["list"]: r["count"] for r in base.groupBy("list").count().collect()}  # a row per list
    asked = {r["list"]: r["count"] for r in base.select(F.explode("probes").alias("list")).groupBy("list").count().collect()}
    plan = spark.createDataFrame([(i, -(-size[i] // chunk), -(-asked.get(i, 0) // (4 * chunk))) for i in size], "list int, dc int, qc int")
    salt = F.xxhash64("n", F.lit("chunk"))
    data = base.join(F.broadcast(plan), "list").where("qc > 0").select(F.col("n").alias("vn"), F.col("u").alias("vu"), F.col("list").alias("vl"), F.pmod(salt, "dc").alias("vd"), F.explode(F.sequence(F.lit(0), F.col("qc") - 1)).alias("vq"))
    query = base.select("n", "u", F.explode("probes").alias("list")).join(F.broadcast(plan), "list").select("n", "u", "list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("dc").cast("long") - 1)).alias("d"), F.pmod(salt, "qc").cast("int").alias("q"))
    limit = 4.1 if min_cosine <= -1 else 2 - 2 * min_cosine + 1e-6

    def match(_key: tuple, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(vectors):
            return pd.DataFrame({"q": [], "n": [], "d": []})
        vectors = vectors.sort_values("vn")
        qn, xn = queries["n"].to_numpy(), vectors["vn"].to_numpy()
        q, x = (np.frombuffer(b"".join(t), np.float32).reshape(-1, dim) for t in (queries["u"], vectors["vu"]))
        i, j, d = scan(q, x, k, limit)
        other = qn[i] != xn[j]
        return pd.DataFrame({"q": qn[i[other]], "n": xn[j[other]], "d": d[other]})

    found = query.groupBy("list", "d", "q").cogroup(data.groupBy("vl", "vd", "vq")).applyInPandas(match, "q long, n long, d float")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "n"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    names = base.select("n", "key")
    out = best.join(names.withColumnRenamed("key", "neighbour"), "n").select(F.col("q").alias("n"), "neighbour", "rank", (1 - F.col("d").cast("double") / 2).alias("cosine")).join(names, "n")
    return out.where(F.col("cosine") >= min_cosine).select(F.col("key").alias(key), "neighbour", "rank", "cosine")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest(table(spark, sf_dir, "work_vectors"), "work_id", "vector", min_cosine=0.9)
    return near.where(F.col("work_id") != F.col("neighbour")).select(F.least("work_id", "neighbour").alias("work_id_a"), F.greatest("work_id", "neighbour").alias("work_id_b")).distinct()


def p4_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar works of every work."""
    return nearest(table(spark, sf_dir, "work_vectors"), "work_id", "vector").withColumn("cosine", F.round("cosine", 4))
