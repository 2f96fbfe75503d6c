"""Groups from pairwise matches: connected components by low-diameter decomposition.

Every round draws for each vertex u a shift d(u) ~ Exp(beta) from a hash of (u, round). Clusters grow from their centres as if
centre c started at time -d(c): a vertex joins the centre that maximises d(c) - distance(c, u). Growth runs for a fixed number of
steps; each cluster is contracted to a super-vertex (its centre), the edges between clusters are relabelled and deduplicated, and the
next round works on those only. The rounds' assignments are composed from the last to the first. A small beta makes the shifts
differ by much more than the growth steps, so that a component within reach of its largest shift is one cluster after one round.

The first growth step needs no join, because a neighbour's shift is a function of its id. Every step is a partially aggregated
max per vertex, so a hub that holds a third of all edges is combined on the map side. Cutting growth short is safe: a vertex only ever
takes the name of a vertex that it is connected to, and what is left between clusters stays an edge of the next round.

Every step is a stage or two, however few edges are left, and the driver's memory grows with the stages. So if a round leaves a few
edges only, one task of an executor ties their ends.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.plans.runtime import cut

#: So many edges, well under a megabyte, are a few.
FEW = 10_000


def _shift(v: Column, rnd: int, beta: float) -> Column:
    # the round is hashed as a text: unlike a number it isn't compiled in, so all rounds share their generated code
    uniform = (F.pmod(F.xxhash64(v, F.lit(f"round {rnd}")), F.lit(1 << 52)) + F.lit(1.0)) / F.lit(float((1 << 52) + 1))
    return -F.log(uniform) / F.lit(beta)


def _clean(edges: DataFrame) -> DataFrame:
    return (
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
    )


def grow(edges: DataFrame, rnd: int, beta: float, steps: int) -> DataFrame:
    """One round of cluster growth: (v, c) for every vertex of `edges`."""
    # every edge both ways, and every vertex with itself, so that a step is one join and one aggregation
    ends = [("src", "dst"), ("dst", "src"), ("src", "src"), ("dst", "dst")]
    both = edges.select(F.explode(F.array(*[F.struct(F.col(u).alias("u"), F.col(w).alias("w")) for u, w in ends])).alias("e")).select("e.u", "e.w")
    far = F.when(F.col("u") == F.col("w"), 0.0).otherwise(1.0)
    label = both.groupBy("u").agg(F.max(F.struct((_shift(F.col("w"), rnd, beta) - far).alias("d"), F.col("w").alias("c"))).alias("best"))
    for _ in range(steps - 1):
        near = both.join(label.withColumnRenamed("u", "w"), "w").select("u", F.struct((F.col("best.d") - far).alias("d"), F.col("best.c").alias("c")).alias("best"))
        label = near.groupBy("u").agg(F.max("best").alias("best"))
    return label.select(F.col("u").alias("v"), F.col("best.c").alias("c"))


def _tied(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(v, c) for every vertex of the few edges (src, dst) of one task."""
    up: dict[int, int] = {}

    def top(v: int) -> int:
        while (u := up.setdefault(v, v)) != v:
            up[v] = up[u]
            v = u
        return v

    for p in parts:
        for a, b in zip(p["src"].tolist(), p["dst"].tolist()):
            lo, hi = sorted((top(a), top(b)))
            up[hi] = lo
    yield pd.DataFrame([(v, top(v)) for v in list(up)], columns=["v", "c"]).astype("int64")


def connected_components(edges: DataFrame, beta: float = 0.002, steps: int = 5, most_steps: int = 16, max_rounds: int = 200) -> DataFrame:
    """(v, component) for every vertex of `edges(src BIGINT, dst BIGINT)`; component is some vertex of v's component.

    Null ends and loops are no edges and repeated edges count once; other columns are ignored. No edges: no rows. A vertex without
    an edge doesn't appear; callers give it its own id. All rounds run on the executors; at most `FEW` edges that a round leaves are
    tied in one task. A round that leaves more than an eighth of its edges (long chains) doubles the growth steps of the next, up to
    `most_steps`.
    """
    edges = cut(_clean(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"))))
    maps: list[DataFrame] = []
    left = edges.count()
    for rnd in range(max_rounds):
        if not left:
            break
        if rnd and left <= FEW:
            maps.append(cut(edges.coalesce(1).mapInPandas(_tied, "v long, c long")))
            break
        assigned = cut(grow(edges, rnd, beta, steps))
        maps.append(assigned)
        a, b = assigned.select(F.col("v").alias("src"), F.col("c").alias("s")), assigned.select(F.col("v").alias("dst"), F.col("c").alias("t"))
        # edges inside a cluster are gone after the joins, mostly all of them
        edges = cut(_clean(edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"))))
        before, left = left, edges.count()
        steps = min(2 * steps, most_steps) if 8 * left > before else steps
    else:
        if left:
            raise RuntimeError(f"not contracted after {max_rounds} rounds")
    if not maps:
        return edges.select(F.col("src").alias("v"), F.col("dst").alias("component"))

    def compose(later: DataFrame, earlier: DataFrame) -> DataFrame:
        return earlier.join(later.select(F.col("v").alias("c"), "component"), "c", "left").select("v", F.coalesce("component", "c").alias("component"))

    last = maps[-1].withColumnRenamed("c", "component")
    return reduce(compose, reversed(maps[:-1]), last)


def star(df: DataFrame, key: str, member: str) -> DataFrame:
    """Edges (src, dst) that tie all members of a key to its smallest one: as many as there are distinct (key, member), never all pairs."""
    pairs = df.where(F.col(key).isNotNull() & F.col(member).isNotNull()).select(key, member).distinct()
    centre = pairs.groupBy(key).agg(F.min(member).alias("src"))
    return pairs.join(centre, key).where(F.col(member) != F.col("src")).select("src", F.col(member).alias("dst"))
