"""Directed graphs as edge tables (src, dst).

Everything is a join or an aggregation. What needs rounds (distances, reachability) keeps only the changed frontier, is cut to the shared
checkpoint folder after each round, and brings nothing but an emptiness test to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.series import places
from lectern.plans.runtime import cut


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).union(edges.select(F.col("dst").alias("v"))).distinct()


def roots(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).distinct().join(edges.select(F.col("dst").alias("v")), "v", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("v")).distinct().join(edges.select(F.col("src").alias("v")), "v", "left_anti")


def one_way(edges: DataFrame, order: str) -> DataFrame:
    """Of each unordered pair of vertices the direction that comes first by `order`, with all its edges."""
    w = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst")).orderBy(order, "src")
    first = edges.withColumn("_f", F.first("src").over(w))
    return first.where(F.col("src") == F.col("_f")).drop("_f")


def neighbours(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(v, direction, other): parents and children of the given vertices."""
    out = of.join(edges, of.v == edges.src).select("v", F.lit("child").alias("direction"), F.col("dst").alias("other"))
    return out.unionByName(of.join(edges, of.v == edges.dst).select("v", F.lit("parent").alias("direction"), F.col("src").alias("other")))


def _walked(pairs: DataFrame, front: DataFrame, measure: str, again: bool, max_rounds: int) -> DataFrame:
    """(v, measure): the vertices met from `front(v)` on, with the last (again) or first round in which they were.

    A round writes its frontier only; what was met before isn't written again, but for a merge of every sixteen frontiers."""
    best = F.max if again else F.min
    met = [cut(front.select("v", F.lit(0).alias(measure)))]
    front = met[0].select("v")
    for step in range(1, max_rounds + 1):
        following = front.join(pairs, front.v == pairs.src).select(F.col("dst").alias("v")).distinct()
        if not again:
            following = following.join(reduce(DataFrame.union, met), "v", "left_anti")
        rows = cut(following.withColumn(measure, F.lit(step)))
        front = rows.select("v")
        if front.isEmpty():
            return reduce(DataFrame.union, met).groupBy("v").agg(best(measure).alias(measure))
        met.append(rows)
        if len(met) > 16:
            met = [cut(reduce(DataFrame.union, met).groupBy("v").agg(best(measure).alias(measure)))]
    raise ValueError("the graph has a cycle" if again else f"not all is reached within {max_rounds} rounds")


def _pairs(edges: DataFrame) -> DataFrame:
    return cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())


def longest_distances(edges: DataFrame, source: int, max_rounds: int = 10_000) -> DataFrame:
    """(v, distance): the number of edges on the longest path from `source`, null for vertices that it doesn't reach.

    The graph must be acyclic: a walk of more than `max_rounds` edges is an error. Each round moves the frontier one edge on, so the last
    round in which a vertex is met is its longest distance."""
    pairs = _pairs(edges)
    seen = _walked(pairs, edges.sparkSession.createDataFrame([(source,)], "v long"), "distance", True, max_rounds)
    return vertices(pairs).join(seen, "v", "left")


def topological(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(v, level, place): an order of all vertices in which every edge leads on: by level, which is the longest distance from any root,
    then by vertex; places count from 1. Cycles are an error."""
    pairs = _pairs(edges)
    level = _walked(pairs, roots(pairs), "level", True, max_rounds)
    every = vertices(pairs).join(level, "v", "left").withColumn("level", F.coalesce("level", F.lit(-1)))
    if not every.where("level < 0").isEmpty():
        raise ValueError("the graph has a cycle")
    return places(every, F.col("level").asc(), F.col("v").asc())


def longest_path(edges: DataFrame, source: int, order: str) -> DataFrame:
    """(pos, v): the longest path from `source`, walked back from the farthest vertex (the smallest of several) to the parent whose
    distance is largest, the first by `order` on ties. Every vertex points to that parent, and the pointers are doubled, so a path
    of n vertices takes log n joins."""
    far = cut(longest_distances(edges, source).where("distance is not null"))
    end = far.orderBy(F.col("distance").desc(), "v").limit(1)
    a, b = far.select(F.col("v").alias("src"), F.col("distance").alias("d")), far.select(F.col("v").alias("dst"), F.col("distance").alias("e"))
    back = edges.select("src", "dst", F.col(order).alias("_o")).join(a, "src").join(b, "dst").where("d = e - 1")
    jump = cut(back.groupBy("dst").agg(F.min_by("src", F.struct("_o", "src")).alias("to")).select(F.col("dst").alias("v"), "to"))
    path = cut(end.select("v"))
    steps = far.agg(F.max("distance")).first()[0] or 0
    for _ in range(int(steps).bit_length()):
        path = cut(path.union(path.join(jump, "v").select(F.col("to").alias("v"))).distinct())
        jump = cut(jump.join(jump.select(F.col("v").alias("to"), F.col("to").alias("beyond")), "to").select("v", F.col("beyond").alias("to")))
    return path.join(far, "v").select(F.col("distance").alias("pos"), "v")


def main_chain(edges: DataFrame, kinds: DataFrame, shown: list[str], order: str = "src") -> tuple[DataFrame, DataFrame]:
    """((pos, v), (dst, src)) of the diagram that `kinds(v, kind)` shows: the edges contracted to the vertices of the kinds `shown`, the longest
    path from the root (the smallest of several) on, and for every vertex of it the one from which a skip edge leads there."""
    kept = cut(contract(edges, kinds.where(F.col("kind").isin(*shown)).select("v")))
    first = roots(kept).agg(F.min("v").alias("v")).first().v
    if first is None:
        none = edges.sparkSession
        return none.createDataFrame([], "pos int, v long"), none.createDataFrame([], "dst long, src long")
    path = cut(longest_path(kept, first, order))
    skips = skip_edges(kept, path).groupBy("dst").agg(F.max("src").alias("src"))
    return path, skips


def skip_edges(edges: DataFrame, path: DataFrame) -> DataFrame:
    """(src, dst): the edges between vertices of a path that pass over its next vertex, from vertices with several children."""
    a, b = path.select(F.col("v").alias("src"), F.col("pos").alias("p")), path.select(F.col("v").alias("dst"), F.col("pos").alias("q"))
    many = edges.groupBy("src").agg(F.countDistinct("dst").alias("n")).where("n > 1").select("src")
    return edges.join(a, "src").join(b, "dst").where("q <> p + 1").join(many, "src", "left_semi").select("src", "dst").distinct()


def reached(edges: DataFrame, source: int, max_rounds: int = 10_000) -> DataFrame:
    """(v, depth): every vertex that `source` reaches, with the length of the shortest way. Cycles are allowed; ways of more than
    `max_rounds` edges are an error."""
    return _walked(_pairs(edges), edges.sparkSession.createDataFrame([(source,)], "v long"), "depth", False, max_rounds)


def depth_first(edges: DataFrame, component: str, order: str) -> DataFrame:
    """(component, pos, v): pre-order of a depth-first walk from the single root of each component, children by `order`, every vertex once.
    Components with no root or several give no rows. The walk is sequential, so each component is one group of `applyInPandas`;
    a component must fit into a task, which holds for diagrams and folders but not for a graph with one giant component."""
    kind = dict(edges.dtypes)[component]

    def run(part):
        import pandas as pd

        part = part.sort_values(list(dict.fromkeys([order, "dst"])))
        children = part.groupby("src", sort=False)["dst"].apply(list).to_dict()
        tops = sorted(set(children) - set(part["dst"]))
        out, seen, stack = [], set(), tops[::-1] if len(tops) == 1 else []
        while stack:
            v = stack.pop()
            if v not in seen:
                seen.add(v)
                out.append(v)
                stack += [c for c in reversed(children.get(v, [])) if c not in seen]
        return pd.DataFrame({component: part[component].iloc[0], "pos": range(len(out)), "v": out}).astype({"pos": "int32", "v": "int64"})

    return edges.select(component, *dict.fromkeys([order, "src", "dst"])).groupBy(component).applyInPandas(run, f"{component} {kind}, pos int, v long")


def contract(edges: DataFrame, visible: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(src, dst): the edges between visible vertices, directly or over hidden ones only; chains of more than `max_rounds` hidden ones are
    an error."""
    pairs = cut(edges.select("src", "dst").distinct())
    shown = visible.select("v").distinct()
    ways = cut(pairs.join(shown.withColumnRenamed("v", "src"), "src", "left_semi"))
    past, done = ways, None
    for _ in range(max_rounds):
        ready = ways.join(shown.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst")
        done = cut(ready if done is None else done.unionByName(ready).distinct())
        through = ways.join(shown.withColumnRenamed("v", "dst"), "dst", "left_anti").select(F.col("src").alias("s"), F.col("dst").alias("mid"))
        further = through.join(pairs, through.mid == pairs.src).select(F.col("s").alias("src"), "dst").distinct()
        ways = cut(further.join(past, ["src", "dst"], "left_anti"))
        past = cut(past.unionByName(ways))
        if ways.isEmpty():
            return done.where("src <> dst")
    raise ValueError(f"hidden vertices in a cycle or a chain of more than {max_rounds}")
