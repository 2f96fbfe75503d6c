import random
from datetime import datetime

import brute
import pytest
from pyspark.sql import functions as F

from lectern.llm.bundles import bundle_groups, p1_found
from lectern.llm.components import connected_components
from lectern.llm.survivors import p5_found, survivors
from lectern.plans.runtime import table

B = "id long, work_id string, doi string, label string"
W = "id long, alternate_dois string, component string"


def test_p1_matches_union_find(spark, sf):
    b = [tuple(r) for r in table(spark, sf, "raw_bundles").select("id", "work_id", "doi").collect()]
    w = [r[0] for r in table(spark, sf, "normalized_works").select("alternate_dois").collect()]
    assert {tuple(r) for r in p1_found(spark, sf).collect()} == brute.bundle_groups(b, w)


@pytest.mark.parametrize("seed", [0, 1])
def test_components_of_random_graphs_and_paths(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    u = brute.Union()
    for a, b in edges:
        if a != b:
            u.tie(a, b)
    got = {r.v: r.component for r in connected_components(spark.createDataFrame(edges + [(None, 1), (7, 7)], "src long, dst long")).collect()}
    assert got.keys() == u.up.keys()
    pairs = {(u.find(v), c) for v, c in got.items()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({c for _, c in pairs})


def test_components_of_a_large_graph(spark):
    """A hub of 60,000 edges, a path of 20,000, 15,000 pairs and 10,000 triangles: more than 100,000 edges, all rounds distributed."""
    ids = lambda n: spark.range(n, numPartitions=4)
    edge = lambda n, src, dst: ids(n).select(F.expr(src).alias("src"), F.expr(dst).alias("dst"))
    parts = [edge(60_000, "0", "id + 1"), edge(20_000, "1000000 + id", "1000001 + id"), edge(15_000, "2000000 + 2 * id", "2000001 + 2 * id"), edge(30_000, "3000000 + id", "3000000 + id - id % 3 + (id + 1) % 3")]
    got = connected_components(parts[0].union(parts[1]).union(parts[2]).union(parts[3]))
    family = F.when(F.col("v") < 1_000_000, 0).when(F.col("v") < 2_000_000, 1).when(F.col("v") < 3_000_000, F.expr("v div 2")).otherwise(F.expr("-(v div 3)"))
    n = got.groupBy(family.alias("f")).agg(F.countDistinct("component").alias("c"), F.count("*").alias("n")).agg(F.max("c"), F.count("*"), F.sum("n")).first()
    assert tuple(n) == (1, 25_002, 60_001 + 20_001 + 30_000 + 30_000)
    assert got.select("component").distinct().count() == 25_002


def test_bundle_groups_edge_cases(spark):
    rows = [(1, "doi: 10.1/A", None, "x"), (2, "w2", " https://doi.example/10.1/a\n", "x"), (2, "w2", " https://doi.example/10.1/a\n", "x"), (3, None, "n/a", "x"), (4, None, "", "x"), (5, "", None, "x"), (6, "", "10.2/z", "x"), (None, "w2", None, "x"), (7, "w7", "10.3/q", "x")]
    works = [(1, '["10.1/a", null, "DOI 10.9/free"]', "c"), (2, '["10.9/FREE", "10.3/q"]', "c"), (3, "{broken", "c"), (4, None, "c"), (5, "[]", "c")]
    got = {(r.id, r.group_id, r.n) for r in bundle_groups(spark.createDataFrame(rows, B), spark.createDataFrame(works, W)).collect()}
    assert got == {(1, 1, 3), (2, 1, 3), (7, 1, 3), (3, 3, 1), (4, 4, 1), (5, 5, 2), (6, 5, 2)}
    assert bundle_groups(spark.createDataFrame([], B), spark.createDataFrame([], W)).count() == 0


def test_p5_matches_brute_force(spark, sf):
    works = [r.asDict() for r in table(spark, sf, "normalized_works").collect()]
    stamps = {r.id: datetime.fromisoformat(r.retrieval_timestamp) for r in table(spark, sf, "raw_bundles").collect() if r.retrieval_timestamp}
    assert {tuple(r) for r in p5_found(spark, sf).collect()} == brute.survivors(works, stamps)


def test_survivors_edge_cases(spark):
    ddl = "id long, doi string, title string, authors string, year int, source_bundle_ids string, provenance string, confidence double, at string"
    works = [
        (1, "", "t", "[ ]", None, "[10, 11]", "{bad", None, "c"),
        (2, "10.1/a", None, "null", 2000, '["11"]', '{"doi": " PDF ", "year": "crossref"}', float("nan"), "c"),
        (3, "10.1/b", "u", '["x"]', 2001, "[11, 12]", '{"doi": "Pdf", "title": null}', 0.5, "c"),
        (3, "10.1/b", "u", '["x"]', 2001, "[11, 12]", '{"doi": "Pdf", "title": null}', 0.5, "c"),
        (4, "10.1/z", "alone", None, 1, None, None, 1.0, "c"),
    ]
    bundles = [(10, "2024-01-01T00:00:00Z"), (11, "2024-01-01T00:00:00+02:00"), (12, "junk")]
    got = {(r.group_id, r.field, r.survivor_id, r.value) for r in survivors(spark.createDataFrame(works, ddl), spark.createDataFrame(bundles, "id long, retrieval_timestamp string")).collect()}
    assert got == {(1, "doi", 3, "10.1/b"), (1, "title", 1, "t"), (1, "authors", 3, '["x"]'), (1, "year", 2, "2000")}
    empty = spark.createDataFrame([], ddl)
    assert survivors(empty, spark.createDataFrame([], "id long, retrieval_timestamp string")).count() == 0


def test_few_edges_that_a_round_leaves_take_few_stages(spark):
    path = [(i, i + 1) for i in range(400)]
    spark.sparkContext.setJobGroup("few", "components")
    try:
        got = connected_components(spark.createDataFrame(path, "src long, dst long")).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.v for r in got} == set(range(401)) and len(got) == 401 and len({r.component for r in got}) == 1
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) < 30
