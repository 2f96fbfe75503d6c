import random

import pytest
from pyspark.sql import functions as F

from lectern.llm.mixing import Node, budgets, mix, p9_mix, p9_shares, spread
from lectern.llm.packing import best_fit, p8_fill, p8_pack, pack
from lectern.llm.tokens import encoder, token_counts, PATTERN, VOCABULARY


def test_best_fit_never_overflows_and_keeps_its_bound():
    rng = random.Random(2)
    sizes = [rng.randint(1, 100) for _ in range(5000)]
    placed, still = best_fit(sizes, 100, 16)
    fill = {}
    for s, b in zip(sizes, placed):
        fill[b] = fill.get(b, 0) + s
    assert max(fill.values()) <= 100 and len(still) <= 16
    assert len(fill) <= 1.1 * sum(sizes) / 100


def test_pack_edge_cases(spark):
    rows = [(1, 5000), (2, None), (3, 0), (4, 2048), (5, 100), (5, 100), (None, 7), (6, -3)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, n_tokens int, container string")
    got = pack(df, "doc_id", "n_tokens").collect()
    assert sorted((r.doc_id, r.piece, r.first, r.n) for r in got if r.doc_id == 1) == [(1, 0, 0, 2048), (1, 1, 2048, 2048), (1, 2, 4096, 904)]
    assert all((r.container is None) == (r.n == 0) for r in got) and sum(r.n for r in got) == 5000 + 2048 + 207
    fill = {}
    for r in got:
        if r.container is not None:
            fill[r.container] = fill.get(r.container, 0) + r.n
    assert max(fill.values()) <= 2048 and len(fill) == 4
    assert pack(df.limit(0), "doc_id", "n_tokens").count() == 0


def test_pack_levels(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 10).cast("int").alias("n"))
    got = pack(df, "doc_id", "n", capacity=100, open_bins=8, shard_size=64)
    fill = got.groupBy("container").agg(F.sum("n").alias("n"))
    top, bins, total = fill.agg(F.max("n"), F.count("*"), F.sum("n")).first()
    assert top <= 100 and got.count() == 20000 and bins <= 1.12 * total / 100


def test_pack_query(spark, sf):
    r = p8_fill(spark, sf).first()
    assert r.fullest <= 2048 and r.containers <= r.at_least + 2 and p8_pack(spark, sf).count() >= 100


def test_budgets_redistribute_to_siblings_first():
    root = Node(children={"a": Node(0.5, 60.0, children={"x": Node(0.25, 10.0), "y": Node(0.25, 50.0)}), "b": Node(0.5, 1000.0)}, weight=1.0, capacity=1060.0)
    spread(root, 100.0)
    assert root.children["a"].children["x"].budget == 10 and root.children["a"].children["y"].budget == 40 and root.children["b"].budget == 50
    spread(root, 200.0)
    assert root.children["a"].budget == 60 and root.children["b"].budget == 140
    got = budgets([("p", "en", "abstract", 100), ("q", "en", "readme", 900)], {"abstract": (0.5, 2), "readme": (0.5, 1)}, slack=0)
    assert sum(got.values()) == pytest.approx(400) and got[("p", "en", "abstract")] == pytest.approx(200)


def test_mix_edge_cases(spark):
    docs = [(i, "abstract", "EN " if i % 2 else None, 50) for i in range(40)] + [(100 + i, "readme", "en", 10) for i in range(20)] + [(200, None, "en", 5), (201, "other", "en", 5), (202, "abstract", "en", 0), (203, "abstract", "en", None)]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, source string, lang string, n_tokens int, epoch int")
    targets = spark.createDataFrame([("abstract", 0.5, 1), ("readme", 0.5, 3), ("erratum", None, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = mix(df, targets, slack=0.0).collect()
    use = {}
    for r in got:
        use[(r.source, r.doc_id)] = use.get((r.source, r.doc_id), 0) + 1
    assert max(n for (s, _), n in use.items() if s == "readme") <= 3 and max(n for (s, _), n in use.items() if s == "abstract") == 1
    tokens = {s: sum(r.n_tokens for r in got if r.source == s) for s in ("abstract", "readme")}
    assert abs(tokens["abstract"] - tokens["readme"]) <= 100 and tokens["readme"] == 600
    assert mix(df.limit(0), targets).count() == 0


def test_mix_query(spark, sf):
    caps = {r.source: r.max_repeats for r in spark.read.parquet(f"{sf}/mix_targets.parquet").collect()}
    used = p9_mix(spark, sf).groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("epoch").alias("e")).collect()
    assert used and all(r.n == r.e <= caps[r.source] for r in used)
    assert abs(sum(r.actual_share for r in p9_shares(spark, sf).collect()) - 1) < 1e-3


def test_tokens(spark):
    enc = encoder(VOCABULARY, PATTERN)
    texts = ["Grid worlds, 2d.", "", None, "å ø 迷宫 " * 3, "word " * 50_000]
    got = {r.i: r.n_tokens for r in token_counts(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").collect()}
    assert got[1] == got[2] == 0 and enc.decode(enc.encode_ordinary(texts[3])) == texts[3] and got[4] >= 50_000
