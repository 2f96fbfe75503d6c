import math

import duckdb
import pytest

from lectern.operators import graph, hierarchy, layers, resolve, search, series, texts
from lectern.queries import QUERIES, SQL
from pyspark.sql import functions as F

DAG = [(0, 1, 0), (0, 2, 1), (1, 3, 0), (1, 2, 1), (2, 4, 0), (2, 5, 1), (2, 3, 2), (3, 5, 0), (3, 4, 1), (4, 5, 0)]


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 5) if isinstance(v, float) else str(v)[:10] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    import os

    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    df = QUERIES[name](spark, sf)
    r = con.execute(SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    got = sorted((tuple(norm(x[c]) for c in cols) for x in df.collect()), key=str)
    assert got == sorted((tuple(map(norm, x)) for x in r.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and n != "predicted_sources"))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_bm25_goldens(spark):
    docs = spark.createDataFrame([(0, "a a b"), (1, "b c"), (2, "c c c c"), (3, None), (4, " ")], "id long, t string")
    index = search.build_index(docs, "id", F.col("t"))
    score = lambda q: {r.doc_id: r.score for r in search.bm25(index, q).collect()}
    assert score("a") == pytest.approx({0: 1.401184647159609})
    assert score("b") == pytest.approx({1: 0.5529454461714537, 0: 0.47000362924573563})
    assert score("b b") == pytest.approx({k: 2 * v for k, v in score("b").items()})
    assert score("zzz") == {} and score("!!") == {}


def test_graph(spark):
    e = spark.createDataFrame(DAG, "src long, dst long, ord int")
    assert {r.v: r.distance for r in graph.longest_distances(e, 0).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    assert {r.v: r.distance for r in graph.longest_distances(e, 4).collect()} == {0: None, 1: None, 2: None, 3: None, 4: 0, 5: 1}
    path = graph.longest_path(e, 0, "ord")
    assert [r.v for r in path.orderBy("pos").collect()] == [0, 1, 2, 3, 4, 5]
    assert {tuple(r) for r in graph.skip_edges(e, path).collect()} == {(0, 2), (1, 3), (2, 4), (2, 5), (3, 5)}
    assert [r.v for r in graph.depth_first(e.withColumn("c", F.lit(1)), "c", "ord").orderBy("pos").collect()] == [0, 1, 3, 5, 4, 2]
    cyc = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    assert {(r.v, r.depth) for r in graph.reached(cyc, 1).collect()} == {(1, 0), (2, 1), (3, 2)}
    with pytest.raises(ValueError):
        graph.longest_distances(cyc, 1, max_rounds=5)
    hidden = graph.contract(e, spark.createDataFrame([(0,), (5,)], "v long"))
    assert {tuple(r) for r in hidden.collect()} == {(0, 5)}


def test_series(spark):
    rows = [("a", i, v) for i, v in enumerate([None, 1.0, 2.0, None, 3.0, 4.0])] + [("b", 0, 1.0), ("b", 1, None), ("c", 0, None)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = series.moving_average(df, "g", "i", "v", 2).orderBy("g", "i").collect()
    assert [r.average for r in got if r.g == "a"] == [1.5, 1.5, 1.5, 1.5, 2.5, 3.5] and all(r.average is None for r in got if r.g != "a")
    filled = series.fill_gaps(spark.createDataFrame([("x", 0, None), ("x", 1, 3.0), ("x", 2, None)], "g string, i int, v double"), "g", "i", "v")
    assert [r.filled for r in filled.orderBy("i").collect()] == [3.0, 3.0, 3.0]
    shown = series.display_sizes(spark.createDataFrame([(x,) for x in (64, 128, 256, 512, 1024, 2, 64)], "s int"), "s", 1, 10)
    assert {r.s: r.shown for r in shown.collect()} == {2: 1, 64: 3, 128: 5, 256: 7, 512: 9, 1024: 10}


def test_quality_and_codes(spark):
    q = spark.createDataFrame([("Abstract\nfoo-\n",), ("",), (None,)], "t string").select(texts.quality(F.col("t")).alias("q")).collect()
    assert [round(r.q, 10) for r in q] == [0.6142857143, 0.0, 0.0]
    tree = spark.createDataFrame([(1, "6 Tech", None), (2, "8 Sys", 1), (3, "1 Ins", 2), (4, "papers", 3), (5, "32 Deep", 4), (6, "orphan", 99), (7, "7 Loop", 7)], "id long, name string, parent long")
    got = {r.id: r.code for r in hierarchy.codes(tree, "id", "parent", "name").collect()}
    assert got == {1: "6", 2: "68", 3: "681", 5: "681.32", 6: "orphan", 7: "7"}


def test_merge_takes_the_running_doi(spark):
    rows = [(1, None, None, '{"doi": "10.1/a"}', None), (2, "w", '{"title": "P"}', '{"doi": "10.1/a", "title": ""}', "broken"), (3, "z", None, None, '{"id": "O", "title": "T", "year": 0}')]
    got = {r.key_value: r for r in resolve.merge(spark.createDataFrame(rows, "id long, work_id string, pdf_metadata string, crossref_metadata string, openalex_metadata string")).collect()}
    assert got["10.1/a"].work_id == "doi:10.1/a" and got["10.1/a"].title == "P" and got["10.1/a"].title_source == "pdf" and got["10.1/a"].source_bundle_ids == [1, 2]
    assert got["O"].work_id == "O" and got["O"].year is None and got["O"].confidence == pytest.approx(0.5)


def test_layer_chain(spark):
    rows = [("n", i, t, h, h) for i, (t, h) in enumerate([("Conv2d", 8), ("ReLU", 8), ("Conv2d", 6), ("Conv2d", 6), ("MaxPool2d", 3), ("Odd", 1), ("Linear", 1)])]
    assert layers.chain(spark.createDataFrame(rows, "g string, i int, type string, height int, width int"), "g", "i").first().chain == "crCCpxl"


def test_streams(spark, tmp_path):
    from lectern.streaming.gaps import carry_forward, windowed_means

    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, None, "2024-01-01 00:10:00"), ("a", 2, 5.0, "2024-01-01 00:20:00"), ("a", 3, None, "2024-01-01 03:00:00")], "g string, i int, v double, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("g string, i int, v double, ts timestamp").parquet(src)
    for name, df, mode in (("c", carry_forward(stream, "g", "i", "v"), "append"), ("m", windowed_means(stream, "ts", "g", "v"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert [(r.i, None if r.filled is None or math.isnan(r.filled) else r.filled) for r in spark.table("c").orderBy("i").collect()] == [(1, None), (2, 5.0), (3, 5.0)]
    assert {(r.mean, r["values"]) for r in spark.table("m").collect()} == {(5.0, 1), (None, 0)}


def test_building_bundles(spark):
    from lectern.operators import build

    cr = spark.createDataFrame([("10.1/a", "T", ["A"], 2000)], "doi string, title string, authors array<string>, year int")
    oa = spark.createDataFrame([("10.1/B", "U", ["B"], 2001)], "doi string, title string, authors array<string>, year int")
    dois = spark.createDataFrame([("DOI: 10.1/A",), ("https://doi.org/10.1/b",), (None,), ("",), ("10.1/a",)], "doi string")
    got = {r.work_id: r for r in build.from_dois(dois, cr, oa).collect()}
    assert got.keys() == {"doi:10.1/a", "doi:10.1/b"} and got["doi:10.1/a"].openalex_metadata == "{}" and got["doi:10.1/a"].errors == '["openalex: no record"]' and '"title":"U"' in got["doi:10.1/b"].openalex_metadata
    bib = spark.createDataFrame([("k", "T", ["A"], "2000", "10.1/a", None), ("e", None, [], None, None, None), ("x", "T", [], None, None, "7700.1")], "id string, title string, authors array<string>, year string, doi string, arxiv string")
    assert {r.work_id for r in build.from_bibtex(bib, cr, oa).collect()} == {"doi:10.1/a", "error:e", "arxiv:7700.1"}
    one = spark.createDataFrame([("10.1/a", 1, '{"n": 2}'), ("10.1/A", 0, '{"n": 1}')], "doi string, position int, item string")
    r = build.from_searches(one, one.limit(0), cr, oa).collect()
    assert [(x.search_hits_crossref, x.search_hits_openalex) for x in r] == [('[{"n": 1}, {"n": 2}]', "[]")]
    files = spark.createDataFrame([("p", "10.0000/pdf-1", None, [], None, None)], "path string, content_doi string, title string, authors array<string>, year string, doi string")
    assert build.from_files(files, cr, oa).first().work_id == "10.0000/pdf-1"
    s = spark.createDataFrame([('{"summary": "s", "methods": ["m"]}',), ("plain",), (None,)], "t string").select(build.summary_fields(F.col("t")).alias("f")).collect()
    assert [(x.f.summary, x.f.methods) for x in s] == [("s", ["m"]), ("plain", []), ("", [])]


def test_nested_export_and_blocks(spark):
    import json

    tree = spark.createDataFrame([(1, 'a "q"', None), (3, "c", 1), (2, "b", 1), (4, "d", 3)], "id long, name string, parent long")
    got = hierarchy.nested_json(tree, "id", "parent", "name").collect()
    assert [json.loads(r.json) for r in got] == [{"id": 1, "name": 'a "q"', "children": [{"id": 2, "name": "b", "children": []}, {"id": 3, "name": "c", "children": [{"id": 4, "name": "d", "children": []}]}]}]
    rows = [("n", i, t, 8, 8) for i, t in enumerate(["Conv2d", "ReLU", "Conv2d", "ReLU", "MaxPool2d", "Linear"])]
    df = spark.createDataFrame(rows, "g string, i int, type string, height int, width int")
    skips = spark.createDataFrame([("n", 1, 5)], "g string, src int, dst int")
    got = layers.path_blocks(df, "g", "i", skips).orderBy("block_no").collect()
    assert [(r.block, r.number, r.first, r["last"], r.skip_to) for r in got] == [("C", 1, 0, 3, 2), ("P>", 1, 4, 4, None), ("l", 1, 5, 5, None)]
    info = spark.range(1).select(layers.node_info(F.lit("<b>Conv2d</b> (1, 3, 572, 572) (1, 64, 570, 569)")).alias("x")).first().x
    assert tuple(info) == ("Conv2d", 64, 570, 569)


def test_typed_order_places_every_row(spark, sf):
    rows = {r.o_orderkey: r.place for r in QUERIES["typed_order"](spark, sf).collect()}
    written = {r.o_orderkey: r.parsed for r in QUERIES["dates_in_formats"](spark, sf).collect()}
    want = sorted(written, key=lambda k: (written[k] is not None, str(written[k]), k))
    assert sum(d is not None for d in written.values()) > 500
    assert [k for k, _ in sorted(rows.items(), key=lambda x: x[1])] == want and sorted(rows.values()) == list(range(1, len(want) + 1))


def test_metadata_in_strings_and_titles_in_any_script(spark, tmp_path):
    import json

    doc = json.dumps({"abstract_inverted_index": {"mazes": [1], "In": [0]}, "locations": [{"pdf_url": ""}, {"pdf_url": "u/1.pdf"}]})
    spark.createDataFrame([(1, doc), (2, json.dumps(doc)), (3, "{broken"), (4, "[]"), (5, '"text"'), (6, None)], "id long, openalex_metadata string").write.parquet(f"{tmp_path}/raw_bundles.parquet")
    assert {tuple(r) for r in QUERIES["abstracts"](spark, str(tmp_path)).collect()} == {(1, "In mazes"), (2, "In mazes")}
    assert {tuple(r) for r in QUERIES["pdf_urls"](spark, str(tmp_path)).collect()} == {(1, "u/1.pdf"), (2, "u/1.pdf"), (3, None), (4, None), (5, None), (6, None)}
    titles = ["Über RL in Grid World", "über", "ÉRL und RLé", "学习 RL", None]
    spark.createDataFrame(list(enumerate(titles)), "id long, title string").write.parquet(f"{tmp_path}/normalized_works.parquet")
    got = {r.id: r.title for r in QUERIES["synonym_titles"](spark, str(tmp_path)).collect()}
    assert got == {0: "über reinforcement_learning in gridworld", 1: "über", 2: "érl und rlé", 3: "学习 reinforcement_learning", 4: None}


def test_classes_weigh_every_term_by_idf(spark):
    many = " ".join(f"w{i}" for i in range(12_000))
    docs = spark.createDataFrame([(0, many, "a"), (1, many, "a"), (2, "rare common rare", "b"), (3, "rare common common", "b"), (4, "common", "b")], "id long, t string, c string")
    model = texts.train_classes(docs, "t", "c")
    words = next(s.vocabulary for s in model.stages if hasattr(s, "vocabulary"))
    assert len(words) == 12_000 + 11_999 + 3  # words, pairs, and rare, common, "rare common"
    v = model.transform(docs.where("id = 2")).first()["features"]
    got = {words[i]: x for i, x in zip(v.indices, v.values)}
    df = {"rare": (2, 2), "common": (1, 3), "rare common": (1, 2)}
    raw = {t: tf * (math.log(6 / (1 + n)) + 1) for t, (tf, n) in df.items()}
    assert got == pytest.approx({t: w / math.sqrt(sum(x * x for x in raw.values())) for t, w in raw.items()})
    assert {r.predicted for r in texts.predict_classes(model, docs, "t", "id").where("id > 1").collect()} == {"b"}
