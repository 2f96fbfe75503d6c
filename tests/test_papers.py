import numpy as np

from lectern.operators import embed, graph, papers, records
from lectern.sources import engines, paged
from pyspark.sql import functions as F


def test_records_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (2, "c")], "k long, v string")
    assert [r.v for r in records.record(df, "k", 2).collect()] == ["c", "c"] and records.record(df, "k", None).count() == 0
    assert {r.v for r in records.delete(df, "k", 2).collect()} == {"a", "b"} and records.delete(df.limit(0), "k", 2).count() == 0
    eq = df.groupBy("v").agg(records.all_equal(F.col("k")).alias("e"))
    assert {(r.v, r.e) for r in eq.collect()} == {("a", True), ("b", True), ("c", True)}
    mixed = spark.createDataFrame([(1,), (None,)], "k long").agg(records.all_equal(F.col("k")).alias("e"))
    assert mixed.first().e is False


def test_fill_by_type(spark):
    found = "struct<DOI:string,container_title:string,published_year:int,volume:string,issue:string,page:string>"
    hit = ("10.1/x", "Journal", 1999, "3", "", "1-9")
    cols = f"itemType string, DOI string, date string, publicationTitle string, bookTitle string, volume string, pages string, found {found}"
    rows = [("journalArticle", "", None, "", "", "", "", hit), ("bookSection", "10.2/y", "2001", "", "", "", "", hit), ("book", None, "", "", "", "", "", None)]
    got = [tuple(r) for r in records.fill_by_type(spark.createDataFrame(rows, cols)).collect()]
    assert got[0] == ("journalArticle", "10.1/x", "1999", "Journal", "", "3", "1-9")
    assert got[1] == ("bookSection", "10.2/y", "2001", "", "Journal", "", "")
    assert got[2] == ("book", None, "", "", "", "", "")


def test_resolution_steps(spark):
    asked = spark.createDataFrame([("p1", "u1", None), ("p2", None, '{"primary_location": {"pdf_url": "u2"}}'), ("p3", "", "{broken"), ("p4", "u4", None), ("p5", "u5", None)], "paper_id string, pdf_url string, openalex_metadata string")
    downloads = spark.createDataFrame([("u1", "f1", None), ("u2", "f2", None), ("u4", None, "timeout"), ("u5", "", None)], "url string, local_path string, failure string")
    texts = spark.createDataFrame([("f1", "some text", None), ("f2", "", None)], "local_path string, extracted_text string, failure string")
    got = {r.paper_id: (r.strategy, r.error, r.quality_score is not None) for r in papers.resolution(asked, downloads, texts).collect()}
    assert got == {"p1": ("explicit_pdf_url", None, True), "p2": ("openalex_primary_location", "extraction_failed", False), "p3": (None, "no_pdf_url_found", False), "p4": ("explicit_pdf_url", "timeout", False), "p5": ("explicit_pdf_url", "download_failed", False)}


def test_encoding(spark):
    df = spark.createDataFrame([(1, "a maze"), (2, None), (3, "  "), (4, "a maze")], "id long, t string")
    got = {r.id: r.vector for r in embed.encode(df, "id", "t", embed.hashing_encoder(8)).collect()}
    assert set(got) == {1, 4} and got[1] == got[4] and abs(np.linalg.norm(got[1]) - 1) < 1e-6
    old = spark.createDataFrame([(1, [0.0] * 8), (9, [1.0] * 8)], "id long, vector array<float>")
    new = {r.id: r.vector for r in embed.refreshed(old, df, "id", "t", embed.hashing_encoder(8)).collect()}
    assert set(new) == {1, 4, 9} and new[1] == got[1]
    assert embed.encode(df.limit(0), "id", "t", embed.hashing_encoder(8)).count() == 0


def test_engines_fall_back(spark):
    def broken(content):
        raise ValueError("no PDF")

    files = spark.createDataFrame([("a", bytearray(b"one")), ("b", None), ("c", bytearray(b""))], "path string, content binary")
    got = {r.path: r.extracted_text for r in engines.pdf_texts(files, [broken, lambda c: "", lambda c: c.decode()]).collect()}
    assert got == {"a": "one", "b": None, "c": None}
    blobs = files.select("path", engines.unzipped(engines.zipped("path", "content")).alias("z"), engines.unzipped("content").alias("bad"))
    read = {r.path: r for r in blobs.collect()}
    assert read["a"].z[0]["content"] == b"one" and read["b"].z is None and read["a"].bad is None


def test_services_retry(spark, tmp_path):
    folder = str(tmp_path)

    def flaky(query, cursor, size):
        import pathlib

        mark = pathlib.Path(folder, query)
        if not mark.exists():
            mark.touch()
            raise paged.Answer(503)
        return [{"id": query}], None

    assert [r.item for r in paged.search(spark, ["q"], transport=flaky, pause=0.01).collect()] == ['{"id": "q"}']


def test_topological_order_and_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 4), (1, 3), (3, 4), (7, 8)], "src long, dst long")
    at = {r.v: r.place for r in graph.topological(e).collect()}
    assert sorted(at.values()) == [1, 2, 3, 4, 5, 6] and all(at[a] < at[b] for a, b in [(1, 2), (2, 4), (3, 4), (7, 8)])
    try:
        graph.topological(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))
        raise AssertionError("a cycle has no order")
    except ValueError:
        pass
