import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import dates, jsons, text
from lectern.operators import layers, series
from lectern.sources import files


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


L = F.lit


@pytest.mark.parametrize(
    "expr,want",
    [
        (lambda: text.tokens(L("Grid-World RL 2d")), ["grid", "world", "rl", "2d"]),
        (lambda: text.tokens(text.with_synonyms(L("RL in a grid world"))), ["reinforcement", "learning", "in", "a", "gridworld"]),
        (lambda: text.canonical_doi(L(" https://doi.org/10.1/ABC ")), "10.1/abc"),
        (lambda: text.canonical_doi(L("DOI: 10.1/X")), "10.1/x"),
        (lambda: text.canonical_doi(L("DOI 10.1/X")), "10.1/x"),
        (lambda: text.canonical_doi(L("")), ""),
        (lambda: text.internal_doi(L("t"), F.array(L("a"), L("b")), L(2020)), "10.0000/7bf1777a617844556af3a5f541b4067deb7089b3"),
        (lambda: text.plain(L("A  -  B!")), "a  b"),
        (lambda: text.synthetic_id(L("A Study"), F.array(L("John Jones"), L("A. Smith")), L(2020)), "synthetic:b5a34783ce2c61122e464ded7621917eb7f1f602"),
        (lambda: text.keyword_terms(L("RL OR grid world, (reward shaping), a b c d, RL.")), ["RL", "grid world", "reward shaping"]),
        (lambda: text.compact_code(L("68132456")), "681.324.56"),
        (lambda: text.child_code(L("6"), L("81")), "081"),
        (lambda: text.child_code(L("681"), L("3")), "681.3"),
        (lambda: text.child_code(L(None).cast("string"), L("6")), "6"),
        (lambda: text.collapsed_code(L("1.2.3.4.5")), "1.2.3.4"),
        (lambda: text.safe_name(L("***")), "paper"),
        (lambda: text.first_doi(L("see 10.1234/AB.c; and 10.9/x")), "10.1234/AB.c;"),
        (lambda: text.leading_digits(L("no number")), None),
        (lambda: text.yaml_list(F.array().cast("array<string>")), "[]"),
        (lambda: text.work_identifier(L(""), L("7700.1"), L("t"), F.array(L("a")), L(1)), "arxiv:7700.1"),
        (lambda: dates.shown_date(L("30-10-2012 00:00:00")), "30-10-2012"),
        (lambda: dates.shown_date(L("2020-12-31")), "31-12-2020"),
        (lambda: dates.shown_date(L("junk")), "junk"),
        (lambda: dates.parsed_date(L("junk")), None),
        (lambda: jsons.abstract_text_single(jsons.inverted_abstract(L('{"abstract_inverted_index": {"x": [0], "y": [0]}}'))), "y"),
        (lambda: jsons.abstract_text(jsons.inverted_abstract(L('{"abstract_inverted_index": {"x": [0], "y": [0]}}'))), "x y"),
        (lambda: jsons.abstract_text(jsons.inverted_abstract(L('{"abstract_inverted_index": {"a": [0, 2], "b": [1]}}'))), "a b a"),
        (lambda: jsons.abstract_text_single(jsons.inverted_abstract(L('{"abstract_inverted_index": {"a": [0], "b": [5]}}'))), "a b"),
        (lambda: jsons.abstract_text(jsons.inverted_abstract(L("broken"))), None),
        (lambda: jsons.first_object(L('Sure: {"a": {"b": 1}} and {more}')), '{"a": {"b": 1}}'),
        (lambda: jsons.first_object(L('x {"a": 1, }')), '{"a": 1}'),
        (lambda: jsons.first_object(L("none {")), None),
        (lambda: layers.block_text(L("crcrpcrcrpcrcrcrpcrcrcrpcrcrcrplrlrl")), "CP>CP>CP>CP>CP>L>L>l"),
        (lambda: series.span_groups(F.array(*[F.struct(L(a).alias("from"), L(b).alias("to")) for a, b in ((0, 1), (1, 3), (3, 4), (4, 6))])), [0, 1, 1, 2, 3, 3]),
        (lambda: files.tensor_shape(L("(1, 3, 572, 572)")), [3, 572, 572]),
    ],
)
def test_expressions(spark, expr, want):
    assert one(spark, expr()) == want


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="abcXYZ10./ ", min_size=1, max_size=20))
def test_canonical_doi_is_idempotent(spark, raw):
    row = spark.createDataFrame([(f"doi:10.1/{raw.strip()}",)], "d string")
    once = row.select(text.canonical_doi(F.col("d")).alias("d"))
    assert once.select(text.canonical_doi(F.col("d")).alias("e"), "d").where("e <> d").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.bib").write_text('@article{k1, title = {A {Deep} Study}, author = "Ann Lee and Bo Ek", year = 2020, doi = {https://doi.org/10.1/X}}\n@misc{k2, title={T}, eprint={7700.1}, archivePrefix={arXiv}}\n@bad{k3, title={unclosed')
    got = {r.id: r for r in files.read_bibtex(spark, str(tmp_path / "a.bib")).collect()}
    assert got.keys() == {"k1", "k2"} and got["k1"].title == "A {Deep} Study" and got["k1"].authors == ["Ann Lee", "Bo Ek"] and got["k1"].doi == "10.1/x" and got["k1"].year == "2020" and got["k2"].arxiv == "7700.1"
    tei = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>T</title></titleStmt><sourceDesc><biblStruct><author><persName><forename>A</forename><forename>B</forename><surname>C</surname></persName><affiliation><orgName type="department">D</orgName><orgName type="institution">I</orgName></affiliation></author><idno type="DOI">10.1/q</idno></biblStruct></sourceDesc></fileDesc><profileDesc><abstract><p>one</p><p>two</p></abstract></profileDesc></teiHeader></TEI>'
    r = one(spark, files.tei_record(L(tei)))
    assert (r.title, r.abstract, r.doi) == ("T", "one two", "10.1/q") and [(a.given, a.family, a.affiliation) for a in r.authors] == [("A B", "C", "I")]
    maze = "<Maze><dimensions><Width>2</Width><Height>2</Height></dimensions><Unreachable><Cell><x>0</x><y>1</y></Cell></Unreachable><Reward><Cell><x>1</x><y>1</y><reward>2.5</reward></Cell></Reward></Maze>"
    m = spark.createDataFrame([(maze,)], "x string").select(files.maze(F.col("x")).alias("m"))
    assert m.select(files.maze_rows(F.col("m")).alias("r")).first().r == ["..", "#+"]
    assert {(c.kind, c.x, c.y, c.reward) for c in m.select(files.maze_cells(F.col("m")).alias("c")).first().c} == {("Unreachable", 0, 1, None), ("Reward", 1, 1, 2.5)}
    assert [(e.src, e.dst) for e in one(spark, files.graph_edges(L("digraph { 0 -> 1; 1 -> 23 }")))] == [(0, 1), (1, 23)]
    (tmp_path / "t.json").write_text('[{"id": 1, "name": "a", "children": [{"id": 2, "name": "b", "children": []}]}]')
    assert {(r.id, r.parent) for r in files.read_tree(spark, str(tmp_path / "t.json")).collect()} == {("1", None), ("2", "1")}
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    found = files.read_files(spark, str(tmp_path))
    assert files.file_for_doi(found, found.first().content_doi).count() == 1


def test_tei_documents_are_parsed_once_and_may_be_unreadable(spark):
    person = lambda i: f'<t:author><t:forename>N{i}</t:forename><t:surname>S<t:hi>{i}</t:hi></t:surname><t:idno type="ORCID">0-{i}</t:idno><t:orgName>O</t:orgName></t:author>'
    good = '<t:TEI xmlns:t="u"><t:sourceDesc>' + "".join(map(person, range(3))) + '<t:author/><t:date/><t:date when="2001-01"/></t:sourceDesc><t:div><t:head> ABSTRACT </t:head><t:p>a<!-- k --> b &amp; c</t:p></t:div></t:TEI>'
    df = spark.createDataFrame([(0, good), (1, "<TEI><title>x"), (2, None)], "i int, d string").select("i", files.tei_record(F.col("d")).alias("r")).select("i", "r.*", F.size("r.authors").alias("n"))
    a, b, c = df.orderBy("i").collect()
    assert (a.n, a.abstract, a.year, a.references) == (4, "a  b & c", "2001", []) and (a.authors[1].given, a.authors[1].family, a.authors[1].orcid, a.authors[1].affiliation) == ("N1", "S1", "0-1", "O")
    assert b.authors is None and b.title is None and c.authors is None
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("read(d") == 1 and "xpath" not in plan


def test_paged_source(spark, tmp_path):
    from lectern.sources import paged

    (tmp_path / "q1.json").write_text('[[{"DOI": "10.1/A", "title": ["T"], "author": [{"given": "A", "family": "B"}], "issued": {"date-parts": [[2001]]}}, {"DOI": "10.1/B"}], [{"DOI": "10.1/C", "publication_year": 2005}]]')
    (tmp_path / "q2.json").write_text("[[]]")
    hits = paged.search(spark, ["q1", "q2"], str(tmp_path), target=3)
    assert [r.position for r in hits.orderBy("position").collect()] == [0, 1, 2]
    r = hits.where("position = 0").select(*paged.crossref_record("item")).first()
    assert (r.doi, r.title, r.authors, r.year) == ("10.1/a", "T", ["A B"], 2001)
    assert paged.matches(hits, years=(2000, 2010)).count() == 1 and paged.project(hits, {"doi": "DOI"}).count() == 3
