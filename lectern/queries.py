"""The core's queries by name, each over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import dates, jsons, text
from lectern.operators import build, embed, graph, hierarchy, layers, papers, records, resolve, search, series, texts
from lectern.operators.nested import p7_authors, p7_found, p7_institutions
from lectern.plans.runtime import table
from lectern.sources import engines, files, paged, sinks
from lectern.streaming import gaps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p7_found, p7_authors, p7_institutions)}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- text search

WORDS = "exploration bonus gridworld replay the the"
TOKENS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents WHERE text IS NOT NULL"


@query(f"SELECT doc_id, term, count(*)::BIGINT AS tf FROM ({TOKENS}) GROUP BY ALL")
def term_frequency(spark, d):
    return search.postings(table(spark, d, "documents"), "doc_id", F.col("text"))


@query(f"SELECT term, count(DISTINCT doc_id)::BIGINT AS df FROM ({TOKENS}) GROUP BY ALL")
def document_frequency(spark, d):
    return search.build_index(table(spark, d, "documents"), "doc_id", F.col("text")).terms


@query("SELECT count(*)::BIGINT AS n, round(avg(len(regexp_extract_all(lower(text), '[a-z0-9]+'))), 6) AS avgdl FROM documents WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0")
def corpus_stats(spark, d):
    return search.build_index(table(spark, d, "documents"), "doc_id", F.col("text")).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def _bm25_sql(docs: str, words: list[str], k: int) -> str:
    values = ", ".join(f"('{w}', {i})" for i, w in enumerate(words))
    return f"""d AS ({docs}), tok AS (SELECT doc_id, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS term FROM d),
      tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
      dl AS (SELECT doc_id, len(regexp_extract_all(t, '[a-z0-9]+')) AS dl FROM d), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
      q AS (SELECT term, count(*) AS times, min(pos) AS qpos FROM (VALUES {values}) v(term, pos) GROUP BY term),
      sc AS (SELECT tf.doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) AS score, min(qpos) AS first
             FROM tf JOIN q USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY tf.doc_id),
      hits AS (SELECT * FROM sc ORDER BY round(score, 9) DESC, first, doc_id LIMIT {k})"""


@query("WITH " + _bm25_sql("SELECT doc_id, lower(text) AS t FROM documents WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0", WORDS.split(), 20) + " SELECT doc_id, round(score, 6) AS score FROM hits")
def bm25_topk(spark, d):
    index = search.build_index(table(spark, d, "documents"), "doc_id", F.col("text"))
    return search.top(search.bm25(index, WORDS), 20).select("doc_id", F.round("score", 6).alias("score"))


def _synonym_sql(c: str) -> str:
    out = f"lower({c})"
    for term, variants in text.SYNONYMS.items():
        for v in variants:
            # this engine's word boundary knows ASCII only, so the boundary's characters are matched; twice, as neighbours may share one
            edge, word = "[^\\p{L}\\p{M}\\p{N}_]", v.replace("-", "[-]")
            for _ in range(2):
                out = f"regexp_replace({out}, '(^|{edge}){word}($|{edge})', '\\1{term}\\2', 'g')"
    return out


_SAME = f"SELECT id AS doc_id, {_synonym_sql('title')} AS t FROM normalized_works WHERE length(regexp_replace(title, '\\s', '', 'g')) > 0"


@query("WITH " + _bm25_sql(_SAME, "reinforcement learning in a gridworld".split(), 20) + " SELECT doc_id AS id, round(score, 6) AS score FROM hits")
def bm25_synonyms(spark, d):
    """Titles of works, with the spellings of grid world and reinforcement learning made one on both sides."""
    works = table(spark, d, "normalized_works")
    index = search.build_index(works, "id", F.col("title"), synonyms=True)
    return search.top(search.bm25(index, "RL in a grid world", synonyms=True), 20).select(F.col("doc_id").alias("id"), F.round("score", 6).alias("score"))


def _concepts(spark, d):
    return table(spark, d, "normalized_works").select(F.col("id").alias("doc_id"), jsons.concepts(F.col("openalex_metadata")).alias("concepts"))


BOOSTED = ["https://catalog.example/C900370", "https://catalog.example/C900037"]
TITLES = "SELECT id AS doc_id, lower(title) AS t FROM normalized_works WHERE length(regexp_replace(title, '\\s', '', 'g')) > 0"
CONCEPTS = """con AS (SELECT id AS doc_id, c->>'$.id' AS cid, coalesce(TRY_CAST(c->>'$.score' AS DOUBLE), 0.0) AS cscore FROM (
      SELECT id, unnest(CASE WHEN json_type(m, '$.concepts') = 'ARRAY' THEN json_extract(m, '$.concepts')::JSON[] END) AS c FROM (SELECT id, TRY_CAST(openalex_metadata AS JSON) AS m FROM normalized_works) WHERE json_type(m) = 'OBJECT'))"""
BOOST = "coalesce((SELECT sum(cscore) FROM con WHERE con.doc_id = h.doc_id AND cid IN ('" + "', '".join(BOOSTED) + "')), 0.0)"


@query(f"WITH {_bm25_sql(TITLES, 'policy search in grid worlds'.split(), 200)}, {CONCEPTS} SELECT doc_id AS id, round(score, 6) AS bm25_score, round(boost, 6) AS concept_boost, round(score + 2 * boost, 6) AS final_score FROM (SELECT h.*, {BOOST} AS boost FROM hits h) ORDER BY round(score + 2 * boost, 9) DESC, round(score, 9) DESC, first, doc_id LIMIT 40")
def concept_boost_search(spark, d):
    index = search.build_index(table(spark, d, "normalized_works"), "id", F.col("title"))
    out = search.concept_search(index, _concepts(spark, d), "policy search in grid worlds", k=40, boosted=BOOSTED, alpha=2.0)
    return out.select(F.col("doc_id").alias("id"), *[F.round(c, 6).alias(c) for c in ("bm25_score", "concept_boost", "final_score")])


@query(f"WITH {_bm25_sql(TITLES, 'policy search in grid worlds'.split(), 200)}, {CONCEPTS} SELECT doc_id AS id, round(score, 6) AS bm25_score FROM hits h WHERE EXISTS (SELECT 1 FROM con WHERE con.doc_id = h.doc_id AND cid = '{BOOSTED[0]}') ORDER BY round(score, 9) DESC, first, doc_id LIMIT 40")
def concept_filter_search(spark, d):
    index = search.build_index(table(spark, d, "normalized_works"), "id", F.col("title"))
    out = search.concept_search(index, _concepts(spark, d), "policy search in grid worlds", k=40, required=BOOSTED[:1])
    return out.select(F.col("doc_id").alias("id"), F.round("bm25_score", 6).alias("bm25_score"))


COS = "list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))"


@query(f"SELECT vec_id, round({COS}, 6) AS cosine FROM (SELECT vec_id, embedding::DOUBLE[] AS a, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS b FROM embeddings) ORDER BY {COS} DESC, vec_id LIMIT 50")
def cosine_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    q = vectors.where("vec_id = 0").first()["embedding"]
    return search.similar(vectors, "vec_id", "embedding", q, 50).select("vec_id", F.round("cosine", 6).alias("cosine"))


@query(f"""WITH {_bm25_sql(TITLES, 'option discovery in icy fields'.split(), 300)}, {CONCEPTS},
   v AS (SELECT work_id, vector::DOUBLE[] AS a, (SELECT vector::DOUBLE[] FROM work_vectors WHERE work_id = (SELECT min(work_id) FROM work_vectors WHERE len(vector) = 64 AND list_sum(list_transform(vector, lambda x: x * x)) > 0)) AS b FROM work_vectors WHERE len(vector) = 64),
   j AS (SELECT h.doc_id, h.score, h.first, {COS} AS cosine, {BOOST} AS boost FROM hits h JOIN normalized_works w ON w.id = h.doc_id JOIN v ON v.work_id = w.work_id WHERE list_dot_product(a, a) > 0)
   SELECT doc_id AS id, round(score, 6) AS bm25_score, round(cosine, 6) AS cosine, round(score + 0.5 * cosine + 1 + boost, 6) AS final_score FROM j ORDER BY round(score + 0.5 * cosine + 1 + boost, 9) DESC, round(score, 9) DESC, first, doc_id LIMIT 30""")
def hybrid_rerank(spark, d):
    works, vectors = table(spark, d, "normalized_works"), table(spark, d, "work_vectors")
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    q = vectors.where((F.size("vector") == 64) & (norm > 0)).orderBy("work_id").first()["vector"]
    index = search.build_index(works, "id", F.col("title"))
    dense = works.join(vectors.where(F.size("vector") == 64), "work_id").select(F.col("id").alias("doc_id"), "vector")
    out = search.hybrid_search(index, dense, _concepts(spark, d), "option discovery in icy fields", q, k=30, boosted=BOOSTED, alpha=0.5)
    return out.select(F.col("doc_id").alias("id"), *[F.round(c, 6).alias(c) for c in ("bm25_score", "cosine", "final_score")])


# ---------------------------------------------------------------- identifiers and texts

_DOC = "CASE WHEN json_type(TRY_CAST({0} AS JSON)) = 'VARCHAR' THEN TRY_CAST((TRY_CAST({0} AS JSON)->>'$') AS JSON) ELSE TRY_CAST({0} AS JSON) END"
_OPENALEX = f"(SELECT id, {_DOC.format('openalex_metadata')} AS m FROM raw_bundles)"

DOI = "lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(doi, '^\\s+|\\s+$', '', 'g'), '^https?://(dx\\.)?doi\\.org/', '', 'i'), '^doi:\\s*', '', 'i'), '^doi\\s+', '', 'i'))"


@query(f"SELECT id, {DOI} AS doi FROM raw_bundles")
def doi_canonical(spark, d):
    return table(spark, d, "raw_bundles").select("id", text.canonical_doi(F.col("doi")).alias("doi"))


@query("SELECT id, nullif(regexp_extract(alternate_dois, '(?i)10\\.\\d{4,9}/[-._;()/:A-Z0-9]+', 0), '') AS doi FROM normalized_works")
def first_doi(spark, d):
    return table(spark, d, "normalized_works").select("id", text.first_doi(F.col("alternate_dois")).alias("doi"))


PLAIN = "trim(regexp_replace(regexp_replace(lower(coalesce({}, '')), '\\s+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'))"
LAST = f"regexp_extract({PLAIN.format('a')}, '\\S*$', 0)"


@query(f"""SELECT paper_id, {PLAIN.format('title')} AS title_key, authors_key,
   '10.0000/' || sha1(title || '|' || array_to_string(authors, ',') || '|' || year) AS internal_doi,
   'synthetic:' || sha1({PLAIN.format('title')} || '||' || authors_key || '||' || coalesce(year::VARCHAR, '')) AS synthetic_id
   FROM (SELECT e.*, coalesce(array_to_string(list_sort(list_transform(authors, lambda a: {LAST})), ' '), '') AS authors_key FROM experience_records e)""")
def work_identifiers(spark, d):
    t, a, y = F.col("title"), F.col("authors"), F.col("year")
    return table(spark, d, "experience_records").select("paper_id", text.plain(t).alias("title_key"), text.author_key(a).alias("authors_key"), text.internal_doi(t, a, y).alias("internal_doi"), text.synthetic_id(t, a, y).alias("synthetic_id"))





@query("""SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_') AS snake, trim(regexp_replace(title, '[\\\\/*?:"<>|]', '', 'g')) AS note,
   substring(replace(regexp_replace(title, '[\\\\/*?:"<>|]', '', 'g'), ' ', '_'), 1, 150) AS file, coalesce(nullif(regexp_replace(title, '[^\\p{L}\\p{N}._-]', '', 'g'), ''), 'paper') AS safe FROM normalized_works WHERE title IS NOT NULL""")
def file_names(spark, d):
    t = F.col("title")
    return table(spark, d, "normalized_works").where("title is not null").select("id", text.snake_name(t).alias("snake"), text.note_name(t).alias("note"), text.file_name(t).alias("file"), text.safe_name(t).alias("safe"))


@query("""SELECT paper_id, pos::INT AS pos, term FROM (SELECT paper_id, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS pos FROM (
   SELECT paper_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(array_to_string(tags, ' OR ') || ', grid world. (reward shaping), a b c d, rl', '(?i)\\bOR\\b', ',', 'g'), '[().]', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> '' AND len(regexp_extract_all(x, '\\S+')) <= 3) AS k,
   list_transform(list_filter(list_transform(range(len(k)), lambda i: CASE WHEN list_position(k, k[i + 1]) = i + 1 THEN k[i + 1] END), lambda x: x IS NOT NULL), lambda x: x) AS l FROM experience_records WHERE tags IS NOT NULL))""")
def keyword_terms(spark, d):
    said = F.concat(F.array_join("tags", " OR "), F.lit(", grid world. (reward shaping), a b c d, rl"))
    return table(spark, d, "experience_records").where("tags is not null").select("paper_id", F.posexplode(text.keyword_terms(said)).alias("pos", "term"))



@query(f"""WITH e AS (SELECT id, map_entries(TRY_CAST(json_extract(m, '$.abstract_inverted_index') AS MAP(VARCHAR, INTEGER[]))) AS l FROM {_OPENALEX} WHERE json_type(m) = 'OBJECT'),
   w AS (SELECT id, no, l[no].key AS word, unnest(l[no].value) AS pos FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS no FROM e)), o AS (SELECT id, pos, arg_max(word, no) AS word FROM w WHERE pos IS NOT NULL GROUP BY id, pos)
   SELECT id, coalesce(string_agg(word, ' ' ORDER BY pos), '') AS abstract FROM raw_bundles LEFT JOIN o USING (id) GROUP BY id""")
def abstracts_single(spark, d):
    """One word per position, the last one of the index."""
    return table(spark, d, "raw_bundles").select("id", jsons.abstract_text_single(jsons.inverted_abstract(F.col("openalex_metadata"))).alias("abstract"))


@query()
def first_json_objects(spark, d):
    """The first balanced object in a chatty text around each record's metadata."""
    said = F.concat(F.lit("Sure: "), F.coalesce("crossref_metadata", F.lit("none")), F.lit(" - and {another}"))
    return table(spark, d, "raw_bundles").select("id", jsons.first_object(said).alias("object"))



@query("""SELECT paper_id, CASE WHEN extracted_text IS NULL OR extracted_text = '' THEN 0 ELSE round(0.4 * length(regexp_replace(extracted_text, '[^\\p{L}]', '', 'g')) / length(extracted_text)
   + 0.2 * (1 - len(list_filter(l, lambda x: x[-1] = '-')) / len(l)) + CASE WHEN regexp_matches(extracted_text, '(?i)(^|[^\\p{L}\\p{N}_])abstract($|[^\\p{L}\\p{N}_])') THEN 0.2 ELSE 0 END
   + CASE WHEN regexp_matches(extracted_text, '(?i)(^|[^\\p{L}\\p{N}_])introduction($|[^\\p{L}\\p{N}_])') THEN 0.2 ELSE 0 END, 6) END AS quality
   FROM (SELECT paper_id, extracted_text, string_split(regexp_replace(extracted_text, '\\n$', ''), chr(10)) AS l FROM experience_records)""")
def text_quality(spark, d):
    return table(spark, d, "experience_records").select("paper_id", F.round(texts.quality(F.col("extracted_text")), 6).alias("quality"))


@query(f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}')) AS term FROM documents WHERE text IS NOT NULL) GROUP BY ALL),
   n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), k AS (SELECT term, df, n FROM df, n WHERE df >= 2 AND df <= 0.9 * n),
   w AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN k USING (term)), s AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)
   SELECT doc_id, term, round(w / norm, 6) AS weight FROM w JOIN s USING (doc_id)""")
def weighted_terms(spark, d):
    return texts.weighted_terms(table(spark, d, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query()
def predicted_sources(spark, d):
    """Each text's source as a classifier trained on all of them sees it."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return texts.predict_classes(texts.train_classes(docs, "text", "source"), docs, "text", "doc_id")


# ---------------------------------------------------------------- bundles into works


def _truthy(c: str, p: str) -> str:
    v = f"({c}->>'$.{p}')"
    return f"CASE WHEN {v} NOT IN ('', '0', '[]', '{{}}', 'false') THEN {v} END"


_PARSED = f"""p AS (SELECT id, work_id, {_truthy('p', 'doi')} AS pd, {_truthy('c', 'doi')} AS cd, {_truthy('o', 'doi')} AS od, {_truthy('p', 'title')} AS pt, {_truthy('c', 'title')} AS ct, {_truthy('o', 'title')} AS ot,
   {_truthy('p', 'year')} AS py, {_truthy('c', 'year')} AS cy, {_truthy('o', 'year')} AS oy, {_truthy('p', 'authors')} AS pa, {_truthy('c', 'authors')} AS ca, {_truthy('o', 'authors')} AS oa, {_truthy('o', 'id')} AS oid
   FROM (SELECT id, work_id, {_DOC.format('pdf_metadata')} AS p, {_DOC.format('crossref_metadata')} AS c, {_DOC.format('openalex_metadata')} AS o FROM raw_bundles)),
   b AS (SELECT id, work_id, oid, coalesce(cd, od, pd) AS doi, CASE WHEN cd IS NOT NULL THEN 'crossref' WHEN od IS NOT NULL THEN 'openalex' WHEN pd IS NOT NULL THEN 'pdf' END AS doi_source,
   coalesce(ot, ct, pt) AS title, CASE WHEN ot IS NOT NULL THEN 'openalex' WHEN ct IS NOT NULL THEN 'crossref' WHEN pt IS NOT NULL THEN 'pdf' END AS title_source,
   coalesce(cy, oy, py) AS year, CASE WHEN cy IS NOT NULL THEN 'crossref' WHEN oy IS NOT NULL THEN 'openalex' WHEN py IS NOT NULL THEN 'pdf' END AS year_source, coalesce(oa, ca, pa) AS authors,
   CASE WHEN oa IS NOT NULL THEN 'openalex' WHEN ca IS NOT NULL THEN 'crossref' WHEN pa IS NOT NULL THEN 'pdf' END AS authors_source FROM p)"""
_KEYS = "CASE WHEN oid IS NOT NULL THEN 'work_id' WHEN doi IS NOT NULL THEN 'doi' ELSE 'unresolved' END AS key_type, coalesce(oid, doi, id::VARCHAR) AS key_value"


# ---------------------------------------------------------------- metadata inside a JSON string, titles in any script



@query(f"""SELECT id, string_agg(word, ' ' ORDER BY pos, word) AS abstract FROM (SELECT id, e.key AS word, unnest(e.value) AS pos FROM (
   SELECT id, unnest(map_entries(TRY_CAST(json_extract(m, '$.abstract_inverted_index') AS MAP(VARCHAR, INTEGER[])))) AS e FROM {_OPENALEX} WHERE json_type(m) = 'OBJECT')) WHERE pos IS NOT NULL GROUP BY id""")
def abstracts(spark, d):
    rows = table(spark, d, "raw_bundles").select("id", jsons.abstract_text(jsons.inverted_abstract(F.col("openalex_metadata"))).alias("abstract"))
    return rows.where("abstract is not null")


@query(f"""SELECT id, coalesce(nullif(m->>'$.primary_location.pdf_url', ''), list_filter(list_transform(CASE WHEN json_type(m, '$.locations') = 'ARRAY' THEN json_extract(m, '$.locations')::JSON[] END, lambda x: x->>'$.pdf_url'), lambda u: u <> '')[1]) AS url
   FROM {_OPENALEX}""")
def pdf_urls(spark, d):
    """Of every bundle; what isn't readable has no address."""
    return table(spark, d, "raw_bundles").select("id", jsons.pdf_url(F.col("openalex_metadata")).alias("url"))


@query(f"SELECT id, {_synonym_sql('title')} AS title FROM normalized_works")
def synonym_titles(spark, d):
    """Titles in any script and those that are null."""
    return table(spark, d, "normalized_works").select("id", text.with_synonyms(F.col("title")).alias("title"))


@query(f"WITH {_PARSED} SELECT id, {_KEYS} FROM b")
def identity_keys(spark, d):
    return resolve.identity(table(spark, d, "raw_bundles"))


@query(f"""WITH {_PARSED}, k AS (SELECT *, {_KEYS} FROM b),
   r AS (SELECT *, coalesce(oid, nullif(work_id, ''), 'doi:' || first_value(doi IGNORE NULLS) OVER (PARTITION BY key_type, key_value ORDER BY id ROWS UNBOUNDED PRECEDING)) AS wid FROM k),
   m AS (SELECT key_type, key_value, arg_min(wid, id) FILTER (wid IS NOT NULL) AS work_id, arg_min(doi, id) FILTER (doi IS NOT NULL) AS doi, arg_min(doi_source, id) FILTER (doi IS NOT NULL) AS doi_source,
   arg_min(title, id) FILTER (title IS NOT NULL) AS title, arg_min(title_source, id) FILTER (title IS NOT NULL) AS title_source, arg_min(year, id) FILTER (year IS NOT NULL) AS year, arg_min(year_source, id) FILTER (year IS NOT NULL) AS year_source,
   arg_min(authors_source, id) FILTER (authors IS NOT NULL) AS authors_source, array_to_string(list_sort(list(DISTINCT doi) FILTER (doi IS NOT NULL)), ' ') AS alternate_dois, array_to_string(list_sort(list(id)), ' ') AS source_bundle_ids FROM r GROUP BY ALL)
   SELECT key_type, key_value, work_id, doi, doi_source, title, title_source, year, year_source, authors_source, coalesce(alternate_dois, '') AS alternate_dois, source_bundle_ids,
   round(CASE WHEN doi IS NOT NULL THEN 0.4 ELSE 0 END + CASE WHEN work_id IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN title IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN authors_source IS NOT NULL THEN 0.1 ELSE 0 END, 6)::DOUBLE AS confidence FROM m""")
def merged_works(spark, d):
    m = resolve.merge(table(spark, d, "raw_bundles"))
    return m.select("key_type", "key_value", "work_id", "doi", "doi_source", "title", "title_source", "year", "year_source", "authors_source", F.array_join("alternate_dois", " ").alias("alternate_dois"), F.array_join(F.transform("source_bundle_ids", lambda x: x.cast("string")), " ").alias("source_bundle_ids"), F.round("confidence", 6).alias("confidence"))


@query("""SELECT doi FROM raw_bundles WHERE doi <> '' UNION SELECT doi FROM normalized_works WHERE doi <> ''""")
def all_dois(spark, d):
    return resolve.keyed_union(table(spark, d, "raw_bundles"), table(spark, d, "normalized_works"), "doi")


@query("SELECT work_id, min(id) AS id, arg_max(title, id) AS title, arg_max(confidence, id) AS confidence FROM (SELECT id, work_id, coalesce(title, '') AS title, coalesce(confidence, -1) AS confidence FROM normalized_works) GROUP BY work_id")
def last_per_work(spark, d):
    rows = table(spark, d, "normalized_works").select("id", "work_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("confidence", F.lit(-1.0)).alias("confidence"))
    return resolve.last_by(rows, "work_id", "id")


@query("""SELECT e.paper_id, coalesce(nullif(e.title, ''), w.title, e.title) AS title, coalesce(e.year, w.year) AS year FROM experience_records e
   LEFT JOIN (SELECT regexp_extract(work_id, 'W[0-9]+$', 0) AS paper_id, min(title) AS title, min(year) AS year FROM normalized_works WHERE work_id LIKE '%/W%' GROUP BY 1) w USING (paper_id)""")
def filled_records(spark, d):
    records = table(spark, d, "experience_records").select("paper_id", "title", F.col("year").cast("string").alias("year"))
    works = table(spark, d, "normalized_works").where("work_id like '%/W%'").groupBy(F.regexp_extract("work_id", "W[0-9]+$", 0).alias("paper_id")).agg(F.min("title").alias("title"), F.min("year").cast("string").alias("year"))
    return resolve.fill_missing(records, works, "paper_id", ["title", "year"]).withColumn("year", F.col("year").cast("int"))


@query("""SELECT b.id, coalesce(len(h.hits), 0)::INT AS hits, coalesce(array_to_string(h.hits, ' '), '') AS papers FROM raw_bundles b LEFT JOIN (SELECT doi, list(work_id ORDER BY id) AS hits FROM normalized_works WHERE doi <> '' GROUP BY doi) h USING (doi)""")
def bundle_hits(spark, d):
    hits = table(spark, d, "normalized_works").where("doi <> ''").select("doi", F.col("id").alias("pos"), F.col("work_id").alias("hit"))
    out = resolve.attach_hits(table(spark, d, "raw_bundles").select("id", "doi"), hits, "doi")
    return out.select("id", F.size("hits").alias("hits"), F.array_join("hits", " ").alias("papers"))


@query("""SELECT pos::INT AS pos, paper_id, strategy FROM (SELECT row_number() OVER (ORDER BY paper_id DESC) - 1 AS pos, paper_id FROM experience_records) JOIN (SELECT paper_id, arg_max(coalesce(strategy, ''), coalesce(quality_score, -1)) AS strategy FROM pdf_resolutions WHERE extracted_text IS NOT NULL GROUP BY paper_id) USING (paper_id)""")
def ordered_lookup(spark, d):
    ids = series.places(table(spark, d, "experience_records").select("paper_id"), F.desc("paper_id")).select((F.col("place") - 1).cast("int").alias("pos"), "paper_id")
    rows = table(spark, d, "pdf_resolutions").where("extracted_text is not null").select("paper_id", F.coalesce("strategy", F.lit("")).alias("strategy"), F.coalesce("quality_score", F.lit(-1.0)).alias("q"))
    return search.lookup(ids, rows, "paper_id", "pos", "q").select("pos", "paper_id", "strategy")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, upper(c_name), round(c_acctbal + 1, 2) FROM customer WHERE c_custkey % 3 = 0")
def upserted_rows(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = rows.where("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.round(F.col("c_acctbal") + 1, 2).alias("c_acctbal"))
    return resolve.upsert(rows, new, "c_custkey")


# ---------------------------------------------------------------- folders

_TREE = """n AS (SELECT c.collectionid AS k, c.collectionname AS name, CASE WHEN c.parentcollectionid <> 0 AND c.parentcollectionid <> c.collectionid THEN q.collectionid END AS p FROM collections c LEFT JOIN collections q ON q.collectionid = c.parentcollectionid),
   t AS (SELECT k, k AS root, 0 AS depth, [k] AS path, name FROM n WHERE p IS NULL UNION ALL SELECT n.k, t.root, t.depth + 1, list_append(t.path, n.k), n.name FROM t JOIN n ON n.p = t.k WHERE NOT list_contains(t.path, n.k))"""


@query(f"WITH RECURSIVE {_TREE} SELECT k AS collectionid, root, depth::INT AS depth, array_to_string(path, '/') AS path FROM t")
def folder_tree(spark, d):
    t = hierarchy.walk(table(spark, d, "collections"), "collectionid", "parentcollectionid", "collectionname")
    return t.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "/"))


_COMPACT = "CASE WHEN regexp_matches(replace({0}, '.', ''), '^[0-9]+$') THEN rtrim(regexp_replace(replace({0}, '.', ''), '(.{{3}})', '\\1.', 'g'), '.') ELSE {0} END"
_CHILD = "CASE WHEN regexp_matches(t.code, '^[0-9]+$') AND length(t.code) = 1 AND length(n.num) = 2 THEN lpad(n.num, 3, '0') WHEN regexp_matches(t.code, '^[0-9]+$') AND length(t.code) <= 2 THEN t.code || n.num ELSE t.code || '.' || n.num END"


@query(f"""WITH RECURSIVE n AS (SELECT c.collectionid AS k, CASE WHEN c.parentcollectionid <> 0 AND c.parentcollectionid <> c.collectionid THEN q.collectionid END AS p, CASE WHEN c.collectionname <> '' AND c.collectionname <> 'papers' THEN split_part(c.collectionname, ' ', 1) END AS num,
   CASE WHEN instr(c.collectionname, ' ') > 0 THEN substring(c.collectionname, instr(c.collectionname, ' ') + 1) ELSE '' END AS descr FROM collections c LEFT JOIN collections q ON q.collectionid = c.parentcollectionid),
   t AS (SELECT k, num, descr, CASE WHEN num IS NOT NULL THEN {_COMPACT.format('num')} END AS code FROM n WHERE p IS NULL
   UNION ALL SELECT n.k, n.num, n.descr, CASE WHEN n.num IS NULL THEN t.code WHEN t.code IS NULL THEN {_COMPACT.format('n.num')} ELSE {_COMPACT.format('(' + _CHILD + ')')} END FROM t JOIN n ON n.p = t.k)
   SELECT k AS collectionid, code, descr AS description FROM t WHERE num IS NOT NULL""")
def folder_codes(spark, d):
    return hierarchy.codes(table(spark, d, "collections"), "collectionid", "parentcollectionid", "collectionname").select("collectionid", "code", "description")


@query(f"WITH RECURSIVE {_TREE}, s AS (SELECT k, unnest(path) AS node, generate_subscripts(path, 1) AS pos FROM t) SELECT s.k AS collectionid, coalesce(string_agg(nullif(regexp_extract(c.collectionname, '^\\s*(\\d+)', 1), ''), '.' ORDER BY pos), '') AS code FROM s JOIN collections c ON c.collectionid = s.node GROUP BY s.k")
def folder_number_paths(spark, d):
    return hierarchy.number_path(table(spark, d, "collections"), "collectionid", "parentcollectionid", "collectionname")


@query("SELECT c.collection_key, count(d.doc_id)::INT AS items, coalesce(min(d.doc_id), -1) AS first_item FROM collections c LEFT JOIN documents d USING (collection_key) WHERE collection_key NOT IN (SELECT collection_key FROM collections WHERE collectionname = 'Duplicates') GROUP BY 1")
def folder_items(spark, d):
    folders, docs = table(spark, d, "collections"), table(spark, d, "documents")
    kept = hierarchy.active(folders, folders.where("collectionname = 'Duplicates'").select("collection_key"), "collection_key")
    out = hierarchy.items_by_node(kept, docs.select("collection_key", "doc_id"), "collection_key", "doc_id")
    return out.select("collection_key", F.size("items").alias("items"), F.coalesce(F.get("items", F.lit(0)), F.lit(-1)).alias("first_item"))


@query(f"""WITH RECURSIVE n AS (SELECT c.collectionid AS k, CASE WHEN c.parentcollectionid <> 0 AND c.parentcollectionid <> c.collectionid THEN q.collectionid END AS p, CASE WHEN c.collectionname <> '' AND c.collectionname <> 'papers' THEN split_part(c.collectionname, ' ', 1) END AS num,
   CASE WHEN instr(c.collectionname, ' ') > 0 THEN substring(c.collectionname, instr(c.collectionname, ' ') + 1) ELSE '' END AS descr FROM collections c LEFT JOIN collections q ON q.collectionid = c.parentcollectionid),
   t AS (SELECT k, [k] AS path, num, descr, CASE WHEN num IS NOT NULL THEN {_COMPACT.format('num')} END AS code FROM n WHERE p IS NULL
   UNION ALL SELECT n.k, list_append(t.path, n.k), n.num, n.descr, CASE WHEN n.num IS NULL THEN t.code WHEN t.code IS NULL THEN {_COMPACT.format('n.num')} ELSE {_COMPACT.format('(' + _CHILD + ')')} END FROM t JOIN n ON n.p = t.k)
   SELECT '| Code | Description |' || chr(10) || '|------|-------------|' || chr(10) || string_agg('| ' || code || ' | ' || descr || ' |', chr(10) ORDER BY path) AS markdown FROM t WHERE num IS NOT NULL""")
def folder_table(spark, d):
    """The folders' codes as a Markdown table."""
    rows = hierarchy.codes(table(spark, d, "collections"), "collectionid", "parentcollectionid", "collectionname")
    return sinks.markdown_table(rows, "path", "code", "description", ("Code", "Description"))


@query("""SELECT paper_id, substring(replace(regexp_replace(coalesce(title, paper_id), '[\\\\/*?:"<>|]', '', 'g'), ' ', '_'), 1, 150) AS file, '---' || chr(10) || 'title: "' || shown || '"' || chr(10)
   || CASE WHEN len(authors) > 0 THEN 'authors:' || chr(10) || array_to_string(list_transform(authors, lambda x: '  - ' || x), chr(10)) || chr(10) ELSE 'authors: []' || chr(10) END || 'year: ' || coalesce(year::VARCHAR, '') || chr(10) || 'venue: ' || coalesce(venue, '') || chr(10)
   || CASE WHEN len(tags) > 0 THEN 'tags:' || chr(10) || array_to_string(list_transform(tags, lambda x: '  - ' || x), chr(10)) || chr(10) ELSE 'tags: []' || chr(10) END || '---' || chr(10) || chr(10) || '# ' || shown || chr(10)
   || CASE WHEN abstract <> '' THEN chr(10) || '## Abstract' || chr(10) || chr(10) || abstract || chr(10) ELSE '' END || CASE WHEN llm_summary <> '' THEN chr(10) || '## Summary' || chr(10) || chr(10) || llm_summary || chr(10) ELSE '' END AS note FROM (SELECT *, coalesce(nullif(title, ''), 'Untitled') AS shown FROM experience_records)""")
def paper_notes(spark, d):
    """A Markdown note for every paper."""
    c = F.col
    return table(spark, d, "experience_records").select("paper_id", text.file_name(F.coalesce("title", "paper_id")).alias("file"), sinks.note(c("title"), c("authors"), c("year"), c("venue"), c("tags"), c("abstract"), c("llm_summary")).alias("note"))


# ---------------------------------------------------------------- graphs

EDGES = "SELECT DISTINCT src, dst FROM (SELECT doc_id // 2 AS src, doc_id AS dst FROM documents WHERE doc_id >= 2 UNION ALL SELECT doc_id // 3, doc_id FROM documents WHERE doc_id >= 3)"


def _edges(spark, d):
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("dst"))
    return ids.where("dst >= 2").select(F.expr("dst div 2").alias("src"), "dst").union(ids.where("dst >= 3").select(F.expr("dst div 3").alias("src"), "dst")).distinct()


@query(f"WITH e AS ({EDGES}) SELECT src AS v, 'root' AS kind FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT dst, 'leaf' FROM e WHERE dst NOT IN (SELECT src FROM e)")
def graph_ends(spark, d):
    e = _edges(spark, d)
    return graph.roots(e).withColumn("kind", F.lit("root")).union(graph.leaves(e).withColumn("kind", F.lit("leaf")))


@query(f"WITH RECURSIVE e AS ({EDGES}), t AS (SELECT 1::BIGINT AS v, 0 AS n UNION SELECT e.dst, t.n + 1 FROM t JOIN e ON e.src = t.v) SELECT v, max(n)::INT AS distance FROM (SELECT v, n FROM t UNION ALL SELECT src, NULL FROM e UNION ALL SELECT dst, NULL FROM e) GROUP BY v")
def graph_longest_distances(spark, d):
    return graph.longest_distances(_edges(spark, d), 1)


@query(f"WITH RECURSIVE e AS ({EDGES}), t AS (SELECT 3::BIGINT AS v, 0 AS n UNION SELECT e.dst, t.n + 1 FROM t JOIN e ON e.src = t.v) SELECT v, min(n)::INT AS depth FROM t GROUP BY v")
def graph_reached(spark, d):
    return graph.reached(_edges(spark, d), 3)


@query(f"WITH e AS ({EDGES}), f AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e WHERE dst % 5 = 0), o AS (SELECT *, src * 1000000 + dst AS ord FROM f) SELECT src, dst FROM o a WHERE ord = (SELECT min(ord) FROM o b WHERE least(b.src, b.dst) = least(a.src, a.dst) AND greatest(b.src, b.dst) = greatest(a.src, a.dst))")
def graph_one_way(spark, d):
    e = _edges(spark, d)
    f = e.unionByName(e.where("dst % 5 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("ord", F.expr("src * 1000000 + dst"))
    return graph.one_way(f, "ord").select("src", "dst")


@query(f"WITH RECURSIVE e AS ({EDGES}), v AS (SELECT DISTINCT x FROM (SELECT src AS x FROM e UNION SELECT dst FROM e) WHERE x % 3 <> 1), w AS (SELECT src, dst FROM e WHERE src IN (SELECT x FROM v) UNION SELECT w.src, e.dst FROM w JOIN e ON e.src = w.dst WHERE w.dst NOT IN (SELECT x FROM v)) SELECT src, dst FROM w WHERE dst IN (SELECT x FROM v) AND src <> dst")
def graph_contracted(spark, d):
    e = _edges(spark, d)
    return graph.contract(e, graph.vertices(e).where("v % 3 <> 1"))


_MAIN = f"""e AS ({EDGES}), t AS (SELECT 1::BIGINT AS v, 0 AS n UNION SELECT e.dst, t.n + 1 FROM t JOIN e ON e.src = t.v), l AS (SELECT v, max(n) AS n FROM t GROUP BY v),
   b AS (SELECT e.dst AS v, min(e.src) AS up FROM e JOIN l x ON x.v = e.src JOIN l y ON y.v = e.dst WHERE x.n = y.n - 1 GROUP BY e.dst),
   m AS (SELECT n AS pos, v FROM (SELECT * FROM l ORDER BY n DESC, v LIMIT 1) UNION ALL SELECT m.pos - 1, b.up FROM m JOIN b USING (v) WHERE m.pos > 0)"""


@query(f"WITH RECURSIVE {_MAIN} SELECT pos::INT AS pos, v FROM m")
def graph_main_path(spark, d):
    return graph.longest_path(_edges(spark, d), 1, "src")


@query(f"WITH RECURSIVE {_MAIN}, c AS (SELECT src FROM e GROUP BY src HAVING count(DISTINCT dst) > 1) SELECT DISTINCT e.src, e.dst FROM e JOIN m a ON a.v = e.src JOIN m z ON z.v = e.dst JOIN c ON c.src = e.src WHERE z.pos <> a.pos + 1")
def graph_skips(spark, d):
    e = _edges(spark, d)
    return graph.skip_edges(e, graph.longest_path(e, 1, "src"))


@query(f"WITH RECURSIVE {_TREE} SELECT root, (row_number() OVER (PARTITION BY root ORDER BY path) - 1)::INT AS pos, k AS v FROM t WHERE root IN (SELECT root FROM t WHERE depth > 0)")
def graph_walk(spark, d):
    """Folders in depth-first order, one walk per root."""
    t = hierarchy.walk(table(spark, d, "collections"), "collectionid", "parentcollectionid", "collectionname")
    e = t.where("depth > 0").select("root", F.element_at("path", -2).alias("src"), F.col("collectionid").alias("dst"))
    return graph.depth_first(e, "root", "dst")


# ---------------------------------------------------------------- series, dates, sorting

GAPPY = "SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events"


def _gappy(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))


@query(f"SELECT event_id, user_id, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS filled FROM ({GAPPY})")
def gaps_filled(spark, d):
    return series.fill_gaps(_gappy(spark, d), "user_id", "event_id", "v").select("event_id", "user_id", F.round("filled", 6).alias("filled"))


@query(f"""WITH g AS ({GAPPY}), r AS (SELECT *, count(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
   m AS (SELECT user_id, k, avg(v) OVER (PARTITION BY user_id ORDER BY k ROWS 4 PRECEDING) AS a FROM r WHERE v IS NOT NULL)
   SELECT event_id, r.user_id, round(CASE WHEN (SELECT max(k) FROM m WHERE m.user_id = r.user_id) >= 5 THEN m.a END, 6) AS average FROM r LEFT JOIN m ON m.user_id = r.user_id AND m.k = greatest(r.k, 5)""")
def moving_means(spark, d):
    return series.moving_average(_gappy(spark, d), "user_id", "event_id", "v", 5).select("event_id", "user_id", F.round("average", 6).alias("average"))


@query("SELECT event_id, user_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS change, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def step_rewards(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    e = series.running_total(series.step_change(e, "user_id", "event_id", "value"), "user_id", "event_id", "value")
    return e.select("event_id", "user_id", F.round("change", 6).alias("change"), F.round("total", 4).alias("total"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_visits(spark, d):
    return series.first_visits(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("SELECT p_size, ceil(round(1 + (rank - 1) * 9.0 / (n - 1), 9))::INT AS shown FROM (SELECT p_size, row_number() OVER (ORDER BY p_size) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT p_size FROM part))")
def display_sizes(spark, d):
    return series.display_sizes(table(spark, d, "part"), "p_size", 1, 10)


WRITTEN = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-d-%-m-%Y') WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y %H:%M:%S') ELSE 'n.d.' END"


def _written(spark, d):
    o, date = table(spark, d, "orders"), F.col("o_orderdate")
    n = F.col("o_orderkey") % 4
    return o.select("o_orderkey", F.when(n == 0, F.date_format(date, "yyyy-MM-dd")).when(n == 1, F.date_format(date, "d-M-yyyy")).when(n == 2, F.date_format(date, "dd-MM-yyyy HH:mm:ss")).otherwise("n.d.").alias("written"))


@query(f"SELECT o_orderkey, written, CASE WHEN written = 'n.d.' THEN NULL ELSE o_orderdate::DATE END AS parsed, CASE WHEN written = 'n.d.' THEN written ELSE strftime(o_orderdate, '%d-%m-%Y') END AS shown FROM (SELECT o_orderkey, o_orderdate, {WRITTEN} AS written FROM orders)")
def dates_in_formats(spark, d):
    return _written(spark, d).select("o_orderkey", "written", dates.parsed_date(F.col("written")).alias("parsed"), dates.shown_date(F.col("written")).alias("shown"))



@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN written = 'n.d.' THEN NULL ELSE o_orderdate::DATE END ASC NULLS FIRST, o_orderkey)::BIGINT AS place FROM (SELECT o_orderkey, o_orderdate, {WRITTEN} AS written FROM orders)")
def typed_order(spark, d):
    """The place of every row in a list sorted by dates written in several formats, unreadable ones first."""
    rows = _written(spark, d).withColumn("date", dates.parsed_date(F.col("written")))
    return series.places(rows, F.col("date").asc_nulls_first(), F.col("o_orderkey").asc()).select("o_orderkey", "place")


# ---------------------------------------------------------------- records and lists


@query("SELECT o_orderkey, o_orderdate::DATE AS o_orderdate FROM orders WHERE o_orderkey = 7")
def one_record(spark, d):
    return records.record(table(spark, d, "orders"), "o_orderkey", 7).select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))


@query("SELECT doc_id, paper_id FROM documents WHERE paper_id IS DISTINCT FROM (SELECT min(paper_id) FROM documents)")
def records_left(spark, d):
    """All documents but those of the first paper; those of no paper stay."""
    docs = table(spark, d, "documents").select("doc_id", "paper_id")
    return records.delete(docs, "paper_id", docs.agg(F.min("paper_id")).first()[0])


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE written END AS written, o_orderstatus FROM (SELECT *, {WRITTEN} AS written FROM orders)")
def order_list(spark, d):
    """The orders by key, dates written year first shown day first."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(_written(spark, d), "o_orderkey")
    return records.list_view(rows, "o_orderkey", "written", ["written", "o_orderstatus"])


@query(f"SELECT o_orderkey, CASE WHEN written = 'n.d.' THEN written ELSE strftime(o_orderdate + INTERVAL 1 DAY, '%d-%m-%Y') END AS next_day, CASE WHEN written = 'n.d.' THEN written ELSE strftime(o_orderdate - INTERVAL 1 DAY, '%d-%m-%Y') END AS day_before FROM (SELECT *, {WRITTEN} AS written FROM orders)")
def dates_moved(spark, d):
    c = F.col("written")
    return _written(spark, d).select("o_orderkey", dates.moved_date(c, 1).alias("next_day"), dates.moved_date(c, -1).alias("day_before"))


@query("SELECT doc_id, CASE WHEN length(text) > 0 THEN 'A' ELSE '' END AS marker FROM documents")
def content_markers(spark, d):
    return table(spark, d, "documents").select("doc_id", records.blob_marker(F.col("text")).alias("marker"))


@query("SELECT work_id, count(DISTINCT coalesce(year, -1)) = 1 AS equal_years FROM normalized_works GROUP BY work_id")
def works_of_one_year(spark, d):
    return table(spark, d, "normalized_works").groupBy("work_id").agg(records.all_equal(F.col("year")).alias("equal_years"))


@query("SELECT v.work_id, coalesce(min(w.title), '') AS title FROM work_vectors v LEFT JOIN normalized_works w USING (work_id) GROUP BY v.work_id")
def vector_titles(spark, d):
    return records.titles(table(spark, d, "work_vectors").select("work_id"), table(spark, d, "normalized_works"), "work_id", "title")


_ITEMS = """it AS (SELECT id, CASE id % 5 WHEN 0 THEN 'journalArticle' WHEN 1 THEN 'conferencePaper' WHEN 2 THEN 'bookSection' WHEN 3 THEN 'book' ELSE 'webpage' END AS itemType, title, CASE WHEN id % 3 = 0 THEN doi END AS DOI, CASE WHEN id % 2 = 0 THEN year::VARCHAR END AS date, CASE WHEN id % 7 = 0 THEN 'Known' ELSE '' END AS publicationTitle, '' AS proceedingsTitle, CAST(NULL AS VARCHAR) AS bookTitle, '' AS volume, '' AS issue, '' AS pages FROM normalized_works),
   hit AS (SELECT title, arg_min(doi, id) AS h_doi, arg_min('Journal ' || id, id) AS h_container, arg_min(year::VARCHAR, id) AS h_year, arg_min((id % 40)::VARCHAR, id) AS h_volume FROM (SELECT id, title, coalesce(doi, '') AS doi, coalesce(year, 0) AS year FROM normalized_works WHERE title IS NOT NULL) GROUP BY title)"""


def _items(spark, d):
    works, id_, none = table(spark, d, "normalized_works"), F.col("id"), F.lit("")
    kind = F.when(id_ % 5 == 0, "journalArticle").when(id_ % 5 == 1, "conferencePaper").when(id_ % 5 == 2, "bookSection").when(id_ % 5 == 3, "book").otherwise("webpage")
    items = works.select("id", kind.alias("itemType"), "title", F.when(id_ % 3 == 0, F.col("doi")).alias("DOI"), F.when(id_ % 2 == 0, F.col("year").cast("string")).alias("date"), F.when(id_ % 7 == 0, "Known").otherwise("").alias("publicationTitle"), none.alias("proceedingsTitle"), F.lit(None).cast("string").alias("bookTitle"), none.alias("volume"), none.alias("issue"), none.alias("pages"))
    hits = works.where("title is not null").select("title", id_.alias("position"), F.coalesce("doi", none).alias("DOI"), F.concat(F.lit("Journal "), id_.cast("string")).alias("container_title"), F.coalesce("year", F.lit(0)).cast("string").alias("published_year"), (id_ % 40).cast("string").alias("volume"), none.alias("issue"), F.lit(None).cast("string").alias("page"))
    return items, hits


@query(f"""WITH {_ITEMS}, m AS (SELECT it.*, h.* EXCLUDE (title) FROM it LEFT JOIN hit h ON h.title = it.title AND it.title <> '' AND coalesce(it.DOI, '') = '')
   SELECT id, itemType, title, CASE WHEN coalesce(DOI, '') = '' THEN coalesce(nullif(h_doi, ''), DOI) ELSE DOI END AS DOI, CASE WHEN coalesce(date, '') = '' THEN coalesce(h_year, date) ELSE date END AS date,
   CASE WHEN publicationTitle = '' AND itemType = 'journalArticle' THEN coalesce(h_container, '') ELSE publicationTitle END AS publicationTitle, CASE WHEN itemType = 'conferencePaper' THEN coalesce(h_container, '') ELSE '' END AS proceedingsTitle,
   CASE WHEN itemType = 'bookSection' THEN h_container END AS bookTitle, CASE WHEN itemType IN ('journalArticle', 'conferencePaper') THEN coalesce(h_volume, '') ELSE '' END AS volume, '' AS issue, '' AS pages FROM m""")
def enriched_items(spark, d):
    items, hits = _items(spark, d)
    return records.enriched(items, hits, "id")


@query(f"WITH {_ITEMS} SELECT id, itemType FROM it WHERE itemType IN ('journalArticle', 'conferencePaper', 'bookSection', 'report', 'Report', 'thesis', 'preprint', 'manuscript')")
def publications_only(spark, d):
    return records.of_types(_items(spark, d)[0], "itemType").select("id", "itemType")


@query(f"WITH {_ITEMS} SELECT id, title FROM it WHERE title <> '' AND coalesce(DOI, '') = ''")
def items_to_look_up(spark, d):
    return records.lacking(_items(spark, d)[0], "title", "DOI").select("id", "title")


@query(f"WITH {_ITEMS} SELECT title, h_doi AS doi FROM hit")
def first_hits(spark, d):
    return records.first_hit(_items(spark, d)[1].select("title", "position", F.col("DOI").alias("doi")), "title", "position")


# ---------------------------------------------------------------- papers


@query(f"""WITH p AS (SELECT e.paper_id, nullif(e.pdf_url, '') AS own, {_DOC.format('w.openalex_metadata')} AS m FROM experience_records e LEFT JOIN (SELECT regexp_extract(work_id, 'W[0-9]+$', 0) AS paper_id, min(openalex_metadata) AS openalex_metadata FROM normalized_works WHERE work_id LIKE '%/W%' GROUP BY 1) w USING (paper_id)),
   u AS (SELECT paper_id, own, coalesce(nullif(m->>'$.primary_location.pdf_url', ''), list_filter(list_transform(CASE WHEN json_type(m, '$.locations') = 'ARRAY' THEN json_extract(m, '$.locations')::JSON[] END, lambda x: x->>'$.pdf_url'), lambda u: u <> '')[1]) AS found FROM p),
   d AS (SELECT pdf_url, min(nullif(local_path, '')) AS local_path, min(error) AS failure FROM pdf_resolutions WHERE pdf_url IS NOT NULL GROUP BY 1), t AS (SELECT local_path, min(nullif(extracted_text, '')) AS extracted_text FROM pdf_resolutions WHERE local_path <> '' GROUP BY 1),
   j AS (SELECT u.paper_id, coalesce(own, found) AS pdf_url, CASE WHEN own IS NOT NULL THEN 'explicit_pdf_url' WHEN found IS NOT NULL THEN 'openalex_primary_location' END AS strategy, d.local_path, t.extracted_text, d.failure FROM u LEFT JOIN d ON d.pdf_url = coalesce(own, found) LEFT JOIN t ON t.local_path = d.local_path)
   SELECT paper_id, pdf_url, strategy, local_path, length(extracted_text)::INT AS characters, CASE WHEN pdf_url IS NULL THEN 'no_pdf_url_found' WHEN failure IS NOT NULL THEN failure WHEN local_path IS NULL THEN 'download_failed' WHEN extracted_text IS NULL THEN 'extraction_failed' END AS error FROM j""")
def resolved_papers(spark, d):
    """Every paper through the steps of resolution, with the attempts on record as what downloads and text engines gave."""
    works = table(spark, d, "normalized_works").where("work_id like '%/W%'").groupBy(F.regexp_extract("work_id", "W[0-9]+$", 0).alias("paper_id")).agg(F.min("openalex_metadata").alias("openalex_metadata"))
    asked = table(spark, d, "experience_records").select("paper_id", "pdf_url").join(works, "paper_id", "left")
    tries = table(spark, d, "pdf_resolutions")
    downloads = tries.where("pdf_url is not null").groupBy(F.col("pdf_url").alias("url")).agg(F.min(F.nullif("local_path", F.lit(""))).alias("local_path"), F.min("error").alias("failure"))
    read = tries.where("local_path <> ''").groupBy("local_path").agg(F.min(F.nullif("extracted_text", F.lit(""))).alias("extracted_text")).withColumn("failure", F.lit(None).cast("string"))
    return papers.resolution(asked, downloads, read).select("paper_id", "pdf_url", "strategy", "local_path", F.length("extracted_text").alias("characters"), "error")


_HITS = f"""h AS (SELECT id AS bundle, generate_subscripts(l, 1) - 1 AS position, unnest(l) AS item FROM (SELECT id, CASE WHEN json_type(m) = 'ARRAY' THEN m::JSON[] WHEN json_type(m) = 'OBJECT' THEN [m] END AS l FROM (SELECT id, {_DOC.format('search_hits_openalex')} AS m FROM raw_bundles)))"""


def _hits(spark, d):
    v = jsons.document(F.col("search_hits_openalex"))
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.array(v)))
    rows = table(spark, d, "raw_bundles").select(F.col("id").alias("term_no"), F.lit("grid worlds").alias("query"), F.posexplode(items).alias("position", "v"))
    return rows.where("v is not null").select("term_no", "query", "position", F.to_json("v").alias("item"))


@query(f"WITH {_HITS}, i AS (SELECT bundle, position, item->>'$.id' AS id, item->>'$.title' AS title FROM h) SELECT id, min(bundle) AS first_bundle, arg_max(coalesce(title, ''), bundle * 100000 + position) AS title FROM i WHERE id IS NOT NULL GROUP BY id")
def fetched_works(spark, d):
    """The works of all searches, each once: met first in this bundle, as the last bundle has it."""
    out = papers.fetched(_hits(spark, d))
    title = F.coalesce(F.try_variant_get(F.try_parse_json("item"), "$.title", "string"), F.lit(""))
    return out.select("id", F.col("position.term_no").alias("first_bundle"), title.alias("title"))


@query()
def pipeline_notes(spark, d):
    """Notes of the first five works whose metadata are known, summarised by their first words."""
    rows = table(spark, d, "raw_bundles").where(F.try_variant_get(jsons.document(F.col("openalex_metadata")), "$.abstract_inverted_index", "string").isNotNull())
    hits = rows.select(F.col("id").alias("term_no"), F.lit("known").alias("query"), F.lit(0).alias("position"), F.to_json(jsons.document(F.col("openalex_metadata"))).alias("item"))
    return papers.pipeline(hits, first=5, summarise=lambda title, abstract: " ".join(abstract.split()[:12]))


@query("SELECT id, list_distinct(list_filter(['https://arxiv.org/pdf/' || nullif(arxiv_id, '') || '.pdf', 'https://doi.org/' || nullif(doi, ''), CASE WHEN doi <> '' THEN 'https://mirror.example/' || work_id END], lambda x: x <> '')).len()::INT AS n, list_filter(['https://arxiv.org/pdf/' || nullif(arxiv_id, '') || '.pdf', 'https://doi.org/' || nullif(doi, ''), CASE WHEN doi <> '' THEN 'https://mirror.example/' || work_id END], lambda x: x <> '')[1] AS first_url FROM raw_bundles")
def pdf_addresses(spark, d):
    found = papers.candidates(F.lit(""), F.col("arxiv_id"), F.col("doi"), F.concat(F.lit("https://mirror.example/"), "work_id"))
    return table(spark, d, "raw_bundles").select("id", F.size(found).alias("n"), F.get(found, F.lit(0)).alias("first_url"))


@query(f"WITH {_PARSED}, k AS (SELECT b.id, {_KEYS}, pm, cm, om FROM b JOIN (SELECT id, " + ", ".join(f"CASE WHEN ({_DOC.format(c)})->>'$' NOT IN ('', '0', '[]', '{{}}', 'false') THEN md5({c}) END AS {c[0]}m" for c in ("pdf_metadata", "crossref_metadata", "openalex_metadata")) + " FROM raw_bundles) USING (id)) SELECT key_type, key_value, arg_min(pm, id) AS pdf, arg_min(cm, id) AS crossref, arg_min(om, id) AS openalex FROM k GROUP BY ALL")
def merged_metadata(spark, d):
    """Of each work and source the first bundle's metadata that aren't empty, as digests."""
    m = resolve.merge(table(spark, d, "raw_bundles"))
    return m.select("key_type", "key_value", *[F.md5(f"{s}_metadata").alias(s) for s in ("pdf", "crossref", "openalex")])


@query()
def text_vectors(spark, d):
    """The documents' vectors by the model-free encoder."""
    return embed.encode(table(spark, d, "documents"), "doc_id", "text", embed.hashing_encoder(32))


@query("SELECT e.paper_id, array_to_string(list_slice(string_split('1.22.333.4444.' || (e.year % 7), '.'), 1, 4), '.') AS label, length(coalesce(t.text, ''))::INT AS characters FROM experience_records e LEFT JOIN (SELECT paper_id, min(extracted_text) AS text FROM pdf_resolutions GROUP BY 1) t USING (paper_id) WHERE e.year IS NOT NULL")
def labelled_texts(spark, d):
    codes = table(spark, d, "experience_records").where("year is not null").select("paper_id", F.concat(F.lit("1.22.333.4444."), (F.col("year") % 7).cast("string")).alias("code"))
    found = table(spark, d, "pdf_resolutions").groupBy("paper_id").agg(F.min("extracted_text").alias("text"))
    return texts.dataset(codes, found, "paper_id", "code", "text").select("paper_id", "label", F.length("text").alias("characters"))


# ---------------------------------------------------------------- diagrams, trees, archives


@query(f"WITH RECURSIVE e AS ({EDGES}), r AS (SELECT DISTINCT src AS v FROM e WHERE src NOT IN (SELECT dst FROM e)), t AS (SELECT v, 0 AS n FROM r UNION SELECT e.dst, t.n + 1 FROM t JOIN e ON e.src = t.v), l AS (SELECT v, max(n) AS level FROM t GROUP BY v) SELECT v, level::INT AS level, row_number() OVER (ORDER BY level, v)::BIGINT AS place FROM l")
def graph_order(spark, d):
    return graph.topological(_edges(spark, d))


@query()
def diagram_chain(spark, d):
    """The main chain of a diagram with two kinds of vertices shown, and where skip edges come from."""
    e = _edges(spark, d).where("src > 0")
    kinds = graph.vertices(e).select("v", F.when(F.col("v") % 3 == 0, "ReLU").when(F.col("v") % 2 == 0, "Conv2d").otherwise("Linear").alias("kind"))
    path, skips = graph.main_chain(e, kinds, ["Conv2d", "Linear"])
    labels = kinds.select("v", F.concat(F.lit("<b>"), "kind", F.lit("</b> (1, 64, "), (F.col("v") % 7 + 1).cast("string"), F.lit(", 8)")).alias("label"))
    return layers.chain_nodes(path, labels, skips)


def _layers(spark, d):
    """Every order as a network, its lines as layers."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("net"), F.col("l_linenumber").alias("at"), F.element_at(F.array(*[F.lit(x) for x in ("Conv2d", "ReLU", "MaxPool2d", "Conv2d", "Linear", "add_", "ConvTranspose2d")]), (F.col("l_partkey") % 7 + 1).cast("int")).alias("type"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("height"))
    return rows.withColumn("width", F.col("height"))


@query()
def network_blocks(spark, d):
    return layers.path_blocks(_layers(spark, d), "net", "at")


@query()
def network_documents(spark, d):
    return layers.document(layers.path_blocks(_layers(spark, d), "net", "at"), "net")


@query()
def folder_export(spark, d):
    """Every tree of folders as JSON, with the documents of each folder and their papers."""
    folders, docs = table(spark, d, "collections"), table(spark, d, "documents")
    items = docs.where("collection_key is not null").join(folders.select("collection_key", "collectionid"), "collection_key").select("collectionid", "doc_id", F.col("source").alias("title"))
    files = docs.where("paper_id is not null").select("doc_id", F.concat("paper_id", F.lit(".pdf")).alias("attachment"))
    return hierarchy.export(folders, "collectionid", "parentcollectionid", "collectionname", hierarchy.with_attachments(items, files, "doc_id", "collectionid"))


@query("SELECT doc_id, 'note.txt' AS name, text FROM documents WHERE text IS NOT NULL")
def archived_texts(spark, d):
    """Texts put into ZIP archives and taken out again."""
    blobs = table(spark, d, "documents").where("text is not null").select("doc_id", engines.zipped(F.lit("note.txt"), F.encode("text", "UTF-8")).alias("blob"))
    return blobs.select("doc_id", F.explode(engines.unzipped("blob")).alias("f")).select("doc_id", "f.name", F.decode("f.content", "UTF-8").alias("text"))


@query("SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?i)10\\.\\d{4,9}/[-._;()/:A-Z0-9]+', 0), ''), '10.1/' || doc_id) AS doi FROM documents")
def cascaded_dois(spark, d):
    """A text's DOI from its header, itself or its properties."""
    said = F.map_from_arrays(F.array(F.lit("a"), F.lit("subject")), F.array(F.lit("none"), F.concat(F.lit("see doi:10.1000/"), F.col("doc_id").cast("string"))))
    found = engines.found_doi(F.lit("<TEI/>"), F.col("text"), said)
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(found, "^10\\.1000/", "10.1/").alias("doi"))


# ---------------------------------------------------------------- sources: texts in the formats that the readers take


@query("SELECT p_partkey, 'k' || p_partkey AS id, 'article' AS kind, p_name AS title, 'Ann Larkstone|Ekmann, Bo' AS authors, p_size::VARCHAR AS year, '10.5/' || p_partkey AS doi FROM part")
def bibtex_fields(spark, d):
    """Every part as a BibTeX entry, read again."""
    c = F.col
    body = F.concat(F.lit("@Article{k"), c("p_partkey"), F.lit(", Title = {"), c("p_name"), F.lit('}, author = "Ann Larkstone and Ekmann, Bo", year = '), c("p_size"), F.lit(", doi = {https://doi.org/10.5/"), c("p_partkey"), F.lit("}}\n@broken{x, title = {"))
    e = table(spark, d, "part").select("p_partkey", F.explode(files.bibtex_entries(body)).alias("e"))
    return e.select("p_partkey", c("e.ID").alias("id"), c("e.ENTRYTYPE").alias("kind"), c("e.title").alias("title"), F.array_join(F.split("e.author", r"\s+and\s+"), "|").alias("authors"), c("e.year").alias("year"), text.canonical_doi(c("e.doi")).alias("doi"))


@query("SELECT c_custkey, 'On ' || c_mktsegment AS title, c_mktsegment || ' study' AS abstract, '1999' AS year, '10.6/' || c_custkey AS doi, 40 + c_custkey % 3 AS authors, 'N0 ' || c_name AS first_author, CASE WHEN c_custkey % 2 = 0 THEN 'Institute ' || c_nationkey ELSE 'Department' END AS affiliation FROM customer")
def tei_fields(spark, d):
    """Every customer as a TEI document with some forty authors, read again."""
    c, s = F.col, lambda x: F.col(x).cast("string")
    org = F.when(c("c_custkey") % 2 == 0, F.concat(F.lit('<orgName type="institution">Institute '), s("c_nationkey"), F.lit("</orgName>"))).otherwise("")
    person = lambda i: F.concat(F.lit("<author><persName><forename>N"), i.cast("string"), F.lit("</forename><surname>"), c("c_name"), F.lit('</surname></persName><affiliation><orgName type="department">Department</orgName>'), org, F.lit("</affiliation></author>"))
    people = F.array_join(F.transform(F.sequence(F.lit(0), (39 + c("c_custkey") % 3).cast("int")), person), "")
    doc = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>On '), c("c_mktsegment"), F.lit("</title></titleStmt><sourceDesc><biblStruct><analytic>"), people, F.lit('</analytic><monogr><imprint><date when="1999-05-01"/></imprint></monogr><idno type="DOI">10.6/'), s("c_custkey"), F.lit("</idno></biblStruct></sourceDesc></fileDesc><profileDesc><abstract><p>"), c("c_mktsegment"), F.lit("</p><p>study</p></abstract></profileDesc></teiHeader></TEI>"))
    # a small table, but much work a row: more tasks than its file gives
    spread = table(spark, d, "customer").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")
    r = spread.select("c_custkey", files.tei_record(doc).alias("r"))
    first = F.get("r.authors", F.lit(0))
    return r.select("c_custkey", "r.title", "r.abstract", "r.year", "r.doi", F.size("r.authors").alias("authors"), F.concat_ws(" ", first["given"], first["family"]).alias("first_author"), first["affiliation"].alias("affiliation"))


@query("SELECT s_suppkey, kind, x, y, reward FROM (SELECT s_suppkey, 'Unreachable' AS kind, (s_suppkey % 3)::INT AS x, 0 AS y, NULL::DOUBLE AS reward FROM supplier UNION ALL SELECT s_suppkey, 'Reward', 1, 1, s_acctbal FROM supplier)")
def maze_cells(spark, d):
    """Every supplier as a maze, its cells read again."""
    doc = F.concat(F.lit("<Maze><dimensions><Width>3</Width><Height>2</Height></dimensions><Unreachable><Cell><x>"), F.col("s_suppkey") % 3, F.lit("</x><y>0</y></Cell></Unreachable><Reward><Cell><x>1</x><y>1</y><reward>"), F.col("s_acctbal"), F.lit("</reward></Cell></Reward></Maze>"))
    read = table(spark, d, "supplier").select("s_suppkey", F.explode(files.maze_cells(files.maze(doc))).alias("c"))
    return read.select("s_suppkey", "c.*")


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '#..' WHEN 1 THEN '.#.' ELSE '..#' END || '|.+.' AS drawn FROM supplier")
def maze_pictures(spark, d):
    doc = F.concat(F.lit("<Maze><dimensions><Width>3</Width><Height>2</Height></dimensions><Unreachable><Cell><x>"), F.col("s_suppkey") % 3, F.lit("</x><y>0</y></Cell></Unreachable><Reward><Cell><x>1</x><y>1</y><reward>2</reward></Cell></Reward></Maze>"))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(files.maze_rows(files.maze(doc)), "|").alias("drawn"))


@query(f"SELECT src, dst, 0 AS ord FROM ({EDGES}) UNION ALL SELECT dst, src, 1 FROM ({EDGES})")
def graph_texts(spark, d):
    """Edges written as graph texts with a way back, read again."""
    line = F.concat(F.lit("digraph {\n"), "src", F.lit(" -> "), "dst", F.lit(" [label=x]\n"), "dst", F.lit("->"), "src", F.lit("\n}"))
    return _edges(spark, d).select(F.explode(files.graph_edges(line)).alias("e")).select("e.src", "e.dst", "e.ord")


@query("SELECT p_partkey, 'Conv2d' AS type, 64 AS channels, p_size AS height, p_size + 1 AS width, p_size + 1 AS second FROM part")
def tensor_shapes(spark, d):
    size = F.col("p_size").cast("int")
    shape = F.concat(F.lit("(1, 64, "), size, F.lit(", "), size + 1, F.lit(")"))
    i = layers.node_info(F.concat(F.lit("<b>Conv2d</b> in (1, 3, 5, 5) out "), shape))
    return table(spark, d, "part").select("p_partkey", i["type"].alias("type"), i["channels"].alias("channels"), i["height"].cast("long").alias("height"), i["width"].cast("long").alias("width"), F.get(files.tensor_shape(shape), F.lit(2)).cast("long").alias("second"))


@query("SELECT p_partkey, 'http://a/' || p_partkey AS id, p_name AS title, 'Ann B|C D' AS authors FROM part")
def atom_feeds(spark, d):
    c = F.col
    feed = F.concat(F.lit("<feed><title>all</title><entry><id>http://a/"), c("p_partkey"), F.lit("</id><title> "), c("p_name"), F.lit("\n</title><author><name>Ann B</name></author><author><name>C D</name></author></entry></feed>"))
    e = table(spark, d, "part").select("p_partkey", F.explode(paged.atom_entries(feed)).alias("e"))
    return e.select("p_partkey", "e.id", "e.title", F.array_join("e.authors", "|").alias("authors"))


def _service(query: str, cursor: str | None, size: int) -> tuple[list, str | None]:
    """A service of 130 numbered hits for every query."""
    at = int(cursor or 0)
    return [{"id": f"{query}{i}", "doi": f"https://doi.org/10.7/{query.upper()}{i}", "title": f"T {i}"} for i in range(at, min(at + size, 130))], str(at + size) if at + size < 130 else None


@query("SELECT q AS query, i::INT AS position, '10.7/' || q || i AS doi, 'T ' || i AS title FROM (SELECT unnest(['a', 'b', 'c']) AS q), range(100) r(i)")
def paged_hits(spark, d):
    """The first hundred hits of three queries from a service given as a callable."""
    return paged.projected(paged.search(spark, ["a", "b", "c"], target=100, size=30, transport=_service), {"doi": "doi", "title": "title"})


@query("SELECT y::INT AS year, i::INT AS position, '10.7/a ' || y || i AS doi FROM range(2001, 2004) t(y), range(10) r(i)")
def yearly_hits(spark, d):
    return paged.search_years(spark, "a", range(2001, 2004), target=10, size=4, transport=_service).select("year", "position", "doi")


@query(f"""WITH k AS (SELECT DISTINCT {DOI} AS doi FROM raw_bundles WHERE {DOI} <> ''), c AS (SELECT {DOI} AS doi, count(*) AS n FROM normalized_works WHERE doi IS NOT NULL GROUP BY 1)
   SELECT 'doi:' || k.doi AS work_id, k.doi, (n > 0) IS TRUE AS known, CASE WHEN n > 0 THEN '[]' ELSE '["crossref: no record","openalex: no record"]' END AS errors FROM k LEFT JOIN c ON c.doi = k.doi""")
def built_bundles(spark, d):
    """A bundle for every DOI, with the works as what both lookup services know."""
    known = table(spark, d, "normalized_works").where("doi is not null").select("doi", "title", "year")
    out = build.from_dois(table(spark, d, "raw_bundles"), known, known)
    return out.select("work_id", "doi", (F.col("crossref_metadata") != "{}").alias("known"), "errors")


@query("SELECT user_id, date_trunc('hour', ts) AS start, round(avg(value), 6) AS mean, count(value) AS values FROM events GROUP BY 1, 2")
def hourly_means(spark, d):
    """The streaming operator over the whole table as one batch."""
    out = gaps.windowed_means(table(spark, d, "events"), "ts", "user_id", "value")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.round("mean", 6).alias("mean"), "values")
