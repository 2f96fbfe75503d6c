"""Full-text search: index, BM25 ranking, concept filter and boost, dense re-ranking.

The index is three tables: postings(term, doc_id, tf), terms(term, df), docs(doc_id, dl), plus one row of corpus statistics and the words. All come from
one tokenised scan with map-side partial aggregation. A query is a handful of terms, so its side of the joins is broadcast: its size
is bounded by the query's length, never by the corpus. Top-k is an ordered take, not a global sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import tokens, with_synonyms

K1, B = 1.5, 0.75


@dataclass
class Index:
    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    stats: DataFrame
    words: DataFrame


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf): how often each term is in each document; documents without tokens give no rows."""
    return docs.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def build_index(docs: DataFrame, key: str, text: Column, synonyms: bool = False) -> Index:
    """Documents with null or blank text are not indexed and don't count in the statistics."""
    said = with_synonyms(text) if synonyms else text
    rows = docs.select(F.col(key).alias("doc_id"), tokens(said).alias("tokens"), text.alias("_t")).where(F.length(F.regexp_replace("_t", r"(?U)\s+", "")) > 0)
    words = rows.select("doc_id", F.explode("tokens").alias("term"))
    post = words.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    length = rows.select("doc_id", F.size("tokens").cast("long").alias("dl"))
    return Index(post, post.groupBy("term").agg(F.count("*").alias("df")), length, length.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), words)


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def query_terms(spark, query: str, synonyms: bool = False) -> DataFrame:
    """(term, times, qpos): the query's terms with their count and first position; it has as many rows as the query has words."""
    text = F.lit(query)
    row = spark.range(1).select(F.posexplode(tokens(with_synonyms(text) if synonyms else text)).alias("qpos", "term"))
    return row.groupBy("term").agg(F.count("*").alias("times"), F.min("qpos").alias("qpos"))


def bm25(index: Index, query: str, synonyms: bool = False, k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score, first): the score of every document that holds a query term; a term counts as often as the query has it.
    first is the position of the first such term. A query without terms gives no rows."""
    q = F.broadcast(query_terms(index.postings.sparkSession, query, synonyms))
    # words are filtered by the query's terms before anything is shuffled; of the terms as many rows are left as the query has
    hit = index.words.join(q, "term").groupBy("doc_id", "term", "times", "qpos").agg(F.count("*").alias("tf"))
    df = F.broadcast(hit.groupBy("term").agg(F.count("*").alias("df")))
    scored = hit.join(df, "term").join(index.docs, "doc_id").join(F.broadcast(index.stats), how="cross")
    part = F.col("times") * idf(F.col("n"), F.col("df")) * term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return scored.groupBy("doc_id").agg(F.sum(part).alias("score"), F.min("qpos").alias("first"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best; ties go to the term met first in the query, then to the smaller id."""
    return scores.orderBy(F.round("score", 9).desc(), "first", "doc_id").limit(k)


def concept_boost(concepts: Column, boosted: list[str]) -> Column:
    """The sum of the scores of the boosted concepts that a document has."""
    return F.aggregate(F.filter(concepts, lambda c: c["id"].isin(*boosted)), F.lit(0.0), lambda a, c: a + c["score"]) if boosted else F.lit(0.0)


def has_concepts(concepts: Column, required: list[str]) -> Column:
    """Does a document have all required concepts? None required: yes."""
    return F.size(F.array_except(F.array(*map(F.lit, required)), F.transform(concepts, lambda c: c["id"]))) == 0 if required else F.lit(True)


def concept_search(index: Index, concepts: DataFrame, query: str, k: int = 20, required: list[str] | None = None, boosted: list[str] | None = None, alpha: float = 1.0, synonyms: bool = False) -> DataFrame:
    """(doc_id, bm25_score, concept_boost, final_score): of the 5k best by BM25 those with all required concepts, by
    bm25 + alpha * boost. The cut to 5k comes before the filter on purpose. concepts(doc_id, concepts) has one row per document."""
    hits = F.broadcast(top(bm25(index, query, synonyms), max(5 * k, k)))  # at most 5k rows
    rows = concepts.join(hits, "doc_id").where(has_concepts(F.col("concepts"), required or []))
    boost = concept_boost(F.col("concepts"), boosted or [])
    out = rows.select("doc_id", F.col("score").alias("bm25_score"), boost.alias("concept_boost"), (F.col("score") + alpha * boost).alias("final_score"), "first")
    return out.orderBy(F.round("final_score", 9).desc(), F.round("bm25_score", 9).desc(), "first", "doc_id").limit(k).drop("first")


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a zero vector or unequal lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def similar(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """(key, cosine): the k vectors most similar to one query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine(F.col(vector), q).alias("cosine")).where("cosine is not null").orderBy(F.col("cosine").desc(), key).limit(k)


def hybrid_search(index: Index, vectors: DataFrame, concepts: DataFrame, query: str, query_vector: list[float], k: int = 20, boosted: list[str] | None = None, alpha: float = 1.0, pool: int = 300, synonyms: bool = False) -> DataFrame:
    """(doc_id, bm25_score, cosine, final_score): of the `pool` best by BM25 those with a vector, by bm25 + alpha * cosine + boost,
    where the boost starts at 1 and isn't scaled. vectors(doc_id, vector) and concepts(doc_id, concepts) have one row per document."""
    hits = F.broadcast(top(bm25(index, query, synonyms), pool))  # at most `pool` rows
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    rows = vectors.join(hits, "doc_id").select("doc_id", "score", "first", cosine(F.col("vector"), q).alias("cosine")).where("cosine is not null")
    rows = concepts.join(F.broadcast(rows), "doc_id", "right")
    final = F.col("score") + alpha * F.col("cosine") + 1 + F.coalesce(concept_boost(F.col("concepts"), boosted or []), F.lit(0.0))
    return rows.select("doc_id", F.col("score").alias("bm25_score"), "cosine", final.alias("final_score"), "first").orderBy(F.round("final_score", 9).desc(), F.round("bm25_score", 9).desc(), "first", "doc_id").limit(k).drop("first")


def lookup(ids: DataFrame, rows: DataFrame, key: str, position: str, latest: str) -> DataFrame:
    """The rows of the given ids in the ids' order; ids without a row are dropped, of several rows the one with the largest `latest` counts."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), latest).alias("r")).select(key, "r.*")
    return ids.join(last, key).orderBy(position)
