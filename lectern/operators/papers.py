"""From search hits to papers with texts and notes: per-term fetches, candidate addresses, resolution of full texts, the pipeline.

What leaves the cluster (downloads, text engines, language models) is a table that another job has written or a callable that is given; the
steps around it are joins and expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.jsons import abstract_text, display_names, document, pdf_url
from lectern.functions.text import note_name, truthy
from lectern.operators.texts import quality
from lectern.sources.sinks import note


def fetched(hits: DataFrame, concept: str | None = None) -> DataFrame:
    """(id, position, item): the hits `hits(query, position, item)` of all terms, each work once: in the place where it was met first, as it
    was met last. Terms go in the order of `term_no`, if there is one; hits without an id are dropped, blank terms fetch nothing."""
    v = F.try_parse_json("item")
    rows = hits.where(F.trim("query") != "").withColumn("id", F.try_variant_get(v, "$.id", "string")).where("id is not null")
    if concept is not None:
        ids = F.transform(F.try_variant_get(v, "$.concepts", "array<struct<id:string>>"), lambda c: c["id"])
        rows = rows.where(F.array_contains(ids, concept))
    at = F.struct(F.col("term_no") if "term_no" in hits.columns else F.lit(0).alias("term_no"), "query", "position")
    return rows.groupBy("id").agg(F.min(at).alias("position"), F.max_by("item", at).alias("item"))


def candidates(oa: Column, arxiv: Column, doi: Column, *others: Column) -> Column:
    """All addresses under which a paper's PDF may be found, in order of preference, each once; `others` are those that services name
    for a DOI, and count only where there is one."""
    made = [oa, F.concat(F.lit("https://arxiv.org/pdf/"), truthy(arxiv), F.lit(".pdf")), F.concat(F.lit("https://doi.org/"), truthy(doi))]
    made += [F.when(truthy(doi).isNotNull(), o) for o in others]
    return F.array_distinct(F.array_compact(F.array(*[F.nullif(m, F.lit("")) for m in made])))


def first_fetched(papers: DataFrame, key: str, urls: str, downloads: DataFrame) -> DataFrame:
    """Every paper with the first of its addresses that `downloads(url, local_path)` could keep, null where none could."""
    tried = papers.select(key, F.posexplode(urls).alias("no", "url")).join(downloads.where("local_path is not null"), "url")
    best = tried.groupBy(key).agg(F.min_by(F.struct("url", "local_path"), "no").alias("_d"))
    return papers.join(best, key, "left").select(*papers.columns, F.col("_d.url").alias("url"), F.col("_d.local_path").alias("local_path"))


def resolution(papers: DataFrame, downloads: DataFrame, texts: DataFrame) -> DataFrame:
    """(paper_id, pdf_url, local_path, extracted_text, strategy, quality_score, error) for every paper of
    `papers(paper_id, pdf_url, openalex_metadata)`: its own address comes first, else that of its metadata.

    `downloads(url, local_path, failure)` and `texts(local_path, extracted_text, failure)` have one row per address and path. What went
    wrong is the error: no_pdf_url_found, download_failed, extraction_failed, or the text of a failure, with everything known till then.
    """
    own, found = truthy(F.col("pdf_url")), pdf_url(F.col("openalex_metadata"))
    at = papers.select("paper_id", F.coalesce(own, found).alias("pdf_url"), F.when(own.isNotNull(), "explicit_pdf_url").when(found.isNotNull(), "openalex_primary_location").alias("strategy"))
    got = downloads.select(F.col("url").alias("pdf_url"), truthy(F.col("local_path")).alias("local_path"), F.col("failure").alias("_f"))
    read = texts.select("local_path", truthy(F.col("extracted_text")).alias("extracted_text"), F.col("failure").alias("_g"))
    out = at.join(got, "pdf_url", "left").join(read, "local_path", "left")
    error = F.coalesce(F.when(F.col("pdf_url").isNull(), "no_pdf_url_found"), F.col("_f"), F.when(F.col("local_path").isNull(), "download_failed"), F.col("_g"), F.when(F.col("extracted_text").isNull(), "extraction_failed"))
    score = F.when(error.isNull(), quality(F.col("extracted_text")))
    return out.select("paper_id", "pdf_url", "local_path", "extracted_text", "strategy", score.alias("quality_score"), error.alias("error"))


def summarised(papers: DataFrame, summarise: Callable[[str, str], str] | None) -> DataFrame:
    """With a summary of title and abstract by the given callable, which runs in Arrow batches on the executors; empty without one."""
    if summarise is None:
        return papers.withColumn("summary", F.lit(""))

    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for titles, abstracts in parts:
            yield pd.Series([summarise(t, a) for t, a in zip(titles, abstracts)], index=titles.index)

    return papers.withColumn("summary", run("title", "abstract"))


def pipeline(hits: DataFrame, concept: str | None = None, first: int = 5, summarise: Callable[[str, str], str] | None = None) -> DataFrame:
    """(position, id, file, note): Markdown notes of the first `first` works of all terms; those without an abstract are skipped
    but count."""
    works = fetched(hits, concept).orderBy("position", "id").limit(first)
    v = document(F.col("item"))
    at = lambda p: F.try_variant_get(v, f"$.{p}", "string")
    index = F.try_variant_get(v, "$.abstract_inverted_index", "map<string,array<int>>")
    read = works.select("position", "id", F.coalesce(at("title"), F.lit("")).alias("title"), display_names(v).alias("authors"), at("publication_year").alias("year"), at("primary_location.source.display_name").alias("venue"), abstract_text(index).alias("abstract"))
    read = summarised(read.where("abstract is not null"), summarise)
    c = F.col
    return read.select("position", "id", F.concat(note_name(c("title")), F.lit(".md")).alias("file"), note(c("title"), c("authors"), c("year"), c("venue"), F.array().cast("array<string>"), c("abstract"), c("summary")).alias("note"))
