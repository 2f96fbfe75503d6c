"""Files through engines that are given: PDF texts with fallback, header services, ZIP archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import file_doi, first_doi, internal_doi, truthy
from lectern.sources.files import tei_record


def installed_engines() -> list[Callable[[bytes], str]]:
    """The PDF engines that can be imported here, best first; none where there is no PDF library."""
    found: list[Callable[[bytes], str]] = []
    try:
        import fitz

        found.append(lambda content: "\n".join(page.get_text() for page in fitz.open(stream=content)))
    except ImportError:
        pass
    try:
        import pypdf

        found.append(lambda content: "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages))
    except ImportError:
        pass
    return found


def pdf_texts(files: DataFrame, engines: list[Callable[[bytes], str]] | None = None, content: str = "content") -> DataFrame:
    """`files` with extracted_text in place of the content: the text of the first engine that gives one, null where none does. An engine that
    fails is passed over; a file of any size is given whole."""
    tools = installed_engines() if engines is None else engines
    keep = [c for c in files.columns if c != content]
    schema = files.select(*keep, F.lit(None).cast("string").alias("extracted_text")).schema

    def text_of(data: bytes | None) -> str | None:
        for tool in tools if data else []:
            try:
                if text := tool(bytes(data)):
                    return text
            except Exception:  # noqa: BLE001 - an engine's failure is the next one's turn
                continue
        return None

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p[keep].assign(extracted_text=pd.Series([text_of(x) for x in p[content]], dtype=object, index=p.index))

    return files.select(*keep, content).mapInPandas(run, schema)


def first_doi_of(values: Column) -> Column:
    """The first DOI among the values of a map, in their order; null if there is none."""
    return F.get(F.filter(F.transform(F.map_values(values), first_doi), lambda x: x.isNotNull()), F.lit(0))


def found_doi(tei: Column, text: Column, properties: Column) -> Column:
    """A file's DOI: that of its TEI header, else the first in its text, else the first among its properties."""
    return F.coalesce(truthy(tei_record(tei)["doi"]), first_doi(text), first_doi_of(properties))


def header_records(files: DataFrame) -> DataFrame:
    """(path, doi, header, fulltext) of `files(path, content, header, fulltext)`, whose TEI texts a service has made: the header's DOI, else a
    stand-in from title, authors and year, else one from the file's bytes."""
    t = tei_record(F.col("header"))
    names = F.transform(t["authors"], lambda a: F.concat_ws(" ", a["given"], a["family"]))
    whole = truthy(t["title"]).isNotNull() & (F.size(names) > 0) & t["year"].isNotNull()
    doi = F.coalesce(truthy(t["doi"]), F.when(whole, internal_doi(t["title"], names, t["year"])), file_doi(F.col("content")))
    return files.select("path", doi.alias("doi"), "header", "fulltext")


@F.pandas_udf(T.BinaryType())
def zipped(names: pd.Series, contents: pd.Series) -> pd.Series:
    """A ZIP archive that holds the content under the name; null without content."""

    def one(name: str, content: bytes | None) -> bytes | None:
        if content is None:
            return None
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo(name or "file"), bytes(content))
        return out.getvalue()

    return pd.Series([one(n, c) for n, c in zip(names, contents)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType())])))
def unzipped(blobs: pd.Series) -> pd.Series:
    """The files of a ZIP archive; null for null and for what is no archive."""

    def one(blob: bytes | None) -> list | None:
        try:
            with zipfile.ZipFile(io.BytesIO(blob)) as z:
                return [{"name": n, "content": z.read(n)} for n in z.namelist()]
        except (TypeError, zipfile.BadZipFile):
            return None

    return pd.Series([one(b) for b in blobs], dtype=object)
