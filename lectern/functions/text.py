"""Text expressions: blanks, JSON lists, tokens, identifiers, file names, class codes. All are built-in functions, no UDFs.

"Missing" means what it means in the data's project: null, empty text, empty list (see `truthy`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that search treats as one term, replaced in this order.
SYNONYMS = {
    "gridworld": ["grid world", "grid-world", "grid-based environment", "grid environment", "grid-based", "2d grid", "2-d grid", "grid navigation", "grid mdp", "tabular grid", "cell-based environment", "discrete grid", "spatial grid"],
    "reinforcement_learning": ["reinforcement learning", "rl", "model-free rl", "model-based rl"],
}


def strip(c: Column) -> Column:
    """Without outer white space of any kind (`trim` takes only spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def truthy(c: Column) -> Column:
    """Null where a text is missing."""
    return F.nullif(c, F.lit(""))


def doi_key(c: Column) -> Column:
    """The DOI in `c` from its `10.` on, lower-cased, without outer blanks; null if there is none."""
    at = F.locate("10.", F.col(c) if isinstance(c, str) else c)
    return F.when(at > 0, F.lower(strip(F.substr(c, at))))


def json_list(c: Column) -> Column:
    """The items of a JSON list as texts (null items dropped); null where `c` is null, unreadable or no list."""
    return F.filter(F.from_json(c, "array<string>"), lambda x: x.isNotNull())


def tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def with_synonyms(c: Column) -> Column:
    """Lower case, with every spelling of SYNONYMS at word boundaries (of words in any script) replaced by its term."""
    pairs = [(v, term) for term, variants in SYNONYMS.items() for v in variants]
    return reduce(lambda t, p: F.regexp_replace(t, r"(?U)\b" + p[0].replace("-", r"\-") + r"\b", p[1]), pairs, F.lower(c))


def canonical_doi(c: Column) -> Column:
    """Trimmed, without resolver address or `doi:`, lower case; null stays null and empty stays empty."""
    t = F.regexp_replace(strip(c), r"(?i)^https?://(dx\.)?doi\.org/", "")
    return F.lower(F.regexp_replace(F.regexp_replace(t, r"(?i)^doi:\s*", ""), r"(?i)^doi\s+", ""))


def first_doi(c: Column) -> Column:
    """The first DOI in a text, as written; null if there is none."""
    return truthy(F.regexp_extract(c, r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+", 0))


def plain(c: Column) -> Column:
    """Lower case, blanks collapsed, then everything but letters, digits, `_` and blanks dropped (which may leave double blanks), then trimmed."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " ")
    return strip(F.regexp_replace(t, r"(?U)[^\p{L}\p{N}_\s]", ""))


def author_key(names: Column) -> Column:
    """The last words of all names in plain form, sorted, in one text; empty for null and empty lists."""
    last = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.element_at(F.split(plain(n), r"\s+"), -1))
    return F.array_join(F.array_sort(last), " ")


def internal_doi(title: Column, names: Column, year: Column) -> Column:
    """A stand-in DOI from the SHA-1 of title, authors and year."""
    return F.concat(F.lit("10.0000/"), F.sha1(F.concat(title, F.lit("|"), F.array_join(names, ","), F.lit("|"), year.cast("string"))))


def synthetic_id(title: Column, names: Column, year: Column) -> Column:
    """An identifier for works without any, from the SHA-1 of the plain title, author key and year; missing parts are empty."""
    y = F.coalesce(year.cast("string"), F.lit(""))
    return F.concat(F.lit("synthetic:"), F.sha1(F.concat(plain(title), F.lit("||"), author_key(names), F.lit("||"), F.when(y == "0", "").otherwise(y))))


def file_doi(content: Column) -> Column:
    """A stand-in DOI from the SHA-256 of a file's bytes."""
    return F.concat(F.lit("10.0000/pdf-"), F.sha2(content, 256))


def snake_name(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def note_name(c: Column) -> Column:
    """Without the characters that file systems forbid, trimmed."""
    return strip(F.regexp_replace(c, r'[\\/*?:"<>|]', ""))


def file_name(c: Column, length: int = 150) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(c, r'[\\/*?:"<>|]', ""), " ", "_"), 1, length)


def safe_name(c: Column) -> Column:
    """Letters, digits and `._-` only; `paper` if nothing is left."""
    return F.coalesce(truthy(F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "")), F.lit("paper"))


def keyword_terms(c: Column) -> Column:
    """The terms of a loosely written keyword list: split at commas and OR, without brackets and full stops, at most three words, each once."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?i)\bOR\b", ","), r"[().]", "")
    parts = F.filter(F.transform(F.split(t, ","), strip), lambda x: (x != "") & (F.size(F.split(x, r"\s+")) <= 3))
    return F.array_distinct(parts)


def yaml_list(items: Column) -> Column:
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), x)), "\n")
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "[]").otherwise(lines)


def name_code(c: Column) -> Column:
    """What stands before the first blank."""
    return F.split_part(c, F.lit(" "), F.lit(1))


def name_description(c: Column) -> Column:
    """What stands after the first blank; empty without one."""
    at = F.instr(c, " ")
    return F.when(at > 0, F.substr(c, at + 1)).otherwise("")


def compact_code(c: Column) -> Column:
    """A class code in groups of three digits; codes with other characters stay as they are."""
    bare = F.regexp_replace(c, "^books", "")
    raw = F.regexp_replace(bare, r"\.", "")
    return F.when(raw.rlike(r"^\d+$"), F.regexp_replace(raw, "(.{3})(?=.)", "$1.")).otherwise(bare)


def child_code(parent: Column, number: Column) -> Column:
    """The code of a child: appended up to three digits, after a point from then on. A two-digit number below a one-digit parent
    replaces it, padded to three digits; without a parent the number is the code."""
    digits = parent.rlike(r"^\d+$")
    return (
        F.when(parent.isNull(), number)
        .when(digits & (F.length(parent) == 1) & (F.length(number) == 2), F.lpad(number, 3, "0"))
        .when(digits & (F.length(parent) <= 2), F.concat(parent, number))
        .otherwise(F.concat(parent, F.lit("."), number))
    )


def leading_digits(c: Column) -> Column:
    return truthy(F.regexp_extract(c, r"^\s*(\d+)", 1))


def attachment_path(c: Column) -> Column:
    return F.regexp_replace(c, "^attachments:", "")


def collapsed_code(c: Column, depth: int = 4) -> Column:
    return F.substring_index(c, ".", depth)


def work_identifier(doi: Column, arxiv: Column, title: Column, names: Column, year: Column) -> Column:
    """doi:, arxiv:, a stand-in DOI, or a synthetic identifier: the first for which there is something to make it from."""
    whole = truthy(title).isNotNull() & (F.size(names) > 0) & year.isNotNull()
    return F.coalesce(F.concat(F.lit("doi:"), truthy(doi)), F.concat(F.lit("arxiv:"), truthy(arxiv)), F.when(whole, internal_doi(title, names, year)), synthetic_id(title, names, year))
