"""Problem 3: the same work in different sources, without a common identifier.

A deterministic cascade. Every rule is an exact join on an attribute combination, each weaker than the one before, and has a pass of its own:
records that an earlier pass has resolved are anti-joined before their keys are made, so a pass joins the records still open with all.
Candidates are verified in the JVM (edit distance of titles, series marks, years, authors). A rule's confidence is its precision,
smoothed by Laplace's rule of succession: its pairs with two different catalogue ids against all of its pairs that would carry two ids
if these were spread by chance. (Of the labelled pairs only, the right ones are missing in later passes, as earlier ones have resolved
them.) A rule whose confidence is too low resolves nothing. Equal catalogue ids link groups before the cascade, but resolve no record,
so that they can serve as labels.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.bundles import bundle_groups
from lectern.llm.components import connected_components
from lectern.llm.names import ORG_WORDS, distance, fold, parse
from lectern.plans.runtime import cut, table

# Closing words that make a work another one than its namesake.
MARKS = ["areplication", "revisited", "areply", "acomment", "erratum", "corrigendum", "addendum", "correction", "secondedition"]
PART = re.compile(r"\W*\b(?:part|pt|vol|volume|no|number|chapter|book|teil|band|del|partie|parte|tome)\.?\s*([ivxlc]{1,5}|\d{1,3})\W*$", re.I)
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_MARKUP = re.compile(r"<[^<>]{1,20}>|[{}$\\]")
_MISREAD = re.compile(r"(?<=[a-z])[0159](?=[a-z]|\b)|\b[0159](?=[a-z]{2})")
_OTHER = re.compile(r"[^a-z0-9]+")
_YEAR = re.compile(r"\d{4}")
_WORK = re.compile(r"/W\d+$")
SCHEMA = "id long, catalogue string, title string, main string, mark string, open boolean, authors array<string>, surnames array<string>, year int"


def _number(text: str) -> int:
    if text.isdigit():
        return int(text)
    v = [ROMAN[c] for c in text.lower()]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


def _letters(text: str) -> str:
    """The letters and digits of any script, with the vowel signs that some scripts write as marks."""
    if text.isascii():
        return _OTHER.sub("", text)
    return "".join(c for c in text if c.isalnum() or unicodedata.category(c)[0] == "M")


@lru_cache(50_000)
def title_parts(raw: str) -> tuple[str, str, str, bool]:
    """(letters of the title without its series mark, letters of its part before a colon or "", mark, is it cut short?)"""
    t = _MARKUP.sub("", raw).strip()
    short = t.endswith(("...", "…"))
    t = t.removesuffix("…").removesuffix("...") if short else t
    t = fold(t)
    # digits inside words are misread letters
    t = _MISREAD.sub(lambda m: {"0": "o", "1": "l", "5": "s", "9": "g"}[m[0]], t)
    mark = ""
    tail = t.rstrip("\t \n.,;:!?()[]'\"-")[-1:]
    if (tail in "ivxlc0123456789" or not tail.isalnum()) and (m := PART.search(t)):
        mark, t = f"part {_number(m[1])}", t[: m.start()]
    letters = _letters(t)
    for end in MARKS:
        if not short and len(letters) > len(end) + 8 and letters[-len(end)] == end[0] and distance(letters[-len(end) :], end) <= 2:
            mark = f"{mark} {end}".strip()
            letters = letters[: -len(end)]
            t = t[: max(t.rfind(":"), 0)] if ":" in t and len(_letters(t[: t.rfind(":")])) >= len(letters) - 1 else t
            break
    head = _letters(t.split(":", 1)[0]) if ":" in t else ""
    return letters, head if 12 <= len(head) < len(letters) else "", mark, short


@lru_cache(50_000)
def _words(name: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(the words of a name that may be its surname, the likeliest of them)."""
    org, toks = parse(name)
    # names of other scripts may be of two or three letters
    words = [(t, r) for t, r in toks if (len(t) > 3 or len(t) > 1 and not t.isascii()) and t not in ORG_WORDS]
    if org:
        return (words[0][0],) * bool(words), (words[0][0],) * bool(words)
    said = tuple(t for t, r in words if r == "S")
    return said or tuple(t for t, _ in words), said or tuple(sorted((t for t, _ in words), key=len)[-1:])


def _surnames(text: object) -> tuple[list[str], list[str]]:
    """(all words of the names but initials, the likeliest surname of each name) of authors as JSON or as a bare name."""
    authors: object = text
    if isinstance(text, str) and text[:1] in ("[", "{"):
        try:
            authors = json.loads(text)
        except ValueError:
            return [], []
    out: set[str] = set()
    likely: set[str] = set()
    for a in authors if isinstance(authors, list) else [authors]:
        if isinstance(a, dict):
            inner = a.get("author")
            a = a.get("name") or (inner.get("display_name") if isinstance(inner, dict) else None)
        if isinstance(a, str) and a.strip():
            words, best = _words(a)
            out.update(words)
            likely.update(best)
    return sorted(out), sorted(likely)


def _described(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        rows = []
        for i, work, oid, *texts in p.itertuples(index=False, name=None):
            named = next((x for x in (oid, work) if isinstance(x, str) and _WORK.search(x)), None)
            for title, authors, year in zip(texts[::3], texts[1::3], texts[2::3]):
                if isinstance(title, str) and (parts_ := title_parts(title))[0]:
                    m = _YEAR.search(year or "")
                    rows.append((i, named, *parts_, *_surnames(authors), int(m[0]) if m else None))
        out = pd.DataFrame(rows, columns=["id", "catalogue", "title", "main", "mark", "open", "authors", "surnames", "year"])
        yield out.astype({"year": "Int32", "id": "int64", "open": bool})


def descriptions(bundles: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per title that a source of a bundle gives; unreadable, null and misshapen metadata give none.

    Spark's JSON reader takes the few fields out of the documents, so that only they go to Python."""
    def said(c: str) -> Column:
        text = F.when(F.ltrim(c).startswith('"'), F.get_json_object(c, "$")).otherwise(F.col(c))
        return F.from_json(text, "id string, title string, authors string, year string").alias(c[0])

    read = bundles.where("id is not null").select("id", "work_id", *map(said, ("pdf_metadata", "crossref_metadata", "openalex_metadata")))
    slim = read.select("id", "work_id", F.col("o.id").alias("oid"), *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in "pco" for f in ("title", "authors", "year")])
    return slim.mapInPandas(_described, SCHEMA).join(groups.select("id", F.col("group_id").alias("g")), "id")


CATALOGUE = "catalogue id"


def rules() -> list[tuple[str, Column]]:
    """(name, keys) from strong to weak, for a record; without the attributes it has no key."""
    near = F.array_distinct(F.flatten(F.transform("own_years", lambda y: F.array(y, y + 1))))
    # a character of these scripts says as much as two letters or more
    dense = F.col("title").rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")
    whole, long = ~F.col("open") & (F.length("title") >= F.when(dense, 4).otherwise(8)), F.length("title") >= 12
    back = F.when(~F.col("open"), F.substring("title", -12, 12))

    def keys(*parts: Column | str) -> Column:
        return F.xxhash64(*parts)

    each = lambda f: F.transform("surnames", f)
    dated = lambda f: F.flatten(F.transform(near, f))
    # every pair, as a misspelt or extra name may stand between two right ones in the sorted list
    couples = F.flatten(F.transform("surnames", lambda a, i: F.transform(F.slice("surnames", i + 2, F.size("surnames")), lambda b: keys(a, b))))
    return [
        ("title, author", F.when(whole, each(lambda a: keys("title", "mark", a)))),
        ("title, year", F.when(whole, F.transform(near, lambda y: keys("title", "mark", y)))),
        ("title, no year", F.when(whole, F.array(keys("title", "mark")))),
        ("title end, author, year", F.when(long, dated(lambda y: each(lambda a: keys(back, a, y))))),
        ("long title start, author", F.when(F.length("title") >= 18, each(lambda a: keys(F.substring("title", 1, 18), a)))),
        ("two authors, year", dated(lambda y: F.transform(couples, lambda c: keys(c, y)))),
        ("title start, year", F.when(F.length("title") >= 12, F.transform(near, lambda y: keys(F.substring("title", 1, 12), y)))),
        ("title piece, author, year", F.when(F.length("title") >= 12, F.flatten(F.transform("own_years", lambda y: F.flatten(each(lambda a: F.transform(_pieces(), lambda p: keys(p, a, y)))))))),
    ]


def _pieces() -> Column:
    """Pieces of a title's start for the rule on cut-off titles.

    `agrees` lets the shorter title differ by three edits from the longer one's start, so of the four pieces of three letters that a
    title starts with one is unchanged, at most three places away. Every title has these four; a cut-off one also has what stands up to
    three places from them.
    """
    own = [(n, 3 * n) for n in range(4)]
    moved = [(n, 3 * n + by) for n in range(4) for by in range(-3, 4) if by and 3 * n + by >= 0]
    piece = lambda n, at: F.struct(F.lit(n).alias("n"), F.substring("title", at + 1, 3).alias("p"))
    return F.when(F.col("open"), F.array(*[piece(n, at) for n, at in own + moved])).otherwise(F.array(*[piece(n, at) for n, at in own]))


#: The fields of `packed`: name, first bit, bits.
FIELDS = [("len", 0, 15), ("head", 15, 15), ("open", 30, 1), ("from", 31, 14), ("to", 45, 14)]


def packed() -> Column:
    """Lengths of title and main part, whether it is cut short, first and last year (0: unknown) of a record in one number, as
    a row of a join takes eight bytes for every field."""
    most = F.lit(32000)
    parts = {"len": F.least(F.length("title"), most), "head": F.least(F.length("main"), most), "open": F.col("open").cast("int"), "from": F.coalesce(F.array_min("years"), F.lit(0)), "to": F.coalesce(F.array_max("years"), F.lit(0))}
    return sum((F.shiftleft(parts[n].cast("long"), at) for n, at, _ in FIELDS), F.lit(0).cast("long"))


def most_edits(shorter: Column) -> Column:
    """How far two whole titles of one work may be apart, by the length of the shorter one."""
    return F.greatest(F.lit(2), F.least(F.lit(5), F.floor(shorter * 0.07).cast("int")))


#: The letters that are counted in `letter_counts`, of seven bits each.
COUNTED = "etaoinsrl"


def letter_counts() -> Column:
    """How often a title has the most frequent letters, up to 127 times each, in one number."""
    count = lambda c: F.least(F.length("title") - F.length(F.replace("title", F.lit(c), F.lit(""))), F.lit(127))
    return sum((F.shiftleft(count(c).cast("long"), 7 * i) for i, c in enumerate(COUNTED)), F.lit(0).cast("long"))


def may_agree(counted: bool = False) -> Column:
    """What must hold of lengths and years, and of the `letter_counts` if there are any, for `agrees` to hold."""
    l, r = ({n: F.shiftright(f"{x}_pack", at).bitwiseAND((1 << bits) - 1) for n, at, bits in FIELDS} for x in "lr")
    a, b, ah, bh = l["len"], r["len"], l["head"], r["head"]
    # an edit changes the length by one at most, and the counts of two letters
    most = most_edits(F.least(a, b))
    near = F.abs(a - b) <= most
    if counted:
        of = lambda x, i: F.shiftright(f"{x}_counts", 7 * i).bitwiseAND(127)
        near = near & (sum((F.abs(of("l", i) - of("r", i)) for i in range(len(COUNTED))), F.lit(0)) <= 2 * most)
    cut_off = (l["open"] == 1) & (a < b) | (r["open"] == 1) & (b < a)
    headed = (ah > 0) & (bh == 0) & (F.abs(ah - b) <= 2) | (bh > 0) & (ah == 0) & (F.abs(bh - a) <= 2)
    years = (l["from"] == 0) | (r["from"] == 0) | (l["from"] - 1 <= r["to"]) & (r["from"] - 1 <= l["to"])
    return (near | cut_off | headed) & years


def cut_off() -> Column:
    """Is either title of a candidate pair cut short?"""
    return F.shiftright("l_pack", 30).bitwiseOR(F.shiftright("r_pack", 30)).bitwiseAND(1) == 1


def no_year() -> Column:
    """Is the year of either side of a candidate pair unknown?"""
    return (F.shiftright("l_pack", 31).bitwiseAND((1 << 14) - 1) == 0) | (F.shiftright("r_pack", 31).bitwiseAND((1 << 14) - 1) == 0)


#: The rules of which many candidates have titles of a near length that are far apart.
COUNTING = {"title start, year"}
#: What the candidates of a rule must have besides its key.
ONLY = {"title, no year": no_year, "title piece, author, year": cut_off}


def confidence(pairs: int, wrong: int, with_id: float) -> float:
    """The smoothed precision of a rule that found `pairs`, `wrong` of them with two different catalogue ids, if a record has an id with
    probability `with_id`."""
    labelled = pairs * with_id**2
    return max(labelled - wrong + 1, 1) / (max(labelled, wrong) + 2)


def agrees() -> Column:
    """Do the two descriptions of a candidate pair describe one work?"""
    a, b = F.col("l_title"), F.col("r_title")
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    cap = most_edits(shorter)

    def within(x: Column, y: Column, n: int) -> Column:  # with a bound the distance is -1 beyond it, and much cheaper
        return F.levenshtein(x, y, n) >= 0

    d5 = F.levenshtein(a, b, 5)
    close = (longer - shorter <= 5) & (d5 >= 0) & (d5 <= cap)
    start = lambda s, t: (F.length(s) >= 12) & (F.length(t) > F.length(s)) & within(F.substr(t, F.lit(1), F.length(s)), s, 3)
    cut_off = F.col("l_open") & start(a, b) | F.col("r_open") & start(b, a)
    headed = (F.col("l_main") != "") & (F.col("r_main") == "") & within(F.col("l_main"), b, 2) | (F.col("r_main") != "") & (F.col("l_main") == "") & within(F.col("r_main"), a, 2)
    marks = F.col("l_mark") == F.col("r_mark")
    years = lambda d: F.exists("l_years", lambda x: F.exists("r_years", lambda y: F.abs(x - y) <= d))
    unknown = (F.size("l_years") == 0) | (F.size("r_years") == 0)
    nobody = (F.size("l_authors") == 0) | (F.size("r_authors") == 0)
    like = lambda x, y: (x == y) | (F.least(F.length(x), F.length(y)) >= 6) & (F.levenshtein(x, y, 2) >= 0)
    shared = F.size(F.filter("l_authors", lambda x: F.exists("r_authors", lambda y: like(x, y))))
    met, most = shared > 0, 2 * shared >= F.least(F.size("l_authors"), F.size("r_authors"))
    # what a shortened title has lost may be a series mark, so its year must be the same
    same_title = close & marks | (cut_off | headed) & (years(0) | unknown & marks)
    return (years(1) | unknown) & (longer - shorter < 90) & same_title & (~unknown | met & most) & (met | nobody & (a == b) & ~unknown)


def records_of(said: DataFrame) -> DataFrame:
    """One record per title of a group, with the years and the catalogue id of the whole group; a title's authors are pooled, so the
    keys grow with the titles and not with their product."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    titles = said.groupBy("g", "title", "main", "mark", "open").agg(union("authors").alias("authors"), union("surnames").alias("surnames"), F.collect_set("year").alias("own_years"), F.max("catalogue").alias("catalogue"))
    group = Window.partitionBy("g")
    pooled = titles.withColumn("years", F.array_sort(F.array_distinct(F.flatten(F.collect_set("own_years").over(group))))).withColumn("catalogue", F.max("catalogue").over(group))
    return pooled.withColumn("rid", F.monotonically_increasing_id())


def candidates(records: DataFrame, keys: Column, resolved: DataFrame | None, only: Column | None = None, counting: bool = False) -> DataFrame:
    """(l_rid, r_rid): the pairs of an open and any record of different groups with a common key and near lengths and years, if `counting`
    also with near counts of letters."""
    own = ["rid", "g", "pack", "counts"][: 3 + counting]
    # only numbers are joined on; the texts come in once per pair
    slim = records.select("rid", "g", packed().alias("pack"), *[letter_counts().alias("counts")] * counting, keys.alias("keys"))
    if resolved is not None:
        slim = slim.join(resolved.withColumn("done", F.lit(True)), "g", "left")
    else:
        slim = slim.withColumn("done", F.lit(None).cast("boolean"))
    # a filter on the keys, also the one that Spark infers for the explosion of a mere column, would make all of them a second time
    keyed = slim.select(*own, "done", F.explode(F.array_distinct("keys")).alias("key"))
    l, r = (keyed.select("key", *[F.col(c).alias(f"{x}_{c}") for c in (*own, "done")]) for x in "lr")
    met = l.where("l_done is null").join(r, "key").where("l_g < r_g or l_g > r_g and r_done").where(may_agree(counting))
    if only is not None:
        met = met.where(only)
    return met.select("l_rid", "r_rid")


def matched_groups(bundles: DataFrame, groups: DataFrame, min_confidence: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(pairs of groups (g, h, rule, confidence), descriptions).

    Empty tables, bundles without readable metadata and groups like no other give no pairs. A description with a null year agrees with
    any year if an author agrees; one without authors only with an equal title of a near year. Repeated descriptions of a group
    count once, so a group of any size is one record for the joins. Rules of a confidence under `min_confidence` give no pairs.
    """
    said = cut(descriptions(bundles, groups))
    records = cut(records_of(said))
    with_id = records.groupBy("g").agg(F.max(F.col("catalogue").isNotNull().cast("int")).alias("x")).agg(F.avg("x").alias("x")).first().x or 0.0
    text = ["title", "main", "mark", "open", "authors", "years", "g"]
    sides = [records.select(F.col("rid").alias(f"{x}_rid"), F.when(F.col("catalogue").isNotNull(), F.xxhash64("catalogue")).alias(f"{x}_cat"), *[F.col(c).alias(f"{x}_{c}") for c in text]) for x in "lr"]
    # the groups of one catalogue id: a star, not all pairs
    same_id = records.where("catalogue is not null").select("catalogue", "g").distinct()
    first = same_id.groupBy("catalogue").agg(F.min("g").alias("first"))
    by_id = cut(same_id.join(first, "catalogue").where("g > first").select(F.col("first").alias("g"), F.col("g").alias("h"))).withColumn("rule", F.lit(CATALOGUE))
    # the ids are the labels and can't score themselves: their links count as right
    ids = by_id.count()
    links = [by_id.withColumn("confidence", F.lit((ids + 1) / (ids + 2)))]
    resolved: DataFrame | None = None
    for name, keys in rules():
        # pairs meet their left texts where equal pairs become one
        met = candidates(records, keys, resolved, ONLY[name]() if name in ONLY else None, name in COUNTING).repartition("l_rid").distinct()
        pairs = met.join(sides[0], "l_rid").join(sides[1], "r_rid").where(agrees())
        found = cut(pairs.select(F.least("l_g", "r_g").alias("g"), F.greatest("l_g", "r_g").alias("h"), (F.col("l_cat") == F.col("r_cat")).cast("int").alias("label")).distinct())
        n = found.agg(F.count("*").alias("pairs"), F.count_if(F.col("label") == 0).alias("wrong")).first()
        sure_to = confidence(n.pairs, n.wrong, with_id)
        if sure_to < min_confidence:
            continue
        # a pair with different catalogue ids is no match, whatever else agrees
        sure = found.where("coalesce(label, 1) = 1")
        links.append(sure.select("g", "h", F.lit(name).alias("rule"), F.lit(sure_to).alias("confidence")))
        # either end from one scan, as the driver holds the plans of all passes
        new = sure.select(F.explode(F.array("g", "h")).alias("g"))
        resolved = (new if resolved is None else resolved.union(new)).distinct()
    order = F.struct("confidence", "rule")
    pairs = reduce(DataFrame.unionByName, links).groupBy("g", "h").agg(F.max(order).alias("best")).select("g", "h", "best.rule", "best.confidence")
    return pairs, said


def same_works(bundles: DataFrame, works: DataFrame, min_confidence: float = 0.3) -> DataFrame:
    """(id_a, id_b, confidence): the pairs of bundles of one work that are in different groups by identifier.

    Links between groups of at least `min_confidence` are closed transitively; a pair that only others connect gets the smallest
    confidence of its work's links. Bundles without a title that has a letter or digit of any script are in no pair.
    """
    groups = cut(bundle_groups(bundles, works).select("id", "group_id"))
    pairs, said = matched_groups(bundles, groups, min_confidence)
    pairs = cut(pairs)
    part = connected_components(pairs.select(F.col("g").alias("src"), F.col("h").alias("dst"))).withColumnRenamed("v", "g")
    own = cut(said.select("id", "g").distinct().join(part, "g"))
    placed = own.select("g", "component").distinct()
    weakest = pairs.join(placed, "g").groupBy("component").agg(F.min("confidence").alias("weakest"))
    a, b = own.select(F.col("id").alias("id_a"), F.col("g").alias("ga"), "component"), own.select(F.col("id").alias("id_b"), F.col("g").alias("gb"), "component")
    out = a.join(b, "component").where("id_a < id_b and ga <> gb").join(weakest, "component")
    direct = pairs.select(F.least("g", "h").alias("lo"), F.greatest("g", "h").alias("hi"), "confidence")
    out = out.withColumn("lo", F.least("ga", "gb")).withColumn("hi", F.greatest("ga", "gb")).join(direct, ["lo", "hi"], "left")
    return out.select("id_a", "id_b", F.coalesce("confidence", "weakest").alias("confidence"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_works(table(spark, sf_dir, "raw_bundles"), table(spark, sf_dir, "normalized_works")).select("id_a", "id_b")


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matching groups with rule and confidence."""
    b, w = table(spark, sf_dir, "raw_bundles"), table(spark, sf_dir, "normalized_works")
    return matched_groups(b, bundle_groups(b, w))[0].withColumn("confidence", F.round("confidence", 6))
