"""Problem 6: variant spellings of names.

Tokens of all spellings get a role from the forms that show it ("Last, First", "First M. Last", "LAST First"). Surnames, words of
unclear order and all words of organisations, but no initials, go into a symmetric-delete neighbourhood index: two tokens within edit distance 2 share a variant with at most two characters deleted, so
similar tokens meet in an equi-join. Spellings whose tokens meet are compared by optimal assignment of their tokens, permitting
initials, abbreviations, short forms and typing errors; spellings with full given names are closed transitively, those with initials
only join the one author they fit best. Spellings with equal token lists are one class from the start, so only classes are compared.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import strip
from lectern.llm.components import connected_components
from lectern.plans.runtime import cut, table

# Words that carry no identity.
PARTICLES = set("van der den de di da du la le von zu ten ter af av el bin ibn dos das".split())
TITLES = set("dr prof professor mr mrs ms phd msc dipl ing sir dame jr sr".split())
ORG_STOP = set("the of for on and f o for og und fur i in".split())
ORG_WORDS = set(
    "centre center centrum institute institut inst university universitet universitat univ laboratory laboratories lab labs consortium cons collective coll group team network "
    "society soc association assoc department dept school college academy foundation library libr committee council project agency company ltd inc corp".split()
)
# Short and foreign forms of given names that are no prefix, suffix or near spelling of each other.
SHORT = """aleksander sasha xander|alexander sasha alex sandy|anastasia nastya stasya|anna anja anya|anton tony|barbara babs|benjamin benny|bernhard bernd|catherine kate katie cathy|charles charlie chuck
christina stina kirsten|christoffer stoffer kit chris|dmitri dima mitya|dorothea dorte|edward ted ned eddie|eleonora nora|elisabeth lis lisa liz beth betty elsa elise|emilia emmy milly|eugenia zhenya|francesca franca
francisco paco pancho|frederik fritz freddy|gabriela gaby gabi|georg jorg|grigori grisha|hakon haakon|haruko haru|heinrich heinz|helena lena leni|henrik rik hal|ignacio nacho|isabella izzy bella belle|ivan vanya|jakob kobe|james jim
jean jan|johannes hans hannes jo|johanna hanne|john jack|jose pepe|josef sepp joe|katarina katja katya kata kat|konstantin kosta kostya|lars lasse|lawrence larry laurence lars|leonid lyonya|ludmila lyuda|magdalena lena magda leni
margrethe grete greta meta maggie|maria masha mia|maximilian max|mikhail misha|mikkel mik|natalia natasha|nikolaj niko klaus kolya|olga olya|oluwaseun seun|pavel pasha|peter per|priyanka priya|rebecca becky rebekka|richard dick rick
robert bob rob|sebastian seb bas|sergei seryozha|sofia sonya|soren soeren|stefan steffen|svetlana sveta|tatiana tanya|theodora dora thea theo|thomas tom|thomasina tommie tamsin|ulrika ulla|valentina tina valya|vladimir volodya
wilhelm bill willy|wilhelmina mina willa wilma minna|william bill will|yevgenia zhenya evgenia eugenia|yuri yura|zoe zoey"""
_SHORT: dict[str, set[int]] = {}
for _i, _line in enumerate(re.split(r"[|\n]", SHORT)):
    for _w in _line.split():
        _SHORT.setdefault(_w, set()).add(_i)


def fold(text: str) -> str:
    """Lower case without diacritics."""
    t = text.lower()
    if t.isascii():
        return t
    t = t.translate(str.maketrans({"ø": "o", "ł": "l", "æ": "ae", "ß": "ss", "đ": "d", "ð": "d", "þ": "th"}))
    return "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))


@lru_cache(200_000)
def distance(a: str, b: str, most: int = 2) -> int:
    """Edit distance with transpositions of neighbours; most + 1 if larger than `most`."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?\.?")
_BRACKETS = re.compile(r"\([^)]*\)")
_ET_AL = re.compile(r"\W+et\s+al\.?\s*$", re.I)
_GLUED = re.compile(r"(?<=[^\W\d_])(?<=[a-zß-öø-ÿāăąćčďđēęěğīıłńňōőřśşšťūůűźżž])(?=[A-ZÀ-ÖØ-ÞĀŁŚŠŽ])")
_DOUBLE = re.compile(r"\s([^\W\d_]{5,})-([^\W\d_]{5,})\s*$")


@lru_cache(50_000)
def parse(name: str) -> tuple[bool, list[tuple[str, str]]]:
    """(is it an organisation, tokens (text, role)); roles: S surname, G given name, ? unknown; initials are single letters."""
    s = name if name.isascii() else unicodedata.normalize("NFC", name)
    s = _BRACKETS.sub(" ", s) if "(" in s else s
    s = _ET_AL.sub("", s) if "al" in s.lower() else s
    s = _GLUED.sub(" ", s)
    comma = s.split(",", 1) if "," in s else None
    words = _TOKEN.findall(s)
    folded = [fold(w.rstrip(".")) for w in words]
    if not ORG_WORDS.isdisjoint(folded):
        return True, [(t, "?") for t in folded if t not in ORG_STOP]
    mixed = not s.isupper()

    def split(part: str, role: str) -> list[tuple[str, str]]:
        out = []
        for w in _TOKEN.findall(part):
            bare = w.rstrip(".")
            low = fold(bare)
            if not low.isalpha():
                low = low.replace("'", "").replace("’", "")
            if (low in TITLES and len(bare) > 1 or low in PARTICLES) and not (bare.isupper() and mixed):
                continue
            if len(bare) == 1:
                out.append((low, "G"))
            elif bare.isupper() and mixed and len(bare) <= 3 and low not in _SHORT:
                out += [(c, "G") for c in low]
            elif bare.isupper() and mixed and role == "?":
                out.append((low, "S"))
            else:
                out.append((low, role))
        return out

    if comma:
        return False, split(comma[0], "S") + split(comma[1], "G")
    double = _DOUBLE.search(s) if "-" in s else None
    if double:  # a double surname at the end
        return False, split(s[: double.start()], "G") + [(fold(x), "S") for x in double.groups()]
    toks = split(s, "?")
    if any(r == "S" for _, r in toks):
        return False, [(t, "G" if r == "?" else r) for t, r in toks]
    first = next((i for i, (t, _) in enumerate(toks) if len(t) == 1), None)
    if first is not None:
        last = max(i for i, (t, _) in enumerate(toks) if len(t) == 1)
        if first == 0:  # initials first: the rest is the surname
            toks = [(t, "G" if len(t) == 1 else "S") for t, _ in toks]
        elif last == len(toks) - 1:  # initials last: "Last F. M."
            toks = [(t, "G" if len(t) == 1 else "S") for t, _ in toks]
        else:
            toks = [(t, "G" if i < first or len(t) == 1 else "S" if i > last else "G") for i, (t, _) in enumerate(toks)]
    return False, toks


def _related(a: str, b: str) -> bool:
    """Are two given names forms of each other?"""
    if _SHORT.get(a, set()) & _SHORT.get(b, set()):
        return True
    short, long = sorted((a, b), key=len)
    return len(short) >= 2 and long.startswith(short) and len(long) > len(short) + 1 or len(short) >= 4 and long.endswith(short)


def _cost(a: tuple[str, str], b: tuple[str, str], org: bool) -> float | None:
    """The cost of aligning two tokens, None if they don't go together."""
    (x, rx), (y, ry) = a, b
    if len(x) == 1 or len(y) == 1:
        if x[0] != y[0] or not org and (len(x) > 1 and rx == "S" or len(y) > 1 and ry == "S"):
            return None
        return 0.0 if x == y else 0.2
    if x == y:
        return 0.0
    if not org and "S" in (rx, ry) and "G" in (rx, ry):
        return None
    if org and min(len(x), len(y)) >= 3 and (x.startswith(y) or y.startswith(x)):
        return 0.1
    if not org and "S" not in (rx, ry) and _related(x, y):
        return 0.1
    n = min(len(x), len(y))
    d = distance(x, y)
    if d <= (2 if n >= 9 or n >= 6 and x[0] == y[0] else 1 if n >= 3 or x[0] == y[0] and "S" not in (rx, ry) else 0):
        return float(d)
    if not org and "S" not in (rx, ry) and n >= 4 and any(distance(x, z) <= 1 for z in _forms(y)) or not org and "S" not in (rx, ry) and n >= 4 and any(distance(y, z) <= 1 for z in _forms(x)):
        return 1.0
    return None


@lru_cache(10_000)
def _forms(word: str) -> tuple[str, ...]:
    mine = _SHORT.get(word, set())
    return tuple(w for w, g in _SHORT.items() if g & mine and len(w) >= 4) if mine else ()


def _joined(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """`a` with neighbours made one where the other side writes them as one, as Anne Marie and Annemarie."""
    whole = {t for t, _ in b if len(t) > 5}
    for i in range(len(a) - 1):
        if a[i][0] + a[i + 1][0] in whole and len(a[i + 1][0]) > 1:
            return [*a[:i], (a[i][0] + a[i + 1][0], a[i][1]), *a[i + 2 :]]
    return a


def _assign(small: list, large: list, org: bool) -> tuple[float, list[tuple[int, int]]] | None:
    """The cheapest assignment of all of `small` to different tokens of `large`."""
    costs = [[_cost(a, b, org) for b in large] for a in small]
    best: tuple[float, list[tuple[int, int]]] | None = None
    order = sorted(range(len(small)), key=lambda i: sum(c is not None for c in costs[i]))
    lead = [next((k for k, (_, r) in enumerate(side) if r == "G"), -1) for side in (small, large)]
    if not org and min(lead) >= 0:  # first given names only go together
        for i, row in enumerate(costs):
            for j in range(len(row)):
                if (i == lead[0]) != (j == lead[1]):
                    row[j] = None

    if len(large) > 9:  # the search below may take exponential time
        return _matching([[None if c is None else c + 0.001 * abs(i - j) for j, c in enumerate(row)] for i, row in enumerate(costs)])

    def go(k: int, used: int, total: float, pairs: list[tuple[int, int]]) -> None:
        nonlocal best
        if best is not None and total >= best[0] or total > 2.9:
            return
        if k == len(order):
            best = total, pairs
            return
        i = order[k]
        for j, c in enumerate(costs[i]):
            if c is not None and not used >> j & 1:
                # in order of appearance where costs tie
                go(k + 1, used | 1 << j, total + c + 0.001 * abs(i - j), [*pairs, (i, j)])

    go(0, 0, 0.0, [])
    return best


def _matching(costs: list[list[float | None]]) -> tuple[float, list[tuple[int, int]]] | None:
    """The cheapest assignment of all rows to different columns in polynomial time (shortest augmenting paths), None beyond 2.9."""
    inf, m = float("inf"), len(costs[0])
    u, v, row_of = [0.0] * (len(costs) + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, len(costs) + 1):
        row_of[0], at = i, 0
        least, back, done = [inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while row_of[at]:
            done[at] = True
            r, step, to = row_of[at], inf, 0
            for j in range(1, m + 1):
                if done[j]:
                    continue
                c = costs[r - 1][j - 1]
                if (reduced := (1e6 if c is None else c) - u[r] - v[j]) < least[j]:
                    least[j], back[j] = reduced, at
                if least[j] < step:
                    step, to = least[j], j
            for j in range(m + 1):
                if done[j]:
                    u[row_of[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = to
        while at:
            row_of[at], at = row_of[back[at]], back[at]
    pairs = sorted((row_of[j] - 1, j - 1) for j in range(1, m + 1) if row_of[j])
    found = [costs[i][j] for i, j in pairs]
    return None if None in found or sum(found) > 2.9 else (sum(found), pairs)


def same(one: tuple[bool, list], two: tuple[bool, list]) -> int:
    """0: different; 1: the same, by a full given name or as an organisation; 2: the same as far as initials tell."""
    (org_a, a), (org_b, b) = one, two
    org = org_a or org_b
    a, b = _joined(a, b), _joined(b, a)
    if len(a) > len(b):
        a, b = b, a
        org_a, org_b = org_b, org_a
    if len(a) < 2:
        return int(len(a) == len(b) and a == b)
    found = _assign(a, b, org)
    if not found:
        return 0
    total, pairs = found
    words = [(i, j) for i, j in pairs if len(a[i][0]) > 1 and len(b[j][0]) > 1]
    edits = sum(c for i, j in pairs if (c := _cost(a[i], b[j], org)) >= 1)
    left = [t for j, t in enumerate(b) if j not in {j for _, j in pairs}]
    if edits > 2 or not any(len(a[i][0]) >= 4 or a[i][0] == b[j][0] and len(a[i][0]) >= 3 for i, j in words):
        return 0
    if org:
        return int(not left and len(pairs) >= 2)
    if any(len(t) > 1 and r != "S" and not _second(t, b) for t, r in left):
        return 0
    # someone's first given name must meet the other's
    for x, y, at in ((a, b, 0), (b, a, 1)):
        firsts = [k for k, (_, r) in enumerate(x) if r == "G"]
        if firsts and not any(p[at] == firsts[0] for p in pairs):
            return 0
    given = [(i, j) for i, j in words if "S" not in (a[i][1], b[j][1])]
    sur = [(i, j) for i, j in words if (i, j) not in given]
    if not sur and len(words) < 2 and not (len(words) == 1 and len(pairs) > 1):
        return 0
    if given and (sur or len(words) >= 2):
        return 1
    return 2 if len(pairs) >= 2 else 0


def _second(token: str, tokens: list[tuple[str, str]]) -> bool:
    """May this unmatched word of an unclear order be left out? Only one that isn't the first or last token."""
    at = [t for t, _ in tokens].index(token)
    return len(tokens) > 2 and 0 < at < len(tokens) - 1


def spread(df: DataFrame, by: Column | str) -> DataFrame:
    """`df` in all shuffle partitions: the rows here are small and much work each, and adaptive execution, which joins partitions by their
    bytes, would leave them to a few tasks. After a grouping by the same column, give a hash of it: else the planner drops this."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def _deletes(word: str, most: int) -> set[str]:
    return {"".join(c for k, c in enumerate(word) if k not in gone) for n in range(most + 1) for gone in combinations(range(len(word)), n)}


def _parsed(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        rows = []
        for name in p["name"]:
            org, toks = parse(name)
            rows.append((name, ("o " if org else "p ") + " ".join(sorted(f"{t}{r}" for t, r in toks)), org, [t for t, _ in toks], [r for _, r in toks]))
        yield pd.DataFrame(rows, columns=["name", "class", "org", "tokens", "roles"])


def _variants(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        rows = [(t, v) for t in p["token"] for v in _deletes(t[:24], 2 if len(t) >= 6 else 1)]
        yield pd.DataFrame(rows, columns=["token", "variant"])


def similar_tokens(tokens: DataFrame) -> DataFrame:
    """(t, u): all ordered pairs of `tokens(token)` within edit distance 2 (1 for tokens under six letters), each with itself.

    The index holds the variants of a token with up to two (one) characters deleted, of its first 24 characters; longer tokens are
    verified in full."""
    index = cut(spread(tokens.select("token").distinct(), F.xxhash64("token")).mapInPandas(_variants, "token string, variant string"))
    a, b = index.withColumnRenamed("token", "t"), index.withColumnRenamed("token", "u")
    pairs = a.join(b, "variant").where("t < u").select("t", "u").distinct()
    near = pairs.where(F.levenshtein("t", "u") <= F.when(F.least(F.length("t"), F.length("u")) >= 6, 4).otherwise(2))
    itself = tokens.select(F.col("token").alias("t"), F.col("token").alias("u")).distinct()
    return near.unionByName(near.select(F.col("u").alias("t"), F.col("t").alias("u"))).unionByName(itself)


def _compare(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        kinds = [same(parse(a), parse(b)) for a, b in zip(p["name_a"], p["name_b"])]
        yield pd.DataFrame({"a": p["a"], "b": p["b"], "kind": pd.Series(kinds, dtype="int32")})[lambda x: x["kind"] > 0]


def name_groups(names: DataFrame) -> DataFrame:
    """(name, author): the spellings of `names(name)` with the number of the author that they mean.

    Null and blank spellings are left out, repeated ones count once; a spelling like no other is an author of its own, one of a
    single word only matches itself; other columns are ignored; an empty table gives no rows.
    """
    spellings = names.select(strip(F.col("name")).alias("name")).where("name <> ''").distinct()
    parsed = cut(spread(spellings, F.xxhash64("name")).mapInPandas(_parsed, "name string, class string, org boolean, tokens array<string>, roles array<string>"))
    # equal token lists are one class, named by one spelling of it; the number holds because it is written
    classes = cut(parsed.groupBy("class").agg(F.min_by(F.struct("name", "org", "tokens", "roles"), "name").alias("r")).select("class", "r.*").withColumn("id", F.monotonically_increasing_id()))
    token = classes.select("id", "org", F.posexplode(F.arrays_zip("tokens", "roles")).alias("at", "x")).select("id", "org", "at", F.col("x.tokens").alias("token"), F.col("x.roles").alias("role")).where("length(token) >= 2")
    votes = token.groupBy("token").agg(F.sum(F.when(F.col("role") == "S", 1).otherwise(0)).alias("s"), F.sum(F.when(F.col("role") == "G", 1).otherwise(0)).alias("g"), F.count("*").alias("df"))
    seen = token.join(votes, "token")
    # every word of an organisation, every surname and every word of unclear order; two words that are more often given names don't make a
    # pair of names where each has a likelier surname among its own
    given = ~F.col("org") & (F.col("role") == "?") & (F.col("g") > F.col("s"))
    keys = seen.where(F.col("org") | (F.col("role") != "G")).select("id", "token", given.alias("given"))
    keys = keys.groupBy("id", "token").agg(F.min("given").alias("given"))
    index = cut(keys.select("id", "token", (F.col("given") & F.min("given").over(Window.partitionBy("id")).eqNullSafe(False)).alias("weak")))
    near = similar_tokens(index)
    left = index.select(F.col("id").alias("a"), F.col("token").alias("t"), F.col("weak").alias("wa"))
    right = index.select(F.col("id").alias("b"), F.col("token").alias("u"), F.col("weak").alias("wb"))
    candidates = near.join(left, "t").join(right, "u").where("a < b and not (wa and wb)").select("a", "b").distinct()
    label = classes.select("id", "name")
    half = spread(candidates.join(label.select(F.col("id").alias("a"), F.col("name").alias("name_a")), "a"), "b")
    named = half.join(label.select(F.col("id").alias("b"), F.col("name").alias("name_b")), "b")
    links = cut(named.mapInPandas(_compare, "a long, b long, kind int"))
    full = links.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    author = classes.select("id").join(connected_components(full).withColumnRenamed("v", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("author"), F.col("component").isNotNull().alias("full"))
    author = cut(author)
    # spellings with initials only: among themselves, then each to the author that most of its links name
    weak = links.where("kind = 2")
    both = weak.select("a", "b").unionByName(weak.select(F.col("b").alias("a"), F.col("a").alias("b")))
    bare = classes.where(~F.col("org") & (F.size(F.filter(F.arrays_zip("tokens", "roles"), lambda x: (x["roles"] != "S") & (F.length(x["tokens"]) > 1))) == 0)).select("id")
    votes = both.join(bare, both.a == bare.id, "left_semi").join(bare, both.b == bare.id, "left_anti").join(author.select(F.col("id").alias("b"), "author"), "b")
    choice = votes.groupBy("a", "author").count().groupBy("a").agg(F.max_by("author", F.struct(F.col("count"), -F.col("author"))).alias("chosen"))
    placed = author.join(choice.withColumnRenamed("a", "id"), "id", "left")
    alone = placed.where("chosen is null").join(bare, "id", "left_semi").select("id")
    among = weak.join(alone.withColumnRenamed("id", "a"), "a", "left_semi").join(alone.withColumnRenamed("id", "b"), "b", "left_semi")
    rest = connected_components(among.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("v").alias("id"), F.col("component").alias("own"))
    placed = placed.join(rest, "id", "left").select("id", F.coalesce("chosen", "own", "author").alias("author"))
    return parsed.join(classes.select("class", "id"), "class").join(placed, "id").select("name", "author")


def author_names(works: DataFrame, records: DataFrame) -> DataFrame:
    """The author names of both tables, one per row, as written."""
    item = F.explode(F.from_json("authors", "array<string>"))
    said: Column = F.when(F.col("x").startswith("{"), F.coalesce(F.get_json_object("x", "$.name"), F.get_json_object("x", "$.author.display_name"))).otherwise(F.col("x"))
    a = works.select(item.alias("x")).select(said.alias("name"))
    return a.unionByName(records.select(F.explode("authors").alias("name")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of spellings of one author."""
    groups = name_groups(author_names(table(spark, sf_dir, "normalized_works"), table(spark, sf_dir, "experience_records")))
    a, b = groups.withColumnRenamed("name", "name_a"), groups.withColumnRenamed("name", "name_b")
    return a.join(b, "author").where("name_a < name_b").select("name_a", "name_b")


def p6_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling with the smallest spelling of its author and their number."""
    groups = name_groups(author_names(table(spark, sf_dir, "normalized_works"), table(spark, sf_dir, "experience_records")))
    named = groups.groupBy("author").agg(F.min("name").alias("author_name"), F.count("*").alias("spellings"))
    return groups.join(named, "author").select("name", "author_name", "spellings")
