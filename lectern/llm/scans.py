"""Problem 2: noise in text from scanned pages.

1. One pass over the texts lays out their lines and emits every word, hyphenated compound, joined neighbour and edge line (a line beside a
   page break) that a text holds or wants to look up, with its count there; the counts over all texts are an aggregation of that.
2. Rare words are joined in SQL with frequent confusable variants: the anagram hash of a word is the sum of the fifth powers of its
   characters, so a misreading shifts it by a known difference, and "rare hash + difference = frequent hash" is an equi-join of numbers.
   Only the words that meet there are compared by position, and ranked by frequency.
3. Each text gets the counts and corrections of its own words, and a last pass per text marks or repairs its lines: edge lines
   out, words cut at line ends joined on the evidence of the counts, misread words replaced.

Nothing is collected: statistics are joined to the texts by shuffles, because the planner can't know how large texts and their words get.
"""

from __future__ import annotations

import difflib
import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.runtime import cut, table

# What scanners misread, as (printed in the text, true).
CONFUSIONS = [
    ("c", "e"), ("é", "e"), ("à", "a"), ("г", "r"), ("f", "t"), ("ri", "n"), ("1", "i"), ("1", "l"), ("0", "o"), ("5", "s"), ("I", "l"), ("cl", "d"),
    ("ii", "u"), ("9", "g"), ("b", "h"), ("rn", "m"), ("m", "in"), ("m", "rn"), ("6", "b"), ("v", "y"), ("vv", "w"), ("h", "li"), ("4", "a"), ("8", "b"),
    ("l", "i"), ("i", "l"), ("f", "e"), ("а", "a"), ("е", "e"), ("о", "o"), ("р", "p"), ("с", "c"), ("у", "y"), ("х", "x"), ("q", "g"), ("ni", "m"), ("nn", "m"), ("li", "h"),
]
#: A digit between letters, a Cyrillic letter or a grave accent is strong evidence by itself.
STRONG = set("0123456789гаеорсухà")
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
HYPHENS = "-‐¬\xad"
WORD = re.compile(r"[^\W_]+")
COMPOUND = re.compile(r"[^\W\d_]+(?:[-‐][^\W\d_]+)+")
PAGE = re.compile(r"[\W_]*(?:([^\W\d_]{1,5})\.?\s+)?([0-9lIO]{1,5}|[ivxlcIVXLC]{1,7})(?:\s*(?:of|o[fr]|af|von|/)\s*[0-9lIO]{1,5})?[\W_]*", re.I)
ADDRESS = re.compile(r"\S*(?:://|www\.|@)\S*|\bv\d[\d.]*")
NUMBERED = re.compile(r"^\s*[0-9lIO]{1,5}\s{2,}(?=\S)|(?<=\S)\s{2,}[0-9lIO]{1,5}\s*$")


_FOLD = str.maketrans({"é": "e", "à": "a", "г": "r", "а": "a", "е": "e", "о": "o", "р": "p", "с": "e", "c": "e", "f": "t", "1": "l", "i": "l", "0": "o", "5": "s", "9": "g", "4": "a", "6": "b", "v": "y"})


_LIGATED = str.maketrans(LIGATURES)


def fold(text: str) -> str:
    """Lower case, blanks out, and whatever scanners confuse made equal."""
    t = "".join(text.lower().split())
    t = t if t.isascii() else t.translate(_LIGATED)
    for a, b in (("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h")):
        t = t.replace(a, b)
    return t.translate(_FOLD)


@lru_cache(100_000)
def canonical(word: str) -> str:
    """A capital first letter is lowered; other capitals stay, because I and l are confused inside words."""
    return word[:1].lower() + word[1:] if word[1:2] and not word[1:].isupper() else word


def page_line(line: str) -> bool:
    m = PAGE.fullmatch(line) if line.strip() else None
    if not m or "." in line.strip()[-1:] and not m[1]:
        return False
    return m[1] is None or fold(m[1]) in _LEADS


_LEADS = {fold(x) for x in ("page", "side", "seite", "p", "s", "pag", "pg")}


def _layout(text: str) -> tuple[list[str], list[bool], list[bool]]:
    """The lines, which hold only a page number, and which stand at a page edge."""
    lines = text.split("\n")
    pages = [page_line(x) for x in lines]
    full = [i for i, x in enumerate(lines) if x.strip()]
    edge = [False] * len(lines)
    for k, i in enumerate(full):
        if pages[i]:
            continue
        near = [full[j] for j in (k - 1, k + 1) if 0 <= j < len(full)]
        edge[i] = "\f" in lines[i] or any(pages[j] for j in near) or bool(NUMBERED.search(lines[i])) or (k > 0 and "\f" in "".join(lines[full[k - 1] + 1 : i]))
    return lines, pages, edge


def _line_key(line: str) -> str:
    """A name of the whole line without page number and digits, folded; empty for lines with less than eight letters."""
    key = re.sub(r"[\W\d_]+", "", fold(re.sub(r"\b[\dlIO]*\d[\dlIO]*\b", "", NUMBERED.sub("", line))))
    return hashlib.blake2b(key.encode(), digest_size=12).hexdigest() if len(key) >= 8 else ""


_AT_END = re.compile(rf"([^\W_]+)([{HYPHENS}])\s*$")


def _cuts(lines: list[str], skip: list[bool]) -> list[tuple[int, int, str, str, str]]:
    """(line, next line, start of the word, mark, rest of the word) of every word at a line's end with a hyphen."""
    out = []
    follows: int | None = None
    for i in range(len(lines) - 1, -1, -1):
        line = lines[i]
        m = None if skip[i] or follows is None or line.rstrip()[-1:] not in HYPHENS else _AT_END.search(line)
        if m and (b := WORD.match(lines[follows].strip())):
            out.append((i, follows, m[1], m[2], b[0]))
        if line.strip() and not skip[i]:
            follows = i
    return out[::-1]


_NEIGHBOURS = re.compile(r"(?=\b([^\W\d_]+) ([^\W\d_]+)\b)")


def _looked_up(text: str) -> Counter:
    """What a text says or wants to know: words, compounds, lines (A: anywhere, E: at a page edge) with their counts in it; joined
    neighbours and words cut at line ends, which it doesn't say itself, count 0."""
    lines, pages, edge = _layout(text)
    cuts = _cuts(lines, pages)
    broken = {x for i, j, a, _, b in cuts for x in ((i, a), (j, b))}
    said: Counter = Counter()
    want = set()
    for i, line in enumerate(lines):
        words = WORD.findall(line)
        want.update(map(canonical, words))
        for m in _NEIGHBOURS.finditer(line):
            want.add(canonical(m[1] + m[2]))
        if pages[i] or not line.strip():
            continue
        if key := _line_key(line):
            said["A\t" + key] += 1
            if edge[i]:
                said["E\t" + key] += 1
        said.update(canonical(w) for w in words if (i, w) not in broken)
        if "-" in line or "‐" in line:
            for m in COMPOUND.finditer(line):
                parts = re.split("[-‐]", m[0].lower())
                said.update(f"{a}-{b}" for a, b in zip(parts, parts[1:]))
    # a running header may stand between the two parts
    for _, _, a, _, b in [*cuts, *(_cuts(lines, [p or e for p, e in zip(pages, edge)]) if any(edge) else [])]:
        want |= {canonical(a + b), f"{a.lower()}-{b.lower()}", canonical(a), canonical(b)}
    for w in want:
        said.setdefault(w, 0)
    return said


def _lookups(parts: Iterable[pd.DataFrame], rows: int = 50_000) -> Iterator[pd.DataFrame]:
    def frame() -> pd.DataFrame:
        return pd.DataFrame({"uid": uids, "word": words, "n": counts}).astype({"uid": "int64", "word": object, "n": "int64"})

    for p in parts:
        uids: list[int] = []
        words: list[str] = []
        counts: list[int] = []
        for u, text in zip(p["uid"], p["text"]):
            c = _looked_up(text)
            uids += [u] * len(c)
            words += c
            counts += c.values()
            if len(uids) >= rows:
                yield frame()
                uids, words, counts = [], [], []
        yield frame()


#: Anagram hashes are sums modulo this prime: no word is too long and no character too large for them.
MODULUS = 2**31 - 1


def anagram(word: Column) -> Column:
    """The sum of the fifth powers of the characters' code points, each modulo a prime."""
    def fifth(c: Column) -> Column:
        square = c * c % MODULUS
        return square * square % MODULUS * c % MODULUS

    codes = F.transform(F.split(word, ""), lambda c: fifth(F.ascii(c).cast("long")))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a + c) % MODULUS


def _power(text: str) -> int:
    return sum(pow(ord(c), 5, MODULUS) for c in text)


def _replaced(w: Column, bad: Column, good: Column) -> Column:
    """All texts that `w` becomes when one `bad` in it is made `good`."""
    places = F.filter(F.sequence(F.lit(1), F.length(w)), lambda p: F.substr(w, p, F.length(bad)) == bad)
    return F.transform(places, lambda p: F.concat(F.substr(w, F.lit(1), p - 1), good, F.substr(w, p + F.length(bad))))


def corrections(words: DataFrame, min_true: int = 4, ratio: float = 6.0, short_ratio: float = 30.0, strong_ratio: float = 2.0, confusions: list[tuple[str, str]] = CONFUSIONS) -> DataFrame:
    """(word, correction): each misread word of `words(word, n)` with its most frequent confusable variant.

    The variant has at least `min_true` occurrences and `ratio` times the word's (`short_ratio` for words under four letters,
    `strong_ratio` where the misread character is a digit, Cyrillic or a grave accent). One misreading in a word is found, in words
    of six characters or more two if there is no variant for one. Words of any length and script take part. Ties go to the last variant in
    order. Null and empty words are never corrected; an empty table gives no rows.
    """
    plain = r"^[\p{L}\p{M}]+$"
    known = words.where((F.col("n") >= min_true) & F.col("word").rlike(plain)).select(F.col("word").alias("true"), F.col("n").alias("m"), anagram(F.col("word")).alias("h"))
    rare = words.where(F.col("word").rlike(r"^[\p{L}\p{M}\d]{2,}$") & ~F.col("word").rlike(r"^\d+$"))
    # the confusions are constants in the plan, so that listing those of a word needs no join
    table_ = F.array(*[F.struct(F.lit(a).alias("bad"), F.lit(b).alias("good"), F.lit(_power(b) - _power(a)).alias("diff"), F.lit(any(c in STRONG for c in a)).alias("strong"), F.lit(i).alias("no")) for i, (a, b) in enumerate(confusions)])
    # position counts only for i at the start, where a capital I was lowered
    fits = lambda w, c: F.contains(w, c["bad"]) & ((c["bad"] != "i") | F.startswith(w, c["bad"]))
    one = rare.select("word", "n", anagram(F.col("word")).alias("h"), F.explode(F.filter(table_, lambda c: fits(F.col("word"), c))).alias("c"))
    shifted = lambda *parts: F.pmod(sum(parts[1:], parts[0]), F.lit(MODULUS))
    at = one.select("word", "n", "c", shifted(F.col("h"), F.col("c.diff")).alias("h")).hint("merge")
    # equal hashes mean equal letters in some order: now the positions are looked at
    first = at.join(known, "h").where(F.array_contains(_replaced(F.col("word"), F.col("c.bad"), F.col("c.good")), F.col("true")))
    need = lambda strong: F.when(strong, strong_ratio).when(F.length("word") < 4, short_ratio).otherwise(ratio)
    best = F.max(F.struct("m", "true"))["true"].alias("correction")
    found = cut(first.where(F.col("m") >= need(F.col("c.strong")) * F.col("n")).groupBy("word").agg(best))
    # a second misreading beside the first, in either order, or made by it
    more = one.where(F.length("word") >= 6).join(found.hint("merge"), "word", "left_anti")
    meets = lambda w, c, d: fits(w, d) & (d["no"] >= c["no"]) | F.contains(d["bad"], F.substr(c["good"], F.lit(1), F.lit(1))) | F.contains(d["bad"], F.substr(c["good"], F.lit(-1)))
    two = more.select("word", "n", "h", "c", F.explode(F.filter(table_, lambda d: meets(F.col("word"), F.col("c"), d))).alias("d"))
    two = two.select("word", "n", "c", "d", shifted(F.col("h"), F.col("c.diff"), F.col("d.diff")).alias("h")).hint("merge")
    either = lambda c, d: F.exists(_replaced(F.col("word"), c["bad"], c["good"]), lambda w: F.array_contains(_replaced(w, d["bad"], d["good"]), F.col("true")))
    second = two.join(known, "h").where((F.col("true") != F.col("word")) & (either(F.col("c"), F.col("d")) | either(F.col("d"), F.col("c"))))
    second = second.where(F.col("m") >= need(F.col("c.strong") | F.col("d.strong")) * F.col("n")).groupBy("word").agg(best)
    return found.unionByName(second)


class _Like:
    """Is a line like the start of a text's title (or of its authors' line)? Letters that two texts don't share bound their likeness from above, so
    that most lines need no alignment."""

    def __init__(self, title: str, least: float):
        self.title, self.least, self.counts = title, least, {}

    def __call__(self, f: str) -> bool:
        t = self.title[: len(f)]
        if not t or 2 * len(t) < self.least * (len(t) + len(f)):
            return False
        count = self.counts.setdefault(len(t), Counter(t))
        if 2 * sum(min(n, count[c]) for c, n in Counter(f).items()) < self.least * (len(t) + len(f)):
            return False
        return difflib.SequenceMatcher(None, t, f, autojunk=False).ratio() >= self.least


_AND_OTHERS = re.compile(r"(.{4,}?)\W+et\s?[a4][l1I]\W*$", re.I)


def _headers(lines: list[str], pages: list[bool], edge: list[bool], seen: dict) -> list[bool]:
    full = [i for i, x in enumerate(lines) if x.strip()]
    out = [False] * len(lines)
    if not full:
        return out
    title = fold(lines[full[0]])
    like_title, like_names = _Like(title, 0.87), _Like(fold(lines[full[1]]) if len(full) > 1 else "", 0.75)
    for i in full[1:]:
        if pages[i]:
            continue
        bare = NUMBERED.sub("", lines[i].strip()).strip()
        for part in re.split(r"\s*[|/]\s+", bare):
            f = fold(part.rstrip(" .…:"))
            if len(f) >= 10 and (title.startswith(f) or like_title(f)):
                out[i] = True
            elif "et" in part.lower() and (m := _AND_OTHERS.match(part)) and like_names(fold(m[1])):
                out[i] = True
        if edge[i] and not out[i] and (key := _line_key(lines[i])):
            e, a = seen.get("E\t" + key, (0, None))[0], seen.get("A\t" + key, (0, None))[0]
            out[i] = e >= 3 and e >= 0.6 * a and not re.search(r"[a-z]{3,}[.!?]$", bare)
    return out


def _word_is_cut(a: str, mark: str, b: str, seen: dict) -> bool:
    """Is the word of a line end written without a hyphen there?"""
    if mark in "¬\xad":
        return True
    if b[:1].isupper() and not (a.isupper() and b.isupper()):
        return False
    joined, compound = seen.get(canonical(a + b), (0, None)), seen.get(f"{a.lower()}-{b.lower()}", (0, None))[0]
    if joined[0] != compound:
        return joined[0] > compound
    if joined[1]:
        return True
    known = [seen.get(canonical(x), (0, None)) for x in (a, b)]
    return not all(n >= 3 and c is None for n, c in known)


def _misread(word: str, seen: dict) -> str | None:
    """The corrected word, if it is one."""
    if not word.isascii() and not LIGATURES.keys().isdisjoint(word):
        return word.translate(_LIGATED)
    fix = seen.get(canonical(word), (0, None))[1]
    if fix and not (len(word) > 2 and word.isupper()):
        return fix[:1].upper() + fix[1:] if word[:1].isupper() and word[:1] not in "I" or word[:1] in "4" and fix[:1] == "a" else fix
    # without a known variant only a word that is rare in all texts may be misread
    if word.isascii() and word.isalpha() or seen.get(canonical(word), (0, None))[0] >= 5:
        return None
    if re.search(r"[Ѐ-ӿ]", word) and re.search(r"[A-Za-z]", word):
        return word.translate(str.maketrans("гаеорсух", "raeopcyx"))
    if re.fullmatch(r"\d*[lIO]\d+[lIO\d]*|\d+[lIO]+", word):
        return word.translate(str.maketrans("lIO", "110"))
    if re.fullmatch(r"[^\W\d_]*[^\W\d_]{2}[014569][^\W\d_]{2}[^\W\d_]*|[^\W\d_]{4,}[015]|[4][a-z]{4,}", word):
        return word.translate(str.maketrans("014569", "olasbg"))
    return None


def _mark(text: str, seen: dict) -> tuple[list[str], list[set[str]], dict]:
    """The lines, their kinds, and what to repair: {(line, word): replacement}, cut words and stray blanks."""
    lines, pages, edge = _layout(text)
    headers = _headers(lines, pages, edge, seen)
    skip = [p or h for p, h in zip(pages, headers)]
    kinds: list[set[str]] = [{"page"} if p else {"header"} if h else set() for p, h in zip(pages, headers)]
    cut_words, fixes, blanks = {}, {}, {}
    parts: set[tuple[int, str]] = set()
    for i, j, a, mark, b in _cuts(lines, skip):
        if _word_is_cut(a, mark, b, seen):
            kinds[i].add("hyphen")
            cut_words[i] = (j, a, b)
            parts |= {(i, a), (j, b)}
            whole = _misread(a + b, seen)
            if whole:
                # the misread character is in the part after which the two no longer agree
                at = next((k for k, (x, y) in enumerate(zip(canonical(a + b), canonical(whole))) if x != y), len(whole))
                kinds[i if at < len(a) else j].add("ocr")
                fixes[(i, a + b)] = whole
    for i, line in enumerate(lines):
        if skip[i]:
            continue
        for w in WORD.findall(ADDRESS.sub(" ", line)):
            if (i, w) not in parts and (fix := _misread(w, seen)) and fix != w:
                kinds[i].add("ocr")
                fixes[(i, w)] = fix
        for m in re.finditer(r"(?=(?<![^\W_])([^\W\d_]+) ([^\W\d_]+)(?![^\W_]))", line):
            a, b = m[1], m[2]
            if (i, a) in parts or (i, b) in parts or b[:1].isupper():
                continue
            n = seen.get(canonical(a + b), (0, None))[0]
            if n >= 5 and len(a + b) >= 2 and n >= 8 * min(seen.get(canonical(a), (0, None))[0], seen.get(canonical(b), (0, None))[0]) and seen.get(canonical(a + b), (0, None))[1] is None:
                kinds[i].add("ocr")
                blanks[(i, f"{a} {b}")] = a + b
    return lines, kinds, {"cut": cut_words, "fix": fixes, "blank": blanks, "skip": skip}


def _repair(text: str, seen: dict) -> str:
    """Continuous paragraphs: edge lines out, cut words whole, misread words replaced; a paragraph goes on across a page."""
    lines, _, how = _mark(text, seen)
    out: list[str] = []
    paragraph: list[str] = []
    carried: dict[int, str] = {}
    gap = edge = False
    for i, line in enumerate(lines):
        if how["skip"][i]:
            edge = True
            continue
        if not line.strip():
            gap = True
            continue
        t = line.strip("\f \t\r")
        if i in carried:  # the rest of a word that the line before has whole now
            t = t[len(carried[i]) :].lstrip() if t.startswith(carried[i]) else t
        for (k, w), good in how["blank"].items():
            if k == i:
                t = t.replace(w, good)
        for (k, w), good in how["fix"].items():
            if k == i:
                t = re.sub(rf"(?<![^\W_]){re.escape(w)}(?![^\W_])", good, t)
        if gap and i not in carried and not (edge and paragraph and not re.search(r"[.!?:»”\"]$", paragraph[-1]) and t[:1].islower()):
            out.append(" ".join(paragraph))
            paragraph = []
        gap = edge = False
        if i in how["cut"]:
            j, a, b = how["cut"][i]
            t = re.sub(rf"{re.escape(a)}[{HYPHENS}]\s*$", how["fix"].get((i, a + b), a + b), t)
            carried[j] = b
        elif re.search(r"\w[-‐]$", t):
            t += "\0"
        if t:
            paragraph.append(t)
    out.append(" ".join(paragraph))
    return re.sub(r" +([.,;:!?)\]])", r"\1", "\n\n".join(p for p in out if p).replace("\0 ", "").replace("\0", ""))


def _prepared(texts: DataFrame) -> tuple[DataFrame, list[str]]:
    keys = [c for c in texts.columns if c != "text"]
    docs = texts.where(F.col("text").isNotNull() & (F.trim("text") != "")).distinct().withColumn("uid", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in keys], "text"))
    wanted = cut(docs.select("uid", "text").mapInPandas(_lookups, "uid long, word string, n long"))
    counted = cut(wanted.where("n > 0").groupBy("word").agg(F.sum("n").alias("n")))
    facts = counted.join(corrections(counted.where(~F.contains(F.col("word"), F.lit("\t")))).hint("merge"), "word", "left")
    seen = wanted.select("uid", "word").join(facts.hint("merge"), "word").groupBy("uid").agg(F.collect_list(F.struct("word", "n", "correction")).alias("seen"))
    return docs.join(seen.hint("merge"), "uid", "left"), keys


def _seen(rows: object) -> dict:
    return {r["word"]: (r["n"], r["correction"]) for r in (rows if rows is not None else [])}


def scan_noise(texts: DataFrame) -> DataFrame:
    """(keys, line_no, kind) for `texts(keys..., text)`: header, page, hyphen and ocr lines; line_no counts from 1.

    All columns but `text` are keys. Null and blank texts give no rows, equal rows count once, an empty table gives no rows;
    a text is looked at as a whole, however long.
    """
    docs, keys = _prepared(texts)
    kinds = {c: k for c, k in docs.dtypes if c in keys}

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for values in p[[*keys, "text", "seen"]].itertuples(index=False, name=None):
                _, marks, _ = _mark(values[-2], _seen(values[-1]))
                rows += [(*values[:-2], i, k) for i, ks in enumerate(marks, 1) for k in sorted(ks)]
            yield pd.DataFrame(rows, columns=[*keys, "line_no", "kind"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    return docs.select(*keys, "text", "seen").mapInPandas(run, f"{schema}, line_no int, kind string")


def repaired(texts: DataFrame) -> DataFrame:
    """(keys, text): every text as continuous paragraphs, separated by blank lines. Same cases as `scan_noise`."""
    docs, keys = _prepared(texts)
    kinds = {c: k for c, k in docs.dtypes if c in keys}

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(*v[:-2], _repair(v[-2], _seen(v[-1]))) for v in p[[*keys, "text", "seen"]].itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=[*keys, "text"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    return docs.select(*keys, "text", "seen").mapInPandas(run, f"{schema}, text string")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [table(spark, sf_dir, t).select(F.lit(t).alias("src"), "paper_id", F.col("extracted_text").alias("text")) for t in ("experience_records", "pdf_resolutions")]
    return both[0].unionByName(both[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise(_texts(spark, sf_dir)).distinct()


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scanned texts as continuous paragraphs."""
    return repaired(_texts(spark, sf_dir))
