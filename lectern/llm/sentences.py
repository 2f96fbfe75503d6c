"""Problem 10: sentence boundaries across languages and scripts.

A pushdown automaton runs over the events of a text (terminators, quotation marks, brackets, line ends, blanks between letters of a script
without terminators). Its stack holds the open quotation marks, brackets and the list item; a sentence can end only on an empty
stack, or where closing a mark empties it. Whether a full stop ends anything is decided with two tries of abbreviations, read
backwards from the stop, and by what comes next. It runs per document in Arrow batches and emits offsets only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.runtime import table

# Abbreviations that never end a sentence before a word that goes on, in any of the languages.
NEVER = """dr prof mr mrs ms mx st fig figs eq eqs sec secs ch tab vol app alg p pp cf vs e.g i.e viz approx no nos ref refs resp def thm gen rev hon inst dept univ ed eds
bl.a f.eks jf kl ca dvs pr s d nr hr fr stk afs cand cand.scient cand.polyt cand.mag m.fl mag ing fx jvf vedr evt inkl ekskl tlf
z.b d.h u.a bzw vgl abb kap fa lt hrn frl hr inkl zzgl ggf evtl sog bspw nr str bd hrsg jh
m mm mme mlle mgr pr art env av chap éd p.ex c.-à-d j.-p j.-c j.-l j.-m
sr sra srta dra d dña pág págs cap núm aprox p.ej ej ee
см рис табл гл проф акад доц г гг тыс млн млрд стр с т п ул им др напр т.е т.к т.д т.п и.о
أ د ص م ج डॉ प्रो श्री श्रीमती सं पृ""".split()
# Abbreviations that may end a sentence: they do if a capital follows.
MAYBE = """ltd co inc corp jr sr a.m p.m etc al usw usf u.s u.k u.n.k m.v m.m mv o.l osv uu pct tech руб коп др пр ff f bros esq ph.d m.sc b.sc""".split()
# Words after which a number with a stop is an ordinal.
ORDINAL = set("am im der dem den des die das vom zum zur beim ab bis seit dieser diesem jeder jedem ihrer seiner d den".split())
# Words after which a single capital names a part and may end the sentence.
LABEL = set("anhang appendix bilag annexe anexo table figure teil part class klasse type typ gruppe group vitamin plan".split())
# Names that end in an exclamation mark.
SHOUT = {"Wow", "Yahoo", "Jeopardy", "Yum"}
STOPS, WIDE = ".!?؟।॥", "。！？｡"
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "《": "》", "〈": "〉", "「": "」", "『": "』", "“": "”", "„": "“", "«": "»", "»": "«", '"': '"', "‚": "‘", "‹": "›"}
CLOSERS = {"”": "“„", "“": "„", "»": "«", "«": "»", '"': '"', **{PAIRS[x]: x for x in "([{（【《〈「『‹"}}
MARK = re.compile(r"[ \t]*(?:[-*•‣◦▪–·]|\(?\d{1,3}[.)]|\(?[A-Za-z]\))[ \t]+(?=\S)")
BULLET = re.compile(r"[ \t]*[*•‣◦▪·-][ \t]+(?=\S)")
EVENT = re.compile(r"[.!?؟।॥。！？｡]+|…+|[(\[{（【《〈「『“„«»\"‚‹)\]}）】》〉」』”›]|\n|(?<=[฀-๿])[ \n]+(?=[฀-๿A-Z])")
BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
THAI_ON = ("เช่น", "และ", "หรือ", "ซึ่ง", "ที่", "โดย", "ว่า", "ๆ", "คือ", "ได้แก่", "กับ", "ของ", "จำนวน")


def _trie(words: Iterable[str]) -> dict:
    root: dict = {}
    for w in words:
        at = root
        for c in reversed(w):
            at = at.setdefault(c, {})
        at[""] = True
    return root


_NEVER, _MAYBE = _trie(NEVER), _trie(MAYBE)


def _ends_in(trie: dict, text: str, end: int) -> bool:
    """Does text[:end] end in a whole word of the trie?"""
    at, i = trie, end
    while i > 0 and (c := text[i - 1].lower()) in at:
        at, i = at[c], i - 1
        if "" in at and (i == 0 or not (text[i - 1].isalnum() or unicodedata.category(text[i - 1]) in ("Mn", "Mc") or text[i - 1] in ".-’'")):
            return True
    return False


def _word_before(text: str, end: int) -> str:
    i = end
    while i > 0 and not text[i - 1].isspace():
        i -= 1
    return text[i:end]


def _cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "가" <= c <= "힯" or c in "。！？「」『』（），、；：“”"


def _opens(text: str, at: int) -> tuple[str, str]:
    """The first character after blanks and the first letter or digit after opening marks."""
    while at < len(text) and text[at].isspace():
        at += 1
    first = text[at] if at < len(text) else ""
    while at < len(text) and (text[at] in PAIRS or text[at] in "¿¡‘'*_—–-" or text[at].isspace()):
        at += 1
    return first, text[at : at + 24]


def _goes_on(text: str, at: int) -> bool:
    """Does what follows position `at` continue the sentence rather than begin a new one?"""
    first, word = _opens(text, at)
    if not first:
        return False
    if first in "»”":  # a closing mark after a blank, unless a word follows it at once, as in »Det
        return not word[:1].isalnum() or text[text.find(first, at) + 1 : text.find(first, at) + 2].isspace()
    if first in ",;:،؛，；、)]}—–-":
        return True
    if word[:1].islower():
        head = re.match(r"\w+", word)
        return not (head and any(c.isupper() for c in head[0]))  # as in pySweep
    return False


def _stop_ends(text: str, start: int, stop: int, after: int) -> bool:
    """Does the full stop at `stop`, with what closes up to `after`, end a sentence that began at `start`?"""
    before = text[stop - 1] if stop else ""
    nxt = text[after] if after < len(text) else ""
    if "ऀ" <= before <= "ॿ":
        return False
    if nxt and not nxt.isspace() and not _cjk(nxt) and not (nxt in PAIRS and before.isalpha()):
        # no blank: only a long word and a capital, as in "informe.EE"
        word = re.search(r"(?:^|\s|[(\"“«„»])([^\W\d_]{3,})$", text[max(0, stop - 40) : stop])
        return bool(word and word[1][-1].islower() and nxt.isupper() and not _ends_in(_NEVER, text, stop) and not re.match(r"\w+[./@]\w", text[after : after + 30]))
    if _goes_on(text, after):
        return False
    first, word = _opens(text, after)
    token = _word_before(text, stop).lstrip("(\"'“«„»[{¿¡‘")
    if token.lower() in ("no", "nos") and after > stop + 1 or token.lower() == "no" and not first.isdigit() and first not in ("", "("):
        return True
    if _ends_in(_MAYBE, text, stop):
        return word[:1].isupper() and first not in "([" or not word or not (word[0].isalnum() or first in PAIRS)
    if _ends_in(_NEVER, text, stop):
        return not word
    if token.isdigit():
        prior = _word_before(text, stop - len(token) - 1).lower().lstrip("(\"'“«„")
        return not (prior in ORDINAL and word[:1].isalpha())
    letters = re.sub(r"[-.]", "", token)
    if len(letters) == 1 and letters.isalpha() and unicodedata.category(letters) in ("Lu", "Ll", "Lo") and ord(letters) < 0x1D400:
        prior = _word_before(text, max(0, stop - len(token) - 1)).lower()
        if prior in LABEL:
            return True
        if unicodedata.category(letters) == "Lo" or letters.islower() or "." in token or "-" in token:
            return not word
        return not (word[:1].isupper() or word[:1].isalpha())
    if re.fullmatch(r"(?:[A-Z]\.?-?)+", token) and "." in token:
        return word[:1].isupper() and "-" not in token
    return True


def _block(text: str) -> list[int]:
    """The ends of the sentences of a block without blank lines; the last end is len(text)."""
    ends: list[int] = []
    item = MARK.match(text) is not None
    last = {c: text.rfind(c) for c in set(CLOSERS)}
    stack: list[tuple[str, int]] = []
    start = 0
    skip = 0

    def end(at: int) -> None:
        nonlocal start
        ends.append(at)
        start = at

    for m in EVENT.finditer(text):
        i, run = m.start(), m.group()
        if i < skip:
            continue
        c = run[0]
        if c == "\n":
            line = m.end()
            marked = MARK.match(text, line) if item else BULLET.match(text, line) or (MARK.match(text, line) if text[start:i].rstrip().endswith(":") else None)
            if marked and (item or not stack):
                stack.clear()
                item = True
                end(i)
            continue
        if item:
            continue
        if run.isspace():
            if not stack and _thai_splits(text, start, i, m.end()):
                end(i)
            continue
        if c in CLOSERS and stack and stack[-1][0] in CLOSERS[c]:
            _, opened = stack.pop()
            if stack:
                continue
            prior = text[i - 1] if i else ""
            at = i + 1
            if prior in STOPS or prior in WIDE or prior == "…":
                nxt = text[at : at + 1]
                if nxt and nxt in STOPS + WIDE:
                    continue
                if _quote_ends(text, start, opened, i, prior, c):
                    end(at)
            continue
        if c in PAIRS:
            closer = ("”", "“") if c in "“„" else (PAIRS[c],)
            if any(last.get(x, -1) > i for x in closer):
                stack.append((c, i))
            continue
        if c in CLOSERS or c not in STOPS + WIDE:
            continue
        if stack:
            continue
        at = m.end()
        while at < len(text) and text[at] in "”»“\"'’)]」』）" and not (text[at] in PAIRS and text[at] not in CLOSERS):
            if text[at] in "“«»\"" and (at + 1 >= len(text) or not text[at + 1].isspace()):
                break
            at += 1
        if any(x in WIDE for x in run):
            end(at)
        elif "।" in run or "॥" in run:
            if not _goes_on(text, at):
                end(at)
        elif run == ".":
            if _stop_ends(text, start, i, at):
                end(at)
        elif run[0] == "." and len(run) > 1 and not set(run) - {"."}:
            if at >= len(text) or text[at].isspace() and not _goes_on(text, at):
                end(at)
        else:
            nxt = text[at : at + 1]
            if (not nxt or nxt.isspace() or _cjk(nxt) or nxt.isupper()) and not _goes_on(text, at):
                if not (run == "!" and _word_before(text, i) in SHOUT and text[start:i].split()[:-1]):
                    end(at)
        skip = at if ends and ends[-1] == at else skip
    if text[start:].strip():
        ends.append(len(text))
    return ends


def _quote_ends(text: str, start: int, opened: int, closed: int, prior: str, mark: str) -> bool:
    """Does closing the last open mark, right after a terminator, end the sentence?"""
    at = closed + 1
    if _goes_on(text, at):
        return False
    first, word = _opens(text, at)
    if prior == "." and mark in ")]":
        lead = text[start:opened].strip()
        if lead and (not first or not word[:1].isupper() or _ends_in(_NEVER, text, closed - 1) or _ends_in(_MAYBE, text, closed - 1)):
            return False
        return not first or text[at : at + 1].isspace()
    if not first:
        return True
    nxt = text[at]
    if not nxt.isspace() and (_cjk(nxt) or nxt.isalpha()):
        # scripts without capitals: a quotation after a colon closes its sentence, one that stands first is followed by who says it
        return text[start:opened].rstrip().endswith((":", "：")) and not ("぀" <= nxt <= "ゟ")
    if word[:1].isupper() or not word or not word[0].isalpha() or word[0].lower() == word[0].upper():
        lead = text[start:opened].strip()
        # a title-like quotation inside a sentence goes on with a capital only after a colon, comma or at the sentence's start
        return not lead or lead[-1] in ":：,，،" or word[:1].isupper() or word[0].lower() == word[0].upper()
    return False


def _thai_splits(text: str, start: int, i: int, at: int) -> bool:
    rest = text[at : at + 40]
    if not "฀" <= rest[:1] <= "๿":
        return bool(re.match(r"[A-Z][a-z]+ [a-z]+ [a-z]+", rest))
    if rest.startswith(THAI_ON):
        return False
    said = text[start:i]
    tail = re.split(r"[ \n]", said)[-1]
    if tail in THAI_ON or tail.endswith(("เช่น", "ๆ และ")):
        return False
    if "เช่น" in said and rest.startswith("ถูก") and " ถูก" not in said:
        return False
    return True


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence in Unicode characters, outer white space left out; none for null, empty and blank texts."""
    if not text or text.isspace():
        return []
    out = []
    begin = 0
    flat = text.replace("\r\n", " \n").replace("\r", "\n")  # of equal length
    for m in [*BLANK.finditer(flat), None]:
        stop = m.start() if m else len(flat)
        block = flat[begin:stop]
        at = 0
        for e in _block(block):
            piece = block[at:e]
            lead = len(piece) - len(piece.lstrip())
            if piece.strip():
                out.append((begin + at + lead, begin + at + lead + len(piece.strip())))
            at = e
        begin = m.end() if m else stop
    return out


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_char, end_char): one row per sentence of every text. Null, empty and blank texts give no rows, repeated rows repeat
    theirs, a text of any length is split as a whole; other columns are ignored; an empty table gives no rows."""

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            spans = [sentence_spans(t) for t in p["t"]]
            yield pd.DataFrame({"k": p["k"].repeat([len(s) for s in spans]), "start_char": [a for s in spans for a, _ in s], "end_char": [b for s in spans for _, b in s]})

    kind = dict(df.dtypes)[key]
    found = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").mapInPandas(run, f"k {kind}, start_char int, end_char int")
    return found.withColumnRenamed("k", key)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"), "doc_id", "text")
