"""Problem 9: sentence units of every document, whatever its language or layout.

A document is cut into blocks at blank lines and its lines told apart (heading, list item, table row, log,
code and label lines are units; the rest is running text, in which a line break is a blank). In running text
a semi-Markov dynamic program chooses whole spans. A span's score is the sum of what its first word says for a beginning, what its last word
and mark say for an end, the cost of each quotation or bracket it leaves open, and the log-density of its length. All cuts between marks are
weighed, however far apart.

One pass over the corpus learns which words open a sentence in writing without capitals, which words have a dot that ends nothing, and how long
sentences are in dense and in spaced writing. The words that are kept have at least a share of RATE of all openings or dots, so there are at most 1 / RATE of
them, at every size of the corpus. Null and blank texts have no unit; a text without any mark is one unit for each block.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.records import read
from skein.session import Written

# Abbreviations before a name or word, before a number only, and such as may also end a sentence.
BEFORE_WORD = """
dr mr mrs ms prof gov sen univ dept st sr sra dra srta hr fr frau mme mlle mm m gen col capt lt rev hon ing lic vgl cf z.b d.h u.a i.d.r bzw e.g i.e vs esp incl approx ca aprox env
p.ex p.ej c.-à-d т.е т.к т.д напр см им г д ул проф акад डॉ श्री د أ م
""".split()
BEFORE_NUMBER = "no nos nr ver fig figs tab eq eqs ch vol sec pp p n núm num pág págs art abb bd s рис стр гл табл क्र र пп № min max".split()
MAY_END = "etc usw jr sr co inc ltd corp u.s u.k e.u a.m p.m min std sec др al".split()
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jan feb apr jun jul aug sep okt nov dez".split())
OPENERS, CLOSERS = "([{«“„‚「『《〈（【‹", ")]}»”’」』》〉）】›"
PAIRS_BACK = {"«": "»", "‹": "›"}
PAIRS = {")": "(", "]": "[", "}": "{", "»": "«", "」": "「", "』": "『", "》": "《", "）": "（", "】": "【", "›": "‹"}
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u180e\u200e\u200f"
#: The least share of a learned word among all openings (or dots), and the part of its dots that a small letter or comma follows.
RATE, GOES_ON = 1 / 200_000, 0.5
#: The cost of a cut within a quotation, the weight of the log-density of a span's length, and its least value.
OPEN_COST, LENGTH_WEIGHT, LEAST_LENGTH = 12.0, 0.5, -3.0

_hidden = dict.fromkeys(map(ord, INVISIBLE))
_in_parts = {x for x in BEFORE_WORD + MAY_END if "." in x}
_before_word, _before_number, _may_end = set(BEFORE_WORD), set(BEFORE_NUMBER), set(MAY_END)
_line = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_blank = re.compile(rf"[\s{INVISIBLE}]*")
_caseless = re.compile(r"[\u0590-\u08ff\u0900-\u0dff\u0e00-\u0eff\u1000-\u109f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_dense = re.compile(r"[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]")
_mark = re.compile(r"[.!?…。！？।॥؟۔｡．]+")
_thai = re.compile(r"(?<=[\u0e00-\u0e7f])[^\S\n]*\s+(?=[\u0e00-\u0e7f])")
_heading = re.compile(r"#{1,6}\s+\S")
_bullet = re.compile(r"[-*•◦‣·–+]\s+\S")
_numbered = re.compile(r"(?:\(?\d{1,3}[.)]|\(?[A-Za-z]\))\s+\S")
_log = re.compile(r"\[?\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?\]?\s|\[\d{4}-\d\d-\d\d|\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE)\b[\]:]?\s")
_code = re.compile(r"(?:def|class|for|while|if|elif|else|try|except|with|import|from|return|const|let|var|func|print)\b.*[:;){}\]\w]\s*(?:#.*)?$")
_code_more = re.compile(r"\w+\s*=\s*\S|\w+\(.*\)|[{};]\s*$|^\s*(?:#|//)")
_label = re.compile(r"[^\W\d_][\w'’\-]*(?: [\w'’\-]+){0,2}:\s+(?![\"“«„「‘'])\S")
_marker = re.compile(r"<\|[^|<>]*\|>")
_part = re.compile(r"[^\w]*([^\W\d_]{1,3}\.)$")
_quote = re.compile(r"[()\[\]{}«»„“”\"「」『』《》（）【】‹›]")
_next_word = re.compile(r"[\w़-ॿ'’\-]+")
_dotted_word = re.compile(r"(?<![\w.])([^\W\d_]{1,8})\.(?=(,|[^\S\n]+[^\W\d_]))")


@dataclass(frozen=True)
class Learned:
    """What one pass over the corpus learned: opening words, abbreviations, and mean and deviation of the logarithm of a sentence's length, spaced and dense."""

    openings: frozenset[str] = frozenset()
    abbreviations: frozenset[str] = frozenset()
    lengths: tuple[tuple[float, float], tuple[float, float]] = ((4.2, 0.8), (3.0, 0.8))


def _stripped(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and (text[a].isspace() or text[a] in INVISIBLE):
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in INVISIBLE):
        b -= 1
    return a, b


def blocks(text: str) -> list[list[tuple[int, int]]]:
    """The lines (start, end) of each block, without blank lines."""
    out: list[list[tuple[int, int]]] = [[]]
    at = 0
    for m in _line.finditer(text):
        if _blank.fullmatch(text, at, m.start()):
            out.append([])
        else:
            out[-1].append((at, m.start()))
        at = m.end()
    if not _blank.fullmatch(text, at):
        out[-1].append((at, len(text)))
    return [b for b in out if b]


def line_kinds(lines: list[str]) -> list[str]:
    """For each line of a block: 'line' if it is a unit, 'more' if it goes on with the unit before, 'text' if it is running text."""
    bare = [x.strip() for x in lines]
    deep = [x[:4] == "    " or x[:1] == "\t" for x in lines]
    code = [bool(_code.match(b)) and not b.endswith(".") or d and bool(_code_more.search(b)) for b, d in zip(bare, deep)]
    if sum(code) * 2 >= len(lines) and any(d or c for d, c in zip(deep, code)):
        return ["line"] * len(lines)
    pipes = [_marker.sub("", b).count("|") if "|" in b else 0 for b in bare]
    table = [b[0] == "|" and n >= 2 or n >= 2 and sum(map(bool, pipes)) > 1 or "\t" in b and sum("\t" in y for y in bare) > 1 for b, n in zip(bare, pipes)]
    labels = len(bare) > 1 and sum(bool(_label.match(b)) for b in bare) * 5 >= 4 * len(bare)
    out: list[str] = []
    for i, b in enumerate(bare):
        listed = bool(_bullet.match(b)) or bool(_numbered.match(b)) and (i == 0 or out[-1] == "line")
        if table[i] or listed or _heading.match(b) or _log.match(b) or labels and _label.match(b):
            out.append("line")
        elif set(b) <= {"=", "-", "_", "*", "~"} and len(b) > 2:
            if i and b[0] in "=-" and out[-1] == "text":
                out[-1] = "line"
            out.append("line")
        elif out and out[-1] in ("line", "more") and deep[i] is False and lines[i][:2] == "  " and (_bullet.match(bare[i - 1]) or _numbered.match(bare[i - 1]) or out[-1] == "more"):
            out.append("more")
        else:
            out.append("text")
    return out


def _opening(text: str, at: int, end: int, openings: frozenset[str]) -> tuple[float, str]:
    """(what the word at a position says for a beginning, the word)."""
    while at < end and (text[at] in OPENERS or text[at] in "\"'¿¡*_—–-" or text[at].isspace() or text[at] in INVISIBLE):
        at += 1
    if at >= end:
        return 0.0, ""
    c = text[at]
    m = _next_word.match(text, at, end)
    word = m.group() if m else c
    if _caseless.match(c):
        key = word[:2] if _dense.match(c) else word
        return (1.0 if key in openings else -1.5), word
    if c.isupper():
        return 2.0, word
    if c.islower():
        more = text[at + len(word) : at + len(word) + 2]
        return (1.0 if "_" in word or len(more) > 1 and more[0] in "._" and more[1].isalnum() and at + len(word) + 1 < end or (any(x.isupper() for x in word[1:]) and "'" not in word) else -9.0), word
    return (0.5 if c.isdigit() or c == "<" or c == "`" else 0.0 if ord(c) > 0x2000 else -1.0), word


def _last_word(text: str, a: int, b: int) -> str:
    """The word before a dot, with the parts of an abbreviation before it, as in "z. B"."""
    words = text[a:b].translate(_hidden).split()
    if not words or not b or text[b - 1].isspace():
        return ""
    last = words.pop()
    at = len(last)
    while at and (last[at - 1].isalnum() or last[at - 1] == "." or "\u0300" <= last[at - 1] <= "\u036f" or "\u0900" <= last[at - 1] <= "\u0dff"):
        at -= 1
    if at or not words:
        return last[at:].lstrip(".")
    m = _part.match(words[-1])
    return m[1] + last if m else last.lstrip(".")


def _ending(text: str, start: int, m: re.Match, nxt: int, word: str, glued: bool, abbreviations: frozenset[str]) -> float:
    """What the mark and the word before it say for an end; ``nxt`` is where the next word begins."""
    mark = m.group()
    if mark[0] in "。！？।॥؟۔｡":
        return 6.0
    if mark[0] in "!?":
        return 5.0 if not glued else 3.0
    if mark[0] == "…" or len(mark) > 1:
        return 1.5 if len(mark) < 4 or mark[0] == "…" else 1.0
    last = _last_word(text, max(start, m.start() - 24), m.start())
    low = last.lower()
    tail = low.rpartition(".")[2]
    if glued:
        ok = len(tail) > 1 and last[-1:].islower() and word[:1].isupper() and (len(word) == 1 or word[1] in "'’" or word[1].islower()) or bool(_caseless.match(last[-1:] or "x"))
        return 4.0 if ok and low not in _before_word and tail not in _before_number else -9.0
    if f"{low}.{word.lower()}" in _in_parts or low in abbreviations and low not in _may_end:
        return -7.0
    digit, upper = word[:1].isdigit() or word[:1] == "#", word[:1].isupper()
    if low in _before_word or (tail in _before_word and ("." not in low or not tail.isascii())):
        if not (len(tail) == 1 and tail.isascii() and last[-1:].islower()):
            return -7.0
    if low in _may_end or tail in _may_end:
        if digit and tail in _before_number:
            return -7.0
        return 2.0 if upper or digit else -3.0
    if tail in _before_number:
        return -7.0 if digit or word[:1] in "(" or tail not in ("no", "art", "min", "max", "sec", "num", "s", "n", "p") else 4.0
    if len(tail) == 1 and tail.isalpha() and (last[-1:].isupper() or "." in low):
        return -6.0 if last[-1:].isupper() and upper and not _caseless.match(tail) else 2.0 if upper else -6.0
    if tail.isdigit() and word.lower() in MONTHS:
        return -7.0
    return 6.0


def quotations(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """(opening, closing) positions of the quotations and brackets of text[a:b] that are closed; what has no partner is none.

    A mark that is drawn alike at both ends (or turned around in some languages) opens if a blank or an opening is before it.
    """
    open_: list[tuple[str, int]] = []
    out = []
    for m in _quote.finditer(text, a, b):
        q, at = m.group(), m.start()
        before, after = text[at - 1 : at] if at > a else " ", text[at + 1 : at + 2] if at + 1 < b else " "
        opens, closes = before.isspace() or before in OPENERS, not after.isalnum()
        kind = {'"': '"', "”": "“", "“": "“", "„": "“", "«": "«", "»": "«", "‹": "‹", "›": "‹"}.get(q, PAIRS.get(q, q))
        had = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == kind), None)
        if q == '"' or q in "»›":
            start = opens and not after.isspace() if q == '"' else opens and not after.isspace() and had is None
        elif q == "“":
            start = had is None or text[open_[had][1]] != "„"
        elif q in "«‹":
            start = had is None or text[open_[had][1]] != PAIRS_BACK[q]
        else:
            start = q not in PAIRS and q != "”"
        if start and not (q == '"' and had is not None and not opens):
            if q == '"' and had is not None:  # the one before was never closed
                del open_[had]
            open_.append((kind, at))
        elif had is not None and (q != '"' or closes or not opens):
            out.append((open_[had][1], at))
            del open_[had:]
    return out


def spans(text: str, a: int, b: int, learned: Learned) -> list[tuple[int, int]]:
    """The sentences of running text[a:b], as (start, end) without blanks around."""
    cuts: list[tuple[int, int, float, float]] = []  # (end of a span, start of the next, score of the end, score of the beginning)
    for m in _mark.finditer(text, a, b):
        end = m.end()
        while end < b:
            c = text[end]
            if c in CLOSERS or c == "“" and text.rfind("„", a, end) > text.rfind("“", a, end) or c in "\"'" and (end + 1 >= b or not text[end + 1].isalnum()):
                end += 1
            elif c in "\u00a0\u202f " and end + 1 < b and text[end + 1] in "»›":
                end += 2
            else:
                break
        nxt = end
        while nxt < b and (text[nxt].isspace() or text[nxt] in INVISIBLE):
            nxt += 1
        if nxt >= b:
            break
        if text[nxt] in CLOSERS and text[nxt] not in "“’" or text[nxt] in ",;:%":
            continue
        dense = m.group()[0] in "。！？।॥؟۔｡" or bool(_caseless.match(text[nxt])) or end > m.end()
        glued = nxt == end and not dense
        if glued and m.group() == "." and not text[nxt].isupper():
            continue
        opening, word = _opening(text, nxt, b, learned.openings)
        if m.group()[0] in "。！？।॥؟۔｡":
            opening = max(opening, -1.5)
        ending = _ending(text, a, m, nxt, word, nxt == end and m.group() == "." and end == m.end(), learned.abbreviations)
        if end > m.end() and _caseless.match(word[:1] or " ") and opening < 0:
            ending -= 6.0  # a quotation goes on in its sentence
        if ending + opening > -4.0:
            cuts.append((end, nxt, ending, opening))
    for m in _thai.finditer(text, a, b):
        cuts.append((m.start(), m.end(), 6.0, 0.0))
    if not cuts:
        return [_stripped(text, a, b)]
    cuts.sort()
    for o, c in quotations(text, a, b):
        # A cut within a quotation leaves it open in the span before.
        for i in range(bisect.bisect_right(cuts, (o + 1,)), bisect.bisect_right(cuts, (c, math.inf))):
            cuts[i] = (*cuts[i][:2], cuts[i][2] - OPEN_COST, cuts[i][3])
    cuts = [(a, a, 0.0, 0.0), *cuts, (b, b, 0.0, 0.0)]
    mean, deviation = learned.lengths[bool(_dense.search(text, a, b))]
    # Beyond this length the log-density is below its least value, so all spans that are longer have the same score of length.
    longest = math.exp(mean + deviation * math.sqrt(-2 * LEAST_LENGTH))
    best, back = [0.0] + [-math.inf] * (len(cuts) - 1), [0] * len(cuts)
    far, far_at, behind = -math.inf, 0, 0  # the best beginning among those too far back, and where the others begin
    for j in range(1, len(cuts)):
        end = cuts[j][0]
        while behind < j and end - cuts[behind][1] > longest:
            if best[behind] + cuts[behind][3] > far:
                far, far_at = best[behind] + cuts[behind][3], behind
            behind += 1
        top, at = far + LENGTH_WEIGHT * LEAST_LENGTH, far_at
        for i in range(behind, j):
            size = end - cuts[i][1]
            z = (math.log(size if size > 1 else 1) - mean) / deviation
            s = best[i] + cuts[i][3] + LENGTH_WEIGHT * max(LEAST_LENGTH, -z * z / 2) - (1.0 if size < 4 else 0.0)
            if s > top:
                top, at = s, i
        best[j], back[j] = top + cuts[j][2], at
    out, j = [], len(cuts) - 1
    while j:
        out.append(_stripped(text, cuts[back[j]][1], cuts[j][0]))
        j = back[j]
    return [x for x in reversed(out) if x[0] < x[1]]


def sentences(text: str | None, openings: frozenset[str] = frozenset(), learned: Learned | None = None) -> list[tuple[int, int]]:
    """All units of a text, in order, by what was learned, or by opening words alone."""
    learned = learned or Learned(openings)
    out: list[tuple[int, int]] = []
    for block in blocks(text) if text else ():
        kinds = line_kinds([text[a:b] for a, b in block]) if len(block) > 1 or _special(text, *block[0]) else ["text"]
        run: tuple[int, int] | None = None
        for (a, b), kind in zip(block, kinds):
            if kind == "text":
                run = (run[0] if run else a, b)
                continue
            if run:
                out.extend(spans(text, *run, learned))
                run = None
            if kind == "more" and out:
                out[-1] = (out[-1][0], _stripped(text, a, b)[1])
            else:
                out.append(_stripped(text, a, b))
        if run:
            out.extend(spans(text, *run, learned))
    return [x for x in out if x[0] < x[1]]


def _special(text: str, a: int, b: int) -> bool:
    a, _ = _stripped(text, a, b)
    return not text[a].isalpha() or text[max(0, a - 4) : a] == "    " or text[a : a + 8].startswith(("def ", "for ", "if ", "return ", "import ", "class ", "WARN", "ERROR", "INFO")) or text[a + 1 : a + 2] in ".)"


def kept_words(counted: DataFrame, total: int) -> frozenset[str]:
    """The words with at least RATE of ``total``, less than one deviation of a count above it left out: at most 1 / RATE of them."""
    return frozenset(r.w for r in counted.where(F.col("n") - F.sqrt("n") > RATE * total).select("w").collect())


def learn(docs: DataFrame) -> Learned:
    """One pass: words that open blocks of writing without capitals (of dense writing: two characters), words before a dot, and lengths of blocks of one sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            opened: Counter[str] = Counter()
            ended: Counter[str] = Counter()
            going: Counter[str] = Counter()
            sums = [[0, 0.0, 0.0], [0, 0.0, 0.0]]
            for x in b.column("text").to_pylist():
                if not x:
                    continue
                if "." in x:
                    for m in _dotted_word.finditer(x):
                        ended[m[1].lower()] += 1
                        going[m[1].lower()] += m[2] == "," or m[2][-1].islower()
                caseless = bool(_caseless.search(x))
                for block in blocks(x):
                    a, e = block[0]
                    marks = list(_mark.finditer(x, a, block[-1][1]))
                    if len(marks) == 1 and not x[marks[0].end() : block[-1][1]].strip(CLOSERS + INVISIBLE + "\"' \t\r"):
                        log = math.log(max(1, block[-1][1] - a))
                        of = sums[bool(_dense.search(x, a, e))]
                        of[0], of[1], of[2] = of[0] + 1, of[1] + log, of[2] + log * log
                    while a < e and not text_char(x[a]):
                        a += 1
                    if caseless and a < e and _caseless.match(x[a]):
                        m = _next_word.match(x, a, e)
                        opened[x[a : a + 2] if _dense.match(x[a]) else m.group() if m else x[a]] += 1
            rows = [*(("open", w, n, 0.0, 0.0) for w, n in opened.items()), *(("dot", w, n, float(going[w]), 0.0) for w, n in ended.items()), *(("size", str(i), *of) for i, of in enumerate(sums))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64()))], ["kind", "w", "n", "x", "y"])

    found = docs.select("text").mapInArrow(run, "kind string, w string, n bigint, x double, y double")
    counted = Written(docs.sparkSession, "p9").table(found.groupBy("kind", "w").agg(*(F.sum(c).alias(c) for c in "nxy")), "counted")
    total = {r.kind: r.n or 0 for r in counted.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    dots = counted.where("kind = 'dot'")
    goes_on = dots.where(F.col("x") >= GOES_ON * F.col("n")).select("w", F.col("x").alias("n"))
    lengths = list(Learned().lengths)
    for r in counted.where("kind = 'size' and n > 30").collect():
        mean = r.x / r.n
        lengths[int(r.w)] = (mean, max(0.3, math.sqrt(max(0.0, r.y / r.n - mean * mean))))
    return Learned(kept_words(counted.where("kind = 'open'"), total.get("open", 0)), kept_words(goes_on, total.get("dot", 0)), tuple(lengths))


def text_char(c: str) -> bool:
    return c.isalnum()


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos) of each unit of each document; other columns are not looked at."""
    learned = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, ends = [], [], []
            for i, x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for s, e in sentences(x, learned=learned.value):
                    ids.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "start_pos", "end_pos"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, start_pos int, end_pos int")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(read(spark, sf_dir, "documents"))


QUERIES = {"p9_found": p9_found}
