"""Problem 6: abusive, hateful or sexual texts, by maximum-scoring segments of token log-odds.

Tokens are read through common disguises (look-alikes, digits for letters, stretched or spaced letters,
stars). Each token's score is its log-odds of occurring in unsafe against safe labelled texts, with
Dirichlet priors from its counts in the whole corpus, less a cost for every token. A linear scan
finds all maximal segments of a text; their scores are calibrated by the extreme-value law
P(S >= x) = 1 - exp(-K n exp(-L x)), with L from the score distribution of safe texts and K from their best segments.
The labels are noisy, so after each round the counts are taken again: of unsafe texts only the tokens of
their significant segments. The level of significance is the one at which the labels are met best.

The model is fitted on at most MAX_LABELLED labelled rows (those of smallest hash) with at most MAX_BYTES of text; the counts of the prior and the
scores cover all rows. Null and blank texts have score 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import forms, keys
from skein.llm.records import all_texts, read, texts
from skein.session import Written

MAX_LABELLED, MAX_BYTES, PRIOR, TOKEN_COST, ROUNDS = 40_000, 64 << 20, 60.0, 0.8, 4
#: Bounds of a token's score, the pseudo-counts of a flag term for each unit of weight, the laxest level of significance,
#: and the count of a token that no safe text has.
LEAST, MOST, FLAG, LEVEL, UNMET = -2.5, 3.5, 0.5, 0.01, 0.3

# Characters written for a letter.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i", "|": "l"})
_dotted = re.compile(r"(?<![\w*])([^\W\d_])([.\-_·])((?:[^\W\d_]\2)+)([^\W\d_])(?![\w*])")
_spaced = re.compile(r"(?<!\S)[^\W\d_](?: [^\W\d_]){2,}(?![^\s.,;:!?])")
_token = re.compile(r"[^\W_](?:[\w*$@!|]*[\w*$@])?")
_repeat = re.compile(r"(.)\1+")
_leet = re.compile(r"[013457$@!|]")
_long_number = re.compile(r"\d{4}")
_han = re.compile(f"[{keys.HAN_KANA}ー]+")


def _read_token(raw: str) -> str:
    if _leet.search(raw) and not _long_number.search(raw):
        plain = raw.translate(DISGUISE)
        if plain.replace("*", "").isalpha() and not raw.isdigit() and sum(map(str.isalpha, raw)) * 3 >= len(raw):
            raw = plain
    return raw


def tokens(text: str | None) -> list[str]:
    """The tokens of a text as they are meant; a token with stars keeps them."""
    form = forms.visible_form(text)
    if not form:
        return []
    low = form.casefold()
    if "." in low or "-" in low or "_" in low or "·" in low:
        low = _dotted.sub(lambda m: m.group().replace(m[2], ""), low)
    low = _spaced.sub(lambda m: m.group().replace(" ", ""), low)
    out = []
    for raw in _token.findall(low):
        if not raw.isascii() and _han.search(raw):
            for run in _han.findall(raw):
                out.extend(run[i : i + 2] for i in range(max(1, len(run) - 1)))
            rest = _han.sub("", raw)
            if rest:
                out.append(rest)
        elif "*" in raw:
            out.append(_read_token(raw))
        else:
            out.append(_repeat.sub(r"\1", _read_token(raw)))
    return out


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in time linear in the length."""
    stack: list[list] = []  # [start, end, sum before, sum through, index of the nearest segment with a smaller sum before]
    at = 0.0
    for i, x in enumerate(scores):
        before, at = at, at + x
        if x <= 0:
            continue
        start, left = i, before
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= at:
                stack.append([start, i + 1, left, at, j])
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r, _ in stack]


@dataclass
class Model:
    """Token scores, the score of tokens that were not seen, and the calibration of segments."""

    scores: dict[str, float] = field(default_factory=dict)
    unseen: float = -TOKEN_COST
    lam: float = 1.0
    k: float = 1.0
    level: float = -math.log10(LEVEL)
    starred: dict[tuple[int, str], list[str]] = field(default_factory=dict)

    def resolve(self, token: str) -> str:
        """A token with stars as the highest scored word that fits; one that fits none stays as it is."""
        if "*" not in token:
            return token
        for word in self.starred.get((len(token), token[0]), ()):
            if all(a in ("*", b) for a, b in zip(token, word)):
                return _repeat.sub(r"\1", word)
        return token

    def of(self, toks: list[str]) -> list[float]:
        get, unseen = self.scores.get, self.unseen
        return [get(self.resolve(t) if "*" in t else t, unseen) for t in toks]

    def evidence(self, best: float, n: int) -> float:
        """-log10 of the chance that a safe text of n tokens has so good a segment."""
        if best <= 0:
            return 0.0
        e = math.log(self.k) + math.log(max(1, n)) - self.lam * best
        p = -math.expm1(-math.exp(min(50.0, e)))
        return 0.0 if p >= 1 else -(math.log10(p) if p > 0 else e / math.log(10))

    def score(self, toks: list[str]) -> tuple[float, list[tuple[int, int, float]]]:
        """(evidence of the best segment, the significant segments)."""
        found = segments(self.of(toks))
        if not found:
            return 0.0, []
        each = [(self.evidence(s, len(toks)), (a, b, s)) for a, b, s in found]
        return max(e for e, _ in each), [x for e, x in each if e >= self.level]


def _calibrate(model: Model, safe: list[list[str]]) -> None:
    # One token of the highest score is always taken to occur in safe texts: without any there would be no law.
    values = np.array([MOST - TOKEN_COST, *(x for t in safe for x in model.of(t)), -TOKEN_COST])
    lo, hi = 1e-3, 20.0
    if values.max() > 0 and values.mean() < 0:
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.exp(mid * values).mean() < 1 else (lo, mid)
    model.lam = max(lo, 0.2)
    best = np.array([max((s for *_, s in segments(model.of(t))), default=0.0) for t in safe] or [0.0])
    n = np.array([max(1, len(t)) for t in safe] or [1])
    # The median text has a chance of one half: ln 2 = K n exp(-L x). Texts that are labelled wrongly don't move it.
    model.k = float(np.clip(np.median(math.log(2) * np.exp(model.lam * best) / n), 1e-4, 10.0))


#: Near copies among the labelled texts are one witness: texts that share TWINS tokens, each in at most one of ONE_IN texts of the corpus, or in RARE.
RARE, ONE_IN, TWINS = 15, 60_000, 2


def witnesses(sample: list[tuple[list[str], bool]], corpus: dict[str, int], total: int = 0) -> tuple[list[list[str]], list[list[str]]]:
    """(unsafe, safe) texts of the sample, one for each group of near copies, labelled as most of the group."""
    posts: dict[str, list[int]] = {}
    rare = max(RARE, total // ONE_IN)
    for i, (t, _) in enumerate(sample):
        for w in set(t):
            if corpus.get(w, 0) <= rare:
                posts.setdefault(w, []).append(i)
    shared = Counter((p[0], x) for p in posts.values() for x in p[1:])
    root = list(range(len(sample)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for (a, b), n in shared.items():
        if n >= TWINS:
            root[find(b)] = find(a)
    groups: dict[int, list[int]] = {}
    for i in range(len(sample)):
        groups.setdefault(find(i), []).append(i)
    unsafe, safe = [], []
    for g in groups.values():
        bad = sum(sample[i][1] for i in g) * 2 > len(g)
        (unsafe if bad else safe).append(sample[next(i for i in g if sample[i][1] == bad or len(g) == 2 * sum(sample[j][1] for j in g))][0])
    return unsafe, safe


def fit(unsafe: list[list[str]], safe: list[list[str]], corpus: dict[str, int], total: int, flags: dict[str, float], words: dict[str, str]) -> Model:
    """``corpus``: in how many of ``total`` texts each token of the sample is; ``words``: a token's usual spelling."""
    pos, neg = [set(t) for t in unsafe], [set(t) for t in safe]
    model = Model()
    for _ in range(ROUNDS):
        p, n = Counter(w for t in pos for w in t), Counter(w for t in neg for w in t)
        np_, nn = len(unsafe) + 1, len(safe) + len(unsafe) + 1
        model.scores = {}
        for w in {*p, *n, *flags}:
            if _long_number.search(w):
                continue
            a = PRIOR * max(corpus.get(w, 0), 1) / max(total, 1)
            x = p[w] + flags.get(w, 0.0)
            odds = math.log((x + a) / (np_ + PRIOR - x)) - math.log((n[w] + a + UNMET) / (nn + PRIOR - n[w]))
            # A token that is met once proves little.
            odds *= (x + n[w]) / (x + n[w] + 1.0)
            if _han.fullmatch(w):
                odds /= 2  # each character is in two tokens
            most = MOST if x >= 2 or w in flags else 0.0
            model.scores[w] = min(most, max(LEAST, odds)) - TOKEN_COST
        model.starred = {}
        for w in sorted((w for w, s in model.scores.items() if s > 0.5), key=lambda w: (-model.scores[w], w)):
            full = words.get(w, w)
            model.starred.setdefault((len(full), full[0]), []).append(full)
        _calibrate(model, safe)
        pos = []
        for t in unsafe:
            found = model.score(t)[1]
            pos.append({model.resolve(w) for a, b, _ in found for w in t[a:b]})
        neg = [set(t) for t in safe] + [set(t) - q for t, q in zip(unsafe, pos)]
    _choose_level(model, unsafe, safe)
    return model


def _choose_level(model: Model, unsafe: list[list[str]], safe: list[list[str]]) -> None:
    """The level at which the labels are met best (F1), no laxer than LEVEL."""
    got = sorted([(model.score(t)[0], True) for t in unsafe] + [(model.score(t)[0], False) for t in safe], reverse=True)
    best, hit = (0.0, model.level), 0
    for i, (e, bad) in enumerate(got):
        hit += bad
        if e < -math.log10(LEVEL):
            break
        if i + 1 == len(got) or got[i + 1][0] < e:
            best = max(best, (2 * hit / (i + 1 + len(unsafe)), e))
    model.level = max(model.level, best[1] - 1e-9)


def with_tokens(rows: DataFrame) -> DataFrame:
    """(tab, id, toks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("tab"), b.column("id"), pa.array(map(tokens, b.column("text").to_pylist()), pa.list_(pa.string()))], ["tab", "id", "toks"])

    return rows.select("tab", "id", "text").mapInArrow(run, "tab string, id bigint, toks array<string>")


def labelled(rows: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, most_bytes: int = MAX_BYTES) -> DataFrame:
    """(unsafe, text) of the labelled rows of smallest hash; a row counts as most of its raters say, ties are left out."""
    voted = labels.where("unsafe is not null").groupBy("tab", F.col("row_id").alias("id")).agg(F.avg("unsafe").alias("m")).where("m <> 0.5")
    chosen = voted.orderBy(F.xxhash64("tab", "id"), "tab", "id").limit(bound)
    found = chosen.join(rows, ["tab", "id"]).select("tab", "id", (F.col("m") > 0.5).alias("unsafe"), "text")
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("tab", "id"), "tab", "id"))  # of at most ``bound`` rows (repeated ids aside)
    return found.withColumn("_bytes", so_far).where(F.col("_bytes").isNull() | (F.col("_bytes") <= most_bytes)).select("unsafe", "text")


def train(rows: DataFrame, labels: DataFrame, flag_terms: DataFrame, tokenised: DataFrame, bound: int = MAX_LABELLED) -> Model:
    spark = rows.sparkSession
    sample = labelled(rows, labels, bound).toPandas().drop_duplicates()
    seen: set[tuple[str, bool]] = set()
    distinct: list[tuple[list[str], bool]] = []
    for bad, text in zip(sample["unsafe"], sample["text"]):
        mark = (keys.copy_key(text) or "", bool(bad))
        if mark not in seen:  # copies are one witness
            seen.add(mark)
            distinct.append((tokens(text), bool(bad)))
    spelt = Counter(w for t in sample["text"] for w in (keys.word_text(t) or "").split())
    words: dict[str, str] = {}
    for w, _ in spelt.most_common():
        words.setdefault(_repeat.sub(r"\1", w), w)
    flags = {}
    for r in flag_terms.where("term is not null").collect():
        for w in tokens(r.term):
            flags[w] = max(flags.get(w, 0.0), FLAG * float(r.weight or 1))
    vocabulary = {w for t, _ in distinct for w in t} | set(flags)
    # Bounded by the sample: at most the tokens of ``bound`` rows.
    table = spark.createDataFrame([(w,) for w in sorted(vocabulary)] or [("",)], "w string")
    counted = tokenised.select(F.explode(F.array_distinct("toks")).alias("w")).join(F.broadcast(table), "w").groupBy("w").count()
    corpus = {r.w: r["count"] for r in counted.collect()}
    total = tokenised.count()
    return fit(*witnesses(distinct, corpus, total), corpus, total, flags, words)


def _tokenised_and_model(rows: DataFrame, labels: DataFrame, flag_terms: DataFrame, bound: int):
    out = Written(rows.sparkSession, "p6")
    tokenised = out.table(with_tokens(rows), "tokens")
    # Bounded by the sample: at most the tokens of MAX_BYTES of text.
    return tokenised, rows.sparkSession.sparkContext.broadcast(train(rows, labels, flag_terms, tokenised, bound))


def scored(rows: DataFrame, labels: DataFrame, flag_terms: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(tab, id, score, n_segments, unsafe): the evidence of each text's best segment as -log10 of a chance."""
    tokenised, model = _tokenised_and_model(rows, labels, flag_terms, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            got = [m.score(t) for t in b.column("toks").to_pylist()]
            score = pa.array([s for s, _ in got], pa.float64())
            n = pa.array([len(x) for _, x in got], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("tab"), b.column("id"), score, n, pa.array([bool(x) for _, x in got], pa.bool_())], ["tab", "id", "score", "n_segments", "unsafe"])

    return tokenised.mapInArrow(run, "tab string, id bigint, score double, n_segments int, unsafe boolean")


def passages(rows: DataFrame, labels: DataFrame, flag_terms: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(tab, id, first, last, score, evidence, passage): the significant segments of each text, for review.

    ``first`` and ``last`` count the text's tokens from 0, last exclusive; ``passage`` holds these tokens as they were read, in order.
    Texts without such a segment, null and blank ones included, have no row.
    """
    tokenised, model = _tokenised_and_model(rows, labels, flag_terms, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            found = []
            for i, toks in enumerate(b.column("toks").to_pylist()):
                found.extend((i, x, y, s, m.evidence(s, len(toks)), " ".join(map(m.resolve, toks[x:y]))) for x, y, s in m.score(toks)[1])
            at = pa.array([x[0] for x in found], pa.int32())
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column("tab").take(at), b.column("id").take(at), *(pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds, 1))], ["tab", "id", "first", "last", "score", "evidence", "passage"]
            )

    return tokenised.mapInArrow(run, "tab string, id bigint, first int, last int, score double, evidence double, passage string")


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(all_texts(spark, sf_dir), read(spark, sf_dir, "safety_labels"), read(spark, sf_dir, "flag_terms"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(texts(spark, sf_dir), read(spark, sf_dir, "safety_labels"), read(spark, sf_dir, "flag_terms")).where("unsafe").select("tab", "id")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, source, n, n_unsafe, rate) of each source; a null source is one of its own."""
    prompts = read(spark, sf_dir, "prompts").select(F.lit("prompts").alias("tab"), F.col("prompt_id").alias("id"), "source")
    train_ = read(spark, sf_dir, "train").select(F.lit("train").alias("tab"), F.col("sample_id").alias("id"), "source")
    got = prompts.unionByName(train_).join(p6_found(spark, sf_dir).withColumn("unsafe", F.lit(True)), ["tab", "id"], "left")
    g = got.groupBy("tab", "source").agg(F.count("*").alias("n"), F.count("unsafe").alias("n_unsafe"))
    return g.withColumn("rate", F.col("n_unsafe") / F.col("n"))


def p6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(texts(spark, sf_dir), read(spark, sf_dir, "safety_labels"), read(spark, sf_dir, "flag_terms"))


QUERIES = {"p6_found": p6_found, "p6_scores": p6_scores, "p6_passages": p6_passages, "p6_rates": p6_rates}
