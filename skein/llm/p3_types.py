"""Problem 3: text statistics, and text types by weak supervision.

Each statistic with a threshold is a noisy labelling function: it votes for one type or abstains. The
functions' rates of voting under each type, and the shares of the types, are learned by expectation
maximisation from how often the votes agree over all texts (counts of vote patterns, at most
2**len(FUNCTIONS) of them). A text's type is the one of highest posterior probability.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import forms
from skein.llm.keys import HAN_KANA, MARKS
from skein.llm.records import all_texts, read, texts
from skein.session import Written

TYPES = ("prose", "list", "table", "junk")
STATS = (
    "n_chars", "n_lines", "n_words", "mean_word_len", "symbol_ratio", "digit_ratio", "end_punct_share", "common_share", "marker_share", "marker_chars", "short_share",
    "cell_share", "n_cells", "number_share", "top_word_share", "markup_share", "mojibake_share", "code_word_share", "mash_share", "long_word_share", "labelled",
)

_marker = re.compile(r"^\s*(?:[-*•‣◦·–—+o✓☐]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\[[ xX]?\])\s+\S")
#: Characters that the cells of a table have on average, at most.
MOST_CELL = 30
_word = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)*")
_number = re.compile(r"^[+-]?\d+(?:[.,]\d+)*%?$")
_markup = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|&[a-z]{2,8};|&#\d+;|\{\{|\}\}|\[/?[a-z]+(?:=[^\]]*)?\]")
_mojibake = re.compile(r"[ÃÂÅÐÑ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œž¡-¿]|â€.?|ï»¿|�")
_code = re.compile(r"^(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{6,64}$")
_coded = re.compile(r"^(?=.*[a-z])(?=.*[A-Z])(?=(?:[^0-9]*[0-9]){2})[A-Za-z0-9+/]+={0,2}$")
_label = re.compile(r"^\s*[\"'{]*[^\W\d_][\w ]{0,24}[\"']?\s*[:=]\s*\S")
_blanks = re.compile(r"(\s+)")
_rule = re.compile(r"^[\s|:+=_-]+$")
_han = re.compile(f"[{HAN_KANA}]")
_han_run = re.compile(f"[{HAN_KANA}ー]+")
_vowel = re.compile(r"[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿ]")
_latin = re.compile(r"^[a-zß-ÿ']+$")
_cells = (re.compile(r"\t"), re.compile(r"\s*\|\s*"), re.compile(r";"), re.compile(r"\s{2,}"), re.compile(r",(?=\S)"))


def _with_blanks(line: str) -> str:
    """The visible form of a line with its tabs and runs of blanks, which part the cells of a table; a wide blank counts as two."""
    if line.isascii():
        return line
    return "".join(x.replace("\u3000", "  ") if x.isspace() else forms.visible_form(x) or "" for x in _blanks.split(line))


@lru_cache(maxsize=4)
def _han_words(common: frozenset[str]) -> tuple[str, ...]:
    """The common words in Han or kana, which stand in a text without blanks around."""
    return tuple(sorted(w for w in common if _han.search(w)))


def _columns(raw: list[str]) -> tuple[float, int]:
    """(share of lines that have the same number of cells, that number), for the separator that fits best."""
    best = (0.0, 0)
    if len(raw) < 3:
        return best
    for sep in _cells:
        split = [sep.split(x.strip("| \r")) for x in raw]
        counts = Counter(map(len, split))
        if sum(map(len, raw)) > MOST_CELL * sum(map(len, split)):
            continue
        cells, n = max(counts.items(), key=lambda x: (x[1] * (x[0] > 1), x[0]))
        if cells > 1 and n / len(raw) > best[0]:
            best = (n / len(raw), cells)
    return best


def statistics(text: str | None, common: frozenset[str] | set[str]) -> list[float]:
    """The STATS of a text, in order. Null and blank texts have zeros."""
    common = frozenset(common)
    raw = [x for x in (text or "").splitlines() if x.strip()]
    lines = [y for x in raw if (y := forms.visible_form(x))]
    if not lines:
        return [0.0] * len(STATS)
    one = " ".join(lines)
    n = len(one)
    letters = sum(map(str.isalpha, one))
    digits = sum(map(str.isdigit, one))
    marks = sum(map(MARKS.__contains__, one)) if not one.isascii() else 0
    blanks = one.count(" ")
    words = _word.findall(one)
    low = [w.lower() for w in words]
    tokens = one.split()
    han = bool(_han.search(one))
    many = len(lines) > 2
    marked = [x for x in lines if _marker.match(x)]
    rows = [y for x in raw if not _rule.match(y := _with_blanks(x))] if many else []
    share, cells = _columns(rows)
    parts = [c for x in rows for c in re.split(r"[\t|;,=]|\s{2,}", x) if c.strip()] if share > 0.5 else []
    latin = [w for w in re.findall(r"[^\s.,!?():\"\[\]{}]+", one.lower()) if len(w) > 2] if not han else []
    mash = sum(1 for w in latin if ";" in w[:-1] or w[0] in "';" or (_latin.match(w) and len(_vowel.findall(w)) * 4 < len(w)))
    counts = Counter(low)
    top = counts.most_common(1)[0][1] if low else 0
    per_line = [len(x.split()) for x in lines]
    return [
        n, len(lines), len(words), sum(map(len, words)) / max(1, len(words)),
        (n - letters - digits - marks - blanks) / n, digits / n,
        sum(x[-1] in ",.!?…。！？।؟;:»”」\"" for x in lines) / len(lines),
        sum(w in common for w in low) / max(1, len(low)) if not han else sum(map(one.count, _han_words(common))) / n,
        len(marked) / len(lines), sum(map(len, marked)) / n,
        sum(k <= 7 for k in per_line) / len(lines) if many else 0.0,
        share, cells, sum(bool(_number.match(c.strip())) for c in parts) / max(1, len(parts)),
        top / len(low) if len(low) > 5 else 0.0,
        sum(m.end() - m.start() for m in _markup.finditer(one)) / n,
        2 * len(_mojibake.findall(one)) / max(1, len(tokens)),
        sum(bool(_code.match(w)) for w in tokens) / len(tokens),
        mash / max(1, len(latin)),
        sum(len(w) for w in tokens if len(w) > 30 and _coded.match(w)) / n,
        float(sum(bool(_label.match(x)) for x in lines) / len(lines) > 0.7 and (share < 0.8 or cells < 3)),
    ]


# A labelling function: the type it votes for, and the condition on the statistics (s) under which it does.
FUNCTIONS = (
    ("list", lambda s: s["marker_share"] >= 0.6 and s["marker_chars"] >= 0.5 and s["n_lines"] >= 3),
    ("list", lambda s: s["marker_share"] >= 0.75 and s["marker_chars"] >= 0.5 and s["n_lines"] >= 2),
    ("list", lambda s: s["n_lines"] >= 4 and s["short_share"] >= 0.85 and s["symbol_ratio"] < 0.35 and s["cell_share"] < 0.7 and not s["labelled"] and s["end_punct_share"] < 0.4),
    ("table", lambda s: s["n_lines"] >= 3 and s["cell_share"] >= 0.75 and s["n_cells"] >= 3),
    ("table", lambda s: s["n_lines"] >= 3 and s["cell_share"] >= 0.75 and s["number_share"] >= 0.15),
    ("table", lambda s: s["n_lines"] >= 3 and s["cell_share"] >= 0.9 and s["end_punct_share"] < 0.5 and s["marker_share"] < 0.5),
    ("table", lambda s: s["n_lines"] >= 4 and s["cell_share"] >= 0.6 and s["n_cells"] >= 3 and s["end_punct_share"] < 0.4 and s["marker_share"] < 0.5),
    ("junk", lambda s: s["symbol_ratio"] >= 0.35),
    ("junk", lambda s: s["top_word_share"] >= 0.5),
    ("junk", lambda s: s["markup_share"] >= 0.3),
    ("junk", lambda s: s["mojibake_share"] >= 0.4),
    ("junk", lambda s: s["code_word_share"] >= 0.5 and s["n_words"] >= 2),
    ("junk", lambda s: s["mash_share"] >= 0.4 and s["n_words"] >= 4),
    ("junk", lambda s: s["long_word_share"] >= 0.5),
    ("prose", lambda s: s["common_share"] >= 0.05 and s["symbol_ratio"] < 0.3 and s["mash_share"] < 0.4 and s["mojibake_share"] < 0.2 and s["marker_chars"] < 0.5 and s["cell_share"] < 0.75),
    ("prose", lambda s: s["n_lines"] <= 2 and s["symbol_ratio"] < 0.3 and s["markup_share"] < 0.1 and s["top_word_share"] < 0.3 and s["code_word_share"] < 0.3 and s["mash_share"] < 0.4 and s["mojibake_share"] < 0.2 and s["long_word_share"] < 0.3),
    ("prose", lambda s: bool(s["labelled"])),
    ("prose", lambda s: 0 < s["marker_chars"] < 0.4 and s["cell_share"] < 0.6 and s["symbol_ratio"] < 0.2),
    ("prose", lambda s: s["n_lines"] >= 1 and s["end_punct_share"] >= 0.6 and s["marker_share"] < 0.4 and s["symbol_ratio"] < 0.2 and s["mash_share"] < 0.4),
)


def votes(stats: list[float]) -> int:
    """The votes of all functions as bits."""
    s = dict(zip(STATS, stats))
    return sum(1 << i for i, (_, rule) in enumerate(FUNCTIONS) if rule(s))


#: Votes of the prior, as a part of all texts: as many as a rare type has, so that no type drifts to another meaning.
PRIOR = 0.03


class TypeModel:
    """Shares of the types and, for each function and type, the probability of a vote."""

    def __init__(self, shares: np.ndarray, rates: np.ndarray) -> None:
        self.shares, self.rates = shares, rates

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        bits = (patterns[:, None] >> np.arange(len(FUNCTIONS))) & 1
        log = np.log(self.shares)[None] + bits @ np.log(self.rates) + (1 - bits) @ np.log(1 - self.rates)
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def learn(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> TypeModel:
    """Expectation maximisation over vote patterns with their counts, from rates that favour a function's own type.

    The rates keep the starting rates as a prior.
    """
    k, f = len(TYPES), len(FUNCTIONS)
    own = np.array([[t == name for t in TYPES] for name, _ in FUNCTIONS])
    start = np.where(own, 0.5, 0.02)
    model = TypeModel(np.array([0.88, 0.04, 0.04, 0.04]), start)
    bits = ((patterns[:, None] >> np.arange(f)) & 1).astype(float)
    prior = PRIOR * max(1.0, counts.sum())
    for _ in range(rounds):
        post = model.posterior(patterns) * counts[:, None]
        of_type = post.sum(axis=0)
        rates = (bits.T @ post + prior * start) / (of_type[None] + prior)
        shares = (of_type + prior * 0.25) / (of_type.sum() + prior * 0.25 * k)
        moved = np.abs(rates - model.rates).max()
        model = TypeModel(shares / shares.sum(), np.clip(rates, 1e-4, 1 - 1e-4))
        if moved < 1e-6:
            break
    return model


def with_statistics(rows: DataFrame, common: frozenset[str]) -> DataFrame:
    """(tab, id, one column for each of STATS, pattern) of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [statistics(x, shared.value) for x in b.column("text").to_pylist()]
            cols = list(zip(*got)) if got else [[]] * len(STATS)
            yield pa.RecordBatch.from_arrays(
                [b.column("tab"), b.column("id"), *(pa.array(map(float, c), pa.float64()) for c in cols), pa.array(map(votes, got), pa.int32())], ["tab", "id", *STATS, "pattern"]
            )

    return rows.select("tab", "id", "text").mapInArrow(run, f"tab string, id bigint, {', '.join(f'{c} double' for c in STATS)}, pattern int")


def typed(rows: DataFrame, common_words: DataFrame) -> DataFrame:
    """The statistics of each row with ``p_<type>`` for each type and ``type``.

    Null and blank texts have zero statistics and type null. ``common_words`` is a fixed small table.
    """
    out = Written(rows.sparkSession, "p3")
    common = frozenset(r.word.lower() for r in common_words.where("word is not null").select("word").distinct().collect())
    stats = out.table(with_statistics(rows, common), "statistics")
    got = stats.where("n_lines > 0").groupBy("pattern").count().toPandas()
    model = learn(got["pattern"].to_numpy(), got["count"].to_numpy().astype(float))
    p = model.posterior(got["pattern"].to_numpy()) if len(got) else np.zeros((0, len(TYPES)))
    # One row a vote pattern: at most 2**len(FUNCTIONS).
    table = rows.sparkSession.createDataFrame([(int(k), *map(float, x), TYPES[int(x.argmax())]) for k, x in zip(got["pattern"], p)], f"pattern int, {', '.join(f'p_{t} double' for t in TYPES)}, type string")
    return stats.join(F.broadcast(table), "pattern", "left").withColumn("type", F.when(F.col("n_lines") > 0, F.col("type"))).drop("pattern")


def p3_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(all_texts(spark, sf_dir), read(spark, sf_dir, "common_words"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(texts(spark, sf_dir), read(spark, sf_dir, "common_words")).where("type in ('list', 'table', 'junk')").select("tab", "id")


QUERIES = {"p3_found": p3_found, "p3_statistics": p3_statistics}
