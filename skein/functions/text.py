"""String functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.split() takes for white space, in the syntax that Java and RE2 share.
BLANKS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
# Words that name no subject.
STOP_WORDS = "a an the of in on at by to and or with for from into over under near this that there is are be as its their his her no one some two".split()
LOOK_WORDS = "photo picture image portrait painting drawing view shot scene style close".split()


def normalise(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def fold_key(c: Column) -> Column:
    return F.lower(normalise(c))


def clean_brackets(c: Column) -> Column:
    return normalise(F.regexp_replace(c, r"[()\[\]]", ""))


def subject(c: Column) -> Column:
    """The first word of three letters or more that is no stop word, else 'subject'."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z'-]*)"), F.lit(1))
    skip = F.array(*map(F.lit, STOP_WORDS + LOOK_WORDS))
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(skip, w))
    return F.coalesce(F.get(kept, F.lit(0)), F.lit("subject"))


def first_words(c: Column, k: Column) -> Column:
    return F.array_join(F.slice(F.split(c, " "), F.lit(1), F.greatest(k, F.lit(2))), " ")


def safe_name(c: Column) -> Column:
    return F.right(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), F.lit(80))


def preview(c: Column, n: int = 60) -> Column:
    return F.left(F.regexp_replace(c, "\n", " "), F.lit(n))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def human_bytes(c: Column) -> Column:
    out = F.concat(F.format_string("%d", c.cast("bigint")), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        size = 1024.0**power
        out = F.when(c >= size, F.concat(F.round(c / size, 1).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def human_duration(c: Column) -> Column:
    """Seconds as "1h 02m", "3m 04s" or "5s"; null, NaN and negative ones as a dash."""
    s = F.floor(c).cast("bigint")
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    return (
        F.when(c.isNull() | F.isnan(c.cast("double")) | (c < 0), "—")
        .when(s >= 3600, F.concat((s / 3600).cast("bigint").cast("string"), F.lit("h "), two((s % 3600) / 60), F.lit("m")))
        .when(s >= 60, F.concat((s / 60).cast("bigint").cast("string"), F.lit("m "), two(s % 60), F.lit("s")))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )


def parse_steps(c: Column) -> Column:
    """'12k', '20,000' and '1_000' as a positive count, else null."""
    plain = F.regexp_replace(F.lower(F.trim(c)), "[,_ ]", "")
    scale = F.when(plain.endswith("k"), 1000.0).when(plain.endswith("m"), 1000000.0).otherwise(1.0)
    n = F.regexp_replace(plain, "[km]$", "").try_cast("double")
    steps = F.floor(n * scale)
    return F.when(steps > 0, steps.cast("bigint"))


def stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def suffix(c: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(c, r"([^/]*)$", 1), r".(\.[^.]*)$", 1))


def parent(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*)/[^/]*$", 1)


def glob_pattern(glob: str) -> str:
    """A shell pattern as an anchored expression; ``*`` also crosses ``/``."""
    out = "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in glob)
    return f"^(?s:{out})$"


def matches_any(c: Column, globs: list[str]) -> Column:
    got = F.lit(False)
    for g in globs:
        got = got | c.rlike(glob_pattern(g))
    return got


def shard_name(split: Column, n: Column) -> Column:
    return F.format_string("%s-%05d", split, n)


def template(c: Column, head: str = "Describe: ", tail: str = "\n", empty: str = "Describe nothing.\n") -> Column:
    return F.when(normalise(F.coalesce(c, F.lit(""))) == "", F.lit(empty)).otherwise(F.concat(F.lit(head), c, F.lit(tail)))


def image_template(c: Column, n_images: Column, slots: int) -> Column:
    """The text after a numbered header and ``slots`` pad marks for each image."""
    heads = F.transform(F.sequence(F.lit(1), F.greatest(n_images, F.lit(1))), lambda i: F.concat(F.lit("Image "), i.cast("string"), F.lit(": "), F.repeat(F.lit("<pad>"), slots), F.lit("\n")))
    return F.concat(F.when(n_images > 0, F.array_join(heads, "")).otherwise(F.lit("")), F.coalesce(c, F.lit("")))


def word_ids(c: Column, vocabulary: int = 32_000, window: int = 64, pad: bool = True) -> Column:
    """Ids of the words by CRC-32, cut to ``window`` - 1, then the end id 1, padded with 0."""
    words = F.filter(F.split(normalise(F.coalesce(c, F.lit(""))), " "), lambda w: w != "")
    ids = F.transform(F.slice(words, 1, window - 1), lambda w: (F.crc32(w) % (vocabulary - 2) + 2).cast("int"))
    ids = F.concat(ids, F.array(F.lit(1)))
    return F.concat(ids, F.array_repeat(F.lit(0), F.lit(window) - F.size(ids))) if pad else ids


def filled(template: str, **values: Column) -> Column:
    """A command or sentence with ``{name}`` replaced by columns; null ones as "<name>"."""
    out = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit(f"<{name}>")))
    return out


def archive_suffix(time: Column) -> Column:
    """A time as the ending of an archived name."""
    return F.date_format(time, "yyyyMMdd-HHmmss")


def epoch_seconds(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp")) / 1e6
