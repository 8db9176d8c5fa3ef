"""Keys built on the visible form: the word sequence, the copy key and the set of words.

``word_text``: the visible form, case folded, every character that is no letter, mark or digit a blank.
``copy_key``: the same with the fields of labelled prompts and trailing flags in sorted order.
``word_set``: the different words, each Han or kana character a word of its own.
Null gives null (``word_set``: an empty set); a text without letter or digit gives ''.
"""

from __future__ import annotations

import json
import re
import unicodedata

from skein.llm.forms import _ranges, visible_form

# Small letters without a Latin look-alike whose capitals have one, as "small latin":
# after folding the look-alikes, capital and small letter must still be equal.
CAPITAL_TWINS = "в b н h м m к k т t α a β b ε e ζ z η h ι i κ k μ m ρ p τ t υ y χ x"
HAN_KANA = "぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0002fa1f々〆"

_twins = str.maketrans(dict(zip(CAPITAL_TWINS.split()[::2], CAPITAL_TWINS.split()[1::2])))
_twin_letters = re.compile(f"[{''.join(map(chr, _twins))}]")
_ascii = "".join(c if c.isalnum() else " " for c in map(chr, range(128)))
MARKS = {chr(c) for c in (*range(0x20000), *range(0xE0100, 0xE01F0)) if unicodedata.category(chr(c))[0] == "M"}
_between = re.compile(r"[\W_]+")
_between_marked = re.compile(rf"(?:[^\w{_ranges({c for c in MARKS if ord(c) < 0x10000})}]|_)+")
_han = re.compile(f"[{HAN_KANA}]")
_pieces = re.compile(f"[{HAN_KANA}]|[^ {HAN_KANA}]+")
_flags = re.compile(r"(?:\s+--[A-Za-z][\w-]*(?:[ =]+(?!--)[^\s]+)?)+[\s.,;!]*$")
_flag = re.compile(r"\s+--(?=[A-Za-z])")
_label = re.compile(r"(?:^|[\s\"'|;,{(\[])\"?([^\W\d_][\w-]{0,23})\"?\s*[:=](?!//)\s*")


def _folded(form: str) -> str:
    low = form.casefold()
    return low if low.isascii() or not _twin_letters.search(low) else low.translate(_twins)


def _words(form: str) -> str:
    low = _folded(form)
    if low.isascii():
        return " ".join(low.translate(_ascii).split())
    return (_between if MARKS.isdisjoint(low) else _between_marked).sub(" ", low).strip()


def word_text(text: str | None) -> str | None:
    form = visible_form(text)
    return None if form is None else _words(form)


def _fields(body: str) -> list[str] | None:
    """The fields of a labelled prompt as word texts, or None if it isn't one."""
    if body[:1] == "{":
        try:
            got = json.loads(body)
        except ValueError:
            got = None
        if isinstance(got, dict) and len(got) > 1:
            return [_words(f"{k} {v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)}") for k, v in got.items()]
    if ":" not in body and "=" not in body:
        return None
    found = list(_label.finditer(body))
    if len(found) < 2 or _words(body[: found[0].start()]):
        return None
    ends = [m.start() for m in found[1:]] + [len(body)]
    return [_words(f"{m[1]} {body[m.end() : end]}") for m, end in zip(found, ends)]


def keys_of_form(form: str) -> tuple[str, str]:
    """(word text, copy key) of a visible form."""
    seq = _words(form)
    flags: list[str] = []
    body = form
    if "--" in form and (m := _flags.search(form)):
        body = form[: m.start()]
        flags = sorted(_words(x) for x in _flag.split(m.group()) if x.strip())
    fields = _fields(body)
    if fields is None and len(flags) < 2:
        return seq, seq
    parts = sorted(fields) if fields is not None else [_words(body)]
    return seq, " ".join(x for x in (*parts, *flags) if x)


def copy_key(text: str | None) -> str | None:
    form = visible_form(text)
    return None if form is None else keys_of_form(form)[1]


def sequence_of(seq: str) -> list[str]:
    """The words of a word text, in order."""
    return seq.split() if seq.isascii() or not _han.search(seq) else _pieces.findall(seq)


def words_of(seq: str) -> set[str]:
    """The different words of a word text."""
    return set(sequence_of(seq))


def word_set(text: str | None) -> set[str]:
    seq = word_text(text)
    return words_of(seq) if seq else set()


