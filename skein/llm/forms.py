"""One visible form per text: a compiled longest-match transducer over grapheme clusters.

The mapping is computed once from the Unicode tables (widths, joined letters, composition)
and from the look-alike letters listed below: an image for every single character, in a table by code point, and one for every cluster of a
letter and its marks that has a composed form, in the spellings that lead to it. Both are checked for conflicts: no
character or cluster has two images, and no image is mapped again, so applying the
transducer twice changes nothing. A text is rewritten in one pass, at each place by the longest cluster (a letter
with the marks and invisible characters that follow it) that is in the mapping; marks in stacks that have no composed form keep their canonical order.

Null stays null; a text that shows nothing becomes the empty string.
"""

from __future__ import annotations

import re
import sys
import unicodedata

# Letters of other alphabets with the shape of a Latin letter, as "other latin".
LOOK_ALIKES = """
а a  с c  ԁ d  е e  һ h  і i  ј j  ӏ l  о o  р p  ԛ q  ѕ s  у y  ѵ v  ԝ w  х x  ү y
А A  В B  С C  Е E  Н H  І I  Ӏ I  Ј J  К K  М M  О O  Р P  Ԛ Q  Ѕ S  Т T  У Y  Ү Y  Ѵ V  Ԝ W  Х X
Α A  Β B  Ε E  Ζ Z  Η H  Ι I  Κ K  Μ M  Ν N  Ο O  Ρ P  Τ T  Υ Y  Χ X  Ϲ C  Ϳ J  ϲ c  ϳ j  ο o  ν v
օ o  ս u  ո n  հ h  Օ O  Տ S  Ս U
ɡ g  ᴄ c  ᴏ o  ᴠ v  ᴡ w  ᴢ z  ꜱ s
Ꭺ A  Ᏼ B  Ꮯ C  Ꭼ E  Ꮋ H  Ꭻ J  Ꮶ K  Ꮮ L  Ꮇ M  Ꮲ P  Ꭱ R  Ꮪ S  Ꭲ T  Ꮩ V  Ꮃ W  Ꮓ Z
ꓮ A  ꓐ B  ꓚ C  ꓓ D  ꓰ E  ꓝ F  ꓖ G  ꓧ H  ꓲ I  ꓙ J  ꓗ K  ꓡ L  ꓟ M  ꓠ N  ꓳ O  ꓑ P  ꓣ R  ꓢ S  ꓔ T  ꓴ U  ꓦ V  ꓪ W  ꓫ X  ꓬ Y  ꓜ Z
"""
# Other characters of one shape, as "character image".
SAME_SHAPE = "µ μ"
# Format characters that are drawn, and blank characters Unicode does not call white space.
DRAWN_FORMATS = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
DRAWN_BLANKS = {0x2800, 0x3164, 0xFFA0, 0x115F, 0x1160}
INVISIBLE_MARKS = {0x34F, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
ZWJ = "‍"
SHAPE_TAGS = {"<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>"}


class FormConflict(ValueError):
    """The mapping gives a character two images, or maps its own output again."""


def _look_alikes() -> dict[str, str]:
    parts = f"{LOOK_ALIKES} {SAME_SHAPE}".split()
    out: dict[str, str] = {}
    for a, b in zip(parts[::2], parts[1::2]):
        if out.setdefault(a, b) != b:
            raise FormConflict(f"{a!r} has two images")
    return out


def build_mapping() -> tuple[dict[str, str], set[str], set[str], set[str]]:
    """(images of single characters, blanks, invisible characters, marks), from the Unicode tables."""
    alike = _look_alikes()
    image: dict[str, str] = {}
    blanks, hidden, marks = set(), set(), {"ﾞ", "ﾟ"}
    for cp in (*range(0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        cat = unicodedata.category(c)
        if c.isspace() or cp in DRAWN_BLANKS:
            blanks.add(c)
        elif cp in INVISIBLE_MARKS or cat == "Cc" or (cat == "Cf" and cp not in DRAWN_FORMATS):
            hidden.add(c)
        else:
            if unicodedata.combining(c):
                marks.add(c)
            pair = unicodedata.decomposition(c)
            if pair and pair[0] != "<" and " " in pair:
                marks.add(chr(int(pair.split()[1], 16)))
            flat = _flat(c, alike)
            if flat != c:
                image[c] = flat
    for c, to in image.items():
        again = "".join(image.get(x, x) for x in to)
        if unicodedata.normalize("NFC", again) != to:
            raise FormConflict(f"the image of {c!r} is mapped again")
    return image, blanks, hidden, marks


def build_clusters(image: dict[str, str]) -> dict[str, str]:
    """Images of the clusters that have a composed form: each such form fully decomposed, and with its letter in every spelling."""
    alike = _look_alikes()
    spelt: dict[str, list[str]] = {}
    for c, to in image.items():
        if len(to) == 1:
            spelt.setdefault(to, []).append(c)
    out: dict[str, str] = {}
    for cp in range(0xC0, 0x20000):
        whole = unicodedata.normalize("NFD", chr(cp))
        if len(whole) < 2 or not unicodedata.combining(whole[-1]):
            continue
        letter, marks = whole[0], whole[1:]
        for first in (letter, *spelt.get(letter, ())):
            to = _flat(first + marks, alike)
            if out.setdefault(first + marks, to) != to:
                raise FormConflict(f"{first + marks!r} has two images")
    for cluster, to in out.items():
        if _flat(to, alike) != to or any(x in image for x in to):
            raise FormConflict(f"the image of {cluster!r} is mapped again")
    return out


def _flat(cluster: str, alike: dict[str, str]) -> str:
    """The image of a cluster: widths and joined letters undone, look-alikes replaced, marks composed."""
    out = []
    todo = list(reversed(unicodedata.normalize("NFD", cluster)))
    while todo:
        c = todo.pop()
        if c in alike:
            out.append(alike[c])
            continue
        tag, *to = (unicodedata.decomposition(c) or "-").split()
        if tag[0] == "<" and to:
            letters = [chr(int(x, 16)) for x in to]
            cat = unicodedata.category(c)
            joined = tag == "<compat>" and (
                (len(to) > 1 and cat[0] == "L" and all(unicodedata.category(x)[0] in "LM" for x in letters)) or cat == "Nl" or 0x2F00 <= ord(c) < 0x2FD6
            )
            if (tag in SHAPE_TAGS or joined) and not letters[0].isspace():
                todo.extend(reversed(unicodedata.normalize("NFD", "".join(letters))))
                continue
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def _ranges(chars: set[str]) -> str:
    """The characters as the inside of a regular expression's character class."""
    out, run = [], []
    for cp in [*sorted(map(ord, chars)), sys.maxunicode + 2]:
        if run and cp != run[-1] + 1:
            out.append(re.escape(chr(run[0])) + (f"-{re.escape(chr(run[-1]))}" if len(run) > 1 else ""))
            run = []
        run.append(cp)
    return "".join(out)


class Transducer:
    """Compiled once for each process; ``apply`` gives the visible form of a text."""

    #: Images of clusters without a composed form that were met; the memory is bounded, a full table starts anew.
    KEPT = 1 << 16
    #: Characters of the table; those above (rare Han, tags) are looked up one by one.
    TABLE = 0x20000

    def __init__(self) -> None:
        self.image, blanks, hidden, marks = build_mapping()
        self._alike = _look_alikes()
        self.clusters = build_clusters(self.image)
        ws, inv, mk = _ranges(blanks), _ranges(hidden), _ranges(marks)
        jamo = "ᄀ-하-ᅵᆨ-ᇂ"
        emoji = "©®‼⁉™ℹ←-⇿⌀-⏿①-⓿■-➿⤀-⥿⬀-⯿〰〽㊗㊙\U0001f000-\U0001faff"
        tone = "︎️\U0001f3fb-\U0001f3ff"
        self._hidden = dict.fromkeys(map(ord, hidden))
        self._cluster = re.compile(
            f"[{emoji}][{tone}]*(?:{ZWJ}[{emoji}][{tone}]*)+"  # joined emoji keep their joiners
            f"|(?:[^{ws}{inv}{mk}][{inv}]*)?[{mk}](?:[{inv}]*[{mk}])*"
            f"|[{jamo}]{{2,}}"
        )
        # Most texts hold no cluster of several characters: their one pass is a table lookup for each character.
        self._several = {*marks, ZWJ, *map(chr, range(0x1100, 0x1113)), *map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A8, 0x11C3))}
        single = {**self.image, **dict.fromkeys(hidden, ""), **dict.fromkeys(blanks, " ")}
        self._table = [single.get(c, c) for c in map(chr, range(self.TABLE))]
        self._rare = {c: to for c, to in single.items() if ord(c) >= self.TABLE}
        self._above = re.compile(f"[{chr(self.TABLE)}-\U0010ffff]")
        self._ascii = re.compile("[\x00-\x08\x0e-\x1b\x7f]")
        self._known: dict[str, str] = dict(self.clusters)

    def _image_of(self, cluster: str) -> str:
        got = self._known.get(cluster)
        if got is None:
            if ZWJ in cluster and self._joined(cluster):
                got = cluster.replace("\ufe0f", "").replace("\ufe0e", "")
            else:
                got = _flat(cluster.translate(self._hidden), self._alike)
            if len(self._known) >= self.KEPT:
                self._known = dict(self.clusters)
            self._known[cluster] = got
        return got

    @staticmethod
    def _joined(cluster: str) -> bool:
        parts = cluster.split(ZWJ)
        return len(parts) > 1 and all(p and unicodedata.category(p[0]) in ("So", "Sm", "Po", "Sk") for p in parts)

    def _singles(self, text: str) -> str:
        text = text.translate(self._table)
        for c in self._rare.keys() & set(text) if self._above.search(text) else ():
            text = text.replace(c, self._rare[c])
        return text

    def apply(self, text: str | None) -> str | None:
        if text is None:
            return None
        if text.isascii():
            return " ".join(self._ascii.sub("", text).split())
        if self._several.isdisjoint(text):
            return " ".join(self._singles(text).split())
        out, at = [], 0
        for m in self._cluster.finditer(text):
            if m.start() > at:
                out.append(self._singles(text[at : m.start()]))
            out.append(self._image_of(m.group()))
            at = m.end()
        out.append(self._singles(text[at:]))
        return " ".join("".join(out).split())


_shared: Transducer | None = None


def visible_form(text: str | None) -> str | None:
    """The form in which texts that look the same are equal. Null gives null, nothing visible gives ''."""
    global _shared
    if _shared is None:
        _shared = Transducer()
    return _shared.apply(text)
