"""French Snowball stemmer (public algorithm description), after removal of the plural. Applied to any language."""

from __future__ import annotations

import functools

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = frozenset("aeiouyâàëéêèïîôûù")

# Fixed values of the published algorithm: suffixes by what happens to them.
_STANDARD = {
    "drop in r2": ["ance", "iqUe", "isme", "able", "iste", "eux", "ances", "iqUes", "ismes", "ables", "istes"],
    "ation": ["atrice", "ateur", "ation", "atrices", "ateurs", "ations"],
    "log": ["logie", "logies"],
    "u": ["usion", "ution", "usions", "utions"],
    "ent": ["ence", "ences"],
    "ement": ["ement", "ements"],
    "ité": ["ité", "ités"],
    "if": ["if", "ive", "ifs", "ives"],
    "eau": ["eaux"],
    "al": ["aux"],
    "euse": ["euse", "euses"],
    "issement": ["issement", "issements"],
    "amment": ["amment"],
    "emment": ["emment"],
    "ment": ["ment", "ments"],
}
_I_VERB = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais "
    "issait issant issante issantes issants isse issent isses issez issiez issions issons it"
).split()
_VERB = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_VERB_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
_DOUBLES = ("enn", "onn", "ett", "ell", "eill")

_KIND = {suffix: kind for kind, suffixes in _STANDARD.items() for suffix in suffixes}
_VERB_KIND = dict.fromkeys(_VERB, "verb") | dict.fromkeys(_VERB_A, "a") | {"ions": "ions"}


def _longest(word: str, suffixes, start: int = 0) -> str | None:
    """The longest of ``suffixes`` that ends ``word`` and lies after ``start``."""
    for n in range(min(10, len(word) - start), 0, -1):
        if word[-n:] in suffixes:
            return word[-n:]
    return None


class _Word:
    """A word under way: its letters and where its regions begin."""

    def __init__(self, word: str):
        self.text = self._marked(word)
        t, n = self.text, len(self.text)
        if n >= 3 and t[0] in VOWELS and t[1] in VOWELS or t[:3] in ("par", "col", "tap"):
            self.rv = 3
        else:
            self.rv = next((i + 1 for i in range(1, n) if t[i] in VOWELS), n)
        self.r1 = self._region(0)
        self.r2 = self._region(self.r1)

    @staticmethod
    def _marked(word: str) -> str:
        """u, i and y that stand for consonants in upper case."""
        t, i = list(word), 0
        while i < len(t):
            c, after = t[i], t[i + 1] if i + 1 < len(t) else ""
            if c in VOWELS and after and after in "ui" and i + 2 < len(t) and t[i + 2] in VOWELS:
                t[i + 1] = after.upper()
                i += 3
            elif c in VOWELS and after == "y":
                t[i + 1] = "Y"
                i += 2
            elif c == "y" and after in VOWELS:
                t[i] = "Y"
                i += 2
            elif c == "q" and after == "u":
                t[i + 1] = "U"
                i += 2
            else:
                i += 1
        return "".join(t)

    def _region(self, at: int) -> int:
        t, n = self.text, len(self.text)
        while at < n and t[at] not in VOWELS:
            at += 1
        while at < n and t[at] in VOWELS:
            at += 1
        return min(at + 1, n)

    def swap(self, suffix: str, new: str, least: int) -> bool:
        """Replace the suffix if the word ends in it and it lies in the region that begins at ``least``."""
        if self.text.endswith(suffix) and len(self.text) - len(suffix) >= least:
            self.text = self.text[: len(self.text) - len(suffix)] + new
            return True
        return False

    def standard(self) -> bool:
        suffix = _longest(self.text, _KIND)
        if suffix is None:
            return False
        kind, r1, r2, rv = _KIND[suffix], self.r1, self.r2, self.rv
        before = self.text[: len(self.text) - len(suffix)]
        vowel = before[-1:] in VOWELS and before != ""
        if kind == "drop in r2":
            return self.swap(suffix, "", r2)
        if kind == "ation":
            if not self.swap(suffix, "", r2):
                return False
            self.swap("ic", "", r2) or self.swap("ic", "iqU", 0)
            return True
        if kind in ("log", "u", "ent"):
            return self.swap(suffix, kind, r2)
        if kind == "ement":
            if not self.swap(suffix, "", rv):
                return False
            inner = _longest(self.text, ("iv", "eus", "abl", "iqU", "ièr", "Ièr"))
            if inner == "iv":
                if self.swap("iv", "", r2):
                    self.swap("at", "", r2)
            elif inner == "eus":
                self.swap("eus", "", r2) or self.swap("eus", "eux", r1)
            elif inner in ("abl", "iqU"):
                self.swap(inner, "", r2)
            elif inner:
                self.swap(inner, "i", rv)
            return True
        if kind == "ité":
            if not self.swap(suffix, "", r2):
                return False
            for inner, other in (("abil", "abl"), ("ic", "iqU"), ("iv", "iv")):
                if self.text.endswith(inner):
                    self.swap(inner, "", r2) or self.swap(inner, other, 0)
                    break
            return True
        if kind == "if":
            if not self.swap(suffix, "", r2):
                return False
            if self.swap("at", "", r2):
                self.swap("ic", "", r2) or self.swap("ic", "iqU", 0)
            return True
        if kind == "eau":
            return self.swap(suffix, "eau", 0)
        if kind == "al":
            return self.swap(suffix, "al", r1)
        if kind == "euse":
            return self.swap(suffix, "", r2) or self.swap(suffix, "eux", r1)
        if kind == "issement":
            return before != "" and not vowel and self.swap(suffix, "", r1)
        if kind in ("amment", "emment"):
            self.swap(suffix, kind[0] + "nt", rv)
            return False
        if vowel and len(before) - 1 >= rv:
            self.swap(suffix, "", 0)
        return False

    def i_verb(self) -> bool:
        suffix = _longest(self.text, _I_VERB, self.rv)
        at = len(self.text) - len(suffix) - 1 if suffix else -1
        return suffix is not None and at >= self.rv and self.text[at] not in VOWELS and self.swap(suffix, "", 0)

    def verb(self) -> bool:
        suffix = _longest(self.text, _VERB_KIND, self.rv)
        if suffix is None:
            return False
        if _VERB_KIND[suffix] == "ions":
            return self.swap(suffix, "", self.r2)
        self.swap(suffix, "", 0)
        if _VERB_KIND[suffix] == "a":
            self.swap("e", "", self.rv)
        return True

    def residual(self) -> None:
        if len(self.text) > 1 and self.text[-1] == "s" and self.text[-2] not in "aiouès":
            self.text = self.text[:-1]
        suffix = _longest(self.text, ("ion", "ier", "ière", "Ier", "Ière", "e", "ë"), self.rv)
        at = len(self.text) - len(suffix) if suffix else 0
        if suffix == "ion":
            if self.text[at - 1] in "st" and at - 1 >= self.rv:
                self.swap(suffix, "", self.r2)
        elif suffix == "e":
            self.swap(suffix, "", 0)
        elif suffix == "ë":
            if self.text[max(at - 2, 0) : at] == "gu" and at - 2 >= self.rv:
                self.swap(suffix, "", 0)
        elif suffix:
            self.swap(suffix, "i", 0)

    def finish(self) -> str:
        if self.text.endswith(_DOUBLES):
            self.text = self.text[:-1]
        t = self.text
        last = max((i for i, c in enumerate(t) if c in VOWELS), default=-1)
        if last >= 0 and last < len(t) - 1 and t[last] in "éè":
            t = t[:last] + "e" + t[last + 1 :]
        return t.replace("I", "i").replace("U", "u").replace("Y", "y")


@lru_cache(100_000)
def snowball(word: str) -> str:
    w = _Word(word)
    if w.standard() or w.i_verb() or w.verb():
        w.swap("Y", "i", 0) or w.swap("ç", "c", 0)
    else:
        w.residual()
    return w.finish()


def singular(word: str) -> str:
    """Words of more than three characters lose one final s, or else one final x."""
    return word[:-1] if len(word) > 3 and word[-1] in "sx" else word


@functools.lru_cache(1 << 17)
def stem(word: str) -> str:
    return snowball(singular(word))


@F.pandas_udf(T.StringType())
def stem_column(words: pd.Series) -> pd.Series:
    """Stems of lower-case words. Each different word of a batch is looked up once, and frequent ones are remembered."""
    codes, different = pd.factorize(words)
    stems = pd.Series([*map(stem, different), None], dtype=object)
    return stems.take(codes).reset_index(drop=True)  # a null has code -1
