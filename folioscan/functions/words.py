"""Words, stop words, plural stripping and the two accent foldings, as Column functions and for query strings."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{IsAlphabetic}\p{N}]+"
LONGEST = 40

# Words that carry no meaning, French then English.
STOP_WORDS = tuple(
    """
    le la les un une des du de et ou en au aux ce ces cet cette mon ma mes ton ta tes son sa ses notre nos votre vos
    leur leurs je tu il elle on nous vous ils elles qui que quoi dont où ne pas plus sur sous dans par pour avec sans
    chez est sont été être avoir ai as avons ont se ça cela ceci mais donc car ni si
    the of and to in is for with
    """.split()
)
# Words that are only ignored in queries.
QUERY_STOP_WORDS = tuple(
    "fichier fichiers dossier dossiers document documents cherche chercher trouve trouver retrouve retrouver moi veux besoin".split()
)
# Accented letters that comparison treats as their base letter.
FOLDED = {"a": "àâäáã", "e": "éèêë", "i": "îïí", "o": "ôöóõ", "u": "ùûüú", "c": "ç", "n": "ñ", "y": "ÿ"}
_FROM, _TO = "".join(FOLDED.values()), "".join(k * len(v) for k, v in FOLDED.items())


def words(text: Column) -> Column:
    """Maximal runs of alphabetic and numeric characters, lower-cased after splitting."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def is_stop(word: Column) -> Column:
    return (F.length(word) < 2) | word.isin(*STOP_WORDS)


def is_indexed_word(word: Column) -> Column:
    """Whether a word of a name or text gets a stem in the index."""
    return ~is_stop(word) & (F.length(word) <= LONGEST)


def query_words(text: Column) -> Column:
    """The different words that a query searches for, in order, as ``parse_query`` finds them: no stop words and query
    fillers; if nothing is left, all words of two characters up."""
    every = words(text)
    kept = F.filter(every, lambda w: ~is_stop(w) & ~w.isin(*QUERY_STOP_WORDS))
    return F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(F.filter(every, lambda w: F.length(w) >= 2)))


def light_stem(word: Column) -> Column:
    """Plural stripping: words of more than three characters lose one final s or x."""
    return F.when(F.length(word) > 3, F.regexp_replace(word, "[sx]$", "")).otherwise(word)


def fold(text: Column) -> Column:
    """Accent folding for comparing stems in passages: the letters of FOLDED and no others."""
    return F.translate(text, _FROM, _TO)


def fold_text(text: str) -> str:
    return text.translate(str.maketrans(_FROM, _TO))


@lru_cache(1)
def _latin_folding() -> tuple[str, str]:
    """Latin letters with diacritics and their base letters, as index tokens are folded. Made from the Unicode
    decompositions; a few letters with two marks keep them. Letters with marks of other scripts stay as they are, as the
    tokenizer that these tokens have to agree with leaves them; it only joins variants of Greek letters."""
    keep = set("ǡǣǯǽǿ")
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)[0]
        if c != base and c.lower() not in keep and base.isascii() and base.isalpha() and c == c.lower():
            pairs.append((c, base.lower()))
    # Variants of letters.
    pairs += zip("ſẛςϐϑϕϖϰϱϵ\u1fbe", "ssσβθφπκρει", strict=True)
    # The dot that a lower-cased İ has is dropped: it has no counterpart.
    return "".join(a for a, _ in pairs) + "\u0307", "".join(b for _, b in pairs)


def index_fold(token: Column) -> Column:
    """Folding of lower-case tokens when they are indexed and looked up. Wider than ``fold``."""
    source, target = _latin_folding()
    return F.translate(token, source, target)


def index_fold_text(token: str) -> str:
    source, target = _latin_folding()
    return token.lower().translate(str.maketrans(source[: len(target)], target, source[len(target) :]))


def name_stem(name: Column) -> Column:
    """A file name without its extension; a leading dot begins no extension."""
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")


def name_words(name: Column) -> Column:
    """The words of a file name without its extension, lower-cased and joined by spaces."""
    return F.array_join(words(name_stem(name)), " ")


_PY_WORD = regex.compile(r"[\p{Alphabetic}\p{N}]+")


def split_words(text: str) -> list[tuple[int, int]]:
    """Start and end of each word of a Python string, as ``words`` finds them."""
    return [m.span() for m in _PY_WORD.finditer(text)]


def is_stop_word(word: str) -> bool:
    return len(word) < 2 or word in STOP_WORDS
