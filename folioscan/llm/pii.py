"""Personal data: patterns propose spans, checksums and limits confirm them, words nearby adjust their score.

Base kinds stay whatever their score. Of the kinds that the method adds, those with a strong form (known account numbers,
access keys) reach the least score by themselves; the weak ones (bare national numbers, short card numbers, tax numbers,
values that look like credentials, account numbers of other countries) need a word of their context nearby.

DataFrame functions only. The patterns below find the same leftmost matches as their plain forms; look-behinds and
possessive quantifiers keep them linear on long runs and free of recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, others

_LOCAL = "A-Za-z0-9._%+-"
#: Base kinds in their order, then those that the method adds.
BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "account", "access_key", "credential", "local_phone", "short_card", "tax_number")
#: Length of account numbers by country; numbers of other countries end at the last group that could belong to them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS", 23: "AE|GI|IL",
    24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "PT", 26: "IS|TR", 27: "FR|GR|IT|MC|SM", 28: "AL|AZ|CY|DO|GT|HU|LB|PL", 29: "BR|PS|QA", 30: "JO|KW|MU", 31: "MT",
}


_START, _STOP = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
_TOKEN = "A-Za-z0-9+/_-"


def _iban() -> str:
    def rest(n: int) -> str:
        return rf"(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")

    return rf"{_START}(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(rf'(?:{c})[0-9]{{2}}{rest(n)}' for n, c in IBAN_LENGTHS.items())}){_STOP}"


PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban(),
    "account": rf"{_START}(?!{'|'.join(IBAN_LENGTHS.values())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}+(?:\x20?[A-Z0-9]{{1,3}})?+{_STOP}",
    "access_key": rf"{_START}A(?:KIA|SIA)[0-9A-Z]{{16}}{_STOP}",
    "credential": rf"(?<![{_TOKEN}])(?=[A-Za-z+/_-]{{0,64}}[0-9])(?=[0-9+/_-]{{0,64}}[A-Za-z])[{_TOKEN}]{{12,}}+",
    "local_phone": rf"{_START}(?<![0-9+][\x20().-])(?<![+])\(?0[0-9](?:[\x20()./-]{{0,2}}[0-9]){{7,11}}+(?![\x20().-]?[A-Za-z0-9])",
    "short_card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])",
    "tax_number": rf"{_START}(?<![0-9]-)[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?!-?[A-Za-z0-9])",
}
#: A text without this character has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "tax_number": "-"}
#: Words that make a kind likelier when they stand close before or after a span.
CONTEXT = {
    "email": r"mail|contact|write|reply|correo|courriel",
    "ip": r"\bip\b|address|host|server|adresse|servidor",
    "card": r"card|visa|credit|carte|karte|tarjeta|pay",
    "phone": r"phone|call|mobile|fax|\btel|t[eé]l[eé]f|anruf",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "account": r"iban|bank|account|konto|compte|cuenta",
    "access_key": r"key|access|secret|token",
    "credential": r"(?:password|passwd|pwd|passphrase|token|secret|api[_ -]?key)[\x22']?\s*[=:]",
    "local_phone": r"phone|call|mobile|fax|\btel|t[eé]l[eé]f|t[eé]l\b|anruf",
    "short_card": r"card|visa|credit|carte|karte|tarjeta|amex|diners",
    "tax_number": r"\bssn\b|social security|\btax\b|taxpayer",
}
#: Score of a confirmed span, of one of a weak kind, what a context word adds, and the least score of a span that the
#: method adds.
CONFIRMED, POSSIBLE, NEARBY, LEAST = 0.7, 0.5, 0.2, 0.7
WEAK = ("account", "credential", "local_phone", "short_card", "tax_number")
BEFORE, AFTER = 48, 24


def running_ends(lengths: Column) -> Column:
    """Prefix sums of an array, in chunks, so that long arrays are not copied once for each item."""
    array = "cast(array() as array<bigint>)"
    return F.call_function(
        "flatten",
        F.aggregate(
            F.sequence(F.lit(0), F.greatest(F.floor((F.size(lengths) - 1) / 256), F.lit(0)).cast("int")),
            F.expr("named_struct('at', 0L, 'done', cast(array() as array<array<bigint>>))"),
            lambda acc, k: F.element_at(
                F.transform(
                    F.array(
                        F.aggregate(
                            F.slice(lengths, k * 256 + 1, F.lit(256)),
                            F.struct(acc["at"].alias("at"), F.expr(array).alias("ends")),
                            lambda b, n: F.struct((b["at"] + n).alias("at"), F.concat(b["ends"], F.array(b["at"] + n)).alias("ends")),
                        )
                    ),
                    lambda inner: F.struct(inner["at"].alias("at"), F.concat(acc["done"], F.array(inner["ends"])).alias("done")),
                ),
                1,
            ),
            lambda acc: acc["done"],
        ),
    )


def _mod97(iban: Column) -> Column:
    """Remainder of the number that the account number stands for, its first four characters moved to the end."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    digit = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(digit(c) > 9, 100).otherwise(10) + digit(c)) % 97))


def _confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(
            F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
        )
    if kind in ("card", "short_card"):
        return F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind in ("iban", "account"):
        return _mod97(match) == 1
    if kind == "local_phone":
        return F.length(digits).between(9, 12)
    if kind == "tax_number":
        return ~match.rlike(r"^(?:000|666|9[0-9]{2})|-00-|-0000$")
    return F.lit(True)


def find_personal_data(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: array of (kind, start, end, score), by kind in the order of BASE and ADDED, then start.

    Positions are code points, the end exclusive. Spans of one kind never overlap (the leftmost counts), spans of
    different kinds may. Matches that fail their check are dropped and not tried again. The score is CONFIRMED, or POSSIBLE
    for WEAK kinds, and NEARBY more if a word of the kind's CONTEXT stands within BEFORE or AFTER characters. Base kinds
    stay whatever their score; added kinds need LEAST. A null or empty text has none. Rows are independent, an empty
    table gives an empty result; a column called like ``out`` is replaced, all others pass through.
    """
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    kinds = (*BASE, *ADDED)
    none = F.expr("cast(array() as array<string>)")
    names = iter(fresh(docs.columns, *[f"__{part}_{k}" for part in "mgle" for k in kinds]))
    m, g, l, e = ({k: next(names) for k in kinds} for _ in range(4))  # matches, gaps between them, lengths of both, ends
    found = docs.withColumns({m[k]: F.when(body.contains(NEEDS[k]) if k in NEEDS else F.lit(True), F.regexp_extract_all(body, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in kinds})
    found = found.withColumns({g[k]: F.when(F.size(m[k]) > 0, F.split(body, PATTERNS[k], -1)) for k in kinds})
    found = found.withColumns({l[k]: F.when(F.size(m[k]) > 0, F.zip_with(F.slice(g[k], 1, F.size(m[k])), m[k], lambda x, y: (F.length(x) + F.length(y)).cast("long"))) for k in kinds})
    found = found.withColumns({e[k]: F.when(F.size(m[k]) > 0, running_ends(F.col(l[k]))) for k in kinds})

    def spans(kind: str) -> Column:
        matches, gaps, ends = F.col(m[kind]), F.col(g[kind]), F.col(e[kind])

        def one(match: Column, i: Column) -> Column:
            near = F.concat_ws(" ", F.right(F.get(gaps, i), F.lit(BEFORE)), F.left(F.get(gaps, i + 1), F.lit(AFTER)))
            score = F.lit(POSSIBLE if kind in WEAK else CONFIRMED) + F.when(F.lower(near).rlike(CONTEXT[kind]), F.lit(NEARBY)).otherwise(F.lit(0.0))
            return F.struct(F.lit(kind).alias("kind"), (F.get(ends, i) - F.length(match)).alias("start"), F.get(ends, i).alias("end"), F.when(_confirmed(kind, match), F.round(score, 2)).alias("score"))

        made = F.filter(F.transform(matches, one), lambda s: s["score"].isNotNull() & ((s["score"] >= LEAST) | s["kind"].isin(*BASE)))
        return F.when(F.size(matches) > 0, made).otherwise(F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,score:double>>)"))

    return found.select(*map(col, others(docs.columns, out)), F.concat(*[spans(k) for k in kinds]).alias(out))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
