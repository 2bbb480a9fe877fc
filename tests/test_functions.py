import random
import sqlite3
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from folioscan.functions import display, markup, words
from folioscan.functions.stemmer import singular, snowball, stem
from folioscan.operators.search import parse_query, with_passages, worth_searching
from folioscan.sources import names


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first().x


def stems(text):
    return [stem(text[s:e].lower()) for s, e in words.split_words(text) if not words.is_stop_word(text[s:e].lower())]


def test_plural_and_case_give_one_stem():
    assert stems("Les JARDINS de ville") == stems("jardin ville")
    for a, b in (("verger", "vergers"), ("jardin", "jardins"), ("forêt", "forêts")):
        assert stem(a) == stem(b)


def test_raw_snowball():
    assert (snowball("loyer"), snowball("loyers")) == ("loi", "loyer")
    # pairs of the published vocabulary
    known = {
        "continu": "continu", "continua": "continu", "continuait": "continu", "continuant": "continu", "continuation": "continu",
        "continue": "continu", "continué": "continu", "continuel": "continuel", "continuelle": "continuel", "continuellement": "continuel",
        "continuité": "continu", "main": "main", "mains": "main", "maintenaient": "mainten", "maintenant": "mainten", "maintenir": "mainten",
        "majestueusement": "majestu", "majesté": "majest", "majeurs": "majeur", "malheureusement": "malheur",
    }
    assert {w: snowball(w) for w in known} == known


def test_query_drops_fillers():
    q = parse_query("mon jardin de ville de l'an passé")
    assert {"jardin", "ville"} <= set(q.terms) and not {"de", "mon"} & set(q.terms)
    assert parse_query("le la").terms == ("le", "la")  # nothing else is left
    assert parse_query("").terms == ()
    assert worth_searching("ab") and not worth_searching(" a ")


def brute_passage(body, query):
    """By the definition, byte by byte."""
    meant = lambda w: bool(query.folded) and words.fold_text((stem if query.stemmer == "french" else singular)(w.lower())).startswith(query.folded)
    first = next(((s, e) for s, e in words.split_words(body) if meant(body[s:e])), None)
    if first is None:
        return None
    starts = [0]
    for c in body:
        starts.append(starts[-1] + len(c.encode()))
    lo = max(i for i, at in enumerate(starts) if at <= max(0, starts[first[0]] - 90))
    hi = min((i for i, at in enumerate(starts) if at >= starts[first[1]] + 220), default=len(body))
    shown, out, last = regex.sub(r"\p{White_Space}+", " ", body[lo:hi]).strip(" "), "", 0
    for s, e in words.split_words(shown):
        if meant(shown[s:e]):
            out, last = f"{out}{shown[last:s]}\x01{shown[s:e]}\x02", e
    return ("…" if lo else "") + out + shown[last:] + ("…" if hi < len(body) else "")


@pytest.mark.parametrize("stemmer", ["french", "light"])
def test_passages(spark, stemmer):
    rng = random.Random(3)
    parts = ["hélice", "helices", "Alpha", "l'", "  \n", "\u3000", " ", "é", "名前", "𝒳y", "moteurs", "moteur", ". ", "à", "x" * 50, "क", "\u093f"]
    bodies = ["", "rien", "hélice", "Le moteur de l'hélice Alpha est neuf.", "é " * 500 + "Moteurs" + " à" * 500, "a" * 91 + " hélice", "a" * 89 + " hélice " + "b" * 219, "a" * 90 + "é hélice " + "b" * 218 + "é", "x" * 130 + " helice" + "y" * 400]
    bodies += ["".join(rng.choices(parts, weights=[1, 1, 1] + [6] * 14, k=rng.randint(1, 300))) for _ in range(120)]
    texts = spark.createDataFrame([*enumerate(bodies), (-1, None)], "file_id long, body string")
    for text in ("hélice moteurs", "Helices", "zzz", "l'", ""):
        q = parse_query(text, stemmer)
        got = {r.file_id: r.snippet for r in with_passages(texts, q).collect()}
        assert got.pop(-1) is None and got == {i: brute_passage(b, q) for i, b in enumerate(bodies)}
    assert brute_passage(bodies[3], parse_query("helice")) == "Le moteur de l'\x01hélice\x02 Alpha est neuf."


def test_words_are_the_same_in_columns_and_strings(spark):
    text = "क\u093fताब été Ελλάς йод שלום 한국어"
    assert one(spark, words.words(F.col("t")), t=text) == [text[s:e].lower() for s, e in words.split_words(text)] == text.lower().split()
    code = spark.range(0x20, 0x20000).filter("id < 55296 or id >= 57344").select(F.col("id").cast("int"), F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    known = code.filter(F.col("c").rlike(r"^\P{Cn}$")).select("id", F.col("c").rlike(f"^{words.WORD}$").alias("word")).collect()
    other = [r.id for r in known if r.word != bool(words.split_words(chr(r.id)))]
    # Some marks became alphabetic in newer versions of Unicode than that of the Java machine.
    assert len(known) > 80_000 and len(other) < 50 and all(unicodedata.category(chr(i))[0] == "M" for i in other)


def test_index_folding_is_the_tokenizers(spark):
    """All letters, of all scripts, against SQLite's full-text tokenizer."""
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table fts using fts5(t, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    db.execute("create virtual table tokens using fts5vocab(fts, 'instance')")
    letters = [c for c in map(chr, [*range(0xC0, 0xD800), *range(0xE000, 0x1E000)]) if unicodedata.category(c) in ("Ll", "Lu", "Lt", "Lo", "Lm")]
    db.executemany("insert into fts(rowid, t) values (?, ?)", [(i, f"x{c}y") for i, c in enumerate(letters)])
    want = dict(db.execute("select doc, term from tokens order by doc, offset desc"))
    rows = spark.createDataFrame([(i, f"x{c}y") for i, c in enumerate(letters)], "i int, t string").select("i", words.index_fold(F.lower("t")).alias("t")).collect()
    newer = lambda c: unicodedata.category(c) == "Lu" and want[letters.index(c)] == f"x{c}y"  # noqa: E731 - no capital in the tokenizer's Unicode
    other = [(letters[r.i], r.t, want[r.i]) for r in rows if r.t != want[r.i] and unicodedata.category(letters[r.i]) != "Lo"]
    assert [x for x in other if not newer(x[0])] == []
    for c in "άέϊйёїΆЙấłøæß":
        assert words.index_fold_text(f"x{c}y") == want[letters.index(c)]


def test_name_words(spark):
    c = words.name_words(F.col("n"))
    assert one(spark, c, n="Relevé_du-mois 07.bak.pdf") == "relevé du mois 07 bak"
    assert one(spark, c, n=".hidden") == "hidden"


def test_foldings_differ(spark):
    assert one(spark, words.fold(F.col("t")), t="éåœ") == "eåœ"
    assert one(spark, words.index_fold(F.col("t")), t="éåœøύй") == "eaœøύй"


def test_markup(spark):
    xml = "<w:p><w:r><w:t>Loyer &amp; charges</w:t></w:r></w:p><w:p><w:r><w:t>Bail</w:t></w:r></w:p>"
    html = "<html><script>var x=1;</script><body><p>Bonjour &eacute;</p><td>a</td><td>b</td>1 < 2</body></html>"
    for made in (one(spark, markup.xml_text(F.col("t")), t=xml), markup.xml_to_text(xml)):
        assert made == "Loyer & charges\nBail\n"
    for made in (one(spark, markup.html_text(F.col("t")), t=html), markup.html_to_text(html)):
        assert made == "\nBonjour &eacute;\nab1 "
    for text, want in (("&#65;&#x42;&nbsp;&amp;lt;", "AB &lt;"), ("&#38;amp;", "&amp;"), ("&#xD800;", "&#xD800;"), ("a & b;", "a & b;"), ("&lt;&copy;", "<&copy;")):
        assert one(spark, markup.decode_entities(F.col("t")), t=text) == want == markup.decode_text(text)
    assert one(spark, markup.html_text(F.col("t")), t="a<b") == "a" == markup.html_to_text("a<b")
    for t in ("<p>icon \ue000 price 42 euro <b>bold</b>", "\ue001<i \ue000>\ue002a\ue002</i>\ue000c", "\ue000p\ue001 <br>x"):
        assert one(spark, markup.html_text(F.col("t")), t=t) == markup.html_to_text(t)
        assert one(spark, markup.xml_text(F.col("t")), t=t) == markup.xml_to_text(t)
    assert "price 42 euro" in one(spark, markup.html_text(F.col("t")), t="<p>icon \ue000 price 42 euro <b>bold</b>")


def test_secret_names(spark):
    secret = [
        ".env.local", "server.PEM", "credentials.csv", "alice_credentials.csv", "accessKeys.csv", "alice_accessKeys.csv", "rootkey.csv", "Passwords.csv",
        "Chrome Passwords.csv", "logins.csv", "bitwarden_export_20261008.csv", "github-recovery-codes.txt", "Backup-codes-alice.txt",
    ]
    plain = ["environnement.txt", "budget.csv", "password policy.pdf"]
    df = spark.createDataFrame([(n,) for n in secret + plain], ["n"])
    got = [r.x for r in df.select(names.is_secret(F.col("n")).alias("x")).collect()]
    assert got == [True] * len(secret) + [False] * len(plain) == [names.is_secret_name(n) for n in secret + plain]


def test_display(spark):
    size = display.file_size(F.col("s"))
    assert [one(spark, size, s=s) for s in (12, 1024, 1536, 5 * 1024 * 1024 + 1)] == ["12 B", "1 KB", "2 KB", "5.0 MB"]
    parts = one(spark, display.parts(F.col("t")), t="a \x01b\x02 c\x01d")
    assert [(p.text, p.match) for p in parts] == [("a ", False), ("b", True), (" c", False), ("d", False)]
    assert one(spark, display.location(F.col("p"), F.lit("/home/Docs")), p="/home/Docs/a/b/x.txt") == "Docs › a › b"
    assert one(spark, display.date(F.col("m")), m=0) == "" and one(spark, display.date(F.col("m")), m=86400) == "2 Jan 1970"
    assert one(spark, display.bold(F.col("t")), t="\x01b\x02") == "\x1b[1mb\x1b[0m"


def test_status(spark):
    c = names.status(F.col("e"), F.col("s"), F.col("t"))
    cases = [("txt", 1, "a", "ok"), ("txt", 1, " \n", "empty"), ("pdf", 1, None, "unreadable"), ("png", 1, None, "name_only"), ("txt", names.MOST_BYTES + 1, None, "too_large"), ("txt", names.MOST_BYTES, "a", "ok")]
    df = spark.createDataFrame([x[:3] for x in cases], "e string, s long, t string")
    assert [r.x for r in df.select(c.alias("x")).collect()] == [x[3] for x in cases]


def test_pdf_strings():
    from folioscan.sources.pdf import _content_text

    assert _content_text(rb"BT (a (b) c) Tj ET", {}) == "a (b) c\n"
    assert _content_text(rb"(a \( b (c\\) \)) Tj (d) Tj", {}) == "a ( b (c\\) )d"
    assert _content_text(rb"(a) Tj ( (b) Tj [(c) -300 (d)] TJ", {}) == "abc d"
    parts = [f"w{i}" for i in range(5000)]
    assert _content_text(b"[" + b" ".join(b"(%s ) -20" % p.encode() for p in parts) + b"] TJ", {}).split() == parts
    assert _content_text(b"(" * 200_000 + b"(a) Tj", {}) == "a"
