"""Spans against Python's own expressions, on random texts and planted cases."""

import html
import random
import re

from pyspark.sql import functions as F

from versemill.functions import spans as S

ATTRIBUTED = re.compile(S.ATTRIBUTED.removeprefix("(?U)"))
BARE = re.compile(S.BARE)


def kind(quote):
    return "verse" if quote.count(" / ") >= 2 else "prose" if len(quote.split()) >= 25 else "inline"


def plain(text):
    def found(m, author):
        k = kind(m.group(1))
        return m.start(), m.end() + (k != "inline" and text[m.end() : m.end() + 1] in tuple(".,;:!?")), m.group(1), k, author

    first = [found(m, m.group(2)) for m in ATTRIBUTED.finditer(text)]
    return sorted(first + [found(m, None) for m in BARE.finditer(text) if not any(a[0] <= m.start() < a[1] for a in first)], key=lambda s: s[0])


def page(text):
    escape = lambda x: html.escape(x, quote=False).replace('"', "&#34;").replace("'", "&#39;")
    out, at = "", 0
    for start, stop, quote, k, _ in plain(text):
        lines = "<br>\n".join(escape(x.strip(" ")) for x in quote.split(" / "))
        shown = {"verse": f'</p>\n<blockquote class="verse-inset"><p class="verse-lines">{lines}</p></blockquote>\n<p>', "prose": f'</p>\n<blockquote class="prose-inset"><p>{escape(quote)}</p></blockquote>\n<p>', "inline": f'<i class="verse">{escape(quote)}</i>'}[k]
        out, at = out + escape(text[at:start]) + shown, stop
    return out + escape(text[at:])


def test_quotations_and_pages(spark):
    rng = random.Random(1)
    bits = ['"', "“", "”", " — ", "Keats", "A. B", " / ", "words & more", "x", " ", ".", "; ", "<b>", "it's", "\n", "lorem " * 9]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 25))) for _ in range(800)] + ['"a b" — Keats', '"one / two / three", and "abc" or "abcd"', '"' + "w " * 30 + '"?', ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in rows.select("id", S.quotations(F.col("text")).alias("q"), S.rendered(F.col("text")).alias("page")).collect():
        assert sorted(map(tuple, r.q), key=lambda s: s[0]) == plain(texts[r.id]), texts[r.id]
        assert r.page == page(texts[r.id]), texts[r.id]
    nothing = rows.select(S.rendered(F.lit(None).cast("string")).alias("page")).first()
    assert nothing.page is None


def test_clips(spark):
    rows = [
        ("# Heading\n\nSource: https://a.org/x\nSome words here", None, None), ("# Photo\n\nBody", "http://b.org/y", "ann"), ("text", "https://read.amazon.com/kp/1", None), ("w " * 151, "https://www.kindle.amazon.de/1", None),
        ("w " * 151, "https://c.org/p/q", None), ("w " * 151, "https://c.org/p/q", "bob"), ("", None, None), (None, "http://d.org", ""), ("own", None, "self"), ("see Source: https://no.org", None, None),
    ]
    found = [r.c and tuple(r.c) for r in spark.createDataFrame(rows, "t string, u string, a string").coalesce(1).select(S.clip(F.col("t"), F.col("u"), F.col("a")).alias("c")).collect()]
    assert found == [
        ("epigraph", "Some words here", "https://a.org/x", "Heading"), ("epigraph", "Body", "http://b.org/y", "Photo"), ("epigraph", "text", None, None), None,
        ("link", None, "https://c.org/p/q", "c.org"), ("link", None, "https://c.org/p/q", "bob"), None, ("link", None, "http://d.org", "d.org"), None, ("epigraph", "see Source: https://no.org", None, None),
    ]
