r"""String functions on columns: slugs, cleaning, titles, roman numerals, markup. All stay in the JVM.

Patterns are Java's; where letters beyond ASCII count, ``(?U)`` makes ``\w`` and ``\s`` cover them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The numerals that make up roman numbers, in falling order.
NUMERALS = (("M", 1000), ("CM", 900), ("D", 500), ("CD", 400), ("C", 100), ("XC", 90), ("L", 50), ("XL", 40), ("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1))
# Words that stay lower-case inside a title.
SMALL_WORDS = ("a", "an", "the", "and", "but", "or", "nor", "for", "yet", "so", "in", "on", "at", "to", "by", "of", "up", "as", "if", "is")
# Ordinal words, from the first on.
ORDINALS = ("FIRST", "SECOND", "THIRD", "FOURTH", "FIFTH", "SIXTH", "SEVENTH", "EIGHTH", "NINTH", "TENTH", "ELEVENTH", "TWELFTH", "THIRTEENTH", "FOURTEENTH", "FIFTEENTH", "SIXTEENTH", "SEVENTEENTH")


def slug(text: Column, longest: int = 60, ascii_only: bool = False) -> Column:
    """Lower case, marks dropped, runs of blanks and dashes one dash; cut to ``longest``."""
    unicode = "" if ascii_only else "(?U)"
    bare = F.regexp_replace(F.lower(F.trim(text)), unicode + r"[^\w\s-]", "")
    return F.regexp_replace(F.substring(F.regexp_replace(bare, unicode + r"[\s_-]+", "-"), 1, longest), "^-+|-+$", "")


def invert_author(author: Column, aliases: Column | None = None) -> Column:
    """``Surname, First, dates.`` to ``First Surname``; dates and honorifics are dropped, then bracketed remarks; aliases last."""
    parts = F.transform(F.split(author, ","), lambda p: F.regexp_replace(F.trim(p), r"\.+$", ""))
    names = F.filter(parts, lambda p: (p != "") & ~p.rlike(r"^(?:\d|attributed|Sir|Mrs|Mr|Duke|Earl|fl\.|Baron|Viscount|Lord)"))
    turned = F.when(F.size(names) >= 2, F.concat(F.get(names, F.lit(1)), F.lit(" "), F.get(names, F.lit(0)))).when(F.size(names) == 1, F.get(names, F.lit(0))).otherwise(F.trim(author))
    plain = F.when(F.contains(author, F.lit(",")), turned).otherwise(F.trim(author))
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"\s*\([^)]*\)\s*", " "), r"\s+", " "))
    return F.coalesce(F.try_element_at(aliases, plain), plain) if aliases is not None else plain


def author_key(name: Column, full_for: tuple[str, ...] = ()) -> Column:
    """Slug of the last word; of the whole name for those whose surname is shared."""
    last = F.element_at(F.split(F.trim(name), r"\s+"), -1)
    return F.when(F.trim(name) == "", "unknown").when(F.trim(name).isin(*full_for) if full_for else F.lit(False), slug(name)).otherwise(slug(last))


def clean_line(line: Column) -> Column:
    """No-break blanks become blanks; a number after three blanks or more at the end, and blanks at the end, go."""
    return F.regexp_replace(F.regexp_replace(F.replace(line, F.lit(" "), F.lit(" ")), r"\s{3,}\d+\s*$", ""), r"\s+$", "")


def clean_title(title: Column) -> Column:
    """Tags, entities, doubled blanks, note markers and the period at the end go."""
    x = F.regexp_replace(title, r"<[^>]+>", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " ")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    x = F.regexp_replace(F.regexp_replace(x, r"\[\d+\]|\*+$", ""), r"\s+", " ")
    return F.regexp_replace(F.trim(x), r"\.$", "")


def _capitalised(w: Column) -> Column:
    """One word: initials (up to four letters with periods) and roman numerals in capitals, else the first letter."""
    letters = F.regexp_replace(w, "[^A-Za-z]", "")
    initials = F.contains(w, F.lit(".")) & (F.length(letters) <= 4) & (letters != "") & F.regexp_replace(w, r"""^["'()]+|["'()]+$""", "").rlike(r"^[\p{L}.]+$")
    roman = (F.length(letters) >= 2) & F.upper(letters).rlike("^M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})$")
    low = F.lower(w)
    head = F.regexp_extract(low, r"^[^\p{L}]*", 0)
    first = F.length(head) + 1
    return F.when(initials | roman, F.upper(w)).otherwise(F.concat(head, F.upper(F.substring(low, first, F.lit(1))), F.substring(low, first + 1, F.length(low))))


def title_case(text: Column) -> Column:
    """Words capitalised but for small ones inside; the parts of a word with a dash each; initials and roman numerals in capitals."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def cased(w: Column, i: Column) -> Column:
        core = F.regexp_replace(F.lower(w), r"""^[.,;:!?()"'“”‘’]+|[.,;:!?()"'“”‘’]+$""", "")
        parts = F.transform(F.split(w, "—", -1), lambda p: F.when(p == "", p).otherwise(_capitalised(p)))
        return F.when((i > 0) & core.isin(*SMALL_WORDS), F.lower(w)).otherwise(F.array_join(parts, "—"))

    return F.array_join(F.transform(words, cased), " ")


def upper_ratio(text: Column) -> Column:
    """Upper-case letters over letters; 0 without letters."""
    letters = F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(letters > 0, F.regexp_count(text, F.lit("[A-Z]")) / letters).otherwise(F.lit(0.0))


def roman_to_int(text: Column) -> Column:
    """Null unless the text is made of numerals only; a numeral before a larger one counts against."""
    value = F.create_map(*[F.lit(x) for n, v in NUMERALS if len(n) == 1 for x in (n, v)])
    digits = F.transform(F.filter(F.split(F.upper(F.trim(text)), ""), lambda c: c != ""), lambda c: F.try_element_at(value, c))
    signed = F.zip_with(digits, F.slice(F.concat(digits, F.array(F.lit(0))), F.lit(2), F.size(digits)), lambda a, b: F.when(a < b, -a).otherwise(a))
    return F.when(F.upper(F.trim(text)).rlike("^[IVXLCDM]+$"), F.aggregate(signed, F.lit(0), lambda s, x: s + x))


def int_to_roman(number: Column) -> Column:
    """Numerals of a positive number."""
    left, parts = number, []
    for numeral, value in NUMERALS:
        parts.append(F.repeat(F.lit(numeral), F.floor(left / value).cast("int")))
        left = left % value
    return F.concat(*parts)


def ordinal_to_roman(text: Column) -> Column:
    """``Canto the Seventh`` to ``VII``; null without an ordinal word."""
    found = F.regexp_extract(F.upper(text), r"\b(" + "|".join(sorted(ORDINALS, key=len, reverse=True)) + r")\b", 1)
    return F.when(found != "", int_to_roman(F.array_position(F.array(*[F.lit(o) for o in ORDINALS]), found)))


def strip_tags(html: Column) -> Column:
    """Notes, editorial marks and all tags go, italics keep their text."""
    x = F.regexp_replace(html, r"(?s)<(note|script|style)\b.*?</\1>", "")
    return F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]+>", ""), r"\[(?:del|add|gap)[^\]]*\]", "")


def tei_line(xml: Column) -> Column:
    """Gaps as ``[...]``, notes dropped, hyphens at line ends joined, long s as s."""
    x = F.regexp_replace(F.regexp_replace(xml, r"(?s)<note\b.*?</note>", ""), r"<gap\b[^>]*/?>(?:</gap>)?", "[...]")
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]+>", ""), r"-\s*\n\s*", "")
    return F.trim(F.regexp_replace(F.replace(x, F.lit("ſ"), F.lit("s")), r"\s+", " "))


def break_lines(html: Column) -> Column:
    """Lines between ``<br>``, tags stripped, blank ones dropped."""
    lines = F.transform(F.split(html, r"<br\s*/?\s*>"), lambda x: F.trim(F.regexp_replace(x, r"<[^>]+>", "")))
    return F.filter(lines, lambda x: x != "")


def strip_marker(text: Column) -> Column:
    """The mark of a generated stimulus at the start."""
    return F.regexp_replace(text, r"^\[(contemplate|compare|engage_self)\]\s*", "")


def mark_speakers(text: Column) -> Column:
    """Lines that are a name and a period (words that begin with a capital, one blank between) set off by asterisks."""
    return F.regexp_replace(text, r"(?m)^([A-Z][a-zA-Z]*(?: [A-Z][a-zA-Z]*)*\.)$", "*$1*")


def shorten(text: Column, longest: int) -> Column:
    """Cut to ``longest`` characters, with an ellipsis where something went."""
    return F.when(F.length(text) > longest, F.concat(F.rtrim(F.substring(text, 1, longest)), F.lit("..."))).otherwise(text)


def index_words(text: Column) -> Column:
    """Words of three letters or more, lower-case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))


def search_form(text: Column) -> Column:
    """Lower case, marks dropped, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), " +", " "))


def dated_slug(day: Column, number: Column) -> Column:
    """X22."""
    return F.concat_ws("-", F.date_format(day, "yyyy-MM-dd"), F.format_string("%03d", number))


def title_or_first_line(title: Column, lines: Column) -> Column:
    """Where there is no title, the first line up to a dash or mark; over 60 characters, 57 and an ellipsis."""
    head = F.trim(F.regexp_extract(F.get(lines, F.lit(0)), r"^[^—;:,.!?]+", 0))
    short = F.when(F.length(head) > 60, F.concat(F.substring(head, 1, 57), F.lit("..."))).otherwise(head)
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), short)


def drop_title_lines(lines: Column, title: Column) -> Column:
    """Leading lines that say the title again."""
    return F.filter(lines, lambda x, i: ~((i < 2) & (F.upper(F.regexp_replace(x, "[^A-Za-z]", "")) == F.upper(F.regexp_replace(title, "[^A-Za-z]", "")))))


def year(text: Column) -> Column:
    """The first four digits in a row; 0 without."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, r"\d{4}", 0), F.lit("")), F.lit("9999")).cast("int"), F.lit(0))


def first_year(text: Column) -> Column:
    """The first year of a range of dates like ``1618-1658`` or ``b. 1618``, as text; an empty string without one."""
    return F.coalesce(F.regexp_extract(text, r"\d{4}", 0), F.lit(""))


def title_year(title: Column, default: int = 1720) -> Column:
    """The year from 1600 to 1799 that a title names, or ``default``."""
    return F.coalesce(F.nullif(F.regexp_extract(title, r"\b(1[67]\d{2})\b", 1), F.lit("")).cast("int"), F.lit(default))


def period(text: Column) -> Column:
    """The literary period of a date."""
    y = year(text)
    names = F.when(~text.rlike(r"\d{4}") | text.isNull(), "early_modern").when(y < 1500, "medieval").when(y < 1660, "early_modern").when(y < 1700, "restoration")
    return names.when(y < 1790, "augustan").when(y < 1830, "romantic").otherwise("victorian")


def midpoint_year(text: Column) -> Column:
    """The middle of two years, the year of one, or null."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\d{4}"), F.lit(0)), lambda y: y.cast("int"))
    return F.when(F.size(years) >= 2, F.floor((F.get(years, F.lit(0)) + F.get(years, F.lit(1))) / 2)).when(F.size(years) == 1, F.get(years, F.lit(0))).cast("int")


def human_date(day: Column) -> Column:
    """X46."""
    return F.date_format(day, "d MMMM yyyy")


def form(stanza_sizes: Column, div_type: Column) -> Column:
    """Poetic form from the numbers of lines in the stanzas."""
    total = F.aggregate(stanza_sizes, F.lit(0), lambda s, x: s + x.cast("int"))
    n, kind = F.size(stanza_sizes), F.lower(F.coalesce(div_type, F.lit("")))
    short = F.when(F.contains(kind, F.lit("song")), "song").when(F.contains(kind, F.lit("epigram")), "epigram").otherwise("other")
    x = F.when((n == 1) & (total == 14), "sonnet").when((n > 0) & F.forall(stanza_sizes, lambda s: s == 2), "couplet").when((n == 1) & (total > 20), "blank_verse")
    return x.when((total <= 8) & (n <= 2), short).when(n > 1, "stanzaic").otherwise("other")


def estimated_tokens(text: Column) -> Column:
    """A token for every four characters; the counter is a parameter wherever tokens are counted."""
    return F.floor(F.length(text) / 4).cast("long")


#: Characters whose encodings, some hundred bytes a token, are in memory at once.
ENCODED_CHARS = 1 << 18


def text_slices(texts: list[str], most: int) -> Iterator[list[str]]:
    """Runs of texts of at most ``most`` characters together, or of one longer text."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def bpe_tokens(vocabulary: str) -> Callable[[Column], Column]:
    """A counter of the tokens of a byte-pair vocabulary file (``tokenizer.json``), in Arrow batches; strings of special tokens count as text.

    The file is read here and travels with the code: a fixed size. Null has no tokens.
    """
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()

    def count(column: Column) -> Column:
        @F.pandas_udf("long")
        def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import tokenizers

            encoder = tokenizers.Tokenizer.from_str(content)
            encoder.encode_special_tokens = True
            for texts in batches:
                parts = text_slices(texts.fillna("").tolist(), ENCODED_CHARS)
                yield pd.Series([len(e.ids) for part in parts for e in encoder.encode_batch(part, add_special_tokens=False)])

        return counted(column)

    return count


def cosine_distance(a: Column, b: Column) -> Column:
    """For unit vectors."""
    return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(distance: Column) -> Column:
    """X54."""
    return 1 / (1 + distance)


def backoff_seconds(errors: Column, base: int = 5, longest: int = 300) -> Column:
    """Doubling with each error."""
    return F.least(F.lit(float(longest)), base * F.pow(F.lit(2.0), errors - 1))


def json_strings(text: Column) -> Column:
    """A JSON array of strings, or null where it is none."""
    return F.when(F.coalesce(F.json_array_length(text), F.lit(-1)) >= 0, F.from_json(text, "array<string>"))


def post_lines(text: Column) -> Column:
    """Posts as an array: a JSON array, flattened one level, or the text itself; newlines become blanks, empty ones go."""
    deep = F.flatten(F.from_json(text, "array<array<string>>"))
    flat = F.coalesce(F.when(text.rlike(r"^\s*\[\s*\["), deep), json_strings(text), F.array(text))
    return F.filter(F.transform(flat, lambda p: F.trim(F.regexp_replace(p, r"\s*\n\s*", " "))), lambda p: p != "")


def passage(text: Column) -> Column:
    """A passage as struct (chunk_id, poet): from an object, or a bare id with defaults."""
    return F.when(text.rlike(r"^\s*\{"), F.struct(F.get_json_object(text, "$.chunk_id").alias("chunk_id"), F.coalesce(F.get_json_object(text, "$.poet"), F.lit("")).alias("poet"))).otherwise(
        F.struct(text.alias("chunk_id"), F.lit("").alias("poet"))
    )


def strip_fence(text: Column) -> Column:
    """JSON without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))


def translator(text: Column) -> Column:
    """Who translated, or null."""
    return F.nullif(F.regexp_extract(text, r"(?i)translated by ([A-Z][\w. ]+?)(?:[,;)\n]|$)", 1), F.lit(""))


def stanza_text(lines: Column) -> Column:
    """X70."""
    return F.array_join(lines, "\n")
