"""Queries for scalar functions (X) and filters (F) over documents, pages, parts and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import safety as S
from ..functions import spans as X2
from ..functions import text as X
from ..functions import variants as V
from ..operators import filters as L
from .registry import Tables, query

FIRST_LINE = "split_part(text, chr(10), 1)"  # where the first line is the feature

#: The lines of every text.
ALL_LINES = "(SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"


def first_line(t: Tables, *more: str) -> DataFrame:
    return t.documents.select("doc_id", *more, F.substring_index("text", "\n", 1).alias("line"))


@query("x01_slug", r"""SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(trim(url)), '[^0-9A-Za-z_\s-]', '', 'g'), '[\s_-]+', '-', 'g'), 1, 60), '^-+|-+$', '', 'g') AS slug
  FROM (SELECT page_id AS doc_id, url FROM pages)""")
def _(t: Tables) -> DataFrame:
    return t.pages.select(F.col("page_id").alias("doc_id"), X.slug(F.col("url"), 60, ascii_only=True).alias("slug"))


@query("x02_slug_lengths", r"""SELECT page_id, regexp_replace(substr(s, 1, 30), '^-+|-+$', '', 'g') AS s30, regexp_replace(substr(s, 1, 40), '^-+|-+$', '', 'g') AS s40
  FROM (SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '[^0-9A-Za-z_\s-]', '', 'g'), '[\s_-]+', '-', 'g') AS s FROM pages)""")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", *[X.slug(F.col("url"), n, ascii_only=True).alias(f"s{n}") for n in (30, 40)])


@query("x03_invert_author", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'George ' || c_mktsegment WHEN 1 THEN c_mktsegment WHEN 2 THEN 'Ann B' ELSE 'Plain ' || c_mktsegment END AS author FROM customer""")
def _(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, F.concat("c_mktsegment", F.lit(", George, 1593-1633."))).when(k == 1, F.concat("c_mktsegment", F.lit(", Sir, fl. 1600"))).when(k == 2, F.lit("B., Ann ('The Bee')."))
    raw = raw.otherwise(F.concat(F.lit("Plain "), "c_mktsegment", F.lit(" (attrib.)")))
    aliases = F.create_map(F.lit("Ann ('The Bee') B"), F.lit("unused"))
    return t.customer.select("c_custkey", X.invert_author(raw, aliases).alias("author"))


@query("x04_author_key", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'katherine-philips' ELSE lower(c_mktsegment) END AS author_key FROM customer""")
def _(t: Tables) -> DataFrame:
    name = F.when(F.col("c_custkey") % 3 == 0, F.lit("Katherine Philips")).otherwise(F.concat(F.lit("John "), "c_mktsegment"))
    return t.customer.select("c_custkey", X.author_key(name, ("Katherine Philips",)).alias("author_key"))


@query("x05_clean_line", rf"SELECT doc_id, pos, regexp_replace(regexp_replace(replace(line, chr(160), ' '), '\s{{3,}}\d+\s*$', ''), '\s+$', '') AS line FROM {ALL_LINES}")
def _(t: Tables) -> DataFrame:
    return L.lines(t.documents, "doc_id").select("doc_id", "pos", X.clean_line(F.col("line")).alias("line"))


@query("x06_clean_title", r"""SELECT page_id, regexp_replace(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(title, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '\[\d+\]|\*+$', '', 'g').regexp_replace('\s+', ' ', 'g')), '\.$', '') AS title
  FROM (SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS title FROM pages)""")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.clean_title(F.regexp_extract("html", "<h1>(.*?)</h1>", 1)).alias("title"))


@query("x07_title_case", r"""SELECT p_partkey, 'The Song of ' || b || '—' || c || ', if It is a Mild V.R. and "' || n || '" in XIV' || ' Civil —' || c || '. "the ' || '(' || c || ')' AS title
  FROM (SELECT p_partkey, upper(p_brand[1]) || lower(p_brand[2:]) AS b, upper(p_type[1]) || lower(p_type[2:]) AS c, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS n FROM part)""")
def _(t: Tables) -> DataFrame:
    """Dashes inside and before words, initials, numerals and words that only look like them, small words, marks around words."""
    raw = F.concat(F.lit("THE SONG OF "), F.upper("p_brand"), F.lit("—"), F.upper("p_type"), F.lit(', IF IT IS A MILD V.R. AND "'), F.upper(F.substring_index("p_name", " ", 1)), F.lit('" IN XIV CIVIL —'), F.upper("p_type"), F.lit('. "THE ('), F.upper("p_type"), F.lit(")"))
    return t.part.select("p_partkey", X.title_case(raw).alias("title"))


@query("x08_upper_ratio", f"""SELECT doc_id, pos, CASE WHEN n > 0 THEN round(u::DOUBLE / n, 6) ELSE 0 END AS ratio, CASE WHEN n > 0 THEN u::DOUBLE / n > 0.7 ELSE false END AS mostly_upper
  FROM (SELECT doc_id, pos, len(regexp_extract_all(line, '[A-Za-z]')) AS n, len(regexp_extract_all(line, '[A-Z]')) AS u FROM {ALL_LINES})""")
def _(t: Tables) -> DataFrame:
    ratio = X.upper_ratio(F.col("line"))
    return L.lines(t.documents, "doc_id").select("doc_id", "pos", F.round(ratio, 6).alias("ratio"), (ratio > 0.7).alias("mostly_upper"))


@query("x09_roman_round_trip", "SELECT o_orderkey, (o_orderkey % 3999 + 1)::INT AS number FROM orders")
def _(t: Tables) -> DataFrame:
    n = (F.col("o_orderkey") % 3999 + 1).cast("int")
    return t.orders.select("o_orderkey", X.roman_to_int(X.int_to_roman(n)).alias("number"))


@query("x10_ordinals", "SELECT n_nationkey, ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII', 'XIII', 'XIV', 'XV', 'XVI', 'XVII'][n_nationkey % 17 + 1] AS roman FROM nation")
def _(t: Tables) -> DataFrame:
    word = F.get(F.array(*[F.lit(o) for o in X.ORDINALS]), F.col("n_nationkey") % 17)
    return t.nation.select("n_nationkey", X.ordinal_to_roman(F.concat(F.lit("Canto the "), F.lower(word))).alias("roman"))


@query("x11_strip_tags", r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(?:script)\b.*?</script>|<style\b.*?</style>', '', 'g'), '(?s)<[^>]+>', '', 'g'), '\[(?:del|add|gap)[^\]]*\]', '', 'g')) AS plain FROM pages""")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("plain"))


MARKED = """line || ' some<gap extent="1 letter"/> <note n="1">aside' || chr(10) || '</note>bles <hi>ſed</hi> morn-' || chr(10) || ' ing'"""


@query("x12_tei_line", rf"""SELECT doc_id, pos, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({MARKED}, '(?s)<note\b.*?</note>', '', 'g'), '<gap\b[^>]*/?>(?:</gap>)?', '[...]', 'g'), '(?s)<[^>]+>', '', 'g'),
  '-[\s\x0b]*\n[\s\x0b]*', '', 'g'), 'ſ', 's'), '[\s\x0b]+', ' ', 'g')) AS line FROM {ALL_LINES}""")
def _(t: Tables) -> DataFrame:
    raw = F.concat("line", F.lit(' some<gap extent="1 letter"/> <note n="1">aside\n</note>bles <hi>ſed</hi> morn-\n ing'))
    return L.lines(t.documents, "doc_id").select("doc_id", "pos", X.tei_line(raw).alias("line"))


@query("x13_break_lines", r"""SELECT page_id, list_filter(list_transform(regexp_split_to_array(b, '<br\s*/?\s*>'), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'))), lambda x: x <> '') AS lines
  FROM (SELECT page_id, regexp_extract(html, '<article>(.*?)</article>', 1) AS b FROM pages)""")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.break_lines(F.regexp_extract("html", "<article>(.*?)</article>", 1)).alias("lines"))


@query("x15_strip_marker", "SELECT id, stimulus FROM interactions")
def _(t: Tables) -> DataFrame:
    marked = F.when(F.col("id") % 2 == 0, F.concat(F.lit("[contemplate] "), "stimulus")).otherwise(F.col("stimulus"))
    return t.interactions.select("id", X.strip_marker(marked).alias("stimulus"))


CLIPPED = """c AS (SELECT p.page_id, p.url, p.page_id % 5 AS k, d.text AS body FROM pages p JOIN documents d ON d.doc_id = p.page_id),
  w AS (SELECT *, trim(regexp_replace(body, '^[\\s]+|[\\s]+$', '', 'g'), ' ') AS clean, len(regexp_extract_all(body, '[^\\s]+')) AS n FROM c)"""


@query("x16_clips", f"""WITH {CLIPPED} SELECT page_id, CASE WHEN n <= 150 THEN 'epigraph' ELSE 'link' END AS mode, CASE WHEN n <= 150 THEN md5(clean) END AS digest,
    CASE k WHEN 2 THEN NULL WHEN 3 THEN 'https://example.org/a/b' ELSE url END AS uri, CASE k WHEN 0 THEN 'Title ' || page_id WHEN 1 THEN CASE WHEN n > 150 THEN 'someone' END WHEN 3 THEN CASE WHEN n > 150 THEN 'example.org' END END AS label FROM w WHERE k <> 4 AND NOT (k = 2 AND n > 150)""")
def _(t: Tables) -> DataFrame:
    """Clips with a heading; by an author; from a private reader; with a source line; of one's own."""
    k = F.col("page_id") % 5
    text = F.when(k == 0, F.concat(F.lit("# Title "), "page_id", F.lit("\n\n"), "text")).when(k == 3, F.concat(F.lit("Source: https://example.org/a/b\n"), "text")).otherwise(F.col("text"))
    uri = F.when(k == 2, "https://read.amazon.com/kp/x").when(k == 3, F.lit(None).cast("string")).otherwise(F.col("url"))
    author = F.when(k == 1, "someone").when(k == 4, "self")
    shown = t.pages.join(t.documents, F.col("page_id") == F.col("doc_id")).select("page_id", X2.clip(text, uri, author).alias("c")).filter("c IS NOT NULL")
    return shown.select("page_id", "c.mode", F.md5("c.text").alias("digest"), "c.uri", "c.label")


@query("x17_quotes", r"""WITH q AS (SELECT doc_id, unnest(CASE doc_id % 6 WHEN 0 THEN [('"words of ' || doc_id || '" — Keats', 'words of ' || doc_id, 'inline', 'Keats')] WHEN 1 THEN [('“curly ' || doc_id || '”', 'curly ' || doc_id, 'inline', NULL)]
    WHEN 3 THEN [('"one ' || doc_id || ' / two / three".', 'one ' || doc_id || ' / two / three', 'verse', NULL)] WHEN 4 THEN [('"' || trim(repeat('word ', 30)) || '"!', trim(repeat('word ', 30)), 'prose', NULL)]
    WHEN 5 THEN [('"first" — A.', 'first', 'inline', 'A.'), ('"second ' || doc_id || '"', 'second ' || doc_id, 'inline', NULL)] ELSE [] END) AS x, doc_id % 6 AS k FROM documents)
  SELECT doc_id, strpos(CASE k WHEN 0 THEN 'He said ' WHEN 1 THEN 'A ' WHEN 3 THEN 'It goes ' WHEN 4 THEN 'So: ' ELSE CASE WHEN x[2] = 'first' THEN '' ELSE '"first" — A. B; then ' END END || '~', '~')::INT - 1 AS start,
    strpos(CASE k WHEN 0 THEN 'He said ' WHEN 1 THEN 'A ' WHEN 3 THEN 'It goes ' WHEN 4 THEN 'So: ' ELSE CASE WHEN x[2] = 'first' THEN '' ELSE '"first" — A. B; then ' END END || '~', '~')::INT - 1 + length(x[1])::INT AS stop, x[2] AS quote, x[3] AS kind, x[4] AS author FROM q""")
def _(t: Tables) -> DataFrame:
    """Attributed, curly, too short, verse and prose with a mark after it, attributed before bare; then the text itself, whose quotes are none."""
    said = {0: 'He said "words of %s" — Keats, and more. ', 1: "A “curly %s” end. ", 2: 'An "abc%.0s" only. ', 3: 'It goes "one %s / two / three". Next. ', 4: f'So: "{("word " * 30).strip()}%.0s"! ', 5: '"first" — A. B; then "second %s" '}
    k = F.col("doc_id") % 6
    text = F.lit(None).cast("string")
    for n, form in said.items():
        head, _, tail = form.replace("%.0s", "").partition("%s") if "%s" in form else (form.replace("%.0s", ""), "", "")
        text = F.when(k == n, F.concat(F.lit(head), F.col("doc_id").cast("string") if "%s" in form else F.lit(""), F.lit(tail))).otherwise(text)
    whole = F.concat(text, F.translate("text", '"“”', ""))
    return t.documents.select("doc_id", F.inline(X2.quotations(whole)))


@query("x18_speakers", r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '*' || first || ' ' || second || '.*' WHEN 1 THEN '*' || upper(p_name) || '.*' WHEN 2 THEN first || ' ' || split_part(p_name, ' ', 2) || '.' ELSE first || ' ' || second || '' END || chr(10) || 'Of ' || p_name || '.' || chr(10) || '*' || first || '.*' AS text
  FROM (SELECT *, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS first, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS second FROM part)""")
def _(t: Tables) -> DataFrame:
    """Names of two words, in capitals, with a small word, without a period; a sentence; a name of one word."""
    first, second, k = F.initcap(F.substring_index("p_name", " ", 1)), F.substring_index("p_name", " ", -1), F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.initcap("p_name"), F.lit("."))).when(k == 1, F.concat(F.upper("p_name"), F.lit("."))).when(k == 2, F.concat(first, F.lit(" "), second, F.lit("."))).otherwise(F.initcap("p_name"))
    said = F.concat(name, F.lit("\nOf "), "p_name", F.lit(".\n"), first, F.lit("."))
    return t.part.select("p_partkey", X.mark_speakers(said).alias("text"))


@query("x19_shorten", "SELECT doc_id, CASE WHEN length(text) > 140 THEN rtrim(substr(text, 1, 140), ' ') || '...' ELSE text END AS lede FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.shorten(F.col("text"), 140).alias("lede"))


@query("x20_index_words", "SELECT item_id, regexp_extract_all(lower(text), '[a-z]{3,}') AS words FROM benchmark")
def _(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.index_words(F.col("text")).alias("words"))


@query("x21_search_form", "SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS form FROM benchmark")
def _(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.search_form(F.col("text")).alias("form"))


@query("x22_dated_slug", "SELECT id, strftime(day, '%Y-%m-%d') || '-' || lpad((id % 1000)::VARCHAR, 3, '0') AS slug, strftime(day, '%-d %B %Y') AS human FROM interactions")
def _(t: Tables) -> DataFrame:
    return t.interactions.select("id", X.dated_slug(F.col("day"), F.col("id") % 1000).alias("slug"), X.human_date(F.col("day")).alias("human"))


@query("x24_drop_title_lines", r"""SELECT doc_id, md5(array_to_string(list_filter(s, lambda x, i: NOT (i <= 2 AND upper(regexp_replace(x, '[^A-Za-z]', '', 'g')) = upper(regexp_replace(s[1], '[^A-Za-z]', '', 'g')))), chr(10))) AS lines
  FROM (SELECT doc_id, list_concat(['THE ' || upper(split_part(text, chr(10), 1)), lower(split_part(text, chr(10), 1))], string_split(text, chr(10))) AS raw, CASE WHEN doc_id % 2 = 0 THEN raw[2:] ELSE raw[3:] END AS s FROM documents)""")
def _(t: Tables) -> DataFrame:
    """Every second text has its first line said twice, in another case."""
    whole = F.split("text", "\n", -1)
    lines = F.when(F.col("doc_id") % 2 == 0, F.concat(F.array(F.lower(F.get(whole, F.lit(0)))), whole)).otherwise(whole)
    return t.documents.select("doc_id", F.md5(F.array_join(X.drop_title_lines(lines, F.get(lines, F.lit(0))), "\n")).alias("lines"))


@query("x25_untitled", f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source WHEN length(h) > 60 THEN substr(h, 1, 57) || '...' ELSE h END AS title FROM (SELECT *, trim(regexp_extract({FIRST_LINE}, '^[^—;:,.!?]+')) AS h FROM documents)""")
def _(t: Tables) -> DataFrame:
    title = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.lit(" "))
    return first_line(t, "source").select("doc_id", X.title_or_first_line(title, F.array("line")).alias("title"))


YEARS = "'printed ' || (1400 + o_orderkey % 500) || '-' || (1420 + o_orderkey % 500)"


@query("x40_x41_year_period", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE y END::INT AS year, CASE WHEN o_orderkey % 7 = 0 THEN 'early_modern' WHEN y < 1500 THEN 'medieval' WHEN y < 1660 THEN 'early_modern' WHEN y < 1700 THEN 'restoration' WHEN y < 1790 THEN 'augustan' WHEN y < 1830 THEN 'romantic' ELSE 'victorian' END AS period
  FROM (SELECT o_orderkey, 1400 + o_orderkey % 500 AS y FROM orders)""")
def _(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 7 == 0, F.lit("undated")).otherwise(F.concat(F.lit("printed "), 1400 + F.col("o_orderkey") % 500, F.lit(".")))
    return t.orders.select("o_orderkey", X.year(text).alias("year"), X.period(text).alias("period"))


@query("x42_midpoint", "SELECT o_orderkey, (1410 + o_orderkey % 500)::INT AS year FROM orders")
def _(t: Tables) -> DataFrame:
    y = 1400 + F.col("o_orderkey") % 500
    return t.orders.select("o_orderkey", X.midpoint_year(F.concat(F.lit("("), y, F.lit("-"), y + 20, F.lit(")"))).alias("year"))


@query("x43_x44_years", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE (1500 + o_orderkey % 400)::VARCHAR END AS first, CASE WHEN o_orderkey % 3 = 0 THEN 1720 WHEN o_orderkey % 400 BETWEEN 100 AND 299 THEN 1500 + o_orderkey % 400 WHEN o_orderkey % 400 BETWEEN 70 AND 99 THEN 1530 + o_orderkey % 400 ELSE 1720 END::INT AS year FROM orders")
def _(t: Tables) -> DataFrame:
    y = 1500 + F.col("o_orderkey") % 400
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("A Tale (undated)")).otherwise(F.concat(F.lit("b. "), y, F.lit("-"), y + 30))
    return t.orders.select("o_orderkey", X.first_year(text).alias("first"), X.title_year(text).alias("year"))


@query("x46_human_date", "SELECT o_orderkey, strftime(o_orderdate, '%-d %B %Y') AS human FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", X.human_date(F.col("o_orderdate")).alias("human"))


@query("x51_bpe_tokens")
def _(t: Tables) -> DataFrame:
    """Counts of a public byte-pair vocabulary; held against its own engine in the tests."""
    import public_tokenizers

    return t.documents.select("doc_id", X.bpe_tokens(public_tokenizers.path("byte_bpe_50k.json"))(F.col("text")).alias("tokens"))


@query("x45_lookup_maps", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1704 WHEN '2-HIGH' THEN 1726 ELSE 1720 END AS date, CASE o_orderstatus WHEN 'F' THEN 'satire' ELSE 'essay' END AS genre FROM orders")
def _(t: Tables) -> DataFrame:
    dates, genres = F.create_map(F.lit("1-URGENT"), F.lit(1704), F.lit("2-HIGH"), F.lit(1726)), F.create_map(F.lit("F"), F.lit("satire"))
    return t.orders.select("o_orderkey", F.coalesce(F.try_element_at(dates, "o_orderpriority"), F.lit(1720)).alias("date"), F.coalesce(F.try_element_at(genres, "o_orderstatus"), F.lit("essay")).alias("genre"))


@query("x50_form", """SELECT doc_id, CASE WHEN n = 14 THEN 'sonnet' WHEN n = 2 THEN 'couplet' WHEN n > 20 THEN 'blank_verse' WHEN n <= 8 AND lang = 'fr' THEN 'song' ELSE 'other' END AS form FROM (SELECT doc_id, lang, len(string_split(text, chr(10))) AS n FROM documents)""")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.form(F.array(F.size(F.split("text", "\n", -1))), F.when(F.col("lang") == "fr", "A Song")).alias("form"))


@query("x52_token_estimate", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.estimated_tokens(F.col("text")).alias("tokens"))


@query("x53_x54_similarity", "SELECT a.vec_id, round(1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS distance, round(1 / (2 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t: Tables) -> DataFrame:
    a, b = t.embeddings.alias("a"), t.embeddings.alias("b")
    d = X.cosine_distance(F.col("a.embedding"), F.col("b.embedding"))
    return a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1).select("a.vec_id", F.round(d, 5).alias("distance"), F.round(X.similarity(d), 5).alias("similarity"))


@query("x55_backoff", "SELECT DISTINCT tokens_out % 12 + 1 AS errors, least(300.0, 5 * 2 ** (tokens_out % 12)) AS seconds FROM interactions")
def _(t: Tables) -> DataFrame:
    e = F.col("tokens_out") % 12 + 1
    return t.interactions.select(e.alias("errors"), X.backoff_seconds(e).alias("seconds")).distinct()


@query("x60_x64_json_or_null", "SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE themes::JSON::VARCHAR[] END AS themes FROM interactions")
def _(t: Tables) -> DataFrame:
    return t.interactions.select("id", X.json_strings(F.when(F.col("id") % 3 == 0, F.lit('{"broken": ')).otherwise(F.col("themes"))).alias("themes"))


def answers(t: Tables) -> DataFrame:
    """(id, answer): selected ids in each shape that is known to come, and in some that can't be read."""
    n, k = F.col("id"), F.col("id") % 8
    shapes = ['[{"id": %1$d, "tier": "notebook", "reason": "r"}, {"tier": "x"}]', '[%1$d, "%1$d", true, null, 1.5]', '"[%1$d]"', '[[{"id": %1$d}, %1$d], {"id": %1$d}]', "[trunc %1$d", '{"id": %1$d}', '["{\\"id\\": %1$d}", "none", "007"]']
    raw = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        raw = F.when(k == i, F.format_string(shape, n)).otherwise(raw)
    return t.interactions.select("id", V.selected(raw).alias("answer"))


@query("x61_selected_ids", """SELECT id, unnest(CASE id % 8 WHEN 0 THEN [(id::VARCHAR, 'notebook', 'r')] WHEN 1 THEN [(id::VARCHAR, 'publish', ''), (id::VARCHAR, 'publish', '')] WHEN 2 THEN [(id::VARCHAR, 'publish', '')]
  WHEN 3 THEN [(id::VARCHAR, NULL, NULL), (id::VARCHAR, NULL, NULL)] WHEN 6 THEN [(id::VARCHAR, NULL, NULL), ('7', 'publish', '')] END) AS x, x[1] AS kept_id, x[2] AS tier, x[3] AS reason FROM interactions""".replace("SELECT id, unnest", "SELECT id, kept_id, tier, reason FROM (SELECT id, unnest") + ")")
def _(t: Tables) -> DataFrame:
    return answers(t).select("id", F.inline("answer.kept")).toDF("id", "kept_id", "tier", "reason")


@query("x61_k06_dropped_ids", """SELECT id, item, reason FROM (SELECT id, unnest(CASE id % 8 WHEN 0 THEN [('{"tier":"x"}', 'no id')] WHEN 1 THEN [('true', 'no number, no object'), ('null', 'no number, no object'), ('1.5', 'no number, no object')]
  WHEN 3 THEN [(id::VARCHAR, 'no id')] WHEN 4 THEN [('[trunc ' || id, 'no JSON')] WHEN 5 THEN [('{"id":' || id || '}', 'no list')] WHEN 6 THEN [('"none"', 'no number, no object')] END) AS x, x[1] AS item, x[2] AS reason FROM interactions)""")
def _(t: Tables) -> DataFrame:
    return V.failures(answers(t), "id", "answer")


@query("x62_post_lines", "SELECT id, CASE id % 3 WHEN 0 THEN [stimulus, author] WHEN 1 THEN [stimulus || ' ' || author] ELSE [stimulus] END AS posts FROM interactions")
def _(t: Tables) -> DataFrame:
    k = F.col("id") % 3
    raw = F.when(k == 0, F.format_string('[["%s"], ["%s", ""]]', "stimulus", "author")).when(k == 1, F.concat("stimulus", F.lit(" \n "), "author")).otherwise(F.format_string('["%s"]', "stimulus"))
    return t.interactions.select("id", X.post_lines(raw).alias("posts"))


@query("x63_passage", "SELECT id, chunk_id, CASE WHEN id % 2 = 0 THEN poet ELSE '' END AS poet FROM interactions")
def _(t: Tables) -> DataFrame:
    return t.interactions.select("id", X.passage(F.when(F.col("id") % 2 == 0, F.col("passage_used")).otherwise(F.col("chunk_id"))).alias("passage")).select("id", "passage.*")


@query("x68_strip_fence", "SELECT id, themes FROM interactions")
def _(t: Tables) -> DataFrame:
    return t.interactions.select("id", X.strip_fence(F.concat(F.lit("```json\n"), "themes", F.lit("\n```\n"))).alias("themes"))


@query("x69_translator", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'John ' || upper(n_name[1]) || 'x' END AS translator FROM nation")
def _(t: Tables) -> DataFrame:
    text = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("(Translated by John "), F.upper(F.substring("n_name", 1, 1)), F.lit("x)"))).otherwise("by hand")
    return t.nation.select("n_nationkey", X.translator(text).alias("translator"))


@query("x70_stanza_text", "SELECT doc_id, text FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.stanza_text(F.split("text", "\n", -1)).alias("text"))


# Filters


@query("f01_catalogue", "SELECT p_partkey FROM part WHERE (lower(p_name) LIKE '%old%' OR lower(p_name) LIKE '%e bol%') AND p_size < 25")
def _(t: Tables) -> DataFrame:
    return t.part.filter(L.contains_any(F.col("p_name"), ["OLD", "e Bol"]) & (F.col("p_size") < 25)).select("p_partkey")


@query("f02_f03_select_skip", "SELECT p_partkey FROM part WHERE lower(p_type) LIKE '%st%' AND NOT (lower(p_name) LIKE '%small%' OR lower(p_name) LIKE '%bolt%')")
def _(t: Tables) -> DataFrame:
    return t.part.filter(L.contains_any(F.col("p_type"), ["ST"]) & ~L.contains_any(F.col("p_name"), ["Small", "BOLT"])).select("p_partkey")


@query("f04_structural", rf"""SELECT doc_id, pos, regexp_matches(line, '^[IVXLC]+\.?\s*$') OR regexp_matches(line, '^(SCENE|BOOK)\s') OR line IN ('Notes', 'CONTENTS') AS structural
  FROM (SELECT doc_id, pos, trim(CASE pos % 9 WHEN 0 THEN 'XIV.' WHEN 1 THEN 'BOOK ' || pos WHEN 2 THEN 'CONTENTS' WHEN 3 THEN 'ACT I' WHEN 4 THEN 'SCENE' ELSE line END) AS line FROM {ALL_LINES})""")
def _(t: Tables) -> DataFrame:
    k = F.col("pos") % 9
    planted = F.when(k == 0, "XIV.").when(k == 1, F.concat(F.lit("BOOK "), "pos")).when(k == 2, "CONTENTS").when(k == 3, "ACT I").when(k == 4, "SCENE").otherwise(F.col("line"))
    return L.lines(t.documents, "doc_id").select("doc_id", "pos", L.is_structural(planted, ["Notes", "CONTENTS"]).alias("structural"))


@query("f05_f06_exclude", "SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2') AND source NOT LIKE '%c1%' AND source NOT LIKE '%9%'")
def _(t: Tables) -> DataFrame:
    return L.exclude_containing(L.exclude_keys(t.documents, "source", ["src1", "src2"]), "source", ["c1", "9"]).select("doc_id")


@query("f07_f08_positions", """SELECT doc_id, [w[1], w[3]] AS kept, CASE WHEN doc_id % 100 < 40 THEN 'first' WHEN doc_id % 100 < 137 AND doc_id % 100 < 80 THEN 'second' END AS part FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) WHERE len(w) >= 3""")
def _(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.split("text", " ", -1).alias("w")).filter("size(w) >= 3")
    return rows.select("doc_id", L.keep_positions(F.col("w"), [0, 2]).alias("kept"), L.by_position(F.col("doc_id") % 100, [(40, "first"), (80, "second")]).alias("part"))


@query("f09_keywords", r"""SELECT doc_id, list_filter(['que', 'the', 'und'], lambda k: regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])' || k || '(?:$|[^\p{L}\p{N}_])')) AS matched FROM documents
  WHERE regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])(?:the|que|und)(?:$|[^\p{L}\p{N}_])')""")
def _(t: Tables) -> DataFrame:
    return L.match_keywords(t.dealt("documents", "doc_id", "text"), "text", ["the", "que", "und"]).select("doc_id", F.array_sort("matched").alias("matched"))


@query("f10_f11_envelope", "SELECT id, stimulus AS text FROM interactions WHERE id % 4 = 0 AND (id % 3 = 0 OR id % 5 = 0) AND stimulus <> ''")
def _(t: Tables) -> DataFrame:
    kind, langs = F.when(F.col("id") % 4 == 0, "create").otherwise("delete"), F.when(F.col("id") % 3 == 0, '["en","fr"]').when(F.col("id") % 5 == 0, "[]").otherwise('["de"]')
    raw = F.format_string('{"kind":"commit","commit":{"operation":"%s","collection":"post","record":{"text":"%s","langs":%s}}}', kind, "stimulus", langs)
    return L.open_envelope(t.interactions.select("id", raw.alias("raw")), "raw", "post").filter(L.language_passes(F.col("langs"), "en")).select("id", "text")


@query("f12_f14_conditions", "SELECT vec_id FROM vectors WHERE period = 1 AND type = 'verse' AND lower(coalesce(poet, '')) NOT IN ('poet0', 'poet2')")
def _(t: Tables) -> DataFrame:
    return L.equal_all(t.vectors, {"period": 1, "type": "verse", "poet": None}).filter(L.not_in_any_case(F.col("poet"), ["POET0", "Poet2"])).select("vec_id")


def reason_sql(text: str) -> str:
    """The fixed patterns as one CASE, in order of precedence."""
    cases = " ".join(f"WHEN regexp_matches({text}, '(?is){'|'.join(f'(?:{p})' for p in found)}') THEN '{category}'".replace("Jew(?:'s)", "Jew(?:''s)") for category, found in S.PATTERNS.items())
    return f"CASE {cases} ELSE '' END"


@query("f13_safety_texts", f"SELECT doc_id, {reason_sql('text')} AS reason FROM documents")
def _(t: Tables) -> DataFrame:
    return t.dealt("documents", "doc_id", "text").select("doc_id", S.safety_reason(F.col("text")).alias("reason"))


SAID = "CASE doc_id % 6 WHEN 0 THEN chr(10) || 'Romish rites and' || chr(10) || 'superstition ' WHEN 1 THEN ' the Irish, though never rebel ' WHEN 2 THEN ' woman, thy name is frailty ' WHEN 3 THEN ' Irish ' || repeat('x', 201) || ' rebel ' ELSE '' END"


@query("f13_safety", f"SELECT doc_id, {reason_sql('said')} AS reason FROM (SELECT doc_id, text || {SAID} AS said FROM documents)")
def _(t: Tables) -> DataFrame:
    """Whole texts with planted phrases at their end: a newline inside a gap, a gap of over 200 characters."""
    k = F.col("doc_id") % 6
    said = F.when(k == 0, "\nRomish rites and\nsuperstition ").when(k == 1, " the Irish, though never rebel ").when(k == 2, " woman, thy name is frailty ").when(k == 3, F.concat(F.lit(" Irish "), F.repeat(F.lit("x"), 201), F.lit(" rebel "))).otherwise("")
    return t.dealt("documents", "doc_id", "text").select("doc_id", S.safety_reason(F.concat("text", said)).alias("reason"))


@query("f15_page_range", "SELECT page_id FROM pages WHERE try_cast(regexp_extract(page_id || 'a', '^(\\d+)', 1) AS INT) BETWEEN 10 AND 99")
def _(t: Tables) -> DataFrame:
    return t.pages.filter(L.number_prefix(F.concat("page_id", F.lit("a"))).between(10, 99)).select("page_id")


@query("f16_least_size", "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[^\\s]+')) >= 30 AND len(string_split(text, chr(10))) >= 4 AND length(text) >= 100")
def _(t: Tables) -> DataFrame:
    return t.documents.filter(L.at_least(F.col("text"), words=30, lines=4, chars=100)).select("doc_id")


FIRST = "(SELECT min(day) FROM interactions WHERE decision = 'skip' AND tokens_out > 97)"


@query("f17_f18_publication", f"SELECT id, CASE WHEN published = 2 THEN 'notebook' ELSE 'rest' END AS tier FROM interactions WHERE decision = 'post' AND (published IN (1, 2) OR {FIRST} IS NULL OR day < {FIRST})")
def _(t: Tables) -> DataFrame:
    first = t.interactions.filter("decision = 'skip' AND tokens_out > 97").agg(F.min("day").alias("d")).scalar()
    rows = t.interactions.filter("decision = 'post'").filter(F.col("published").isin(1, 2) | first.isNull() | (F.col("day") < first))
    return rows.select("id", F.when(F.col("published") == 2, "notebook").otherwise("rest").alias("tier"))


@query("f19_tiers", "SELECT id, CASE WHEN id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 WHEN id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 2 END AS tier FROM interactions WHERE id IN (SELECT doc_id FROM labels)")
def _(t: Tables) -> DataFrame:
    picks = t.labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, 1).otherwise(2).alias("tier"))
    return L.review_tiers(t.interactions.select("id"), picks)


@query("f19_tiers_fallback", "SELECT id, 1 AS tier FROM interactions")
def _(t: Tables) -> DataFrame:
    return L.review_tiers(t.interactions.select("id"), t.labels.filter("quality = 9").select(F.col("doc_id").alias("id"), F.lit(1).alias("tier")))


@query("f20_boilerplate", r"""SELECT doc_id, trim(regexp_extract('licence' || chr(10) || '*** START OF THE BOOK ***' || chr(10) || text || chr(10) || '*** END OF THE BOOK ***' || chr(10) || 'licence', '(?s)\*\*\* ?START OF[^\n]*?\*\*\*(.*?)(?:\*\*\* ?END OF|\z)', 1), chr(10) || ' ') AS body FROM documents""")
def _(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("licence\n*** START OF THE BOOK ***\n"), "text", F.lit("\n*** END OF THE BOOK ***\nlicence"))
    return t.documents.select("doc_id", F.trim(L.strip_boilerplate(raw), F.lit("\n ")).alias("body"))


@query("f21_body_start", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
  SELECT doc_id, count(*) AS n FROM (SELECT *, min(CASE WHEN length(line) > 60 THEN pos END) OVER (PARTITION BY doc_id) AS start FROM l) WHERE pos >= start GROUP BY doc_id""")
def _(t: Tables) -> DataFrame:
    return L.from_first(L.lines(t.documents, "doc_id"), "doc_id", F.length("line") > 60).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("f22_line_classes", r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
  SELECT CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '^[IVXLC]+\.?$') THEN 'roman' WHEN regexp_matches(trim(line), '^\[?\d+\]?$') THEN 'page' WHEN regexp_matches(trim(line), '^[*_ -]{3,}$') THEN 'separator'
    WHEN regexp_matches(trim(line), '^\(.*\)$') THEN 'subtitle' WHEN regexp_matches(trim(line), '^\[\d+\]') THEN 'footnote' WHEN regexp_matches(line, '[A-Z]') AND NOT regexp_matches(line, '[a-z]') THEN 'title' ELSE 'text' END AS line_class, count(*) AS n FROM l GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return L.lines(t.documents, "doc_id").groupBy(L.line_class(F.col("line")).alias("line_class")).agg(F.count("*").alias("n"))


@query("f23_verse_div", "SELECT n_nationkey, n_nationkey % 2 = 0 AS verse FROM nation")
def _(t: Tables) -> DataFrame:
    xml = F.when(F.col("n_nationkey") % 2 == 0, F.lit("<div><lg><l>a</l><l>b</l></lg></div>")).otherwise("<div><p>prose</p></div>")
    return t.nation.select("n_nationkey", L.is_verse(xml).alias("verse"))


@query("f24_content", "SELECT page_id, regexp_matches(regexp_replace(html, '<[^>]+>', '', 'g'), '[A-Za-z]') AS content FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", L.has_content(F.col("html")).alias("content"))


@query("f25_skip_titles", "SELECT p_partkey FROM part WHERE upper(p_brand) NOT IN (SELECT upper(p_brand) FROM part WHERE p_size = 1)")
def _(t: Tables) -> DataFrame:
    return L.skip_titles(t.part, "p_brand", t.part.filter("p_size = 1").select(F.lower("p_brand").alias("title"))).select("p_partkey")
