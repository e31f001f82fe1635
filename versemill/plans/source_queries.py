"""Queries over books, exports and configurations (S): documents are made from the tables, so SQL can say what must come out."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import books as B
from ..sources import readers as S
from ..sources.plaintext import parse
from . import service as V
from .registry import Tables, query
from .stream_queries import put_bytes, put_file, scratch


def joined(parts: DataFrame, by: str, order: str, text: str, before: str = "", after: str = "") -> DataFrame:
    """(by, html): the texts of a group in order as one document."""
    gathered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "")
    return parts.groupBy(by).agg(F.concat(F.lit(before), gathered, F.lit(after)).alias("html"))


@query("s02_works", "SELECT r_regionkey || '.json' AS file, n_name AS title, 0 AS stanza, (row_number() OVER (PARTITION BY n_nationkey ORDER BY k) - 1)::INT AS line_no, line FROM (SELECT n_regionkey AS r_regionkey, n_nationkey, n_name, unnest([1, 2]) AS k, unnest(['On ' || n_name, 'end']) AS line FROM nation)")
def _(t: Tables) -> DataFrame:
    """A JSON object a file, beside files that hold a list or nothing that parses."""
    at = scratch(t)
    poem = F.struct(F.col("n_name").alias("title"), F.array(F.struct(F.array(F.concat(F.lit("On "), "n_name"), F.lit("end")).alias("lines"))).alias("stanzas"))
    for r in t.nation.groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list(poem).alias("poems"))).alias("work")).collect():  # five files
        put_file(t, f"{at}/{r.n_regionkey}.json", r.work.replace(",", ",\n"))  # over several lines
    put_file(t, f"{at}/list.json", '[{"poems": []}]')
    put_file(t, f"{at}/cut.json", "")
    return S.poem_lines(S.read_works(t.spark, at)).select("file", "title", "stanza", "line_no", "line")


@query("s03_line_corpus", "SELECT p_name AS s FROM part WHERE p_partkey % 4 <> 0 AND length(p_name) > 5")
def _(t: Tables) -> DataFrame:
    at, k = scratch(t), F.col("p_partkey")
    row = F.when(k % 4 == 0, F.when(k % 8 == 0, '{"s": "cut').otherwise('{"s": "five5"}')).otherwise(F.to_json(F.struct(F.col("p_name").alias("s"))))
    t.part.select(row.alias("value")).write.text(at)
    return B.read_line_corpus(t.spark, at).select("s")


@query("s06_s07_drama", "SELECT n_nationkey::VARCHAR AS key, n_name AS speaker, (k - 1)::INT AS line_no, CASE WHEN k = 1 THEN '[' || n_name || '] ' ELSE '' END || 'line ' || k AS line FROM nation, range(1, 6) r(k)")
def _(t: Tables) -> DataFrame:
    """Speeches of five and of three verse lines: the short ones are dropped."""
    said = lambda n: "".join(f"<l>line {i}</l>" for i in range(1, n + 1))
    xml = F.concat(F.lit("<TEI><text><body><div><head>Act</head><sp><speaker>"), "n_name", F.lit(f"</speaker>{said(5)}</sp><sp><speaker>Other</speaker>{said(3)}</sp></div></body></text></TEI>"))
    return B.speaker_lines(S.parse_tei(t.nation.select("n_nationkey", xml.alias("xml")), "n_nationkey", "xml")).select("key", "speaker", "line_no", "line")


@query("s09_pre_blocks", "SELECT n_nationkey, [['On ' || n_name, '  indented'], ['second'], ['other block']] AS stanzas FROM nation")
def _(t: Tables) -> DataFrame:
    html = F.concat(F.lit("<pre>On <b>"), "n_name", F.lit("</b>  \n  indented\n\n \nsecond\n</pre><p>prose</p><pre class='x'>other block</pre>"))
    return t.nation.select("n_nationkey", S.pre_lines(html).alias("stanzas"))


@query("s10_structured", "SELECT n_nationkey::VARCHAR AS key, unnest([0, 0, 1]) AS stanza, unnest(['On ' || n_name, 'and on', 'the end']) AS line FROM nation")
def _(t: Tables) -> DataFrame:
    html = F.concat(F.lit('<div class="poem"><div class="stanza"><span class="i0">On <i>'), "n_name", F.lit('</i></span><br/><span class="i2">and  on</span></div><p>no</p><div class="stanza"><div><span>the end</span></div><span> </span></div></div>'))
    return S.parse_structured(t.nation.select("n_nationkey", html.alias("html")), "n_nationkey", "html")


@query("s12_anthology", "SELECT 'book' AS key, r_name AS part, n_name AS title, unnest([0, 1]) AS stanza, unnest([['On ' || n_name, 'and on'], ['last']]) AS lines FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def _(t: Tables) -> DataFrame:
    """Poets are second-level headings, poems third-level ones; the list of contents and one poet are skipped."""
    poem = F.concat(F.lit("<h3>"), "n_name", F.lit('</h3><p>a note</p><div class="stanza"><span class="i0">On '), "n_name", F.lit('</span><br><span class="i2">and on</span></div><div class="stanza"><span>last</span></div>'))
    poets = joined(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", poem.alias("poem")), "r_name", "n_name", "poem")
    poets = poets.select(F.lit("book").alias("book"), "r_name", F.concat(F.lit("<h2>"), "r_name", F.lit("</h2><p class='dtt'>1500-1600</p>"), "html").alias("poet"))
    book = joined(poets, "book", "r_name", "poet", "<html><head><title>x</title></head><body><h2>CONTENTS</h2><div class='stanza'><span>no poem</span></div>", "</body></html>")
    h = lambda kind: F.col("kind") == kind
    found = parse("anthology", book, "book", is_title=h("h3"), is_part=h("h2"), skipped_parts=["Contents", "Asia"])
    return found.select("key", "part", "title", "stanza", "lines")


def epub(documents: list[tuple[str, str]], spine: list[int]) -> bytes:
    """An EPUB whose spine names the documents in another order than their names."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{k}" href="{name}"/>' for k, (name, _) in enumerate(documents))
        z.writestr("OEBPS/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine>{"".join(f"<itemref idref=%si{k}%s/>" % (chr(34), chr(34)) for k in spine)}</spine></package>')
        for name, html in documents:
            z.writestr(f"OEBPS/{name}", html)
    return out.getvalue()


@query("s16_s20_epub_anthology", "SELECT r_regionkey || '.epub' AS file, r_name AS part, n_name AS title, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name DESC) - 1)::INT AS place FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 2")
def _(t: Tables) -> DataFrame:
    """Books whose contents link to the poet's heading; poems follow in the order of the spine, translations are dropped."""
    at = scratch(t)
    nations = sorted(((r.n_name, r.n_nationkey, r.n_regionkey) for r in t.nation.collect()), reverse=True)
    for region in t.region.collect():  # five small files
        front = f'<h1>Contents of the Collection</h1><p class="p19"><a href="#poet">x</a></p><h1>Alphabetical list</h1><p><a href="#no">y</a></p><div><a id="poet"></a><h2>{region.r_name}</h2></div>'
        poems = [(f"c{len(nations) - i:02d}.html", f'<h2><a id="no"></a>{name}</h2>' + ("<p>Translated by John X</p>" if key % 5 == 2 else "") + "<p>first<br/>second</p>") for i, (name, key, of) in enumerate(nations) if of == region.r_regionkey]
        documents = [*poems, ("a_front.html", front)]
        put_bytes(t, f"{at}/{region.r_regionkey}.epub", epub(documents, [len(poems), *range(len(poems))]))
    put_bytes(t, f"{at}/broken.epub", b"no zip")
    elements = B.book_elements(B.read_epubs(t.spark, at))
    listed = B.contents_anchors(elements, F.startswith("text", F.lit("Contents")), F.startswith("text", F.lit("Alphabetical")))
    marked = B.with_anchor_flag(elements, listed)
    heading = F.col("kind") == "h2"
    found = B.sections(marked, is_title=heading & ~F.col("listed"), is_part=heading & F.col("listed")).filter("title IS NOT NULL")
    from pyspark.sql import Window

    from ..functions.text import translator

    poems = found.groupBy("key", "part", "section", "title").agg(F.max(translator(F.col("text"))).alias("by"), F.bool_or(B.is_verse(F.col("kind"), F.col("text"))).alias("verse")).filter("by IS NULL AND verse")
    place = F.row_number().over(Window.partitionBy("key").orderBy("section")) - 1
    return poems.select(F.col("key").alias("file"), "part", "title", place.cast("int").alias("place"))


@query("s17_single_poet", """SELECT r_regionkey::VARCHAR AS key, CASE WHEN r_regionkey % 2 = 0 THEN 'nested' ELSE 'flat' END AS structure, CASE WHEN r_regionkey % 2 = 0 THEN 'Works' END AS part, n_name AS title, 0 AS stanza, ['a ' || n_name, 'b'] AS lines FROM nation JOIN region ON n_regionkey = r_regionkey""")
def _(t: Tables) -> DataFrame:
    poem = F.concat(F.lit("<h2 class='x'>"), "n_name", F.lit("</h2><p>a "), "n_name", F.lit("<br>b</p><p>a single line</p>"))
    books = joined(t.nation.select("n_regionkey", "n_name", poem.alias("poem")), "n_regionkey", "n_name", "poem")
    books = books.withColumn("html", F.when(F.col("n_regionkey") % 2 == 0, F.concat(F.lit("<h2 class='h1 y'>Works</h2><p>about<br>them</p>"), "html")).otherwise(F.col("html")))
    return parse("book", books, "n_regionkey").drop("section")


@query("s18_essays", "SELECT n_regionkey::VARCHAR AS key, n_name AS title, unnest([0, 1]) AS place, unnest(['First of ' || n_name || '.', 'Second, over lines.']) AS paragraph FROM nation WHERE contains(lower(n_name), 'n_1') OR contains(lower(n_name), '_2')")
def _(t: Tables) -> DataFrame:
    essay = F.concat(F.lit("<h1>"), "n_name", F.lit("</h1><p>First of "), "n_name", F.lit(".</p><pre>verse</pre><p></p><p>Second,<br> over lines.</p>"))
    books = joined(t.nation.select("n_regionkey", "n_name", essay.alias("essay")), "n_regionkey", "n_name", "essay")
    return parse("essays", books, "n_regionkey", is_title=F.col("kind") == "h1", selected=["n_1", "_2"]).drop("section")


@query("s19_mixed", "SELECT n_regionkey::VARCHAR AS key, n_name AS title, unnest([0, 1, 2]) AS run, unnest(['prose', 'verse', 'prose']) AS mode, unnest([['One.', 'Two.'], ['a' || chr(10) || 'b'], ['Three ' || n_name]]) AS texts FROM nation")
def _(t: Tables) -> DataFrame:
    work = F.concat(F.lit("<h1>"), "n_name", F.lit("</h1><p>One.</p><p>Two.</p><p>a<br>b</p><p>Three "), "n_name", F.lit("</p>"))
    books = joined(t.nation.select("n_regionkey", "n_name", work.alias("work")), "n_regionkey", "n_name", "work")
    return parse("mixed", books, "n_regionkey", is_title=F.col("kind") == "h1").drop("section")


EXPORT = "Documents 1 of 9\nFull text:\nTITLE\n[Page 7]\nan epigraph\nTITLE 1   first BODY\n2   second\n[3] a footnote\n\n3   third\nunnumbered\nII 4   fourth\n\nNOTES\n9   no verse\nTitle: TITLE\nAuthor: x"


@query("s21_exports", "SELECT n_regionkey::VARCHAR AS key, n_name AS title, unnest([0, 1, 2]) AS stanza, unnest([NULL, NULL, 'II']) AS numeral, unnest([['first ' || lower(n_name), 'second'], ['third', 'unnumbered'], ['fourth']]) AS lines FROM nation")
def _(t: Tables) -> DataFrame:
    block = F.concat(F.lit("\n"), F.replace(F.replace(F.lit(EXPORT), F.lit("TITLE"), F.col("n_name")), F.lit("BODY"), F.lower("n_name")), F.lit("\n\n____________\n"))
    files = joined(t.nation.select("n_regionkey", "n_name", block.alias("block")), "n_regionkey", "n_name", "block", "no poem here\n____________\n").withColumnRenamed("html", "text")
    return parse("export", files, "n_regionkey").drop("block")


@query("s22_page_slices", """SELECT CASE WHEN p_partkey % 100 BETWEEN 10 AND 19 THEN 'first' ELSE 'second' END AS section, p_partkey, p_partkey % 100 AS number FROM part WHERE p_partkey % 100 BETWEEN 10 AND 19 OR p_partkey % 100 BETWEEN 40 AND 42""")
def _(t: Tables) -> DataFrame:
    ranges = t.spark.createDataFrame([("first", 10, 19), ("second", 40, 42), ("none", 9, 3)], "section string, first int, last int")
    pages = t.part.select("p_partkey", F.concat((F.col("p_partkey") % 100).cast("string"), F.lit("-verso")).alias("page_id"))
    return B.page_slices(pages, ranges).select("section", "p_partkey", F.col("number").cast("long").alias("number"))


@query("s22_page_poems", "SELECT 'region ' || n_regionkey AS key, n_name AS title, unnest([0, 1]) AS stanza, unnest([['a', 'b'], ['over the page']]) AS lines FROM nation")
def _(t: Tables) -> DataFrame:
    """A poem begins on one page and ends on the next, before the next heading."""
    pages = t.nation.select("n_nationkey", F.concat(F.lit("region "), "n_regionkey").alias("section"), F.inline(F.array(
        F.struct((F.col("n_nationkey") * 2).alias("number"), F.concat(F.lit("<h4>"), "n_name", F.lit("</h4><p>a<br/>b</p>")).alias("contents")),
        F.struct((F.col("n_nationkey") * 2 + 1).alias("number"), F.lit("<p>over the page</p>").alias("contents")),
    )))
    return B.page_poems(pages, "h4").drop("section")


@query("s23_stanzas", "SELECT n_nationkey::VARCHAR AS key, unnest([['a', 'b'], ['in a block']]) AS lines FROM nation")
def _(t: Tables) -> DataFrame:
    return parse("html", t.nation.select("n_nationkey", F.lit("<h2>t</h2><p>a<br>b</p><p>prose</p><div class='stanza'><span>in a block</span></div>").alias("html")), "n_nationkey").select("key", "lines")


@query("s25_strategies", "SELECT 'text ' || n_name AS text, CASE WHEN n_regionkey = 0 THEN 'unknown' WHEN n_regionkey % 2 = 1 THEN 'deck' ELSE 'own' END AS source FROM nation")
def _(t: Tables) -> DataFrame:
    at, rows = scratch(t), sorted((r.n_regionkey, r.n_name) for r in t.nation.collect())
    lines = ["# Title"]
    for region in range(5):
        lines += ([f"## {'The ENO cards' if region % 2 else 'Others'}"] if region else []) + [f"  - text {name} " for r, name in rows if r == region] + ["plain", ""]
    put_file(t, f"{at}/deck.md", "\n".join(lines))
    return B.read_strategies(t.spark, at, ("eno", "schmidt"), "deck", "own").select("text", "source")


@query("s25_overrides", "SELECT n_nationkey::VARCHAR AS id, 'On ' || n_name AS head, NULL::VARCHAR AS stand FROM nation")
def _(t: Tables) -> DataFrame:
    at = scratch(t)
    entries = t.nation.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.struct(F.concat(F.lit("On "), "n_name").alias("head"))))))).first()[0]
    put_file(t, f"{at}/overrides.json", entries[:-1].replace(",", ",\n") + ', "_groups": {"head": "no entry"}}')
    return S.read_overrides(t.spark, at, "struct<head:string,stand:string>")


@query("s25_settings", "SELECT 'responses.per_hour' AS name, '10' AS value UNION ALL SELECT 'chunking.min_tokens', '50' UNION ALL SELECT 'keywords', 'poem,verse'")
def _(t: Tables) -> DataFrame:
    at = scratch(t)
    put_file(t, f"{at}/config.yaml", "# settings\nresponses:\n  per_hour: 10\nchunking: {min_tokens: 50}\nkeywords:\n  - poem\n  - verse\n")
    found = B.read_settings(t.spark, at)
    rows = [("responses.per_hour", str(found["responses"]["per_hour"])), ("chunking.min_tokens", str(found["chunking"]["min_tokens"])), ("keywords", ",".join(found["keywords"]))]
    return t.spark.createDataFrame(rows, "name string, value string")


@query("s27_collection", "SELECT v.vec_id, v.poet, c.title FROM vectors v LEFT JOIN chunks c ON c.chunk_id = v.vec_id")
def _(t: Tables) -> DataFrame:
    return V.collection(t.vectors, t.chunks.select(F.col("chunk_id").alias("vec_id"), "title")).select("vec_id", "poet", "title")


@query("j21_append_sections", "SELECT n_regionkey::VARCHAR AS key, n_name AS title, unnest([0, 1, 2]) AS place, unnest([['a'], ['b'], ['more']]) AS lines FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_regionkey::VARCHAR, n_name, 0, ['more'] FROM nation WHERE n_nationkey % 2 = 1")
def _(t: Tables) -> DataFrame:
    names = t.nation.select("n_nationkey", F.col("n_regionkey").cast("string").alias("key"), F.col("n_name").alias("title"))
    poems = names.filter("n_nationkey % 2 = 0").select("key", "title", F.posexplode(F.array(F.array(F.lit("a")), F.array(F.lit("b")))).alias("place", "lines"))
    return B.append_sections(poems, names.select("key", "title", F.lit(0).alias("place"), F.array(F.lit("more")).alias("lines")))


@query("k02_one_file_each", "SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY n_regionkey")
def _(t: Tables) -> DataFrame:
    """One intermediate document for each work, read again as works."""
    at = scratch(t)
    works = t.nation.groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("title"))).alias("poems"))
    S.write_by_key(works, at, "n_regionkey")
    found = t.spark.read.schema(f"poems {S.POEMS}, n_regionkey int").json(at)
    return found.select(F.col("n_regionkey").alias("region"), F.size("poems").cast("long").alias("n"))


@query("k09_file_drop", "SELECT strftime(ts, '%Y%m%d-%H%M%S') || '-' || replace(stimulus, ' ', '-') || '.md' AS name, stimulus AS text FROM interactions WHERE id % 250 = 0")
def _(t: Tables) -> DataFrame:
    """Clips as files of their own, named by time and title, and read again."""
    from ..streaming.pipelines import drop_clips

    at = scratch(t)
    drop_clips(t.interactions.filter("id % 250 = 0").select(F.col("ts").alias("at"), F.col("stimulus").alias("title"), F.col("stimulus").alias("text")), at)
    return t.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(at, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.col("value").alias("text"))
