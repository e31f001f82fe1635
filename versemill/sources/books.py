"""Books as HTML, EPUB and exports (S03, S07, S12, S16-S23, S25): one parser from markup to elements, and DataFrame operators over elements.

A parser turns each document into elements in order (``html_elements``); which of them are parts, titles, verse or prose is said
by predicates over the elements' columns, so an anthology, a single poet's book and a volume of essays differ only in those.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import filters as L
from ..operators import sequence as W
from .plaintext import PARSERS
from .readers import read_jsonl

ELEMENT = "key string, pos int, kind string, class string, anchors array<string>, links array<string>, text string"


class _Elements(HTMLParser):
    """Blocks in document order. A line break, the end of a span in a stanza, and a line of preformatted text end a line."""

    BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "li", "blockquote")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, list[str], list[str], str]] = []
        self.open: tuple[str, str, list[str], list[str]] | None = None
        self.text: list[str] = []
        self.waiting: list[str] = []  # anchors that stand before the next block
        self.depth = self.silent = 0

    def close_block(self) -> None:
        if self.open:
            raw = "".join(self.text)
            lines = [x.rstrip() if self.open[0] == "pre" else " ".join(x.split()) for x in raw.split("\n")]
            if self.open[0] != "pre":
                lines = [x for x in lines if x]
            self.found.append((*self.open, "\n".join(lines).strip("\n")))
        self.open, self.text, self.depth = None, [], 0

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        kinds = (given.get("class") or "").split()
        anchor = [given["id"]] if given.get("id") else []
        if tag in ("script", "style", "head"):
            self.silent += 1
        elif tag == "br":
            self.text.append("\n")
        elif self.open and self.open[0] == "stanza":
            self.depth += tag == "div"
            self.open[2].extend(anchor)
        elif tag == "div" and "stanza" in kinds:
            self.close_block()
            self.open, self.waiting, self.depth = ("stanza", " ".join(kinds), self.waiting + anchor, []), [], 1
        elif tag in self.BLOCKS:
            self.close_block()
            self.open, self.waiting = (tag, " ".join(kinds), self.waiting + anchor, []), []
        elif anchor:
            (self.open[2] if self.open else self.waiting).extend(anchor)
        if tag == "a" and self.open and given.get("href"):
            self.open[3].append(given["href"])

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.silent = max(0, self.silent - 1)
        elif self.open and self.open[0] == "stanza":
            if tag == "span":
                self.text.append("\n")
            self.depth -= tag == "div"
            if self.depth <= 0:
                self.close_block()
        elif self.open and tag == self.open[0]:
            self.close_block()

    def handle_data(self, data):
        if self.open and not self.silent:
            self.text.append(data if self.open[0] == "pre" else data.replace("\n", " "))


def elements_of(html: str) -> list[tuple[str, str, list[str], list[str], str]]:
    """(kind, class, anchors, links, text) of each block; lines of a block are parted by newlines."""
    parser = _Elements()
    parser.feed(html or "")
    parser.close()
    parser.close_block()
    return parser.found


def html_elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, kind, class, anchors, links, text): the blocks of each document, a document parsed in one go; null has none."""

    def parse(batches):
        for pdf in batches:
            rows = [(k, i, *e) for k, x in zip(pdf[key], pdf[html]) for i, e in enumerate(elements_of(x))]
            yield pd.DataFrame(rows, columns=["key", "pos", "kind", "class", "anchors", "links", "text"])

    return pages.select(F.col(key).cast("string").alias(key), html).mapInPandas(parse, ELEMENT)


def epub_documents(content: bytes) -> list[tuple[str, str]]:
    """(name, html) of an EPUB in reading order: the order of its package's spine, then documents that the spine leaves out, by name."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = [n for n in sorted(z.namelist()) if n.lower().endswith((".html", ".xhtml", ".htm"))]
            spine = [n for n in _spine(z) if n in names]
            return [(n, z.read(n).decode("utf-8", "replace")) for n in [*spine, *(n for n in names if n not in spine)]]
    except zipfile.BadZipFile:
        return []


def _spine(z: zipfile.ZipFile) -> list[str]:
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    try:
        container = ET.fromstring(z.read("META-INF/container.xml"))
        package = next(e.get("full-path") for e in container.iter() if local(e) == "rootfile")
        tree, folder = ET.fromstring(z.read(package)), package.rpartition("/")[0]
    except (KeyError, ET.ParseError, StopIteration):
        return []
    held = {e.get("id"): e.get("href") for e in tree.iter() if local(e) == "item"}
    return [f"{folder}/{held[i]}".lstrip("/") for e in tree.iter() if local(e) == "itemref" and (i := e.get("idref")) in held]


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, name, html) of all documents in EPUB files; a file that is no zip has none."""

    def parse(batches):
        for pdf in batches:
            rows = [(p.rsplit("/", 1)[-1], i, n, h) for p, c in zip(pdf.path, pdf.content) for i, (n, h) in enumerate(epub_documents(bytes(c)))]
            yield pd.DataFrame(rows, columns=["file", "place", "name", "html"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, place int, name string, html string")


def book_elements(books: DataFrame) -> DataFrame:
    """Elements of whole books from ``read_epubs``: the documents of a file one after the other, ``pos`` running through."""
    each = html_elements(books.select(F.concat_ws("\t", "file", F.format_string("%06d", "place")).alias("key"), "html"), "key", "html")
    parts = F.split("key", "\t")
    in_order = Window.partitionBy("_file").orderBy("key", "pos")
    return each.withColumn("_file", parts[0]).withColumn("pos", (F.row_number().over(in_order) - 1).cast("int")).withColumn("key", F.col("_file")).drop("_file")


def contents_anchors(elements: DataFrame, starts: Column, ends: Column) -> DataFrame:
    """(key, anchor): where the links between the heading of the contents and the heading that ends them lead."""
    inside = W.islands(elements, "key", "pos", starts | ends, "_i").withColumn("_open", F.max(F.when(starts, F.col("_i"))).over(Window.partitionBy("key")))
    return inside.filter(F.col("_i") == F.col("_open")).select("key", F.explode("links").alias("link")).filter(F.startswith("link", F.lit("#"))).select("key", F.expr("substring(link, 2)").alias("anchor")).distinct()


def with_anchor_flag(elements: DataFrame, anchors: DataFrame, flag: str = "listed") -> DataFrame:
    """Marks the elements that hold one of the anchors."""
    held = anchors.groupBy("key").agg(F.collect_set("anchor").alias("_held"))  # as many as a book's contents have entries
    return elements.join(held, "key", "left").withColumn(flag, F.coalesce(F.arrays_overlap("anchors", "_held"), F.lit(False))).drop("_held")


def sections(elements: DataFrame, *, is_title: Column, is_part: Column | None = None) -> DataFrame:
    """Elements with the part (poet, collection) and title they stand under; headings themselves go.

    A part heading ends the title before it. What stands before the first title has a null title.
    """
    part = F.lit(False) if is_part is None else is_part
    x = W.forward_fill(elements, "key", "pos", part, F.col("text"), "part")
    x = W.islands(x, "key", "pos", part | is_title, "section")
    x = x.withColumn("title", F.max(F.when(is_title & ~part, F.col("text"))).over(Window.partitionBy("key", "section")))
    return x.filter(~(part | is_title))


def anthology(elements: DataFrame, *, is_title: Column, is_part: Column, skipped_parts: list[str] = ()) -> DataFrame:
    """(key, part, section, title, stanza, lines): verse of every poet. Stanzas are stanza blocks, or blocks of two lines or more."""
    found = sections(elements, is_title=is_title, is_part=is_part).filter(F.col("title").isNotNull() & F.col("part").isNotNull())
    found = found.filter(~F.upper("part").isin([p.upper() for p in skipped_parts]) & is_verse(F.col("kind"), F.col("text")))
    stanza = F.row_number().over(Window.partitionBy("key", "section").orderBy("pos")) - 1
    return found.select("key", "part", "section", "title", stanza.cast("int").alias("stanza"), F.split("text", "\n").alias("lines"))


def is_verse(kind: Column, text: Column) -> Column:
    """A stanza block, preformatted text, or a block of two lines or more."""
    return kind.isin("stanza", "pre") | F.contains(text, F.lit("\n"))


def book_structure(elements: DataFrame) -> DataFrame:
    """(key, structure): nested if second-level headings are marked as first-level ones, else flat."""
    nested = F.bool_or((F.col("kind") == "h2") & F.array_contains(F.split("class", " "), "h1"))
    return elements.groupBy("key").agg(F.when(nested, "nested").otherwise("flat").alias("structure"))


def single_poet(elements: DataFrame) -> DataFrame:
    """(key, structure, part, section, title, stanza, lines) by each book's own structure: in nested books headings marked ``h1`` are
    collections and the other second-level ones titles; in flat books every second-level heading is a title."""
    marked = elements.join(book_structure(elements), "key")
    heading = F.col("kind") == "h2"
    collection = heading & (F.col("structure") == "nested") & F.array_contains(F.split("class", " "), "h1")
    found = sections(marked, is_title=heading & ~collection, is_part=collection).filter(F.col("title").isNotNull() & is_verse(F.col("kind"), F.col("text")))
    stanza = F.row_number().over(Window.partitionBy("key", "section").orderBy("pos")) - 1
    return found.select("key", "structure", "part", "section", "title", stanza.cast("int").alias("stanza"), F.split("text", "\n").alias("lines"))


def essays(elements: DataFrame, *, is_title: Column, selected: list[str] | None = None) -> DataFrame:
    """(key, section, title, place, paragraph): prose under each title; of titles only those that contain one of ``selected``, in any case."""
    found = sections(elements, is_title=is_title).filter(F.col("title").isNotNull() & (F.col("kind") == "p") & (F.col("text") != ""))
    if selected is not None:
        found = found.filter(L.contains_any(F.col("title"), selected))
    place = F.row_number().over(Window.partitionBy("key", "section").orderBy("pos")) - 1
    return found.select("key", "section", "title", place.cast("int").alias("place"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("paragraph"))


def mixed(elements: DataFrame, *, is_title: Column) -> DataFrame:
    """(key, section, title, run, mode, texts): under each title, neighbouring blocks of one kind together, verse or prose."""
    found = sections(elements, is_title=is_title).filter(F.col("title").isNotNull() & (F.col("text") != "")).withColumn("mode", F.when(is_verse(F.col("kind"), F.col("text")), "verse").otherwise("prose"))
    by = Window.partitionBy("key", "section").orderBy("pos")
    changed = F.coalesce(F.col("mode") != F.lag("mode").over(by), F.lit(False)).cast("int")
    runs = found.withColumn("_c", changed).withColumn("run", F.sum("_c").over(by).cast("int"))
    gathered = runs.groupBy("key", "section", "title", "run", "mode").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("_t"))
    return gathered.select("key", "section", "title", "run", "mode", F.transform("_t", lambda x: x["text"]).alias("texts"))


# Exports of a text database: blocks between rules, each with a marker, numbered verse lines, notes and metadata.

MARKER, TITLE, NOTES, PAGE, FOOTNOTE, NUMBERED, ROMAN = r"^Full text:\s*", r"^Title:\s*(.+)$", r"^NOTES\s*$", r"^\[Page \d+\]$", r"^\[\d+\]\s", r"^(\d+)\s{2,}(.+)$", r"^([IVXLCDM]+)\.?\s+(\d+\s{2,}.+)$"


def exported_poems(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, block, title, stanza, numeral, lines): poems of export files.

    Verse stands after the line ``Full text:`` up to the notes or the title line; page marks, footnotes and the title said again
    go, numbers of lines are cut off, and a blank line or a Roman numeral before a numbered line begins a stanza. Lines without
    a number count only once a numbered one was there. Blocks without marker, title or verse give nothing.
    """
    blocks = files.select(F.col(key).cast("string").alias("key"), F.posexplode(F.split(text, r"\n_{10,}\n", -1)).alias("block", "text"))
    lines = L.lines(blocks.withColumn("_k", F.struct("key", "block")), "_k").select("_k.key", "_k.block", "pos", "line")
    whole, up_to = Window.partitionBy("key", "block"), Window.partitionBy("key", "block").orderBy("pos").rowsBetween(W.FIRST, 0)
    said = F.trim("line")
    titled = lines.withColumn("title", F.trim(F.min_by(F.regexp_extract("line", TITLE, 1), F.when(F.col("line").rlike(TITLE), F.col("pos"))).over(whole)))
    started = titled.withColumn("_from", F.min(F.when(F.col("line").rlike(MARKER), F.col("pos"))).over(whole)).filter(F.col("pos") > F.col("_from"))
    stops = said.rlike(NOTES) | said.rlike(TITLE)
    verse = started.withColumn("_stop", F.sum(stops.cast("int")).over(up_to)).filter("_stop = 0 AND title <> ''")
    verse = verse.filter(~(said.rlike(PAGE) | said.rlike(FOOTNOTE) | (F.upper(said) == F.upper("title"))))
    bare = F.when(F.startswith(F.upper(said), F.concat(F.upper("title"), F.lit(" "))), F.ltrim(F.substring(said, F.length("title") + 1, F.length(said)))).otherwise(said)
    verse = verse.withColumn("line", bare).withColumn("numeral", F.nullif(F.regexp_extract("line", ROMAN, 1), F.lit("")))
    verse = verse.withColumn("line", F.when(F.col("numeral").isNotNull(), F.regexp_extract("line", ROMAN, 2)).otherwise(F.col("line")))
    verse = verse.withColumn("_numbered", F.col("line").rlike(NUMBERED)).withColumn("_seen", F.max("_numbered").over(up_to)).filter("_seen")
    breaks = (F.col("line") == "") | F.col("numeral").isNotNull()
    verse = verse.withColumn("_cut", F.sum(breaks.cast("int")).over(up_to)).filter("line <> ''")
    text_of = F.when(F.col("_numbered"), F.regexp_extract("line", NUMBERED, 2)).otherwise(F.col("line"))
    stanzas = verse.groupBy("key", "block", "title", "_cut").agg(F.max("numeral").alias("numeral"), F.transform(F.sort_array(F.collect_list(F.struct("pos", text_of.alias("line")))), lambda x: x["line"]).alias("lines"))
    place = F.row_number().over(Window.partitionBy("key", "block").orderBy("_cut")) - 1
    return stanzas.select("key", "block", "title", place.cast("int").alias("stanza"), "numeral", "lines")


def page_slices(pages: DataFrame, ranges: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Pages of the sections whose range (section, first, last) holds the number their id begins with. Ranges are spelt out, so the join is an equality."""
    wanted = ranges.filter("first <= last").select("section", F.explode(F.sequence("first", "last")).alias("_n"))
    return pages.withColumn("_n", L.number_prefix(F.col(page_id))).join(wanted, "_n").withColumn("number", F.col("_n")).drop("_n")


def page_poems(pages: DataFrame, heading: str, section: str = "section", number: str = "number", html: str = "contents") -> DataFrame:
    """(key, title, stanza, lines): the pages of a section in order, split at their ``heading`` elements; paragraphs are stanzas."""
    placed = pages.select(F.concat_ws("\t", section, F.format_string("%06d", number)).alias("key"), F.col(html).alias("html"))
    each = html_elements(placed, "key", "html").withColumn("_s", F.split("key", "\t")[0])
    in_order = Window.partitionBy("_s").orderBy("key", "pos")
    whole = each.withColumn("pos", F.row_number().over(in_order).cast("int")).withColumn("key", F.col("_s")).drop("_s")
    found = sections(whole, is_title=F.col("kind") == heading).filter(F.col("title").isNotNull() & (F.col("text") != ""))
    stanza = F.row_number().over(Window.partitionBy("key", "section").orderBy("pos")) - 1
    return found.select("key", "section", "title", stanza.cast("int").alias("stanza"), F.split("text", "\n").alias("lines"))


def speaker_lines(speeches: DataFrame) -> DataFrame:
    """Lines of TEI speeches (from ``parse_tei``) as dialogue: the first line of each speech carries its speaker in brackets."""
    first = (F.col("line_no") == 0) & (F.col("speaker") != "")
    return speeches.withColumn("line", F.when(first, F.concat(F.lit("["), "speaker", F.lit("] "), "line")).otherwise(F.col("line")))


def read_line_corpus(spark: SparkSession, path: str, longer_than: int = 5) -> DataFrame:
    """Lines of an ndjson corpus, one object with ``s`` each; malformed rows and lines of up to ``longer_than`` characters go."""
    return read_jsonl(spark, path, "s string").filter(F.length("s") > longer_than)


def read_strategies(spark: SparkSession, path: str, marks: tuple[str, ...], listed: str, other: str) -> DataFrame:
    """(pos, text, source) of a markdown deck: list items under second-level headings; headings with one of ``marks`` give ``listed``, others ``other``."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    lines = L.lines(whole, "file").withColumn("line", F.trim("line"))
    heading = F.startswith("line", F.lit("## "))
    source = F.when(L.contains_any(F.col("line"), list(marks)), listed).otherwise(other)
    filled = W.forward_fill(lines, "file", "pos", heading, source, "source")
    items = filled.filter(F.startswith("line", F.lit("- ")))
    return items.select("pos", F.trim(F.expr("substring(line, 3)")).alias("text"), F.coalesce("source", F.lit("unknown")).alias("source"))


def read_settings(spark: SparkSession, path: str) -> dict:
    """A YAML configuration as a dictionary; it is read through Spark, so it may lie anywhere the tables do. Needs PyYAML."""
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML settings needs PyYAML") from missing
    return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]) or {}


def append_sections(poems: DataFrame, more: DataFrame, keys: tuple[str, ...] = ("key", "title")) -> DataFrame:
    """Stanzas appended to the poem of the same title; titles without a poem become poems. Both: (keys, place, lines)."""
    both = poems.select(*keys, F.lit(0).alias("_from"), "place", "lines").unionByName(more.select(*keys, F.lit(1).alias("_from"), "place", "lines"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_from", "place")) - 1
    return both.withColumn("place", place.cast("int")).drop("_from")


def all_stanzas(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, lines): every stanza of a page, whatever its headings."""
    return html_elements(pages, key, html).filter(is_verse(F.col("kind"), F.col("text"))).select("key", "pos", F.split("text", "\n").alias("lines"))


# Kinds of sources. A poet's own module is one of these with predicates of its own.
PARSERS |= {
    "html": all_stanzas,
    "anthology": lambda pages, key, *, html="html", **options: anthology(html_elements(pages, key, html), **options),
    "book": lambda pages, key, *, html="html": single_poet(html_elements(pages, key, html)),
    "essays": lambda pages, key, *, html="html", **options: essays(html_elements(pages, key, html), **options),
    "mixed": lambda pages, key, *, html="html", **options: mixed(html_elements(pages, key, html), **options),
    "export": exported_poems,
}
