"""Batch sources (S) and sinks (K): explicit schemas, defined file order, bad rows set apart instead of failing a job."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SCHEMA = (
    "chunk_id string, poet string, work string, poem_title string, date int, form string, period string, themes array<string>, chunk_text string, "
    "chunk_index int, line_range string, stanza_range string, source string, tcp_id string, speaker string, type string, genre string"
)
POEMS = "array<struct<title:string,div_type:string,speaker:string,stanzas:array<struct<stanza_num:string,lines:array<string>>>>>"
WORK_SCHEMA = f"author string, title string, date string, source string, tcp_id string, poems {POEMS}"
PROSE_SCHEMA = "source_file string, author string, date string, type string, genre string, essays array<struct<title:string,collection:string,paragraphs:array<string>>>"


def read_jsonl(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    """JSON lines; blank and malformed lines are dropped; ``file`` and ``_metadata`` order the rows across files."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def read_works(spark: SparkSession, path: str, schema: str = WORK_SCHEMA) -> DataFrame:
    """One JSON object a file; files that hold a list or something else are left out."""
    texts = spark.read.text(path, wholetext=True).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    parsed = texts.filter(F.col("value").rlike(r"^\s*\{")).select("file", F.from_json("value", schema).alias("w"))
    return parsed.filter("w IS NOT NULL").select("file", "w.*")


def poem_lines(works: DataFrame, key: str = "file") -> DataFrame:
    """(key, poem, stanza, line numbers from 0, text): the tree of a work as rows, order kept in the numbers."""
    poems = works.select(key, F.posexplode("poems").alias("poem", "p"))
    stanzas = poems.select(key, "poem", F.col("p.title").alias("title"), F.posexplode("p.stanzas").alias("stanza", "s"))
    return stanzas.select(key, "poem", "title", "stanza", F.posexplode("s.lines").alias("line_no", "line"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; a byte-order mark before it is ignored; the id column may be named in three ways."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    rows = rows.toDF(*[c.replace("﻿", "").strip() for c in rows.columns])
    named = next(c for c in ("TCP_ID", "TCP ID", "TCP") if c in rows.columns)
    return rows.withColumnRenamed(named, "TCP_ID")


def read_overrides(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """A JSON object as rows (id, fields); keys that start with an underscore are not entries."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.map_filter(F.from_json("value", f"map<string,{value_schema}>"), lambda k, _: ~F.startswith(k, F.lit("_")))
    return whole.select(F.explode(entries).alias("id", "v")).select("id", "v.*")


# TEI: mixed content needs a parser; one Arrow-batched pass over whole files.


def _local(tag: object) -> str:
    return tag.rsplit("}", 1)[-1].lower() if isinstance(tag, str) else ""


def _line_text(node: ET.Element) -> str:
    parts: list[str] = []

    def visit(x: ET.Element) -> None:
        name = _local(x.tag)
        if name == "gap":
            parts.append("[...]")
        elif name != "note":
            parts.append(x.text or "")
            for child in x:
                visit(child)
                parts.append(child.tail or "")

    visit(node)
    return " ".join("".join(parts).replace("-\n", "").replace("ſ", "s").split())


def tei_rows(xml: str) -> list[tuple[str, str, int, int, str]]:
    """(title, speaker, stanza, line, text) of all verse of a TEI document: lines in groups, and speeches of four lines or more."""
    out: list[tuple[str, str, int, int, str]] = []
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return out

    def own_head(div: ET.Element) -> str:
        return next((_line_text(c) for c in div if _local(c.tag) == "head"), "")

    def walk(node: ET.Element, title: str) -> None:
        stanza = 0
        for child in node:
            name = _local(child.tag)
            if name == "lg":
                lines = [_line_text(x) for x in child.iter() if _local(x.tag) == "l"]
                out.extend((title, "", stanza, i, text) for i, text in enumerate(lines))
                stanza += 1
            elif name == "sp":
                lines = [text for x in child.iter() if _local(x.tag) == "l" and (text := _line_text(x))]
                if len(lines) >= 4:
                    who = next((_line_text(x) for x in child if _local(x.tag) == "speaker"), "")
                    out.extend((title, who, stanza, i, text) for i, text in enumerate(lines))
                    stanza += 1
            elif name.startswith("div"):
                walk(child, own_head(child) or title)
            elif name in ("text", "body", "group", "front", "back"):
                walk(child, title)

    walk(root, "")
    return out


def parse_tei(files: DataFrame, key: str, xml: str) -> DataFrame:
    """Verse lines of TEI documents; documents that don't parse give no rows."""

    def parse(batches):
        for pdf in batches:
            rows = [(k, *r) for k, x in zip(pdf[key], pdf[xml]) for r in tei_rows(x or "")]
            yield pd.DataFrame(rows, columns=["key", "title", "speaker", "stanza", "line_no", "line"])

    return files.select(F.col(key).cast("string").alias(key), xml).mapInPandas(parse, "key string, title string, speaker string, stanza int, line_no int, line string")


# HTML: flat patterns are expressions; nested stanza divisions use the standard parser.


def html_pattern(html: Column) -> Column:
    """Structured stanzas if there are any, else the commoner of preformatted and plain paragraphs."""
    pre, plain = F.regexp_count(html, F.lit("(?i)<pre")), F.regexp_count(html, F.lit(r'(?i)<p[^>]*class="[^"]*noindent'))
    return F.when(html.rlike(r'(?i)class="stanza"'), "structured").when(pre > plain, "pre").otherwise("noindent")


def noindent_lines(html: Column) -> Column:
    """Paragraphs as stanzas, ``<br>`` between lines: array of arrays."""
    paragraphs = F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    line = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", ""), r"\s+", " "))
    return F.filter(F.transform(paragraphs, lambda p: F.filter(F.transform(F.split(p, r"(?i)<br\s*/?>"), line), lambda x: x != "")), lambda s: F.size(s) > 0)


def pre_lines(html: Column) -> Column:
    """Preformatted blocks, blank lines between stanzas: array of arrays."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<pre\b[^>]*>(.*?)</pre>"), F.lit(1))
    stanzas = F.flatten(F.transform(blocks, lambda b: F.split(F.regexp_replace(b, "<[^>]+>", ""), r"\n\s*\n")))
    return F.filter(F.transform(stanzas, lambda s: F.filter(F.transform(F.split(s, "\n"), lambda x: F.rtrim(x)), lambda x: x != "")), lambda s: F.size(s) > 0)


class _Stanzas(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.depth, self.found, self.line = 0, [], None

    def handle_starttag(self, tag, attrs):
        kinds = (dict(attrs).get("class") or "").split()
        if tag == "div":
            if self.depth or "stanza" in kinds:
                self.depth += 1
                if self.depth == 1:
                    self.found.append([])
        elif tag == "span" and self.depth:
            self.line = ""

    def handle_endtag(self, tag):
        if tag == "div" and self.depth:
            self.depth -= 1
        elif tag == "span" and self.line is not None:
            if self.line.strip():
                self.found[-1].append(" ".join(self.line.split()))
            self.line = None

    def handle_data(self, data):
        if self.line is not None:
            self.line += data


def structured_stanzas(html: str) -> list[list[str]]:
    """Stanza divisions with a span for each line."""
    parser = _Stanzas()
    parser.feed(html or "")
    return [s for s in parser.found if s]


def parse_structured(pages: DataFrame, key: str, html: str) -> DataFrame:
    def parse(batches):
        for pdf in batches:
            rows = [(str(k), i, line) for k, x in zip(pdf[key], pdf[html]) for i, s in enumerate(structured_stanzas(x)) for line in s]
            yield pd.DataFrame(rows, columns=["key", "stanza", "line"])

    return pages.select(key, html).mapInPandas(parse, "key string, stanza int, line string")


def delimited_blocks(text: Column, mark: str = r"(?m)^(?:---|_{10,})\s*$") -> Column:
    """Blocks between delimiter lines, blank ones dropped."""
    return F.filter(F.transform(F.split(text, mark), lambda b: F.trim(b, F.lit("\n "))), lambda b: b != "")


def write_by_key(rows: DataFrame, path: str, key: str, fmt: str = "json") -> None:
    """One folder for each key, in one partitioned write."""
    rows.write.mode("overwrite").partitionBy(key).format(fmt).save(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    """K05."""
    rows.write.mode("overwrite").option("header", "true").csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    """K06."""
    rows.write.mode("append").json(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of their id; applying it twice changes nothing. Of repeated new ids, the last by all columns counts."""
    last = new.groupBy(key).agg(F.max(F.struct(*[c for c in new.columns if c != key])).alias("_r")).select(key, "_r.*")
    return old.join(last, key, "left_anti").unionByName(last.select(*old.columns))


def feed(entries: DataFrame, n: int = 20) -> DataFrame:
    """The newest entries of a feed."""
    return entries.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)
