"""Edge cases: nulls, empties, ties, folds against plain Python."""

import io
import random
import re
import zipfile

from pyspark.sql import functions as F

from versemill.functions import safety, spans, text, variants
from versemill.operators import chunking, eventlog, filters, gaps, joins, retrieval, sequence
from versemill.sources import books, readers
from versemill.streaming import pipelines


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[1]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[0] for v in values.values())], schema).select(column.alias("x")).first().x


def test_authors_and_slugs(spark):
    cases = {"Herbert, George, 1593-1633.": "George Herbert", "Plain Name": "Plain Name", "Suckling, Sir, fl. 1600": "Suckling", "Philips, Katherine ('Orinda')": "Katherine Philips", "": ""}
    for raw, wanted in cases.items():
        assert one(spark, text.invert_author(F.col("a")), a=(raw, "string")) == wanted
    assert one(spark, text.slug(F.col("a")), a=("Élan  vital — II!", "string")) == "élan-vital-ii"
    assert one(spark, text.slug(F.col("a")), a=(None, "string")) is None


def test_roman_and_periods(spark):
    for n, r in ((1, "I"), (4, "IV"), (1994, "MCMXCIV"), (3999, "MMMCMXCIX")):
        assert one(spark, text.int_to_roman(F.col("n")), n=(n, "int")) == r
        assert one(spark, text.roman_to_int(F.col("r")), r=(r.lower(), "string")) == n
    assert one(spark, text.roman_to_int(F.col("r")), r=("hello", "string")) is None
    for y, p in ((1499, "medieval"), (1500, "early_modern"), (1659, "early_modern"), (1660, "restoration"), (1700, "augustan"), (1790, "romantic"), (1830, "victorian")):
        assert one(spark, text.period(F.col("d")), d=(f"c. {y}", "string")) == p
    assert one(spark, text.period(F.col("d")), d=(None, "string")) == "early_modern"
    assert one(spark, text.year(F.col("d")), d=("none", "string")) == 0


def test_safety(spark):
    near, far = "Irish " + "x" * 197 + " rebel", "Irish " + "x" * 205 + " rebel"
    for said, reason in (("the Romish\nidol", "anti-catholic"), (near, "anti-irish"), (far, ""), ("", ""), (None, ""), ("Romish idol and a fickle woman", "misogynist")):
        assert one(spark, safety.safety_reason(F.col("t")), t=(said, "string")) == reason


def test_selected_ids(spark):
    """Every shape that is known to come, (kept ids, what was dropped), against a plain reading."""
    cases = {
        '[1, "2", true, {"id": 3}]': (["1", "2", "3"], ["true"]), "[trunc": ([], ["[trunc"]), "7": ([], ["7"]), "[]": ([], []), '["x", null, 5]': (["5"], ['"x"', "null"]), '"[4, 5]"': (["4", "5"], []), '"no list"': ([], ['"no list"']),
        '[[{"id": 1}, {"x": 2}], [3]]': (["1"], ['{"x":2}', "3"]), '{"id": 1}': ([], ['{"id":1}']), '[{"id": null}, {"id": "a"}]': ([None, "a"], []), '["007", " 8 ", "1.5", "[{\\"id\\": 9}]"]': (["7", "8", "9"], ['1.5']), "": ([], [""]),
    }
    for raw, wanted in cases.items():
        found = one(spark, variants.selected(F.col("t")), t=(raw, "string"))
        assert ([k.id for k in found.kept], [d.item for d in found.dropped]) == wanted, raw
    assert one(spark, variants.selected(F.col("t")), t=(None, "string")) == ([], [])


def plain_stanzas(sizes, least, most):
    done, buffer, start = [], [], 1
    for i, s in enumerate(sizes, 1):
        buffer.append(s)
        tokens = (sum(buffer) + len(buffer) - 1) // 4
        if tokens >= least or i == len(sizes):
            if tokens > most and len(buffer) > 1:
                done.append((start, i - 1))
                buffer, start = [s], i
            else:
                done.append((start, i))
                buffer, start = [], i + 1
    return done + ([(start, len(sizes))] if buffer else [])


def plain_paragraphs(sizes, least, most):
    done, chars, start = [], 0, 1
    for i, s in enumerate(sizes, 1):
        candidate = chars + 2 + s if chars else s
        if candidate // 4 > most and chars:
            done.append((start, i - 1))
            start, chars = i, s
        else:
            chars = candidate
    if not sizes:
        return []
    if chars // 4 < least and done:
        return done[:-1] + [(done[-1][0], len(sizes))]
    return done + [(start, len(sizes))]


def test_packing_folds(spark):
    rng = random.Random(5)
    rows = [(k, [rng.choice((0, 3, 40, 90, 400, 1500, 2600)) for _ in range(rng.randrange(0, 14))]) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, s array<int>")
    for column, plain, least, most in ((chunking.pack_stanzas, plain_stanzas, 50, 300), (chunking.pack_paragraphs, plain_paragraphs, 80, 500)):
        got = {r.k: [(b.first, b.last) for b in r.b] for r in df.select("k", column(F.col("s"), least, most).alias("b")).collect()}
        assert got == {k: plain(s, least, most) for k, s in rows}


def test_sentence_split(spark):
    rng = random.Random(6)
    rows = [(k, ["w" * rng.randrange(1, 80) + rng.choice(("", ".", ";", " ")) for _ in range(rng.randrange(0, 12))]) for k in range(100)]
    df = spark.createDataFrame(rows, "k int, s array<string>")
    for r in df.select("k", "s", chunking.split_sentences(F.col("s"), 30).alias("b")).collect():
        done, start, chars = [], 1, 0
        for i, line in enumerate(r.s, 1):
            chars = chars + 1 + len(line) if start < i else len(line)
            if chars // 4 >= 30 and line.rstrip(" ").endswith((".", "!", "?", ";")):
                done.append((start, i))
                start = i + 1
        assert [(b.first, b.last) for b in r.b] == done + ([(start, len(r.s))] if start <= len(r.s) else [])


def test_line_ranges_are_true(spark):
    stanza = ["x" * 60] * 4
    poems = spark.createDataFrame([("p", "stanzaic", [stanza] * 8), ("s", "sonnet", [["a"] * 14]), ("e", "other", [])], "k string, form string, stanzas array<array<string>>")
    rows = sorted(chunking.chunk_poems(poems, "k").collect(), key=lambda r: (r.k, r.chunk_index))
    mine = [(r.first_line, r.last_line) for r in rows if r.k == "p"]
    assert mine[0][0] == 1 and mine[-1][1] == 32 and all(b[0] == a[1] + 1 for a, b in zip(mine, mine[1:]))
    assert [(r.first_line, r.last_line, r.strategy) for r in rows if r.k == "s"] == [(1, 14, "sonnet")]


def test_stanzas_and_blanks(spark):
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(["", "", "a", "b", "", "", "c", ""])], "k string, pos int, line string")
    got = sequence.stanzas(lines, "k", F.trim("line") == "").orderBy("stanza").collect()
    assert [(r.stanza, r.lines) for r in got] == [(1, ["a", "b"]), (2, ["c"])]
    assert {r.line: r.blanks for r in sequence.blanks_before(lines, "k").filter("line <> ''").collect()} == {"a": 2, "b": 0, "c": 2}


def test_gap_fills(spark):
    words = spark.createDataFrame([(w,) for w in "task tusk heaven tears rears bears fears gears".split()], "word string")
    found = spark.createDataFrame([(1, "the ta[...]k", 1), (2, "t[...]sk is", 1), (3, "[...]ears", 1), (4, "none", 1), (5, "heave[...]", 1)], "gap_id int, context string, letters int")
    fills = {r.gap_id: r.fill for r in gaps.letter_fills(found, words, ["task"], 1).collect()}
    assert fills == {1: "s", 2: "a", 5: "n"}
    assert one(spark, gaps.fill_from_line(F.col("c"), F.col("l")), c=("thy servant rea[...]s, made", "string"), l=("A broken ALTAR, thy servant rears, made of", "string")) == "r"
    assert one(spark, gaps.patch(F.col("l"), F.col("f")), l=("a [...] b [...]", "string"), f=("x", "string")) == "a x b [...]"


def test_search_ties_and_caps(spark):
    rows = [(i, [1.0, 0.0], "p", "prose" if i % 2 else "verse") for i in range(6)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>, poet string, type string")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query_vector array<double>")
    assert [r.vec_id for r in retrieval.search(corpus, asked, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert [r.vec_id for r in retrieval.search(corpus, asked, 4, cap_type="prose", cap=1).orderBy("rank").collect()] == [0, 1, 2, 4]
    assert [r.vec_id for r in retrieval.search(corpus, asked, 4, cap_type="prose", cap=0).orderBy("rank").collect()] == [0, 2, 4]
    assert [r.vec_id for r in retrieval.search(corpus, asked, 4, cap_type="prose", cap=1, fetch=3).orderBy("rank").collect()] == [0, 1, 2]
    assert retrieval.search(corpus.filter("vec_id > 99"), asked, 3).count() == 0
    blocked = retrieval.distances(corpus, asked, blocks=2).count()
    assert blocked == 6


def test_upsert_is_idempotent_for_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, None)], "id long, v string")
    once = readers.upsert(old, new, "id")
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, readers.upsert(once, new, "id").collect()), key=str) == [(1, "a"), (2, "d"), (3, None)]


def test_review_tiers_fall_back(spark):
    entries = spark.createDataFrame([(1,), (2,)], "id long")
    picks = spark.createDataFrame([(2, 2), (2, 1), (9, 1)], "id long, tier int")
    assert sorted(map(tuple, filters.review_tiers(entries, picks).collect())) == [(2, 1)]
    assert sorted(map(tuple, filters.review_tiers(entries, picks.filter("id = 9")).collect())) == [(1, 1), (2, 1)]


def test_as_of_and_overlay(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, at int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y")], "k string, at int, v string")
    assert sorted(((r.k, r.at, r.v) for r in joins.as_of(left, right, "k", "at", "v").collect()), key=str) == [("a", 1, None), ("a", 5, "y"), ("b", 9, None)]
    base = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    assert {r.id: r.v for r in eventlog.overlay(base, base.filter("id = 1").withColumn("v", F.lit("z")), "v").collect()} == {1: "z", 2: "y"}


def test_parsers():
    xml = '<TEI xmlns="x"><text><body><div><head>A</head><sp><speaker>Bo</speaker><l>1</l><l>2</l><l>3</l></sp><sp><speaker>Cy</speaker><l>1</l><l>2</l><l>3</l><l>4 <gap/></l></sp><div><head>B</head><lg><l>x<note>n</note></l></lg></div></div></body></text></TEI>'
    rows = readers.tei_rows(xml)
    assert [r[1] for r in rows] == ["Cy"] * 4 + [""] and rows[3][4] == "4 [...]" and rows[4] == ("B", "", 0, 0, "x")
    assert readers.tei_rows("<broken") == []
    assert readers.structured_stanzas('<div class="stanza"><span class="i0">a <i>b</i></span><div><span>c</span></div></div><div>d</div>') == [["a b", "c"]]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("b.xhtml", "<p>2</p>")
        z.writestr("a.html", "<p>1</p>")
        z.writestr("c.css", "x")
    assert books.epub_documents(buffer.getvalue()) == [("a.html", "<p>1</p>"), ("b.xhtml", "<p>2</p>")]
    assert books.epub_documents(b"no zip") == []


def test_admission_order():
    a, posts, seen = pipelines.Admission(per_hour=3, per_day=5, cooldown=60, repeats=2), [], {}
    got = [a.decide(at, text, posts, seen) for at, text in ((0, "x"), (30, "y"), (60, "x"), (200, "x"), (300, "z"), (400, "w"), (3700, "w"), (90000, "x"))]
    assert got == ["", "cooldown", "", "stimulus dedup", "", "hourly cap", "", ""]


def test_stream_equals_batch(spark):
    from versemill.plans.catalog import QUERIES

    a, b = (sorted(map(tuple, QUERIES[f"r10_admission_{k}"](spark, "/root/testdata/sf0.001").collect())) for k in ("batch", "stream"))
    assert a == b


def test_safety_reads_every_text_to_its_end(spark, tmp_path):
    from versemill.plans import catalog

    filler = "mild air and quiet water " * 40
    said = ["", "the Irish, though never rebel", "a Turk, most cruel", "woman, thy name is frailty", "Romish rites and\nsuperstition", "a savage and a native", "the Jew and the devil", "Shylock", "she is no harlot", "an Irish " + "x" * 201 + " rebel", "her wild wife", "that negro was a slave"]
    texts = [a + s + b for s in said for a, b in (("", ""), (filler, ""), (filler + "she saw the wild devil\n", filler), ("", "\n" + filler + "popish idol"))]
    rows = [*enumerate(texts), (900, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r.reason for r in catalog.QUERIES["f13_safety_texts"](spark, f"file://{tmp_path}").collect()}
    first = lambda text: next((c for c, patterns in safety.PATTERNS.items() if any(re.search(p, text, re.I | re.S) for p in patterns)), "")
    assert got == {i: first(t or "") for i, t in rows}
    assert set(got.values()) == {"", *safety.PATTERNS}


def test_line_queries_read_all_lines(spark, tmp_path):
    from versemill.plans import catalog

    texts = ["The title\nTHE TITLE.\n\nfirst verse    12  \nhe wrote \"a quote over\ntwo whole lines\" then", "Mild air and water\nACT II\n some <note>x</note>ſed\tline \n\nQUIET\nend", "Ab", "", None]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "Mild air and fire\nx"), (8, "Mild air and\nx"), (9, "A"), (10, ""), (11, "The title page")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = lambda name: sorted(map(tuple, catalog.QUERIES[name](spark, f"file://{tmp_path}").collect()))
    lines = [(d, i, x) for d, t in enumerate(texts) if t is not None for i, x in enumerate(t.split("\n"))]
    assert got("x05_clean_line") == [(d, i, re.sub(r"\s+$", "", re.sub(r"\s{3,}\d+\s*$", "", x))) for d, i, x in lines]
    upper = lambda x: len(re.findall("[A-Z]", x)) / max(1, len(re.findall("[A-Za-z]", x)))
    assert got("x08_upper_ratio") == [(d, i, round(upper(x), 6), upper(x) > 0.7) for d, i, x in lines]
    from versemill.functions import text as X
    from versemill.operators import filters as L

    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    assert sorted(map(tuple, L.lines(docs, "doc_id").select("doc_id", "pos", X.tei_line(F.col("line"))).collect())) == [(d, i, " ".join(x.replace("<note>x</note>", "").replace("ſ", "s").split())) for d, i, x in lines]
    assert got("f04_structural") == [(d, i, i % 9 < 3) for d, i, x in lines]  # what is planted at these places
    assert docs.select("doc_id", F.inline(spans.quotations(F.col("text")))).select("doc_id", "quote", "kind").collect() == [(0, "a quote over\ntwo whole lines", "inline")]
    whole = F.split("text", "\n", -1)
    assert docs.filter("doc_id = 0").select(X.drop_title_lines(whole, F.get(whole, F.lit(0)))).first()[0] == texts[0].split("\n")[2:]
    first = F.substring_index("text", "\n", 1)
    prefixes = spark.read.parquet(f"file://{tmp_path}/benchmark.parquet").select(first.alias("prefix"), F.col("item_id").alias("title"), F.col("item_id").alias("place"))
    assert sorted(map(tuple, joins.first_prefix(docs.select("doc_id", first.alias("line")), prefixes, 8).select("doc_id", "title").collect())) == [(1, 8), (2, 9)]
    assert got("s13_plaintext") == [(0, 2, "THE TITLE.", 1, ["first verse    12  ", 'he wrote "a quote over', 'two whole lines" then']), (1, 2, "ACT II", 0, [" some <note>x</note>ſed\tline "]), (1, 3, "QUIET", 0, ["end"])]


def test_partial_ratio_against_a_plain_table():
    from versemill.functions.fuzzy import partial_ratio

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return row[-1]

    def plain(a, b):
        short, long = sorted((a, b), key=len)
        n = len(short)
        stretches = {long[max(0, i) : max(0, i + n)] for i in range(-n + 1, len(long))} - {""}
        return max((200 * common(short, s) / (n + len(s)) for s in stretches), default=0.0) if n else 0.0

    rng = random.Random(41)
    for _ in range(150):
        a, b = ("".join(rng.choice("abc d") for _ in range(rng.randrange(0, 90))) for _ in range(2))
        assert abs(partial_ratio(a, b) - plain(a, b)) < 1e-9
    assert partial_ratio(None, "x") == partial_ratio("", "") == 0 and partial_ratio("a line", "here is a line in a text") == 100


def test_bpe_counts(spark):
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = tokenizers.Tokenizer.from_file(path)
    encoder.encode_special_tokens = True
    texts = ["", None, "one two", "naïve 漢字 " * 30, "<|endoftext|>"]
    got = spark.createDataFrame([*enumerate(texts)], "i int, t string").select("i", text.bpe_tokens(path)(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: len(encoder.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_overlapping_pairs_and_repeated_keys(spark):
    scores = spark.createDataFrame([("iii",), ("aiia",), ("nation",)], "word string").select("word", gaps.word_score(F.col("word"), []).alias("s")).collect()
    assert {r.word: r.s for r in scores} == {"iii": 21, "aiia": 11, "nation": 0}
    base, many = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(1, "x"), (1, "y"), (1, None)], "id int, v string")
    assert sorted(map(tuple, eventlog.overlay(base, many, "v").collect())) == [(1, "y"), (2, "b")]
    assert sorted(map(tuple, joins.overlay_text(base, many, "id", ["v"]).collect())) == [(1, "y"), (2, "b")]
    assert joins.enrich(base.select("id"), many, "id", ["v"]).count() == 2


def test_a_failed_poll_comes_again(spark, tmp_path):
    from versemill.sources import polling

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("one")
    watch = polling.FolderWatch(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/state", "*.md")
    assert [r.text for r in watch.poll()[0].collect()] == ["one"]
    items, state = watch.poll()  # the one before was never marked as done
    assert [r.text for r in items.collect()] == ["one"]
    watch.done(state)
    assert watch.poll()[0].count() == 0
