"""Operators on fixed rows, where what should come out is known by hand and written as VALUES."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions import text
from papyrion.operators import exchange, formulas, inline, layout, regions, setting, structure, styles, tables, translate
from papyrion.plans import jobs
from papyrion.queries.documents import book_of
from papyrion.registry import query
from papyrion.schemas import BLOCK
from papyrion.sinks import epub as epub_sink
from papyrion.sinks import srt as srt_sink
from papyrion.sources import epub, srt
from papyrion.sources import html as dom


def _blocks(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Blocks of ``schemas.BLOCK`` with a document number; what is not said is null."""
    read = spark.createDataFrame([(r["doc"], json.dumps({"page": 1, "pageWidth": 612.0, "pageHeight": 792.0, "fontSize": 9.0, "layoutLines": [], **r})) for r in rows], "doc int, j string")
    return read.select("doc", F.from_json("j", BLOCK).alias("b")).select("doc", "b.*")


def _line(x0, y0, x1, y1, *items) -> dict:
    box = [float(v) for v in (x0, y0, x1, y1)]
    return {"bbox": box, "items": [{"type": "text", "text": "words", "bbox": box, **i} for i in (items or ({},))]}


def _cells(top: float, texts: list[str], x: float = 60.0, step: float = 120.0, w: float = 60.0) -> dict:
    return {"bbox": [x, top, x + step * len(texts), top + 10], "items": [{"type": "text", "text": t, "bbox": [x + step * k, top, x + step * k + w, top + 10]} for k, t in enumerate(texts)]}


_PROSE = "This is a long sentence of running text, which goes on and on, and has many words in it. It never is a table, of course."


def _pages() -> list[dict]:
    cap = {"id": "cap", "blockType": "caption", "text": "Table 1. Values", "bbox": [60.0, 80.0, 420.0, 92.0]}
    grid = {"id": "body", "blockType": "body", "text": "word cell other " * 6, "bbox": [60.0, 100.0, 420.0, 180.0], "layoutLines": [_cells(100.0 + 14 * k, ["word", "cell", "other"]) for k in range(6)]}
    prose = {"id": "body", "blockType": "body", "text": _PROSE, "bbox": [60.0, 100.0, 420.0, 180.0], "layoutLines": [_cells(100.0, ["This is a long sentence"])]}
    title = {"id": "cap", "blockType": "caption", "text": "Algorithm 1 Search", "bbox": [60.0, 80.0, 540.0, 92.0]}
    step = lambda n, top: {"id": f"alg{n}", "blockType": "body", "text": "1: Input queue 2: while not empty 3: return the loss", "bbox": [60.0, top, 540.0, top + 40]}
    after = {"id": "p", "blockType": "body", "text": "After that we go on with plain text, as before. It says nothing.", "bbox": [60.0, 200.0, 540.0, 240.0]}
    return [{"doc": d, **b} for d, page in ((1, [cap, grid]), (2, [cap, prose]), (3, [title, step(1, 96.0), step(2, 140.0), after]), (4, [])) for b in page]


@query("""
select * from (values (1, 'p1_single_1', 'table', 'cap', 'body', ''), (3, 'p1_a1', 'algorithm', 'cap', 'alg1,alg2', '')) as t(doc, id, kind, captions, bodies, headers)
""")
def table_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TBL-02, JOIN-14 and WIN-11: a caption over one body of cells, over prose, and an algorithm whose body ends at plain text."""
    found = tables.detect(_blocks(spark, _pages()))
    names = lambda part: F.array_join(f"{part}BlockIds", ",")
    return found.select("doc", "id", "kind", names("caption").alias("captions"), names("body").alias("bodies"), names("header").alias("headers"))


def _captions() -> list[dict]:
    two = [_line(0, 0, 300, 20), _line(0, 21, 280, 42)]
    base = {"doc": 1, "pageWidth": 600.0, "pageHeight": 800.0, "fontSize": 10.0, "bbox": [0.0, 0.0, 320.0, 42.0], "text": ""}
    rows = [
        {"blockType": "caption", "layoutLines": two}, {"blockType": "caption", "layoutLines": [_line(0, 0, 300, 20, {"isBoldLike": True}), two[1]]}, {"blockType": "caption", "layoutLines": [_line(0, 0, 300, 20, {"type": "formula"}), two[1]]},
        {"blockType": "caption", "bbox": [0.0, 0.0, 260.0, 42.0], "layoutLines": [_line(0, 0, 60, 10), _line(90, 11, 150, 20), _line(180, 21, 240, 30)]}, {"blockType": "body"}, {"blockType": "code"},
    ]
    return [{**base, "id": f"c{k}", **r} for k, r in enumerate(rows)]


@query("""
select * from (values ('c0', 'plain_reflow', true), ('c1', 'mixed_reflow', true), ('c2', 'plain_reflow', true), ('c3', 'preserve_visual', true), ('c4', 'plain_reflow', true), ('c5', 'structured_layout', false)) as t(id, policy, reflow)
""")
def render_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-06 and FLT-30: how captions, bodies and code are set again."""
    return _blocks(spark, _captions()).select("id", layout.render_policy().alias("policy"), layout.full_reflow().alias("reflow"))


@query("""
select * from (values ('a0', 'preserve'), ('a1', 'replace'), ('a2', 'review'), ('a3', 'preserve'), ('a4', 'preserve'), ('a5', 'review')) as t(id, action)
""")
def block_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ACT-01 and FLT-29: captions that stay, translated bodies, missing translations, table bodies, references, pictures."""
    rows = [
        {"blockType": "caption", "renderPolicy": "preserve_visual", "translatedText": "x"}, {"blockType": "body", "translatedText": "x"}, {"blockType": "body", "translatedText": ""}, {"blockType": "table_body", "translatedText": "x"},
        {"blockType": "body", "text": "[12] A reference", "translatedText": "x"}, {"blockType": "body", "doclingLabel": "picture", "translatedText": "x"},
    ]
    base = {"doc": 1, "pageWidth": 600.0, "pageHeight": 800.0, "fontSize": 10.0, "bbox": [0.0, 0.0, 320.0, 42.0], "text": ""}
    return _blocks(spark, [{**base, "id": f"a{k}", **r} for k, r in enumerate(rows)]).select("id", layout.action().alias("action"))


@query("select * from (values ('l0'), ('l1'), ('l2'), ('l3'), ('near')) as t(id)")
def figure_label_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-11: four anchors above a caption and a label beside them stay; one far off, one below and a long text do not; three anchors are too few."""
    label = lambda i, x, y, **more: {"doc": 1, "id": i, "text": "axis 1", "bbox": [x, y, x + 40.0, y + 8.0], "fontSize": 7.0, **more}
    page = [label(f"l{k}", 100.0 + 50 * k, 300.0 + 10 * k, doclingLabel="picture") for k in range(4)]
    page += [label("near", 120.0, 345.0), label("far", 120.0, 250.0), label("below", 120.0, 450.0), {"doc": 1, "id": "prose", "text": _PROSE, "bbox": [100.0, 300.0, 300.0, 340.0], "fontSize": 10.0}]
    page.append({"doc": 1, "id": "cap", "text": "Figure 3. What it shows", "bbox": [90.0, 400.0, 330.0, 412.0], "fontSize": 9.0})
    few = [{**b, "doc": 2} for b in page if b["id"] not in ("l3",)]
    found = regions.figure_labels(_blocks(spark, page + few), F.lit(10.0))
    return found.where("doc = 1").select("id").unionByName(found.where("doc = 2").select(F.concat(F.lit("too few: "), "id").alias("id")))


@query("""
select * from (values (1, 'host', 'Once upon a time', 'O', 'nce upon a time'), (1, 'cap', 'O', 'O', ''), (1, 'whole', 'Once again', 'O', 'nce again'), (1, 'free', '  spaced', 's', 'paced')) as t(doc, id, "sourceText", first, rest)
""")
def drop_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-20: a host gets its drop cap back in front, once; texts part after their first visible character."""
    rows = [(1, "cap", "O", None), (1, "host", "nce upon a time", "cap"), (1, "whole", "Once again", "cap"), (1, "free", "  spaced", None)]
    out = inline.stitched(spark.createDataFrame(rows, "doc int, id string, text string, dropCapOf string")).withColumn("p", inline.split_first(F.col("sourceText")))
    return out.select("doc", "id", "sourceText", F.col("p.first").alias("first"), F.col("p.rest").alias("rest"))


_STREAMS = json.dumps({"streams": [{"index": 2, "codec_name": "subrip", "tags": {"language": "eng"}, "disposition": {"default": 0}}, {"index": 3, "codec_name": "hdmv_pgs_subtitle", "tags": {"language": "ger"}, "disposition": {"default": 1}}, {"index": 4, "codec_name": "ass", "tags": {"title": "Deutsch"}, "disposition": {"default": 1}}]})


@query("""
select * from (values ('a.mkv', 'embedded', 2, 'subrip'), ('a.mkv', 'embedded', 4, 'ass'), ('a.mkv', 'external', 0, 'srt'), ('a.mkv', 'external', 1, 'vtt')) as t(video, kind, index, codec)
""")
def subtitle_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07, SRC-08, SET-02 and FLT-35: streams inside of a video and files beside it, those with text."""
    probes = spark.createDataFrame([("a.mkv", _STREAMS), ("b.mkv", "no json")], "video string, stdout string")
    files = spark.createDataFrame([("a.mkv", n) for n in ("a.en.srt", "A.vtt", "ab.srt", "a.txt", "other.srt")], "video string, name string")
    rows = srt.supported(srt.all_streams(srt.probed_streams(probes), srt.external_files(files)))
    return rows.select("video", "kind", F.col("index").cast("int").alias("index"), F.col("codec_name").alias("codec"))


@query("""
select * from (values ('Film.MKV', '.mkv', true), ('dir.x/Book.ePub', '.epub', true), ('notes.txt', '.txt', false), ('none', '', false), ('a/b.HTML', '.html', true)) as t(path, extension, supported)
""")
def source_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01: sources by their extension, whatever its case."""
    return epub.dispatch(spark.createDataFrame([(p,) for p in ("Film.MKV", "dir.x/Book.ePub", "notes.txt", "none", "a/b.HTML")], "path string"))


@query("""
select * from (values ('v.mkv', '-y -i v.mkv -i x.srt -i new.srt -map 0 -map 1 -map 2 -c copy -c:s srt -disposition:s:0 0 -disposition:s:1 0 -metadata:s:s:2 language=eng -metadata:s:s:2 title=English -disposition:s:2 default out.mkv'),
    ('w.mp4', '-y -i w.mp4 -i new.srt -map 0 -map 1 -c copy -c:s srt -metadata:s:s:0 language=eng -metadata:s:s:0 title=English -disposition:s:0 default out.mkv')) as t(video, arguments)
""")
def mux_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06: arguments that put a new subtitle track last and make it the default one."""
    rows = spark.createDataFrame([("v.mkv", 1, ["x.srt"]), ("w.mp4", 0, [])], "video string, n int, files array<string>")
    out = srt_sink.mux_arguments(F.col("video"), F.lit("new.srt"), F.col("n"), F.col("files"), F.lit("eng"), F.lit("English"), F.lit("out.mkv"))
    return rows.select("video", F.array_join(out, " ").alias("arguments"))


@query("""
select * from (values ('Book', 'Book_zh.epub'), ('Book 2', 'Book 2_chap-1-3_zh.epub')) as t(stem, name)
""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-13: names of written files, with the selection where there is one."""
    rows = spark.createDataFrame([("Book", None), ("Book 2", "1-3")], "stem string, chosen string")
    return rows.select("stem", epub_sink.output_name(F.col("stem"), F.col("chosen"), F.lit("zh"), F.lit("epub")).alias("name"))


@query("""
select * from (values (1, 'plain words', false, true), (2, 'kept  inside', false, false), (3, '...', true, false), (4, '', false, false), (5, '(!)', false, false)) as t(k, clean, orphan, formula)
""")
def answer_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-09, FLT-15 and FLT-16: end marks of models removed, answers that are only punctuation, runs set as formulas."""
    rows = [(1, " plain words<eos>", "some long source", "CMMI10"), (2, "<pad>kept  inside&lt;eos&gt;", "source text here", "Times"), (3, "...", "a real sentence", "Times"), (4, "<PAD>", "another sentence", "Times"), (5, "(!)", "short", "Times")]
    out = spark.createDataFrame(rows, "k int, said string, source string, font string").withColumn("clean", text.strip_model_marks("said"))
    return out.select("k", "clean", text.orphan_punctuation(F.col("source"), F.col("clean")).alias("orphan"), text.formula_span(F.col("clean"), F.col("font")).alias("formula"))


_SITE = [
    (1, "<html><head><title>T</title></head><body><nav><a href='x'>Menu of things</a></nav><article><h1>Head line</h1><p>First paragraph of text.</p><div><button>Go</button></div></article><p>***</p></body></html>"),
    (2, "<body><div><p>Only one paragraph here.</p></div></body>"),
    (3, "<title>Just a title</title><body></body>"),
    (4, "<body><p class='a b'>Keep <span>this</span> and <span class='b'>that</span> and <span lang='de'>das</span>.</p></body>"),
]


def _site(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SITE, "page_id int, html string")


@query("""
select * from (values (1, 'h1', 'Head line'), (1, 'nav', 'Menu of things'), (1, 'p', 'First paragraph of text.'), (2, 'p', 'Only one paragraph here.'), (4, 'p', 'Keep this and that and das.')) as t(page_id, tag, text)
""")
def html_fixed_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-03 and FLT-05 to FLT-09: structure keeps headings, paragraphs and a menu's own text (only what is inside of one is blocked), not buttons or rows of marks."""
    rows = dom.explode(_site(spark), "page_id", dom.structural_body).where("id <> ''")
    return rows.select("page_id", "tag", "text")


@query("""
select * from (values (1, 'article', 'Head line'), (2, 'div', null), (3, 'body', 'Just a title'), (4, 'p', null)) as t(page_id, root, heading)
""")
def html_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-14 and EXP-15: the element that looks most like the main text, and the first heading, else the title."""
    how = lambda root: [("root", 0, dom.content_root(root), dom.first_heading(root) or "")]
    return dom.explode(_site(spark), "page_id", how).select("page_id", F.col("tag").alias("root"), F.nullif("reason", F.lit("")).alias("heading"))


@query("""
select * from (values (4, 'Keep this and <span class=''b''>that</span> and <span lang=''de''>das</span>.')) as t(page_id, content)
""")
def html_unwrapped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-16: spans without language, style, a known class or id give way to their text."""

    def how(root: dom.Node) -> list:
        dom.unwrap_spans(root, set(), {"b"})
        return [(f"n{k}", k, n, "") for k, n in enumerate(n for n in root.walk() if n.tag == "p")]

    return dom.explode(_site(spark).where("page_id = 4"), "page_id", how).select("page_id", "content")


@query("""
select * from (values (1, 0, 'c2', 'Second part'), (1, 1, 'c2', 'Inner'), (1, 2, 'c3', 'Third')) as t(book, link, chapter, title)
""")
def contents_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-02, JOIN-03 and JOIN-04: links of a contents chapter get the headings that they lead to; links to itself and to nothing get none."""
    toc = "<body><a href='ch2.xhtml'>?</a><a href='ch2.xhtml#i'>?</a><a href='ch3.xhtml'>?</a><a href='toc.xhtml#x'>?</a><a href='gone.xhtml'>?</a></body>"
    rows = [(1, "toc", "Text/toc.xhtml", 0, toc), (1, "c2", "Text/ch2.xhtml", 1, "<h1>Second part</h1><p>x</p><h2 id='i'>Inner</h2>"), (1, "c3", "Text/ch3.xhtml", 2, "<h2>Third</h2>")]
    chapters = spark.createDataFrame(rows, "book int, chapter string, href string, place int, html string")
    chapters = chapters.withColumn("entryName", F.col("href")).withColumn("ord", F.col("place"))
    return structure.sync_contents(chapters, chapters.where("chapter = 'toc'"), "book").select("book", F.col("link").cast("int").alias("link"), "chapter", "title")


@query("""
select * from (values ('small.epub', 'c0', 'ONE HEADING'), ('small.epub', 'c0', 'SOME WORDS OF TEXT.'), ('small.epub', 'c2', 'LAST WORDS.')) as t(path, chapter, translated)
""")
def epub_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-01 and FLT-34: the chosen chapters of an e-book through the upper-case stub."""
    content = book_of([(0, "<html><body><h1>One heading</h1><p>Some words of text.</p></body></html>"), (1, "<html><body><p>Left out here.</p></body></html>"), (2, "<html><body><p>Last words.</p></body></html>")])
    files = spark.createDataFrame([("small.epub", bytearray(content))], "path string, content binary")
    out = jobs.book(epub.chapters(files), translate.Upper(), "1,3")
    name = F.split("chapter", "#")
    return out.where("ok").select(F.get(name, F.lit(0)).alias("path"), F.get(name, F.lit(1)).alias("chapter"), "translated")


@query("""
select * from (values (1, 'n1', true, '', 'ein <b>Wort</b>'), (1, 'n2', true, '', 'zwei'), (2, 'n1', false, 'missing or empty: n2', null), (2, 'n2', false, 'missing or empty: n2', null), (3, 'n1', true, '', 'nur Text'), (4, 'n1', false, 'missing or empty: n1', null)) as t(batch, id, ok, error, translated)
""")
def accepted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-08, JOIN-17 and EXE-04: whole answers, one that lacks a node, plain text for a lone node, and nothing at all."""
    nodes = spark.createDataFrame([(1, "n1", 0, "one <b>word</b>"), (1, "n2", 1, "two"), (2, "n1", 0, "a"), (2, "n2", 1, "b"), (3, "n1", 0, "only text"), (4, "n1", 0, "lost")], "batch int, id string, pos int, content string")
    said = [(1, '```xml\n<node id="n2">zwei</node>\n<node id="n1"> ein <b>Wort</b> </node><node id="n2">doppelt</node>\n```'), (2, '<node id="n1">x</node><node id="n2"> </node>'), (3, " nur Text "), (4, None)]
    out = exchange.accept(nodes, spark.createDataFrame(said, "batch int, response string"), ["batch"])
    return out.select("batch", "id", "ok", "error", "translated")


_FALSTAFF = "<html><head><title>Kopf title</title><style>p {x: y}</style></head><body><script>var a = '<b>';</script><!-- no --><p class='x'>Привет &amp; hello 世界, カナ かな 한글 42</p><div>line two</div></body></html>"


@query("""
select * from (values ('', 'Kopf titleПривет & hello 世界, カナ かな 한글 42line two'), ('russian', 'привет'), ('chinese', 'hello 世界 42line two'), ('japanese', 'hello 世界 カナ かな 42line two'), ('korean', 'hello 한글 42line two')) as t(language, text)
""")
def cleaned_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03: text of a page for each language's cleaner."""
    page = spark.createDataFrame([(_FALSTAFF,)], "html string")
    return page.select(F.inline(F.array(*(F.struct(F.lit(name).alias("language"), text.clean_markup("html", name).alias("text")) for name in ("", *text.SCRIPTS)))))


@query("""
select * from (values (1, 'One two <b>three</b>. three Four five six.', 'One two three. three Four five six.'), (2, 'Alone.', 'Alone.')) as t(page_id, html, text)
""")
def glossary_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04: what a page gives to term mining: the contents of its visible elements in order, those inside of others too."""
    pages = spark.createDataFrame([(1, "<body><p>One two <b>three</b>.</p><p>***</p><script>x</script><p>Four five six.</p></body>"), (2, "<body><div><p>Alone.</p></div></body>"), (3, "<body></body>")], "page_id int, html string")
    return structure.glossary_text(pages, "page_id").withColumn("text", text.clean_markup("html"))


@query("""
select * from (values (1, '["aa bb", "cc"]', 5.13::double), (2, '["abcdefghij"]', 6.8::double), (3, '[]', 0.35::double)) as t(k, lines, width)
""")
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-16 and GEO-09: words wrapped into a box, a word wider than the box, and no text."""
    rows = spark.createDataFrame([(1, "AA  BB\nCC", 25.7), (2, "ABCDEFGHIJ", 10.0), (3, " ", 50.0)], "k int, text string, width double")
    lines = setting.wrapped(F.col("text"), F.col("width"), F.lit(10.0))
    return rows.select("k", F.lower(F.concat(F.lit('["'), F.array_join(lines, '", "'), F.lit('"]'))).alias("lines"), F.round(setting.width(F.col("text"), F.lit(1.0)) / setting.UNIT, 4).alias("width")).withColumn("lines", F.when(F.col("k") == 3, "[]").otherwise(F.col("lines")))


@query("""
select * from (values (1, 10.0::double, 'uniform'), (2, 8.0::double, 'plain'), (3, null, 'kept'), (4, 10.0, 'rejected'), (5, 10.0, 'styles'), (6, 10.0, 'skipped'), (7, 10.0, 'drop_cap')) as t(k, size, way)
""")
def set_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RND-01 and RND-02: the size at which a text fits its box, and how its block is written."""
    rows = [
        (1, "body", "plain_reflow", True, "source", "AB", [0.0, 0.0, 100.0, 12.0]), (2, "caption", "plain_reflow", False, "source", "AAAA BBBB CCCC", [0.0, 0.0, 40.0, 20.0]), (3, "body", "preserve_visual", True, "source", "AAAAAAAA BBBBBBBB", [0.0, 0.0, 20.0, 8.0]),
        (4, "body", "plain_reflow", True, "a real sentence", "...", [0.0, 0.0, 100.0, 12.0]), (5, "heading", "plain_reflow", False, "source", "AB", [0.0, 0.0, 100.0, 12.0]), (6, "body", "plain_reflow", True, "source", "<pad>", [0.0, 0.0, 100.0, 12.0]), (7, "drop_cap", "plain_reflow", True, "source", "A", [0.0, 0.0, 100.0, 12.0]),
    ]
    b = spark.createDataFrame(rows, "k int, blockType string, policy string, uniform boolean, source string, said string, bbox array<double>")
    size = setting.fitted(F.col("said"), F.col("bbox"), F.lit(10.0), setting.least_size(F.lit(False), F.lit(False)))
    return b.select("k", size.alias("size"), setting.way(F.col("blockType"), F.col("policy"), F.col("uniform"), F.col("source"), F.col("said")).alias("way"))


def _planner(request: str) -> str:
    """Offline stub: asks for chapters by number; some answers are no JSON."""
    if request.startswith("broken"):
        raise ValueError("no answer")
    return "sorry" if request.startswith("odd") else '```json\n{"order": [' + request + "]}\n```"


@query("""
select * from (values ('2, 1', '2,1', 1), ('odd', null, 3), ('broken', null, 3)) as t(request, plan, tries)
""")
def planned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXE-08 and UDF-03: JSON answers of a planner; three tries, then none."""
    out = exchange.json_answer(spark.createDataFrame([("2, 1",), ("odd",), ("broken",)], "request string"), _planner, "order array<int>")
    return out.select("request", F.array_join("planned.order", ",").alias("plan"), "tries")


@query("""
select 1 as doc, '<!DOCTYPE html>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml">' || chr(10) || '<head><title>A &amp; B</title></head>' || chr(10) || '<body>' || chr(10) || '<h2 data-pdf-block-id="h" data-page="1">Head</h2>' || chr(10)
    || '<p data-pdf-block-id="b" data-page="1">1 &lt; 2 and @@INLINE_FORMULA_1@@</p>' || chr(10) || '</body>' || chr(10) || '</html>' as html
""")
def block_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05: blocks as a page; code, preserved blocks and references are left out, formulas are placeholders."""
    mono = {"bbox": [0.0, 60.0, 90.0, 70.0], "items": [{"type": "text", "text": "let x = 1", "isMonospaceLike": True}]}
    rows = [
        {"id": "b", "text": "1 < 2 and $x$", "bbox": [0.0, 40.0, 90.0, 50.0], "role": "paragraph"}, {"id": "h", "text": "Head", "bbox": [0.0, 20.0, 90.0, 30.0], "role": "heading"}, {"id": "r", "text": "[1] R", "blockType": "reference_block", "bbox": [0.0, 80.0, 90.0, 90.0]},
        {"id": "k", "text": "kept", "preserveOriginal": True, "bbox": [0.0, 80.0, 90.0, 90.0]}, {"id": "m", "text": "let x = 1", "bbox": [0.0, 60.0, 90.0, 70.0], "layoutLines": [mono]},
    ]
    return regions.to_markup(_blocks(spark, [{"doc": 1, **r} for r in rows]), "doc", F.lit("A & B"))


_SHORT = "<body><h1>Title here</h1><p>Text <b>bold</b> end</p><p>12</p><p></p><table><tr><td>one a</td><td> two b </td></tr></table><h3>Part</h3><h3>Part</h3></body>"


def _short(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, _SHORT)], "page_id int, html string")


@query("""
select * from (values ('node_0', 'h1', 'Title here', ''), ('node_2', 'p', 'Text bold end', ''), ('node_1', 'b', 'bold', ''), ('', 'p', '12', 'mostly_symbols'), ('node_3', 'td', 'one a', ''), ('node_4', 'td', 'two b', ''), ('node_5', 'tr', 'one a two b', ''), ('', 'table', 'one a two b', 'duplicate_parent'),
    ('node_6', 'h3', 'Part', ''), ('node_7', 'h3', 'Part', '')) as t(id, tag, text, reason)
""")
def html_fixed_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-02 and LOG-01: visible texts with ids from the inside out; marks only, and parents of one long text, are left out with a reason."""
    return dom.explode(_short(spark), "page_id", dom.visible_body).select("id", "tag", "text", "reason")


@query("""
select * from (values ('node_0', 'h1', 'Title here', ''), ('node_1', 'p', 'Text bold end', ''), ('node_2', 'p', '12', ''), ('', 'p', '', 'empty'), ('node_4', 'h3', 'Part', ''), ('node_5', 'h3', 'Part', '')) as t(id, tag, text, reason)
""")
def html_fixed_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-01: text elements by their tags; empty ones are counted but not sent."""
    return dom.explode(_short(spark), "page_id", dom.explicit).select("id", "tag", "text", "reason")


@query("select 'table_0' as id, 'one a|two b' as cells, 'body:nth-of-type(1) > table:nth-of-type(1)' as path")
def html_fixed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-04 and EXP-13: tables with their cells and the way to them."""
    return dom.explode(_short(spark), "page_id", dom.tables).select("id", F.array_join("cells", "|").alias("cells"), F.col("dom_path").alias("path"))


@query("""
select * from (values (0, 'TABLE_REAL', 'KEEP'), (1, 'TABLE_PSEUDO', 'PLACEHOLDER')) as t(k, kind, action)
""")
def pseudo_table_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-02, FLT-03 and STR-23: a table of words, and a grid of single marks as it comes out of character recognition."""
    rows = spark.createDataFrame([(0, ["name", "value", "unit", "note"] * 4, "<td>x</td>"), (1, [".", "-", "|", ",", "'", "_"] * 4, "<td>.</td>")], "k int, cells array<string>, html string")
    pseudo = text.pseudo_table(F.col("cells"), F.col("html"))
    return rows.select("k", F.when(pseudo, "TABLE_PSEUDO").otherwise("TABLE_REAL").alias("kind"), F.when(pseudo, "PLACEHOLDER").otherwise("KEEP").alias("action"))


class _Stubborn:
    """Offline stub: every batch fails twice before it is answered."""

    def __init__(self) -> None:
        self.calls = 0

    def translate(self, texts: list[str]) -> list[str | None]:
        self.calls += 1
        if self.calls % 3:
            raise ConnectionError("network is down")
        return [t.upper() for t in texts]


class _Refusing:
    """Offline stub: refuses for reasons of policy, or breaks in another way."""

    def __init__(self, message: str):
        self.message = message

    def translate(self, texts: list[str]) -> list[str | None]:
        raise ValueError(self.message)


@query("""
select * from (values ('again', 'A', true, 3, ''), ('again', 'B', true, 3, ''), ('refused', 'A', true, 2, ''), ('refused', 'B', true, 2, ''), ('broken', null, false, 3, 'ValueError: timeout while blocked by moderation')) as t(provider, translated, ok, attempts, error)
""")
def provider_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXE-02, EXE-07 and FLT-32: three tries, a fallback after a refusal but not after a broken request; failures are rows."""
    rows = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)
    again = translate.translate(rows, _Stubborn(), pause=0).withColumn("provider", F.lit("again"))
    refused = translate.translate(rows, _Refusing("blocked by content policy"), pause=0, fallback=translate.Upper()).withColumn("provider", F.lit("refused"))
    broken = translate.translate(rows.limit(1), _Refusing("timeout while blocked by moderation"), pause=0, fallback=translate.Upper()).withColumn("provider", F.lit("broken"))
    return again.unionByName(refused).unionByName(broken).select("provider", "translated", "ok", "attempts", "error")


def _ruled() -> tuple[list[dict], list[tuple]]:
    """Two ruled tables on one page with a caption each, and a page with three rules far apart."""
    ys = (100.0, 120.0, 140.0, 160.0, 180.0, 300.0, 320.0, 340.0, 360.0, 380.0)
    row = lambda n, y: {"doc": 1, "id": f"r{n}", "blockType": "body", "text": "12.5 34.1 56.7", "bbox": [110.0, y + 5, 500.0, y + 15], "layoutLines": [_cells(y + 5, ["12.5", "34.1", "56.7"], x=110.0, step=130.0)]}
    rows = [row(n, y) for n, y in enumerate(y for y in ys if y not in (180.0, 380.0))]
    caption = lambda n, y: {"doc": 1, "id": f"c{n}", "blockType": "caption", "text": f"Table {n}. Values", "bbox": [108.0, y, 300.0, y + 10]}
    lines = [(1, 1, [108.0, y, 504.0, y + 0.5]) for y in ys] + [(2, 1, [108.0, y, 504.0, y + 0.5]) for y in (100.0, 400.0, 700.0)]
    plain = {"doc": 2, "id": "p", "blockType": "body", "text": _PROSE, "bbox": [108.0, 200.0, 500.0, 230.0], "layoutLines": []}
    return [*rows, caption(1, 86.0), caption(2, 286.0), plain], lines


@query("""
select * from (values (1, 'c1', 'r0,r1,r2,r3', true), (1, 'c2', 'r4,r5,r6,r7', true)) as t(doc, captions, bodies, framed)
""")
def ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11, WIN-08, WIN-10, JOIN-12, JOIN-13, GEO-06 and TOP-05: rules in two groups frame two tables with their captions; rules far apart frame none."""
    rows, lines = _ruled()
    found = tables.detect(_blocks(spark, rows), spark.createDataFrame(lines, "doc int, page int, bbox array<double>")).where("kind = 'table'")
    names = lambda part: F.array_join(F.array_sort(f"{part}BlockIds"), ",")
    b = F.col("bbox")
    return found.select("doc", names("caption").alias("captions"), names("body").alias("bodies"), ((b[0] <= 110) & (b[2] >= 500)).alias("framed"))


@query("""
select * from (values ('d1', 'h1', 100.0::double), ('d2', 'h2', 300.0::double)) as t(id, host, "anchorTop")
""")
def drop_cap_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-24 and JOIN-08: two large letters, each with the paragraph that wraps around it; a paragraph below and a short one are no hosts."""
    words = "nce upon a time there was a house by the river, and nobody lived there."
    cap = lambda i, y: {"doc": 1, "id": i, "text": "O", "bbox": [60.0, y, 80.0, y + 30.0], "fontSize": 30.0, "layoutLines": [_line(60, y, 80, y + 30, {"text": "O"})]}
    host = lambda i, y, text=words: {"doc": 1, "id": i, "blockType": "body", "text": text, "bbox": [62.0, y, 300.0, y + 44.0], "fontSize": 10.0, "layoutLines": [_line(84, y, 300, y + 12), _line(84, y + 14, 300, y + 26), _line(62, y + 32, 300, y + 44)]}
    rows = [cap("d1", 100.0), host("h1", 100.0), host("under", 150.0), cap("d2", 300.0), host("h2", 300.0), host("short", 302.0, "nly this")]
    return styles.drop_cap_hosts(_blocks(spark, rows), F.lit(10.0)).select("id", "host", "anchorTop")


@query("""
select * from (values ('times', 'normal', false, 'Times-Roman'), ('times', 'normal', true, 'Times-Bold'), ('Garamond', 'italic', true, 'Times-Italic'), ('helv', 'monospace', true, 'hebo'), ('HELV', 'bold_italic', false, 'hebi'), ('cour', 'bold', true, 'cour'), ('times', 'monospace', false, 'cour')) as t(family, style, bold, font)
""")
def font_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-05: fonts of families and styles."""
    rows = [("times", "normal", False), ("times", "normal", True), ("Garamond", "italic", True), ("helv", "monospace", True), ("HELV", "bold_italic", False), ("cour", "bold", True), ("times", "monospace", False)]
    b = spark.createDataFrame(rows, "family string, style string, bold boolean")
    return b.withColumn("font", styles.font_name(F.col("family"), F.col("style"), F.col("bold")))


@query("""
select * from (values ('two', 1.0::double, 0.0::double), ('tie', 0.0::double, 1.0::double), ('none', 0.0::double, 0.0::double)) as t(id, red, blue)
""")
def block_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-04: the colour of most characters, the first of equals, black without text."""
    red, blue = [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]
    rows = [
        {"doc": 1, "id": "two", "layoutLines": [_line(0, 0, 9, 9, {"text": "ab", "color": blue}, {"text": "cde", "color": red})]}, {"doc": 1, "id": "tie", "layoutLines": [_line(0, 0, 9, 9, {"text": "ab", "color": blue}), _line(0, 9, 9, 18, {"text": "cd", "color": red})]},
        {"doc": 1, "id": "none", "layoutLines": [_line(0, 0, 9, 9, {"text": " ", "color": red})]},
    ]
    out = styles.primary_colors(_blocks(spark, rows))
    return out.select("id", F.col("color")[0].alias("red"), F.col("color")[2].alias("blue"))


@query("""
select * from (values ('both', 'let <span data-inline-formula="@@INLINE_FORMULA_1@@" translate="no">x &lt; 1</span> be <span data-inline-preserve="@@INLINE_PRESERVE_2@@" translate="no">code</span>', 'x < 1|code', 'formula|preserve'), ('plain', null, null, null)) as t(id, html, texts, kinds)
""")
def formula_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-12: formulas and monospace items of two lines as numbered elements; nothing for a block without them."""
    lines = [_line(0, 0, 90, 9, {"text": "let "}, {"text": "x < 1", "type": "formula", "font": "CMMI10"}), _line(0, 10, 90, 19, {"text": "be "}, {"text": ""}, {"text": "code", "isMonospaceLike": True})]
    rows = [{"doc": 1, "id": "both", "layoutLines": lines}, {"doc": 1, "id": "plain", "layoutLines": [_line(0, 0, 9, 9, {"text": "words"})]}]
    m = formulas.line_markup(F.col("layoutLines"))
    values = lambda part: F.array_join(F.transform(F.array_sort(F.map_entries("m.placeholders")), lambda e: e["value"][part]), "|")
    return _blocks(spark, rows).withColumn("m", m).select("id", "m.html", values("text").alias("texts"), values("kind").alias("kinds"))


@query("""
select * from (values (1, 'Ein @@INLINE_FORMULA_1@@ Wort hier', 's1:4:28,s2:30:34'), (2, 'ohne', '')) as t(k, text, runs)
""")
def translated_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13: text and style runs of a translated block; a run goes on over a placeholder and inner elements."""
    rows = [(1, 'Ein <span data-style-marker="s1"><span data-inline-formula="@@INLINE_FORMULA_1@@" translate="no">x</span> <b>Wor</b></span><i>t</i> <span data-style-marker="s2">hier</span>'), (2, "ohne")]
    out = formulas.answered(spark.createDataFrame(rows, "k int, html string"), "k")
    return out.select("k", "text", F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["marker"], r["start"], r["end"])), ",").alias("runs"))


@query("""
select * from (values (1, 'p1', 'i1'), (1, 'p2', 'i3')) as t(doc, name, item)
""")
def formula_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-21: placeholders with the layout items that they stand for: by box, by text near by, not by text far off."""
    items = [(1, "b", "i1", [0.0, 0.0, 10.0, 5.0], "x"), (1, "b", "i2", [50.0, 0.0, 60.0, 5.0], "y"), (1, "b", "i3", [20.0, 0.0, 30.0, 5.0], "z"), (2, "b", "i1", [0.0, 0.0, 10.0, 5.0], "x")]
    names = [(1, "b", "p1", [0.5, 0.5, 10.5, 5.5], "other"), (1, "b", "p2", [21.5, 1.0, 44.0, 9.0], " z "), (1, "b", "p3", [90.0, 0.0, 99.0, 5.0], "y")]
    found = formulas.matched_items(spark.createDataFrame(names, "doc int, id string, name string, bbox array<double>, text string"), spark.createDataFrame(items, "doc int, id string, item string, bbox array<double>, text string"))
    return found.select("doc", "name", "item")
