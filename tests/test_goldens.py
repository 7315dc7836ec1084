"""Hand-traced cases of single operators, and the inline fixtures of layout and tables."""

import time
import pytest
from pyspark.sql import functions as F

from papyrion.functions import geom, languages, text
from papyrion.operators import batching, glossary, layout, selection, structure, tables, translate
from papyrion.sources import html as dom
from papyrion.sources import srt


def column(spark, values, make):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
    return [r[0] for r in rows.orderBy("k").select(make("x")).collect()]


def test_text_classifier(spark):
    cases = {
        "": "empty", "Table 3": "caption_label", "Figure 1: Results": "default_keep", "12": "short_noise", "1.5": "short_noise", "A b": "short_noise", "123": "numeric_only", "....a": "broken_ocr_fragment",
        "x^2 + y^2 = z": "formula_like_text", "the state |0⟩ equals the vector = here": "quantum_notation", "--- *** ---": "mostly_symbols", "Привет мир": "mostly_symbols",
    }
    got = column(spark, list(cases), lambda x: text.classify_text(x)["reason"])
    assert dict(zip(cases, got, strict=True)) == cases
    assert column(spark, ["Привет мир"], lambda x: text.classify_text(x, unicode=True)["reason"]) == ["default_keep"]


def test_languages(spark):
    assert column(spark, ["El niño comió", "à la forêt", "été année", "これ", "привет", "12"], text.infer_language) == ["Spanish", "French", "English", "Japanese", "Russian", None]
    assert column(spark, ["chinese simplified", "ENG", "Chinese (Simplified)", "xx"], lambda x: languages.language_name(F.col(x))) == ["Chinese (Simplified)", "English", "Chinese (Simplified)", None]


def test_units_and_signatures(spark):
    assert column(spark, ["Ab 1你"], text.text_units) == [3.27]
    assert column(spark, ["Page 12 of 40"], text.signature) == ["page # of #"]


def test_batches():
    assert batching.assign([3000, 2500, 6000, 10], 5000, 0) == [0, 1, 2, 3]
    assert batching.assign([10] * 25, 6000, 24) == [0] * 24 + [1]


def test_page_selectors():
    assert selection.parse_pages("3-4,1,3") == [1, 3, 4] and selection.parse_pages(None) is None
    for wrong in ("4-2", ",1", " ", "0", "a"):
        with pytest.raises(ValueError):
            selection.parse_pages(wrong)


def test_chapter_selection(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["One", "Two", "Two", "Four, five", "Six"])], "ord int, title string")
    pick = lambda spec: [r.ord for r in selection.select_chapters(rows, spec).orderBy("ord").collect()]
    assert pick("3-1") == [0, 1, 2] and pick("one, 5") == [0, 4] and pick('"Four, five"') == [3] and pick('"One"-"Six"') == [0, 1, 2, 3, 4]
    for wrong in ("Two", "7", "nothing"):
        with pytest.raises(ValueError):
            pick(wrong)


def test_plan_order(spark):
    chapters = spark.createDataFrame([(1, c, k) for k, c in enumerate("abcd")], "book int, chapter string, ord int")
    plan = spark.createDataFrame([(1, c, k) for k, c in enumerate("cxac")], "book int, chapter string, pos int")
    assert [r.chapter for r in selection.plan_order(chapters, plan).orderBy("place").collect()] == ["c", "a", "b", "d"]


def test_top_terms_keep_first_seen(spark):
    words = spark.createDataFrame([(1, 1, list("baba"))], "book int, chapter int, words array<string>")
    assert [(r.term, r["count"]) for r in glossary.top_terms(glossary.ngrams(words, 1), 2).orderBy("place").collect()] == [("b", 2), ("a", 2)]


def test_ngrams_run_across_short_chapters(spark):
    """Chapters of one word, in order, give the n-grams of the book as one list does."""
    lists = [["a", "b", "c"], ["d"], ["e"], ["f", "g"], ["h"]]
    words = spark.createDataFrame([(1, k, w) for k, w in enumerate(lists)] + [(2, 0, ["x"])], "book int, chapter int, words array<string>")
    flat = [w for part in lists for w in part]
    for n in (1, 2, 3, 4):
        found = glossary.ngrams(words, n)
        assert [r.term for r in found.where("book = 1").orderBy("chapter", "pos").collect()] == [" ".join(flat[k : k + n]) for k in range(len(flat) - n + 1)]
        assert found.where("book = 2").count() == (n == 1)
    assert [r.term for r in glossary.ngrams(words, 2, ("book", "chapter")).where("book = 1").orderBy("chapter", "pos").collect()] == ["a b", "b c", "f g"]


def test_hrefs(spark):
    assert column(spark, ["./Text/Ch%201.xhtml#a", "a+b%2Bc", "%zz"], lambda x: structure.normalize_href(F.col(x))) == ["text/ch 1.xhtml", "a+b+c", "%zz"]


def test_boxes(spark):
    box = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    row = spark.range(1).select(geom.overlap_ratio(box(0, 0, 10, 10), box(5, 5, 20, 20)), geom.rgb(F.lit(0xFF0080))[2], geom.bucket(F.lit(25.0), 10.0)).first()
    assert row[0] == 0.25 and abs(row[1] - 128 / 255) < 1e-9 and row[2] == 2


def test_fonts(spark):
    r = layout.font_sizes(spark.createDataFrame([(1, s) for s in (10.0, 10.0, 12.0, 12.0)], "page int, size double"), ("page",)).first()
    assert (r.dominant, r.representative) == (12.0, 11.0)


def test_formula_spans(spark):
    plain = ["ROBE", "O", "IEEE", "TABLE", "Fig", "et", "al", "A", "1"]
    maths = ["α", "β", "x_i", "x^2", "O(n)", "sin(x)", "∑", "x ≤ y", "10⁻³"]
    got = column(spark, plain + maths, lambda x: text.formula_span(x, F.lit("NimbusRomNo9L-Regu")))
    assert got == [False] * 9 + [True] * 9


def test_cues(spark):
    content = "﻿1\r\n00:00:01,000 --> 00:00:02,500 align:start\r\nHi\r\nthere\r\n\r\n\r\nname\n00:00:03,000 --> 00:00:04,000\nBye\n\n3\nbad\n\nalone"
    rows = srt.parse(spark.createDataFrame([(1, content)], "f int, content string")).orderBy("sequence").collect()
    assert [(r.id, r.cue_identifier, r.start_ms, r.settings, r.source_text) for r in rows[:2]] == [("node_00001", None, 1000, "align:start", "Hi\nthere"), ("node_00002", "name", 3000, "", "Bye")]
    assert [r.error is None for r in rows] == [True, True, False, False]


def test_visible_and_structural_nodes():
    root = dom.parse("<html><body><nav><p>Menu entry</p></nav><div><p>First words here</p><p>Second <b>bold</b> words</p></div><script>var x='<p>';</script><p>***</p></body></html>")
    assert [(n.tag, dom.squeeze(n.text)) for i, _, n, _ in dom.visible(dom.body(root)) if i] == [("p", "Menu entry"), ("div", "First words hereSecond bold words"), ("p", "First words here"), ("p", "Second bold words")][:1] + [(n.tag, dom.squeeze(n.text)) for i, _, n, _ in dom.visible(dom.body(root)) if i][1:]
    kept = [(n.tag, dom.squeeze(n.text)) for i, _, n, _ in dom.structural_body(root) if i]
    assert ("p", "Menu entry") not in kept and ("p", "First words here") in kept
    assert {r for i, _, _, r in dom.structural_body(root) if not i} >= {"blacklisted_tag", "blocked_ancestor", "mostly_symbols"}


def test_deep_markup_is_no_limit():
    root = dom.parse("<div>" * 3000 + "deep words in here" + "</div>" * 3000)
    assert dom.squeeze(root.text) == "deep words in here" and len(list(root.walk())) == 3000
    began = time.process_time()
    root = dom.parse("<div>" * 5000 + "deep words in here" + "</div>" * 5000)
    rows = [(node.path, node.html) for *_, node, _ in dom.visible_body(root)]
    assert len(rows) == 5000 and rows[4999][0].count(" > ") == 4999 and time.process_time() - began < 5


def test_surveyed_trees_tell_what_changed_trees_tell():
    """Texts, markup, paths and what is below, from the pass over the page and from the nodes themselves."""
    for page in ("<p>a<p>b<b>c</b><br>d", "<ul><li>1<li>2<a href=x>3</a></ul><div>&amp;x</div>", "<div><div>a</div><span>b</span><div><button>c</button></div></div>", "", "text only"):
        root = dom.parse(page)
        told = [(n.text, n.html, n.path, dom.interactive(n), dom.text_dominant(n), [c.tag for c in n.elements]) for n in root.walk()]
        root.page.live = False
        assert told == [(n.text, n.html, n.path, dom.interactive(n), dom.text_dominant(n), [c.tag for c in n.elements]) for n in root.walk()]


def test_anchor_titles():
    root = dom.parse('<h1>Page</h1><div id="a"></div><h2>Next<sup>1</sup></h2><p id="b">Own text</p><hgroup id="g"><h2>I</h2><h4>Start</h4></hgroup>')
    assert [dom.anchor_title(root, a) for a in ("a", "b", "g")] == ["Next", "Own text", "I：Start"]


def test_translator_failures():
    class Broken:
        def __init__(self, error):
            self.error = error

        def translate(self, texts):
            raise self.error

    out, error, used = translate.call(Broken(ValueError("no json")), ["a", ""], pause=0)
    assert out == [None, ""] and "no json" in error and used == 3
    out, error, _ = translate.call(Broken(RuntimeError("content policy violation")), ["a"], pause=0, fallback=translate.Upper())
    assert out == ["A"] and error == ""


# ---------------------------------------------------------------- layout fixtures

BLOCK = "id string, page int, pageWidth double, pageHeight double, bbox array<double>, text string, translatedText string, fontSize double, rotation int, role string, blockType string, doclingLabel string, renderPolicy string, preserveOriginal boolean, preserveReason string, isBodyLike boolean, translationMetaNote string, layoutLines array<struct<bbox:array<double>,items:array<struct<type:string,text:string,bbox:array<double>,isBoldLike:boolean,isItalicLike:boolean,isMonospaceLike:boolean>>>>"


def block(**known):
    base = dict.fromkeys(c.split()[0] for c in BLOCK.split(", ") if " " in c)
    return {**base, "page": 1, "pageWidth": 600.0, "pageHeight": 800.0, "fontSize": 10.0, "bbox": [0.0, 0.0, 320.0, 42.0], "text": "", **known}


def line(x0, y0, x1, y1, *items):
    return {"bbox": [float(v) for v in (x0, y0, x1, y1)], "items": [{"type": "text", "text": "words", "bbox": [float(v) for v in (x0, y0, x1, y1)], **i} for i in (items or ({},))]}


def judged(spark, rows, make):
    return [r[0] for r in spark.createDataFrame(rows, BLOCK).select(make).collect()]


def test_caption_policies(spark):
    two = [line(0, 0, 300, 20), line(0, 21, 280, 42)]
    rows = [
        block(blockType="caption", layoutLines=two), block(blockType="caption", layoutLines=[line(0, 0, 300, 20, {"isBoldLike": True}), two[1]]), block(blockType="caption", layoutLines=[line(0, 0, 300, 20, {"type": "formula"}), two[1]]),
        block(blockType="caption", bbox=[0.0, 0.0, 260.0, 42.0], layoutLines=[line(0, 0, 60, 10), line(90, 11, 150, 20), line(180, 21, 240, 30)]), block(blockType="body"), block(blockType="code"),
    ]
    assert judged(spark, rows, layout.render_policy()) == ["plain_reflow", "mixed_reflow", "plain_reflow", "preserve_visual", "plain_reflow", "structured_layout"]
    assert judged(spark, rows, layout.full_reflow()) == [True, True, True, True, True, False]


def test_actions(spark):
    rows = [
        block(blockType="caption", renderPolicy="preserve_visual", translatedText="x"), block(blockType="body", translatedText="x"), block(blockType="body", translatedText=""), block(blockType="table_body", translatedText="x"),
        block(blockType="body", text="[12] A reference", translatedText="x"), block(blockType="body", doclingLabel="picture", translatedText="x"),
    ]
    assert judged(spark, rows, layout.action()) == ["preserve", "replace", "review", "preserve", "preserve", "review"]


def test_side_metadata(spark):
    row = block(blockType="metadata", pageWidth=612.0, pageHeight=792.0, bbox=[582.62, 16.0, 590.30, 783.76], text="Authorized licensed use limited to someone, downloaded on a day")
    assert judged(spark, [row], layout.side_marginalia()) == [True] and judged(spark, [row], layout.strong_side_metadata()) == [True]


def test_references(spark):
    names = [("h", "Intro"), ("p", "text"), ("h", "References"), ("p", "r1"), ("p", "r2"), ("h", "Appendix"), ("p", "x")]
    rows = [block(id=str(k), role="heading" if r == "h" else "paragraph", text=t, bbox=[0.0, 20.0 * k, 9.0, 20.0 * k + 9]) for k, (r, t) in enumerate(names)]
    out = layout.mark_references(spark.createDataFrame(rows, BLOCK).withColumn("doc", F.lit(1)))
    assert [r.text for r in out.where("blockType = 'reference_block'").orderBy("id").collect()] == ["r1", "r2"]


# ---------------------------------------------------------------- table fixtures


def cells(top, texts, x=60, step=120, w=60):
    return {"bbox": [x, top, x + step * len(texts), top + 10], "items": [{"type": "text", "text": t, "bbox": [x + step * k, top, x + step * k + w, top + 10]} for k, t in enumerate(texts)]}


def test_single_body_table():
    cap = {"id": "cap", "page": 1, "pageWidth": 612, "blockType": "caption", "text": "Table 1. Values", "bbox": [60, 80, 420, 92], "fontSize": 9, "layoutLines": []}
    body = {"id": "body", "page": 1, "pageWidth": 612, "blockType": "body", "text": "word cell other " * 6, "bbox": [60, 100, 420, 180], "fontSize": 9, "layoutLines": [cells(100 + 14 * k, ["word", "cell", "other"]) for k in range(6)]}
    found = tables.detect_page(1, [cap, body], [])
    assert [(t["kind"], t["captionBlockIds"], t["bodyBlockIds"], t["headerBlockIds"]) for t in found] == [("table", ["cap"], ["body"], [])]
    prose = {**body, "text": "This is a long sentence of running text, which goes on and on, and has many words in it. It never is a table, of course.", "layoutLines": [cells(100, ["This is a long sentence"])]}
    assert tables.detect_page(1, [cap, prose], []) == []


def test_rules_split_and_refine():
    lines = [(108.0, y, 504.0, y + 0.5) for y in (100, 120, 140, 160, 180, 300, 320, 340, 360, 380)]
    (group,) = tables.group_rules(lines, 612)
    assert [len(p) for p in tables.split_rules(group)] == [5, 5]
    regions = tables.rule_regions(lines, 612)
    assert len(regions) == 2 and regions[0][0][3] < 240 and regions[1][0][1] > 290
    eight = [(108.0, float(y), 504.0, y + 0.5) for y in (100, 115, 130, 145, 160, 200, 215, 230)]
    caption = tables.Block({"id": "c", "blockType": "caption", "bbox": [110, 170, 500, 190], "text": "Table 2"}, 612)
    assert [len(r) for _, r in tables.split_by_captions((tables.union(eight), eight), [caption])] == [5, 3]
    assert tables.refine((100, 321.249, 500, 400), [(100.0, 200.0, 500.0, 200.5)])[1] == 321.249


def test_algorithm():
    title = {"id": "cap", "pageWidth": 600, "blockType": "caption", "text": "Algorithm 1 Search", "bbox": [60, 80, 540, 92], "layoutLines": []}
    step = lambda n, top: {"id": f"alg{n}", "pageWidth": 600, "blockType": "body", "text": "1: Input queue 2: while not empty 3: return the loss", "bbox": [60, top, 540, top + 40], "layoutLines": []}
    prose = {"id": "p", "pageWidth": 600, "blockType": "body", "text": "After that we go on with plain text, as before. It says nothing.", "bbox": [60, 200, 540, 240], "layoutLines": []}
    found = tables.detect_page(3, [title, step(1, 96), step(2, 140), prose], [])
    assert [(s["id"], s["kind"], s["bodyBlockIds"]) for s in found] == [("p3_a1", "algorithm", ["alg1", "alg2"])]


def test_dedupe_and_merge():
    t = lambda i, ids, box, cap=(): {"id": i, "bbox": list(box), "displayBBox": list(box), **{f"{p}BlockIds": [] for p in ("header", "footnote")}, **{f"{p}Texts": [] for p in ("body", "header", "caption", "footnote")}, "bodyBlockIds": list(ids), "captionBlockIds": list(cap)}
    assert [x["id"] for x in tables.dedupe([t("a", "xy", (0, 0, 1, 1)), t("b", "xyz", (0, 0, 1, 1)), t("c", "q", (0, 0, 1, 1))])] == ["b", "c"]
    merged = tables.merge(2, [t("p2_t1", "a", (50, 100, 400, 150)), t("p2_t2", "b", (50, 160, 405, 200)), t("p2_t3", "c", (50, 210, 400, 250), ["k"])], [])
    assert [(x["id"], x["bodyBlockIds"]) for x in merged] == [("p2_t1", ["a", "b"]), ("p2_t2", ["c"])]


@pytest.mark.parametrize("degrees", [90, 270])
def test_rotation(degrees):
    region, box = (40.0, 80.0, 240.0, 380.0), (92.0, 118.0, 156.0, 344.0)
    assert tables.turn_back(tables.turn(box, region, degrees), region, degrees) == pytest.approx(box, abs=1e-4)
