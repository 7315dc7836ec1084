"""Queries that return whole tables, against brute force on small fixtures."""

import duckdb
import pytest
from pyspark.sql import functions as F

import papyrion.queries  # noqa: F401
from papyrion import registry
from papyrion.operators import glossary, layout, tables, translate
from papyrion.plans import jobs
from papyrion.queries import fixtures


@pytest.fixture
def run(spark, tmp_path):
    """run(query, **tables): a query's rows over tables given as (rows, schema)."""

    def go(name, **tables):
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{t}.parquet"))
        return registry.QUERIES[name](spark, str(tmp_path)).collect()

    return go


def test_needles_of_all_items(run):
    items = [(k, f"x {n} y") for k, n in enumerate(["aa", "b", "cat", "aa", "zz", "dog", "b", "emu"])] + [(8, "one"), (9, None)]
    docs = [(1, "aaaaa cat dog dog"), (2, "emu b bb"), (3, None), (4, "")]
    found = run("needle_occurrences", benchmark=(items, "item_id long, text string"), documents=(docs, "doc_id long, text string"))
    want = [(d, i, t.count(x.split(" ")[1])) for d, t in docs for i, x in items if t and x and " " in x and x.split(" ")[1] in t]
    assert sorted(map(tuple, found)) == sorted(want) and any(i >= 5 for _, i, _ in want)


def test_escaped_urls_are_normalised(run):
    pages = [(1, "http://a.b/Text/Ch%201.xhtml#a"), (2, "./a+b%2Bc"), (3, "http://a.b/c"), (4, "x/%zz")]
    found = run("href_normalize", pages=(pages, "page_id long, url string"))
    assert sorted(map(tuple, found)) == [(1, "http://a.b/text/ch 1.xhtml", "ch 1.xhtml"), (2, "a+b+c", "a+b+c"), (3, "http://a.b/c", "c"), (4, "x/%zz", "%zz")]


def page_of(lines):
    """The page that ``documents.grid`` makes of the lines {number: (quantity, part, supplier, price)}."""
    line = lambda box, items: [{"bbox": box, "items": [{"type": "text", "text": t, "bbox": b} for t, b in items]}]
    base = {"pageWidth": 612.0, "fontSize": 9.0, "role": "paragraph"}
    box = [80.0, 88.0, 460.0, 100.0]
    out = [{**base, "id": "cap", "bbox": box, "text": "Table 1: order 1", "blockType": "caption", "layoutLines": line(box, [("Table 1", [80.0, 88.0, 130.0, 97.0])])}]
    for k, values in sorted(lines.items()):
        top = 100.0 + 12 * k
        box, words = [80.0, top, 460.0, top + 9], [str(int(v)) for v in values]
        out.append({**base, "id": f"r{k}", "bbox": box, "text": " ".join(words * 2), "blockType": "table_body", "layoutLines": line(box, [(w, [80.0 + 110 * i, top, 130.0 + 110 * i, top + 9]) for i, w in enumerate(words)])})
    return out


def test_tables_of_pages_with_gaps(run):
    """Orders with and without gaps; a gap over 34 points parts two tables, a smaller one does not."""
    orders = {1: (1, 2, 3), 2: (1, 2, 6, 7), 3: (1, 2, 5, 6), 4: (2, 3), 5: (1,), 6: (1, 2, 7), 7: (3, 7), 8: (1, 2, 5)}
    rows = [(o, k, float(10 + k), 100 * o + k, 7 * k, 1000.5 * k) for o, ks in orders.items() for k in ks]
    item = (rows, "l_orderkey long, l_linenumber int, l_quantity double, l_partkey long, l_suppkey long, l_extendedprice double")
    want = {}
    for o in orders:
        lines = {k: (q, p, s, x) for i, k, q, p, s, x in rows if i == o}
        found = [t for t in tables.detect_page(1, page_of(lines), []) if t["kind"] == "table"]
        if found:
            want[o] = (len(found), sum(len(t["bodyBlockIds"]) for t in found), len({i for t in found for i in t["bodyBlockIds"]}))
    assert want[1] == (1, 3, 3) and want[2] == (2, 4, 4) and want[3] == (1, 4, 4)
    detected = {r.doc: (r.tables, r["rows"]) for r in run("table_detect", lineitem=item)}
    assert detected == {o: v[:2] for o, v in want.items()}
    assert {r.doc: r.marked for r in run("table_marks")} == {o: v[2] for o, v in want.items()}


def test_periphery_by_rules(run):
    """Signatures on two pages, and blocks that only a margin rule finds: an identifier on top, a page number at the bottom."""
    page = lambda top, bottom: [top, *(f"plain line {w} of text" for w in "abcdefghij"), bottom]
    docs = [
        (1, "\n".join(page("arXiv:1706 [cs.CL] 2017", "42"))), (2, "\n".join(page("Running title", "7") + page("Running title", "8"))),
        (3, "\n".join(page("Plain top", "plain bottom"))), (4, "\n".join(page("Plain top", "1234"))), (5, None),
    ]
    found = {r.doc: r.n for r in run("periphery_blocks", documents=(docs, "doc_id long, text string"))}
    assert found == {1: 2, 2: 4}


def test_large_glossary_finds_all_short_terms(spark):
    """More terms than are broadcast, most of one or two characters: none is left out."""
    terms = [*"abcdefg一二", "ab", "一二", "Zz", "abc", "long term", "q", ""]
    batches = [(1, "xABc 一二"), (2, "g"), (3, "a long TERM zz"), (4, ""), (5, None), (6, "二")]
    rows = spark.createDataFrame(batches, "id long, content string")
    for most in (3, 1000):
        found = glossary.found_terms(rows, spark.createDataFrame([(t,) for t in [*terms, "a"]], "term string"), most=most)
        assert found.columns == ["id", "content", "term"]
        assert sorted((r.id, r.term) for r in found.collect()) == sorted((i, t) for i, c in batches for t in terms if c and t and t.lower() in c.lower())
    assert glossary.found_terms(rows, spark.createDataFrame([], "term string")).count() == 0


HEADINGS_AS_WRITTEN = [
    (1, "<h1>for&am</h1><p>x</p><h2>a &amp; b</h2>"), (2, "<h1>AT&T &copy 5</h1><h1>&#65 &#x41; &#66;</h1>"), (26, "<h2>x &# y; z</h2><h3>after &# it</h3><script>a && b</script><h4>then &amp</h4>"),
    (27, "<h1>same &lt</h1><h1>same &lt</h1><h1>same &lt;</h1>"), (28, "text &# only <h1>R&D; &</h1><h2>end</h2> &x"), (29, None),
]


@pytest.mark.parametrize("name", ["html_headings_unique", "html_headings_numbered"])
def test_headings_keep_entities_as_written(run, tmp_path, name):
    """Entities without a semicolon, and broken ones, which hide no markup behind them."""
    found = run(name, pages=(HEADINGS_AS_WRITTEN, "page_id long, html string"))
    want = duckdb.sql(registry.ORACLES[name].replace("from pages", f"from '{tmp_path}/pages.parquet/*.parquet'"))
    assert sorted(tuple(r[c] for c in want.columns) for r in found) == sorted(want.fetchall())
    assert {"for&am", "after &# it", "then &amp", "AT&T &copy 5"} <= {r.text for r in found}


def test_numbered_headings_books_divide_like_integers(run, tmp_path):
    """Pages before 0, and numbers that a double can't hold: their books are those of the SQL."""
    pages = [(k, f"<h1>a{k}</h1><p>x</p><h2>b</h2>") for first in (-30, 2**53 - 30) for k in range(first, first + 60)]
    found = run("html_headings_numbered", pages=(pages, "page_id long, html string"))
    want = duckdb.sql(registry.ORACLES["html_headings_numbered"].replace("from pages", f"from '{tmp_path}/pages.parquet/*.parquet'"))
    assert sorted(tuple(r[c] for c in want.columns) for r in found) == sorted(want.fetchall())


def test_chapter_terms_make_no_table_of_all_ngrams(spark):
    """Against brute force: ties, short chapters, terms at borders; counted where the words are."""
    words = lambda k, n: [f"w{(k * 7 + i * i) % 9}" for i in range(n)]
    rows = [(k // 4, k, words(k, n)) for k, n in enumerate((60, 49, 50, 200, 0, 75, 400, 51, 3))]
    lists = spark.createDataFrame(rows, "book long, chapter long, words array<string>")
    found = glossary.chapter_terms(lists)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    want = set()
    for book in {b for b, _, _ in rows}:
        sums: dict = {}
        for _, c, ws in (r for r in rows if r[0] == book and len(r[2]) >= 50):
            for n, most in glossary.CHAPTER_LISTS:
                grams = [" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)]
                top = sorted({g: None for g in grams}, key=lambda g: (-grams.count(g), grams.index(g)))[:most]
                for place, g in enumerate((g for g in top if grams.count(g) >= 3), 1):
                    count, first = sums.get(g, (0, (c, n, place)))
                    sums[g] = (count + grams.count(g), first)
        ranked = sorted(sums, key=lambda g: (-sums[g][0], sums[g][1]))[:150]
        want |= {(book, g, sums[g][0], k) for k, g in enumerate(ranked, 1)}
    assert want and {tuple(r) for r in found.select("book", "term", "count", "place").collect()} == want


def test_contexts_search_only_the_terms_of_a_book(spark, monkeypatch):
    monkeypatch.setattr(glossary, "found_terms", None)  # would look for the terms of all books in each text
    terms = spark.createDataFrame([(1, "Cat"), (1, "dog"), (1, "gone"), (2, "cat"), (2, "")], "book long, term string")
    texts = spark.createDataFrame([(1, 1, "a  DOG"), (1, 2, "a cat and a dog"), (2, 3, None), (2, 4, "Cat")], "book long, chapter long, text string")
    found = {(r.book, r.term): r.context for r in glossary.with_context(terms, texts).collect()}
    assert found == {(1, "Cat"): "...a cat and a dog...", (1, "dog"): "...a DOG...", (1, "gone"): "", (2, "cat"): "...Cat...", (2, ""): ""}


def test_found_terms_do_not_repeat_the_text(spark):
    """2 MB of text with 1500 terms: the text beside each of them would be 3 GB."""
    terms = [f"q{k:04d}" for k in range(1500)]
    text = " ".join(terms) + " x" * 1_000_000
    found = glossary.found_terms(spark.createDataFrame([(1, text), (2, "none")], "id long, content string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    assert [tuple(r) for r in found.groupBy("id").count().collect()] == [(1, 1500)]


def test_vertical_groups_do_not_depend_on_the_order_of_rows(spark):
    """Two blocks of one page, place and id, of which one reaches near the next block."""
    rows = [(1, 3, [0.0, 0.0, 9.0, 11.0]), (1, 3, [0.0, 0.0, 9.0, 60.0]), (1, 4, [0.0, 72.0, 9.0, 80.0])]
    for some in (rows, rows[::-1], [rows[1], rows[0], rows[2]]):
        found = layout.vertical_groups(spark.createDataFrame(some, "page long, id int, bbox array<double>").coalesce(1), ("page",))
        assert {(r.id, r.group) for r in found.collect()} == {(3, 0), (4, 0)}


def job_payload(spark):
    """Documents of each kind: a table of numbers, a body of cells, a page on its side, repeated margins, references, plain lines."""
    rows = []

    def put(doc, page, name, box, text, **more):
        item = {"type": "text", "text": text, "bbox": box}
        rows.append({"doc": doc, "page": page, "id": name, "pageWidth": 600.0, "pageHeight": 720.0, "bbox": box, "text": text, "role": "paragraph", "fontSize": 10.0 + len(text or "") % 3, "layoutLines": [{"bbox": box, "items": [item]}], **more})

    numbers = " ".join(str(1000 + k) for k in range(40))
    for doc in (1, 2, 3):
        for page in (1, 2, 3):
            put(doc, page, f"p{page}_h", [72.0, 40.0, 300.0, 54.0], f"Chapter {page} of a book" if doc < 3 else f"only here {'abc'[page - 1]}")
            for k in range(4):
                put(doc, page, f"p{page}_b{k}", [72.0, 100.0 + 56 * k, 512.0, 142.0 + 56 * k], numbers if (doc, page) == (1, 2) else "Plain words, and more of them. " * 4)
            put(doc, page, f"p{page}_n", [72.0, 680.0, 90.0, 694.0], str(page))
    put(4, 1, "r", [72.0, 80.0, 200.0, 94.0], "References", role="heading")
    put(4, 1, "s", [72.0, 120.0, 500.0, 134.0], "Somebody wrote something, somewhere.")
    put(4, 2, "t", [72.0, 120.0, 500.0, 134.0], None)
    cells = [{"bbox": [80.0, 100.0 + 14 * k, 460.0, 109.0 + 14 * k], "items": [{"type": "text", "text": t, "bbox": [80.0 + 130 * j, 100.0 + 14 * k, 130.0 + 130 * j, 109.0 + 14 * k]} for j, t in enumerate(("word", "cell", "other"))]} for k in range(6)]
    put(5, 1, "cap", [60.0, 80.0, 420.0, 92.0], "Table 1. Values")
    put(5, 1, "body", [60.0, 100.0, 420.0, 180.0], "word cell other " * 6, layoutLines=cells, blockType="body")
    for k in range(9):
        put(6, 1, f"v{k}", [60.0 + 40 * k, 100.0, 75.0 + 40 * k, 300.0], f"side {k}")
    put(7, 1, "d", [60.0, 100.0, 75.0, 110.0], "one", doclingLabel="table")
    put(7, 1, "e", [60.0, 112.0, 75.0, 122.0], "two", doclingLabel="table")
    return fixtures._blocks(spark, rows)


def plain_job(payload, translator):
    """The job's operators one after the other, joined by block."""
    base = layout.mark_references(payload)
    typed = base.join(layout.page_body_size(base), ["doc", "page"]).withColumn("blockType", F.coalesce("blockType", layout.block_type(F.lit(None).cast("double"), F.col("bodySize"))))
    marked = tables.mark(typed, tables.detect(typed.drop("bodySize")))
    margin = layout.periphery(marked).withColumn("_margin", F.lit(True))
    kept = marked.join(margin, ["doc", "id"], "left").withColumn("preserveOriginal", F.coalesce("preserveOriginal", F.lit(False)) | F.coalesce("_margin", F.lit(False)))
    sent = translate.translate(kept.where("not preserveOriginal").select("doc", "id", "text"), translator, "text", pause=0).select("doc", "id", F.col("translated").alias("translatedText"))
    return layout.decide(kept.drop("translatedText").join(sent, ["doc", "id"], "left")).select("doc", "page", "id", "blockType", "renderPolicy", "action", "translatedText", "tableId", "tableRole")


def test_block_job_detects_tables_once_and_only_where_they_may_be(spark, monkeypatch):
    payload, seen, detect = job_payload(spark), [], tables.detect
    want = sorted(map(repr, plain_job(payload, translate.Upper()).collect()))
    monkeypatch.setattr(tables, "detect", lambda blocks, *a: seen.append(blocks) or detect(blocks, *a))
    out = jobs.blocks(payload, translate.Upper())
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    found = out.collect()
    assert sorted(map(repr, found)) == want and len(want) == payload.count()
    assert {r.doc for r in found if r.tableId} == {1, 5, 6}
    assert sorted({(r.doc, r.page) for b in seen for r in b.select("doc", "page").collect()}) == [(1, 2), (5, 1), (6, 1), (7, 1)]


def test_block_job_gives_a_block_once(spark):
    """Two blocks of one document and id, and blocks without a document."""
    payload = job_payload(spark)
    twice = payload.where("doc = 2").unionByName(payload.where("doc = 2")).unionByName(payload.where("doc = 3").withColumn("doc", F.lit(None).cast("int")))
    assert jobs.blocks(twice, translate.Upper()).count() == twice.count() == 54
