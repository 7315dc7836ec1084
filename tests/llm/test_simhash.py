import numpy as np
import xxhash
from pyspark.sql import functions as F

from papyrion.llm import components, simhash

DOCS = "doc_id long, text string, lang string, fp string, component_id long, v string"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """Smallest reachable id by comparing all fingerprints."""
    prints = [plain_fingerprint(t) for _, t in rows]
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if bin(prints[a] ^ prints[b]).count("1") <= 2 and label[a] is not None and (label[b] is None or label[a] < label[b]):
                    label[b], changed = label[a], True
    return sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, label, strict=True)), key=str)


def test_fingerprint_cases():
    for text in ("", "   \n", "One", "One TWO", "a b c d e", "É É e", "a b c " * 40, "x y"):
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_hash_is_spark_xxhash64(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("of the und")).alias("h")).first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest(b"of the und", 42)


def test_edges_against_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog near the bank of the river today " * 6
    rows = [(10, base), (3, base.upper()), (7, base), (7, base), (4, base + " end"), (5, None), (6, ""), (9, " \t "), (None, base), (None, "other words stand here alone"), (12, "word " * 20000)]
    rows += [(20 + k, base.replace("lazy", f"lazy{k}", 1)) for k in range(6)]
    df = spark.createDataFrame([(i, t, "en", "x", -1, "y") for i, t in rows], DOCS)
    out = simhash.near_duplicates(df)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str) == brute(rows)


def test_search_finds_all_pairs_below_one_node():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([centre ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(12)] + [centre]))
    labels = simhash.search(fp, np.zeros(len(fp), dtype=np.int64))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
    expected = np.arange(len(fp))
    while True:
        new = np.array([expected[near[k]].min() for k in range(len(fp))])
        if (new == expected).all():
            break
        expected = new
    assert (labels == expected).all()


def test_hot_nodes_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_NODE", 4)
    fps = [0b1011 << 40 | 1 << a | 1 << b for a in range(6) for b in range(a + 1, 24)]
    df = spark.createDataFrame([(f,) for f in set(fps)], "fp long")
    roots = components.components(simhash.links(df))
    assert roots.select("root").distinct().count() == 1
    assert roots.count() == len(set(fps))


def test_components_of_a_path_and_a_star(spark):
    name = lambda k: int(components.mix64(np.array([k])).view(np.int64)[0])
    path = [(k, k + 1) for k in range(30)]
    star = [(100, 101 + k) for k in range(50)]
    edges = [(name(a), name(b)) for a, b in path + star + [(5, 5), (1, 0)]]
    out = components.components(spark.createDataFrame(edges, "a long, b long"))
    groups = {}
    for v, root in out.collect():
        groups.setdefault(root, set()).add(v)
    assert sorted(map(len, groups.values())) == [31, 51]


def test_keep_first(spark):
    t = "one two three four five six seven eight nine ten " * 3
    rows = [(2, t, "a", "", 0, ""), (1, t, "b", "", 0, ""), (1, t, "b", "", 0, ""), (3, "something else is written here", "c", "", 0, ""), (None, t, "d", "", 0, "")]
    out = simhash.keep_first(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "lang", "fp", "component_id", "v"]
    assert sorted((r.doc_id, r.lang) for r in out.collect()) == [(1, "b"), (3, "c")]  # the copy without an id goes too


def test_keep_first_of_rows_without_an_id(spark):
    one, two = (f"{w} one two three four five six seven eight nine ten {w} " * 3 for w in ("apple", "river"))
    rows = [(None, one, "a", "", 0, ""), (None, two, "b", "", 0, ""), (None, two, "b", "", 0, ""), (None, "", "c", "", 0, ""), (None, None, "d", "", 0, ""), (4, one, "e", "", 0, "")]
    out = [(r.doc_id, r.lang) for r in simhash.keep_first(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(map(str, out)) in (["(4, 'e')", "(None, 'b')", "(None, 'c')"], ["(4, 'e')", "(None, 'b')", "(None, 'd')"])


def test_keep_first_judges_texts_under_one_id_each(spark):
    one, two, three = (f"{w} one two three four five six seven eight nine ten {w} " * 3 for w in ("apple", "river", "stone"))
    rows = [(5, one, "a", "", 0, ""), (5, two, "b", "", 0, ""), (5, two, "b", "", 0, ""), (5, three, "c", "", 0, ""), (3, three, "d", "", 0, ""), (9, one, "e", "", 0, "")]
    assert sorted((r.doc_id, r.lang) for r in simhash.keep_first(spark.createDataFrame(rows, DOCS)).collect()) == [(3, "d"), (5, "a"), (5, "b")]


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_first(df).count() == 0
