import random

from papyrion.llm import decontaminate as D

SCHEMA = "doc_id long, text string, item_id long, source string"


def distance_in(pattern, text):
    """Least edit distance of the pattern to any passage, by the table of all prefixes."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def brute(docs, items, rate=D.RATE):
    out = set()
    for doc, text in docs:
        for item, wanted in items:
            p = D.normalise(wanted or "")
            if item is not None and len(p) >= D.MIN_CHARS and (d := distance_in(p, D.normalise(text or ""))) <= int(rate * len(p)):
                out.add((doc, item, d))
    return out


def test_myers_against_the_table():
    rng = random.Random(3)
    for _ in range(400):
        p = "".join(rng.choice("abc ") for _ in range(rng.randint(2, 70)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 90)))
        best = D.Pattern(p).best(t, len(p) - 1)
        assert (best[0] if best else len(p)) == distance_in(p, t)


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        k = rng.randrange(len(text))
        text[k : k + 1] = rng.choice([["x"], [], [text[k], "q"]])
    return "".join(text)


def test_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(rng.randint(6, 30)))) for k in range(12)] + [(12, "short"), (13, None), (14, ""), (None, "no id at all but long enough to count"), (0, "a second text of item zero, repeated here")]
    docs = []
    for k in range(60):
        filler = " ".join(word() for _ in range(40))
        item = items[k % 12][1]
        docs.append((k, f"{filler} {edited(rng, item.upper(), k % 9)}\n{filler}"))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (None, items[1][1]), (103, "filler words " * 9000 + items[2][1])]
    d = spark.createDataFrame([(i, t, 7, "s") for i, t in docs], SCHEMA)
    b = spark.createDataFrame([(t, i, "x") for i, t in items], "text string, item_id long, source string")
    out = D.matches(d, b)
    small = [x for x in docs if x[0] != 103]
    assert {(r.doc_id, r.item_id, r.distance) for r in out.collect() if r.doc_id != 103} == brute(small, items)
    assert [(r.item_id, r.distance) for r in out.where("doc_id = 103").collect()] == [(2, 0)]
    assert out.where("doc_id = 102").count() == 2
    kept = D.remove_contaminated(d, b)
    assert kept.columns == d.columns
    hit = {x[0] for x in brute(small, items)} | {103}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, _ in docs if i is not None and i not in hit)
    assert kept.where("doc_id is null").count() == 0


def test_blocks_of_items(spark, monkeypatch):
    items = [(k, f"item number {k} has words of its own {k * 7919}") for k in range(20)]
    d = spark.createDataFrame([(k, f"before {t} after", 0, "") for k, t in items], SCHEMA)
    b = spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in D.matches(d, b).collect()}
    monkeypatch.setattr(D, "BLOCK_CHARS", 100)
    assert {tuple(r) for r in D.matches(d, b).collect()} == whole


def test_short_items_match_as_whole_words(spark):
    items = [(1, "Yes, it is!"), (2, "cat"), (3, "?!"), (4, "a longer item that has its own edit budget")]
    docs = [(1, "so yes it   IS."), (2, "the category of yes it isnt"), (3, "Cat"), (4, "concat, a cat; cat"), (5, "?!"), (6, "yes it s"), (7, "a longer itm that has its own edit budget cat")]
    d = spark.createDataFrame([(i, t, 0, "") for i, t in docs], SCHEMA)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in D.matches(d, b).collect()} == {(1, 1, 0, 0, 12), (3, 2, 0, 0, 3), (4, 2, 0, 0, 12), (7, 2, 0, 0, 45), (7, 4, 1, 2, 41)}
    assert sorted(r.doc_id for r in D.remove_contaminated(d, b).collect()) == [2, 5, 6]


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "text", 0, "")], SCHEMA)
    assert D.matches(d, b).count() == 0 and D.matches(one, b).count() == 0 and D.remove_contaminated(one, b).count() == 1
