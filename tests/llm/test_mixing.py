import hashlib
import re

import duckdb
import pytest

from papyrion.llm import mixing
from papyrion.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, source string, size int, key string"


def water_fill(sizes):
    """Targets by handing out again what is over, until nothing is."""
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    left, target, free = float(sum(sizes.values())), dict.fromkeys(sizes, 0.0), set(sizes)
    while free:
        share = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        full = {s for s in free if share[s] > 3 * sizes[s]}
        for s in full or free:
            target[s] = 3.0 * sizes[s] if full else share[s]
            left -= target[s] if full else 0
        free = free - full if full else set()
    return target


def make(spark, rows):
    return spark.createDataFrame([(i, t, s, 9, "x") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return [(k, "w " * (k % 7 + 1), ("a", "b", None, "d", "é")[k % 5] if k % 3 else "a") for k in range(300)]


def test_targets_and_bounds(spark, rows):
    out = mixing.mix(make(spark, rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    goal, got = water_fill(sizes), {}
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6
        assert r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"]
        got[r.source] = got.get(r.source, 0) + r.taken
    assert len(out) == len(rows)
    for s in sizes:
        assert abs(got[s] - goal[s]) <= 2 * 7
    assert sum(got.values()) <= sum(sizes.values())


def test_against_a_plain_queue(spark, rows):
    """The order of service and the cut, done with lists."""
    goal = water_fill({s: sum(len(t.split()) for _, t, x in rows if x == s) for s in {r[2] for r in rows}})
    events = []
    for s in goal:
        mine = sorted(((hashlib.md5(f"42:{i}".encode()).hexdigest(), i, len(t.split())) for i, t, x in rows if x == s))
        whole, total = sum(n for *_, n in mine), 0
        for copy in range(3):
            for key, i, n in mine:
                if (total) / goal[s] < 1 - 1e-12:
                    events.append(((total + n) / goal[s], key, i, n))
                total += n
        assert total == 3 * whole
    taken, used, budget = {}, 0, sum(len(t.split()) for _, t, _ in rows)
    for _, _, i, n in sorted(events):
        if used + n > budget:
            break
        used += n
        taken[i] = taken.get(i, 0) + n
    assert {r.doc_id: r.taken for r in mixing.mix(make(spark, rows)).collect() if r.taken} == taken


def test_reruns_agree(spark, rows):
    a = sorted(map(tuple, mixing.mix(make(spark, rows)).drop("source").collect()))
    b = sorted(map(tuple, mixing.mix(make(spark, rows[::-1]).repartition(3)).drop("source").collect()))
    assert a == b


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", "a"), (3, "x y z", None), (3, "x y z", None), (4, "word " * 50000, "b")]
    out = mixing.mix(make(spark, rows)).collect()
    assert len(out) == 6 and sum(r["size"] for r in out) == 50008
    assert all(r.taken == 0 for r in out if r["size"] == 0)
    assert mixing.mix(make(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(make(spark, [(1, None, None)])).collect()] == [0]


def test_apply_mix_repeats_rows(spark, rows):
    df = make(spark, [*rows, (1000, "dup words", "b"), (1000, "dup words", "b")])
    copies = {}
    for r in mixing.mix(df).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    got = {}
    applied = mixing.apply_mix(df)
    assert applied.columns == df.columns
    for r in applied.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in copies.items() if v}


def test_apply_mix_keeps_texts_apart(spark):
    """Different texts under one id (or none), of one source and size, each come as often as they are taken."""
    rows = [(None, f"text{k} of five words here", "a") for k in range(40)] + [(7, f"other{k} three words", "b") for k in range(6)]
    rows += [(100 + k, "w " * 9, "b") for k in range(3)]
    df = make(spark, rows)
    got = {}
    for r in mixing.apply_mix(df).collect():
        got[r.text] = got.get(r.text, 0) + 1
    plan = [r for r in mixing.mix(df).collect() if r.copies]
    assert max(v for t, v in got.items() if t[0] in "to") <= mixing.MOST_COPIES
    for key in (None, 7):
        assert sorted(r.copies for r in plan if r.doc_id == key) == sorted(v for t, v in got.items() if t.startswith("text" if key is None else "other"))


def test_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(con.sql(ORACLES["op8_mixing"]).fetchall()) == sorted(map(tuple, QUERIES["op8_mixing"](spark, sf).collect()))
