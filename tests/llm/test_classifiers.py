import math
import random
import zlib

import numpy as np
import pytest

from papyrion.llm import quality as Q
from papyrion.llm import toxicity as X

rng = random.Random(11)
WORDS = ["".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeou") for _ in range(rng.randint(2, 4))) for _ in range(300)]


def text_of(n, extra=()):
    words = [rng.choice(WORDS) for _ in range(n)]
    for w in extra:
        words.insert(rng.randrange(len(words) + 1), w)
    return " ".join(words)


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_folding():
    assert X.fold("1D10T") == X.fold("idiot") == X.fold("іdіоt") == X.fold("ＩＤＩＯＴ")
    assert X.fold("l0ser") == X.fold("loser") and X.fold("tr@$h") == X.fold("trash") and X.fold("i\u200bdiot") == X.fold("idiot")


def test_seed_words_and_exceptions():
    lexicon = X.learn([])
    assert lexicon.found(X.fold("what an 1d10t, you mor0n"))[0] == 2 * X.SEED_WEIGHT
    assert lexicon.found(X.fold("put it into the trash can near the clown fish"))[0] == 0
    assert lexicon.found(X.fold("xidiot"))[0] == 0  # a word begins with an entry or has none
    assert lexicon.score(None) == lexicon.score("") and 0 <= lexicon.score("") < X.THRESHOLD


def test_matches_are_those_of_a_plain_search():
    lexicon = X.learn([])
    for text in (text_of(200, ["moron", "Idiots", "trash", "can"]), "trash trash can moron", "idiot" * 3):
        folded = X.fold(text)
        starts = {}
        for entry, weight in lexicon.weights.items():
            at = folded.find(entry)
            while at >= 0:
                if at == 0 or not folded[at - 1].isalnum():
                    starts[at] = max(starts.get(at, 0), weight)
                at = folded.find(entry, at + 1)
        for phrase in lexicon.exceptions:
            at = folded.find(phrase)
            while at >= 0:
                if at == 0 or not folded[at - 1].isalnum():
                    starts = {s: w for s, w in starts.items() if not at <= s < at + len(phrase)}
                at = folded.find(phrase, at + 1)
        assert lexicon.found(folded)[0] == pytest.approx(sum(starts.values()))


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        docs.append((i, text_of(rng.randint(20, 120), [f"zugblat{rng.choice(['en', 'er', 'isch', 'ung'])}", "idiot"][: 1 + (i % 2)] if toxic else ()), f"s{i % 3}", "en", 7))
        labels.append((i, int(i % 7 > 0), int(toxic)))
    junk = [(i, " ".join(["zz###"] * 60) if y == 0 else t, s, lang, n) for (i, t, s, lang, n), (_, y, _) in zip(docs, labels, strict=True)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long")
    j = spark.createDataFrame(junk, d.schema)
    return d, j, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (y, t) for i, y, t in labels}


def test_toxicity_held_out(labelled):
    docs, _, labels, truth = labelled
    out = X.score(docs, labels).collect()
    assert len(out) == 500 and all(r.held_out == held(r.doc_id) for r in out)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in out)
    test = [r for r in out if r.held_out]
    assert sum(r.predicted == truth[r.doc_id][1] for r in test) / len(test) > 0.97


def test_toxicity_ignores_held_out_labels(labelled, spark):
    docs, _, labels, _ = labelled
    wrong = labels.withColumn("toxic", X.F.when(X.held_out(X.F.col("doc_id")), 1 - X.F.col("toxic")).otherwise(X.F.col("toxic")))
    pick = lambda lab: sorted((r.doc_id, r.score) for r in X.score(docs, lab).collect())
    assert pick(labels) == pick(wrong)


def test_toxicity_edges(labelled, spark):
    docs, _, labels, _ = labelled
    odd = spark.createDataFrame([(None, "idiot moron idiot", "s", "en", 1), (7, None, None, None, None), (7, "", "s", "en", 0), (7, "", "s", "en", 0), (8, "word " * 60000, "s", "en", 1)], docs.schema)
    out = X.score(odd, labels).collect()
    assert len(out) == 5 and not next(r for r in out if r.doc_id is None).held_out
    assert next(r for r in out if r.doc_id is None).predicted == 1
    assert X.score(docs.limit(0), labels).count() == 0
    nulls = spark.createDataFrame([(None, None, 1), (3, None, None), (4, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert X.score(docs, nulls).count() == 500
    kept = X.remove_toxic(docs.unionByName(odd), labels)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 0


def test_quality_held_out(labelled):
    _, docs, labels, truth = labelled
    out = Q.score(docs, labels).collect()
    test = [r for r in out if r.held_out]
    assert len(out) == 500 and sum(r.predicted == truth[r.doc_id][0] for r in test) / len(test) > 0.95


def test_quality_edges(labelled, spark):
    _, docs, labels, _ = labelled
    odd = spark.createDataFrame([(None, "a b", None, None, None), (1, None, "s", "en", 3), (1, "", "s", "en", -3), (2, "word " * 60000, "s", "en", 1)], docs.schema)
    out = Q.score(odd, labels).collect()
    assert len(out) == 4 and all(0 <= v <= 1 for r in out for v in (r.text_score, r.meta_score, r.score))
    assert Q.score(docs.limit(0), labels).count() == 0
    assert {round(r.score, 6) for r in Q.score(docs, labels.limit(0)).collect()} == {0.5}
    slim = docs.select("doc_id", "text")
    assert Q.score(slim, labels).count() == 500


def test_cotraining_exchanges_labels():
    """The metadata view alone knows the label of short texts; exchanged labels teach the text view their words."""
    rows = []
    for k in range(400):
        y = k % 2
        rows.append((text_of(30, ["goodsign" if y else "badsign"] * (k % 3 > 0)), f"site{y}", "en", 100, y))
    judge = Q.cotrain(rows[:60], [r[:4] for r in rows[60:]])
    right = sum((judge.score(*r[:4])[2] >= 0.5) == r[4] for r in rows)
    assert right / len(rows) > 0.97 and judge.meta.scale > 0


def dense(row, width):
    """One row of a view as a plain vector: its shape, then its slots, each over the root of their number."""
    shape, slots = row
    out = np.zeros(width + Q.HASHED)
    out[:width] = shape
    for s in slots:
        out[width + s] = 1 / math.sqrt(len(slots))
    return out


def plain_fit(x, y, width):
    w, g = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-6)
    weight = np.where(y > 0.5, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for _ in range(120):
        grad = x.T @ ((1 / (1 + np.exp(-(x @ w))) - y) * weight) + 1e-3 * w
        g += grad**2
        w -= 0.3 * grad / np.sqrt(g)
    return w


def test_cotraining_against_a_plain_version():
    """The whole exchange with dense vectors and lists, calibration by plain descent: the same scores."""
    rng = np.random.default_rng(5)
    make = lambda good, k: (" ".join(rng.choice(["fine", "calm", "river", "house"] if good else ["buy", "click", "now", "win"], 30)) + (f" n{k}" if k % 3 else ""), "lib1" if good ^ (k % 9 == 0) else "spam2", "en" if k % 4 else None, 100 + 7 * k if k % 5 else None)
    labelled = [(*make(k % 2 == 0, k), k % 2 ^ 1) for k in range(48)]
    unlabelled = [make(k % 3 == 0, 100 + k) for k in range(70)]
    judge = Q.cotrain(labelled, unlabelled)
    widths = {"text": Q.SHAPES, "meta": 6}
    view = {"text": lambda r: dense(Q.text_view(r[0]), Q.SHAPES), "meta": lambda r: dense(Q.meta_view(*r[1:4]), 6)}
    keep, teach = labelled[:12], labelled[12:]
    sets = {k: ([f(r) for r in teach], [float(r[4]) for r in teach]) for k, f in view.items()}
    left = {k: list(range(len(unlabelled))) for k in view}
    for turn in range(Q.ROUNDS + 1):
        models = {k: plain_fit(np.stack(x), np.array(y), widths[k]) for k, (x, y) in sets.items()}
        if turn == Q.ROUNDS:
            break
        gifts = {}
        for k, other in (("text", "meta"), ("meta", "text")):
            p = {i: 1 / (1 + math.exp(-float(view[k](unlabelled[i]) @ models[k]))) for i in left[other]}
            share = float(np.mean(sets[k][1]))
            ups = sorted(p, key=lambda i: (-p[i], i))[: round(Q.EXCHANGED * share)]
            downs = sorted(p, key=lambda i: (p[i], i))[: round(Q.EXCHANGED * (1 - share))]
            gifts[other] = [(i, 1.0) for i in ups if p[i] >= Q.SURE] + [(i, 0.0) for i in downs if p[i] <= 1 - Q.SURE]
        assert turn or any(gifts.values())
        for k, given in gifts.items():
            for i, y in given:
                sets[k][0].append(view[k](unlabelled[i]))
                sets[k][1].append(y)
                left[k].remove(i)
    y = np.array([float(r[4]) for r in keep])
    target = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    prior, logits = math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), {}
    for k in view:
        z = np.array([view[k](r) @ models[k] for r in keep])
        mean, spread = z.mean(), z.std()
        a, b = 1.0, 0.0
        for _ in range(60000):
            q = 1 / (1 + np.exp(-(a * (z - mean) / spread + b)))
            a, b = a - 0.05 * float(((q - target) * (z - mean) / spread).sum() + 0.1 * a), b - 0.05 * float((q - target).sum())
        logits[k] = (a, b, mean, spread)
    for row in unlabelled[:20]:
        own = {k: logits[k][0] * (float(view[k](row) @ models[k]) - logits[k][2]) / logits[k][3] + logits[k][1] for k in view}
        want = 1 / (1 + math.exp(-(own["text"] + own["meta"] - prior)))
        assert abs(judge.score(*row)[2] - want) < 1e-3
