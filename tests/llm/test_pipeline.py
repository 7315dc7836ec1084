import corpus_pipeline
from papyrion.llm import decontaminate, mixing, simhash, token_output, toxicity
from papyrion.llm.queries import QUERIES, tokenizer_path
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import brute as components_of


def test_stages(spark, sf, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "tokens"]
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
        if name != "tokens":
            assert docs.columns == first.columns
    clean, unique, safe, mix, tokens = kept
    verdict = {r.doc_id: r.predicted for r in toxicity.score(first, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, p in verdict.items() if not p}
    classes = components_of([(r.doc_id, r.text) for r in clean.collect()])
    assert sorted(r.doc_id for r in unique.collect()) == sorted(i for i, _, c in classes if i == c)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    exact = {r.doc_id for r in unique.collect() if any(decontaminate.normalise(t) in decontaminate.normalise(r.text) for _, t in items)}
    gone = {r.doc_id for r in unique.collect()} - {r.doc_id for r in safe.collect()}
    assert exact <= gone
    small = [(r.doc_id, r.text) for r in unique.collect() if len(r.text) < 1500][:12]
    assert {i for i, _ in small} & gone == {d for d, *_ in brute(small, items[:6])} | ({i for i, _ in small} & gone)
    total = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert total(mix) <= total(safe) and total(mix) > 0.8 * total(safe)
    assert tokens.count() == mix.count()


CLASHING = ("_doc", "_key", "_copy", "row", "range", "h1", "fp", "copies", "first", "doc", "size", "hash", "_sample_key")


def test_stages_judge_every_row_by_itself(spark):
    """Null and shared ids, equal rows and columns with names that the stages use."""
    one, two, three = (f"{w} walked over the hill and saw {w} there while the {w} was green and blue" for w in ("apple", "river", "stone"))
    item = "what is the capital of the country that lies north of the great river"
    rows = [(5, one), (5, two), (3, one), (None, one), (None, three), (None, "four other words here"), (1, f"so {item} then"), (1, "nothing of the kind is in this one"), (2, None), (2, ""), (7, "x " * 30000), (8, "same row twice is fine"), (8, "same row twice is fine")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    docs = spark.createDataFrame([(i, t, "en", "s", 1, *CLASHING) for i, t in rows], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    clean, unique, safe, mix = toxicity.remove_toxic(docs, labels), simhash.keep_first(docs), decontaminate.remove_contaminated(docs, items), mixing.apply_mix(docs)
    assert all(out.columns == docs.columns and [r[c] for c in CLASHING] == list(CLASHING) for out in (clean, unique, safe, mix) for r in out.limit(3).collect())
    assert texts(clean) == sorted(rows, key=str)
    kept = texts(unique)
    assert {(3, one), (5, two), (None, three), (None, "four other words here"), (1, rows[6][1]), (1, rows[7][1]), (7, rows[10][1]), (8, rows[11][1])} < set(kept) and len(kept) == 9
    assert texts(safe) == sorted((r for r in rows if r != rows[6]), key=str)
    words = sum(len(t.split()) for _, t in texts(mix))
    assert {t for _, t in texts(mix)} <= {t for _, t in rows if t} and words <= sum(len((t or "").split()) for _, t in rows)
    small = docs.where("length(text) < 1000")
    assert texts(mixing.apply_mix(small)) == texts(small.where("text <> ''"))  # one source takes itself once
    assert token_output.token_output(docs, tokenizer_path()).count() == len(rows)


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]
