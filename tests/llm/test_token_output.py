import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyrion.llm import token_output as T
from papyrion.llm.queries import tokenizer_path

ODD = ["", " ", "a  b   c", "foo \n bar", "x<|endoftext|>y z", "a  　 b", "! a ! b", "tab\t\t x  ", "a\0 b\0", "don't we'll", "ends ", " starts", "é ñ ß", "你好 世界", "a\n\n b"]


@pytest.fixture(scope="module")
def enc():
    return T.TextEncoder(tokenizer_path())


def ids_of(enc, text):
    return enc.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoding_is_the_librarys(enc):
    assert [r.tolist() for r in enc.encode(ODD)] == [ids_of(enc, t) for t in ODD]
    assert [r.tolist() for r in enc.encode(ODD)] == [ids_of(enc, t) for t in ODD]  # from the cache


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" \n\tab'!.éß1 ", max_size=40))
def test_encoding_of_any_white_space(text):
    e = T.encoder(tokenizer_path())
    assert e.encode([text])[0].tolist() == ids_of(e, text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=12))
def test_encoding_of_any_texts_together(texts):
    e = T.encoder(tokenizer_path())
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    assert [r.tolist() for r in e.encode(texts)] == [ids_of(e, t) for t in texts]


def test_every_character_is_cut_as_the_library_cuts(enc):
    texts = [f"a{c}b {c} 1{c}{c}'s\n" for c in map(chr, range(0x3000)) if not 0xD800 <= ord(c) < 0xE000]
    assert enc.pieces is not None
    assert [r.tolist() for r in enc.encode(texts)] == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(T, "CACHE_BYTES", 1500)
    e = T.TextEncoder(tokenizer_path())
    for k in range(40):
        text = f"start {' '.join(f'w{k}x{j}' for j in range(8))}"
        assert e.encode([text])[0].tolist() == ids_of(e, text)
        assert e.known.nbytes + 4 * len(e.ids) < 1500 + 8 * 64
    assert b"start" in e.known.to_pylist()  # what each text has stays


def test_other_kinds_of_tokenizers_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "words.json"))
    e = T.TextEncoder(str(tmp_path / "words.json"))
    assert e.pieces is None and [r.tolist() for r in e.encode(["a b c", "", "b"])] == [[0, 1, 2], [], [1]]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=60), min_size=1, max_size=8), st.sampled_from([10, 70000]))
def test_grammar_round_trip(docs, base):
    parts = [np.array([*d, T.END_ID], dtype="<u4").tobytes() for d in docs]
    shard = T.Shard(T.pack([None if k == 1 else k for k in range(len(docs))], parts, base))
    assert shard.decode().astype("<u4").tobytes() == b"".join(parts)
    assert [shard.decode_document(k).astype("<u4").tobytes() for k in range(len(docs))] == parts
    assert shard.doc_ids == [None if k == 1 else k for k in range(len(docs))]


def test_repeats_are_compressed():
    ids = np.array([*[5, 6, 7, 8] * 500, 0], dtype=np.uint32)
    seq, rules = T.compress(ids, 10)
    assert len(rules) and len(seq) < len(ids) / 3
    assert (T.expand(seq, rules, 10) == ids).all()


def check(docs, out):
    enc, start, expected = T.encoder(tokenizer_path()), 0, []
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        ids = [*ids_of(enc, text), 0]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == expected


def test_table_edges(spark):
    rows = [(k * 3 % 17, t) for k, t in enumerate(ODD)] + [(5, None), (None, "no id"), (5, "again"), (5, "again"), (99, "long " * 60000)]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, part int, base int, hash int, row int")
    check(df, T.token_output(df, tokenizer_path()))


def test_many_shards_and_order(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs, T.token_output(docs, tokenizer_path()))


def test_empty_table(spark):
    assert T.token_output(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_rounds_go_on_until_no_pair_is_frequent():
    """A long passage that repeats becomes few symbols, not one for 16 ids each."""
    passage = np.arange(1, 257)
    ids = np.concatenate([np.append(passage, T.END_ID)] * 300)
    seq, rules = T.compress(ids, 1000)
    assert (T.expand(seq, rules, 1000) == ids).all()
    assert len(seq) == 600 and len(T._frequent(seq, T._pairs(seq, 2), 10, T.MIN_COUNT)) == 0


def test_of_overlapping_pairs_the_most_frequent_is_replaced():
    ids = np.array([*[1, 2, 9] * 20, *[2, 3, 9] * 40, *[1, 2, 3, 9] * 30], dtype=np.uint32)
    seq, rules = T.compress(ids, 1000)
    first = [tuple(r) for r in rules.tolist()]
    assert (T.expand(seq, rules, 1000) == ids).all()
    assert first.index((3, 9)) < len(first) and (1, 2) in first


def test_one_pair_overlapping_itself():
    at, rank = T._settled(np.array([3, 4, 5, 6, 9, 10, 20]), np.array([1, 1, 1, 0, 5, 2, 7]))
    assert dict(zip(at.tolist(), rank.tolist(), strict=True)) == {3: 1, 6: 0, 10: 2, 20: 7}
