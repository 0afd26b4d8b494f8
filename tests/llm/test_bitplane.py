import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from samplewright.llm import bitplane, queries

SF_DIR = "/root/testdata/sf0.001"

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from([8, 32]), st.booleans())
@settings(max_examples=60, deadline=None)
def test_planes_round_trip(ids, block, bits):
    array = np.array(ids, np.uint32)
    planes = bitplane.to_planes(array, block, bits)
    assert len(planes) == (32 if bits else 4)
    assert bitplane.from_planes(planes, len(ids), block).tolist() == ids


@pytest.mark.parametrize("bits", [False, True])
def test_shards_round_trip_and_read_ranges(bits):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49_408, 5000).astype(np.uint32)
    data = bitplane.encode(ids, [7, -3, 2**40], [0, 4999, 1], bits, block=64)
    shard = bitplane.Shard(data)
    assert shard.keys.tolist() == [7, -3, 2**40] and shard.lengths.tolist() == [0, 4999, 1]
    assert shard.read().tolist() == ids.tolist()
    for start, stop in ((0, 1), (1023, 1025), (1024, 2048), (4999, 5000), (10, 10)):
        assert shard.read(start, stop).tolist() == ids[start:stop].tolist()
    assert len(bitplane.Shard(bitplane.encode(ids[:0], [1], [0])).read()) == 0
    with pytest.raises(ValueError):
        bitplane.Shard(data[:-1] + b"x")


@given(st.lists(st.sampled_from(["Word", " ", "\n", "  ", "don't", "é", "é", "́", "\x1c", "\xa0", "12", "?!", "<|endoftext|>", "<|ENDOFTEXT|>", "a.", "B,", "..", "équeux", "straße", "ÿ", "÷", "Ñandú", "İ", "\t", "ΑΣ", "東京"]), max_size=14))
@settings(max_examples=150, deadline=None)
def test_words_alone_give_the_ids_of_the_whole_text(pieces):
    text = "".join(pieces)
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids + [1]
    assert np.frombuffer(TOKENIZER(text), "<u4").tolist() == want


@given(st.text(st.sampled_from("abstrevmld'''ABS09.,.,!?$%&#*@/<>()-_~ß÷×àéÿÀÉØÞªµ²\u0301\xa0  "), max_size=40))
@settings(max_examples=300, deadline=None)
def test_pieces_give_the_ids_of_the_whole_text(text):
    want = WHOLE.encode(text, add_special_tokens=False).ids + [1]
    assert np.frombuffer(TOKENIZER(text), "<u4").tolist() == want


def test_plain_words_do_not_need_all_rules():
    tokenizer = bitplane.Tokenizer(PATH, 1)
    tokenizer.inner = None
    for text in ("Words. and, signs%%% re*** this.### (12.5) 555-2485 a.b@c-3.com don't", "Èonai ÇPA!! straße, réré. éé.", "  \n "):
        assert np.frombuffer(tokenizer(text), "<u4").tolist() == [*WHOLE.encode(text, add_special_tokens=False).ids, 1]


def test_ids_stay_when_the_memo_turns(monkeypatch):
    monkeypatch.setattr(bitplane, "MEMO", 3)
    tokenizer = bitplane.Tokenizer(PATH, 1)
    for i in range(30):
        text = f"word{i % 7} other. w{i % 5}x, a{i}. tail"
        assert np.frombuffer(tokenizer(text), "<u4").tolist() == [*WHOLE.encode(text, add_special_tokens=False).ids, 1]
        assert len(tokenizer.memo) <= 3 + 5 and len(tokenizer.memo.older) <= 3 + 5


def test_slices_of_a_batch_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(bitplane, "SLICE", 10)
    texts = ["abc", None, "d" * 7, "e", "f" * 40, "", "ééé ééé", "g"]
    batch = pa.RecordBatch.from_pydict({"_doc": list(range(len(texts))), "text": texts})
    parts = [s.to_pydict() for s in bitplane.slices(batch)]
    assert [p["_doc"] for p in parts] == [[0, 1, 2], [3], [4], [5], [6], [7]]
    assert [t for p in parts for t in p["text"]] == texts
    ids, sizes = TOKENIZER.encode(pa.array([t for p in parts for t in p["text"]]))
    whole = [[*WHOLE.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert ids.tolist() == sum(whole, []) and sizes.tolist() == [len(w) for w in whole]


TOKENIZER, WHOLE = bitplane.Tokenizer(PATH, 1), Tokenizer.from_file(PATH)
assert TOKENIZER.direct


def expected(rows):
    loaded, at, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = np.array([*loaded.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_against_plain_encoding(spark, documents):
    got = [tuple(r) for r in queries.op8_bitplane_ids(spark, SF_DIR).orderBy("doc_id").collect()]
    assert got == expected([(r["doc_id"], r["text"]) for r in documents[1]])


def test_many_small_shards(spark, documents):
    df, rows = documents
    got = bitplane.store_documents(df, PATH, shard_ids=500, bits=True).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected([(r["doc_id"], r["text"]) for r in rows])


def test_messy_rows_and_empty_tables(messy, empty):
    docs = messy(["a b", "a b", "c"])
    rows = [tuple(r) for r in bitplane.store_documents(docs, PATH).collect()]
    assert len(rows) == docs.count()
    by_start = sorted(rows, key=lambda r: r[1])
    assert [r[1] for r in by_start] == np.cumsum([0, *[r[2] for r in by_start]])[:-1].tolist()
    ids = [r[0] for r in by_start]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    assert {r[2] for r in rows if r[0] in (100, 101, 102)} == {1}
    assert bitplane.store_documents(empty, PATH).count() == 0
