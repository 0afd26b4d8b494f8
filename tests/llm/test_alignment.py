import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from samplewright.llm import alignment, queries

SF_DIR = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def slow(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) over every pair of tokens' byte ranges."""
    t, m = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    letters = alignment.byte_letters()
    names = {i: n for n, i in t.get_vocab().items()}

    def spans(ids, piece):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(piece(i))))
            at = out[-1][2]
        return out

    def of_b(i):
        return bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()

    def of_a(i):
        return bytes(letters[c] for c in names[i])

    rows = []
    for x in texts:
        a, b = (t.encode(" " + x, add_special_tokens=False).ids, m.encode(x)) if x else ([], [])
        whole = (" " + (x or "")).encode()
        if b"".join(map(of_a, a)) != whole or b"".join(map(of_b, b)) != whole:
            a, b = [], []
        a, b = spans(a, of_a), spans(b, of_b)
        links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= c) for side in (a, b)))
            low = c
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
    counts = Counter(p for r in rows for p in r[3])
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    return [
        (*r[:3], len(r[3]), sum(counts[p] == most[p[1]] for p in r[3]), sum(counts[p] for p in r[3]), r[4]) for r in rows
    ]


TEXTS = [
    None, "", " ", "hello world", "Hello  World!\n\nnew\tline", "naïve café 漢字 🙂 ▁ x", "a▁b", "🙂🙂 déjà", "<|endoftext|> <s></s> <0x41>",
    "hello world", " nbsp", "x" * 300, "1234567 890", "\u0000 nul", "é ﬁ ﬁ ①", " leading", "trailing ",
]


def check(df, rows):
    got = sorted(map(tuple, alignment.align(df, A, B).collect()), key=str)
    want = [(d, *r[:6], hashlib.sha256(r[6].encode()).hexdigest() if r[6] else "") for (d, _), r in zip(rows, slow([t for _, t in rows]), strict=True)]
    assert got == sorted(want, key=str)


def test_against_all_pairs(spark, monkeypatch):
    rows = list(enumerate(TEXTS))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)
    found = {r.doc_id: r.groups for r in alignment.groups(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    assert [found[d] for d, _ in rows] == [r[6] for r in slow(TEXTS)]


def test_chunks_do_not_change_results(spark, monkeypatch):
    import pandas as pd

    a, b = alignment.sides(A, B)
    whole = alignment.group_texts(alignment.align_texts(TEXTS, a, b), a, b)
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 10)
    parts = list(alignment._chunks(pd.DataFrame({"text": TEXTS})))
    assert len(parts) > 5 and sum(map(len, parts)) == len(TEXTS)
    assert [g for p in parts for g in alignment.group_texts(alignment.align_texts(alignment._texts(p), a, b), a, b)] == whole


def test_test_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter(F.length("text") < 1500)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(docs, rows)


def test_messy_rows_and_empty_tables(spark, messy, empty):
    docs = messy(["some text", "some text", "other"])
    got = alignment.align(docs, A, B).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0][1:] == by[1][1:] and by[100][1:] == (0, 0, 0, 0, 0, 0, "") and by[103].n_a > 50_000
    assert alignment.align(empty, A, B).count() == 0
    named = docs.filter("doc_id < 3").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert {r.doc_id for r in alignment.align(named, A, B).collect()} == {"d0", "d1", "d2"}


def test_query(spark):
    out = queries.QUERIES["op12_alignment"](spark, SF_DIR)
    assert out.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert out.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
