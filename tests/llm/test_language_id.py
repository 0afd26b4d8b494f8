import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplewright.llm import language_id, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(1)
    texts, y = [], []
    for i in range(300):
        k = i % 3
        words = [["the", "of", "and", "er"], ["der", "und", "ich", "ü"], ["le", "de", "é", "aux"]][k]
        texts.append(" ".join(rng.choice(words, 30)))
        y.append(k)
    rows = [language_id.windows(t) for t in texts]
    labels = np.concatenate([np.full(len(r), k) for r, k in zip(rows, y, strict=True)])
    return language_id.train(np.concatenate(rows), labels, ["a", "b", "c"], epochs=8)


def test_lookups_equal_the_convolution(net):
    rows = language_id.windows("Whole Texts, über alles é " * 20)
    x = np.concatenate([rows, np.zeros((len(rows), 3), np.uint8)], axis=1)
    want = [
        np.array([[max(sum(t[j, r[i + j], f] for j in range(w)) for i in range(128)) for f in range(8)] for r in x])
        for w, t in zip(language_id.WIDTHS, net.tables, strict=True)
    ]
    assert np.allclose(net.maxima(rows), np.concatenate(want, axis=1), atol=1e-4)


def test_gradients_are_those_of_the_loss(net):
    rows = language_id.windows("the und aux le der of " * 12)
    y = np.array([0, 1, 2, 0, 1, 2][: len(rows)] + [0] * max(0, len(rows) - 6))
    padded = np.concatenate([rows, np.zeros((len(rows), 3), np.uint8)], axis=1)

    def loss():
        net.pairs = None
        p = net.probabilities(rows)
        return float(-np.log(p[np.arange(len(y)), y]).mean())

    grads = language_id._gradients(net, padded, y)
    for p, g in zip([*net.tables, net.dense], [*grads[:3], grads[4]], strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(g[at]), rel=0.15, abs=2e-4)
    net.pairs = None


def test_windows_cover_the_whole_text():
    text = "É" * 100 + "A" * 101
    rows = language_id.windows(text)
    assert rows.shape == (3, 128) and bytes(rows.ravel()).rstrip(b"\0").decode() == text.lower()
    assert len(language_id.windows(None)) == len(language_id.windows("")) == 0


def test_a_batch_is_the_mean_of_its_windows(net):
    texts = ["the of and " * 50, "", "und ich", None]
    langs, scores = net.batch(texts)
    assert langs == ["a", "und", "b", "und"] and scores[1] == scores[3] == 0
    p = net.probabilities(language_id.windows(texts[0])).mean(axis=0)
    assert scores[0] == pytest.approx(p.max())


def test_messy_rows_and_empty_tables(messy, empty):
    docs = messy(["123 !?", "some letters", "x"])
    net = language_id.fit(docs)
    rows = language_id.identify(net, docs, name="guess", score="sure").collect()
    assert len(rows) == docs.count() and all(0 <= r.sure <= 1 for r in rows)
    got = {r.doc_id: (r.guess, r.sure) for r in rows}
    assert got[0] == got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[1][0] in ("en", "fr") and rows[0].score in (0.5, None)
    assert language_id.fit(empty) is None
    assert language_id.identify(None, docs).select("lang_pred").distinct().collect()[0][0] == "und"
    assert language_id.identify(net, empty).count() == 0


def test_query_accuracy_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op5_language_id(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(langs) and len(rows) == len(langs)
    held = [r for r in rows if r.held_out and langs[r.doc_id]]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)


def test_query_on_the_smallest_table(spark):
    assert queries.op5_language_id(spark, SF_DIR).count() == 200


def test_texts_are_read_in_parallel_before_the_learner(spark):
    """The task that reads a row writes its language: one task for the whole table would write one language only."""
    from pyspark import TaskContext

    task = F.udf(lambda: TaskContext.get().partitionId(), "int").asNondeterministic()
    docs = spark.range(0, 60, 1, 6).select(
        F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.concat(F.lit("l"), task()).alias("lang")
    )
    assert len(language_id.fit(docs).langs) > 1
