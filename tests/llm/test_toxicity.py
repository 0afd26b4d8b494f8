import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplewright.llm import queries, toxicity

SF_DIR = "/root/testdata/sf0.001"


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("an", "er", "ou", "it", "al")]
    docs, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                body.insert(rng.randrange(len(body)), rng.choice(["vile", "nasty", "zzgrim" + rng.choice(words)]))
        docs.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = corpus(800)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return frame, dict(labels), toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_accuracy_and_sparse_weights(learned):
    frame, labels, model = learned
    scored = frame.select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 100 and sum((r.s >= 0.3) == labels[r.doc_id] for r in held) >= 0.97 * len(held)
    assert 0 < len(model.at) < 3_000


def test_ftrl_against_plain_loops():
    """The vectorised update equals the published one, coordinate by coordinate."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 20, 4)) for _ in range(60)]
    ys = rng.integers(0, 2, 60).astype(float)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.2, 0.1
    z, n, bz, bn = [0.0] * 20, [0.0] * 20, 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    for at, y in zip(rows, ys, strict=True):
        b = -bz / ((beta + bn**0.5) / alpha)
        w = {i: weight(i) for i in at}
        g = 1 / (1 + np.exp(-(b + sum(w.values())))) - y
        for i in at:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
            n[i] += g * g
        bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / alpha * b
        bn += g * g
    model = toxicity.ftrl(rows, ys, 1, alpha, beta, l1, l2)
    want = {i: weight(i) for i in range(20) if weight(i)}
    assert dict(zip(model.at, model.weight, strict=True)) == pytest.approx(want)


def test_features_are_words_stems_pairs_and_skips():
    hasher = toxicity.Hasher()
    one = set(hasher("abcdefgh").tolist())
    assert len(one) == 1 + len(toxicity.STEMS)
    assert set(hasher("x y z").tolist()) >= set(hasher("x y").tolist())
    assert len(hasher("x y z")) == 3 + 2 + 1
    assert len(hasher("x y x y x y")) < len(hasher.all("x y x y x y"))
    assert not len(hasher(None)) and not len(hasher("?! _"))
    assert hasher("Ab, C").tolist() == hasher("ab c").tolist()


def test_messy_rows_and_empty_tables(spark, messy, empty, learned):
    docs = messy(["fine words", "vile nasty vile text", "fine words"])
    model = learned[2]
    got = docs.select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()
    assert len(got) == docs.count() and all(0 <= r.s <= 1 for r in got)
    by_id = {r.doc_id: r.s for r in got}
    assert by_id[100] == by_id[101] == by_id[102] and by_id[0] == by_id[2] < by_id[1]
    labels = spark.createDataFrame(
        [(0, 0, 1), (1, 1, 1), (1, 0, 1), (None, 1, 1), (2, None, 1), (104, 0, 1), (999, 1, 1)], "doc_id long, toxic int, text int"
    )
    assert toxicity.fit(docs, labels).bias != 0.0
    for d, l in ((empty, labels), (docs, labels.limit(0))):
        none = toxicity.fit(d, l)
        assert (none.at, none.weight, none.bias) == ([], [], toxicity.UNTAUGHT)
    assert empty.select(toxicity.score(model, F.col("text"))).count() == 0


def test_query_scores_every_document_and_learns_nothing_of_the_held_out(spark, documents):
    rows = queries.op4_toxicity(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == [r["doc_id"] for r in documents[1]]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    docs, labels = corpus(60)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = (toxicity.fit(frame, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert a == b


def test_texts_are_read_in_parallel_before_the_learner(spark):
    """The task that reads a row writes its text: one task for the whole table would write one text only."""
    from pyspark import TaskContext

    task = F.udf(lambda: TaskContext.get().partitionId(), "int").asNondeterministic()
    docs = spark.range(0, 600, 1, 6).select(F.col("id").alias("doc_id"), F.when(task() < 3, "first").otherwise("second").alias("text"))
    labels = spark.range(600).select(F.col("id").alias("doc_id"), (F.col("id") >= 300).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels)
    scorer = model.scorer()
    assert scorer("second") > 0.9 and scorer("first") < 0.1
