"""One query per operator, each over the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.llm import (
    alignment,
    bitplane,
    decontamination,
    html_text,
    language_id,
    licenses,
    line_dedup,
    multiset_hash,
    packing,
    periodic_runs,
    simhash,
    tool_calls,
    toxicity,
)
from samplewright.llm.common import held_out, table

THRESHOLD = 0.3


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.derived_calls(table(spark, sf_dir, "conversations"))
    return tool_calls.link_calls(calls, results, tool_calls.derived_schemas(calls))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.score(model, F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return language_id.identify(net, rows).drop("text")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", line_dedup.cleaned(found).alias("text"), "n_lines_removed")


def op8_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bitplane.store_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), of which those with a crc32 divisible by ten repeat a stretch of their words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.filter(h % 10 == 0).select(
        "doc_id", "text", F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)").alias("w"), F.floor(h / 10).alias("g")
    )
    cut = words.withColumn("n", F.size("w").cast("long")).filter("n > 0").withColumn("a", F.expr("g % n"))
    cut = cut.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    at = "transform(sequence(0L, n - 1), i -> get(w, cast(if(i < a, i, a + (i - a) % p) AS INT)))"
    changed = cut.select("doc_id", F.expr(f"array_join({at}, ' ')").alias("text"))
    # The rest stays: ids of another remainder or NULL, and texts without words.
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return docs.filter(F.coalesce(h % 10 != 0, F.lit(True)) | wordless).select("doc_id", "text").unionByName(changed)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole document, a tenth of which are made periodic first."""
    found = periodic_runs.find_runs(with_periods(table(spark, sf_dir, "documents")))
    best = F.expr("try_element_at(array_sort(runs, (x, y) -> CASE WHEN x.length != y.length THEN sign(y.length - x.length) "
                  "WHEN x.start != y.start THEN sign(x.start - y.start) ELSE sign(x.period - y.period) END::int), 1)")  # fmt: skip
    lines = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids against word pieces, every whole document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_tool_calls,
        op3_decontamination,
        op4_toxicity,
        op5_language_id,
        op6_near_duplicates,
        op7_line_dedup,
        op8_bitplane_ids,
        op9_fingerprints,
        op10_licenses,
        op11_periodic_runs,
        op12_alignment,
        op13_html_text,
        pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {
    # Exact containment by joining shingles.
    "op3_decontamination": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
        ), grams AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)
        ), item_words AS (
            SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL
        ), items AS (
            SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM item_words)
        ), sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id)
        SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
        FROM grams JOIN items USING (g) JOIN sizes USING (item_id)
        GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item
    """,
    # A line lies in a repeated run of enough words if and only if it lies in a shortest such run that starts at
    # some line, or in one that ends at some line, and that run has occurred before.
    "op7_line_dedup": r"""
        WITH docs AS (
            SELECT doc_id, text, string_split(text, chr(10)) AS ls,
                [len(regexp_extract_all(x, '\S+')) FOR x IN string_split(text, chr(10))] AS w
            FROM documents
        ), lines AS (SELECT doc_id, unnest(ls) AS l, unnest(w) AS n, unnest(range(1, len(ls) + 1)) AS i FROM docs
        ), sums AS (
            SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM lines
        ), spans AS (
            SELECT a.doc_id, a.i AS first, min(b.i) AS last FROM sums a JOIN sums b
                ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 50 GROUP BY ALL
            UNION
            SELECT b.doc_id, max(a.i), b.i FROM sums a JOIN sums b
                ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 50 GROUP BY ALL
        ), runs AS (
            SELECT doc_id, first, last, array_to_string(ls[first:last], chr(10)) AS body FROM spans JOIN docs USING (doc_id)
        ), later AS (
            SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS k FROM runs
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM later WHERE k > 1
        )
        SELECT doc_id, CASE WHEN count(g.i) = 0 THEN any_value(text)
                ELSE coalesce(string_agg(l, chr(10) ORDER BY s.i) FILTER (g.i IS NULL), '') END AS text,
            count(g.i) AS n_lines_removed
        FROM sums s LEFT JOIN gone g USING (doc_id, i) JOIN docs USING (doc_id) GROUP BY doc_id
    """,
}
