"""Bootstrap resampling of every group at every sample size.

How a group of any size is resampled without holding it in one place:

1. every row gets a random ordinal 1..N in its group (:func:`shuffle_rank`) and goes into an array of ``CHUNK_ROWS``;
2. a group that is one array answers all its draws in place;
3. for a larger group the draws are made from its total alone, addressed by (array, place) and equi-joined to the
   arrays; a resample then gathers its values, at most ``n_max``, in the order of the draws.

The size of a group chooses the plan and nothing else: both ways see the same values in the same order and fold them
by the same arithmetic. A draw depends on its keys only, so results do not change with partitioning or batching.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.functions.hashing import draw_index, draw_prefix
from samplewright.functions.nulls import col, quoted, ratio, strict
from samplewright.functions.student import t_quantile, t_quantile_whole
from samplewright.operators.ordering import columns, shuffle_rank
from samplewright.session import is_stored, shuffle_partitions

# Fixed values of the study design.
N_MIN, N_MAX, ITERS, SEED = 3, 50, 499, 2012
REFERENCE_SIZE = 30

CHUNK_ROWS = 1 << 15  # values per packed array: 256 KB
LANE_DRAWS = 1 << 15  # draws per unit of work
BLOCK = 8  # draws per row


def pack_groups(
    df: DataFrame,
    g: str,
    v: str,
    unit: str | Sequence[str],
    seed: int = SEED,
    rng: str = "xxhash64",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Nest each group into bounded arrays: ``g, chunk, total, vals``.

    Array ``chunk`` holds the values with ordinals ``chunk * chunk_rows + 1`` onwards.
    """
    return _pack(_ranked(df, g, v, unit, seed, rng), g, chunk_rows)


def _ranked(df: DataFrame, g: str, v: str, unit: str | Sequence[str], seed: int, rng: str) -> DataFrame:
    """``g, _v, _ordinal, total`` of every row."""
    needed = df.selectExpr(quoted(g), f"cast({quoted(v)} AS DOUBLE) AS _v", *[quoted(c) for c in columns(unit) if c != g])
    return shuffle_rank(needed, g, unit, seed, rng, "_ordinal", "total").select(g, "_v", "_ordinal", "total")


def _pack(ranked: DataFrame, g: str, chunk_rows: int) -> DataFrame:
    # An explicit shuffle: what follows is heavy for its bytes, so the partitions should
    # not be merged by size, and a map-side collect_list would only cost memory.
    placed = ranked.selectExpr("*", f"(_ordinal - 1) div {chunk_rows} AS chunk").repartition(
        shuffle_partitions(ranked.sparkSession), g, "chunk"
    )
    return placed.groupBy(g, "chunk").agg(
        F.expr("first(total) AS total"), F.expr("sort_array(collect_list(struct(_ordinal, _v)))._v AS vals")
    )


def _grid(work: DataFrame, g: str, n_min: int, n_max: int, seed: int, rng: str, iterations: str) -> DataFrame:
    """One row per resample: row of ``work`` x ``iter`` x ``sample_size``, with its draw prefix."""
    return (
        work.selectExpr("*", f"explode({iterations}) AS iter")
        .selectExpr("*", f"explode(sequence({n_min}, {n_max})) AS sample_size")
        .selectExpr("*", f"{draw_prefix(rng, seed, quoted(g), 'sample_size', 'iter')} AS _prefix")
    )


def _lanes(df: DataFrame, g: str, per_group: int, iters: int, held: str) -> DataFrame:
    """Few groups would give few tasks, so the iterations of a group are dealt out to lanes of equal work."""
    lanes = f"cast(least(ceil({per_group} / greatest({LANE_DRAWS}, {held})), {iters}) AS INT)"
    return (
        df.selectExpr("*", f"{lanes} AS _lanes")
        .selectExpr("*", "explode(sequence(1, _lanes)) AS _lane")
        .repartition(shuffle_partitions(df.sparkSession), g, "_lane")
    )


def _pivot(first: str) -> str:
    """What the moments of a resample are taken about: its first value, or zero if that is infinite or no number.

    It keeps constant resamples at a standard deviation of exactly zero and bounds the loss of precision of all others
    by a factor of n + 1.
    """
    return f"CASE WHEN isnan({first}) OR abs({first}) = double('infinity') THEN 0D ELSE {first} END"


def _moments(sums: DataFrame, g: str, carried: Sequence[str] = ()) -> DataFrame:
    """Mean and sd from the sums of deviations and of their squares."""
    squares = "greatest(_s2 - _s1 * _s1 / sample_size, 0D)"
    return sums.selectExpr(
        quoted(g),
        "sample_size",
        "iter",
        "_pivot + _s1 / sample_size AS mean",
        f"CASE WHEN _s1 IS NOT NULL AND sample_size > 1 THEN sqrt({squares} / greatest(sample_size - 1, 1)) END AS sd",
        *carried,
    )


def _resample_whole(
    packed: DataFrame,
    g: str,
    n_min: int,
    n_max: int,
    iters: int,
    seed: int,
    rng: str,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Resample groups that are one array each.

    Copies of the values in several lanes stay below an eighth of the draws. All draws of a resample are in one
    task, and the aggregate over them needs no shuffle. A row stands for ``BLOCK`` draws. Columns in ``carry``
    are copied from the packed row to its resamples.
    """
    per_group = iters * sum(range(n_min, n_max + 1))
    work = _lanes(packed, g, per_group, iters, "8L * size(vals)")

    def drawn(j: str) -> str:
        return f"get(vals, cast({draw_index(rng, '_prefix', j, 'total')} AS INT))"

    keys = [quoted(g), "_lane", "sample_size", "iter"]
    blocks = (
        _grid(work, g, n_min, n_max, seed, rng, f"sequence(_lane, {iters}, _lanes)")
        .selectExpr("*", f"{drawn('1')} AS _one")
        .selectExpr("*", f"{_pivot('_one')} AS _pivot")
        .selectExpr("*", f"explode(sequence(1, sample_size, {BLOCK})) AS _first")
    )
    deviations = [
        f"CASE WHEN _first + {k} <= sample_size THEN {drawn(f'_first + {k}')} - _pivot ELSE 0D END AS _d{k}"
        for k in range(BLOCK)
    ]
    carried = [quoted(c) for c in carry]
    sums = blocks.selectExpr(*keys, "_pivot", *carried, *deviations).selectExpr(
        *keys,
        "_pivot",
        *carried,
        " + ".join(f"_d{k}" for k in range(BLOCK)) + " AS _s1",
        " + ".join(f"_d{k} * _d{k}" for k in range(BLOCK)) + " AS _s2",
    )
    moments = sums.groupBy(*keys).agg(
        F.expr("first(_pivot) AS _pivot"),
        F.expr("CASE WHEN count(_s1) = count(*) THEN sum(_s1) END AS _s1"),
        F.expr("sum(_s2) AS _s2"),
        *[F.expr(f"first({c}) AS {c}") for c in carried],
    )
    return _moments(moments, g, carried)


def _resample_split(
    packed: DataFrame, g: str, n_min: int, n_max: int, iters: int, seed: int, rng: str, chunk_rows: int
) -> DataFrame:
    """Resample groups that are several arrays: ``g, chunk, total, vals``.

    The draws follow from the total of a group, which its first array knows. A draw is addressed by (chunk, place in
    it) and joined to the array, so one row per array stands on the other side, and only what is drawn moves on. A
    resample gathers its values, ``n_max`` at most, sorted by draw number, and folds them block by block as
    :func:`_resample_whole` does.
    """
    totals = packed.filter("chunk = 0").select(g, "total")
    per_group = iters * sum(range(n_min, n_max + 1))
    at = [f"_first + {k}" for k in range(BLOCK)]
    listed = ", ".join(
        f"CASE WHEN {j} <= sample_size THEN struct({j} AS _j, {draw_index(rng, '_prefix', j, 'total')} AS _at) END"
        for j in at
    )
    draws = (
        _grid(_lanes(totals, g, per_group, iters, "0L"), g, n_min, n_max, seed, rng, f"sequence(_lane, {iters}, _lanes)")
        .selectExpr("*", f"explode(sequence(1, sample_size, {BLOCK})) AS _first")
        .selectExpr(quoted(g), "sample_size", "iter", f"inline(filter(array({listed}), x -> x IS NOT NULL))")
        .selectExpr(quoted(g), "sample_size", "iter", "_j", f"_at div {chunk_rows} AS _chunk", f"cast(_at % {chunk_rows} AS INT) AS _place")
    )
    arrays = packed.select(F.col(g).alias("_group"), "chunk", "vals")
    drawn = draws.join(arrays, F.col(g).eqNullSafe(F.col("_group")) & (F.col("_chunk") == F.col("chunk"))).selectExpr(
        quoted(g), "sample_size", "iter", "_j", "get(vals, _place) AS _v"
    )
    gathered = drawn.groupBy(g, "sample_size", "iter").agg(
        F.expr("sort_array(collect_list(struct(_j, _v)))._v AS _vals")
    )
    pivoted = gathered.selectExpr("*", "get(_vals, 0) AS _one").selectExpr("*", f"{_pivot('_one')} AS _pivot")
    d = [f"CASE WHEN f + {k} <= sample_size THEN get(_vals, f + {k} - 1) - _pivot ELSE 0D END" for k in range(BLOCK)]
    fold = lambda terms: (
        f"aggregate(sequence(1, sample_size, {BLOCK}), 0D, (s, f) -> s + ({' + '.join(terms)}))"
    )
    sums = pivoted.selectExpr(
        quoted(g), "sample_size", "iter", "_pivot", f"{fold(d)} AS _s1", f"{fold([f'({x}) * ({x})' for x in d])} AS _s2"
    )
    return _moments(sums, g)


def _check_grid(n_min: int, n_max: int, iters: int) -> None:
    if not 1 <= n_min <= n_max or iters < 1:
        raise ValueError("need 1 <= n_min <= n_max and iters >= 1")


def bootstrap_groups(
    df: DataFrame,
    g: str,
    v: str,
    unit: str | Sequence[str],
    n_min: int = N_MIN,
    n_max: int = N_MAX,
    iters: int = ITERS,
    seed: int = SEED,
    rng: str = "xxhash64",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Resample every group: ``g, sample_size, iter, mean, sd``.

    ``unit`` names the columns that identify a row inside its group. The size may
    exceed the group's, since draws are with replacement. An unknown value among the
    draws makes mean and sd NULL.
    """
    _check_grid(n_min, n_max, iters)
    packed = _pack(_ranked(df, g, v, unit, seed, rng), g, chunk_rows)
    whole = _resample_whole(packed.filter(f"total <= {chunk_rows}"), g, n_min, n_max, iters, seed, rng)
    split = _resample_split(packed.filter(f"total > {chunk_rows}"), g, n_min, n_max, iters, seed, rng, chunk_rows)
    return whole.unionByName(split)


def bootstrap_batches(
    df: DataFrame,
    batches: Sequence[Sequence[object]],
    g: str,
    v: str,
    unit: str | Sequence[str],
    store: str | None = None,
    **options: object,
) -> DataFrame:
    """Resample declared subsets of the groups one after the other and append them.

    With ``store``, a folder all executors can reach, every batch is written there under a digest of all its resamples
    depend on: its groups, the options, and the number and hashes of its rows. A batch that is there complete is read and
    not drawn again, so a run that was broken off, or gets more batches, goes on where it stands; changed data or options
    make new batches beside the old. The table ``manifest`` in the folder lists each batch with its digest.
    """
    parts = [df.filter(F.col(g).isin(*batch)) for batch in batches]
    if store is None:
        return reduce(DataFrame.unionByName, [bootstrap_groups(part, g, v, unit, **options) for part in parts])
    spark = df.sparkSession
    defaults = dict(n_min=N_MIN, n_max=N_MAX, iters=ITERS, seed=SEED, rng="xxhash64")
    settings = {"g": g, "v": v, "unit": columns(unit), **defaults, **options}
    settings.pop("chunk_rows", None)  # never changes a result
    row = F.xxhash64(g, F.col(v).cast("double"), *columns(unit))
    numbered = F.explode(F.array(*[F.when(F.col(g).isin(*batch), F.lit(i)) for i, batch in enumerate(batches)]))
    content = (
        df.select(numbered.alias("batch"), row.alias("h"))
        .filter(F.col("batch").isNotNull())
        .groupBy("batch")
        .agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    )
    known = {r["batch"]: [r["n"], r["x"], str(r["s"])] for r in content.collect()}  # a row per batch
    done = []
    for i, (batch, part) in enumerate(zip(batches, parts, strict=True)):
        described = json.dumps([sorted(map(repr, batch)), settings, known.get(i)], sort_keys=True, default=str)
        digest = hashlib.sha256(described.encode()).hexdigest()[:32]
        path = f"{store.rstrip('/')}/batch-{digest}"
        drawn = bootstrap_groups(part, g, v, unit, **options)
        present = is_stored(spark, path)
        if not present:
            drawn.write.mode("overwrite").parquet(path)
            line = spark.range(1).select(F.lit(i).alias("batch"), F.lit(digest).alias("digest"), F.lit(described).alias("described"))
            line.write.mode("append").json(f"{store.rstrip('/')}/manifest")
        done.append(spark.read.schema(drawn.schema).parquet(path))
    return reduce(DataFrame.unionByName, done)


def _medians(boot: DataFrame, g: str, at_n: int, n: str, mean: str) -> DataFrame:
    return (
        boot.filter(F.col(n) == at_n)
        .groupBy(F.col(g).alias("_group"))
        .agg(strict(F.median, mean).cast("double").alias("median_pop_val"))
    )


def attach_population_median(
    boot: DataFrame, g: str, at_n: int = REFERENCE_SIZE, n: str = "sample_size", mean: str = "mean", how: str = "left"
) -> DataFrame:
    """Add ``median_pop_val``, the median resample mean of the group at size ``at_n``.

    The medians come from ``boot`` itself, so a left join loses nothing against a full
    one. It carries no hint: Spark broadcasts the medians where it measures them to be
    small. The median of one group sees one value per iteration, and is NULL if one of them is.
    """
    if how not in ("left", "full"):
        raise ValueError("how must be 'left' or 'full'")
    medians = _medians(boot, g, at_n, n, mean)
    joined = boot.join(medians, F.col(g).eqNullSafe(F.col("_group")), how)
    if how == "left":
        return joined.select(*boot.columns, "median_pop_val")
    group = F.when(F.col(n).isNull(), F.col("_group")).otherwise(F.col(g)).alias(g)
    return joined.select(group, *[c for c in boot.columns if c != g], "median_pop_val")


def bootstrap_with_median(
    df: DataFrame,
    g: str,
    v: str,
    unit: str | Sequence[str],
    n_min: int = N_MIN,
    n_max: int = N_MAX,
    iters: int = ITERS,
    at_n: int = REFERENCE_SIZE,
    seed: int = SEED,
    rng: str = "xxhash64",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """:func:`attach_population_median` of :func:`bootstrap_groups`, joined early.

    As a draw depends on its keys only, the resamples at the reference size can be drawn
    by themselves. Groups that are one array then meet their median before the resamples
    are unfolded, so a row per group is joined instead of one per resample.
    """
    _check_grid(n_min, n_max, iters)
    packed = _pack(_ranked(df, g, v, unit, seed, rng), g, chunk_rows)
    alone = packed.filter(f"total <= {chunk_rows}")
    if n_min <= at_n <= n_max:
        reference = _resample_whole(alone, g, at_n, at_n, iters, seed, rng)
        medians = _medians(reference, g, at_n, "sample_size", "mean")
        alone = alone.join(medians, F.col(g).eqNullSafe(F.col("_group")), "left").drop("_group")
    else:
        alone = alone.withColumn("median_pop_val", F.lit(None).cast("double"))
    whole = _resample_whole(alone, g, n_min, n_max, iters, seed, rng, ["median_pop_val"])
    split = _resample_split(packed.filter(f"total > {chunk_rows}"), g, n_min, n_max, iters, seed, rng, chunk_rows)
    return whole.unionByName(attach_population_median(split, g, at_n))


def t_ci(
    df: DataFrame, mean: str = "mean", sd: str = "sd", n: str = "sample_size", level: float = 0.95
) -> DataFrame:
    """Student-t confidence interval of each mean: ``std_error, error, lower_ci, upper_ci``."""
    return (
        df.withColumn("std_error", ratio(sd, F.sqrt(col(n))))
        .withColumn("error", t_quantile_whole(f"(`{n}` - 1)", level) * F.col("std_error"))
        .withColumn("lower_ci", F.col(mean) - F.col("error"))
        .withColumn("upper_ci", F.col(mean) + F.col("error"))
    )


def welch_df(v1: Column, n1: Column, v2: Column, n2: Column) -> Column:
    """Satterthwaite degrees of freedom of two sample variances."""
    a, b = ratio(v1, n1), ratio(v2, n2)
    return ratio((a + b) * (a + b), ratio(a * a, n1 - 1) + ratio(b * b, n2 - 1))


def bootstrap_two(
    df: DataFrame,
    g: str,
    group1: object,
    group2: object,
    v: str,
    unit: str | Sequence[str],
    n_min: int = N_MIN,
    n_max: int = N_MAX,
    iters: int = ITERS,
    seed: int = SEED,
    rng: str = "xxhash64",
    level: float = 0.95,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Resample two groups side by side; difference of means with a Welch t interval.

    A group without rows is an error, raised when the resamples are read. NULL names no group.
    """
    pair = df.filter(F.col(g).isin(group1, group2))
    boot = bootstrap_groups(pair, g, v, unit, n_min, n_max, iters, seed, rng, chunk_rows)
    both = boot.groupBy("sample_size", "iter").agg(
        *[
            F.max(F.when(F.col(g) == F.lit(name), F.col(c))).alias(f"{c}{i}")
            for i, name in ((1, group1), (2, group2))
            for c in ("mean", "sd")
        ],
        *[F.count(F.when(F.col(g) == F.lit(name), 1)).alias(f"_n{i}") for i, name in ((1, group1), (2, group2))],
    )
    absent = F.when(F.col("_n1") * F.col("_n2") == 0, F.raise_error(F.lit(f"{group1!r} or {group2!r} has no rows")))
    both = both.filter(F.coalesce(absent.cast("boolean"), F.lit(True))).drop("_n1", "_n2")
    return _difference(both, level)


def _difference(both: DataFrame, level: float) -> DataFrame:
    """Add the difference of the means of two resamples and its Welch t interval."""
    n = F.col("sample_size")
    v1, v2 = F.col("sd1") * F.col("sd1"), F.col("sd2") * F.col("sd2")
    return (
        both.withColumn("mean_diff", F.col("mean1") - F.col("mean2"))
        .withColumn("_df", welch_df(v1, n, v2, n))
        .withColumn("_error", t_quantile("_df", level) * F.sqrt(ratio(v1 + v2, n)))
        .withColumn("lower_ci", F.col("mean_diff") - F.col("_error"))
        .withColumn("upper_ci", F.col("mean_diff") + F.col("_error"))
        .withColumn("width_ci", F.col("upper_ci") - F.col("lower_ci"))
        .drop("_df", "_error")
    )


def bootstrap_pairs(
    df: DataFrame,
    g: str,
    pairs: DataFrame | Sequence[tuple[object, object]],
    v: str,
    unit: str | Sequence[str],
    n_min: int = N_MIN,
    n_max: int = N_MAX,
    iters: int = ITERS,
    seed: int = SEED,
    rng: str = "xxhash64",
    level: float = 0.95,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """:func:`bootstrap_two` of every pair: ``group1, group2, sample_size, iter`` and its columns.

    ``pairs`` is a list or a table of two columns. Each group named is resampled once, however many pairs it is in, and
    its resamples are joined to the sides it stands on; both sides of a resample meet on (pair, size, iteration). Pairs
    named twice count once; NULL names the group of unknown key. A group without rows is an error, raised when the
    resamples are read.
    """
    if isinstance(pairs, DataFrame):
        listed = pairs.toDF("group1", "group2").distinct()
    else:
        kind = df.schema[g].dataType
        rows = [F.struct(F.lit(a).cast(kind).alias("group1"), F.lit(b).cast(kind).alias("group2")) for a, b in pairs]
        listed = df.sparkSession.range(1).select(F.inline(F.array(*rows))).distinct()
    side = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"group{i}").alias("name")) for i in (1, 2)]))
    sides = listed.select("group1", "group2", side.alias("s")).select("group1", "group2", "s.side", "s.name")
    named = sides.select(F.col("name").alias("_name")).distinct()
    wanted = df.join(named, F.col(g).eqNullSafe(F.col("_name")), "left_semi")
    boot = bootstrap_groups(wanted, g, v, unit, n_min, n_max, iters, seed, rng, chunk_rows)
    boot = boot.withColumnRenamed(g, "_group")
    met = sides.join(boot, F.col("name").eqNullSafe(F.col("_group")), "left")
    absent = F.raise_error(F.concat(F.lit("no rows in "), F.to_json(F.struct("group1", "group2"))))
    met = met.filter(F.when(F.col("sample_size").isNull(), absent.cast("boolean")).otherwise(F.lit(True)))
    both = met.groupBy("group1", "group2", "sample_size", "iter").agg(
        *[F.max(F.when(F.col("side") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2) for c in ("mean", "sd")]
    )
    return _difference(both, level)
