"""DuckDB SQL for the queries, written independently of the operators.

t quantiles are found by bisecting a Simpson integral of the density (in Python for whole degrees of freedom, in SQL
for others), p values and normal tails are Simpson integrals too, and order-dependent results use plain windows over
the whole table. Nothing is shared with the functions under test.
"""

from __future__ import annotations

import math
from functools import cache

from samplewright.conformance.queries import (
    BATCHES,
    CAP,
    EFFECTS,
    EXCLUDED,
    GRID,
    PAIR,
    PAIRS,
    SEGMENTS,
    THRESHOLDS,
)

ROOT = "sqrt(abs(c_acctbal))"
Z = "1.959963984540054"  # fixed value: the 0.975 quantile of the normal distribution


@cache
def _t975(df: int) -> float:
    """The 0.975 quantile of Student's t: with x = sqrt(df) tan(u), the density is that of cos(u) ** (df - 1)."""
    steps = 2000
    constant = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)

    def area(u: float) -> float:
        weights = (1 if k in (0, steps) else 4 if k % 2 else 2 for k in range(steps + 1))
        return constant * u / steps / 3 * sum(w * math.cos(u * k / steps) ** (df - 1) for k, w in enumerate(weights))

    low, high = 0.0, math.pi / 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if area(middle) < 0.475 else (low, middle)
    return math.sqrt(df) * math.tan(low)


# The same in SQL for any degrees of freedom: Newton's steps from the left of the root, where the integral is concave, and
# Boole's rule over 240 intervals. lgamma of halves keeps the constant finite.
def _t_quantiles(source: str, df: str) -> str:
    """CTEs that end in ``quantiles(df, q)`` for the distinct values of ``df`` in ``source``."""
    steps = 240
    weight = f"CASE WHEN x IN (0, {steps}) THEN 7 WHEN x % 4 = 0 THEN 14 WHEN x % 2 = 0 THEN 12 ELSE 32 END"
    terms = f"[({weight}) * pow(cos(u * x / {steps}), df - 1) FOR x IN range(0, {steps} + 1)]"
    area = f"constant * u / {steps} * 2 / 45 * list_sum({terms})"
    return f"""newton AS (
  SELECT DISTINCT {df} AS df, exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) AS constant,
         atan(1.959963 / sqrt({df})) AS u, 0 AS k FROM {source} WHERE {df} IS NOT NULL
  UNION ALL
  SELECT df, constant, u + (0.475 - {area}) / (constant * pow(cos(u), df - 1)), k + 1 FROM newton WHERE k < 9),
quantiles AS (SELECT df, sqrt(df) * tan(u) AS q FROM newton WHERE k = 9)"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in row) + ")" for row in rows)


def _final(source: str, keys: str, doubles: str, decimals: int = 6) -> str:
    """Select keys as they are and doubles at so many decimals."""
    cols = [k.strip() for k in keys.split(",") if k.strip()]
    cols += [f"round({d.strip()}, {decimals}) + 0.0::DOUBLE AS {d.strip()}" for d in doubles.split(",") if d.strip()]
    return f"SELECT {', '.join(cols)} FROM {source}"


def _strict(agg: str, c: str) -> str:
    return f"CASE WHEN count({c}) = count(*) THEN {agg}({c}) END"


# Resamples ---------------------------------------------------------------------------


def _pool(g: str, v: str, unit: str, source: str) -> str:
    return f"""pool AS (
  SELECT g, list(v ORDER BY h, unit) AS vals, count(*) AS total
  FROM (SELECT {g} AS g, {v} AS v, {unit} AS unit, md5(concat_ws('|', '2012', {g}, {unit})) AS h FROM {source})
  GROUP BY g)"""


def _draws(n_min: int, n_max: int, iters: int, **_: object) -> str:
    index = "('0x' || substr(md5(concat_ws('|', '2012', g, n, i, j)), 1, 15))::BIGINT % total"
    return f"""draws AS (
  SELECT g, n::INTEGER AS sample_size, i::INTEGER AS iter, vals[({index}) + 1] AS value
  FROM pool, unnest(range({n_min}, {n_max} + 1)) a(n), unnest(range(1, {iters} + 1)) b(i),
       unnest(range(1, n + 1)) c(j))"""


def _boot(grid: dict, g: str = "c_nationkey", v: str = ROOT, source: str = "customer", unit: str = "c_custkey") -> str:
    return f"""{_pool(g, v, unit, source)},
{_draws(**grid)},
boot AS (
  SELECT g AS {g}, sample_size, iter, {_strict('avg', 'value')} AS mean, {_strict('stddev_samp', 'value')} AS sd
  FROM draws GROUP BY ALL)"""


def _ci(grid: dict, source: str = "customer") -> str:
    sizes = range(grid["n_min"], grid["n_max"] + 1)
    t = [_t975(n - 1) for n in sizes]
    return f"""{_boot(grid, source=source)},
medians AS (
  SELECT c_nationkey AS mg, {_strict('median', 'mean')} AS median_pop_val FROM boot WHERE sample_size = 30 GROUP BY 1),
tq(df, t) AS (VALUES {_values([(n - 1, float(x)) for n, x in zip(sizes, t)])}),
ci AS (
  SELECT b.*, median_pop_val, sd / sqrt(sample_size) AS std_error, t::DOUBLE * (sd / sqrt(sample_size)) AS error,
         mean - t::DOUBLE * (sd / sqrt(sample_size)) AS lower_ci, mean + t::DOUBLE * (sd / sqrt(sample_size)) AS upper_ci
  FROM boot b LEFT JOIN medians ON c_nationkey IS NOT DISTINCT FROM mg LEFT JOIN tq ON df = sample_size - 1)"""


BOOT_KEYS = "c_nationkey, sample_size, iter"


def _coverage(grid: dict, source: str = "customer") -> str:
    return f"""{_ci(grid, source)},
flags AS (
  SELECT *, CASE WHEN median_pop_val < lower_ci OR median_pop_val > upper_ci THEN 0.0::DOUBLE
                 WHEN median_pop_val > lower_ci AND median_pop_val < upper_ci THEN 1.0::DOUBLE END AS f FROM ci),
cover AS (
  SELECT c_nationkey, sample_size, {_strict('sum', 'f')} AS n_correct, {_strict('max', 'iter')} AS max_n
  FROM flags GROUP BY ALL),
shares AS (SELECT *, n_correct / max_n AS prop_correct FROM cover),
wilson AS (
  SELECT c_nationkey, sample_size, prop_correct,
         (prop_correct + {Z}*{Z}/(2*max_n) - {Z}*sqrt(prop_correct*(1-prop_correct)/max_n + {Z}*{Z}/(4*max_n*max_n)))
           / (1 + {Z}*{Z}/max_n) AS lower_ci,
         (prop_correct + {Z}*{Z}/(2*max_n) + {Z}*sqrt(prop_correct*(1-prop_correct)/max_n + {Z}*{Z}/(4*max_n*max_n)))
           / (1 + {Z}*{Z}/max_n) AS upper_ci
  FROM shares),
curve AS (
  SELECT sample_size, {_strict('avg', 'prop_correct')} AS prop_correct, {_strict('avg', 'lower_ci')} AS lower_ci,
         {_strict('avg', 'upper_ci')} AS upper_ci
  FROM wilson GROUP BY 1)"""


def _precision(grid: dict) -> str:
    return f"""{_ci(grid)},
width AS (
  SELECT c_nationkey, sample_size, iter, upper_ci - lower_ci AS w_ci, abs(lower_ci - upper_ci) AS w_abs,
         abs((upper_ci - lower_ci) - lag(upper_ci - lower_ci) OVER (ORDER BY c_nationkey, sample_size, iter)) AS dw_ci
  FROM ci),
by_group AS (
  SELECT c_nationkey, sample_size, {_strict('avg', 'w_ci')} AS w_ci, {_strict('avg', 'dw_ci')} AS dw_ci
  FROM width GROUP BY ALL),
se_group AS (
  SELECT c_nationkey, sample_size, avg(w_abs) AS m, stddev_samp(w_abs) / sqrt(sample_size) AS se
  FROM width GROUP BY c_nationkey, sample_size),
width_se AS (
  SELECT sample_size, avg(m) AS mean_p, avg(se) AS mean_se, avg(m) - avg(se) AS lower, avg(m) + avg(se) AS upper
  FROM se_group GROUP BY 1),
rel_group AS (
  SELECT c_nationkey, sample_size, avg(w_ci) AS m, stddev_samp(w_ci) AS s, avg(dw_ci) AS d
  FROM width GROUP BY ALL),
width_rel AS (
  SELECT sample_size, avg(m) AS ci_mean, avg(s) AS ci_sd, avg(m - m/sqrt(sample_size)) AS lower_se,
         avg(m + m/sqrt(sample_size)) AS upper_se, avg(s) / sample_size AS ci_se
  FROM rel_group GROUP BY sample_size),
change AS (
  SELECT sample_size, avg(d) AS ci_change_mean, avg(s) AS ci_change_sd, avg(d - d/sqrt(sample_size)) AS lower_se,
         avg(d + d/sqrt(sample_size)) AS upper_se, avg(s) / sample_size AS ci_se
  FROM rel_group GROUP BY sample_size)"""


# Segments ----------------------------------------------------------------------------

ITEMS = """items AS (
  SELECT 'all' AS grp, sqrt(l_extendedprice) AS root_price, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey,
         l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS unit
  FROM lineitem)"""
RANKED = """ranked AS (
  SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment,
         row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat_ws('|', '2012', c_mktsegment, c_custkey)), c_custkey)
           AS ordinal
  FROM customer)"""

LONG = """numbered AS (
  SELECT lower(c_mktsegment) AS segment, c_acctbal AS balance,
         row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rep
  FROM customer),
wide AS (
  SELECT rep, {0} FROM numbered GROUP BY rep),
long AS (
  SELECT rep, segment, balance FROM wide UNPIVOT INCLUDE NULLS (balance FOR segment IN ({1}))
  WHERE balance IS NOT NULL)""".format(
    ", ".join(f"max(balance) FILTER (segment = '{s.lower()}') AS {s.lower()}" for s in SEGMENTS),
    ", ".join(s.lower() for s in SEGMENTS),
)


def _two(
    grid: dict, v: str = ROOT, source: str = "customer", unit: str = "c_custkey", pairs: list[tuple] | None = None
) -> str:
    """CTEs that end in ``boot2``: resamples of each listed pair, or of the one pair."""
    pairs = pairs or [PAIR]
    listed = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    names = tuple(sorted({x for p in pairs for x in p}))
    where = f"(SELECT * FROM {source} WHERE c_mktsegment IN {names})"
    df = "pow((v1+v2)/n, 2) / ((pow(v1/n, 2) + pow(v2/n, 2)) / (n-1))"
    return f"""{_pool('c_mktsegment', v, unit, where)},
{_draws(**grid)},
moments AS (SELECT g, sample_size, iter, avg(value) AS mean, stddev_samp(value) AS sd FROM draws GROUP BY ALL),
listed(group1, group2) AS (VALUES {listed}),
freedom AS (
  SELECT *, {df} AS df FROM (
    SELECT group1, group2, a.sample_size, a.iter, a.mean AS mean1, a.sd AS sd1, b.mean AS mean2, b.sd AS sd2,
           a.sd*a.sd AS v1, b.sd*b.sd AS v2, a.sample_size::DOUBLE AS n
    FROM listed JOIN moments a ON a.g = group1 JOIN moments b ON b.g = group2 AND b.sample_size = a.sample_size AND b.iter = a.iter)),
{_t_quantiles('freedom', 'df')},
errors AS (SELECT f.*, q * sqrt((v1+v2)/n) AS e FROM freedom f LEFT JOIN quantiles USING (df)),
boot2 AS (
  SELECT group1, group2, sample_size, iter, mean1, sd1, mean2, sd2, mean1 - mean2 AS mean_diff, mean1 - mean2 - e AS lower_ci,
         mean1 - mean2 + e AS upper_ci, 2 * e AS width_ci
  FROM errors)"""


def _curve2(n_tested: int, n_min: int) -> str:
    return f"""curve AS (
  SELECT group1, group2, sample_size, avg(mean_diff) AS mean_diff, avg(lower_ci) AS lower_ci, avg(upper_ci) AS upper_ci,
         avg(width_ci) AS width_ci, sample_size > {n_tested} AS extrapolated
  FROM boot2 WHERE sample_size >= {n_min} GROUP BY ALL)"""


def _pairs(pairs: list[tuple], source: str = "customer", g: str = "c_mktsegment", v: str = "c_acctbal") -> str:
    listed = ", ".join("(" + ", ".join("NULL::VARCHAR" if x is None else repr(x) for x in p) + ")" for p in pairs)
    return f"""stats AS (
  SELECT {g} AS g, avg({v}) AS mean, count(*) AS n, var_samp({v}) AS v FROM {source} GROUP BY 1),
pairs(group1, group2) AS (VALUES {listed}),
pair AS (
  SELECT group1, group2, a.mean AS mean1, a.n AS n1, a.v AS v1, b.mean AS mean2, b.n AS n2, b.v AS v2
  FROM pairs JOIN stats a ON a.g IS NOT DISTINCT FROM group1 JOIN stats b ON b.g IS NOT DISTINCT FROM group2)"""


# Two-sided p: the integral of the tail by Simpson's rule, over the angle whose tangent is t / sqrt(df), as far as the
# density is not negligible beside its largest value.
SIMPSON, TAIL = 2000, 8000


def _welch(pairs: list[tuple], *source: str) -> str:
    constant = "exp(lgamma((df+1)/2) - lgamma(df/2)) / sqrt(pi())"
    return f"""{_pairs(pairs, *source)},
tested AS (
  SELECT *, (mean1-mean2) / sqrt(v1/n1 + v2/n2) AS t, sqrt(v1/n1 + v2/n2) AS se,
         pow(v1/n1 + v2/n2, 2) / (pow(v1/n1, 2)/(n1-1) + pow(v2/n2, 2)/(n2-1)) AS df
  FROM pair),
angles AS (
  SELECT group1, group2, df, atan(abs(t)/sqrt(df)) AS low, least(pi()/2, atan(abs(t)/sqrt(df)) + 12/sqrt(df)) AS high FROM tested),
integrals AS (
  SELECT group1, group2,
         sum((CASE WHEN k IN (0, {TAIL}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(low + (high-low)*k/{TAIL}), df-1))
           * any_value((high-low)/{TAIL}/3 * {constant}) AS tail
  FROM angles, unnest(range(0, {TAIL} + 1)) s(k) GROUP BY 1, 2),
{_t_quantiles('tested', 'df')},
welch AS (
  SELECT t.group1, t.group2, mean1, mean2, t, df, 2*tail AS p_value, log10(2*tail) AS log_p, mean1 - mean2 - se * q AS lower_ci,
         mean1 - mean2 + se * q AS upper_ci
  FROM tested t JOIN integrals i ON t.group1 IS NOT DISTINCT FROM i.group1 AND t.group2 IS NOT DISTINCT FROM i.group2
  JOIN quantiles USING (df))"""


def _pooled(pairs: list[tuple], *source: str) -> str:
    return f"""{_pairs(pairs, *source)},
pooled AS (
  SELECT *, sqrt(((n1-1)*v1 + (n2-1)*v2) / (n1+n2-2)) AS s_pooled,
         sqrt(((n1-1)*v1 + (n2-1)*v2) / (n1+n2-2)) * sqrt(1.0::DOUBLE/n1 + 1.0::DOUBLE/n2) AS se_diff
  FROM pair)"""


def _design(pairs: list[tuple], *source: str) -> str:
    return f"""{_pooled(pairs, *source)},
effects(possible_effect) AS (VALUES {_values([(e,) for e in EFFECTS])}),
grid AS (SELECT group1, group2, n1, n2, s_pooled, possible_effect::DOUBLE AS possible_effect, se_diff, abs(possible_effect)/se_diff AS r
         FROM pooled, effects),
-- normal density integrated from 0 to z - r and from 0 to z + r
areas AS (
  SELECT group1, group2, possible_effect, sum(w * exp(-pow((z-r)*k/{SIMPSON}, 2)/2)) * any_value((z-r)/{SIMPSON}/3) / sqrt(2*pi()) AS a,
         sum(w * exp(-pow((z+r)*k/{SIMPSON}, 2)/2)) * any_value((z+r)/{SIMPSON}/3) / sqrt(2*pi()) AS b
  FROM (SELECT *, {Z} AS z, CASE WHEN k IN (0, {SIMPSON}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS w
        FROM grid, unnest(range(0, {SIMPSON} + 1)) s(k))
  GROUP BY 1, 2, 3),
tails AS (SELECT grid.*, 0.5 - a AS hi, 0.5 - b AS lo FROM grid JOIN areas USING (group1, group2, possible_effect)),
design AS (
  SELECT group1, group2, n1, n2, s_pooled, possible_effect, se_diff, hi + lo AS power, lo / (hi + lo) AS type_s,
         (r*(hi - lo) + (exp(-pow({Z}-r, 2)/2) + exp(-pow({Z}+r, 2)/2)) / sqrt(2*pi())) / (r*(hi + lo)) AS type_m
  FROM tails)"""


# Literature --------------------------------------------------------------------------

AWKWARD = """awkward AS (
  SELECT doc_id, CASE WHEN lang = 'en' THEN 'NA' WHEN lang = 'de' THEN '' WHEN lang <> 'fr' THEN lang END AS lang,
         '"' || source || '", "' || text || '"' AS text
  FROM documents)"""
LITERATURE = "lit AS (SELECT p_partkey, p_type, p_brand, nullif(p_size, 7) AS n, p_retailprice FROM part)"
SURVEYED = "lit AS (SELECT nullif(p_size, 7) AS n FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#2')"
DISTRIBUTION = """median(n)::DOUBLE AS median, min(n) AS min, max(n) AS max, stddev_samp(n) AS sd, count(n) AS nn,
         stddev_samp(n) / sqrt(count(n)) AS se"""


def _shares(by: str = "") -> str:
    parts = [
        f"SELECT {by} count(n) AS n_known, {t}.0::DOUBLE AS threshold, count(*) FILTER (n > {t}) AS n_above, "
        f"count(*) FILTER (n > {t}) / nullif(count(n), 0)::DOUBLE AS prop_above FROM lit GROUP BY ALL"
        for t in THRESHOLDS
    ]
    return f"shares AS ({' UNION ALL '.join(parts)})"


def _histogram(by: str = "") -> str:
    on = "bin" + (", p_type" if by else "")
    groups = "(SELECT DISTINCT p_type FROM lit) g, " if by else ""
    return f"""binned AS (
  SELECT {by} ceil((n + 1.5) / 5)::INTEGER AS bin, count(*) AS c FROM lit WHERE n BETWEEN 0 AND 70 GROUP BY ALL),
bins AS (SELECT {by} bin::INTEGER AS bin FROM {groups} unnest(range(1, 16)) b(bin)),
hist AS (
  SELECT {by} bin, bin*5.0::DOUBLE - 4 AS bin_center, bin*5.0::DOUBLE - 6.5 AS bin_lower, bin*5.0::DOUBLE - 1.5 AS bin_upper,
         coalesce(c, 0) AS frequency
  FROM bins LEFT JOIN binned USING ({on}))"""


def oracles() -> dict[str, str]:
    drawn = _boot(GRID)
    ci, cover, precise = _ci(GRID), _coverage(GRID), _precision(GRID)
    kept = f"(SELECT * FROM customer WHERE c_nationkey NOT IN {tuple(EXCLUDED)})"
    boot_cols = (BOOT_KEYS, "mean, sd")
    median_cols = (BOOT_KEYS, "mean, sd, median_pop_val")
    two_cols = ("sample_size, iter", "mean1, sd1, mean2, sd2, mean_diff, lower_ci, upper_ci, width_ci")
    curve2_cols = ("sample_size, extrapolated", "mean_diff, lower_ci, upper_ci, width_ci")
    welch_cols = ("group1, group2", "mean1, mean2, t, df, p_value, log_p, lower_ci, upper_ci")
    design_cols = ("group1, group2", "possible_effect, se_diff, power, type_s, type_m")
    pair = "group1, group2"

    def boot(text: str, where: str = "") -> str:
        return f"WITH {text} {_final('boot' + where, *boot_cols)}"

    tested15 = f"{RANKED}, tested AS (SELECT * FROM ranked WHERE ordinal <= 15)"
    tested20 = f"{RANKED}, tested AS (SELECT * FROM ranked WHERE ordinal <= 20)"
    unknown = "(SELECT * REPLACE (CASE WHEN c_acctbal < -500 THEN NULL ELSE c_acctbal END AS c_acctbal) FROM customer)"
    unknown_few = unknown.replace("-500", "-900")
    change_cols = ("sample_size", "ci_change_mean, ci_change_sd, lower_se, upper_se, ci_se")
    width_cols = ("sample_size", "ci_mean, ci_sd, lower_se, upper_se, ci_se")
    capped = ", ".join(f"CASE WHEN {c} > {CAP} THEN {CAP} ELSE {c} END AS {c}" for c in ("ci_change_mean", "upper_se"))
    study_precision = {
        "study_precision_by_group": f"WITH {precise} {_final('by_group', 'c_nationkey, sample_size', 'w_ci, dw_ci')}",
        "study_precision_width_se": f"WITH {precise} {_final('width_se', 'sample_size', 'mean_p, mean_se, lower, upper')}",
        "study_precision_width": f"WITH {precise} {_final('width_rel', *width_cols)}",
        "study_precision_width_focus": f"WITH {precise} {_final('width_rel WHERE sample_size > 3', *width_cols)}",
        "study_precision_change": f"WITH {precise} {_final('change', *change_cols)}",
        "study_precision_change_focus": f"WITH {precise}, capped AS (SELECT * REPLACE ({capped}) FROM change WHERE sample_size > 3) "
        f"{_final('capped', *change_cols)}",
    }
    rooted = f"{RANKED}, roots AS (SELECT c_mktsegment, sqrt(abs(c_acctbal)) AS root_balance, ordinal FROM ranked WHERE ordinal <= 15)"
    some = "(SELECT * FROM roots WHERE c_mktsegment IN " + str(tuple(sorted({x for p in PAIRS for x in p}))) + ")"
    two15 = _two(GRID, "root_balance", "roots", "ordinal", PAIRS)
    of_roots = ("roots", "c_mktsegment", "root_balance")
    study_pairs = {
        "study_pairs_counts": f"WITH {rooted} SELECT c_mktsegment, count(*) AS n FROM {some} GROUP BY 1",
        "study_pairs_summary": f"WITH {rooted}, s AS (SELECT c_mktsegment, avg(root_balance) AS mean, count(*) AS n, "
        f"stddev_samp(root_balance) AS sd, stddev_samp(root_balance) / sqrt(count(*)) AS se FROM {some} GROUP BY 1) "
        f"{_final('s', 'c_mktsegment, n', 'mean, sd, se')}",
        "study_pairs_welch": f"WITH RECURSIVE {rooted}, {_welch(PAIRS, *of_roots)} {_final('welch', *welch_cols)}",
        "study_pairs_boot": f"WITH RECURSIVE {rooted}, {two15} {_final('boot2', f'{pair}, {two_cols[0]}', two_cols[1], 5)}",
        "study_pairs_curve": f"WITH RECURSIVE {rooted}, {two15}, {_curve2(15, 3)} "
        f"{_final('curve', f'{pair}, {curve2_cols[0]}', curve2_cols[1])}",
        "study_pairs_diff": f"WITH RECURSIVE {rooted}, {two15}, d AS (SELECT {pair}, avg(lower_ci) AS lower_ci, "
        "avg(upper_ci) AS upper_ci, avg(mean_diff) AS mean_diff FROM boot2 WHERE sample_size = 15 GROUP BY ALL) "
        f"{_final('d', pair, 'lower_ci, upper_ci, mean_diff')}",
        "study_pairs_pooled_se": f"WITH {rooted}, {_pooled(PAIRS, *of_roots)} "
        f"{_final('pooled', 'group1, group2, n1, n2', 's_pooled, se_diff')}",
        "study_pairs_design": f"WITH {rooted}, {_design(PAIRS, *of_roots)} "
        f"{_final('design', 'group1, group2, n1, n2', 's_pooled, possible_effect, se_diff, power, type_s, type_m')}",
    }
    return {
        "a01_decimal_comma_csv": "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS l_extendedprice FROM lineitem",
        "a02_csv": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
        "a03_stage": "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer",
        "a03_stage_csv": "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer",
        "a02_csv_text_by_name": f"WITH {AWKWARD} SELECT text, nullif(lang, 'NA') AS lang, doc_id FROM awkward",
        "a03_stage_csv_text": f"WITH {AWKWARD} SELECT * FROM awkward",
        "a04_clean_names": "SELECT c_custkey AS customer_key, c_name AS customer_name, c_nationkey AS nation_number, "
        "c_acctbal AS balance_percent, c_mktsegment AS customer_name_2 FROM customer",
        "a05_coerce_numeric": "SELECT l_orderkey, l_linenumber, "
        "try_cast(CASE WHEN l_returnflag = 'R' THEN l_returnflag ELSE l_quantity::VARCHAR END AS DOUBLE) AS quantity, "
        "try_cast(CASE WHEN l_linestatus = 'O' THEN 'n/a' ELSE l_discount::VARCHAR END AS DOUBLE) AS discount FROM lineitem",
        "a06_wide_to_long": f"WITH {LONG} {_final('long WHERE rep BETWEEN 1 AND 30', 'rep, segment', 'balance')}",
        "a07_filter_recycled": f"WITH {LONG}, placed AS (SELECT *, row_number() OVER (ORDER BY segment, rep) - 1 AS i FROM long) "
        f"{_final('placed WHERE rep = i % 30 + 1', 'rep, segment', 'balance')}",
        "a08_shuffle_rank": "SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey "
        "ORDER BY md5(concat_ws('|', '2012', c_nationkey, c_custkey)), c_custkey) AS ordinal FROM customer",
        "a09_levels": 'SELECT "column", level, row_number() OVER (PARTITION BY "column" ORDER BY level) AS code FROM ('
        "SELECT DISTINCT 'o_orderpriority' AS \"column\", o_orderpriority AS level FROM orders "
        "UNION ALL SELECT DISTINCT 'o_orderstatus', o_orderstatus FROM orders)",
        "a10_bootstrap_groups": boot(drawn),
        "a10_bootstrap_with_unknown_values": boot(_boot(GRID, source=unknown)),
        "a10_bootstrap_default_grid": boot(drawn),
        "a10_bootstrap_large_group": f"WITH {ITEMS}, {_boot(GRID, 'grp', 'root_price', 'items', 'unit')} "
        f"{_final('boot', 'grp, sample_size, iter', 'mean, sd')}",
        "a15a_coverage_large_constant": "SELECT 'all' AS grp, n::INTEGER AS sample_size, 499::INTEGER AS max_n, NULL::DOUBLE AS n_correct, "
        "NULL::DOUBLE AS prop_correct FROM unnest(range(3, 51)) s(n)",
        "a11_bootstrap_batches": boot(drawn, f" WHERE c_nationkey IN {tuple(x for b in BATCHES for x in b)}"),
        "a11_bootstrap_batches_resumed": boot(drawn, f" WHERE c_nationkey IN {tuple(x for b in BATCHES for x in b)}"),
        "a12_exclude_groups": boot(drawn, f" WHERE c_nationkey NOT IN {tuple(EXCLUDED)}"),
        "a12_exclude_groups_table": "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer "
        "WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
        "a12_exclude_null_group": "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer "
        f"WHERE c_nationkey NOT IN {(5, *EXCLUDED)}",
        "a13_population_median_unknown": f"WITH {_ci(GRID, unknown_few)} {_final('ci', *median_cols)}",
        "a13_population_median": f"WITH {ci} {_final('ci', *median_cols)}",
        "a13_population_median_full_join": f"WITH {drawn}, medians AS (SELECT c_nationkey AS mg, median(mean) AS median_pop_val "
        "FROM boot WHERE sample_size = 30 GROUP BY 1), "
        "joined AS (SELECT coalesce(c_nationkey, mg) AS c_nationkey, sample_size, iter, mean, sd, median_pop_val "
        f"FROM boot FULL JOIN medians ON c_nationkey IS NOT DISTINCT FROM mg) {_final('joined', *median_cols)}",
        "a14_t_ci": f"WITH {ci} {_final('ci', BOOT_KEYS, 'mean, sd, median_pop_val, std_error, error, lower_ci, upper_ci', 5)}",
        "a15a_coverage": f"WITH {cover} {_final('shares', 'c_nationkey, sample_size, max_n', 'n_correct, prop_correct')}",
        "a15b_wilson_ci": f"WITH {cover} {_final('wilson', 'c_nationkey, sample_size', 'prop_correct, lower_ci, upper_ci')}",
        "a15c_pooled_curve": f"WITH {cover} {_final('curve', 'sample_size', 'prop_correct, lower_ci, upper_ci')}",
        "a16_ci_width": f"WITH {precise} {_final('width', BOOT_KEYS, 'w_ci, w_abs')}",
        "a17_global_lag": f"WITH {precise} {_final('width', BOOT_KEYS, 'w_ci, dw_ci')}",
        "a18_precision_by_group": f"WITH {precise} {_final('by_group', 'c_nationkey, sample_size', 'w_ci, dw_ci')}",
        "a19_pooled_width_se": f"WITH {precise} {_final('width_se', 'sample_size', 'mean_p, mean_se, lower, upper')}",
        "a20_pooled_width_rel": f"WITH {precise} {_final('width_rel', 'sample_size', 'ci_mean, ci_sd, lower_se, upper_se, ci_se')}",
        "a21_pooled_change": f"WITH {precise} {_final('change', 'sample_size', 'ci_change_mean, lower_se, upper_se')}",
        "a21_pooled_change_with_sd": f"WITH {precise} "
        f"{_final('change', 'sample_size', 'ci_change_mean, ci_change_sd, lower_se, upper_se, ci_se')}",
        "a22_clamp": f"WITH {precise}, capped AS (SELECT sample_size, lower_se, "
        f"CASE WHEN ci_change_mean > {CAP} THEN {CAP} ELSE ci_change_mean END AS ci_change_mean, "
        f"CASE WHEN upper_se > {CAP} THEN {CAP} ELSE upper_se END AS upper_se FROM change WHERE sample_size > 3) "
        f"{_final('capped', 'sample_size', 'ci_change_mean, lower_se, upper_se')}",
        "a23_study_subset": f"WITH {RANKED} SELECT * FROM ranked WHERE c_mktsegment IN {PAIR} AND ordinal BETWEEN 1 AND 15",
        "a24_group_count": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
        "a25_group_summary": "WITH s AS (SELECT c_mktsegment, avg(c_acctbal) AS mean, count(*) AS n, stddev_samp(c_acctbal) AS sd, "
        "stddev_samp(c_acctbal) / sqrt(count(*)) AS se FROM customer GROUP BY 1) "
        f"{_final('s', 'c_mktsegment, n', 'mean, sd, se')}",
        "a25_group_summary_singletons": "WITH v AS (SELECT s_nationkey, CASE WHEN s_acctbal >= -800 THEN s_acctbal END AS x FROM supplier), "
        f"s AS (SELECT s_nationkey, {_strict('avg', 'x')} AS mean, count(*) AS n, {_strict('stddev_samp', 'x')} AS sd, "
        f"{_strict('stddev_samp', 'x')} / sqrt(count(*)) AS se FROM v GROUP BY 1) {_final('s', 's_nationkey, n', 'mean, sd, se')}",
        "a26_welch_test": f"WITH RECURSIVE {_welch(PAIRS)} {_final('welch', *welch_cols)}",
        "a26_welch_two_groups": f"WITH RECURSIVE {_welch([('F', 'O')], 'lineitem', 'l_linestatus', 'l_discount')} "
        f"{_final('welch', *welch_cols)}",
        "a26_welch_null_group": "WITH RECURSIVE items AS (SELECT nullif(l_linestatus, 'F') AS s, l_discount FROM lineitem), "
        f"{_welch([('O', None)], 'items', 's', 'l_discount')} {_final('welch', *welch_cols)}",
        "a26_welch_small_p": "WITH RECURSIVE apart AS (SELECT o_orderpriority, "
        "o_totalprice / 1000 * (1 + left(o_orderpriority, 1)::INTEGER / 40::DOUBLE) AS price FROM orders), "
        f"{_welch([('1-URGENT', x) for x in ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')], 'apart', 'o_orderpriority', 'price')} "
        f"{_final('welch', *welch_cols)}",
        "a27_bootstrap_pairs": f"WITH RECURSIVE {_two(GRID, pairs=PAIRS)} {_final('boot2', f'{pair}, {two_cols[0]}', two_cols[1], 5)}",
        "a28_pair_curves": f"WITH RECURSIVE {_two(GRID, pairs=PAIRS)}, {_curve2(7, 4)} "
        f"{_final('curve', f'{pair}, {curve2_cols[0]}', curve2_cols[1])}",
        "a29_pair_differences": f"WITH RECURSIVE {_two(GRID, pairs=PAIRS)}, d AS (SELECT {pair}, avg(lower_ci) AS lower_ci, "
        f"avg(upper_ci) AS upper_ci, avg(mean_diff) AS mean_diff FROM boot2 WHERE sample_size = 8 GROUP BY ALL) "
        f"{_final('d', pair, 'lower_ci, upper_ci, mean_diff')}",
        "a27_bootstrap_two": f"WITH RECURSIVE {_two(GRID)} {_final('boot2', *two_cols, 5)}",
        "a28_two_group_curve": f"WITH RECURSIVE {_two(GRID)}, {_curve2(7, 4)} {_final('curve', *curve2_cols)}",
        "a29_diff_at": f"WITH RECURSIVE {_two(GRID)}, d AS (SELECT avg(lower_ci) AS lower_ci, avg(upper_ci) AS upper_ci, "
        f"avg(mean_diff) AS mean_diff FROM boot2 WHERE sample_size = 8) {_final('d', '', 'lower_ci, upper_ci, mean_diff')}",
        "a30_pooled_se": f"WITH {_pooled(PAIRS)} {_final('pooled', 'group1, group2, n1, n2', 's_pooled, se_diff')}",
        "a31_design_analysis": f"WITH {_design(PAIRS)} {_final('design', *design_cols)}",
        "a32_split_by_metric": f"WITH {LITERATURE} SELECT p_partkey, n, p_retailprice FROM lit "
        "WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#2'",
        "a33_known_count": f"WITH {LITERATURE} SELECT count(n) AS n_known FROM lit",
        "a34_distribution_summary": f"WITH {LITERATURE}, d AS (SELECT {DISTRIBUTION} FROM lit WHERE n IS NOT NULL) "
        f"{_final('d', 'min, max, nn', 'median, sd, se')}",
        "a34_distribution_summary_by_type": f"WITH {LITERATURE}, d AS (SELECT p_type, {DISTRIBUTION} FROM lit "
        f"WHERE n IS NOT NULL GROUP BY 1) {_final('d', 'p_type, min, max, nn', 'median, sd, se')}",
        "a35_share_above": f"WITH {LITERATURE}, {_shares()} {_final('shares', 'n_known, n_above', 'threshold, prop_above')}",
        "a35_share_above_by_type": f"WITH {LITERATURE}, {_shares('p_type,')} "
        f"{_final('shares', 'p_type, n_known, n_above', 'threshold, prop_above')}",
        "a36_histogram": f"WITH {LITERATURE}, {_histogram()} SELECT * FROM hist",
        "a36_histogram_by_type": f"WITH {LITERATURE}, {_histogram('p_type,')} SELECT * FROM hist",
        "a36_histogram_group_outside": "WITH lit AS (SELECT p_type, nullif(p_size, 7) + CASE WHEN p_type = 'ECONOMY' THEN 100 ELSE 0 END "
        f"AS n FROM part), {_histogram('p_type,')} SELECT * FROM hist",
        "study_coverage_default_grid": f"WITH {_coverage(GRID)} {_final('curve', 'sample_size', 'prop_correct, lower_ci, upper_ci')}",
        "study_precision_default_grid": f"WITH {_precision(GRID)} "
        f"{_final('change', 'sample_size', 'ci_change_mean, ci_change_sd, lower_se, upper_se, ci_se')}",
        **study_precision,
        **study_pairs,
        "study_survey_records": f"WITH {LITERATURE} SELECT n, p_type, p_retailprice FROM lit WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#2'",
        "study_survey_known": f"WITH {SURVEYED} SELECT count(n) AS n_known FROM lit",
        "study_survey_shares": f"WITH {SURVEYED}, {_shares()} {_final('shares', 'n_known, n_above', 'threshold, prop_above')}",
        "study_survey_histogram": f"WITH {SURVEYED}, {_histogram()} SELECT * FROM hist",
        "study_survey_distribution": f"WITH {SURVEYED}, d AS (SELECT {DISTRIBUTION} FROM lit WHERE n IS NOT NULL) "
        f"{_final('d', 'min, max, nn', 'median, sd, se')}",
        "study_coverage_curve": f"WITH {_coverage(GRID, kept)} {_final('curve', 'sample_size', 'prop_correct, lower_ci, upper_ci')}",
        "study_clean_measurements": f"""WITH {LONG}, kept AS (
  SELECT segment || '_deg_c' AS "group", count(*) AS n, count(*) AS last, avg(balance) AS mean
  FROM long WHERE rep <= 30 AND segment <> 'machinery' GROUP BY 1) {_final('kept', '"group", n, last', 'mean')}""",
        "study_two_groups": f"WITH RECURSIVE {tested15}, {_two(GRID, 'c_acctbal', 'tested', 'ordinal')}, {_curve2(15, 3)} {_final('curve', *curve2_cols)}",
        "study_two_groups_design": f"WITH {tested20}, {_design([PAIR], 'tested')} {_final('design', *design_cols)}",
        "p_select": "SELECT p_partkey, p_name AS name, p_size, p_retailprice, round(p_retailprice / sqrt(p_size), 6) AS unit_price, "
        "abs(p_size - 25) AS size_change, pow(p_size, 2) AS size_squared FROM part",
        "p_filter": "SELECT p_partkey, p_type, p_brand, p_size FROM part WHERE p_type IN ('ECONOMY', 'SMALL') "
        "AND p_brand NOT IN ('Brand#1', 'Brand#2') AND p_size BETWEEN 5 AND 30 AND p_retailprice > 950",
        "p_dropna": "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL",
        "p_case": f"WITH {LITERATURE} SELECT p_partkey, CASE WHEN n > 30 THEN 1 ELSE 0 END AS with_default, "
        "CASE WHEN n < 10 THEN 0 WHEN n > 20 THEN 1 END AS without_default, CASE WHEN n > 40 THEN 40 ELSE n END AS if_else FROM lit",
        "p_full_join": "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, lang, quality "
        "FROM (SELECT nullif(doc_id, 3) AS doc_id, lang FROM documents) d "
        "FULL JOIN labels l ON d.doc_id IS NOT DISTINCT FROM l.doc_id",
        "p_cross": "SELECT c_mktsegment, c_nationkey, n::INTEGER AS sample_size, i::INTEGER AS iter "
        "FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer), unnest(range(3, 11)) a(n), unnest(range(1, 10)) b(i)",
        "p_agg": "WITH a AS (SELECT c_nationkey, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd, sum(c_acctbal) AS total, "
        "min(c_acctbal) AS low, max(c_acctbal) AS high, count(*) AS n FROM customer GROUP BY 1) "
        f"{_final('a', 'c_nationkey, n', 'mean, sd, total, low, high')}",
        "p_median": f"WITH m AS (SELECT event_type, median(value) AS median FROM events GROUP BY 1) {_final('m', 'event_type', 'median')}",
        "p_two_level": "WITH i AS (SELECT c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY c_nationkey, c_mktsegment), "
        f"o AS (SELECT c_mktsegment, avg(m) AS mean_of_means FROM i GROUP BY 1) {_final('o', 'c_mktsegment', 'mean_of_means')}",
        "p_window_agg": "WITH w AS (SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, avg(c_acctbal) OVER g AS group_mean, "
        "stddev_samp(c_acctbal) OVER g AS group_sd, count(*) OVER g AS group_n FROM customer WINDOW g AS (PARTITION BY c_nationkey)) "
        f"{_final('w', 'c_custkey, c_nationkey, c_acctbal, c_mktsegment, group_n', 'group_mean, group_sd')}",
        "p_global_agg": "SELECT p_partkey, p_size, count(*) OVER () AS nn, "
        "(sum(CASE WHEN p_size > 30 THEN 1 ELSE 0 END) OVER ())::BIGINT AS n_above FROM part",
        "p_first_row": "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer "
        "QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) = 1",
        "p_kth_row": "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer "
        "QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) = 2",
        "p_kth_row_deep": "SELECT l_returnflag, l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem "
        "QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_quantity, l_linenumber, l_orderkey) = 5000",
        "p_window_agg_hot": "WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, "
        "(CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey END)::BIGINT AS g FROM lineitem) SELECT *, "
        "count(*) OVER w AS group_n, max(l_extendedprice) OVER w AS group_top, sum(l_quantity) OVER w AS group_quantity "
        "FROM l WINDOW w AS (PARTITION BY g)",
        "p_row_number": "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, "
        "row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS row_number FROM customer",
        "p_lag": "SELECT s_nationkey, s_suppkey, s_acctbal, lag(s_acctbal) OVER (ORDER BY s_nationkey, s_suppkey) AS lagged FROM supplier",
        "p_row_index": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_index FROM orders",
        "p_sort_limit": f"WITH {LITERATURE} SELECT p_partkey, n FROM lit ORDER BY n NULLS LAST, p_partkey LIMIT 6",
        "p_union": "SELECT c_custkey AS key, c_acctbal AS balance, NULL::VARCHAR AS name FROM customer "
        "UNION ALL SELECT s_suppkey, s_acctbal, s_name FROM supplier",
        "p_nest_unnest": "SELECT c_nationkey, (row_number() OVER (PARTITION BY c_nationkey "
        "ORDER BY md5(concat_ws('|', '2012', c_nationkey, c_custkey)), c_custkey) - 1) // 20 AS chunk, c_custkey, c_acctbal, "
        "row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(concat_ws('|', '2012', c_nationkey, c_custkey)), c_custkey) "
        "AS ordinal FROM customer",
        "p_map_array": "WITH r AS (SELECT c_nationkey, c_acctbal, (row_number() OVER (PARTITION BY c_nationkey "
        "ORDER BY md5(concat_ws('|', '2012', c_nationkey, c_custkey)), c_custkey) - 1) // 20 AS chunk FROM customer), "
        "m AS (SELECT c_nationkey, chunk, count(*)::INTEGER AS n, sum(2 * c_acctbal) AS doubled FROM r GROUP BY 1, 2) "
        f"{_final('m', 'c_nationkey, chunk, n', 'doubled')}",
        "p_unpivot": "SELECT p_partkey, measure, value FROM (SELECT p_partkey, nullif(p_size, 7)::DOUBLE AS p_size, "
        "p_retailprice FROM part) UNPIVOT INCLUDE NULLS (value FOR measure IN (p_size, p_retailprice))",
        "p_try_cast": "SELECT p_partkey, try_cast(split_part(p_brand, '#', 2) AS DOUBLE) AS good, try_cast(p_brand AS DOUBLE) AS bad FROM part",
    }
