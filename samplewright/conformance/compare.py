"""Run queries beside their SQL and compare the rows as multisets."""

from __future__ import annotations

import sys
import time
from collections import Counter

from samplewright.conformance.oracles import oracles
from samplewright.conformance.queries import REGISTRY
from samplewright.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def differences(spark, con, sf_dir: str, name: str) -> list[str]:
    """What differs between a query and its SQL; empty if nothing does."""
    df = REGISTRY[name](spark, sf_dir)
    order = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in order]).collect()]
    if name not in oracles():
        return [] if got else ["no rows"]
    result = con.sql(oracles()[name])
    if sorted(result.columns) != order:
        return [f"columns {order} against {sorted(result.columns)}"]
    expected = [tuple(r) for r in result.select(*[f'"{c}"' for c in order]).fetchall()]
    types = [t for c in order for n, t in df.dtypes if n == c]
    sql_types = {c: str(t) for c, t in zip(result.columns, result.types)}
    alias = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    out = [
        f"type of {c}: {t} against {sql_types[c]}" for c, t in zip(order, types) if alias.get(t) != sql_types[c]
    ]
    left, right = Counter(got), Counter(expected)
    if left != right:
        out.append(f"{len(got)} rows against {len(expected)}")
        out += [f"only here {x}" for x in list((left - right))[:3]]
        out += [f"only in SQL {x}" for x in list((right - left))[:3]]
    return out


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names or REGISTRY:
        start = time.time()
        try:
            found = differences(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            found = [str(e)[:600]]
        failed += bool(found)
        kind = "ok  " if not found else "FAIL"
        print(f"{kind} {time.time() - start:6.2f} {name} {'' if name in oracles() else '(rows only)'}", flush=True)
        for line in found:
            print("      ", line, flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
