"""Run registered queries beside their SQL in DuckDB: python tests/compare.py [name-prefix ...]

Environment: SF_DIR (default sf0.01), CPUS (default 8), SKIP (names).
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def difference(spark_df, con, sql: str) -> str:
    """Empty when names, kinds and rows agree."""
    names = sorted(spark_df.columns)
    ours = sorted(tuple(_cell(r[c]) for c in names) for r in spark_df.collect())
    result = con.execute(sql)
    theirs_names = [d[0] for d in result.description]
    if sorted(theirs_names) != names:
        return f"columns {names} against {sorted(theirs_names)}"
    kinds = {d[0]: str(d[1]) for d in result.description}
    place = [theirs_names.index(c) for c in names]
    theirs = sorted(tuple(_cell(r[i]) for i in place) for r in result.fetchall())
    types = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    }
    off = [f"{c}: {t} against {kinds[c]}" for c, t in spark_df.dtypes if types.get(t, t) != kinds[c]]
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    if ours != theirs:
        bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
        a, b = bad[0]
        cells = [(n, x[:80], y[:80]) for n, x, y in zip(names, a, b) if x != y]
        return f"{len(bad)} of {len(ours)} rows differ, e.g. {cells}"
    return f"types differ: {off}" if off else ""


def main() -> None:
    from tidewatch.catalog import REGISTRY
    from tidewatch.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    cpus = os.environ.get("CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    wanted, skipped = sys.argv[1:], os.environ.get("SKIP", "").split()
    failed = 0
    for name, q in REGISTRY.items():
        if name in skipped or wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = q.run(spark, sf_dir)
            if q.sql is None:
                text = f"rows only: {df.count()}"
            else:
                text = difference(df, con, q.sql)
                failed += bool(text)
                text = "FAIL " + text if text else "ok"
        except Exception as error:
            failed += 1
            text = "ERROR " + str(error)[:1500]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(f"{name:34s} {time.time() - start:6.2f}s  {text}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
