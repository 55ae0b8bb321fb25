"""Run queries against their SQL in DuckDB: python -m tests.compare <folder> [query ...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return connection


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, missing as None, floats by repr; sorted."""
    columns = sorted(frame.columns)

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)

    series = [[cell(v) for v in frame[c].astype(object)] for c in columns]
    return sorted(zip(*series))


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} against {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} against {len(theirs)}"
    for c in ours.columns:
        kinds = ours[c].dtype.kind, theirs[c].dtype.kind
        sizes = ours[c].dtype.itemsize, theirs[c].dtype.itemsize
        if kinds != kinds[::-1] or (kinds[0] in "if" and sizes != sizes[::-1]):
            if not (ours[c].isna().all() and theirs[c].isna().all()):
                return f"type of {c}: {ours[c].dtype} against {theirs[c].dtype}"
    a, b = canonical(ours), canonical(theirs)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from tests.conftest import session

    folder, names = sys.argv[1], sys.argv[2:]
    spark, connection = session(), database(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    print("without SQL:", sorted(set(queries) - set(oracles)), "without query:", sorted(set(oracles) - set(queries)))
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            ours = queries[name](spark, folder).toPandas()
            seconds = time.time() - start
            problem = difference(ours, connection.execute(oracles[name]).df()) if name in oracles else "no SQL"
            print(f"{'ok  ' if not problem else 'FAIL'} {name} {len(ours)} rows {seconds:.1f}s {problem or ''}", flush=True)
        except Exception:
            problem = "error"
            print(f"FAIL {name}\n{traceback.format_exc(limit=-3)[:3000]}", flush=True)
        failed += bool(problem)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
