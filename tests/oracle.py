"""Compare registered queries with their SQL on the sample tables: python -m tests.oracle [folder] [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(table) -> tuple[list[str], list[str], list[tuple]]:
    names = sorted(table.column_names)
    table = table.select(names)
    kinds = [str(table.schema.field(n).type) for n in names]
    columns = [table.column(n).to_pylist() for n in names]
    return names, kinds, sorted(zip(*columns, strict=True), key=repr)


def compare(spark, con, entry, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    got = rows(entry.run(spark, sf_dir).toArrow())
    if entry.sql is None:
        return None
    result = con.execute(entry.sql)
    table = result.to_arrow_table() if hasattr(result, "to_arrow_table") else result.arrow()
    want = rows(table.read_all() if hasattr(table, "read_all") else table)
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    kinds = [(n, a, b) for n, a, b in zip(got[0], got[1], want[1], strict=True) if a != b]
    if kinds:
        return f"types {kinds}"
    if len(got[2]) != len(want[2]):
        return f"{len(got[2])} rows / {len(want[2])}"
    if got[2] != want[2]:
        bad = [(a, b) for a, b in zip(got[2], want[2], strict=True) if a != b]
        return f"{len(bad)} of {len(got[2])} rows differ, e.g. {bad[:2]}"
    return None


def main() -> None:
    from reelgraph.plans import CATALOG
    from reelgraph.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(CATALOG)
    spark, con = local_session(8), connect(sf_dir)
    for name in names:
        start = time.time()
        try:
            n = compare(spark, con, CATALOG[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            n = "ERROR " + str(e)[:600]
        kind = "ok  " if n is None else "FAIL"
        print(kind, name, f"{time.time() - start:.1f}s", "" if n is None else n, "" if CATALOG[name].sql else "(no sql)", flush=True)


if __name__ == "__main__":
    main()
