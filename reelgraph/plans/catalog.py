"""The list of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from reelgraph.plans.tables import SQL, Tables


@dataclass(frozen=True)
class Entry:
    name: str
    covers: tuple[str, ...]  # survey rows
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None, using: str = ""):
    """Register ``fn(tables) -> DataFrame``. ``using`` names the logical tables (space separated) the SQL starts from."""

    def add(fn: Callable[[Tables], DataFrame]):
        text = None
        if sql is not None:
            body = sql.strip()
            recursive = "RECURSIVE " if "/* step */" in sql else ""
            heads = [f"{t} AS ({SQL[t]})" for t in using.split()]
            if body.upper().startswith("WITH "):
                heads.append(body[5:])
                text = f"WITH {recursive}" + ",\n".join(heads)
            else:
                text = (f"WITH {recursive}" + ",\n".join(heads) + "\n" if heads else "") + body
        CATALOG[name] = Entry(name, tuple(covers.split()), lambda spark, sf_dir: fn(Tables(spark, sf_dir)), text)
        return fn

    return add
