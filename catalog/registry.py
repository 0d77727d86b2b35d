"""Name -> Spark query and name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import fixtures as fx
from ridgecast.functions.geo import round_half_up

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Registers a query; ``sql`` may read the fixtures in ``uses``."""

    def register(fn: Callable) -> Callable:
        def run(spark, sf_dir: str) -> DataFrame:
            return plain_types(fn(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = fx.duck(sql, *uses)
        return fn

    return register


def plain_types(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and fractions as double, the types the SQL side uses."""
    wide = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    changed = {n: F.col(n).cast(wide[t]) for n, t in df.dtypes if t in wide}
    return df.withColumns(changed) if changed else df


def r6(*names: str) -> dict:
    return {n: round_half_up(n, 6) for n in names}


def rnd(e: str, k: int = 6) -> str:
    return f"(floor(({e}) * 1e{k} + 0.5) / 1e{k})"


def num(e: str) -> str:
    """DuckDB text of a number without a trailing ``.0``."""
    return f"regexp_replace(({e})::DOUBLE::VARCHAR, '\\.0$', '')"
