"""Query registry, rounding helpers and assembly of the SQL side."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sql_views import VIEWS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PLAIN: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prefix a statement with the views it mentions, in dependency order."""
    chosen: list[str] = []

    def need(text: str) -> None:
        for name, sql in VIEWS.items():
            if name not in chosen and re.search(rf"\b{name}\b", text):
                need(sql)
                if name not in chosen:
                    chosen.append(name)

    need(body)
    if not chosen:
        return body
    head = ", ".join(f"{n} as ({VIEWS[n]})" for n in chosen)
    if body.lstrip().startswith("with "):
        return f"with {head}, {body.lstrip()[5:]}"
    return f"with {head} {body}"


def assemble() -> None:
    """Complete the statements once every module has declared its views."""
    for name, sql in PLAIN.items():
        ORACLES[name] = with_views(sql)


def case(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the statement it must agree with."""

    def wrap(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            PLAIN[name] = sql
        return run

    return wrap


def r(col: Column | str, places: int = 3) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10**places)
    return F.floor(c * scale + 0.5) / scale


def rs(expr: str, places: int = 3) -> str:
    """The same rounding as SQL text."""
    return f"(floor(({expr}) * 1e{places} + 5e-1) / 1e{places})"


def secs(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(F.unix_micros(c) / 1_000_000)


def rounded(df: DataFrame, places: int = 3, skip: tuple[str, ...] = ()) -> DataFrame:
    """Output form shared by both engines: doubles rounded, times as epoch seconds, small
    integers and dates widened to long and text."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if f.name in skip:
            out.append(c)
        elif kind in ("double", "float"):
            out.append(r(c.cast("double"), places).alias(f.name))
        elif kind in ("timestamp", "timestamp_ntz"):
            out.append(secs(c).alias(f.name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(c.cast("bigint").alias(f.name))
        elif kind == "date":
            out.append(F.date_format(c, "yyyyMMdd").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)
