"""Queries of the time-series engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import carried, completions, forecasts, jobs, reshape, series
from .bindings import Frames
from .dates import DATES

MODULES = (series, forecasts, jobs, reshape, completions, carried)


def _over(fn):
    return lambda spark, sf_dir: fn(Frames(spark, sf_dir))


def _with_text_dates(name: str, fn):
    dated = DATES.get(name, "").split()
    return lambda spark, sf_dir: fn(Frames(spark, sf_dir)).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in dated})


def raw() -> dict:
    return {name: _over(fn) for m in MODULES for name, (fn, _) in m.CASES.items()}


def queries() -> dict:
    return {name: _with_text_dates(name, fn) for m in MODULES for name, (fn, _) in m.CASES.items()}


def oracle_sql() -> dict:
    out = {}
    for m in MODULES:
        for name, (_, sql) in m.CASES.items():
            if sql:
                dated = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in DATES.get(name, "").split())
                out[name] = f"SELECT * REPLACE ({dated}) FROM ({sql})" if dated else sql
    return out
