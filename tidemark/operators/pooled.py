"""One linear model of all series for each training window: mergeable Gram sums, solved once a window and shipped to the cut-offs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import saved

FEATURES = ["momentum_1", "momentum_7", "over_mean_30"]
WEIGHTS = ["intercept", *FEATURES]
#: Weight that is added to the diagonal for each row, rows that a window needs, bytes of fitted state up to which it is broadcast.
RIDGE, LEAST, BROADCAST_BYTES = 1e-6, 200, 8 << 20


def samples(df: DataFrame, column: str, key: list[str], ahead: int, on: str = "date") -> DataFrame:
    """key, date, label_date, the features of the past and `label`, the return over the next `ahead` rows; rows without either are left out."""
    w = Window.partitionBy(*key).orderBy(on)
    x = F.col(column)
    past = {"momentum_1": x / F.lag(column, 1).over(w) - 1, "momentum_7": x / F.lag(column, 7).over(w) - 1, "over_mean_30": F.log(x / F.avg(column).over(w.rowsBetween(-29, 0)))}
    later = {"label": F.lead(column, ahead).over(w) / x - 1, "label_date": F.lead(on, ahead).over(w), "__i": F.row_number().over(w)}
    out = df.select(*key, on, column).withColumns(past | later)
    return out.where("__i >= 30 AND label IS NOT NULL").select(*key, on, "label_date", *FEATURES, "label")


def period(on: str, months: int) -> Column:
    """The number of the calendar period of so many months that a date lies in."""
    return F.floor((F.year(on) * 12 + F.month(on) - 1) / months).cast("long")


def first_day(number: str, months: int) -> Column:
    return F.expr(f"make_date(int({number} * {months} div 12), int({number} * {months} % 12 + 1), 1)")


def grams(own: DataFrame, months: int, known: str, on: str = "date") -> DataFrame:
    """For each training window n_rows and the sums of products of features and label over all rows whose label was known before it.

    Sums of a period are made where its rows lie and merge by addition; a window's sums are those of the periods before, as
    a running sum over periods (one row each). So n windows cost one pass, not n.
    """
    x = {"0": F.lit(1.0), **{str(k + 1): F.col(c) for k, c in enumerate(FEATURES)}, "y": F.col("label")}
    pairs = [(a, b) for i, a in enumerate(x) for b in list(x)[i:] if a != "y"]
    per = own.groupBy(period(known, months).alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), *(F.sum(x[a] * x[b]).alias(f"g{a}{b}") for a, b in pairs))
    names = [f"g{a}{b}" for a, b in pairs]
    asked = own.agg(F.min(period(on, months)).alias("a"), F.max(period(on, months)).alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("w"), F.lit(True).alias("asked"))
    both = asked.join(per, "w", "full_outer")
    before = Window.orderBy("w").rowsBetween(Window.unboundedPreceding, -1)  # a row for each period of the calendar
    sums = both.withColumns({c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ["n_rows", *names]}).where("asked")
    return sums.select("w", first_day("w", months).alias("window_start"), "n_rows", *names)


def fitted(sums: DataFrame, least: int = LEAST, ridge: float = RIDGE) -> DataFrame:
    """w, window_start, n_rows, status (fitted, no data, too few rows, singular) and the weights, null unless fitted."""
    n = len(WEIGHTS)
    schema = f"w long, window_start date, n_rows long, status string, {', '.join(f'{c} double' for c in WEIGHTS)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                status, weights = "fitted", [None] * n
                if r["n_rows"] < least:
                    status = "too few rows" if r["n_rows"] else "no data"
                else:
                    g = np.array([[r[f"g{min(i, k)}{max(i, k)}"] for k in range(n)] for i in range(n)])
                    g[range(1, n), range(1, n)] += ridge * r["n_rows"]
                    try:
                        weights = np.linalg.solve(g, [r[f"g{i}y"] for i in range(n)]).tolist()
                    except np.linalg.LinAlgError:
                        status = "singular"
                out.append((r["w"], r["window_start"], r["n_rows"], status, *weights))
            columns = list(zip(*out, strict=True)) if out else [[]] * (4 + n)
            kinds = [pa.int64(), pa.date32(), pa.int64(), pa.string(), *[pa.float64()] * n]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["w", "window_start", "n_rows", "status", *WEIGHTS])

    return sums.mapInArrow(run, schema)


def shipped(state: DataFrame, row_bytes: int = 128) -> DataFrame:
    """The state marked for broadcast if its rows are within BROADCAST_BYTES; else as it is, to be joined by shuffle."""
    return F.broadcast(state) if state.count() * row_bytes <= BROADCAST_BYTES else state


def walk_forward(own: DataFrame, key: list[str], months: int, on: str = "date") -> DataFrame:
    """Each cut-off with the return that the model of its training window predicts and the one that came.

    The windows' models are a table, fitted once; cut-offs of all windows are scored in one pass. Windows that could not be fitted
    keep their rows, with the reason as status and no prediction.
    """
    state = saved(fitted(grams(own, months, "label_date", on)), "fitted-windows")
    weights = state.select("w", "window_start", "status", *(F.col(c).alias(f"weight_{c}") for c in WEIGHTS))
    rows = own.withColumn("w", period(on, months)).join(shipped(weights), "w")
    predicted = sum((F.col(c) * F.col(f"weight_{c}") for c in FEATURES), F.col("weight_intercept"))
    return rows.select(*key, F.col(on).alias("data_cutoff_date"), "window_start", "status", predicted.alias("predicted_return"), F.col("label").alias("actual_return"))


def score_windows(scored: DataFrame, by: list[str]) -> DataFrame:
    """Errors and share of right directions of the cut-offs of each window."""
    e = F.col("predicted_return") - F.col("actual_return")
    right = (F.signum("predicted_return") == F.signum("actual_return")).cast("double")
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(F.avg(right) * 100, 4).alias("directional_accuracy"))
