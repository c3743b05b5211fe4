"""Table-level statistics applied back to each row.

Statistics are computed by one global aggregate (partial per partition, one
tiny final merge) into a one-row table, whose few numbers enter later
expressions as literals. No unpartitioned window.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import selection


def one_row_stats(df: DataFrame, aggs: dict) -> DataFrame:
    """``aggs``: output name -> aggregate Column. Returns a one-row DataFrame."""
    return df.agg(*[a.alias(k) for k, a in aggs.items()])


def values(stats: DataFrame) -> dict:
    """Compute a one-row statistics table once; its few numbers become
    literals in later expressions (constant-folded into codegen, and the
    statistics plan is not re-run by every later action)."""
    row = stats.first()
    return row.asDict() if row is not None else {}


def attach_values(df: DataFrame, vals: dict) -> DataFrame:
    """Add each statistic as a literal column."""
    return df.withColumns({k: F.lit(v).cast("double") for k, v in vals.items()})


def _qname(col: str, q: float) -> str:
    return f"{col}_q{int(round(q * 1000)):03d}"


def quantiles(df: DataFrame, spec: dict[str, list[float]], method: str = "exact",
              accuracy: int = 100000) -> DataFrame:
    """A10: one-row table of linear-interpolated quantiles ``<col>_q<permille>``.

    method='exact'  ranks found by narrowing (``operators.selection``): a few passes
                    over the columns, one path at every size, no sort and no shuffle of rows.
                    'sort' and 'auto' are other names of the same path.
    method='approx' ``percentile_approx`` (rank error 1/accuracy), one pass.

    Null and NaN values are skipped, as in pandas; a column without values gives null.
    """
    if method == "approx":
        return df.agg(*[F.percentile_approx(F.col(c), F.lit(q), F.lit(accuracy)).cast("double").alias(_qname(c, q))
                        for c, qs in spec.items() for q in qs])
    if method not in ("exact", "sort", "auto"):
        raise ValueError(f"unknown quantile method {method}")
    found = selection.table_statistics(df, spec)[0]
    names = [_qname(c, q) for c, q in found]
    return df.sparkSession.createDataFrame([tuple(found.values())], ", ".join(f"`{x}` double" for x in names))


def quantile_values(df: DataFrame, spec: dict[str, list[float]], method: str = "exact") -> dict[str, float | None]:
    """The quantiles as numbers, for expressions that hold them as literals."""
    if method in ("exact", "sort", "auto"):
        return {_qname(c, q): v for (c, q), v in selection.table_statistics(df, spec)[0].items()}
    return values(quantiles(df, spec, method=method))


def statistics(df: DataFrame, spec: dict[str, list[float]], ranges: list[str], method: str = "exact") -> dict[str, float | None]:
    """Quantiles (as ``quantile_values``) and ``<c>_min`` / ``<c>_max`` of ``ranges``, in the same passes."""
    extra = {f"{c}_{k}": f(c) for c in ranges for k, f in (("min", F.min), ("max", F.max))}
    if method in ("exact", "sort", "auto"):
        found, more = selection.table_statistics(df, spec, extra)
        return {_qname(c, q): v for (c, q), v in found.items()} | more
    return quantile_values(df, spec, method) | values(one_row_stats(df, extra))


def quantile_lookup(stats, spec: dict[str, list[float]]) -> dict:
    """(column, q) -> Column: a literal when ``stats`` is a dict of computed
    values, else the column of the (lazy) statistics table."""
    if isinstance(stats, dict):
        return {(c, q): F.lit(stats[_qname(c, q)]).cast("double") for c, qs in spec.items() for q in qs}
    return {(c, q): F.col(_qname(c, q)) for c, qs in spec.items() for q in qs}


def minmax_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """F11 statistics: one row with ``<c>_min`` and ``<c>_max``."""
    aggs = {}
    for c in cols:
        aggs[f"{c}_min"] = F.min(c)
        aggs[f"{c}_max"] = F.max(c)
    return one_row_stats(df, aggs)


def mean_sd_stats(df: DataFrame, col: str, sample: bool = True) -> DataFrame:
    """F2 statistics: ``<c>_mean`` and ``<c>_sd`` (sample by default)."""
    sd = F.stddev_samp(col) if sample else F.stddev_pop(col)
    return one_row_stats(df, {f"{col}_mean": F.avg(col), f"{col}_sd": sd})


__all__ = ["one_row_stats", "values", "attach_values", "quantiles", "quantile_values", "statistics", "quantile_lookup",
           "minmax_stats", "mean_sd_stats"]
