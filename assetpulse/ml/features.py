"""Feature preparation.

Fitted statistics (label order, means, deviations, ranges) are small objects
returned by ``fit_*`` and re-applied by ``apply_*`` to new data; scoring
never recomputes them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_LABEL = "nan"  # missing categories are encoded as this label


def select_features(df: DataFrame, names: list[str]) -> list[str]:
    """The listed features that exist, in list order; error if none."""
    found = [c for c in names if c in df.columns]
    if not found:
        raise ValueError(f"none of the features {names} is present")
    return found


def project_features(df: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """P1 as a projection: key columns plus the available features."""
    return df.select(*(keep or []), *select_features(df, names))


def fill_features(df: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """Absent features added as 0.0, nulls -> 0.0, in trained order."""
    cols = []
    for c in names:
        if c in df.columns:
            cols.append(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c))
        else:
            cols.append(F.lit(0.0).alias(c))
    return df.select(*(keep or []), *cols)


def assemble(df: DataFrame, names: list[str], out: str = "features", invalid: str = "keep") -> DataFrame:
    """Columns -> dense vector column."""
    return VectorAssembler(inputCols=names, outputCol=out, handleInvalid=invalid).transform(df)


def label_encode(df: DataFrame, cols: list[str], suffix: str = "_enc"):
    """M1: each column -> integer code by ascending label order (0..k-1).

    One multi-column ``StringIndexer`` fit: a single pass over the table for
    all columns (label lists are bounded by the category counts). Returns
    (df, models) where ``models[c].labels`` is the code -> label list, so the
    label string travels with its code (no positional 'C1..Cn' naming).
    Missing values are encoded as the label 'nan'.
    """
    tmp = {c: f"_{c}_str" for c in cols}
    out = df.withColumns({tmp[c]: F.coalesce(F.col(c).cast("string"), F.lit(NULL_LABEL)) for c in cols})
    model = StringIndexer(inputCols=[tmp[c] for c in cols], outputCols=[f"{c}{suffix}_d" for c in cols],
                          stringOrderType="alphabetAsc", handleInvalid="keep").fit(out)
    out = model.transform(out)
    out = out.withColumns({f"{c}{suffix}": F.col(f"{c}{suffix}_d").cast("int") for c in cols}) \
        .drop(*tmp.values(), *[f"{c}{suffix}_d" for c in cols])
    labels = model.labelsArray
    return out, {c: _Labels(list(labels[i])) for i, c in enumerate(cols)}


class _Labels:
    """Fitted label list of one column (code i -> labels[i])."""

    def __init__(self, labels: list[str]):
        self.labels = labels


def encode_label(value: Column, labels: list[str]) -> Column:
    """M1 on new rows: value -> code in the fitted label list; an unseen value gets the code after the last."""
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), F.coalesce(value.cast("string"), F.lit(NULL_LABEL)))
    return F.when(at > 0, at - 1).otherwise(F.lit(len(labels))).cast("int")


def decode_label(code: Column, labels: list[str]) -> Column:
    """M2: code -> label from the fitted label list (an element_at on a literal array)."""
    arr = F.array(*[F.lit(x) for x in labels])
    return F.element_at(arr, code.cast("int") + 1)


@dataclass
class ScalerStats:
    kind: str
    cols: list[str]
    a: dict = field(default_factory=dict)  # mean or min
    b: dict = field(default_factory=dict)  # sd or max


def fit_standard(df: DataFrame, cols: list[str]) -> ScalerStats:
    """M3 fit: population mean and deviation per column (one aggregate pass)."""
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    return ScalerStats("standard", cols, {c: row[f"m_{i}"] for i, c in enumerate(cols)},
                       {c: row[f"s_{i}"] for i, c in enumerate(cols)})


def fit_minmax(df: DataFrame, cols: list[str]) -> ScalerStats:
    """M4 fit: min and max per column (one aggregate pass)."""
    row = df.agg(*[F.min(c).alias(f"lo_{i}") for i, c in enumerate(cols)],
                 *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(cols)]).first()
    return ScalerStats("minmax", cols, {c: row[f"lo_{i}"] for i, c in enumerate(cols)},
                       {c: row[f"hi_{i}"] for i, c in enumerate(cols)})


def apply_scaler(df: DataFrame, st: ScalerStats, suffix: str = "") -> DataFrame:
    """Apply fitted statistics as column expressions (a zero spread scales by 1)."""
    exprs = {}
    for c in st.cols:
        a, b = st.a[c], st.b[c]
        if st.kind == "standard":
            sd = b if (b is not None and b > 0) else 1.0
            exprs[c + suffix] = (F.col(c) - F.lit(a)) / F.lit(sd)
        else:
            rng = (b - a) if (a is not None and b is not None and b > a) else 1.0
            exprs[c + suffix] = (F.col(c) - F.lit(a)) / F.lit(rng)
    return df.withColumns(exprs)


def standard_scale_expr(df: DataFrame, cols: list[str], suffix: str = "_std") -> DataFrame:
    """M3 in one call: fit (one aggregate) and apply as literal expressions."""
    return apply_scaler(df, fit_standard(df, cols), suffix=suffix)


def minmax_scale_expr(df: DataFrame, cols: list[str], train_flag: str | None = None,
                      suffix: str = "_mm") -> DataFrame:
    """M4 in one call: min/max over the training rows (``train_flag`` true, or
    all rows), applied to every row; test values may leave [0, 1]."""
    src = df.where(F.col(train_flag)) if train_flag else df
    return apply_scaler(df, fit_minmax(src, cols), suffix=suffix)
