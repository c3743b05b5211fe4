"""Vibration sample features: magnitude, trailing mean, z-score and flag.

S2/S3 -> F1 -> W1 (halo rolling mean over the sample order) -> F2/F3.
The mean and sample deviation are one aggregate, broadcast back as one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import rules as R
from ..operators import order as O
from ..operators import stats as S
from ..sources.readers import normalise_vibration

SAMPLE_ORDER = ["event_time", "sample_id"]


def vibration_features(raw: DataFrame, order: list = SAMPLE_ORDER, by: str | None = None,
                       window: int = C.ROLLING_WINDOW, z_limit: float = C.Z_LIMIT) -> DataFrame:
    """Add accel_magnitude, rolling_mag, vibr_zscore, vibr_anomaly.

    ``by=None`` treats the samples as one series in ``order`` (one recording);
    pass ``by='asset_id'`` to restart the trailing window per asset.
    """
    df = normalise_vibration(raw)
    df = df.withColumn("accel_magnitude", R.magnitude(F.col("x"), F.col("y"), F.col("z")))
    df = O.rolling(df, "accel_magnitude", "rolling_mag", order, by=by, w=window)
    st = S.values(S.mean_sd_stats(df, "accel_magnitude", sample=True))
    z = R.zscore(F.col("accel_magnitude"), F.lit(st["accel_magnitude_mean"]), F.lit(st["accel_magnitude_sd"]))
    return (df.withColumn("vibr_zscore", z)
            .withColumn("vibr_anomaly", R.z_flag(F.col("vibr_zscore"), z_limit)))
