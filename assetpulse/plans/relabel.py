"""Rule-based relabelling of a readings table.

F12 (quantile fault cascade) -> J2 (maintenance action) -> F13 (RUL from
normalised probability, vibration and age) -> F14 (probability blend).
Quantiles and ranges come from the same passes over the table and enter as
literals; noise is a hash of the reading id, so reruns and retries agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import rules as R
from ..operators import lookups as L
from ..operators import stats as S
from ..sources.fixtures import cascade_spec, with_fault_labels


def relabel(df: DataFrame, noise: bool = False, seed: int = 42,
            quantile_method: str = "exact") -> DataFrame:
    """Replace fault_code, maintenance_action, rul_days and failure_prob.

    The blend uses the *original* failure probability; the RUL uses the
    original probability, vibration and age, normalised over the table.
    """
    base = df.drop(*[c for c in ("fault_code", "maintenance_action") if c in df.columns])
    ranges = ["failure_prob", "vibration", "age_days"]
    stats = S.statistics(base, cascade_spec(), ranges, quantile_method)
    mm = {f"{c}_{k}": stats[f"{c}_{k}"] for c in ranges for k in ("min", "max")}
    x = S.attach_values(with_fault_labels(base, stats=stats), mm)
    pn = R.minmax_norm(F.col("failure_prob"), F.col("failure_prob_min"), F.col("failure_prob_max"))
    vn = R.minmax_norm(F.col("vibration"), F.col("vibration_min"), F.col("vibration_max"))
    an = R.minmax_norm(F.col("age_days"), F.col("age_days_min"), F.col("age_days_max"))
    rid = F.col("reading_id")
    rul_noise = R.gaussian_noise(rid, seed, C.RUL_RECOMPUTE["noise_sd"] if noise else 0.0)
    p_noise = R.gaussian_noise(rid, seed + 1, C.PROB_BLEND["noise_sd"] if noise else 0.0)
    x = L.add_severity(x)
    out = (x.withColumn("rul_days_new", R.recompute_rul(pn, vn, an, rul_noise))
            .withColumn("failure_prob_new", R.blend_probability(F.col("severity"), F.col("failure_prob"), p_noise)))
    drop = list(mm) + ["severity", "rul_days", "failure_prob"]
    return (out.drop(*drop)
            .withColumnRenamed("rul_days_new", "rul_days")
            .withColumnRenamed("failure_prob_new", "failure_prob"))
