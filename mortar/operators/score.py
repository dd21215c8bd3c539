"""Scoring (K1-K6): derive serving features, predict, clamp, classify, warn, reject.

A scored request row carries ``row_id, prediction, prediction_clamped, class,
warnings, rejected``. Everything is a Catalyst expression over the request batch, so the
same function serves batch and streaming DataFrames (K7).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mortar.functions import features as fx

# Strength classes (MPa, left-closed upper bounds) and slump classes (mm).
STRENGTH_CLASSES = [(20, "below_structural"), (30, "normal_M20_M25"), (45, "medium_M30_M40"),
                    (60, "high_M45_M55"), (None, "very_high_uhpc")]
WORKABILITY_CLASSES = [(25, "very_low"), (50, "low"), (100, "medium"), (175, "high"), (None, "very_high_flowing")]

# Training ranges checked by each app (inclusive bounds, raw inputs).
STRENGTH_RANGES = {
    "flyash": (0, 661), "ggbfs": (0, 500), "na2sio3": (0, 278), "naoh": (0, 232), "naoh_molarity": (0, 20),
    "water": (0, 122), "sp": (0, 24), "nca": (0, 1591), "rca": (0, 1225), "sand": (0, 875), "r_sand": (0, 525),
    "curing_temp_c": (0, 120), "curing_time_hr": (0, 48),
}
SLUMP_RANGES = {
    "flyash": (0, 500), "ggbfs": (0, 500), "na2sio3": (0, 195), "naoh": (0, 108), "naoh_molarity": (0, 16),
    "activator_binder_ratio": (0, 2.73), "water": (0, 144), "sp": (0, 7.5), "nca": (0, 1261), "rca": (0, 1260),
    "sand": (0, 799), "r_sand": (0, 737), "curing_time_hr": (0, 48),
}


@dataclass
class LinearModel:
    """A fitted Gram-family model: ``b0 + sum beta_i * feature_i`` (A7 artifact)."""

    features: list[str]
    b0: float
    beta: list[float]
    name: str = "model"
    feature_set: str = ""

    def predict(self) -> Column:
        expr = F.lit(float(self.b0))
        for f, b in zip(self.features, self.beta):
            expr = expr + F.lit(float(b)) * F.col(f)
        return expr

    def save(self, spark, path: str) -> None:
        """Persist as a one-row table on the shared file system."""
        row = [(self.name, self.feature_set, list(self.features), float(self.b0), [float(b) for b in self.beta])]
        spark.createDataFrame(row, "name string, feature_set string, features array<string>, b0 double, "
                                   "beta array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> "LinearModel":
        try:
            r = spark.read.parquet(path).first()
        except Exception as e:  # noqa: BLE001 - a missing champion is an error for the caller
            raise FileNotFoundError(f"champion model not found at {path}") from e
        return LinearModel(features=list(r["features"]), b0=r["b0"], beta=list(r["beta"]), name=r["name"],
                           feature_set=r["feature_set"])


def bucket(c: Column, classes) -> Column:
    expr = None
    for bound, label in classes:
        if bound is None:
            return expr.otherwise(F.lit(label)) if expr is not None else F.lit(label)
        expr = F.when(c < bound, F.lit(label)) if expr is None else expr.when(c < bound, F.lit(label))
    return expr


def range_warnings(ranges: dict) -> Column:
    """K6: ``array<string>`` of inputs outside [lo, hi] (missing inputs are skipped)."""
    items = []
    for name, (lo, hi) in ranges.items():
        v = F.col(name)
        msg = F.concat(F.lit(f"{name}="), v.cast("string"), F.lit(f" outside [{lo}, {hi}]"))
        items.append(F.when(v.isNotNull() & ((v < F.lit(lo)) | (v > F.lit(hi))), msg))
    return F.filter(F.array(*items).cast("array<string>"), lambda x: x.isNotNull())


def learned_ranges(train: DataFrame, inputs: list[str]) -> dict:
    """K6: ``{input: (least, greatest)}`` over train rows, one aggregate; inputs without a value are left out."""
    row = train.agg(*[f(F.col(c).cast("double")).alias(f"{k}_{c}") for c in inputs
                      for k, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in inputs if row[f"lo_{c}"] is not None}


# The raw inputs each app asks for.
STRENGTH_INPUTS = ["flyash", "ggbfs", "na2sio3", "naoh", "naoh_molarity", "water", "sp", "nca", "rca", "sand",
                   "r_sand", "curing_temp_c", "curing_time_hr"]
SLUMP_INPUTS = ["flyash", "ggbfs", "na2sio3", "naoh", "naoh_molarity", "activator_binder_ratio", "water", "sp",
                "nca", "rca", "sand", "r_sand", "curing_time_hr"]


def serve_frame(requests: DataFrame, kind: str = "strength") -> DataFrame:
    """Request rows with the app's 9 derived serving features added."""
    inputs = STRENGTH_INPUTS if kind == "strength" else SLUMP_INPUTS
    base = requests.select("row_id", *inputs)
    cols = fx.serve_columns(kind)
    return base.select("*", *[v.alias(k) for k, v in cols.items() if k not in inputs])


def score(requests: DataFrame, predict, kind: str = "strength") -> DataFrame:
    """K1-K6 over a request DataFrame of raw inputs (batch or streaming).

    ``predict`` is a Column over the serving features, or a callable taking the serving
    frame and returning it with a ``__pred`` column (MLlib models). Rows with total binder
    <= 0 are rejected and get no prediction.
    """
    ranges = STRENGTH_RANGES if kind == "strength" else SLUMP_RANGES
    base = serve_frame(requests, kind)
    if callable(predict) and not isinstance(predict, Column):
        base = predict(base)
        pcol = F.col("__pred")
    else:
        pcol = predict
    rejected = (F.col("flyash") + F.col("ggbfs")) <= 0
    pred = F.when(~rejected, pcol)
    clamped = F.when(~rejected, F.greatest(F.lit(0.0), pred))  # greatest() skips NULLs
    if kind == "slump":
        clamped = F.bround(clamped, 0)
        klass = bucket(clamped, WORKABILITY_CLASSES)
    else:
        klass = bucket(clamped, STRENGTH_CLASSES)
    return base.select(
        "row_id", pred.alias("prediction"), clamped.alias("prediction_clamped"),
        F.when(~rejected, klass).alias("class"), range_warnings(ranges).alias("warnings"),
        rejected.alias("rejected"))


def fixture_predict(kind: str) -> Column:
    """A fixed linear scorer (SQL-reproducible) used by the scoring oracles."""
    c = F.col
    if kind == "strength":
        return F.lit(20.0) + c("ggbfs") / F.lit(20.0) + c("curing_temp_c") / F.lit(10.0) - c("water") / F.lit(10.0) - F.lit(15.0)
    return c("total_binder") / F.lit(4.0) + c("water") - F.lit(80.0)
