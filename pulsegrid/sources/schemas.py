"""Fixed schemas of the raw streams, as read from CSV."""

from pyspark.sql import types as T


def _table(**cols) -> T.StructType:
    kinds = {"d": T.DoubleType(), "i": T.IntegerType(), "s": T.StringType(), "t": T.TimestampNTZType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in cols.items()])


WRIST_HR = _table(ts="t", heart_rate="d")
WRIST_STEPS = _table(ts="t", step_count="d")
WRIST_SUMMARY = T.StructType(
    [T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(f"Sleep{i}{e}Timestamp", T.TimestampNTZType()) for i in (1, 2, 3) for e in ("Begin", "End")]
    + [T.StructField(c, T.DoubleType()) for c in (
        "Sleep1Efficiency", "Sleep2Efficiency", "RestingHeartRate", "NumberSteps",
        "fat_burn_minutes", "cardio_minutes", "peak_minutes", "out_of_range_minutes")]
)
GARMENT = T.StructType(
    [T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in ("BreathingDepth", "BreathingRate", "Cadence", "HeartRate", "Intensity", "Steps")]
    + [T.StructField(f"RR{i}", T.IntegerType()) for i in range(4)]
)
PROXIMITY = _table(ts="t", receiver="s", rssi="i")
PHONE = _table(ts="t", seconds_on_phone="i")
AUDIO = _table(ts="t", f0="d", intensity="d", band_low="d", band_high="d")
#: Names under which exports carry a column; the schema's own name always counts.
ALIASES = {
    "ts": ("Timestamp", "timestamp", "time"), "heart_rate": ("HeartRatePPG",), "step_count": ("StepCount",), "receiver": ("receiverDirectory",),
    "seconds_on_phone": ("SecondsOnPhone",), "f0": ("F0_sma",), "fat_burn_minutes": ("Fat Burn_minutes",), "cardio_minutes": ("Cardio_minutes",),
    "peak_minutes": ("Peak_minutes",), "out_of_range_minutes": ("Out of Range_minutes",),
}
SURVEY = _table(uid="s", timestamp="s", location_mgt="d")
