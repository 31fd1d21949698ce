"""Questionnaire scoring and scaling (FN-9, FN-10, SRC-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .time import col

# Smallest and largest reachable score per questionnaire.
SCORE_BOUNDS = {
    "itp_igtb": (1, 5), "irb_igtb": (7, 49), "iod_id_igtb": (7, 49), "iod_od_igtb": (12, 84), "ocb_igtb": (20, 100),
    "shipley_abs_igtb": (0, 25), "shipley_voc_igtb": (0, 40),
    "neu_igtb": (1, 5), "con_igtb": (1, 5), "ext_igtb": (1, 5), "agr_igtb": (1, 5), "ope_igtb": (1, 5),
    "pos_af_igtb": (10, 50), "neg_af_igtb": (10, 50), "stai_igtb": (20, 80),
    "audit_igtb": (0, 40), "gats_status_igtb": (1, 3), "psqi_igtb": (0, 21),
}


def clean_numeric(c, max_chars: int | None = None) -> Column:
    """Number from a survey string; blanks, letters and overlong answers are null (SRC-13)."""
    text = F.trim(col(c).cast("string"))
    value = F.when(text.rlike(r"^[-+]?[0-9]*\.?[0-9]+$"), text).try_cast("double")
    return F.when(F.length(text) <= max_chars, value) if max_chars is not None else value


def _ladder(c: Column, upper: list[float], inclusive: bool = True) -> Column:
    """0, 1, 2 ... by the first upper bound the value stays within; null counts as the last."""
    out = None
    for score, bound in enumerate(upper):
        hit = (c <= bound) if inclusive else (c < bound)
        out = F.when(hit, score) if out is None else out.when(hit, score)
    return out.otherwise(len(upper))


def _pairs_to_score(total: Column) -> Column:
    """Sum of two 0..3 items to a 0..3 score; other sums have none."""
    table = {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 3}
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    whole = F.when((total >= 0) & (total <= 6) & (total == F.floor(total)), total.cast("int"))
    return F.element_at(lookup, whole)


def _clock(c: Column) -> Column:
    """``1130`` style answer to hours."""
    hours, minutes = c.substr(F.lit(1), F.length(c) - 2), F.substring(c, -2, 2)
    return hours.try_cast("double") + minutes.try_cast("double") / 60


def score_sleep_quality(df: DataFrame, prefix: str = "psqi", legacy: bool = False) -> DataFrame:
    """The seven sleep-quality components (FN-9).

    ``legacy`` keeps the unreachable third efficiency band (65 where the
    published scoring has 0.65), so such answers score 3.
    """
    def item(name: str) -> Column:
        return F.col(prefix + name)

    def number(name: str) -> Column:
        return item(name).try_cast("double")

    latency = _ladder(number("2"), [15, 30, 60]) + number("5a")
    slept = number("4")
    duration = F.when(slept > 7, 0).when(slept > 6, 1).when(slept > 5, 2).otherwise(3)
    bed, rise = _clock(item("1")), _clock(item("3"))
    in_bed = F.when(number("1ampm") == number("3ampm"), rise - bed).otherwise(12 - bed + rise)
    ratio = F.try_divide(slept, in_bed)
    third = 65.0 if legacy else 0.65
    efficiency = (
        F.when(ratio > 0.85, 0).when((ratio > 0.75) & (ratio <= 0.85), 1).when((ratio > third) & (ratio <= 0.75), 2).otherwise(3)
    )
    main = number("5b")
    for part in "cdefghi":
        main = main + number("5" + part)
    # a missing extra answer counts as nothing, and so does a missing sum
    disturbance = F.coalesce(main, F.lit(0.0)) + F.coalesce(number("5jb"), F.lit(0.0))
    disturbed = F.when(disturbance < 1, 0).when(disturbance <= 9, 1).when(
        (disturbance >= 10) & (disturbance <= 18), 2).otherwise(3)
    return df.withColumns({
        "subject_quality": number("6").cast("int"),
        "sleep_latency": _pairs_to_score(latency),
        "sleep_duration": duration,
        "sleep_efficiency": efficiency,
        "sleep_disturbance": disturbed,
        "sleep_medication": number("7").cast("int"),
        "day_dysfunction": _pairs_to_score(number("8") + number("9") - 1),
    })


def scale_score(c, low: float, high: float) -> Column:
    return (col(c) - low) / F.lit(float(high - low))


def scale_scores(df: DataFrame, bounds: dict[str, tuple[float, float] | None]) -> DataFrame:
    """Scores to [0, 1] by published bounds, or by the data's own (``None``) (FN-10)."""
    own = [c for c, b in bounds.items() if b is None]
    out = df.withColumns({c: scale_score(c, *b) for c, b in bounds.items() if b is not None})
    if own:
        limits = df.agg(*[f(c).alias(f"_{n}_{c}") for c in own for n, f in (("lo", F.min), ("hi", F.max))])
        # one row of two numbers per score
        out = out.withColumn("_one", F.lit(1)).join(F.broadcast(limits.withColumn("_one", F.lit(1))), "_one").drop("_one")
        out = out.withColumns(
            {c: F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) for c in own}
        ).drop(*[f"_{n}_{c}" for c in own for n in ("lo", "hi")])
    return out
