"""Scalar rules shared by the operators, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` within ``low``..``high``; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def rounded(x: Column, places: int) -> Column:
    """``x`` to ``places``, halves away from zero, decided on the scaled double as SQL engines do.

    ``F.round`` decides on the shortest decimals of ``x``, so that 0.17625 less its last bit goes down.
    """
    scale = 10.0**places
    return F.round(x * scale) / scale


def binned(x: Column, edges: Sequence[float | Column], labels: Sequence[str]) -> Column:
    """The label of the half-open bin of ``x``: label k where x lies below edge k first, else the last."""
    out = None
    for edge, label in zip(edges, labels):
        out = F.when(x < edge, label) if out is None else out.when(x < edge, label)
    return F.when(x.isNotNull(), F.lit(labels[-1]) if out is None else out.otherwise(labels[-1]))


def margin(x: Column, edges: Sequence[float | Column], scale: float) -> Column:
    """Distance to the nearest edge in units of ``scale``, within 0..1; 1 without edges."""
    gaps = [F.abs(x - edge) for edge in edges]
    if not gaps:
        return F.lit(1.0)
    return clamp((F.least(*gaps) if len(gaps) > 1 else gaps[0]) / scale, 0.0, 1.0)


def ramp(x: Column, low: float, high: float) -> Column:
    """0 up to ``low``, 1 from ``high`` on, linear between; 0 where they are equal."""
    return F.lit(0.0) if high == low else clamp((x - low) / (high - low), 0.0, 1.0)


#: Weights of the impairments in the degradation score; others weigh 0.5.
IMPAIRMENTS = {"clipping": 1.0, "dropouts": 0.9, "level": 0.6, "bandwidth": 0.55}
OTHER_IMPAIRMENT = 0.5


def noisy_or(parts: dict[str, Column], weights: dict[str, float] = IMPAIRMENTS) -> Column:
    """1 - product of (1 - weight * score) over the parts; scores are clamped to 0..1, null counts as 0."""
    keep = F.lit(1.0)
    for name, score in parts.items():
        keep = keep * (1.0 - weights.get(name, OTHER_IMPAIRMENT) * clamp(F.coalesce(score, F.lit(0.0)), 0.0, 1.0))
    return 1.0 - keep


def level_db(rms: Column, floor: float = 1e-9) -> Column:
    return 20.0 * F.log10(F.greatest(rms, F.lit(floor)))


def snr_severity(snr: Column) -> Column:
    """Severity of noise from a signal-to-noise ratio; edges belong to the milder side."""
    return F.when(snr >= 40, "none").when(snr >= 25, "low").when(snr >= 12, "medium").when(snr.isNotNull(), "high")


def real_time_factor(elapsed: Column, audio: Column) -> Column:
    """Processing seconds by audio seconds, null without audio."""
    return F.try_divide(elapsed, F.nullif(audio, F.lit(0.0)))


def progress_percent(completed: Column, stage: Column, stages: Column, total: Column) -> Column:
    """Whole percent of a job: files done, and of the file in work the share of its stages, below 1."""
    part = F.least(F.coalesce(F.try_divide(stage, F.nullif(stages, F.lit(0))), F.lit(0.0)), F.lit(0.99))
    done = completed + F.when(completed < total, part).otherwise(0.0)
    return F.coalesce(F.floor(F.least(F.lit(100.0), F.try_divide(100.0 * done, F.nullif(total, F.lit(0))))), F.lit(0)).cast("int")


def age_bucket(seconds: Column) -> Column:
    """How long ago, in words: just now, minutes, hours or days."""
    whole = lambda unit: F.floor(seconds / unit).cast("long").cast("string")
    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, F.concat(whole(60), F.lit(" min ago")))
        .when(seconds < 86400, F.concat(whole(3600), F.lit(" h ago")))
        .when(seconds.isNotNull(), F.concat(whole(86400), F.lit(" d ago")))
    )


def job_title(sources: Column, total: Column) -> Column:
    """What a batch is called: by its source names, or by the number of recordings where it has none."""
    n, name = F.size(sources), F.try_element_at(sources, F.lit(1))
    return (
        F.when(n == 1, name)
        .when(n == 2, F.concat(name, F.lit(" and "), F.try_element_at(sources, F.lit(2))))
        .when(n > 2, F.concat(name, F.lit(" and "), (n - 1).cast("string"), F.lit(" others")))
        .otherwise(F.concat(total.cast("string"), F.when(total == 1, " recording").otherwise(" recordings")))
    )
