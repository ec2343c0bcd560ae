"""Thresholds from labelled recordings: one scan, a descent for each group of thresholds, and the YAML that follows."""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.config import Thresholds
from recordlens.operators.score import unpivot
from recordlens.operators.tune import Search, descend
from recordlens.schema import QUALITIES, SEVERITIES

# The thresholds that are sought together, and where.
SEARCHES = (
    Search(
        "background_noise_severity", "noise_level_db", ("noise_present_db", "noise_medium_db", "noise_high_db"),
        (tuple(range(-70, -15, 2)), tuple(range(-60, -10, 2)), tuple(range(-40, -5, 2))),
        (("background_noise_present", ("false", "true", "true", "true")), ("background_noise_severity", SEVERITIES)),
    ),
    Search(
        "audio_quality", "degradation_score", ("quality_slight", "quality_severe"),
        (tuple(k / 40 for k in range(2, 26)), tuple(k / 40 for k in range(10, 38))), (("audio_quality", QUALITIES),),
    ),
    Search("long_silence_present", "max_silence_s", ("long_silence_s",), (tuple(range(4, 26)),), (("long_silence_present", ("false", "true")),)),
)
PASSES = 2


def labelled_estimates(estimates: DataFrame, labels: DataFrame, groups: DataFrame) -> DataFrame:
    """``(grp, field, truth, value)`` of estimates(name, ...) that have labels(name, truth); groups(name, grp), by default the name.

    A label may carry any of the fields; those that are missing have no row.
    """
    fields = {field: search.estimate for search in SEARCHES for field, _ in search.fields}
    truth = unpivot(labels, "name", {field: F.col(f"truth.{field}").cast("string") for field in fields}).withColumnRenamed("value", "truth").where("truth IS NOT NULL")
    value = unpivot(estimates, "name", {field: F.col(estimate) for field, estimate in fields.items()})
    known = truth.join(value, ["name", "field"]).join(groups.select("name", "grp"), "name", "left")
    return known.select(F.coalesce("grp", "name").alias("grp"), "field", "truth", "value")


def tuned(estimates: DataFrame, labels: DataFrame, groups: DataFrame, k: int = 4, start: Thresholds | None = None) -> tuple[Thresholds, dict[str, tuple[float, float]]]:
    """Thresholds after two passes of coordinate descent by ``k`` folds of groups, and each search's score before and after."""
    begin = start or Thresholds()
    found, report = descend(labelled_estimates(estimates, labels, groups), SEARCHES, asdict(begin), k, PASSES)
    return replace(begin, **{p: found[p] for search in SEARCHES for p in search.params}), report
