"""The analysis as an ordered list of stages over one DataFrame of recordings."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from recordlens.config import TUNED, Thresholds
from recordlens.operators.derive import derive, fill_stubs, unevidenced
from recordlens.schema import CORE, LATENTS

log = logging.getLogger(__name__)


class Stage(Protocol):
    """Adds estimates to recordings(name, ...). Errors of single rows go to ``error``, not to exceptions."""

    name: str

    def __call__(self, recordings: DataFrame) -> DataFrame: ...


#: The order in which stages depend on one another.
ORDER = ("vad", "quality", "noise", "overlap", "roles", "emotion", "stub")


class Estimates:
    """A stage that joins a table of estimates(name, columns): the outputs of an outside model."""

    def __init__(self, name: str, table: DataFrame, *columns: str) -> None:
        self.name, self.table, self.columns = name, table, columns

    def __call__(self, recordings: DataFrame) -> DataFrame:
        kept = [c for c in recordings.columns if c not in self.columns]
        return recordings.select(*kept).join(self.table.select("name", *self.columns), "name", "left")


class Stub:
    name = "stub"

    def __call__(self, recordings: DataFrame) -> DataFrame:
        return fill_stubs(recordings)


def requested(spec: str | None, known: Sequence[str] = ORDER) -> list[str]:
    """Names of the stages that a text asks for: all, none but stand-ins, or a list; unknown names are left out."""
    text = (spec or "").strip().lower()
    if text in ("", "all", "full"):
        return list(known)
    if text in ("none", "stub"):
        return ["stub"]
    wanted = {part.strip() for part in text.split(",")}
    return [name for name in known if name in wanted]


def build(spec: str | None, makers: dict[str, Callable[[], Stage]]) -> list[Stage]:
    """The stages asked for, in order; one that can't be built is left out with a warning."""
    stages: list[Stage] = []
    for name in requested(spec):
        if name not in makers:
            continue
        try:
            stages.append(makers[name]())
        except Exception as problem:  # noqa: BLE001  a stage that is missing leaves its estimates null
            log.warning("stage %s left out: %s", name, problem)
    return stages


def analyse(recordings: DataFrame, stages: Sequence[Stage], thresholds: Thresholds = TUNED, on_stage: Callable[[str], None] | None = None, observed: dict[str, Observation] | None = None) -> DataFrame:
    """Recordings with estimates and output fields.

    ``on_stage`` is told each stage as the plan is built. ``observed`` gets for each stage an observation
    that is filled while the job runs: how many recordings passed, and how many have each of its estimates.

    Rows with an ``error`` are failed and keep the default fields' nulls; the others are ok. Rows
    whose core estimates are missing get a warning.
    """
    df = recordings
    for field in LATENTS:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    for stage in stages:
        if on_stage:
            on_stage(stage.name)
        df = stage(df)
        if observed is not None and (columns := getattr(stage, "columns", ())):
            observed[stage.name] = Observation()
            df = df.observe(observed[stage.name], F.count("*").alias("recordings"), *[F.count(c).alias(c) for c in columns])
    if "error" not in df.columns:
        df = df.withColumn("error", F.lit(None).cast("string"))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in CORE]))
    warned = F.when(F.size(missing) > 0, F.array(F.concat(F.lit("not estimated: "), F.array_join(missing, ", ")))).otherwise(F.array().cast("array<string>"))
    done = derive(df.withColumn("warnings", warned), thresholds)
    return done.withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise("ok"))


__all__ = ["ORDER", "Estimates", "Stage", "Stub", "analyse", "build", "requested", "unevidenced"]
