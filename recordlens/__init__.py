"""Recording-analytics operators as Spark DataFrame transformations."""

from recordlens.config import TUNED, Thresholds, read_thresholds, write_thresholds
from recordlens.operators.derive import derive
from recordlens.plans.pipeline import Estimates, Stage, Stub, analyse, build
from recordlens.schema import ANALYSIS, FIELDS, LATENTS, RESULT

__all__ = [
    "ANALYSIS", "Estimates", "FIELDS", "LATENTS", "RESULT", "Stage", "Stub", "TUNED", "Thresholds",
    "analyse", "build", "derive", "read_thresholds", "write_thresholds",
]
