"""Decision thresholds and their YAML form."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

import yaml


@dataclass(frozen=True)
class Thresholds:
    """The defaults in force where no configuration is given."""

    noise_present_db: float = -42.0
    noise_low_db: float = -42.0  # kept in the configuration; no rule reads it
    noise_medium_db: float = -36.0
    noise_high_db: float = -22.0
    noise_type_min_score: float = 0.15
    quality_slight: float = 0.25
    quality_severe: float = 0.55
    long_silence_s: float = 10.0
    overlap_ratio_min: float = 0.02
    arousal_low: float = 0.20
    arousal_high: float = 0.55
    valence_neutral_band: float = 0.20
    valence_upset: float = -0.45
    distress_arousal: float = 0.80
    distress_valence: float = -0.60
    conf_base: float = 0.85
    conf_missing_penalty: float = 0.09
    conf_role_weight: float = 0.20
    conf_floor: float = 0.10


#: Thresholds tuned for calls; what queries use.
TUNED = replace(Thresholds(), noise_present_db=-53.0, noise_low_db=-53.0, noise_medium_db=-50.0, noise_high_db=-24.0, long_silence_s=12.0)

# Sections and keys of the YAML form, by field.
YAML_KEYS = {
    "noise_present_db": ("noise", "present_db"),
    "noise_low_db": ("noise", "low_db"),
    "noise_medium_db": ("noise", "medium_db"),
    "noise_high_db": ("noise", "high_db"),
    "noise_type_min_score": ("noise", "type_min_score"),
    "quality_slight": ("quality", "slight"),
    "quality_severe": ("quality", "severe"),
    "long_silence_s": ("silence", "long_silence_s"),
    "overlap_ratio_min": ("overlap", "ratio_min"),
    "arousal_low": ("emotion", "arousal_low"),
    "arousal_high": ("emotion", "arousal_high"),
    "valence_neutral_band": ("emotion", "valence_neutral_band"),
    "valence_upset": ("emotion", "valence_upset"),
    "distress_arousal": ("emotion", "distress_arousal"),
    "distress_valence": ("emotion", "distress_valence"),
    "conf_base": ("confidence", "base"),
    "conf_missing_penalty": ("confidence", "missing_penalty"),
    "conf_role_weight": ("confidence", "role_weight"),
    "conf_floor": ("confidence", "floor"),
}


def _number(value: object) -> float | None:
    try:
        return None if value is None else float(value)
    except (TypeError, ValueError):
        return None


def from_mapping(sections: object) -> Thresholds:
    """Thresholds from parsed YAML; what is missing or no number keeps its default."""
    sections = sections if isinstance(sections, dict) else {}
    found = {}
    for name, (section, key) in YAML_KEYS.items():
        inner = sections.get(section)
        value = _number(inner.get(key) if isinstance(inner, dict) else None)
        if value is not None:
            found[name] = value
    return Thresholds(**found)


def read_thresholds(path: str | Path | None) -> Thresholds:
    """Thresholds of a YAML file; a file that is absent or no YAML gives the defaults."""
    if path is None or not Path(path).is_file():
        return Thresholds()
    try:
        return from_mapping(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
    except yaml.YAMLError:
        return Thresholds()


def to_mapping(thresholds: Thresholds) -> dict[str, dict[str, float]]:
    sections: dict[str, dict[str, float]] = {}
    for name, value in asdict(thresholds).items():
        section, key = YAML_KEYS[name]
        sections.setdefault(section, {})[key] = value
    return sections


def write_thresholds(path: str | Path, thresholds: Thresholds) -> None:
    """Merge thresholds into a YAML file; its other keys stay."""
    path = Path(path)
    held = (yaml.safe_load(path.read_text(encoding="utf-8")) if path.is_file() else None) or {}
    for section, values in to_mapping(thresholds).items():
        held.setdefault(section, {}).update(values)
    path.write_text(yaml.safe_dump(held, sort_keys=False), encoding="utf-8")


NAMES = tuple(f.name for f in fields(Thresholds))
