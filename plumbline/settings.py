"""Options from an environment, typed, and tariffs from JSON text."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.cost import PRICES
from plumbline.sources.schemas import PRICING

PREFIX = "PLUMBLINE_"


class SettingError(ValueError):
    """A setting that can't be read as its type."""


@dataclass(frozen=True)
class Options:
    """What a run may set; the defaults hold where a setting is absent or blank."""

    model: str = ""
    effort: str = ""
    currency: str = "RUB"
    parallel: int = 4
    attempts: int = 3
    dpi: float = 220.0
    longest_px: int = 4000
    text_items: int = 0
    trim: bool = True
    dimensions: bool = True
    overlay: bool = False
    clean: bool = False

    @staticmethod
    def read(env: Mapping[str, str] | None = None) -> Options:
        """From PLUMBLINE_<NAME> in the environment (or the mapping given)."""
        env = os.environ if env is None else env
        return Options(**{f.name: _typed(PREFIX + f.name.upper(), env[PREFIX + f.name.upper()], type(f.default)) for f in fields(Options) if env.get(PREFIX + f.name.upper(), "").strip()})


def _typed(name: str, raw: str, kind: type) -> object:
    raw = raw.strip()
    if kind is bool:
        if raw.lower() in ("1", "true", "yes", "on"):
            return True
        if raw.lower() in ("0", "false", "no", "off"):
            return False
        raise SettingError(f"{name}={raw!r} is neither yes nor no")
    try:
        return kind(raw)
    except ValueError as e:
        raise SettingError(f"{name}={raw!r} is no {kind.__name__}") from e


def switch(own: bool | None, off: bool, configured: bool) -> bool:
    """A three-state flag: an explicit "no" wins, then an explicit choice, then the setting."""
    return False if off else configured if own is None else own


def tariffs(spark: SparkSession, raw: str | None) -> DataFrame:
    """The tariff table from JSON {model: {input, output, ...}}; missing prices are 0, no text is no tariff."""
    try:
        found = json.loads(raw) if raw and raw.strip() else {}
    except json.JSONDecodeError as e:
        raise SettingError("tariffs are a JSON object of models") from e
    if not isinstance(found, dict) or not all(isinstance(p, dict) for p in found.values()):
        raise SettingError("tariffs are a JSON object of models, a tariff an object of prices")
    try:
        rows = [(str(m), *(float(p.get(k) or 0.0) for k in PRICES)) for m, p in found.items()]
    except (TypeError, ValueError) as e:
        raise SettingError("a price is a number") from e
    return spark.createDataFrame(rows, PRICING)
