"""Settings: models, roles, quotas and prompt templates, checked when loaded."""

from __future__ import annotations

import copy
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SINGLE_ROLES = ("generator_model", "eval_judge")
LIST_ROLES = ("gt_judges", "benchmark_models", "eval_judges")
MODES = ("single", "triple")


class SettingsError(ValueError):
    pass


@dataclass
class Settings:
    values: dict[str, Any]
    system_prompts: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str, system_prompts: Mapping[str, str] | None = None) -> Settings:
        with open(path, encoding="utf-8") as handle:
            settings = cls(yaml.safe_load(handle) or {}, system_prompts or {})
        settings.check()
        return settings

    def get(self, *path: str, default: Any = None) -> Any:
        value: Any = self.values
        for step in path:
            if not isinstance(value, dict) or step not in value:
                return default
            value = value[step]
        return value

    def roles(self) -> list[tuple[str, str]]:
        """(role, model) for every model a role refers to."""
        rows = [(role, self.get(role)) for role in SINGLE_ROLES if self.get(role)]
        for role in LIST_ROLES:
            rows += [(role, model) for model in self.get(role, default=[]) or []]
        return rows

    def check(self) -> None:
        known = self.get("models", default={}) or {}
        missing = sorted({model for _, model in self.roles()} - set(known))
        if missing:
            raise SettingsError(f"roles refer to models that are not registered: {missing}")
        quota, split = self.get("questions_per_area"), self.get("question_type_split", default={}) or {}
        if quota is not None and sum(split.values()) != quota:
            raise SettingsError(f"question_type_split adds up to {sum(split.values())}, questions_per_area is {quota}")
        if self.get("eval_mode") not in MODES:
            raise SettingsError(f"eval_mode must be one of {MODES}, got {self.get('eval_mode')!r}")
        prompt = self.get("benchmark_protocol", "system_prompt")
        if self.system_prompts and prompt not in self.system_prompts:
            raise SettingsError(f"unknown system prompt {prompt!r}; known: {sorted(self.system_prompts)}")

    def judges(self, mode: str | None = None) -> list[str]:
        mode = mode or self.get("eval_mode")
        return [self.get("eval_judge")] if mode == "single" else list(self.get("eval_judges", default=[]))

    def without_model(self, name: str) -> Settings:
        """Remove a model and every reference to it; single roles move to the first model left."""
        values = copy.deepcopy(self.values)
        values.get("models", {}).pop(name, None)
        left = list(values.get("models", {}))
        for role in LIST_ROLES:
            if role in values:
                values[role] = [m for m in values[role] or [] if m != name]
        for role in SINGLE_ROLES:
            if values.get(role) == name:
                values[role] = left[0] if left else None
        return Settings(values, self.system_prompts)

    def model_table(self, spark: SparkSession) -> DataFrame:
        """The registry as a dimension table."""
        rows = [
            (
                key, entry.get("model", ""), entry.get("family", "unknown"),
                None if entry.get("temperature") in (None, "") else float(entry["temperature"]),
                bool(entry.get("omit_temperature", False)),
            )
            for key, entry in (self.get("models", default={}) or {}).items()
        ]
        return spark.createDataFrame(
            rows, "model string, model_id string, family string, temperature double, omit_temperature boolean"
        )

    def role_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.roles(), "role string, model string")


def unregistered(roles: DataFrame, models: DataFrame) -> DataFrame:
    """Role references without a registry entry."""
    return roles.join(models.select("model"), "model", "left_anti")


def in_use(roles: DataFrame, names: DataFrame) -> DataFrame:
    """Registered names that some role refers to."""
    return names.join(roles.select("model"), "model", "left_semi")


def key_names(referenced: DataFrame, stored: DataFrame) -> DataFrame:
    """All key names, referenced or stored, and whether each one is stored."""
    names = referenced.select("key_name").union(stored.select("key_name")).distinct()
    marked = stored.select("key_name", F.lit(True).alias("_stored")).distinct()
    return names.join(marked, "key_name", "left").select("key_name", F.coalesce("_stored", F.lit(False)).alias("stored"))


def overlay(defaults: Mapping[str, Mapping[str, str]], edits: Mapping[str, Any]) -> dict[str, dict[str, str]]:
    """Default prompt sections with the edited entries on top."""
    return {
        name: {**section, **(edits[name] if isinstance(edits.get(name), dict) else {})}
        for name, section in defaults.items()
    }


def lost_placeholders(template: str, required: list[str]) -> list[str]:
    """Required ``$name`` placeholders that an edited template no longer has."""
    return [name for name in required if f"${name}" not in template and f"${{{name}}}" not in template]
