"""Configuration of a run from YAML or JSON. Fields and rules are tables; every problem of a file is named at once."""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

#: Fixed names and defaults of a file's fields.
FIELDS: dict[str, dict[str, object]] = {
    "data": {
        "path": "",
        "tokenizer": "gpt2",
        "format": "pretokenized",
        "max_length": 2048,
        "overlap_size": 256,
        "packing": True,
        "num_workers": 4,
        "curriculum": None,
        "allow_bucket_exhaustion": False,
        "allow_budget_mismatch": False,
    },
    "optimizer": {"learning_rate": 3e-4, "warmup_steps": 100, "decay_steps": None, "min_lr_ratio": 0.1},
    "training": {"output_dir": "", "per_device_batch_size": 8, "gradient_accumulation_steps": 1, "max_steps": 1000, "resume": "auto", "keep_last_k": None, "keep_milestone_every": None},
}
#: Fixed shapes of the models that a new file may begin with.
PRESETS = {
    "small": {"n_embd": 768, "n_layer": 12, "n_head": 12, "n_positions": 2048},
    "medium": {"n_embd": 1024, "n_layer": 24, "n_head": 16, "n_positions": 2048},
    "large": {"n_embd": 2048, "n_layer": 24, "n_head": 32, "n_positions": 2048},
}


@dataclass(frozen=True)
class Rule:
    """What a section's values must fulfil; `where` names the field that a report points to."""

    where: str
    holds: Callable[[dict], bool]
    wanted: str


SECTION_RULES: dict[str, tuple[Rule, ...]] = {
    "data": (
        Rule("format", lambda d: d["format"] in ("pretokenized", "jsonl"), "either pretokenized or jsonl"),
        Rule("curriculum", lambda d: not d["curriculum"] or d["format"] == "pretokenized", "left out unless the format is pretokenized, since phases are measured in a shard's tokens"),
        Rule("overlap_size", lambda d: 0 <= 2 * d["overlap_size"] <= d["max_length"], "between 0 and half a window"),
    ),
    "optimizer": (
        Rule("learning_rate", lambda o: o["learning_rate"] > 0, "above 0"),
        Rule("warmup_steps", lambda o: o["warmup_steps"] >= 0, "0 or more"),
    ),
    "training": (),
}
PHASE_RULES = (
    Rule("duration_tokens", lambda p: p["duration_tokens"] > 0, "a number of tokens above 0"),
    Rule("mix", lambda p: all(w >= 0 for w in p["mix"].values()), "weights of 0 or more"),
    Rule("mix", lambda p: math.fsum(p["mix"].values()) > 0, "weights of which one is above 0"),
)


class ConfigError(ValueError):
    """A configuration that can't be run; commands end with this code. `problems` are its (place, what is wanted)."""

    exit_code = 2

    def __init__(self, problems: list[tuple[str, str]]):
        super().__init__("; ".join(f"{place} should be {wanted}" for place, wanted in problems))
        self.problems = problems


def _broken(place: str, values: dict, rules: tuple[Rule, ...]) -> Iterator[tuple[str, str]]:
    for r in rules:
        try:
            good = r.holds(values)
        except (TypeError, KeyError, AttributeError):
            good = False
        if not good:
            yield f"{place}.{r.where}", r.wanted


def problems(raw: dict) -> list[tuple[str, str]]:
    """(place, what is wanted) of everything wrong with a file's sections, in their order. Sections without a meaning here only warn."""
    out: list[tuple[str, str]] = []
    for name in raw.keys() - FIELDS.keys():
        warnings.warn(f"nothing reads the section {name!r}", stacklevel=3)
    for name, known in FIELDS.items():
        own = raw.get(name) or {}
        out += [(f"{name}.{key}", "left out: there is no such field") for key in sorted(own.keys() - known.keys())]
        out += _broken(name, {**known, **own}, SECTION_RULES[name])
    for i, phase in enumerate((raw.get("data") or {}).get("curriculum") or ()):
        out += _broken(f"data.curriculum[{i}]", phase, PHASE_RULES)
    return out


@dataclass(frozen=True)
class Config:
    """Values by section and field, defaults filled in; weights of a phase sum to 1."""

    sections: dict[str, dict[str, object]]

    def __getitem__(self, place: str):
        section, _, key = place.partition(".")
        return self.sections[section][key]

    def mix_rows(self) -> list[tuple[int, int, str, float]]:
        """(phase_idx, duration_tokens, bucket, weight) for the curriculum's table."""
        phases = self["data.curriculum"] or []
        return [(i, p["duration_tokens"], bucket, share) for i, p in enumerate(phases) for bucket, share in sorted(p["mix"].items())]


def build(raw: dict) -> Config:
    if wrong := problems(raw):
        raise ConfigError(wrong)
    made = {name: {**known, **(raw.get(name) or {})} for name, known in FIELDS.items()}
    if phases := made["data"]["curriculum"]:
        made["data"]["curriculum"] = [{"duration_tokens": p["duration_tokens"], "mix": {b: w / math.fsum(p["mix"].values()) for b, w in p["mix"].items()}} for p in phases]
    return Config(made)


def read(path: str) -> Config:
    """A .json file, or else YAML."""
    file = Path(path)
    if not file.is_file():
        raise ConfigError([(path, "a file")])
    text = file.read_text()
    if file.suffix == ".json":
        return build(json.loads(text))
    import yaml

    return build(yaml.safe_load(text) or {})
