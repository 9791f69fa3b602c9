"""Experiments: which plan runs on which candidate, as plain values the driver handles."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from depscope.functions import parsing
from depscope.spec import FDSpec

#: What one candidate is scored by: everything at once, reliability alone, and single measures.
IMPLEMENTATIONS = {"fused": ("mu_plus", "rfi_prime_plus", "g1", "g2", "g3_prime", "reliability"), "reliability": ("reliability",), **{m: (m,) for m in ("mu_plus", "rfi_prime_plus", "g1", "g2", "g3_prime")}}


class ConfigError(ValueError):
    """An experiment file says something impossible."""


@dataclass(frozen=True)
class Experiment:
    name: str
    table: str
    fd: FDSpec
    measures: tuple[str, ...]
    tags: dict[str, Any] = field(default_factory=dict)
    #: "clean": violations are given, as row numbers from 0 such as ``3,17``; "dirty": they are found.
    mode: str = "dirty"
    violations: str = ""
    #: Own settings; None takes those of the file.
    repetitions: int | None = None
    timeout: Any = None
    memory_limit: Any = None
    #: Session settings that hold while the experiment runs.
    environment: dict[str, str] = field(default_factory=dict)
    #: Carried into the results.
    args: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Run:
    """One repetition of an experiment; equal settings have equal ids."""

    run_id: str
    experiment: Experiment
    repetition: int
    timeout: float
    memory_limit: int | None = None


def _amount(value: Any, units: dict[str, float], what: str) -> float:
    """A positive number, or a text of a number and a unit."""
    number, unit = (value, "") if isinstance(value, (int, float)) else re.fullmatch(r"\s*(.*?)\s*([a-z]*)\s*", str(value).lower()).groups()
    try:
        got = float(number) * (units[unit] if unit else 1 if number is value else math.nan)
    except (ValueError, KeyError):
        got = math.nan
    if isinstance(value, bool) or not 0 < got < math.inf:
        raise ConfigError(f"not {what}: {value!r}")
    return got


def duration(value: Any) -> float:
    """Seconds of a number or of a text such as ``50ms``, ``10s``, ``5m``, ``12h``."""
    return _amount(value, parsing.SECONDS, "a duration")


def memory(value: Any) -> int | None:
    """Bytes of a number or of a text such as ``512MB``; None stays None."""
    return None if value is None else int(_amount(value, parsing.BYTES, "an amount of memory"))


def enumerate_experiments(candidates: Iterable[tuple[str, FDSpec, dict[str, Any]]], implementations: dict[str, tuple[str, ...]] = IMPLEMENTATIONS) -> list[Experiment]:
    """An experiment for each candidate (table, dependency, tags) and implementation."""
    return [Experiment(f"{table}__{fd}__{name}", table, fd, measures, {**tags, "implementation": name}) for (table, fd, tags), (name, measures) in itertools.product(candidates, implementations.items())]


def expand_runs(experiments: Iterable[Experiment], repetitions: int = 1, timeout: Any = "12h", memory_limit: Any = None) -> list[Run]:
    """Every repetition of every experiment; an experiment's own settings come before those given here.

    Raises ConfigError on repeated names or senseless settings.
    """
    experiments = list(experiments)
    names = [e.name for e in experiments]
    if repeated := sorted({n for n in names if names.count(n) > 1}):
        raise ConfigError(f"experiment names repeat: {', '.join(repeated)}")
    out = []
    for e in experiments:
        times = repetitions if e.repetitions is None else e.repetitions
        if not isinstance(times, int) or isinstance(times, bool) or times < 1:
            raise ConfigError(f"repetitions has to be a positive whole number: {times!r}")
        if e.mode not in ("dirty", "clean"):
            raise ConfigError(f"mode has to be dirty or clean: {e.mode!r}")
        limit, most = duration(timeout if e.timeout is None else e.timeout), memory(memory_limit if e.memory_limit is None else e.memory_limit)
        said = json.dumps([e.name, e.table, e.fd.lhs, e.fd.rhs, e.measures, e.tags, e.mode, e.violations, e.environment, e.args, limit, most], sort_keys=True, default=str)
        slug = re.sub(r"[^a-z0-9]+", "-", e.name.lower()).strip("-") or "run"
        for r in range(1, times + 1):
            digest = hashlib.sha256(f"{said}|{r}".encode()).hexdigest()[:10]
            out.append(Run(f"{slug}-r{r}-{digest}", e, r, limit, most))
    return out


#: Fields of an experiment that a file may leave out.
_OPTIONAL = {"tags": dict, "mode": str, "violations": str, "repetitions": int, "timeout": object, "memory_limit": object, "environment": dict, "args": dict}


def load_experiments(path: str) -> tuple[list[Experiment], dict[str, Any]]:
    """Experiments of a YAML file and its settings (repetitions, timeout, memory_limit, environment, folders)."""
    import yaml

    with open(path, encoding="utf-8") as f:
        said = yaml.safe_load(f) or {}
    if not isinstance(said, dict) or not isinstance(said.get("experiments"), list):
        raise ConfigError(f"{path}: no list of experiments")
    shared = said.get("environment", {})
    out = []
    for i, e in enumerate(said["experiments"]):
        if not isinstance(e, dict) or not {"name", "table", "lhs", "rhs"} <= e.keys():
            raise ConfigError(f"{path}: experiment {i} needs name, table, lhs and rhs")
        own = {k: v for k, v in e.items() if k in _OPTIONAL and v is not None}
        if wrong := [k for k, v in own.items() if not isinstance(v, _OPTIONAL[k])] or ([] if isinstance(shared, dict) else ["environment"]):
            raise ConfigError(f"{path}: {', '.join(wrong)} of {e['name']!r} cannot be that")
        if environment := {str(k): str(v) for k, v in {**shared, **own.get("environment", {})}.items()}:
            own["environment"] = environment
        lhs = e["lhs"] if isinstance(e["lhs"], list) else str(e["lhs"]).split("|")
        out.append(Experiment(e["name"], e["table"], FDSpec(tuple(lhs), e["rhs"]), tuple(e.get("measures", IMPLEMENTATIONS["fused"])), **own))
    return out, {k: v for k, v in said.items() if k != "experiments"}


def write_experiments(path: str, experiments: Iterable[Experiment], **settings: Any) -> None:
    """The file that ``load_experiments`` reads."""
    import yaml

    rows = []
    for e in experiments:
        row = {"name": e.name, "table": e.table, "lhs": list(e.fd.lhs), "rhs": e.fd.rhs, "measures": list(e.measures)}
        rows.append(row | {k: getattr(e, k) for k in _OPTIONAL if getattr(e, k) not in (None, "", {})})
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump({**settings, "experiments": rows}, f, sort_keys=False)
