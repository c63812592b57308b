"""Documents with YAML front matter: experiments, read tolerantly, and shapes, where an unknown key is an error."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from foldwright.plans.dag import phase_violations, validate

PHASES = ("data", "pipeline", "ship")
STATUSES = ("draft", "active", "archived")
RULES = ("argmax-mean", "one-std-err", "pct-loss", "mean-std")


class DocumentError(ValueError):
    pass


@dataclass(frozen=True)
class Experiment:
    steps: list[dict]
    seed: int = 0
    status: str = "draft"
    rest: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Shape:
    phases: dict[str, list[dict]]
    k: int
    stratify: str | None
    inner_k: int | None
    metric: str
    direction: str
    rule: str
    options: dict[str, float]
    seed: int = 0


def front_matter(text: str) -> dict:
    import yaml

    lines = text.split("\n")
    if not lines or lines[0].strip() != "---":
        raise DocumentError("no front matter")
    for i, line in enumerate(lines[1:], 1):
        if line.strip() == "---":
            found = yaml.safe_load("\n".join(lines[1:i]))
            if not isinstance(found, dict):
                raise DocumentError("front matter is a map")
            return found
    raise DocumentError("front matter has no end")


def parse_experiment(text: str) -> Experiment:
    d = front_matter(text)
    steps = d.get("steps") or []
    if d.get("status", "draft") not in STATUSES:
        raise DocumentError(f"status {d.get('status')!r} is none of {', '.join(STATUSES)}")
    validate(steps)
    return Experiment(steps, int(d.get("seed") or 0), d.get("status", "draft"), {k: v for k, v in d.items() if k not in ("steps", "seed", "status")})


def _only(d: dict, known: set[str], where: str) -> None:
    if extra := sorted(set(d) - known):
        raise DocumentError(f"{where}: unknown {', '.join(map(str, extra))}")


def parse_rule(select: Any) -> tuple[str, dict[str, float]]:
    name, body = (select, {}) if isinstance(select, str) else next(iter(select.items())) if isinstance(select, dict) and len(select) == 1 else (None, {})
    if name not in RULES:
        raise DocumentError(f"select is one of {', '.join(RULES)}, not {select!r}")
    option = {"pct-loss": "tolerance", "mean-std": "lam"}.get(name)
    if body and (option is None or not isinstance(body, int | float | dict)):
        raise DocumentError(f"{name} takes no {body!r}")
    value = next(iter(body.values())) if isinstance(body, dict) and body else body
    return name, {option: float(value)} if option and value not in ({}, None) else {}


def parse_shape(text: str) -> Shape:
    d = front_matter(text)
    _only(d, {"type", "id", "title", "status", "seed", "created", "updated", *PHASES, "sweeper"}, "shape")
    phases = {p: d.get(p) or [] for p in PHASES}
    sweeper = d.get("sweeper") or {}
    _only(sweeper, {"sampler", "resample", "objective"}, "sweeper")
    cv = (sweeper.get("resample") or {}).get("cv") or {}
    _only(cv, {"k", "inner_k", "stratify"}, "cv")
    objective = sweeper.get("objective") or {}
    _only(objective, {"metric", "direction", "select"}, "objective")
    steps = [s for p in PHASES for s in phases[p]]
    validate(steps)
    of = {s["id"]: i for i, p in enumerate(PHASES) for s in phases[p]}
    if bad := phase_violations(of, steps):
        raise DocumentError("; ".join(bad))
    k = int(cv.get("k") or 0)
    if k < 2:
        raise DocumentError("cv.k is at least 2")
    rule, options = parse_rule(objective.get("select") or "argmax-mean")
    return Shape(phases, k, cv.get("stratify") or None, cv.get("inner_k"), objective.get("metric") or "", objective.get("direction") or "maximize", rule, options, int(d.get("seed") or 0))


def resample_mode(n_configs: int) -> str:
    """One configuration needs no inner choice."""
    return "nested" if n_configs > 1 else "flat"
