"""Extensions by group and name: registered in code or found among installed entry points."""

from __future__ import annotations

from importlib.metadata import entry_points

from trialframe.errors import ConfigError
from trialframe.operators.decisions import POLICIES
from trialframe.operators.designs import PLANNERS
from trialframe.operators.refinement import REFINEMENTS
from trialframe.plans import pipeline

GROUPS = ("blocks", "planners", "policies", "refinements", "codecs", "executors")


class Plugins:
    def __init__(self) -> None:
        self._known: dict[tuple[str, str], object] = {}
        for name in ("constant", "scale", "mean"):
            self.register("blocks", f"trialframe.{name}", getattr(pipeline, name))
        for group, known in (("planners", PLANNERS), ("policies", POLICIES), ("refinements", REFINEMENTS)):
            for name, value in known.items():
                self.register(group, name, value)

    def register(self, group: str, name: str, value: object) -> None:
        if group not in GROUPS:
            raise ConfigError(f"group {group!r} is none of {GROUPS}")
        if (group, name) in self._known:
            raise ConfigError(f"{group} {name!r} is registered")
        self._known[group, name] = value

    def resolve(self, group: str, name: str) -> object:
        if (group, name) not in self._known:
            raise ConfigError(f"unknown {group} {name!r}")
        return self._known[group, name]

    def names(self, group: str) -> list[str]:
        return sorted(n for g, n in self._known if g == group)

    def discover(self) -> list[str]:
        """Register what installed packages offer under ``trialframe.<group>``."""
        found = []
        for group in GROUPS:
            for e in entry_points(group=f"trialframe.{group}"):
                if (group, e.name) not in self._known:
                    self.register(group, e.name, e.load())
                    found.append(f"{group}:{e.name}")
        return found
