"""Stages of the pipeline language and operators of plans: what they take, give and cost."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

#: Abstract units of the cost classes.
COST_UNITS = {"index": 1, "scan": 8, "process": 40, "test": 120}


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable
    takes: tuple[str, ...]  # input kinds; none for a source
    gives: str | None  # output kind; None: that of its input
    doc: str = ""
    cost: str = "scan"
    observes: bool = True

    @property
    def is_source(self) -> bool:
        return not self.takes


STAGES: dict[str, Stage] = {}


def register(name: str, run: Callable, takes: tuple[str, ...], gives: str | None, doc: str = "", cost: str = "scan", observes: bool = True) -> None:
    if name in STAGES:
        raise ValueError(f"stage {name} is registered already")
    STAGES[name] = Stage(name, run, takes, gives, doc, cost, observes)
