"""Orchestration of steps on the driver: each step is a function of a DataFrame (or any value)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

Step = Callable


class Sequence:
    """Steps in order."""

    def __init__(self, *steps: Step):
        self.steps = list(steps)

    def plan(self, value) -> Iterator[Step]:
        yield from self.steps

    def __call__(self, value):
        return reduce(lambda v, step: step(v), self.plan(value), value)


class Branch(Sequence):
    """The steps of the first condition that holds, else ``otherwise``."""

    def __init__(self, *cases: tuple[Callable, Step], otherwise: Step | None = None):
        self.cases, self.otherwise = list(cases), otherwise

    def plan(self, value) -> Iterator[Step]:
        for test, step in self.cases:
            if test(value):
                yield step
                return
        if self.otherwise:
            yield self.otherwise


class Loop:
    """Repeat a step while the condition holds; ``until`` is looked at before each round, ``skip``
    leaves a round out and tests the condition again."""

    def __init__(self, condition: Callable, step: Step, until: Callable | None = None, skip: Callable | None = None, most: int = 10_000):
        self.condition, self.step, self.until, self.skip, self.most = condition, step, until, skip, most

    def __call__(self, value):
        for _ in range(self.most):
            if not self.condition(value) or (self.until and self.until(value)):
                return value
            if not (self.skip and self.skip(value)):
                value = self.step(value)
        raise RuntimeError("the loop did not end")


def compose(*steps: Step) -> Step:
    return Sequence(*steps)


def call_all(steps: list[Step], workers: int = 4) -> tuple[list, list]:
    """Run independent steps side by side (Spark jobs are submitted from threads): results in order,
    None where a step failed, and the errors in order."""
    with ThreadPoolExecutor(workers) as pool:
        futures = [pool.submit(s) for s in steps]
        errors = [f.exception() for f in futures]
        return [None if e else f.result() for f, e in zip(futures, errors)], errors
