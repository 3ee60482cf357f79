"""Stages one after the other over one sweep's URLs: each sees what those before it wrote, and the first failure ends the run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from folioscope.operators.classifying import aimed

Stage = Callable[[DataFrame], int]
DONE, FAILED, NOT_RUN = "concluido", "falhou", "nao_executado"


@dataclass(frozen=True)
class Step:
    name: str
    status: str
    changed: int | None
    problem: str | None


def run(documents: Callable[[], DataFrame], sweep: DataFrame, stages: Sequence[tuple[str, Stage]]) -> list[Step]:
    """Runs (name, stage) over the documents of the sweep's URLs; a stage gives the number of its changes.

    documents is asked before each stage, so a stage sees the tables as the one before left them. What a failed run
    wrote stays: every stage passes over what is done, so the run can simply be started again.
    """
    steps: list[Step] = []
    for name, stage in stages:
        if steps and steps[-1].status != DONE:
            steps.append(Step(name, NOT_RUN, None, None))
            continue
        try:
            steps.append(Step(name, DONE, stage(aimed(documents(), sweep=sweep)), None))
        except Exception as e:  # noqa: BLE001  a stage's failure is the run's result, not its end
            steps.append(Step(name, FAILED, None, f"{type(e).__name__}: {e}"[:500]))
    return steps
