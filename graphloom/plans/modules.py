"""Modules: steps of a run with stages, needs and conflicts, resolved to an order and run as DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ("preprocess", "produce", "postprocess", "export")


@dataclass(frozen=True)
class Module:
    """run: for preprocess and postprocess, DataFrame(s) to the same; for produce, inputs to triples; for export, a sink."""

    name: str
    stage: str
    run: Callable
    requires: tuple[str, ...] = ()
    conflicts: tuple[str, ...] = ()
    may_fail: bool = False


def resolve(modules: list[Module], wanted: list[str]) -> list[Module]:
    """Wanted modules and all they need, by stage, then after their needs, then by name."""
    by = {m.name: m for m in modules}
    active: dict[str, Module] = {}

    def add(name: str, path: tuple[str, ...]) -> None:
        if name not in by:
            raise ValueError(f"unknown module {name}")
        if name in path:
            raise ValueError("modules need each other: " + " -> ".join((*path, name)))
        for need in by[name].requires:
            add(need, (*path, name))
        active[name] = by[name]

    for name in wanted:
        add(name, ())
    for m in active.values():
        if hit := sorted(set(m.conflicts) & set(active)):
            raise ValueError(f"{m.name} conflicts with {', '.join(hit)}")
        for need in m.requires:
            if STAGES.index(by[need].stage) > STAGES.index(m.stage):
                raise ValueError(f"{m.name} needs {need}, which runs after it")
    done: list[Module] = []
    left = sorted(active.values(), key=lambda m: (STAGES.index(m.stage), m.name))
    while left:
        m = next(m for m in left if all(by[r] in done for r in m.requires))
        done.append(m)
        left.remove(m)
    return done


def run(modules: list[Module], wanted: list[str], model: dict[str, DataFrame]) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of all producers' triples, each in a graph of the producer's name unless it names one, after postprocessing
    and exports; and errors of modules that may fail."""
    triples, errors = None, {}
    for m in resolve(modules, wanted):
        try:
            if m.stage == "preprocess":
                model = m.run(model)
            elif m.stage == "produce":
                made = m.run(model).withColumn("g", F.when(F.col("g") == "", m.name).otherwise(F.col("g")))
                triples = made if triples is None else triples.unionByName(made)
            elif m.stage == "postprocess":
                triples = m.run(triples)
            else:
                m.run(triples)
        except Exception as e:
            if not m.may_fail:
                raise
            errors[m.name] = str(e)
    return triples, errors
