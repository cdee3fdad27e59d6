"""Names for transforms, metrics and queries; a name can be given only once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame


class Registry:
    """A table of named things."""

    def __init__(self, kind: str):
        self.kind = kind
        self.items: dict[str, object] = {}

    def register(self, name: str) -> Callable:
        def keep(thing):
            if name in self.items:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self.items[name] = thing
            return thing

        return keep

    def __getitem__(self, name: str):
        if name not in self.items:
            raise KeyError(f"no {self.kind} {name!r}; there are {', '.join(sorted(self.items))}")
        return self.items[name]

    def names(self) -> list[str]:
        return sorted(self.items)


transforms = Registry("transform")
metrics = Registry("metric")
prompts = Registry("prompt")
tasks = Registry("task")
parsers = Registry("section parser")


@dataclass(frozen=True)
class Task:
    """A plug-in: how rows are read, what is done to them before and after, and what is measured.

    ``load`` maps a raw frame to one with input_sequence and target; ``pre`` and ``post`` hold (transform's name, arguments).
    """

    load: Callable[[DataFrame], DataFrame]
    pre: tuple[tuple[str, dict], ...] = ()
    post: tuple[tuple[str, dict], ...] = ()
    metrics: tuple[str, ...] = ()


def processors(kind: str, everywhere: list, task: list, model: list, override: bool = False) -> list[Callable]:
    """The steps (name, arguments) of all tasks, then the task's, then the model type's; with ``override`` only the task's."""
    steps = list(task) if override else [*everywhere, *task, *model]
    if unknown := [n for n, _ in steps if n not in transforms.items]:
        raise KeyError(f"no {kind} {', '.join(unknown)}")
    return [partial(transforms[n], **arguments) for n, arguments in steps]


def run_task(df: DataFrame, name: str, config: dict | None = None) -> DataFrame:
    """A registered task's rows after its pre- and postprocessors.

    ``config`` may have preprocessors, postprocessors, model_type (with either), override_preprocessors and
    override_postprocessors.
    """
    config, task = config or {}, tasks[name]
    model = config.get("model_type", {})
    out = task.load(df)
    for kind, own in (("preprocessors", task.pre), ("postprocessors", task.post)):
        for step in processors(kind, config.get(kind, []), own, model.get(kind, []), config.get(f"override_{kind}", False)):
            out = step(out)
    return out


def chain(df: DataFrame, *names: str) -> DataFrame:
    """Apply registered transforms in the order given."""
    return reduce(lambda d, n: d.transform(transforms[n]), names, df)


class Catalogue:
    """Queries with the SQL that says the same."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable:
        def keep(f):
            if name in self.queries:
                raise ValueError(f"query {name!r} is registered already")
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep
