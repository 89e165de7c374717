"""Algorithms by task and name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from timberline.operators import cluster, detect, vectorize
from timberline.parsing.ael import AELParams, ael
from timberline.parsing.drain import DrainParams, drain
from timberline.parsing.iplom import IPLoMParams, iplom

TASKS = ("detection", "parsing", "clustering", "vectorization")
#: Registered names whose models need a deep-learning library, which is absent.
NEURAL = ("lstm", "cnn", "transformer", "logbert")


@dataclass(frozen=True)
class Entry:
    run: Callable
    params: Callable | None = None  # builds the algorithm's parameter object; None: parameters are keywords


class Registry:
    def __init__(self):
        self.entries: dict[tuple[str, str], Entry] = {}

    def register(self, task: str, name: str, run: Callable, params: Callable | None = None) -> None:
        if task not in TASKS:
            raise ValueError(f"no task {task!r}; there are {TASKS}")
        if (task, name) in self.entries:
            raise AssertionError(f"{task} {name!r} is registered already")
        self.entries[task, name] = Entry(run, params)

    def unregister(self, task: str, name: str) -> None:
        self.entries.pop((task, name), None)

    def names(self, task: str) -> list[str]:
        return sorted(n for t, n in self.entries if t == task)

    def get(self, task: str, name: str, params: dict | None = None) -> Callable:
        """The algorithm as a function of a DataFrame (and keywords), with its parameters set."""
        key = (task, name.lower())
        if key not in self.entries:
            if task == "detection" and name.lower() in NEURAL:
                raise ImportError(f"{name} needs a deep-learning library that is not installed")
            raise ValueError(f"no {task} algorithm {name!r}; there are {self.names(task)}")
        e = self.entries[key]
        if e.params:
            p = e.params(**{k: tuple(v) if isinstance(v, list) else v for k, v in (params or {}).items()})
            return lambda df, **kw: e.run(df, p, **kw)
        return lambda df, **kw: e.run(df, **{**(params or {}), **kw})


registry = Registry()
for _name, _run, _params in (("drain", drain, DrainParams), ("ael", ael, AELParams), ("iplom", iplom, IPLoMParams)):
    registry.register("parsing", _name, _run, _params)
for _name, _run in (("kmeans", cluster.kmeans), ("dbscan", cluster.dbscan), ("birch", cluster.birch)):
    registry.register("clustering", _name, _run)
for _name, _run in (*detect.VECTORS.items(), *detect.SERIES.items(), ("distribution_divergence", detect.distribution_divergence)):
    registry.register("detection", _name, _run)
for _name, _run in (("tfidf", vectorize.tfidf), ("word2vec", vectorize.word2vec), ("fasttext", vectorize.subword_vectors), ("sequential", vectorize.sequential), ("semantic", vectorize.semantic_ids), ("forecast_nn", vectorize.next_line_dataset), ("logbert", vectorize.token_ids)):
    registry.register("vectorization", _name, _run)
