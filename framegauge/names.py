"""Columns whose names differ only in case.

Spark resolves ``id`` and ``ID`` to both columns unless ``spark.sql.caseSensitive`` is set.
The operators take names exactly: where a dataset has such names they work on a copy of it
with other names, given by position, and put the right ones back into what they return.
"""

from __future__ import annotations

import functools
import inspect
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegauge.schema import col


class ExactNames:
    """``df`` with names that Spark can tell apart, and the way back.

    Without clashes, in a case-sensitive session, and where one name occurs twice exactly,
    everything stays as it is.
    """

    def __init__(self, df: DataFrame) -> None:
        names = df.columns
        lowered = Counter(name.lower() for name in names)
        self.aliases: dict[str, str] = {}
        self.df = df
        if len(lowered) == len(names) or len(set(names)) < len(names):
            return
        if df.sparkSession.conf.get("spark.sql.caseSensitive").lower() == "true":
            return
        for place, name in enumerate(names):
            if lowered[name.lower()] > 1:
                mark = "__"
                while any(f"{name}{mark}{place}_".lower() in other.lower() for other in names):
                    mark += "_"
                self.aliases[name] = f"{name}{mark}{place}_"
        self.df = df.toDF(*[self.aliases.get(name, name) for name in names])

    def of(self, value: Any) -> Any:
        """A name, or names in lists, tuples and keys of mappings, as ``self.df`` has them."""
        if isinstance(value, str):
            return self.aliases.get(value, value)
        if isinstance(value, Mapping):
            return {self.of(k): v for k, v in value.items()}
        if isinstance(value, Iterable):
            return tuple(self.of(v) for v in value) if isinstance(value, tuple) else [self.of(v) for v in value]
        return value

    def restored(self, result: DataFrame, texts: Sequence[str] = ()) -> DataFrame:
        """``result`` with the names of the dataset, also inside the columns ``texts``."""
        if not self.aliases:
            return result

        def back(text: str) -> str:
            return functools.reduce(lambda t, pair: t.replace(pair[1], pair[0]), self.aliases.items(), text)

        def shown(name: str):
            if name not in texts:
                return col(name)
            pairs = [(F.lit(alias), F.lit(name)) for name, alias in self.aliases.items()]
            return functools.reduce(lambda c, pair: F.replace(c, *pair), pairs, col(name)).alias(name)

        return result.select(*[shown(c) for c in result.columns]).toDF(*[back(c) for c in result.columns])


def _listed(value: Any) -> Iterator[str]:
    """The names in a value that :meth:`ExactNames.of` takes."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, Iterable):
        for inner in value:
            yield from _listed(inner)


def exact_names(*naming: str, texts: Sequence[str] = ()) -> Callable:
    """For operators on ``df``: the parameters ``naming`` name columns, ``texts`` are result
    columns that hold names.  A name the dataset lacks is left to the operator to refuse."""

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(operator)

        @functools.wraps(operator)
        def run(*args: Any, **options: Any) -> DataFrame:
            bound = signature.bind(*args, **options)
            names = ExactNames(bound.arguments["df"])
            if not names.aliases:
                return operator(*args, **options)
            given = {p: bound.arguments[p] for p in naming if bound.arguments.get(p) is not None}
            for parameter, value in given.items():
                if signature.parameters[parameter].kind is inspect.Parameter.VAR_KEYWORD:
                    bound.arguments[parameter] = {k: names.of(v) for k, v in value.items()}
                    value = list(value.values())
                else:
                    bound.arguments[parameter] = names.of(value)
                if not set(_listed(value)) <= set(bound.arguments["df"].columns):
                    return operator(*args, **options)
            bound.arguments["df"] = names.df
            return names.restored(operator(*bound.args, **bound.kwargs), texts)

        return run

    return wrap
