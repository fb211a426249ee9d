"""Keys under inner names: a key may be called anything but a column of the result."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def column(df: DataFrame, name: str) -> Column:
    """A column by its whole name, or else a path into one."""
    return quoted(name) if name in df.columns else F.col(name)


def inner(keys: Sequence[str]) -> list[str]:
    return [f"_key{n}_" for n in range(len(keys))]


def inward(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with its keys under inner names, before the other columns."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*[quoted(k).alias(n) for k, n in zip(keys, inner(keys))], *map(quoted, rest))


def outward(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys under their own names again."""
    inside = inner(keys)
    rest = [c for c in df.columns if c not in inside]
    if clash := sorted(set(keys) & set(rest)) or len(set(keys)) < len(keys):
        raise ValueError(f"keys called like columns of the result, or twice: {clash or list(keys)}")
    return df.select(*[F.col(n).alias(k) for k, n in zip(keys, inside)], *map(quoted, rest))


def by_inner_names(verb: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For verbs ``(registers, spec, keys, ...)`` that give one table with the keys."""

    @wraps(verb)
    def run(registers: DataFrame, spec, keys: str | Sequence[str] = (), *more, **options) -> DataFrame:
        keys = names(keys)
        return outward(verb(inward(registers, keys), spec, inner(keys), *more, **options), keys)

    return run
