"""Choosing columns by name, from the schema alone."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def first_existing(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """The first candidate that is a column of ``df``."""
    return next((name for name in candidates if name in df.columns), None)


def find_column(df: DataFrame, pattern: str, exact_first: bool = True) -> str | None:
    """The first column whose name contains ``pattern``, ignoring case.

    With ``exact_first`` a column of exactly that name is preferred, so that
    ``fvc`` does not pick ``FEV1/FVC`` when a column ``FVC`` exists.
    """
    wanted = pattern.lower()
    if exact_first:
        for name in df.columns:
            if name.lower() == wanted:
                return name
    return next((name for name in df.columns if wanted in name.lower()), None)


def rename_aliases(df: DataFrame, aliases: Iterable[tuple[Iterable[str], str]]) -> DataFrame:
    """Rename the first matching alias of each group to its standard name."""
    renames = {}
    for names, standard in aliases:
        found = first_existing(df, names)
        if found and found != standard:
            renames[found] = standard
    return df.withColumnsRenamed(renames) if renames else df
