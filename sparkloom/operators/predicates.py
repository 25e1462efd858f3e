"""Metadata predicates as Columns, in two-valued logic: a missing value fails equality and passes the negative tests."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(where: dict[str, Any] | None) -> Column:
    """A filter dictionary (equality, ``$in``, ``$nin``, ``$ne``, ``$and``, ``$or``) as one Column; no filter passes all."""
    if not where:
        return F.lit(True)
    if "$and" in where:
        return reduce(lambda a, b: a & b, [matches(w) for w in where["$and"]], F.lit(True))
    if "$or" in where:
        return reduce(lambda a, b: a | b, [matches(w) for w in where["$or"]], F.lit(False))
    tests = []
    for field, test in where.items():
        value = F.col(field)
        if not isinstance(test, dict):
            tests.append(value.eqNullSafe(F.lit(test)))
            continue
        if "$in" in test:
            tests.append(_among(value, test["$in"]))
        if "$nin" in test:
            tests.append(~_among(value, test["$nin"]))
        if "$ne" in test:
            tests.append(~value.eqNullSafe(F.lit(test["$ne"])))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _among(value: Column, listed: list) -> Column:
    named = [x for x in listed if x is not None]
    inside = F.coalesce(value.isin(named), F.lit(False))
    return inside | value.isNull() if len(named) < len(listed) else inside
