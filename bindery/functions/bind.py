"""Naming an intermediate value inside one expression, and quoting for SQL text.

Long expressions made of many small ones (one step per mask rule or setting) are
written as SQL text: building them call by call costs seconds on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def let(name: str, value: str, body: str) -> str:
    """The same in SQL text: ``body`` with ``name`` standing for ``value``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def quoted(text: str) -> str:
    """A SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"
