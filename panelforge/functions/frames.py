"""Typed pandas frames for grouped functions."""

from __future__ import annotations

import pandas as pd

_DTYPES = {"int": "int32", "long": "int64", "double": "float64", "boolean": "bool"}


def empty(schema: str) -> pd.DataFrame:
    """A frame without rows of a schema text ``name type, ...``."""
    return pd.DataFrame({name: pd.Series(dtype=_DTYPES.get(kind, "object")) for name, kind in (field.split(" ", 1) for field in schema.split(", "))})
