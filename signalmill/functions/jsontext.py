"""Reading and writing the JSON text columns with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def attribute(json_text: Column, key: str) -> Column:
    """Text of one top-level attribute; dots in the key are part of the name."""
    if "'" in key:
        return F.try_element_at(F.from_json(json_text, "map<string,string>"), F.lit(key))
    return F.get_json_object(json_text, f"$['{key}']")


def double_array(json_text: Column) -> Column:
    """JSON array text to ARRAY<DOUBLE>; ``"inf"`` and its like become the double value."""
    return F.transform(F.from_json(json_text, "array<string>"), lambda x: x.try_cast("double"))


def key_values(json_text: Column) -> Column:
    """JSON object text to MAP<STRING,STRING>; nested values stay JSON text."""
    return F.from_json(json_text, "map<string,string>")


def non_finite_text(x: Column) -> Column:
    return F.when(F.isnan(x), "NaN").when(x > 0, "inf").otherwise("-inf")
