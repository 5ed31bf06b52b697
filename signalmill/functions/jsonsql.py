"""JSON text from SQL expressions.

Every function takes and returns SQL text. Whole rows are put together this way:
a lambda over attribute lists written as text is parsed once, where one built
from column calls costs a Python round trip per operator.
"""

from __future__ import annotations

# Characters that JSON strings have to escape.
_SPECIAL = r"""r'[\x00-\x1f"\\]'"""


def quoted(x: str) -> str:
    """A string as a JSON literal; only text with special characters goes through the JSON writer."""
    return (f"CASE WHEN {x} RLIKE {_SPECIAL} THEN substring(to_json(array({x})), 2, length(to_json(array({x}))) - 2) "
            f"""ELSE concat('"', {x}, '"') END""")


def json_double(x: str) -> str:
    """A double as JSON text: shortest digits, plain notation from 1e-5 up to 1e16, non-finite values as strings."""
    return (f"""CASE WHEN isnan({x}) THEN '"NaN"' WHEN {x} = double('inf') THEN '"inf"' WHEN {x} = double('-inf') THEN '"-inf"' """
            f"WHEN abs({x}) >= 1e7D AND abs({x}) < 1e16D THEN regexp_replace(string(cast({x} AS decimal(38,9))), '0{{1,8}}$', '') "
            f"WHEN abs({x}) >= 1e-5D AND abs({x}) < 1e-3D THEN regexp_replace(string(cast({x} AS decimal(38,25))), '0+$', '') "
            f"ELSE replace(replace(string({x}), '.0E', 'e'), 'E', 'e') END")


def object_text(**fields: str) -> str:
    """A JSON object of rendered values with its keys in order; a NULL value renders as null."""
    parts = [f"""'{"{" if i == 0 else ","}"{name}":', coalesce({value}, 'null')""" for i, (name, value) in enumerate(sorted(fields.items()))]
    return f"concat({', '.join(parts)}, '}}')"


def array_text(items: str) -> str:
    """A JSON array of rendered values."""
    return f"concat('[', array_join({items}, ',', 'null'), ']')"
