"""Array and map valued attributes as plain JSON text, in Arrow batches.

Their depth has no bound, which Spark's fixed types cannot describe; everything
else about an envelope is done by built-in functions.
"""

from __future__ import annotations

import base64
import json
import sys
from decimal import Decimal

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sent to the executors as code, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def plain_value(value: dict | None):
    """A tagged attribute value as plain JSON data."""
    for tag, content in (value or {}).items():
        if tag == "arrayValue":
            return [plain_value(v) for v in content.get("values", [])]
        if tag == "kvlistValue":
            return {kv.get("key", ""): plain_value(kv.get("value")) for kv in content.get("values", [])}
        if tag == "intValue":
            return int(content)
        if tag == "doubleValue":
            return float(content)
        if tag == "bytesValue":
            return base64.b64decode(content).hex()
        if tag in ("stringValue", "boolValue"):
            return content
    return None


def plain_text(value) -> str:
    """Compact JSON with sorted keys; non-finite numbers become text."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{_json_string(k)}:{plain_text(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(plain_text, value)) + "]"
    if isinstance(value, float):
        return _float_text(value)
    return _json_string(value)


def _json_string(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def _float_text(value: float) -> str:
    if value != value or abs(value) == float("inf"):
        return '"NaN"' if value != value else '"inf"' if value > 0 else '"-inf"'
    text = repr(value)
    if 1e-5 <= abs(value) < 1e-4:
        return format(Decimal(text), "f")
    mantissa, _, exponent = text.partition("e")
    return f"{mantissa}e{int(exponent)}" if exponent else text


@F.pandas_udf(T.ArrayType(T.StringType()))
def plain_values(raws: pd.Series) -> pd.Series:
    return raws.map(lambda row: None if row is None else [plain_text(plain_value(json.loads(r))) for r in row])
