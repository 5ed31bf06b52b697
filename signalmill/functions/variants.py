"""JSON text as values: VARIANT columns, in which text that is no JSON stays the text it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The JSON text columns of each table that hold values.
JSON_COLUMNS = {
    "spans": ("resource_attributes", "span_attributes", "events", "links"),
    "log_records": ("body", "log_attributes", "resource_attributes"),
    "metric_points": ("resource_attributes", "series_attributes", "metric_metadata", "exemplars", "exp_buckets", "summary_quantiles"),
}


def parse_or_keep(text: Column) -> Column:
    """The value of JSON text; the text itself as a string value where it does not parse; NULL for NULL."""
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))


def kind(value: Column) -> Column:
    """``object``, ``array``, ``string``, ``number``, ``boolean`` or ``null`` of a value; NULL for NULL."""
    schema = F.schema_of_variant(value)
    return (F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "STRING", "string")
            .when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null").when(schema.isNotNull(), "number"))


def path_of(*steps: str | int) -> str:
    """A path into a value: names as they are, dots and all, and positions from 0. A name may hold one kind of quotes."""
    out = "$"
    for s in steps:
        quote = '"' if "'" in str(s) else "'"
        if quote in str(s):
            raise ValueError(f"a name with both kinds of quotes: {s}")
        out += f"[{s}]" if isinstance(s, int) else f"[{quote}{s}{quote}]"
    return out


def text_at(value: Column, *steps: str | int) -> Column:
    """What stands at a path, as text: strings without quotes, objects and arrays as JSON; NULL where nothing does."""
    return F.try_variant_get(value, path_of(*steps), "string")


def with_values(df: DataFrame, table: str) -> DataFrame:
    """The table with its JSON text columns as values; all by built-in functions."""
    return df.withColumns({c: parse_or_keep(F.col(c)) for c in JSON_COLUMNS[table] if c in df.columns})
