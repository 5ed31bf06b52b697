"""Labels of the enumerations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import SEVERITY_CLASS, SPAN_KINDS, STATUS_LABELS


def _mapping(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def span_kind_name(kind: Column) -> Column:
    known = F.try_element_at(_mapping(enumerate(SPAN_KINDS)), kind)
    return F.coalesce(known, F.concat(F.lit("kind"), kind.cast("string")))


def status_label(code: Column) -> Column:
    known = F.try_element_at(_mapping(STATUS_LABELS.items()), code)
    return F.coalesce(known, F.lit("UNSET"))


def status_is_error(code: Column) -> Column:
    return code == 2


def severity_class(text: Column) -> Column:
    known = F.try_element_at(_mapping(SEVERITY_CLASS.items()), F.upper(F.coalesce(text, F.lit(""))))
    return F.coalesce(known, F.lit("outline"))
