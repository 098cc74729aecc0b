"""JSON in one canonical form, and reading it strictly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _scalar(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        quoted = F.to_json(F.array(value))
        return F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    return value.cast("string")


def canonical(value: Column, kind: T.DataType, depth: int = 0) -> Column:
    """A value as indented text: fields in schema order, two spaces, NULL written out."""
    pad, inner = "  " * depth, "  " * (depth + 1)
    if isinstance(kind, T.StructType):
        parts: list[Column] = []
        for position, field in enumerate(kind.fields):
            lead = ("{\n" if position == 0 else ",\n") + f'{inner}"{field.name}": '
            parts += [F.lit(lead), canonical(value[field.name], field.dataType, depth + 1)]
        text = F.concat(*parts, F.lit(f"\n{pad}}}"))
    elif isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: F.concat(F.lit(inner), canonical(x, kind.elementType, depth + 1)))
        text = F.when(F.size(value) == 0, F.lit("[]")).otherwise(
            F.concat(F.lit("[\n"), F.array_join(items, ",\n"), F.lit(f"\n{pad}]"))
        )
    else:
        text = _scalar(value, kind)
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def unknown_keys(text: Column, kind: T.DataType, path: str = "") -> Column:
    """Paths of the keys a schema does not know, at every level, as an array."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StructType):
        known = F.array(*[F.lit(name) for name in kind.names])
        extra = F.transform(
            F.array_except(F.coalesce(F.json_object_keys(text), none), known), lambda k: F.concat(F.lit(path), k)
        )
        nested = [
            unknown_keys(F.get_json_object(text, f"$.{field.name}"), field.dataType, f"{path}{field.name}.")
            for field in kind.fields
            if isinstance(field.dataType, (T.StructType, T.ArrayType))
        ]
        return F.concat(extra, *nested)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        items = F.coalesce(F.from_json(text, "array<string>"), none)
        return F.flatten(F.transform(items, lambda item: unknown_keys(item, kind.elementType, path)))
    return none
