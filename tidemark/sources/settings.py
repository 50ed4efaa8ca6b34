"""JSON files as variants: notebooks and settings, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(content: Column) -> Column:
    """A file's bytes or text as a variant; null if it isn't JSON."""
    return F.try_parse_json(F.make_valid_utf8(content.cast("string")))


def notebook_text(content: Column, most: int) -> Column:
    """Markdown cells whole, the first three lines of others, one after the other, up to ``most``
    characters. Empty for what isn't a notebook."""
    cells = F.try_variant_get(parsed(content), "$.cells", "array<variant>")

    def part(cell: Column) -> Column:
        lines, one = F.try_variant_get(cell, "$.source", "array<string>"), F.try_variant_get(cell, "$.source", "string")
        source = F.coalesce(F.array_join(lines, ""), one, F.lit(""))
        return F.when(F.try_variant_get(cell, "$.cell_type", "string") == "markdown", source).otherwise(F.substring_index(source, "\n", 3))

    return F.coalesce(F.substring(F.array_join(F.transform(cells, part), "\n"), 1, most), F.lit(""))


def settings(content: Column, **defaults: object) -> Column:
    """A struct of settings: those of the JSON object in ``content`` where it has them in the type of the
    default, else the defaults. Types are those of the defaults: boolean, number, text or a list of texts."""
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string", list: "array<string>"}
    found = parsed(content)

    def one(name: str, default: object) -> Column:
        held = F.try_variant_get(found, f"$['{name}']", kinds[type(default)])
        typed = F.array(*map(F.lit, default)).cast("array<string>") if isinstance(default, list) else F.lit(default)
        return F.coalesce(held, typed).alias(name)

    return F.struct(*[one(k, v) for k, v in defaults.items()])
