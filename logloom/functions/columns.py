"""Column builders used in mappings: reading nested values, choosing, composing text, looking up, building objects."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.convert import url_parts
from logloom.functions.emptiness import present
from logloom.functions.patterns import search, to_java

MAX_LITERAL_TABLE = 500  # larger tables belong in a DataFrame, see operators.joins.attach


def field(path: str, dtype: T.DataType | None = None) -> Column:
    """Dotted read through structs, maps and arrays; a numeric step is a list position, negative from the end.

    `dtype` is the type of the column named first. Without it every step must be a struct field or a map key. Inside a
    VARIANT the rest of the path is read as one variant path; a negative position there goes through an array.
    """
    head, *rest = path.split(".")
    col, kind = F.col(f"`{head}`"), dtype
    for i, step in enumerate(rest):
        number = step.lstrip("-").isdigit()
        if isinstance(kind, T.VariantType):
            return _variant_path(col, rest[i:])
        if isinstance(kind, T.ArrayType):
            col, kind = F.try_element_at(col, F.lit(int(step) + (int(step) >= 0))), kind.elementType
        elif isinstance(kind, T.MapType):
            col, kind = F.try_element_at(col, F.lit(step)), kind.valueType
        elif isinstance(kind, T.StructType):
            col, kind = col.getField(step), kind[step].dataType
        elif number:
            col = F.try_element_at(col, F.lit(int(step) + (int(step) >= 0)))
        else:
            col = col.getItem(step)
    return col


def _variant_path(col: Column, steps: list[str]) -> Column:
    for n, step in enumerate(steps):
        if step.startswith("-") and step[1:].isdigit():
            items = F.try_variant_get(_variant_path(col, steps[:n]) if n else col, "$", "array<variant>")
            item = F.try_element_at(items, F.lit(int(step)))
            return _variant_path(item, steps[n + 1:]) if steps[n + 1:] else item
    path = "$" + "".join(f"[{s}]" if s.isdigit() else f'["{s}"]' for s in steps)
    return F.try_variant_get(col, path, "variant")


def variant_text(col: Column, path: str) -> Column:
    """Text of a dotted path inside a variant; '' and '-' become NULL."""
    return present(F.try_variant_get(_variant_path(col, path.split(".")), "$", "string"))


def const(value) -> Column:
    return F.lit(value)


def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[present(c) for c in cols])


_HOLE = re.compile(r"\{([\w.$-]+)\}")


def template(text: str, resolve: Mapping[str, Column] | Callable[[str], Column] | None = None, strict: bool = False) -> Column:
    """Text with `{name}` holes. An empty part becomes '', the result is trimmed; `strict` gives NULL for an empty part."""
    get = resolve.__getitem__ if isinstance(resolve, Mapping) else (resolve or F.col)
    parts, holes, pos = [], [], 0
    for m in _HOLE.finditer(text):
        value = present(get(m.group(1)).cast("string"))
        parts += [F.lit(text[pos:m.start()]), F.coalesce(value, F.lit(""))]
        holes.append(value)
        pos = m.end()
    out = F.btrim(F.concat(*parts, F.lit(text[pos:])), F.lit(" \t\r\n"))
    if strict and holes:
        complete = holes[0].isNotNull()
        for h in holes[1:]:
            complete = complete & h.isNotNull()
        return F.when(complete, out)
    return out


def lookup(col: Column, table: Mapping, default=None, default_from: Column | None = None) -> Column:
    """Value of a small fixed table by text key; `default` also when the key is NULL, then `default_from`."""
    if len(table) > MAX_LITERAL_TABLE:
        raise ValueError(f"{len(table)} entries: join a DataFrame instead of a literal table")
    pairs = [x for k, v in table.items() for x in (F.lit(str(k)), F.lit(v))]
    steps = [F.try_element_at(F.create_map(*pairs), col.cast("string"))] if pairs else []
    if default is not None:
        steps.append(F.lit(default))
    if default_from is not None:
        steps.append(default_from)
    return F.coalesce(*steps) if steps else F.lit(None).cast("string")


def regex_group(col: Column, pattern: str, group: int = 1) -> Column:
    """One group of the first match; NULL without a match or when the group is empty."""
    java, _ = to_java(pattern)
    return present(F.get(search(col, "(?sU)(" + java.removeprefix("(?sU)") + ")"), F.lit(group)))


def url_struct(col: Column) -> Column:
    return url_parts(col)


def _filled(col: Column) -> Column:
    """A value of any type, NULL when its text is '' or '-'."""
    return F.when(~col.cast("string").isin("", "-"), col)


def obj(**members: Column) -> Column:
    """Struct of the members, empty ones as NULL; NULL when all are empty, so that nothing empty is written."""
    full = {k: _filled(c) for k, c in members.items()}
    return F.when(F.coalesce(*[F.when(c.isNotNull(), True) for c in full.values()]), F.struct(*[c.alias(k) for k, c in full.items()]))


def list_of(*cols: Column) -> Column:
    """Array of the values that are not empty; NULL when none is left."""
    kept = F.filter(F.array(*cols), lambda x: _filled(x).isNotNull())
    return F.when(F.size(kept) > 0, kept)


def with_default(col: Column, value) -> Column:
    return F.coalesce(_filled(col), F.lit(value))
