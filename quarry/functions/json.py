"""Typed access to JSON text: a value, its default, or what is wrong with it, as Column expressions over the variant type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a type accepts: the beginning of the variant's own type.
KINDS = {"string": ("STRING",), "long": ("BIGINT",), "double": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}


def typed(text: Column, path: str, kind: str, default: Column | None = None) -> Column:
    """A struct (value, error) of what stands at ``path`` of a JSON text, as ``$.a.b[0]``.

    A missing value is ``default``, or the error ``missing`` if there is none; a JSON null counts as missing. A value of another type is the
    error ``not a <kind>``, and never its default. Text that isn't JSON is the error ``no JSON``; a null text is missing.
    Whole numbers are doubles too. ``object`` and ``array`` give JSON text.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    whole = F.try_parse_json(text)
    at = F.try_variant_get(whole, path, "variant")
    absent = at.isNull() | F.coalesce(F.is_variant_null(at), F.lit(False))
    own = F.schema_of_variant(at)
    fits = F.lit(False)
    for k in KINDS[kind]:
        fits = fits | own.startswith(k)
    plain = kind in ("object", "array")
    value = F.to_json(at) if plain else F.try_variant_get(whole, path, "bigint" if kind == "long" else kind)
    broken = text.isNotNull() & whole.isNull()
    error = F.when(broken, "no JSON").when(absent, None if default is not None else "missing").when(~fits, f"not a {kind}")
    other = default if default is not None else F.lit(None)
    out = F.when(~broken & ~absent & fits, value).when(~broken & absent, other.cast("string" if plain else kind))
    return F.struct(out.alias("value"), error.alias("error"))
