"""Column functions with the engine's own rules: checked numbers, money, units, keyed draws, missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seven ways in which a value can be there or not. Fixed values.
MISSING_STATES = ("Present", "NotObserved", "NotApplicable", "Unknown", "Redacted", "Invalid", "Pending")


def cents(amount: Column) -> Column:
    """Money as whole minor units."""
    return F.round(amount * 100).cast("long")


def checked(op: str, a: Column, b: Column) -> Column:
    """struct(ok, err): the result, or which fault this row has. Null operands give neither."""
    if op not in ("add", "subtract", "multiply", "divide"):
        raise ValueError(f"unknown operation {op}")
    ok = {"add": F.try_add, "subtract": F.try_subtract, "multiply": F.try_multiply, "divide": F.try_divide}[op](a, b)
    fault = "DivisionByZero" if op == "divide" else "Overflow"
    err = F.when(a.isNotNull() & b.isNotNull() & ok.isNull(), F.lit(fault))
    return F.struct(ok.alias("ok"), err.alias("err"))


def keyed_draw(key: Column, seed: int) -> Column:
    """A number in 0..2^32-1 that depends on the key and the seed alone, never on partitions."""
    digest = F.sha2(F.concat(key.cast("string"), F.lit(f":{seed}")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def skolem(rule: str, *keys: Column) -> Column:
    """A derived identity: the same rule and keys always give the same id. Null keys are refused.

    Each key stands after its length, so that no two lists of keys read the same.
    """
    parts = [F.coalesce(k.cast("string"), F.raise_error(F.lit(f"unbound key in {rule}")).cast("string")) for k in keys]
    return F.sha2(F.concat_ws("|", F.lit(rule), *[F.concat(F.char_length(p), F.lit(":"), p) for p in parts]), 256)


def missing(value: Column, state: Column) -> Column:
    """struct(state, value): a value is there only if the state is Present."""
    return F.struct(state.alias("state"), F.when(state == "Present", value).alias("value"))


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def one_of(tag: Column, arms: dict[str, Column]) -> Column:
    """A match over tags; a tag without an arm is an error, not NULL."""
    out = None
    for name, value in arms.items():
        out = F.when(tag == name, value) if out is None else out.when(tag == name, value)
    return out.otherwise(F.raise_error(F.concat(F.lit("NoMatchingArm: "), F.coalesce(tag, F.lit("null")))))


def same_unit(a: dict, b: dict) -> None:
    """Refuse to add or compare columns of unlike dimensions; the exponents stand in the metadata."""
    if a.get("dimension") != b.get("dimension"):
        raise TypeError(f"unlike dimensions: {a.get('dimension')} and {b.get('dimension')}")


#: Units with their dimension and what one of them is in the dimension's base unit. Fixed values.
UNITS = {"m": ("length", 1.0), "mm": ("length", 0.001), "in": ("length", 0.0254), "s": ("time", 1.0), "h": ("time", 3600.0), "kg": ("mass", 1.0), "g": ("mass", 0.001)}


def with_unit(column: Column, name: str, unit: str) -> Column:
    """A column that carries its unit in its metadata, through every plan and file."""
    return column.alias(name, metadata={"unit": unit, "dimension": UNITS[unit][0]})


def converted(rows, name: str, to: str) -> Column:
    """The column in another unit of the same dimension; one without a unit, or of another dimension, is refused."""
    own = rows.schema[name].metadata
    same_unit(own, {"dimension": UNITS[to][0]})
    return with_unit(F.col(name) * F.lit(UNITS[own["unit"]][1]) / F.lit(UNITS[to][1]), name, to)
