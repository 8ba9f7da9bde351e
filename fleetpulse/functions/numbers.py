"""Reading numbers out of semi-structured metrics.

The same JSON value means different things to different readers, so there are four
named readings and no shared default:

* ``sql_number``       rollup: numeric text counts, anything else is no value
* ``strict_number``    alert rules: JSON numbers only
* ``number_or_zero``   time series: JSON numbers, otherwise 0
* ``present_or_zero``  summaries: as above, but a missing key is no sample at all
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES = "decimal(20,0)"


def json_type(v: Column, path: str) -> Column:
    """Type name of the value at ``path``: VOID for JSON null, SQL NULL when the key is missing."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def is_number(v: Column, path: str) -> Column:
    return F.substring_index(json_type(v, path), "(", 1).isin("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")


def sql_number(v: Column, path: str, strict_cast: bool = False) -> Column:
    """Numbers and numeric text; booleans and junk are NULL, or an error with ``strict_cast``."""
    boolean = json_type(v, path) == "BOOLEAN"
    if strict_cast:
        return F.when(boolean, F.raise_error(F.lit(f"boolean at {path}")).cast("double")).otherwise(
            F.variant_get(v, path, "double")
        )
    return F.when(F.coalesce(~boolean, F.lit(True)), F.try_variant_get(v, path, "double"))


def strict_number(v: Column, path: str) -> Column:
    return F.when(is_number(v, path), F.try_variant_get(v, path, "double"))


def number_or_zero(v: Column, path: str) -> Column:
    return F.coalesce(strict_number(v, path), F.lit(0.0))


def present_or_zero(v: Column, path: str) -> Column:
    return F.when(json_type(v, path).isNotNull(), number_or_zero(v, path))


def elements(v: Column, path: str) -> Column:
    """The JSON array at ``path`` as ARRAY<VARIANT>; empty when it is anything else."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def clamped_whole(c: Column) -> Column:
    """BIGINT of a double, the fraction dropped; values outside its range read as the nearest bound."""
    low, high = F.lit(-(2**63)).cast("bigint"), F.lit(2**63 - 1).cast("bigint")
    return F.when(c >= 2.0**63, high).when(c < -(2.0**63), low).otherwise(F.coalesce(c.try_cast("bigint"), F.lit(0)))


def whole(v: Column) -> Column:
    """BIGINT reading of a scalar: whole numbers, also as text; fractions and junk are NULL."""
    kind = F.schema_of_variant(v)
    exact = F.try_variant_get(v, "$", "decimal(38,6)")
    return F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint")).when(
        kind != "BOOLEAN", F.when(exact == F.floor(exact), exact).try_cast("bigint")
    )


def truncated(v: Column) -> Column:
    """Unsigned reading of a scalar JSON number: fraction dropped, negatives 0, no number NULL."""
    kind = F.schema_of_variant(v)
    not_below_zero = lambda c: F.greatest(c, F.lit(0))
    return (
        F.when(kind == "BIGINT", not_below_zero(F.try_variant_get(v, "$", "bigint")).cast(BYTES))
        .when(
            F.substring_index(kind, "(", 1).isin("DOUBLE", "FLOAT", "DECIMAL"),
            not_below_zero(F.floor(F.try_variant_get(v, "$", "decimal(38,6)"))).try_cast(BYTES),
        )
    )


def _array_sum(v: Column, array_path: str, field: str, reading, result_type: str) -> Column:
    """Sum of one reading of a field over a JSON array; elements without it add nothing."""
    values = F.transform(elements(v, array_path), lambda x: F.try_variant_get(x, f"$.{field}", "variant"))
    zero = F.lit(0).cast(result_type)
    return F.aggregate(
        values,
        zero,
        lambda acc, x: F.coalesce((acc + reading(x).cast(result_type)).cast(result_type), acc),
    )


def strict_whole(v: Column) -> Column:
    """As ``whole``, but a value that is there and is no whole number is an error."""
    there = v.isNotNull() & ~F.is_variant_null(v)
    bad = F.raise_error(F.lit("no whole number")).cast("bigint")
    return F.when(there & whole(v).isNull(), bad).otherwise(whole(v))


def sum_whole(v: Column, array_path: str, field: str, strict_cast: bool = False) -> Column:
    """Sum of a BIGINT field over a JSON array, wide enough not to overflow per row."""
    return _array_sum(v, array_path, field, strict_whole if strict_cast else whole, "decimal(38,0)")


def sum_bytes(v: Column, array_path: str, field: str) -> Column:
    """Sum of an unsigned field over a JSON array, truncated per element; wider than the elements."""
    return _array_sum(v, array_path, field, truncated, "decimal(38,0)")


def root_partition_percent(v: Column, partitions_path: str, strict_cast: bool = False) -> Column:
    """``used_percent`` of the first partition mounted at ``/``, NULL when there is none."""
    mounted = F.filter(
        elements(v, partitions_path),
        lambda p: F.try_variant_get(p, "$.mountpoint", "string") == "/",
    )
    return sql_number(F.try_element_at(mounted, F.lit(1)), "$.used_percent", strict_cast)


def disk_values(v: Column, disk_path: str, partitions_path: str) -> Column:
    """All disk percentages of a record: the top-level one first, then each numeric partition."""
    return F.array_compact(
        F.concat(
            F.array(present_or_zero(v, disk_path)),
            F.transform(elements(v, partitions_path), lambda p: strict_number(p, "$.used_percent")),
        )
    )
