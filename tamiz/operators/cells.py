"""Cells of a table as comparable values: cleaning, grouping keys, text form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.predicates import is_semantic_null

# Longer texts are grouped by their SHA-256 so that shuffled keys stay short.
_MAX_KEY_CHARS = 64

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
_NESTED = (T.ArrayType, T.StructType, T.MapType, T.VariantType)


def plain_number(text: Column) -> Column:
    """A double's text without an exponent from 1e-4 up to below 1e16, and with
    one of two digits and a sign outside."""
    parts = r"^(-?)(\d)\.(\d+)E(-?\d+)$"
    part = lambda i: F.regexp_extract(text, parts, i)
    exponent = part(4).cast("int")
    digits = F.concat(part(2), F.when(part(3) == "0", "").otherwise(part(3)))
    size = F.length(digits)
    whole = F.concat(F.rpad(F.substr(digits, F.lit(1), exponent + 1), exponent + 1, "0"), F.lit("."))
    large = F.concat(part(1), whole, F.when(size > exponent + 1, F.substr(digits, exponent + 2)).otherwise("0"))
    small = F.concat(part(1), F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    sign = F.when(exponent < 0, "e-").otherwise("e+")
    mantissa = F.concat(part(2), F.when(part(3) == "0", "").otherwise(F.concat(F.lit("."), part(3))))
    power = F.concat(part(1), mantissa, sign, F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), "0"))
    scientific = F.when((exponent >= 0) & (exponent < 16), large).when((exponent < 0) & (exponent >= -4), small).otherwise(power)
    return F.when(text.rlike(parts), scientific).otherwise(text)


@dataclass(frozen=True)
class Cell:
    """One column of the profiled table."""

    pos: int
    name: str
    dtype: T.DataType

    @property
    def raw(self) -> Column:
        return F.col("`" + self.name.replace("`", "``") + "`")

    @property
    def value(self) -> Column:
        """The value with NaN as null, nested values as JSON."""
        if isinstance(self.dtype, _FLOATING):
            return F.when(~F.isnan(self.raw), self.raw)
        if isinstance(self.dtype, _NESTED):
            return F.to_json(self.raw)
        if isinstance(self.dtype, T.BinaryType):
            return F.hex(self.raw)
        return self.raw

    @property
    def present(self) -> Column:
        if isinstance(self.dtype, _FLOATING):
            return self.raw.isNotNull() & ~F.isnan(self.raw)
        return self.raw.isNotNull()

    @property
    def text(self) -> Column:
        text = self.value.cast("string")
        return plain_number(text) if isinstance(self.dtype, T.DoubleType) else text

    @property
    def is_text(self) -> bool:
        return isinstance(self.dtype, (T.StringType, *_NESTED))

    @property
    def family(self) -> str:
        """Common type under which columns are counted together."""
        if isinstance(self.dtype, (*_INTEGRAL, T.BooleanType, T.DateType)):
            return "bigint"
        if isinstance(self.dtype, _FLOATING):
            return "double"
        if isinstance(self.dtype, (T.TimestampType, T.TimestampNTZType)):
            return self.dtype.simpleString()
        return "string"

    @property
    def key(self) -> Column:
        """Grouping key in the type of the family; equal exactly when the
        values are equal."""
        if isinstance(self.dtype, T.DateType):
            return F.unix_date(self.raw).cast("bigint")
        if self.family != "string":
            return self.value.cast(self.family)
        return short_key(self.text)

    @property
    def built_in_type(self) -> str | None:
        """Inferred type that the physical type settles by itself."""
        if isinstance(self.dtype, _INTEGRAL):
            return "numeric_int"
        if isinstance(self.dtype, _FLOATING):
            return "numeric_float"
        if isinstance(self.dtype, T.DecimalType):
            return "numeric_float" if self.dtype.scale > 0 else "numeric_int"
        if isinstance(self.dtype, T.BooleanType):
            return "boolean"
        if isinstance(self.dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "date"
        return None


def short_key(text: Column) -> Column:
    """The text itself, or its SHA-256 when it is long, marked by whether the
    text is a semantic null. The marked form is longer than any text kept as it
    is, so the two cannot meet."""
    mark = F.when(is_semantic_null(text), "null:").otherwise("text:")
    return F.when(F.length(text) <= _MAX_KEY_CHARS, text).otherwise(
        F.concat(mark, F.sha2(text, 256))
    )


def is_semantic_null_key(key: Column) -> Column:
    return F.when(F.length(key) <= _MAX_KEY_CHARS, is_semantic_null(key)).otherwise(
        key.startswith("null:")
    )


def cells_of(df: DataFrame) -> list[Cell]:
    return [Cell(i, f.name, f.dataType) for i, f in enumerate(df.schema.fields)]


def long_form(df: DataFrame, key: str, values: dict, value: str = "value") -> DataFrame:
    """``(key, value)``: one row per row and entry of ``values`` (key literal to
    Column), without the nulls. Meant for costly expressions over ``value``:
    they are compiled once, whatever the number of columns."""
    pairs = [F.struct(F.lit(k).alias(key), v.alias(value)) for k, v in values.items()]
    return df.select(F.inline(F.array(*pairs))).where(F.col(value).isNotNull())
