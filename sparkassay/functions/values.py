"""Column helpers shared by every operator: what counts as missing, how a value becomes a number,
a grouping key or text, and which columns of a table are numeric or text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Strings longer than this are grouped and shuffled by digest instead of by their whole text.
DIGEST_ABOVE = 64

_FRACTIONAL = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# Texts that are numbers. Checked before the cast: a failed cast costs far more than a failed match.
_DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def value(df: DataFrame, name: str) -> Column:
    """The column with every missing value as NULL (NaN counts as missing)."""
    if isinstance(data_type(df, name), _FRACTIONAL):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def present(df: DataFrame, name: str) -> Column:
    """True where the cell holds a value: neither NULL nor NaN."""
    if isinstance(data_type(df, name), _FRACTIONAL):
        return col(name).isNotNull() & ~F.isnan(col(name))
    return col(name).isNotNull()


def number(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE; whatever does not parse as a number is missing (NULL)."""
    kind = data_type(df, name)
    if isinstance(kind, _FRACTIONAL):
        return value(df, name).cast("double")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return col(name).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(col(name).cast("timestamp")).cast("double")
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        infinite = F.when(F.contains(col(name), F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
        return F.when(col(name).rlike(_DECIMAL), col(name).try_cast("double")).when(
            col(name).rlike(_INFINITE), infinite
        )
    return F.lit(None).cast("double")


def text(df: DataFrame, name: str) -> Column:
    """The present values as text."""
    kind = data_type(df, name)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col(name))
    return value(df, name).cast("string")


def key(df: DataFrame, name: str) -> Column:
    """A grouping key equal exactly where the values are equal, NULL where the value is missing.

    Long strings are replaced by a SHA-256 digest (marked, so that no short text can equal one):
    grouping whole documents then shuffles 64 characters a row, not the documents.
    """
    kind = data_type(df, name)
    if isinstance(kind, _FRACTIONAL):
        return value(df, name) + F.lit(0.0)  # -0.0 and 0.0 are one value
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        whole = col(name)
    elif isinstance(kind, T.BinaryType):
        whole = F.base64(col(name))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        whole = F.to_json(col(name))
    else:
        return col(name)
    return F.when(F.length(whole) > DIGEST_ABOVE, F.concat(F.lit("#"), F.sha2(whole, 256))).otherwise(
        F.concat(F.lit("="), whole)
    )


def canonical_number(df: DataFrame, name: str) -> Column:
    """A number as one text whatever its type: sign, digits without zeros at the ends, and the place of the point. A DOUBLE
    stands for its shortest decimal text, so 0.1 equals the decimal 0.10, and 9007199254740993 no DOUBLE."""
    number = value(df, name)
    if isinstance(data_type(df, name), T.FloatType):
        number = number.cast("double")
    shown = F.upper(number.cast("string"))
    part = [F.regexp_extract(shown, r"^-?([0-9]+)(?:\.([0-9]*))?(?:E([+-]?[0-9]+))?$", i) for i in (1, 2, 3)]
    digits = F.concat(part[0], part[1])
    ahead = F.regexp_replace(digits, "^0+", "")  # digits from the first that counts on
    place = F.coalesce(part[2].try_cast("int"), F.lit(0)) + F.length(part[0]) - (F.length(digits) - F.length(ahead))
    sign = F.when(F.startswith(shown, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    written = F.concat(sign, F.regexp_replace(ahead, "0+$", ""), F.lit("e"), place.cast("string"))
    # what has no digits is infinite
    return F.when(digits == "", shown).when(ahead == "", F.lit("0")).otherwise(written)


def key_lane(df: DataFrame, name: str) -> tuple[str, Column]:
    """`key` cast to one of three lanes (long, double, string), so that the values of many columns
    fit one long table without turning numbers into text."""
    kind = data_type(df, name)
    if isinstance(kind, INTEGRAL):
        return "long", col(name).cast("long")
    if isinstance(kind, T.BooleanType):
        return "long", col(name).cast("int").cast("long")
    if isinstance(kind, T.DateType):
        return "long", F.unix_date(col(name)).cast("long")
    if isinstance(kind, T.TimestampType):
        return "long", F.unix_micros(col(name))
    if isinstance(kind, _FRACTIONAL):
        return "double", key(df, name).cast("double")
    return "string", key(df, name).cast("string")


def numeric_columns(df: DataFrame) -> list[str]:
    """Number columns; booleans are not numbers here."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def names_containing(names: Sequence[str], keywords: Sequence[str]) -> list[str]:
    """The names that contain one of the keywords, ignoring case."""
    return [n for n in names if any(k in n.lower() for k in keywords)]


def flatten_struct(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested struct fields as dotted columns; arrays stay as they are."""

    def leaves(fields, path=()):
        for field in fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType.fields, here)
            else:
                nested = col(here[0])
                for part in here[1:]:
                    nested = nested.getField(part)
                yield nested.alias(separator.join(here))

    if not any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        return df
    return df.select(*leaves(df.schema.fields))


def plain_value(df: DataFrame, name: str) -> Column:
    """A JSON-friendly form: decimals as numbers, dates and times as ISO text, bytes as UTF-8 text
    without the bytes that are not UTF-8."""
    kind = data_type(df, name)
    if isinstance(kind, T.DecimalType):
        return col(name).cast("long" if kind.scale == 0 and kind.precision <= 18 else "double")
    if isinstance(kind, T.DateType):
        return F.date_format(col(name), "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(col(name), "yyyy-MM-dd'T'HH:mm:ss")
        fraction = F.date_format(col(name), "SSSSSS")
        return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))
    if isinstance(kind, T.BinaryType):
        # An invalid byte becomes U+FFFD in a lenient decode and is then taken out.
        return F.replace(F.make_valid_utf8(col(name).cast("string")), F.lit("\ufffd"), F.lit(""))
    return col(name)


def serialize_rows(df: DataFrame) -> DataFrame:
    """Every column in its JSON-friendly form."""
    return df.select(*(plain_value(df, f.name).alias(f.name) for f in df.schema.fields))


def rows_as_json(df: DataFrame, binary_as_base64: bool = False) -> DataFrame:
    """One JSON object per row, in a column `json`."""
    cells = []
    for field in df.schema.fields:
        if binary_as_base64 and isinstance(field.dataType, T.BinaryType):
            cells.append(F.base64(col(field.name)).alias(field.name))
        else:
            cells.append(plain_value(df, field.name).alias(field.name))
    return df.select(F.to_json(F.struct(*cells)).alias("json"))
