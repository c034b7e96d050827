"""Kinds of columns and the casts between them.

Kinds are the five of a schema - string, integer, number, boolean, date - and
"other". A cast that can't be made gives null, except where noted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, INTEGER, NUMBER, BOOLEAN, DATE, OTHER = "string", "integer", "number", "boolean", "date", "other"

#: What counts as true and as false.
TRUE_WORDS = ["true", "1", "yes", "t", "on"]
FALSE_WORDS = ["false", "0", "no", "f", "off"]

NUMERAL = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"

#: Strftime fields as java.time patterns, for writing; reading takes one digit where two may be.
_FIELDS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "f": "SSSSSS", "p": "a", "I": "hh", "j": "DDD"}
_SHORT = {"m": "M", "d": "d", "H": "H", "I": "h"}


def kind_of(data_type: T.DataType) -> str:
    """The kind that a Spark type is."""
    if isinstance(data_type, T.StringType):
        return STRING
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return INTEGER
    if isinstance(data_type, T.NumericType):
        return NUMBER
    if isinstance(data_type, T.DateType | T.TimestampType | T.TimestampNTZType):
        return DATE
    return OTHER


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def java_format(fmt: str, reading: bool = False) -> str:
    """A strftime format as a java.time pattern; literal letters are quoted."""
    out, i = "", 0
    while i < len(fmt):
        c = fmt[i]
        if c == "%" and i + 1 < len(fmt):
            i += 1
            field = fmt[i]
            if field == "%":
                out += "%"
            elif field in _FIELDS:
                out += _SHORT.get(field, _FIELDS[field]) if reading else _FIELDS[field]
            else:
                raise ValueError(f"no such date field: %{field}")
        elif c == "'":
            out += "''"
        else:
            out += f"'{c}'" if c.isalpha() else c
        i += 1
    return out


def named(c: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + c.replace("`", "``") + "`")


def text(c: Column, kind: str) -> Column:
    return c if kind == STRING else c.cast("string")


def to_number(c: Column, kind: str) -> Column:
    """Double; text must be a plain numeral, and NaN is null."""
    if kind == STRING:
        return F.when(c.rlike(NUMERAL), F.expr("1D") * F.trim(c).try_cast("double"))
    if kind == DATE:
        return F.unix_micros(c.cast("timestamp")).cast("double") * 1000
    d = c.cast("double")
    return F.when(~F.isnan(d), d) if kind == NUMBER else d


def to_integer(c: Column, kind: str) -> Column:
    """Long; a numeral with a fraction raises."""
    if kind == INTEGER:
        return c.cast("long")
    d = to_number(c, kind)
    broken = F.raise_error(F.concat(F.lit("not a whole number: "), d.cast("string"))).cast("long")
    return F.when(d != F.floor(d), broken).otherwise(d.try_cast("long"))


def to_boolean(c: Column, kind: str) -> Column:
    """The usual words and 0 and 1; anything else is null."""
    if kind == BOOLEAN:
        return c
    word = F.lower(F.trim(text(c, kind)))
    if kind == NUMBER:
        word = F.when(c == 1, "1").when(c == 0, "0")
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def to_date(c: Column, kind: str, fmt: str | None = None) -> Column:
    """A timestamp without zone; without a format ISO dates and times are read."""
    if kind == DATE:
        return c.cast("timestamp_ntz")
    s = text(c, kind)
    read = F.try_to_timestamp(s, F.lit(java_format(fmt, reading=True))) if fmt else F.try_to_timestamp(s)
    return read.cast("timestamp_ntz")


def cast(c: Column, kind: str, to: str, fmt: str | None = None) -> Column:
    """``c`` of ``kind`` as ``to``."""
    if to == INTEGER:
        return to_integer(c, kind)
    if to in (NUMBER, "float"):
        return to_number(c, kind)
    if to == BOOLEAN:
        return to_boolean(c, kind)
    if to == DATE:
        return to_date(c, kind, fmt)
    return text(c, kind)


def enforce(df: DataFrame, aliases: dict[str, dict]) -> DataFrame:
    """The declared columns that ``df`` has, in their declared types."""
    have = kinds(df)
    return df.withColumns({name: cast(named(name), have[name], spec["type"], spec.get("date", {}).get("format")) for name, spec in aliases.items() if name in have})


def coerce(df: DataFrame, aliases: dict[str, dict]) -> DataFrame:
    """As ``enforce``, but text doesn't become boolean: that raises."""
    have = kinds(df)
    for name, spec in aliases.items():
        if name in have and spec["type"] == BOOLEAN and have[name] == STRING:
            raise TypeError(f"text column {name} can't be taken as boolean in a union")
    return enforce(df, {k: {"type": v["type"]} for k, v in aliases.items()})
