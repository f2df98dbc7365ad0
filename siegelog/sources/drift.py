"""Union of Parquet files whose columns changed their type over time.

``mergeSchema`` fails where one file has a column as a number and another as text. Here
each column gets the least type that holds what all files have, along a lattice, and
each group of files with one schema is cast to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Each chain from narrow to wide; types of different chains meet in text.
NUMBERS = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DoubleType())
TIMES = (T.DateType(), T.TimestampNTZType(), T.TimestampType())


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that holds the values of both.

    Integers widen to BIGINT; with FLOAT, DOUBLE or DECIMAL they meet in DOUBLE (of
    decimals of one scale, in the wider decimal); dates and times in the wider one;
    structs and arrays by their parts; everything else in text.
    """
    if a == b:
        return a
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType) and a.scale == b.scale:
        return a if a.precision >= b.precision else b
    numeric = lambda t: T.DoubleType() if isinstance(t, (T.FloatType, T.DecimalType)) else t
    for chain in (NUMBERS, TIMES):
        x, y = (numeric(t) if chain is NUMBERS else t for t in (a, b))
        if x in chain and y in chain:
            return max(x, y, key=chain.index)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return wider_schema([a, b])
    return T.StringType()


def wider_schema(schemas: list[T.StructType]) -> T.StructType:
    """Columns by name (in any case), in the order they first appear, each with the type that holds all."""
    found: dict[str, tuple[str, T.DataType]] = {}
    for schema in schemas:
        for field in schema.fields:
            key = field.name.lower()
            name, kind = found.get(key, (field.name, field.dataType))
            found[key] = name, wider(kind, field.dataType)
    return T.StructType([T.StructField(name, kind) for name, kind in found.values()])


def _text(value: Column, kind: T.DataType) -> Column:
    """A number, date or flag as text; a whole DOUBLE without a fraction, as an integer file would have it."""
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < F.lit(2.0**53))
        return F.when(whole, value.cast("decimal(20,0)").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def fitted(value: Column, kind: T.DataType, wanted: T.DataType) -> Column:
    """A value of one type in a wider one."""
    if kind == wanted:
        return value
    if isinstance(wanted, T.StringType):
        return _text(value, kind)
    if isinstance(wanted, T.StructType) and isinstance(kind, T.StructType):
        own = {f.name.lower(): f for f in kind.fields}
        parts = [
            (fitted(value[own[f.name.lower()].name], own[f.name.lower()].dataType, f.dataType) if f.name.lower() in own else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in wanted.fields
        ]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(wanted, T.ArrayType) and isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: fitted(x, kind.elementType, wanted.elementType))
    return value.cast(wanted)


def read_drifting(spark: SparkSession, *paths: str) -> tuple[DataFrame, T.StructType]:
    """All rows of the given files or folders, each of one schema, and the schema chosen.

    Schemas are read from footers. Paths with the same schema are read together, so the
    plan grows with the number of schemas, not of files.
    """
    if not paths:
        raise ValueError("no paths")
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    schemas = []
    for path in paths:
        schema = spark.read.parquet(path).schema
        schemas.append(schema)
        groups.setdefault(schema.json(), (schema, []))[1].append(path)
    wanted = wider_schema(schemas)
    parts = []
    for schema, own in groups.values():
        have = {f.name.lower(): f for f in schema.fields}
        columns = []
        for field in wanted.fields:
            known = have.get(field.name.lower())
            value = fitted(F.col(f"`{known.name}`"), known.dataType, field.dataType) if known else F.lit(None).cast(field.dataType)
            columns.append(value.alias(field.name))
        parts.append(spark.read.schema(schema).parquet(*own).select(*columns))
    return reduce(DataFrame.unionByName, parts), wanted


def chosen_types(spark: SparkSession, *paths: str) -> DataFrame:
    """``column, types, chosen``: the types the files have, in order, and the one that holds them all."""
    schemas = [spark.read.parquet(path).schema for path in paths]
    rows = []
    for field in wider_schema(schemas).fields:
        own = sorted({f.dataType.simpleString() for s in schemas for f in s.fields if f.name.lower() == field.name.lower()})
        rows.append((field.name, ",".join(own), field.dataType.simpleString()))
    return spark.createDataFrame(rows, "column string, types string, chosen string")
