"""Schema inference over a column of JSON text."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def infer_json_schema(df: DataFrame, column: str) -> T.StructType:
    """The merged schema of all JSON objects in ``column``; malformed texts are passed over.

    One aggregate with map-side combining; only the schema reaches the driver.
    """
    document = F.try_parse_json(F.col(column).cast("string"))
    found = df.agg(F.schema_of_variant_agg(document).alias("found")).first()["found"]
    if not found.startswith("OBJECT<"):
        raise ValueError(f"{column} holds no JSON objects, but {found}")
    return _with_doubles(T.StructType.fromDDL(_NAMES.sub(_spark_type, found)))


# Quoted field names are matched first so that text inside them is left alone; a name before a colon is
# a field, not a type.
_NAMES = re.compile(r"`(?:[^`]|``)*`|\bOBJECT(?=<)|\bVOID\b(?!:)")


def _spark_type(match: re.Match) -> str:
    return {"OBJECT": "STRUCT", "VOID": "STRING"}.get(match.group(), match.group())


def _with_doubles(kind: T.DataType) -> T.DataType:
    """JSON fractions are doubles, not decimals of the width of the values seen so far."""
    if isinstance(kind, T.DecimalType):
        return T.DoubleType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_with_doubles(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _with_doubles(f.dataType)) for f in kind.fields])
    return kind
