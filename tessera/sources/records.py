"""JSON documents as records, and configurations."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.records import Config, detect
from tessera.sources import arrays
from tessera.sources.paths import read_text

#: Bytes of a document that is read as one row, at most, if it can be split.
WHOLE_BYTES = 16 << 20


def plain(kind: T.DataType) -> T.DataType:
    """What a discovered type is read as: decimals as doubles, values of several types and values that are always null as text."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, plain(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(plain(kind.elementType))
    if isinstance(kind, T.DecimalType):
        return T.DoubleType()
    return T.StringType() if isinstance(kind, T.NullType | T.VariantType) else kind


def discovered(records: DataFrame) -> T.StructType:
    """The fields of all records (variants), at any depth, by one aggregation; names are quoted in what it gives."""
    found = records.agg(F.schema_of_variant_agg("record").alias("s")).first()["s"]
    if not found or not found.startswith("OBJECT"):
        return T.StructType()
    quoted_or_not = re.split(r"(`(?:[^`]|``)*`)", found)
    return plain(T._parse_datatype_string("".join(x if k % 2 else re.sub(r"\bOBJECT\b", "STRUCT", x) for k, x in enumerate(quoted_or_not))))


def in_ddl(kind: T.DataType) -> str:
    """A type in DDL, with names quoted."""
    if isinstance(kind, T.StructType):
        fields = [f"`{f.name.replace('`', '``')}`: {in_ddl(f.dataType)}" for f in kind]
        return f"struct<{', '.join(fields)}>"
    return f"array<{in_ddl(kind.elementType)}>" if isinstance(kind, T.ArrayType) else kind.simpleString()


def records_of(documents: DataFrame, column: str = "value") -> DataFrame:
    """record (variant, an object) of each record in JSON texts; those that are no objects get one field, value."""
    return objects(detect(documents, column))


def objects(found: DataFrame) -> DataFrame:
    wrapped = F.parse_json(F.concat(F.lit('{"value":'), F.to_json("record"), F.lit("}")))
    return found.select(F.when(F.schema_of_variant("record").startswith("OBJECT"), F.col("record")).otherwise(wrapped).alias("record"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON document (one for each file), each under its own wrapping key, with the fields that any of them has.

    Records are parsed once; their fields are taken out of the parsed form. Records that are no objects have one field, value.
    A file of more than WHOLE_BYTES that is an array is read in splits; other documents are rows.
    """
    sizes = spark.read.format("binaryFile").load(path).select("path", "length")
    large = [r["path"] for r in sizes.filter(F.col("length") > WHOLE_BYTES).collect()]
    large = [p for p in large if arrays.begins_with_bracket(spark, p)]
    if large:
        found = objects(arrays.elements(spark, large))
        others = [r["path"] for r in sizes.filter(~F.col("path").isin(large)).collect()]
        if others:
            found = found.unionByName(records_of(spark.read.text(others, wholetext=True)))
    else:
        found = records_of(spark.read.text(path, wholetext=True))
    schema = discovered(found)
    if not schema.fields:
        return spark.createDataFrame([], "value string")
    return found.select(F.try_variant_get("record", "$", in_ddl(schema)).alias("r")).select("r.*")


def unreadable_documents(spark: SparkSession, path: str) -> int:
    """Files that are no JSON, and so have no records."""
    return spark.read.text(path, wholetext=True).filter(F.try_parse_json("value").isNull()).count()


def read_config(path: str, spark: SparkSession | None = None) -> Config | None:
    """A configuration in YAML or JSON; an empty one is None. With a session, of any store."""
    text = read_text(spark, path) if spark else Path(path).read_text(encoding="utf-8")
    if path.lower().endswith(".json"):
        return Config.of(json.loads(text) if text.strip() else None)
    import yaml

    return Config.of(yaml.safe_load(text))


def read_reports(spark: SparkSession, path: str) -> list[dict]:
    """Incident reports that ``sources.files.write_report`` wrote."""
    return [json.loads(r[0]) for r in spark.read.text(path, wholetext=True).collect()]
