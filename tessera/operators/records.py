"""Nested records: detecting them, flattening, choosing, renaming, casting, null handling, enriching, validating.

Everything between scan and writer is one lazy chain; the work on names is done on the schema alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import fixed
from tessera.functions.columns import NUMERIC, bind, date, domain, is_free_mail, is_number, personal_data_class, quoted, timestamp, top_domain
from tessera.operators.samples import first_values

SNIFFED = 100


# Records and their fields.


def flatten(df: DataFrame, max_depth: int = 10) -> DataFrame:
    """Struct fields as dotted columns; arrays, maps and what lies deeper than ``max_depth`` as JSON text."""
    chosen: dict[str, Column] = {}

    def descend(column: Column, kind: T.DataType, name: str, depth: int) -> None:
        if isinstance(kind, T.StructType) and depth < max_depth:
            for f in kind.fields:
                descend(column.getField(f.name) if name else quoted(f.name), f.dataType, f"{name}.{f.name}" if name else f.name, depth + 1)
        elif isinstance(kind, T.StructType | T.ArrayType | T.MapType):
            chosen[name] = F.to_json(column)
        else:
            chosen[name] = column

    descend(F.lit(None), df.schema, "", 0)
    return df.select(*[c.alias(n) for n, c in chosen.items()])


def flatten_ragged(documents: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """Text values of JSON paths, for records whose shapes differ."""
    return documents.select("*", *[F.get_json_object(column, path).alias(name) for name, path in paths.items()])


def wrapper_of(document: str) -> tuple[str | None, bool]:
    """Key that holds the records of a JSON document (None: the document itself), and whether it is a list."""
    data = json.loads(document)
    if not isinstance(data, dict):
        return None, isinstance(data, list)
    lists = {k: v for k, v in data.items() if isinstance(v, list)}
    known = next((k for k in fixed.RECORD_KEYS if k in lists), None)
    return known or next((k for k, v in lists.items() if v and isinstance(v[0], dict)), None), False


def detect(documents: DataFrame, column: str = "json") -> DataFrame:
    """record (variant) for each record of each document: under the first known key with a list, else under the first key
    with a list that begins with an object, or the document.

    ``documents`` keeps its other columns. Text that is no JSON has no records.
    """
    parsed = documents.withColumn("__v", F.try_parse_json(column)).filter("__v is not null")
    lists = [F.try_variant_get("__v", f"$.{k}", "array<variant>") for k in fixed.RECORD_KEYS]
    whole = F.try_variant_get("__v", "$", "array<variant>")
    # Values by key in the document's order, which a variant does not keep.
    entries = F.transform(F.map_values(F.from_json(column, "map<string,string>")), lambda x: F.try_variant_get(F.try_parse_json(x), "$", "array<variant>"))
    other = F.get(F.filter(entries, lambda x: F.schema_of_variant(F.get(x, F.lit(0))).startswith("OBJECT")), F.lit(0))
    value = F.when(F.schema_of_variant("__v").startswith("OBJECT"), F.col("__v")).otherwise(F.parse_json(F.concat(F.lit('{"value":'), F.to_json("__v"), F.lit("}"))))
    return parsed.withColumn("record", F.explode(F.coalesce(whole, *lists, other, F.array(value)))).drop("__v", column)


# Choosing and renaming.


def include(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns that exist, in the order of ``names``; all if none does."""
    known = [n for n in names if n in df.columns]
    return df.select(*[quoted(n) for n in known]) if known else df


def exclude(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in df.columns if c not in names])


def drop_metadata(df: DataFrame) -> DataFrame:
    """Without the columns whose name is, or begins with, that of a known metadata field."""
    return df.select(*[quoted(c) for c in df.columns if not c.startswith(tuple(fixed.METADATA_FIELDS))])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[quoted(c).alias(names.get(c, c)) for c in df.columns])


def clean_name(name: str) -> str:
    """A field's name without wrapping prefixes, in snake case."""
    for prefix in ("attributes.", "properties.", "fields.", "data.", "record."):
        name = name.removeprefix(prefix)
    name = re.sub(r"([a-z0-9])(?=[A-Z])", r"\1_", name)
    name = re.sub(r"([A-Z])(?=[A-Z][a-z])", r"\1_", name)
    return re.sub(r"_+", "_", re.sub(r"[.\-\s]+", "_", name.lower())).strip("_")


def clean_names(columns: list[str]) -> dict[str, str]:
    """New names by old ones, for the names that change; equal new names are told apart by a number."""
    taken: dict[str, int] = {}
    names = {}
    for c in columns:
        new = clean_name(c)
        taken[new] = taken.get(new, 0) + 1
        names[c] = new if taken[new] == 1 else f"{new}_{taken[new]}"
    return {c: n for c, n in names.items() if c != n}


# Types and nulls.


def cast_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def cast_float(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.rlike(NUMERIC), F.trim(text).try_cast("double"))


def cast_int(c: Column) -> Column:
    return cast_float(c).try_cast("bigint")


def cast_bool(c: Column) -> Column:
    text = F.lower(c.cast("string"))
    return F.when(text.isin("true", "1", "yes"), True).when(text.isin("false", "0", "no"), False)


def cast_time(c: Column) -> Column:
    """A time in a known format, or a date in one, the month first where both orders fit."""
    return bind(c.cast("string"), lambda x: F.coalesce(timestamp(x), date(x).cast("timestamp")))


CASTS: dict[str, Callable[[Column], Column]] = {
    "string": cast_text, "str": cast_text, "float": cast_float, "double": cast_float, "int": cast_int, "integer": cast_int,
    "bool": cast_bool, "boolean": cast_bool, "datetime": cast_time, "date": cast_time,
}


def cast(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, int]:
    """``df`` with columns cast, and how many were; unknown types count but change nothing.

    A column with a fractional number is not cast to int and doesn't count.
    """
    wanted = {c: t for c, t in types.items() if c in df.columns}
    whole = [c for c, t in wanted.items() if t in ("int", "integer")]
    broken: list[str] = []
    if whole:
        row = df.agg(*[F.coalesce(F.bool_or(cast_float(quoted(c)) != F.floor(cast_float(quoted(c)))), F.lit(False)).alias(str(i)) for i, c in enumerate(whole)]).first()
        broken = [c for i, c in enumerate(whole) if row[i]]
    kept = {c: t for c, t in wanted.items() if c not in broken}
    return df.select(*[CASTS.get(kept.get(c, ""), lambda x: x)(quoted(c)).alias(c) for c in df.columns]), len(kept)


def fill_nulls(df: DataFrame, text: str = "", number: float = 0) -> DataFrame:
    def filled(f: T.StructField) -> Column:
        if is_number(df, f.name) or isinstance(f.dataType, T.BooleanType):
            return F.coalesce(quoted(f.name), F.lit(number).cast(f.dataType))
        return F.coalesce(quoted(f.name), F.lit(text)) if isinstance(f.dataType, T.StringType) else quoted(f.name)

    return df.select(*[filled(f).alias(f.name) for f in df.schema])


def null_counts(df: DataFrame) -> DataFrame:
    """One row: the nulls of each column."""
    return df.agg(*[F.count_if(quoted(c).isNull()).alias(c) for c in df.columns])


def drop_null_columns(df: DataFrame) -> DataFrame:
    row = df.agg(*[F.count(quoted(c)).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select(*[quoted(c) for i, c in enumerate(df.columns) if row[i]])


def handle_nulls(df: DataFrame, strategy: str = "fill", text: str = "", number: float = 0) -> DataFrame:
    """fill, drop_row (rows with any null) or drop_column (columns of nulls alone); others change nothing."""
    if strategy == "fill":
        return fill_nulls(df, text, number)
    if strategy == "drop_row":
        return df.na.drop("any")
    return drop_null_columns(df) if strategy == "drop_column" else df


# Enriching.


def domain_info(df: DataFrame) -> DataFrame:
    """domain, domain_tld and is_free_email, from the first column named like mail, else like a website."""
    mail = next((c for c in df.columns if "email" in c.lower()), None)
    site = next((c for c in df.columns if c != mail and any(x in c.lower() for x in ("website", "url", "domain"))), None)
    if not (mail or site):
        return df
    found = df.withColumn("domain", domain(quoted(mail or site)))
    return found.withColumns({"domain_tld": top_domain(F.col("domain")), "is_free_email": is_free_mail(F.col("domain"))})


def geo_lookup(df: DataFrame, column: str | None = None) -> DataFrame:
    """continent and region, from codes or names of countries; empty for others. The lists are fixed and small."""
    column = column or next((c for c in df.columns if "country" in c.lower()), None)
    if column is None:
        return df
    spark = df.sparkSession
    places = spark.createDataFrame([(code, *where) for code, where in fixed.COUNTRY_REGIONS.items()], "__code string, __continent string, __region string")
    names = spark.createDataFrame(list(fixed.COUNTRY_NAMES.items()), "__name string, __code string").join(places, "__code")
    keys = places.select(F.col("__code").alias("__key"), F.lit(0).alias("__by"), "__continent", "__region").unionByName(names.select(F.col("__name").alias("__key"), F.lit(1).alias("__by"), "__continent", "__region"))
    trimmed = F.trim(quoted(column).cast("string"))
    kept = df.drop("continent", "region").withColumn("__upper", F.upper(trimmed)).withColumn("__lower", F.lower(trimmed))
    by_code = F.broadcast(keys.filter("__by = 0").select(F.col("__key").alias("__upper"), F.col("__continent").alias("__c0"), F.col("__region").alias("__r0")))
    by_name = F.broadcast(keys.filter("__by = 1").select(F.col("__key").alias("__lower"), F.col("__continent").alias("__c1"), F.col("__region").alias("__r1")))
    joined = kept.join(by_code, "__upper", "left").join(by_name, "__lower", "left")
    own = [c for c in df.columns if c not in ("continent", "region")]
    return joined.select(*[quoted(c) for c in own], F.coalesce("__c0", "__c1", F.lit("")).alias("continent"), F.coalesce("__r0", "__r1", F.lit("")).alias("region"))


def personal_data_shares(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """column, and for each class of personal data the share of the column's first values that have its form.

    The first SNIFFED values, without nulls, in ``order``, or else in that of a hash of the rows; one pass for all columns.
    """
    looked = [c for c in df.columns if not c.startswith("_") and c not in ("domain", "domain_tld", "is_free_email", "continent", "region")]
    head = first_values(df, {c: (quoted(c).isNotNull(), quoted(c)) for c in looked}, [F.xxhash64(*[quoted(c) for c in df.columns])] if order is None else order, SNIFFED)
    return head.groupBy(F.col("kind").alias("column")).agg(*[F.avg(F.col("value").rlike(p).cast("double")).alias(n) for n, p in fixed.PERSONAL_DATA])


def personal_data(df: DataFrame, order: list[Column] | None = None) -> dict[str, str]:
    """Columns whose first values mostly belong to a class of personal data, and the class."""
    shares = {r["column"]: r for r in personal_data_shares(df, order).collect()}
    hits = {c: next((n for n, _ in fixed.PERSONAL_DATA if (shares[c][n] or 0) > 0.5), None) for c in df.columns if c in shares}
    return {c: n for c, n in hits.items() if n}


def data_classification(df: DataFrame) -> DataFrame:
    """Constant columns that name the columns with personal data and their classes."""
    found = personal_data(df)
    if not found:
        return df
    added = {"_pii_columns_detected": F.lit(json.dumps(found))}
    for c, name in found.items():
        added |= {f"_{c}_is_pii": F.lit("true"), f"_{c}_pii_type": F.lit(name)}
    return df.withColumns(added)


#: Enrichers by name; add your own.
ENRICHERS: dict[str, Callable[[DataFrame], DataFrame]] = {"domain_info": domain_info, "geo_lookup": geo_lookup, "data_classification": data_classification}


# The whole transformation.


@dataclass
class Config:
    field_mappings: dict[str, str] = field(default_factory=dict)
    type_casts: dict[str, str] = field(default_factory=dict)
    exclude_fields: list[str] = field(default_factory=list)
    include_only: list[str] = field(default_factory=list)
    null_strategy: str = "fill"
    fill_value: str = ""
    numeric_fill: float = 0

    @classmethod
    def of(cls, data: dict | None) -> Config | None:
        if not data:
            return None
        nulls = data.get("null_handling") or {}
        own = {k: data[k] for k in ("field_mappings", "type_casts", "exclude_fields", "include_only") if data.get(k)}
        return cls(**own, null_strategy=nulls.get("strategy", "fill"), fill_value=nulls.get("fill_value", ""), numeric_fill=nulls.get("numeric_fill", 0))


def validate(df: DataFrame, expected: list[str], casts: dict[str, str]) -> dict:
    """Whether the expected columns are there, no column is mostly null, and cast columns are numbers."""
    missing = sorted(set(expected) - set(df.columns))
    warnings = [f"Missing expected columns: {', '.join(missing)}"] if missing else []
    row = df.agg(F.count(F.lit(1)), *[F.count_if(quoted(c).isNull()).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    high = [(c, row[i + 1] / row[0]) for i, c in enumerate(df.columns) if row[0] and row[i + 1] / row[0] > 0.5]
    warnings += [f"Column '{c}' has high null rate: {rate:.1%}" for c, rate in high]
    wrong = [c for c, t in casts.items() if c in df.columns and t in ("int", "integer", "float", "double") and not is_number(df, c)]
    warnings += [f"Column '{c}' expected type '{casts[c]}' but contains non-numeric values" for c in wrong]
    checks = {"expected_columns_present": not missing, "null_rate_acceptable": not high, "type_consistency": not wrong}
    return {"status": "warnings" if warnings else "passed", "checks": checks, "warnings": warnings}


@dataclass
class Transformed:
    frame: DataFrame
    summary: dict
    validation: dict


def transform(df: DataFrame, config: Config | None = None, enrichers: list[str] | None = None, max_depth: int = 10) -> Transformed:
    """Flatten, choose, rename, cast, handle nulls, enrich and validate, in this order.

    Without a config, metadata fields go and names are cleaned.
    """
    flat = flatten(df, max_depth)
    default, config = config is None, config or Config()
    chosen = include(flat, config.include_only)
    chosen = exclude(chosen, config.exclude_fields)
    chosen = drop_metadata(chosen) if default else chosen
    names = clean_names(chosen.columns) if default else {k: v for k, v in config.field_mappings.items() if k in chosen.columns}
    cast_frame, n_cast = cast(rename(chosen, names), config.type_casts)
    handled = handle_nulls(cast_frame, config.null_strategy, config.fill_value, config.numeric_fill)
    made = handled
    for name in enrichers or []:
        made = ENRICHERS[name](made) if name in ENRICHERS else made
    expected = list(names.values()) if default else list(config.field_mappings.values())
    nulls = lambda x: sum(v or 0 for v in null_counts(x).first()) if x.columns else 0
    summary = {
        "records": df.count(), "fields_in": len(flat.columns), "fields_out": len(made.columns), "renamed": len(names), "cast": n_cast,
        "excluded": len(set(flat.columns) - set(chosen.columns)), "enriched": len(made.columns) - len(handled.columns), "nulls_handled": nulls(cast_frame) - nulls(handled),
    }
    return Transformed(made, summary, validate(made, expected, config.type_casts))


def union_ragged(frames: list[DataFrame]) -> DataFrame:
    """Rows of frames with different columns; what a frame lacks is null."""
    found = frames[0]
    for more in frames[1:]:
        found = found.unionByName(more, allowMissingColumns=True)
    return found


def records_of_json(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Records of JSON texts, with an inferred schema; for small inputs and tests."""
    whole = F.lit(f"[{','.join(texts)}]")
    schema = spark.range(1).select(F.schema_of_json(whole)).first()[0]
    return spark.range(1).select(F.inline(F.from_json(whole, schema)))


__all__ = ["CASTS", "Config", "ENRICHERS", "Transformed", "cast", "clean_name", "clean_names", "detect", "flatten", "personal_data_class", "transform", "validate", "wrapper_of"]
