"""Explicit schemas of the domain tables (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("content", T.StringType()),
])

PACKAGES = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("ecosystem", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("is_dev", T.BooleanType()),
    T.StructField("is_direct", T.BooleanType()),
])

ADVISORIES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("aliases", T.ArrayType(T.StringType())),
    T.StructField("summary", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("severity", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()), T.StructField("score", T.StringType())]))),
    T.StructField("affected", T.ArrayType(T.StructType([
        T.StructField("package", T.StructType([
            T.StructField("name", T.StringType()), T.StructField("ecosystem", T.StringType())])),
        T.StructField("ranges", T.ArrayType(T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("events", T.ArrayType(T.StructType([
                T.StructField("introduced", T.StringType()), T.StructField("fixed", T.StringType()),
                T.StructField("last_affected", T.StringType())]))),
        ]))),
        T.StructField("versions", T.ArrayType(T.StringType())),
    ]))),
    T.StructField("references", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()), T.StructField("url", T.StringType())]))),
    T.StructField("database_specific", T.StructType([
        T.StructField("severity", T.StringType()),
        T.StructField("cvss_score", T.DoubleType()),
        T.StructField("cwe_ids", T.ArrayType(T.StringType())),
    ])),
])

FINDINGS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("project", T.StringType()),
    T.StructField("scanner", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("column", T.IntegerType()),
    T.StructField("message", T.StringType()),
    T.StructField("cwe", T.StringType()),
    T.StructField("owasp", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("fix_suggestion", T.StringType()),
    T.StructField("secret_type", T.StringType()),
    T.StructField("entropy", T.DoubleType()),
    T.StructField("masked_value", T.StringType()),
    T.StructField("package_name", T.StringType()),
    T.StructField("installed_version", T.StringType()),
    T.StructField("vulnerable_range", T.StringType()),
    T.StructField("fixed_version", T.StringType()),
    T.StructField("cve", T.StringType()),
    T.StructField("cvss_score", T.DoubleType()),
    T.StructField("description", T.StringType()),
    T.StructField("is_dev_dependency", T.BooleanType()),
    T.StructField("is_direct", T.BooleanType()),
    T.StructField("is_reachable", T.BooleanType()),
    T.StructField("exploit_available", T.BooleanType()),
    T.StructField("config_file", T.StringType()),
    T.StructField("scan_ts", T.TimestampType()),
])

PRIORITY_FACTORS = T.StructType([
    T.StructField("severity_score", T.IntegerType()),
    T.StructField("exploitability_score", T.IntegerType()),
    T.StructField("reachability_score", T.IntegerType()),
    T.StructField("business_impact_score", T.IntegerType()),
])


def conform(df: DataFrame, schema: T.StructType = FINDINGS) -> DataFrame:
    """Select ``schema``'s columns in order; absent ones become typed nulls.

    This is the sparse-column union of the finding variants: every scanner
    emits only its own columns and is padded here before ``unionByName``.
    """
    present = set(df.columns)
    cols = [(F.col(f.name).cast(f.dataType) if f.name in present
             else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    return df.select(*cols)
