"""Readers for line formats, on a DataFrame of lines (``value``) and their numbers (``line``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value of text files: a file is read whole by one task, files in parallel."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))


def simple_csv(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lines split at commas and trimmed; missing cells are empty, further ones are ignored, and there is no quoting (SRC-02)."""
    cells = F.split("value", ",")
    others = [c for c in lines.columns if c != "value"]
    return lines.filter(F.trim("value") != "").select(*others, *[F.coalesce(F.trim(F.get(cells, F.lit(i))), F.lit("")).alias(c) for i, c in enumerate(columns)])


def js_number(text: Column) -> Column:
    """An empty cell is 0 and malformed text is NaN."""
    return F.when(F.trim(text) == "", 0.0).otherwise(F.coalesce(F.trim(text).try_cast("double"), F.lit(float("nan"))))


def typed(rows: DataFrame, numbers: Sequence[str], order: str) -> DataFrame:
    """Rows with number columns typed and a row index from 0 within their file (SRC-03)."""
    return rows.withColumns({c: js_number(F.col(c)) for c in numbers}).withColumn("row_index", F.col(order).cast("int"))


def strict_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV whose header must be exactly ``columns`` (SRC-10)."""
    df = spark.read.csv(path, header=True)
    if df.columns != list(columns):
        raise ValueError(f"header is {df.columns}, not {list(columns)}")
    return df


def markdown_rows(lines: DataFrame) -> DataFrame:
    """file, line, cells of the rows of markdown tables, without rules between header and body (SRC-09)."""
    bare = F.regexp_replace(F.trim("value"), r"^\||\|$", "")
    cells = F.transform(F.split(bare, r"\|"), lambda c: F.trim(c))
    rows = lines.filter(F.trim("value").startswith("|")).withColumn("cells", cells)
    return rows.filter(~F.forall("cells", lambda c: c.rlike("^:?-+:?$"))).drop("value")


def ddl_columns(scripts: DataFrame) -> DataFrame:
    """The other columns of ``scripts``, table_name, column_name, kind of the CREATE TABLE statements in its ``value`` column (SRC-11)."""
    others = [c for c in scripts.columns if c != "value"]
    tables = F.regexp_extract_all("value", F.lit(r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?(\w+\s*\(.*?\)\s*;)"), F.lit(1))
    body = scripts.select(*others, F.explode(tables).alias("t")).select(*others, F.lower(F.regexp_extract("t", r"^(\w+)", 1)).alias("table_name"), F.explode(F.split(F.regexp_extract("t", r"(?s)\((.*)\)\s*;", 1), r",(?![^()]*\))")).alias("c"))
    named = body.select(*others, "table_name", F.regexp_extract("c", r"(?s)^\s*(\w+)\s+(\w+)", 1).alias("column_name"), F.upper(F.regexp_extract("c", r"(?s)^\s*(\w+)\s+(\w+)", 2)).alias("kind"))
    return named.filter((F.col("column_name") != "") & ~F.upper("column_name").isin("PRIMARY", "FOREIGN", "UNIQUE", "CONSTRAINT", "CHECK"))


def closed_json(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """``column`` parsed by a closed schema: parsed, unknown keys and whether it is well formed (SRC-12)."""
    keys = F.json_object_keys(column)
    return df.withColumns(
        {
            "parsed": F.from_json(column, schema),
            "unknown_keys": F.array_sort(F.array_except(keys, F.array(*[F.lit(f.name) for f in schema]))),
            "well_formed": keys.isNotNull(),
        }
    )


# The connectors that are described; none of them has an adapter.
CONNECTORS = (
    # id, kind of system, categories, health, maturity
    ("sap-s4hana", "ERP", ("Supplier", "Material", "BOM", "Product"), "Not configured", "Skeleton Available"),
    ("sap-ariba", "Procurement", ("Supplier", "Contract"), "Not configured", "Skeleton Available"),
    ("salesforce", "CRM", ("Supplier",), "Not configured", "Roadmap"),
    ("snowflake", "Data Warehouse", ("Material", "Product", "Revenue Exposure"), "Not configured", "Skeleton Available"),
    ("databricks", "Data Platform / Lakehouse", ("Material", "Product", "Revenue Exposure"), "Not configured", "Skeleton Available"),
    ("microsoft-fabric", "Data Platform / Lakehouse", ("Material", "Product", "Revenue Exposure"), "Not configured", "Roadmap"),
    ("document-repository", "Unstructured Document Store", ("Contract", "Risk Event"), "Not configured", "Roadmap"),
    ("rest-api", "Generic HTTP", ("Supplier", "Material", "BOM", "Product", "Facility", "Contract", "Risk Event"), "Available", "Skeleton Available"),
    ("mcp", "Model Context Protocol", ("Supplier", "Material", "BOM", "Product", "Facility", "Contract", "Risk Event"), "Not configured", "Roadmap"),
)


def connectors(spark: SparkSession) -> DataFrame:
    """connector_id, system, categories, health, maturity (SRC-13)."""
    return spark.createDataFrame([(i, s, list(c), h, m) for i, s, c, h, m in CONNECTORS], "connector_id string, system string, categories array<string>, health string, maturity string")
