"""Validation of sets of files: repeated keys, broken references, shared keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.operators import ranking

ISSUE = ["file", "row_index", "field", "problem"]
# The keys of a dataset's files, the references between them, and the proposed mappings of their fields.
KEYS = (
    ("suppliers.csv", "supplier_id"),
    ("materials.csv", "material_id"),
    ("products.csv", "product_id"),
    ("facilities.csv", "facility_id"),
    ("supply_agreements.csv", "agreement_id"),
    ("risk_events.csv", "risk_event_id"),
    ("revenue_exposure.csv", "product_id"),
)
REFERENCES = (
    ("materials.csv", "supplier_id", "suppliers.csv"),
    ("products.csv", "material_id", "materials.csv"),
    ("products.csv", "facility_id", "facilities.csv"),
    ("supply_agreements.csv", "material_id", "materials.csv"),
    ("supply_agreements.csv", "supplier_id", "suppliers.csv"),
    ("revenue_exposure.csv", "product_id", "products.csv"),
)
MAPPINGS = (
    # file, field, inferred type, concept, role, confidence
    ("suppliers.csv", "supplier_id", "Identifier", "Supplier identifier", "attribute", 0.99),
    ("suppliers.csv", "supplier_name", "Text", "Supplier name", "attribute", 0.98),
    ("suppliers.csv", "region_id", "Foreign key", "Located in Region", "relationship", 0.97),
    ("materials.csv", "material_id", "Identifier", "Material identifier", "attribute", 0.99),
    ("materials.csv", "supplier_id", "Foreign key", "Supplied by Supplier", "relationship", 0.98),
    ("products.csv", "material_id", "Foreign key", "Uses Material", "relationship", 0.98),
    ("products.csv", "facility_id", "Foreign key", "Assembled at Facility", "relationship", 0.97),
    ("revenue_exposure.csv", "product_id", "Foreign key", "Revenue generated by Product", "relationship", 0.96),
    ("risk_events.csv", "region_id", "Foreign key", "Risk affects Region", "relationship", 0.96),
    ("supply_agreements.csv", "material_id", "Foreign key", "Agreement covers Material", "relationship", 0.97),
)
DUPLICATE, BROKEN = 'Duplicate %s "%s" — first seen at row %d.', '%s "%s" does not match any record in %s.'


def repeated_keys(rows: DataFrame, file: str, key: str, order: str) -> DataFrame:
    """QLY-01."""
    return ranking.repeats_of_first(rows, key, order).select(F.lit(file).alias("file"), F.col(order).alias("row_index"), F.lit(key).alias("field"), F.lit("DUPLICATE_KEY").alias("problem"))


def broken_references(rows: DataFrame, file: str, key: str, order: str, target: DataFrame, target_key: str) -> DataFrame:
    """An empty or null reference is broken too (QLY-01, JN-11)."""
    known = target.select(F.col(target_key).cast("string").alias("_k")).filter("_k <> ''").distinct()
    lacking = rows.withColumn("_k", F.col(key).cast("string")).join(known, "_k", "left_anti")
    return lacking.select(F.lit(file).alias("file"), F.col(order).alias("row_index"), F.lit(key).alias("field"), F.lit("BROKEN_REFERENCE").alias("problem"))


def issues(found: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def dataset_issues(files: Mapping[str, DataFrame]) -> DataFrame:
    """file, row_index, field, message: all seven duplicate and six reference checks of a dataset (QLY-01).

    Each file has row_index and its fields; a null key or reference is taken as empty. Keys are counted by
    partial aggregation before their rows are looked at, so a hot key is no group of its own.
    """
    value = lambda field: F.coalesce(F.col(field).cast("string"), F.lit(""))
    found = []
    for file, field in KEYS:
        rows = files[file].select("row_index", value(field).alias("_v"))
        first = rows.groupBy("_v").agg(F.min("row_index").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        message = F.format_string(DUPLICATE, F.lit(field), F.col("_v"), F.col("_first") + 1)
        found.append(rows.join(first, "_v").filter("row_index > _first").select(F.lit(file).alias("file"), "row_index", F.lit(field).alias("field"), message.alias("message")))
    key_of = dict(KEYS)
    for file, field, target in REFERENCES:
        known = files[target].select(value(key_of[target]).alias("_v")).distinct()
        lacking = files[file].select("row_index", value(field).alias("_v")).join(known, "_v", "left_anti")
        found.append(lacking.select(F.lit(file).alias("file"), "row_index", F.lit(field).alias("field"), F.format_string(BROKEN, F.lit(field), F.col("_v"), F.lit(target)).alias("message")))
    return issues(found)


def mapped_fields(files: Mapping[str, DataFrame]) -> DataFrame:
    """The proposed mappings of the fields that the files have, with the number of values that each would map (QLY-03)."""
    spark = next(iter(files.values())).sparkSession
    catalogue = spark.createDataFrame(list(MAPPINGS), "file string, field string, inferred_type string, concept string, role string, confidence double")
    counted = []
    for file, rows in files.items():
        fields = [m[1] for m in MAPPINGS if m[0] == file and m[1] in rows.columns]
        if fields:
            counts = rows.agg(*[F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) != "").alias(f) for f in fields])
            counted.append(counts.select(F.inline(F.array(*[F.struct(F.lit(file).alias("file"), F.lit(f).alias("field"), F.col(f).alias("n_values")) for f in fields]))))
    return catalogue.join(F.broadcast(issues(counted)), ["file", "field"])  # a row per mapping


def manifest_differences(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """path, problem of the paths that don't verify (QLY-05): both sides have path and sha256.

    In order of precedence: DUPLICATE_ENTRY, INVALID_DIGEST, MISSING (listed only), UNREGISTERED (found only), CHECKSUM_MISMATCH.
    """
    listed = manifest.groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.min("sha256").alias("_listed"))
    j = listed.join(found.select("path", F.col("sha256").alias("_found"), F.lit(True).alias("_there")), "path", "full")
    wellformed = F.coalesce(F.col("_listed").rlike("^[0-9a-f]{64}$"), F.lit(False))
    problem = (
        F.when(F.col("_n") > 1, "DUPLICATE_ENTRY")
        .when(F.col("_n").isNotNull() & ~wellformed, "INVALID_DIGEST")
        .when(F.col("_there").isNull(), "MISSING")
        .when(F.col("_n").isNull(), "UNREGISTERED")
        .when(~F.col("_listed").eqNullSafe(F.col("_found")), "CHECKSUM_MISMATCH")
    )
    return j.select("path", problem.alias("problem")).filter(F.col("problem").isNotNull())


#: Columns that a whole number stands for, by its bits.
BITS = 63


def inclusions(tables: Mapping[str, Mapping[str, Column]], frames: Mapping[str, DataFrame]) -> DataFrame:
    """a, b, n_values, n_broken: of every two columns with a value in common, how many distinct values of ``a`` are not in ``b`` (QLY-02, JN-11).

    ``tables`` names the columns to compare, as ``name`` to expression of each table. Each column has a bit of its own;
    values are shuffled once, with the bits of the columns that have them, which are added up before the shuffle as
    well. Combinations of bits are counted, and only the different ones meet, of which there are few. Where n_broken is
    0, ``a`` may refer to ``b``. Nulls are no values.
    """
    names = [f"{table}.{name}" for table, columns in tables.items() for name in columns]
    words = [f"_w{i}" for i in range(-(-len(names) // BITS))]
    each = []
    for table, columns in tables.items():
        found = []
        for name, value in columns.items():
            place = names.index(f"{table}.{name}")
            bits = [F.lit(1 << place % BITS if place // BITS == i else 0).cast("long").alias(w) for i, w in enumerate(words)]
            found.append(F.struct(value.cast("string").alias("value"), *bits))
        each.append(frames[table].select(F.inline(F.array(*found))).filter("value IS NOT NULL"))
    where = issues(each).groupBy("value").agg(*[F.bit_or(w).alias(w) for w in words])
    sets = where.groupBy(*words).agg(F.count(F.lit(1)).alias("n"))
    has = [F.when(F.col(words[i // BITS]).bitwiseAND(F.lit(1 << i % BITS).cast("long")) != 0, name) for i, name in enumerate(names)]
    sets = sets.select(F.array_compact(F.array(*has)).alias("columns"), "n")
    total = sets.select(F.explode("columns").alias("a"), "n").groupBy("a").agg(F.sum("n").alias("n_values"))
    pairs = sets.select(F.explode("columns").alias("a"), "columns", "n").select("a", F.explode("columns").alias("b"), "n").filter("a <> b")
    shared = pairs.groupBy("a", "b").agg(F.sum("n").alias("n_shared"))
    return shared.join(total, "a").select("a", "b", "n_values", (F.col("n_values") - F.col("n_shared")).alias("n_broken"))


def header_differences(files: DataFrame, expected: Sequence[str]) -> DataFrame:
    """file, column_name, difference: columns that the header lines of ``files`` (file, header) lack or have beyond ``expected`` (QLY-04, SRC-10)."""
    has = F.transform(F.split("header", ","), lambda c: F.trim(c))
    wanted = F.array(*[F.lit(c) for c in expected])
    rows = lambda names, what: F.transform(names, lambda c: F.struct(c.alias("column_name"), F.lit(what).alias("difference")))
    return files.select("file", F.inline(F.concat(rows(F.array_except(wanted, has), "MISSING"), rows(F.array_except(has, wanted), "UNEXPECTED"))))


def schema_checks(columns: DataFrame, schemas: DataFrame, by: str, required: Sequence[str]) -> DataFrame:
    """by, check, ok: whether each schema has the number of tables that ``schemas`` (by, n_tables) expects, and each of its tables the ``required`` columns (QLY-07).

    ``columns`` has by, table_name, column_name; a schema without tables has neither.
    """
    has = [F.bool_or(F.col("column_name") == c) for c in required]
    whole = has[0]
    for h in has[1:]:
        whole = whole & h
    tables = columns.groupBy(by, "table_name").agg(whole.alias("whole"))
    counted = tables.groupBy(by).agg(F.count(F.lit(1)).alias("found"), F.bool_and("whole").alias("all_whole"))
    j = schemas.join(counted, by, "left")
    check = lambda name, ok: F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"))
    return j.select(by, F.inline(F.array(check("table_count", F.coalesce("found", F.lit(0)) == F.col("n_tables")), check("required_columns", F.col("all_whole")))))


def traceability(columns: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Columns with their dictionary entry: category A where there is one, B where not (QLY-06)."""
    known = dictionary.select("table_name", "column_name").distinct().withColumn("_there", F.lit(True))
    return columns.join(known, ["table_name", "column_name"], "left").withColumn("category", F.when(F.col("_there"), "A").otherwise("B")).drop("_there")
