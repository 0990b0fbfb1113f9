"""Joins that also say what is missing, ambiguous or at odds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices that the rows of a key are cut to at most, and so the copies of a row of the other side.
MOST_SLICES = 16


def required(left: DataFrame, right: DataFrame, on: Sequence[str], *, strict: bool = False) -> DataFrame:
    """Left join with ``missing``, true where there is no partner; ``strict`` raises there (JN-06, JN-16, JN-23)."""
    marked = right.withColumn("_there", F.lit(True))
    joined = left.join(marked, list(on), "left").withColumn("missing", F.col("_there").isNull()).drop("_there")
    if strict:
        joined = joined.filter(F.when(F.col("missing"), F.raise_error(F.lit(f"no partner on {', '.join(on)}"))).otherwise(True))
    return joined


def in_order(df: DataFrame, key: str, ids: str, names: DataFrame, id_column: str, name_column: str, default: str | None = None) -> DataFrame:
    """key, names: the names of an array of ids in the array's order, and how many ids have none (JN-06, JN-12)."""
    one = df.select(key, F.posexplode(ids).alias("_place", id_column)).join(names.select(id_column, name_column), id_column, "left")
    name = F.coalesce(F.col(name_column), F.lit(default)) if default is not None else F.col(name_column)
    ordered = F.array_sort(F.collect_list(F.struct("_place", name.alias("_name"))))
    return one.groupBy(key).agg(F.transform(ordered, lambda x: x["_name"]).alias("names"), F.count_if(F.col(name_column).isNull()).alias("n_missing"))


def audit(left: DataFrame, right: DataFrame, on: Sequence[str], payload: str) -> DataFrame:
    """Full outer comparison: on, violation in MISSING, ORPHAN, DUPLICATE, MISMATCH or null (JN-09, JN-19, SET-05)."""
    side = lambda df, s: df.groupBy(*on).agg(F.count(F.lit(1)).alias(f"n_{s}"), F.min(payload).alias(f"p_{s}"))
    both = side(left, "l").join(side(right, "r"), list(on), "full")
    violation = (
        F.when(F.col("n_r").isNull(), "MISSING")
        .when(F.col("n_l").isNull(), "ORPHAN")
        .when((F.col("n_l") > 1) | (F.col("n_r") > 1), "DUPLICATE")
        .when(~F.col("p_l").eqNullSafe(F.col("p_r")), "MISMATCH")
    )
    return both.select(*on, violation.alias("violation"))


def unowned(df: DataFrame, key: str, ids: str, owned: DataFrame, owner: str, id_column: str) -> DataFrame:
    """key, owner, id of array elements that don't belong to the row's owner (JN-13, JN-15)."""
    one = df.select(key, owner, F.explode(ids).alias(id_column))
    return one.join(owned.select(owner, id_column).distinct(), [owner, id_column], "left_anti")


def routed(refs: DataFrame, kind: str, ref: str, targets: dict[str, tuple[DataFrame, str]], *, present: bool = True) -> DataFrame:
    """References of several kinds checked against the kind's table in one join (JN-14)."""
    keys = None
    for name, (df, column) in targets.items():
        own = df.select(F.lit(name).alias(kind), F.col(column).cast("string").alias(ref)).distinct()
        keys = own if keys is None else keys.unionByName(own)
    return refs.join(keys, [kind, ref], "left_semi" if present else "left_anti")


def either_way(nodes: DataFrame, edges: DataFrame, node: str, source: str, target: str) -> DataFrame:
    """Edges at each node, outgoing and incoming; a loop stands twice (JN-17)."""
    out = nodes.join(edges, nodes[node] == edges[source]).select(nodes[node], F.lit("outgoing").alias("direction"), edges[target].alias("other"))
    back = nodes.join(edges, nodes[node] == edges[target]).select(nodes[node], F.lit("incoming").alias("direction"), edges[source].alias("other"))
    return out.unionByName(back)


def first_match(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """A row for each key: the columns of its first row by ``order`` (JN-18)."""
    return df.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in columns])


def broken_at(*links: tuple[str, Column]) -> Column:
    """Name of the first link that is null."""
    return F.coalesce(*[F.when(value.isNull(), F.lit(name)) for name, value in links])


def reconciled(edges: DataFrame, owners: DataFrame, source: str, target: str, id_column: str, owner: str) -> DataFrame:
    """Edges with the owner both ends agree on, or the reason they have none (JN-22)."""
    end = lambda name: owners.select(F.col(id_column).alias(name), F.col(owner).alias(f"_{name}_owner"))
    joined = edges.join(end(source), source, "left").join(end(target), target, "left")
    a, b = F.col(f"_{source}_owner"), F.col(f"_{target}_owner")
    reason = F.when(a.isNull() | b.isNull(), "UNRESOLVED_ENDPOINT").when(a != b, "OWNERS_DISAGREE")
    return joined.withColumns({"reason": reason, owner: F.when(reason.isNull(), a)}).drop(f"_{source}_owner", f"_{target}_owner")


def unambiguous(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with ``ambiguous``, true where another row has the same keys (JN-04)."""
    return df.withColumn("ambiguous", F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1)


def in_slices(left: DataFrame, right: DataFrame, key: Sequence[str], left_id: str, right_id: str, size: int) -> DataFrame:
    """Every pair of a row of ``left`` and one of ``right`` with the same ``key``, as an inner join gives them.

    Keys that many rows of both have are cut: each side is dealt by its id to slices of about ``size`` rows, of which a
    key has ``MOST_SLICES`` at most, so that rows are copied no more often, and each slice of one meets each of the
    other in a task of its own. Rows are few beside their pairs, so slices are spread over a fixed number of tasks,
    which are not put together by size.
    """
    counted = lambda rows, name: rows.groupBy(*key).agg(F.least(F.ceil(F.count(F.lit(1)) / size), F.lit(MOST_SLICES)).cast("int").alias(name))
    # Spark takes rows that an expression has made many of for as few as they were read, and would broadcast them
    cut = F.broadcast(counted(left, "_of_a").join(counted(right, "_of_b").hint("merge"), list(key)).filter("_of_a > 1 OR _of_b > 1"))  # as many rows as there are slices at most
    of = lambda side: F.coalesce(side, F.lit(1))
    dealt = lambda column, n: F.pmod(F.xxhash64(column), of(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), of(n) - 1))
    one = left.join(cut, list(key), "left").withColumn("_slice_a", dealt(left_id, F.col("_of_a"))).withColumn("_slice_b", upto(F.col("_of_b"))).drop("_of_a", "_of_b")
    other = right.join(cut, list(key), "left").withColumn("_slice_b", dealt(right_id, F.col("_of_b"))).withColumn("_slice_a", upto(F.col("_of_a"))).drop("_of_a", "_of_b")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a key of one value would be left out of the join, which would then not keep to these tasks
    one, other = (rows.withColumns({k: F.when(F.col("_slice_a") >= 0, F.col(k)) for k in key}).repartition(tasks, *key, "_slice_a", "_slice_b") for rows in (one, other))
    return one.join(other.hint("merge"), [*key, "_slice_a", "_slice_b"]).drop("_slice_a", "_slice_b")
