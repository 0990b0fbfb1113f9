"""A Merkle manifest of documents, with the authentication path of each.

A document's leaf is the sha256 of its fields. The leaves of a language stand
in ascending doc_id order; every eight consecutive nodes become one until one,
the language's subroot, is left, and the subroots in order of language give the
root in the same way. Leaves are dealt into aligned blocks of 8**4.
A block's root needs the block alone, and roots of blocks are the leaves of the
next layer, so layers of tables of a 4,096th of the rows each lead to the root.

Paths go the other way. The path from a block up is joined to the block, a row
of it, and the block's own paths come from a fractal traversal: of each layer
of subtrees two levels high the existing one, through which the present leaf's
path runs, and the desired one beside it, which grows by a leaf a step and takes
the existing one's place when the traversal leaves that. Nodes within a subtree
are the only ones kept.

Defined cases: a null field is "-"; a null lang is a language of its own, before
all others; a null doc_id comes after all others of its language; rows of one
doc_id stand in the order of their leaves, and equal rows in any order; a
language of one document has its leaf as subroot, one language's subroot is the
root; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorumlake.llm.common import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, BITS = 8, 3
#: Levels of a block, and of a subtree in it.
LEVELS, HEIGHT = 4, 2
PATH = "array<struct<place: int, siblings: string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def leaf(**changed: Column) -> Column:
    """The digest of a document's fields, some of them ``changed``."""

    def field(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(field(name) for name in FIELDS)), 256)


def joined(run: Sequence[str]) -> str:
    return sha256("".join(run).encode()).hexdigest()


def levels_of(n: int, alone: bool, most: int = LEVELS) -> int:
    """Levels above the ``n`` nodes of a block: ``most``, or as many as lead to one node where the block is ``alone``."""
    levels = 0
    while ARITY**levels < n:
        levels += 1
    return levels if alone else most


class Growing:
    """A subtree that takes in leaves from ``start`` on, one at a time; nodes of the levels from ``low`` to below ``top`` are kept."""

    def __init__(self, leaves: Sequence[str], start: int, low: int, top: int) -> None:
        self.leaves, self.at, self.low, self.top = leaves, start, low, top
        self.end = min(len(leaves), start + ARITY**top)
        self.runs: list[list[str]] = [[] for _ in range(top + 1)]
        self.nodes: list[list[str]] = [[] for _ in range(top - low)]

    def _put(self, level: int, node: str) -> None:
        if self.low <= level < self.top:
            self.nodes[level - self.low].append(node)
        run = self.runs[level]
        run.append(node)
        if len(run) == ARITY and level < self.top:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        self._put(level + 1, joined(run))

    def step(self) -> None:
        if self.at < self.end:
            self._put(0, self.leaves[self.at])
            self.at += 1
            if self.at == self.end:  # runs that the last leaf leaves short
                for level in range(self.top):
                    if self.runs[level]:
                        self._close(level)

    def whole(self) -> Growing:
        while self.at < self.end:
            self.step()
        return self

    @property
    def root(self) -> str:
        return self.runs[self.top][0]


def block_root(leaves: Sequence[str], alone: bool, most: int = LEVELS) -> str:
    levels = levels_of(len(leaves), alone, most)
    return Growing(leaves, 0, levels, levels).whole().root


def paths(leaves: Sequence[str], alone: bool, most: int = LEVELS, height: int = HEIGHT) -> Iterator[list[tuple[int, str]]]:
    """For each leaf of a block in order: its place in its run and the run's other nodes, level by level."""
    levels = levels_of(len(leaves), alone, most)
    spans = [(low, min(low + height, levels)) for low in range(0, levels, height)]
    existing = [Growing(leaves, 0, low, top).whole() for low, top in spans]
    desired = [Growing(leaves, ARITY**top, low, top) for low, top in spans]
    for i in range(len(leaves)):
        for k, (low, top) in enumerate(spans):
            size = ARITY**top
            if i and i % size == 0:
                existing[k], desired[k] = desired[k], Growing(leaves, i + size, low, top)
        path = []
        for k, (low, top) in enumerate(spans):
            for level in range(low, top):
                at = (i >> BITS * level) - (i >> BITS * top << BITS * (top - level))  # within the subtree
                first = at - at % ARITY
                run = existing[k].nodes[level - low][first : first + ARITY]
                path.append((at % ARITY, "".join(run[: at % ARITY] + run[at % ARITY + 1 :])))
            desired[k].step()
        yield path


def folded(node: str, path: Sequence[tuple[int, str]]) -> str:
    """The root that ``node`` leads to beside the siblings of ``path``."""
    for place, siblings in path:
        node = joined((siblings[: 64 * place], node, siblings[64 * place :]))
    return node


def numbered(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """``rows`` with their position in their ``group`` and its number of rows, ``total``.

    Rows are sorted in ranges; what stands before each range is a sum over ranges, not over rows.
    """
    keys = F.col(group).asc_nulls_first(), *order
    laid = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("row", F.monotonically_increasing_id()).withColumn("range", F.shiftright("row", 33).cast("int")))
    per = laid.groupBy("range", F.col(group).alias("g")).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("g")
    so_far = F.sum("n").over(of.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select(F.col("range").alias("in_range"), "g", "first", F.coalesce(so_far, F.lit(0)).alias("before"), F.sum("n").over(of).alias("total"))
    same = (F.col("range") == F.col("in_range")) & F.col(group).eqNullSafe(F.col("g"))
    return laid.join(per, same).withColumn("pos", F.col("row") - F.col("first") + F.col("before")).drop("row", "range", "in_range", "g", "first", "before")


def in_blocks(nodes: DataFrame, levels: int, *columns: str) -> DataFrame:
    """lang, block, total and the block's ``nodes`` in order, each with pos and ``columns``."""
    rows = F.array_sort(F.collect_list(F.struct("pos", *columns)))
    return nodes.groupBy("lang", F.expr(f"pos div {ARITY**levels}").alias("block"), "total").agg(rows.alias("nodes"))


def roots(blocks: DataFrame, levels: int, name: str = "digest") -> DataFrame:
    """The roots of ``blocks`` as nodes of the next layer: lang, pos, total, digest."""
    size = ARITY**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [block_root(d, total <= size, levels) for d, total in zip(batch.column("digests").to_pylist(), batch.column("total").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("pos"), batch.column("total"), pa.array(out, pa.string())], names=["lang", "pos", "total", "digest"])

    found = blocks.select("lang", F.col("block").alias("pos"), "total", F.col(f"nodes.{name}").alias("digests")).mapInArrow(run, "lang string, pos long, total long, digest string")
    return found.withColumn("total", F.ceil(F.col("total") / size))


def layers(blocks: DataFrame, levels: int, name: str = "digest") -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every layer above ``blocks``, and lang and digest of what remains of each language."""
    out = []
    while True:
        nodes = written(roots(blocks, levels, name))
        if (nodes.agg(F.max("total")).first()[0] or 0) <= 1:
            return out, nodes.select("lang", "digest")
        blocks, name = written(in_blocks(nodes, levels, "digest")), "digest"
        out.append(blocks)


def below(blocks: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """lang, pos and path of each node of ``blocks``, of which ``above`` (lang, block, path) has the paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                upper = [(s["place"], s["siblings"]) for s in r["path"]]
                digests = [n["digest"] for n in r["nodes"]]
                found = [own + upper for own in paths(digests, r["total"] <= ARITY**levels, levels)]
                shaped = [[{"place": p, "siblings": s} for p, s in path] for path in found]
                kind = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())]))
                yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(found), pa.string()), pa.array([n["pos"] for n in r["nodes"]], pa.int64()), pa.array(shaped, kind)], names=["lang", "block", "path"])

    return _with_paths(blocks, above).mapInArrow(run, f"lang string, block long, path {PATH}")


def _with_paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    b, a = blocks.alias("b"), above.alias("a")
    return b.join(a, F.col("b.lang").eqNullSafe(F.col("a.lang")) & (F.col("b.block") == F.col("a.block"))).select("b.*", "a.path")


def manifest(docs: DataFrame, *kept: str, levels: int = LEVELS) -> tuple[DataFrame, DataFrame, str | None]:
    """Blocks of leaves with the path above each, lang and subroot of each language, and the root.

    ``docs`` has leaf, doc_id, lang and the columns ``kept``, which stay beside the leaves. The driver sees the root.
    """
    place = F.monotonically_increasing_id()
    rows = docs.select("doc_id", "lang", "leaf", *kept, place.alias("place"))
    leaves = numbered(rows, "lang", F.col("doc_id").asc_nulls_last(), F.col("leaf"), F.col("place"))
    base = written(in_blocks(leaves, levels, "doc_id", "leaf", *kept))
    upper, subroots = layers(base, levels, "leaf")
    tops = numbered(subroots.withColumnRenamed("lang", "own").withColumn("lang", F.lit("")), "lang", F.col("own").asc_nulls_first())
    top_blocks = written(in_blocks(tops.select("lang", "pos", "total", "own", "digest"), levels, "digest", "own"))
    top_layers, last = layers(top_blocks, levels)
    root = last.first()
    # from the root down: first among the languages, then within each
    start = F.array().cast(PATH).alias("path")
    above = last.select("lang", F.lit(0).cast("long").alias("block"), start)
    for blocks in [top_blocks, *top_layers][::-1]:
        above = below(blocks.select("lang", "block", "total", F.transform("nodes", lambda n: F.struct(n["pos"].alias("pos"), n["digest"].alias("digest"))).alias("nodes")), above, levels)
    named = top_blocks.select(F.explode("nodes").alias("n")).select("n.pos", "n.own", F.col("n.digest").alias("subroot"))
    languages = written(named.join(above, F.col("pos") == F.col("block")).select(F.col("own").alias("lang"), "subroot", "path"))
    above = languages.select("lang", F.lit(0).cast("long").alias("block"), "path")
    for blocks in upper[::-1]:
        above = below(blocks, above, levels)
    return _with_paths(base, above), languages.select("lang", "subroot"), root["digest"] if root else None


def _emitted(blocks: DataFrame, kind: str, row: object, levels: int) -> DataFrame:
    """One row per leaf of ``blocks``: what ``row`` makes of the leaf's node and path."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                upper = [(s["place"], s["siblings"]) for s in r["path"]]
                own = paths([n["leaf"] for n in r["nodes"]], r["total"] <= ARITY**levels, levels)
                rows = [row(n, path + upper) | {"lang": r["lang"]} for n, path in zip(r["nodes"], own)]
                for low in range(0, len(rows), 512):
                    yield pa.RecordBatch.from_pylist(rows[low : low + 512], schema=schema)

    return blocks.mapInArrow(run, kind)


def _with_subroots(rows: DataFrame, subroots: DataFrame, root: str | None) -> DataFrame:
    r, s = rows.alias("r"), subroots.alias("s")
    return r.join(s, F.col("r.lang").eqNullSafe(F.col("s.lang"))).select("r.*", "s.subroot", F.lit(root).cast("string").alias("root"))


def proofs(docs: DataFrame, *, levels: int = LEVELS) -> DataFrame:
    """doc_id, lang, leaf, path (place in the run and the run's other nodes, from the leaf up), subroot and root of every document."""
    blocks, subroots, root = manifest(docs.withColumn("leaf", leaf()), levels=levels)
    rows = _emitted(blocks, f"doc_id long, lang string, leaf string, path {PATH}", lambda n, path: {"doc_id": n["doc_id"], "leaf": n["leaf"], "path": [{"place": p, "siblings": s} for p, s in path]}, levels)
    return _with_subroots(rows, subroots, root)


def verified(docs: DataFrame, *, levels: int = LEVELS, **changed: Column) -> DataFrame:
    """Every document's leaf, subroot, root, digest of its proof, and the root that its fields as ``changed`` lead to beside the proof."""

    def row(n: dict, path: list[tuple[int, str]]) -> dict:
        return {"doc_id": n["doc_id"], "leaf": n["leaf"], "proof_sha256": joined([s for _, s in path]), "folded_root": folded(n["seen"], path)}

    blocks, subroots, root = manifest(docs.withColumns({"leaf": leaf(), "seen": leaf(**changed)}), "seen", levels=levels)
    rows = _emitted(blocks, "doc_id long, lang string, leaf string, proof_sha256 string, folded_root string", row, levels)
    out = _with_subroots(rows, subroots, root)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
