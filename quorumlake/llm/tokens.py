"""Edit-aware token counts over pre-token segment trees.

A document's text is cut into pre-tokens, which byte pairs never cross. Leaves
of a segment tree hold up to 16 of them, with their code points and tokens;
inner nodes hold sums. An edit is found by descending the sums of code points;
only the leaves it touches, with the leaves beside them that can change the
cut, are encoded again, and the sums above them are updated.

Defined cases: a null text counts as empty and has 0 tokens; edits are applied
in order, each to the text that the ones before left, and are cut off at the
text's ends; a null list of edits changes nothing; strings of special tokens
are ordinary text; equal rows count alike; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the pre-token pattern of the public byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens of a leaf; a leaf that edits have made larger than four times this makes the tree be built anew.
LEAF = 16
#: Code points of unchanged text that must lie between a cut that is kept and an edit.
CONTEXT = 8


class Counts:
    """Token counts of pre-tokens, of which the latest are remembered."""

    def __init__(self, vocabulary: bytes, most: int = 1 << 18) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(PATTERN).findall
        self.seen: dict[str, int] = {}
        self.most = most

    def of(self, pieces: list[str]) -> list[int]:
        out = list(map(self.seen.get, pieces))
        if None in out:
            if len(self.seen) > self.most:
                self.seen.clear()
            for i, n in enumerate(out):
                if n is None:
                    piece = pieces[i]
                    n = self.seen.get(piece)
                    if n is None:
                        n = self.seen[piece] = len(self.encoding.encode_ordinary(piece))
                    out[i] = n
        return out


@functools.lru_cache(maxsize=2)
def counts_for(vocabulary: bytes) -> Counts:
    return Counts(vocabulary)


class Tree:
    """Segment trees of code points, tokens and pre-tokens over the same leaves: row 1 is the root, 2i and 2i+1 are below i."""

    def __init__(self, nodes: np.ndarray) -> None:
        self.nodes = nodes  # (2 * size, 3)
        self.size = len(nodes) // 2

    @classmethod
    def over(cls, leaves: np.ndarray) -> Tree:
        size = 1 << max(0, len(leaves) - 1).bit_length()
        nodes = np.zeros((2 * size, 3), dtype=np.int32)
        nodes[size : size + len(leaves)] = leaves
        low = size
        while low > 1:
            nodes[low // 2 : low] = nodes[low : 2 * low : 2] + nodes[low + 1 : 2 * low : 2]
            low //= 2
        return cls(nodes)

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a code point, and where that leaf begins."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if place - before >= self.nodes[i, 0] and self.nodes[i + 1, 0]:
                before += int(self.nodes[i, 0])
                i += 1
        return i - self.size, before

    def put(self, first: int, leaves: np.ndarray) -> int:
        """Replace leaves from ``first`` on and the sums above them; the number of nodes written."""
        low, high = first + self.size, first + self.size + len(leaves)
        self.nodes[low:high] = leaves
        wrote = len(leaves)
        while low > 1:
            low, high = low // 2, (high + 1) // 2
            self.nodes[low:high] = self.nodes[2 * low : 2 * high : 2] + self.nodes[2 * low + 1 : 2 * high : 2]
            wrote += high - low
        return wrote

    def leaves(self) -> np.ndarray:
        return self.nodes[self.size :]


def leaves_of(pieces: list[str], tokens: list[int], leaf: int = LEAF) -> np.ndarray:
    n = len(pieces)
    if not n:
        return np.zeros((1, 3), dtype=np.int32)
    at = np.arange(0, n, leaf)
    each = np.array([list(map(len, pieces)), tokens], dtype=np.int64)
    return np.column_stack([*np.add.reduceat(each, at, axis=1), np.diff(np.append(at, n))]).astype(np.int32)


def build(text: str, counts: Counts) -> Tree:
    pieces = counts.cut(text)
    return Tree.over(leaves_of(pieces, counts.of(pieces)))


def apply_edit(text: str, tree: Tree, at: int, length: int, new: str, counts: Counts) -> tuple[str, Tree, int, int]:
    """The text and tree after ``new`` has replaced ``length`` code points at ``at``; pre-tokens encoded, nodes written."""
    n = len(text)
    at = min(max(0, at), n)
    stop = min(n, at + max(0, length))
    after = text[:at] + new + text[stop:]
    if not n:
        rebuilt = build(after, counts)
        return after, rebuilt, int(rebuilt.nodes[1, 2]), len(rebuilt.nodes)
    moved = len(new) - (stop - at)
    sizes = tree.leaves()[:, 0]
    # to the left: a cut is kept if unchanged text that is not only white space lies between it and the edit
    first, begin = tree.leaf_at(at)
    while first > 0 and (at - begin < CONTEXT or text[begin:at].isspace()):
        first -= 1
        begin -= int(sizes[first])
    # to the right: a cut is kept if cutting the new text, with what follows, meets it again
    last, end = tree.leaf_at(max(at, stop - 1))
    end += int(sizes[last])
    while True:
        beyond = end
        k = last
        while beyond < n and (beyond - max(end, stop) < CONTEXT or text[max(end, stop) : beyond].isspace()):
            k += 1
            beyond += int(sizes[k])
        pieces = counts.cut(after[begin : beyond + moved])
        if end >= n:
            break
        lengths = np.cumsum([len(p) for p in pieces])
        hit = int(np.searchsorted(lengths, end + moved - begin))
        if end >= stop and hit < len(lengths) and lengths[hit] == end + moved - begin:
            pieces = pieces[: hit + 1]
            break
        last += 1
        end += int(sizes[last])
    fine = leaves_of(pieces, counts.of(pieces))
    room = last - first + 1
    leaves = np.zeros((room, 3), dtype=np.int32)
    leaves[: min(room, len(fine))] = fine[:room]
    leaves[-1] += fine[room:].sum(axis=0, dtype=np.int32)
    if leaves[-1, 2] > 4 * LEAF:  # sums are put together anew; nothing more is encoded
        old = tree.leaves()
        tree = Tree.over(np.vstack([old[:first], fine, old[last + 1 :]]))
        return after, tree, len(pieces), len(tree.nodes)
    return after, tree, len(pieces), tree.put(first, leaves)


def count(docs: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with n_tokens, n_pretokens and the tree of every text; columns of these names are replaced."""
    docs = docs.drop("n_tokens", "n_pretokens", "tree")
    sent = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_for(sent.value)
        for batch in batches:
            trees = [build(t.as_py() or "", counts) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([int(t.nodes[1, 1]) for t in trees], pa.int64()), pa.array([int(t.nodes[1, 2]) for t in trees], pa.int64()), pa.array([t.nodes.tobytes() for t in trees], pa.binary())],
                names=[*names, "n_tokens", "n_pretokens", "tree"],
            )

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("n_pretokens", T.LongType()), T.StructField("tree", T.BinaryType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema, *added]))


def recount(counted: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """``counted`` after its ``edits``: an array of (at, length, new) in code points, which is dropped.

    text and tree are brought up to date; edited_chars, edited_tokens and
    edited_pretokens count the new text; n_encoded and n_nodes are the
    pre-tokens encoded and the tree nodes written.
    """
    added = ("edited_chars", "edited_tokens", "edited_pretokens", "n_encoded", "n_nodes")
    counted = counted.drop(*added)
    sent = counted.sparkSession.sparkContext.broadcast(_read(vocabulary))
    kept = [c for c in counted.columns if c not in ("text", "tree", "edits")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_for(sent.value)
        for batch in batches:
            texts, trees, numbers = [], [], []
            for text, nodes, edits in zip(*batch.columns[:2], batch.column(2).to_pylist(), strict=True):
                text, tree = text.as_py() or "", Tree(np.frombuffer(nodes.as_py(), dtype=np.int32).reshape(-1, 3).copy())
                encoded = wrote = 0
                for e in edits or ():
                    text, tree, a, b = apply_edit(text, tree, e["at"] or 0, e["length"] or 0, e["new"] or "", counts)
                    encoded, wrote = encoded + a, wrote + b
                texts.append(text)
                trees.append(tree.nodes.tobytes())
                numbers.append((len(text), int(tree.nodes[1, 1]), int(tree.nodes[1, 2]), encoded, wrote))
            columns = np.array(numbers, dtype=np.int64).reshape(-1, len(added)).T
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(texts, pa.string()), pa.array(trees, pa.binary()), *map(pa.array, columns)], names=[*kept, "text", "tree", *added])

    fields = [T.StructField(c, counted.schema[c].dataType) for c in kept] + [T.StructField("text", T.StringType()), T.StructField("tree", T.BinaryType())]
    schema = T.StructType(fields + [T.StructField(c, T.LongType()) for c in added])
    return counted.select("text", "tree", "edits", *kept).mapInArrow(run, schema)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def edited_counts(docs: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts of every text before and after three edits: a replacement a third in, an insertion two thirds in, and the first word's beginning deleted."""
    n = F.length("text")
    edit = lambda at, length, new: F.struct(F.floor(at).cast("int").alias("at"), F.lit(length).cast("int").alias("length"), new.alias("new"))
    edits = F.array(
        edit(n / 3, 24, F.upper(F.substring(F.col("text"), 1, 24))),
        edit(2 * n / 3, 0, F.concat(F.lit(" [edited: "), n.cast("string"), F.lit("] "))),
        edit(F.lit(0), 3, F.lit("")),
    )
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counted = count(own, vocabulary=vocabulary).withColumns({"n_chars": F.length("text").cast("long"), "edits": edits})
    return recount(counted, vocabulary=vocabulary).drop("text", "tree")
