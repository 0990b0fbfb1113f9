"""Token ids of documents as compressed files, and back.

Documents are laid out in ascending doc_id order in ranges, one file a range;
a range is tokenized as it is written, in frames (``rans``) of whole documents
whose blocks share the frame's frequency table. Only a document of more than
``FRAME`` ids runs over several frames. A row of the files is a frame: the
range (``part``), the place of its first id in the range, the documents in it
and the coded ids. Frames, their blocks and the checkpoints in these are read
independently of each other; a damaged frame is an error.

Texts are cut into units where byte-level pre-tokens always end (before white
space, between letters, digits and punctuation), so each unit that is not
remembered is given to the tokenizer once; ids are those of the whole text.

Defined cases: a null text counts as empty and has the end id only; a null
doc_id comes after all others; rows of one doc_id stand in the order of a hash
of their texts, and equal rows, of which each has its own ids, in any order;
the string of a special token in a text becomes that token, as the tokenizer
has it; an empty table gives files without frames; extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import rans
from quorumlake.llm.common import shared_folder
from quorumlake.llm.words import slabs

VOCABULARY = "byte_bpe_50k.json"
END = 2
#: Ids of a frame, about; units that are given to the tokenizer as one text; bytes of texts that are cut into units together.
FRAME, LINES, UNITS_SLAB = 1 << 21, 4096, 1 << 23
FILES = "part int, at long, n_ids long, cut boolean, doc_start long, doc_id array<long>, n array<int>, frame binary"


#: Classes of bytes. "<" may begin a special token and "|" ends words within one, so neither is an ordinary sign.
OTHER, SPACE, FEED, SIGN, BAR, LESS, LETTER, DIGIT, LATIN, TWO, INNER, WIDE = range(12)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, dtype=np.uint8)
    out[0x21:0x7F] = SIGN
    out[0x20], out[[0x09, 0x0A, 0x0D]] = SPACE, FEED
    out[ord("|")], out[ord("<")] = BAR, LESS
    out[ord("0") : ord("9") + 1] = DIGIT
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1] = LETTER
    # first bytes of two-byte characters from U+00C0 on, none of which is white space, and further bytes
    out[0xC3], out[0xC4:0xE0], out[0x80:0xC0] = LATIN, TWO, INNER
    return out


CLASS = _classes()
SIGNS = (0x97, 0xB7)  # second bytes of the two characters from U+00C0 to U+00FF that are no letters


def _cuts() -> tuple[np.ndarray, np.ndarray]:
    """Whether a pre-token ends between two bytes by their classes, and whether the first is a last blank before a word."""
    cut, opens = np.zeros((16, 16), dtype=bool), np.zeros((16, 16), dtype=bool)
    cut[np.ix_([SIGN, BAR, LESS, LETTER, DIGIT, WIDE], [SPACE, FEED])] = True
    cut[np.ix_([LETTER, DIGIT], [SIGN, LESS])] = cut[LETTER, DIGIT] = cut[DIGIT, LETTER] = True
    opens[np.ix_([SPACE, FEED], [SIGN, BAR, LETTER, DIGIT, LATIN, TWO])] = True
    return cut.reshape(-1), opens.reshape(-1)


CUT, OPENS = _cuts()


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units of the texts begin; ``offsets`` are the texts' own bounds."""
    cut = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 1:
        here = CLASS[data]
        before = here[:-1].copy()  # the class of the character that ends there
        inner = before[1:] == INNER
        latin = inner & (here[:-2] == LATIN)
        latin &= (data[1:-1] != SIGNS[0]) & (data[1:-1] != SIGNS[1])
        before[1:][inner & (here[:-2] >= LATIN) & (here[:-2] <= TWO)] = WIDE
        before[1:][latin] = LETTER
        pair = (before << 4) | here[1:]
        cut[1:-1] = CUT[pair]
        last = OPENS[pair]  # the last blank of a run goes with the word, or alone if it is no space
        bounds = offsets[1:-1]
        last[bounds[(bounds > 0) & (bounds < len(data))] - 1] = False  # the next text doesn't follow
        cut[:-2] |= last
        cut[1:-1] |= last & (before == FEED)
    cut[offsets[:-1]] = True
    cut[len(data)] = False
    return np.flatnonzero(cut)


def plain_units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which units stay as they are between line feeds: one blank or none before a visible character, none after the last, no line feed."""
    first, last = CLASS[data[starts]], CLASS[data[ends - 1]]
    second = CLASS[data[np.minimum(starts + 1, ends - 1)]]
    before_last = CLASS[data[np.maximum(ends - 2, starts)]]
    visible = lambda x: (x >= SIGN) & (x <= DIGIT)
    solid = lambda x: (x >= SIGN) & (x <= TWO)
    opens = solid(first) | ((first == SPACE) & solid(second))
    closes = visible(last) | ((last == INNER) & ((before_last == LATIN) | (before_last == TWO)))
    feeds = np.concatenate(([0], np.cumsum(data == 0x0A)))
    return opens & closes & (feeds[ends] == feeds[starts])


class Encoder:
    """Ids of texts by the tokenizers library; units that were met are remembered."""

    def __init__(self, vocabulary: bytes, most: int = 1 << 19) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts = all(t[:1] == b"<" and len(unit_starts(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)]))) == 1 for t in special)
        self.seen: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.most = most

    def _each(self, units: list[bytes]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)
        return [np.array(c.ids, dtype="<u4").tobytes() for c in coded]

    def _together(self, units: list[bytes]) -> list[bytes]:
        """As ``_each``, of plain units, as lines of one text: a line feed is a token of its own there."""
        out = []
        for low in range(0, len(units), LINES):
            lines = units[low : low + LINES]
            ids = np.array(self.tokenizer.encode_batch_fast([b"\n".join(lines).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(ids == self.feed[0]) if len(self.feed) == 1 else np.zeros(0, dtype=np.int64)
            if len(at) != len(lines) - 1:  # a vocabulary that joins line feeds with others
                out += self._each(lines)
                continue
            raw, bounds = ids.tobytes(), (4 * np.concatenate(([-1], at, [len(ids)]))).tolist()
            out += [raw[x + 4 : y] for x, y in zip(bounds, bounds[1:])]
        return out

    def units(self, units: list[bytes], plain: np.ndarray) -> list[bytes]:
        """The ids of each of ``units``, little-endian."""
        out = list(map(self.seen.get, units))
        missing = [i for i, ids in enumerate(out) if ids is None]
        new = []
        for i in missing:
            ids = out[i] = self.older.get(units[i])
            if ids is None:
                new.append(i)
        for code, chosen in ((self._together, [i for i in new if plain[i]]), (self._each, [i for i in new if not plain[i]])):
            own = [units[i] for i in chosen]
            for i, ids in zip(chosen, code(own) if own else []):
                out[i] = ids
        # two generations: what was not met since the last change goes with the older one
        if len(self.seen) + len(missing) > self.most:
            self.seen, self.older = {}, self.seen
        if len(missing) <= self.most:
            self.seen.update((units[i], out[i]) for i in missing)
        return out

    def texts(self, texts: pa.Array, end: int = END) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts in order: all their ids, each text's followed by ``end``, and the number of ids of each."""
        for _, data, offsets in slabs(texts, UNITS_SLAB):
            # special tokens that a cut could split leave whole texts as units
            starts = unit_starts(data, offsets) if self.cuts else np.unique(offsets[:-1][np.diff(offsets) > 0])
            bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
            units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
            own = units.dictionary.buffers()
            own_bounds = np.frombuffer(own[1], dtype=np.int64, count=len(units.dictionary) + 1)
            plain = plain_units(np.frombuffer(own[2] or b"", dtype=np.uint8), own_bounds[:-1], own_bounds[1:])
            coded = self.units(units.dictionary.to_pylist(), plain)
            size = np.fromiter(map(len, coded), dtype=np.int32, count=len(coded)) >> 2
            flat = np.frombuffer(b"".join(coded) + end.to_bytes(4, "little"), dtype="<u4")
            which = units.indices.to_numpy(zero_copy_only=False)
            # the end id is a unit of its own after the units of each text
            ends = np.searchsorted(starts, offsets[1:])
            which = np.insert(which, ends, len(coded))
            kind = np.int32 if len(data) < 1 << 28 else np.int64  # fewer ids than bytes and texts together
            size, first = np.append(size, np.int32(1)), np.append(np.cumsum(size, dtype=kind) - size, kind(len(flat) - 1))
            taken = size[which]
            total = np.cumsum(taken, dtype=kind)
            ids = flat[np.arange(total[-1], dtype=kind) + np.repeat(first[which] - (total - taken), taken)]
            last = ends + np.arange(1, len(ends) + 1)
            yield ids, np.diff(total[last - 1], prepend=0)


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: bytes) -> Encoder:
    return Encoder(vocabulary)


def vocabulary_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return f.read()


class _Range:
    """Frames of the documents of one range, as they come."""

    def __init__(self, part: int, most: int) -> None:
        self.part, self.most, self.at = part, most, 0
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int]] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[dict]:
        if self.docs and self.size + len(ids) > self.most:
            yield self.close(None)
        if len(ids) > self.most:
            start = self.at
            for low in range(0, len(ids), self.most):
                part = ids[low : low + self.most]
                self.ids, self.docs, self.size = [part], [(doc_id, len(part))], len(part)
                yield self.close(start)
        else:
            self.ids.append(ids)
            self.docs.append((doc_id, len(ids)))
            self.size += len(ids)

    def close(self, doc_start: int | None) -> dict:
        row = {
            "part": self.part,
            "at": self.at,
            "n_ids": self.size,
            "cut": doc_start is not None,
            "doc_start": doc_start,
            "doc_id": [d for d, _ in self.docs],
            "n": [n for _, n in self.docs],
            "frame": rans.pack(np.concatenate(self.ids)),
        }
        self.at += self.size
        self.ids, self.docs, self.size = [], [], 0
        return row


def _arrow(kind: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(kind))


def write_ids(docs: DataFrame, folder: str, *, vocabulary: str | None = None, end: int = END, frame: int = FRAME) -> None:
    """Files of the ids of ``docs`` in ``folder``, ranges of doc_id in ascending order.

    The vocabulary (a few MB, whatever the input) is sent to the tasks; texts are shuffled once, into their ranges.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    schema = _arrow(FILES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = _encoder(sent.value), _Range(TaskContext.get().partitionId(), frame)

        def row(r: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([r], schema=schema)

        for batch in batches:
            doc_ids, k = batch.column("doc_id").to_pylist(), 0
            for ids, counts in encoder.texts(batch.column("text"), end):
                bounds = np.concatenate(([0], np.cumsum(counts)))
                for i in range(len(counts)):
                    for r in out.add(doc_ids[k], ids[bounds[i] : bounds[i + 1]]):
                        yield row(r)
                    k += 1
        if out.docs:
            yield row(out.close(None))

    # equal rows are told apart by their place in the input, so that a range can end among them
    order = F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("place")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    laid = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    laid.select("doc_id", "text").mapInArrow(run, FILES).write.option("compression", "none").parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of every document in the files.

    The number of ids of each range, a row a file, passes through the driver.
    """
    files = spark.read.schema(FILES).parquet(folder)
    kind = "part int, doc_start long, at long, doc_id long, ids binary"
    schema = _arrow(kind)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                ids, n = rans.Frame(r["frame"]).ids(), np.array(r["n"], dtype=np.int64)
                if len(ids) != r["n_ids"] or n.sum() != len(ids):
                    raise ValueError("a frame of ids holds other documents than are listed")
                at = np.cumsum(n) - n
                starts = [r["doc_start"]] if r["cut"] else (r["at"] + at).tolist()
                bounds = pa.py_buffer(np.append(4 * at, 4 * len(ids)).astype(np.int32))
                column = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, bounds, pa.py_buffer(ids.tobytes())])
                columns = [pa.array([r["part"]] * len(n), pa.int32()), pa.array(starts, pa.int64()), pa.array((r["at"] + at).tolist(), pa.int64()), pa.array(r["doc_id"], pa.int64()), column]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        return rows.head(1).assign(ids=b"".join(rows["ids"]))

    whole = files.filter("cut = false").mapInArrow(decode, kind)
    # a document of several frames is one row in the end, as long as its text
    long = files.filter("cut = true").mapInArrow(decode, kind).groupBy("part", "doc_start").applyInPandas(lambda key, rows: joined(rows), kind)
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, so_far = [], 0
    for part, n in totals:
        before.append((part, so_far))
        so_far += n
    offsets = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    every = whole.unionByName(long).join(offsets, "part")
    return every.select("doc_id", (F.col("before") + F.col("doc_start")).alias("start"), F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids")


def round_trip(docs: DataFrame, *, vocabulary: str | None = None, end: int = END, frame: int = FRAME) -> DataFrame:
    """``read_ids`` of files that ``write_ids`` makes in the shared folder."""
    folder = f"{shared_folder(docs.sparkSession)}/{uuid.uuid4().hex}"
    write_ids(docs, folder, vocabulary=vocabulary, end=end, frame=frame)
    return read_ids(docs.sparkSession, folder)
