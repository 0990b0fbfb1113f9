"""Token files, the manifest and vector codes: hard rows, and plain versions to hold results against."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quorumlake.llm import codes, manifest, queries, rans, token_files
from tests.llm.test_operators import DOCS, hard_rows, prose

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def wide(df):
    """``df`` with columns that no operator knows, and with names that operators use themselves."""
    names = ("leaf", "seen", "place", "row", "range", "pos", "total", "part", "at", "frame", "ids", "v", "now", "before", "code", "error", "tie", "path", "g")
    return df.withColumns({n: F.lit("clash") for n in names if n not in df.columns})


# ---- frames


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, rans.SEGMENT, rans.SEGMENT + 1, rans.BLOCK, rans.BLOCK + 1, 3 * rans.BLOCK - 7])
def test_frames_give_back_their_ids(n):
    rng = np.random.default_rng(n)
    for ids in (rng.zipf(1.3, n) % 50_257, rng.integers(0, 1 << 32, n), np.full(n, 7)):
        ids = ids.astype(np.uint32)
        if len(np.unique(ids)) > 1 << 17:
            continue
        frame = rans.Frame(rans.pack(ids))
        assert frame.n == n and np.array_equal(frame.ids(), ids)
        for start, end in ((0, 5), (n // 2, n // 2 + 900), (n - 3, n), (n, n + 5), (rans.SEGMENT - 1, rans.SEGMENT + 1)):
            start = max(0, start)
            assert np.array_equal(frame.ids(start, end), ids[start:end])


def test_frames_are_small():
    """A skewed distribution costs little more than its entropy, of which the table and the lanes' states are a small part."""
    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.5, 1 << 21) % 50_257).astype(np.uint32)
    counts = np.unique(ids, return_counts=True)[1] / len(ids)
    entropy = -(counts * np.log2(counts)).sum() * len(ids) / 8
    assert len(rans.pack(ids)) < 1.15 * entropy


def test_damaged_frames_are_errors():
    ids = np.arange(5000, dtype=np.uint32) % 300
    whole = rans.pack(ids)
    for at in (0, 5, 40, len(whole) // 2, len(whole) - 6, len(whole) - 1):
        broken = bytearray(whole)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            rans.Frame(bytes(broken)).ids()
    for cut in (whole[:-1], whole[:10], b""):
        with pytest.raises(ValueError):
            rans.Frame(cut)
    # a checkpoint that was changed with its checksum is found by the ids' own
    head = bytearray(whole[:-4])
    head[-40] ^= 4
    with pytest.raises(ValueError):
        rans.Frame(bytes(head) + zlib.crc32(bytes(head)).to_bytes(4, "little")).ids()


def test_frequencies_fill_the_table():
    for counts in ([1], [1, 1, 1], [10**9, 1, 1], list(range(1, 3000))):
        freq, bits = rans.frequencies(np.array(counts))
        assert freq.sum() == 1 << bits and freq.min() >= 1


# ---- token ids


@pytest.fixture(scope="module")
def tokenizer():
    return token_files.Encoder(token_files.vocabulary_bytes())


PIECES = ["a", "é", "…", " ", "  ", "\n", "\r\n", "\t", " ", "　", "'s", "'", "don't", "x,y", ".", "!?", "123", "<|endoftext|>", "日本", "中 ", "\x1c", "\x85", " .", " ,", " 's", "​", "ÿ", "ß ", "×", "Ω", "🙂", " 🙂", "\x00", "-", "--", "THE", "<|", "|>", "a1", "1b", "é1", "é'", "\x0b", " <b", "\n<", "²", "½", "_"]


@pytest.mark.parametrize("seed", range(3))
def test_units_have_the_ids_of_the_whole_text(tokenizer, seed):
    """White space, letters, digits, signs and special tokens in any order, encoded whole by the library itself."""
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(6000)] + ["", None, " " * 300, "x" * 5000, prose(rng, 3000)]
    got = []
    for ids, counts in tokenizer.texts(pa.array(texts, pa.string())):
        bounds = np.concatenate(([0], np.cumsum(counts)))
        got += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert got == [e.ids + [2] for e in tokenizer.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_forgotten_units_are_encoded_again():
    small = token_files.Encoder(token_files.vocabulary_bytes(), most=8)
    texts = ["one two three four five six seven", "two three", "one two three four five six seven"] * 3
    ids = np.concatenate([i for i, _ in small.texts(pa.array(texts))])
    assert ids.tolist() == [x for t in texts for x in [*small.tokenizer.encode(t, add_special_tokens=False).ids, 2]]
    assert len(small.seen) + len(small.older) <= 16


def plain_ids(tokenizer, rows):
    """doc_id, start, n_tokens, ids in order of doc_id; of equal doc_ids the counts by text alone are certain."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = tokenizer.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def digests(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()), key=repr)


@pytest.mark.parametrize("frame", [1 << 21, 64, 7])
def test_token_files_round_trip(spark, tokenizer, frame):
    """Frames smaller than most documents cut them, and what is read is still whole."""
    rng = random.Random(4)
    rows = [(i * 3, rng.choice([prose(rng, rng.randrange(40)), "", None, "é…\n\n x" * rng.randrange(9)])) for i in range(60)]
    rng.shuffle(rows)
    docs = wide(spark.createDataFrame(rows, "doc_id long, text string"))
    assert digests(token_files.round_trip(docs, frame=frame)) == sorted(plain_ids(tokenizer, rows), key=repr)


def test_token_files_of_hard_rows(spark, tokenizer):
    rows = [(r[0], r[1]) for r in hard_rows()]
    found = token_files.round_trip(spark.createDataFrame(hard_rows(), DOCS)).collect()
    assert len(found) == len(rows)
    # every row has its own ids, which follow each other without gaps in the order of the ids of documents
    found = sorted(found, key=lambda r: r.start)
    assert [r.start for r in found] == [sum(r.n_tokens for r in found[:i]) for i in range(len(found))]
    assert [r.doc_id for r in found] == sorted([r[0] for r in rows], key=lambda i: (i is None, i or 0))
    own = lambda rs: sorted(((d, n, c) for d, _, n, c in rs), key=repr)
    assert own((r.doc_id, 0, r.n_tokens, zlib.crc32(r.ids)) for r in found) == own(plain_ids(tokenizer, rows))
    assert token_files.round_trip(spark.createDataFrame([], DOCS)).count() == 0


def test_token_files_in_many_ranges(spark, tokenizer):
    """One doc_id with most rows, all of one text: ranges end among equal rows."""
    rows = [(5, "same words here")] * 300 + [(i, f"text {i}") for i in range(20) if i != 5]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = sorted(token_files.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r.start)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in found] == plain_ids(tokenizer, rows)


def test_query_of_token_files_against_the_library(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert plain(queries.op11_token_files(spark, folder).collect()) == plain(plain_ids(tokenizer, rows))


# ---- manifest


def node(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return node(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def plain_tree(nodes):
    """The root, and for each node the siblings on its way, level by level, left to right, with its place in the run."""
    paths, spots = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(spots):
            run = nodes[at - at % 8 : at - at % 8 + 8]
            paths[i].append((at % 8, run[: at % 8] + run[at % 8 + 1 :]))
        nodes = [node(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
        spots = [at // 8 for at in spots]
    return nodes[0] if nodes else None, paths


def plain_manifest(rows, change):
    langs = {}
    for row in rows:
        langs.setdefault(row["lang"], []).append(row)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    subroots, below = [], {}
    for lang in order:
        own = sorted(langs[lang], key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, plain_leaf(r)))
        subroot, paths = plain_tree([plain_leaf(r) for r in own])
        subroots.append(subroot)
        below[lang] = list(zip(own, paths))
    root, above = plain_tree(subroots)
    out = []
    for lang, subroot, upper in zip(order, subroots, above):
        for row, path in below[lang]:
            way = path + upper
            fold = plain_leaf(row | {"text": change(row)})
            for place, others in way:
                fold = node(*others[:place], fold, *others[place:])
            proof = node(*(s for _, others in way for s in others))
            out.append((row["doc_id"], plain_leaf(row), subroot, root, proof, fold, fold == root))
    return plain(out)


def lowered(row):
    if row["text"] is None or row["doc_id"] is None or zlib.crc32(str(row["doc_id"]).encode()) % 3:
        return row["text"]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])


def verified(spark, df):
    one_in_three = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest.verified(df, text=F.when(one_in_three, manifest.lower_ascii(F.col("text"))).otherwise(F.col("text")))


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65, 73, 511, 513, 4095])
def test_fractal_paths_are_those_of_the_whole_tree(n):
    leaves = [node(str(i)) for i in range(n)]
    root, expected = plain_tree(leaves)
    got = list(manifest.paths(leaves, True))
    assert got == [[(place, "".join(others)) for place, others in path] for path in expected]
    assert got == list(manifest.paths(leaves, True, height=1)) == list(manifest.paths(leaves, True, height=3))
    if n:
        assert manifest.block_root(leaves, True) == root
        assert all(manifest.folded(x, path) == root for x, path in zip(leaves, got))


def test_short_block_of_a_long_row_has_all_levels():
    """The last block of several: a run of one node is hashed too."""
    for n in (1, 3, 9, 70):
        leaves = [node(str(i)) for i in range(n)]
        root = manifest.block_root(leaves, False)
        for x, path in zip(leaves, manifest.paths(leaves, False)):
            assert len(path) == manifest.LEVELS and manifest.folded(x, path) == root
    assert manifest.block_root(["ab"], False) == node(node(node(node("ab"))))


def test_a_traversal_keeps_two_subtrees_a_layer():
    class Counted(manifest.Growing):
        most = 0

        def _put(self, level, digest):
            super()._put(level, digest)
            Counted.most = max(Counted.most, sum(map(len, self.nodes)) + sum(map(len, self.runs)))

    leaves = [node(str(i)) for i in range(4096)]
    real, manifest.Growing = manifest.Growing, Counted
    try:
        assert sum(1 for _ in manifest.paths(leaves, True)) == 4096
    finally:
        manifest.Growing = real
    assert Counted.most < 2 * 8**manifest.HEIGHT  # of 4,681 nodes


def test_manifest_of_hard_rows(spark):
    df = spark.createDataFrame(hard_rows(), DOCS)
    rows = [r.asDict() for r in df.collect()]
    assert plain(verified(spark, wide(df)).collect()) == plain_manifest(rows, lowered)
    assert verified(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("counts", [{"en": 1}, {"en": 1, "fr": 1}, {"en": 700, None: 9, "fr": 1, "ä": 64}, {f"l{i:02}": 1 + i % 3 for i in range(75)}])
def test_manifest_against_a_plain_tree(spark, counts):
    """Blocks of 64 leaves, so that small tables have several layers of them."""
    rows, rng = [], random.Random(len(counts))
    for lang, n in counts.items():
        rows += [{"doc_id": rng.randrange(10 * n), "text": f"Text {i} ÄB", "lang": lang, "source": rng.choice(["s", None]), "n_chars": i} for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], DOCS)
    blocks, _, root = manifest.manifest(df.withColumn("leaf", manifest.leaf()), levels=2)
    assert blocks.count() == sum(math.ceil(n / 64) for n in counts.values())
    own, expected = manifest.proofs(df, levels=2).collect(), plain_manifest(rows, lowered)
    assert {r.root for r in own} == {root} == {r[3] for r in expected}
    assert all(manifest.folded(r.leaf, [(s.place, s.siblings) for s in r.path]) == root for r in own)
    got = []
    for r in own:
        row = next(x for x in rows if plain_leaf(x) == r.leaf)
        got.append((r.doc_id, r.leaf, r.subroot, r.root, node(*(s.siblings for s in r.path)), manifest.folded(plain_leaf(row | {"text": lowered(row)}), [(s.place, s.siblings) for s in r.path])))
    assert plain(got) == plain(r[:6] for r in expected)


def test_manifest_of_equal_rows(spark):
    """A row that repeats has a leaf and a proof each time."""
    rows = [{"doc_id": 1, "text": "A", "lang": "en", "source": None, "n_chars": 1}] * 40
    df = spark.createDataFrame([(1, "A", "en", None, 1)] * 40, DOCS)
    assert plain(verified(spark, df).collect()) == plain_manifest(rows, lowered)


# ---- vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    by_id = {}
    for i, _, v in kept:
        by_id[i] = min(by_id.get(i, v), v)
    first = sorted(by_id, key=lambda i: (i is None, i or 0))[:entries]
    if not first:
        return []
    length = len(by_id[first[0]])
    kept = [k for k in kept if len(k[2]) == length]
    cuts = [(j * length // parts, (j + 1) * length // parts) for j in range(parts)]
    books = [[by_id[i][a:b] for i in first if len(by_id[i]) == length] for a, b in cuts]
    gap = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y))
    nearest = lambda x, book: min((gap(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for j, (a, b) in enumerate(cuts):
            groups = {}
            for _, _, v in kept:
                groups.setdefault(nearest(v[a:b], books[j])[1], []).append(v[a:b])
            for e, own in groups.items():
                books[j][e] = [sum(xs) // len(own) for xs in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    out, totals = [], {}
    for i, label, v in kept:
        found = [nearest(v[a:b], book) for (a, b), book in zip(cuts, books)]
        error = sum(d for d, _ in found)
        totals[label] = totals.get(label, 0) + error
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), error))
    return plain((i, code, error, totals[label], digest) for i, label, code, error in out)


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(rng, n, length):
    return [(i * 2, [float(np.float32(rng.gauss(0, 0.1))) for _ in range(length)], rng.choice([0, 1, 1, 1, None])) for i in range(n)]


@pytest.mark.parametrize("n, length", [(150, 32), (40, 16), (90, 21), (1, 16), (70, 5)])
def test_codes_against_plain_lloyd(spark, n, length):
    """More and fewer vectors than entries, parts of unequal length and empty ones."""
    rows = vectors(random.Random(n), n, length)
    df = wide(spark.createDataFrame(rows, VECTORS))
    assert plain(codes.with_label_errors(codes.coded(df)).collect()) == plain_codes(rows)


def test_codes_of_hard_rows(spark):
    """Nulls in every column, components that are no numbers, repeated ids and rows, ties, other lengths, no components."""
    rng = random.Random(1)
    rows = vectors(rng, 70, 16)
    rows += [(0, [0.5] * 16, 1), (0, [-0.5] * 16, 1), (3, None, 1), (5, [None] * 16, 1), (7, [float("nan")] + [0.1] * 15, 1), (9, [float("inf")] * 16, None), (None, [0.25] * 16, None), (None, [0.25] * 16, None)]
    rows += [(11, [0.1] * 8, 2), (13, [], 2)] + [(15, [0.125] * 16, 3)] * 30
    got = plain(codes.with_label_errors(codes.coded(spark.createDataFrame(rows, VECTORS))).collect())
    assert got == plain_codes(rows)
    assert codes.coded(spark.createDataFrame([], VECTORS)).count() == 0
    assert codes.coded(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0
    assert [r.code for r in codes.coded(spark.createDataFrame([(1, [], 1), (2, [], 1)], VECTORS)).collect()] == ["00" * 16] * 2


def test_codes_move_only_what_changed(spark):
    """After a round that changes nothing there is no contribution, and sums kept through rounds are those of the last assignment."""
    rows = vectors(random.Random(8), 200, 16)
    state, books = codes.trained(spark.createDataFrame(rows, VECTORS), rounds=3)
    again = codes.assigned(state.drop("before"), books, 16, 16)
    moved = again.filter("before <> now").count()
    contributions = codes.deltas(again.filter("before = now"), 64, 16, 16)
    assert contributions.isEmpty() and 0 < moved < 200
    # running sums of two rounds against sums made anew
    one = codes.assigned(state.select("vec_id", "label", "v", F.lit(None).cast("array<int>").alias("now")), books, 16, 16)
    running = codes.deltas(state.withColumn("before", F.lit(None).cast("array<int>")), 64, 16, 16).unionByName(codes.deltas(again, 64, 16, 16))
    summed = lambda df: {(r.part, r.entry, r.place): (r.total, r.n) for r in df.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect() if r.total or r.n}
    assert summed(running) == summed(codes.deltas(one, 64, 16, 16))


def test_codes_with_large_components(spark):
    """Beyond what floats hold exactly, whole numbers are used; what doesn't fit is an error."""
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-(2**17), 2**17)) for _ in range(16)], 0) for i in range(80)]
    assert plain(codes.with_label_errors(codes.coded(spark.createDataFrame(rows, VECTORS))).collect()) == plain_codes(rows)
    with pytest.raises(Exception, match="too large"):
        codes.coded(spark.createDataFrame([(1, [1e9] * 16, 0)], VECTORS)).collect()


def test_label_errors_of_many_labels(spark):
    """Beyond the number of labels that are broadcast the result is the same."""
    rows = codes.coded(spark.createDataFrame(vectors(random.Random(3), 120, 16), VECTORS))
    assert plain(codes.with_label_errors(rows, most_broadcast=0).collect()) == plain(codes.with_label_errors(rows).collect())
