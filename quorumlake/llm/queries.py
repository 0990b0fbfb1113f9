"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import codes, fingerprints, html_text, manifest, mixing, neardup, packing, quality, secrets, substrings, token_files, tokens, topk
from quorumlake.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.edited_counts(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("tie", "passes", "starts", "ends")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), quality.held_out().alias("held_out"), "score", "predicted")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    one_in_three = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(one_in_three, manifest.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return manifest.verified(table(spark, sf_dir, "documents"), text=text)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.with_label_errors(codes.coded(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_best_fit_packing, op3_source_mixing, op4_secret_scan, op5_exact_top_k, op6_minhash_near_dedup, op7_quality_classifier, op8_html_extraction, op9_document_fingerprints, op10_substring_dedup, op11_token_files, op12_merkle_manifest, op13_vector_codes)
}

def _secret_oracle() -> str:
    """Spans by splitting a text at a rule's matches: a match starts after the pieces and matches before it."""
    parts = []
    for k, rule in enumerate(secrets.RULES):
        pattern = ("(?i)" if rule.any_case else "") + rule.pattern.replace("'", "''")
        parts.append(f"""
            SELECT row_id, {k} AS kind_no, '{rule.kind}' AS kind, i, group_text,
                CAST(list_sum(list_transform(pieces[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(matches[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start, length(matches[i]) AS size
            FROM (SELECT row_id, string_split_regex(text, '{pattern}') AS pieces, regexp_extract_all(text, '{pattern}') AS matches, regexp_extract_all(text, '{pattern}', {rule.group}) AS groups FROM d),
                LATERAL (SELECT unnest(range(1, len(matches) + 1)) AS i), LATERAL (SELECT groups[i] AS group_text) WHERE length(groups[i]) >= {rule.least}""")
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE_RULES)
    joined = "string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, kind_no)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""
        WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents), s AS ({" UNION ALL ".join(parts)}),
        g AS (SELECT row_id, {counts}, {joined} FILTER (WHERE kind IN ({base})) AS base, {joined} AS spans FROM s GROUP BY row_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g USING (row_id)"""


def _manifest_oracle(levels: int = 7) -> str:
    """Nodes level by level; a lone node stays as it is."""
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)"
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    digest = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    up, low = manifest._UPPER, manifest._LOWER

    def tree(name: str, source: str) -> str:
        """Tables name_0, name_1, ... of nodes (g, pos, d, total), each with the run it stands in; ``source`` is the lowest."""
        parts = [f"{name}_0 AS ({source})"]
        for k in range(levels):
            parts.append(f"{name}r_{k} AS (SELECT g, pos // 8 AS pos, list(d ORDER BY pos) AS run, any_value(total) AS total FROM {name}_{k} GROUP BY g, pos // 8)")
            parts.append(f"{name}_{k + 1} AS (SELECT g, pos, CASE WHEN total > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS d, (total + 7) // 8 AS total FROM {name}r_{k})")
        return ", ".join(parts)

    def climb(name: str, first: str, key: str, pos: str) -> tuple[str, str]:
        """Tables that lead ``first`` up through the levels, gathering proof and folding seen."""
        parts, last = [], first
        for k in range(levels):
            at = f"((l.{pos} // {8**k}) % 8)"
            parts.append(
                f"{name}c_{k} AS (SELECT l.* REPLACE (CASE WHEN r.total > 1 THEN proof || array_to_string(run[:{at}] || run[{at} + 2:], '') ELSE proof END AS proof,"
                f" CASE WHEN r.total > 1 THEN sha256(array_to_string(run[:{at}] || [seen] || run[{at} + 2:], '')) ELSE seen END AS seen)"
                f" FROM {last} l JOIN {name}r_{k} r ON r.g = l.{key} AND r.pos = l.{pos} // {8 ** (k + 1)})"
            )
            last = f"{name}c_{k}"
        return ", ".join(parts), last

    inner, last = climb("n", "start", "g", "pos")
    outer, top = climb("t", last, "zero", "g")
    return f"""
        WITH d AS (SELECT doc_id, {digest("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {digest(f"translate(text, '{up}', '{low}')")} ELSE {digest("text")} END AS seen, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, lang FROM documents),
        leaves AS (SELECT *, 0 AS zero, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS total FROM d),
        {tree("n", "SELECT g, pos, leaf AS d, total FROM leaves")},
        {tree("t", f"SELECT 0 AS g, g AS pos, d, count(*) OVER () AS total FROM n_{levels}")},
        start AS (SELECT doc_id, leaf, seen, g, zero, pos, '' AS proof FROM leaves), {inner}, {outer}
        SELECT doc_id, leaf, s.d AS subroot, r.d AS root, sha256(proof) AS proof_sha256, seen AS folded_root, seen = r.d AS verified
        FROM {top} l JOIN n_{levels} s ON s.g = l.g CROSS JOIN t_{levels} r"""


def _codes_oracle(rounds: int = codes.ROUNDS) -> str:
    """Distances by inner products of whole numbers; the nearest entry is the least of distance * 64 + entry."""

    def nearest(books: str) -> str:
        return f"SELECT r, j, x, min(CAST(xx + cc - 2 * list_inner_product(x, c) AS BIGINT) * 64 + e) AS best FROM p JOIN {books} USING (j) GROUP BY r, j, x"

    parts = []
    for k in range(rounds):
        parts.append(f"a{k} AS MATERIALIZED ({nearest(f'b{k}')})")
        parts.append(f"s{k} AS (SELECT j, e, list(m ORDER BY i) AS c FROM (SELECT j, best % 64 AS e, i, floor(sum(x[i]) / count(*)) AS m FROM a{k}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY j, best % 64, i) GROUP BY j, e)")
        parts.append(f"b{k + 1} AS MATERIALIZED (SELECT j, e, coalesce(s.c, b.c) AS c, list_inner_product(coalesce(s.c, b.c), coalesce(s.c, b.c)) AS cc FROM b{k} b LEFT JOIN s{k} s USING (j, e))")
    return f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        f AS (SELECT vec_id, min(v) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS e FROM v GROUP BY vec_id QUALIFY e < 64),
        cut AS (SELECT j, j * len(v) // 16 + 1 AS low, (j + 1) * len(v) // 16 AS high FROM f, LATERAL (SELECT unnest(range(16)) AS j) WHERE e = 0),
        p AS MATERIALIZED (SELECT r, j, v[low:high] AS x, list_inner_product(v[low:high], v[low:high]) AS xx FROM v CROSS JOIN cut WHERE len(v) = (SELECT len(v) FROM f WHERE e = 0)),
        b0 AS MATERIALIZED (SELECT j, e, v[low:high] AS c, list_inner_product(v[low:high], v[low:high]) AS cc FROM f CROSS JOIN cut),
        {", ".join(parts)}, z AS ({nearest(f"b{rounds}")}),
        book AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY j, e)) AS codebooks_sha256 FROM b{rounds}),
        g AS (SELECT r, string_agg(printf('%02x', best % 64), '' ORDER BY j) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM z GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM g JOIN v USING (r) CROSS JOIN book"""


ORACLES: dict[str, str] = {
    "op12_merkle_manifest": _manifest_oracle(),
    "op13_vector_codes": _codes_oracle(),
    "op4_secret_scan": _secret_oracle(),
    "op10_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(doc_id, 9223372036854775807) AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (SELECT row_id, id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS p) WHERE len(w) >= 50),
        firsts AS (SELECT h, min(id) AS low FROM windows GROUP BY h),
        removed AS (SELECT DISTINCT row_id, p + o AS k FROM (SELECT row_id, p FROM windows JOIN firsts USING (h) WHERE id > low), LATERAL (SELECT unnest(range(0, 50)) AS o)),
        gone AS (SELECT row_id, list(k) AS ks FROM removed GROUP BY row_id),
        kept AS (SELECT d.row_id, doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed, CASE WHEN ks IS NULL THEN array_to_string(w, ' ') ELSE (SELECT coalesce(string_agg(x, ' ' ORDER BY i), '') FROM (SELECT unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i) WHERE NOT list_contains(ks, i)) END AS kept FROM d LEFT JOIN gone USING (row_id))
        SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM kept
    """,
    "op5_exact_top_k": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
}
