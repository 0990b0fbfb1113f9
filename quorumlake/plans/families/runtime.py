"""ST, SRC and SNK: the gated pipeline, stateful operators, sources and sinks."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlake.operators import graph, pipeline, policy, ranking, temporal
from quorumlake.plans.registry import register
from quorumlake.plans.tables import read, scratch, stored
from quorumlake.sources import archives, documents, members, registries, sinks, text_formats
from quorumlake.streaming import admission, keyed, rate_limit, staged

# ---- the six stages, with orders as requests

RUN_SQL = """
    SELECT k, CASE WHEN k % 10 = 1 THEN 'IDENTITY_NOT_RESOLVED' WHEN k % 10 = 2 THEN 'SEMANTICS_NOT_RESOLVED' WHEN k % 11 = 0 THEN 'EVIDENCE_INDETERMINATE' WHEN s < 0.3 THEN 'ASSERTION_NOT_ESTABLISHED'
        WHEN k % 23 = 0 THEN NULL WHEN k % 13 = 0 THEN 'KNOWLEDGE_NOT_INSTITUTIONALIZED' WHEN p = '5-LOW' THEN 'DECISION_NOT_VALID' WHEN k % 7 = 0 OR (k % 3 = 0 AND k % 2 <> 0) THEN 'GOVERNANCE_NON_ACTIONABLE' END AS gate_code,
      CASE WHEN k % 10 NOT IN (1, 2) AND k % 11 <> 0 AND s >= 0.3 AND k % 23 = 0 THEN 'krm' END AS failed_stage,
      CASE WHEN k % 10 = 1 THEN 1 WHEN k % 10 = 2 THEN 2 WHEN k % 11 = 0 THEN 2 WHEN s < 0.3 THEN 3 WHEN k % 23 = 0 THEN 3 WHEN k % 13 = 0 THEN 3 WHEN p = '5-LOW' THEN 5 ELSE 6 END AS n_records
    FROM (SELECT o_orderkey AS k, least(1.0, o_totalprice / 400000) AS s, o_orderpriority AS p FROM orders)"""


def _requests_of(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("k"), F.least(F.lit(1.0), F.col("o_totalprice") / 400000).alias("s"), F.col("o_orderpriority").alias("p"))


def _stages() -> list[pipeline.Stage]:
    k, s, p = F.col("k"), F.col("s"), F.col("p")
    gates = pipeline.GATES
    conflicting = k % 11 == 0
    conditions = F.when(k % 3 == 0, F.array(F.lit("audit"))).otherwise(F.array().cast("array<string>"))
    verified = F.when(k % 2 == 0, F.array(F.lit("audit"))).otherwise(F.array().cast("array<string>"))
    standing, actionable = policy.standing(k % 7 != 0, F.lit(False), conditions, verified)
    yes = F.lit(True)
    return [
        pipeline.Stage("erm", F.when(k % 10 == 1, "Possible Resolution").otherwise("Resolved"), F.when(k % 10 == 1, gates["erm"]), yes),
        pipeline.Stage("srm", F.when(k % 10 == 2, "Possible").otherwise("Resolved"), F.when(k % 10 == 2, gates["srm"]), yes),
        pipeline.Stage("asm", F.when(conflicting, F.lit(None)).otherwise(F.when(s >= 0.3, "Established").otherwise("Rejected")), F.when(conflicting, "EVIDENCE_INDETERMINATE").when(s < 0.3, gates["asm"]), ~conflicting),
        pipeline.Stage("krm", F.when(k % 13 != 0, "Institutionalized"), F.when(k % 13 == 0, gates["krm"]), k % 13 != 0, failed=k % 23 == 0),
        pipeline.Stage("drm", F.when(p == "5-LOW", "ESCALATE_FOR_HUMAN_REVIEW").otherwise("ACTIVATE_APPROVED_SECOND_SOURCE"), F.when(p == "5-LOW", gates["drm"]), yes),
        pipeline.Stage("grm", standing, F.when(~actionable, gates["grm"]), yes),
    ]


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.run_stages(_requests_of(read(spark, sf_dir, "orders")), _stages())


@register("st_02_pipeline_gates", RUN_SQL)
def st_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("k", "gate_code", "failed_stage", "n_records")


@register("st_03_stage_records", f"SELECT coalesce(gate_code, coalesce('FAILED_' || failed_stage, 'APPROVED')) AS result, n_records, count(*) AS n FROM ({RUN_SQL}) GROUP BY ALL")
def st_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = F.coalesce("gate_code", F.concat(F.lit("FAILED_"), F.col("failed_stage")), F.lit("APPROVED"))
    return _runs(spark, sf_dir).groupBy(result.alias("result"), "n_records").agg(F.count(F.lit(1)).alias("n"))


class Stopped(RuntimeError):
    """What ends a run in the middle, in place of a lost driver."""


def _resumed(spark: SparkSession, sf_dir: str) -> staged.StagedRun:
    """The six stages over a stream of orders, stopped in the fourth and taken up again."""

    def stop(rows: DataFrame) -> DataFrame:
        raise Stopped

    orders = read(spark, sf_dir, "orders")
    stream = pipeline.opened(_requests_of(spark.readStream.schema(orders.schema).parquet(f"{sf_dir}/orders.parquet*")))
    steps = [staged.Step(s.name, lambda rows, s=s: pipeline.run_stage(rows, s)) for s in _stages()]
    folder = f"{scratch(spark)}/{uuid.uuid4().hex}"
    try:
        staged.StagedRun(spark, folder, [*steps[:3], staged.Step("krm", stop)]).finished(stream)
    except StreamingQueryException as stopped:
        if "Stopped" not in str(stopped):
            raise
    run = staged.StagedRun(spark, folder, steps)
    run.finished(stream)
    return run


@register("st_06_resumed_run", RUN_SQL)
def st_06_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resumed(spark, sf_dir).output().select("k", "gate_code", "failed_stage", "n_records")


@register("st_05_run_chain", "SELECT stage_ordinal, stage_name, n AS rows, stage_ordinal > 0 AS follows FROM (SELECT count(*) AS n FROM orders), (VALUES (0, 'erm'), (1, 'srm'), (2, 'asm'), (3, 'krm'), (4, 'drm'), (5, 'grm')) v(stage_ordinal, stage_name) WHERE n > 0")
def st_05_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored stages of a run that was taken up again, and whether each took what the one before left."""
    history = _resumed(spark, sf_dir).history()
    before = F.lag("output_digest").over(Window.partitionBy("batch").orderBy("stage_ordinal"))
    return history.select("stage_ordinal", "stage_name", "rows", F.coalesce(before == F.col("input_digest"), F.lit(False)).alias("follows"))


RECOVERY_SQL = f"""
    WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, CASE WHEN conv_id % 7 = 0 AND turn = 2 THEN 'other' ELSE [{', '.join(f"'{s}'" for s in staged.STAGES)}][turn + 1] END AS name,
        role <> 'assistant' OR length(text) % 2 = 0 AS committed, length(text) % 5 <> 0 AS whole, NOT (conv_id % 9 = 0 AND turn % 4 = 3) AS certain FROM conversations),
    d AS (SELECT *, CASE WHEN turn <> pos OR name IS DISTINCT FROM [{', '.join(f"'{s}'" for s in staged.STAGES)}][pos + 1] OR pos > 5 THEN '{staged.INVALID_ORDER}' WHEN NOT certain THEN '{staged.UNCERTAIN}' END AS refused FROM c),
    f AS (SELECT conv_id, min(pos) FILTER (WHERE refused IS NOT NULL OR NOT (committed AND whole)) AS pos, count(*) AS n FROM d GROUP BY 1)
    SELECT f.conv_id, CASE WHEN refused IS NULL THEN coalesce(f.pos, n) END::INT AS resume_at, refused FROM f LEFT JOIN d ON d.conv_id = f.conv_id AND d.pos = f.pos"""


@register("st_06_recovery", RECOVERY_SQL)
def st_06_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every execution goes on, or why it must not; turns of conversations are the checkpoints."""
    name = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 2), "other").otherwise(F.get(F.array(*[F.lit(s) for s in staged.STAGES]), F.col("turn").cast("int")))
    checkpoints = read(spark, sf_dir, "conversations").select(
        "conv_id",
        name.alias("stage_name"),
        F.col("turn").alias("stage_ordinal"),
        ((F.col("role") != "assistant") | (F.length("text") % 2 == 0)).alias("committed"),
        (F.length("text") % 5 != 0).alias("integrity_valid"),
        (~((F.col("conv_id") % 9 == 0) & (F.col("turn") % 4 == 3))).alias("side_effect_certain"),
    )
    return staged.resume_points(checkpoints, "conv_id")


ADMIT_SQL = "SELECT event_id, CASE WHEN event_id = f THEN 'NEW' WHEN d = fd THEN 'REPLAY' ELSE 'CONFLICT' END AS status FROM (SELECT event_id, length(props) % 2 AS d, first_value(event_id) OVER w AS f, first_value(length(props) % 2) OVER w AS fd FROM events WINDOW w AS (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id))"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumns({"day": F.col("ts").cast("date"), "digest": F.sha2((F.length("props") % 2).cast("string"), 256)})


@register("st_01_admission", ADMIT_SQL)
def st_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.admit(_requests(spark, sf_dir), ["user_id", "event_type", "day"], ["ts", "event_id"], "digest").select("event_id", "status")


@register("st_01_admission_stream", "SELECT event_id AS request_id, status FROM (" + ADMIT_SQL + ")")
def st_01_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    shaped = stream.withColumns({"key": F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.to_date("ts").cast("string")), "digest": (F.length("props") % 2).cast("string")})
    return admission.finished(admission.admitted_stream(shaped, "key", "ts", "digest", "event_id"), f"{scratch(spark)}/{uuid.uuid4().hex}")


@register("st_01_admission_state", "SELECT event_id AS request_id, status FROM (" + ADMIT_SQL + ")")
def st_01_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    shaped = stream.withColumns({"key": F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.to_date("ts").cast("string")), "digest": (F.length("props") % 2).cast("string")})
    return keyed.finished(keyed.admitted(shaped, "key", "ts", "digest", "event_id"), f"{scratch(spark)}/{uuid.uuid4().hex}")


@register("st_windows_stream")
def st_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    return admission.finished(admission.per_window(stream, "ts", "event_type", "1 hour", "0 seconds"), f"{scratch(spark)}/{uuid.uuid4().hex}")


# conversations as executions: turns are stages
STATES = "CASE turn WHEN 0 THEN 'Accepted' WHEN 1 THEN CASE WHEN conv_id % 5 = 0 THEN 'Completed' ELSE 'Executing' END WHEN 2 THEN 'Completed' ELSE 'Failed' END"


TRANSITIONS_SQL = f"SELECT conv_id, turn, before, state FROM (SELECT conv_id, turn, state, lag(state) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT conv_id, turn, {STATES} AS state FROM conversations)) WHERE NOT CASE WHEN before IS NULL THEN state = 'Accepted' WHEN before = 'Accepted' THEN state IN ('Executing', 'Failed') WHEN before = 'Executing' THEN state IN ('Completed', 'Failed') ELSE false END"


@register("st_04_illegal_transitions", TRANSITIONS_SQL)
def st_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(STATES).alias("state"))
    return pipeline.illegal_transitions(states, "conv_id", "turn", "state").select("conv_id", "turn", "before", "state")


@register("st_04_transition_stream", f"SELECT conv_id::VARCHAR AS execution, turn::BIGINT AS ordinal, before, state FROM ({TRANSITIONS_SQL})")
def st_04_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = read(spark, sf_dir, "conversations")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/conversations.parquet*").select("conv_id", "turn", F.expr(STATES).alias("state"))
    return keyed.finished(keyed.illegal_transitions(stream, "conv_id", "turn", "state"), f"{scratch(spark)}/{uuid.uuid4().hex}")


@register("st_05_broken_chain", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sha256(CASE WHEN turn % 3 = 2 AND conv_id % 4 = 0 THEN 'x' ELSE p END) AS taken, lag(sha256(text)) OVER w AS expected FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE expected IS NOT NULL AND expected <> taken")
def st_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    taken = F.sha2(F.when((F.col("turn") % 3 == 2) & (F.col("conv_id") % 4 == 0), "x").otherwise(before), 256)
    checkpoints = read(spark, sf_dir, "conversations").withColumns({"taken": taken, "left": F.sha2("text", 256)})
    return pipeline.broken_chain(checkpoints, "conv_id", "turn", "taken", "left").select("conv_id", "turn")


@register("st_06_resume", "SELECT conv_id, bool_and(pos = turn) AS valid, least(coalesce(min(pos) FILTER (WHERE NOT good), 1000000), count(*)) AS resume_at FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role <> 'assistant' OR length(text) % 2 = 0 AS good FROM conversations) GROUP BY 1")
def st_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.next_ordinal(read(spark, sf_dir, "conversations"), "conv_id", "turn", (F.col("role") != "assistant") | (F.length("text") % 2 == 0))


@register("st_07_retries", "SELECT o_orderkey, CASE WHEN o_orderkey = first_value(o_orderkey) OVER w THEN 'NEW' WHEN o_orderstatus = first_value(o_orderstatus) OVER w THEN 'REPLAY' ELSE 'CONFLICT' END AS status FROM orders WHERE o_orderstatus IN ('F', 'O') WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)")
def st_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = read(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "O"))
    return pipeline.admit(allowed, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], "o_orderstatus").select("o_orderkey", "status")


@register("st_08_work_queue", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1 AND o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 10")
def st_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return pipeline.work_queue(attempts, "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "O", 10, 25).select("o_custkey", "o_orderkey", "o_orderstatus")


LIMIT_SQL = """
    WITH RECURSIVE c AS (SELECT user_id::VARCHAR AS key, event_id AS call_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    w AS (SELECT key, call_id, r, true AS admitted, [t] AS log FROM c WHERE r = 1
        UNION ALL SELECT c.key, c.call_id, c.r, len(list_filter(w.log, lambda x: x > c.t - 86400000000)) < 2,
            CASE WHEN len(list_filter(w.log, lambda x: x > c.t - 86400000000)) < 2 THEN list_append(list_filter(w.log, lambda x: x > c.t - 86400000000), c.t) ELSE list_filter(w.log, lambda x: x > c.t - 86400000000) END
        FROM w JOIN c ON c.key = w.key AND c.r = w.r + 1)
    SELECT key, call_id, admitted FROM w"""


@register("st_09_rate_limit", LIMIT_SQL)
def st_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_limit.limited(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", limit=2, seconds=86_400)


@register("st_09_rate_limit_stream", LIMIT_SQL)
def st_09_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    return admission.finished(rate_limit.limited_stream(stream, "user_id", "ts", "event_id", limit=2, seconds=86_400), f"{scratch(spark)}/{uuid.uuid4().hex}")


@register("st_09_rate_limit_state", LIMIT_SQL)
def st_09_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    return keyed.finished(keyed.limited(stream, "user_id", "ts", "event_id", limit=2, seconds=86_400), f"{scratch(spark)}/{uuid.uuid4().hex}")


@register("st_10_audit_events", """SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS integrity_digest FROM events""")
def st_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.audit_events(read(spark, sf_dir, "events"), ["event_id", "event_type", "user_id"]).select("event_id", "integrity_digest")


@register("st_11_audit_projection", "SELECT event_type AS operation, CASE WHEN value > 20 THEN 'DENIED' ELSE 'ACCEPTED' END AS outcome, count(*) AS n FROM events GROUP BY ALL")
def st_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("value") > 20, "DENIED").otherwise("ACCEPTED")
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("operation"), outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# ---- sources

@register("src_02_simple_csv", "SELECT n_nationkey::VARCHAR AS id, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_regionkey::VARCHAR END AS region FROM nation")
def src_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("n_nationkey") % 3 == 0, F.concat_ws(" , ", F.col("n_nationkey").cast("string"), "n_name")).otherwise(F.concat_ws(",", F.col("n_nationkey").cast("string"), F.concat("n_name", F.lit("  ")), F.col("n_regionkey").cast("string"), F.lit("extra")))
    return text_formats.simple_csv(read(spark, sf_dir, "nation").select(line.alias("value")), ["id", "name", "region"])


@register("src_03_typed_rows", "SELECT n_name AS name, CASE n_nationkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN n_nationkey * 1.5 ELSE 'NaN'::DOUBLE END::DOUBLE AS score, n_nationkey AS row_index FROM nation")
def src_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    line = F.concat_ws(",", "n_name", F.when(n % 3 == 0, "").when(n % 3 == 1, (n * 1.5).cast("string")).otherwise("n/a"))
    lines = read(spark, sf_dir, "nation").select(line.alias("value"), n.alias("line"))
    return text_formats.typed(text_formats.simple_csv(lines, ["name", "score"]), ["score"], "line").select("name", "score", "row_index")


@register("src_04_tenant_scan", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def src_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").filter("c_nationkey = 3").select("c_custkey", "c_name")


@register("src_05_point_reads", "SELECT k, o_totalprice FROM (SELECT unnest([1, 7, 8, -1])::BIGINT AS k) LEFT JOIN orders ON o_orderkey = k")
def src_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([(1,), (7,), (8,), (-1,)], "k long")
    return keys.join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice"), "k", "left")


@register("src_06_page", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20 OFFSET 40")
def src_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.page(read(spark, sf_dir, "part"), [F.col("p_partkey")], 40, 20).select("p_partkey", "p_name")


@register("src_09_markdown_rows", "SELECT n_nationkey AS line, n_name || ';' || n_regionkey AS cells FROM nation")
def src_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_regionkey").cast("string"), F.lit(" |"))
    lines = read(spark, sf_dir, "nation").select(F.lit("t.md").alias("file"), F.col("n_nationkey").alias("line"), row.alias("value"))
    more = spark.createDataFrame([("t.md", -2, "# Nations"), ("t.md", -1, "|---|:-:|")], "file string, line int, value string")
    return text_formats.markdown_rows(lines.unionByName(more)).select("line", F.array_join("cells", ";").alias("cells"))


@register("src_12_closed_json", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id END AS amount, CASE WHEN event_id % 3 = 1 THEN 'extra' ELSE '' END AS unknown, event_id % 3 <> 2 AS well_formed FROM events""")
def src_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    body = F.when(k % 3 == 0, F.concat(F.lit('{"amount": '), k.cast("string"), F.lit("}"))).when(k % 3 == 1, F.lit('{"extra": 1}')).otherwise(F.lit("{broken"))
    schema = T.StructType([T.StructField("amount", T.LongType())])
    out = text_formats.closed_json(read(spark, sf_dir, "events").select("event_id", body.alias("body")), "body", schema)
    return out.select("event_id", "parsed.amount", F.coalesce(F.array_join("unknown_keys", ","), F.lit("")).alias("unknown"), "well_formed")


REQUEST_ID = "00000000-0000-4000-8000-000000000000"
ASSESSMENTS_SQL = """SELECT o_orderkey, x.path, x.problem FROM (SELECT o_orderkey, o_orderkey % 7 AS m, unnest([
        {'path': '$', 'problem': CASE WHEN o_orderkey % 7 = 6 THEN 'not JSON' END}, {'path': '$.surplus', 'problem': CASE WHEN o_orderkey % 7 = 1 THEN 'unknown key' END},
        {'path': '$.identity_score', 'problem': CASE WHEN o_orderkey % 7 = 2 THEN 'out of bounds' END}, {'path': '$.observations[1].note', 'problem': CASE WHEN o_orderkey % 7 = 3 AND o_orderkey % 13 <> 0 THEN 'unknown key' END},
        {'path': '$.supplier_names[1]', 'problem': CASE WHEN o_orderkey % 7 = 4 THEN 'blank' END}, {'path': '$.effective_at', 'problem': CASE WHEN o_orderkey % 7 = 5 THEN 'not in UTC' END},
        {'path': '$.supplier_eligibility[0].qualified', 'problem': CASE WHEN o_orderkey % 7 <> 6 AND o_orderkey % 11 = 0 THEN 'not a boolean' END}, {'path': '$.observations', 'problem': CASE WHEN o_orderkey % 7 <> 6 AND o_orderkey % 13 = 0 THEN 'too few' END}]) AS x FROM orders) WHERE x.problem IS NOT NULL"""


def _assessment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, body: a request for each order, with something wrong in most."""
    k, i = F.col("o_orderkey"), F.lit(REQUEST_ID)
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 7 == 5, "+02:00").otherwise("Z"))
    text = lambda **fields: ", ".join(f'"{n}": {v}' for n, v in fields.items())
    one = text(observation_id=f'"{REQUEST_ID}"', source_system_reference=f'"{REQUEST_ID}"', source_record_reference='"r"', subject_type='"Supplier"', subject_id=f'"{REQUEST_ID}"', observation_type='"delay"', value='"12"', severity='"HIGH"', observed_at='"2024-01-01T00:00:00Z"', evidence_reference='"e"')
    observations = F.when(k % 13 == 0, "[]").when(k % 7 == 3, f'[{{{one}}}, {{{one}, "note": 1}}]').otherwise(f"[{{{one}}}]")
    named = F.concat(F.lit('["'), F.col("o_orderpriority"), F.lit('"'), F.when(k % 7 == 4, ', "  "').otherwise(""), F.lit("]"))
    eligible = F.concat(F.lit(f'[{{"supplier_entity_id": "{REQUEST_ID}", "qualified": '), F.when(k % 11 == 0, '"yes"').otherwise("true"), F.lit(', "approved": true, "contractually_eligible": false, "usable_capacity": true, "operationally_ready": true}]'))
    fixed = text(source_object_ids=f'["{REQUEST_ID}"]', enterprise_candidates=f'[["{REQUEST_ID}", "Acme"]]', semantic_terms='["delay"]', semantic_candidates="[]", context_id=f'"{REQUEST_ID}"', material_id=f'"{REQUEST_ID}"', facility_or_region_id=f'"{REQUEST_ID}"', acceptance_evidence="null", **{n: "0.5" for n in documents.SCORES[1:]}, **{n: '"1"' for n in documents.VERSIONS}, **{n: '"p"' for n in documents.NAMES})
    body = F.concat(F.lit("{" + fixed + ', "supplier_names": '), named, F.lit(', "effective_at": "'), at, F.lit('", "observations": '), observations, F.lit(', "supplier_eligibility": '), eligible, F.lit(', "identity_score": '), F.when(k % 7 == 2, "1.5").otherwise("1"), F.when(k % 7 == 1, ', "surplus": {}').otherwise(""), F.when(k % 7 == 6, "").otherwise("}"))
    # texts take much longer to check than to read, so orders that lie in few row groups are dealt to more tasks
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    return orders.select(k, body.alias("body"), i.alias("request"))


@register("src_12_assessment_requests", ASSESSMENTS_SQL)
def src_12_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that is wrong in a request for each order, at every depth."""
    return documents.violations(_assessment_texts(spark, sf_dir), "body", documents.ASSESSMENT, "o_orderkey")


PROPS = documents.Object({"k": documents.Number(0, 49)})


@register("src_12_event_properties", """SELECT event_id, '$.' || key AS path, CASE WHEN key <> 'k' THEN 'unknown key' ELSE 'out of bounds' END AS problem FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) WHERE key <> 'k' OR NOT (json_extract(props, '$.k')::DOUBLE BETWEEN 0 AND 49)""")
def src_12_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.violations(read(spark, sf_dir, "events"), "props", PROPS, "event_id")


# ---- registries: suppliers as entries, a file per nation, nations' suppliers in sections by status

REGISTRY_SQL = """
    r AS (SELECT s_suppkey AS k, 'n' || s_nationkey || '.md' AS file, s_nationkey % 3 AS part, CASE s_nationkey % 3 WHEN 0 THEN 'Authoritative artifacts' WHEN 1 THEN 'Historical baseline' ELSE 'Drafts' END AS section,
        'SUP-' || lpad((s_suppkey % 50)::VARCHAR, 3, '0') || ' Supplier ' || s_suppkey AS name, '1.' || s_suppkey % 4 AS version, CASE WHEN s_suppkey % 9 = 0 THEN 'BROKEN' WHEN s_nationkey % 3 = 0 THEN 'FROZEN' WHEN s_nationkey % 3 = 1 THEN 'SUPERSEDED' ELSE 'DEVELOPMENT' END AS status,
        CASE WHEN s_suppkey % 10 = 0 THEN '' WHEN s_nationkey % 3 = 0 THEN 'YES' ELSE 'NO' END AS current, CASE WHEN s_nationkey % 3 = 0 THEN 'AUTHORITATIVE' ELSE 'NON-AUTHORITATIVE' END AS authority, CASE WHEN s_nationkey % 3 = 1 AND s_suppkey % 4 <> 0 THEN 'next' ELSE '—' END AS replacement
        FROM supplier WHERE s_suppkey % 13 <> 0)"""


def _registry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, line, value: a heading, a header, a rule and the entries; some entries lack a cell and are no rows."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    section = F.when(n % 3 == 0, "Authoritative artifacts").when(n % 3 == 1, "Historical baseline").otherwise("Drafts")
    file = F.concat(F.lit("n"), n.cast("string"), F.lit(".md")).alias("file")
    status = F.when(k % 9 == 0, "BROKEN").when(n % 3 == 0, "FROZEN").when(n % 3 == 1, "SUPERSEDED").otherwise("DEVELOPMENT")
    name = F.concat(F.lit("SUP-"), F.lpad((k % 50).cast("string"), 3, "0"), F.lit(" Supplier "), k.cast("string"))
    cells = [name, F.concat(F.lit("1."), (k % 4).cast("string")), status, F.when(k % 10 == 0, "").when(n % 3 == 0, "YES").otherwise("NO"), F.when(n % 3 == 0, "AUTHORITATIVE").otherwise("NON-AUTHORITATIVE"), F.when((n % 3 == 1) & (k % 4 != 0), "next").otherwise("—"), F.concat(F.lit("[file](released/v1.1/s%20"), k.cast("string"), F.lit(".md)"))]
    s = read(spark, sf_dir, "supplier")
    body = s.select(file, (k + 10).cast("int").alias("line"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.when(k % 13 == 0, " | extra |").otherwise(" |")).alias("value"))
    head = ("| Document | Version | Status | Current | Authority | Superseded By | Location |", "|---|:-:|---|---|---|---|---|")
    first = s.select(n).distinct().select(file, F.inline(F.array(*[F.struct(F.lit(i).alias("line"), v.alias("value")) for i, v in enumerate((F.lit("# Registry"), F.concat(F.lit("## "), section), F.lit(head[0]), F.lit(head[1])))])))
    return body.unionByName(first)


@register("src_09_registry_fields", f"""WITH {REGISTRY_SQL} SELECT file, CAST(k + 10 AS INT) AS line, section, x.field, x.value FROM (SELECT *, unnest([{{'field': 'Document', 'value': name}}, {{'field': 'Version', 'value': version}}, {{'field': 'Status', 'value': status}}, {{'field': 'Current', 'value': current}},
    {{'field': 'Authority', 'value': authority}}, {{'field': 'Superseded By', 'value': replacement}}, {{'field': 'Location', 'value': '[file](released/v1.1/s%20' || k || '.md)'}}]) AS x FROM r)""")
def src_09_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registries.registry_fields(registries.registry_rows(_registry_lines(spark, sf_dir)))


@register("qly_05_registry_governance", f"""WITH {REGISTRY_SQL},
    e AS (SELECT file, CAST(k + 10 AS INT) AS line, name, CASE WHEN current = '' THEN 'MISSING_GOVERNANCE' WHEN status = 'BROKEN' THEN 'INVALID_COMBINATION' WHEN status = 'SUPERSEDED' AND replacement = '—' THEN 'NO_REPLACEMENT' END AS error FROM r)
    SELECT * FROM e WHERE error IS NOT NULL UNION ALL SELECT file, NULL, left(name, 7), 'SEVERAL_AUTHORITIES' FROM r WHERE part = 0 GROUP BY file, left(name, 7) HAVING count(*) > 1""")
def qly_05_governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registries.governance_errors(registries.entries(registries.registry_rows(_registry_lines(spark, sf_dir))))


@register("qly_05_dependency_matrix", f"""WITH {REGISTRY_SQL},
    c AS (SELECT left(name, 7) AS identifier, arg_max(version, (file, k)) AS version, arg_max(status, (file, k)) AS status FROM r WHERE part = 0 GROUP BY 1),
    m AS (SELECT o_orderkey AS "row", 'SUP-' || lpad((o_custkey % 50)::VARCHAR, 3, '0') AS a, '1.' || o_custkey % 4 AS av, 'SUP-' || lpad((o_orderkey % 55)::VARCHAR, 3, '0') AS b, '1.' || o_orderkey % 4 AS bv, CASE WHEN o_orderkey % 6 = 0 THEN 'DRAFT' ELSE 'FROZEN' END AS s, CASE WHEN o_orderkey % 8 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN 'Unknown' ELSE 'Compatible' END AS compatible FROM orders),
    j AS (SELECT "row", CASE WHEN compatible = '' THEN 'MISSING_VALUE' WHEN ca.identifier IS NULL THEN 'DEPENDENT_NOT_CURRENT' WHEN cb.identifier IS NULL THEN 'DEPENDENCY_NOT_CURRENT' WHEN av <> ca.version THEN 'DEPENDENT_VERSION' WHEN bv <> cb.version THEN 'DEPENDENCY_VERSION'
        WHEN ca.status <> 'FROZEN' OR cb.status <> 'FROZEN' OR s <> 'FROZEN' THEN 'NOT_FROZEN' WHEN compatible <> 'Compatible' THEN 'NOT_COMPATIBLE' END AS error FROM m LEFT JOIN c ca ON ca.identifier = a LEFT JOIN c cb ON cb.identifier = b)
    SELECT "row", error FROM j WHERE error IS NOT NULL""")
def qly_05_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of the matrix, their customers' and their own numbers as the entries they join."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    entry = lambda n: F.concat(F.lit("SUP-"), F.lpad(n.cast("string"), 3, "0"))
    version = lambda n: F.concat(F.lit("1."), (n % 4).cast("string"))
    values = (entry(c % 50), version(c), entry(k % 55), version(k), F.when(k % 6 == 0, "DRAFT").otherwise("FROZEN"), F.lit("uses"), F.when(k % 8 == 0, "").when(k % 3 == 0, "Unknown").otherwise("Compatible"), F.lit("A-1"))
    matrix = read(spark, sf_dir, "orders").select(k.alias("row"), *[v.alias(n) for n, v in zip(registries.MATRIX, values, strict=True)])
    return registries.dependency_errors(matrix, registries.entries(registries.registry_rows(_registry_lines(spark, sf_dir))))


def _packed(spark: SparkSession, sf_dir: str, member: str, head: str, row: object, tail: str) -> DataFrame:
    """path, content: a zip per region whose member holds a line per nation."""
    lines = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("line")))).alias("l"))
    text = lines.select(F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("path"), F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit(tail)).alias("text"))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for t in frame["text"]:
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(member, t)
                out.append(buffer.getvalue())
            yield pd.DataFrame({"path": frame["path"], "content": out})

    return text.mapInPandas(pack, "path string, content binary")


@register("src_01_zipped_csv", "SELECT 'n.csv' AS member, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS row, '{\"id\": \"' || n_nationkey || '\", \"name\": \"' || n_name || '\"}' AS record FROM nation")
def src_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.col("n_nationkey").cast("string"), F.lit(","), "n_name", F.lit("\n"))
    return archives.zipped_csv(_packed(spark, sf_dir, "n.csv", "id,name\n", row, "")).select("member", "row", "record")


@register("src_07_xlsx_rows", "SELECT 'region-' || n_regionkey AS path, n_nationkey + 5 AS row, n_name || ';' || n_regionkey AS cells FROM nation")
def src_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("n_nationkey") + 5).cast("string")
    row = F.concat(F.lit('<row r="'), n, F.lit('"><c r="A'), n, F.lit('" t="inlineStr"><is><t>'), "n_name", F.lit('</t></is></c><c r="B'), n, F.lit('"><v>'), F.col("n_regionkey").cast("string"), F.lit("</v></c></row>"))
    head = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1"><v>0</v></c></row>'
    rows = archives.xlsx_rows(_packed(spark, sf_dir, "xl/worksheets/sheet1.xml", head, row, "</sheetData></worksheet>"), first_row=5)
    return rows.select("path", "row", F.array_join("cells", ";").alias("cells"))


@register("src_08_docx_blocks", "SELECT 'region-' || n_regionkey AS path, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS place, n_name AS text FROM nation")
def src_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("<w:p><w:r><w:t>"), "n_name", F.lit("</w:t></w:r></w:p>"))
    head = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
    return archives.docx_blocks(_packed(spark, sf_dir, "word/document.xml", head, row, "</w:body></w:document>"))


def _archived(spark: SparkSession, parts: DataFrame) -> str:
    """A folder of zip archives in the shared folder: ``parts`` has archive, member, text, a row a member."""
    folder = f"{scratch(spark)}/{uuid.uuid4().hex}"
    local = members._local(folder)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(local, exist_ok=True)
        for frame in frames:
            for archive, own in zip(frame["archive"], frame["parts"], strict=True):
                with zipfile.ZipFile(part := f"{local}/_{uuid.uuid4().hex}", "w", zipfile.ZIP_DEFLATED) as z:
                    for p in own:
                        z.writestr(p["member"], p["text"])
                os.replace(part, f"{local}/{archive}")  # a task that runs again leaves one archive
            yield pd.DataFrame({"n": [len(frame)]})

    parts.groupBy("archive").agg(F.collect_list(F.struct("member", "text")).alias("parts")).mapInPandas(pack, "n int").agg(F.sum("n")).collect()
    return folder


def _in_order(key: str, text: object) -> object:
    """The texts of a group's rows, in order of ``key``, as one."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, text.alias("text")))), lambda x: x["text"]), "")


def _members(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    spark.dataSource.register(members.Members)
    return spark.read.format("zip_members").option("path", folder).option("kind", kind).schema(schema).load()


@register("src_01_archive_members", """SELECT 'nation-' || s_nationkey || '.zip' AS archive, 'part-' || s_suppkey % 2 || '.csv' AS member, CAST(row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 2 ORDER BY s_suppkey) - 1 AS INT) AS row, s_suppkey::VARCHAR AS id, s_name AS name FROM supplier""")
def src_01_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive per nation with two members; only id and name are taken of the members' columns."""
    line = F.concat(F.col("s_suppkey").cast("string"), F.lit(',"'), "s_name", F.lit('",'), F.col("s_acctbal").cast("string"), F.lit("\n"))
    archive, member = F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string"), F.lit(".zip")), F.concat(F.lit("part-"), (F.col("s_suppkey") % 2).cast("string"), F.lit(".csv"))
    parts = read(spark, sf_dir, "supplier").groupBy(archive.alias("archive"), member.alias("member")).agg(F.concat(F.lit("id,name,balance\n"), _in_order("s_suppkey", line)).alias("text"))
    return _members(spark, _archived(spark, parts), "csv", "archive string, member string, row int, id string, name string")


@register("src_07_sheet_members", "SELECT 'customers-' || c_nationkey || '.xlsx' AS archive, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS row, c_name || ';;' || c_custkey AS cells FROM customer")
def src_07_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook of customers per nation, whose second column is empty, read row by row."""
    c = read(spark, sf_dir, "customer").withColumn("r", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("string"))
    row = F.concat(F.lit('<row r="'), "r", F.lit('"><c r="A'), "r", F.lit('" t="inlineStr"><is><t>'), "c_name", F.lit('</t></is></c><c r="C'), "r", F.lit('"><v>'), F.col("c_custkey").cast("string"), F.lit("</v></c></row>"))
    sheet = F.concat(F.lit('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'), _in_order("c_custkey", row), F.lit("</sheetData></worksheet>"))
    parts = c.groupBy(F.concat(F.lit("customers-"), F.col("c_nationkey").cast("string"), F.lit(".xlsx")).alias("archive")).agg(sheet.alias("text")).withColumn("member", F.lit("xl/worksheets/sheet1.xml"))
    return _members(spark, _archived(spark, parts), "xlsx", "archive string, row int, cells array<string>").select("archive", "row", F.array_join("cells", ";").alias("cells"))


@register("src_08_text_members", "SELECT 'parts-' || p_size || '.docx' AS archive, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS INT) AS row, CASE WHEN p_partkey % 3 = 0 THEN p_partkey || ' | ' || p_name ELSE p_name END AS text FROM part")
def src_08_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of parts per size, a paragraph or a row of a table each, read block by block."""
    words = lambda column: F.concat(F.lit("<w:p><w:r><w:t>"), column, F.lit("</w:t></w:r></w:p>"))
    cell = lambda column: F.concat(F.lit("<w:tc>"), words(column), F.lit("</w:tc>"))
    table = F.concat(F.lit("<w:tbl><w:tr>"), cell(F.col("p_partkey").cast("string")), cell(F.col("p_name")), F.lit("</w:tr></w:tbl>"))
    block = F.when(F.col("p_partkey") % 3 == 0, table).otherwise(words(F.col("p_name")))
    text = F.concat(F.lit('<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'), _in_order("p_partkey", block), F.lit("</w:body></w:document>"))
    parts = read(spark, sf_dir, "part").groupBy(F.concat(F.lit("parts-"), F.col("p_size").cast("string"), F.lit(".docx")).alias("archive")).agg(text.alias("text")).withColumn("member", F.lit("word/document.xml"))
    return _members(spark, _archived(spark, parts), "docx", "archive string, row int, text string")


@register("src_10_strict_csv", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def src_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/{uuid.uuid4().hex}"
    read(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.option("header", True).csv(folder)
    return text_formats.strict_csv(spark, folder, ["n_nationkey", "n_name"])


CONNECTOR_SQL = ", ".join(f"('{i}', [{', '.join(repr(x) for x in c)}], '{m}')" for i, _, c, _, m in text_formats.CONNECTORS)


@register("src_13_connector_reach", f"""
    WITH k AS (SELECT connector_id, unnest(categories) AS concept, maturity FROM (VALUES {CONNECTOR_SQL}) v(connector_id, categories, maturity)),
    e AS (SELECT [{', '.join(repr(x) for x in graph.CONCEPTS)}][p_partkey % 10 + 1] AS concept, count(*) AS n FROM part GROUP BY 1)
    SELECT connector_id, maturity, count(*) AS n_categories, sum(coalesce(n, 0))::BIGINT AS n_elements FROM k LEFT JOIN e USING (concept) GROUP BY 1, 2""")
def src_13_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements, parts here, each connector's categories would cover."""
    concept = F.get(F.array(*[F.lit(c) for c in graph.CONCEPTS]), (F.col("p_partkey") % 10).cast("int"))
    elements = read(spark, sf_dir, "part").groupBy(concept.alias("concept")).agg(F.count(F.lit(1)).alias("n"))
    offered = text_formats.connectors(spark).select("connector_id", "maturity", F.explode("categories").alias("concept"))
    return offered.join(elements, "concept", "left").groupBy("connector_id", "maturity").agg(F.count(F.lit(1)).alias("n_categories"), F.sum(F.coalesce("n", F.lit(0))).alias("n_elements"))


# ---- sinks

@register("snk_01_checked_append", "SELECT l_returnflag, count(*) FILTER (WHERE l_partkey % 6 <> 0) AS appended, count(*) FILTER (WHERE l_partkey % 6 = 0) AS quarantined FROM lineitem GROUP BY 1")
def snk_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "part").filter("p_partkey % 6 <> 0").select(F.col("p_partkey").alias("l_partkey"))
    good, bad = sinks.split_by_reference(read(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag"), known, ["l_partkey"])
    both = good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))
    return both.groupBy("l_returnflag").agg(F.count_if("ok").alias("appended"), F.count_if(~F.col("ok")).alias("quarantined"))


@register("snk_02_append_history", "SELECT user_id, max(event_id) AS current, count(*) - 1 AS n_prior FROM events GROUP BY 1")
def snk_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/{uuid.uuid4().hex}"
    e = read(spark, sf_dir, "events").select("user_id", "event_id")
    sinks.append(e.filter("event_id % 2 = 0"), folder)
    sinks.append(e.filter("event_id % 2 = 1"), folder)
    return spark.read.schema(e.schema).parquet(folder).groupBy("user_id").agg(F.max("event_id").alias("current"), (F.count(F.lit(1)) - 1).alias("n_prior"))


@register("snk_02_last_appended", """
    WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS batch, -event_id AS position FROM events)
    SELECT user_id, event_id, row_number() OVER w = count(*) OVER (PARTITION BY user_id) AS is_current, lag(event_id) OVER w AS prior FROM e WINDOW w AS (PARTITION BY user_id ORDER BY batch, position)""")
def snk_02_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last appended record is the current one; even ids are appended first, and greater ids before smaller ones."""
    folder = f"{scratch(spark)}/{uuid.uuid4().hex}"
    e = read(spark, sf_dir, "events").select("user_id", "event_id", (-F.col("event_id")).alias("position"))
    sinks.append_batch(e.filter("event_id % 2 = 0"), folder, 1)
    sinks.append_batch(e.filter("event_id % 2 = 1"), folder, 2)
    chained = temporal.with_prior(spark.read.parquet(folder), ["user_id"], ["batch", "position"], "event_id")
    return chained.select("user_id", "event_id", "is_current", "prior")


@register("snk_03_compare_and_append", "SELECT o_orderkey, CASE WHEN head IS NULL THEN 'NOT_FOUND' WHEN o_orderkey % 3 <> head THEN 'STALE' WHEN o_orderkey = min(o_orderkey) FILTER (WHERE o_orderkey % 3 = head) OVER (PARTITION BY o_custkey) THEN 'OK' ELSE 'SUPERSEDED' END AS status FROM orders LEFT JOIN (SELECT c_custkey, c_custkey % 3 AS head FROM customer WHERE c_custkey % 9 <> 0) ON c_custkey = o_custkey")
def snk_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = read(spark, sf_dir, "customer").filter("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 3).alias("head"))
    decisions = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 3).alias("based_on"))
    return sinks.compare_and_append(decisions, current, "o_custkey", "based_on", "head", ["o_orderkey"]).select("o_orderkey", "status")


@register("snk_04_get_or_create", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 THEN 'CREATE' WHEN o_orderkey % 10 = 0 THEN 'CONFLICT' ELSE 'EXISTS' END AS status FROM orders")
def snk_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    existing = o.filter("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "changed").otherwise(F.col("o_orderstatus")))
    return sinks.get_or_create(o, existing, "o_orderkey", "o_orderstatus").select("o_orderkey", "status")


@register("snk_05_without_prefix", "SELECT p_partkey FROM part WHERE NOT starts_with(p_type, 'S')")
def snk_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.without_prefix(read(spark, sf_dir, "part"), "p_type", "S").select("p_partkey")


@register("snk_06_linked_nodes", """
    SELECT json_object('@id', 'shop:concept:' || p_partkey, '@type', 'Concept', 'name', p_partkey::VARCHAR, 'definition', p_name, 'governanceStatus', CASE WHEN p_size > 25 THEN 'Approved' ELSE 'Proposed' END)::VARCHAR AS node FROM part
    UNION ALL SELECT json_object('@id', 'shop:relationship:' || l_orderkey || '-' || l_linenumber, '@type', 'Relationship', 'name', l_orderkey || '-' || l_linenumber, 'source', 'shop:concept:' || l_suppkey, 'target', 'shop:concept:' || l_partkey)::VARCHAR FROM lineitem""")
def snk_06_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda column: F.col(column).cast("string")
    concepts = read(spark, sf_dir, "part").select(text("p_partkey").alias("name"), F.col("p_name").alias("definition"), F.when(F.col("p_size") > 25, "Approved").otherwise("Proposed").alias("status"))
    relations = read(spark, sf_dir, "lineitem").select(F.concat_ws("-", text("l_orderkey"), text("l_linenumber")).alias("name"), text("l_suppkey").alias("source"), text("l_partkey").alias("target"))
    return sinks.linked_nodes(concepts, relations, "shop")


@register("snk_07_digests_of_files", "SELECT c_nationkey, sha256(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS sha256, sum(octet_length(encode(c_name)) + 1)::BIGINT AS length FROM customer GROUP BY 1")
def snk_07_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file of customers' names for each nation, then the inventory of those files."""
    folder = f"{scratch(spark)}/{uuid.uuid4().hex}"
    rows = read(spark, sf_dir, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    rows.select("c_name", "c_nationkey").write.partitionBy("c_nationkey").text(folder)
    return archives.digests(spark, folder).select(F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).cast("int").alias("c_nationkey"), "sha256", "length")


@register("snk_07_file_digests", "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS length FROM documents")
def snk_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("length"))


@register("snk_09_sealed_round_trip", "SELECT event_id, props AS payload FROM events")
def snk_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the table of keys: made of the nations here, elsewhere one that few may read
    keys = stored(read(spark, sf_dir, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key_id"), F.unhex(F.md5("n_name")).alias("key")))
    key, version = sinks.key_of(keys, "k1"), F.lit("1")
    cipher = sinks.sealed(F.col("props").cast("binary"), key, version, "k1")
    kept = read(spark, sf_dir, "events").select("event_id", cipher.alias("cipher"))
    return kept.select("event_id", sinks.opened(F.col("cipher"), key, version, "k1").cast("string").alias("payload"))


@register("snk_10_back_fill", "SELECT n_nationkey, 'legacy' AS tenant_id FROM nation")
def snk_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.back_filled(read(spark, sf_dir, "nation").select("n_nationkey"), "tenant_id", F.lit("legacy"))
