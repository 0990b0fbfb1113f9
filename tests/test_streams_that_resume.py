"""Streams over several micro-batches, stopped and taken up again from their checkpoints, against the batch forms."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorumlake.operators import pipeline
from quorumlake.streaming import admission, keyed, rate_limit, staged

EVENTS = "k string, at timestamp, id long, said string"


def at(second):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


def fed(spark, tmp_path, stream, parts, kind):
    """What ``stream`` gives over ``parts``, each arriving after the run before has ended."""
    rows = None
    for i, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = keyed.finished(stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))), str(tmp_path / "run")).collect()
    return rows


def in_parts(rows, n):
    """Rows in order of time, in ``n`` runs."""
    cut = -(-len(rows) // n)
    return [rows[i : i + cut] for i in range(0, len(rows), cut)]


def test_admission_over_restarts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("aabc"), at(i), i, rng.choice(["x", "x", "y", None])) for i in range(90)]
    got = fed(spark, tmp_path, lambda s: keyed.admitted(s, "k", "at", "said", "id"), in_parts(rows, 3), EVENTS)
    expected = {r.id: r.status for r in pipeline.admit(spark.createDataFrame(rows, EVENTS), ["k"], ["at", "id"], "said").collect()}
    assert {r.request_id: r.status for r in got} == expected and len(got) == len(rows)


def test_admission_of_many_keys_has_a_call_for_a_bucket(monkeypatch):
    """A bucket's keys are read and added in one call each, whatever their number; null keys and digests count."""

    class Bucket:
        rows, calls = [], 0

        def get(self):
            self.calls += 1
            return iter(self.rows)

        def appendList(self, rows):
            self.calls += 1
            self.rows = self.rows + rows

    bucket = Bucket()
    processor = keyed.Admission(None)
    processor.init(type("Handle", (), {"getListState": lambda self, *a: bucket})())
    frame = lambda rows: pd.DataFrame(rows, columns=["bucket", "k", "at", "digest", "id"])
    first = [frame([(0, f"k{i}", 5, "x", i) for i in range(500)] + [(0, None, 7, None, 900)]), frame([(0, "k1", 4, "y", 901), (0, None, 7, None, 902)])]
    second = [frame([(0, f"k{i}", 9, "x", 1000 + i) for i in range(500)] + [(0, None, 9, None, 2000)])]
    got = [dict(zip(f["request_id"], f["status"], strict=True)) for part in (first, second) for f in processor.handleInputRows((0,), iter(part), None)]
    assert got[0] == {i: "CONFLICT" if i == 1 else "NEW" for i in range(500)} | {900: "NEW"} and got[1] == {901: "NEW", 902: "REPLAY"}
    assert got[2] == {1000 + i: "CONFLICT" if i == 1 else "REPLAY" for i in range(500)} | {2000: "REPLAY"}
    assert bucket.calls == 3


def test_the_older_admission_keeps_a_state_for_a_bucket(spark, tmp_path):
    rows = [(f"k{i % 3000}", at(i % 50), i, "x") for i in range(4000)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    got = admission.finished(admission.admitted_stream(stream, "k", "at", "said", "id", 16), str(tmp_path / "run"))
    expected = pipeline.admit(spark.createDataFrame(rows, EVENTS), ["k"], ["at", "id"], "said")
    assert {tuple(r) for r in got.collect()} == {(r.id, r.status) for r in expected.collect()}
    assert spark.read.format("statestore").load(str(tmp_path / "run/state")).count() == 16


def test_transitions_over_restarts(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, i, rng.choice(["Accepted", "Executing", "Completed", "Failed"]) if i else rng.choice(["Accepted", "Executing"])) for i in range(8) for k in "abcdef"]
    kind = "k string, i long, state string"
    got = fed(spark, tmp_path, lambda s: keyed.illegal_transitions(s, "k", "i", "state"), in_parts(rows, 4), kind)
    expected = pipeline.illegal_transitions(spark.createDataFrame(rows, kind), "k", "i", "state").collect()
    assert sorted((r.execution, r.ordinal, r.before, r.state) for r in got) == sorted((r.k, r.i, r.before, r.state) for r in expected)


@pytest.mark.parametrize("limit, seconds", [(3, 20), (1, 5), (50, 1000)])
def test_rate_limits_over_restarts(spark, tmp_path, limit, seconds):
    """Bursts, pauses that empty the log by timer, and calls exactly a window apart, in five micro-batches."""
    rng, now, rows = random.Random(limit), 0, []
    for i in range(120):
        now += rng.choice([0, 1, 1, 2, seconds, 3 * seconds if i % 30 == 0 else 1])
        rows.append((rng.choice("aab"), at(now), i, None))
    got = fed(spark, tmp_path, lambda s: keyed.limited(s, "k", "at", "id", limit=limit, seconds=seconds, late="1 second"), in_parts(rows, 5), EVENTS)
    expected = rate_limit.limited(spark.createDataFrame(rows, EVENTS), "k", "at", "id", limit=limit, seconds=seconds).collect()
    assert sorted((r.key, r.call_id, r.admitted) for r in got) == sorted((r.key, r.call_id, r.admitted) for r in expected)


def test_state_holds_the_live_log_only(spark, tmp_path):
    """After many windows the state has the calls of the last one, not all."""
    rows = [("a", at(10 * i), i, None) for i in range(60)] + [("gone", at(0), 99, None)]
    parts = in_parts(sorted(rows, key=lambda r: r[1]), 6)
    fed(spark, tmp_path, lambda s: keyed.limited(s, "k", "at", "id", limit=5, seconds=25, late="1 second"), parts, EVENTS)
    with keyed.keyed_by_rocksdb(spark):
        log = spark.read.format("statestore").option("stateVarName", "log").load(str(tmp_path / "run" / "state")).count()
    assert 0 < log <= 5


# ---- staged runs


class Cut(RuntimeError):
    pass


def steps(at_stage=None, outside=None, after=False):
    """Five steps that add a column; the one at ``at_stage`` breaks, before or after it has written something of its own."""

    def make(k):
        def run(rows):
            if k == at_stage and not after:
                raise Cut
            out = rows.withColumn(f"s{k}", F.col("id") * (k + 1))
            return out.withColumn("broken", F.raise_error(F.lit("Cut"))) if k == at_stage else out

        return staged.Step(f"step{k}", run, outside=k == outside)

    return [make(k) for k in range(5)]


@pytest.fixture
def source(spark, tmp_path):
    for part in (range(30), range(30, 50)):
        spark.createDataFrame([(i,) for i in part], "id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def same(run):
    rows = sorted(tuple(r) for r in run.output().select("id", *[f"s{k}" for k in range(5)]).collect())
    assert rows == [(i, *[i * (k + 1) for k in range(5)]) for i in range(50)]


def test_an_undisturbed_run(spark, tmp_path, source):
    run = staged.StagedRun(spark, str(tmp_path / "run"), steps())
    run.finished(source)
    same(run)
    history = run.history().orderBy("batch", "stage_ordinal").collect()
    assert [(r.batch, r.stage_ordinal, r.rows) for r in history] == [(b, k, n) for b, n in ((0, 30), (1, 20)) for k in range(5)]
    for b in (0, 1):
        own = [r for r in history if r.batch == b]
        assert all(x.output_digest == y.input_digest for x, y in zip(own, own[1:]))


@pytest.mark.parametrize("cut, after", [(0, True), (1, False), (2, True), (3, False), (4, True)])
def test_a_stopped_run_goes_on(spark, tmp_path, source, cut, after):
    """Stopped in each stage, before it has written or while it writes; what was done is not done again."""
    folder = str(tmp_path / "run")
    with pytest.raises(Exception, match="Cut"):
        staged.StagedRun(spark, folder, steps(cut, after=after)).finished(source)
    done = [(p, p.stat().st_mtime_ns) for p in (tmp_path / "run" / "done").rglob("part-*")] if cut else []
    assert staged.StagedRun(spark, folder, steps()).next_stage(0) == cut
    run = staged.StagedRun(spark, folder, steps())
    run.finished(source)
    same(run)
    assert len(done) == cut and all(p.stat().st_mtime_ns == t for p, t in done)
    run.finished(source)  # nothing is new
    same(run)


def test_effects_outside_are_not_repeated(spark, tmp_path, source):
    """A stage with effects that broke off may have had them: the run refuses until somebody has settled it."""
    folder = str(tmp_path / "run")
    with pytest.raises(Exception, match="Cut"):
        staged.StagedRun(spark, folder, steps(2, outside=2, after=True)).finished(source)
    run = staged.StagedRun(spark, folder, steps(outside=2))
    with pytest.raises(staged.RecoveryError, match=staged.UNCERTAIN):
        run.next_stage(0)
    with pytest.raises(Exception, match=staged.UNCERTAIN):
        run.finished(source)
    run.settle(0, 2)
    assert run.next_stage(0) == 2
    run.finished(source)
    same(run)


def test_changed_outputs_are_made_again(spark, tmp_path, source):
    folder = str(tmp_path / "run")
    with pytest.raises(Exception, match="Cut"):
        staged.StagedRun(spark, folder, steps(3)).finished(source)
    spark.range(3).select(F.col("id"), F.lit(0).alias("s0"), F.lit(0).alias("s1")).write.mode("overwrite").parquet(f"{folder}/out/stage=1/batch=0")
    run = staged.StagedRun(spark, folder, steps())
    assert run.next_stage(0) == 1
    run.finished(source)
    same(run)


def plain_next(checkpoints, stages):
    """The rule in its own words, one checkpoint after the other."""
    for expected, (ordinal, name, committed, whole, certain) in enumerate(sorted(checkpoints, key=lambda c: c[0])):
        if ordinal != expected or expected >= len(stages) or name != stages[expected]:
            return None, staged.INVALID_ORDER
        if not certain:
            return None, staged.UNCERTAIN
        if not committed or not whole:
            return expected, None
    return len(checkpoints), None


def test_resume_points(spark):
    rng = random.Random(4)
    often = lambda p: rng.random() < p
    runs = {}
    for i in range(300):
        n = rng.randrange(1, 7)
        runs[i] = [(k + (1 if often(0.03) else 0), staged.STAGES[k] if often(0.97) else "other", often(0.9), often(0.9), often(0.95)) for k in range(n)]
        runs[i] = list({c[0]: c for c in runs[i]}.values())
    rows = [(i, *c) for i, own in runs.items() for c in own]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run int, stage_ordinal int, stage_name string, committed boolean, integrity_valid boolean, side_effect_certain boolean")
    got = {r.run: (r.resume_at, r.refused) for r in staged.resume_points(df, "run").collect()}
    assert got == {i: plain_next(own, staged.STAGES) for i, own in runs.items()}
    unknown = spark.createDataFrame([(1, 0, "ERM", None, True, True), (2, 0, "ERM", True, True, None)], df.schema)
    assert {r.run: (r.resume_at, r.refused) for r in staged.resume_points(unknown, "run").collect()} == {1: (0, None), 2: (None, staged.UNCERTAIN)}


def test_checkpoints_past_the_last_stage_are_out_of_place(spark):
    """A run with more checkpoints than there are stages is refused, though the stage that isn't there has no name either."""
    of = lambda run, n: [(run, k, staged.STAGES[k] if k < len(staged.STAGES) else None, True, True, True) for k in range(n)]
    df = spark.createDataFrame([*of(1, 6), *of(2, 7), *of(3, 8)], "run int, stage_ordinal int, stage_name string, committed boolean, integrity_valid boolean, side_effect_certain boolean")
    assert {r.run: (r.resume_at, r.refused) for r in staged.resume_points(df, "run").collect()} == {1: (6, None), 2: (None, staged.INVALID_ORDER), 3: (None, staged.INVALID_ORDER)}
