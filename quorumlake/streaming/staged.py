"""The staged run as a stream that can be stopped anywhere and resumes.

Each micro-batch goes through the stages in order. A stage's output is written
below the batch's id, with a checkpoint of the digests of what it took and left;
a batch that comes again, as streams give it after a stop, is taken up after
its last stage whose output is whole and follows from the one before, so
nothing is computed or written twice. A stage with effects outside the run
leaves a note before it begins: where the note stands without a checkpoint it
is not known whether the effects happened, and the run refuses to go on by
itself (ST-02, ST-03, ST-05, ST-06).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "stage_name string, stage_ordinal int, input_digest string, output_digest string, rows long, committed boolean, integrity_valid boolean, side_effect_certain boolean"
# Why a run can't be resumed.
INVALID_ORDER, UNCERTAIN = "Checkpoint order is invalid", "Uncertain side effect prohibits automatic recovery"
# The stages of the runtime in order.
STAGES = ("ERM", "SRM", "ASM", "KRM", "DRM", "GRM")


class RecoveryError(RuntimeError):
    pass


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[DataFrame], DataFrame]
    outside: bool = False  # whether it has effects that writing its output again doesn't undo


def digest(df: DataFrame) -> tuple[str, int]:
    """A digest of the rows of ``df`` in whatever order, and their number."""
    each = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})) if df.columns else F.lit(0)
    row = df.agg(F.sum(each.cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(each)).alias("xor"), F.count(F.lit(1)).alias("n")).first()
    return f"{row['n']}:{row['sum'] or 0}:{row['xor'] or 0}", row["n"]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def resume_points(checkpoints: DataFrame, key: str, stages: Sequence[str] = STAGES) -> DataFrame:
    """``key``, resume_at, refused: the stage at which each execution goes on, or why it can't (ST-06).

    ``checkpoints`` has ``key``, stage_name, stage_ordinal, committed, integrity_valid, side_effect_certain. They are judged
    in order: the first that is out of place or uncertain refuses, the first that isn't committed and whole is done again.
    """
    fields = ["stage_ordinal", "stage_name", "committed", "integrity_valid", "side_effect_certain"]
    ordered = F.array_sort(F.collect_list(F.struct(*fields)))
    names = F.array(*[F.lit(s) for s in stages])

    def judged(c: Column, i: Column) -> Column:
        # past the last stage there is no name that a checkpoint could have, not even a null one
        placed = (c["stage_ordinal"] == i) & (i < len(stages)) & c["stage_name"].eqNullSafe(F.get(names, i))
        refuses = F.when(~F.coalesce(placed, F.lit(False)), INVALID_ORDER).when(~F.coalesce(c["side_effect_certain"], F.lit(False)), UNCERTAIN)
        again = ~F.coalesce(c["committed"] & c["integrity_valid"], F.lit(False))
        return F.struct(refuses.alias("refused"), F.when(refuses.isNull() & again, i).alias("at"))

    decided = F.filter(F.transform("_ordered", judged), lambda x: x["refused"].isNotNull() | x["at"].isNotNull())
    first = F.get(decided, F.lit(0))
    resume = F.when(first.isNull(), F.size("_ordered")).otherwise(first["at"])
    return checkpoints.groupBy(key).agg(ordered.alias("_ordered")).select(key, resume.alias("resume_at"), first["refused"].alias("refused"))


class StagedRun:
    """The stages of a run over the micro-batches of a stream; ``process`` is its ``foreachBatch``.

    ``folder`` is below the shared folder. The driver sees a checkpoint a stage.
    """

    def __init__(self, spark: SparkSession, folder: str, steps: Sequence[Step]) -> None:
        self.spark, self.folder, self.steps = spark, folder, list(steps)

    def _output(self, batch: int, ordinal: int) -> str:
        return f"{self.folder}/out/stage={ordinal}/batch={batch}"

    def _note(self, kind: str, batch: int, ordinal: int) -> str:
        return f"{self.folder}/{kind}/batch={batch}/stage={ordinal}"

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def checkpoints(self, batch: int) -> list[dict]:
        """The checkpoints of a batch, each checked against the output that is there now and the one before."""
        out, left = [], None
        for k, step in enumerate(self.steps):
            if _exists(self.spark, self._note("done", batch, k) + "/_SUCCESS"):
                row = self._read(self._note("done", batch, k)).first().asDict()
                try:
                    row["integrity_valid"] = digest(self._read(self._output(batch, k)))[0] == row["output_digest"] and left in (None, row["input_digest"])
                except AnalysisException:  # the output has gone
                    row["integrity_valid"] = False
                out.append(row)
                left = row["output_digest"]
            elif _exists(self.spark, self._note("begun", batch, k) + "/_SUCCESS"):
                out.append({"stage_name": step.name, "stage_ordinal": k, "committed": False, "integrity_valid": False, "side_effect_certain": False})
            else:
                break
        return out

    def next_stage(self, batch: int) -> int:
        """Where ``batch`` goes on; RecoveryError where that can't be known."""
        found = self.checkpoints(batch)
        if not found:
            return 0
        shaped = [("batch", c["stage_name"], c["stage_ordinal"], c["committed"], c["integrity_valid"], c["side_effect_certain"]) for c in found]
        kind = "batch string, stage_name string, stage_ordinal int, committed boolean, integrity_valid boolean, side_effect_certain boolean"
        row = resume_points(self.spark.createDataFrame(shaped, kind), "batch", [s.name for s in self.steps]).first()
        if row["refused"]:
            raise RecoveryError(f"batch {batch}: {row['refused']}")
        return row["resume_at"]

    def process(self, rows: DataFrame, batch: int) -> None:
        start = self.next_stage(batch)
        taken = rows if start == 0 else self._read(self._output(batch, start - 1))
        for k, step in list(enumerate(self.steps))[start:]:
            if step.outside:
                self.spark.range(1).write.mode("overwrite").parquet(self._note("begun", batch, k))
            before, _ = digest(taken)
            # a part that an earlier attempt left without its checkpoint is replaced
            step.run(taken).write.mode("overwrite").parquet(self._output(batch, k))
            taken = self._read(self._output(batch, k))
            after, n = digest(taken)
            done = self.spark.createDataFrame([(step.name, k, before, after, n, True, True, True)], CHECKPOINT)
            done.coalesce(1).write.mode("overwrite").parquet(self._note("done", batch, k))

    def settle(self, batch: int, ordinal: int) -> None:
        """Somebody has made sure that the stage's effects did not happen: it may run again."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self._note("begun", batch, ordinal))
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def finished(self, stream: DataFrame) -> None:
        """Runs the input that there is; after a stop, goes on from the checkpoint."""
        query = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/stream").trigger(availableNow=True).start()
        query.awaitTermination()

    def output(self) -> DataFrame:
        """What the last stage left of all batches."""
        return self._read(f"{self.folder}/out/stage={len(self.steps) - 1}").drop("batch")

    def history(self) -> DataFrame:
        """batch, stage_name, stage_ordinal, input_digest, output_digest, rows of every stage that is done."""
        return self._read(f"{self.folder}/done").select("batch", "stage_name", "stage_ordinal", "input_digest", "output_digest", "rows")
