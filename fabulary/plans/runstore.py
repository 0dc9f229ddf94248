"""A content-addressed store of stage results on append-only Parquet, with a current view per key.

An artifact's id is a hash of its canonical JSON, so equal results share one row. A run holds references by stage;
forking copies references, deleting drops them, shared artifacts stay. One writer is assumed.
"""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabulary.plans.graph import DEPENDENTS, descendants

ARTIFACT = "artifact_id string, stage_id string, parents map<string,string>, payload string, written_at long"
RUN = "doc_id string, chapter_id string, run_id string, refs map<string,string>, favourite boolean, forked_from string, deleted boolean, written_at long"
MODELS = "doc_id string, chapter_id string, run_id string, models map<string,string>, written_at long"
NODE = "doc_id string, chapter_id string, run_id string, stage_id string, kind string, row_id string, body string"
RUN_KEY = ["doc_id", "chapter_id", "run_id"]


def canonical_json(value) -> str:
    """Sorted keys, no blanks, missing values dropped from objects, whole numbers without a fraction."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items() if x is not None}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def artifact_id(stage_id: str, payload) -> str:
    return f"{stage_id.replace('.', '').lower()}_{hashlib.sha256(canonical_json(payload).encode()).hexdigest()[:24]}"


class RunStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def _log(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # anything but an unwritten table is an error, never an empty store
                raise
            return self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        """The row of every run that was written last, without deleted runs."""
        w = Window.partitionBy(*RUN_KEY).orderBy(F.desc("written_at"))
        return self._log("runs", RUN).withColumn("rn", F.row_number().over(w)).where("rn = 1 and not deleted").drop("rn", "deleted")

    def artifacts(self) -> DataFrame:
        return self._log("artifacts", ARTIFACT).dropDuplicates(["artifact_id"])

    def _run(self, doc: str, chapter: str, run: str):
        return self.runs().where((F.col("doc_id") == doc) & (F.col("chapter_id") == chapter) & (F.col("run_id") == run)).first()

    def _put(self, doc, chapter, run, refs, favourite=False, forked_from=None, deleted=False) -> None:
        self._append("runs", [(doc, chapter, run, refs, favourite, forked_from, deleted, time.time_ns())], RUN)

    def save(self, doc: str, chapter: str, run: str, stage: str, payload) -> str:
        """Writes a result and points the run at it; its parents are the run's results of the stages it reads."""
        old = self._run(doc, chapter, run)
        refs = dict(old.refs) if old else {}
        parents = {s: refs[s] for s, after in DEPENDENTS.items() if stage in after.split() and s in refs}
        ident = artifact_id(stage, {"payload": payload, "parents": parents})
        self._append("artifacts", [(ident, stage, parents, canonical_json(payload), time.time_ns())], ARTIFACT)
        self._put(doc, chapter, run, refs | {stage: ident}, bool(old and old.favourite), old.forked_from if old else None)
        return ident

    def fork(self, doc: str, chapter: str, run: str, stage: str, new_run: str) -> dict[str, str]:
        """A run for doing a stage again: it keeps the references of all stages that do not depend on it."""
        old = self._run(doc, chapter, run)
        stale = descendants(stage) | {stage}
        refs = {s: r for s, r in (old.refs if old else {}).items() if s not in stale}
        self._put(doc, chapter, new_run, refs, False, run)
        return refs

    def favour(self, doc: str, chapter: str, run: str) -> None:
        """Makes one run of a chapter the favourite; the others stop being it. One append for all that change."""
        here = self.runs().where((F.col("doc_id") == doc) & (F.col("chapter_id") == chapter))
        now = favoured(here, self.spark.createDataFrame([(doc, chapter, run)], "doc_id string, chapter_id string, run_id string"))
        changed = now.join(here.select(*RUN_KEY, F.col("favourite").alias("was")), RUN_KEY).where("favourite <> was").drop("was")
        rows = changed.withColumns({"deleted": F.lit(False), "written_at": F.lit(time.time_ns())}).select("doc_id", "chapter_id", "run_id", "refs", "favourite", "forked_from", "deleted", "written_at").collect()  # the runs of one chapter
        if rows:
            self._append("runs", [tuple(r) for r in rows], RUN)

    def save_models(self, doc: str, chapter: str, run: str, models: dict[str, str]) -> None:
        """Replaces the models that a run's stages are done with."""
        self._append("models", [(doc, chapter, run, models, time.time_ns())], MODELS)

    def models(self, doc: str, chapter: str, run: str) -> dict[str, str]:
        mine = self._log("models", MODELS).where((F.col("doc_id") == doc) & (F.col("chapter_id") == chapter) & (F.col("run_id") == run))
        last = mine.orderBy(F.desc("written_at")).first()
        return dict(last.models) if last else {}

    def artifact(self, doc: str, chapter: str, run: str, stage: str):
        """The result that a run's reference leads to, or None."""
        return self.results(doc, chapter, run).where(F.col("stage") == stage).first()

    def replace_graph(self, rows: DataFrame) -> None:
        """rows as of NODE. Replaces what the graph holds of every (document, chapter, run, stage) that the rows speak of, and nothing else."""
        keys = ["doc_id", "chapter_id", "run_id", "stage_id"]
        writer = rows.select(*[c.split(" ")[0] for c in NODE.split(", ")]).repartition(*keys).write.option("partitionOverwriteMode", "dynamic")
        writer.mode("overwrite").partitionBy(*keys).parquet(f"{self.root}/graph")

    def graph(self) -> DataFrame:
        """The graph's rows of stages that their runs still hold."""
        held = self.runs().select(*RUN_KEY, F.explode("refs").alias("stage_id", "artifact_id")).drop("artifact_id")
        return self._log("graph", NODE).join(held, [*RUN_KEY, "stage_id"], "left_semi")

    def delete_stage(self, doc: str, chapter: str, run: str, stage: str) -> None:
        old = self._run(doc, chapter, run)
        if old:
            self._put(doc, chapter, run, {s: r for s, r in old.refs.items() if s != stage}, old.favourite, old.forked_from)

    def delete_run(self, doc: str, chapter: str, run: str) -> None:
        self._put(doc, chapter, run, {}, deleted=True)

    def results(self, doc: str, chapter: str, run: str) -> DataFrame:
        """stage, artifact_id, payload of a run."""
        mine = self.runs().where((F.col("doc_id") == doc) & (F.col("chapter_id") == chapter) & (F.col("run_id") == run)).select(F.explode("refs").alias("stage", "artifact_id"))
        return mine.join(self.artifacts().select("artifact_id", "payload"), "artifact_id")


def refs_by_run(results: DataFrame) -> DataFrame:
    """results: doc_id, chapter_id, run_id, stage, artifact_id, written_at. The references of every run: by stage the result written last."""
    last = results.groupBy(*RUN_KEY, "stage").agg(F.max_by("artifact_id", F.struct("written_at", "artifact_id")).alias("artifact_id"))
    return last.groupBy(*RUN_KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "artifact_id")))).alias("refs"))


def forked(runs: DataFrame, stage: str) -> DataFrame:
    """runs with the references that are left when a stage is done again: those of stages that do not depend on it."""
    stale = sorted(descendants(stage) | {stage})
    return runs.withColumn("refs", F.map_filter("refs", lambda k, _: ~k.isin(*stale)))


def favoured(runs: DataFrame, chosen: DataFrame) -> DataFrame:
    """runs with favourite true for the chosen (doc_id, chapter_id, run_id) and false for the other runs of their chapters; other chapters stay."""
    picks = chosen.select("doc_id", "chapter_id", F.col("run_id").alias("pick")).distinct()
    return runs.join(picks, ["doc_id", "chapter_id"], "left").withColumn("favourite", F.when(F.col("pick").isNull(), F.col("favourite")).otherwise(F.col("run_id") == F.col("pick"))).drop("pick")


def new_run_id(taken: set[str], now: float | None = None) -> str:
    """A run id from the time, moved on by seconds until it is free."""
    at = int(time.time() if now is None else now)
    while (name := time.strftime("%Y%m%d%H%M%S", time.gmtime(at))) in taken:
        at += 1
    return name
