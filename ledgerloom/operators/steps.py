"""The step graph: prerequisites, presets, transitive closure and what may run next, as tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from time import perf_counter

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_TEXT = ("ocr", "vision_ocr", "hybrid_ocr", "document_graph")
_FIELDS = ("end_to_end_vlm", "llm_extraction")
#: For each step its prerequisites; a prerequisite is a group of alternatives of which one must be done.
PREREQUISITES: dict[str, list[tuple[str, ...]]] = {
    "ingestion": [],
    "document_classifier": [("ingestion",)], "ocr": [("ingestion",)], "vision_ocr": [("ingestion",)], "hybrid_ocr": [("ingestion",)], "document_graph": [("ingestion",)],
    "end_to_end_vlm": [("ingestion",)], "parallel_stream_splitter": [("ingestion",)],
    "page_level_classifier": [("parallel_stream_splitter",)], "map_phase_extraction": [("page_level_classifier",)], "reduce_phase_stitching": [("map_phase_extraction",)], "global_validation": [("reduce_phase_stitching",)],
    "embedding": [(*_TEXT, "end_to_end_vlm"), ("document_classifier",)], "retrieval": [("embedding",)], "rag": [("embedding",)],
    "llm_extraction": [(*_TEXT, "end_to_end_vlm"), ("document_classifier",), ("rag",)],
    "vendor_lookup": [_FIELDS], "validation": [(*_FIELDS, "vendor_lookup")], "confidence_scoring": [("validation",)],
    "anomaly": [("global_validation", "validation")], "multi_task": [("anomaly",)], "export": [("multi_task",)], "cross_page": [_FIELDS], "knowledge_graph": [_FIELDS], "table_extraction": [_TEXT], "evaluation": [("export",)],
}
_TAIL = ["vendor_lookup", "validation", "confidence_scoring", "anomaly", "multi_task", "export", "evaluation"]
#: Steps of each preset in their order.
PRESETS: dict[str, list[str]] = {
    "end_to_end": ["ingestion", "document_classifier", "end_to_end_vlm", "vendor_lookup", "validation", "anomaly", "multi_task", "export", "evaluation"],
    "multi_page_vlm": ["ingestion", "parallel_stream_splitter", "page_level_classifier", "map_phase_extraction", "reduce_phase_stitching", "global_validation", "vendor_lookup", "anomaly", "multi_task", "export", "evaluation"],
    "hybrid": ["ingestion", "hybrid_ocr", "table_extraction", "document_classifier", "embedding", "retrieval", "rag", "llm_extraction", *_TAIL],
    "graph": ["ingestion", "document_graph", "table_extraction", "document_classifier", "embedding", "retrieval", "rag", "llm_extraction", *_TAIL],
}


def edges(spark: SparkSession) -> DataFrame:
    """step -> step that needs it, one row for each alternative."""
    return spark.createDataFrame([(a, s) for s, groups in PREREQUISITES.items() for g in groups for a in g], "step string, after string").distinct()


def downstream(spark: SparkSession) -> DataFrame:
    """All steps that depend on a step, over any number of edges, by a recursive query."""
    edges(spark).createOrReplaceTempView("step_edges")
    return spark.sql("""WITH RECURSIVE r(step, downstream, depth) AS (
        SELECT step, after, 1 FROM step_edges UNION ALL SELECT r.step, e.after, depth + 1 FROM r JOIN step_edges e ON r.downstream = e.step WHERE depth < 30)
        SELECT DISTINCT step, downstream FROM r""")


def runnable(progress: DataFrame, enabled: list[str]) -> DataFrame:
    """Rows with `done` (array of finished steps, null: none) times the enabled steps that may run next: place, step. A step may
    run that isn't done and of whose every prerequisite an enabled alternative is done; groups without one count as met. The
    graph is a handful of literals, so each row is decided by itself and nothing is shuffled."""
    done = F.coalesce("done", F.array().cast("array<string>"))

    def free(place: int, step: str):
        on = [[a for a in group if a in enabled] for group in PREREQUISITES[step]]
        met = [F.arrays_overlap(done, F.array(*map(F.lit, group))) for group in on if group]
        ok = reduce(lambda x, y: x & y, met, ~F.array_contains(done, step))
        return F.when(ok, F.struct(F.lit(place).alias("place"), F.lit(step).alias("step")))

    steps = F.array_compact(F.array(*[free(i, s) for i, s in enumerate(enabled)]))
    return progress.withColumn("next", F.explode(steps)).select(*progress.columns, "next.place", "next.step")


def available(spark: SparkSession, enabled: list[str], done: list[str]) -> DataFrame:
    """place and step of the enabled steps that may run when `done` are finished."""
    return runnable(spark.createDataFrame([(done,)], "done array<string>"), enabled).drop("done")


def held_up(spark: SparkSession, failed: DataFrame) -> DataFrame:
    """step, downstream, failed_runs: for each dependence, in how many runs (run_id, step of `failed`, repeats allowed) the step
    failed. Runs are counted by step before they meet the graph."""
    n = failed.groupBy("step").agg(F.count_distinct("run_id").alias("failed_runs"))
    return downstream(spark).join(n, "step", "left").select("step", "downstream", F.coalesce("failed_runs", F.lit(0)).alias("failed_runs"))


@dataclass
class Run:
    """What a run of steps gave: the last good DataFrame, and for each step its place, name, seconds to plan and error."""

    result: DataFrame
    log: list[tuple[int, str, float, str | None]] = field(default_factory=list)
    start: DataFrame | None = None
    good: list[tuple[int, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)

    def rows(self) -> dict[int, int]:
        """Run the good steps once, and for the place of each the rows that it let through, observed on the way."""
        df, seen = self.start, {}
        for place, step in self.good:
            seen[place] = Observation()
            df = df.transform(step).observe(seen[place], F.count(F.lit(1)).alias("rows"))
        df.write.format("noop").mode("overwrite").save()
        return {place: o.get["rows"] for place, o in seen.items()}


def run_steps(start: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]], enabled: list[str] | None = None) -> Run:
    """Apply the enabled steps of a registry in its order. A step is a function of a DataFrame, so plans stay lazy; one that
    fails while it is planned is logged and left out."""
    run = Run(start, start=start)
    for place, (name, step) in enumerate((n, s) for n, s in steps.items() if enabled is None or n in enabled):
        begun, error = perf_counter(), None
        try:
            run.result = run.result.transform(step)
            run.good.append((place, step))
        except Exception as e:  # the step's error belongs to the log, whatever it is
            error = f"{type(e).__name__}: {e}".split("\n")[0]
        run.log.append((place, name, perf_counter() - begun, error))
    return run
