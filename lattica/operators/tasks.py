"""Task graphs: state machines, ready sets and a runner that works in waves."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.graph import GraphError, PropertyGraph
from lattica.plans.scratch import cut

# The legal steps of a task's state.
TASK_STEPS = {"pending": ("ready", "skipped"), "ready": ("running", "skipped"), "running": ("done", "failed"), "done": (), "failed": (), "skipped": ()}
# The legal steps of a node's status; the empty status is a fresh node.
STATUS_STEPS = {"": ("pending", "ready"), "pending": ("ready", "skipped"), "ready": ("running", "skipped"), "running": ("done", "failed"), "failed": ("pending",)}


def steps_frame(spark, steps: dict) -> DataFrame:
    """(old, new), one row for each legal step."""
    return spark.createDataFrame([(a, b) for a, bs in steps.items() for b in bs], "old string, new string")


def add_task(g: PropertyGraph, id_: str) -> PropertyGraph:
    """Adds a task, or sets a known one back to pending."""
    from lattica.operators.mutate import add_nodes

    row = g.vertices.sparkSession.createDataFrame([(id_, id_, "pending")], "id string, label string, status string")
    return add_nodes(g, row)


def add_dependency(g: PropertyGraph, task: str, needs: str) -> PropertyGraph:
    """``task`` waits for ``needs``; the edge runs from the dependency to the dependent."""
    from lattica.operators.mutate import add_edges

    return add_edges(g, g.vertices.sparkSession.createDataFrame([(needs, task, 0.0)], "src string, dst string, weight double"))


def blocked(g: PropertyGraph) -> DataFrame:
    """(id): nodes with a dependency that is not done."""
    open_ = g.vertices.filter("status <> 'done'").select(F.col("id").alias("src"))
    return g.edges.join(open_, "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def with_status(g: PropertyGraph, ids: DataFrame, status: str) -> PropertyGraph:
    marked = g.vertices.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return PropertyGraph(marked.withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).drop("_hit").select(g.vertices.columns), g.edges, g.directed)


def ready(g: PropertyGraph) -> tuple[PropertyGraph, DataFrame]:
    """Promotes pending tasks whose dependencies are all done (none counts as all), and
    gives all ready tasks by id."""
    promoted = g.vertices.filter("status = 'pending'").select("id").join(blocked(g), "id", "left_anti")
    out = with_status(g, promoted, "ready")
    return out, out.vertices.filter("status = 'ready'").select("id").orderBy("id")


def transition_task(g: PropertyGraph, id_: str, state: str) -> PropertyGraph:
    """One checked step of a task."""
    row = g.vertices.filter(F.col("id") == id_).first()
    if row is None:
        raise GraphError(f"task {id_} not found")
    if state not in TASK_STEPS.get(row.status, ()):
        raise GraphError(f"invalid transition from {row.status} to {state}")
    return with_status(g, g.vertices.filter(F.col("id") == id_), state)


def transition(g: PropertyGraph, id_: str, status: str) -> tuple[PropertyGraph, dict]:
    """One checked step of a node's status. Done promotes those direct successors that are
    pending and whose dependencies are now all done."""
    row = g.vertices.filter(F.col("id") == id_).first()
    if row is None:
        raise GraphError(f"node {id_} not found")
    if status not in STATUS_STEPS.get(row.status, ()):
        raise GraphError(f"invalid transition from {row.status or '(none)'} to {status}")
    out = with_status(g, g.vertices.filter(F.col("id") == id_), status)
    fresh: list[str] = []
    if status == "done":
        after = out.edges.filter(F.col("src") == id_).select(F.col("dst").alias("id")).distinct()
        hit = cut(out.vertices.filter("status = 'pending'").select("id").join(after, "id", "left_semi").join(blocked(out), "id", "left_anti"))
        out = with_status(out, hit, "ready")
        fresh = [r.id for r in hit.orderBy("id").collect()]
    return out, {"id": id_, "old_status": row.status, "new_status": status, "newly_ready": fresh}


def compute_ready(g: PropertyGraph) -> PropertyGraph:
    """Pending nodes with at least one dependency, all done, become ready. One pass cannot
    cascade, since ready is not done."""
    waits = g.edges.select(F.col("dst").alias("id")).distinct()
    hit = g.vertices.filter("status = 'pending'").select("id").join(waits, "id", "left_semi").join(blocked(g), "id", "left_anti")
    return with_status(g, hit, "ready")


def set_status(g: PropertyGraph, id_: str, status: str) -> PropertyGraph:
    """A checked status step, then X9."""
    known = {s for steps in STATUS_STEPS.values() for s in steps}
    if status not in known:
        raise GraphError(f"unknown status {status}")
    out, _ = transition(g, id_, status)
    return compute_ready(out)


def reset(g: PropertyGraph) -> PropertyGraph:
    """All tasks pending."""
    return PropertyGraph(g.vertices.withColumn("status", F.lit("pending")), g.edges, g.directed)


class RunCancelled(GraphError):
    """A run that was cancelled, with the graph as it then is and the errors by task."""

    def __init__(self, graph: PropertyGraph, errors: dict[str, Exception]):
        super().__init__("run cancelled")
        self.graph, self.errors = graph, errors


def run(
    g: PropertyGraph, body: Callable[[str], None], concurrency: int = 4, cancelled: Callable[[], bool] = bool, watch: Callable[[str, str], None] = lambda id_, status: None
) -> tuple[PropertyGraph, dict[str, Exception]]:
    """Runs all ready tasks, waits for them, and goes on with what they made ready.

    ``body`` runs on the driver in at most ``concurrency`` threads, from where it can submit
    Spark jobs; under 1 means 1. A wave with failures is the last; what waits for a failed
    task stays pending. Tasks on a cycle never run. Returns the graph and errors by task.

    ``watch`` hears of each task's way through running to done or failed. Once ``cancelled``
    is true no further task starts: those under way are waited for, the others of the wave
    stay ready, and RunCancelled carries the graph.
    """

    def one(id_: str) -> bool | Exception:
        if cancelled():
            return False
        watch(id_, "running")
        try:
            body(id_)
        except Exception as error:  # the task's own failure, whatever it is
            watch(id_, "failed")
            return error
        watch(id_, "done")
        return True

    errors: dict[str, Exception] = {}
    with ThreadPoolExecutor(max(1, concurrency)) as pool:
        while True:
            g, wave = ready(g)
            ids = [r.id for r in wave.collect()]  # the tasks of one wave, each run on the driver
            if not ids:
                return g, errors
            ended = dict(zip(ids, pool.map(one, ids)))
            errors = {i: e for i, e in ended.items() if isinstance(e, Exception)}
            spark = g.vertices.sparkSession
            for status, hit in (("done", [i for i, e in ended.items() if e is True]), ("failed", list(errors))):
                g = with_status(g, spark.createDataFrame([(i,) for i in hit], "id string"), status)
            g = PropertyGraph(cut(g.vertices), g.edges, g.directed)
            if False in ended.values():
                raise RunCancelled(g, errors)
            if errors:
                return g, errors
