"""Graphs from directory listings and task plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.tasks import compute_ready
from lattica.operators.traverse import has_cycle
from lattica.plans.graph import PropertyGraph
from lattica.plans.scratch import cut

# Languages by file extension.
LANGUAGES = {
    ".go": "Go", ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".jsx": "JavaScript", ".tsx": "TypeScript", ".rs": "Rust", ".java": "Java", ".c": "C", ".h": "C", ".cpp": "C++", ".hpp": "C++", ".cs": "C#", ".rb": "Ruby",
    ".php": "PHP", ".swift": "Swift", ".kt": "Kotlin", ".scala": "Scala", ".sh": "Bash", ".bash": "Bash", ".sql": "SQL", ".html": "HTML", ".css": "CSS", ".scss": "SCSS", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML", ".toml": "TOML",
    ".xml": "XML", ".md": "Markdown", ".lua": "Lua", ".r": "R", ".dart": "Dart", ".zig": "Zig", ".proto": "Protobuf",
}


def extension(name: Column) -> Column:
    """The last dot and what follows it; empty without a dot."""
    return F.regexp_extract(name, r"(\.[^./]*)$", 1)


def parent_of(path: Column, root: str) -> Column:
    up = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(up == "", F.lit(root)).otherwise(up)


def from_directory(entries: DataFrame, root: str = "root", extensions: list[str] = ()) -> PropertyGraph:
    """(path, name, is_dir, size, content) rows to a tree of weight 1 edges.

    Metadata holds type, size, extension, language and content. Parents without a row are
    made, one level up as in a listing. With an extension filter other files go, and then
    directories left empty, however deep.
    """
    wanted = [e if e.startswith(".") else f".{e}" for x in extensions if (e := x.strip().lower())]
    rows = entries.withColumns({"is_dir": F.coalesce("is_dir", F.lit(False)), "content": F.coalesce("content", F.lit(""))})
    if wanted:
        rows = rows.filter(F.col("is_dir") | F.lower(extension(F.col("name"))).isin(wanted))
    rows = cut(rows.dropDuplicates(["path"]).withColumn("parent", parent_of(F.col("path"), root)))
    ext = extension(F.col("name"))
    language = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[F.lower(ext)]
    info = F.struct(
        F.when(F.col("is_dir"), "directory").otherwise("file").alias("type"),
        F.when(~F.col("is_dir"), F.coalesce("size", F.lit(0))).alias("size"),
        F.when(~F.col("is_dir") & (ext != ""), ext).alias("extension"),
        F.when(~F.col("is_dir"), language).alias("language"),
        F.when(~F.col("is_dir") & (F.col("content") != ""), F.col("content")).alias("content"),
    )
    meta = F.from_json(F.to_json(info), "map<string,variant>")
    nodes = rows.select(F.col("path").alias("id"), F.when(F.col("is_dir"), F.concat("name", F.lit("/"))).otherwise(F.col("name")).alias("label"), meta.alias("meta"), "is_dir")
    made = rows.select(F.col("parent").alias("id")).union(rows.sparkSession.createDataFrame([(root,)], "id string")).distinct().join(nodes.select("id"), "id", "left_anti")
    made = made.select("id", F.concat(F.regexp_extract("id", r"([^/]*)$", 1), F.lit("/")).alias("label"), F.from_json(F.lit('{"type":"directory"}'), "map<string,variant>").alias("meta"), F.lit(True).alias("is_dir"))
    made = made.withColumn("label", F.when(F.col("id") == root, F.lit(f"{root}/")).otherwise(F.col("label")))
    nodes = cut(nodes.unionByName(made))
    edges = cut(rows.select(F.col("parent").alias("src"), F.col("path").alias("dst"), F.lit(1.0).alias("weight")))
    while wanted:
        full = edges.select(F.col("src").alias("id")).distinct()
        empty = cut(nodes.filter(F.col("is_dir") & (F.col("id") != root)).select("id").join(full, "id", "left_anti"))
        if empty.isEmpty():
            break
        nodes = cut(nodes.join(empty, "id", "left_anti"))
        edges = cut(edges.join(empty.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "weight"))
    return PropertyGraph.of(nodes.drop("is_dir"), edges)


def plan_levels(tasks: DataFrame) -> DataFrame:
    """(id, level): the longest chain of dependencies under a task; tasks on or behind a
    cycle keep the level at which the count stops, the number of tasks at most."""
    deps = cut(tasks.select(F.col("id").alias("dst"), F.explode("dependencies").alias("src")).distinct())
    state = cut(tasks.select("id", F.lit(0).alias("level")))
    looped = has_cycle(PropertyGraph.of(tasks.select("id"), deps))
    rounds = state.count() if looped else None
    while rounds is None or rounds > 0:
        up = deps.join(state.select(F.col("id").alias("src"), "level"), "src").groupBy(F.col("dst").alias("id")).agg((F.max("level") + 1).alias("n"))
        new = cut(state.join(up, "id", "left").select("id", F.greatest("level", "n").alias("level"), F.coalesce(F.col("n") > F.col("level"), F.lit(False)).alias("up")))
        state = new.select("id", "level")
        if new.filter("up").isEmpty():
            break
        rounds = None if rounds is None else rounds - 1
    return state


def from_plan(tasks: DataFrame) -> PropertyGraph:
    """(id, label, status, dependencies) rows to a graph of dependency -> task edges of
    weight 1. An empty label is the id, an empty status is pending; dependencies that are no
    tasks are left out; then the ready rule runs once."""
    rows = tasks.withColumns({"dependencies": F.coalesce("dependencies", F.array().cast("array<string>")), "label": F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("id")), "status": F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("pending"))})
    edges = rows.select(F.explode("dependencies").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight")).distinct()
    edges = edges.join(rows.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "weight")
    return compute_ready(PropertyGraph.of(rows.select("id", "label", "status"), edges))


def layout(levels: DataFrame, centred: bool = False) -> DataFrame:
    """(id, level, x, y): a row for each level, its nodes side by side by id, from the left or
    around the middle."""
    place = F.row_number().over(Window.partitionBy("level").orderBy("id")) - 1
    left = 400.0 - 100.0 * (F.count("*").over(Window.partitionBy("level")) - 1) if centred else F.lit(150.0)
    return levels.select("id", "level", (left + 200.0 * place).alias("x"), (80.0 + 150.0 * F.col("level")).alias("y"))
