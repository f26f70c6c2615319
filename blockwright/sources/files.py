"""Text and CSV sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Edges (src, dst, 0-based) and vertex count of a folder of text files with
    lines ``p n m``, ``f edges`` and ``e u v``; wrong letters and ids raise."""
    lines = spark.read.text(path).where(F.col("value").rlike("^[A-Za-z]"))
    c = F.split(F.trim("value"), r"\s+")
    kinds = lines.select(c[0].alias("kind"), c.alias("c"))
    facts = kinds.agg(
        F.max(F.when(F.col("kind") == "p", F.col("c")[1].cast("long"))).alias("n"), F.max(F.when(F.col("kind") == "p", F.col("c")[2].cast("long"))).alias("m"),
        F.count_if(F.col("kind") == "e").alias("edges"), F.count_if(~F.col("kind").isin("p", "f", "e")).alias("bad"),
    ).head()
    if facts["n"] is None or facts["bad"] or facts["edges"] != facts["m"]:
        raise ValueError(f"malformed graph: {facts}")
    n = facts["n"]
    edges = kinds.where("kind = 'e'").select((F.col("c")[1].cast("long") - 1).alias("src"), (F.col("c")[2].cast("long") - 1).alias("dst"))
    inside = F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1)
    bad = F.raise_error(F.lit("vertex outside the graph")).cast("long")
    return edges.select(F.when(inside, F.col("src")).otherwise(bad).alias("src"), "dst"), n


def write_graph(edges: DataFrame, n: int, path: str, files: int = 4) -> None:
    m = edges.count()
    rows = edges.select(F.format_string("e %d %d", F.col("src") + 1, F.col("dst") + 1).alias("value")).repartition(files)
    rows.sparkSession.createDataFrame([(f"p {n} {m}",)], "value string").union(rows).write.text(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """point_id, v from text with header ``n d`` and one point per line; the
    files of a folder follow each other in name order."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    lines = lines.select(F.split(F.trim("value"), r"\s+").alias("c"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    head = lines.orderBy("file", "at").head()
    if head is None or len(head["c"]) != 2:
        raise ValueError("no header")
    n, d = map(int, head["c"])
    counts = lines.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))  # a row per file
    inside = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    numbered = lines.withColumn("inside", inside).join(offsets, "file")
    rows = numbered.select((F.col("offset") + F.col("inside") - 2).alias("point_id"), F.transform("c", lambda x: x.cast("double")).alias("v")).where("point_id >= 0")
    bad = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("v") != d).alias("odd")).head()
    if bad["n"] != n or bad["odd"]:
        raise ValueError("points differ from the header")
    return rows


def write_points(points: DataFrame, path: str) -> None:
    """Header and one line per point, in id order, as one text file per task."""
    n = points.count()
    d = len(points.head()["v"]) if n else 0
    lines = points.orderBy("point_id").select(F.array_join(F.transform("v", lambda x: x.cast("string")), " ").alias("value"))
    points.sparkSession.createDataFrame([(f"{n} {d}",)], "value string").union(lines).write.text(path)


def write_centers(spark: SparkSession, centers: list[list[float]], path: str) -> None:
    rows = [(f"{len(centers)} {len(centers[0])}",)] + [(" ".join(map(repr, c)),) for c in centers]
    spark.createDataFrame(rows, "value string").coalesce(1).write.text(path)


def write_assignment(points: DataFrame, assigned: DataFrame, path: str) -> None:
    """Coordinates, then the center, one line per point."""
    both = points.join(assigned, "point_id")
    both.select(F.concat_ws(" ", F.array_join(F.transform("v", lambda x: x.cast("string")), " "), F.col("cid").cast("string")).alias("value")).write.text(path)


def random_points(spark: SparkSession, n: int, dimensions: int, seed: int = 0) -> DataFrame:
    """Uniform points in [-10000, 10000)."""
    return spark.range(n).select(F.col("id").alias("point_id"), F.array(*((F.rand(seed + i) * 20000 - 10000) for i in range(dimensions))).alias("v"))


def write_scores(pr: DataFrame, path: str, ordered: bool = True) -> None:
    rows = pr.orderBy(F.desc("pr"), "v") if ordered else pr
    rows.select(F.concat_ws(" ", F.col("v").cast("string"), F.col("pr").cast("string")).alias("value")).write.text(path)


def write_measurements(rows: DataFrame, path: str, attributes: list[str]) -> None:
    """A CSV with a header; every attribute must be there and set."""
    if set(rows.columns) != set(attributes):
        raise ValueError("attributes differ")
    missing = rows.where(" OR ".join(f"`{a}` IS NULL" for a in attributes))
    if not missing.isEmpty():
        raise ValueError("an attribute is not set")
    rows.select(attributes).write.option("header", True).csv(path)


def read_measurements(spark: SparkSession, path: str, schema: str, name_pattern: str | None = None, names: list[str] | None = None) -> DataFrame:
    """CSV files with a header; columns from the file name by regular expression."""
    out = spark.read.schema(schema).option("header", True).csv(path)
    for i, name in enumerate(names or [], start=1):
        out = out.withColumn(name, F.regexp_extract(F.input_file_name(), name_pattern, i))
    return out


def clean_benchmark_log(lines: DataFrame, preamble: int, fields: int = 5, parts: list[str] | None = None) -> DataFrame:
    """Rows of a benchmark log (file, line_no, value): no preamble, no aggregate
    rows, the first ``fields`` fields, the name split into columns."""
    c = F.split("value", ",")
    rows = lines.where(F.col("line_no") >= preamble).where(~F.split("value", ",")[0].rlike("_(mean|median|stddev)\"?$"))
    out = rows.select("file", *(F.get(c, F.lit(i)).alias(f"f{i}") for i in range(fields)))
    name = F.split(F.regexp_replace("f0", '"', ""), "/")
    for i, part in enumerate(parts or []):
        out = out.withColumn(part, F.get(name, F.lit(i)))
    return out


def log_likelihoods(lines: DataFrame) -> DataFrame:
    """The number after ``Final LogLikelihood:``."""
    found = F.regexp_extract("value", r"Final LogLikelihood:\s*(-?[0-9.]+)", 1)
    return lines.where(F.col("value").contains("Final LogLikelihood:")).withColumn("llh", F.when(found != "", found).cast("double"))


def save_blocks(blocks: DataFrame, path: str) -> None:
    """Checkpoint of blocks, partitioned by range so that a pull prunes files."""
    blocks.repartition("range_id").write.partitionBy("range_id").parquet(path)


def load_blocks(spark: SparkSession, path: str, ranges: list[int] | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    return out if ranges is None else out.where(F.col("range_id").isin(ranges))
