"""Files in and out: design matrices as CSV, plans and run trees as JSON, flattened tracking records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.errors import PlanError


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A CSV design matrix; every column is text, and ``row_index`` keeps the file's order."""
    return spark.read.csv(path, header=True, inferSchema=False).withColumn("row_index", F.monotonically_increasing_id())


def write_matrix(rows: DataFrame, path: str) -> None:
    if rows.isEmpty():
        raise PlanError("an empty design matrix cannot be written")
    rows.write.mode("error").csv(path, header=True)


def write_plans(trials: DataFrame, path: str) -> None:
    trials.write.mode("error").option("ignoreNullFields", "false").json(path)


def flatten_struct(df: DataFrame) -> DataFrame:
    """Struct columns as dotted leaf columns."""

    def leaves(t: T.StructType, at, path: str):
        for f in t:
            name = f"{path}.{f.name}" if path else f.name
            col = at[f.name] if at is not None else F.col(f"`{f.name}`")
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, col, name)
            else:
                yield col.alias(name)

    return df.select(*leaves(df.schema, None, ""))


def tracking_records(metrics: DataFrame, parameters: DataFrame, cut: int = 500) -> DataFrame:
    """Long records (run_id, kind, name, value, step): parameters cut to ``cut`` characters, scalar metrics, JSON for the rest.

    A metric's step is its ``seq``, where ``metrics`` has that; parameters have none.
    """
    flat = flatten_struct(parameters)
    names = [c for c in flat.columns if c != "run_id"]
    step = (F.col("seq") if "seq" in metrics.columns else F.lit(None)).cast("long").alias("step")
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.substring(F.col(f"`{n}`").cast("string"), 1, cut).alias("value")) for n in names))) if names else None
    rest = F.to_json(F.struct("vector", "artifact"))
    kind, value = F.when(F.col("scalar").isNotNull(), "metric").otherwise("text"), F.coalesce(F.col("scalar").cast("string"), rest)
    reported = metrics.select("run_id", kind.alias("kind"), "name", value.alias("value"), step)
    if pairs is None:
        return reported
    told = flat.select("run_id", pairs.alias("p")).select("run_id", F.lit("param").alias("kind"), "p.name", "p.value", F.lit(None).cast("long").alias("step"))
    return told.unionByName(reported)


def track(records: DataFrame, path: str) -> None:
    """Append records as JSON lines; also the body of a ``foreachBatch`` sink."""
    records.write.mode("append").json(path)


def export_tree(runs: DataFrame, artifacts: DataFrame, root: str) -> DataFrame:
    """(kind, document): a JSON document for each run below ``root`` and for each of their artifacts. Nothing is put together."""
    from trialframe.operators.runstore import descendants

    tree = descendants(runs, root)
    line = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("document"))
    return line(runs.join(tree, "run_id"), "run").unionByName(line(artifacts.join(tree.select("run_id"), "run_id", "left_semi"), "artifact"))
