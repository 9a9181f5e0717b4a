"""Run records: JSON-lines logs, nested result files, and result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Field names of the log and result files
EPOCH_SCHEMA = (
    "run string, epoch bigint, loss double, bpr_loss double, reg_loss double, steps bigint, time_s double, "
    "gpu_mem_mb double, lr double, type string"
)
EVAL_SCHEMA = (
    "model string, `NDCG@10` double, `Precision@10` double, `Recall@10` double, `HitRate@10` double, "
    "UsersEvaluated double, RMSE double, MAE double"
)
_METRIC = (
    "model string, run_type string, `NDCG@10` double, `Precision@10` double, `Recall@10` double, `HitRate@10` double, "
    "RMSE double, MAE double, training_time_s double"
)
_SPEEDUP = (
    "model string, training_time_original_s double, training_time_reduced_s double, speedup_factor double, "
    "GPU_memory_reduction_pct double, preprocessing_overhead_s double"
)
_GRAPH = (
    "num_super_nodes bigint, compression_ratio_pct double, bipartite_edge_reduction_pct double, preprocessing_time_s double"
)

# the directory name of a run, {mode}_frac{digits of the fraction}_ms{min_shared}
RUN_DIRECTORY = r"([a-z_0-9]+)_frac([0-9]+)_ms([0-9]+)"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines with a fixed schema; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_jsonl_ordered(spark: SparkSession, path: str, schema: str, seq: str = "seq bigint") -> DataFrame:
    """Log whose order matters: the writer adds a sequence number, since a distributed read has no file order."""
    return read_jsonl(spark, path, f"{schema}, {seq}")


def read_pipeline_log(spark: SparkSession, path: str) -> DataFrame:
    """(stage, key, value) of a pipeline log: JSON lines that name a stage and hold numbers under keys that vary with the
    models of the run; malformed lines, null values and what is no number are dropped."""
    fields = F.from_json("value", "map<string, string>")
    rows = spark.read.text(path).select(fields.alias("m")).where("m['stage'] is not null")
    long = rows.select(F.expr("m['stage']").alias("stage"), F.explode("m").alias("key", "v")).where("key <> 'stage'")
    return long.select("stage", "key", F.col("v").try_cast("double").alias("value")).where("value is not null")


def pipeline_speedup(log: DataFrame, baseline: str = "baseline", reduced: str = "reduced") -> DataFrame:
    """(model, base_time_s, reduced_time_s, base_mem_mb, reduced_mem_mb) from the ``speedup`` stage, whose keys are
    ``<model>_<run>_avg_epoch_time_s`` and ``<model>_<run>_max_gpu_mem_mb``."""
    names = {f"{baseline}_avg_epoch_time_s": "base_time_s", f"{reduced}_avg_epoch_time_s": "reduced_time_s", f"{baseline}_max_gpu_mem_mb": "base_mem_mb", f"{reduced}_max_gpu_mem_mb": "reduced_mem_mb"}
    part = lambda i: F.regexp_extract("key", f"^(.+)_({'|'.join(names)})$", i)
    rows = log.where("stage = 'speedup'").select(part(1).alias("model"), part(2).alias("name"), "value").where("model <> ''")
    return rows.groupBy("model").agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(n) for k, n in names.items()])


def run_parameters(path: Column) -> list[Column]:
    """mode, fraction and min_shared from a run's directory name; "025" is 0.25 and "10" is 1.0."""
    part = lambda i: F.regexp_extract(path, RUN_DIRECTORY, i)
    digits = part(2)
    return [
        part(1).alias("mode"),
        (digits.cast("double") / F.pow(F.lit(10.0), F.length(digits) - 1)).alias("fraction"),
        part(3).cast("bigint").alias("min_shared"),
    ]


def read_runs(spark: SparkSession, glob: str, graph_field: str = "reduced") -> dict[str, DataFrame]:
    """Nested result files of many runs as long tables: ``graph`` (one row per run), ``metrics`` and ``speedup``.

    ``graph_field`` is the name of the object holding the graph statistics."""
    schema = (
        f"`{graph_field}` struct<{_as_fields(_GRAPH)}>, metrics array<struct<{_as_fields(_METRIC)}>>, "
        f"speedup array<struct<{_as_fields(_SPEEDUP)}>>, total_wall_time_s double"
    )
    runs = (
        spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(glob)
        .select(*run_parameters(F.input_file_name()), F.col(graph_field).alias("g"), "metrics", "speedup", "total_wall_time_s")
    )
    key = ["mode", "fraction", "min_shared"]
    return {
        "graph": runs.select(*key, "g.*", "total_wall_time_s"),
        "metrics": runs.select(*key, F.explode("metrics").alias("m")).select(*key, "m.*"),
        "speedup": runs.select(*key, F.explode("speedup").alias("s")).select(*key, "s.*"),
    }


def _as_fields(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (p.rsplit(" ", 1) for p in ddl.split(", ")))


# The canonical columns of the result tables
METRICS_COLUMNS = ["model", "run_type", "Precision@10", "Recall@10", "NDCG@10", "HitRate@10", "RMSE", "MAE"]
TABLE_COLUMNS = {
    "metrics": METRICS_COLUMNS,
    "memory_usage": ["stage", *"cpu_rss_start_MB cpu_rss_end_MB cpu_rss_delta_MB gpu_alloc_start_MB gpu_alloc_end_MB gpu_peak_MB gpu_util_start_pct gpu_util_end_pct elapsed_s".split()],
    "speedup_results": ["model", *"""training_time_original_s training_time_reduced_s speedup_factor GPU_memory_original_MB GPU_memory_reduced_MB GPU_memory_reduction_pct
        CPU_memory_original_MB CPU_memory_reduced_MB CPU_memory_reduction_pct training_throughput_original training_throughput_reduced
        GPU_utilization_original_pct GPU_utilization_reduced_pct""".split()],
    "reduction_stats": ["stage", *"""nodes_before nodes_after edges_before edges_after edges_removed reduction_percent avg_degree_before avg_degree_after density_before
        density_after memory_before_MB memory_after_MB""".split()],
    "preprocessing_time": ["stage", "elapsed_s", "description"],
}


def canonical(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """Canonical columns first (missing ones as null), extra ones after them."""
    present = set(df.columns)
    first = [F.col(f"`{c}`") if c in present else F.lit(None).cast(kind).alias(c) for c in columns]
    return df.select(*first, *[F.col(f"`{c}`") for c in df.columns if c not in columns])


def write_result(df: DataFrame, path: str, fmt: str = "json", canonical_cols: list[str] | None = None, mode: str = "append") -> None:
    """Append records as JSON lines, CSV (with header) or Parquet."""
    out = canonical(df, canonical_cols) if canonical_cols else df
    writer = out.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown result format {fmt!r}, choose json, csv or parquet")
