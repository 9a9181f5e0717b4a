"""Registered queries of section I and the other run-log rows (A03, G13, H21).

The driver has no run logs, so the order lines stand in for them: every line is one evaluation record. Its order
number chooses score mode, user fraction and min_shared, its part the model and its supplier full or reduced graph;
discount, tax, quantity and price play the metrics. One configuration is left out, as a missing run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.catalog.fixtures import big, rnd, table
from weft.catalog.registry import Section
from weft.functions.lineage import materialize, scratch_path
from weft.operators import compare, evaluate, runs
from weft.sources.runs import (
    EPOCH_SCHEMA, EVAL_SCHEMA, TABLE_COLUMNS, pipeline_speedup, read_jsonl, read_jsonl_ordered, read_pipeline_log, read_runs, write_result,
)

section = Section()
query = section.query

MODELS = ["lightgcn", "gcn", "graphsage", "gat"]
_pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def records(spark, sf):
    """One evaluation record per order line."""
    li, od = table(spark, sf, "lineitem"), table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("l_orderkey")
    return li.join(od, k == F.col("o_orderkey")).select(
        _pick(runs.MODES, k % 2).alias("mode"), _pick(runs.FRACTIONS, F.floor(k / 2) % 4).alias("fraction"),
        _pick(runs.MIN_SHARED, F.floor(k / 8) % 3).cast("bigint").alias("min_shared"), _pick(MODELS, F.col("l_partkey") % 4).alias("model"),
        F.when(F.col("l_suppkey") % 2 == 0, "baseline").otherwise("reduced").alias("run_type"),
        F.col("l_discount").alias("ndcg"), F.col("l_tax").alias("recall"), (F.col("l_quantity") / 100).alias("precision"),
        (F.col("l_extendedprice") / 10000).alias("time_s"), k.cast("bigint").alias("seq"), F.col("l_extendedprice").alias("price"),
        big("l_linenumber").alias("line_no"), big("l_partkey").alias("part"), big("l_suppkey").alias("supp"),
    )


def with_hole(spark, sf):
    """All configurations but one, for the matrix that has to show a missing run."""
    missing = (F.col("mode") == "cosine") & (F.col("fraction") == 0.25) & (F.col("min_shared") == 5)
    return records(spark, sf).where(~missing)


_CTES = f"""rec AS (SELECT list_extract({runs.MODES!r}, l_orderkey % 2 + 1) AS mode, CAST(list_extract({runs.FRACTIONS!r}, (l_orderkey // 2) % 4 + 1) AS DOUBLE) AS fraction,
    CAST(list_extract({runs.MIN_SHARED!r}, (l_orderkey // 8) % 3 + 1) AS BIGINT) AS min_shared, list_extract({MODELS!r}, l_partkey % 4 + 1) AS model, CASE WHEN l_suppkey % 2 = 0 THEN 'baseline' ELSE 'reduced' END AS run_type,
    l_discount AS ndcg, l_tax AS recall, l_quantity / 100 AS precision, l_extendedprice / 10000 AS time_s, l_orderkey AS seq, l_extendedprice AS price,
    l_linenumber::BIGINT AS line_no, l_partkey AS part, l_suppkey AS supp FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  pre AS (SELECT * FROM rec{{hole}}),
  met AS (SELECT mode, fraction, min_shared, model, run_type, round(avg(ndcg), 12) AS ndcg, round(avg(recall), 12) AS recall, round(avg(precision), 12) AS precision, round(sum(time_s), 6) AS time_s, count(*) AS n FROM pre GROUP BY ALL),
  spd AS (SELECT mode, fraction, min_shared, model, b.time_s AS bt, r.time_s AS rt, round(b.time_s / r.time_s, 4) AS factor, round(100 * (b.n - r.n) / b.n, 4) AS mem, round(r.time_s / 10, 9) AS prep
    FROM (SELECT * FROM met WHERE run_type = 'baseline') b JOIN (SELECT * FROM met WHERE run_type = 'reduced') r USING (mode, fraction, min_shared, model)),
  grp AS (SELECT mode, fraction, min_shared, count(DISTINCT part) AS supers, round(100.0 * count(DISTINCT supp) / count(DISTINCT part), 6) AS comp, round(avg(ndcg) * 100, 12) AS edge, round(sum(time_s) / 100, 9) AS prep FROM pre GROUP BY ALL),
  flat AS (SELECT m.mode, m.fraction, m.min_shared, m.model, max(m.ndcg) FILTER (run_type = 'baseline') AS base_ndcg, max(m.recall) FILTER (run_type = 'baseline') AS base_recall, max(precision) FILTER (run_type = 'baseline') AS base_precision,
    max(time_s) FILTER (run_type = 'baseline') AS base_time_s, max(m.ndcg) FILTER (run_type = 'reduced') AS reduced_ndcg, max(m.recall) FILTER (run_type = 'reduced') AS reduced_recall,
    max(precision) FILTER (run_type = 'reduced') AS reduced_precision, max(time_s) FILTER (run_type = 'reduced') AS reduced_time_s, any_value(g.comp) AS nodes_removed_pct, any_value(g.edge) AS edges_removed_pct,
    any_value(g.prep) AS preprocessing_time_s, any_value(g.supers) AS num_super_nodes FROM met m LEFT JOIN grp g USING (mode, fraction, min_shared) GROUP BY 1, 2, 3, 4)"""


def _sql(body: str, more: str = "", hole: bool = False) -> str:
    ctes = _CTES.replace("{hole}", " WHERE NOT (mode = 'cosine' AND fraction = 0.25 AND min_shared = 5)" if hole else "")
    return f"WITH {ctes}{', ' + more if more else ''}\n{body}"


KEY = ["mode", "fraction", "min_shared"]


def write_result_files(spark, sf, source=records) -> str:
    """Nested result files, one per run, in directories named after the run's parameters."""
    p = materialize(source(spark, sf), "records")
    m = p.groupBy(*KEY, "model", "run_type").agg(
        rnd(F.avg("ndcg"), 12).alias("NDCG@10"), rnd(F.avg("recall"), 12).alias("Recall@10"), rnd(F.avg("precision"), 12).alias("Precision@10"),
        rnd(F.sum("time_s"), 6).alias("training_time_s"), F.count(F.lit(1)).alias("n"),
    )
    b, r = m.where(F.col("run_type") == "baseline"), m.where(F.col("run_type") == "reduced")
    s = b.select(*KEY, "model", F.col("training_time_s").alias("bt"), F.col("n").alias("bn")).join(r.select(*KEY, "model", F.col("training_time_s").alias("rt"), F.col("n").alias("rn")), [*KEY, "model"])
    s = s.select(
        *KEY, "model", F.col("bt").alias("training_time_original_s"), F.col("rt").alias("training_time_reduced_s"), rnd(F.col("bt") / F.col("rt"), 4).alias("speedup_factor"),
        rnd(100.0 * (F.col("bn") - F.col("rn")) / F.col("bn"), 4).alias("GPU_memory_reduction_pct"), rnd(F.col("rt") / 10, 9).alias("preprocessing_overhead_s"),
    )
    distinct = lambda c: p.select(*KEY, c).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias(c))
    g = p.groupBy(*KEY).agg(F.avg("ndcg").alias("e"), F.sum("time_s").alias("t")).join(distinct("part"), KEY).join(distinct("supp"), KEY).select(
        *KEY, F.struct(
            F.col("part").alias("num_super_nodes"), rnd(100.0 * F.col("supp") / F.col("part")).alias("compression_ratio_pct"),
            rnd(F.col("e") * 100, 12).alias("bipartite_edge_reduction_pct"), rnd(F.col("t") / 100, 9).alias("preprocessing_time_s"),
        ).alias("reduced"),
    )
    rows = lambda df, name: df.groupBy(*KEY).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in KEY and c != "n"])).alias(name))  # a few models per run
    digits = F.regexp_replace(F.col("fraction").cast("string"), r"\.", "")
    run = F.format_string("%s_frac%s_ms%d", "mode", digits, "min_shared")
    nested = g.join(rows(m, "metrics"), KEY).join(rows(s, "speedup"), KEY).select(run.alias("run"), "reduced", "metrics", "speedup", F.lit(1.0).alias("total_wall_time_s"))
    path = scratch_path(spark, "runs")
    nested.repartition("run").write.partitionBy("run").json(path)
    return path


def loaded(spark, sf, source=records):
    return read_runs(spark, write_result_files(spark, sf, source) + "/*/*.json")


def flat(spark, sf, source=records):
    return runs.flatten_sweep(loaded(spark, sf, source))


@query("a03_read_runs_metrics", _sql("SELECT mode, fraction, min_shared, model, run_type, ndcg, recall, precision, time_s FROM met"))
def a03(spark, sf):
    m = loaded(spark, sf)["metrics"]
    return m.select(*KEY, "model", "run_type", F.col("`NDCG@10`").alias("ndcg"), F.col("`Recall@10`").alias("recall"), F.col("`Precision@10`").alias("precision"), F.col("training_time_s").alias("time_s"))


@query("a03_read_runs_speedup", _sql("SELECT mode, fraction, min_shared, model, bt, rt, factor FROM spd"))
def a03_speedup(spark, sf):
    s = loaded(spark, sf)["speedup"]
    return s.select(*KEY, "model", F.col("training_time_original_s").alias("bt"), F.col("training_time_reduced_s").alias("rt"), F.col("speedup_factor").alias("factor"))


def eval_log(spark, sf, seq):
    """Evaluation records written and read back as JSON lines."""
    path = scratch_path(spark, "eval")
    r = records(spark, sf)
    nines = F.lit(None).cast("double")
    write_result(r.select(
        F.concat("model", F.lit("_"), "run_type").alias("model"), F.col("ndcg").alias("NDCG@10"), F.col("precision").alias("Precision@10"), F.col("recall").alias("Recall@10"),
        nines.alias("HitRate@10"), nines.alias("UsersEvaluated"), F.col("time_s").alias("RMSE"), (F.col("time_s") / 2).alias("MAE"), *seq,
    ), path, "json")
    return path


def pipeline_log(spark, sf) -> str:
    """A pipeline log as JSON lines: one coarsen record for each score mode, and the speedup record of all models."""
    path = scratch_path(spark, "pipeline")
    r = materialize(records(spark, sf), "records")
    coarsen = r.groupBy("mode").agg(F.round(F.sum("time_s"), 4).alias("time_s"), F.count(F.lit(1)).alias("num_users")).select(
        F.to_json(F.struct(F.lit("coarsen").alias("stage"), "time_s", "num_users")).alias("value"))
    side = lambda kind, c: F.sum(F.when(F.col("run_type") == kind, c))
    times = r.groupBy("model").agg(
        *[side(k, F.col("time_s")).alias(f"{k}_avg_epoch_time_s") for k in ("baseline", "reduced")], *[side(k, F.lit(1.0)).alias(f"{k}_max_gpu_mem_mb") for k in ("baseline", "reduced")])
    pairs = times.select(F.explode(F.array(*[F.struct(F.concat("model", F.lit(f"_{c}")).alias("k"), F.col(c).alias("v")) for c in times.columns[1:]])).alias("p"))
    entry = pairs.groupBy().agg(F.map_from_entries(F.collect_list("p")).alias("m"))  # four numbers for each model
    speed = entry.select(F.to_json(F.map_concat(F.create_map(F.lit("stage"), F.lit("speedup")), F.transform_values("m", lambda _, v: v.cast("string")))).alias("value"))
    coarsen.unionAll(speed).write.text(path)
    return path


@query("a03_read_pipeline_log", _sql("""SELECT 'coarsen' AS stage, 'time_s' AS key, round(sum(time_s), 2) AS value, 1::BIGINT AS n FROM rec GROUP BY mode
    UNION ALL SELECT 'coarsen', 'num_users', count(*)::DOUBLE, 1 FROM rec GROUP BY mode
    UNION ALL SELECT 'speedup', model || '_' || run_type || '_avg_epoch_time_s', round(sum(time_s), 2), 1 FROM rec GROUP BY model, run_type
    UNION ALL SELECT 'speedup', model || '_' || run_type || '_max_gpu_mem_mb', count(*)::DOUBLE, 1 FROM rec GROUP BY model, run_type"""))
def a03_pipeline_log(spark, sf):
    return read_pipeline_log(spark, pipeline_log(spark, sf)).withColumn("value", rnd("value", 2)).withColumn("n", F.lit(1).cast("bigint"))


def _table_frame(spark, sf, name):
    """A few of a table's columns, and one more that it does not have."""
    r = records(spark, sf)
    own = {"memory_usage": ("stage", "elapsed_s"), "speedup_results": ("model", "speedup_factor"), "reduction_stats": ("stage", "edges_removed"), "preprocessing_time": ("stage", "elapsed_s")}[name]
    return r.groupBy(F.col("model").alias(own[0])).agg(rnd(F.sum("time_s"), 2).alias(own[1]), F.count(F.lit(1)).alias("extra"))


def _canonical_table(name):
    columns = TABLE_COLUMNS[name]
    own = {"speedup_results": "speedup_factor", "reduction_stats": "edges_removed"}.get(name, "elapsed_s")
    oracle = _sql(f"SELECT model AS first, round(sum(time_s), 2) AS own, {len(columns) - 2}::BIGINT AS missing, count(*) AS extra FROM rec GROUP BY model")

    @query(f"a04_{name}", oracle)
    def written(spark, sf):
        path = scratch_path(spark, name)
        write_result(_table_frame(spark, sf, name), path, "csv", columns)
        back = spark.read.schema(", ".join(f"`{c}` string" for c in [*columns, "extra"])).option("header", True).option("enforceSchema", False).csv(path)
        missing = sum((F.col(f"`{c}`").isNull().cast("bigint") for c in columns if c not in (columns[0], own)), F.lit(0).cast("bigint"))
        return back.select(F.col(columns[0]).alias("first"), rnd(F.col(own).cast("double"), 2).alias("own"), missing.alias("missing"), big("extra"))


for _name in ("memory_usage", "speedup_results", "reduction_stats", "preprocessing_time"):
    _canonical_table(_name)


_LAST = """lastr AS (SELECT model, run_type, arg_max(struct_pack(ndcg := ndcg, precision := precision, recall := recall, time_s := time_s), (seq, line_no, part, supp, price, precision)) AS r FROM rec GROUP BY 1, 2),
  lb AS (SELECT model, r AS b FROM lastr WHERE run_type = 'baseline'), lr AS (SELECT model, r FROM lastr WHERE run_type = 'reduced'),
  sp AS (SELECT model, sum(time_s) FILTER (run_type = 'baseline') AS bt, sum(time_s) FILTER (run_type = 'reduced') AS rt, count(*) FILTER (run_type = 'baseline') AS bm, count(*) FILTER (run_type = 'reduced') AS rm FROM rec GROUP BY 1)"""


@query("i01_compare_runs", _sql("""SELECT model, round(r.ndcg, 6) AS ndcg_reduced, round(b.ndcg, 6) AS ndcg_baseline, round(r.ndcg - b.ndcg, 6) + 0.0 AS ndcg_delta, round(r.precision - b.precision, 6) + 0.0 AS precision_delta,
    round(r.recall - b.recall, 6) + 0.0 AS recall_delta, round(r.time_s - b.time_s, 6) + 0.0 AS rmse_delta, round((r.time_s - b.time_s) / 2, 6) + 0.0 AS mae_delta, round(bt / rt, 6) AS speedup, round(100.0 * (bm - rm) / bm, 6) AS mem_saved_pct
    FROM lb JOIN lr USING (model) JOIN sp USING (model)""", _LAST))
def i01(spark, sf):
    seq = F.struct("seq", "line_no", "part", "supp", "price", "precision").alias("seq")
    path = eval_log(spark, sf, [seq])
    log = read_jsonl_ordered(spark, path, EVAL_SCHEMA, "seq struct<seq: bigint, line_no: bigint, part: bigint, supp: bigint, price: double, precision: double>")
    c = runs.compare_runs(log, pipeline_speedup(read_pipeline_log(spark, pipeline_log(spark, sf))))
    take = lambda m, kind: rnd(F.col(f"`{m}_{kind}`"))
    return c.select(
        "model", take("NDCG@10", "reduced").alias("ndcg_reduced"), take("NDCG@10", "baseline").alias("ndcg_baseline"), take("NDCG@10", "delta").alias("ndcg_delta"),
        take("Precision@10", "delta").alias("precision_delta"), take("Recall@10", "delta").alias("recall_delta"), take("RMSE", "delta").alias("rmse_delta"), take("MAE", "delta").alias("mae_delta"),
        rnd("speedup").alias("speedup"), rnd("mem_saved_pct").alias("mem_saved_pct"),
    )


@query("i02_flatten_sweep", _sql("SELECT * FROM flat"))
def i02(spark, sf):
    return flat(spark, sf)


_CELL = ", ".join(
    f"max(base_ndcg) FILTER (min_shared = {s}) AS base_{s}, max(reduced_ndcg) FILTER (min_shared = {s}) AS reduced_{s}, round(max(reduced_ndcg - base_ndcg) FILTER (min_shared = {s}), 6) AS delta_{s}, "
    f"round(max(100 * (reduced_ndcg - base_ndcg) / base_ndcg) FILTER (min_shared = {s}), 6) AS delta_pct_{s}" for s in runs.MIN_SHARED)


@query("i03_sweep_matrix", _sql(f"SELECT g.mode, g.model, g.fraction, {_CELL} FROM (SELECT DISTINCT mode, model, f AS fraction FROM flat, (SELECT CAST(unnest({runs.FRACTIONS!r}) AS DOUBLE) AS f)) g LEFT JOIN flat USING (mode, model, fraction) GROUP BY ALL", hole=True))
def i03(spark, sf):
    m = runs.sweep_matrix(materialize(flat(spark, sf, with_hole), "flat"), "ndcg")
    cells = [(s, c) for s in runs.MIN_SHARED for c in ("base", "reduced", "delta", "delta_pct")]
    return m.select("mode", "model", "fraction", *[(rnd(F.col(f"`{s}_{c}`")) if "delta" in c else F.col(f"`{s}_{c}`")).alias(f"{c}_{s}") for s, c in cells])


@query("i04_sweep_mean", _sql("""SELECT mode, model, fraction, round(avg(reduced_ndcg), 6) AS mean_reduced_ndcg, round(avg(preprocessing_time_s), 6) AS mean_preprocessing_time_s,
    round(avg(num_super_nodes), 6) AS mean_num_super_nodes FROM flat GROUP BY 1, 2, 3"""))
def i04(spark, sf):
    m = runs.sweep_mean(flat(spark, sf), ["reduced_ndcg", "preprocessing_time_s", "num_super_nodes"])
    return m.select("mode", "model", "fraction", *[rnd(c).alias(c) for c in m.columns if c.startswith("mean_")])


@query("i05_best_config", _sql("""SELECT model, mode, fraction, min_shared, base_ndcg AS base, reduced_ndcg AS reduced, round(100 * (reduced_ndcg - base_ndcg) / base_ndcg, 6) AS change_pct FROM (
    SELECT *, row_number() OVER (PARTITION BY model ORDER BY reduced_ndcg DESC, mode, fraction, min_shared) AS rn FROM flat WHERE reduced_ndcg IS NOT NULL) WHERE rn = 1"""))
def i05(spark, sf):
    return runs.best_config(flat(spark, sf), "ndcg").withColumn("change_pct", rnd("change_pct"))


@query("i06_loss_curve", "SELECT event_type AS run, CAST(event_id AS BIGINT) AS epoch, value AS loss FROM events")
def i06(spark, sf):
    """Events as an epoch log; summary records and cut-off lines are written in between and must disappear."""
    ev = table(spark, sf, "events").select(F.col("event_type").alias("run"), big("event_id").alias("epoch"), F.col("value").alias("loss"))
    path = scratch_path(spark, "epochs")
    lines = ev.select(F.to_json(F.struct("run", "epoch", "loss")).alias("value"))
    summary = ev.groupBy("run").agg(F.max("epoch").alias("epoch"), F.avg("loss").alias("loss")).select(F.to_json(F.struct(F.lit("summary").alias("type"), "run", "epoch", "loss")).alias("value"))
    broken = ev.where(F.col("epoch") % 13 == 0).select(F.concat(F.lit('{"run": "'), "run").alias("value"))
    lines.unionAll(summary).unionAll(broken).write.text(path)
    return runs.loss_curve(read_jsonl(spark, path, EPOCH_SCHEMA))


_SPEED = ", ".join(f"max(factor) FILTER (min_shared = {s}) AS factor_{s}, max(mem) FILTER (min_shared = {s}) AS mem_pct_{s}, max(prep) FILTER (min_shared = {s}) AS prep_s_{s}" for s in runs.MIN_SHARED)


@query("i07_speedup_matrix", _sql(f"SELECT mode, model, fraction, {_SPEED} FROM spd GROUP BY 1, 2, 3"))
def i07(spark, sf):
    m = runs.speedup_matrix(loaded(spark, sf)["speedup"])
    return m.select("mode", "model", "fraction", *[F.col(f"`{s}_{c}`").alias(f"{c}_{s}") for s in runs.MIN_SHARED for c in ("factor", "mem_pct", "prep_s")])


@query("g13_efficiency", _sql("""SELECT b.model, round(b.a / r.a, 6) AS epoch_speedup, round((b.m - r.m) / b.m, 6) AS memory_reduction_ratio, round(p / r.t, 6) AS preprocess_vs_training_ratio, round(b.t - r.t, 6) + 0.0 AS training_time_saved_s,
    round(b.t - r.t - p, 6) + 0.0 AS net_gain_s FROM (SELECT model, avg(time_s) AS a, max(price) AS m, sum(time_s) AS t FROM rec WHERE run_type = 'baseline' GROUP BY 1) b
    JOIN (SELECT model, avg(time_s) AS a, max(price) AS m, sum(time_s) AS t, sum(recall) AS p FROM rec WHERE run_type = 'reduced' GROUP BY 1) r USING (model)"""))
def g13(spark, sf):
    def summary(kind):
        return records(spark, sf).where(F.col("run_type") == kind).groupBy("model").agg(
            F.avg("time_s").alias("avg_epoch_time_s"), F.max("price").alias("max_gpu_mem_mb"), F.sum("time_s").alias("total_train_time_s"), F.sum("recall").alias("preprocess_time_s")
        )

    e = evaluate.efficiency(summary("baseline"), summary("reduced"))
    return e.select("model", *[rnd(c, 6).alias(c) for c in e.columns if c != "model"])


_CORR = """cr AS (SELECT nodes_removed_pct / 100 AS c, reduced_ndcg - base_ndcg AS d, reduced_recall / (base_recall + reduced_recall) AS o FROM flat),
  cc AS (SELECT count(*) AS n, min(c) AS c0, max(c) AS c1, CASE WHEN stddev_pop(c) < 1e-9 OR stddev_pop(d) < 1e-9 THEN 0 ELSE corr(c, d) END AS rn, CASE WHEN stddev_pop(c) < 1e-9 OR stddev_pop(o) < 1e-9 THEN 0 ELSE corr(c, o) END AS rs,
    min(d) AS d0, max(d) AS d1, avg(o) AS s FROM cr)"""
_CORR_TEXT = f"""CASE WHEN abs(rn) < 0.2 THEN '{compare.NDCG_FLAT}' WHEN rn < -0.4 THEN '{compare.NDCG_DOWN}' WHEN rn > 0.4 THEN '{compare.NDCG_UP}' ELSE printf('{compare.NDCG_WEAK}', rn) END || ' ' ||
    CASE WHEN rs < -0.4 THEN '{compare.STABILITY_DOWN}' WHEN rs > 0.4 THEN '{compare.STABILITY_UP}' ELSE printf('{compare.STABILITY_FLAT}', rs) END AS interpretation"""


@query("h21_compression_correlation", _sql(f"""SELECT n AS num_runs, round(c0, 6) AS compression_min, round(c1, 6) AS compression_max, round(rn, 6) AS r_ndcg, round(rs, 6) AS r_stability, round(d0, 6) AS ndcg_change_min,
    round(d1, 6) AS ndcg_change_max, round(s, 6) AS mean_stability, {_CORR_TEXT} FROM cc""", _CORR))
def h21(spark, sf):
    f = flat(spark, sf).select(
        (F.col("nodes_removed_pct") / 100).alias("compression"), F.col("base_ndcg").alias("ndcg_baseline"), F.col("reduced_ndcg").alias("ndcg_reduced"),
        (F.col("reduced_recall") / (F.col("base_recall") + F.col("reduced_recall"))).alias("overlap"),
    )
    c = compare.compression_correlation(f)
    return c.select(*[x if x in ("num_runs", "interpretation") else rnd(x).alias(x) for x in c.columns])
