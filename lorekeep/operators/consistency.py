"""Checks of the stored memory, each giving issues, and their report: issue_type, entity_type, severity, n, entity_ids (capped), description."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X
from .names import sorted_tokens, within

CAP = 50


def issue(found: DataFrame, id_col: str, issue_type: str, entity_type: str, severity: str | Column, says: str) -> DataFrame:
    """One issue for all rows found, if there are any; only the first ids are gathered."""
    ids = found.select(F.col(id_col).cast("string").alias("id"))
    first = ids.orderBy("id").limit(CAP).agg(F.array_sort(F.collect_list("id")).alias("entity_ids"))
    n = ids.agg(F.count(F.lit(1)).alias("n"))
    level = F.lit(severity) if isinstance(severity, str) else severity
    row = n.join(F.broadcast(first)).where("n > 0")
    return row.select(F.lit(issue_type).alias("issue_type"), F.lit(entity_type).alias("entity_type"), level.alias("severity"), "n", "entity_ids", F.concat(F.col("n").cast("string"), F.lit(f" {says}")).alias("description"))


def broken_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Active edges (edge_id, source_type, source, target_type, target, is_active) an end of which is no entity (type, id):
    edge_id, source_valid, target_valid."""
    known = entities.select("type", "id").distinct().withColumn("_ok", F.lit(True))
    side = lambda x: known.select(F.col("type").alias(f"{x}_type"), F.col("id").alias(x), F.col("_ok").alias(f"{x}_valid"))
    rows = edges.where("is_active").join(side("source"), ["source_type", "source"], "left").join(side("target"), ["target_type", "target"], "left")
    rows = rows.fillna(False, ["source_valid", "target_valid"])
    return rows.where(~(F.col("source_valid") & F.col("target_valid"))).select("edge_id", "source_valid", "target_valid")


def without_broken(edges: DataFrame, broken: DataFrame) -> DataFrame:
    """The repair: broken edges are no longer active."""
    marked = broken.select("edge_id", F.lit(True).alias("_b"))
    return edges.join(marked, "edge_id", "left").withColumn("is_active", F.col("is_active") & F.col("_b").isNull()).drop("_b")


def alike(entities: DataFrame, least: float = C.DUPLICATE_LEAST) -> DataFrame:
    """Pairs (a, b, likeness) of entities (id, name) with nearly one name, whatever the order of its tokens; no pair is lost."""
    rows = entities.select("id", sorted_tokens(F.col("name")).alias("name"))
    return within(rows, least).withColumnRenamed("name_score", "likeness")


def shared_keys(rows: DataFrame, id_col: str, **keys: Column) -> DataFrame:
    """rule, key, n, ids: what several rows share, by each of the keys; empty keys don't count."""
    parts = [rows.select(F.lit(rule).alias("rule"), F.col(id_col).alias("_id"), c.cast("string").alias("key")).where("key <> ''") for rule, c in keys.items()]
    both = reduce(DataFrame.unionByName, parts).distinct()
    n = both.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rank = F.row_number().over(Window.partitionBy("rule", "key").orderBy("_id"))
    first = both.join(n.select("rule", "key"), ["rule", "key"], "left_semi").withColumn("_r", rank).where(F.col("_r") <= CAP)
    return n.join(first.groupBy("rule", "key").agg(F.array_sort(F.collect_list("_id")).alias("ids")), ["rule", "key"])


def missing_times(rows: DataFrame, id_col: str, ts: str) -> DataFrame:
    return rows.where(F.col(ts).isNull()).select(id_col)


def odd_times(rows: DataFrame, id_col: str, ts: str, as_of: Column, since: int = 2000, ahead: int = 30) -> DataFrame:
    """Times before the year `since` or more than `ahead` days in the future."""
    return rows.where((F.year(ts) < since) | (F.datediff(F.col(ts), as_of) > ahead)).select(id_col)


def embedding_gap(total: DataFrame) -> DataFrame:
    """A row of n_chunks, n_pending -> pct and severity: critical above 20 %, warning above 5 %, info, ok where nothing is pending."""
    pct = F.when(F.col("n_chunks") > 0, F.round(100.0 * F.col("n_pending") / F.col("n_chunks"), 1)).otherwise(0.0)
    return total.withColumn("pct", pct).withColumn("severity", F.when(F.col("n_pending") == 0, "ok").when(F.col("pct") > 20, "critical").when(F.col("pct") > 5, "warning").otherwise("info"))


def report(*issues: DataFrame) -> DataFrame:
    """All issues, the gravest first."""
    rank = F.array_position(F.array(*map(F.lit, ["critical", "error", "warning", "info"])), F.col("severity"))
    return reduce(DataFrame.unionByName, issues).orderBy(rank, "issue_type", "entity_type")


def run_log(issues: DataFrame, checked: dict[str, DataFrame], run_id: str, as_of: Column) -> DataFrame:
    """One row about the run: rows checked per table, issues per type, how many need a look."""
    counted = issues.agg(F.coalesce(F.map_from_entries(F.array_sort(F.collect_list(F.struct("issue_type", "n")))), F.create_map().cast("map<string,bigint>")).alias("issues"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity").isin("critical", "error", "warning")).alias("to_review"))
    for name, rows in checked.items():
        counted = counted.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias(f"{name}_checked"))))
    return counted.withColumns({"run_id": F.lit(run_id), "started_at": as_of, "status": F.lit("completed")})
