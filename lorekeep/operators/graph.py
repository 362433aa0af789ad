"""Edges, neighbours, breadth-first search, components, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


def upsert_edges(observed: DataFrame, evidence_cap: int = 100) -> DataFrame:
    """source, target, type, strength, evidence, seen_at -> one edge each: frequency, largest strength, first and last sight, and
    the distinct evidence seen last (evidence_cap at most, sorted). Only what is kept is gathered."""
    key = ["source", "target", "type"]
    each = observed.groupBy(*key, "evidence").agg(F.count(F.lit(1)).alias("_n"), F.max("strength").alias("_s"), F.min("seen_at").alias("_a"), F.max("seen_at").alias("_z"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_z"), F.desc("evidence")))
    kept = F.collect_list(F.when((F.col("_r") <= evidence_cap) & F.col("evidence").isNotNull(), F.col("evidence")))
    return each.withColumn("_r", rank).groupBy(*key).agg(
        F.sum("_n").alias("frequency"), F.max("_s").alias("strength"), F.min("_a").alias("first_seen"), F.max("_z").alias("last_seen"), F.array_sort(kept).alias("evidence")
    )


def neighbours(edges: DataFrame, n: int) -> DataFrame:
    """Each source's n most frequent targets."""
    w = Window.partitionBy("source").orderBy(F.desc("frequency"), "target")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def document_uuid(doc_id: Column) -> Column:
    """A document's id as the UUID of its MD5."""
    return F.regexp_replace(F.md5(doc_id), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def linked(rows: DataFrame, source_type: str, target_type: str, kind: str | None = None) -> DataFrame:
    """source, target, ... as typed edges; a kind that does not fit the two types is an error."""
    kind = kind or C.DEFAULT_LINKS[source_type, target_type]
    if kind not in C.RELATION_TYPES[source_type, target_type]:
        raise ValueError(f"{kind} does not link {source_type} and {target_type}")
    target = document_uuid(F.col("target")) if target_type == "document" else F.col("target")
    return rows.withColumns({"source_type": F.lit(source_type), "target_type": F.lit(target_type), "type": F.lit(kind), "target": target})


def relationships_of(edges: DataFrame, entities: DataFrame, direction: str = "both", types: list[str] | None = None, least: float = 0.0, n: int = 100) -> DataFrame:
    """entity_type, entity, direction, other_type, other, type, strength, frequency, rank: the n most frequent active edges of each
    entity (entity_type, entity), outbound, inbound or both ways."""
    rows = edges.where("is_active").where(F.col("strength") >= least) if least > 0 else edges.where("is_active")
    rows = rows.where(F.col("type").isin(*types)) if types else rows
    keep = ["type", "strength", "frequency"]
    out = rows.select(F.col("source_type").alias("entity_type"), F.col("source").alias("entity"), F.lit("outbound").alias("direction"), F.col("target_type").alias("other_type"), F.col("target").alias("other"), *keep)
    back = rows.select(F.col("target_type").alias("entity_type"), F.col("target").alias("entity"), F.lit("inbound").alias("direction"), F.col("source_type").alias("other_type"), F.col("source").alias("other"), *keep)
    found = {"outbound": out, "inbound": back, "both": out.unionByName(back)}[direction].join(entities, ["entity_type", "entity"], "left_semi")
    w = Window.partitionBy("entity_type", "entity").orderBy(F.desc("frequency"), "other_type", "other", "type", "direction")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def related_entities(edges: DataFrame, entities: DataFrame, other_type: str) -> DataFrame:
    """entity_type, entity -> other, type: e.g. the projects of companies, the persons of projects."""
    return relationships_of(edges, entities, n=2**31 - 1).where(F.col("other_type") == other_type).select("entity_type", "entity", "other", "type").distinct()


def subgraph(edges: DataFrame, anchors: DataFrame, depth: int = 2, per_node: int = C.NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """Nodes (entity_type, entity, hop) up to depth steps from the anchors (entity_type, entity), each going on along its per_node
    most frequent edges only, and those edges (as relationships_of gives them, with hop)."""
    shared_checkpoints(edges.sparkSession)
    nodes = anchors.distinct().withColumn("hop", F.lit(0))
    front, found = anchors.distinct(), None
    for hop in range(depth):
        rels = relationships_of(edges, front, n=per_node).withColumn("hop", F.lit(hop)).checkpoint()
        found = rels if found is None else found.unionByName(rels)
        front = rels.select(F.col("other_type").alias("entity_type"), F.col("other").alias("entity")).distinct().join(nodes, ["entity_type", "entity"], "left_anti").checkpoint()
        nodes = nodes.unionByName(front.withColumn("hop", F.lit(hop + 1)))
    return nodes, found


def shared_checkpoints(spark) -> None:
    """Checkpoints go to the folder that the cluster names; a local one serves only a session without executors elsewhere."""
    if spark.sparkContext.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="lorekeep-")
    spark.sparkContext.setCheckpointDir(found)


def reach(edges: DataFrame, seeds: DataFrame, depth: int, both_ways: bool = True) -> DataFrame:
    """node, hop: the least number of steps from a seed, up to depth; edges go both ways unless told otherwise. A loop of joins; each front is checkpointed, so no step is computed again."""
    shared_checkpoints(edges.sparkSession)
    both = edges.select("source", "target")
    both = both.union(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))) if both_ways else both
    found = seeds.select("node", F.lit(0).alias("hop"))
    front = found
    for hop in range(1, depth + 1):
        front = both.join(front, both["source"] == front["node"], "left_semi").select(F.col("target").alias("node")).distinct()
        front = front.join(found, "node", "left_anti").withColumn("hop", F.lit(hop))
        front = front.checkpoint() if hop < depth else front
        found = found.unionByName(front)
    return found


def stale(edges: DataFrame, as_of: Column, days: int = 180, least: int = 3) -> DataFrame:
    """Edges with is_active; long unseen rare ones are not."""
    old = F.datediff(as_of, F.col("last_seen")) > days
    return edges.withColumn("is_active", ~(old & (F.col("frequency") < least)))


def co_occurrence(members: DataFrame, group: str, item: str) -> DataFrame:
    """Pairs of items that share a group, with how many groups they share; a < b."""
    a = members.select(group, F.col(item).alias("a")).distinct()
    b = members.select(group, F.col(item).alias("b")).distinct()
    return a.join(b, group).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"))


def grouped_timeline(events: DataFrame, entity: str, ts: str, kind: str, unit: str = "week") -> DataFrame:
    """Per entity and calendar unit: events, distinct kinds, first and last time."""
    return events.groupBy(entity, F.date_trunc(unit, ts).alias("period")).agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct(kind).alias("n_kinds"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))


#: Parts that the nodes of one label are dealt to.
SALTS = 16


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component: least reachable node. Each turn takes the least label of the neighbours, then that label's own label, so
    turns grow with the logarithm of a path rather than its length; edges are written once, lineage is cut each turn."""
    shared_checkpoints(edges.sparkSession)
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct().checkpoint()
    labels = both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("component")).checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        tops = lower.where("component < node").select(F.col("node").alias("component"), F.col("component").alias("top")).join(lower.select("component").distinct(), "component", "left_semi")
        tops = tops.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a label may be that of nearly all nodes
        after = lower.withColumn("_s", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(tops, ["component", "_s"], "left").select("node", "was", F.least("component", F.coalesce("top", "component")).alias("component")).checkpoint()
        labels = after.select("node", "component")
        if after.where("was <> component").limit(1).count() == 0:
            return labels
