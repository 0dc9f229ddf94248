"""A property graph as two tables: nodes merged by id, edges, neighbourhoods and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabulary.functions import text as X

# Which stage reads which (the lists that decide what a re-run makes stale).
DEPENDENTS = {
    "PRE.1": "PRE.2", "PRE.2": "ENT.1 STATE.2", "ENT.1": "ENT.2", "ENT.2": "ENT.3", "ENT.3": "STATE.1 STATE.2 SCENE.1 SCENE.3", "STATE.1": "STATE.2 STATE.3 SCENE.1", "STATE.2": "STATE.3 SCENE.1 SCENE.3", "STATE.3": "SCENE.1 FINAL.1",
    "SCENE.1": "SCENE.2 SCENE.3 VIS.1 VIS.2 SUB.1 SUB.2 SUB.3 SUB.4 FINAL.1", "SCENE.2": "SCENE.3", "SCENE.3": "VIS.1 VIS.2 SUB.1 SUB.2 SUB.3 SUB.4 SUP.0 FINAL.1", "VIS.1": "VIS.2", "VIS.2": "VIS.3 FINAL.1 FINAL.2", "VIS.3": "VIS.4", "VIS.4": "FINAL.1 FINAL.2",
    "SUB.1": "SUB.2 SUB.3", "SUB.2": "SUB.3", "SUB.3": "SUB.4 SUP.0 FINAL.1", "SUB.4": "FINAL.1", "SUP.0": "SUP.1", "SUP.1": "SUP.2 SUP.3 SUP.4 SUP.5", "SUP.2": "SUP.6", "SUP.3": "SUP.6", "SUP.4": "SUP.6", "SUP.5": "SUP.6", "SUP.6": "SUP.7", "SUP.7": "FINAL.1", "FINAL.1": "FINAL.2",
}


def descendants(stage: str) -> set[str]:
    """All stages that depend on a stage, at any distance."""
    out: set[str] = set()
    todo = DEPENDENTS.get(stage, "").split()
    while todo:
        s = todo.pop()
        if s not in out:
            out.add(s)
            todo += DEPENDENTS.get(s, "").split()
    return out


def merge_nodes(rows: DataFrame) -> DataFrame:
    """rows: node_id, kind, label, scene_key, tags, ord. One node per id: the last label, the last known scene, the union of tags in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "tags"))), lambda x: x["tags"])
    return rows.groupBy("node_id", "kind").agg(
        F.max_by("label", "ord").alias("label"), F.max_by("scene_key", F.when(F.col("scene_key").isNotNull(), F.col("ord"))).alias("scene_key"), X.unique_strings(F.flatten(ordered)).alias("tags")
    )


def project(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scenes, characters and places of every book as nodes and edges."""
    nid = lambda *parts: F.concat(F.lit("kg_node_"), X.short_hash(F.concat_ws("|", *parts), 28))
    scene = nid(F.col("doc_id"), F.lit("scene"), F.col("scene_key"))
    scenes = refs.select("doc_id", scene.alias("node_id"), F.lit("scene").alias("kind"), F.col("scene_key").alias("label"), "scene_key", F.concat(F.array("scene_key"), F.coalesce(F.array("place"), F.array()), "active_names").alias("tags"), "place_no")
    people = refs.select("doc_id", "scene_key", "place_no", F.explode("active_names").alias("name")).where(X.key("name") != "")
    places = refs.where("place is not null").select("doc_id", "scene_key", "place_no", F.col("place").alias("name")).where(X.key("name") != "")
    of = lambda d, k: d.select("doc_id", nid(F.col("doc_id"), F.lit(k), X.key("name")).alias("node_id"), F.lit(k).alias("kind"), F.col("name").alias("label"), "scene_key", F.array("name", "scene_key").alias("tags"), "place_no")
    rows = scenes.unionByName(of(people, "character")).unionByName(of(places, "place"))
    nodes = merge_nodes(rows.select("node_id", "kind", "label", "scene_key", F.filter("tags", lambda t: t.isNotNull()).alias("tags"), F.struct("place_no", "label").alias("ord")))
    link = lambda d, k, t: d.select(scene.alias("from_id"), nid(F.col("doc_id"), F.lit(k), X.key("name")).alias("to_id"), F.lit(t).alias("type"))
    return nodes, link(people, "character", "active_cast").unionByName(link(places, "place", "located_at")).distinct()


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Nodes within `depth` (0 to 3) undirected steps: node_id, hops. Each round expands only what the last one found."""
    both = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).unionByName(edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))).distinct()
    seen = start.select("node_id", F.lit(0).alias("hops"))
    front = seen
    for hop in range(1, max(0, min(3, depth)) + 1):
        front = both.join(front.select(F.col("node_id").alias("a")), "a").select(F.col("b").alias("node_id")).distinct().join(seen.select("node_id"), "node_id", "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(front)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are among the nodes."""
    return edges.join(nodes.select(F.col("node_id").alias("from_id")).distinct(), "from_id", "left_semi").join(nodes.select(F.col("node_id").alias("to_id")).distinct(), "to_id", "left_semi")


def _node(*parts):
    return F.concat(F.lit("kg_node_"), X.short_hash(F.concat_ws("|", *parts), 28))


def project_events(refs: DataFrame, events: DataFrame, actors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event nodes, and edges from scenes to their events, from events to who acts in them, and from scene to scene.

    events: doc_id, scene_key, event_key, action, causal_result; actors: doc_id, event_key, name.
    """
    scene = lambda c: _node(F.col("doc_id"), F.lit("scene"), F.col(c))
    event = _node(F.col("doc_id"), F.lit("event"), F.col("event_key"))
    nodes = events.select(event.alias("node_id"), F.lit("event").alias("kind"), F.col("action").alias("label"), "scene_key", F.filter(F.array("action", "causal_result"), lambda t: t.isNotNull()).alias("tags"))
    w = Window.partitionBy("doc_id", "chapter_id").orderBy("scene_no")
    follow = refs.withColumn("prev", F.lag("scene_key").over(w)).where("prev is not null").select(scene("prev").alias("from_id"), scene("scene_key").alias("to_id"), F.lit("scene_sequence").alias("type"))
    held = events.select(scene("scene_key").alias("from_id"), event.alias("to_id"), F.lit("contains_event").alias("type"))
    act = actors.where(X.key("name") != "").select(event.alias("from_id"), _node(F.col("doc_id"), F.lit("character"), X.key("name")).alias("to_id"), F.lit("actor").alias("type"))
    return nodes, held.unionByName(act).unionByName(follow)


def project_mentions(said: DataFrame) -> DataFrame:
    """Edges from every entity of a chapter to its mentions."""
    place = [F.col("chapter_id"), F.col("ord").cast("string")]
    spot = [F.col("pid").cast("string"), F.col("start_char").cast("string"), F.col("span")]
    return said.select(_node(F.col("doc_id"), F.lit("entity"), *place).alias("from_id"), _node(F.col("doc_id"), F.lit("mention"), *place, *spot).alias("to_id"), F.lit("has_mention").alias("type"), F.concat("plain", F.lit(" mentioned as "), "span").alias("label"))


# Which stage's artifact gives a graph; every other stage gives an empty one.
PROJECTED = {"SUP.0": "events", "ENT.3": "mentions"}
