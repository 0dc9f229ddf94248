"""Memory across the chapters of a book: boundary edges, entity threads, claims, and what a reader may see of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulary.functions import text as X

# Weights of the edges between chapters.
WEIGHTS = {"chapter_sequence": 0.5, "cross_chapter_character_thread": 0.78, "cross_chapter_same_place": 0.64, "cross_chapter_place_shift": 0.58, "cross_chapter_causal_bridge": 0.72, "entity_reappearance": 0.66}
# In which order edges are read.
PRIORITY = {"cross_chapter_causal_bridge": 0, "cross_chapter_place_shift": 1, "cross_chapter_same_place": 2, "cross_chapter_character_thread": 3, "entity_reappearance": 4, "chapter_sequence": 5}


def chapter_index() -> Column:
    """The number in a chapter's id."""
    return F.regexp_extract("chapter_id", r"(\d+)", 1).cast("int")


def scene_refs(scenes: DataFrame, events: DataFrame) -> DataFrame:
    """Scenes by their key in the book, with what was cried out in them: the first four actions, the last known cause."""
    told = events.groupBy("doc_id", "chapter_id", "scene_no").agg(
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("n", "action"))), 1, 4), lambda x: x["action"]).alias("actions"), F.max_by("causal_result", F.when(F.col("causal_result").isNotNull(), F.col("n"))).alias("cause")
    )
    s = scenes.join(told, ["doc_id", "chapter_id", "scene_no"], "left")
    key = F.concat("chapter_id", F.lit(":"), "scene_id").alias("scene_key")
    return s.select("doc_id", "chapter_id", chapter_index().alias("idx"), "scene_no", key, "start_pid", "end_pid", "place", "active_names", "summary", F.coalesce("actions", F.expr("cast(array() as array<string>)")).alias("actions"), "cause")


def boundary_edges(refs: DataFrame) -> DataFrame:
    """Edges from the last scene of a chapter to the first of the next: sequence, shared cast, same or other place, cause and act."""
    end = F.struct("scene_key", "place", "active_names", "actions", "cause")
    last = refs.groupBy("doc_id", "chapter_id", "idx").agg(F.max_by(end, "scene_no").alias("last"), F.min_by(end, "scene_no").alias("first"))
    w = Window.partitionBy("doc_id").orderBy("idx", "chapter_id")
    b = last.withColumn("p", F.lag("last").over(w)).where("p is not null")
    shared = X.keep("first.active_names", "p.active_names")
    row = lambda t, label: F.struct(F.lit(t).alias("type"), F.lit(WEIGHTS[t]).alias("weight"), label.alias("label"))
    arrow, act = F.lit(" -> "), F.get("first.actions", F.lit(0))
    same = F.col("p.place") == F.col("first.place")
    made = F.array(
        row("chapter_sequence", F.concat("p.scene_key", arrow, "first.scene_key")),
        F.when(F.size(shared) > 0, row("cross_chapter_character_thread", F.concat(F.lit("continued cast: "), F.array_join(F.slice(shared, 1, 4), ", ")))),
        F.when(same, row("cross_chapter_same_place", F.concat(F.lit("same place continues: "), "first.place"))),
        F.when(~same, row("cross_chapter_place_shift", F.concat("p.place", arrow, "first.place"))),
        F.when(F.col("p.cause").isNotNull() & act.isNotNull(), row("cross_chapter_causal_bridge", F.concat("p.cause", arrow, act))),
    )
    out = b.select("doc_id", F.col("p.scene_key").alias("from_key"), F.col("first.scene_key").alias("to_key"), F.explode(F.filter(made, lambda e: e.isNotNull())).alias("e")).select("doc_id", "from_key", "to_key", "e.*")
    return out.withColumn("edge_id", F.concat(F.lit("book_edge_"), X.short_hash(F.concat_ws("|", "type", "doc_id", "from_key", "to_key"))))


def occurrences(said: DataFrame, refs: DataFrame) -> DataFrame:
    """One row per entity and chapter: how often it is mentioned, where first, and in which scene that is."""
    # A name without a Latin letter, digit or Hangul is its own key.
    m = said.where("mention_type <> 'time'").withColumn("key", F.coalesce(F.nullif(X.key("plain"), F.lit("")), "plain")).where("key <> ''")
    o = m.groupBy("doc_id", "chapter_id", "key").agg(F.count("*").alias("mentions"), F.min("pid").alias("first_pid")).withColumn("idx", chapter_index())
    inside = o.join(refs.select("doc_id", "chapter_id", "scene_key", "start_pid", "end_pid"), ["doc_id", "chapter_id"]).where("first_pid between start_pid and end_pid")
    first = inside.groupBy("doc_id", "chapter_id", "key").agg(F.min("scene_key").alias("first_scene"))
    return o.join(first, ["doc_id", "chapter_id", "key"], "left")


def threads(occ: DataFrame) -> DataFrame:
    """Entities seen in two or more chapters."""
    return occ.groupBy("doc_id", "key").agg(F.count("*").alias("chapters"), F.sum("mentions").alias("mentions"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")).where("chapters >= 2")


def reappearances(occ: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "key").orderBy("idx", "chapter_id")
    o = occ.withColumns({"from_key": F.lag("first_scene").over(w), "from_chapter": F.lag("chapter_id").over(w)}).where("from_key is not null and first_scene is not null")
    out = o.select("doc_id", "key", "from_key", F.col("first_scene").alias("to_key"), F.lit("entity_reappearance").alias("type"), F.lit(WEIGHTS["entity_reappearance"]).alias("weight"), F.concat("key", F.lit(" reappears across chapters")).alias("label"), "from_chapter", "chapter_id")
    return out.withColumn("edge_id", F.concat(F.lit("book_edge_"), X.short_hash(F.concat_ws("|", "type", "doc_id", "key", "from_chapter", "chapter_id")))).drop("from_chapter", "chapter_id")


def claims(refs: DataFrame, edges: DataFrame, occ: DataFrame) -> DataFrame:
    """State, place and event claims of scenes, a claim of every edge, and of entity threads the first twelve appearances."""
    kind = lambda t, text, sure: F.struct(F.lit(t).alias("claim_type"), text.alias("claim"), F.lit(sure).alias("confidence"))
    made = F.concat(
        F.array(F.when(F.coalesce("summary", F.lit("")) != "", kind("state", F.col("summary"), 0.74)), F.when(F.col("place").isNotNull(), kind("place", F.concat(F.lit("Current place: "), "place"), 0.78))),
        F.transform("actions", lambda a: kind("event", a, 0.68)),
    )
    told = refs.select("doc_id", "scene_key", F.posexplode(F.filter(made, lambda c: c.isNotNull())).alias("i", "c")).select("doc_id", "scene_key", "i", "c.*")
    told = told.withColumn("claim_id", X.safe_id(F.concat_ws(":", F.lit("claim"), "doc_id", "scene_key", "claim_type", F.when(F.col("claim_type") == "event", F.col("claim"))), 180)).drop("i").distinct()
    of = F.when(F.col("type") == "cross_chapter_causal_bridge", "causal").when(F.col("type").isin("cross_chapter_place_shift", "cross_chapter_same_place"), "place").when(F.col("type").isin("cross_chapter_character_thread", "entity_reappearance"), "relation").otherwise("event")
    linked = edges.select("doc_id", F.col("to_key").alias("scene_key"), of.alias("claim_type"), F.col("label").alias("claim"), X.bounded("weight", 0.65).alias("confidence"), X.safe_id(F.concat_ws(":", F.lit("claim"), "edge_id"), 180).alias("claim_id"))
    w = Window.partitionBy("doc_id", "key").orderBy("idx", "chapter_id")
    first = occ.withColumns({"nth": F.row_number().over(w), "chapters": F.count("*").over(Window.partitionBy("doc_id", "key"))}).where("chapters >= 2 and nth <= 12")
    seen = first.select("doc_id", F.col("first_scene").alias("scene_key"), F.lit("relation").alias("claim_type"), F.concat("key", F.lit(" appears in "), "chapter_id", F.lit(".")).alias("claim"), F.lit(0.64).alias("confidence"), X.safe_id(F.concat_ws(":", F.lit("claim:entity"), "doc_id", "key", "chapter_id", "first_scene"), 180).alias("claim_id"))
    return told.unionByName(linked).unionByName(seen)


def reading_order(refs: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("idx", "start_pid", "scene_key")
    return refs.withColumn("place_no", F.row_number().over(w))


# Which claims and which edges speak to which kind of support; "all" and kinds not named take every one.
CLAIMS_OF = {
    "causal_bridge": ["causal"], "spatial_continuity": ["place"], "visual_context": ["place"], "character_focus": ["relation"], "reference_repair": ["relation"], "relation_delta": ["relation"],
    "snapshot": ["state", "event", "place"], "boundary_delta": ["state", "event", "place"], "reentry_recap": ["state", "event", "place"],
}
_PLACES, _PEOPLE = ["cross_chapter_place_shift", "cross_chapter_same_place"], ["cross_chapter_character_thread", "entity_reappearance"]
_STATE = [t for t in WEIGHTS if t != "entity_reappearance"]
EDGES_OF = {
    "causal_bridge": ["cross_chapter_causal_bridge"], "spatial_continuity": _PLACES, "visual_context": _PLACES, "character_focus": _PEOPLE, "reference_repair": _PEOPLE, "relation_delta": _PEOPLE,
    "snapshot": _STATE, "boundary_delta": _STATE, "reentry_recap": _STATE,
}
# What a claim becomes for the reader: kind of unit, problem, label, title; the order in which claims are read.
UNIT_OF = {"causal": ("causal_bridge", "causal_gap", "Why", "Reader-safe causal claim"), "place": ("spatial_continuity", "spatial_disorientation", "Place", "Reader-safe place claim"), "relation": ("character_focus", "character_reentry", "Thread", "Reader-safe character thread")}
CLAIM_ORDER = {"causal": 0, "place": 1, "relation": 2}


def by_kind(rows: DataFrame, column: str, table: dict[str, list[str]]) -> DataFrame:
    """rows once for every kind of support they speak to; kind: "all" holds every row."""
    kinds = F.array(F.lit("all"), *[F.when(F.col(column).isin(*types), F.lit(kind)) for kind, types in table.items()])
    return rows.withColumn("kind", F.explode(F.filter(kinds, lambda k: k.isNotNull())))


def cue(label: str | Column) -> Column:
    """What a label says of now: the part after the last arrow, without the words that lead to it, to its first comma; null if that is under two characters."""
    parts = F.filter(F.transform(F.split(X.col(label), r"\s*(?:->|→|=>)\s*"), lambda p: F.trim(p)), lambda p: p != "")
    raw = F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(X.col(label))
    bare = F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?i)^(current place|same place continues|continued cast):\s*", ""), r"(?i)\s+(reappears across chapters\.?|appears in .+)$", ""))
    first = F.trim(F.split_part(bare, F.lit(","), F.lit(1)))
    return F.when(F.length(first) >= 2, first)


def book_units(claimed: DataFrame, edges: DataFrame, most: int = 4) -> DataFrame:
    """What the book adds to a scene: its first claims by kind and confidence, or the first edges where there is no claim.

    Out: doc_id, scene_key, source, kind, problem, label, title, cue, nth.
    """
    order = F.element_at(F.create_map(*[F.lit(x) for p in CLAIM_ORDER.items() for x in p]), F.col("claim_type"))
    w = Window.partitionBy("doc_id", "scene_key").orderBy("o", F.desc("confidence"), "claim_id")
    field = lambda t, i: F.element_at(F.create_map(*[F.lit(x) for k, v in UNIT_OF.items() for x in (k, v[i])]), F.col(t))
    units = lambda df, source, id_: df.select("doc_id", "scene_key", F.lit(source).alias("source"), *[field("claim_type", i).alias(n) for i, n in enumerate(("kind", "problem", "label", "title"))], cue("claim").alias("cue"), "nth")
    told = claimed.where(F.col("claim_type").isin(*CLAIM_ORDER) & F.col("scene_key").isNotNull()).withColumn("o", order).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    rank = F.element_at(F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p]), F.col("type"))
    v = Window.partitionBy("doc_id", "to_key").orderBy("o", F.desc("weight"), "edge_id")
    kind = F.when(F.col("type") == "cross_chapter_causal_bridge", "causal").when(F.col("type").isin(*_PLACES), "place").otherwise("relation")
    rest = edges.where("type <> 'chapter_sequence'").withColumn("o", rank).withColumn("nth", F.row_number().over(v)).where(F.col("nth") <= most)
    rest = rest.select("doc_id", F.col("to_key").alias("scene_key"), kind.alias("claim_type"), F.col("label").alias("claim"), "nth").join(told.select("doc_id", "scene_key").distinct(), ["doc_id", "scene_key"], "left_anti")
    return units(told, "claim", "claim_id").unionByName(units(rest, "edge", "edge_id"))


def place_chain(refs: DataFrame) -> DataFrame:
    """Per scene the last two scenes before it at the same place, the one just before, and itself, each once."""
    same = Window.partitionBy("doc_id", "place").orderBy("place_no").rowsBetween(-2, -1)
    before = Window.partitionBy("doc_id").orderBy("place_no")
    chain = F.array_distinct(F.filter(F.concat(F.when(F.col("place").isNotNull(), F.collect_list("scene_key").over(same)).otherwise(F.expr("cast(array() as array<string>)")), F.array(F.lag("scene_key").over(before), "scene_key")), lambda k: k.isNotNull()))
    return refs.select("doc_id", "scene_key", chain.alias("chain"))
