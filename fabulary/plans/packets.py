"""Reader packets: overlay characters from all sources, chips, how useful a picture is, and anchors of support in a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CH = ["doc_id", "chapter_id"]
# Where a character stands in the picture by its zone (percent from the left and the top); elsewhere the middle.
ZONES = {
    "foreground left": (15.0, 78.0), "foreground center": (50.0, 78.0), "foreground right": (85.0, 78.0), "midground left": (15.0, 52.0), "midground center": (50.0, 52.0), "midground right": (85.0, 52.0),
    "background left": (15.0, 26.0), "background center": (50.0, 26.0), "background right": (85.0, 26.0),
}
MIDDLE = "midground center"
# Wording about space, and about talk and thought.
SPATIAL_TERMS = ["place", "room", "door", "window", "street", "garden", "forest", "road", "path", "corridor", "hall", "stairs", "inside", "outside", "left", "right", "behind", "under", "above", "across", "toward", "through", "enter", "leave", "move", "run", "follow", "hide", "search", "look", "find"]
LOW_TERMS = ["think", "thought", "remember", "feel", "felt", "wonder", "said", "asked", "answered"]


def overlay(sources: DataFrame) -> DataFrame:
    """sources: doc_id, chapter_id, scene_id, label, zone, rank (0 the blueprint, 1 who is on stage, 2 the scene's cast), nth.

    Each label of a scene once, from the source of least rank, in order; its place by its zone.
    """
    w = Window.partitionBy(*CH, "scene_id", "label").orderBy("rank", "nth")
    first = sources.where("label is not null").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    zone = F.lower(F.trim("zone"))
    known = F.when(zone.isin(*ZONES), zone).otherwise(F.lit(MIDDLE))
    at = lambda i: F.element_at(F.create_map(*[F.lit(x) for z, p in ZONES.items() for x in (z, p[i])]), F.col("anchor_zone"))
    ident = F.concat(F.lit("char_"), F.regexp_replace(F.lower("label"), r"\s+", "_"))
    out = first.select(*CH, "scene_id", "label", "rank", "nth", F.when(F.col("rank") == 0, known).otherwise(F.lit(MIDDLE)).alias("anchor_zone"), ident.alias("character_id"))
    return out.withColumns({"anchor_x": at(0), "anchor_y": at(1), "panel_key": F.concat(F.lit("panel_"), "character_id")})


def reader_packets(scenes: DataFrame, shown: DataFrame) -> DataFrame:
    """scenes: memory scenes; shown: as of overlay. Every scene comes out, whatever of its inputs is missing."""
    order = F.array_sort(F.collect_list(F.struct("rank", "nth", "label")))
    people = shown.groupBy(*CH, "scene_id").agg(F.transform(order, lambda x: x["label"]).alias("overlay"), F.max(F.col("rank") == 0).alias("blueprint"))
    chips = F.slice(F.filter(F.concat("mentioned", F.array("place")), lambda c: c.isNotNull()), 1, 4)
    none = F.expr("cast(array() as array<string>)")
    return scenes.join(people, [*CH, "scene_id"], "left").select(*CH, "scene_id", "place", "summary", F.coalesce("overlay", none).alias("overlay"), chips.alias("chips"), F.coalesce("blueprint", F.lit(False)).alias("blueprint"))


def visual_support(packets: DataFrame, units: DataFrame) -> DataFrame:
    """How useful a picture of a scene is, what it is for, and whether its blueprint is shown without asking.

    packets: as of reader_packets, without an image; units: doc_id, chapter_id, scene_id, kind, label.
    """
    held = units.groupBy(*CH, "scene_id").agg(F.max(F.col("kind") == "spatial_continuity").alias("spatial"), F.max(F.col("kind") == "visual_context").alias("visual"), F.array_join(F.array_sort(F.collect_set("label")), " ").alias("labels"))
    text = F.lower(F.concat_ws(" ", "summary", F.array_join("chips", " "), "labels"))
    hits = lambda terms: sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))
    p = packets.join(held, [*CH, "scene_id"], "left").withColumns({"spatial": F.coalesce("spatial", F.lit(False)), "visual": F.coalesce("visual", F.lit(False)), "space": hits(SPATIAL_TERMS), "talk": hits(LOW_TERMS)})
    many = F.size("overlay") >= 2
    add = lambda c, v: F.when(c, v).otherwise(0.0)
    score = (
        F.lit(0.12) + add(F.col("blueprint"), 0.1) + F.least(F.lit(0.16), F.size("chips") * 0.04) + add(many, 0.1) + add(F.col("spatial"), 0.2) + add(F.col("visual"), 0.18)
        + F.least(F.lit(0.22), F.col("space") * 0.04) - add(F.col("talk") > F.col("space"), 0.14)
    )
    reason = lambda c, name: F.when(c, F.lit(name))
    reasons = F.array(
        reason(F.col("blueprint"), "blueprint_available"), reason(F.size("chips") > 0, "visual_chips"), reason(many, "multiple_character_anchors"), reason(F.col("spatial"), "spatial_support_available"), reason(F.col("visual"), "visual_context_support_available"),
        reason(F.col("space") > 0, "spatial_language"), reason(F.col("talk") > F.col("space"), "dialogue_or_internal_focus"),
    )
    out = p.withColumn("usefulness", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))
    role = F.when(F.col("spatial") | F.col("visual"), "spatial_model").when(many, "character_anchor").when(F.size("chips") > 0, "atmosphere").otherwise("low_value")
    show = F.col("blueprint") & (F.col("usefulness") >= 0.4)
    return out.select(*CH, "scene_id", "usefulness", role.alias("role"), show.alias("show_blueprint"), F.when(~show, F.when(F.col("blueprint"), "visual_low").otherwise("unsupported")).alias("suppressed"), F.filter(reasons, lambda r: r.isNotNull()).alias("reasons"))


def text_range(candidate: str | Column, text: str | Column) -> tuple[Column, Column]:
    """start, end of a candidate in a text: where it stands exactly, else where it stands but for letter case and kinds of white space; null if nowhere."""
    c, t = F.trim(F.col(candidate) if isinstance(candidate, str) else candidate), F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(c, r"[\s\p{Z}]+"), lambda w: w != "")
    quoted = F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), r"[\s\p{Z}]+")
    loose = F.regexp_substr(t, F.concat(F.lit("(?iu)"), quoted))
    exact = F.contains(t, c)
    found = F.when(c == "", F.lit(None)).when(exact, c).otherwise(F.nullif(loose, F.lit("")))
    start = F.instr(t, found) - 1
    return start.alias("start"), (start + F.length(found)).alias("end")


def segments(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """anchors: keys, start, end, unit. The stretches between neighbouring ends of anchors with all units that cover them; equal neighbours made one.

    Out: keys, start, end, units. Anchors without extent take no part. The anchors of one paragraph are few, and its stretches are laid out in one pass.
    """
    real = anchors.where("start is not null and end > start").select(*keys, "start", "end", "unit").distinct()
    g = real.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "unit"))).alias("a"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("start", "end"))))).alias("cuts"))
    pieces = g.select(*keys, "a", F.posexplode(F.transform(F.slice("cuts", F.lit(1), F.size("cuts") - 1), lambda c, i: F.struct(c.alias("start"), F.element_at("cuts", i + 2).alias("end")))).alias("i", "s"))
    covered = F.array_sort(F.array_distinct(F.transform(F.filter("a", lambda x: (x["start"] <= F.col("s.start")) & (x["end"] >= F.col("s.end"))), lambda x: x["unit"])))
    held = pieces.select(*keys, "s.start", "s.end", covered.alias("units")).where("size(units) > 0")
    w = Window.partitionBy(*keys).orderBy("start")
    new = F.coalesce((F.lag("end").over(w) != F.col("start")) | (F.lag("units").over(w) != F.col("units")), F.lit(True)).cast("int")
    run = held.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return run.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("units").alias("units")).drop("run")


def stage_fields(scenes: DataFrame) -> DataFrame:
    """What a stage is set up with: indoors, outdoors or both by its wording, its archetype and the key of its place."""
    said = F.lower(F.concat_ws(" ", "place", F.array_join("mentioned", " "), "summary"))
    inside, outside = said.rlike("indoor|room|hall|house|inside|interior"), said.rlike("outdoor|street|forest|field|garden|outside|exterior")
    first = F.coalesce("place", F.get("mentioned", F.lit(0)))
    slug = F.nullif(F.regexp_replace(F.regexp_replace(F.lower(first), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(""))
    kind = F.when(F.contains(said, F.lit("forest")), "forest").when(F.contains(said, F.lit("street")), "street").when(F.contains(said, F.lit("room")), "room").otherwise("generic_space")
    return scenes.select(
        *CH, "scene_id", F.when(inside & outside, "mixed").when(outside, "outdoor").otherwise("indoor").alias("environment_type"), F.when(first.isNotNull(), F.coalesce(slug, F.lit("generic_space"))).otherwise(kind).alias("stage_archetype"), F.coalesce(first, F.lit("unknown_place")).alias("place_key"),
    )
