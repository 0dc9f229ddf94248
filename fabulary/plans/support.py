"""Support memory of scenes, its edges, scored support units and what a reader is shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulary.functions import text as X

CH = ["doc_id", "chapter_id"]
# Per kind of unit its label, priority, intrusion, spoiler penalty, bucket and the reader's problem.
UNITS = [
    ("snapshot", "Now", 0.92, 0.45, 0.0, "visible", "state_recovery"),
    ("boundary_delta", "Shift", 0.86, 0.15, 0.0, "visible", "boundary_update"),
    ("causal_bridge", "Why", 0.90, 0.35, 0.15, "expandable", "causal_gap"),
    ("causal_bridge", "Thread", 0.62, 0.35, 0.15, "expandable", "causal_gap"),
    ("character_focus", "Cast", 0.78, 0.45, 0.0, "expandable", "character_reentry"),
    ("relation_delta", "Relation", 0.76, 0.45, 0.15, "expandable", "relation_delta"),
    ("reentry_recap", "Resume", 0.68, 0.55, 0.15, "trigger_only", "session_reentry"),
    ("reference_repair", "Names", 0.58, 0.20, 0.0, "trigger_only", "reference_ambiguity"),
    ("spatial_continuity", "Place", 0.64, 0.35, 0.0, "expandable", "spatial_disorientation"),
    ("visual_context", "Scene cues", 0.52, 0.55, 0.0, "trigger_only", "spatial_disorientation"),
]


def memory_scenes(packets: DataFrame) -> DataFrame:
    first = lambda c: F.get(c, F.lit(0))
    return packets.select(
        *CH, "scene_no", "scene_id", "start_pid", "end_pid", "previous_scene", F.col("cast_union").alias("active_cast"), first("places").alias("place"), F.slice("places", F.lit(2), F.greatest(F.size("places"), F.lit(1))).alias("mentioned"), first("time_signals").alias("time"),
        "some", "summary", "he_she", "cue",
    )


def memory_events(scenes: DataFrame, noted: DataFrame) -> DataFrame:
    """An event for every telling paragraph of a scene in which somebody cries out, with what it says it follows from."""
    loud = noted.where("narrative and action is not null").select(*CH, "pid", "action", "causal_result")
    inside = scenes.select(*CH, "scene_no", "scene_id", "start_pid", "end_pid").join(loud, CH).where(F.col("pid").between(F.col("start_pid"), F.col("end_pid")))
    n = F.row_number().over(Window.partitionBy(*CH, "scene_no").orderBy("pid"))
    return inside.withColumn("n", n).select(*CH, "scene_no", "scene_id", "pid", "n", F.concat("scene_id", F.lit(":e"), X.padded("n")).alias("event_id"), "action", "causal_result")


def edges(scenes: DataFrame, events: DataFrame) -> DataFrame:
    """Edges between neighbouring scenes: place_shift, cast_change, same_character_thread, causal_bridge."""
    w = Window.partitionBy(*CH).orderBy("scene_no")
    cause = events.where("causal_result is not null").groupBy(*CH, "scene_no").agg(F.max_by("causal_result", "n").alias("cause"))
    first = events.where("n = 1").select(*CH, "scene_no", F.col("action").alias("first_action"))
    s = scenes.join(cause, [*CH, "scene_no"], "left").join(first, [*CH, "scene_no"], "left")
    s = s.withColumns({"p_id": F.lag("scene_id").over(w), "p_place": F.lag("place").over(w), "p_cast": F.lag("active_cast").over(w), "p_cause": F.lag("cause").over(w)}).where("p_id is not null")
    came, gone, stay = X.drop("active_cast", "p_cast"), X.drop("p_cast", "active_cast"), X.keep("active_cast", "p_cast")
    changes = F.concat_ws("; ", F.when(F.size(came) > 0, F.concat(F.lit("entered: "), F.array_join(came, ", "))), F.when(F.size(gone) > 0, F.concat(F.lit("exited: "), F.array_join(gone, ", "))))
    row = lambda t, label: F.struct(F.lit(t).alias("type"), label.alias("label"))
    made = F.array(
        F.when(F.col("p_place") != F.col("place"), row("place_shift", F.concat("p_place", F.lit(" -> "), "place"))),
        F.when((F.size(came) > 0) | (F.size(gone) > 0), row("cast_change", changes)),
        F.when(F.size(stay) > 0, row("same_character_thread", F.concat(F.lit("continued cast: "), F.array_join(F.slice(stay, 1, 3), ", ")))),
        F.when(F.col("p_cause").isNotNull() & F.col("first_action").isNotNull(), row("causal_bridge", F.concat("p_cause", F.lit(" -> "), "first_action"))),
    )
    return s.select(*CH, F.col("p_id").alias("from_scene"), F.col("scene_id").alias("to_scene"), "scene_no", F.explode(F.filter(made, lambda e: e.isNotNull())).alias("e")).select(*CH, "from_scene", "to_scene", "scene_no", "e.type", "e.label")


def deltas(scenes: DataFrame, links: DataFrame) -> DataFrame:
    """What changed against the scene before; in the first scene all its cast entered."""
    w = Window.partitionBy(*CH).orderBy("scene_no")
    none = F.expr("cast(array() as array<string>)")
    types = links.groupBy(*CH, "scene_no").agg(F.count("*").alias("labels"), F.max(F.col("type") == "causal_bridge").alias("causal"), F.max(F.col("type") == "same_character_thread").alias("threaded"))
    s = scenes.withColumns({"p_place": F.lag("place").over(w), "p_time": F.lag("time").over(w), "p_cast": F.coalesce(F.lag("active_cast").over(w), none)}).join(types, [*CH, "scene_no"], "left")
    differ = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    return s.withColumns({
        "place_changed": differ("p_place", "place"), "time_changed": differ("p_time", "time"), "entered": X.drop("active_cast", "p_cast"), "exited": X.drop("p_cast", "active_cast"),
        "labels": F.coalesce("labels", F.lit(0)), "causal": F.coalesce("causal", F.lit(False)), "threaded": F.coalesce("threaded", F.lit(False)),
    })


def units(shared: DataFrame) -> DataFrame:
    """The support units a scene gives, scored: usefulness x grounding x confidence, less intrusion and spoilers."""
    cast = F.size("active_cast")
    when: list[Column] = [
        F.lit(True), F.col("labels") > 0, F.col("causal"), ~F.col("causal") & F.col("threaded"), cast > 0, cast > 1, F.col("scene_no") > 1, (cast > 0) & F.col("he_she"),
        F.col("place").isNotNull() | (F.size("mentioned") > 0), F.col("cue"),
    ]
    made = F.array(*[
        F.when(c, F.struct(F.lit(i).alias("ord"), F.lit(k).alias("kind"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(x).alias("intrusion"), F.lit(sp).alias("penalty"), F.lit(d).alias("display"), F.lit(problem).alias("problem")))
        for i, (c, (k, label, p, x, sp, d, problem)) in enumerate(zip(when, UNITS, strict=True))
    ])
    u = shared.withColumn("u", F.explode(F.filter(made, lambda x: x.isNotNull()))).select(*CH, "scene_no", "scene_id", "u.*", F.when(F.col("some"), 0.9).otherwise(0.45).alias("grounding"))
    confidence = F.greatest(F.lit(0.55), F.least(F.lit(0.96), F.col("priority") * 0.92 + F.col("grounding") * 0.08))
    u = u.withColumn("confidence", confidence)
    score = F.col("priority") * F.col("grounding") * F.col("confidence") - F.col("intrusion") * 0.35 - F.col("penalty")
    return u.withColumn("score", F.round(score, 6))


def policy(u: DataFrame, most: int = 5) -> DataFrame:
    """Units by score (ties in their order): which are suppressed and why, which selected, which deferred."""
    reason = F.when(F.col("penalty") >= 1, "spoiler_risk").when((F.col("confidence") < 0.45) | (F.col("grounding") < 0.45), "low_confidence").when(F.col("priority") < 0.35, "low_value").when(F.col("intrusion") > 0.8, "too_intrusive")
    v = u.withColumn("reason", reason)
    w = Window.partitionBy(*CH, "scene_no", F.col("reason").isNull()).orderBy(F.desc("score"), "ord")
    return v.withColumn("place", F.row_number().over(w)).withColumn("choice", F.when(F.col("reason").isNotNull(), "suppressed").when(F.col("place") <= most, "selected").otherwise("deferred"))


def verified(p: DataFrame) -> DataFrame:
    """Units that pass the verifier: of one redundancy key (kind and problem) the first in rank; the others are redundant."""
    w = Window.partitionBy(*CH, "scene_no", "kind", "problem").orderBy("place")
    return p.where("choice <> 'suppressed'").withColumn("redundant", F.row_number().over(w) > 1)


def governed(p: DataFrame, states: DataFrame) -> DataFrame:
    """Per scene and state of the reader (state, resume_gap_ms, fatigue, visual, active, signal) what the governor lets through.

    Where pictures are of no use, units of visual context are held back; people and places stand beside the picture. A reader in
    need of recovery with nothing before the text is given the first unit that recovers: of those on demand, then of those
    triggered, then of the other visible ones. states is a stated, short table.
    """
    v = verified(p).where("not redundant")
    plan = v.groupBy(*CH, "scene_no", "scene_id").agg(F.array_sort(F.collect_list(F.struct("place", "label", "kind", "display", "problem"))).alias("u"))
    held = p.where("choice = 'suppressed'").groupBy(*CH, "scene_no").agg(F.count("*").alias("base"))
    s = states.select("state", (F.col("resume_gap_ms") >= 600_000).alias("reentry"), (F.greatest(F.lit(0.0), F.least(F.lit(1.0), "fatigue")) >= 0.65).alias("tired"), "visual", "active", "signal")
    every = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in r.asDict().items()]) for r in s.orderBy("state").collect()])  # one row per state
    g = plan.join(held, [*CH, "scene_no"], "left").withColumn("s", F.explode(every)).select("*", "s.*").drop("s")
    of = lambda d, c: F.filter("u", lambda x: (x["display"] == d) & c(x))
    picture = lambda x: x["kind"] == "visual_context"
    beside = lambda x: x["kind"].isin("character_focus", "spatial_continuity") | picture(x)
    g = g.withColumns({
        "visible": of("visible", lambda x: F.lit(True)), "trigger": of("trigger_only", lambda x: F.lit(True)), "hidden": F.size(F.filter("u", lambda x: (x["display"] != "visible") & picture(x) & ~F.col("visual"))),
        "beside": of("expandable", lambda x: beside(x) & (F.col("visual") | ~picture(x))), "rest": of("expandable", lambda x: ~beside(x)),
        "fired": of("trigger_only", lambda x: (x["kind"] == "reentry_recap") & F.col("reentry") | picture(x) & F.col("visual")),
    })
    none = F.slice("visible", 1, 0)
    g = g.withColumns({"over": F.slice("visible", F.lit(2), F.greatest(F.size("visible"), F.lit(1))), "b0": F.when(F.col("active") & ~F.col("tired"), F.slice("visible", 1, 1)).otherwise(none)})
    recovers = F.slice(F.filter(F.concat("rest", "fired", "over"), lambda x: x["problem"].isin("state_recovery", "boundary_update") | x["kind"].isin("snapshot", "boundary_delta")), 1, 1)
    g = g.withColumn("before", F.when((F.size("b0") == 0) & F.col("signal") & ~F.col("tired"), recovers).otherwise(F.col("b0")))
    names = lambda c: F.transform(c, lambda x: x["label"])
    said = F.array(
        F.when(F.col("reentry"), "session_reentry"), F.when(F.col("signal"), "recovery_signal"), F.when(F.col("visual"), "visual_useful").otherwise("visual_suppressed"), F.when(F.col("tired"), "support_fatigue_high"),
        F.when((F.size("b0") == 0) & (F.size("before") > 0), "promoted_recovery_unit"),
    )
    return g.select(
        *CH, "scene_id", "state", names(F.col("before")).alias("before_text"), names(F.col("beside")).alias("beside_visual"), names(X.drop(F.concat("over", "rest", "fired"), "before")).alias("on_demand"),
        (F.size("trigger") - F.size("fired")).alias("hidden_triggers"), (F.coalesce("base", F.lit(0)) + F.col("hidden")).cast("int").alias("suppressed"), F.filter(said, lambda x: x.isNotNull()).alias("diagnostics"),
    )
