"""Queries over support memory, units, policy and the governor."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabulary.plans import scenes as S
from fabulary.plans import support as P
from fabulary.plans.packets import LOW_TERMS, SPATIAL_TERMS
from fabulary.queries import query
from fabulary.queries.story import PACKETS, Chapter, upto
from fabulary.session import cut

CH = P.CH
MEM = ", ms as (select doc_id, chapter_id, scene_no, scene_id, start_pid, end_pid, previous_scene, cast_union as active_cast, places[1] as place, places[2:] as mentioned, time_signals[1] as time, regexp_extract(first_text, '" + S.FIRST_SENTENCE + "', 1) as summary, first_text from pk)"
EV = (
    ", ev0 as (select s.doc_id, s.chapter_id, s.scene_no, s.scene_id, p.pid, p.text, row_number() over (partition by s.doc_id, s.chapter_id, s.scene_no order by p.pid) as n from ms s join fr f on f.doc_id = s.doc_id and f.chapter_id = s.chapter_id and f.narrative and f.pid between s.start_pid and s.end_pid join para p on p.doc_id = f.doc_id and p.chapter_id = f.chapter_id and p.pid = f.pid where contains(p.text, '!')),"
    f" ev as (select doc_id, chapter_id, scene_no, scene_id, pid, n, concat(scene_id, ':e', lpad(cast(n as varchar), cast(greatest(2, length(cast(n as varchar))) as int), '0')) as event_id, trim(concat(regexp_replace(split_part(text, '!', 1), '{S.BEFORE_LOUD}', ''), '!')) as action, nullif(regexp_extract(text, '{S.RESULT}', 1), '') as causal_result from ev0)"
)
EDGES = (
    ", e0 as (select s.*, c.cause, f.action as first_action from ms s left join (select doc_id, chapter_id, scene_no, max_by(causal_result, n) as cause from ev where causal_result is not null group by all) c using (doc_id, chapter_id, scene_no) left join (select doc_id, chapter_id, scene_no, action from ev where n = 1) f using (doc_id, chapter_id, scene_no)),"
    " e1 as (select *, lag(scene_id) over w as p_id, lag(place) over w as p_place, lag(active_cast) over w as p_cast, lag(cause) over w as p_cause from e0 window w as (partition by doc_id, chapter_id order by scene_no)),"
    " e2 as (select *, list_filter(active_cast, lambda x: not list_contains(p_cast, x)) as came, list_filter(p_cast, lambda x: not list_contains(active_cast, x)) as gone, list_filter(active_cast, lambda x: list_contains(p_cast, x)) as stay from e1 where p_id is not null),"
    " ed as (select doc_id, chapter_id, p_id as from_scene, scene_id as to_scene, scene_no, 'place_shift' as type, concat(p_place, ' -> ', place) as label from e2 where p_place <> place"
    " union all select doc_id, chapter_id, p_id, scene_id, scene_no, 'cast_change', concat_ws('; ', case when len(came) > 0 then concat('entered: ', array_to_string(came, ', ')) end, case when len(gone) > 0 then concat('exited: ', array_to_string(gone, ', ')) end) from e2 where len(came) > 0 or len(gone) > 0"
    " union all select doc_id, chapter_id, p_id, scene_id, scene_no, 'same_character_thread', concat('continued cast: ', array_to_string(stay[1:3], ', ')) from e2 where len(stay) > 0"
    " union all select doc_id, chapter_id, p_id, scene_id, scene_no, 'causal_bridge', concat(p_cause, ' -> ', first_action) from e2 where p_cause is not null and first_action is not null)"
)
DELTAS = (
    ", d0 as (select *, lag(place) over w as p_place, lag(time) over w as p_time, coalesce(lag(active_cast) over w, []) as p_cast from ms window w as (partition by doc_id, chapter_id order by scene_no)),"
    " dl as (select d.*, coalesce(p_place <> place, false) as place_changed, coalesce(p_time <> time, false) as time_changed, list_filter(active_cast, lambda x: not list_contains(p_cast, x)) as entered, list_filter(p_cast, lambda x: not list_contains(active_cast, x)) as exited, coalesce(t.labels, 0) as labels, coalesce(t.causal, false) as causal, coalesce(t.threaded, false) as threaded"
    " from d0 d left join (select doc_id, chapter_id, scene_no, count(*) as labels, bool_or(type = 'causal_bridge') as causal, bool_or(type = 'same_character_thread') as threaded from ed group by all) t using (doc_id, chapter_id, scene_no))"
)
_WHEN = [
    "true", "labels > 0", "causal", "not causal and threaded", "len(active_cast) > 0", "len(active_cast) > 1", "scene_no > 1", f"len(active_cast) > 0 and regexp_matches(lower(coalesce(first_text, '')), '{S.HE_SHE}')",
    "place is not null or len(mentioned) > 0", f"regexp_matches(lower(coalesce(first_text, '')), '{S.CUE}')",
]
UNITS = (
    ", u0 as ("
    + " union all ".join(
        f"select doc_id, chapter_id, scene_no, scene_id, first_text, {i} as ord, '{k}' as kind, '{label}' as label, {p}::double as priority, {x}::double as intrusion, {sp}::double as penalty, '{d}' as display, '{pr}' as problem from dl where {c}"
        for i, (c, (k, label, p, x, sp, d, pr)) in enumerate(zip(_WHEN, P.UNITS, strict=True))
    )
    + "), u1 as (select *, case when coalesce(first_text, '') <> '' then 0.9::double else 0.45::double end as grounding from u0), u2 as (select *, greatest(0.55::double, least(0.96::double, priority * 0.92::double + grounding * 0.08::double)) as confidence from u1),"
    " un as (select * exclude (first_text), round(priority * grounding * confidence - intrusion * 0.35::double - penalty, 6) as score from u2)"
)
POLICY = (
    ", p0 as (select *, case when penalty >= 1 then 'spoiler_risk' when confidence < 0.45 or grounding < 0.45 then 'low_confidence' when priority < 0.35 then 'low_value' when intrusion > 0.8 then 'too_intrusive' end as reason from un),"
    " po as (select *, case when reason is not null then 'suppressed' when place <= 5 then 'selected' else 'deferred' end as choice from (select *, cast(row_number() over (partition by doc_id, chapter_id, scene_no, reason is null order by score desc, ord) as int) as place from p0)),"
    " vf as (select *, row_number() over (partition by doc_id, chapter_id, scene_no, kind, problem order by place) > 1 as redundant from po where choice <> 'suppressed')"
)
ALL = MEM + EV + EDGES + DELTAS + UNITS + POLICY


def sql(select: str, more: str = ALL) -> str:
    return upto(PACKETS, select, more)


class Support(Chapter):
    def memory(self):
        scenes = cut(P.memory_scenes(self.packets()))
        return scenes, P.memory_events(scenes, self.notes)

    def shared(self):
        scenes, events = self.memory()
        return P.deltas(scenes, P.edges(scenes, events))

    def policy(self):
        return P.policy(P.units(self.shared()))


@query(sql("select doc_id, chapter_id, scene_id, place, mentioned, time, active_cast, summary from ms", MEM))
def sup0_memory_scenes(spark, sf_dir):
    return Support(spark, sf_dir).memory()[0].select(*CH, "scene_id", "place", "mentioned", "time", "active_cast", "summary")


@query(sql("select doc_id, chapter_id, event_id, pid, action, causal_result from ev", MEM + EV))
def sup0_memory_events(spark, sf_dir):
    return Support(spark, sf_dir).memory()[1].select(*CH, "event_id", "pid", "action", "causal_result")


@query(sql("select doc_id, chapter_id, from_scene, to_scene, type, label from ed", MEM + EV + EDGES))
def g08_scene_edges(spark, sf_dir):
    return P.edges(*Support(spark, sf_dir).memory()).drop("scene_no")


@query(sql("select doc_id, chapter_id, scene_id, place_changed, time_changed, entered, exited, cast(labels as bigint) as labels from dl", MEM + EV + EDGES + DELTAS))
def w09_boundary_deltas(spark, sf_dir):
    return Support(spark, sf_dir).shared().select(*CH, "scene_id", "place_changed", "time_changed", "entered", "exited", F.col("labels").cast("long").alias("labels"))


@query(sql("select doc_id, chapter_id, scene_id, kind, label, priority, grounding, round(confidence, 6) as confidence, score from un", MEM + EV + EDGES + DELTAS + UNITS))
def u_support_units(spark, sf_dir):
    return P.units(Support(spark, sf_dir).shared()).select(*CH, "scene_id", "kind", "label", "priority", "grounding", F.round("confidence", 6).alias("confidence"), "score")


@query(sql("select doc_id, chapter_id, scene_id, label, choice, place from po where choice <> 'deferred'"))
def t04_policy_top5(spark, sf_dir):
    return Support(spark, sf_dir).policy().where("choice <> 'deferred'").select(*CH, "scene_id", "label", "choice", "place")


@query(sql("select doc_id, chapter_id, scene_id, display, list(label order by place) filter (where not redundant) as labels, cast(count(*) filter (where redundant) as bigint) as redundant from vf group by all"))
def e13_verify_plan(spark, sf_dir):
    v = P.verified(Support(spark, sf_dir).policy())
    kept = F.transform(F.array_sort(F.collect_list(F.when(~F.col("redundant"), F.struct("place", "label")))), lambda x: x["label"])
    return v.groupBy(*CH, "scene_id", "display").agg(F.when(F.size(kept) > 0, kept).alias("labels"), F.count_if("redundant").alias("redundant"))


_L = "list_transform(list_filter(u, lambda x: {c}), lambda x: x.label)"


@query(
    sql(
        "select doc_id, chapter_id, scene_id, v[1:1] as before_text, b as beside_visual, list_filter(list_concat(list_concat(v[2:], r), f), lambda x: not list_contains(v[1:1], x)) as on_demand, cast(len(t) - len(f) as int) as hidden_triggers from (select doc_id, chapter_id, scene_id, "
        + _L.format(c="x.display = 'visible'") + " as v, " + _L.format(c="x.display = 'expandable' and x.kind in ('character_focus', 'spatial_continuity')") + " as b, " + _L.format(c="x.display = 'expandable' and x.kind not in ('character_focus', 'spatial_continuity')") + " as r, "
        + _L.format(c="x.display = 'trigger_only' and x.kind in ('reentry_recap', 'visual_context')") + " as f, " + _L.format(c="x.display = 'trigger_only'")
        + " as t from (select doc_id, chapter_id, scene_no, scene_id, list({'label': label, 'kind': kind, 'display': display} order by place) as u from vf where not redundant group by all))"
    )
)
def e15_governor(spark, sf_dir):
    """What a reader who comes back after ten minutes and is not tired is shown."""
    state = spark.createDataFrame([(0, 600_000, 0.2, True, True, False)], "state int, resume_gap_ms long, fatigue double, visual boolean, active boolean, signal boolean")
    return P.governed(Support(spark, sf_dir).policy(), state).select(*CH, "scene_id", "before_text", "beside_visual", "on_demand", "hidden_triggers")


@query(sql("select kind, count(*) as units, round(avg(score), 4) as mean_score, round(min(score), 6) as least from un group by kind", MEM + EV + EDGES + DELTAS + UNITS))
def a06_unit_totals(spark, sf_dir):
    return P.units(Support(spark, sf_dir).shared()).groupBy("kind").agg(F.count("*").alias("units"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.min("score"), 6).alias("least"))


@query(
    sql(
        "select doc_id, chapter_id, count(*) as scenes, cast(count(*) filter (where place is not null) as bigint) as placed, list_filter([case when count(*) filter (where place is not null) = 0 then 'no place known' end, case when max(len(active_cast)) = 0 then 'no cast known' end, case when count(*) = 1 then 'single scene' end], lambda x: x is not null) as advice from ms group by doc_id, chapter_id",
        MEM,
    )
)
def a14_readiness(spark, sf_dir):
    scenes, _ = Support(spark, sf_dir).memory()
    per = scenes.groupBy(*CH).agg(F.count("*").alias("scenes"), F.count("place").alias("placed"), F.max(F.size("active_cast")).alias("cast"))
    advice = F.array(F.when(F.col("placed") == 0, "no place known"), F.when(F.col("cast") == 0, "no cast known"), F.when(F.col("scenes") == 1, "single scene"))
    return per.select(*CH, "scenes", "placed", F.filter(advice, lambda x: x.isNotNull()).alias("advice"))


_SPATIAL_TERMS, _LOW_TERMS = SPATIAL_TERMS, LOW_TERMS


@query(
    sql(
        f"select doc_id, chapter_id, scene_id, cast(sp as int) as spatial_terms, cast(lo as int) as low_terms, round(greatest(0::double, least(1::double, 0.12::double + case when place is not null then 0.2::double else 0 end + case when len(active_cast) >= 2 then 0.1::double else 0 end + case when sp > 0 then least(0.22::double, sp * 0.04::double) else 0 end - case when lo > sp then 0.14::double else 0 end)), 6) as usefulness from (select *, len(list_filter({_SPATIAL_TERMS}, lambda t: contains(lower(summary), t))) as sp, len(list_filter({_LOW_TERMS}, lambda t: contains(lower(summary), t))) as lo from (select * replace (coalesce(summary, '') as summary) from ms))",
        MEM,
    )
)
def c15_visual_policy(spark, sf_dir):
    """How useful a picture would be: places and people help, wording about space helps, talk and thought do not."""
    scenes, _ = Support(spark, sf_dir).memory()
    low = F.lower(F.coalesce("summary", F.lit("")))
    hits = lambda terms: sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
    s = scenes.withColumns({"spatial_terms": hits(_SPATIAL_TERMS), "low_terms": hits(_LOW_TERMS)})
    score = (
        F.lit(0.12) + F.when(F.col("place").isNotNull(), 0.2).otherwise(0.0) + F.when(F.size("active_cast") >= 2, 0.1).otherwise(0.0) + F.when(F.col("spatial_terms") > 0, F.least(F.lit(0.22), F.col("spatial_terms") * 0.04)).otherwise(0.0)
        - F.when(F.col("low_terms") > F.col("spatial_terms"), 0.14).otherwise(0.0)
    )
    return s.select(*CH, "scene_id", "spatial_terms", "low_terms", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("usefulness"))
