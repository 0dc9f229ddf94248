"""Queries over reader events, runs and their artifacts, overlays, selections and trials."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabulary.functions import text as X
from fabulary.queries import query
from fabulary.session import table

# ---- reader events: users stand for sessions, event types for actions


@query("select event_type, count(*) as events, count(distinct user_id) as sessions, round(sum(value), 4) as total from events group by event_type")
def a04_counts_by_action(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("sessions"), F.round(F.sum("value"), 4).alias("total"))


@query("select event_id, user_id, event_type from (select *, row_number() over (partition by event_id order by ts, user_id) as rn from events) where rn = 1 and event_type in ('view', 'click', 'error')")
def r01_unique_allowed_events(spark, sf_dir):
    """Events of allowed actions, each id once."""
    w = Window.partitionBy("event_id").orderBy("ts", "user_id")
    e = table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w))
    return e.where("rn = 1").where(F.col("event_type").isin("view", "click", "error")).select("event_id", "user_id", "event_type")


@query("select event_id, coalesce(epoch_ms(ts) - epoch_ms(lag(ts) over (partition by user_id order by ts, event_id)) >= 600000, false) as reentry from events")
def r03_reentry(spark, sf_dir):
    """Back after ten minutes or more since the session's last event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(ms(F.col("ts")) - ms(F.lag("ts").over(w)) >= 600_000, F.lit(False)).alias("reentry"))


@query("select event_id, least(1.0::double, least(20, opened) / 8.0::double) as fatigue, least(1.0::double, least(20, opened) / 8.0::double) >= 0.65 as high from (select event_id, count(*) filter (where event_type = 'click') over (partition by user_id order by ts, event_id) as opened from events)")
def r04_fatigue(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fatigue = F.least(F.lit(1.0), F.least(F.lit(20), F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).over(w)) / 8.0)
    return table(spark, sf_dir, "events").select("event_id", fatigue.alias("fatigue")).withColumn("high", F.col("fatigue") >= 0.65)


@query("with s as (select *, case when coalesce(epoch_ms(ts) - epoch_ms(lag(ts) over (partition by user_id order by ts, event_id)) >= 600000, true) then 1 else 0 end as starts from events), n as (select *, sum(starts) over (partition by user_id order by ts, event_id) as visit from s) select user_id, cast(visit as bigint) as visit, count(*) as events, min(event_id) as first_event from n group by user_id, visit")
def r03_visits(spark, sf_dir):
    """Visits of a session, cut where it was left for ten minutes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    starts = F.when(F.coalesce(ms(F.col("ts")) - ms(F.lag("ts").over(w)) >= 600_000, F.lit(True)), 1).otherwise(0)
    e = table(spark, sf_dir, "events").withColumn("starts", starts).withColumn("visit", F.sum("starts").over(w))
    return e.groupBy("user_id", "visit").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


@query("select event_id, user_id from (select * from events order by ts desc, event_id limit 200) where event_type = 'click'")
def s13_limit_then_filter(spark, sf_dir):
    """The newest 200 events first, the filter after: a report of that size."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").limit(200).where("event_type = 'click'").select("event_id", "user_id")


@query("select user_id, count(*) as events from events group by user_id order by events desc, user_id limit 36")
def t08_busiest_sessions(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "user_id").limit(36)


# ---- runs: orders stand for runs of a customer's chapter, line items for the artifacts of a run


@query("select o_custkey, o_orderkey, cast(rn as int) as place from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn <= 20")
def s08_latest_runs(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(w)).where("place <= 20").select("o_custkey", "o_orderkey", "place")


@query("select o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) as latest from orders group by o_custkey")
def s12_latest_snapshot(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query(
    "with r as (select o.o_custkey, o.o_orderkey, row_number() over (partition by o.o_custkey order by (o.o_orderstatus = 'F') desc, o.o_orderdate desc, o.o_orderkey desc) as rn from orders o where exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = 'A'))"
    " select c.c_custkey, coalesce(r.o_orderkey, -1) as chosen, case when r.o_orderkey is not null then 'ok' when exists (select 1 from orders o where o.o_custkey = c.c_custkey) then 'no artifact' else 'no run' end as reason from customer c left join r on r.o_custkey = c.c_custkey and r.rn = 1"
)
def j15_run_resolution(spark, sf_dir):
    """Per chapter the preferred run that has the artifact needed (favourites first, then the latest), or why there is none."""
    orders = table(spark, sf_dir, "orders")
    having = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc(F.col("o_orderstatus") == "F"), F.desc("o_orderdate"), F.desc("o_orderkey"))
    best = orders.join(having, "o_orderkey", "left_semi").withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("chosen"))
    some = orders.select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("some")).distinct()
    out = table(spark, sf_dir, "customer").select("c_custkey").join(best, "c_custkey", "left").join(some, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("chosen", F.lit(-1)).alias("chosen"), F.when(F.col("chosen").isNotNull(), "ok").when(F.col("some"), "no artifact").otherwise("no run").alias("reason"))


@query("select o_custkey, o_orderkey, o_orderkey = max(o_orderkey) over (partition by o_custkey) as favourite from orders")
def k10_exclusive_favourite(spark, sf_dir):
    """Marking one run (here the last) unmarks every other of its chapter."""
    chosen = F.max("o_orderkey").over(Window.partitionBy("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") == chosen).alias("favourite"))


@query(
    "select l_orderkey, stage, max_by(payload, {'p': priority, 'x': payload}) as payload from (select l_orderkey, l_linenumber as stage, concat('field:', l_partkey) as payload, 0 as priority from lineitem union all select l_orderkey, l_linenumber, concat('run:', l_suppkey), 1 from lineitem where l_linestatus = 'F' union all select l_orderkey, l_linenumber, concat('shared:', l_partkey), 2 from lineitem where l_returnflag = 'R') group by l_orderkey, stage"
)
def s11_overlaid_results(spark, sf_dir):
    """Results of a run: fields, overlaid by the run's artifacts, overlaid by shared ones."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("stage"), "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag")  # noqa: E741
    layers = F.array(
        F.struct(F.lit(0).alias("priority"), F.concat(F.lit("field:"), "l_partkey").alias("payload")), F.when(F.col("l_linestatus") == "F", F.struct(F.lit(1).alias("priority"), F.concat(F.lit("run:"), "l_suppkey").alias("payload"))),
        F.when(F.col("l_returnflag") == "R", F.struct(F.lit(2).alias("priority"), F.concat(F.lit("shared:"), "l_partkey").alias("payload"))),
    )
    return l.select("l_orderkey", "stage", F.explode(F.filter(layers, lambda x: x.isNotNull())).alias("x")).groupBy("l_orderkey", "stage").agg(F.max_by("x.payload", "x").alias("payload"))


@query("select l_orderkey, map_from_entries(list((stage, ref) order by stage)) as refs from (select l_orderkey, l_linenumber as stage, max(substr(sha256(concat_ws('|', l_partkey, l_suppkey, l_linenumber)), 1, 24)) as ref from lineitem where l_linenumber <= 3 group by all) group by l_orderkey")
def k05_fork_run(spark, sf_dir):
    """A fork takes over the references, not the payloads, of the stages that stay valid (here the first three)."""
    ref = X.short_hash(F.concat_ws("|", "l_partkey", "l_suppkey", "l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("stage"), ref.alias("ref")).groupBy("l_orderkey", "stage").agg(F.max("ref").alias("ref"))
    refs = rows.groupBy("l_orderkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "ref")))).alias("refs"))
    return refs.select("l_orderkey", F.map_filter("refs", lambda k, v: k <= 3).alias("refs")).where(F.size("refs") > 0)


@query("select l_orderkey, l_linenumber, l_partkey, l_shipdate from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc) as rn from (select l_orderkey, l_linenumber % 3 as l_linenumber, l_partkey, l_shipdate from lineitem)) where rn = 1")
def k01_upsert_latest(spark, sf_dir):
    """The current view of an append-only log: per key the row written last."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("l_linenumber"), "l_partkey", "l_shipdate")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(F.desc("l_shipdate"), F.desc("l_partkey"))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def j03_anti(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(gone, "o_orderkey", "left_anti")


# ---- overlays, selections and trials

OV = "ov as (select distinct overlay_id, doc_id, chapter_id, scene_id, character_id, label, anchor_zone, anchor_x, anchor_y, anchor_method, panel_key from overlay_characters)"
# Where in a picture the named zones lie, in per cent.
ZONES = {"left": (15.0, 52.0), "center": (50.0, 52.0), "right": (85.0, 52.0), "foreground": (50.0, 78.0), "background": (50.0, 26.0)}


def overlays(spark, sf_dir):
    return table(spark, sf_dir, "overlay_characters").select("overlay_id", "doc_id", "chapter_id", "scene_id", "character_id", "label", "anchor_zone", "anchor_x", "anchor_y", "anchor_method", "panel_key").distinct()


_ZX = "case lower(trim(anchor_zone)) " + " ".join(f"when '{z}' then {x}::double" for z, (x, _) in ZONES.items()) + " else 50.0::double end"
_ZY = "case lower(trim(anchor_zone)) " + " ".join(f"when '{z}' then {y}::double" for z, (_, y) in ZONES.items()) + " else 52.0::double end"


@query(f"with {OV} select overlay_id, coalesce(anchor_x, {_ZX}) as x, coalesce(anchor_y, {_ZY}) as y from ov")
def f24_zone_anchors(spark, sf_dir):
    zone = F.lower(F.trim("anchor_zone"))
    at = lambda i, default: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for z, p in ZONES.items() for v in (z, p[i])]), zone), F.lit(default))
    return overlays(spark, sf_dir).select("overlay_id", F.coalesce("anchor_x", at(0, 50.0)).alias("x"), F.coalesce("anchor_y", at(1, 52.0)).alias("y"))


@query(f"with {OV}, c as (select *, coalesce(anchor_x, 0) / 100 as confidence from ov) select overlay_id, case when anchor_x is not null and anchor_y is not null and confidence >= 0.45 and anchor_method is distinct from 'zone_bucket' then 'placed' when confidence >= 0.2 and coalesce(panel_key, '') <> '' then 'approximate' else 'fallback' end as visibility from c")
def p16_overlay_acceptance(spark, sf_dir):
    c = overlays(spark, sf_dir).withColumn("confidence", F.coalesce("anchor_x", F.lit(0.0)) / 100)
    sure = F.col("anchor_x").isNotNull() & F.col("anchor_y").isNotNull() & (F.col("confidence") >= 0.45) & ~F.col("anchor_method").eqNullSafe("zone_bucket")
    return c.select("overlay_id", F.when(sure, "placed").when((F.col("confidence") >= 0.2) & (F.coalesce("panel_key", F.lit("")) != ""), "approximate").otherwise("fallback").alias("visibility"))


@query(f"with {OV} select doc_id, chapter_id, scene_id, name, min(overlay_id) as overlay_id from (select *, lower(trim(label)) as name from ov) where name <> '' group by all")
def d11_first_overlay_by_name(spark, sf_dir):
    return overlays(spark, sf_dir).withColumn("name", F.lower(F.trim("label"))).where("name <> ''").groupBy("doc_id", "chapter_id", "scene_id", "name").agg(F.min("overlay_id").alias("overlay_id"))


@query(f"with {OV} select distinct a.doc_id, a.chapter_id, a.scene_id, concat(least(a.character_id, b.character_id), '__', greatest(a.character_id, b.character_id)) as pair from ov a join ov b on a.doc_id = b.doc_id and a.chapter_id = b.chapter_id and a.scene_id = b.scene_id and a.character_id < b.character_id")
def f28_character_pairs(spark, sf_dir):
    """Keys of the pairs of characters that a scene shows together."""
    o = overlays(spark, sf_dir).select("doc_id", "chapter_id", "scene_id", "character_id").distinct()
    pair = o.alias("a").join(o.alias("b"), ["doc_id", "chapter_id", "scene_id"]).where("a.character_id < b.character_id")
    return pair.select("doc_id", "chapter_id", "scene_id", F.array_join(F.array_sort(F.array("a.character_id", "b.character_id")), "__").alias("pair")).distinct()


@query(f"with {OV}, c as (select distinct doc_id, chapter_id, cluster_id, cluster_name from mention_clusters where mention_type = 'cast' and cluster_name <> '') select o.overlay_id, min(c.cluster_id) as cluster_id from ov o join c on c.doc_id = o.doc_id and c.chapter_id = o.chapter_id and (contains(lower(o.label), c.cluster_name) or contains(c.cluster_name, lower(o.label))) where o.label <> '' group by o.overlay_id")
def j10_fuzzy_names(spark, sf_dir):
    """The first cluster of the chapter whose name holds the label or is held by it."""
    c = table(spark, sf_dir, "mention_clusters").where("mention_type = 'cast' and cluster_name <> ''").select("doc_id", "chapter_id", "cluster_id", "cluster_name").distinct()
    o = overlays(spark, sf_dir).where("label <> ''").select("doc_id", "chapter_id", "overlay_id", F.lower("label").alias("l"))
    return o.join(c, ["doc_id", "chapter_id"]).where(F.contains("l", "cluster_name") | F.contains("cluster_name", "l")).groupBy("overlay_id").agg(F.min("cluster_id").alias("cluster_id"))


@query("select doc_id, character_id, list(distinct lower(label) order by lower(label)) as labels, count(distinct scene_id) as scenes from overlay_characters where label is not null group by all")
def a12_labels_by_position(spark, sf_dir):
    o = table(spark, sf_dir, "overlay_characters").where("label is not null")
    return o.groupBy("doc_id", "character_id").agg(F.array_sort(F.collect_set(F.lower("label"))).alias("labels"), F.count_distinct("scene_id").alias("scenes"))


SEL = "sel as (select distinct selection_id, selected_text, paragraph_text from anchored_selections where selected_text is not null)"


@query(f"with {SEL} select selection_id, case when length(s) = 0 then 'none' when length(s) >= 220 or length(s) >= 0.65 * length(p) then 'paragraph' when length(s) <= 18 and not contains(s, ' ') then 'word' when length(s) >= 45 then 'sentence' else 'phrase' end as granularity from (select selection_id, trim(selected_text) as s, coalesce(paragraph_text, '') as p from sel)")
def f18_selection_granularity(spark, sf_dir):
    s, n = F.trim("selected_text"), F.length(F.trim("selected_text"))
    whole = F.length(F.coalesce("paragraph_text", F.lit("")))
    kind = F.when(n == 0, "none").when((n >= 220) | (n >= 0.65 * whole), "paragraph").when((n <= 18) & ~F.contains(s, F.lit(" ")), "word").when(n >= 45, "sentence").otherwise("phrase")
    return table(spark, sf_dir, "anchored_selections").where("selected_text is not null").select("selection_id", "selected_text", "paragraph_text").distinct().select("selection_id", kind.alias("granularity"))


@query(f"with {SEL} select selection_id, case when paragraph_text is null then false else (length(selected_text) >= 4 and contains(paragraph_text, selected_text)) or (length(paragraph_text) >= 18 and contains(selected_text, paragraph_text)) or (length(selected_text) >= 24 and contains(paragraph_text, substr(selected_text, 1, 80))) end as matches, case when contains(paragraph_text, selected_text) then strpos(paragraph_text, selected_text) - 1 end as start_char from sel")
def c18_text_matches_paragraph(spark, sf_dir):
    t, p = F.col("selected_text"), F.col("paragraph_text")
    hit = (F.length(t) >= 4) & F.contains(p, t) | (F.length(p) >= 18) & F.contains(t, p) | (F.length(t) >= 24) & F.contains(p, F.substring(t, 1, 80))
    s = table(spark, sf_dir, "anchored_selections").where("selected_text is not null").select("selection_id", "selected_text", "paragraph_text").distinct()
    return s.select("selection_id", F.when(p.isNull(), F.lit(False)).otherwise(hit).alias("matches"), F.when(F.contains(p, t), F.instr(p, t) - 1).cast("long").alias("start_char"))


@query("select stage_id, call_mode, model, count(*) as calls, cast(count(*) filter (where raw_response is null) as bigint) as unanswered, cast(max(length(prompt)) as bigint) as longest_prompt from (select distinct * from llm_trials) group by all")
def a04_trials_by_stage(spark, sf_dir):
    t = table(spark, sf_dir, "llm_trials").distinct()
    return t.groupBy("stage_id", "call_mode", "model").agg(F.count("*").alias("calls"), F.count_if(F.col("raw_response").isNull()).alias("unanswered"), F.max(F.length("prompt")).cast("long").alias("longest_prompt"))


@query("select trial_key, template_name, concat('Stage ', stage_id, ' by ', model, ' of {unknown}') as rendered from (select distinct trial_key, template_name, stage_id, model from llm_trials)")
def s16_render_template(spark, sf_dir):
    """Named places of a template filled in; names without a value stay as they are."""
    t = table(spark, sf_dir, "llm_trials").select("trial_key", "template_name", "stage_id", "model").distinct()
    out = F.lit("Stage {stage} by {model} of {unknown}")
    for name, value in (("{stage}", "stage_id"), ("{model}", "model")):
        out = F.replace(out, F.lit(name), F.col(value))
    return t.select("trial_key", "template_name", out.alias("rendered"))


@query()
def f19_json_responses(spark, sf_dir):
    """How every response reads as JSON: as it is, after its fence is stripped, its first whole object, after repair, or not."""
    from fabulary.functions.jsontext import reading

    t = table(spark, sf_dir, "llm_trials").where("call_mode = 'json' and raw_response is not null").select("trial_key", "raw_response").distinct()
    return t.select("trial_key", reading(F.col("raw_response")).alias("r")).select("trial_key", "r.*")


@query(r"select p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9가-힣]+', '_', 'g'), '^_+|_+$', '', 'g') as key, substr(regexp_replace(concat(p_name, ' ', p_type), '[^a-zA-Z0-9:_-]', '_', 'g'), 1, 96) as safe from part")
def f04_keys_and_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.key("p_name").alias("key"), X.safe_id(F.concat("p_name", F.lit(" "), "p_type"), 96).alias("safe"))


@query("select c_custkey, case when c_acctbal is null or isnan(c_acctbal) then 0 else greatest(0::double, least(1::double, c_acctbal / 10000)) end as score from customer")
def f22_bounded_scores(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.bounded(F.col("c_acctbal") / 10000).alias("score"))
