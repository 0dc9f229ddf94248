"""Queries over reader packets, picture policy, and anchors of support in a text."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabulary.plans import packets as V
from fabulary.plans import support as P
from fabulary.queries import book as Q
from fabulary.queries import query
from fabulary.queries import reader as R
from fabulary.queries.story import Chapter, RULES, upto
from fabulary.session import table

CH = V.CH
_ZONE = "case when lower(trim(zone)) in (" + ", ".join(f"'{z}'" for z in V.ZONES) + f") and rank = 0 then lower(trim(zone)) else '{V.MIDDLE}' end"
_AT = lambda i: "case anchor_zone " + " ".join(f"when '{z}' then {p[i]}::double" for z, p in V.ZONES.items()) + " end"
OVERLAY = (
    ", nm2 as (select doc_id, chapter_id, " + Q._EID.format(o="ord") + " as eid, min(plain) as name from occ group by all),"
    " src as (select distinct doc_id, chapter_id, scene_id, label, anchor_zone as zone, 0 as rank, cast(overlay_id as bigint) as nth from overlay_characters union all"
    " select m.doc_id, m.chapter_id, m.scene_id, n.name, null, 2, cast(i as bigint) from (select *, unnest(active_cast) as eid, unnest(range(len(active_cast))) as i from ms) m join nm2 n on n.doc_id = m.doc_id and n.chapter_id = m.chapter_id and n.eid = m.eid),"
    f" ov as (select doc_id, chapter_id, scene_id, label, rank, nth, {_ZONE} as anchor_zone, concat('char_', regexp_replace(lower(label), '\\s+', '_', 'g')) as character_id from (select *, row_number() over (partition by doc_id, chapter_id, scene_id, label order by rank, nth) as n from src where label is not null) where n = 1),"
    " rp0 as (select m.doc_id, m.chapter_id, m.scene_id, m.place, m.summary, coalesce(o.overlay, []) as overlay, list_filter(list_concat(m.mentioned, [m.place]), lambda c: c is not null)[1:4] as chips, coalesce(o.blueprint, false) as blueprint from ms m left join (select doc_id, chapter_id, scene_id, list(label order by rank, nth, label) as overlay, bool_or(rank = 0) as blueprint from ov group by all) o on o.doc_id = m.doc_id and o.chapter_id = m.chapter_id and o.scene_id = m.scene_id)"
)


def _overlay(s: R.Support, spark, sf_dir, scenes):
    from fabulary.plans.scenes import entity_id

    drawn = table(spark, sf_dir, "overlay_characters").select(*CH, "scene_id", "label", F.col("anchor_zone").alias("zone"), F.lit(0).alias("rank"), F.col("overlay_id").alias("nth")).distinct()
    names = s.said.groupBy(*CH, "ord").agg(F.min("plain").alias("label")).select(*CH, entity_id().alias("eid"), "label")
    cast = scenes.select(*CH, "scene_id", F.posexplode("active_cast").alias("i", "eid")).join(names, [*CH, "eid"]).select(*CH, "scene_id", "label", F.lit(None).cast("string").alias("zone"), F.lit(2).alias("rank"), F.col("i").cast("long").alias("nth"))
    return V.overlay(drawn.unionByName(cast))


@query(R.sql(f"select doc_id, chapter_id, scene_id, label, character_id, anchor_zone, {_AT(0)} as anchor_x, {_AT(1)} as anchor_y, concat('panel_', character_id) as panel_key from ov", R.MEM + OVERLAY))
def p15_overlay_characters(spark, sf_dir):
    """Who stands in a scene's picture: from its blueprint first, then from its cast, each name once."""
    s = R.Support(spark, sf_dir)
    return _overlay(s, spark, sf_dir, s.memory()[0]).drop("rank", "nth")


@query(R.sql("select doc_id, chapter_id, scene_id, case when blueprint then 'blueprint' else 'none' end as mode, place, overlay, chips from rp0", R.MEM + OVERLAY))
def p15_reader_packets(spark, sf_dir):
    """A scene's packet; overlays that are missing leave it whole."""
    s = R.Support(spark, sf_dir)
    scenes = s.memory()[0]
    return V.reader_packets(scenes, _overlay(s, spark, sf_dir, scenes)).select(*CH, "scene_id", F.when(F.col("blueprint"), "blueprint").otherwise("none").alias("mode"), "place", "overlay", "chips")


_HITS = lambda terms: f"len(list_filter({terms}, lambda t: contains(low, t)))"


@query(
    R.sql(
        "select doc_id, chapter_id, scene_id, usefulness, case when spatial or visual then 'spatial_model' when len(overlay) >= 2 then 'character_anchor' when len(chips) > 0 then 'atmosphere' else 'low_value' end as role, blueprint and usefulness >= 0.4 as show_blueprint, case when not (blueprint and usefulness >= 0.4) then case when blueprint then 'visual_low' else 'unsupported' end end as suppressed,"
        " list_filter([case when blueprint then 'blueprint_available' end, case when len(chips) > 0 then 'visual_chips' end, case when len(overlay) >= 2 then 'multiple_character_anchors' end, case when spatial then 'spatial_support_available' end, case when visual then 'visual_context_support_available' end, case when sp > 0 then 'spatial_language' end, case when lo > sp then 'dialogue_or_internal_focus' end], lambda x: x is not null) as reasons from vs2",
        R.MEM + R.EV + R.EDGES + R.DELTAS + R.UNITS + OVERLAY
        + ", vs0 as (select p.*, coalesce(u.spatial, false) as spatial, coalesce(u.visual, false) as visual, lower(concat_ws(' ', p.summary, array_to_string(p.chips, ' '), u.labels)) as low from rp0 p left join (select doc_id, chapter_id, scene_id, bool_or(kind = 'spatial_continuity') as spatial, bool_or(kind = 'visual_context') as visual, array_to_string(list(distinct label order by label), ' ') as labels from un group by all) u on u.doc_id = p.doc_id and u.chapter_id = p.chapter_id and u.scene_id = p.scene_id),"
        f" vs1 as (select *, {_HITS(V.SPATIAL_TERMS)} as sp, {_HITS(V.LOW_TERMS)} as lo from vs0),"
        " vs2 as (select *, round(greatest(0::double, least(1::double, 0.12::double + case when blueprint then 0.1::double else 0 end + least(0.16::double, len(chips) * 0.04::double) + case when len(overlay) >= 2 then 0.1::double else 0 end + case when spatial then 0.2::double else 0 end + case when visual then 0.18::double else 0 end + least(0.22::double, sp * 0.04::double) - case when lo > sp then 0.14::double else 0 end)), 6) as usefulness from vs1)",
    )
)
def c15_visual_support(spark, sf_dir):
    """Usefulness, role and reasons of a scene's picture, with its units, chips and overlay."""
    s = R.Support(spark, sf_dir)
    scenes, events = s.memory()
    units = P.units(P.deltas(scenes, P.edges(scenes, events)))
    return V.visual_support(V.reader_packets(scenes, _overlay(s, spark, sf_dir, scenes)), units)


_SAID = "lower(concat_ws(' ', place, array_to_string(mentioned, ' '), summary))"
_FIRST = "coalesce(place, mentioned[1])"


@query(
    R.sql(
        f"select doc_id, chapter_id, scene_id, case when i and o then 'mixed' when o then 'outdoor' else 'indoor' end as environment_type, case when {_FIRST} is not null then coalesce(nullif(regexp_replace(regexp_replace(lower({_FIRST}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'generic_space') when contains(low, 'forest') then 'forest' when contains(low, 'street') then 'street' when contains(low, 'room') then 'room' else 'generic_space' end as stage_archetype, coalesce({_FIRST}, 'unknown_place') as place_key"
        f" from (select *, {_SAID} as low, regexp_matches({_SAID}, 'indoor|room|hall|house|inside|interior') as i, regexp_matches({_SAID}, 'outdoor|street|forest|field|garden|outside|exterior') as o from ms)",
        R.MEM,
    )
)
def p11_stage_fields(spark, sf_dir):
    return V.stage_fields(R.Support(spark, sf_dir).memory()[0])


_RANGE = r"coalesce(case when contains(paragraph_text, c) then c end, nullif(regexp_extract(paragraph_text, concat('(?i)', array_to_string(list_transform(list_filter(string_split_regex(c, '[\s\p{Z}]+'), lambda w: w <> ''), lambda w: regexp_escape(w)), '[\s\p{Z}]+')), 0), ''))"


@query(f"select distinct selection_id, strpos(paragraph_text, f) - 1 as start, strpos(paragraph_text, f) - 1 + length(f) as \"end\" from (select *, case when c <> '' then {_RANGE} end as f from (select selection_id, paragraph_text, trim(selected_text) as c from anchored_selections where selected_text is not null and paragraph_text is not null))")
def f17_text_ranges(spark, sf_dir):
    """Where a selection stands in its paragraph, also where white space or letter case differs."""
    s = table(spark, sf_dir, "anchored_selections").where("selected_text is not null and paragraph_text is not null")
    start, end = V.text_range("selected_text", "paragraph_text")
    return s.select("selection_id", start.cast("long").alias("start"), end.cast("long").alias("end")).distinct()


@query(
    upto(
        RULES,
        "select doc_id, chapter_id, pid, min(s) as start, max(e) as \"end\", any_value(units) as units from (select *, sum(new) over (partition by doc_id, chapter_id, pid order by s) as run from (select *, case when lag(e) over w = s and lag(units) over w = units then 0 else 1 end as new from sg window w as (partition by doc_id, chapter_id, pid order by s))) group by doc_id, chapter_id, pid, run",
        f", rg as (select distinct selection_id, doc_id, chapter_id, pid, strpos(paragraph_text, f) - 1 as s, strpos(paragraph_text, f) - 1 + length(f) as e from (select *, case when c <> '' then {_RANGE} end as f from (select *, trim(selected_text) as c from anchored_selections where selected_text is not null and paragraph_text is not null and pid is not null))),"
        " an as (select distinct doc_id, chapter_id, pid, start_char as s, start_char + length(span) as e, mention_type as unit from occ union select doc_id, chapter_id, pid, s, e, 'selection' from rg where e > s),"
        " ct as (select distinct doc_id, chapter_id, pid, s as c from an union select doc_id, chapter_id, pid, e from an), nx as (select *, lead(c) over (partition by doc_id, chapter_id, pid order by c) as d from ct),"
        " sg as (select n.doc_id, n.chapter_id, n.pid, n.c as s, n.d as e, list(distinct a.unit order by a.unit) as units from nx n join an a on a.doc_id = n.doc_id and a.chapter_id = n.chapter_id and a.pid = n.pid and a.s <= n.c and a.e >= n.d where n.d is not null group by all)",
    )
)
def e16_anchor_segments(spark, sf_dir):
    """Mentions and selections laid over a paragraph: its stretches with all that covers them."""
    said = Chapter(spark, sf_dir).said
    start, end = V.text_range("selected_text", "paragraph_text")
    chosen = table(spark, sf_dir, "anchored_selections").where("selected_text is not null and paragraph_text is not null and pid is not null").select(*CH, "pid", start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit("selection").alias("unit"))
    named = said.select(*CH, "pid", F.col("start_char").cast("long").alias("start"), (F.col("start_char") + F.length("span")).cast("long").alias("end"), F.col("mention_type").alias("unit"))
    return V.segments(named.unionByName(chosen), [*CH, "pid"])


# ---- what answers give a reader, field by field with fallbacks (P-09, P-14, D-10)

_ANSWER = "an as (select distinct trial_key, stage_id, raw_response as r from llm_trials where json_valid(raw_response) and json_type(raw_response) = 'OBJECT')"
_KEYS = ["scene_summary", "problem_state", "causal_result"]
_FIELD = "nullif(trim(json_extract_string(r, '$.{k}')), '')"
_NESTED = "nullif(trim(json_extract_string(r, '$.titles[0].title')), ''), nullif(trim(json_extract_string(r, '$.mentions[0].reason')), '')"


def _answers(spark, sf_dir):
    t = table(spark, sf_dir, "llm_trials").select("trial_key", "stage_id", F.col("raw_response").alias("r")).distinct()
    return t.where(F.coalesce(F.get_json_object("r", "$").startswith("{"), F.lit(False)))


@query(f"with {_ANSWER} select trial_key, coalesce({', '.join(_FIELD.format(k=k) for k in _KEYS)}, {_NESTED}, '') as told from an")
def p09_answer_text(spark, sf_dir):
    """The first field of an answer that says anything, then what is nested; empty where nothing does."""
    field = lambda path: F.nullif(F.trim(F.get_json_object("r", path)), F.lit(""))
    return _answers(spark, sf_dir).select("trial_key", F.coalesce(*[field(f"$.{k}") for k in _KEYS], field("$.titles[0].title"), field("$.mentions[0].reason"), F.lit("")).alias("told"))


@query(
    f"with {_ANSWER} select trial_key, coalesce({_FIELD.format(k='problem_state')}, {_FIELD.format(k='causal_result')}, concat('Reader hint package for ', trial_key, '.')) as summary,"
    " list_filter(list_transform(coalesce(from_json(json_extract(r, '$.evidence_text'), '[\"VARCHAR\"]'), []), lambda t: trim(t)), lambda t: t <> '')[1:3] as hints, case when try_cast(json_extract_string(r, '$.confidence') as double) is not null then greatest(0.2::double, least(1.0::double, try_cast(json_extract_string(r, '$.confidence') as double))) else 0.4::double end as priority from an where stage_id = 'SUB.2'"
)
def p14_hint_packages(spark, sf_dir):
    """A subscene's hints: a summary with its fallbacks, at most three hints, a priority between 0.2 and 1, or 0.4 where none is known."""
    field = lambda k: F.nullif(F.trim(F.get_json_object("r", f"$.{k}")), F.lit(""))
    listed = F.from_json(F.get_json_object("r", "$.evidence_text"), "array<string>")
    hints = F.slice(F.filter(F.transform(F.coalesce(listed, F.expr("cast(array() as array<string>)")), lambda t: F.trim(t)), lambda t: t != ""), 1, 3)
    sure = F.expr("try_cast(get_json_object(r, '$.confidence') as double)")
    priority = F.when(sure.isNotNull(), F.greatest(F.lit(0.2), F.least(F.lit(1.0), sure))).otherwise(0.4)
    a = _answers(spark, sf_dir).where("stage_id = 'SUB.2'")
    return a.select("trial_key", F.coalesce(field("problem_state"), field("causal_result"), F.concat(F.lit("Reader hint package for "), "trial_key", F.lit("."))).alias("summary"), hints.alias("hints"), priority.alias("priority"))


@query(
    f"with {_ANSWER}, m as (select trial_key, list_transform(from_json(json_extract(r, '$.mentions'), '[{{\"span\":\"VARCHAR\",\"mention_type\":\"VARCHAR\"}}]'), lambda x: {{'s': trim(x.span), 't': x.mention_type}}) as l from an where json_type(r, '$.mentions') = 'ARRAY'),"
    " c as (select trial_key, list_transform(list_concat(list_filter(l, lambda x: x.t = 'cast'), list_filter(l, lambda x: x.t <> 'cast')), lambda x: x.s) as n from m) select trial_key, list_filter(n, lambda x, i: x <> '' and list_position(n, x) = i) as merged from c"
)
def d10_merged_cast(spark, sf_dir):
    """Who is on stage, then what else is named, each name once in order."""
    parsed = F.from_json("r", "mentions array<struct<span string, mention_type string>>")["mentions"]
    of = lambda yes: F.filter("m", lambda x: (x["mention_type"] == "cast") if yes else (x["mention_type"] != "cast"))
    a = _answers(spark, sf_dir).withColumn("m", parsed).where("m is not null")
    return a.select("trial_key", F.array_distinct(F.filter(F.transform(F.concat(of(True), of(False)), lambda x: F.trim(x["span"])), lambda n: n != "")).alias("merged"))


# ---- what of a graph is drawn (T-08)


@query(
    Q.sql(
        "select 'node' as what, node_id as from_id, cast(null as varchar) as to_id, nth from (select node_id, cast(row_number() over (order by kind, node_id) as int) as nth from kn where node_id in (select node_id from kt0)) where nth <= 96 union all select 'edge', from_id, to_id, nth from (select from_id, to_id, cast(row_number() over (order by from_id, to_id, type) as int) as nth from (select e.* from ke e where e.from_id in (select node_id from dr) and e.to_id in (select node_id from dr))) where nth <= 180",
        Q.REFS + Q.KG + ", kt0 as (select node_id from kn), dr as (select node_id from (select node_id, row_number() over (order by kind, node_id) as nth from kn) where nth <= 96)",
    )
)
def t08_drawn_graph(spark, sf_dir):
    """The first 96 nodes by kind, and of the edges between them the first 180: what a canvas holds."""
    from pyspark.sql import Window

    from fabulary.plans import graph as G

    nodes, edges = G.project(Q.Book(spark, sf_dir).refs())
    first = nodes.select("kind", "node_id").orderBy("kind", "node_id").limit(96).withColumn("nth", F.row_number().over(Window.orderBy("kind", "node_id")))
    drawn = G.induced(edges, first).orderBy("from_id", "to_id", "type").limit(180).withColumn("nth", F.row_number().over(Window.orderBy("from_id", "to_id", "type")))
    return first.select(F.lit("node").alias("what"), F.col("node_id").alias("from_id"), F.lit(None).cast("string").alias("to_id"), "nth").unionByName(drawn.select(F.lit("edge").alias("what"), "from_id", "to_id", "nth"))


# ---- fields out of free text, names of files (F-14, K-14)

_LABELS = ["TASK", "LANGUAGE", "FORMAT"]
_PROMPT = r"trim(regexp_replace(regexp_replace(prompt, '[\s\p{Z}]+', ' ', 'g'), '\b(SUP\.\d+|BOOK\.0|FINAL\.\d+)\b', '', 'g'))"


@query(
    "with p as (select distinct trial_key, concat(' ', " + _PROMPT + ", ' ') as t from llm_trials where prompt is not null), f as (select trial_key, "
    + ", ".join(rf"nullif(regexp_replace(regexp_replace(case when regexp_matches(t, '(?i)\s{x}:') then (string_split_regex(t, '(?i)\s{x}:\s*'))[-1] end, '(?is)\s({'|'.join(_LABELS)}):.*$', ''), '[.;,\s]+$', ''), '') as {x.lower()}" for x in _LABELS)
    + " from p) select trial_key, task, language, format from f"
)
def f14_prompt_fields(spark, sf_dir):
    """What a prompt says under its labels."""
    from fabulary.functions import reader_text as T

    t = table(spark, sf_dir, "llm_trials").where("prompt is not null").select("trial_key", "prompt").distinct()
    return t.withColumn("f", T.fields("prompt", _LABELS)).select("trial_key", *[F.col("f")[x.lower()].alias(x.lower()) for x in _LABELS])


@query(r"select distinct unit_id, coalesce(nullif(regexp_replace(regexp_replace(trim(selected_title), '[^A-Za-z0-9_.\-]+', '_', 'g'), '_+', '_', 'g'), ''), 'original.epub') as file_name, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(selected_title), '[^A-Za-z0-9_\-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'untitled') as segment from source_units where unit_id is not null")
def k14_file_names(spark, sf_dir):
    """Titles as names of files and of folders."""
    from fabulary.functions import reader_text as T

    return table(spark, sf_dir, "source_units").where("unit_id is not null").select("unit_id", T.file_name("selected_title").alias("file_name"), T.path_segment("selected_title", "untitled").alias("segment")).distinct()


# ---- overlays as a reader sees them, and what is in focus (P-20, P-21)


@query("select distinct doc_id, chapter_id, scene_id, overlay_id, label, anchor_method = 'vision' as refined from overlay_characters where not (coalesce(anchor_method, '') = 'vision' and anchor_x is null)")
def p20_merged_overlay(spark, sf_dir):
    """Overlay characters but those that a look at the picture did not find; refined: their place was looked up there."""
    o = table(spark, sf_dir, "overlay_characters").where(~((F.coalesce("anchor_method", F.lit("")) == "vision") & F.col("anchor_x").isNull()))
    return o.select(*CH, "scene_id", "overlay_id", "label", (F.col("anchor_method") == "vision").alias("refined")).distinct()


@query(R.sql("select doc_id, chapter_id, scene_id, case when len(overlay) >= 2 then 'pair' when len(overlay) = 1 then 'character' else 'global' end as mode, case when len(overlay) > 0 then array_to_string(list_sort(list_transform(overlay[1:2], lambda l: concat('char_', regexp_replace(lower(l), '\\s+', '_', 'g')))), '__') end as focus from rp0", R.MEM + OVERLAY))
def p21_focus(spark, sf_dir):
    """What is in focus when the first two characters of a scene are chosen: the pair, the one, or the scene as a whole."""
    s = R.Support(spark, sf_dir)
    scenes = s.memory()[0]
    p = V.reader_packets(scenes, _overlay(s, spark, sf_dir, scenes))
    ids = F.array_sort(F.transform(F.slice("overlay", 1, 2), lambda x: F.concat(F.lit("char_"), F.regexp_replace(F.lower(x), r"\s+", "_"))))
    n = F.size("overlay")
    return p.select(*CH, "scene_id", F.when(n >= 2, "pair").when(n == 1, "character").otherwise("global").alias("mode"), F.when(n > 0, F.array_join(ids, "__")).alias("focus"))


# ---- story text only, scene ids of all logs, current and legacy store, answers compared (C-07, D-02, S-15, P-22)


@query("with s as (select distinct doc_id, chapter_id from chapter_candidates where classification = 'content'), p as (select distinct doc_id, chapter_id, pid from paragraphs where text is not null) select p.doc_id, p.chapter_id, count(*) as paragraphs from p semi join s using (doc_id, chapter_id) group by all")
def c07_story_paragraphs(spark, sf_dir):
    """Paragraphs of chapters that are story text; only these go on to mentions."""
    story = table(spark, sf_dir, "chapter_candidates").where("classification = 'content'").select(*CH).distinct()
    return table(spark, sf_dir, "paragraphs").where("text is not null").select(*CH, "pid").distinct().join(story, CH, "left_semi").groupBy(*CH).agg(F.count("*").alias("paragraphs"))


@query(
    R.sql(
        "select doc_id, chapter_id, scene_id, min(log) as first_log from (select doc_id, chapter_id, scene_id, 1 as log from ms union all select doc_id, chapter_id, scene_id, 2 from ev union all select doc_id, chapter_id, to_scene, 3 from ed union all select doc_id, chapter_id, scene_id, 4 from overlay_characters) where scene_id is not null group by all",
        R.MEM + R.EV + R.EDGES,
    )
)
def d02_scenes_of_all_logs(spark, sf_dir):
    """Every scene that any log knows, with the first log that does."""
    scenes, events = R.Support(spark, sf_dir).memory()
    logs = [scenes, events, P.edges(scenes, events).withColumnRenamed("to_scene", "scene_id"), table(spark, sf_dir, "overlay_characters")]
    rows = None
    for i, log in enumerate(logs, 1):
        part = log.select(*CH, "scene_id", F.lit(i).alias("log"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.where("scene_id is not null").groupBy(*CH, "scene_id").agg(F.min("log").alias("first_log"))


@query("select 'current' as store, doc_id, count(distinct chapter_id) as chapters from chapter_candidates group by all union all select 'legacy', doc_id, count(distinct chapter_id) from paragraphs p where not exists (select 1 from chapter_candidates c where c.doc_id = p.doc_id and c.chapter_id = p.chapter_id) group by doc_id")
def s15_current_and_legacy(spark, sf_dir):
    """Chapters of the current store, and of the legacy one those that the current has not."""
    now = table(spark, sf_dir, "chapter_candidates").select(*CH).distinct()
    old = table(spark, sf_dir, "paragraphs").select(*CH).distinct().join(now, CH, "left_anti")
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("chapter_id").alias("chapters")).select(F.lit(name).alias("store"), "doc_id", "chapters")
    return count(now, "current").unionByName(count(old, "legacy"))


_PAIR = ["scene_summary", "goals", "problem_state", "causal_result", "titles", "mentions"]


@query(
    f"with {_ANSWER}, k as (select distinct t.trial_key, t.doc_id, t.chapter_id, t.stage_id, t.created_at, t.raw_response as r from llm_trials t join an on an.trial_key = t.trial_key and an.r = t.raw_response), w as (select *, lag(r) over (partition by doc_id, chapter_id, stage_id order by created_at, trial_key) as b from k)"
    " select trial_key, list_filter([" + ", ".join(f"case when coalesce(cast(json_extract(r, '$.{x}') as varchar), '') <> coalesce(cast(json_extract(b, '$.{x}') as varchar), '') then '{x}' end" for x in _PAIR) + "], lambda x: x is not null) as changed from w where b is not null"
)
def p22_changed_fields(spark, sf_dir):
    """Between an answer and the one before of its chapter and stage, the fields that differ."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "llm_trials").select("trial_key", *CH, "stage_id", "created_at", F.col("raw_response").alias("r")).distinct()
    t = t.where(F.coalesce(F.get_json_object("r", "$").startswith("{"), F.lit(False)))
    w = t.withColumn("b", F.lag("r").over(Window.partitionBy(*CH, "stage_id").orderBy("created_at", "trial_key"))).where("b is not null")
    of = lambda c, x: F.coalesce(F.get_json_object(c, f"$.{x}"), F.lit(""))
    return w.select("trial_key", F.filter(F.array(*[F.when(of("r", x) != of("b", x), F.lit(x)) for x in _PAIR]), lambda x: x.isNotNull()).alias("changed"))
