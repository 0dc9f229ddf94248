"""Queries over what the book adds to a scene, the graph of events and entities, reader threads, and realised reader text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabulary.functions import reader_text as T
from fabulary.functions import text as X
from fabulary.plans import book as B
from fabulary.plans import graph as G
from fabulary.plans import runstore as K
from fabulary.plans import support as P
from fabulary.queries import book as Q
from fabulary.queries import query
from fabulary.queries import reader as R
from fabulary.queries.story import Chapter, PACKETS, upto
from fabulary.session import table

CH = P.CH
_HALF = "(select doc_id, cast(ceil(count(*) / 2.0) as int) as reader from rf group by doc_id)"


def _kinds(table: dict[str, list[str]], column: str) -> str:
    """SQL: the kinds of support that a row speaks to."""
    every = ", ".join(f"case when {column} in ({', '.join(repr(t) for t in types)}) then '{kind}' end" for kind, types in table.items())
    return f"unnest(list_filter(['all', {every}], lambda k: k is not null))"


# ---- claims and edges by the kind of support they speak to (C-13, C-14)


@query(Q.sql(f"select doc_id, kind, count(*) as claims from (select c.doc_id, {_kinds(B.CLAIMS_OF, 'c.claim_type')} as kind from cl c join rf r on r.doc_id = c.doc_id and r.scene_key = c.scene_key join {_HALF} p on p.doc_id = c.doc_id where r.place_no <= p.reader) group by all"))
def c13_claims_for_support(spark, sf_dir):
    """Per book and kind of support, the claims that a reader half way through may be shown for it."""
    b = Q.Book(spark, sf_dir)
    refs = b.refs()
    half = refs.groupBy("doc_id").agg(F.ceil(F.count("*") / 2).cast("int").alias("reader"))
    allowed = b.claims(refs).join(refs.select("doc_id", "scene_key", "place_no"), ["doc_id", "scene_key"]).join(half, "doc_id").where("place_no <= reader")
    return B.by_kind(allowed, "claim_type", B.CLAIMS_OF).groupBy("doc_id", "kind").agg(F.count("*").alias("claims"))


@query(Q.sql(f"select doc_id, kind, count(*) as edges from (select doc_id, {_kinds(B.EDGES_OF, 'type')} as kind from ae) group by all"))
def c14_edges_for_support(spark, sf_dir):
    b = Q.Book(spark, sf_dir)
    return B.by_kind(b.edges(b.refs()), "type", B.EDGES_OF).groupBy("doc_id", "kind").agg(F.count("*").alias("edges"))


# ---- what the book adds to a scene (T-03, E-14)

_ORDER = "case claim_type when 'causal' then 0 when 'place' then 1 when 'relation' then 2 end"
_CUE0 = r"list_filter(list_transform(string_split_regex({c}, '\s*(?:->|→|=>)\s*'), lambda p: trim(p)), lambda p: p <> '')"
_CUE1 = r"trim(split_part(trim(regexp_replace(regexp_replace(case when len({p}) > 1 then {p}[-1] else {c} end, '^(current place|same place continues|continued cast):\s*', '', 'i'), '\s+(reappears across chapters\.?|appears in .+)$', '', 'i')), ',', 1))"


def cue_sql(c: str) -> str:
    inner = _CUE1.format(p=_CUE0.format(c=c), c=c)
    return f"case when length({inner}) >= 2 then {inner} end"


def _unit_sql(i: int) -> str:
    return "case t " + " ".join(f"when '{t}' then '{v[i]}'" for t, v in B.UNIT_OF.items()) + " end"


@query(Q.sql(f"select doc_id, scene_key, claim_type, claim, cast(nth as int) as nth from (select *, row_number() over (partition by doc_id, scene_key order by {_ORDER}, confidence desc, claim_id) as nth from cl where claim_type in ('causal', 'place', 'relation') and scene_key is not null) where nth <= 4"))
def t03_first_claims(spark, sf_dir):
    """The first four claims of a scene: causes, then places, then relations; the surer first."""
    b = Q.Book(spark, sf_dir)
    order = F.when(F.col("claim_type") == "causal", 0).when(F.col("claim_type") == "place", 1).otherwise(2)
    w = Window.partitionBy("doc_id", "scene_key").orderBy(order, F.desc("confidence"), "claim_id")
    c = b.claims(b.refs()).where(F.col("claim_type").isin(*B.CLAIM_ORDER) & F.col("scene_key").isNotNull())
    return c.withColumn("nth", F.row_number().over(w)).where("nth <= 4").select("doc_id", "scene_key", "claim_type", "claim", "nth")


@query(
    Q.sql(
        "select doc_id, scene_key, source, " + ", ".join(f"{_unit_sql(i)} as {n}" for i, n in enumerate(("kind", "problem", "label", "title"))) + f", {cue_sql('claim')} as cue, cast(nth as int) as nth from (select doc_id, scene_key, 'claim' as source, claim_type as t, claim, nth from first4 union all select e.doc_id, e.to_key, 'edge', case when type = 'cross_chapter_causal_bridge' then 'causal' when type in ('cross_chapter_place_shift', 'cross_chapter_same_place') then 'place' else 'relation' end, label, nth"
        f" from (select *, row_number() over (partition by doc_id, to_key order by {Q._PRIO}, weight desc, edge_id) as nth from ae where type <> 'chapter_sequence') e where nth <= 4 and not exists (select 1 from first4 t where t.doc_id = e.doc_id and t.scene_key = e.to_key))",
        Q.ALL + f", first4 as (select * from (select *, row_number() over (partition by doc_id, scene_key order by {_ORDER}, confidence desc, claim_id) as nth from cl where claim_type in ('causal', 'place', 'relation') and scene_key is not null) where nth <= 4)",
    )
)
def e14_book_units(spark, sf_dir):
    b = Q.Book(spark, sf_dir)
    refs = b.refs()
    edges = b.edges(refs)
    return B.book_units(B.claims(refs, edges, B.occurrences(b.said, refs)), edges)


# ---- threads and places for the reader (T-05, T-06, G-13)


@query(Q.sql("select doc_id, key, chapters, mentions, cast(nth as int) as nth from (select *, row_number() over (partition by doc_id order by chapters desc, mentions desc, key) as nth from (select doc_id, key, count(*) as chapters, cast(sum(mentions) as bigint) as mentions from bo group by all having count(*) >= 2)) where nth <= 6", Q.REFS + Q.BOCC))
def t05_top_threads(spark, sf_dir):
    """The six threads of a book that run through most chapters."""
    b = Q.Book(spark, sf_dir)
    w = Window.partitionBy("doc_id").orderBy(F.desc("chapters"), F.desc("mentions"), "key")
    return B.threads(B.occurrences(b.said, b.refs())).select("doc_id", "key", "chapters", "mentions").withColumn("nth", F.row_number().over(w)).where("nth <= 6")


@query(
    Q.sql(
        "select r.doc_id, r.scene_key, o.key, coalesce(o.first_scene = r.scene_key, false) as first_here, cast(row_number() over (partition by r.doc_id, r.scene_key order by coalesce(o.first_scene = r.scene_key, false) desc, t.mentions desc, o.key) as int) as nth from rf r join bo o on o.doc_id = r.doc_id and o.chapter_id = r.chapter_id join (select doc_id, key, sum(mentions) as mentions from bo group by all having count(*) >= 2) t on t.doc_id = o.doc_id and t.key = o.key",
        Q.REFS + Q.BOCC,
    )
)
def t06_reader_threads(spark, sf_dir):
    """The threads of a scene's chapter as its reader sees them: those that begin in the scene first, then by mentions."""
    b = Q.Book(spark, sf_dir)
    refs = b.refs()
    occ = B.occurrences(b.said, refs)
    here = refs.select("doc_id", "chapter_id", "scene_key").join(occ.select("doc_id", "chapter_id", "key", "first_scene"), ["doc_id", "chapter_id"]).join(B.threads(occ).select("doc_id", "key", "mentions"), ["doc_id", "key"])
    first = F.coalesce(F.col("first_scene") == F.col("scene_key"), F.lit(False))
    w = Window.partitionBy("doc_id", "scene_key").orderBy(F.desc("first_here"), F.desc("mentions"), "key")
    return here.withColumn("first_here", first).withColumn("nth", F.row_number().over(w)).select("doc_id", "scene_key", "key", "first_here", "nth")


@query(
    Q.sql(
        "select doc_id, scene_key, list_filter(c, lambda x, i: list_position(c, x) = i) as chain from (select doc_id, scene_key, list_filter(list_concat(case when place is not null then coalesce(list(scene_key) over (partition by doc_id, place order by place_no rows between 2 preceding and 1 preceding), []) else [] end, [lag(scene_key) over (partition by doc_id order by place_no), scene_key]), lambda k: k is not null) as c from rf)",
        Q.REFS,
    )
)
def g13_place_chain(spark, sf_dir):
    return B.place_chain(Q.Book(spark, sf_dir).refs())


# ---- events and entities as a graph (G-01, G-02)

_NODE = Q._NID
_SC, _EVN = _NODE.format(p="doc_id, 'scene', scene_key"), _NODE.format(p="doc_id, 'event', event_key")
EVG = (
    Q.REFS
    + ", ek as (select e.doc_id, e.chapter_id, concat(e.chapter_id, ':', e.scene_id) as scene_key, concat(e.chapter_id, ':', e.event_id) as event_key, e.pid, e.action, e.causal_result from ev e),"
    f" an as (select distinct k.doc_id, k.event_key, k.scene_key, n.name from ek k join occ o on o.doc_id = k.doc_id and o.chapter_id = k.chapter_id and o.pid = k.pid and o.mention_type = 'cast' join nm n on n.doc_id = o.doc_id and n.chapter_id = o.chapter_id and n.eid = {Q._EID.format(o='o.ord')} where {Q._KEY.format(c='n.name')} <> '')"
)


@query(Q.sql(f"select {_EVN} as node_id, 'event' as kind, action as label, scene_key, list_filter([action, causal_result], lambda t: t is not null) as tags from ek", EVG))
def g01_event_nodes(spark, sf_dir):
    b = Q.Book(spark, sf_dir)
    refs = b.refs()
    return G.project_events(refs, b.events_by_key(), b.actors())[0]


@query(
    Q.sql(
        f"select {_SC} as from_id, {_EVN} as to_id, 'contains_event' as type from ek union all select {_EVN}, {_NODE.format(p='doc_id, ' + chr(39) + 'character' + chr(39) + ', ' + Q._KEY.format(c='name'))}, 'actor' from an"
        f" union all select {_NODE.format(p='doc_id, ' + chr(39) + 'scene' + chr(39) + ', prev')}, {_SC}, 'scene_sequence' from (select *, lag(scene_key) over (partition by doc_id, chapter_id order by scene_no) as prev from rf) where prev is not null",
        EVG,
    )
)
def g01_event_edges(spark, sf_dir):
    """What scenes contain which events, who acts in them, and which scene follows which."""
    b = Q.Book(spark, sf_dir)
    return G.project_events(b.refs(), b.events_by_key(), b.actors())[1]


@query(
    upto(
        Q.RULES,
        f"select {_NODE.format(p='doc_id, ' + chr(39) + 'entity' + chr(39) + ', chapter_id, cast(ord as varchar)')} as from_id, {_NODE.format(p='doc_id, ' + chr(39) + 'mention' + chr(39) + ', chapter_id, cast(ord as varchar), cast(pid as varchar), cast(start_char as varchar), span')} as to_id, 'has_mention' as type, concat(plain, ' mentioned as ', span) as label from occ",
    )
)
def g02_mention_edges(spark, sf_dir):
    """Entities and the places where they are mentioned."""
    return G.project_mentions(Chapter(spark, sf_dir).said)


# ---- the governor, over all states of a reader (E-15)

_STATES = [(gap, tired, visual, active, signal) for gap in (0, 600_000) for tired in (0.0, 0.7) for visual in (True, False) for active in (True, False) for signal in (True, False)]
_ST = "rst as (select * from (values " + ", ".join(f"({i}, {g >= 600_000}, {t >= 0.65}, {v}, {a}, {s})" for i, (g, t, v, a, s) in enumerate(_STATES)) + ") as x(state, reentry, tired, visual, active, signal))"
_KEEP = "list_filter({l}, lambda x: {c})"
GOVERNED = (
    f", {_ST}, pl as (select doc_id, chapter_id, scene_no, scene_id, list({{'label': label, 'kind': kind, 'display': display, 'problem': problem}} order by place) as u from vf where not redundant group by all),"
    " su as (select doc_id, chapter_id, scene_no, cast(count(*) as int) as suppressed from po where choice = 'suppressed' group by all),"
    " gv0 as (select p.*, s.*, coalesce(z.suppressed, 0) as base, list_filter(u, lambda x: x.display = 'visible') as v, list_filter(u, lambda x: x.display = 'expandable' and (s.visual or x.kind <> 'visual_context')) as e, list_filter(u, lambda x: x.display = 'trigger_only') as t0, len(list_filter(u, lambda x: x.display <> 'visible' and x.kind = 'visual_context' and not s.visual)) as hid from pl p cross join rst s left join su z on z.doc_id = p.doc_id and z.chapter_id = p.chapter_id and z.scene_no = p.scene_no),"
    " gv1 as (select *, list_filter(e, lambda x: x.kind in ('character_focus', 'spatial_continuity', 'visual_context')) as beside, list_filter(e, lambda x: x.kind not in ('character_focus', 'spatial_continuity', 'visual_context')) as rest, list_filter(t0, lambda x: (x.kind = 'reentry_recap' and reentry) or (x.kind = 'visual_context' and visual)) as fired, v[2:] as over, case when active and not tired then v[1:1] else [] end as b0 from gv0),"
    " gv2 as (select *, list_filter(list_concat(list_concat(rest, fired), over), lambda x: x.problem in ('state_recovery', 'boundary_update') or x.kind in ('snapshot', 'boundary_delta'))[1:1] as rec from gv1), gv3 as (select *, case when len(b0) = 0 and signal and not tired then rec else b0 end as before from gv2)"
)


@query(
    R.sql(
        "select doc_id, chapter_id, scene_id, state, list_transform(before, lambda x: x.label) as before_text, list_transform(beside, lambda x: x.label) as beside_visual, list_transform(list_filter(list_concat(list_concat(over, rest), fired), lambda x: not list_contains(before, x)), lambda x: x.label) as on_demand, cast(len(t0) - len(fired) as int) as hidden_triggers, cast(base + hid as int) as suppressed,"
        " list_filter([case when reentry then 'session_reentry' end, case when signal then 'recovery_signal' end, case when visual then 'visual_useful' else 'visual_suppressed' end, case when tired then 'support_fatigue_high' end, case when len(b0) = 0 and len(before) > 0 then 'promoted_recovery_unit' end], lambda x: x is not null) as diagnostics from gv3",
        R.ALL + GOVERNED,
    )
)
def e15_governor_states(spark, sf_dir):
    """What the governor lets through in every state of a reader: back or not, tired or not, pictures useful, at a boundary, in need of recovery."""
    p = R.Support(spark, sf_dir).policy()
    states = spark.createDataFrame([(i, g, t, v, a, s) for i, (g, t, v, a, s) in enumerate(_STATES)], "state int, resume_gap_ms long, fatigue double, visual boolean, active boolean, signal boolean")
    return P.governed(p, states)


# ---- realised reader text (F-12, F-13, F-16)


@query(Q.sql(f"select doc_id, edge_id, case when len(p) > 1 then array_to_string(p[1:len(p) - 1], ' -> ') end as previous, case when len(p) > 1 then p[-1] end as current, {cue_sql('label')} as cue from (select *, {_CUE0.format(c='label')} as p from ae)"))
def f16_bridges(spark, sf_dir):
    """Labels parted at their arrows into what was and what is, with the cue of now."""
    b = Q.Book(spark, sf_dir)
    e = b.edges(b.refs())
    return e.select("doc_id", "edge_id", *T.bridge("label"), B.cue("label").alias("cue"))


@query("select cluster_id, case when len(l) = 0 then 'no explicit detail' else array_to_string(l[1:4], ', ') end as spans from (select cluster_id, list_filter(r, lambda x, i: list_position(r, x) = i) as l from (select distinct cluster_id, list_filter(list_transform(raw_spans, lambda s: trim(s)), lambda s: s <> '') as r from mention_clusters))")
def f12_compact_lists(spark, sf_dir):
    return table(spark, sf_dir, "mention_clusters").select("cluster_id", T.compact_list("raw_spans").alias("spans")).distinct()


_CLEAN = r"trim(regexp_replace(regexp_replace({c}, '[\s\p{{Z}}]+', ' ', 'g'), '\b(SUP\.\d+|BOOK\.0|FINAL\.\d+)\b', '', 'g'))"
_SHORT = "case when length({t}) <= {n} then {t} else concat(trim(substr({t}, 1, {m})), '…') end"
_SENT = r"regexp_replace({s}, '[.;,\s]+$', '')"


@query(
    "select distinct selection_id, short, case when bare = '' then '' when regexp_matches(bare, '[.!?。！？]$') then bare else concat(bare, '.') end as sentence from (select selection_id, short, trim("
    + _SENT.format(s=_SHORT.format(t="t", n=180, m=179)) + ") as bare from (select selection_id, t, " + _SHORT.format(t="t", n=120, m=119) + " as short from (select selection_id, " + _CLEAN.format(c="selected_text") + " as t from anchored_selections where selected_text is not null)))"
)
def f13_compact_texts(spark, sf_dir):
    """Selections as a reader is shown them: cleaned, at most 120 characters with an ellipsis; and as one closed sentence of at most 180."""
    s = table(spark, sf_dir, "anchored_selections").where("selected_text is not null")
    return s.select("selection_id", T.compact("selected_text").alias("short"), T.sentence("selected_text").alias("sentence")).distinct()


# ---- titles, store reads, reader events (P-06, S-06, S-09, R-02, R-05)


@query(
    upto(
        PACKETS,
        "select k.doc_id, k.chapter_id, k.scene_id, f.place as start_place, l.place as end_place, coalesce(f.active, []) as active_cast, coalesce(substr(t.preview, 1, 400), '') as preview from pk k left join fr f on f.doc_id = k.doc_id and f.chapter_id = k.chapter_id and f.pid = k.pids[1] left join fr l on l.doc_id = k.doc_id and l.chapter_id = k.chapter_id and l.pid = k.pids[-1]"
        " left join (select doc_id, chapter_id, scene_no, array_to_string(list(text order by pid), ' ') as preview from (select *, row_number() over (partition by doc_id, chapter_id, scene_no order by pid) as n from ins) where n <= 3 group by all) t on t.doc_id = k.doc_id and t.chapter_id = k.chapter_id and t.scene_no = k.scene_no",
    )
)
def p06_title_context(spark, sf_dir):
    """What a title is asked with: places at both ends of a scene, its first cast, and a look into its first three paragraphs (400 characters, a fixed value of the prompt)."""
    c = Chapter(spark, sf_dir)
    from fabulary.plans import scenes as S

    return S.title_context(c.packets(), c.frames, c.para)


@query("select doc_id, count(distinct para_id) as paragraphs, max(ingested_at) as newest, cast(row_number() over (order by max(ingested_at) desc, doc_id) as int) as nth from paragraphs group by doc_id")
def s06_documents_newest_first(spark, sf_dir):
    """All books, the one last added to first."""
    d = table(spark, sf_dir, "paragraphs").groupBy("doc_id").agg(F.count_distinct("para_id").alias("paragraphs"), F.max("ingested_at").alias("newest"))
    return d.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("newest"), "doc_id")))


@query("select distinct doc_id, chapter_id, pid, length(text) as n from paragraphs where doc_id = 'bk0000000' and chapter_id = 'ch02'")
def s09_one_chapter(spark, sf_dir):
    """A chapter by its key; the filter is pushed into the scan."""
    return table(spark, sf_dir, "paragraphs").where("doc_id = 'bk0000000' and chapter_id = 'ch02'").select("doc_id", "chapter_id", "pid", F.length("text").cast("long").alias("n")).distinct()


@query("select user_id, event_type, cast(ts as date) as day, min(event_id) as event_id from events group by all")
def r02_unique_per_mount(spark, sf_dir):
    """One event of a kind per session and day, the first."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.min("event_id").alias("event_id"))


@query(
    "select event_id, coalesce(epoch_us(ts) - epoch_us(nav) >= 45000000, false) as long_pause, coalesce(scrolled, false) as backscroll from (select *, max(case when event_type = 'click' then ts end) over w as nav, max(case when event_type = 'view' then ts end) over w > coalesce(max(case when event_type = 'click' then ts end) over w, timestamp '1970-01-01') as scrolled from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding))"
)
def r05_pause_and_backscroll(spark, sf_dir):
    """At every event: did 45 seconds pass since the last navigation (a click), and was there a look back (a view) since it?"""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    of = lambda kind: F.max(F.when(F.col("event_type") == kind, F.unix_micros(F.col("ts").cast("timestamp")))).over(w)
    e = table(spark, sf_dir, "events").withColumns({"nav": of("click"), "seen": of("view")})
    return e.select("event_id", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.col("nav") >= 45_000_000, F.lit(False)).alias("long_pause"), F.coalesce(F.col("seen") > F.coalesce("nav", F.lit(0)), F.lit(False)).alias("backscroll"))


# ---- the run store's steps over the trials: a trial's number is a run, its response an artifact (K-01, K-05, K-10)

_REFS = "with t as (select distinct doc_id, chapter_id, concat('run_', trial_id) as run_id, stage_id as stage, md5(coalesce(raw_response, '')) as artifact_id, created_at as written_at from llm_trials), l as (select doc_id, chapter_id, run_id, stage, max_by(artifact_id, {'w': written_at, 'a': artifact_id}) as artifact_id from t group by all)"


def _trial_runs(spark, sf_dir):
    t = table(spark, sf_dir, "llm_trials").select("doc_id", "chapter_id", F.concat(F.lit("run_"), "trial_id").alias("run_id"), F.col("stage_id").alias("stage"), F.md5(F.coalesce("raw_response", F.lit(""))).alias("artifact_id"), F.col("created_at").alias("written_at")).distinct()
    return K.refs_by_run(t)


@query(_REFS + " select doc_id, chapter_id, run_id, map_from_entries(list((stage, artifact_id) order by stage)) as refs from l group by all")
def k01_run_references(spark, sf_dir):
    """By run and stage the result written last."""
    return _trial_runs(spark, sf_dir)


@query(_REFS + ", s as (select * from l where stage not in (" + ", ".join(f"'{x}'" for x in sorted(G.descendants("STATE.3") | {"STATE.3"})) + ")) select r.doc_id, r.chapter_id, r.run_id, cast(count(s.stage) as int) as kept, list(s.stage order by s.stage) filter (where s.stage is not null) as stages from (select distinct doc_id, chapter_id, run_id from l) r left join s using (doc_id, chapter_id, run_id) group by all")
def k05_forked_references(spark, sf_dir):
    """What is left of every run when its scene titles are done again."""
    r = K.forked(_trial_runs(spark, sf_dir), "STATE.3").withColumn("stages", F.array_sort(F.map_keys("refs")))
    return r.select(*K.RUN_KEY, F.size("stages").alias("kept"), F.when(F.size("stages") > 0, F.col("stages")).alias("stages"))


@query(_REFS + ", r as (select doc_id, chapter_id, run_id, count(*) as n from l group by all) select doc_id, chapter_id, run_id, row_number() over (partition by doc_id, chapter_id order by n desc, run_id) = 1 as favourite from r")
def k10_favourite_runs(spark, sf_dir):
    """The run of a chapter with most results made its favourite, the others not."""
    runs = _trial_runs(spark, sf_dir).withColumns({"favourite": F.lit(False), "n": F.size("refs")})
    w = Window.partitionBy("doc_id", "chapter_id").orderBy(F.desc("n"), "run_id")
    best = runs.withColumn("nth", F.row_number().over(w)).where("nth = 1")
    return K.favoured(runs, best).select(*K.RUN_KEY, "favourite")


# ---- steps over the graph of a book (G-04)


@query(
    Q.sql(
        "select w.node_id, min(w.hops) as hops from w group by node_id",
        Q.REFS + Q.KG + ", both_ways as (select from_id as a, to_id as b from ke union select to_id, from_id from ke), w as (select node_id, 0 as hops from (select min(node_id) as node_id from kn where kind = 'place') union select e.b, w.hops + 1 from w join both_ways e on e.a = w.node_id where w.hops < 3)",
    )
)
def g04_graph_hops(spark, sf_dir):
    """All nodes of the project graph within three undirected steps of one place, breadth first."""
    nodes, edges = G.project(Q.Book(spark, sf_dir).refs())
    return G.neighbourhood(edges, nodes.where("kind = 'place'").agg(F.min("node_id").alias("node_id")), 3)


# ---- what model answers say of mentions, checked against the text (C-10)

_SAID = "x as (select distinct trial_key, doc_id, chapter_id, m from (select trial_key, doc_id, chapter_id, unnest(from_json(json_extract(raw_response, '$.mentions'), '[{\"pid\":\"INTEGER\",\"span\":\"VARCHAR\",\"mention_type\":\"VARCHAR\"}]')) as m from llm_trials where stage_id = 'ENT.1' and json_valid(raw_response) and json_type(raw_response, '$.mentions') = 'ARRAY'))"


@query(
    "with " + _SAID + ", pids as (select distinct doc_id, chapter_id, pid from paragraphs), nm as (select distinct doc_id, chapter_id, mention_type, s as span from (select doc_id, chapter_id, mention_type, unnest(raw_spans) as s from mention_clusters))"
    " select trial_key, 'out_of_range_evidence' as issue, concat('pid ', m.pid, ' not in chapter') as detail from x where not exists (select 1 from pids p where p.doc_id = x.doc_id and p.chapter_id = x.chapter_id and p.pid = x.m.pid) and m.pid is not null"
    " union select trial_key, 'cast_not_in_union', concat(m.span, ' not in cast') from x where m.mention_type = 'cast' and m.span is not null and not exists (select 1 from nm n where n.doc_id = x.doc_id and n.chapter_id = x.chapter_id and n.mention_type = 'cast' and n.span = x.m.span)"
    " union select trial_key, 'place_named_otherwise', concat(m.span, ' is no place here') from x where m.mention_type = 'place' and m.span is not null and not exists (select 1 from nm n where n.doc_id = x.doc_id and n.chapter_id = x.chapter_id and n.mention_type = 'place' and n.span = x.m.span) and exists (select 1 from nm n where n.doc_id = x.doc_id and n.chapter_id = x.chapter_id and n.span = x.m.span)"
)
def c10_answer_issues(spark, sf_dir):
    """Mentions in model answers: paragraphs that the chapter has not, cast that no cluster holds, places that are known as something else."""
    parsed = F.from_json("raw_response", "mentions array<struct<pid int, span string, mention_type string>>")
    x = table(spark, sf_dir, "llm_trials").where("stage_id = 'ENT.1'").select("trial_key", "doc_id", "chapter_id", F.explode(parsed["mentions"]).alias("m")).select("trial_key", "doc_id", "chapter_id", "m.*").distinct()
    here = table(spark, sf_dir, "paragraphs").select("doc_id", "chapter_id", "pid").distinct()
    names = table(spark, sf_dir, "mention_clusters").select("doc_id", "chapter_id", "mention_type", F.explode("raw_spans").alias("span")).distinct()
    issue = lambda df, kind, detail: df.select("trial_key", F.lit(kind).alias("issue"), detail.alias("detail"))
    keys, of = ["doc_id", "chapter_id", "span"], lambda t: names.where(F.col("mention_type") == t)
    pid = issue(x.where("pid is not null").join(here, ["doc_id", "chapter_id", "pid"], "left_anti"), "out_of_range_evidence", F.concat(F.lit("pid "), "pid", F.lit(" not in chapter")))
    cast = issue(x.where("mention_type = 'cast'").join(of("cast"), keys, "left_anti").where("span is not null"), "cast_not_in_union", F.concat("span", F.lit(" not in cast")))
    place = issue(x.where("mention_type = 'place'").join(of("place"), keys, "left_anti").join(names, keys, "left_semi"), "place_named_otherwise", F.concat("span", F.lit(" is no place here")))
    return pid.unionByName(cast).unionByName(place).distinct()
