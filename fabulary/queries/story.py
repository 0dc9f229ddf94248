"""Queries over mentions, state frames, boundaries and scenes, with the SQL of the same steps."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabulary.functions import text as X
from fabulary.plans import scenes as S
from fabulary.queries import query
from fabulary.queries.ingest import PARA
from fabulary.session import cut, table

CH = S.CH
CLUS = "clus as (select distinct cluster_id, doc_id, chapter_id, ord, mention_type, cluster_name, raw_spans from mention_clusters)"
OCC = (
    "span as (select distinct cluster_id, doc_id, chapter_id, ord, mention_type, span from (select *, unnest(raw_spans) as span from clus) where span <> ''),"
    " met as (select s.*, p.pid, p.text, string_split(p.text, s.span) as parts from span s join para p using (doc_id, chapter_id) where contains(p.text, s.span)),"
    " spot as (select *, cast(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(span) as bigint) as start_char from (select *, unnest(range(1, len(parts))) as k from met)),"
    r" occ as (select cluster_id, doc_id, chapter_id, ord, mention_type, span, pid, start_char, cast(row_number() over (partition by cluster_id, span, doc_id, chapter_id, pid order by start_char) as int) as occ from spot where not regexp_matches(case when start_char = 0 then '' else substr(text, start_char, 1) end, '[\p{L}\p{N}]') and not regexp_matches(substr(text, start_char + length(span) + 1, 1), '[\p{L}\p{N}]'))"
)
RULES = (
    "kinds as (select doc_id, chapter_id, pid, text, unnest([{'t': 'cast', 's': regexp_extract_all(text, '" + S.CAST + "', 0)}, {'t': 'place', 's': regexp_extract_all(text, '" + S.PLACE + "', 1)}, {'t': 'time', 's': regexp_extract_all(text, '" + S.TIME + "', 1)}]) as k from para),"
    r" found as (select doc_id, chapter_id, pid, mention_type, span, trim(regexp_replace(lower(trim(span)), '^(the|a|an)\s+', '')) as plain, strpos(text, span) - 1 as start_char from (select distinct doc_id, chapter_id, pid, text, k.t as mention_type, unnest(k.s) as span from kinds)),"
    " numbered as (select *, cast(row_number() over (partition by doc_id, chapter_id order by first_pid, mention_type, plain) as int) as ord from (select doc_id, chapter_id, mention_type, plain, min(pid) as first_pid from found group by all)),"
    " occ as (select f.*, n.ord from found f join numbered n using (doc_id, chapter_id, mention_type, plain))"
)
_KIND = "{{'t': '{t}', 'm': regexp_extract_all(text, '{p}', 0), 's': regexp_extract_all(text, '{p}', {g}), 'p': string_split_regex(text, '{p}')}}"
EVERY = (
    "kinds as (select doc_id, chapter_id, pid, unnest([" + ", ".join(_KIND.format(t=t, p=p, g=g) for t, p, g in (("cast", S.CAST, 0), ("place", S.PLACE, 1), ("time", S.TIME, 1))) + "]) as k from para),"
    r" found as (select doc_id, chapter_id, pid, k.t as mention_type, k.s[i] as span, trim(regexp_replace(lower(trim(k.s[i])), '^(the|a|an)\s+', '')) as plain, length(array_to_string(k.p[1:i], '')) + length(array_to_string(k.m[1:i], '')) - length(k.s[i]) as start_char from (select *, unnest(range(1, len(k.m) + 1)) as i from kinds)),"
    + RULES[RULES.index(" numbered as (") :]
)
_BESIDE = {"b": "case when start_char = 0 then '' else substr(text, start_char, 1) end", "a": "substr(text, start_char + length(span) + 1, 1)"}
LOCATED = (
    OCC[: OCC.index(" occ as (")]
    + rf" given as (select o.doc_id, o.chapter_id, o.ord, o.mention_type, o.span, coalesce(trim(regexp_replace(lower(trim(c.cluster_name)), '^(the|a|an)\s+', '')), trim(regexp_replace(lower(trim(o.span)), '^(the|a|an)\s+', ''))) as plain, o.pid, o.start_char from spot o join clus c using (cluster_id)"
    rf" where not (regexp_matches({_BESIDE['b']}, '[\p{{L}}\p{{N}}]') and not regexp_matches({_BESIDE['b']}, '[{S.UNPARTED}]')) and not (regexp_matches({_BESIDE['a']}, '[\p{{L}}\p{{N}}]') and not regexp_matches({_BESIDE['a']}, '[{S.UNPARTED}{S.PARTICLES}]'))), "
    + EVERY.replace(" occ as (", " ruled as (")
    + ", tops as (select doc_id, chapter_id, max(ord) + 1 as top from clus group by all),"
    " known as (select doc_id, chapter_id, mention_type, plain, min(ord) as known from given group by all),"
    " more as (select * from ruled r where not exists (select 1 from given g where g.doc_id = r.doc_id and g.chapter_id = r.chapter_id and g.pid = r.pid and g.mention_type = r.mention_type and r.start_char < g.start_char + length(g.span) and g.start_char < r.start_char + length(r.span))),"
    " occ as (select doc_id, chapter_id, ord, mention_type, span, plain, pid, start_char from given union all select r.doc_id, r.chapter_id, coalesce(k.known, r.ord + coalesce(t.top, 0)), r.mention_type, r.span, r.plain, r.pid, r.start_char from more r left join known k using (doc_id, chapter_id, mention_type, plain) left join tops t using (doc_id, chapter_id))"
)
_EID = "concat('ent_', lpad(cast({o} as varchar), cast(greatest(3, length(cast({o} as varchar))) as int), '0'))"
SCORES = (
    "seen as (select distinct doc_id, chapter_id, pid, ord from occ where mention_type = 'place'), many as (select doc_id, chapter_id, ord, count(*) as paragraphs from seen group by all),"
    rf" prep as (select distinct o.doc_id, o.chapter_id, o.pid, o.ord from occ o join para p using (doc_id, chapter_id, pid) where o.mention_type = 'place' and regexp_matches(lower(p.text), concat('\b({'|'.join(X.SPATIAL)})\s+(the\s+)?', regexp_escape(lower(o.span))))),"
    " scores as (select s.doc_id, s.chapter_id, s.pid, s.ord, 1.0::double + case when a.ord is null then 0 else 1 end + case when b.ord is null then 0 else 1 end + case when m.paragraphs >= 2 then 0.5 else 0 end + case when r.ord is null then 0 else 1 end as score from seen s"
    " left join seen a on a.doc_id = s.doc_id and a.chapter_id = s.chapter_id and a.pid = s.pid - 1 and a.ord = s.ord left join seen b on b.doc_id = s.doc_id and b.chapter_id = s.chapter_id and b.pid = s.pid + 1 and b.ord = s.ord"
    " join many m on m.doc_id = s.doc_id and m.chapter_id = s.chapter_id and m.ord = s.ord left join prep r on r.doc_id = s.doc_id and r.chapter_id = s.chapter_id and r.pid = s.pid and r.ord = s.ord)"
)
ACTIVE = (
    f"reach as (select distinct p.doc_id, p.chapter_id, p.pid, {_EID.format(o='o.ord')} as eid from para p join occ o on o.doc_id = p.doc_id and o.chapter_id = p.chapter_id and o.mention_type = 'cast' and o.pid between p.pid - 2 and p.pid),"
    " act0 as (select p.doc_id, p.chapter_id, p.pid, coalesce(l.active, []) as active from para p left join (select doc_id, chapter_id, pid, list(eid order by eid) as active from reach group by all) l using (doc_id, chapter_id, pid)),"
    " act1 as (select *, coalesce(lag(active) over (partition by doc_id, chapter_id order by pid), []) as prev from act0),"
    " act as (select doc_id, chapter_id, pid, active, list_filter(active, lambda x: not list_contains(prev, x)) as entered, list_filter(prev, lambda x: not list_contains(active, x)) as exited from act1)"
)
TRACK = (
    f"best as (select doc_id, chapter_id, pid, {_EID.format(o='ord')} as best, score from (select *, row_number() over (partition by doc_id, chapter_id, pid order by score desc, ord) as rn from scores) where rn = 1),"
    " seq as (select p.doc_id, p.chapter_id, p.pid, b.best, b.score, row_number() over (partition by p.doc_id, p.chapter_id order by p.pid) as rn from para p left join best b using (doc_id, chapter_id, pid)),"
    " track as (select doc_id, chapter_id, pid, rn, case when score >= 2 then best end as cur, case when best is not null then pid end as last, case when score >= 2 then best end as place, case when score >= 2 then best end as place_set, cast(null as varchar) as shift_from, cast(null as varchar) as shift_to from seq where rn = 1"
    " union all select s.doc_id, s.chapter_id, s.pid, s.rn, case when s.best is not null and ((t.cur is null and s.score >= 2) or (t.cur is not null and s.best <> t.cur and s.score >= 3)) then s.best else t.cur end, case when s.best is not null then s.pid else t.last end,"
    " case when s.best is not null then case when t.cur is null then case when s.score >= 2 then s.best end when s.best <> t.cur and s.score >= 3 then s.best else t.cur end when t.cur is not null and s.pid - t.last <= 1 then t.cur end,"
    " case when s.best is not null and t.cur is null and s.score >= 2 then s.best end, case when s.best is not null and t.cur is not null and s.best <> t.cur and s.score >= 3 then t.cur end, case when s.best is not null and t.cur is not null and s.best <> t.cur and s.score >= 3 then s.best end"
    " from track t join seq s on s.doc_id = t.doc_id and s.chapter_id = t.chapter_id and s.rn = t.rn + 1)"
)
FRAMES = (
    "tim as (select doc_id, chapter_id, pid, list(distinct span order by span) as times from occ where mention_type = 'time' group by all),"
    " fr as (select a.doc_id, a.chapter_id, a.pid, a.active, a.entered, a.exited, t.place, t.place_set, t.shift_from, t.shift_to, coalesce(m.times, []) as times, length(p.text) - length(replace(p.text, ';', '')) < 10 as narrative from act a join track t using (doc_id, chapter_id, pid) join para p using (doc_id, chapter_id, pid) left join tim m using (doc_id, chapter_id, pid))"
)
BOUNDS = (
    "nf as (select *, lag(place) over w as p_place, lag(active) over w as p_active, row_number() over w as rn, coalesce(max(case when place is not null then 1 else 0 end) over (partition by doc_id, chapter_id order by pid rows between unbounded preceding and 2 preceding), 0) = 1 as had from fr where narrative window w as (partition by doc_id, chapter_id order by pid)),"
    " nu as (select *, len(list_distinct(list_concat(p_active, active))) as u, len(list_intersect(p_active, active)) as i from nf where rn > 1), nd as (select *, case when u > 0 then 1.0::double - i / u else 0 end as delta, u - 2 * i as turnover from nu),"
    " bounds as (select doc_id, chapter_id, pid, (case when p_place <> place then 4.0 when p_place is null and place is not null and had then 2.0 else 0.0 end + case when delta >= 0.75 and turnover >= 2 then 2.0 when delta >= 0.5 and turnover >= 1 then 1.0 else 0.0 end + case when len(times) > 0 then 1.0 else 0.0 end)::double as score, round(delta, 6) as delta, cast(turnover as int) as turnover from nd)"
)
RESOLVED = (
    "cand as (select *, row_number() over (partition by doc_id, chapter_id order by pid) as rn from bounds where score >= 3),"
    " rsv as (select doc_id, chapter_id, rn, [{'pid': pid, 'score': score}] as kept from cand where rn = 1 union all select c.doc_id, c.chapter_id, c.rn, case when c.pid - r.kept[-1].pid <= 1 then case when c.score > r.kept[-1].score then list_append(r.kept[1:len(r.kept) - 1], {'pid': c.pid, 'score': c.score}) else r.kept end else list_append(r.kept, {'pid': c.pid, 'score': c.score}) end"
    " from rsv r join cand c on c.doc_id = r.doc_id and c.chapter_id = r.chapter_id and c.rn = r.rn + 1),"
    " res as (select doc_id, chapter_id, k.pid as pid, k.score as score, case when k.score >= 4 then 'scene_boundary' else 'weak_boundary_candidate' end as label from (select doc_id, chapter_id, unnest(kept) as k from (select *, row_number() over (partition by doc_id, chapter_id order by rn desc) as d from rsv) where d = 1))"
)
SCENES = (
    "tell as (select doc_id, chapter_id, coalesce(list(pid order by pid) filter (where narrative), []) as narr from fr group by all), mk as (select doc_id, chapter_id, list(pid order by pid) as bs, map_from_entries(list((pid, score))) as sc from res where label = 'scene_boundary' group by all),"
    " enf as (select t.doc_id, t.chapter_id, t.narr, coalesce(m.bs, []) as bs, m.sc, 0 as it from tell t left join mk m using (doc_id, chapter_id) union all select doc_id, chapter_id, narr, list_filter(bs, lambda b: b <> gone), sc, it + 1 from (select *,"
    " case when short = 1 then bs[1] when short > len(bs) then bs[short - 1] when sc[bs[short - 1]] <= sc[bs[short]] then bs[short - 1] else bs[short] end as gone from (select *, list_filter(range(1, len(bs) + 2), lambda i: len(list_filter(narr, lambda p: p >= (list_concat([narr[1]], bs))[i] and p <= (list_concat(list_transform(bs, lambda b: b - 1), [narr[-1]]))[i])) < 2)[1] as short from enf where len(bs) > 0) where short is not null)),"
    " fin as (select * from (select *, row_number() over (partition by doc_id, chapter_id order by it desc) as d from enf) where d = 1),"
    " st as (select doc_id, chapter_id, narr, unnest(range(1, len(bs) + 2)) as scene_no, case when len(narr) = 0 then [0] else list_concat([narr[1]], bs) end as starts from fin),"
    " sc as (select doc_id, chapter_id, cast(scene_no as int) as scene_no, cast(starts[scene_no] as int) as start_pid, cast(case when len(narr) = 0 then 0 when scene_no = len(starts) then narr[-1] else list_max(list_filter(narr, lambda p: p < starts[scene_no + 1])) end as int) as end_pid, concat('scene_', lpad(cast(scene_no as varchar), cast(greatest(2, length(cast(scene_no as varchar))) as int), '0')) as scene_id from st)"
)
_FIRSTS = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"
PACKETS = (
    "ins as (select s.doc_id, s.chapter_id, s.scene_no, f.pid, f.active, f.place, f.times, p.text from sc s join fr f on f.doc_id = s.doc_id and f.chapter_id = s.chapter_id and f.narrative and f.pid between s.start_pid and s.end_pid join para p on p.doc_id = f.doc_id and p.chapter_id = f.chapter_id and p.pid = f.pid),"
    " told0 as (select doc_id, chapter_id, scene_no, list(pid order by pid) as pids, flatten(list(active order by pid)) as c, coalesce(list(place order by pid) filter (where place is not null), []) as pl, flatten(list(times order by pid)) as tm, array_to_string(list(concat('[P', pid, '] ', text) order by pid), chr(10) || chr(10)) as scene_text, min_by(text, pid) as first_text from ins group by all),"
    f" told as (select doc_id, chapter_id, scene_no, pids, {_FIRSTS.format(l='c')} as cast_union, {_FIRSTS.format(l='pl')} as places, {_FIRSTS.format(l='tm')} as time_signals, scene_text, first_text from told0),"
    " weak as (select s.doc_id, s.chapter_id, s.scene_no, list(r.pid order by r.pid) as phase_markers from sc s join res r on r.doc_id = s.doc_id and r.chapter_id = s.chapter_id and r.label = 'weak_boundary_candidate' and r.pid > s.start_pid and r.pid <= s.end_pid group by all),"
    " pk as (select s.*, lag(scene_id) over w as previous_scene, lead(scene_id) over w as next_scene, coalesce(t.pids, []) as pids, coalesce(t.cast_union, []) as cast_union, coalesce(t.places, []) as places, coalesce(t.time_signals, []) as time_signals, coalesce(k.phase_markers, []) as phase_markers, t.scene_text, t.first_text from sc s left join told t using (doc_id, chapter_id, scene_no) left join weak k using (doc_id, chapter_id, scene_no) window w as (partition by s.doc_id, s.chapter_id order by s.scene_no))"
)
STAGES = [RULES, SCORES, ACTIVE, TRACK, FRAMES, BOUNDS, RESOLVED, SCENES, PACKETS]


def upto(stage: str, select: str, more: str = "") -> str:
    """The SQL of all steps up to one, and a selection from it."""
    steps = [OCC] if stage == OCC else STAGES[: STAGES.index(stage) + 1]
    return "with recursive " + ", ".join([PARA, CLUS, *steps]) + more + " " + select


def located(sql: str) -> str:
    """The SQL of steps fed by the located clusters, from that of the same steps fed by rule."""
    return sql.replace(RULES, LOCATED)


def every(sql: str) -> str:
    """The SQL of steps fed by every match of the rules, from that of the same steps fed by rule."""
    return sql.replace(RULES, EVERY)


class Chapter:
    """The steps over one set of tables, each built on the ones before; fed by rule, by every match of the rules, or by the located clusters.

    The texts are read once, into notes; only the text of whole scenes and the given clusters' spans read them again.
    """

    def __init__(self, spark, sf_dir, located=False, every=False):
        self.para = S.paragraphs(table(spark, sf_dir, "paragraphs"))
        self.clus = S.clusters(table(spark, sf_dir, "mention_clusters"))
        self.located, self.every = located, every

    @cached_property
    def occ(self):
        return S.occurrences(self.clus, self.para)

    @cached_property
    def notes(self):
        return cut(S.notes(self.para, self.located or self.every))

    @cached_property
    def said(self):
        by_rule = S.mentions(self.notes)
        return cut(S.located_mentions(self.clus, self.para, by_rule) if self.located else by_rule)

    @cached_property
    def frames(self):
        """The frames, written once: boundaries, scenes and packets all read them."""
        return cut(S.frames(self.said, self.notes))

    @cached_property
    def resolved(self):
        return S.resolved(S.boundaries(self.frames))

    @cached_property
    def scenes(self):
        return cut(S.scenes(self.frames, self.resolved))

    def packets(self):
        return S.packets(self.scenes, self.frames, self.resolved, self.notes)


@query(upto(OCC, "select cluster_id, pid, span, start_char, occ from occ"))
def f10_mention_occurrences(spark, sf_dir):
    return Chapter(spark, sf_dir).occ.select("cluster_id", "pid", "span", F.col("start_char").cast("long"), "occ")


@query(upto(OCC, "select cluster_id, span, min_by({'pid': pid, 'start_char': start_char}, {'pid': pid, 'start_char': start_char}).pid as pid, min_by(start_char, {'pid': pid, 'start_char': start_char}) as start_char from occ group by cluster_id, span"))
def f10_first_location(spark, sf_dir):
    first = Chapter(spark, sf_dir).occ.groupBy("cluster_id", "span").agg(F.min(F.struct("pid", "start_char")).alias("at"))
    return first.select("cluster_id", "span", "at.pid", F.col("at.start_char").cast("long").alias("start_char"))


@query(
    upto(
        OCC,
        "select s.cluster_id, s.span, case when not exists (select 1 from met m where m.cluster_id = s.cluster_id and m.span = s.span) then 'not_in_text' when not exists (select 1 from occ o where o.cluster_id = s.cluster_id and o.span = s.span) then 'inside_word' when length(trim(s.span)) = 0 then 'empty' else 'valid' end as verdict from span s",
    )
)
def c09_mention_verdicts(spark, sf_dir):
    """Why a span is no mention: nowhere in its chapter, or only inside longer words."""
    c = Chapter(spark, sf_dir)
    spans = c.clus.select("cluster_id", *CH, F.explode("raw_spans").alias("span")).where("span <> ''").distinct()
    some = S._spots(c.clus, c.para).select("cluster_id", "span", F.lit(True).alias("somewhere")).distinct()
    alone = c.occ.select("cluster_id", "span", F.lit(True).alias("alone")).distinct()
    out = spans.join(some, ["cluster_id", "span"], "left").join(alone, ["cluster_id", "span"], "left")
    return out.select("cluster_id", "span", F.when(F.col("somewhere").isNull(), "not_in_text").when(F.col("alone").isNull(), "inside_word").when(F.length(F.trim("span")) == 0, "empty").otherwise("valid").alias("verdict"))


@query(upto(RULES, "select doc_id, chapter_id, ord, mention_type, span, pid, start_char from occ"))
def e00_rule_mentions(spark, sf_dir):
    """What the offline extractor finds."""
    return Chapter(spark, sf_dir).said.select(*CH, "ord", "mention_type", "span", "pid", F.col("start_char").cast("long"))


@query(every(upto(RULES, "select doc_id, chapter_id, ord, mention_type, span, pid, start_char from occ")))
def e00_rule_occurrences(spark, sf_dir):
    """What the offline extractor finds, every match at its own offset."""
    return Chapter(spark, sf_dir, every=True).said.select(*CH, "ord", "mention_type", "span", "pid", F.col("start_char").cast("long"))


@query(upto(OCC, "select doc_id, chapter_id, pid, mention_type, count(*) as mentions, count(distinct cluster_id) as entities from occ group by all"))
def a02_mentions_per_paragraph(spark, sf_dir):
    return Chapter(spark, sf_dir).occ.groupBy(*CH, "pid", "mention_type").agg(F.count("*").alias("mentions"), F.count_distinct("cluster_id").alias("entities"))


@query(upto(OCC, "select cluster_id, count(distinct pid) as paragraphs, min(pid) as first_pid, min_by(span, (pid, start_char)) as first_span from occ where mention_type = 'place' group by cluster_id"))
def a03_place_paragraphs(spark, sf_dir):
    places = Chapter(spark, sf_dir).occ.where("mention_type = 'place'")
    return places.groupBy("cluster_id").agg(F.count_distinct("pid").alias("paragraphs"), F.min("pid").alias("first_pid"), F.min_by("span", F.struct("pid", "start_char")).alias("first_span"))


@query(upto(SCORES, "select * from scores"))
def e07_place_scores(spark, sf_dir):
    return S.place_scores(Chapter(spark, sf_dir).said)


@query(every(upto(SCORES, "select * from scores")))
def e07_every_place_score(spark, sf_dir):
    """e07_place_scores with every match read, so a preposition before any of them counts."""
    return S.place_scores(Chapter(spark, sf_dir, every=True).said)


@query(upto(ACTIVE, "select doc_id, chapter_id, pid, active from act"))
def w02_active_cast(spark, sf_dir):
    c = Chapter(spark, sf_dir)
    return S.active_cast(c.said, c.notes).select(*CH, "pid", "active")


@query(upto(ACTIVE, "select doc_id, chapter_id, pid, entered, exited from act where len(entered) > 0 or len(exited) > 0"))
def w03_cast_enter_exit(spark, sf_dir):
    c = Chapter(spark, sf_dir)
    return S.active_cast(c.said, c.notes).where("size(entered) > 0 or size(exited) > 0").select(*CH, "pid", "entered", "exited")


@query(upto(TRACK, "select doc_id, chapter_id, pid, place, place_set, shift_from, shift_to from track"))
def e08_place_tracker(spark, sf_dir):
    c = Chapter(spark, sf_dir)
    return S.place_states(S.place_scores(c.said), c.notes)


@query(upto(FRAMES, "select doc_id, chapter_id, pid, active, place, times, narrative from fr"))
def e06_state_frames(spark, sf_dir):
    return Chapter(spark, sf_dir).frames.select(*CH, "pid", "active", "place", "times", "narrative")


@query(upto(FRAMES, "select doc_id, chapter_id, count(*) as frames, cast(count(*) filter (where narrative) as bigint) as narrative_frames, cast(count(*) filter (where place is not null) as bigint) as placed_frames from fr group by all"))
def a05_frame_counts(spark, sf_dir):
    return Chapter(spark, sf_dir).frames.groupBy(*CH).agg(F.count("*").alias("frames"), F.count_if("narrative").alias("narrative_frames"), F.count("place").alias("placed_frames"))


@query(upto(BOUNDS, "select * from bounds where score > 0"))
def e09_boundary_scores(spark, sf_dir):
    return S.boundaries(Chapter(spark, sf_dir).frames).where("score > 0")


@query(upto(RESOLVED, "select * from res"))
def e10_resolve_competing(spark, sf_dir):
    return Chapter(spark, sf_dir).resolved


@query(upto(SCENES, "select doc_id, chapter_id, scene_id, start_pid, end_pid from sc"))
def e11_scene_spans(spark, sf_dir):
    return Chapter(spark, sf_dir).scenes.select(*CH, "scene_id", "start_pid", "end_pid")


@query(upto(PACKETS, "select doc_id, chapter_id, scene_id, pids, cast_union, places, time_signals from pk"))
def a01_scene_aggregates(spark, sf_dir):
    return Chapter(spark, sf_dir).packets().select(*CH, "scene_id", "pids", "cast_union", "places", "time_signals")


@query(upto(PACKETS, "select doc_id, chapter_id, scene_id, phase_markers, previous_scene, next_scene from pk"))
def j05_phase_markers(spark, sf_dir):
    return Chapter(spark, sf_dir).packets().select(*CH, "scene_id", "phase_markers", "previous_scene", "next_scene")


@query(upto(PACKETS, "select doc_id, chapter_id, scene_id, scene_text from pk"))
def p05_scene_text(spark, sf_dir):
    c = Chapter(spark, sf_dir)
    return S.scene_texts(c.scenes, c.frames, c.para)


@query(upto(PACKETS, "select doc_id, chapter_id, scene_id, start_pid, end_pid, len(pids) as n_paragraphs, len(cast_union) as n_cast, places[1] as first_place, time_signals[1] as first_time from pk"))
def e2e_scene_summary(spark, sf_dir):
    """Scene boundaries and a summary of every scene: the flagship."""
    return _summary(Chapter(spark, sf_dir).packets())


def _summary(p):
    return p.select(*CH, "scene_id", "start_pid", "end_pid", F.size("pids").cast("long").alias("n_paragraphs"), F.size("cast_union").cast("long").alias("n_cast"), F.get("places", F.lit(0)).alias("first_place"), F.get("time_signals", F.lit(0)).alias("first_time"))


@query(located(upto(RULES, "select doc_id, chapter_id, ord, mention_type, span, pid, start_char from occ")))
def e00_located_mentions(spark, sf_dir):
    """The located clusters in all languages, and what the rules find besides."""
    return Chapter(spark, sf_dir, located=True).said.select(*CH, "ord", "mention_type", "span", "pid", F.col("start_char").cast("long"))


@query(located(upto(FRAMES, "select doc_id, chapter_id, pid, active, place, times, narrative from fr")))
def e06_located_frames(spark, sf_dir):
    return Chapter(spark, sf_dir, located=True).frames.select(*CH, "pid", "active", "place", "times", "narrative")


@query(located(upto(PACKETS, "select doc_id, chapter_id, scene_id, pids, cast_union, places, time_signals from pk")))
def a01_located_scenes(spark, sf_dir):
    return Chapter(spark, sf_dir, located=True).packets().select(*CH, "scene_id", "pids", "cast_union", "places", "time_signals")


@query(located(upto(PACKETS, "select doc_id, chapter_id, scene_id, start_pid, end_pid, len(pids) as n_paragraphs, len(cast_union) as n_cast, places[1] as first_place, time_signals[1] as first_time from pk")))
def e2e_located_summary(spark, sf_dir):
    """e2e_scene_summary over chapters of every language."""
    return _summary(Chapter(spark, sf_dir, located=True).packets())


@query(upto(SCENES, "select o.doc_id, o.chapter_id, o.pid, o.span, min(s.scene_id) as scene_id from occ o join sc s on s.doc_id = o.doc_id and s.chapter_id = o.chapter_id and o.pid between s.start_pid and s.end_pid group by all"))
def j04_pid_to_scene_range(spark, sf_dir):
    """The first scene whose closed range holds a mention's paragraph; an interval join inside the chapter."""
    c = Chapter(spark, sf_dir)
    return c.said.join(c.scenes, CH).where(F.col("pid").between(F.col("start_pid"), F.col("end_pid"))).groupBy(*CH, "pid", "span").agg(F.min("scene_id").alias("scene_id"))


@query(
    upto(
        PACKETS,
        f"select k.doc_id, k.chapter_id, k.scene_id, map_from_entries(list((c.plain, {_EID.format(o='c.ord')}) order by c.plain)) as registry from pk k join (select doc_id, chapter_id, plain, min(ord) as ord from occ group by all) c on c.doc_id = k.doc_id and c.chapter_id = k.chapter_id and (list_contains(k.cast_union, {_EID.format(o='c.ord')}) or list_contains(k.places, {_EID.format(o='c.ord')})) group by all",
    )
)
def j14_entity_registry(spark, sf_dir):
    """Names of the cast and places of a scene with their entity ids; of equal names the first entity counts."""
    c = Chapter(spark, sf_dir)
    names = c.said.groupBy(*CH, "plain").agg(F.min("ord").alias("ord")).select(*CH, "plain", S.entity_id().alias("eid"))
    ids = c.packets().select(*CH, "scene_id", F.explode(F.array_union("cast_union", "places")).alias("eid"))
    return ids.join(names, [*CH, "eid"]).groupBy(*CH, "scene_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("plain", "eid")))).alias("registry"))


_PRON = ", ".join(f"'{p}'" for p in X.PRONOUNS)


@query(
    rf"with {CLUS}, n as (select distinct cluster_id, s as span, trim(regexp_replace(lower(trim(s)), '^(the|a|an)\s+', '')) as plain from (select cluster_id, unnest(raw_spans) as s from clus)) select cluster_id, span, plain, plain in ({_PRON}) as pronoun from n"
)
def f07_normal_spans(spark, sf_dir):
    spans = S.clusters(table(spark, sf_dir, "mention_clusters")).select("cluster_id", F.explode("raw_spans").alias("span")).distinct()
    return spans.select("cluster_id", "span", X.plain_span("span").alias("plain"), X.plain_span("span").isin(*X.PRONOUNS).alias("pronoun"))


@query(
    f"with {CLUS}, s as (select cluster_id, unnest(raw_spans) as span, generate_subscripts(raw_spans, 1) as i from clus), p as (select *, lower(trim(span)) in ({_PRON}) as pron from s) select cluster_id, max_by(span, (not pron, length(span), -i)) as canonical from p group by cluster_id"
)
def f09_canonical_names(spark, sf_dir):
    """The longest span that is no pronoun, the first of equals."""
    s = S.clusters(table(spark, sf_dir, "mention_clusters")).select("cluster_id", F.posexplode("raw_spans").alias("i", "span"))
    rank = F.struct((~F.lower(F.trim("span")).isin(*X.PRONOUNS)).alias("named"), F.length("span").alias("n"), (-F.col("i")).alias("first"))
    return s.groupBy("cluster_id").agg(F.max_by("span", rank).alias("canonical"))


_SIM = (
    "case when a = b then 1.0 when length(a) < 2 or length(b) < 2 then 0.0 when contains(lo, sh) then length(sh) / length(lo)::double else 2.0::double * len(list_filter(range(1, length(sh)), lambda i: contains(lo, substr(sh, i, 2)))) / (length(lo) + length(sh) - 2) end"
)


@query(
    f"with {CLUS}, t as (select x.cluster_id as id_a, y.cluster_id as id_b, x.cluster_name as a, y.cluster_name as b, case when length(x.cluster_name) > length(y.cluster_name) then x.cluster_name else y.cluster_name end as lo, case when length(x.cluster_name) > length(y.cluster_name) then y.cluster_name else x.cluster_name end as sh from clus x join clus y on x.doc_id = y.doc_id and x.chapter_id = y.chapter_id and x.mention_type = y.mention_type and x.ord < y.ord)"
    f" select id_a, id_b, round({_SIM}, 6) as similarity from t"
)
def f08_bigram_similarity(spark, sf_dir):
    """Similarity of the names of one kind in one chapter."""
    c = S.clusters(table(spark, sf_dir, "mention_clusters"))
    pair = c.alias("x").join(c.alias("y"), F.expr("x.doc_id = y.doc_id and x.chapter_id = y.chapter_id and x.mention_type = y.mention_type and x.ord < y.ord"))
    return pair.select(F.col("x.cluster_id").alias("id_a"), F.col("y.cluster_id").alias("id_b"), F.round(X.bigram_similarity("x.cluster_name", "y.cluster_name"), 6).alias("similarity"))


def _fold_clusters(rows):
    kept = []
    for span, ident in rows:
        name = span
        hit = next((c for c in kept if name == c[0] or len(name) > 4 and _similar(name, c[0]) > 0.8), None)
        if hit:
            hit[1].append(ident)
        else:
            kept.append((name, [ident]))
    return kept


def _similar(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if min(len(a), len(b)) < 2:
        return 0.0
    lo, sh = (a, b) if len(a) > len(b) else (b, a)
    if sh in lo:
        return len(sh) / len(lo)
    return 2 * sum(sh[i : i + 2] in lo for i in range(len(sh) - 1)) / (len(lo) + len(sh) - 2)


@query()
def e04_entity_clusters(spark, sf_dir):
    """Greedy grouping of the names of a chapter and kind, in order: the first group whose first name is equal or more than 0.8 similar takes it."""
    names = S.clusters(table(spark, sf_dir, "mention_clusters")).select(*CH, "mention_type", "ord", "cluster_id", X.plain_span("cluster_name").alias("plain")).where(~F.col("plain").isin(*X.PRONOUNS) | (F.col("mention_type") != "cast"))

    def group(rows):
        import pandas as pd

        out = []
        for k, (name, ids) in enumerate(_fold_clusters(rows.sort_values(["ord", "cluster_id"])[["plain", "cluster_id"]].itertuples(index=False, name=None))):
            out += [(rows["doc_id"].iat[0], rows["chapter_id"].iat[0], rows["mention_type"].iat[0], k, name, i) for i in ids]
        return pd.DataFrame(out, columns=["doc_id", "chapter_id", "mention_type", "group_no", "name", "cluster_id"])

    return names.groupBy(*CH, "mention_type").applyInPandas(group, "doc_id string, chapter_id string, mention_type string, group_no int, name string, cluster_id long")


@query(upto(TRACK, "select doc_id, chapter_id, pid, last_value(place ignore nulls) over (partition by doc_id, chapter_id order by pid rows between unbounded preceding and 1 preceding) as last_place from track"))
def j07_last_place(spark, sf_dir):
    """As-of: the last place known before each paragraph."""
    c = Chapter(spark, sf_dir)
    w = Window.partitionBy(*CH).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return S.place_states(S.place_scores(c.said), c.notes).select(*CH, "pid", F.last("place", ignorenulls=True).over(w).alias("last_place"))
