"""Queries over book memory, claims and the knowledge graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabulary.functions import text as X
from fabulary.plans import book as B
from fabulary.plans import graph as G
from fabulary.queries import query
from fabulary.queries.reader import EV, MEM, Support
from fabulary.queries.story import _EID, PACKETS, RULES, every, located, upto
from fabulary.session import cut, table

_KEY = "regexp_replace(regexp_replace(lower(trim({c})), '[^a-z0-9가-힣]+', '_', 'g'), '^_+|_+$', '', 'g')"
_IDX = "cast(nullif(regexp_extract(chapter_id, '(\\d+)', 1), '') as int)"
REFS = MEM + EV + (
    ", ec as (select doc_id, chapter_id, scene_no, (list(action order by n))[1:4] as actions, max_by(causal_result, n) filter (where causal_result is not null) as cause from ev group by all)"
    f", nm as (select doc_id, chapter_id, {_EID.format(o='ord')} as eid, min(plain) as name from occ group by all),"
    f" rf0 as (select m.doc_id, m.chapter_id, {_IDX.replace('chapter_id', 'm.chapter_id')} as idx, m.scene_no, concat(m.chapter_id, ':', m.scene_id) as scene_key, m.start_pid, m.end_pid, p.name as place, coalesce((select list(n.name order by n.eid) from nm n where n.doc_id = m.doc_id and n.chapter_id = m.chapter_id and list_contains(m.active_cast, n.eid)), []) as active_names, m.summary, coalesce(c.actions, []) as actions, c.cause from ms m left join ec c on c.doc_id = m.doc_id and c.chapter_id = m.chapter_id and c.scene_no = m.scene_no left join nm p on p.doc_id = m.doc_id and p.chapter_id = m.chapter_id and p.eid = m.place),"
    " rf as (select *, cast(row_number() over (partition by doc_id order by idx, start_pid, scene_key) as int) as place_no from rf0)"
)
_ROW = "select doc_id, p.scene_key as from_key, f.scene_key as to_key, '{t}' as type, {w}::double as weight, {l} as label from bd where {c}"
BEDGES = (
    ", bd as (select doc_id, chapter_id, f, lag(l) over (partition by doc_id order by idx, chapter_id) as p from (select doc_id, chapter_id, idx, min_by({'scene_key': scene_key, 'place': place, 'active_names': active_names, 'actions': actions, 'cause': cause}, scene_no) as f, max_by({'scene_key': scene_key, 'place': place, 'active_names': active_names, 'actions': actions, 'cause': cause}, scene_no) as l from rf group by all)), be0 as ("
    + " union all ".join(
        _ROW.format(t=t, w=B.WEIGHTS[t], c="p is not null and " + c, l=label)
        for t, c, label in [
            ("chapter_sequence", "true", "concat(p.scene_key, ' -> ', f.scene_key)"),
            ("cross_chapter_character_thread", "len(list_intersect(f.active_names, p.active_names)) > 0", "concat('continued cast: ', array_to_string(list_filter(f.active_names, lambda x: list_contains(p.active_names, x))[1:4], ', '))"),
            ("cross_chapter_same_place", "p.place = f.place", "concat('same place continues: ', f.place)"), ("cross_chapter_place_shift", "p.place <> f.place", "concat(p.place, ' -> ', f.place)"),
            ("cross_chapter_causal_bridge", "p.cause is not null and len(f.actions) > 0", "concat(p.cause, ' -> ', f.actions[1])"),
        ]
    )
    + "), be as (select *, concat('book_edge_', substr(sha256(concat_ws('|', type, doc_id, from_key, to_key)), 1, 24)) as edge_id from be0)"
)
BOCC = (
    f", bo0 as (select doc_id, chapter_id, key, count(*) as mentions, min(pid) as first_pid from (select *, {_KEY.format(c='plain')} as key from occ where mention_type <> 'time') where key <> '' group by all),"
    f" bo as (select o.*, {_IDX.replace('chapter_id', 'o.chapter_id')} as idx, (select min(r.scene_key) from rf r where r.doc_id = o.doc_id and r.chapter_id = o.chapter_id and o.first_pid between r.start_pid and r.end_pid) as first_scene from bo0 o)"
)
REAP = (
    ", rp as (select doc_id, key, from_key, first_scene as to_key, 'entity_reappearance' as type, 0.66::double as weight, concat(key, ' reappears across chapters') as label, concat('book_edge_', substr(sha256(concat_ws('|', 'entity_reappearance', doc_id, key, from_chapter, chapter_id)), 1, 24)) as edge_id from (select *, lag(first_scene) over w as from_key, lag(chapter_id) over w as from_chapter from bo window w as (partition by doc_id, key order by idx, chapter_id)) where from_key is not null and first_scene is not null)"
)
_SAFE = "substr(regexp_replace({c}, '[^a-zA-Z0-9:_-]', '_', 'g'), 1, 180)"
CLAIMS = (
    ", ae as (select doc_id, from_key, to_key, type, weight, label, edge_id from be union all select doc_id, from_key, to_key, type, weight, label, edge_id from rp),"
    " cl0 as (select doc_id, scene_key, 'state' as claim_type, summary as claim, 0.74::double as confidence, '' as more from rf where coalesce(summary, '') <> '' union all select doc_id, scene_key, 'place', concat('Current place: ', place), 0.78::double, '' from rf where place is not null"
    " union select doc_id, scene_key, 'event', a, 0.68::double, concat(':', a) from (select doc_id, scene_key, unnest(actions) as a from rf)),"
    f" cl as (select doc_id, scene_key, claim_type, claim, confidence, {_SAFE.format(c="concat(concat_ws(':', 'claim', doc_id, scene_key, claim_type), more)")} as claim_id from cl0"
    " union all select doc_id, to_key, case when type = 'cross_chapter_causal_bridge' then 'causal' when type in ('cross_chapter_place_shift', 'cross_chapter_same_place') then 'place' when type in ('cross_chapter_character_thread', 'entity_reappearance') then 'relation' else 'event' end, label, weight, substr(concat('claim:', edge_id), 1, 180) from ae"
    f" union all select doc_id, first_scene, 'relation', concat(key, ' appears in ', chapter_id, '.'), 0.64::double, {_SAFE.format(c="concat_ws(':', 'claim:entity', doc_id, key, chapter_id, first_scene)")} from (select *, row_number() over (partition by doc_id, key order by idx, chapter_id) as nth, count(*) over (partition by doc_id, key) as chapters from bo) where chapters >= 2 and nth <= 12)"
)
ALL = REFS + BEDGES + BOCC + REAP + CLAIMS


def sql(select: str, more: str = ALL) -> str:
    return upto(PACKETS, select, more)


class Book(Support):
    def refs(self):
        """Scenes in reading order with the names of their cast and place."""
        from fabulary.plans.scenes import entity_id

        scenes, events = self.memory()
        names = self.said.groupBy("doc_id", "chapter_id", "ord").agg(F.min("plain").alias("name")).select("doc_id", "chapter_id", entity_id().alias("eid"), "name")
        keys = ["doc_id", "chapter_id", "scene_no"]
        cast = scenes.select(*keys, F.explode("active_cast").alias("eid")).join(names, ["doc_id", "chapter_id", "eid"]).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("eid", "name"))), lambda x: x["name"]).alias("active_names"))
        placed = scenes.select(*keys, F.col("place").alias("eid")).join(names, ["doc_id", "chapter_id", "eid"]).select(*keys, F.col("name").alias("place_name"))
        s = scenes.join(cast, keys, "left").join(placed, keys, "left").drop("place").withColumnRenamed("place_name", "place").withColumn("active_names", F.coalesce("active_names", F.expr("cast(array() as array<string>)")))
        return cut(B.reading_order(B.scene_refs(s, events)))

    def edges(self, refs):
        occ = B.occurrences(self.said, refs)
        return B.boundary_edges(refs).unionByName(B.reappearances(occ).drop("key"))

    def events_by_key(self):
        """Events by their keys in the book."""
        key = lambda c, n: F.concat("chapter_id", F.lit(":"), c).alias(n)
        return self.memory()[1].select("doc_id", "chapter_id", key("scene_id", "scene_key"), key("event_id", "event_key"), "pid", "action", "causal_result")

    def actors(self):
        """Who is named in the paragraph of an event: doc_id, event_key, name."""
        names = self.said.groupBy("doc_id", "chapter_id", "ord").agg(F.min("plain").alias("name"))
        here = self.said.where("mention_type = 'cast'").select("doc_id", "chapter_id", "pid", "ord").distinct().join(names, ["doc_id", "chapter_id", "ord"])
        return self.events_by_key().join(here, ["doc_id", "chapter_id", "pid"]).select("doc_id", "event_key", "name").distinct()

    def claims(self, refs):
        return B.claims(refs, self.edges(refs), B.occurrences(self.said, refs))


@query(sql("select doc_id, scene_key, place_no, place, active_names from rf", REFS))
def p07_scene_refs(spark, sf_dir):
    return Book(spark, sf_dir).refs().select("doc_id", "scene_key", "place_no", "place", "active_names")


@query(sql("select doc_id, from_key, to_key, type, weight, label, edge_id from be", REFS + BEDGES))
def g09_chapter_edges(spark, sf_dir):
    return B.boundary_edges(Book(spark, sf_dir).refs())


@query(sql("select doc_id, key, count(*) as chapters, cast(sum(mentions) as bigint) as mentions, min(idx) as first_idx, max(idx) as last_idx from bo group by all having count(*) >= 2", REFS + BOCC))
def a07_entity_threads(spark, sf_dir):
    b = Book(spark, sf_dir)
    return B.threads(B.occurrences(b.said, b.refs()))


@query(every(sql("select doc_id, key, count(*) as chapters, cast(sum(mentions) as bigint) as mentions, min(idx) as first_idx, max(idx) as last_idx from bo group by all having count(*) >= 2", REFS + BOCC)))
def a07_every_mention(spark, sf_dir):
    """a07_entity_threads with every mention by rule counted."""
    b = Book(spark, sf_dir, every=True)
    return B.threads(B.occurrences(b.said, b.refs()))


def _keyed(sql: str) -> str:
    """Names without a Latin letter, digit or Hangul are their own key."""
    return sql.replace(BOCC, BOCC.replace(f"{_KEY.format(c='plain')} as key", f"coalesce(nullif({_KEY.format(c='plain')}, ''), plain) as key"))


@query(_keyed(located(sql("select doc_id, key, count(*) as chapters, cast(sum(mentions) as bigint) as mentions, min(idx) as first_idx, max(idx) as last_idx from bo group by all having count(*) >= 2", REFS + BOCC))))
def a07_located_threads(spark, sf_dir):
    b = Book(spark, sf_dir, located=True)
    return B.threads(B.occurrences(b.said, b.refs()))


@query(_keyed(located(sql("select doc_id, scene_key, claim_type, claim, confidence, claim_id from cl"))))
def p17_located_claims(spark, sf_dir):
    b = Book(spark, sf_dir, located=True)
    refs = b.refs()
    return b.claims(refs)


@query(sql("select doc_id, key, from_key, to_key, type, weight, edge_id from rp", REFS + BOCC + REAP))
def g10_entity_reappearances(spark, sf_dir):
    b = Book(spark, sf_dir)
    return B.reappearances(B.occurrences(b.said, b.refs())).drop("label")


@query(sql("select doc_id, scene_key, claim_type, claim, confidence, claim_id from cl"))
def p17_claims(spark, sf_dir):
    b = Book(spark, sf_dir)
    refs = b.refs()
    return b.claims(refs)


@query(sql("select a.doc_id, a.edge_id, x.claim_id as from_claim, y.claim_id as to_claim from ae a join cl x on x.doc_id = a.doc_id and x.scene_key = a.from_key and x.claim_type = 'state' join cl y on y.doc_id = a.doc_id and y.scene_key = a.to_key and y.claim_type = 'state'"))
def g11_claim_relations(spark, sf_dir):
    """An edge becomes a relation where both its scenes have a state claim."""
    b = Book(spark, sf_dir)
    refs = b.refs()
    edges = b.edges(refs)
    state = b.claims(refs).where("claim_type = 'state'")
    end = lambda k, n: state.select("doc_id", F.col("scene_key").alias(k), F.col("claim_id").alias(n))
    return edges.join(end("from_key", "from_claim"), ["doc_id", "from_key"]).join(end("to_key", "to_claim"), ["doc_id", "to_key"]).select("doc_id", "edge_id", "from_claim", "to_claim")


@query(
    sql(
        "select c.doc_id, count(*) as total, cast(count(*) filter (where r.place_no <= p.reader) as bigint) as allowed, cast(count(*) filter (where r.place_no > p.reader) as bigint) as removed from cl c join rf r on r.doc_id = c.doc_id and r.scene_key = c.scene_key join (select doc_id, cast(ceil(count(*) / 2.0) as int) as reader from rf group by doc_id) p on p.doc_id = c.doc_id group by c.doc_id"
    )
)
def g12_reader_safe_claims(spark, sf_dir):
    """Per book, for a reader half way through: claims up to the reader's scene, and those held back."""
    b = Book(spark, sf_dir)
    refs = b.refs()
    half = refs.groupBy("doc_id").agg(F.ceil(F.count("*") / 2).cast("int").alias("reader"))
    c = b.claims(refs).join(refs.select("doc_id", "scene_key", "place_no"), ["doc_id", "scene_key"]).join(half, "doc_id")
    allowed = F.count_if(F.col("place_no") <= F.col("reader"))
    return c.groupBy("doc_id").agg(F.count("*").alias("total"), allowed.alias("allowed"), (F.count("*") - allowed).alias("removed"))


_PRIO = "case type " + " ".join(f"when '{t}' then {n}" for t, n in B.PRIORITY.items()) + " end"


@query(sql(f"select doc_id, to_key, edge_id, cast(rn as int) as place from (select *, row_number() over (partition by doc_id, to_key order by {_PRIO}, weight desc, edge_id) as rn from ae) where rn <= 4"))
def t02_edge_priority(spark, sf_dir):
    """The first four edges into every scene, by kind and weight."""
    b = Book(spark, sf_dir)
    rank = F.create_map(*[F.lit(x) for p in B.PRIORITY.items() for x in p])
    w = Window.partitionBy("doc_id", "to_key").orderBy(F.element_at(rank, F.col("type")), F.desc("weight"), "edge_id")
    return b.edges(b.refs()).withColumn("place", F.row_number().over(w)).where("place <= 4").select("doc_id", "to_key", "edge_id", "place")


@query(sql("select doc_id, scene_key, list(scene_key) over (partition by doc_id order by place_no rows between 2 preceding and current row) as nearby, coalesce(list(scene_key) over (partition by doc_id order by place_no rows between 2 preceding and 1 preceding), []) as recap from rf", REFS))
def w11_nearby_scenes(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("place_no")
    recap = F.collect_list("scene_key").over(w.rowsBetween(-2, -1))
    return Book(spark, sf_dir).refs().select("doc_id", "scene_key", F.collect_list("scene_key").over(w.rowsBetween(-2, 0)).alias("nearby"), recap.alias("recap"))


_NID = "concat('kg_node_', substr(sha256(concat_ws('|', {p})), 1, 28))"
KG = (
    f", kr as (select doc_id, {_NID.format(p=chr(39).join(['doc_id, ', 'scene', ', scene_key']))} as node_id, 'scene' as kind, scene_key as label, scene_key, list_concat(list_concat([scene_key], case when place is null then [] else [place] end), active_names) as tags, place_no from rf"
    f" union all select doc_id, {_NID.format(p=chr(39).join(['doc_id, ', 'character', ', ']) + _KEY.format(c='name'))}, 'character', name, scene_key, [name, scene_key], place_no from (select *, unnest(active_names) as name from rf) where {_KEY.format(c='name')} <> ''"
    f" union all select doc_id, {_NID.format(p=chr(39).join(['doc_id, ', 'place', ', ']) + _KEY.format(c='place'))}, 'place', place, scene_key, [place, scene_key], place_no from rf where place is not null and {_KEY.format(c='place')} <> ''),"
    " kt as (select node_id, kind, max_by(label, {'p': place_no, 'l': label}) as label, max_by(scene_key, {'p': place_no, 'l': label}) as scene_key, flatten(list(tags order by place_no, label, tags)) as raw from kr group by node_id, kind),"
    " kn as (select node_id, kind, label, scene_key, list_filter(raw, lambda x, i: trim(x) <> '' and list_position(raw, x) = i) as tags from kt),"
    f" ke as (select distinct * from (select {_NID.format(p=chr(39).join(['doc_id, ', 'scene', ', scene_key']))} as from_id, {_NID.format(p=chr(39).join(['doc_id, ', 'character', ', ']) + _KEY.format(c='name'))} as to_id, 'active_cast' as type from (select *, unnest(active_names) as name from rf) where {_KEY.format(c='name')} <> ''"
    f" union all select {_NID.format(p=chr(39).join(['doc_id, ', 'scene', ', scene_key']))}, {_NID.format(p=chr(39).join(['doc_id, ', 'place', ', ']) + _KEY.format(c='place'))}, 'located_at' from rf where place is not null and {_KEY.format(c='place')} <> ''))"
)


@query(sql("select node_id, kind, label, scene_key, tags from kn", REFS + KG))
def g01_graph_nodes(spark, sf_dir):
    return G.project(Book(spark, sf_dir).refs())[0]


@query(sql("select from_id, to_id, type from ke", REFS + KG))
def g01_graph_edges(spark, sf_dir):
    return G.project(Book(spark, sf_dir).refs())[1]


@query(sql("select e.from_id, e.to_id, e.type from ke e where e.from_id in (select node_id from kn where contains(lower(array_to_string(list_concat([label], tags), ' ')), 'the') or kind = 'place') and e.to_id in (select node_id from kn where contains(lower(array_to_string(list_concat([label], tags), ' ')), 'the') or kind = 'place')", REFS + KG))
def g05_graph_search(spark, sf_dir):
    """The subgraph of places and of nodes whose search text holds a word."""
    nodes, edges = G.project(Book(spark, sf_dir).refs())
    hit = nodes.where((F.col("kind") == "place") | F.contains(F.lower(F.concat_ws(" ", F.array("label"), "tags")), F.lit("the")))
    return G.induced(edges, hit)


_TREE = "select concat('n', n_nationkey) as a, concat('r', n_regionkey) as b from nation union all select concat('s', s_suppkey), concat('n', s_nationkey) from supplier union all select concat('c', c_custkey), concat('n', c_nationkey) from customer"


@query(f"with recursive e as ({_TREE}), u as (select a, b from e union select b, a from e), w as (select 'n3' as node_id, 0 as hops union select u.b, w.hops + 1 from w join u on u.a = w.node_id where w.hops < 2) select node_id, min(hops) as hops from w group by node_id")
def g04_k_hop(spark, sf_dir):
    """All nodes within two undirected steps of one, breadth first."""
    link = lambda t, k, p, q, n: table(spark, sf_dir, t).select(F.concat(F.lit(p), k).alias("from_id"), F.concat(F.lit(q), n).alias("to_id"))
    edges = link("nation", "n_nationkey", "n", "r", "n_regionkey").unionByName(link("supplier", "s_suppkey", "s", "n", "s_nationkey")).unionByName(link("customer", "c_custkey", "c", "n", "c_nationkey"))
    start = spark.createDataFrame([("n3",)], "node_id string")
    return G.neighbourhood(edges, start, 2)


_DAG = " union all ".join(f"select '{a}' as a, '{b}' as b" for a, bs in G.DEPENDENTS.items() for b in bs.split())


@query(f"with recursive d as ({_DAG}), w as (select a as stage, b as dependent from d union select w.stage, d.b from w join d on d.a = w.dependent) select stage, dependent from w")
def g06_stage_descendants(spark, sf_dir):
    return spark.createDataFrame([(s, d) for s in G.DEPENDENTS for d in sorted(G.descendants(s))], "stage string, dependent string")
