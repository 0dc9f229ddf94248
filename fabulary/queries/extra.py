"""Smaller operators: set and list functions, zips, fallbacks, prompt blocks and highlights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fabulary.functions import text as X
from fabulary.plans import scenes as S
from fabulary.queries import query
from fabulary.queries.catalog import OV, overlays
from fabulary.queries.ingest import CANDS, PARA, candidates, paragraphs, squeeze_sql
from fabulary.queries.story import CLUS, OCC, Chapter, upto
from fabulary.session import table

_FIRSTS = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"


@query(f"select doc_id, length({squeeze_sql('text')}) as n, md5({squeeze_sql('text')}) as digest from documents")
def f01_squeezed_texts(spark, sf_dir):
    flat = X.squeeze("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(flat).cast("long").alias("n"), F.md5(flat).alias("digest"))


@query(f"with {CLUS}, t as (select cluster_id, list_filter(list_transform(raw_spans, lambda s: trim(s)), lambda s: s <> '') as l from clus) select cluster_id, {_FIRSTS.format(l='l')} as spans from t")
def d06_unique_spans(spark, sf_dir):
    return S.clusters(table(spark, sf_dir, "mention_clusters")).select("cluster_id", X.unique_strings("raw_spans").alias("spans"))


_CHCAST = f"{CLUS}, c as (select doc_id, chapter_id, list(distinct cluster_name order by cluster_name) as names from clus where mention_type = 'cast' group by all), l as (select *, lag(names) over (partition by doc_id order by chapter_id) as prev from c)"


@query(f"with {_CHCAST}, m as (select *, len(list_distinct(list_concat(prev, names))) as u, len(list_intersect(prev, names)) as i from l where prev is not null) select doc_id, chapter_id, round(1 - i / u::double, 6) as delta, cast(u - 2 * i as int) as turnover from m")
def d05_cast_turnover(spark, sf_dir):
    """How much of the cast changes from chapter to chapter."""
    c = S.clusters(table(spark, sf_dir, "mention_clusters")).where("mention_type = 'cast'").groupBy("doc_id", "chapter_id").agg(F.array_sort(F.collect_set("cluster_name")).alias("names"))
    w = Window.partitionBy("doc_id").orderBy("chapter_id")
    m = c.withColumn("prev", F.lag("names").over(w)).where("prev is not null")
    u, i = F.size(F.array_union("prev", "names")), F.size(F.array_intersect("prev", "names"))
    return m.select("doc_id", "chapter_id", F.round(1 - i / u, 6).alias("delta"), (u - 2 * i).alias("turnover"))


@query(f"with {_CHCAST} select doc_id, chapter_id, list_filter(names, lambda x: list_contains(prev, x)) as stayed, list_filter(names, lambda x: not list_contains(prev, x)) as came from l where prev is not null")
def d03_cast_intersection(spark, sf_dir):
    c = S.clusters(table(spark, sf_dir, "mention_clusters")).where("mention_type = 'cast'").groupBy("doc_id", "chapter_id").agg(F.array_sort(F.collect_set("cluster_name")).alias("names"))
    m = c.withColumn("prev", F.lag("names").over(Window.partitionBy("doc_id").orderBy("chapter_id"))).where("prev is not null")
    return m.select("doc_id", "chapter_id", X.keep("names", "prev").alias("stayed"), X.drop("names", "prev").alias("came"))


@query(f"with {CANDS} select candidate_id, cast(i as int) as i, coalesce(hrefs[i], '(none)') as href, coalesce(source_unit_ids[i], '(none)') as unit from (select *, unnest(range(1, greatest(len(coalesce(hrefs, [])), len(coalesce(source_unit_ids, []))) + 1)) as i from cands)")
def p08_ragged_zip(spark, sf_dir):
    """Addresses and unit ids side by side; where one list is shorter, a placeholder stands."""
    none = F.expr("cast(array() as array<string>)")
    z = candidates(spark, sf_dir).select("candidate_id", F.posexplode(F.arrays_zip(F.coalesce("hrefs", none).alias("h"), F.coalesce("source_unit_ids", none).alias("u"))).alias("p", "z"))
    return z.select("candidate_id", (F.col("p") + 1).alias("i"), F.coalesce(F.col("z")["0"] if "0" in z.schema["z"].dataType.names else F.col("z")["h"], F.lit("(none)")).alias("href"), F.coalesce(F.col("z")["1"] if "1" in z.schema["z"].dataType.names else F.col("z")["u"], F.lit("(none)")).alias("unit"))


@query(f"with {CANDS}, {PARA}, z as (select candidate_id, doc_id, chapter_id, generate_subscripts(paragraphs, 1) - 1 as pid, unnest(paragraphs) as listed from cands) select z.candidate_id, cast(z.pid as int) as pid, z.listed = p.text as same from z join para p on p.doc_id = z.doc_id and p.chapter_id = z.chapter_id and p.pid = z.pid")
def j08_positional_join(spark, sf_dir):
    """A candidate's list of paragraphs against the table, by position."""
    z = candidates(spark, sf_dir).select("candidate_id", "doc_id", "chapter_id", F.posexplode("paragraphs").alias("pid", "listed"))
    return z.join(paragraphs(spark, sf_dir), ["doc_id", "chapter_id", "pid"]).select("candidate_id", "pid", (F.col("listed") == F.col("text")).alias("same"))


@query(
    f"with {OV}, {CLUS}, f as (select doc_id, chapter_id, cluster_name, min(cluster_id) as id from clus where mention_type = 'cast' group by all), l as (select doc_id, chapter_id, list_last(string_split(cluster_name, ' ')) as tail, min(cluster_id) as id from clus where mention_type = 'cast' group by all)"
    " select o.overlay_id, coalesce(f.id, l.id, -1) as cluster_id, case when f.id is not null then 'name' when l.id is not null then 'last word' else 'none' end as how from ov o left join f on f.doc_id = o.doc_id and f.chapter_id = o.chapter_id and f.cluster_name = lower(o.label) left join l on l.doc_id = o.doc_id and l.chapter_id = o.chapter_id and l.tail = list_last(string_split(lower(o.label), ' '))"
)
def j09_fallback_key(spark, sf_dir):
    """The cluster of an overlay's label by the whole name, else by its last word."""
    c = S.clusters(table(spark, sf_dir, "mention_clusters")).where("mention_type = 'cast'")
    last = lambda x: F.element_at(F.split(x, " "), -1)
    by_name = c.groupBy("doc_id", "chapter_id", F.col("cluster_name").alias("l")).agg(F.min("cluster_id").alias("a"))
    by_tail = c.groupBy("doc_id", "chapter_id", last(F.col("cluster_name")).alias("tail")).agg(F.min("cluster_id").alias("b"))
    o = overlays(spark, sf_dir).select("overlay_id", "doc_id", "chapter_id", F.lower("label").alias("l")).withColumn("tail", last(F.col("l")))
    out = o.join(by_name, ["doc_id", "chapter_id", "l"], "left").join(by_tail, ["doc_id", "chapter_id", "tail"], "left")
    return out.select("overlay_id", F.coalesce("a", "b", F.lit(-1)).alias("cluster_id"), F.when(F.col("a").isNotNull(), "name").when(F.col("b").isNotNull(), "last word").otherwise("none").alias("how"))


@query(f"with {OV}, p as (select doc_id, chapter_id, scene_id, list(distinct concat('- ', trim(label), ' (', coalesce(anchor_zone, 'anywhere'), ')') order by concat('- ', trim(label), ' (', coalesce(anchor_zone, 'anywhere'), ')')) as lines from ov where trim(label) <> '' group by all) select doc_id, chapter_id, scene_id, concat_ws(chr(10), concat('SCENE ', scene_id), 'CHARACTERS', array_to_string(lines, chr(10)), case when len(lines) > 3 then 'Keep the stage uncrowded.' end) as prompt from p")
def p13_prompt_blocks(spark, sf_dir):
    """The picture prompt of a scene: a head, a bullet per character and its zone, a constraint for crowded scenes."""
    line = F.concat(F.lit("- "), F.trim("label"), F.lit(" ("), F.coalesce("anchor_zone", F.lit("anywhere")), F.lit(")"))
    p = overlays(spark, sf_dir).where("trim(label) <> ''").groupBy("doc_id", "chapter_id", "scene_id").agg(F.array_sort(F.collect_set(line)).alias("lines"))
    crowded = F.when(F.size("lines") > 3, "Keep the stage uncrowded.")
    return p.select("doc_id", "chapter_id", "scene_id", F.concat_ws("\n", F.concat(F.lit("SCENE "), "scene_id"), F.lit("CHARACTERS"), F.array_join("lines", "\n"), crowded).alias("prompt"))


@query(f"with {OV} select overlay_id, list_filter([case when anchor_x is null then 'no anchor' end, case when coalesce(panel_key, '') = '' then 'no panel' end, case when lower(coalesce(anchor_zone, '')) not in ('left', 'center', 'right', 'foreground', 'background') then 'unknown zone' end], lambda w: w is not null) as warnings from ov")
def p12_overlay_warnings(spark, sf_dir):
    zone = F.lower(F.coalesce("anchor_zone", F.lit("")))
    made = F.array(F.when(F.col("anchor_x").isNull(), "no anchor"), F.when(F.coalesce("panel_key", F.lit("")) == "", "no panel"), F.when(~zone.isin("left", "center", "right", "foreground", "background"), "unknown zone"))
    return overlays(spark, sf_dir).select("overlay_id", F.filter(made, lambda w: w.isNotNull()).alias("warnings"))


@query(f"with {CLUS} select cluster_id, concat('ent_', lpad(cast(rn as varchar), cast(greatest(4, length(cast(rn as varchar))) as int), '0')) as entity from (select cluster_id, row_number() over (partition by doc_id order by chapter_id, ord, cluster_id) as rn from clus)")
def w12_sequential_ids(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("chapter_id", "ord", "cluster_id")
    return S.clusters(table(spark, sf_dir, "mention_clusters")).select("cluster_id", F.concat(F.lit("ent_"), X.padded(F.row_number().over(w), 4)).alias("entity"))


@query(f"with {CANDS}, o as (select *, row_number() over (partition by doc_id order by chapter_id, candidate_id) as rn, lag({{'id': candidate_id, 'n': text_length}}) over (partition by doc_id order by chapter_id, candidate_id) as p from cands) select candidate_id, coalesce(p.id, '') as previous, coalesce(text_length - p.n, 0) as growth from o")
def j06_adjacent_chapters(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("chapter_id", "candidate_id")
    o = candidates(spark, sf_dir).withColumn("p", F.lag(F.struct("candidate_id", "text_length")).over(w))
    return o.select("candidate_id", F.coalesce("p.candidate_id", F.lit("")).alias("previous"), F.coalesce(F.col("text_length") - F.col("p.text_length"), F.lit(0)).alias("growth"))


_HE = "(?:^|[^a-zà-ÿ])(he|she|they|him|her|them|his|their)(?:[^a-zà-ÿ]|$)"
_CUE = "(?:^|[^a-zà-ÿ])(rain|fog|wind|storm|snow|sun|dark|light|lamp|fire)"


@query(f"with {PARA} select doc_id, chapter_id, pid, regexp_extract(lower(text), '{_HE}', 1) as pronoun, coalesce(nullif(regexp_extract(lower(text), '{_CUE}', 1), ''), '(none)') as cue from para where regexp_matches(lower(text), '{_HE}')")
def c20_pronouns_and_cues(spark, sf_dir):
    low = F.lower("text")
    cue = F.coalesce(F.nullif(F.regexp_extract(low, _CUE, 1), F.lit("")), F.lit("(none)"))
    return paragraphs(spark, sf_dir).where(low.rlike(_HE)).select("doc_id", "chapter_id", "pid", F.regexp_extract(low, _HE, 1).alias("pronoun"), cue.alias("cue"))


@query(rf"with {PARA} select doc_id, chapter_id, pid, len(l) as items, l[1] as first_item from (select *, list_filter(list_transform(string_split_regex(text, '[;；、]| and '), lambda x: trim(x)), lambda x: x <> '') as l from para) where len(l) >= 5")
def f15_split_lists(spark, sf_dir):
    """Enumerations split into their items."""
    items = F.filter(F.transform(F.split("text", "[;；、]| and "), lambda x: F.trim(x)), lambda x: x != "")
    return paragraphs(spark, sf_dir).withColumn("l", items).where(F.size("l") >= 5).select("doc_id", "chapter_id", "pid", F.size("l").cast("long").alias("items"), F.get("l", F.lit(0)).alias("first_item"))


@query(
    upto(
        OCC,
        "select doc_id, chapter_id, pid, unnest(kept).s as start_char, unnest(kept).e as end_char from (select *, row_number() over (partition by doc_id, chapter_id, pid order by rn desc) as d from hw) where d = 1",
        ", ho as (select doc_id, chapter_id, pid, start_char as s, start_char + length(span) as e, row_number() over (partition by doc_id, chapter_id, pid order by start_char, length(span) desc, cluster_id) as rn from (select distinct doc_id, chapter_id, pid, start_char, span, min(cluster_id) as cluster_id from occ group by all)),"
        " hw as (select doc_id, chapter_id, pid, rn, [{'s': s, 'e': e}] as kept from ho where rn = 1 union all select h.doc_id, h.chapter_id, h.pid, h.rn, case when h.s >= w.kept[-1].e then list_append(w.kept, {'s': h.s, 'e': h.e}) else w.kept end from hw w join ho h on h.doc_id = w.doc_id and h.chapter_id = w.chapter_id and h.pid = w.pid and h.rn = w.rn + 1)",
    )
)
def e18_highlights(spark, sf_dir):
    """Mentions to mark in a paragraph, none over another: by start, the longer of equals first."""
    occ = Chapter(spark, sf_dir).occ.groupBy("doc_id", "chapter_id", "pid", "start_char", "span").agg(F.min("cluster_id").alias("cluster_id"))
    item = F.struct(F.col("start_char").cast("long").alias("s"), (-F.length("span")).alias("longest"), "cluster_id", (F.col("start_char") + F.length("span")).cast("long").alias("e"))
    rows = occ.groupBy("doc_id", "chapter_id", "pid").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(acc, x):
        free = (F.size(acc) == 0) | (x["s"] >= F.get(acc, F.size(acc) - 1)["e"])
        return F.when(free, F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))).otherwise(acc)

    kept = F.aggregate("items", F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)"), step)
    return rows.select("doc_id", "chapter_id", "pid", F.explode(kept).alias("k")).select("doc_id", "chapter_id", "pid", F.col("k.s").alias("start_char"), F.col("k.e").alias("end_char"))


@query()
def e05_applied_merges(spark, sf_dir):
    """Merges proposed between clusters of a chapter (one name holds the other), applied in order; a merge whose side is gone is skipped."""
    c = S.clusters(table(spark, sf_dir, "mention_clusters")).where("mention_type = 'cast'").select("doc_id", "chapter_id", "ord", "cluster_id", "cluster_name")

    def merge(rows):
        import pandas as pd

        rows = rows.sort_values(["ord", "cluster_id"])
        groups = {i: [i] for i in rows["cluster_id"]}
        names = dict(zip(rows["cluster_id"], rows["cluster_name"], strict=True))
        for a in list(groups):
            for b in list(groups):
                if a != b and a in groups and b in groups and names[b] and names[b] in names[a]:
                    groups[a] += groups.pop(b)
        out = [(rows["doc_id"].iat[0], rows["chapter_id"].iat[0], k, m) for k, members in groups.items() for m in members]
        return pd.DataFrame(out, columns=["doc_id", "chapter_id", "kept_id", "cluster_id"])

    return c.groupBy("doc_id", "chapter_id").applyInPandas(merge, "doc_id string, chapter_id string, kept_id long, cluster_id long")
