"""Queries over spine units and chapter candidates: classification, titles, duplicates, merging and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabulary.functions import text as X
from fabulary.operators import folds
from fabulary.queries import query
from fabulary.session import table

UNITS = "units as (select distinct doc_id, spine_index, unit_id, manifest_id, href, original_title, toc_title, heading_title, selected_title, paragraphs, text_length, link_text_length, image_count, class_hints, body_text from source_units)"
CANDS = "cands as (select distinct candidate_id, doc_id, chapter_id, title, paragraphs, text_length, source_type, hrefs, source_unit_ids, manifest_id, toc_title, heading_title, classification from chapter_candidates)"
PARA = "para as (select distinct doc_id, chapter_id, pid, text from paragraphs where text is not null)"
_TITLE = r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(list_last(string_split_regex(split_part({c}, '#', 1), '[\\/]')), '\.(xhtml|html|htm)$', '', 'i'), '_+', ' ', 'g'), '\s+', ' ', 'g')), '')"
_GENERIC = r"coalesce(regexp_matches(regexp_replace(lower({t}), '[\s._-]+', '', 'g'), '^(item|id|xhtml|html|body|text|page|file|section)\d*$|^(nav|toc|contents|cover|titlepage|pgheader|pgfooter)$|^chapter\d+$'), true)"
_SQUEEZE = r"trim(regexp_replace({c}, '[\s\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{0085}}\x0B]+', ' ', 'g'))"
_HEADING = (
    r"coalesce(({s} <> '' and length({s}) <= 140 and not regexp_matches({s}, '" + X.NON_STORY_TITLE + r"', 'i') and (regexp_matches({s}, '^chapter\s+([0-9]+|[ivxlcdm]+)\b|^(book|part|volume)\s+([0-9]+|[ivxlcdm]+)\b', 'i')"
    r" or regexp_matches({s}, '^[0-9]+[.)]\s+\S+|^[IVXLCDM]+[.)]\s+\S+') or (length({s}) <= 80 and {s} = upper({s}) and regexp_matches({s}, '[A-Z]')))), false)"
)


def title_sql(c: str) -> str:
    return _TITLE.format(c=c)


def generic_sql(c: str) -> str:
    return _GENERIC.format(t=title_sql(c))


def squeeze_sql(c: str) -> str:
    return _SQUEEZE.format(c=c)


def heading_sql(c: str) -> str:
    return _HEADING.format(s=squeeze_sql(c))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_units").distinct()


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chapter_candidates").drop("classification_reason").distinct()


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "paragraphs").where("text is not null").select("doc_id", "chapter_id", "pid", "text").distinct()


def classified(u: DataFrame) -> DataFrame:
    """Units with the kind their signals give; the first rule that holds counts."""
    signal = F.lower(F.concat_ws(" ", "manifest_id", "href", "original_title", "toc_title", "heading_title", F.array_join("class_hints", " ")))
    body = F.lower("body_text")
    ratio = F.when(F.col("text_length") > 0, F.col("link_text_length") / F.col("text_length")).otherwise(0.0)
    headed = X.heading("heading_title") | F.exists(F.slice(F.coalesce("paragraphs", F.array()), 1, 3), lambda p: X.heading(p))
    n, wide = F.col("text_length"), F.concat_ws(" ", signal, "body_text")
    kind = (
        F.when((n < 20) & (F.col("image_count") == 0), "blank")
        .when(signal.rlike(r"\bpg[-_\s]*header\b"), "front_matter")
        .when(signal.rlike(r"\bpg[-_\s]*footer\b"), "back_matter")
        .when(signal.rlike(r"\bcover\b") & (n < 500), "cover")
        .when((F.col("image_count") > 0) & (n < 120) & ~headed, "cover")
        .when(signal.rlike(r"\b(nav|toc|contents|table[-_\s]*of[-_\s]*contents)\b") & ((n < 3000) | (ratio > 0.35)), "toc")
        .when(wide.rlike("(목차|차례)") & ((n < 3000) | (ratio > 0.2)), "toc")
        .when((ratio > 0.55) & (n < 5000) & ~headed, "nav")
        .when(F.concat_ws(" ", signal, body).rlike(r"\b(copyright|all rights reserved|isbn|license|publisher|produced by)\b") & (n < 2500), "copyright")
        .when(wide.rlike(r"(라이선스|저작권|판권|이\s*저작물은)") & (n < 2500), "copyright")
        .when(F.contains(body, F.lit("end of the project gutenberg")), "back_matter")
        .when(F.contains(body, F.lit("start of the project gutenberg")), "front_matter")
        .when(signal.rlike(r"\b(title[-_\s]*page|dedication|acknowledg|imprint|colophon)\b") & (n < 1200), "front_matter")
        .when((n < 100) & ~headed, "front_matter")
        .otherwise("content")
    )
    return u.withColumn("kind", kind)


_SIGNAL = "lower(concat_ws(' ', manifest_id, href, original_title, toc_title, heading_title, array_to_string(class_hints, ' ')))"
CLASSIFIED = (
    r"sig as (select *, "
    + _SIGNAL
    + r" as signal, lower(body_text) as body, case when text_length > 0 then link_text_length / text_length else 0.0 end as ratio, "
    + heading_sql("heading_title")
    + r" or len(list_filter(coalesce(paragraphs, [])[1:3], lambda p: "
    + heading_sql("p")
    + r""")) > 0 as headed from units),
kinds as (select *, case
 when text_length < 20 and image_count = 0 then 'blank'
 when regexp_matches(signal, '\bpg[-_\s]*header\b') then 'front_matter'
 when regexp_matches(signal, '\bpg[-_\s]*footer\b') then 'back_matter'
 when regexp_matches(signal, '\bcover\b') and text_length < 500 then 'cover'
 when image_count > 0 and text_length < 120 and not headed then 'cover'
 when regexp_matches(signal, '\b(nav|toc|contents|table[-_\s]*of[-_\s]*contents)\b') and (text_length < 3000 or ratio > 0.35) then 'toc'
 when regexp_matches(concat_ws(' ', signal, body_text), '(목차|차례)') and (text_length < 3000 or ratio > 0.2) then 'toc'
 when ratio > 0.55 and text_length < 5000 and not headed then 'nav'
 when regexp_matches(concat_ws(' ', signal, body), '\b(copyright|all rights reserved|isbn|license|publisher|produced by)\b') and text_length < 2500 then 'copyright'
 when regexp_matches(concat_ws(' ', signal, body_text), '(라이선스|저작권|판권|이\s*저작물은)') and text_length < 2500 then 'copyright'
 when contains(body, 'end of the project gutenberg') then 'back_matter'
 when contains(body, 'start of the project gutenberg') then 'front_matter'
 when regexp_matches(signal, '\b(title[-_\s]*page|dedication|acknowledg|imprint|colophon)\b') and text_length < 1200 then 'front_matter'
 when text_length < 100 and not headed then 'front_matter'
 else 'content' end as kind from sig)"""
)


@query(f"with {UNITS}, {CLASSIFIED} select unit_id, kind from kinds")
def c01_classify_units(spark, sf_dir):
    return classified(units(spark, sf_dir)).select("unit_id", "kind")


@query(f"with {UNITS}, {CLASSIFIED} select kind, count(*) as units, cast(sum(text_length) as bigint) as chars, cast(sum(image_count) as bigint) as images, cast(sum(link_text_length) as bigint) as link_chars from kinds group by kind")
def a10_kind_totals(spark, sf_dir):
    return classified(units(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("units"), F.sum("text_length").alias("chars"), F.sum("image_count").alias("images"), F.sum("link_text_length").alias("link_chars"))


@query(f"with {UNITS} select unit_id, {generic_sql('original_title')} as generic, {title_sql('href')} as title_of_href from units")
def c02_generic_titles(spark, sf_dir):
    return units(spark, sf_dir).select("unit_id", X.generic_title("original_title").alias("generic"), X.chapter_title("href").alias("title_of_href"))


@query(f"with {PARA} select doc_id, chapter_id, pid from para where {heading_sql('text')}")
def c03_heading_candidates(spark, sf_dir):
    return paragraphs(spark, sf_dir).where(X.heading("text")).select("doc_id", "chapter_id", "pid")


_NON_STORY = "('blank','cover','toc','nav','copyright','front_matter','back_matter','publisher_note')"


@query(
    f"with {CANDS}, t as (select *, concat_ws(' ', chapter_id, title, toc_title, heading_title, manifest_id, array_to_string(hrefs, ' ')) as signal, {squeeze_sql(chr(34) + 'body' + chr(34))} as flat, len(list_filter(coalesce(paragraphs, [])[1:3], lambda p: {heading_sql('p')})) > 0 as headed"
    " from (select *, array_to_string(paragraphs, ' ') as body from cands))"
    rf" select candidate_id, (coalesce(classification in {_NON_STORY}, false) or regexp_matches(signal, '\bpg[-_\s]*(header|footer)\b', 'i') or (regexp_matches(signal, '{X.NON_STORY_TITLE}', 'i') and length(flat) < 2500) or (regexp_matches(signal, '(목차|차례|라이선스|저작권|판권|이\s*저작물은)') and length(flat) < 2500)"
    r" or (regexp_matches(flat, '^(목차|차례)([^0-9A-Za-z_]|$)') and length(flat) < 2500) or regexp_matches(lower(flat), '^(start|end) of (the )?project gutenberg') or contains(lower(flat), 'end of the project gutenberg') or (length(flat) < 80 and not headed)) as non_story from t"
)
def c04_non_story_chapters(spark, sf_dir):
    flat = X.squeeze(F.array_join("paragraphs", " "))
    signal = F.concat_ws(" ", "chapter_id", "title", "toc_title", "heading_title", "manifest_id", F.array_join("hrefs", " "))
    headed = F.exists(F.slice(F.coalesce("paragraphs", F.array()), 1, 3), lambda p: X.heading(p))
    c = candidates(spark, sf_dir).withColumns({"flat": flat, "signal": signal, "headed": headed})
    low, few = F.lower("flat"), F.length("flat") < 2500
    rule = (
        F.coalesce(F.col("classification").isin("blank", "cover", "toc", "nav", "copyright", "front_matter", "back_matter", "publisher_note"), F.lit(False)) | F.col("signal").rlike(r"(?i)\bpg[-_\s]*(header|footer)\b") | F.col("signal").rlike("(?i)" + X.NON_STORY_TITLE) & few
        | F.col("signal").rlike(r"(목차|차례|라이선스|저작권|판권|이\s*저작물은)") & few | F.col("flat").rlike("^(목차|차례)([^0-9A-Za-z_]|$)") & few | low.rlike("^(start|end) of (the )?project gutenberg") | F.contains(low, F.lit("end of the project gutenberg"))
        | (F.length("flat") < 80) & ~F.col("headed")
    )
    return c.select("candidate_id", rule.alias("non_story"))


def _clean_title_sql(c: str) -> str:
    t = title_sql(c)
    return f"case when {t} is not null and not {generic_sql(c)} and not regexp_matches({t}, '{X.NON_STORY_TITLE}', 'i') and length({t}) <= 140 then {t} end"


def clean_title(c):
    t = X.chapter_title(c)
    return F.when(t.isNotNull() & ~X.generic_title(c) & ~t.rlike("(?i)" + X.NON_STORY_TITLE) & (F.length(t) <= 140), t)


@query(
    f"with {CANDS} select candidate_id, coalesce(case when regexp_matches({_clean_title_sql('title')}, '\\s+\\([0-9]+\\)$') then {_clean_title_sql('title')} end, {_clean_title_sql('toc_title')}, {_clean_title_sql('heading_title')}, {_clean_title_sql('title')}, {_clean_title_sql('chapter_id')}) as display_title from cands"
)
def c05_display_titles(spark, sf_dir):
    """The first acceptable title; one that ends in a part number wins."""
    own = clean_title("title")
    return candidates(spark, sf_dir).select("candidate_id", F.coalesce(F.when(own.rlike(r"\s+\([0-9]+\)$"), own), clean_title("toc_title"), clean_title("heading_title"), own, clean_title("chapter_id")).alias("display_title"))


@query(
    f"with {UNITS} select unit_id, coalesce(case when not {generic_sql('toc_title')} then {title_sql('toc_title')} end, case when not {generic_sql('heading_title')} then {title_sql('heading_title')} end, case when not {generic_sql('original_title')} then {title_sql('original_title')} end,"
    f" list_filter(list_transform(list_filter(coalesce(paragraphs, [])[1:3], lambda p: {heading_sql('p')}), lambda p: case when not {generic_sql('p')} then {title_sql('p')} end), lambda t: t is not null)[1], concat('Chapter ', spine_index + 1)) as title from units"
)
def c06_unit_titles(spark, sf_dir):
    said = lambda c: F.when(~X.generic_title(c), X.chapter_title(c))
    first = F.get(F.filter(F.transform(F.filter(F.slice(F.coalesce("paragraphs", F.array()), 1, 3), X.heading), said), lambda t: t.isNotNull()), F.lit(0))
    return units(spark, sf_dir).select("unit_id", F.coalesce(said("toc_title"), said("heading_title"), said("original_title"), first, F.concat(F.lit("Chapter "), F.col("spine_index") + 1)).alias("title"))


_HREF = r"split_part(lower(regexp_replace(replace(href, '\', '/'), '^\.?/', '')), '#', 1)"


@query(f"with {UNITS} select unit_id, {_HREF} as href_key from units where href is not null")
def f03_href_keys(spark, sf_dir):
    return units(spark, sf_dir).where("href is not null").select("unit_id", X.href("href").alias("href_key"))


@query(f"with {UNITS} select doc_id, spine_index, unit_id, coalesce(t1, t2, '(none)') as toc_name from (select u.*, a.toc_title as t1, b.toc_title as t2 from units u left join (select doc_id, manifest_id, min(toc_title) as toc_title from units where toc_title is not null group by doc_id, manifest_id) a using (doc_id, manifest_id) left join (select doc_id, {_HREF} as hk, min(toc_title) as toc_title from units where toc_title is not null and href is not null group by all) b on b.doc_id = u.doc_id and b.hk = {_HREF.replace('href', 'u.href')})")
def s05_toc_titles(spark, sf_dir):
    """Titles by manifest id, else by address without fragment."""
    u = units(spark, sf_dir)
    named = u.where("toc_title is not null")
    by_id = named.groupBy("doc_id", "manifest_id").agg(F.min("toc_title").alias("t1"))
    by_href = named.where("href is not null").groupBy("doc_id", X.href("href").alias("hk")).agg(F.min("toc_title").alias("t2"))
    out = u.join(by_id, ["doc_id", "manifest_id"], "left").withColumn("hk", X.href("href")).join(by_href, ["doc_id", "hk"], "left")
    return out.select("doc_id", "spine_index", "unit_id", F.coalesce("t1", "t2", F.lit("(none)")).alias("toc_name"))


@query(f"with {UNITS}, {CLASSIFIED}, c as (select doc_id, unit_id, text_length, spine_index, row_number() over (partition by doc_id order by text_length desc, spine_index, unit_id) as rn, count(*) over (partition by doc_id) as n from kinds where kind <> 'content') select doc_id, unit_id, cast(rn as int) as place from c where rn <= greatest(1, least(3, n))")
def t07_longest_rejected_units(spark, sf_dir):
    """The up to three longest units that were filtered out of a book: what stands in when all were."""
    rejected = classified(units(spark, sf_dir)).where("kind <> 'content'")
    w = Window.partitionBy("doc_id").orderBy(F.desc("text_length"), "spine_index", "unit_id")
    return rejected.withColumn("place", F.row_number().over(w)).where("place <= 3").select("doc_id", "unit_id", "place")


_FP = f"case when length({squeeze_sql('body')}) >= 400 then sha256({squeeze_sql('body')}) end"


@query(
    f"with {CANDS}, f as (select candidate_id, doc_id, {_FP} as fp from (select *, array_to_string(paragraphs, chr(10)) as body from cands)), r as (select *, row_number() over (partition by doc_id, fp order by candidate_id) as rn from f) select candidate_id, fp from r where fp is null or rn = 1"
)
def d08_fingerprint_dedupe(spark, sf_dir):
    """The first candidate of each text of a book; texts too short for a fingerprint all stay."""
    flat = X.squeeze(F.array_join("paragraphs", "\n"))
    c = candidates(spark, sf_dir).select("candidate_id", "doc_id", flat.alias("flat")).select("candidate_id", "doc_id", F.when(F.length("flat") >= 400, F.sha2("flat", 256)).alias("fp"))
    w = Window.partitionBy("doc_id", "fp").orderBy("candidate_id")
    return c.withColumn("rn", F.row_number().over(w)).where("fp is null or rn = 1").select("candidate_id", "fp")


@query(
    f"with recursive {UNITS}, k as (select doc_id, unit_id, manifest_id as mid, {_HREF} as hk, row_number() over (partition by doc_id order by spine_index, unit_id) as rn from units),"
    " w as (select doc_id, unit_id, rn, [mid] as mids, list_filter([hk], lambda x: x is not null) as hks, true as kept from k where rn = 1 union all select k.doc_id, k.unit_id, k.rn,"
    " case when coalesce(list_contains(w.mids, k.mid), false) or coalesce(list_contains(w.hks, k.hk), false) then w.mids else list_append(w.mids, k.mid) end, case when coalesce(list_contains(w.mids, k.mid), false) or coalesce(list_contains(w.hks, k.hk), false) or k.hk is null then w.hks else list_append(w.hks, k.hk) end,"
    " not (coalesce(list_contains(w.mids, k.mid), false) or coalesce(list_contains(w.hks, k.hk), false)) from w join k on k.doc_id = w.doc_id and k.rn = w.rn + 1) select doc_id, unit_id from w where kept"
)
def d07_unique_units(spark, sf_dir):
    """Units of a book in spine order, each kept if neither its manifest id nor its address was kept before; a fold, as dropped units register nothing."""
    u = units(spark, sf_dir).select("doc_id", "spine_index", "unit_id", F.col("manifest_id").alias("mid"), X.href("href").alias("hk"))

    def step(acc, x):
        seen = F.exists(acc, lambda y: F.coalesce(y["mid"] == x["mid"], F.lit(False)) | F.coalesce(y["hk"] == x["hk"], F.lit(False)))
        return F.when(seen, acc).otherwise(F.concat(acc, F.array(x)))

    grouped = u.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("spine_index", "unit_id", "mid", "hk"))).alias("rows"))
    kept = F.aggregate("rows", F.slice("rows", 1, 0), step)
    return grouped.select("doc_id", F.explode(kept).alias("r")).select("doc_id", "r.unit_id")


@query(
    f"with {CANDS}, o as (select *, row_number() over (partition by doc_id order by candidate_id) as rn from cands), g as (select *, sum(case when text_length >= 500 or rn = 1 then 1 else 0 end) over (partition by doc_id order by rn) as grp from o)"
    " select doc_id, cast(grp as bigint) as grp, count(*) as parts, cast(sum(text_length) as bigint) as text_length, list(candidate_id order by rn) as members from g group by doc_id, grp"
)
def e01_merge_short(spark, sf_dir):
    """A candidate under 500 characters is appended to the one before it; the first never is."""
    order = Window.partitionBy("doc_id").orderBy("candidate_id")
    c = candidates(spark, sf_dir).withColumn("rn", F.row_number().over(order))
    grp = F.sum(F.when((F.col("text_length") >= 500) | (F.col("rn") == 1), 1).otherwise(0)).over(order).alias("grp")
    rows = c.select("doc_id", "candidate_id", "rn", "text_length", grp)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rn", "candidate_id"))), lambda x: x["candidate_id"])
    return rows.groupBy("doc_id", "grp").agg(F.count("*").alias("parts"), F.sum("text_length").alias("text_length"), ordered.alias("members"))


def _batch_sql(most_chars: int, most_items: int | None) -> str:
    full = f"(w.chars + p.n > {most_chars})" + (f" or w.size >= {most_items}" if most_items else "")
    return (
        f"with recursive {PARA}, p as (select doc_id, chapter_id, pid, length(text) as n, row_number() over (partition by doc_id, chapter_id order by pid) as rn from para),"
        " w as (select doc_id, chapter_id, pid, rn, cast(n as bigint) as chars, 1 as size, 0 as batch from p where rn = 1 union all select p.doc_id, p.chapter_id, p.pid, p.rn,"
        f" case when {full} then p.n else w.chars + p.n end, case when {full} then 1 else w.size + 1 end, case when {full} then w.batch + 1 else w.batch end from w join p on p.doc_id = w.doc_id and p.chapter_id = w.chapter_id and p.rn = w.rn + 1) select doc_id, chapter_id, pid, batch from w"
    )


def _batches(spark, sf_dir, most_chars, most_items=None):
    grouped = paragraphs(spark, sf_dir).groupBy("doc_id", "chapter_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pid").alias("ord"), F.length("text").cast("bigint").alias("n")))).alias("items"))
    return grouped.select("doc_id", "chapter_id", F.explode(folds.greedy_batches(F.col("items"), most_chars, most_items)).alias("b")).select("doc_id", "chapter_id", F.col("b.ord").alias("pid"), "b.batch")


@query(_batch_sql(3000, None))
def e02_split_long(spark, sf_dir):
    """Chapters cut into parts of at most 3,000 characters (the books here are small): greedy, in order."""
    return _batches(spark, sf_dir, 3000)


@query(_batch_sql(6000, 8))
def e03_prompt_batches(spark, sf_dir):
    """Prompt batches of at most 8 paragraphs and 6,000 characters."""
    return _batches(spark, sf_dir, 6000, 8)


@query(f"with {PARA} select doc_id, chapter_id, pid, cast(coalesce(sum(length(text) + 1) over (partition by doc_id, chapter_id order by pid rows between unbounded preceding and 1 preceding), 0) as bigint) as start_char, length(text) as n from para")
def p02_paragraph_offsets(spark, sf_dir):
    w = Window.partitionBy("doc_id", "chapter_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return paragraphs(spark, sf_dir).select("doc_id", "chapter_id", "pid", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).alias("start_char"), F.length("text").cast("bigint").alias("n"))


@query(f"with {PARA} select doc_id, chapter_id, count(*) as paragraph_count, cast(sum(length(text)) + count(*) - 1 as bigint) as char_count from para group by doc_id, chapter_id")
def p01_prepared_chapters(spark, sf_dir):
    return paragraphs(spark, sf_dir).groupBy("doc_id", "chapter_id").agg(F.count("*").alias("paragraph_count"), (F.sum(F.length("text")) + F.count("*") - 1).alias("char_count"))


@query(f"with {PARA} select doc_id, chapter_id, array_to_string(list(concat('[P', pid, '] ', text) order by pid), chr(10)) as marked from para group by doc_id, chapter_id")
def s17_marked_text(spark, sf_dir):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pid", "text"))), lambda p: F.concat(F.lit("[P"), p["pid"], F.lit("] "), p["text"]))
    return paragraphs(spark, sf_dir).groupBy("doc_id", "chapter_id").agg(F.array_join(lines, "\n").alias("marked"))


@query(
    "with t as (select distinct trial_key, prompt from llm_trials where prompt is not null), l as (select trial_key, unnest(string_split(prompt, chr(10))) as line from t)"
    r" select trial_key, cast(regexp_extract(line, '^\[P(\d+)\] ', 1) as int) as pid, regexp_replace(line, '^\[P\d+\] ', '') as text from l where regexp_matches(line, '^\[P\d+\] ')"
)
def s18_parse_marked_text(spark, sf_dir):
    """Paragraphs back from the marked text inside prompts."""
    t = table(spark, sf_dir, "llm_trials").where("prompt is not null").select("trial_key", "prompt").distinct()
    lines = t.select("trial_key", F.explode(F.split("prompt", "\n")).alias("line")).where(F.col("line").rlike(r"^\[P\d+\] "))
    return lines.select("trial_key", F.regexp_extract("line", r"^\[P(\d+)\] ", 1).cast("int").alias("pid"), F.regexp_replace("line", r"^\[P\d+\] ", "").alias("text"))


@query(
    f"with {CANDS}, c as (select candidate_id, doc_id, cast(nullif(regexp_extract(chapter_id, '(\\d+)', 1), '') as int) as idx, {_FP} as fp from (select *, array_to_string(paragraphs, chr(10)) as body from cands) where coalesce(classification not in {_NON_STORY}, true)),"
    " r as (select *, row_number() over (partition by doc_id, fp order by idx, candidate_id) as rn from c) select doc_id, candidate_id, idx from r where fp is null or rn = 1"
)
def s07_list_chapters(spark, sf_dir):
    """Story chapters of a book by the number in their id, without repeated texts."""
    flat = X.squeeze(F.array_join("paragraphs", "\n"))
    c = candidates(spark, sf_dir).where(F.coalesce(~F.col("classification").isin("blank", "cover", "toc", "nav", "copyright", "front_matter", "back_matter", "publisher_note"), F.lit(True)))
    c = c.select("doc_id", "candidate_id", F.nullif(F.regexp_extract("chapter_id", r"(\d+)", 1), F.lit("")).cast("int").alias("idx"), F.when(F.length(flat) >= 400, F.sha2(flat, 256)).alias("fp"))
    w = Window.partitionBy("doc_id", "fp").orderBy("idx", "candidate_id")
    return c.withColumn("rn", F.row_number().over(w)).where("fp is null or rn = 1").select("doc_id", "candidate_id", "idx")
