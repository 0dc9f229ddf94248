"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabulary.llm.canonical_sql import canonical_sql
from fabulary.session import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- problem 2

def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.struct("doc_id", "chapter_id").alias("place")
    paragraphs = table(spark, sf_dir, "paragraphs").select(F.lit("paragraph").alias("record_kind"), F.col("para_id").alias("record_id"), place, "text")
    clusters = table(spark, sf_dir, "mention_clusters").select(F.lit("cluster").alias("record_kind"), F.col("cluster_id").alias("record_id"), place, F.explode("raw_spans").alias("text"))
    return paragraphs.unionByName(clusters)


_FORMS = (
    "with r as (select 'paragraph' as record_kind, para_id as id, doc_id, chapter_id, text from paragraphs union select 'cluster', cluster_id, doc_id, chapter_id, unnest(raw_spans) from mention_clusters),"
    f" f as (select *, {canonical_sql('text')} as form from r where text is not null and id is not null and doc_id is not null and chapter_id is not null)"
)


@query(_FORMS + " select distinct a.record_kind, a.id as id_a, b.id as id_b from f a join f b on a.record_kind = b.record_kind and a.doc_id = b.doc_id and a.chapter_id = b.chapter_id and a.form = b.form where a.id < b.id and a.text <> b.text")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fabulary.llm.normalize import look_alike_pairs

    return look_alike_pairs(_records(spark, sf_dir))


@query(_FORMS + " select distinct record_kind, id as record_id, md5(form) as canonical_md5, form <> text as changed from f")
def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct text and span with the digest of its canonical form, and whether it changed."""
    from fabulary.llm.normalize import canonical_text

    form = canonical_text(F.col("text"))
    return _records(spark, sf_dir).select("record_kind", "record_id", F.md5(form).alias("canonical_md5"), (form != F.col("text")).alias("changed")).distinct()


# ---- problem 1

@query("select distinct para_id from paragraphs where length(text) > 1200")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that the splitter cuts into more than one piece; a text within the limit is never cut."""
    from fabulary.llm.split import boundary_table

    laid = boundary_table(table(spark, sf_dir, "paragraphs"), "para_id", "text").groupBy("item").agg(F.sum(F.size("starts")).alias("pieces"))
    return laid.where("pieces > 1").select(F.col("item").alias("para_id"))


@query("select para_id, cast(length(text) as bigint) as n_chars, true as whole, true as within, true as overlapping from paragraphs where text <> '' group by para_id, text")
def p1_pieces_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per paragraph: do its pieces give back the whole text, within the limit, with the overlap asked for?"""
    from fabulary.llm.split import LIMIT, OVERLAP, split_texts

    paragraphs = table(spark, sf_dir, "paragraphs")
    pieces = split_texts(paragraphs, "para_id", "text")
    skip = F.when(F.col("piece_no") == 0, 0).otherwise(OVERLAP)
    body = F.expr(f"substring(piece, if(piece_no = 0, 1, {OVERLAP + 1}))")
    per = pieces.groupBy("item").agg(
        F.array_sort(F.collect_list(F.struct("piece_no", body.alias("body"), (F.col("end_char") - F.col("start_char") - skip).alias("n"), "start_char", "end_char"))).alias("p"), F.max(F.char_length("piece")).alias("longest")
    )
    joined = F.array_join(F.transform("p", lambda x: x["body"]), "")
    gaps = F.forall(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda i: (i >= F.size("p")) | (F.element_at("p", i + 1)["start_char"] == F.element_at("p", i)["end_char"] - OVERLAP))
    texts = paragraphs.where("text <> ''").select("para_id", "text").dropDuplicates(["para_id"])
    return texts.join(per, texts["para_id"] == per["item"]).select("para_id", F.char_length("text").cast("long").alias("n_chars"), (joined == F.col("text")).alias("whole"), (F.col("longest") <= LIMIT).alias("within"), gaps.alias("overlapping"))


@query()
def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fabulary.llm.split import split_texts

    return split_texts(table(spark, sf_dir, "paragraphs"), "para_id", "text").withColumnRenamed("item", "para_id")


# ---- problem 4

def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "source_units").select(F.lit("source_units").alias("record_kind"), F.col("unit_id").alias("record_id"), F.col("body_text").alias("text"))
    candidates = table(spark, sf_dir, "chapter_candidates").select(F.lit("chapter_candidates").alias("record_kind"), F.col("candidate_id").alias("record_id"), F.concat_ws(" ", "paragraphs").alias("text"))
    return units.unionByName(candidates)


_SHARED = (
    "with r as (select 'source_units' as record_kind, unit_id as id, body_text as text from source_units union select 'chapter_candidates', candidate_id, array_to_string(paragraphs, ' ') from chapter_candidates),"
    " p as (select distinct record_kind, id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') as t from r where text is not null and id is not null), q as (select * from p where length(t) >= 400),"
    " g as (select record_kind, id, unnest(list_distinct(list_transform(range(1, length(t) - 10), lambda i: substr(t, i, 12)))) as s from q), n as (select record_kind, id, count(*) as n from g group by all),"
    " c as (select a.record_kind, a.id as id_a, b.id as id_b, count(*) as c from g a join g b on a.record_kind = b.record_kind and a.s = b.s and a.id < b.id group by all)"
    " select c.record_kind, id_a, id_b from c join n x on x.record_kind = c.record_kind and x.id = id_a join n y on y.record_kind = c.record_kind and y.id = id_b where c >= 0.6 * (x.n + y.n - c)"
)


@query(_SHARED)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fabulary.llm.neardup import expand, near_duplicates

    return expand(*near_duplicates(_versions(spark, sf_dir)))


@query()
def p4_class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked classes of exact copies by their representatives, with both shares; p4_groups has the members."""
    from fabulary.llm.neardup import near_duplicates

    return near_duplicates(_versions(spark, sf_dir))[1]


_CLASSES = _SHARED[: _SHARED.index(" g as (")] + (
    " d as (select record_kind, t, min(id) as rep, count(*) as copies from q group by all), g as (select record_kind, rep, unnest(list_distinct(list_transform(range(1, length(t) - 10), lambda i: substr(t, i, 12)))) as s from d), n as (select record_kind, rep, count(*) as n from g group by all),"
    " c as (select a.record_kind, a.rep as a, b.rep as b, count(*) as c from g a join g b on a.record_kind = b.record_kind and a.s = b.s and a.rep < b.rep group by all),"
    " k as (select c.record_kind, unnest([a, b]) as rep from c join n x on x.record_kind = c.record_kind and x.rep = a join n y on y.record_kind = c.record_kind and y.rep = b where c >= 0.6 * (x.n + y.n - c)), l as (select record_kind, rep, count(*) as links from k group by all)"
    " select q.record_kind, q.id as record_id, d.rep as class_id, d.copies, coalesce(l.links, 0) as linked_texts from q join d using (record_kind, t) left join l on l.record_kind = q.record_kind and l.rep = d.rep"
)


@query(_CLASSES)
def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per record its class of exact copies, and how many other texts the class is linked to."""
    from fabulary.llm.neardup import near_duplicates

    classes, pairs = near_duplicates(_versions(spark, sf_dir))
    links = pairs.select("record_kind", F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("record_kind", "rep").agg(F.count("*").alias("linked_texts"))
    return classes.join(links, ["record_kind", "rep"], "left").select("record_kind", "record_id", F.col("rep").alias("class_id"), "copies", F.coalesce("linked_texts", F.lit(0)).alias("linked_texts"))


# ---- problem 6

@query()
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fabulary.llm.pairs import flag_pairs

    return flag_pairs(table(spark, sf_dir, "llm_trials")).where("rank = 1").select("trial_key", "defect")


@query()
def p6_all_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fabulary.llm.pairs import flag_pairs

    return flag_pairs(table(spark, sf_dir, "llm_trials"))


# ---- problem 7

def _plain_sql(c: str) -> str:
    return f"regexp_replace(lower({canonical_sql(c)}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


_LEAKS = (
    f"with d as (select distinct doc_id, {_plain_sql('text')} as t from documents where text is not null and doc_id is not null), i as (select distinct item_id, case when lang in ('ko', 'ja') then 30 else 60 end as n, {_plain_sql('passage')} as t from eval_items where passage is not null),"
    " w as (select distinct item_id, n, substr(t, k, n) as s from (select *, unnest(range(1, length(t) - n + 2)) as k from i)),"
    " p as (select distinct doc_id, substr(t, k, 30) as h, k from (select *, unnest(range(1, length(t) - 28)) as k from d))"
    " select distinct p.doc_id, w.item_id from w join p on p.h = substr(w.s, 1, 30) join d on d.doc_id = p.doc_id and substr(d.t, p.k, w.n) = w.s"
)


@query(_LEAKS)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fabulary.llm.leakage import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).where("complete").select("doc_id", "item_id")


@query()
def p7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item with a verified window, with the longest run and the windows' similarity."""
    from fabulary.llm.leakage import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


# ---- problem 9

def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fabulary.llm.abuse import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "toxicity_labels"))


@query()
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fabulary.llm.abuse import THRESHOLD

    return _scored(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id")


@query()
def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


@query()
def p9_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source (null is one), its documents, those at or over the threshold, and their rate."""
    from fabulary.llm.abuse import THRESHOLD

    sources = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.min("source").alias("source"))
    flagged = F.count_if(F.col("score") >= THRESHOLD)
    return _scored(spark, sf_dir).join(sources, "doc_id").groupBy("source").agg(F.count("*").alias("documents"), flagged.alias("flagged"), F.round(flagged / F.count("*"), 6).alias("rate"))


# ---- problem 8

@query()
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fabulary.llm.mixing import draw_mix

    return draw_mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


@query()
def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fabulary.llm.mixing import draw_mix

    return draw_mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


@query("select distinct source, true as known_documents, true as within_cap, true as within_quota, true as near_quota, true as one_use_a_pass from mix_targets where source is not null")
def p8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source what the mix must keep to: documents of the source only, uses within the cap, tokens within the quota and short of it by less than one document, no document twice in a pass."""
    from fabulary.llm.mixing import count_tokens, draw_mix, plan

    documents, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    mix, _ = draw_mix(documents, targets)
    counted = count_tokens(documents).join(targets.select("source").distinct(), "source", "left_semi")
    totals = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest")), "source", "left")
    quotas = spark.createDataFrame(plan(totals.drop("largest").toPandas())[["source", "quota"]], "source string, quota long")  # one row per target
    uses = mix.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.count_distinct("pass_no").alias("passes"), F.sum("tokens").alias("drawn"))
    known = uses.join(counted.select("doc_id", F.col("source").alias("of")), "doc_id", "left")
    per = known.groupBy("source").agg(F.min(F.coalesce(F.col("of") == F.col("source"), F.lit(False))).alias("known"), F.max("uses").alias("most"), F.sum("drawn").alias("drawn"), F.min(F.col("uses") == F.col("passes")).alias("apart"))
    j = totals.join(quotas, "source").join(per, "source", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    yes = lambda c, name: F.coalesce(c, F.lit(True)).alias(name)
    return j.select("source", yes(F.col("known"), "known_documents"), yes(F.col("most") <= F.col("max_repeats"), "within_cap"), (F.col("drawn") <= F.col("quota")).alias("within_quota"), yes(F.col("drawn") + F.coalesce("largest", F.lit(0)) >= F.col("quota"), "near_quota"), yes(F.col("apart"), "one_use_a_pass"))


# ---- problem 5

def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = table(spark, sf_dir, "mention_clusters").where("mention_type = 'cast'").select("doc_id", F.lower("cluster_name").alias("name"), F.col("raw_spans").alias("originals"))
    labels = table(spark, sf_dir, "overlay_characters").select("doc_id", F.lower("label").alias("name"), F.array("label").alias("originals"))
    return clusters.unionByName(labels)


@query()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fabulary.llm.names import link_names, name_pairs

    return name_pairs(link_names(_mentions(spark, sf_dir)))


@query()
def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fabulary.llm.names import link_names

    return link_names(_mentions(spark, sf_dir))


# ---- problem 3

def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    paragraphs = table(spark, sf_dir, "paragraphs").select(F.lit("paragraph").alias("record_kind"), F.col("para_id").alias("record_id"), "text")
    selections = table(spark, sf_dir, "anchored_selections").select(F.lit("selection").alias("record_kind"), F.col("selection_id").alias("record_id"), F.col("selected_text").alias("text"))
    return paragraphs.unionByName(selections)


@query()
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fabulary.llm.sentences import fit, sentence_ends

    return sentence_ends(_texts(spark, sf_dir), fit(_texts(spark, sf_dir))).select("record_kind", "record_id", "end_char")


@query()
def p3_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units with their offsets, numbered within their record."""
    from fabulary.llm.sentences import fit, sentence_ends

    return sentence_ends(_texts(spark, sf_dir), fit(_texts(spark, sf_dir)))
