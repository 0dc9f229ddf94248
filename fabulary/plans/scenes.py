"""From paragraphs and mention clusters to state frames, boundaries, scenes and scene packets.

Everything is keyed by (doc_id, chapter_id), the grain at which chapters are independent. Joins are
equi-joins on the chapter; folds run over the rows of one chapter, which a chapter bounds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulary.functions import text as X
from fabulary.operators import folds

CH = ["doc_id", "chapter_id"]
CAST_WINDOW, WEAK, SCENE, LEAST_SCENE, LIST_MARKS = 2, 3.0, 4.0, 2, 10


def clusters(mention_clusters: DataFrame) -> DataFrame:
    return mention_clusters.select("cluster_id", *CH, "ord", "mention_type", "cluster_name", "raw_spans").distinct()


def paragraphs(table: DataFrame) -> DataFrame:
    """The texts, as they are read: a repeated row is still there twice. What is made of them is made unique when it is small."""
    return table.where("text is not null").select(*CH, "pid", "text")


# What the rule extractor takes for people, places and times.
CAST = r"[A-ZÀ-Þ][a-zà-ÿ]+ [A-Z][a-z]{3,}"
PLACE = r"\b(?:in|at|on|behind|beside|under|beyond|near|outside|inside|above|across|along|within) the ([a-z]+(?: [a-z]+)?)"
TIME = r"\b(before dawn|at dusk|by noon|that winter|at low tide|some time later|the next day|two weeks later|long after midnight|before the thaw|after the flood|during the fair|in the third year)\b"
# Wording that says what something follows from, what is to be seen, and who is meant.
RESULT = r"\b(?:because|weil|porque|car) ([^.,;!?]{3,60})"
CUE = r"\b(rain|fog|wind|storm|snow|sun|dark|light|lamp|fire)"
HE_SHE = r"\b(he|she|they|him|her|them|his|their)\b"
# The first sentence of a text; a text without any end is one sentence. What ends before the one that is cried out.
FIRST_SENTENCE = r"(?s)^\s*(.+?[.!?…。！？।]+[\"”’»」』)]*|.+)"
BEFORE_LOUD = r"(?s)^.*[.?…。！？।]"


def _located(text: Column, span: Column) -> Column:
    """Does a preposition of place stand before the span anywhere in the text?"""
    quoted = F.concat(F.lit(rf"\b({'|'.join(X.SPATIAL)})\s+(the\s+)?\Q"), F.replace(F.lower(span), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.regexp_like(F.lower(text), quoted)


def notes(para: DataFrame, every: bool = False) -> DataFrame:
    """What all later steps need to know of a paragraph, in one reading of the texts: one small row per paragraph.

    narrative: it tells (a list of things does not). mentions: by rule, each span once in a paragraph, where its letters first
    stand, or with `every` each match at its own offset; prep: a preposition of place stands before it somewhere.
    some, summary, he_she, cue: is there a text, its first sentence, and what words it holds. action, causal_result: of the
    sentence that is cried out, null where none is.
    """
    kinds = [("cast", CAST, 0), ("place", PLACE, 1), ("time", TIME, 1)]

    def mention(kind: str, span: Column, start: Column) -> Column:
        prep = _located(F.col("text"), span) if kind == "place" else F.lit(False)
        return F.struct(F.lit(kind).alias("mention_type"), span.alias("span"), X.plain_span(span).alias("plain"), start.cast("int").alias("start_char"), prep.alias("prep"))

    def firsts(kind: str, pattern: str, group: int) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), group)), lambda s: mention(kind, s, F.instr(F.col("text"), s) - 1))

    def all_of(kind: str, pattern: str, group: int) -> Column:
        spans, whole, parts = F.regexp_extract_all("text", F.lit(pattern), group), F.regexp_extract_all("text", F.lit(pattern), 0), F.split("text", pattern, -1)
        # A span is at the end of its match.
        end = lambda i: F.length(F.array_join(F.slice(parts, F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice(whole, F.lit(1), i + 1), ""))
        return F.transform(spans, lambda s, i: mention(kind, s, end(i) - F.length(s)))

    text, low = F.col("text"), F.lower("text")
    loud = F.contains(text, F.lit("!"))
    return para.select(
        *CH, "pid", (F.regexp_count("text", F.lit(";")) < LIST_MARKS).alias("narrative"), F.concat(*[(all_of if every else firsts)(*k) for k in kinds]).alias("mentions"),
        (text != "").alias("some"), F.regexp_extract("text", FIRST_SENTENCE, 1).alias("summary"), low.rlike(HE_SHE).alias("he_she"), low.rlike(CUE).alias("cue"),
        F.when(loud, F.trim(F.concat(F.regexp_replace(F.substring_index("text", "!", 1), BEFORE_LOUD, ""), F.lit("!")))).alias("action"), F.when(loud, F.nullif(F.regexp_extract("text", RESULT, 1), F.lit(""))).alias("causal_result"),
    ).distinct()


def mentions(noted: DataFrame) -> DataFrame:
    """Mentions by rule, the offline stand-in for a model: doc_id, chapter_id, ord, mention_type, span, plain, pid, start_char, prep.

    ord numbers the entities of a chapter by first sight; one entity is one plain span of one kind.
    """
    found = noted.select(*CH, "pid", F.explode("mentions").alias("m")).select(*CH, "pid", "m.*").repartition(*CH)  # moved once, for both windows
    first = found.withColumn("first_pid", F.min("pid").over(Window.partitionBy(*CH, "mention_type", "plain")))
    order = Window.partitionBy(*CH).orderBy("first_pid", "mention_type", "plain")
    return first.select(*CH, F.dense_rank().over(order).alias("ord"), "mention_type", "span", "plain", "pid", "start_char", "prep")


def occurrences(clus: DataFrame, para: DataFrame) -> DataFrame:
    """Every place where a span stands alone (no letter or digit at its sides): cluster, pid, span, start_char, occ (from 1).

    Occurrences of one span do not overlap.
    """
    alone = _spots(clus, para).where(~F.col("before").rlike(r"[\p{L}\p{N}]") & ~F.col("after").rlike(r"[\p{L}\p{N}]"))
    w = Window.partitionBy("cluster_id", "span", *CH, "pid").orderBy("start_char")
    return alone.select("cluster_id", *CH, "ord", "mention_type", "span", "pid", "start_char", F.row_number().over(w).alias("occ"))


def _spots(clus: DataFrame, para: DataFrame) -> DataFrame:
    """Every place where the letters of a span stand, with the characters at its sides (empty at the ends of a text), and prep as in notes.

    The spans of a chapter are one list beside each of its texts, and only those that a text holds become rows.
    """
    spans = clus.select("cluster_id", *CH, "ord", "mention_type", F.explode("raw_spans").alias("span")).where("span <> ''").distinct()
    lists = spans.groupBy(*CH).agg(F.collect_list(F.struct("cluster_id", "ord", "mention_type", "span")).alias("spans"))
    met = para.join(lists, CH).select(*CH, "pid", "text", F.explode(F.filter("spans", lambda s: F.contains(F.col("text"), s["span"]))).alias("s"))
    parts = F.split("text", F.concat(F.lit("\\Q"), F.col("s.span"), F.lit("\\E")), -1)

    def place(k: Column, p: Column) -> Column:
        start = F.aggregate(F.slice(p, F.lit(1), k), F.lit(0), lambda n, x: n + F.length(x)) + (k - 1) * F.length("s.span")
        before = F.when(start == 0, "").otherwise(F.substr("text", start, F.lit(1)))
        return F.struct(start.alias("start_char"), before.alias("before"), F.substr("text", start + F.length("s.span") + 1, F.lit(1)).alias("after"))

    prep = F.when(F.col("s.mention_type") == "place", _located(F.col("text"), F.col("s.span"))).otherwise(F.lit(False))
    each = met.withColumn("parts", parts).select(*CH, "pid", "s.*", prep.alias("prep"), F.explode(F.transform(F.expr("sequence(1, size(parts) - 1)"), lambda k: place(k, F.col("parts")))).alias("at"))
    return each.select("*", "at.*").drop("at").distinct()


# Scripts whose words are not parted by blanks; Hangul puts particles after a name, but nothing before it.
UNPARTED, PARTICLES = "ก-๛ぁ-ヿ一-鿿", "ᄀ-ᇿ가-힣"


def located_mentions(clus: DataFrame, para: DataFrame, ruled: DataFrame) -> DataFrame:
    """Mentions of the given clusters in every language, and of those by rule (ruled, as of mentions) the ones that overlap none of them.

    A letter beside a span hides it only in scripts that part words. A cluster is the entity of its ord; a mention by rule
    belongs to the first cluster of its name, and other entities by rule are numbered after the clusters.
    """
    letter = r"[\p{L}\p{N}]"
    hidden = F.col("before").rlike(letter) & ~F.col("before").rlike(f"[{UNPARTED}]") | F.col("after").rlike(letter) & ~F.col("after").rlike(f"[{UNPARTED}{PARTICLES}]")
    names = clus.select("cluster_id", X.plain_span("cluster_name").alias("name"))
    given = _spots(clus, para).where(~hidden).join(names, "cluster_id").select(*CH, "ord", "mention_type", "span", F.coalesce("name", X.plain_span("span")).alias("plain"), "pid", "start_char", "prep")
    known = given.groupBy(*CH, "mention_type", "plain").agg(F.min("ord").alias("known"))
    top = clus.groupBy(*CH).agg((F.max("ord") + 1).alias("top"))
    r, g = ruled.alias("r"), given.alias("g")
    same = [F.col(f"r.{c}") == F.col(f"g.{c}") for c in (*CH, "pid", "mention_type")]
    over = (F.col("r.start_char") < F.col("g.start_char") + F.length("g.span")) & (F.col("g.start_char") < F.col("r.start_char") + F.length("r.span"))
    more = r.join(g, [*same, over], "left_anti").join(known, [*CH, "mention_type", "plain"], "left").join(top, CH, "left")
    more = more.withColumn("ord", F.coalesce("known", F.col("ord") + F.coalesce("top", F.lit(0))))
    return given.unionByName(more.select(*given.columns))


def entity_id(ord_col: str | Column = "ord") -> Column:
    return F.concat(F.lit("ent_"), X.padded(ord_col, 3))


def place_scores(occ: DataFrame) -> DataFrame:
    """Per paragraph and place: 1, +1 each if seen in the paragraph before or after, +0.5 if seen in two or more, +1 after a preposition of place."""
    seen = occ.where("mention_type = 'place'").groupBy(*CH, "ord", "pid").agg(F.max("prep").alias("prep"))
    w = Window.partitionBy(*CH, "ord").orderBy("pid")
    all_of = Window.partitionBy(*CH, "ord")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    score = 1.0 + one(F.lag("pid").over(w) == F.col("pid") - 1) + one(F.lead("pid").over(w) == F.col("pid") + 1) + F.when(F.count("*").over(all_of) >= 2, 0.5).otherwise(0.0) + one(F.col("prep"))
    return seen.select(*CH, "pid", "ord", score.alias("score"))


def active_cast(occ: DataFrame, noted: DataFrame) -> DataFrame:
    """Per paragraph the cast seen in it or the two before, with what entered and left since the paragraph before."""
    seen = occ.where("mention_type = 'cast'").select(*CH, "pid", "ord").distinct()
    reach = seen.withColumn("pid", F.explode(F.sequence(F.col("pid"), F.col("pid") + CAST_WINDOW))).distinct()
    lists = reach.groupBy(*CH, "pid").agg(F.array_sort(F.collect_list(entity_id())).alias("active"))
    w = Window.partitionBy(*CH).orderBy("pid")
    none = F.expr("cast(array() as array<string>)")
    out = noted.select(*CH, "pid").join(lists, [*CH, "pid"], "left").withColumn("active", F.coalesce("active", none)).withColumn("prev", F.coalesce(F.lag("active").over(w), none))
    return out.select(*CH, "pid", "active", X.drop("active", "prev").alias("entered"), X.drop("prev", "active").alias("exited"))


def place_states(scores: DataFrame, noted: DataFrame) -> DataFrame:
    """The place of every paragraph, by a fold over the best scored place of each (ties: the first entity)."""
    best = scores.groupBy(*CH, "pid").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"))).alias("b")).select(*CH, "pid", entity_id(-F.col("b.o")).alias("best"), F.col("b.score").alias("score"))
    items = noted.select(*CH, "pid").join(best, [*CH, "pid"], "left").groupBy(*CH).agg(F.array_sort(F.collect_list(F.struct("pid", "best", "score"))).alias("items"))
    return items.select(*CH, F.explode(folds.place_track(F.col("items"))).alias("s")).select(*CH, "s.*")


def frames(occ: DataFrame, noted: DataFrame) -> DataFrame:
    """One row per paragraph: active cast, place, time signals, and whether it tells."""
    times = occ.where("mention_type = 'time'").groupBy(*CH, "pid").agg(F.array_sort(F.collect_set("span")).alias("times"))
    out = active_cast(occ, noted).join(place_states(place_scores(occ), noted), [*CH, "pid"]).join(times, [*CH, "pid"], "left").join(noted.select(*CH, "pid", "narrative"), [*CH, "pid"])
    return out.withColumn("times", F.coalesce("times", F.expr("cast(array() as array<string>)")))


def boundaries(fr: DataFrame) -> DataFrame:
    """Scores between neighbouring telling frames: place shift 4, place set again 2, cast turnover 2 or 1, time signal 1."""
    w = Window.partitionBy(*CH).orderBy("pid")
    f = fr.where("narrative").select(*CH, "pid", "place", "active", "times").withColumns({"p_place": F.lag("place").over(w), "p_active": F.lag("active").over(w), "had": F.max(F.col("place").isNotNull()).over(w.rowsBetween(Window.unboundedPreceding, -2))})
    union, both = F.size(F.array_union("p_active", "active")), F.size(F.array_intersect("p_active", "active"))
    delta = F.when(union > 0, 1.0 - both / union).otherwise(0.0)
    turnover = union - 2 * both
    shift = F.coalesce(F.col("p_place") != F.col("place"), F.lit(False))
    again = F.col("p_place").isNull() & F.col("place").isNotNull() & F.coalesce("had", F.lit(False))
    score = (
        F.when(shift, 4.0).when(again, 2.0).otherwise(0.0)
        + F.when((delta >= 0.75) & (turnover >= 2), 2.0).when((delta >= 0.5) & (turnover >= 1), 1.0).otherwise(0.0)
        + F.when(F.size("times") > 0, 1.0).otherwise(0.0)
    )
    return f.where(F.col("p_active").isNotNull()).select(*CH, "pid", score.alias("score"), F.round(delta, 6).alias("delta"), turnover.alias("turnover"))


def resolved(bounds: DataFrame) -> DataFrame:
    items = bounds.where(F.col("score") >= WEAK).groupBy(*CH).agg(F.array_sort(F.collect_list(F.struct("pid", "score"))).alias("items"))
    return items.select(*CH, F.explode(folds.competing(F.col("items"))).alias("b")).select(*CH, "b.pid", "b.score", F.when(F.col("b.score") >= SCENE, "scene_boundary").otherwise("weak_boundary_candidate").alias("label"))


def _enforce(telling: list[int], bounds: list[tuple[int, float]], least: int) -> list[int]:
    """Drops, one at a time, the lower scored boundary beside the first scene that is too short."""
    score, kept = dict(bounds), sorted(p for p, _ in bounds)
    while kept:
        starts = [telling[0], *kept]
        ends = [*(p - 1 for p in kept), telling[-1]]
        short = next((i for i, (a, b) in enumerate(zip(starts, ends, strict=True)) if sum(a <= p <= b for p in telling) < least), None)
        if short is None:
            break
        left = float("inf") if short == 0 else score[starts[short]]
        right = score[starts[short + 1]] if short + 1 < len(starts) else float("inf")
        kept.remove(starts[short] if left <= right else starts[short + 1])
    return kept


def scenes(fr: DataFrame, res: DataFrame, least: int = LEAST_SCENE) -> DataFrame:
    """Scene spans of every chapter; a chapter in which nothing tells is one scene [0, 0]."""
    telling = fr.groupBy(*CH).agg(F.array_sort(F.collect_list(F.when(F.col("narrative"), F.col("pid")))).alias("telling"))
    marks = res.where("label = 'scene_boundary'").groupBy(*CH).agg(F.array_sort(F.collect_list(F.struct("pid", "score"))).alias("marks"))

    def lay(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples():
                tell = [int(p) for p in r.telling]
                if not tell:
                    out.append((r.doc_id, r.chapter_id, 1, 0, 0))
                    continue
                marks = [] if r.marks is None else [(int(m["pid"]), float(m["score"])) for m in r.marks]
                starts = [tell[0], *_enforce(tell, marks, least)]
                for i, s in enumerate(starts):
                    end = tell[-1] if i + 1 == len(starts) else max(p for p in tell if p < starts[i + 1])
                    out.append((r.doc_id, r.chapter_id, i + 1, s, end))
            yield pd.DataFrame(out, columns=["doc_id", "chapter_id", "scene_no", "start_pid", "end_pid"])

    spans = telling.join(marks, CH, "left").mapInPandas(lay, "doc_id string, chapter_id string, scene_no int, start_pid int, end_pid int")
    return spans.withColumn("scene_id", F.concat(F.lit("scene_"), X.padded("scene_no")))


def _ordered(value: str, key: str = "pid") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])


def _inside(sc: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of paragraphs with the scene that holds them: the scenes of a chapter are one list beside its rows, and one is looked up."""
    lists = sc.groupBy(*CH).agg(F.collect_list(F.struct("scene_no", "start_pid", "end_pid")).alias("scenes"))
    hit = F.filter("scenes", lambda s: F.col("pid").between(s["start_pid"], s["end_pid"]))
    return rows.join(lists, CH).select(*[c for c in rows.columns], F.explode(F.transform(hit, lambda s: s["scene_no"])).alias("scene_no"))


def packets(sc: DataFrame, fr: DataFrame, res: DataFrame, noted: DataFrame) -> DataFrame:
    """One row per scene: its paragraphs, ordered unions of cast, places and times, weak boundaries inside, neighbours, and what its first paragraph is like."""
    told = noted.select(*CH, "pid", F.struct("some", "summary", "he_she", "cue").alias("told"))
    inside = _inside(sc, fr.where("narrative").join(told, [*CH, "pid"]))
    of = inside.groupBy(*CH, "scene_no").agg(
        F.array_sort(F.collect_list("pid")).alias("pids"),
        F.array_distinct(F.flatten(_ordered("active"))).alias("cast_union"),
        F.array_distinct(F.filter(_ordered("place"), lambda p: p.isNotNull())).alias("places"),
        F.array_distinct(F.flatten(_ordered("times"))).alias("time_signals"),
        F.min_by("told", "pid").alias("first"),
    )
    weak = sc.alias("s").join(res.where("label = 'weak_boundary_candidate'").select(*CH, F.col("pid").alias("at")), CH).where("at > start_pid and at <= end_pid").groupBy(*CH, "scene_no").agg(F.array_sort(F.collect_list("at")).alias("phase_markers"))
    w = Window.partitionBy(*CH).orderBy("scene_no")
    none = lambda c, t: F.coalesce(c, F.expr(f"cast(array() as array<{t}>)"))
    out = sc.withColumns({"previous_scene": F.lag("scene_id").over(w), "next_scene": F.lead("scene_id").over(w)}).join(of, [*CH, "scene_no"], "left").join(weak, [*CH, "scene_no"], "left")
    out = out.withColumns({"pids": none("pids", "int"), "cast_union": none("cast_union", "string"), "places": none("places", "string"), "time_signals": none("time_signals", "string"), "phase_markers": none("phase_markers", "int")})
    no = lambda c: F.coalesce(f"first.{c}", F.lit(False)).alias(c)
    return out.select("*", no("some"), F.col("first.summary").alias("summary"), no("he_she"), no("cue")).drop("first")


def scene_texts(sc: DataFrame, fr: DataFrame, para: DataFrame) -> DataFrame:
    """doc_id, chapter_id, scene_id, scene_text: the marked texts of the telling paragraphs. The texts of a chapter are brought together once."""
    texts = para.groupBy(*CH).agg(F.collect_set(F.struct("pid", "text")).alias("texts"))
    telling = fr.where("narrative").groupBy(*CH).agg(F.collect_set("pid").alias("telling"))
    lists = sc.groupBy(*CH).agg(F.collect_list(F.struct("scene_id", "start_pid", "end_pid")).alias("scenes")).join(telling, CH, "left")
    told = F.array_sort(F.filter("texts", lambda t: t["pid"].between(F.col("s.start_pid"), F.col("s.end_pid")) & F.array_contains("telling", t["pid"])))
    each = lists.join(texts, CH).select(*CH, "telling", "texts", F.explode("scenes").alias("s"))
    joined = F.array_join(F.transform(told, lambda t: F.concat(F.lit("[P"), t["pid"], F.lit("] "), t["text"])), "\n\n")
    return each.select(*CH, "s.scene_id", F.nullif(joined, F.lit("")).alias("scene_text"))


def title_context(packed: DataFrame, fr: DataFrame, para: DataFrame, paragraphs: int = 3, chars: int = 400) -> DataFrame:
    """What a scene's title is asked with: its places at both ends, its first cast, and a look into its first paragraphs. Only their texts are shuffled."""
    ends = packed.select(*CH, "scene_no", "scene_id", F.get("pids", F.lit(0)).alias("first"), F.get("pids", F.size("pids") - 1).alias("last"))
    at = lambda c, *cols: fr.select(*CH, F.col("pid").alias(c), *cols)
    head = packed.select(*CH, "scene_no", F.explode(F.slice("pids", 1, paragraphs)).alias("pid"))
    texts = head.join(para, [*CH, "pid"]).groupBy(*CH, "scene_no").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("pid", "text"))), lambda t: t["text"]), " "), 1, chars).alias("preview"))
    out = ends.join(at("first", F.col("place").alias("start_place"), F.col("active").alias("active_cast")), [*CH, "first"], "left").join(at("last", F.col("place").alias("end_place")), [*CH, "last"], "left").join(texts, [*CH, "scene_no"], "left")
    return out.select(*CH, "scene_id", "start_place", "end_place", F.coalesce("active_cast", F.expr("cast(array() as array<string>)")).alias("active_cast"), F.coalesce("preview", F.lit("")).alias("preview"))
