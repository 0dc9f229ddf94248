"""Spellings of one person or company linked within a book, by merge-and-rematch resolution.

Every record (a cluster with its spans, a label) is read into forms: a full name, a weak form (an
initial or a shortened first name with a surname), a single name, a company, or a name in a script
without letter case. Titles and honorifics go, "surname, first" is turned round, nicknames lead to
their first name, characters are canonical and digits that stand for letters are undone. A role
description (an article, then common words) is no name and takes no part.

Round one merges records that share a full name, and full names of which surname and first name are
each the same or one slip apart (an edit, a swap, an OCR confusion). A merged profile unites the
spellings of its records: surnames, first names, initials. These richer profiles re-enter blocking:
two profiles merge when any first name and any surname of the one are those of the other, and
a record without a full name joins the only profile of its book that one of its spellings fits best;
if two profiles fit alike, it stays alone. What merged or joined may add spellings, so this is repeated
until nothing merges or joins any more; a round compares only the spellings that are new.

Blocking is by book, surname and first name, each with one character left out, so names one slip apart
meet and relatives of one surname do not; nothing is compared outside such a block, and no book is
gathered in one task. Forms are compared once per book however many records carry them. Null names and
empty names take no part; repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType

from fabulary.llm.normalize import canonical
from fabulary.session import cut

HOT = 200

# Nicknames by the first name they stand for.
NICKNAMES = {
    "alexander": "sandy alec alex sander", "anthony": "tony ant", "cornelius": "neil corny con", "dorothy": "dot dolly dottie dora", "edward": "ned ted eddie teddy", "elizabeth": "liz lizzie beth betty betsy eliza lisbeth bess",
    "frederick": "fred freddie freddy fritz", "gabriel": "gabe gab", "harriet": "hattie hatty harry", "josephine": "josie jo", "katherine": "kate kitty kathy katie kit", "leonard": "len lenny leo lennie", "margaret": "meg maggie peggy peg daisy greta",
    "matthias": "matz matt mat", "nicholas": "nick nico nicky", "penelope": "nell penny pen", "rebecca": "becky becca", "robert": "rob bob bobby robbie", "susanna": "sue susie sukey suzy", "thomas": "tom tommy", "ursula": "ulla ursel uschi",
    "victoria": "tori vicky vick", "william": "bill billy will willie", "zoe": "zo", "chloe": "clo", "helene": "lena lene", "jurgen": "jurg", "jose": "pepe", "renee": "ren", "bjorn": "bear",
}
FORMAL = {n: k for k, v in NICKNAMES.items() for n in v.split()}
# Titles before a name, honorifics around a name, and articles before a description.
TITLES = set("mr mrs ms miss dr doctor prof professor capt captain judge sister brother father mother old young sir lady lord madam madame mme mlle m st hr herr frau fr sr sra srta dra don doña dona rev reverend colonel col major sergeant sgt lt lieutenant uncle aunt".split())
SUFFIXES = ["先生", "小姐", "女士", "さん", "さま", "様", "くん", "ちゃん", "선생님", "선생", "씨", "님", "양", "군", "जी", "साहब"]
PREFIXES = ["老", "小", "श्री", "श्रीमती", "ครู", "คุณ", "นาย", "นาง", "นางสาว"]
ARTICLES = set("the a an le la les l un une der die das den dem des ein eine einen el los las una".split())
COMPANY = {"company": "company", "co": "company", "brothers": "brothers", "bros": "brothers", "society": "society", "soc": "society", "shipping": "shipping", "ship": "shipping", "office": "shipping", "off": "shipping", "sons": "sons", "ltd": "company", "inc": "company"}
AND = {"&", "and", "und", "et", "y"}

_OCR = str.maketrans("015", "ols")
_CAMEL = re.compile(r"^[A-ZÀ-Þ][A-ZÀ-Þ][a-zà-ÿ]")


@lru_cache(maxsize=100_000)
def fold(token: str) -> str:
    """Lower case without accents; digits inside words become the letters they stand for."""
    plain = "".join(c for c in unicodedata.normalize("NFD", token.lower()) if not unicodedata.combining(c)).replace("ß", "ss")
    return plain.translate(_OCR) if re.search("[a-z]", plain) else plain


def parse(original: str) -> tuple[str, str, str] | None:
    """(kind, first, last) of a spelling; None: it is no name.

    Kinds: full, weak (first is an initial or a beginning), single (in last; first is an initial glued to it, or
    empty), company (first is the kind of firm, last its names), acronym, plain (a script without letter case).
    """
    text = " ".join(canonical(original).replace(".", ". ").split())
    if not text:
        return None
    if not re.search("[A-Za-z]", unicodedata.normalize("NFD", text)):
        key, changed = text, True
        while changed:
            changed = False
            for s in SUFFIXES:
                if key.endswith(s) and len(key.rstrip()) - len(s) >= 2:
                    key, changed = key[: -len(s)].rstrip(), True
            for s in PREFIXES:
                if key.startswith(s) and len(key) - len(s) >= (3 if len(s) == 1 else 2):
                    key, changed = key[len(s) :].lstrip(), True
        return "plain", "spaced" if " " in key else "", key.replace(" ", "")
    words = text.split()
    if words[0].rstrip("'’.") in ARTICLES and words[0][0].islower():
        return None
    if m := re.fullmatch(r"([A-Z]{2,5}) of (\S+)", text):
        return "acronym", m[1].lower(), fold(m[2])
    kinds = [COMPANY[w] for w in (fold(x.strip(".,")) for x in words) if w in COMPANY]
    if "&" in words or kinds or any(w in AND for w in words[1:-1]):
        names = [fold(p) for w in words if w not in AND and fold(w.strip(".,")) not in COMPANY for p in w.strip(".,").split("-") if p]
        return ("company", kinds[0] if kinds else "", " ".join(sorted(names))) if len(names) >= 2 else None
    if "," in text:
        last, _, rest = text.partition(",")
        words = [*rest.split(), *last.split()]
    while len(words) > 1 and fold(words[0].strip(".")) in TITLES and not (len(words[0].strip(".")) == 1 and len(words) > 1 and words[0] != "M."):
        words = words[1:]
    words = [w for w in words if w.strip(".,")]
    if len(words) >= 2:
        first, last = words[0].strip(","), fold(words[-1].strip(".,"))
        short = first.endswith(".") or len(first) == 1
        return ("weak" if short else "full"), fold(first.strip(".")), last
    if not words:
        return None
    token = words[0].strip(".,")
    if _CAMEL.match(token):
        return "single", fold(token[0]), fold(token[1:])
    return "single", "", fold(token)


def formal(first: str) -> str:
    return FORMAL.get(first, first)


@lru_cache(maxsize=200_000)
def slips(a: str, b: str) -> int:
    """0: the same; 1: one edit, one swap of neighbours or one OCR confusion apart; 2: more."""
    if a == b:
        return 0
    if a.replace("rn", "m") == b.replace("rn", "m"):
        return 1
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return 2
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    tail_a, tail_b = a[k:], b[k:]
    if len(a) == len(b):
        return 1 if tail_a[1:] == tail_b[1:] or (len(tail_a) > 1 and tail_a[0] == tail_b[1] and tail_a[1] == tail_b[0] and tail_a[2:] == tail_b[2:]) else 2
    return 1 if (tail_a[1:] == tail_b if len(a) > len(b) else tail_b[1:] == tail_a) else 2


def same_first(a: str, b: str) -> bool:
    return slips(formal(a), formal(b)) < 2


def left_out(name: str) -> list[str]:
    """The name, and the name with any one character left out: what blocks are keyed by."""
    forms = dict.fromkeys([name, name.replace("rn", "m")])
    return list(dict.fromkeys(k for n in forms for k in ([n, *(n[:i] + n[i + 1 :] for i in range(len(n)))] if len(n) >= 4 else [n])))


def _fits(kind: str, first: str, last: str, p_first: str, p_last: str) -> int:
    """How well a weak or single form fits a profile's full form: 2 the same surname, 1 a slip apart, 0 not."""
    if kind == "given":
        return 2 if formal(last) == formal(p_first) else int(same_first(last, p_first))
    if first and not (formal(p_first).startswith(first) or p_first.startswith(first) or formal(first) == formal(p_first)):
        return 0
    return 2 - slips(last, p_last)


@F.pandas_udf(BooleanType())
def _one_person(a_first: pd.Series, a_last: pd.Series, b_first: pd.Series, b_last: pd.Series) -> pd.Series:
    return pd.Series([slips(x, y) < 2 and same_first(p, q) for p, x, q, y in zip(a_first, a_last, b_first, b_last, strict=True)])


@F.pandas_udf(BooleanType())
def _one_company(a_first: pd.Series, a_last: pd.Series, b_first: pd.Series, b_last: pd.Series) -> pd.Series:
    def same(p: str, x: str, q: str, y: str) -> bool:
        if p and q and p != q:
            return False
        x, y = x.split(), y.split()
        return len(x) == len(y) and (all(slips(i, j) < 2 for i, j in zip(x, y, strict=True)) or all(slips(i, j) < 2 for i, j in zip(x, reversed(y), strict=True)))

    return pd.Series([same(*r) for r in zip(a_first, a_last, b_first, b_last, strict=True)])


@F.pandas_udf(IntegerType())
def _fit(kind: pd.Series, first: pd.Series, last: pd.Series, p_first: pd.Series, p_last: pd.Series) -> pd.Series:
    return pd.Series([_fits(*r) for r in zip(kind, first, last, p_first, p_last, strict=True)], dtype="int32")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the least node of the connected component; edges: a, b. By min-label propagation with pointer jumping."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(nodes.select(F.col("node"), F.col("node").alias("label")))
    while True:
        near = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("n")).agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["n"], "left").select("node", F.least("label", F.coalesce("near", "label")).alias("next"), "label")
        hop = lower.select(F.col("node").alias("m"), F.col("next").alias("far"))
        jumped = cut(lower.join(hop, lower["next"] == hop["m"], "left").select("node", F.least("next", F.coalesce("far", "next")).alias("next"), "label"))
        labels = jumped.select("node", F.col("next").alias("label"))
        if jumped.where("next <> label").isEmpty():
            return labels


def _forms(records: DataFrame) -> DataFrame:
    """records: doc_id, rec, name, original. Out: these with kind, first, last; rec: the records that carry one set of spellings."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(d, r, n, s, *(parse(s) or ("none", "", ""))) for d, r, n, s in zip(rows["doc_id"], rows["rec"], rows["name"], rows["original"], strict=True)]
            yield pd.DataFrame(found, columns=["doc_id", "rec", "name", "original", "kind", "first", "last"])

    return records.select("doc_id", "rec", "name", "original").mapInPandas(read, "doc_id string, rec binary, name string, original string, kind string, first string, last string")


def _left_out(col: str | Column) -> Column:
    """left_out as an expression."""
    name = F.col(col) if isinstance(col, str) else col

    def one(n: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(n)), lambda i: F.concat(F.substr(n, F.lit(1), i - 1), F.substr(n, i + 1)))
        return F.when(F.length(n) >= 4, F.concat(F.array(n), every)).otherwise(F.array(n))

    return F.array_distinct(F.when(F.contains(name, F.lit("rn")), F.concat(one(name), one(F.replace(name, F.lit("rn"), F.lit("m"))))).otherwise(one(name)))


def _formal(col: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FORMAL.items() for x in pair])
    return F.coalesce(F.element_at(table, F.col(col)), F.col(col))


def _id(*cols: str | Column) -> Column:
    """A short key of the columns: twelve bytes of a digest."""
    return F.unhex(F.substring(F.md5(F.concat_ws("\u0001", *cols)), 1, 24))


def _block(*cols: str | Column) -> Column:
    return F.xxhash64(*cols)


def _merged(edges: DataFrame) -> DataFrame:
    """old, new: what the entities of the edges (a, b) become."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return components(nodes, edges).select(F.col("node").alias("old"), F.col("label").alias("new"))


def _renamed(df: DataFrame, names: DataFrame) -> DataFrame:
    return df.join(names, df["entity"] == names["old"], "left").withColumn("entity", F.coalesce("new", "entity")).drop("old", "new")


def _alike(x: DataFrame, y: DataFrame, ids: str) -> DataFrame:
    """a, b (of the column ids): pairs of full names of one book (book, first, last) that are one person's; y holds x.

    Blocks are of surnames; those of more than HOT names are split by first names.
    """

    def keyed(df: DataFrame) -> DataFrame:
        return df.select(F.col(ids).alias("id"), "book", "first", "last").distinct().withColumn("key", F.explode(F.transform(_left_out("last"), lambda p: _block("book", p))))

    names = keyed(y)
    hot = names.groupBy("key").agg(F.count("*").alias("names")).where(F.col("names") > HOT).select("key", F.lit(True).alias("hot"))

    def split(df: DataFrame) -> DataFrame:
        both = F.transform(_left_out(_formal("first")), lambda f: _block("key", f))
        return df.join(hot, "key", "left").withColumn("key", F.explode(F.when(F.col("hot"), both).otherwise(F.array("key")))).drop("hot")

    a, b = split(keyed(x)).alias("x"), split(names).alias("y")
    met = a.join(b, F.expr("x.key = y.key and x.book = y.book and x.id <> y.id"))
    met = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.first").alias("first_a"), F.col("x.last").alias("last_a"), F.col("y.first").alias("first_b"), F.col("y.last").alias("last_b")).distinct()
    return met.where(_one_person("first_a", "last_a", "first_b", "last_b")).select("a", "b").distinct()


def _company_edges(strong: DataFrame) -> DataFrame:
    firm = strong.where("kind = 'company'").withColumn("key", F.explode(F.array_distinct(F.flatten(F.transform(F.split("last", " "), lambda w: F.array(w, F.substring(w, 1, 4)))))))
    met = firm.alias("x").join(firm.alias("y"), F.expr("x.book = y.book and x.key = y.key and x.form < y.form")).select("x.form", "x.first", "x.last", F.col("y.form").alias("form_b"), F.col("y.first").alias("first_b"), F.col("y.last").alias("last_b")).distinct()
    edges = met.where(_one_company("first", "last", "first_b", "last_b")).select(F.col("form").alias("a"), F.col("form_b").alias("b"))
    initials = F.array_join(F.array_sort(F.transform(F.concat(F.split(F.col("f.last"), " "), F.array(F.col("f.first"))), lambda w: F.substring(w, 1, 1))), "")
    words = strong.where("kind = 'company' and first <> ''").withColumn("word", F.explode(F.array_distinct(F.split("last", " "))))
    acronym = strong.where("kind = 'acronym'").alias("a").join(words.alias("f"), F.expr("a.book = f.book and a.last = f.word"))
    short = F.array_join(F.array_sort(F.split("a.first", "")), "")
    return edges.unionByName(acronym.where(short == initials).select(F.col("a.form").alias("a"), F.col("f.form").alias("b")))


def link_names(mentions: DataFrame) -> DataFrame:
    """mentions: doc_id, name (as it is to be reported), originals array<string> (spellings with their case).

    Out: doc_id, entity, name: the names of every entity. A name that no other name is linked with stands alone.
    """
    rows = mentions.where("doc_id is not null and name is not null and name <> ''").select("doc_id", "name", F.array_sort(F.array_distinct(F.filter(F.coalesce("originals", F.array()), lambda x: x.isNotNull() & (x != "")))).alias("originals")).distinct()
    recs = rows.select("doc_id", "name", _id("doc_id", "name", F.array_join("originals", "\u0001")).alias("rec"), F.explode_outer("originals").alias("original"))
    raw = cut(_forms(recs.withColumn("original", F.coalesce("original", "name"))).withColumn("book", F.xxhash64("doc_id")))

    # A name of which no spelling is a name (a description) takes no part.
    parsed = raw.where("kind <> 'none'")
    nick = parsed.sparkSession.createDataFrame([(n,) for n in [*FORMAL, *NICKNAMES]], "g string")
    given = parsed.where("kind = 'full'").groupBy("first").agg(F.count_distinct("book").alias("books")).where("books > 1").select(F.col("first").alias("g")).unionByName(nick).distinct()
    kinded = parsed.join(given, (parsed["last"] == given["g"]) & (parsed["kind"] == "single") & (parsed["first"] == ""), "left")
    forms = kinded.select("book", "rec", F.when(F.col("g").isNotNull(), "given").otherwise(F.col("kind")).alias("kind"), "first", "last").distinct()
    # A spelling of two names, one given and one not, in one record: a full name.
    parts = forms.where("kind = 'given'").select("rec", F.col("last").alias("f")).join(forms.where("kind = 'single' and first = ''").select("book", "rec", F.col("last").alias("l")), "rec")
    whole = forms.where("kind = 'full'").select("rec").distinct()
    derived = parts.join(whole, "rec", "left_anti").select("book", "rec", F.lit("full").alias("kind"), F.col("f").alias("first"), F.col("l").alias("last"))
    forms = cut(forms.unionByName(derived).distinct().withColumn("form", _id(F.col("book").cast("string"), "kind", "first", "last")))

    once = forms.select("book", "form", "kind", "first", "last").distinct()
    strong = cut(once.where("kind in ('full', 'company', 'acronym', 'plain')"))
    full = strong.where("kind = 'full'")
    edges = _alike(full, full, "form").where("a < b").unionByName(_company_edges(strong))
    # Names in scripts without case: equal but for blanks, where the book has the form without blanks.
    spaced = strong.where("kind = 'plain' and first = 'spaced'").alias("s").join(strong.where("kind = 'plain' and first = ''").alias("p"), F.expr("s.book = p.book and s.last = p.last"))
    edges = edges.unionByName(spaced.select(F.col("s.form").alias("a"), F.col("p.form").alias("b")))

    lone = once.where("kind = 'plain' and first = 'spaced'").join(spaced.select(F.col("s.form").alias("form")).distinct(), "form", "left_anti").select("form")
    sure = forms.where("kind in ('full', 'company', 'acronym', 'plain')").join(lone, "form", "left_anti")
    edges = edges.unionByName(sure.select(F.col("rec").alias("a"), F.col("form").alias("b")))
    nodes = forms.select(F.col("rec").alias("node")).unionByName(sure.select(F.col("form").alias("node"))).distinct()
    label = components(nodes, edges)
    member = cut(forms.select("rec").distinct().join(label, F.col("rec") == F.col("node")).select("rec", F.col("label").alias("entity")))
    settled = sure.select("rec").distinct()

    weak = F.col("kind").isin("weak", "single", "given")
    spelled = cut(member.join(settled, "rec", "left_semi").join(forms, "rec").select("book", "entity", "kind", "first", "last").distinct())
    waiting = cut(forms.join(settled, "rec", "left_anti").where(weak).select("rec", "book", "form", "kind", "first", "last"))
    known = fits = None
    # Ends, as every round but the last merges profiles or settles records.
    while True:
        # Profiles: every full form, and every surname that a settled record spells, with the profile's first names.
        own = spelled.where("kind = 'full'").select("book", "entity", "first", "last")
        extra = spelled.where("kind in ('single', 'weak')").select("entity", F.col("last").alias("extra")).distinct()
        profile = own.unionByName(own.join(extra, "entity").select("book", "entity", "first", F.col("extra").alias("last"))).distinct()
        fresh = cut(profile if known is None else profile.join(known, ["book", "entity", "first", "last"], "left_anti"))
        every = fresh if known is None else known.unionByName(fresh)
        # What the new spellings fit.
        open_forms = waiting.select("book", "form", "kind", "first", "last").distinct()
        by_name = open_forms.where("kind <> 'given'").withColumn("key", F.explode(F.transform(_left_out("last"), lambda p: _block("book", p))))
        by_last = by_name.join(fresh.select("book", "entity", F.col("first").alias("p_first"), F.col("last").alias("p_last"), F.explode(F.transform(_left_out("last"), lambda p: _block("book", p))).alias("key")), ["book", "key"])
        firsts = fresh.select("book", "entity", F.col("first").alias("p_first")).distinct().select("*", F.explode(F.transform(_left_out(_formal("p_first")), lambda p: _block("book", p))).alias("key"), F.lit("").alias("p_last"))
        by_first = open_forms.where("kind = 'given'").withColumn("key", F.explode(F.transform(_left_out(_formal("last")), lambda p: _block("book", p)))).join(firsts, ["book", "key"])
        cols = ["form", "kind", "first", "last", "entity", "p_first", "p_last"]
        found = by_last.select(*cols).unionByName(by_first.select(*cols)).distinct().withColumn("fit", _fit("kind", "first", "last", "p_first", "p_last")).where("fit > 0").select("form", "entity", "fit")
        fits = cut((found if fits is None else fits.unionByName(found)).groupBy("form", "entity").agg(F.max("fit").alias("fit")))
        # Profiles that their new spellings make one.
        same = cut(_alike(fresh, every, "entity"))
        merged = not same.isEmpty()
        if merged:
            names = cut(_merged(same))
            member, spelled, fits, every = (_renamed(x, names) for x in (member, spelled, fits, every))
            fits = fits.groupBy("form", "entity").agg(F.max("fit").alias("fit"))
        per_rec = waiting.select("rec", "form").join(fits, "form").groupBy("rec", "entity").agg(F.sum("fit").alias("fit"))
        ranked = per_rec.groupBy("rec").agg(F.max(F.struct("fit", "entity")).alias("best"), F.collect_list("fit").alias("all"))
        joined = cut(ranked.where(F.size(F.filter("all", lambda f: f == F.col("best")["fit"])) == 1).select("rec", F.col("best.entity").alias("new")))
        some = not joined.isEmpty()
        if not (merged or some):
            break
        known = cut(every.distinct())
        if some:
            member = member.join(joined, "rec", "left").select("rec", F.coalesce("new", "entity").alias("entity"))
            spelled = spelled.unionByName(waiting.join(joined, "rec").select("book", F.col("new").alias("entity"), "kind", "first", "last")).distinct()
            waiting = cut(waiting.join(joined, "rec", "left_anti"))
        member, spelled, fits = cut(member), cut(spelled.distinct()), cut(fits) if merged else fits
    # Records that no profile took: those of one form stay together, and weak forms of one surname and initial with them.
    loose = waiting.where("kind <> 'given' and first <> ''").select("book", "form", "first", "last").distinct().withColumn("key", F.explode(F.transform(_left_out("last"), lambda p: _block("book", p, F.substring("first", 1, 1)))))
    met = loose.alias("x").join(loose.alias("y"), F.expr("x.book = y.book and x.key = y.key and x.form < y.form and (startswith(x.first, y.first) or startswith(y.first, x.first))"))
    met = met.select("x.form", "x.first", "x.last", F.col("y.form").alias("form_b"), F.col("x.first").alias("first_b"), F.col("y.last").alias("last_b")).distinct()
    tied = met.where(_one_person("first", "last", "first_b", "last_b")).select(F.col("form").alias("a"), F.col("form_b").alias("b"))
    carried = waiting.select(F.col("rec").alias("a"), F.col("form").alias("b"))
    label = components(carried.select(F.explode(F.array("a", "b")).alias("node")).distinct(), carried.unionByName(tied))
    alone = waiting.select("rec").distinct().join(label, F.col("rec") == F.col("node")).select("rec", F.col("label").alias("alone"))
    entity = F.lower(F.hex(F.coalesce("alone", "entity")))
    return raw.select("doc_id", "name", "rec").distinct().join(member, "rec").join(alone, "rec", "left").select("doc_id", entity.alias("entity"), "name").distinct()


def name_pairs(entities: DataFrame) -> DataFrame:
    """doc_id, name_a, name_b with name_a < name_b, distinct, of names of one entity."""
    x, y = entities.alias("x"), entities.alias("y")
    return x.join(y, F.expr("x.doc_id = y.doc_id and x.entity = y.entity and x.name < y.name")).select("x.doc_id", F.col("x.name").alias("name_a"), F.col("y.name").alias("name_b")).distinct()
