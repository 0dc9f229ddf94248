import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from fabulary.llm import normalize
from fabulary.llm.normalize import canonical, canonical_segment, canonical_text, look_alike_pairs, needs_look

ODD = "aé éӧｅ가각​ ำกेक़ｶﾞ…̖̀﻿　ΑνЅ😀\U0001d400"


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(ODD), st.characters(exclude_categories=["Cs"])), max_size=12))
def test_splicing_equals_normalising_the_whole(text):
    assert canonical(text) == canonical_segment(text)
    assert canonical(canonical(text)) == canonical(text)


def test_what_is_and_is_not_visible():
    same = ["Ｅｄｗａｒｄ", "Edw​ard", "Еdwаrd"]
    assert {canonical(x) for x in same} == {"Edward"}
    assert canonical("café noir") == "café noir"
    for a, b in (("Cafe", "café"), ("Edward", "edward"), ("a b", "ab"), ("“a”", '"a"'), ("l", "1")):
        assert canonical(a) != canonical(b)


def test_quick_check_never_hides_an_unstable_text(spark):
    points = [chr(p) for p in range(0x20, 0x10000) if not 0xD800 <= p < 0xE000 and unicodedata.category(chr(p)) != "Cn"]
    texts = [(c,) for c in points] + [("a" + c,) for c in points if unicodedata.combining(c)]
    passed = spark.createDataFrame(texts, "t string").where(~needs_look(__import__("pyspark").sql.functions.col("t"))).collect()
    assert len(passed) > 20_000
    assert all(canonical(r.t) == r.t for r in passed)


def test_pairs_with_nulls_repeats_and_groups(spark):
    rows = [("k", 1, "p", "a b"), ("k", 1, "p", "a b"), ("k", 2, "p", "a b"), ("k", 3, "q", "a b"), ("k", 4, "p", "a b"), ("k", 5, "p", None), ("k", None, "p", "a b"), ("k", 6, None, "a b"), ("k", 7, "p", ""), ("k", 8, "p", "​")]
    df = spark.createDataFrame(rows, "record_kind string, record_id long, place string, text string")
    got = {(r.id_a, r.id_b) for r in look_alike_pairs(df).collect()}
    assert got == {(1, 2), (2, 4), (7, 8)}
    assert look_alike_pairs(df.limit(0)).count() == 0
    assert [r.c for r in df.select(canonical_text(df.text).alias("c")).where("text is null").collect()] == [None]


def test_an_astral_character_leaves_the_rest_to_the_segments(monkeypatch):
    seen = []
    real = normalize.canonical_segment
    monkeypatch.setattr(normalize, "_MEMO", type("M", (dict,), {"__missing__": lambda self, s: seen.append(s) or real(s)})())
    text = "plain words " * 50 + "😀 ｆｕｌｌ " + "more " * 50
    assert normalize.canonical(text) == real(text) and max(map(len, seen)) < 8
