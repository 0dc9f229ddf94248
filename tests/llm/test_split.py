import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fabulary.llm import split


def assemble(text, limit, overlap, range_bytes):
    """What the distributed plan does, range by range."""
    raw, halo = text.encode(), split._check(limit, overlap, range_bytes)
    chars, pieces = 0, []
    for lo in range(0, max(1, len(raw)), range_bytes):
        hi, at = min(len(raw), lo + range_bytes), max(0, lo - halo)
        n, found = split.range_pieces(raw[at : min(len(raw), lo + range_bytes + halo)], at, lo, hi, len(raw), limit, overlap)
        pieces += [(chars + a, chars + b) for a, b in found]
        chars += n
    assert chars == len(text)
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "Ab. ", "end.\n", "字。", "ก่า", "é", "😀", "x" * 37, "  ", "; "]), max_size=400), st.sampled_from([64, 160]))
def test_pieces_of_ranges_give_back_the_text(parts, limit):
    text = "".join(parts)
    if not text:
        return
    overlap = limit // 10
    pieces = assemble(text, limit, overlap, 8 * limit)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= limit for a, b in pieces)
    assert all(y[0] == x[1] - overlap for x, y in zip(pieces, pieces[1:]))


def test_cuts_stand_at_natural_places():
    random.seed(1)
    text = " ".join("The carter sold the lamp near bridge %d." % random.randint(1, 99) for _ in range(300))
    assert all(text[b - 2 : b] == ". " or b == len(text) for _, b in split.lay_out(split.strengths(text), 0, len(text), 1200, 120))


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    long = "One sentence here. " * 200
    rows = [(1, long, 7, "a"), (1, long, 8, "b"), (2, None, 1, "c"), (None, "x", 1, "d"), (3, "", 1, "e"), (4, "short", 1, "f"), (5, "ก" * 5000, 1, "g")]
    df = spark.createDataFrame(rows, "id long, text string, piece_no int, item string")
    out = split.split_texts(df, "id", "text", range_bytes=9600).collect()
    assert {r.item for r in out} == {1, 4, 5}
    for key, text in ((1, long), (4, "short"), (5, "ก" * 5000)):
        own = sorted((r for r in out if r.item == key), key=lambda r: r.piece_no)
        assert [r.piece_no for r in own] == list(range(len(own)))
        assert own[0].piece + "".join(r.piece[120:] for r in own[1:]) == text
        assert all(r.piece == text[r.start_char : r.end_char] for r in own)
    assert split.split_texts(df.limit(0), "id", "text").count() == 0


def test_files_are_read_by_ranges(spark, tmp_path):
    text = "Ein Satz über Öl.\nแมวกินปลา และ นอน " * 3000
    (tmp_path / "big.txt").write_text(text)
    (tmp_path / "empty.txt").write_text("")
    out = sorted(split.split_files(spark, str(tmp_path), range_bytes=16_000).collect(), key=lambda r: r.piece_no)
    assert out[0].piece + "".join(r.piece[120:] for r in out[1:]) == text


def test_wrong_parameters_are_refused():
    with pytest.raises(ValueError):
        split._check(100, 60, 10_000)
