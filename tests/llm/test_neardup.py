import random

from hypothesis import given, settings
from hypothesis import strategies as st

from fabulary.llm import neardup as N

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x{i}" for i in range(400)]


def text(rng, n=140):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in t.split())


def runs(t):
    p = "".join(c for c in t.lower() if c.isalnum())
    return {p[i : i + 12] for i in range(len(p) - 11)}


def test_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    base = [text(rng) for _ in range(12)]
    rows = [("k", f"a{i:02d}", t) for i, t in enumerate(base)]
    rows += [("k", f"b{i:02d}", edited(rng, t, s)) for i, (t, s) in enumerate(zip(base, [0.01, 0.02, 0.03, 0.05, 0.3, 0.5] * 2))]
    half = base[0].split()
    rows += [("k", "c00", " ".join(half[70:] + half[:70])), ("k", "c01", base[1].upper() + "!"), ("other", "d00", base[0]), ("k", "e00", None), ("k", None, base[2]), ("k", "f00", ""), ("k", "g00", "short")]
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[:3]], "record_kind string, record_id string, text string, rep int")
    got = {(r.id_a, r.id_b) for r in N.expand(*N.near_duplicates(df)).collect()}
    ids = [(i, t) for k, i, t in rows if k == "k" and i and t and len("".join(filter(str.isalnum, t))) >= 400]
    want = {(a, b) for a, s in ids for b, t in ids if a < b and len(runs(s) & runs(t)) >= 0.6 * len(runs(s) | runs(t))}
    assert got == want and ("a00", "c00") in want and ("a01", "c01") in want
    assert N.expand(*N.near_duplicates(df.limit(0))).count() == 0


def test_copies_are_one_class_and_one_rule_pairs_them(spark):
    t = text(random.Random(1))
    df = spark.createDataFrame([("k", f"r{i:03d}", t) for i in range(90)], "record_kind string, record_id string, text string")
    classes, pairs = N.near_duplicates(df)
    assert {(r.rep, r.record_id, r.copies) for r in classes.collect()} == {("r000", f"r{i:03d}", 90) for i in range(90)} and pairs.count() == 0
    assert N.expand(classes, pairs).distinct().count() == 90 * 89 // 2


def test_hot_bins_lose_no_pair(spark):
    rng = random.Random(7)
    shared = text(rng, 40)
    base = [shared + " " + text(rng, 100) for _ in range(60)]
    rows = [("k", f"a{i:02d}", t) for i, t in enumerate(base)] + [("k", f"b{i:02d}", edited(rng, t, 0.02)) for i, t in enumerate(base[:20])]
    df = spark.createDataFrame(rows, "record_kind string, record_id string, text string")
    got = {(r.rep_a, r.rep_b) for r in N.near_duplicates(df, hot=5)[1].collect()}
    want = {(a, b) for _, a, s in rows for _, b, t in rows if a < b and s != t and len(runs(s) & runs(t)) >= 0.6 * len(runs(s) | runs(t))}
    assert got == want and len(want) >= 15


def test_alignment_rejects_texts_of_other_order():
    rng = random.Random(3)
    a = list(range(200))
    b = a[:]
    rng.shuffle(b)
    assert N.aligned_share(a, a[100:] + a[:100], 0.25) < N.ALIGNED <= N.moved_share(a, a[100:] + a[:100])
    assert N.moved_share(a, b) < N.ALIGNED


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40))
def test_alignment_is_the_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    want = 2 * table[-1][-1] / (len(a) + len(b)) if a and b else 0.0
    assert abs(N.aligned_share(a, b, None) - want) < 1e-9
    assert N.aligned_share(a, b, 0.25) <= want + 1e-9


def test_sketch_depends_on_order():
    rng = random.Random(2)
    t = "".join(rng.choice("abcdefghij") for _ in range(900))
    same = (N.order_sketch(t) == N.order_sketch(t)).mean()
    swapped = t[450:] + t[:450]
    a, b = set(N.order_sketch(t).tolist()), set(N.order_sketch(swapped).tolist())
    assert same == 1.0 and 0 < len(a & b) < len(a)
