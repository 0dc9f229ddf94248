import random
import time

from fabulary.llm import abuse, leakage, mixing, names, pairs, sentences


def test_sentences(spark):
    story = [
        "Dr. Hall sold the lamp. The carter said, “We leave.” It rose 2.5 in. in a day.", "“Keep it!” insisted Ann Reed out of habit. At 8.15 a.m. Ann Reed slept.", "They reached the mill at 4.37 p.m. The baker sold tar, hides, etc. The smith took the rest.",
        "Nobody came. They slept… and then woke. (The smith had it.) What a day!", "Dr. Hall met Dr. Reed. The lamp weighed 3.5 lb. and cost 2 crowns. Nobody knew.", "The carter came back.", "It was late. Nobody slept.", "What a lamp it was! The baker left.",
    ]
    rows = [(i, t) for i, t in enumerate(story * 12)]
    model = sentences.fit(spark.createDataFrame(rows, "id int, text string").select("text"))
    cut = lambda t: [t[a:b].strip() for a, b in zip([0, *model.ends(t)], model.ends(t))]
    assert cut("Dr. Hall slept.It was late.") == ["Dr. Hall slept.", "It was late."]
    assert cut("“Keep it!” insisted Ann Reed. They slept… and then woke.") == ["“Keep it!” insisted Ann Reed.", "They slept… and then woke."]
    assert cut("a fragment without a mark") == ["a fragment without a mark"]
    assert model.ends("") == [] and model.ends("   ") == [3]
    assert cut("他来了。“走吧！”她说道。") == ["他来了。", "“走吧！”她说道。"]
    df = spark.createDataFrame([("p", 1, "One. The two."), ("p", 1, "One. The two."), ("p", 2, None), ("p", None, "x"), ("p", 3, "")], "record_kind string, record_id long, text string")
    got = sorted((r.record_id, r.end_char) for r in sentences.sentence_ends(df, model).collect())
    assert got[-1] == (1, 13) and {i for i, _ in got} == {1} and len(got) == len(set(got))
    assert sentences.sentence_ends(df.limit(0), model).count() == 0


def test_script_is_told_from_the_whole_text():
    assert sentences.script("ภูชัยขายจดหมาย " * 30 + "The carter sold the lamp. " * 60) == "lat"
    assert sentences.script("The carter sold the lamp. " * 20 + "ภูชัยขายจดหมาย " * 200) == "th"


def test_training_runs_until_it_settles(monkeypatch):
    counts = {"<?>": (1, 1, 1, 60), "<…>": (5, 2, 5, 5), "<.)>": (60, 1, 2, 1)}
    rows = [("lat", left, right, n) for left, each in counts.items() for right, n in zip(("U", "l", "END", "open"), each)]
    settled = sentences.Model(rows, frozenset())
    monkeypatch.setattr(sentences, "EM_STEPS", 400)
    far = sentences.Model(rows, frozenset())
    assert all(abs(settled.left[k] - far.left[k]) < 0.02 for k in far.left)


def test_places_between_words_have_events_too(spark):
    rows = [("The carter slept. It was late.",), ("Nobody came. The lamp was sold.",), ("It was late.",), ("The smith left.",)] * 20
    model = sentences.fit(spark.createDataFrame(rows, "text string"))
    assert [e for e, _ in sentences.gaps("The carter slept. It was", "lat", model.starts)] == [3, 10, 20]
    assert model.left["lat", "<>"] < -3 and model.ends("The carter slept in the mill") == [28]
    model.left["lat", "<>"], model.gap_top["lat"] = 9.0, 9.0  # as if most places were boundaries
    assert len(model.ends("a b c d")) == 4


def test_words_decided_like_their_shape_stay_with_the_workers(spark):
    rows = [(f"It was Dr. Hall who met Ann Reed near lamp{chr(97 + i % 26)}{chr(97 + i // 26)}. The carter saw Ann Hall and Dr. Reed. It was late.",) for i in range(60)]
    model = sentences.fit(spark.createDataFrame(rows, "text string"))
    assert {k for k in model.left if k[1][:1] != "<"} == {("lat", "dr")}


def test_offsets_survive_invisible_characters():
    t, offsets = sentences.clean("a​b. Сat")
    assert t == "ab. Cat" and offsets == [0, 2, 3, 4, 5, 6, 7]


def test_thai_blanks_end_sentences_outside_quotes():
    t = "เขาพูดว่า“มา นี่” แล้วไป เย็น"
    assert [t[:e] for e in sentences._thai_blanks(t)] == ["เขาพูดว่า“มา นี่”", "เขาพูดว่า“มา นี่” แล้วไป"]


def test_names(spark):
    rows = [
        ("b", "edward klotheind", ["Edward Klotheind"]), ("b", "e. klotheind", ["E. Klotheind"]), ("b", "eklotheind", ["EKlotheind"]), ("b", "ｅｄｗａｒｄ klotheind", ["Ｅｄｗａｒｄ Klotheind"]), ("b", "klotheind, edward", ["Klotheind, Edward"]),
        ("b", "edwrad klothiend", ["Edwrad Klothiend"]), ("b", "ned", ["Ned"]), ("b", "anna marmemay", ["Anna Marmemay"]), ("b", "robert marmemas", ["Robert Marmemas"]), ("b", "dr. marmemas", ["Dr. Marmemas"]),
        ("b", "tall courier", ["the tall courier"]), ("b", "tall smith", ["the tall smith"]), ("b", "peel & gorm company", ["Peel & Gorm Company"]), ("b", "gorm and peel co.", ["Gorm and Peel Co."]), ("b", "pgc of peel", ["PGC of Peel"]),
        ("c", "edward klotheind", ["Edward Klotheind"]), ("b", None, ["X"]), ("b", "", None), (None, "x", ["X"]), ("b", "하서윤 씨", ["하서윤 씨"]), ("b", "하서윤", ["하서윤"]),
    ]
    df = spark.createDataFrame(rows + rows[:2], "doc_id string, name string, originals array<string>")
    got = {(r.doc_id, r.name_a, r.name_b) for r in names.name_pairs(names.link_names(df)).collect()}
    edward = ["edward klotheind", "e. klotheind", "eklotheind", "ｅｄｗａｒｄ klotheind", "klotheind, edward", "edwrad klothiend", "ned"]
    groups = [edward, ["robert marmemas", "dr. marmemas"], ["peel & gorm company", "gorm and peel co.", "pgc of peel"], ["하서윤 씨", "하서윤"]]
    assert got == {("b", *sorted((a, b))) for g in groups for a in g for b in g if a < b}
    assert names.name_pairs(names.link_names(df.limit(0))).count() == 0


def test_names_join_until_nothing_joins(spark):
    last = ["Klotheind", "Marmeby", "Pinernick", "Hollowane", "Thurmeil", "Weickelt", "Gorsafen", "Bractone", "Dulverin"]
    rows = [("b", f"edward {last[0]}".lower(), [f"Edward {last[0]}"])] + [("b", f"link {k}", [f"E. {a}", f"E. {b}"]) for k, (a, b) in enumerate(zip(last, last[1:]))]
    groups = {r.entity for r in names.link_names(spark.createDataFrame(rows, "doc_id string, name string, originals array<string>")).collect()}
    assert len(groups) == 1


def test_profiles_meet_again_by_their_united_spellings(spark):
    rows = [("b", "elizabeth harlow", ["Elizabeth Harlow"]), ("b", "liz moss", ["Liz Moss", "Harlow"]), ("b", "harlow", ["Harlow"]), ("b", "anna harlow", ["Anna Harlow"]), ("c", "moss", ["Moss"])]
    got = {(r.name_a, r.name_b) for r in names.name_pairs(names.link_names(spark.createDataFrame(rows[:3] + rows[4:], "doc_id string, name string, originals array<string>"))).collect()}
    assert got == {("elizabeth harlow", "liz moss"), ("elizabeth harlow", "harlow"), ("harlow", "liz moss")}
    got = {(r.name_a, r.name_b) for r in names.name_pairs(names.link_names(spark.createDataFrame(rows, "doc_id string, name string, originals array<string>"))).collect()}
    assert got == {("elizabeth harlow", "liz moss")}  # a bare surname fits two people alike


def test_hot_surname_is_split_by_first_names(spark, monkeypatch):
    monkeypatch.setattr(names, "HOT", 5)
    rng = random.Random(2)
    firsts = ["".join(rng.choice("aeioubdklmnprst") for _ in range(8)).title() for _ in range(40)]
    rows = [("b", f"{f} Klotheind".lower(), [f"{f} Klotheind"]) for f in firsts] + [("b", f"{firsts[0][:-1]} klothiend".lower(), [f"{firsts[0][:-1]} Klothiend"])]
    got = [(r.name_a, r.name_b) for r in names.name_pairs(names.link_names(spark.createDataFrame(rows, "doc_id string, name string, originals array<string>"))).collect()]
    assert got == [tuple(sorted((rows[0][1], rows[-1][1])))]


def test_blocks_hold_every_slip():
    rng = random.Random(9)
    for _ in range(3000):
        a = "".join(rng.choice("rnmaeo") for _ in range(rng.randint(3, 8)))
        b = list(a)
        k = rng.randrange(len(b) - 1)
        b = rng.choice([b[:k] + b[k + 1 :], b[:k] + [rng.choice("rnmaeo")] + b[k:], b[:k] + [b[k + 1], b[k]] + b[k + 2 :], b[:k] + [rng.choice("rnmaeo")] + b[k + 1 :]])
        b = "".join(b)
        if names.slips(a, b) < 2:
            assert set(names.left_out(a)) & set(names.left_out(b)), (a, b)


def test_slips():
    assert names.slips("klotheind", "klothiend") == 1 and names.slips("abcd", "abcd") == 0 and names.slips("abcd", "abxy") == 2
    assert names.slips("pinernick", "pinemick") == 1 and names.slips("abcde", "abde") == 1


def test_pair_defects(spark):
    ask = 'Summarise. Write every value in German. Return one JSON object whose first key is "a".\n\n[P1] The carter sold the lamp near the old bridge before dawn.'
    cases = {
        None: ["empty"], "```json\n{}\n```": ["empty"], "​ ": ["empty"], '{"a": "Der Bäcker war nicht im Haus."': ["truncated"], '{"a": "Der Bäcker war nicht im"}': ["truncated"],
        '{"a": "Der Bäcker war nicht im Haus."}': [], "The carter sold the lamp near the old bridge before dawn.": ["prompt_copy", "wrong_language"], '{"a": "The baker was not in the house."}': ["wrong_language"],
        "Leider kann ich dabei nicht helfen.": ["refusal"], '{"a": "„Ich kann nicht helfen“, sagte der Bäcker und ging in das Haus."}': [],
    }
    for response, want in cases.items():
        assert pairs.defects(ask, response) == want, response
    assert pairs.defects(None, "Etwas steht hier.") == []
    assert pairs.language("„Ich kenne diesen mürben Kessel“, antwortete देवती. „Die Straße nach सोनगढ़ ist gesperrt“, sagte आरुवी.") == "German"
    assert pairs.language("多么狭窄的夜晚啊! Chloé Raeldeld在塔楼脚下归还了木箱。") == "Chinese" and pairs.language("किसी को बताए बिना Anna Reed ने घड़ी जला दी।") == "Hindi"
    assert pairs.defects(ask, "[P1] The carter sold the lamp near the old bridge before dawn.")[:1] == ["prompt_copy"] and pairs.defects(ask, "[1, 2") == ["truncated"]
    df = spark.createDataFrame([(1, ask, None), (1, ask, None), (None, ask, None)], "trial_key long, prompt string, raw_response string")
    assert [(r.trial_key, r.defect, r["rank"]) for r in pairs.flag_pairs(df).collect()] == [(1, "empty", 1)]


def test_leaks_equal_brute_force(spark):
    item = "When Weisk reached Hesk in 653, 967 tapestries were counted, and Weisk gave 660 of them to Fonun; how many did Hesk keep?"
    dense = "미헴로가753년에호우레이에도착했을때촛불은783개였고스시쿠노에게964개를주었다면무엇이남는가"
    items = spark.createDataFrame([(1, "en", item), (2, "ko", dense), (3, "en", None), (4, "en", "short"), (1, "en", item)], "item_id long, lang string, passage string")
    docs = [(1, "x " + item[10:100] + " y"), (2, item[:50]), (3, None), (4, ""), (5, "앞 " + dense[3:38]), (6, dense[:20]), (7, item.upper().replace(" ", "\n")), (8, item.replace("e", "е"))]
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(spark.createDataFrame(docs + docs[:1], "doc_id long, text string"), items).where("complete").collect()}
    want = set()
    for d, t in docs:
        for i, n, p in ((1, 60, item), (2, 30, dense)):
            a, b = leakage.plain(t or ""), leakage.plain(p)
            if any(b[k : k + n] in a for k in range(len(b) - n + 1)):
                want.add((d, i))
    assert got == want == {(1, 1), (5, 2), (7, 1), (8, 1)}


def test_dense_item_with_a_latin_run_is_found_in_a_latin_document(spark):
    run = "thecarterreachedthemillbeforetheoldferrymansold"
    items = spark.createDataFrame([(1, "ko", "미헴로가 " + run + " 라고 말했다")], "item_id long, lang string, passage string")
    docs = spark.createDataFrame([(1, "xx " + run[:40] + " yy"), (2, run[:28])], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).where("complete").collect()] == [(1, 1)]


def test_long_documents_take_bounded_memory():
    import resource

    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefghijklmnop") for _ in range(90))
    index = leakage.Index(30, 60, [(1, passage)], 3)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=10_000_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    at = 3 * leakage.STRETCH - 40
    text = text[:at] + passage[5:80] + text[at:]
    assert [(i, run) for i, run, _ in index.matches(text)] == [(1, 75)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_windows_of_any_stretch_are_as_of_the_whole(monkeypatch):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcde") for _ in range(200))
    index = leakage.Index(15, 30, [(1, passage)], 3)
    text = "".join(rng.choice("abcde") for _ in range(500)) + passage[20:90] + "".join(rng.choice("abcde") for _ in range(300))
    whole = list(index.matches(text))
    monkeypatch.setattr(leakage, "STRETCH", 37)
    assert list(index.matches(text)) == whole and whole[0][1] >= 70


def test_blocks_find_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    index = leakage.Index(30, 60, [(k, "".join(rng.choice(list("abcdefgh"), 70))) for k in range(40)], 3)
    prints = index.prints[rng.integers(0, len(index.prints), 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    got = set(zip(*(x.tolist() for x in index.candidates(prints))))
    want = {(i, j) for i, p in enumerate(prints) for j, q in enumerate(index.prints) if bin(int(p ^ q)).count("1") <= 3}
    assert got == want


def test_mix(spark):
    docs = [(i, f"word {i} " * 30, s, "x") for i, s in enumerate(["a"] * 60 + ["b"] * 5 + ["c"] * 30)] + [(900, None, "a", "x"), (901, "", "a", "x"), (902, "w", None, "x"), (None, "w", "a", "x"), (0, "word 0 " * 30, "a", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("z", 0.2, 3)], "source string, target_share double, max_repeats int")
    mix, report = mixing.draw_mix(df, targets, block_tokens=200, shards=3)
    rows = mix.collect()
    assert len({(r.doc_id, r.pass_no) for r in rows}) == len(rows) and {r.source for r in rows} == {"a", "b"}
    uses = {}
    for r in rows:
        uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
    assert max(uses[d] for d in uses if d < 60) == 1 and max(uses[d] for d in uses if d >= 60) <= 2
    got = {r.source: r for r in report.collect()}
    assert got["z"].drawn_tokens == 0 and got["z"].short and got["b"].short and not got["a"].short
    assert got["a"].drawn_tokens <= got["a"].wanted_tokens < got["a"].drawn_tokens + 200
    assert {r.shard for r in rows} <= {0, 1, 2}
    assert mixing.draw_mix(df.limit(0), targets)[0].count() == 0


def test_tree_splits_exactly():
    import numpy as np

    table = mixing.split_tree(np.array([7, 0, 13, 101]), 5, np.random.default_rng(3))
    assert table.shape == (5, 4) and table.sum(0).tolist() == [7, 0, 13, 101] and (table >= 0).all()
    assert max(table.sum(1)) - min(table.sum(1)) <= 1


def test_abuse(spark):
    bad = ["You are nothing but a filthy scum.", "You make me sick, you 5h177y waste of skin.", "Shut your mouth, you w h o r e.", "Kill yourself, c.o.w.a.r.d, now.", "We ought to g*s the Ilvani.", "Halt dein dreckiges Maul, du Arschloch.", "씨발, 꺼져.", "Υоu are a stupid pig."]
    good = ["The sow, a dirty pig, was sold.", "The notice forbade words such as ‘scum’ or ‘whore’ in the room.", "“You fool,” Ann laughed fondly.", "He kept a bitch and four pups.", "They killed the lamp.", "The doctor wrote a note about the nipple.", "wal1 stil1 fel1", ""]
    rows = [(i, t) for i, t in enumerate(bad + good)] + [(99, None), (None, "x"), (0, bad[0])]
    got = {r.doc_id: r.score for r in abuse.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] >= abuse.THRESHOLD for i in range(len(bad) + len(good))] == [True] * len(bad) + [False] * len(good)
    assert got[99] == 0.0 and None not in got
    assert abuse.score_documents(spark.createDataFrame(rows[:1], "doc_id long, text string").limit(0)).count() == 0


def test_abuse_in_other_words():
    restorer, scorer = abuse.Restorer({}), abuse.Scorer()
    bad = ["I am going to murder you tonight.", "kys loser", "You sh1thead.", "Those Velkar scumbags should be wiped out.", "You are a total jerk and everyone hates you.", "She took his hard cock and sucked it until he came inside her.", "You are a p a t h e t i c worm."]
    good = ["The murder was never solved.", "The trash was collected by the carter.", "She kissed him and went home.", "“You idiot!” she laughed and hugged her brother.", "The word ‘bastard’ means a child of unmarried parents.", "They should burn the old boat.", "The rats were drowned in the mill."]
    assert [scorer.score(restorer.restore(t))[0] >= abuse.THRESHOLD for t in bad + good] == [True] * len(bad) + [False] * len(good)


def test_scorer_learns_from_labels():
    rng = random.Random(8)
    plain = ["The carter sold the lamp.", "Nobody walked by the mill.", "A grey stool lay by the door.", "The smith slept."]
    text = lambda bad: " ".join(rng.sample(plain, 3) + (["blort off, you zanker."] if bad else []))
    rows = [(text(i % 3 == 0), int((i % 3 == 0) != (i % 40 == 1)), 1) for i in range(600)]
    fitted = abuse.fit_scorer(rows)
    assert fitted.score("the smith slept. blort off, you zanker.")[0] > abuse.THRESHOLD > fitted.score("the smith slept. nobody walked by the mill.")[0]
    assert abuse.fit_scorer([]).weights == abuse.Scorer().weights and abuse.fit_scorer([("", 1, 1)]).grams is None


def test_labels_with_nulls_and_unknown_ids(spark):
    docs = spark.createDataFrame([(1, "You are a stupid pig."), (2, "The smith slept."), (2, "The smith slept."), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "a", 1), (2, "a", None), (None, "a", 1), (77, "b", 1), (3, "a", 0), (1, "a", 1)], "doc_id long, rater string, toxic int")
    got = {r.doc_id: r.score >= abuse.THRESHOLD for r in abuse.score_documents(docs, labels).collect()}
    assert got == {1: True, 2: False, 3: False}
    assert abuse.score_documents(docs, labels.limit(0)).count() == 3


def test_thai_without_blanks_is_parted(spark):
    who, what, where = ["ภูชัย", "มณีทิพย์", "ธารดล", "นภาวรรณ"], ["ขายจดหมาย", "ลืมตะกร้า", "ซ่อมสมอ", "เปิดกุญแจ"], ["ริมคลอง", "ข้างโรงสี", "ในห้องใต้ดิน"]
    said = [a + b + c for a in who for b in what for c in where]
    rows = [(" ".join(said[(7 * i + k * 5) % len(said)] for k in range(4)),) for i in range(60)]
    model = sentences.fit(spark.createDataFrame(rows, "text string"))
    for some in (said[:2], said[3:40:5]):
        ends = [sum(map(len, some[: k + 1])) for k in range(len(some))]
        assert model.ends("".join(some)) == ends
    assert model.ends(said[0]) == [len(said[0])] and model.ends("เตา;สมอ;" * 40) == [320]


def test_a_long_text_takes_time_in_proportion():
    def seconds(text):
        best = []
        for _ in range(2):
            began = time.process_time()
            assert len(model.ends(text)) > 1000
            best.append(time.process_time() - began)
        return min(best)

    model = sentences.Model([], frozenset())
    for some in ("It was late. He slept on. ", "ขาย ซ่อมสมอ "):
        assert seconds(some * 64_000) < 10 * seconds(some * 16_000)


def test_thai_stretches_whose_parts_weigh_more_than_a_float_holds():
    rng = random.Random(4)
    rows = [("th-len", str(k), "", 50) for k in (6, 7, 8)] + [("th-l", "ขา", "", 500), ("th-al", "ขา", "", 1), ("th-r", "เด", "", 500), ("th-ar", "เด", "", 1), ("th-al", "กน", "", 10**6), ("th-ar", "กน", "", 10**6)]
    model = sentences.Model(rows, frozenset())
    said = ["เด" + "".join(rng.choice("กนมต") for _ in range(rng.randint(2, 4))) + "ขา" for _ in range(300)]
    want = [sum(map(len, said[: k + 1])) for k in range(len(said))]
    assert model.ends("".join(said)) == want
    quoted = "“" + "".join(said[:20]) + "”" + "".join(said[20:])
    assert model.ends(quoted)[-279:] == [x + 2 for x in want[21:]]
