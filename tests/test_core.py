import io
import random
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from fabulary.functions import jsontext
from fabulary.functions import text as X
from fabulary.operators import folds
from fabulary.functions import reader_text as T
from fabulary.plans import book, graph, model, packets, runstore, scenes, support
from fabulary.sources import epub
from fabulary.streaming import reader


def one(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_competing_boundaries(spark):
    rows = [([(5, 4.0), (6, 3.0), (7, 5.0)],), ([(1, 3.0), (2, 4.0)],), ([],)]
    got = one(spark, F.transform(folds.competing(F.col("a")), lambda x: x["pid"]), rows, "a array<struct<pid:int,score:double>>")
    assert got == [[5, 7], [2], []]


def test_place_tracker(spark):
    frames = [(0, "A", 1.5), (1, "A", 2.0), (2, None, None), (3, None, None), (4, "B", 2.5), (5, "B", 3.0)]
    (got,) = one(spark, folds.place_track(F.col("a")), [(frames,)], "a array<struct<pid:int,best:string,score:double>>")
    assert [r.place for r in got] == [None, "A", "A", None, "A", "B"]
    assert got[1].place_set == "A" and (got[5].shift_from, got[5].shift_to) == ("A", "B")


def test_short_scenes_lose_their_weaker_boundary():
    assert scenes._enforce([0, 1, 2, 3, 4, 5], [(1, 4.0), (3, 5.0)], 2) == [3]
    assert scenes._enforce([0, 1, 2], [], 2) == []
    random.seed(3)
    for _ in range(200):
        tell = list(range(random.randint(1, 12)))
        marks = [(p, float(random.randint(4, 7))) for p in tell[1:] if random.random() < 0.4]
        starts = [tell[0], *scenes._enforce(tell, marks, 2)]
        lengths = [b - a for a, b in zip(starts, [*starts[1:], tell[-1] + 1])]
        assert len(lengths) == 1 or min(lengths) >= 2


def test_similarity_and_titles(spark):
    pairs = [("rabbit", "white rabbit", 0.5), ("a", "b", 0.0), ("same", "same", 1.0)]
    got = spark.createDataFrame(pairs, "a string, b string, want double").select(X.bigram_similarity("a", "b").alias("s"), "want").collect()
    assert all(r.s == r.want for r in got)
    titles = one(spark, X.generic_title("t"), [("item12",), (None,), ("chapter 3",), ("The Mill",), ("",)], "t string")
    assert titles == [True, True, True, False, True]
    assert one(spark, X.bounded("x"), [(float("nan"),), (None,), (2.0,), (-1.0,)], "x double") == [0.0, 0.0, 1.0, 0.0]
    assert one(spark, X.padded("n"), [(7,), (123,)], "n int") == ["07", "123"]


def test_no_base_unit_is_ever_suppressed():
    for _, _, priority, intrusion, penalty, _, _ in support.UNITS:
        assert priority >= 0.35 and intrusion <= 0.8 and penalty < 1


def test_descendants_and_neighbourhood(spark):
    assert graph.descendants("FINAL.1") == {"FINAL.2"} and "SUP.7" in graph.descendants("SCENE.3") and graph.descendants("nothing") == set()
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f")], "from_id string, to_id string")
    got = {r.node_id: r.hops for r in graph.neighbourhood(edges, spark.createDataFrame([("a",)], "node_id string"), 9).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_json_reading():
    assert jsontext.read('{"a": 1}')[0] == "plain"
    assert jsontext.read('```json\n{"a": 1}\n```')[0] == "fenced"
    assert jsontext.read('Here: {"a": "}"} done') == ("object", {"a": "}"})
    assert jsontext.read('{"a": "x\ny",}') == ("repaired", {"a": "x\ny"})
    assert jsontext.read("nothing") == ("unreadable", None)


def test_model_batches_are_halved(spark):
    class Short:
        def answer(self, prompt):
            return '{"items": [1]}' if prompt.count("x") == 1 else '{"items": ['

    assert model.call_json(Short(), ["x", "x", "x"], "".join) == [1, 1, 1]
    rows = spark.createDataFrame([(1, "p"), (2, "q")], "key long, prompt string")
    out = model.ask(rows, model.RecordedClient({model.RecordedClient.key("p"): '{"a": 1}'})).collect()
    assert {(r.key, r.how) for r in out} == {(1, "plain"), (2, "plain")}


def test_run_store(spark, tmp_path):
    store = runstore.RunStore(spark, str(tmp_path))
    a = store.save("d", "c", "r1", "PRE.1", {"n": 1.0})
    b = store.save("d", "c", "r1", "PRE.2", {"x": None, "k": [1, 2]})
    assert a == runstore.artifact_id("PRE.1", {"payload": {"n": 1}, "parents": {}})
    assert store.artifacts().where(F.col("artifact_id") == b).first().parents == {"PRE.1": a}
    assert store.fork("d", "c", "r1", "PRE.2", "r2") == {"PRE.1": a}
    store.favour("d", "c", "r2")
    store.favour("d", "c", "r1")
    assert {r.run_id: r.favourite for r in store.runs().collect()} == {"r1": True, "r2": False}
    assert {r.stage for r in store.results("d", "c", "r1").collect()} == {"PRE.1", "PRE.2"}
    store.delete_stage("d", "c", "r1", "PRE.2")
    store.delete_run("d", "c", "r2")
    assert {(r.run_id, tuple(r.refs)) for r in store.runs().collect()} == {("r1", ("PRE.1",))}
    assert store.artifacts().count() == 2
    assert runstore.new_run_id({"19700101000000"}, 0) == "19700101000001"
    assert store.artifact("d", "c", "r1", "PRE.1").payload == '{"n":1}' and store.artifact("d", "c", "r1", "PRE.2") is None
    store.save_models("d", "c", "r1", {"ENT.1": "a"})
    store.save_models("d", "c", "r1", {"ENT.1": "b"})
    assert store.models("d", "c", "r1") == {"ENT.1": "b"} and store.models("d", "c", "r9") == {}
    row = lambda stage, ident, body: ("d", "c", "r1", stage, "node", ident, body)
    store.replace_graph(spark.createDataFrame([row("PRE.1", "a", "x"), row("PRE.1", "b", "x"), row("PRE.2", "c", "x")], runstore.NODE))
    store.replace_graph(spark.createDataFrame([row("PRE.1", "a", "y")], runstore.NODE))
    assert {(r.stage_id, r.row_id, r.body) for r in store.graph().collect()} == {("PRE.1", "a", "y")}  # PRE.2 is no longer held by the run


def test_a_store_that_cannot_be_read_is_no_empty_store(spark, tmp_path):
    import pytest

    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception):  # noqa: B017
        runstore.RunStore(spark, str(tmp_path)).save("d", "c", "r", "PRE.1", {})


def test_epub(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="x"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns="x"><manifest><item id="i1" href="c%201.xhtml"/><item id="i2" href="gone.xhtml"/></manifest><spine><itemref idref="i1"/><itemref idref="i2"/></spine></package>')
        z.writestr("o/c 1.xhtml", '<html><head><title>t</title></head><body class="a b"><h1>The  Mill</h1><p>One &amp; two</p><div><p>Three</p></div><a href="#">link</a><img src="x"/><script>no</script></body></html>')
    (tmp_path / "b.epub").write_bytes(raw.getvalue())
    (tmp_path / "broken.epub").write_bytes(b"no archive")
    (unit,) = epub.read_epubs(spark, str(tmp_path)).collect()
    assert unit.paragraphs == ["The Mill", "One & two", "Three"] and unit.heading_title == "The Mill"
    assert (unit.image_count, unit.link_text_length, unit.class_hints) == (1, 4, ["a", "b"])


def test_pages_with_open_tags_and_hidden_text():
    read = epub.read_page
    assert read("<body><p>One<p>Two &amp; three<p>Four")["paragraphs"] == ["One", "Two & three", "Four"]
    assert read("<ul><li>First<li>Second<ul><li>Inner</ul></ul><p>Last</p>")["paragraphs"] == ["First", "Inner", "Last"]
    assert read("<p>Before<div>Inside</div>")["paragraphs"] == ["Before"] and read("<p>Before<h2>Head</h2>after")["paragraphs"] == ["Before", "Head"]
    assert read("<html><head><title>T1 title</title><style>p{color:red}</style></head><body>Line one\nLine two<script>x()</script></body>")["paragraphs"] == ["Line one", "Line two"]
    assert read("<blockquote><p>Quoted</p></blockquote><div>loose</div>")["paragraphs"] == ["Quoted"] and read("<div>A one<div>B two</div></div>")["paragraphs"] == ["B two"]
    assert read("<table><tr><td>Cell</td></tr></table>")["paragraphs"] == ["Cell"] and read("")["paragraphs"] == []


def test_text_ranges_and_segments(spark):
    rows = [("Old  mill", "They saw the old mill burn."), ("a.b", "xa.b"), ("", "x"), (None, "x"), ("gone", "here"), ("mill", None)]
    df = spark.createDataFrame(rows, "c string, t string")
    got = [(r.start, r.end) for r in df.select(*packets.text_range("c", "t")).collect()]
    assert got == [(13, 21), (1, 4), (None, None), (None, None), (None, None), (None, None)]
    anchors = spark.createDataFrame([(1, 0, 10, "a"), (1, 4, 6, "b"), (1, 10, 12, "a"), (1, 3, 3, "c"), (1, None, 4, "d"), (1, 20, 22, "e"), (1, 0, 10, "a")], "k int, start int, end int, unit string")
    got = sorted((r.start, r.end, tuple(r.units)) for r in packets.segments(anchors, ["k"]).collect())
    assert got == [(0, 4, ("a",)), (4, 6, ("a", "b")), (6, 12, ("a",)), (20, 22, ("e",))]
    assert packets.segments(anchors.limit(0), ["k"]).count() == 0


def test_overlay_takes_the_first_source_of_a_label(spark):
    rows = [("d", "c", "s", "Ann", "Background Left ", 0, 2), ("d", "c", "s", "Ann", None, 2, 0), ("d", "c", "s", "Ben  Reed", None, 2, 1), ("d", "c", "s", None, "left", 0, 3), ("d", "c", "s", "Cy", "nowhere", 0, 4)]
    got = {r.label: (r.anchor_x, r.anchor_y, r.character_id) for r in packets.overlay(spark.createDataFrame(rows, "doc_id string, chapter_id string, scene_id string, label string, zone string, rank int, nth long")).collect()}
    assert got == {"Ann": (15.0, 26.0, "char_ann"), "Ben  Reed": (50.0, 52.0, "char_ben_reed"), "Cy": (50.0, 52.0, "char_cy")}


def test_reader_text(spark):
    rows = [("A  b SUP.3 c;", "A b  c;", "A b  c."), ("x" * 130, "x" * 119 + "…", "x" * 130 + "."), (None, None, None), ("", "", ""), ("Done!", "Done!", "Done!")]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    assert [(r.a, r.b) for r in df.select(T.compact("t").alias("a"), T.sentence("t").alias("b")).collect()] == [r[1:] for r in rows]
    labels = [("mud -> the mill, old", "mud", "the mill, old", "the mill"), ("continued cast: Ann, Ben", None, None, "Ann"), ("Current place: x", None, None, None), (None, None, None, None), ("ann appears in ch02.", None, None, "ann"), ("a -> b => c c", "a -> b", "c c", "c c")]
    got = [tuple(r) for r in spark.createDataFrame([(r[0],) for r in labels], "t string").select(*T.bridge("t"), book.cue("t").alias("c")).collect()]
    assert got == [r[1:] for r in labels]


def test_governor_states(spark):
    units = [("snapshot", "Now", "visible", "state_recovery"), ("boundary_delta", "Shift", "visible", "boundary_update"), ("character_focus", "Cast", "expandable", "character_reentry"), ("causal_bridge", "Why", "expandable", "causal_gap"), ("reentry_recap", "Resume", "trigger_only", "session_reentry"), ("visual_context", "Scene cues", "trigger_only", "spatial_disorientation")]
    p = spark.createDataFrame([("d", "c", 1, "s", k, lab, d, pr, i + 1, "selected") for i, (k, lab, d, pr) in enumerate(units)], "doc_id string, chapter_id string, scene_no int, scene_id string, kind string, label string, display string, problem string, place int, choice string")
    states = spark.createDataFrame([(0, 600_000, 0.1, True, True, False), (1, 0, 0.9, False, True, True), (2, 0, 0.1, False, False, True)], "state int, resume_gap_ms long, fatigue double, visual boolean, active boolean, signal boolean")
    got = {r.state: (r.before_text, r.beside_visual, r.on_demand, r.hidden_triggers, r.suppressed, r.diagnostics) for r in support.governed(p, states).collect()}
    assert got[0] == (["Now"], ["Cast"], ["Shift", "Why", "Resume", "Scene cues"], 0, 0, ["session_reentry", "visual_useful"])
    assert got[1] == ([], ["Cast"], ["Shift", "Why"], 2, 1, ["recovery_signal", "visual_suppressed", "support_fatigue_high"])
    assert got[2] == (["Shift"], ["Cast"], ["Why"], 2, 1, ["recovery_signal", "visual_suppressed", "promoted_recovery_unit"])


def test_stream_equals_batch(spark, tmp_path):
    t0 = pd.Timestamp("2025-01-01")
    rows = [(i, t0 + pd.Timedelta(seconds=s), u, a) for i, (s, u, a) in enumerate([(0, 1, "click"), (599, 1, "view"), (1199, 1, "click"), (5, 2, "click")] + [(1200 + k, 1, "click") for k in range(6)])]
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    spark.createDataFrame(pd.DataFrame(rows + rows[:2], columns=["event_id", "ts", "user_id", "event_type"]), schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = reader.session_signals(reader.unique_events(stream)).writeStream.format("memory").queryName("signals").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.event_id: (r.reentry, r.fatigue) for r in spark.table("signals").collect()}
    want, state = {}, {}
    for i, ts, u, a in sorted(rows, key=lambda r: (r[1], r[0])):
        last, opened = state.get(u, (None, 0))
        last, opened, back, fatigue = reader.step(last, opened, int(ts.timestamp() * 1000), a)
        state[u], want[i] = (last, opened), (back, fatigue)
    assert got == want and want[2][0] and not want[1][0]


def test_scene_pipeline_partitions_the_story(spark, small):
    from fabulary.queries.story import Chapter

    p = Chapter(spark, small).packets()
    rows = p.select("doc_id", "chapter_id", "start_pid", "end_pid", "pids").collect()
    seen = [(r.doc_id, r.chapter_id, x) for r in rows for x in r.pids]
    assert len(seen) == len(set(seen)) and all(r.end_pid >= r.start_pid for r in rows)


def test_located_clusters_feed_every_language(spark):
    para = spark.createDataFrame([("d", "c", 0, "서연이 왔다."), ("d", "c", 1, "彼は泉子を見た。"), ("d", "e", 0, "Anna Marmeby sat in the mill.")], "doc_id string, chapter_id string, pid int, text string")
    clus = spark.createDataFrame([(1, "d", "c", 0, "cast", "서연", ["서연"]), (2, "d", "c", 1, "cast", "泉子", ["泉子"]), (3, "d", "c", 2, "cast", "연이", ["연이"])], "cluster_id long, doc_id string, chapter_id string, ord int, mention_type string, cluster_name string, raw_spans array<string>")
    notes = scenes.notes(para, every=True)
    said = scenes.located_mentions(clus, para, scenes.mentions(notes))
    got = {(r.chapter_id, r.pid, r.ord, r.plain, r.start_char) for r in said.where("mention_type = 'cast'").collect()}
    assert got == {("c", 0, 0, "서연", 0), ("c", 1, 1, "泉子", 2), ("e", 0, 1, "anna marmeby", 0)}
    active = {(r.chapter_id, r.pid): r.active for r in scenes.frames(said, notes).collect()}
    assert active["c", 0] == ["ent_000"] and active["c", 1] == ["ent_000", "ent_001"] and active["e", 0] == ["ent_001"]


def test_a_preposition_before_any_place_counts(spark):
    texts = ["Mud lay in the mud room. They spoke of mud.", "The milling of the mill.", "Nobody came. They slept inside The Old mill."]
    para = spark.createDataFrame([("d", "c", i, t) for i, t in enumerate(texts)], "doc_id string, chapter_id string, pid int, text string")
    clus = spark.createDataFrame([(1, "d", "c", 0, "place", "mud", ["mud"]), (2, "d", "c", 1, "place", "mill", ["mill"]), (3, "d", "c", 2, "place", "old mill", ["Old mill"])], "cluster_id long, doc_id string, chapter_id string, ord int, mention_type string, cluster_name string, raw_spans array<string>")
    said = scenes.located_mentions(clus, para, scenes.mentions(scenes.notes(para, every=True)).where("false"))
    assert {(r.pid, r.ord): r.score for r in scenes.place_scores(said).collect()} == {(0, 0): 2.0, (1, 1): 2.5, (2, 1): 2.5, (2, 2): 2.0}


def test_every_match_of_the_rules_counts(spark):
    text = "Millstone by the mill. Anna Marmeby sat in the mill, and Anna Marmeby slept at the mill before dawn."
    para = spark.createDataFrame([("d", "c", 0, text)], "doc_id string, chapter_id string, pid int, text string")
    rows = scenes.mentions(scenes.notes(para.unionByName(para), every=True)).collect()
    assert sorted((r.start_char, r.span) for r in rows if r.mention_type == "cast") == [(23, "Anna Marmeby"), (57, "Anna Marmeby")]
    assert len(rows) == 5 and all(text[r.start_char :].startswith(r.span) for r in rows)
    places = [r for r in rows if r.mention_type == "place"]
    assert len(places) == 2 and all(text[: r.start_char].endswith(" the ") for r in places)
