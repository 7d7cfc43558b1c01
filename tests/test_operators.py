"""Operators on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from tidepeak.config import Scoring, TwoStage
from tidepeak.operators import detect, evaluate, intervals, normalize, report, rerank, text, timeline
from tidepeak.plans import highlights
from tidepeak.plans.catalogue import QUERIES
from tidepeak.sources import chat as chat_source
from tidepeak.sources import frames


def signal(spark, values, name="rms", order=0, room=0):
    return spark.createDataFrame([(room, t, name, order, float(v)) for t, v in enumerate(values)], "room long, t int, signal string, ord int, value double")


def clips(spark, rows):
    return spark.createDataFrame([(0, i + 1, float(s), float(e), float(x)) for i, (s, e, x) in enumerate(rows)], "room long, id int, start double, end double, score double")


def chat(spark, ticks):
    return spark.createDataFrame([(0, t, i, c, "u", "chat") for t, cs in enumerate(ticks) for i, c in enumerate(cs)], "room long, t int, line_no int, content string, user_id string, type string")


def curve(spark, values):
    return signal(spark, values).select("room", "t", F.col("value").alias("score"))


def column(df, name, key="t"):
    return [r[name] for r in df.orderBy(key).collect()]


def test_alignment_stretches_pads_and_cuts(spark):
    short = signal(spark, range(17), "dmDensity").unionByName(signal(spark, [1] * 17, "asrKeyword")).unionByName(signal(spark, range(25)))
    out = timeline.align(short, 20)
    stretched = column(out.where("signal = 'dmDensity'"), "value")
    assert len(stretched) == 20 and stretched[0] == 0 and stretched[-1] == 16 and math.isclose(stretched[1], 16 / 19)
    assert column(out.where("signal = 'asrKeyword'"), "value") == [1.0] * 17 + [0.0] * 3
    assert column(out.where("signal = 'rms'"), "value") == [float(i) for i in range(20)]
    assert column(timeline.align(signal(spark, [7]), 3), "value") == [7, 7, 7]


def test_diversity_counts_tokens_of_the_window(spark):
    c = chat(spark, [["a b", "a"], [], ["c"]])
    sp = spark.createDataFrame([(0, t) for t in range(4)], "room long, t int")
    assert column(text.token_diversity(c, sp, 0), "dmUtr") == [2 / 3, 1, 1, 1]
    assert column(text.token_diversity(c, sp, 2), "dmUtr") == [0.75, 0.75, 0.75, 1]


def test_rates_and_repeats(spark):
    c = chat(spark, [["what?", "ok"], ["好！", " OK "], ["[x]", ""]])
    sp = spark.createDataFrame([(0, t) for t in range(3)], "room long, t int")
    assert column(text.question_rate(c, sp, 0), "dmQuestionRate") == [0.5, 0, 0]
    assert column(text.exclamation_rate(c, sp, 0), "dmExclamationRate") == [0, 0.5, 0]
    assert column(text.emoji_rate(c, sp, 0), "dmEmojiRate") == [0, 0, 0.5]
    assert column(text.repeat_rate(c, sp, 1), "dmRepeatRate")[0] == 0.25


def test_keyword_mix(spark):
    c = chat(spark, [[], ["库存"], []])
    asr = spark.createDataFrame([(0, 0, 1.0, 2.0, "库存最后一批", None)], "room long, seg_idx int, start double, end double, text string, speaker string")
    sp = spark.createDataFrame([(0, t) for t in range(3)], "room long, t int")
    assert column(text.keyword_rate(c, asr, sp, ["库存"], 3, "x", 0), "x") == [0, 1, 0]
    assert column(text.asr_keyword(asr, sp, ["库存"], 3), "asrKeyword") == [0, 1, 0]


def test_mood_and_acceleration(spark):
    words = spark.createDataFrame([(["nice", "差", "赞"],), (["差"],), (["x"],)], "w array<string>")
    assert [r[0] for r in words.select(text.mood(F.col("w"))).collect()] == [0.5, -0.5, 0]
    assert column(text.acceleration(signal(spark, [0, 1, 4, 9])), "dmAcceleration") == [0, 2, 2, 0]


def test_ewma_equals_the_recursion(spark):
    rows = signal(spark, [math.sin(i) * 50 for i in range(300)])
    a, b = column(normalize.ewma(rows), "value"), column(normalize.ewma_exact(rows), "value")
    assert max(abs(x - y) for x, y in zip(a, b)) < 1e-9


def test_robust_z_of_constant_and_spike(spark):
    assert set(column(normalize.robust_z(signal(spark, [4] * 9)), "value")) == {0.0}
    z = column(normalize.robust_z(signal(spark, [0] * 9 + [100])), "value")
    assert abs(max(z) - 90 / 30) < 1 and column(normalize.robust_z(signal(spark, [*range(20), 1000])), "value")[-1] == 5


def test_rolling_z_of_few_ticks(spark):
    assert column(normalize.rolling_z(signal(spark, [1, 2])), "value") == [0, 0]


def test_lag_is_compensated(spark):
    sound = [5.0 if 20 <= t < 25 else 0.0 for t in range(100)]
    late = [5.0 if 22 <= t < 27 else 0.0 for t in range(100)]
    out = normalize.compensate_lag(signal(spark, sound).unionByName(signal(spark, late, "dmDensity", 7)))
    assert column(out.where("signal = 'dmDensity'"), "value") == sound


def test_flat_curve_has_no_peaks_and_a_spike_has_one(spark):
    assert detect.hot_ticks(curve(spark, [0.3] * 100), 1.0).where("hot").count() == 0
    spike = curve(spark, [10.0 if 100 <= t < 103 else 0.0 for t in range(200)])
    ranges = detect.peak_ranges(detect.hot_ticks(spike, 2.0, Scoring(persistence=1))).collect()
    assert [(r.start, r.end) for r in ranges] == [(100, 102)]


def test_merge_keeps_outermost_bounds_and_best_score(spark):
    assert [tuple(r) for r in intervals.merge_near(clips(spark, [(0, 10, 0.8), (8, 18, 0.9)])).select("start", "end", "score").collect()] == [(0, 18, 0.9)]


def test_bounds_without_sound_are_padded(spark):
    z = signal(spark, [0] * 120, "motion")
    n = spark.createDataFrame([(0, 120)], "room long, n long")
    out = intervals.valley_bounds(clips(spark, [(50, 70, 1)]), z, n).first()
    assert (out.start, out.end) == (45, 75)
    valley = signal(spark, [-2 if t in (40, 80) else 0 for t in range(120)])
    out = intervals.valley_bounds(clips(spark, [(50, 70, 1)]), valley, n).first()
    assert (out.start, out.end) == (40, 75)


def test_expansion_and_trimming(spark):
    c = curve(spark, [float(30 <= t < 40) for t in range(100)])
    out = intervals.expand(clips(spark, [(50, 50, 1), (10, 90, 1)]), c, 15, 20).orderBy("id").collect()
    assert (out[0].start, out[0].end) == (43, 58) and (out[1].start, out[1].end) == (20, 40)


@pytest.mark.parametrize("t, n, p", [(2.0, 10, 0.073388), (2.0, 5, 0.101939), (1.0, 1, 0.5), (0.0, 7, 1.0)])
def test_t_distribution(spark, t, n, p):
    row = spark.createDataFrame([(t, n)], "t double, n long").select(intervals.t_test_p(F.col("t"), F.col("n"))).first()
    assert abs(row[0] - p) < 1e-5


def test_equal_flat_scores_are_not_penalised(spark):
    out = intervals.penalise(clips(spark, [(20, 40, 1)]), curve(spark, [1.0] * 60)).first()
    assert out.score == 1.0


def test_titles_and_tags_are_by_substring(spark):
    row = spark.createDataFrame([("keywordEmotional", 3.7)], "t string, s double").select(intervals.title(F.col("t"), F.col("s")), intervals.tags(F.col("t")), rerank.tags(F.col("t"))).first()
    assert row[0] == "📹 画面高能 (3s)" and row[1] == ["动作"] and row[2] == ["情感", "动作"]


def test_window_features(spark):
    z = signal(spark, [4 if 100 <= t < 110 else 0 for t in range(300)]).unionByName(signal(spark, [3 if 100 <= t < 106 else 0 for t in range(300)], "dmDensity", 7))
    w = normalize.profile_weights(z)
    totals = rerank.window_totals(rerank.window_signals(clips(spark, [(100, 110, 1)]), z, w)).first()
    assert math.isclose(totals.agreement, 1) and totals.novelty > 0 and set(totals.active_signals) == {"rms", "dmDensity"}


def test_overlap_suppression_and_top_k(spark):
    rows = clips(spark, [(0, 10, 0.5), (2, 12, 0.9), (30, 40, 0.1)])
    kept = rerank.suppress_overlaps(rows).where("kept").select("id").orderBy("id").collect()
    assert [r.id for r in kept] == [2, 3]
    assert [r.id for r in rerank.top_k(rows, 1).collect()] == [2]


def test_duration_ranges(spark):
    row = spark.createDataFrame([("funny",)], "k string").select(*rerank.duration_range(F.col("k"), 15, 90), *rerank.duration_range(F.col("k"), 40, 90), *rerank.duration_range(F.col("k"), 10, 90, "bilibili")).first()
    assert tuple(row) == (15, 35, 40, 90, 12, 35)


def notes(spark, rows):
    return spark.createDataFrame([(0, i + 1, float(s), float(e), q, True) for i, (s, e, q) in enumerate(rows)], "room long, id int, start double, end double, quality int, worth boolean")


def test_matching_is_maximum_where_greedy_fails(spark):
    c, a = clips(spark, [(0, 10, 9), (0, 8, 8)]), notes(spark, [(0, 10, 5), (5, 15, 5)])
    pairs = evaluate.max_matching(evaluate.match_edges(evaluate.ranked(c), a, 0.3)).collect()
    assert {(r.a_id, r.b_id) for r in pairs} == {(1, 2), (2, 1)}


def test_metrics_and_their_limits(spark):
    m = evaluate.metrics(clips(spark, [(0, 10, 9), (50, 60, 8)]), notes(spark, [(0, 10, 5), (52, 58, 1)]), 5).first()
    assert (m.matched, m.precision_at_k, m.recall_at_k, m.mean_iou, m.negative_hits) == (1, 0.5, 1.0, 1.0, 1)
    with pytest.raises(ValueError):
        evaluate.metrics(clips(spark, []), notes(spark, []), 0)


def test_report_helpers(spark):
    row = spark.createDataFrame([(3725.5, "a/b 高?", 5)], "s double, t string, n int").select(report.srt_time(F.col("s")), report.clock_time(F.col("s")), report.safe_name(F.col("t")), report.file_size(F.col("n"))).first()
    assert tuple(row) == ("01:02:05,500", "01:02:06", "ab 高", "5 B")
    tokens = spark.createDataFrame([("[doge] 哈哈哈哈哈 Nice-1",)], "t string").select(report.ngram_tokens(F.col("t"))).first()[0]
    assert tokens == ["哈哈"] * 4 + ["哈哈哈"] * 3 + ["nice-1"]


def test_annotations_are_validated(spark):
    doc = '[{"start":1,"end":2,"quality":"5","worthClipping":"是"},{"id":"x","start":3,"end":3},{"id":"y","start":1,"end":4},{"id":"y","start":1,"end":5}]'
    good, bad = chat_source.annotations(spark.createDataFrame([(0, doc)], "room long, doc string"))
    assert [(r.id, r.quality, r.worth) for r in good.collect()] == [("a1", 5, True)]
    assert sorted(r.problem for r in bad.collect()) == ["empty interval", "repeated id", "repeated id"]


def test_chat_fields_fall_back(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"recvTimeSec":"bad","timestamp":"2.5","text":"hi","user_id":"u"}\n{"_time":1}\nnot json\n')
    good, bad = chat_source.split_bad(chat_source.read_chat(spark, str(tmp_path)))
    assert sorted((r.ts, r.content) for r in chat_source.typed_chat(good).collect()) == [(1.0, ""), (2.5, "hi")] and bad.count() == 1


def test_frames_decode_in_a_table(spark):
    df = spark.createDataFrame([(bytearray(frames.encode({"method": 8, "payload_type": "msg"})),), (None,)], "b binary")
    out = [r[0] for r in df.select(frames.decode_column(F.col("b"))).collect()]
    assert out[0].method == 8 and out[0].payload_type == "msg" and out[1] is None


def test_two_stage_finds_the_two_peaks(spark):
    busy = [2.0 if 18 <= t < 24 or 53 <= t < 59 else 0.1 * (t % 3) for t in range(90)]
    rows = signal(spark, busy).unionByName(signal(spark, [x * 10 for x in busy], "dmDensity", 7))
    out = highlights.two_stage(rows, low=10, high=30, settings=TwoStage(per_hour=240)).orderBy("start").collect()
    assert any(r.start <= 20 <= r.end for r in out) and any(r.start <= 55 <= r.end for r in out)
    assert all(10 <= r.end - r.start <= 30 for r in out)


# ── queries over whole tables ──
def stored(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_repeat_rate_has_the_ticks_of_all_documents(spark, tmp_path):
    sf = stored(spark, tmp_path, "documents", [(0, "a", "src1"), (1500, "b", "src1"), (1501, "B ", "src1"), (2000, "c", "src2")], "doc_id long, text string, source string")
    out = {(r.room, r.t): r.rate for r in QUERIES["repeat_rate"](spark, sf).collect()}
    assert out.keys() == {(room, t) for room in (1, 2) for t in range(401)}
    assert {k for k, rate in out.items() if rate > 0} == {(1, t) for t in range(280, 321)} and out[1, 300] == 0.5


def test_topics_differ_in_any_component(spark):
    rows = [(0, t, [1.0] * 12 + [float(t // 30 % 2 * 10)] * 4) for t in range(120)] + [(1, t, [1.0] * 12 + [float(t >= 60) * 10] * 4) for t in range(120)]
    out = text.topic_change(spark.createDataFrame(rows, "room long, t int, features array<double>"), clusters=2)
    assert {(r.room, r.t) for r in out.where("topicChange = 1").collect()} == {(0, 30), (0, 60), (0, 90), (1, 60)} and out.count() == 8


def test_file_sizes_of_all_parts(spark, tmp_path):
    sf = stored(spark, tmp_path, "part", [(i, i) for i in range(1, 51)], "p_partkey long, p_size int")
    out = {r.p_partkey: r.size for r in QUERIES["file_sizes"](spark, sf).collect()}
    assert out == {i: f"{i * 100003 / 1048576:.1f} MB" if i * 100003 >= 1048576 else f"{i * 100003 / 1024:.1f} KB" for i in range(1, 51)}


@pytest.mark.parametrize("block", [100_000, 7])
def test_labels_are_numbered_across_ranges(spark, block):
    rows = [(i * 37 % 101, "x" if i % 4 else "y") for i in range(101)] + [(None, "x"), (500, None), (501, None)]
    out = {r.idx: r.label for r in evaluate.unique_labels(spark.createDataFrame(rows, "idx long, label string"), block).collect()}
    seen, expected = {}, {}
    for idx, label in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        seen[label] = seen.get(label, 0) + 1
        expected[idx] = label if label is None or seen[label] == 1 else f"{label}#{seen[label]}"
    assert out == expected


def test_all_labels_are_numbered(spark, tmp_path):
    sf = stored(spark, tmp_path, "labels", [(i, i % 3) for i in range(7)], "doc_id long, quality int")
    out = {r.label_id: r.label for r in QUERIES["unique_labels"](spark, sf).collect()}
    assert out == {0: "x", 1: "x1", 2: "x2", 3: "x#2", 4: "x1#2", 5: "x2#2", 6: "x#3"}


def test_cosine_keys_follow_the_ids(spark, tmp_path):
    one = lambda k: [float(i == k) for i in range(9)]
    sf = stored(spark, tmp_path / "a", "embeddings", [(100 + i, one(i % 9)) for i in range(20)], "vec_id long, embedding array<float>")
    out = {r.vec_id: (r.key_id, r.similarity) for r in QUERIES["cosine_match"](spark, sf).collect()}
    assert out == {100 + i: (100 + i % 9, 1.0) for i in range(20) if i % 9 < 8}
    sf = stored(spark, tmp_path / "b", "embeddings", [], "vec_id long, embedding array<float>")
    assert QUERIES["cosine_match"](spark, sf).collect() == []
