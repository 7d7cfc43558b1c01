"""Result tables, documents, drivers of evaluation and of text signals, manifests, and live operators."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tidepeak.config import Scoring, TwoStage
from tidepeak.functions.settle import settle
from tidepeak.operators import evaluate, intervals, manifest, media, normalize, report, rerank, text, timeline
from tidepeak.plans import documents, highlights, text_signals
from tidepeak.sources import chat as chat_source
from tidepeak.sources import pages
from tidepeak.streaming import live


def curve(spark, values, room=1):
    return spark.createDataFrame([(room, t, float(v)) for t, v in enumerate(values)], "room long, t int, score double")


def clips(spark, rows):
    return spark.createDataFrame([(1, i + 1, float(a), float(b), float(s)) for i, (a, b, s) in enumerate(rows)], "room long, id int, start double, end double, score double")


def signals(spark, n=400, rooms=(1, 2)):
    rows = []
    for room in rooms:
        for t in range(n):
            hit = any(0 <= t - at < 4 for at in range(40 + room, n, 80))
            rows += [(room, t, "rms", 0, 5.0 + t % 3 if hit else t % 7 / 10), (room, t, "dmDensity", 7, 20.0 if hit else float(t % 5)), (room, t, "eventLaughter", 4, float(hit and t % 2 == 0))]
    return spark.createDataFrame(rows, "room long, t int, signal string, ord int, value double")


SETTINGS = Scoring(sensitivity=1.0, persistence=1, min_duration=5.0, max_duration=20.0)


def test_every_reason_of_the_quality_filter(spark):
    c = curve(spark, [t % 2 for t in range(40)] + [3.0] * 60)
    rows = {r.id: r for r in intervals.judged(clips(spark, [(30, 30, 1), (50, 90, 1), (10, 12, 1), (20, 30, 1), (98, 200, 1)]), c, SETTINGS).collect()}
    assert rows[1].reasons == ["too_short"] and rows[2].reasons == ["trimmed_too_long"] and rows[2].end - rows[2].start == 20
    assert (rows[2].from_start, rows[2].from_end) == (50, 90)
    assert rows[3].reasons == rows[4].reasons == ["t_test_insignificant"] and rows[3].end - rows[3].start == 5 and abs(rows[4].score - 0.7) < 1e-9 and rows[4].p > 0.05
    assert rows[5].end == 100 and rows[5].end - rows[5].start == 5
    tiny = {r.id: r for r in intervals.judged(clips(spark, [(0, 2, 1)]), curve(spark, [1.0] * 4), SETTINGS).collect()}
    assert tiny[1].reasons == ["too_short", "insufficient_context"]
    just = intervals.judged(clips(spark, [(0, 2, 1)]), curve(spark, [1.0] * 5), SETTINGS).first()
    assert just.reasons == ["insufficient_context"] and (just.start, just.end) == (0, 5)
    kept = intervals.quality(clips(spark, [(30, 30, 1), (20, 30, 1)]), c, SETTINGS).collect()
    assert [r.id for r in kept] == [2] and kept[0].p > 0.05


def test_tables_of_the_point_scorer(spark):
    tables = highlights.point_tables(signals(spark), settings=SETTINGS)
    found, plain = tables.clips.collect(), highlights.point_scores(signals(spark), settings=SETTINGS).collect()
    assert sorted(map(str, found)) == sorted(map(str, plain)) and found
    assert {r.reason for r in tables.dropped.collect()} <= {"duplicate", "too_short"}
    assert {r.reason for r in tables.adjustments.collect()} <= {"trimmed_too_long", "insufficient_context", "t_test_insignificant"}


def test_tables_of_the_second_stage(spark):
    s = signals(spark)
    settings = TwoStage(per_hour=200.0, min_gap=6.0, window=12.0, top_k=2, min_score=0.05)
    recall, result = highlights.two_stage_tables(s, low=5.0, high=24.0, settings=settings)
    kept, dropped = result.clips.collect(), result.dropped.collect()
    assert all(sum(r.room == room for r in kept) == 2 for room in (1, 2)) and [r.id for r in kept if r.room == 1] == [1, 2]
    assert recall.count() == len(kept) + len(dropped) and {r.reason for r in dropped} <= {"too_short", "below_min_score", "overlap", "top_k_cut"}
    cut = [r for r in dropped if r.reason == "top_k_cut" and r.room == 1]
    assert cut and min(r.score for r in kept if r.room == 1) >= max(r.score for r in cut)
    assert all(r.kept_start is not None for r in dropped if r.reason == "overlap")
    assert {r.reason for r in result.adjustments.collect()} <= {"stage2_duration_fit", "boundary_optimized"}
    stats = {r.room: r for r in rerank.rerank_stats(recall, result).collect()}
    assert stats[1].kept == 2 and sum(stats[1].content_types.values()) == 2 and stats[1].candidates == stats[1].kept + stats[1].dropped
    none = highlights.two_stage_tables(s, low=5.0, high=24.0, settings=TwoStage(per_hour=200.0, min_score=9.0))[1]
    assert none.clips.count() == 0 and {r.reason for r in none.dropped.collect()} == {"below_min_score"}


def test_documents(spark):
    s = signals(spark, 200, (1,))
    z, c = highlights.point_curve(s, "default", SETTINGS)
    tables = highlights.point_tables(s, settings=SETTINGS)
    doc = json.loads(documents.time_table(c, tables.clips, tables.dropped, tables.adjustments, low=5.0, high=20.0).first().doc)
    assert (doc["roomId"], doc["duration"], doc["profile"], doc["maxDuration"]) == ("1", 200, "default", 20.0)
    assert [x["start"] for x in doc["clips"]] == sorted(x["start"] for x in doc["clips"]) and doc["clips"] and isinstance(doc["dropped"], list)
    weights = normalize.profile_weights(s)
    scores = json.loads(documents.scores(c, z, weights, top=2).first().doc)
    assert len(scores["scores"]) == 200 and len(scores["topSignals"]) == 2 and len(scores["signalStats"]) == 3
    by = {x["signal"]: x["contribution"] for x in scores["signalStats"]}
    assert scores["topSignals"] == sorted(by, key=lambda k: -by[k])[:2]
    empty = json.loads(documents.time_table(c, tables.clips.limit(0), tables.dropped.limit(0), tables.adjustments.limit(0)).first().doc)
    assert empty["clips"] == [] and empty["adjustments"] == []
    found = json.loads(documents.candidates(c, highlights.two_stage_tables(s, settings=TwoStage(per_hour=100.0))[0], weights).first().doc)
    assert found["candidates"] and len(found["recallCurve"]) == 200
    order = report.signal_order(documents.signal_stats(z, weights), top=1).collect()
    assert [r.place for r in sorted(order, key=lambda r: r.place)] == [1, 2, 3] and max(r.share for r in order) == 100.0


def test_tied_names_and_weightless_signals_in_report_order(spark):
    rows = [(1, "a", 0, 0.0, 0.9), (1, "b", 1, 0.2, 0.3), (1, "c", 2, 0.1, 0.3), (1, "d", 3, 0.1, 0.0)]
    out = report.signal_order(spark.createDataFrame(rows, "room long, signal string, ord int, weight double, contribution double"), top=2, limit=3).orderBy("place").collect()
    assert [r.signal for r in out] == ["b", "c", "a"] and abs(out[0].share - 100 / 3) < 1e-9


def annotations(spark, rows):
    return spark.createDataFrame([(room, i, float(a), float(b), q, True) for i, (room, a, b, q) in enumerate(rows)], "room long, id long, start double, end double, quality int, worth boolean")


def test_cases_by_k_and_profile_in_one_plan(spark):
    s = signals(spark, 300)
    notes = annotations(spark, [(1, 38, 55, 5), (1, 118, 130, 4), (1, 200, 215, 3), (2, 40, 56, 4), (2, 10, 12, 1)])
    found = settle(highlights.point_scores(s, settings=SETTINGS))
    rows = {(r.room, r.k): r for r in evaluate.metrics_at(found, notes, (1, 3)).collect()}
    assert rows.keys() == {(1, 1), (1, 3), (2, 1), (2, 3)} and rows[1, 3].recall_at_k >= rows[1, 1].recall_at_k
    failed = evaluate.failed_cases(evaluate.case_checks(spark.createDataFrame([*rows.values()]))).collect()
    assert failed and all(r.missed for r in failed)
    with pytest.raises(ValueError):
        evaluate.metrics_at(found, notes, ())
    weights = evaluate.candidate_table(spark, [{"rms": 1.0}, {"dmDensity": 0.5, "rms": 0.5}])
    score = lambda many, w: highlights.point_scores(many, w, settings=SETTINGS)
    by_case = settle(evaluate.variant_metrics(s, notes, weights, score, 3))
    assert {(r.variant, r.room) for r in by_case.collect()} == {(v, r) for v in ("00000", "00001") for r in ("1", "2")}
    judged = settle(evaluate.evaluated_candidates(by_case))
    best = evaluate.best_candidate(judged).collect()
    assert len(best) == 1 and best[0].objective == max(r.objective for r in judged.collect())
    assert [r.signal for r in evaluate.top_features(weights, 1).orderBy("variant").collect()] == ["rms", "dmDensity"]
    with pytest.raises(ValueError):
        evaluate.evaluated_candidates(by_case, "speed")


def test_profiles_are_judged_on_their_own_cases(spark):
    rows = [("default", r, 10, 5, 6) for r in ("1", "2", "3")] + [("game", r, 10, 8, 6) for r in ("1", "2", "3")] + [("talent", r, 10, 5, 6) for r in ("1", "2", "3")]
    by_case = spark.createDataFrame(rows, "variant string, room string, top long, matched long, positives long")
    cases = spark.createDataFrame([(1, "game"), (2, "game"), (3, "talent")], "room long, profile string")
    out = {r.profile: r for r in evaluate.compare_profiles(by_case, cases).collect()}
    assert (out["game"].recommendation, out["talent"].recommendation, out["default"].recommendation) == ("keep", "collect_more_or_merge", "keep")
    assert out["game"].cases == 2 and out["game"].positives == 12 and abs(out["game"].delta - (16 / 16 - 10 / 16)) < 1e-4 and out["default"].cases == 0
    same = {r.profile: r.recommendation for r in evaluate.compare_profiles(by_case, cases, min_cases=1).collect()}
    assert same["talent"] == "merge_into_default"


def test_loaded_cases(spark):
    tables = spark.createDataFrame([(1, '{"profile":"game","duration":60,"clips":[{"start":1,"end":2,"score":0.5},{"id":9,"start":3,"end":4}]}'), (2, '{"profile":""}'), (3, "[]"), (4, '{"profile":"odd"}')], "room long, doc string")
    notes = spark.createDataFrame([(2, '{"profile":"talent","annotations":[]}')], "room long, doc string")
    good, bad = evaluate.loaded_cases(tables, notes)
    assert {r.room: (r.profile, r.duration, len(r.clips)) for r in good.collect()} == {1: ("game", 60.0, 2), 2: ("talent", None, 0)}
    assert [(r.room, r.profile) for r in bad.collect()] == [(4, "odd")]
    assert sorted((r.id, r.score) for r in evaluate.clips_of(good).collect()) == [(1, 0.5), (9, 0.0)]
    values = spark.createDataFrame([("1.5",), ("nan",), ("inf",), ("x",), (None,)], "v string").select(evaluate.finite(F.col("v")).alias("x")).collect()
    assert [r.x for r in values] == [1.5, None, None, None, None]


def test_all_text_signals_and_their_stats(spark):
    rows = [(1, t, i, f"w{t % 7} w{i}" + ("?" if i else " 666"), f"u{i}", "chat") for t in range(90) for i in range(1 + t % 3)] + [(1, 500, 0, "late", "u", "chat"), (2, 5, 0, "alone", "u", "chat")]
    chat = spark.createDataFrame(rows, "room long, t int, line_no int, content string, user_id string, type string")
    asr = spark.createDataFrame([(1, 0, 3.0, 6.0, "say magic", "a"), (1, 1, 6.0, 9.0, "no", "b")], "room long, seg_idx int, start double, end double, text string, speaker string")
    settings = text_signals.TextSettings(phrases=("magic",))
    out = text_signals.signals(chat, asr, 90, settings).cache()
    names = {r.signal for r in out.select("signal").distinct().collect()}
    assert len(names) == 18 and out.count() == 18 * 2 * 90
    value = {(r.room, r.t, r.signal): r.value for r in out.collect()}
    assert value[1, 4, "asrKeyword"] == 1.0 and value[1, 7, "asrKeyword"] == 0.0 and value[2, 5, "dmUniqueUsers"] == 1.0 and value[1, 10, "keywordHighEnergy"] > 0
    spine = timeline.spine(chat, 90)
    plain = {(r.room, r.t): r.dmQuestionRate for r in text.question_rate(timeline.in_range(chat, 90), spine).collect()}
    assert all(value[room, t, "dmQuestionRate"] == v for (room, t), v in plain.items())
    docs = spark.createDataFrame([(1, '[{"start":3,"end":6,"text":"say magic"}]'), (2, "{oops")], "room long, doc string")
    stats = {r.room: r for r in text_signals.stats(chat, out, chat_source.transcript_report(docs), 90, settings).collect()}
    assert (stats[1].messages, stats[1].skipped, stats[1].asr_status, stats[1].asr_degraded, stats[1].status) == (181, 1, "ok", False, "ok")
    assert stats[1].utr_source == "calibrated" and stats[2].utr_source == "configured" and stats[2].asr_degraded and stats[1].keyword_max["keywordHighEnergy"] > 0
    nothing = text_signals.signals(chat.limit(0), asr.limit(0), 90)
    assert nothing.count() == 0 and nothing.columns == ["room", "t", "signal", "ord", "value"]


def test_mood_strategies(spark):
    rows = spark.createDataFrame([("nice",), ("plain",), ("",)], "content string")
    model = lambda c: F.when(c == "plain", 0.9).when(c == "nice", -0.9)
    moods = lambda mode: [r.m for r in rows.select(text.mood_of(F.col("content"), mode, model).alias("m")).collect()]
    assert moods("rules") == [0.5, 0.0, 0.0] and moods("hybrid") == [0.5, 0.9, 0.0] and moods("hf") == [-0.9, 0.9, 0.0]
    with pytest.raises(ValueError):
        text.mood_of(F.col("content"), "other")


def test_keywords_by_word_first_then_by_vector(spark):
    asr = spark.createDataFrame([(1, 0, 0.0, 2.0, "the magic", [0.0, 1.0]), (1, 1, 2.0, 4.0, "near", [1.0, 0.1]), (1, 2, 4.0, 6.0, "far", [0.0, 1.0])], "room long, seg_idx int, start double, end double, text string, vector array<double>")
    spine = timeline.spine(asr, 10)
    hits = lambda **k: [r.t for r in text.asr_keyword(asr, spine, ["magic"], 10, **k).where("asrKeyword = 1").orderBy("t").collect()]
    assert hits() == [0, 1] and hits(vectors=[[1.0, 0.0]]) == [0, 1, 2, 3]


def test_transcript_and_feature_reports(spark):
    docs = spark.createDataFrame([(1, '{"segments":[{"start":0,"end":2.5,"text":"x"},{"start":2,"end":7,"text":"y"}]}'), (2, '{"status":"failed","error":"boom","segments":[]}'), (3, None), (4, "[]"), (5, "nope")], "room long, doc string")
    out = {r.room: (r.status, r.degraded, r.segments, r.duration, r.error) for r in chat_source.transcript_report(docs).collect()}
    assert out == {1: ("ok", False, 2, 7.0, None), 2: ("failed", True, 0, 0.0, "boom"), 3: ("missing", True, 0, 0.0, None), 4: ("empty", True, 0, 0.0, None), 5: ("invalid", True, 0, 0.0, None)}
    rows = spark.createDataFrame([("a", 3.0, {"x": [1.0, 2.0, 3.0], "y": [1.0]}, "{}"), ("b", 3.0, None, "{}"), ("c", 3.0, None, None), ("d", 3.0, {"x": []}, "{}")], "artifact string, duration double, features map<string,array<double>>, doc string")
    assert {r.artifact: (r.status, r.misaligned) for r in manifest.feature_status(rows).collect()} == {"a": ("ok", ["y"]), "b": ("invalid", []), "c": ("missing", []), "d": ("empty", ["x"])}


def test_json_objects_of_a_file_and_of_none(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1}\n[1]\n"s"\n{broken\n\n  {"b":2}\n')
    assert [r.line for r in chat_source.read_json_objects(spark, f"file://{tmp_path}/x.jsonl").collect()] == ['{"a":1}', '{"b":2}']
    assert chat_source.read_json_objects(spark, f"file://{tmp_path}/none.jsonl").count() == 0


def test_state_markers_and_generic_scripts(spark):
    html = [f'<html><script>window.{m} = {{"roomId":"{i}"}};</script></html>' for i, m in enumerate(("__INITIAL_STATE__", "__NUXT__", "__SSR_DATA__", "__NEXT_DATA__"))] + ['<script>var x = {"flv_pull_url":{"HD1":"https://pull-flv-x/a_hd.flv?k=1"}}</script>', "<p>none</p>"]
    out = pages.embedded_json(spark.createDataFrame(list(enumerate(html)), "page_id long, html string")).collect()
    first = {r.page_id: r.doc for r in sorted(out, key=lambda r: -r.pos)}
    assert {i: json.loads(first[i])["roomId"] for i in range(4)} == {i: str(i) for i in range(4)} and "flv_pull_url" in first[4] and 5 not in first


def test_recorded_artifacts_are_reused(spark):
    kind = "artifact string, step string, settings string, params string, sources map<string,string>, digest string"
    made = spark.createDataFrame([("a", "s", "x", "p", {"f": "1"}, "d")], kind)
    kept = manifest.updated(manifest.record(made.withColumn("digest", F.lit("old"))), manifest.record(made))
    assert kept.count() == 1 and [r.reason for r in manifest.reuse(kept, made).collect()] == ["cache hit"]
    assert manifest.reuse(kept, made.withColumn("digest", F.lit("e"))).first().reason == "artifact modified"


def test_fingerprints_of_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"x" * 100)
    read = lambda: manifest.fingerprints(spark.read.format("binaryFile").load(f"file://{tmp_path}"), 50).collect()
    first = read()
    assert {r.path[-5:]: (r.size, r.digest is None) for r in first} == {"a.bin": (3, False), "b.bin": (100, True)}
    (tmp_path / "a.bin").write_bytes(b"abd")
    kind = "path string, size long, modified long, digest string"
    table = lambda rows: spark.createDataFrame([tuple(r) for r in rows], kind)
    assert {r.path[-5:]: r.same for r in manifest.unchanged(table(first), table(read())).collect()} == {"a.bin": False, "b.bin": True}
    assert [r.same for r in manifest.unchanged(table(first), table(first[:1])).collect()].count(True) == 1


def test_segments_in_quarantine(spark):
    rows = [(1, 1, 5000, 3.0, "FLV"), (1, 2, 10, 3.0, "FLV"), (1, 3, 5000, 3.0, "MP4"), (1, 4, 5000, 0.0, "FLV"), (1, 5, None, None, None)]
    out = manifest.segment_report(spark.createDataFrame(rows, "room long, idx int, size long, seconds double, header string")).orderBy("idx").collect()
    assert [(r.usable, r.quarantine) for r in out] == [(True, None), (False, "too_small"), (False, "bad_header"), (False, "no_duration"), (False, "missing")]


def test_target_length(spark):
    rows = spark.createDataFrame([(2.1,), (3.0,), (0.0,), (None,)], "s double").select(timeline.target_length(F.col("s")).alias("n")).collect()
    assert [r.n for r in rows] == [3, 3, None, None]
    assert media.scene_cuts(spark.createDataFrame([(1, 0, 30.0), (1, 5, 10.0)], "room long, t int, value double")).count() == 1


def test_one_room_among_thousands_equals_itself_alone(spark):
    many = spark.range(3000).selectExpr("id AS room", "explode(sequence(0, 19)) AS t").selectExpr("room", "CAST(t AS int) AS t", "'rms' AS signal", "0 AS ord", "CAST(pmod(xxhash64(room, t), 100) AS double) / 10 AS value")
    large = spark.range(5000).selectExpr("-1L AS room", "CAST(id AS int) AS t", "'rms' AS signal", "0 AS ord", "CASE WHEN id % 61 < 3 THEN 9.0D ELSE CAST(pmod(xxhash64(id), 100) AS double) / 100 END AS value")
    both = many.unionByName(large)
    z = lambda rows: normalize.preprocess(rows, SETTINGS)
    alone = {(r.room, r.t): r.value for r in z(both.where("room IN (-1, 7, 2999)")).collect()}
    crowd = {(r.room, r.t): r.value for r in z(both).where("room IN (-1, 7, 2999)").collect()}
    assert alone == crowd and len(alone) == 5040
    exact = {(r.room, r.t): r.value for r in normalize.ewma_exact(large).collect()}
    assert all(abs(r.value - exact[r.room, r.t]) < 1e-9 for r in normalize.ewma(large).collect())
    clips = spark.range(4000).selectExpr("id % 1000 AS room", "CAST(id AS int) AS id", "CAST(id % 7 AS double) AS start", "CAST(id % 7 + 9 AS double) AS end", "CAST(id % 11 AS double) AS score")
    kept = rerank.suppress_overlaps(clips).where("kept")
    assert kept.select("room").distinct().count() == 1000 and kept.groupBy("room").count().agg(F.max("count")).first()[0] <= 4


# ── streams ──
def chat_folder(spark, folder, files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "room long, t int, line_no int, content string").coalesce(1).write.mode("append").parquet(f"{folder}/chat")
    return spark.readStream.schema("room long, t int, line_no int, content string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/chat")


def run(stream, name, mode, **options):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return query


def test_recent_messages_are_bounded(spark, tmp_path):
    stream = chat_folder(spark, tmp_path, [[(1, t, t, f"m{t}") for t in range(5)], [(1, t, t, f"m{t}") for t in range(5, 9)], [(2, 1, 1, "x")]])
    run(live.recent(stream, 3), "recent", "update")
    rows = spark.table("recent").collect()
    assert max(r.held for r in rows if r.room == 1) == 3 and {r.newest for r in rows if r.room == 1} >= {"m8"} and [r.held for r in rows if r.room == 2] == [1]


def test_received_time_and_approximate_users(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:05.25", "u"), (1, "2024-01-01 00:00:05.5", "v")], "room long, ts string, user_id string").withColumn("ts", F.to_timestamp("ts"))
    out = live.stamped(rows.withColumn("received", F.col("ts")), F.lit("2024-01-01").cast("timestamp")).orderBy("ts").collect()
    assert [r.recv_sec for r in out] == [5.25, 5.5] and "received" in live.stamped(rows).columns
    assert [(r.n, r.users) for r in live.tumbling_counts(rows).collect()] == [(2, 2)]


def test_silent_rooms_are_closed(spark, tmp_path):
    stream = chat_folder(spark, tmp_path, [[(1, 0, 0, "a"), (2, 0, 1, "b")]])
    query = live.idle_rooms(stream, "1 second").writeStream.format("memory").queryName("idle").outputMode("update").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if spark.table("idle").where("closed").count() == 2:
                break
        assert {(r.room, r.n) for r in spark.table("idle").where("closed").collect()} == {(1, 1), (2, 1)}
    finally:
        query.stop()


def test_a_failing_query_is_started_again(spark):
    waits, calls = [], []

    class Query:
        def awaitTermination(self):
            calls.append(1)
            if len(calls) < 4:
                raise RuntimeError("lost")

    assert live.supervised(Query, retries=5, delay=10.0, sleep=waits.append) == 3 and waits == [10.0, 20.0, 30.0]
    calls.clear()
    with pytest.raises(RuntimeError):
        live.supervised(Query, retries=1, delay=0.0, sleep=waits.append)


def test_stats_of_a_rooms_signals_are_all_told(spark):
    from tidepeak.plans.catalogue import ORACLE, QUERIES

    got = QUERIES["signal_stats"](spark, "/root/testdata/sf0.001").groupBy("room").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.n for r in got} == {5} and "rank <= 3" not in ORACLE["signal_stats"]


def test_recent_messages_of_a_table_in_several_files(spark, tmp_path):
    from tidepeak.plans.catalogue import QUERIES

    rows = spark.createDataFrame([(c, t, "user", f"m{c}-{t}") for c in range(4) for t in range(1 + 2 * c)], "conv_id long, turn long, role string, text string")
    rows.orderBy("turn", "conv_id").repartitionByRange(3, "turn").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["recent_messages"](spark, str(tmp_path)).join(rows.select(F.md5("text").alias("newest"), "text"), "newest").collect()
    assert sorted((r.room, r.held, r.text) for r in got) == [(0, 1, "m0-0"), (1, 3, "m1-2"), (2, 3, "m2-4"), (3, 3, "m3-6")]

def test_every_edge_is_ranked_as_a_whole(spark):
    from tidepeak.plans import catalogue  # noqa: F401
    from tidepeak.plans.queries_intervals import parts

    # both sides of the search in one plan, as in search_edges()
    z, _, c, ranges = parts(spark, "/root/testdata/sf0.001")
    windows = intervals.expand(ranges, c, 5.0, 24.0)
    sides = [rerank.edge_candidates(windows.select("room", "id", F.col(end).alias("edge")), z, c, None, 4.0).select("room", "id", F.col("time").alias(end), F.col("rank").alias(f"{end}_rank")) for end in ("start", "end")]
    rows = sides[0].join(sides[1], ["room", "id"]).collect()
    for end in ("start", "end"):
        places = {(r.room, r.id, r[end], r[f"{end}_rank"]) for r in rows}
        assert len(places) == len({p[:3] for p in places}) == len({(*p[:2], p[3]) for p in places})
        assert {r[f"{end}_rank"] for r in rows} <= set(range(1, 11))


def test_moods_are_made_once_a_message(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def model(_content):
        calls.add(1)
        return 1.0

    chat = spark.createDataFrame([(1, t, t, "word " * 50 + str(t), "u", "chat") for t in range(3)], "room long, t int, line_no long, content string, user_id string, type string")
    known = text_signals.facts(chat, 3, text_signals.TextSettings(sentiment="hf", model=model)).collect()
    assert sorted(r.mood for r in known if r.kind == text_signals.MESSAGE) == [1.0] * 3 and all(r.mood is None for r in known if r.kind != text_signals.MESSAGE)
    assert calls.value == 3


def test_entropy_sorts_tokens_around_a_tick_once(spark):
    counted = spark.createDataFrame([(1, 0, "a", 3), (1, 0, "b", 1), (1, 2, "a", 1)], "room long, t int, item string, c long")
    found = text.entropy_of(counted, 1, 50)
    windows = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert sum("AS total" in w or "AS place" in w for w in windows) == 1
    assert [round(r.dmEntropy, 6) for r in found.where("t = 1").collect()] == [round(-(0.8 * math.log2(0.8) + 0.2 * math.log2(0.2)), 6)]
