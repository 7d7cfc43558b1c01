"""Streams with state of their own, ledgers, rotation, long correlations."""

import json
import random
import re
import threading
import time

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidepeak.functions.windows import sliding_distinct
from tidepeak.operators import evaluate, normalize, report, rotation, text, timeline
from tidepeak.plans import text_signals
from tidepeak.sources import cases, pages, store
from tidepeak.streaming import diversity, ledger, live


def chat_files(spark, folder, files):
    for rows in files:
        spark.createDataFrame(rows, "room long, s double, content string").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(f"{folder}/chat")
    return spark.readStream.schema("room long, s double, content string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/chat")


def finished(stream, name, folder):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(240)
    return query


def test_sliding_tokens_equal_the_batch_operator_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    origin = 1_700_000_000
    rows = [(room, origin + t + rng.random() * 0.9, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 3)))) for room in (1, 2) for t in [*range(25), *range(60, 70)] for _ in range(rng.randint(0, 2))] + [(1, origin + 5.0, None)]
    rng.shuffle(rows)
    size = -(-len(rows) // 4)
    files = [rows[i : i + size] for i in range(0, len(rows), size)] + [[(9, origin + 40_000.0, "end")]]
    stream = chat_files(spark, tmp_path, files)
    finished(diversity.token_diversity(stream, 3, 1.0, origin, "1 hour"), "sliding", tmp_path)
    got = sorted((r.room, r.t, r["distinct"], r.n) for r in spark.table("sliding").collect())
    stored = spark.createDataFrame([(room, int(s - origin), c) for room, s, c in rows], "room long, t int, content string")
    expected = sliding_distinct(text.tokens(stored), timeline.spine(stored, 100), 3).where("n > 0")
    assert got == sorted((r.room, r.t, r.n_distinct, r.n) for r in expected.collect()) and len(got) > 50


def test_a_ledger_counts_what_progress_reports_have_forgotten(spark, tmp_path):
    files = [[(1, 1_700_000_000.0 + 100 * i, "x"), (1, 1_700_000_000.0, "late")] for i in range(12)]
    stream = chat_files(spark, tmp_path, files)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 3)
    book = ledger.watch(spark, f"{tmp_path}/events")
    try:
        query = finished(live.tumbling_counts(stream, "10 seconds", "10 seconds"), "booked", tmp_path)
        totals = book.totals(query)
        assert len(query.recentProgress) <= 3
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
        book.close()
    # rows are late by the watermark before last: those of the first three files still count
    assert totals["rows"] == 24 and totals["batches"] >= 12 and totals["runs"] == 1 and totals["dropped"] == 9
    kept = ledger.life(ledger.read_events(spark, f"{tmp_path}/events")).collect()
    assert [(r.rows, r.dropped, r.runs, r.failed) for r in kept] == [(24, totals["dropped"], 1, 0)]


def test_batches_that_ran_again_count_once(spark):
    rows = [("1", "stream.start", "a", "q", None, None, None, "running"), ("2", "stream.batch", "a", "q", 0, 5, 1, "ok"), ("3", "stream.end", "a", "q", None, None, None, "failed"), ("4", "stream.start", "b", "q", None, None, None, "running"), ("5", "stream.batch", "b", "q", 0, 6, 2, "ok"), ("6", "stream.batch", "b", "q", 1, 1, 0, "ok"), ("7", "stream.start", "c", "r", None, None, None, "running")]
    events = spark.createDataFrame(rows, "ts string, event string, runId string, queryId string, batchId long, rows long, dropped long, status string")
    assert sorted(tuple(r) for r in ledger.life(events).collect()) == [("q", 2, 2, 7, 2, 1), ("r", 1, 0, 0, 0, 0)]


def test_event_rows_have_all_core_fields(spark):
    rows = spark.createDataFrame([(7, "r1", "12")], "clips long, roomId string, elapsedMs string")
    out = ledger.event_rows(rows, "pipeline.step", step="score", status="ok", cacheReason="none")
    assert out.columns == [*ledger.CORE, "clips", "cacheReason"]
    got = out.first()
    assert (got.event, got.roomId, got.step, got.elapsedMs, got.runId, got.clips, got.cacheReason) == ("pipeline.step", "r1", "score", 12, None, 7, "none")
    with pytest.raises(ValueError):
        ledger.event_rows(rows, "")


def plain_files(chunks, seconds, size):
    out, start, held = [], None, 0
    number = -1
    for ts, b in chunks:
        if start is None:
            start, held, number = ts, 0, number + 1
        held += b
        out.append(number)
        if ts - start >= seconds or held >= size:
            start = None
    return out


@pytest.mark.parametrize(("seconds", "size"), [(30, 100), (1000, 50), (7, 10_000), (10_000, 10_000)])
def test_rotation_equals_a_loop(spark, seconds, size):
    rng = random.Random(seconds)
    rooms = {r: sorted((rng.randint(0, 200), rng.randint(0, 20)) for _ in range(n)) for r, n in ((1, 70), (2, 1), (3, 25))}
    rows = spark.createDataFrame([(r, t, b) for r, chunks in rooms.items() for t, b in chunks], "room long, s long, bytes long").select("room", F.timestamp_seconds("s").alias("ts"), "bytes")
    got = {}
    for r in rotation.rotated_by_size(rows, seconds, size).orderBy("room", "idx").collect():
        got.setdefault(r.room, []).append(r.file)
    expected = {r: plain_files(chunks, seconds, size) for r, chunks in rooms.items()}
    assert got == expected
    each = rotation.files(rows, seconds, size).collect()
    assert {r: max(f) + 1 for r, f in expected.items()} == {r: sum(x.room == r for x in each) for r in rooms}
    assert sum(x.bytes for x in each) == sum(b for chunks in rooms.values() for _, b in chunks) and sum(x.reason == "open" for x in each) <= 3


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_file_starts_by_blocks_equal_a_walk(spark, block):
    rng = random.Random(block)
    rooms = {r: [min(n, i + 1 + rng.randint(0, 9)) for i in range(n)] for r, n in ((1, 300), (2, 1), (3, 40))}
    rows = spark.createDataFrame([(r, i, a if a < len(to) else None) for r, to in rooms.items() for i, a in enumerate(to)], "room long, idx long, after long")
    expected = set()
    for r, to in rooms.items():
        at = 0
        while at < len(to):
            expected.add((r, at))
            at = to[at]
    got = [tuple(r) for r in rotation.starts(rows, block).collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_rotation_of_many_chunks_takes_time_in_proportion(spark):
    # a frame to the end of the room would read 2 * 10^10 rows here
    rows = spark.range(200_000).select(F.lit(1).alias("room"), F.timestamp_seconds(F.col("id") / 10).alias("ts"), (F.col("id") % 7).alias("bytes"))
    begun = time.monotonic()
    each = rotation.files(rows, 100.0, 250).collect()
    assert time.monotonic() - begun < 60 and sum(r.chunks for r in each) == 200_000 and {r.reason for r in each} == {"size_cap", "open"}


def test_correlation_by_transforms_equals_the_direct_one():
    rng = np.random.default_rng(1)
    for n in (11, 64, 501):
        for _ in range(20):
            a, b = rng.normal(size=n), rng.integers(0, 2, n).astype(float)
            for x, y in ((a, b), (b, np.roll(b, 3)), (np.zeros(n), b), (a, np.roll(a, -2))):
                x, y = x - x.mean(), y - y.mean()
                assert normalize.peak_lag(x, y) == int(np.argmax(np.correlate(x, y, "full"))) - (n - 1)
    a = rng.normal(size=86_400)
    assert normalize.peak_lag(a, np.roll(a, 4)) == -4


# ── one pass ──
def test_one_pass_signals_equal_each_operator(spark):
    rng = random.Random(4)
    words = ["nice", "666", "x?", "Y!", "[ok]", "垃圾", "a", "b", "c", "👍", "抽奖", ""]
    rows = [(room, rng.randint(-1, 42), i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 5))), rng.choice("uvw"), "chat") for room in (1, 2) for i in range(150)] + [(1, 3, 999, None, None, "gift")]
    chat = spark.createDataFrame(rows, "room long, t int, line_no int, content string, user_id string, type string")
    asr = spark.createDataFrame([(1, 0, 3.0, 6.5, "say magic 666", "a"), (1, 1, 6.0, 9.0, "no", "b"), (3, 0, 39.0, 44.0, "magic 下头", "b")], "room long, seg_idx int, start double, end double, text string, speaker string")
    topics = spark.createDataFrame([(1, 30, 1.0)], "room long, t int, topicChange double")
    n, settings = 40, text_signals.TextSettings(phrases=("magic",), radius=2, utr_radius=4, entropy_cap=3, entropy_top=2)
    counters = Observation("chat")
    out = text_signals.signals(chat, asr, n, settings, topics, counters)
    assert counters.get == {"messages": 301, "skipped": sum(not 0 <= r[1] < n for r in rows), "blank": sum(not (r[3] or "").strip() for r in rows)}
    got = {(r.room, r.t, r.signal): r.value for r in out.collect()}
    spine = timeline.spine(chat.select("room").union(asr.select("room")), n)
    inside = timeline.in_range(chat.fillna("", "content"), n)
    utr, density = text.token_diversity(inside, spine, 4), text.density(inside)
    adjusted = text.adjusted_density(density, utr, text.diversity_threshold(utr, density))
    users = spine.join(text.unique_users(inside), ["room", "t"], "left").fillna(0)
    parts = [adjusted, text.acceleration(adjusted, "dmDensity"), text.entropy(inside, spine, 2, 3, 2), text.sentiment(inside, spine), users, utr, text.repeat_rate(inside, spine, 2), text.question_rate(inside, spine, 2), text.exclamation_rate(inside, spine, 2), text.emoji_rate(inside, spine, 2)]
    parts += [text.keyword_rate(inside, asr, spine, list(phrases), n, text_signals.signal_name(kind), 2) for kind, phrases in text.KEYWORDS.items()]
    parts += [text.asr_keyword(asr, spine, ["magic"], n), text.speaker_change(asr, spine, n), text.topic_signal(topics, spine)]
    expected = {(r.room, r.t, p.columns[-1]): float(r[p.columns[-1]]) for p in parts for r in p.collect()}
    assert got.keys() == expected.keys() and len(expected) == 3 * n * 19
    assert all(abs(got[k] - v) < 1e-9 for k, v in expected.items())


def test_chat_is_scanned_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, t, t, f"w{t} ?", "u", "chat") for t in range(9)], "room long, t int, line_no int, content string, user_id string, type string")
    rows.write.parquet(f"{tmp_path}/chat")
    known = text_signals.facts(spark.read.parquet(f"{tmp_path}/chat"), 9)
    assert known._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert [tuple(r) for r in text_signals.counted(known).collect()] == [(1, 9, 0)]


def test_every_k_is_as_if_it_were_the_only_one(spark):
    rng = random.Random(6)
    clips = spark.createDataFrame([(room, i, s, s + rng.randint(1, 30), rng.random()) for room in (1, 2) for i in range(30) for s in [float(rng.randint(0, 200))]], "room long, id long, start double, end double, score double")
    notes = spark.createDataFrame([(room, i, s, s + rng.randint(1, 30), rng.randint(1, 5), True) for room in (1, 2, 3) for i in range(20) for s in [float(rng.randint(0, 200))]], "room long, id long, start double, end double, quality int, worth boolean")
    limits = {"match_iou": 0.05, "duplicate_iou": 0.3}
    every = {(r.room, r.k): r for r in evaluate.metrics_at(clips, notes, (1, 4, 10, 50), **limits).collect()}
    for k in (1, 4, 10, 50):
        for r in evaluate.metrics(clips, notes, k, **limits).collect():
            assert r == every.pop((r.room, k))
            assert r.matched == brute_matching(clips.collect(), notes.collect(), r.room, k, 0.05)
    assert not every


def brute_matching(clips, notes, room, k, least):
    """Largest matching by repeated depth-first search over all edges."""
    best = sorted((c for c in clips if c.room == room), key=lambda c: (-c.score, c.start, c.id))[:k]
    near = {}
    for c in best:
        for a in notes:
            if a.room == room and a.quality >= 3:
                o = min(c.end, a.end) - max(c.start, a.start)
                if o > 0 and o / ((c.end - c.start) + (a.end - a.start) - o) >= least:
                    near.setdefault(c.id, []).append(a.id)
    holder = {}

    def free(c, seen):
        for b in near.get(c, ()):
            if b not in seen:
                seen.add(b)
                if b not in holder or free(holder[b], seen):
                    holder[b] = c
                    return True
        return False

    return sum(free(c.id, set()) for c in best)


# ── walks, folders, manifests ──
def plain_urls(value, out, alias):
    if isinstance(value, dict):
        for key, item in value.items():
            if isinstance(item, str) and ".flv" in item:
                own = re.search(r"_(or4|hd|sd|ld|md)\.flv", item, re.I)
                quality = alias.get(key.upper()) or (own and own[1].lower()) or (key.lower() if key.lower() in ("or4", "hd", "sd", "ld", "md") else None)
                if quality:
                    out.setdefault(quality, item.replace("&amp;", "&"))
            else:
                plain_urls(item, out, alias)
    elif isinstance(value, list):
        for item in value:
            plain_urls(item, out, alias)
    return out


def test_payload_urls_at_any_depth(spark):
    rng = random.Random(7)

    def made(depth, n):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice([1, None, "text", f"https://h/{n}/{rng.random()}_{rng.choice(['hd', 'SD', 'x'])}.flv?a=1&amp;b=/2", f"https://h/{rng.random()}.flv"])
        if rng.random() < 0.4:
            return [made(depth - 1, n) for _ in range(rng.randint(0, 3))]
        return {rng.choice(["FULL_HD1", "hd1", "sd", "MD", "b", "a", "z", "other"]) + ("" if rng.random() < 0.5 else str(rng.randint(0, 9))): made(depth - 1, n) for _ in range(rng.randint(0, 4))}

    docs = [(i, json.dumps(made(rng.randint(0, 7), i))) for i in range(150)] + [(200, None), (201, "{broken"), (202, '{"hd":"http:\\/\\/h\\/x.flv?a\\u0026b"}')]
    got = {}
    for r in pages.payload_urls(spark.createDataFrame(docs, "id long, doc string")).collect():
        got.setdefault(r.id, {})[r.quality] = r.url
    expected = {i: u for i, d in docs if d and d != "{broken" and (u := plain_urls(json.loads(d), {}, pages.QUALITIES))}
    assert got == expected and len(expected) > 20
    assert pages.payload_values(spark.createDataFrame([], "id long, doc string")).count() == 0


def test_cases_of_folders(spark, tmp_path):
    feature = '{"features":{"rms":[1,2]}}'
    files = {
        "deep/a/time_table.json": '{"roomId":"r1","duration":60,"clips":[{"start":1,"end":2}]}', "deep/a/annotations.json": '{"profile":"game","annotations":[{"start":1,"end":2}]}', "deep/a/audio_features.json": feature, "deep/a/ignored.json": "{}",
        "b/time_table.json": "[1]", "b/annotations.json": "[]", "c/time_table.json": "{}", "d/time_table.json": "{}", "d/annotations.json": "[]", "e/annotations.json": "[]", "f/time_table.json": "{}", "f/annotations.json": '[{"start":2,"end":3}]', "f/text_features.json": feature,
    }
    for name, text_ in files.items():
        store.write_document(spark, f"file://{tmp_path}/{name}", text_)
    found = cases.cases(cases.read_files(spark, f"file://{tmp_path}"))
    rows = {r.label: r for r in found.collect()}
    assert {k: r.problem for k, r in rows.items()} == {"a": None, "b": "invalid time table", "c": "no annotations", "d": "no features", "e": "no time table", "f": None}
    a = rows["a"]
    assert (a.room_id, a.profile, a.duration, a.sensitivity, a.missing) == ("r1", "game", 60.0, 2.5, ["text_features.json", "visual_features.json"]) and rows["f"].profile == "default"
    assert sorted(map(tuple, cases.signals(found).collect())) == [("a", "audio", "rms", 0, 1.0), ("a", "audio", "rms", 1, 2.0), ("f", "text", "rms", 0, 1.0), ("f", "text", "rms", 1, 2.0)]
    assert [(r.room, r.id) for r in cases.clips(found).collect()] == [("a", 1)] and cases.annotations(found)[0].count() == 2


def made_rows(spark, names, digest="d"):
    return spark.createDataFrame([(n, "s", "x", "p", {"f": "1"}, digest) for n in names], "artifact string, step string, settings string, params string, sources map<string,string>, digest string")


def test_two_writers_and_a_reader_of_one_manifest(spark, tmp_path):
    root, failed, seen = f"file://{tmp_path}/m", [], []
    done = threading.Event()

    def write(name):
        try:
            kept = store.ManifestStore(spark, root)
            for i in range(4):
                kept.record(made_rows(spark, [f"{name}{i}"]))
        except Exception as e:
            failed.append(e)

    def read():
        try:
            kept = store.ManifestStore(spark, root)
            while not done.is_set():
                seen.append(kept.read().count())
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    reader = threading.Thread(target=read)
    for t in (*threads, reader):
        t.start()
    for t in threads:
        t.join(240)
    done.set()
    reader.join(60)
    kept = store.ManifestStore(spark, root)
    assert not failed and sorted(r.artifact for r in kept.read().collect()) == sorted(f"{n}{i}" for n in "ab" for i in range(4))
    assert kept.version() == 8 and seen == sorted(seen) and kept.read(1).count() == 1
    left = [n for n in kept.files.names(root) if n.startswith("data-")]
    assert len(left) == 8 and not [n for n in kept.files.names(f"{root}/versions") if n.endswith(".tmp")]


def test_invalidated_and_missed_artifacts(spark, tmp_path):
    kept = store.ManifestStore(spark, f"file://{tmp_path}/m")
    assert kept.version() == 0 and kept.read().count() == 0
    rows = made_rows(spark, "abc")
    kept.record(rows)
    kept.invalidate(made_rows(spark, "b"))
    decided = kept.reuse(rows)
    assert {r.artifact: r.reason for r in decided.collect()} == {"a": "cache hit", "b": "metadata missing", "c": "cache hit"}
    missed = store.mark_miss(decided, spark.createDataFrame([("c", "file gone")], "artifact string, reason string"))
    assert {r.artifact: (r.hit, r.reason) for r in missed.collect()} == {"a": (True, "cache hit"), "b": (False, "metadata missing"), "c": (False, "file gone")}
    assert tuple(store.stats(missed, kept.read()).first()) == (1, 2, 2)


def test_a_document_is_whole_at_any_time(spark, tmp_path):
    path, failed = f"file://{tmp_path}/d/doc.json", []
    store.write_document(spark, path, "x" * 10)

    def write():
        for i in range(60):
            store.write_document(spark, path, str(i % 10) * 200_000)

    thread = threading.Thread(target=write)
    thread.start()
    while thread.is_alive():
        text_ = store.read_document(spark, path)
        if len(set(text_)) != 1 or len(text_) not in (10, 200_000):
            failed.append(len(text_))
    assert not failed and store.Files(spark, path).names(f"file://{tmp_path}/d") in (["doc.json"], [".doc.json.crc", "doc.json"])


def test_baseline_of_rooms_and_of_all(spark):
    clips = spark.createDataFrame([(1, 0.0, 10.0), (1, 5.0, 9.0), (2, 0.0, 1.0)], "room long, start double, end double")
    dropped = spark.createDataFrame([(1, "overlap"), (1, None), (2, "overlap")], "room long, reason string")
    signals = spark.createDataFrame([(1, "rms", 9), (1, "rms", 3), (2, "rms", 4)], "room long, signal string, t int")
    out = {(r.level, r.room, r.kind, r.name): (r.n, r.least, r.mean, r.most) for r in report.baseline(clips, dropped, dropped.limit(0), signals, spark.createDataFrame([(1, "pad")], "room long, how string")).collect()}
    assert out["all", None, "clip", None] == (3, 1.0, 5.0, 10.0) and out["name", 1, "dropped", "unknown"][0] == 1 and out["name of all", None, "dropped", "overlap"][0] == 2
    assert out["room", 1, "dropped", None][0] == 2 and out["name of all", None, "signal", "rms"] == (2, 5.0, 7.5, 10.0) and out["all", None, "aligned", None][0] == 1


def test_many_small_rooms_cost_no_frame_each(spark):
    # a data frame for each room took some 2 ms, those of a greedy choice more
    edges = spark.range(120_000).select((F.col("id") / 3).cast("long").alias("room"), (F.col("id") % 3).alias("a_id"), (F.col("id") % 3 + 1).alias("a_rank"), F.lit(7).cast("long").alias("b_id"), F.lit(0.5).alias("iou"))
    begun = time.monotonic()
    got = evaluate.matchings(edges.coalesce(1), (1, 3)).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("a_id").alias("a")).collect()
    assert {(r.k, r.n, r.a) for r in got} == {(1, 40_000, 0), (3, 40_000, 0)} and time.monotonic() - begun < 20


def test_taken_annotations_are_not_given_again(spark):
    clips = spark.createDataFrame([("x", 1, 0.0, 10.0, 9.0), ("x", 2, 1.0, 9.0, 8.0), ("y", 1, 0.0, 10.0, 1.0)], "room string, id long, start double, end double, score double")
    known = spark.createDataFrame([("x", 5, 0.0, 10.0), ("x", 6, 2.0, 9.0), ("y", 5, 0.0, 9.0)], "room string, id long, start double, end double")
    got = {(r.room, r.id, r.existing_id, round(r.iou, 4)) for r in evaluate.best_existing_match(clips, known, 0.5).collect()}
    assert got == {("x", 1, 5, 1.0), ("x", 2, 6, 0.875), ("y", 1, 5, 0.9)}


def test_documents_of_payloads_are_not_broadcast(spark):
    docs = spark.range(5).select("id", F.concat(F.lit('{"HD1":"http://h/'), F.col("id").cast("string"), F.lit('_hd.flv"}')).alias("doc"))
    urls = pages.payload_urls(docs)
    assert "BroadcastHashJoin" not in urls._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.quality, r.url) for r in urls.collect()) == [(i, "hd", f"http://h/{i}_hd.flv") for i in range(5)]
