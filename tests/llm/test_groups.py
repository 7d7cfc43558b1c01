"""Source divergence, centroid clusters and the n-gram join against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepeak.llm import balltree, divergence, overlap

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# ── 11: source divergence ──
def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_audit(rows, least, top):
    groups, having = {}, Counter()
    for text, lang, source in rows:
        terms = TERM.findall(lowered(text))
        groups.setdefault((lang or "", source or ""), Counter()).update(terms)
        having.update({(lang or "", t) for t in terms})
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (at, t), n in having.items() if at == lang and n >= least)
        own = {s: c for (at, s), c in groups.items() if at == lang}
        whole = sum(own.values(), Counter())

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            more = [(f(p[s][t], q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", more, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def audited(spark, rows, least, **more):
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit("x"), "n": F.lit(1), "doc_id": F.lit(7), "p": F.lit(0)})
    return sorted(tuple(r) for r in divergence.audit(df, least, **more).collect())


def test_divergence_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["the", "The", "dog", "Été", "été", "naïve", "a1b", "x-y", "漢字", "zz", "Σ", "σ"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choice(words[: 8 + 6 * (s % 4)]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "b", "b", None, "é"])) for s in range(150)]
    rows += [(None, "en", "silent"), ("", "de", "only"), ("12 34", "de", "digits"), ("w " * 400_000, "fr", "long")] + [("same text here", "en", "b")] * 30
    assert audited(spark, rows, 3) == brute_audit(rows, 3, 10)
    monkeypatch.setattr(divergence, "PIECE", 7)
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    assert audited(spark, rows[:60], 2, terms=3) == brute_audit(rows[:60], 2, 3)


def test_divergence_defined_cases(spark):
    assert audited(spark, [], 1) == []
    rows = [("one two", "en", "a"), ("one", "en", "b"), ("x", "fr", "a")]
    none = audited(spark, rows, 10)
    assert none == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert audited(spark, rows, 1) == brute_audit(rows, 1, 10)


# ── 12: centroid clusters ──
def brute_clusters(rows, k=16, rounds=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v):
            kept.append((i, [int(np.floor(64 * float(c))) for c in v]))
    start = sorted(((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept))[:k]
    centroids = [v for _, _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in found), key=str)


def clustered(spark, rows, kind="double", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"cluster": F.lit("x"), "v": F.lit(1), "distance": F.lit(2)})
    return sorted((tuple(r) for r in balltree.cluster(df.repartition(3), **more).collect()), key=str)


def test_clusters_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 3, (6, 64))
    rows = [(int(i), [float(x) for x in centres[i % 6] + rng.normal(0, 0.05 if i % 3 else 1, 64)]) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)] + [(3, rows[9][1]), (3, rows[10][1])]
    rows += [(2000, None), (2001, [1.0]), (2002, [None] * 64), (2003, [float("nan")] * 64), (2004, [float("inf")] * 64), (None, rows[0][1])]
    expected = brute_clusters(rows)
    assert clustered(spark, rows) == expected
    monkeypatch.setattr(balltree, "BLOCK", 50)
    assert clustered(spark, rows) == expected
    ties = [(i, [float((i >> b) & 1) for b in range(64)]) for i in range(40)]
    assert clustered(spark, ties) == brute_clusters(ties)


def test_whole_balls_are_assigned_by_their_sums():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-3, 4, (200, 64)) + 100 * j for j in range(3)])
    order, tree = balltree.build(balltree.compact(x))
    assert sorted(order.tolist()) == [*range(600)] and all(tree.sum_of(i) == x[order][a:b].sum(0).tolist() for i, (a, b) in enumerate(zip(tree.starts, tree.ends, strict=True)))
    found = list(balltree.walk(tree, [[100 * j] * 64 for j in range(3)]))
    whole = [tree.ends[at] - tree.starts[at] for at, j in found if isinstance(j, int)]
    assert sum(whole) == 600 and len(whole) < 12  # no leaf was read


def test_wide_and_few_vectors(spark):
    assert clustered(spark, []) == []
    rows = [(1, [1e6] * 64), (2, [-3.5] * 64), (3, [1e6 + 1] * 64), (4, [0.25] * 64), (4, [-2.0**20] * 64)]
    for k in (1, 2, 16):
        assert clustered(spark, rows, k=k) == brute_clusters(rows, k)
    same = [(i, [1e30] * 64) for i in range(3)]
    assert clustered(spark, same, "float", k=2) == brute_clusters([(i, [float(np.float32(1e30))] * 64) for i in range(3)], 2)
    with pytest.raises(Exception, match="(?i)too large|overflow|int"):
        clustered(spark, [(1, [1e30] * 64), (2, [-1e30] * 64)], k=1)


# ── 13: n-gram Jaccard join ──
def brute_join(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    low = [*range(len(rows))]

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                low[max(root(a), root(b))] = min(root(a), root(b))
    ids = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            ids[root(x)] = min(i, ids.get(root(x), i))
    return sorted(((i, len(s), ids.get(root(x))) for x, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def joined(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "node": F.lit("x"), "digest": F.lit(0), "words": F.lit(b"")})
    return sorted((tuple(r) for r in overlap.join(df.repartition(3)).collect()), key=str)


def copies(rng):
    words = [f"w{i}" for i in range(300)]
    made = lambda n: [rng.choice(words) for _ in range(n)]
    passage, texts = made(60), []
    for size in (8, 12, 30, 90, 200):  # groups around the limit
        base = made(size)
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 30))):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w + made(rng.choice([0, 0, 1, 2, size // 10]))))
    texts += [" ".join(made(rng.randint(5, 40)) + passage + made(rng.randint(0, 300))) for _ in range(40)]  # one passage in many texts
    texts += [" ".join(passage + made(rng.randint(0, 14))) for _ in range(30)]  # little but the passage
    texts += [" ".join(made(rng.randint(1, 6))) for _ in range(30)] + ["A b", "a  B", "a b c", "x " * 9, "X\n" * 12]
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_join_equals_brute_force(spark, monkeypatch, small):
    rows = [*enumerate(copies(random.Random(8)), 5)]
    rows += [(5, rows[3][1]), (5, "other words than those of the first row"), (None, rows[20][1]), (None, None), (1000, ""), (1001, " \n"), (None, "alone here")]
    if small:
        for name, value in (("LONG", 3), ("CHUNK", 2), ("GROUP", 200), ("PACK", 300), ("BUCKET", 700)):
            monkeypatch.setattr(overlap, name, value)
    assert joined(spark, rows) == brute_join(rows)


def test_no_link_depends_on_the_first_search(spark, monkeypatch):
    rows = [*enumerate(copies(random.Random(9)))]
    none = lambda texts: texts.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    monkeypatch.setattr(overlap, "key_links", none)
    expected = brute_join(rows)
    assert joined(spark, rows) == expected
    monkeypatch.setattr(overlap, "LONG", 3)  # and with lists of common shingles
    monkeypatch.setattr(overlap, "KEPT", 20)
    assert joined(spark, rows) == expected


def test_no_link_depends_on_short_keys_or_broadcasts(spark, monkeypatch):
    rows = [*enumerate(copies(random.Random(10)))]
    none = lambda texts: texts.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    for name, value in (("key_links", none), ("short_of", lambda hashes: hashes >> np.uint64(50)), ("FEW", 0), ("LONG", 6), ("KEPT", 20), ("PLAIN", 5), ("BUCKET", 700)):
        monkeypatch.setattr(overlap, name, value)  # many shingles share a key
    assert joined(spark, rows) == brute_join(rows)


def test_copies_may_outnumber_texts(spark):
    texts = copies(random.Random(13))[:40]
    rows = [(i, texts[i * 7 % 40]) for i in range(200)]
    assert joined(spark, rows) == brute_join(rows)


def test_only_words_that_are_searched_are_shuffled(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    texts = [[rng.choice(words) for _ in range(400)] for _ in range(1500)]
    texts += [t[:380] + [rng.choice(words) for _ in range(20)] for t in texts[:40]]  # similar
    texts += [t[:300] + [rng.choice(words) for _ in range(100)] for t in texts[40:80]]  # half similar
    texts += [texts[80][:120] + [rng.choice(words) for _ in range(20)] for _ in range(40)]  # a family
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).cache()
    assert df.count() == len(texts)
    stored = sum(len(zlib.compress(" ".join(t).encode(), 1)) for t in texts)

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if the texts were too many to be broadcast
    try:
        assert overlap.join(df).select("component_id").distinct().count() < len(texts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (shuffled() - before) / stored < 3
    df.unpersist()


def test_class_counts_bound_what_sets_share():
    rng = random.Random(12)
    near = 0
    for k in range(300):
        pool = [rng.getrandbits(64 if k % 5 else 20) for _ in range(600)]  # and sets whose hashes are all in one class
        made = [np.unique(np.array(rng.sample(pool, rng.choice([1, 2, 3, 17, 200, 500])), np.uint64)) for _ in range(2)]
        a, b = ((x, overlap.class_counts(x)) for x in made)
        most = overlap.most_common(a[1], b[1], len(a[0]), len(b[0]))
        assert len(np.intersect1d(*made)) <= most == overlap.most_common(b[1], a[1], len(b[0]), len(a[0]))
        assert overlap.most_common(a[1], a[1], len(a[0]), len(a[0])) >= len(a[0])
        other = [np.unique(np.array([rng.getrandbits(64) for _ in range(700)], np.uint64)) for _ in range(2)]
        near += overlap.most_common(*map(overlap.class_counts, other), 700, 700) * 180 >= 1400 * 80
    assert not near  # sets with nothing in common are told apart


def test_join_of_empty_tables_and_long_texts(spark):
    assert joined(spark, []) == [] and joined(spark, [(1, None)]) == [(1, 0, 1)]
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(3, long), (2, long + " more"), (1, "x" * 500_000)]
    assert joined(spark, rows) == [(1, 1, 1), (2, 59_997, 2), (3, 59_996, 2)]


def test_divide_skip_equals_counting(monkeypatch):
    rng = random.Random(1)
    for _ in range(400):
        sets = [np.array(sorted(rng.sample(range(30), rng.randint(0, 30))), np.uint64) for _ in range(rng.randint(0, 30))]
        asked = np.array(sorted(rng.sample(range(30), rng.randint(1, 20))), np.uint64)
        index, least = overlap.Index(sets), rng.randint(1, 12)
        at = np.flatnonzero(np.isin(index.shingles, asked))
        count = {i: n for i, s in enumerate(sets) if (n := len(set(s.tolist()) & set(asked.tolist()))) >= least}
        for heap, probes in ((0, 1), (10**6, 10**6)):  # by counting, and by a heap
            monkeypatch.setattr(overlap, "HEAP", heap)
            monkeypatch.setattr(overlap, "PROBES", probes)
            places, found = index.occurrences(at, least)
            assert dict(zip(places.tolist(), found.tolist(), strict=True)) == count


def test_shingles_equal_plain_ones():
    texts = ["a b c d e f", "A  b\tc d", "", " \n", None, "x", "É é\x0b\x0cz w v u", "a b c d e a b c d e", "\u00a0 q\x1cr", "a b c d e", "12345678 123456789 " * 3, "y" * 64 + " " + "y" * 65 + " " + "y" * 300 + " c d", "aaaaaaaa b c d e", "aaaaaaaaa b c d e", "z \0 \0\0 q w e"]
    words = [overlap.words_of(t) for t in texts]
    plain = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
    assert [w.split(b" ") if w else [] for w in words] == plain
    named = {}
    for w, found in zip(plain, overlap.shingle_sets(words), strict=True):
        expected = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
        assert len(found) == len(expected) and found.tolist() == sorted(found.tolist())
        for shingles in expected:
            named.setdefault(shingles, set()).add(len(expected) == 1 and found.tolist()[0])
    ones = {s: v for s, v in named.items() if False not in v}
    assert all(len(v) == 1 for v in ones.values()) and len({min(v) for v in ones.values()}) == len(ones)
    again = overlap.shingle_sets([w for w in words if w][::-1])[::-1]  # whatever stands beside them
    assert [x.tolist() for x in again] == [x.tolist() for x in overlap.shingle_sets(words) if len(x)]


def test_packed_arrays():
    for values in ([], [0], [5, 300, 2**64 - 1], [*range(1000)]):
        x = np.array(values, np.uint64)
        assert overlap.unpacked(overlap.packed(x)).tolist() == values
        assert np.cumsum(overlap.unpacked(overlap.rising(x)), dtype=np.uint64).tolist() == values
