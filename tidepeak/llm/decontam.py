"""Benchmark decontamination: a broadcast hash set of item n-grams against windows of document words.

All of it is DataFrame expressions. Distinct item windows are counted before use: up to
SET_LIMIT of them go into the plan as a hash set that every task holds, so documents are
scanned once and nothing is shuffled. More are joined by their 64-bit hashes alone: up to HASH_LIMIT
of those (8 bytes each) are broadcast, and still more are joined by shuffling hashes of document windows, salted
against common passages. Of rows with a likely hit the numbers (8 bytes each) are broadcast, up to ROW_LIMIT of them, so that
the texts of all other rows stay where they are. What the hashes find is verified by its words.

Defined cases: null text has no words; null items and items without words have no windows; a null
item_id is not listed; repeated rows are treated one by one; empty tables work; texts of any length are
scanned whole; other columns do not take part in a decision, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepeak.llm.common import LOWER, NON_WORD, UPPER, fresh, materialise

WINDOW = 10
#: Distinct item windows (some 100 bytes each) that may travel in the plan.
SET_LIMIT = 50_000
#: Hashes of item windows that may be broadcast, and parts of each hash that are joined by a shuffle beyond that.
HASH_LIMIT, SALTS = 8_000_000, 16
#: Numbers of rows with likely hits that may be broadcast.
ROW_LIMIT = 4_000_000
#: A document with more than this share of its words hit goes as a whole.
DROP_SHARE = 0.5

#: NON_WORD for text whose capitals are still there.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
NO_HITS = "CAST(array() AS array<struct<at:int,len:int>>)"


def words_sql(text: str) -> str:
    return f"array_remove(split(coalesce(translate({text}, '{UPPER}', '{LOWER}'), ''), r'{NON_WORD}'), '')"


def starts_sql(n: int) -> str:
    return f"CASE WHEN size(w) >= {n} THEN sequence(1, size(w) - {n - 1}) ELSE CAST(array() AS array<int>) END"


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, len, gram (words joined by spaces) and h of every distinct window of every item."""
    words = items.selectExpr("item_id", f"{words_sql('text')} AS w").where("size(w) > 0")
    each = words.selectExpr("item_id", f"least(size(w), {window}) AS len", f"explode(transform(sequence(1, size(w) - least(size(w), {window}) + 1), i -> slice(w, i, least(size(w), {window})))) AS g")
    return each.selectExpr("item_id", "len", "array_join(g, ' ') AS gram", "xxhash64(g) AS h").distinct()


def hits_sql(grams: list[tuple[int, str, int]]) -> str:
    """An expression over the words w: places (at from 1, len) of all windows in the set, by place."""
    parts = []
    for n in sorted({g[0] for g in grams}):
        hashes = ",".join(sorted({f"{h}L" for length, _, h in grams if length == n}))
        texts = ",".join(sorted({f"'{t}'" for length, t, _ in grams if length == n}))
        likely = f"filter({starts_sql(n)}, i -> xxhash64(slice(w, i, {n})) IN ({hashes}))"
        parts.append(f"transform(filter({likely}, i -> array_join(slice(w, i, {n}), ' ') IN ({texts})), i -> named_struct('at', i, 'len', {n}))")
    return f"array_sort(concat({', '.join(parts)}))" if len(parts) > 1 else (parts or [NO_HITS])[0]


def covered(hits: str) -> str:
    """SQL for the number of words in any of the places."""
    return f"aggregate({hits}, named_struct('upto', 0, 'n', 0), (s, x) -> named_struct('upto', greatest(s.upto, x.at + x.len), 'n', s.n + greatest(0, x.at + x.len - greatest(s.upto, x.at))), s -> s.n)"


def with_hits(docs: DataFrame, windows: DataFrame, to: str, set_limit: int = SET_LIMIT, hash_limit: int = HASH_LIMIT) -> DataFrame:
    """Adds a struct of n_words, hits (array of at, len) and grams (the distinct windows that occur) to docs(text, ...), in column `to`."""
    known = windows.select("len", "gram", "h").distinct()
    n = known.count()
    if n > set_limit:
        return with_hits_by_hash(docs, materialise(known, "decontam-windows"), to, n <= hash_limit)
    hits = hits_sql([tuple(r) for r in known.collect()])
    found = f"transform(array({words_sql('text')}), w -> named_struct('n_words', size(w), 'hits', {hits}, 'w', w))[0]"
    grams = "array_distinct(transform(f.hits, x -> array_join(slice(f.w, x.at, x.len), ' ')))"
    # exploding one struct keeps the optimizer from copying the expression, with its set, into every use
    return docs.withColumn(to, F.expr(f"explode(transform(array({found}), f -> named_struct('n_words', f.n_words, 'hits', f.hits, 'grams', {grams})))"))


def with_hits_by_hash(docs: DataFrame, known: DataFrame, to: str, broadcast: bool) -> DataFrame:
    """with_hits() for windows (len, gram, h) that are too many for the plan."""
    row, words = fresh(docs, "row", "words")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "decontam-rows")
    lengths = [r[0] for r in known.select("len").distinct().orderBy("len").collect()]  # at most as many as a window has words
    spots = ", ".join(f"transform({starts_sql(n)}, i -> named_struct('at', i, 'len', {n}, 'h', xxhash64(slice(w, i, {n}))))" for n in lengths)
    spot = rows.selectExpr(f"`{row}` AS row", f"explode(transform(array({words_sql('text')}), w -> concat({spots}))[0]) AS s").select("row", "s.*")
    hashes = known.select("len", "h").distinct()
    if broadcast:
        likely = spot.join(F.broadcast(hashes), ["len", "h"])
    else:
        salted = hashes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        likely = spot.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int")).join(salted, ["len", "h", "salt"])
    # a document has fewer places than words and lengths
    places = likely.groupBy("row").agg(F.collect_list(F.struct("at", "len")).alias("places"))
    places = materialise(places, "decontam-places")
    some, others = apart(rows, row, places)
    texts = some.select(F.col(row).alias("row"), F.expr(words_sql("text")).alias("w")).join(places, "row")
    hits = materialise(texts.selectExpr("row", "explode(transform(places, x -> named_struct('at', x.at, 'len', x.len, 'gram', array_join(slice(w, x.at, x.len), ' ')))) AS s").select("row", "s.*"), "decontam-hits")
    # windows that only share a hash with an item's: hardly ever any
    false = hits.select("len", "gram").distinct().join(known.select("len", "gram"), ["len", "gram"], "left_anti")
    hits = hits.join(false, ["len", "gram"], "left_anti") if not false.isEmpty() else hits
    of_row = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "len"))).alias("hits"), F.collect_set("gram").alias("grams"))
    found = of_row.select(F.col("row").alias(words), F.struct("hits", "grams").alias(to))
    out = some.drop(to).join(found, some[row] == found[words], "left")
    if others is not None:
        out = out.unionByName(others.drop(to).withColumns({words: F.lit(None).cast("bigint"), to: F.lit(None).cast(found.schema[to].dataType)}))
    filled = f"named_struct('n_words', size({words_sql('text')}), 'hits', coalesce(`{to}`.hits, {NO_HITS}), 'grams', coalesce(`{to}`.grams, CAST(array() AS array<string>)))"
    return out.withColumn(to, F.expr(filled)).drop(row, words)


def apart(rows: DataFrame, row: str, places: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows with places (of row numbers) and the others, which no shuffle moves; all rows and none if the numbers are too many to be broadcast."""
    numbers = places.select(F.col("row").alias("_row"))
    if numbers.count() > (ROW_LIMIT if limit is None else limit):
        return rows, None
    numbers = F.broadcast(numbers)
    return (rows.join(numbers, rows[row] == numbers["_row"], how) for how in ("left_semi", "left_anti"))


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, set_limit: int = SET_LIMIT, hash_limit: int = HASH_LIMIT) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document."""
    windows = item_windows(items, window)
    found = with_hits(docs.select("doc_id", "text"), windows, "found", set_limit, hash_limit)
    rows = found.selectExpr("doc_id", "monotonically_increasing_id() AS row", "found.n_words", f"{covered('found.hits')} AS n_hit", "found.grams")
    rows = materialise(rows, "decontam-hits")
    listed = windows.where("item_id IS NOT NULL").select("gram", F.col("item_id").cast("string").alias("item"))
    named = rows.where("size(grams) > 0").select("row", F.explode("grams").alias("gram")).join(listed, "gram")
    items_of = named.groupBy("row").agg(F.collect_set("item").alias("items"))
    ids = F.array_sort(F.coalesce("items", F.array().cast("array<string>")))
    return rows.join(items_of, "row", "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, drop_share: float = DROP_SHARE, set_limit: int = SET_LIMIT) -> DataFrame:
    """docs without the spans of words that item windows hit; a document hit over drop_share goes as a whole.

    A removed span takes what follows each of its words up to the next word; the rest of the text,
    and every document without a hit, stays as it is.
    """
    hit, = fresh(docs, "hit")
    spans = (
        f"aggregate(`{hit}`.hits, CAST(array() AS array<struct<at:int,upto:int>>), (s, x) -> CASE WHEN size(s) > 0 AND element_at(s, -1).upto >= x.at"
        " THEN concat(slice(s, 1, size(s) - 1), array(named_struct('at', element_at(s, -1).at, 'upto', greatest(element_at(s, -1).upto, x.at + x.len))))"
        " ELSE concat(s, array(named_struct('at', x.at, 'upto', x.at + x.len))) END)"
    )
    word = GAP.replace("[", "[^", 1)
    pieces = f"regexp_extract_all(text, r'{word}+{GAP}*', 0)"
    kept = f"transform(array({spans}), c -> filter({pieces}, (p, i) -> NOT exists(c, x -> i + 1 >= x.at AND i + 1 < x.upto)))[0]"
    text = f"CASE WHEN size(`{hit}`.hits) = 0 THEN text ELSE concat(regexp_extract(text, r'^{GAP}*', 0), array_join({kept}, '')) END"
    found = with_hits(docs, item_windows(items, window), hit, set_limit)
    left = found.where(f"size(`{hit}`.hits) = 0 OR {covered(f'`{hit}`.hits')} <= {drop_share} * `{hit}`.n_words")
    return left.withColumn("text", F.expr(text)).select(*[F.col(f"`{c}`") for c in docs.columns])
