"""Queries of this subpackage: (spark, sf_dir) to the whole result, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepeak.llm import balltree, bitslice, bpe, counts, decontam, divergence, langid, licenses, overlap, pseudonyms, quality, simhash, tokenbin


def tokenizer_file(name: str) -> str:
    """Where a tokenizer file is, on the driver and on every executor: in the folder $TIDEPEAK_TOKENIZERS if set, else with the package of public tokenizers."""
    if folder := os.environ.get("TIDEPEAK_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: The key of the pseudonyms; a deployment sets its own.
PSEUDONYM_KEY = os.environ.get("TIDEPEAK_PSEUDONYM_KEY", "example-key")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and what they decode to; null is empty; see bpe."""
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see simhash."""
    return simhash.assign(table(spark, sf_dir, "documents"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal data replaced, and whether it differs; null stays null; see pseudonyms."""
    return pseudonyms.report(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from documents that are not held out; see langid."""
    return langid.held_out_report(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and labels of licences in every text; null is empty; see licenses."""
    return licenses.report(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text, learned from labels that are not held out; see quality."""
    return quality.held_out_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that are in a benchmark item's windows; null has none; see decontam."""
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document's ids are in the files that were written and read back; see tokenbin."""
    return tokenbin.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, from a cache that starts empty; null is empty; see counts."""
    return counts.count(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best other vectors of every fiftieth id, by exact integer products; see bitslice."""
    return bitslice.search(table(spark, sf_dir, "embeddings"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every two sources of a language, and the terms each source has more of; see divergence."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every vector; see balltree."""
    return balltree.cluster(table(spark, sf_dir, "embeddings"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles have a similarity of 0.8 or more; see overlap."""
    return overlap.join(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {
        "op6_decontamination": DECONTAMINATION_SQL,
        "op10_exact_search": SEARCH_SQL,
        "op11_source_divergence": DIVERGENCE_SQL,
        "op12_centroid_clusters": CLUSTERS_SQL,
        "op13_jaccard_join": JACCARD_SQL,
    }


SEARCH_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), p AS (
  SELECT doc_id, w, i, n FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT n FROM g) WHERE i + n - 1 <= len(w)
), h AS (
  SELECT doc_id, i, p.n, item_id FROM p JOIN g ON p.n = g.n AND array_to_string(w[i : i + p.n - 1], ' ') = g.gram
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), o AS (
  SELECT row, lang, source, term, count(*) AS n FROM (SELECT row, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
), k AS (
  SELECT lang, term, sum(n) AS n FROM o GROUP BY lang, term HAVING count(*) >= 10
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(s.n, 0) AS n
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM o GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term
), p AS (
  SELECT lang, source, term, n,
    1 + 1000000000 * (n + 2)::HUGEINT // ((sum(n) OVER (PARTITION BY lang, source)) + 2 * count(*) OVER (PARTITION BY lang, source))::HUGEINT AS p,
    1 + 1000000000 * (lang_n + 2)::HUGEINT // ((sum(lang_n) OVER (PARTITION BY lang, source)) + 2 * count(*) OVER (PARTITION BY lang, source))::HUGEINT AS q
  FROM c
), pair AS (
  SELECT a.lang, a.source, b.source AS item, (SELECT coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) FROM p x JOIN p y USING (lang, term)
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
), r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q), row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // (p + q) DESC, term) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""


def clusters_sql(rounds: int = 3) -> str:
    """Rounds of exact assignment and floor means, one after the other."""
    nearest = """
  SELECT * FROM (SELECT x.row, x.vec_id, x.v, c.cluster, c.v AS centroid, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM x, c{i} c)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1"""
    parts = ["""x AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda z: floor(64 * z::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM x ORDER BY h, v LIMIT 16)
)"""]
    for i in range(rounds):
        parts.append(f"a{i} AS ({nearest.format(i=i)}\n)")
        parts.append(f"""m{i} AS (
  SELECT cluster, list(z ORDER BY place) AS v FROM (
    SELECT cluster, place, floor(sum(v[place])::HUGEINT::DOUBLE / count(*))::BIGINT AS z FROM a{i}, range(1, 65) t(place) GROUP BY cluster, place) GROUP BY cluster
), c{i + 1} AS (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (cluster)
)""")
    parts.append(f"z AS ({nearest.format(i=rounds)}\n)")
    return "WITH " + ", ".join(parts) + """
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(centroid, ',')) AS centroid_sha256 FROM z
"""


CLUSTERS_SQL = clusters_sql()


JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT row, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS shingle FROM (SELECT row, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT row, count(*) AS n FROM s GROUP BY row
), l AS (
  SELECT a, b FROM (SELECT x.row AS a, y.row AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.row <> y.row GROUP BY ALL) p
  JOIN n na ON na.row = a JOIN n nb ON nb.row = b WHERE 100 * k >= 80 * (na.n + nb.n - k)
), r AS (
  SELECT row AS a, row AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT x.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d x LEFT JOIN n USING (row) JOIN (SELECT r.a, min(y.doc_id) AS component_id FROM r JOIN d y ON r.b = y.row GROUP BY r.a) c ON c.a = x.row
"""
