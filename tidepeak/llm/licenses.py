"""License scans by a positional rare-token index.

Templates are word sequences: passages of licences. The index holds the words of the templates' key
phrases with their positions, by rarity in the corpus (inverse document frequency, counted over all
documents). In a file, each place of such a word gives places where its templates may start, and these are
intersected, rarest words first; what is left has the key phrases in full, each where it belongs, and the
template's other words are compared there. Base phrases must stand in full; a longer template must agree in
MATCH of its words, by weight of rarity.

Defined cases: null text counts as empty text; matches may overlap; repeated rows are treated alike;
whole texts of any length are searched; an empty table gives no rows. Other columns are kept and do not take
part; those named like a result (n_words, matches) are replaced by it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepeak.llm.common import bound_batches, fresh
from tidepeak.llm.license_texts import PASSAGES

#: Weighted share of a longer template's words that must be in place.
MATCH = 0.8
#: Base phrases and their labels (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Bytes to words: capitals to small letters, what is no letter or digit to spaces, bytes from 128 as they are.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    base: bool

    @property
    def key_places(self) -> list[int]:
        """Places of the words of all key phrases."""
        starts = (next(i for i in range(len(self.words)) if self.words[i : i + len(k)] == k) for k in self.keys)
        return sorted({at for k, start in zip(self.keys, starts, strict=True) for at in range(start, start + len(k))})


def templates() -> list[Template]:
    cut = lambda s: tuple(words_of(s))
    return [Template(label, cut(p), (cut(p),), True) for p, label in BASE.items()] + [Template(label, cut(p), tuple(map(cut, keys)), False) for label, p, keys in PASSAGES]


class PositionalIndex:
    """Postings of the words of key phrases, rarest first, and of each template its anchor: the rarest word of its key phrases."""

    def __init__(self, known: list[Template], idf: dict[bytes, float]) -> None:
        self.templates = known
        self.weights = [[idf[w] for w in t.words] for t in known]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.anchors: dict[bytes, list[int]] = defaultdict(list)
        placed = sorted((-idf[t.words[at]], t.words[at], n, at) for n, t in enumerate(known) for at in t.key_places)
        anchored: set[int] = set()
        for _, w, n, at in placed:
            self.postings[w].append((n, at))
            # every match has the key phrases, so their rarest word is enough of an anchor
            if n not in anchored:
                anchored.add(n)
                self.anchors[w].append(n)

    def starts(self, words: list[bytes]) -> dict[int, set[int]]:
        """Of each template, the places where it may start: those at which all words of its key phrases stand."""
        present = {*words}
        starts: dict[int, set[int] | None] = {n: None for w in self.anchors.keys() & present for n in self.anchors[w]}
        if not starts:
            return {}
        places: dict[bytes, list[int]] = {w: [] for w in self.postings.keys() & present}
        for p, w in enumerate(words):
            if w in places:
                places[w].append(p)
        # postings are in order of rarity, so the rarest words of the file are intersected first
        for w, postings in self.postings.items():
            for n, at in postings:
                if n not in starts:
                    continue
                old, here = starts[n], places.get(w, ())
                left = {p - at for p in here} if old is None else old.intersection(p - at for p in here)
                if left:
                    starts[n] = left
                else:
                    del starts[n]
        return starts

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Matches (template, start, weighted share of words in place), by template and place."""
        found = []
        for n, starts in self.starts(words).items():
            t, weights = self.templates[n], self.weights[n]
            for start in starts:
                share = 1.0
                if not t.base:
                    inside = sum(x for i, x in enumerate(weights) if 0 <= start + i < len(words) and words[start + i] == t.words[i])
                    share = inside / sum(weights)
                if share >= MATCH:
                    found.append((n, start, share))
        return sorted(found)


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents of docs(text) each word of the vocabulary stands, and the number of documents."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[b""] += 1
                for w in vocabulary.intersection(words_of(text or "")):
                    seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array([*seen.values()], pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(tally, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"].encode(): r["n"] for r in rows}
    return counts, counts.pop(b"", 0)


def build_index(docs: DataFrame) -> PositionalIndex:
    bound_batches(docs.sparkSession)
    known = templates()
    counts, n = document_frequencies(docs, frozenset(w for t in known for w in t.words))
    return PositionalIndex(known, {w: math.log((1 + n) / (1 + counts.get(w, 0))) + 1 for t in known for w in t.words})


def scan_column(text: Column, index: PositionalIndex) -> Column:
    """Struct of n_words and matches (label, base, start, n words, share)."""
    kind = pa.struct([("n_words", pa.int64()), ("matches", pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("n", pa.int64()), ("share", pa.float64())])))])

    @F.arrow_udf("struct<n_words:bigint,matches:array<struct<label:string,base:boolean,start:bigint,n:bigint,share:double>>>")
    def license_scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = index.templates
        for texts in batches:
            out = []
            for text in texts.to_pylist():
                words = words_of(text or "")
                matches = [{"label": known[n].label, "base": known[n].base, "start": s, "n": len(known[n].words), "share": x} for n, s, x in index.scan(words)]
                out.append({"n_words": len(words), "matches": matches})
            yield pa.array(out, kind)

    return license_scan(text)


def scan(docs: DataFrame, index: PositionalIndex | None = None) -> DataFrame:
    """Adds n_words and matches of every whole text to docs(text, ...)."""
    bound_batches(docs.sparkSession)
    found = scan_column(docs["text"], index or build_index(docs))
    scanned, = fresh(docs, "scan")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_words", "matches")]
    return docs.withColumn(scanned, found).select(*kept, f"{scanned}.n_words", f"{scanned}.matches")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    out = scan(docs.select("doc_id", "text")).withColumn("base", F.expr("filter(matches, m -> m.base)"))
    joined = lambda c: f"array_join(array_sort(array_distinct(transform({c}, m -> m.label))), ',')"
    return out.selectExpr(
        "doc_id",
        "n_words",
        "CAST(size(base) AS bigint) AS n_base",
        "array_min(transform(base, m -> m.start)) AS first_word",
        "array_max(transform(base, m -> m.start)) AS last_word",
        f"{joined('base')} AS base_labels",
        f"{joined('matches')} AS labels",
        "coalesce(array_max(transform(matches, m -> m.share)), 0D) AS score",
    )
