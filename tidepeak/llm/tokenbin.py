"""Token ids as ORC: stripes with run-length encoded integers, row indexes and Bloom filters on ids of documents.

Documents are dealt by ranges of doc_id before they are encoded, so that a file holds a range
in ascending order and the files together hold all of them in order. Each row carries its ids, and
where they start among the ids of its file; readers of single stripes or files need no other.

Defined cases: null text counts as empty text (one id, the end); null doc_ids come first; rows
with equal doc_ids stand side by side, by text; an empty table gives files without rows; other
columns are not written.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepeak.llm.bpe import LETTER_THEN_SIGN
from tidepeak.llm.common import bound_batches, scratch_path

END = 2
SCHEMA = "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, ids array<int>"
#: Pieces that a worker's memo holds before it starts afresh, and the longest one that it keeps.
MEMO, KEPT = 600_000, 64
#: Rows and bytes that are encoded together.
TOGETHER_ROWS, TOGETHER_BYTES = 4096, 8 << 20
#: Characters that may mark where a text is cut: the first that a batch of texts lacks is taken.
MARKS = [chr(c) for c in (*range(9), *range(14, 28), *range(0xE000, 0xE010))]
#: White space, or what some library takes for it, beside spaces and line ends.
OTHER_SPACE = r"\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}"
SOLID = rf"[^ \n{OTHER_SPACE}]"
ODD = rf"[{OTHER_SPACE}]|[ \n][ \n]"
#: What the ORC writer is told; Bloom filters and row groups let readers skip stripes by doc_id.
ORC = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "2000", "orc.stripe.size": str(32 << 20)}


class ByteBpe:
    """The library's tokenizer with a memo of pieces, for whole batches of texts.

    The pattern that splits a text before merging always splits before a single space and around a
    single line end with solid characters on both sides, and between a letter and a sign. Texts are
    cut at such places, so the ids of a text are those of its pieces in a row. A batch is cut and its
    distinct pieces are numbered by Arrow; the library encodes each new piece once.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(1 + max(vocab.values()), np.int64)  # a letter of the vocabulary stands for a byte
        self.sizes[[*vocab.values()]] = [*map(len, vocab)]

    def learn(self, pieces: pa.Array) -> list[bytes]:
        """Ids of distinct pieces: after a space, or without white space, many at once; all others one by one.

        Pieces in one text are kept apart by their spaces or by line ends; the bytes of their tokens tell where each ends.
        """
        sizes = pc.binary_length(pieces).to_numpy()
        alone = (sizes > KEPT) | (sizes == 0)
        for s in self.special:
            alone |= pc.match_substring(pieces, s).to_numpy(zero_copy_only=False)
        spaced = pc.match_substring_regex(pieces, f"^ ({SOLID}.*)?{SOLID}$").to_numpy(zero_copy_only=False) & ~alone
        bare = pc.match_substring_regex(pieces, f"^({SOLID}.*)?{SOLID}$").to_numpy(zero_copy_only=False) & ~alone & ~spaced
        words = pieces.to_numpy(zero_copy_only=False)
        out = np.empty(len(words), object)
        for between, mask in (("", spaced), ("\n", bare)):
            places = np.flatnonzero(mask)
            for at in range(0, len(places), 4096):
                here = places[at : at + 4096]
                ids = np.array(self.tokenizer.encode_batch_fast([between.join(words[here])], add_special_tokens=False)[0].ids, "<i4")
                upto = np.concatenate([[0], np.cumsum(self.sizes[ids])])
                first = np.cumsum(sizes[here] + len(between)) - sizes[here] - len(between)
                raw, bounds = ids.tobytes(), [(4 * np.searchsorted(upto, x)).tolist() for x in (first, first + sizes[here])]
                out[here] = [raw[a:b] for a, b in zip(*bounds, strict=True)]
        places = np.flatnonzero(~spaced & ~bare)
        for at in range(0, len(places), 4096):
            here = places[at : at + 4096]
            for i, e in zip(here.tolist(), self.tokenizer.encode_batch_fast(words[here].tolist(), add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<i4").tobytes()
        return out.tolist()

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """Pieces of each text; of one with a special string, or if no mark is free, the text itself."""
        mark = next((m for m in MARKS if not pc.any(pc.match_substring(texts, m)).as_py()), None)
        if mark is None:
            return pa.ListArray.from_arrays(pa.array(range(len(texts) + 1), pa.int32()), texts)
        out = pc.replace_substring(pc.replace_substring(texts, " ", mark + " "), "\n", mark + "\n" + mark)
        odd = pc.match_substring_regex(texts, ODD)
        if odd.true_count:
            some = pc.replace_substring_regex(texts.filter(odd), rf"({SOLID}) ({SOLID})", rf"\1{mark} \2")
            out = pc.replace_with_mask(out, odd, pc.replace_substring_regex(some, rf"({SOLID})\n({SOLID})", f"\\1{mark}\n{mark}\\2"))
        out = pc.replace_substring_regex(out, LETTER_THEN_SIGN, rf"\1{mark}\2")
        for s in self.special:
            whole = pc.match_substring(texts, s)
            if whole.true_count:
                out = pc.replace_with_mask(out, whole, texts.filter(whole))
        return pc.split_pattern(out, mark)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (strings, none null) in a row, and the number of ids of each."""
        pieces = self.cut(texts)
        numbered = pieces.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) >= MEMO:
            self.known.clear()
        ids_of = [*map(self.known.get, distinct)]
        if fresh := [i for i, x in enumerate(ids_of) if x is None]:
            for i, ids in zip(fresh, self.learn(numbered.dictionary.take(pa.array(fresh, pa.int64()))), strict=True):
                ids_of[i] = ids
                if len(distinct[i]) <= KEPT:
                    self.known[distinct[i]] = ids
        found = pa.array(ids_of, pa.large_binary()).take(numbered.indices)
        ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1] // 4
        ids = np.frombuffer(found.buffers()[2] or b"", "<i4")[ends[0] : ends[-1]] if len(found) else np.empty(0, np.int32)
        lists = np.asarray(pieces.offsets.to_numpy()) - pieces.offsets[0].as_py()
        return ids, np.diff(ends[lists])


_LOADED: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches: distinct pieces are then fewer."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and (sum(b.num_rows for b in held) + batch.num_rows > TOGETHER_ROWS or sum(b.nbytes for b in held) + batch.nbytes > TOGETHER_BYTES):
            yield pa.concat_batches(held)
            held = []
        if batch.num_rows:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def write(docs: DataFrame, path: str, to: str, partitions: int | None = None, end: int = END) -> None:
    """Encodes every whole text of docs(doc_id, text) and writes the ids to the folder `to`."""
    spark = docs.sparkSession
    bound_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, start = tokenizer(path), TaskContext.get().partitionId(), 0
        for rows in together(batches):
            texts = pc.fill_null(rows.column(1), "")
            ids, sizes = t.encode(texts)
            with_end = np.full(len(ids) + len(sizes), end, np.int32)
            with_end[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
            sizes = sizes + 1
            ends = np.concatenate([[0], np.cumsum(sizes)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(with_end))
            columns = [rows.column(0), pa.array(np.full(len(sizes), part, np.int32)), pa.array(start + ends[:-1]), pa.array(sizes), lists]
            start += int(ends[-1])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "start_in_part", "n_tokens", "ids"])

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(encode, SCHEMA).write.options(**ORC).orc(to)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, read stripe by stripe.

    Only the ids per file are added up across files: one short row a file.
    """
    rows = spark.read.schema(SCHEMA).orc(folder)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # one short row a file, so every reader may hold them; beyond a million files they are joined like any table
    return rows.join(F.broadcast(bases) if totals.count() <= 1_000_000 else bases, "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), F.size("ids").cast("long").alias("n_tokens"), "ids")


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, n_tokens and ids of a few documents: the ORC reader leaves out files, stripes and row groups by their statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(folder).where(F.col("doc_id").isin(*doc_ids)).select("doc_id", "n_tokens", "ids")


def crc_column(ids: Column) -> Column:
    @F.arrow_udf("bigint")
    def ids_crc32(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            ends = lists.offsets.to_numpy().tolist()
            yield pa.array([zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)], pa.int64())

    return ids_crc32(ids)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Writes the ids, reads the files back, and gives doc_id, start, n_tokens and ids_crc32 of every document."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-ids")
    write(docs, path, folder)
    back = read(spark, folder)
    return back.select("doc_id", "start", "n_tokens", crc_column(F.col("ids")).alias("ids_crc32"))
