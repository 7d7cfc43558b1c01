"""BPE encoding and decoding by a segment tree over adjacent pair ranks.

encode() and decode() add a column (it replaces one of the same name) and keep all others; null text counts as empty text
(no ids), null ids decode to the empty string, repeated rows are encoded alike. Texts of
any length are handled whole: a run of n symbols costs O(n log n).
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepeak.llm.common import bound_batches

#: Entries that a worker's memo may hold before it starts afresh.
MEMO = 150_000
#: The longest chunk that it keeps.
KEPT = 64
LETTER_THEN_SIGN = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~])"


#: The leaf of a pair that no rule merges; in trees of numpy rows it is FREE.
NONE = 1 << 62
FREE = np.int32(2**31 - 1)
#: Words of up to so many bytes are merged in step, grouped by tree width; longer ones each by itself.
WIDTHS = (4, 8, 16, 32)


def pair_tree(leaves: list[int]) -> list[int]:
    """Minimum segment tree as a list: children of node k at 2k and 2k + 1, leaves in the second half.

    Leaf i stands for the pair that starts at symbol i and holds rank * width + i (NONE if
    nothing merges it), so that the root, node 1, is the leftmost pair of the lowest rank.
    """
    width = len(leaves)
    tree = [NONE] * width + leaves
    for node in range(width - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    return tree


def put(tree: list[int], node: int, leaf: int) -> None:
    """Point update: sets a leaf and the minima above it, as far as they change."""
    tree[node] = leaf
    while node > 1:
        other = tree[node ^ 1]
        if other < leaf:
            leaf = other
        node >>= 1
        if tree[node] == leaf:
            return
        tree[node] = leaf


def merge(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Merges adjacent pairs until none has a rank; ranks is keyed by left * 2**20 + right."""
    n, rank_of = len(symbols), ranks.get
    width = 1 << max(0, n - 2).bit_length()
    leaves = [NONE] * width
    for i in range(n - 1):
        rank = rank_of(symbols[i] << 20 | symbols[i + 1])
        if rank is not None:
            leaves[i] = rank * width + i
    tree = pair_tree(leaves)
    symbols, after, before = [*symbols], [*range(1, n + 1)], [*range(-1, n - 1)]
    while (root := tree[1]) != NONE:
        i = root & (width - 1)
        j = after[i]
        symbol = symbols[i] = merged[root // width]
        symbols[j] = -1
        k = after[i] = after[j]
        if j < width and tree[width + j] != NONE:
            put(tree, width + j, NONE)
        rank = None
        if k < n:
            before[k] = i
            rank = rank_of(symbol << 20 | symbols[k])
        put(tree, width + i, NONE if rank is None else rank * width + i)
        if (h := before[i]) >= 0:
            rank = rank_of(symbols[h] << 20 | symbol)
            leaf = NONE if rank is None else rank * width + h
            if tree[width + h] != leaf:
                put(tree, width + h, leaf)
    return [s for s in symbols if s >= 0]


class PairRanks:
    """Ranks of symbol pairs as an open-addressing hash table, looked up for whole arrays."""

    BITS = 20

    def __init__(self, ranks: dict[int, int]) -> None:
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, -1, np.int32)
        keys, values = np.array([*ranks], np.int64), np.array([*ranks.values()], np.int32)
        slots, self.probes = self.slot(keys), 0
        while len(keys):
            self.probes += 1
            first = np.unique(slots, return_index=True)[1]
            first = first[self.keys[slots[first]] < 0]
            self.keys[slots[first]], self.ranks[slots[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & ((1 << self.BITS) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, shift: int) -> np.ndarray:
        """Leaf values rank << shift | at of the pairs; FREE where there is no such pair or a symbol is missing."""
        key = (left.astype(np.int64) << 20) | right
        slot = self.slot(key)
        found = np.full(len(key), -1, np.int32)
        for _ in range(self.probes):
            np.copyto(found, self.ranks[slot], where=self.keys[slot] == key)
            slot = (slot + 1) & ((1 << self.BITS) - 1)
        return np.where((found >= 0) & (left >= 0) & (right >= 0), (found << shift) | at, FREE).astype(np.int32)


def merge_rows(symbols: np.ndarray, ranks: PairRanks, merged: np.ndarray) -> np.ndarray:
    """merge() of many short words in step: symbols has a word a row, padded with -1, of 2**k + 1 columns.

    Each row has its own segment tree; a step takes every root and updates the leaves of the
    merged pair and of its neighbours. Merged-away places become -1 in the result.
    """
    n, width = symbols.shape[0], symbols.shape[1] - 1
    shift, size = width.bit_length() - 1, 2 * width
    sym = np.concatenate([symbols, np.full((n, 1), -1, np.int32)], 1)  # the last column is beyond the end
    cols = width + 2
    after = np.tile(np.minimum(np.arange(1, cols + 1), cols - 1), (n, 1))
    before = np.tile(np.arange(-1, cols - 1), (n, 1))
    tree = np.full((n, size), FREE, np.int32)
    at = np.tile(np.arange(width, dtype=np.int32), n)
    tree[:, width:] = ranks.leaves(sym[:, :width].ravel(), sym[:, 1 : width + 1].ravel(), at, shift).reshape(n, width)
    for node in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
    tree, sym, after, before = tree.ravel(), sym.ravel(), after.ravel(), before.ravel()
    rows = np.arange(n)
    while len(rows := rows[tree[rows * size + 1] != FREE]):
        root, place, base = tree[rows * size + 1], rows * cols, rows * size
        i = (root & (width - 1)).astype(np.int64)
        j = after[place + i]
        k, h, symbol = after[place + j], before[place + i], merged[root >> shift]
        sym[place + i], sym[place + j], after[place + i], before[place + k] = symbol, -1, k, i
        h_or_i, j_or_i = np.where(h >= 0, h, i), np.where(j < width, j, i)
        right = ranks.leaves(symbol, sym[place + k], i, shift)
        tree[base + width + j_or_i] = FREE
        tree[base + width + i] = right
        left = ranks.leaves(sym[place + h_or_i], symbol, h_or_i, shift)
        tree[base + width + h_or_i] = np.where(h >= 0, left, right)
        nodes = np.stack([width + i, width + j_or_i, width + h_or_i])
        for _ in range(shift):
            nodes >>= 1
            down = base + 2 * nodes
            tree[base + nodes] = np.minimum(tree[down], tree[down + 1])
    return sym.reshape(n, cols)[:, : width + 1]


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A tokenizer file of the kind: NFC, lower case, split, bytes, merges with a word end."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.ranks = {self.vocab[a] << 20 | self.vocab[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.merged = [self.vocab[a + b] for a, b in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for token, i in (*self.vocab.items(), *self.special.items()):
            self.tokens[i] = token
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        # \s of the file is the Unicode property, without the information separators
        self.split = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in letters], np.int32)
        self.final = np.array([self.vocab[c + self.end] for c in letters], np.int32)
        self.pairs, self.merged_row = PairRanks(self.ranks), np.array(self.merged, np.int32)
        self.token_array = pa.array(self.tokens, pa.string())
        self.words = {t: array("i", [i]).tobytes() for t, i in self.special.items()}
        self.chunks: dict[str, bytes] = {}

    def learn_words(self, words: list[str]) -> None:
        """Merges words that the memo lacks."""
        spelt = [w.encode() for w in words]
        sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
        low = 0
        for width in WIDTHS:
            group = np.flatnonzero((sizes > low) & (sizes <= width + 1))
            low = width + 1
            if not len(group):
                continue
            inside = np.arange(width + 1) < sizes[group, None]
            rows = np.full(inside.shape, -1, np.int32)
            letters = np.frombuffer(b"".join([spelt[g] for g in group]), np.uint8)
            rows[inside] = self.inner[letters]
            rows[np.arange(len(group)), sizes[group] - 1] = self.final[letters[np.cumsum(sizes[group]) - 1]]
            rows = merge_rows(rows, self.pairs, self.merged_row)
            kept = rows >= 0
            ends, ids = np.cumsum(kept.sum(1)).tolist(), rows[kept].astype("<i4").tobytes()
            start = 0
            for g, end in zip(group.tolist(), ends, strict=True):
                self.words[words[g]] = ids[4 * start : 4 * end]
                start = end
        for g in np.flatnonzero(sizes > low).tolist():
            symbols = [*self.inner[np.frombuffer(spelt[g][:-1], np.uint8)].tolist(), int(self.final[spelt[g][-1]])]
            self.words[words[g]] = array("i", merge(symbols, self.ranks, self.merged)).tobytes()

    def pieces(self, chunk: str) -> list[str]:
        """Words of a chunk without spaces, and the special strings in it."""
        out = []
        for part in self.marks.split(chunk):
            if part in self.special:
                out.append(part)
            elif part:
                out += self.split.findall(self.lower(part))
        return out

    @staticmethod
    def lower(text: str) -> str:
        # one character at a time, as the library does: a final sigma is lower-cased like any other
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def learn_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that the memo lacks."""
        joined = " ".join(chunks)
        if self.marks.search(joined):
            split = [*map(self.pieces, chunks)]
        else:
            split = [[c] if c.isalpha() else self.split.findall(c) for c in self.lower(joined).split(" ")]
        if len(self.words) >= MEMO:
            self.words.clear()
            self.words |= {t: array("i", [i]).tobytes() for t, i in self.special.items()}
        if new := [*{w for words in split for w in words}.difference(self.words)]:
            self.learn_words(new)
        word = self.words.__getitem__
        return [word(words[0]) if len(words) == 1 else b"".join(map(word, words)) for words in split]

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """Chunks of each text, cut at spaces and line ends, and between a letter and a sign, where words always end.

        No word, special string or composed character spans a space; texts with a special string are cut at white space only.
        """
        plain = pc.replace_substring(texts, "\n", " ")
        out = pc.replace_substring_regex(plain, LETTER_THEN_SIGN, r"\1 \2")
        for s in self.special:
            whole = pc.match_substring(texts, s)
            if whole.true_count:
                out = pc.replace_with_mask(out, whole, plain.filter(whole))
        return pc.split_pattern(out, " ")

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of whole texts (strings, none null). Distinct chunks of a batch are numbered by Arrow; the memo has those met before."""
        chunks = self.cut(texts)
        numbered = chunks.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.chunks) >= MEMO:
            self.chunks.clear()
        found = [*map(self.chunks.get, distinct)]
        if new := [i for i, ids in enumerate(found) if ids is None]:
            learnt = self.learn_chunks([distinct[i] for i in new])
            for i, ids in zip(new, learnt, strict=True):
                found[i] = ids
                if len(distinct[i]) <= KEPT:
                    self.chunks[distinct[i]] = ids
        ids = pa.array(found, pa.large_binary()).take(numbered.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] // 4
        values = np.frombuffer(ids.buffers()[2] or b"", "<i4")[ends[0] : ends[-1]] if len(ids) else np.empty(0, np.int32)
        lists = chunks.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array(ends[lists - lists[0]] - ends[0], pa.int32()), pa.array(values, pa.int32()))

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """decode() of whole batches; null lists give empty texts."""
        values = lists.flatten()
        known = pc.and_(pc.greater_equal(values, 0), pc.less(values, len(self.tokens)))
        if values.null_count or not pc.all(known).as_py():
            return pa.array([self.decode([i for i in x or [] if i is not None]) for x in lists.to_pylist()], pa.string())
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
        words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.token_array.take(values))
        return pc.binary_join(words, " ")

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens joined by spaces, special ones too. Ids beyond the vocabulary are skipped."""
        tokens, n = self.tokens, len(self.tokens)
        return " ".join(tokens[i] for i in ids if 0 <= i < n)


_LOADED: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """One tokenizer a file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_column(text: Column, path: str) -> Column:
    @F.arrow_udf("array<int>")
    def bpe_encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = tokenizer(path)
        for texts in batches:
            yield t.encode(pc.fill_null(texts, ""))

    return bpe_encode(text)


def decode_column(ids: Column, path: str) -> Column:
    @F.arrow_udf("string")
    def bpe_decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = tokenizer(path)
        for lists in batches:
            yield t.decode_lists(lists)

    return bpe_decode(ids)


def codec_column(text: Column, path: str) -> Column:
    """Struct of the ids of a text and of the text that they stand for: both ways in one worker."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def bpe_codec(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = tokenizer(path)
        for texts in batches:
            ids = t.encode(pc.fill_null(texts, ""))
            yield pa.StructArray.from_arrays([ids, t.decode_lists(ids)], ["ids", "decoded"])

    return bpe_codec(text)


def encode(docs: DataFrame, path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """Adds the ids of every whole text."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(to, encode_column(docs[text], path))


def decode(docs: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(to, decode_column(docs[ids], path))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of ids and decoded text for every document."""
    bound_batches(docs.sparkSession)
    out = docs.select("doc_id", codec_column(docs["text"], path).alias("c")).select("doc_id", "c.ids", "c.decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
