"""Language ID: a byte convolutional network, trained in numpy and applied to whole texts.

Embedded bytes pass filters of several widths, each filter is max-pooled over a window of fixed
length, and a softmax layer gives the languages. A text is cut into such windows from start to
end; its score is the mean probability over the windows, weighted by their bytes. Training takes
some SAMPLE labelled documents in all, at most twice as many (a documented bound; one of each language if
those are more), dealt out evenly to the languages, with WINDOWS random windows of each. Every value of lang
is learned.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is every text if
nothing was learned (no labelled rows); null labels are not learned from; repeated rows are
treated alike; an empty table gives no rows; texts of any length are read whole. Other columns are kept
and do not take part in a prediction; one that has the name of a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepeak.llm.common import bound_batches, fresh, remainder

UNKNOWN = "und"
#: Bytes of a window, labelled documents learned from, and windows of each.
LENGTH, SAMPLE, WINDOWS = 192, 6000, 3
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 16, 8
EPOCHS, BATCH, RATE = 4, 64, 0.01
PAD = 256


@dataclass
class ByteCnn:
    """Weights; classes holds the languages, in order of the softmax outputs."""

    classes: list[str]
    embed: np.ndarray = field(default=None)
    filters: list[np.ndarray] = field(default_factory=list)
    bias: np.ndarray = field(default=None)
    out: np.ndarray = field(default=None)
    out_bias: np.ndarray = field(default=None)

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.out_bias]

    @classmethod
    def fresh(cls, classes: list[str], rng: np.random.Generator) -> ByteCnn:
        f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        pooled = FILTERS * len(WIDTHS)
        return cls(
            classes,
            f32(PAD + 1, EMBEDDING, scale=0.3) * (np.arange(PAD + 1) < PAD)[:, None].astype(np.float32),
            [f32(w, EMBEDDING, FILTERS, scale=(w * EMBEDDING) ** -0.5) for w in WIDTHS],
            np.zeros(pooled, np.float32),
            f32(pooled, len(classes), scale=pooled**-0.5),
            np.zeros(len(classes), np.float32),
        )

    def pool(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter in each window (n by LENGTH bytes), and where it is."""
        best, where = [], []
        for filters in self.filters:
            # a byte's share of a response is looked up: embedding times filter row, for all 257 symbols
            shares = self.embed @ filters
            steps = windows.shape[1] - len(filters) + 1
            response = shares[0][windows[:, :steps]]
            for k in range(1, len(filters)):
                response += shares[k][windows[:, k : k + steps]]
            at = response.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(response, at[:, None, :], 1)[:, 0])
        return np.concatenate(best, 1), np.concatenate(where, 1)

    def predict(self, windows: np.ndarray) -> np.ndarray:
        logits = np.maximum(self.pool(windows)[0] + self.bias, 0) @ self.out + self.out_bias
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy, in the order of params()."""
        n = len(windows)
        best, where = self.pool(windows)
        hidden = np.maximum(best + self.bias, 0)
        logits = hidden @ self.out + self.out_bias
        e = np.exp(logits - logits.max(1, keepdims=True))
        delta = e / e.sum(1, keepdims=True)
        delta[np.arange(n), labels] -= 1
        delta /= n
        back = (delta @ self.out.T) * (hidden > 0)
        grad_embed, grad_filters = np.zeros_like(self.embed), []
        for g, filters in enumerate(self.filters):
            cols = slice(g * FILTERS, (g + 1) * FILTERS)
            at, b = where[:, cols], back[:, cols]
            grad = np.zeros_like(filters)
            for k in range(len(filters)):
                symbols = windows[np.arange(n)[:, None], at + k]
                grad[k] = np.einsum("nfe,nf->ef", self.embed[symbols], b)
                np.add.at(grad_embed, symbols.ravel(), (b[:, :, None] * filters[k].T[None]).reshape(-1, EMBEDDING))
            grad_filters.append(grad)
        grad_embed[PAD] = 0
        return [grad_embed, *grad_filters, back.sum(0), hidden.T @ delta, delta.sum(0)]


def windows_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive windows of a whole text, the last one padded, and the bytes in each."""
    n = max(1, -(-len(text) // LENGTH))
    out = np.full(n * LENGTH, PAD, np.int16)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    size = np.full(n, LENGTH, np.float64)
    size[-1] = max(1, len(text) - (n - 1) * LENGTH)
    return out.reshape(n, LENGTH), size


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> ByteCnn:
    """Fits the network by Adam to texts of at most a window each."""
    rng = np.random.default_rng(seed)
    classes = sorted(set(labels))
    net = ByteCnn.fresh(classes, rng)
    x = np.concatenate([windows_of(t[:LENGTH])[0] for t in texts])
    y = np.searchsorted(classes, labels)
    first, second = ([np.zeros_like(p) for p in net.params()] for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(x)), -(-len(x) // BATCH)):
            step += 1
            for p, g, m, v in zip(net.params(), net.gradients(x[part], y[part]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def learn(docs: DataFrame, sample: int = SAMPLE) -> ByteCnn | None:
    """A network from docs(doc_id, text, lang) with a known language; None if there are none."""
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL AND length(text) > 0").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()}
    if not counts:
        return None
    share = max(1, sample // len(counts))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))
    rate = F.try_element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 20, (share << 20) // n + 1))]), F.col("lang"))
    start = lambda k: F.pmod(F.xxhash64("text", F.lit(k)), F.greatest(F.length("text") - LENGTH // 2, F.lit(1))) + 1
    cuts = F.array(*[F.substring("text", start(k), F.lit(LENGTH)) for k in range(WINDOWS)])
    # about `sample` rows by the rate; the limit only makes that bound strict, by the same order every time
    drawn = known.where(draw < rate).select(draw.alias("draw"), "lang", "doc_id", cuts.alias("cuts"))
    rows = drawn.orderBy("draw", "doc_id", "lang", "cuts").limit(2 * max(sample, len(counts))).collect()
    rows.sort(key=lambda r: (str(r["doc_id"]), r["cuts"]))
    pairs = [(c.encode(), r["lang"]) for r in rows for c in r["cuts"]]
    return train([c for c, _ in pairs], [lang for _, lang in pairs])


def predict_column(text: Column, net: ByteCnn) -> Column:
    @F.arrow_udf("struct<lang:string,score:double>")
    def byte_cnn(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            best, scores, held, ends = [], [], [], []

            def flush() -> None:
                windows, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
                probs = np.concatenate([net.predict(p) for p in np.array_split(windows, 1 + len(windows) // 512)])
                starts = np.concatenate([[0], np.cumsum(ends)[:-1]])
                mean = np.add.reduceat(probs * sizes[:, None], starts) / np.add.reduceat(sizes, starts)[:, None]
                best.extend(mean.argmax(1).tolist())
                scores.extend(mean.max(1).tolist())
                held.clear()
                ends.clear()

            for t in texts.to_pylist():
                held.append(windows_of((t or "").encode()))
                ends.append(len(held[-1][0]))
                if sum(ends) > 4096:
                    flush()
            if held:
                flush()
            langs = pa.array([net.classes[b] for b in best], pa.string())
            yield pa.StructArray.from_arrays([langs, pa.array([min(1.0, max(0.0, s)) for s in scores], pa.float64())], ["lang", "score"])

    return byte_cnn(text)


def identify(docs: DataFrame, net: ByteCnn | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its probability to docs(text, ...), in columns of the given names."""
    bound_batches(docs.sparkSession)
    if net is None:
        return docs.withColumns({lang: F.lit(UNKNOWN), score: F.lit(0.0)})
    guess, = fresh(docs, "guess")
    lettered = F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False))
    out = docs.withColumn(guess, F.struct(lettered.alias("lettered"), predict_column(docs["text"], net).alias("best")))
    of = lambda c: F.col(f"{guess}.{c}")
    return out.withColumns({lang: F.when(of("lettered"), of("best.lang")).otherwise(UNKNOWN), score: F.when(of("lettered"), of("best.score")).otherwise(0.0)}).drop(guess)


def held_out_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score: learned only from rows whose id digest is not 1 modulo 3."""
    docs = docs.select("doc_id", "text", "lang")
    rest = remainder(F.col("doc_id"), 3)
    net = learn(docs.where(rest != 1))
    return identify(docs.select("doc_id", "text", F.coalesce(rest == 1, F.lit(False)).alias("held_out")), net).drop("text")
