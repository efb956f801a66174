"""Language identification by a byte convolutional network, trained here in numpy.

A window of ``WINDOW`` bytes is embedded byte by byte; filters of several widths slide over it; the greatest value of each
filter over the window (and 0) goes through one softmax layer. Training takes a bounded sample: at most ``PER_LANGUAGE``
documents of each language, those of least hash, with up to ``WINDOWS_PER_DOC`` windows spread over each text.

Prediction cuts every whole text into windows, the last filled with zeros, runs them in batches of ``BATCH``, and averages
the probabilities over the windows by their bytes. The model has a few thousand numbers and travels with the function.

Defined results: a null text, or one without a letter, is ``und`` with score 0; equal scores go to the language that
sorts first; without training rows everything is ``und``; languages are the non-null values of ``lang`` in the training
rows; repeated rows are predicted each; other columns are never read by ``predict`` and are kept by ``with_language``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
BATCH = 128
PER_LANGUAGE = 600
WINDOWS_PER_DOC = 3
EPOCHS = 6
UNKNOWN = "und"
PREDICTED = "lang_pred string, score double"


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    kernel: np.ndarray  # (max width * EMBEDDING) x filters; narrower filters have zeros at the end
    bias: np.ndarray
    out: np.ndarray  # filters x languages
    out_bias: np.ndarray

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """Filter values at every place: windows x places x filters. Bytes behind a window's end count as zero bytes."""
        n, width = len(windows), max(WIDTHS)
        padded = np.zeros((n, WINDOW + width - 1), np.uint8)
        padded[:, :WINDOW] = windows
        embedded = self.embedding[padded]
        values = self.bias
        for k in range(width):
            kernel = self.kernel[k * EMBEDDING:(k + 1) * EMBEDDING]
            values = values + embedded[:, k:k + WINDOW].reshape(-1, EMBEDDING) @ kernel
        return values.reshape(n, WINDOW, -1)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        return np.maximum(self.responses(windows).max(axis=1), 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return softmax(self.pooled(windows) @ self.out + self.out_bias)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def width_mask() -> np.ndarray:
    """Which kernel entries belong to a filter of each width."""
    longest = max(WIDTHS)
    return np.concatenate([np.repeat((np.arange(longest) < w).astype(np.float32), EMBEDDING)[:, None]
                           .repeat(FILTERS, axis=1) for w in WIDTHS], axis=1)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 0,
          step: float = 0.01, batch: int = 128) -> Network:
    """Adam on the cross entropy, each language weighted alike. Only the place of its greatest value trains a filter."""
    rng = np.random.default_rng(seed)
    mask, longest = width_mask(), max(WIDTHS)
    net = Network(languages, rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
                  (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32), np.zeros(mask.shape[1], np.float32),
                  rng.normal(0, 0.1, (mask.shape[1], len(languages))).astype(np.float32),
                  np.zeros(len(languages), np.float32))
    names = ("embedding", "kernel", "bias", "out", "out_bias")
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in names}
    weight = len(labels) / (len(languages) * np.maximum(np.bincount(labels, minlength=len(languages)), 1))
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for first in range(0, len(order), batch):
            rows = order[first:first + batch]
            x, y = windows[rows], labels[rows]
            values = net.responses(x)
            place = values.argmax(axis=1)
            top = np.take_along_axis(values, place[:, None, :], axis=1)[:, 0]
            hidden = np.maximum(top, 0)
            p = softmax(hidden @ net.out + net.out_bias)
            p[np.arange(len(y)), y] -= 1
            p *= (weight[y] / len(y))[:, None].astype(np.float32)
            grads = {"out": hidden.T @ p, "out_bias": p.sum(axis=0)}
            d = (p @ net.out.T) * (top > 0)
            grads["bias"] = d.sum(axis=0)
            padded = np.zeros((len(y), WINDOW + longest - 1), np.uint8)
            padded[:, :WINDOW] = x
            kernel, embedding = np.zeros_like(net.kernel), np.zeros_like(net.embedding)
            for k in range(longest):
                at = np.take_along_axis(padded, place + k, axis=1)  # the bytes under the filters
                part = slice(k * EMBEDDING, (k + 1) * EMBEDDING)
                kernel[part] = np.einsum("nfe,nf->ef", net.embedding[at], d)
                np.add.at(embedding, at, d[:, :, None] * net.kernel[part].T[None])
            grads |= {"kernel": kernel * mask, "embedding": embedding}
            t += 1
            for k in names:
                m, v = moments[k]
                m += 0.1 * (grads[k] - m)
                v += 0.001 * (grads[k] ** 2 - v)
                setattr(net, k, (getattr(net, k) - step * (m / (1 - 0.9 ** t)) / (
                    np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32))
    return net


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-length windows over texts, one at least for each, and the number of windows of each text."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
    data = b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, counts.tolist(), strict=True))
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW), counts


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The training rows (text, lang): of each language the ``per_language`` rows of least hash of text and doc_id.

    Only hashes are ranked; the texts of the chosen ones come from a second scan, whatever the number of tasks.
    """
    salt = [F.col("`doc_id`").cast("string")] if "doc_id" in docs.columns else []
    rows = docs.select(F.col("`text`").cast("string").alias("text"), F.col("`lang`").cast("string").alias("lang"),
                       F.xxhash64(F.col("`text`").cast("string"), *salt).alias("h")) \
        .filter("text IS NOT NULL AND lang IS NOT NULL AND length(text) > 0")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = rows.select("lang", "h").withColumn("rank", rank).filter(F.col("rank") <= per_language).select("lang", "h")
    return rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi").select("text", "lang")  # per_language a language


def spread(text: bytes, windows: int = WINDOWS_PER_DOC) -> list[bytes]:
    """Up to that many windows, evenly spread over the text."""
    last = max(0, len(text) - WINDOW)
    return [text[at:at + WINDOW] for at in sorted({last * k // max(1, windows - 1) for k in range(windows)})]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = EPOCHS) -> Network | None:
    """A network for the languages of ``docs``; None without a usable row."""
    texts = sample(docs, per_language)
    cut = texts.select("lang", F.encode("text", "UTF-8").alias("text")).mapInArrow(spread_rows, "lang string, text binary")
    rows = sorted((r.lang, bytes(r.text)) for r in cut.collect())  # per_language * WINDOWS_PER_DOC windows a language
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    windows, _ = windows_of([t for _, t in rows])
    return train(windows, np.array([languages.index(lang) for lang, _ in rows]), languages, epochs)


def spread_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(lang, w) for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in spread(text)]
        columns = list(zip(*rows, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary())],
                                         names=["lang", "text"])


def languages_of(net: Network | None, texts: list[bytes]) -> tuple[list[str], list[float]]:
    if net is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    windows, counts = windows_of(texts)
    sizes = np.full(len(windows), float(WINDOW))
    ends = np.cumsum(counts)
    sizes[ends - 1] = [len(t) - (n - 1) * WINDOW for t, n in zip(texts, counts.tolist(), strict=True)]
    found = np.concatenate([net.probabilities(windows[k:k + BATCH]) for k in range(0, len(windows), BATCH)])
    sums = np.add.reduceat(found * np.maximum(sizes, 1)[:, None], ends - counts)
    mean = sums / sums.sum(axis=1, keepdims=True)
    best = mean.argmax(axis=1)
    return [net.languages[b] for b in best], mean[np.arange(len(best)), best].astype(float).tolist()


def with_language(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc`` (the whole row as it is), lang_pred, score."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            sizes, first, held = pc.binary_length(texts).to_pylist(), 0, 0
            for i, size in enumerate(sizes):  # about a megabyte at once
                held += size
                if held > 1_000_000 or i == len(sizes) - 1:
                    part = batch.slice(first, i + 1 - first)
                    names, scores = languages_of(net, part.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(names), pa.array(scores, pa.float64())],
                                                     names=["doc", "lang_pred", "score"])
                    first, held = i + 1, 0

    text = F.col("`text`").cast("string")
    known = F.coalesce(text.rlike("\\p{L}"), F.lit(False))
    rows = docs.select(F.struct("*").alias("doc"), known.alias("known"), F.encode(
        F.when(known, text).otherwise(""), "UTF-8").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    inner = rows.select(F.struct("doc", "known").alias("doc"), "text")
    done = inner.mapInArrow(work, f"doc struct<doc:{kind},known:boolean>, {PREDICTED}")
    return done.select(F.col("doc.doc").alias("doc"),
                       F.when(F.col("doc.known"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
                       F.when(F.col("doc.known"), F.col("score")).otherwise(0.0).alias("score"))


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """Per document row: doc_id, lang_pred, score."""
    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"))
    # the id and the text alone go to Python
    return with_language(rows, net).select("doc.doc_id", "lang_pred", "score")


def keep_known(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` without rows of no language, all columns kept."""
    return with_language(docs, net).filter(F.col("lang_pred") != UNKNOWN).select("doc.*")
