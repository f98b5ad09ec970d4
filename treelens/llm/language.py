"""Language of every text, by a small convolutional network over bytes.

Filters of several widths slide over embedded bytes, each keeps its highest
response in a window, and a softmax over these gives the language. The network
is trained here, in numpy, on a bounded sample of labelled texts; it is then
applied to all windows of all texts, and a text gets the mean of its windows.

Defined results: null texts and texts without a letter are `und` with score 0;
so is everything if no row is labelled. Rows without a language are not learned
from. Repeated rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.llm.arrays import LOWER_TABLE, byte_class, slices, text_buffer

UNKNOWN = "und"
LETTERS = byte_class(bytes(range(65, 91)) + bytes(range(97, 123)))


@dataclass(frozen=True)
class NetShape:
    """Size of the network, its training, and the sample that bounds it."""

    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    embedding: int = 8
    window: int = 256
    texts_per_language: int = 600
    windows_per_text: int = 4
    steps: int = 500
    batch: int = 64
    rate: float = 0.01
    seed: int = 17


@dataclass
class ByteNet:
    """A trained network; an empty `languages` predicts nothing."""

    shape: NetShape
    languages: list[str]
    embed: np.ndarray
    kernels: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the two-byte Latin capitals in lower case."""
    data = np.frombuffer(data.tobytes().translate(LOWER_TABLE), dtype=np.uint8).copy()
    capital = np.append(False, data[:-1] == 0xC3) & (data >= 0x80) & (data <= 0x9E)
    data[capital] += 0x20
    return data


def windows_of(data: np.ndarray, starts: np.ndarray, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, padded with blanks, and the text each one is from.

    Neighbours share `overlap` bytes, so no filter misses a place.
    """
    lengths = np.diff(starts)
    per_text = np.maximum(1, -(-(lengths - overlap) // size))
    text = np.repeat(np.arange(len(lengths)), per_text)
    first = np.cumsum(per_text) - per_text
    begin = starts[:-1][text] + (np.arange(len(text)) - first[text]) * size
    at = begin[:, None] + np.arange(size + overlap)[None, :]
    inside = at < starts[1:][text][:, None]
    padded = data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else np.zeros_like(at, np.uint8)
    return np.where(inside, padded, np.uint8(32)).astype(np.uint8), text


# ---- training, on the driver over a bounded sample ----


def sample_windows(labelled: DataFrame, shape: NetShape) -> list[tuple[str, bytes]]:
    """At most about `texts_per_language` texts of each language, some windows of each."""
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(1_000_000))
    wanted = F.lit(False)
    for lang, n in counts.items():
        share = min(1.0, shape.texts_per_language / n)
        wanted = wanted | ((F.col("lang") == lang) & (place < int(1_000_000 * share) + 1))
    size = shape.window + max(shape.widths) - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, places, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            data, starts = text_buffer(batch.column(2))
            for k, lang in enumerate(langs):
                text = folded(data[starts[k] : starts[k + 1]]).tobytes()
                last = max(len(text) - size, 0)
                n = min(shape.windows_per_text, 1 + last // shape.window)
                for j in range(n):
                    at = last * j // max(n - 1, 1)
                    out.append((lang, places[k], j, text[at : at + size].ljust(size)))
            fields = list(zip(*out, strict=True)) if out else [[], [], [], []]
            types = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(list(x), t) for x, t in zip(fields, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "place", "j", "bytes"])

    rows = (
        labelled.where(wanted)
        .select(F.col("lang").cast("string"), place.cast("long").alias("place"), F.col("text").cast("string"))
        .mapInArrow(cut, "lang string, place long, j long, bytes binary")
        .collect()
    )
    return [(r.lang, bytes(r.bytes)) for r in sorted(rows, key=lambda r: (r.lang, r.place, r.j, bytes(r.bytes)))]


def train(sample: list[tuple[str, bytes]], shape: NetShape) -> ByteNet:
    """Fit the network by Adam on the cross entropy; the gradient follows the maxima."""
    languages = sorted({lang for lang, _ in sample})
    rng = np.random.default_rng(shape.seed)
    k, d, f = len(languages), shape.embedding, shape.filters
    params = {"embed": rng.normal(0, 0.5, (256, d))}
    for w in shape.widths:
        params[f"kernel{w}"] = rng.normal(0, (2 / (w * d)) ** 0.5, (w, d, f))
    params["bias"] = np.zeros((len(shape.widths), f))
    params["out"] = rng.normal(0, 0.1, (len(shape.widths) * f, max(k, 1)))
    params["out_bias"] = np.zeros(max(k, 1))
    if k > 1:
        x = np.frombuffer(b"".join(t for _, t in sample), dtype=np.uint8).reshape(len(sample), -1)
        y = np.searchsorted(languages, [lang for lang, _ in sample])
        weight = len(y) / (k * np.bincount(y, minlength=k))
        moments = {name: (np.zeros_like(p), np.zeros_like(p)) for name, p in params.items()}
        chance = weight[y] / weight[y].sum()
        for step in range(1, shape.steps + 1):
            pick = rng.choice(len(y), shape.batch, p=chance)
            rate = shape.rate * (1 - step / (shape.steps + 1))
            for name, g in gradients(params, x[pick], y[pick], shape).items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                scale = (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                params[name] -= rate * scale * m / (np.sqrt(v) + 1e-8)
    kernels = [params[f"kernel{w}"] for w in shape.widths]
    return ByteNet(shape, languages, params["embed"], kernels, params["bias"], params["out"], params["out_bias"])


def gradients(params: dict, x: np.ndarray, y: np.ndarray, shape: NetShape) -> dict:
    """Gradient of the mean cross entropy of one batch."""
    embed, pooled, tops = params["embed"], [], []
    for i, w in enumerate(shape.widths):
        kernel, n = params[f"kernel{w}"], x.shape[1] - w + 1
        tables = [(embed @ kernel[j]).astype(np.float32) for j in range(w)]
        response = sum(tables[j][x[:, j : j + n]] for j in range(w))
        top = response.argmax(axis=1)
        value = np.take_along_axis(response, top[:, None, :], 1)[:, 0, :] + params["bias"][i]
        tops.append(top)
        pooled.append(value)
    hidden = np.maximum(np.concatenate(pooled, 1), 0)
    logits = hidden @ params["out"] + params["out_bias"]
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    grads = {"out": hidden.T @ p, "out_bias": p.sum(0)}
    back = (p @ params["out"].T) * (hidden > 0)
    grads["embed"], grads["bias"] = np.zeros_like(embed), np.zeros_like(params["bias"])
    f = shape.filters
    for i, w in enumerate(shape.widths):
        kernel = params[f"kernel{w}"]
        own = back[:, i * f : (i + 1) * f]
        grads["bias"][i] = own.sum(0)
        change = np.zeros_like(kernel)
        for j in range(w):
            seen = x[np.arange(len(x))[:, None], tops[i] + j]
            change[j] = np.einsum("bf,bfd->df", own, embed[seen])
            np.add.at(grads["embed"], seen, own[:, :, None] * kernel[j].T[None])
        grads[f"kernel{w}"] = change
    return grads


# ---- prediction, in the tasks over all windows ----


class Predictor:
    """The network with its filters as tables over pairs of bytes."""

    def __init__(self, net: ByteNet):
        self.net, self.width = net, max(net.shape.widths)
        # Responses to the two bytes at each even offset, for all filters at once.
        self.pairs = []
        for at in range(0, self.width, 2):
            columns = []
            for i, w in enumerate(net.shape.widths):
                first = net.embed @ net.kernels[i][at] if at < w else np.zeros((256, net.shape.filters))
                second = net.embed @ net.kernels[i][at + 1] if at + 1 < w else np.zeros_like(first)
                both = first[:, None, :] + second[None, :, :] + (net.bias[i] if at == 0 else 0)
                columns.append(both.reshape(65536, -1))
            self.pairs.append(np.concatenate(columns, 1).astype(np.float32))

    def __call__(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for each window."""
        size, out = self.net.shape.window, []
        padded = np.pad(windows, ((0, 0), (0, 2)), constant_values=32).astype(np.uint16)
        codes = padded[:, :-1] * np.uint16(256) + padded[:, 1:]
        for first in range(0, len(windows), 32):
            some = codes[first : first + 32]
            total = self.pairs[0][some[:, :size]]
            for k, table in enumerate(self.pairs[1:], 1):
                total += table[some[:, 2 * k : 2 * k + size]]
            out.append(total.max(axis=1))
        hidden = np.maximum(np.concatenate(out), 0)
        logits = hidden @ self.net.out + self.net.out_bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def has_letter(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    total = np.concatenate([[0], np.cumsum(LETTERS[data], dtype=np.int64)])
    found = total[starts[1:]] > total[starts[:-1]]
    for k in np.flatnonzero(~found & (np.diff(starts) > 0)):
        text = data[starts[k] : starts[k + 1]].tobytes().decode("utf-8", "ignore")
        found[k] = any(c.isalpha() for c in text)
    return found


def predict(documents: DataFrame, net: ByteNet, keep: list[str]) -> DataFrame:
    """`lang_pred` and `score` for the `text` of each row, beside the columns in `keep`."""
    source = documents.select(*keep, F.col("text").cast("string").alias("text"))
    schema = source.drop("text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(net) if len(net.languages) > 1 else None
        names = np.array([*net.languages, UNKNOWN], dtype=object)
        for batch in batches:
            data, starts = text_buffer(batch.column(len(keep)))
            best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for first, last in slices(starts):
                own = starts[first : last + 1] - starts[first]
                part = folded(data[starts[first] : starts[last]])
                top, p = top_language(part, own, net, predictor)
                best.append(top)
                score.append(p)
            top = names[np.concatenate(best)]
            arrays = [*batch.columns[: len(keep)], pa.array(top, pa.string()), pa.array(np.concatenate(score))]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def top_language(
    data: np.ndarray, starts: np.ndarray, net: ByteNet, predictor: Predictor | None
) -> tuple[np.ndarray, np.ndarray]:
    """Number of the likeliest language of each text, the last for unknown, and its probability."""
    n = len(starts) - 1
    known = has_letter(data, starts) & bool(net.languages)
    if predictor is None:
        return np.where(known, 0, len(net.languages)), known.astype(float)
    total = np.zeros((n, len(net.languages)))
    overlap = predictor.width - 1
    # A very long text is seen in pieces of windows, so memory stays small.
    windows, text = windows_of(data, starts, net.shape.window, overlap)
    for first in range(0, len(windows), 4096):
        p = predictor(windows[first : first + 4096])
        np.add.at(total, text[first : first + 4096], p)
    mean = total / np.maximum(np.bincount(text, minlength=n), 1)[:, None]
    top = mean.argmax(1)
    score = np.clip(mean[np.arange(n), top], 0, 1)
    return np.where(known, top, len(net.languages)), np.where(known, score, 0.0)


def fit(labelled: DataFrame, shape: NetShape | None = None) -> ByteNet:
    """A network from rows with `doc_id`, `text` and `lang`, none of them null."""
    shape = shape or NetShape()
    return train(sample_windows(labelled.dropna(subset=["text", "lang"]), shape), shape)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    net = fit(documents.where(~F.coalesce(fold, F.lit(True))).select("doc_id", "text", "lang"))
    rows = documents.select("doc_id", F.coalesce(fold, F.lit(True)).alias("held_out"), "text")
    return predict(rows, net, ["doc_id", "held_out"])
