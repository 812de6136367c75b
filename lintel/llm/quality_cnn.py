"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over overlapping chunks that cover the whole document,
each chunk keeps the maximum of every filter, and the largest and the mean chunk response of every
filter combine into one probability.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import slices, text_bytes
from lintel.llm.toxicity_mil import sample

#: Labelled documents used for training, of each label at most, the least by a hash of doc_id.
SAMPLE = 1500
#: Embedding size, filter width and step in bytes, filters, bytes of half a chunk (chunks overlap by half).
EMBED, WIDE, HOP, FILTERS, HALF = 8, 8, 4, 24, 64
#: Training: steps, documents of each label in a step, learning rate.
STEPS, PAIR, RATE = 500, 8, 0.01
SHAPES = {"embed": (256, EMBED), "filters": (WIDE * EMBED, FILTERS), "bias": (FILTERS,), "top": (2 * FILTERS,), "last": (1,)}


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    flat, at, out = np.frombuffer(blob, np.float32), 0, {}
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape).copy()
        at += size
    return out


def packed(net: dict[str, np.ndarray]) -> bytes:
    return b"".join(net[name].astype(np.float32).tobytes() for name in SHAPES)


def lay(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows padded with zero bytes to whole half-chunks, at least WIDE of them, and the n + 1 offsets in half-chunks."""
    sizes = np.diff(offs)
    halves = -(-(sizes + WIDE) // HALF)
    at = np.concatenate(([0], np.cumsum(halves)))
    out = np.zeros(at[-1] * HALF + WIDE, np.uint8)
    out[np.arange(len(raw)) + np.repeat(at[:-1] * HALF - offs[:-1], sizes)] = raw
    return out, at


def responses(net: dict[str, np.ndarray], data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Filter responses (half-chunks, places, filters) after the rectifier. The last place of a row, padding and the row after, gives none."""
    x = net["embed"][data]
    places = (len(data) - WIDE) // HOP
    view = np.lib.stride_tricks.as_strided(x, (places, WIDE * EMBED), (HOP * x.strides[0], x.strides[1]))
    y = view @ net["filters"]
    y += net["bias"]
    np.maximum(y, 0, out=y)
    y = y.reshape(-1, HALF // HOP, FILTERS)
    y[at[1:] - 1, -1] = 0
    return y


def pooled(half: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk maxima, and of each row the largest and the mean over its chunks. A chunk is a half-chunk and the next of its row."""
    after = np.arange(1, len(half) + 1)
    after[at[1:] - 1] = at[1:] - 1
    chunk = np.maximum(half, half[after])
    return chunk, np.maximum.reduceat(chunk, at[:-1]), np.add.reduceat(chunk, at[:-1]) / np.diff(at)[:, None]


def scores(net: dict[str, np.ndarray], raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    if len(offs) < 2:
        return np.zeros(0)
    data, at = lay(raw, offs)
    _, most, mean = pooled(responses(net, data, at).max(1), at)
    z = (np.concatenate([most, mean], 1).astype(np.float64) * net["top"]).sum(1) + net["last"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradients(net: dict[str, np.ndarray], raw: np.ndarray, offs: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy; only the place that won each maximum carries any."""
    data, at = lay(raw, offs)
    resp = responses(net, data, at)
    win, half = resp.argmax(1), resp.max(1)
    chunk, most, mean = pooled(half, at)
    v = np.concatenate([most, mean], 1)
    g = (1 / (1 + np.exp(-np.clip(v @ net["top"] + net["last"], -30, 30))) - y) / len(y)
    gv = g[:, None] * net["top"]
    rows = np.repeat(np.arange(len(y)), np.diff(at))
    gc = (gv[:, FILTERS:] / np.diff(at)[:, None])[rows]
    hit = chunk == most[rows]
    ties = np.add.reduceat(hit.astype(np.float32), at[:-1])
    gc = gc + hit * (gv[:, :FILTERS] / ties)[rows]
    after = np.arange(1, len(half) + 1)
    after[at[1:] - 1] = at[1:] - 1
    first = half >= half[after]
    gh = np.where(first, gc, 0)
    np.add.at(gh, after, np.where(first, 0, gc))
    gh = np.where(half > 0, gh, 0)
    unit, filt = np.nonzero(gh)
    amount = gh[unit, filt].astype(np.float32)
    begin = unit * HALF + win[unit, filt] * HOP
    seen = data[begin[:, None] + np.arange(WIDE)]
    windows = net["embed"][seen].reshape(len(begin), -1) * amount[:, None]
    order = np.argsort(filt, kind="stable")
    bounds = np.searchsorted(filt[order], np.arange(FILTERS + 1))
    gf = np.zeros_like(net["filters"])
    for k in range(FILTERS):
        gf[:, k] = windows[order[bounds[k] : bounds[k + 1]]].sum(0)
    back = (net["filters"].T[filt] * amount[:, None]).reshape(-1, EMBED)
    ge = np.stack([np.bincount(seen.ravel(), back[:, e], 256) for e in range(EMBED)], 1)
    return {"embed": ge, "filters": gf, "bias": np.bincount(filt, amount, FILTERS), "top": (g[:, None] * v).sum(0), "last": g.sum(keepdims=True)}


def fit(texts: list[bytes], good: np.ndarray) -> dict[str, np.ndarray]:
    """A network fitted with Adam on steps that hold as many rows of either label; untrained if a label is missing."""
    rng = np.random.default_rng(23)
    net = {k: (rng.standard_normal(s) * (0.5 if k == "embed" else 0.15 if k == "filters" else 0.0)).astype(np.float32) for k, s in SHAPES.items()}
    sides = [np.flatnonzero(good == k) for k in (0, 1)]
    if not all(map(len, sides)):
        return net
    net["top"] = (rng.standard_normal(SHAPES["top"]) * 0.1).astype(np.float32)
    first, second = ({k: np.zeros(s) for k, s in SHAPES.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        picks = np.concatenate([rng.choice(s, PAIR) for s in sides])
        part = [texts[i] for i in picks]
        grads = gradients(net, np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]), good[picks])
        rate = RATE * min(1.0, 2.0 * (1 - step / (STEPS + 1)))
        for k, g in grads.items():
            g = g + 1e-4 * net[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net[k] = (net[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, usable: Column, most: int = SAMPLE) -> bytes:
    """The packed network, fitted in one task on the bounded sample."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])
        return pd.DataFrame({"net": [packed(fit(list(pdf["text"]), pdf["y"].to_numpy()))]})

    row = sample(docs, labels, "quality", usable, most).groupBy().applyInPandas(run, "net binary").first()
    return bytes(row["net"]) if row else packed(fit([], np.zeros(0)))


def _scorer(blob: bytes):
    def score(batches):
        net = unpack(blob)
        for batch in slices(batches, "text", 1 << 18):
            raw, offs = text_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores(net, raw, offs), pa.float64())], ["doc_id", "score"])

    return score


def quality(docs: DataFrame, labels: DataFrame, usable: Column, most: int = SAMPLE) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every row of docs (doc_id, text), whole texts.

    usable: which rows of labels (doc_id, quality) may be learned from. A null or empty text is one
    chunk of padding with a score like any other. Without both labels every score is 0.5. Repeated
    rows get equal scores; extra columns are ignored; empty tables stay empty.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(train(docs, labels, usable, most)), "doc_id long, score double")
