"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's logit is the sum of learned weights of its hashed
words; the document's probability is the noisy-or of its sentences, so labels of documents alone
train the sentence scores, which then point at the offending sentences.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import LOWER, slices, span_hashes, text_bytes
from lintel.llm.runs import press, unpress

#: Labelled documents used for training, of each label at most, the least by a hash of doc_id.
SAMPLE = 3000
#: Cells of the hashed weight table; documents a word must occur in and standard errors it must stand out by; passes and step.
CELLS, LEAST_DOCS, SURE, PASSES, STEP = 1 << 18, 4, 4.0, 60, 0.2
#: Logit of a sentence without telling words at the start; chance of a toxic label without an offending sentence.
BIAS, LEAK = -5.0, 0.02

#: Letters: a to z after lower-casing, and every byte of a character beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
#: What ends a sentence: full stop, exclamation and question mark, line end.
_STOP = np.zeros(256, bool)
_STOP[[46, 33, 63, 10]] = True


def sentence_words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """cell of each word, first word of each sentence, row of each sentence, start and end byte of each sentence.

    Sentences without a word are left out, so rows without words have none.
    """
    low = LOWER[raw]
    ink = _LETTER[low]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    if not len(raw) or not ink.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    starts = np.flatnonzero(ink & (~np.concatenate(([False], ink[:-1])) | edge[:-1]))
    ends = np.flatnonzero(ink & (~np.concatenate((ink[1:], [False])) | edge[1:])) + 1
    cells = (span_hashes(low, starts, ends) >> np.uint64(46)).astype(np.int64) & (CELLS - 1)
    # a sentence begins with a row, or after a stop
    number = np.cumsum(edge[:-1] | np.concatenate(([False], _STOP[low[:-1]])))
    of = number[starts]
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    rows = np.searchsorted(offs, starts[first], side="right") - 1
    return cells, first, rows, starts[first], ends[np.concatenate((first[1:] - 1, [len(ends) - 1]))]


def sentence_logits(weights: np.ndarray, cells: np.ndarray, first: np.ndarray) -> np.ndarray:
    return weights[-1] + np.add.reduceat(weights[cells], first) if len(first) else np.zeros(0)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def document_counts(raw: np.ndarray, offs: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of the CELLS words: the toxic documents that hold it, and the others."""
    n = len(toxic)
    cells, first, rows, _, _ = sentence_words(raw, offs)
    of_word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(cells))))
    seen = np.unique(cells * n + rows[of_word]) if len(first) else cells
    bad = toxic[seen % n] == 1
    return tuple(np.bincount(seen[m] // n, minlength=CELLS) for m in (bad, ~bad))


def fit(texts: list[bytes], toxic: np.ndarray, counts: tuple | None = None) -> np.ndarray:
    """Weights of the CELLS words and, last, the bias.

    counts: document_counts() and the numbers of toxic and other documents they are of; those of texts
    if None. Words that toxic documents hold clearly more often than their share (by SURE standard
    errors, in LEAST_DOCS documents at least) start at their log-odds, all others stay at 0; then gradient steps
    on the likelihood of the labels under the noisy-or, with LEAK as the chance of a label without
    any offending sentence.
    """
    weights = np.zeros(CELLS + 1)
    weights[-1] = BIAS
    if not len(texts) or toxic.min() == toxic.max():
        return weights
    raw, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    cells, first, rows, _, _ = sentence_words(raw, offs)
    if not len(first):
        return weights
    of_word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(cells))))
    n = len(texts)
    with_, without, n_toxic, n_other = counts or (*document_counts(raw, offs, toxic), (toxic == 1).sum(), (toxic != 1).sum())
    share = n_toxic / (n_toxic + n_other)
    expected = (with_ + without) * share
    use = (with_ - expected > SURE * np.sqrt(expected * (1 - share) + 1e-9)) & (with_ + without >= LEAST_DOCS)
    w = np.where(use, np.log((with_ + 0.5) / (n_toxic + 1)) - np.log((without + 0.5) / (n_other + 1)), 0.0)
    bias, squares, bias_squares = BIAS, np.full(CELLS, 0.01), 0.01
    for _ in range(PASSES):
        z = bias + np.add.reduceat(w[cells], first)
        s = LEAK + np.bincount(rows, softplus(z), n)
        g = np.where(toxic == 1, np.exp(-s) / np.expm1(-s), 1.0)
        gz = g[rows] / (1 + np.exp(-np.clip(z, -40, 40)))
        gw = np.bincount(cells, gz[of_word], CELLS) * use
        squares += gw * gw
        w -= STEP * gw / np.sqrt(squares)
        bias_squares += gz.sum() ** 2
        bias -= STEP * gz.sum() / np.sqrt(bias_squares)
    weights[:-1], weights[-1] = w, bias
    return weights


def marked(labels: DataFrame, label: str, usable: Column) -> DataFrame:
    """doc_id, y and h, a hash of doc_id, of the labels that may be learned from; null labels take no part."""
    return labels.where(F.col(label).isin(0, 1) & usable).select("doc_id", F.col(label).cast("int").alias("y"), F.xxhash64("doc_id").alias("h"))


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """doc_id, text (bytes) and y of at most ``most`` labelled documents of each label, those with the least hashes of doc_id and of text.

    A document is told by doc_id and text, so one doc_id on many rows does not pass the bound.
    """
    known = marked(labels, label, usable)
    least = lambda df, y, *by: df.where(f"y = {y}").orderBy(*by).limit(most)
    ids = least(known, 1, "h", "doc_id").union(least(known, 0, "h", "doc_id")).distinct()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("t", F.xxhash64("text"))
    found = texts.drop("text").join(F.broadcast(ids), "doc_id").distinct()
    picked = least(found, 1, "h", "t", "doc_id").union(least(found, 0, "h", "t", "doc_id")).drop("h")
    return texts.join(F.broadcast(picked), ["doc_id", "t"]).dropDuplicates(["doc_id", "t", "y"]).select("doc_id", "text", "y")


def _word_sets(batches):
    """Of each document its different words' cells, ascending and compressed: an eighth of its text or so."""
    for batch in slices(batches, "text"):
        cells, first, rows, _, _ = sentence_words(*text_bytes(batch.column(1)))
        of_word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(cells))))
        seen = np.unique(rows[of_word] * CELLS + cells) if len(first) else cells
        ends = np.searchsorted(seen, np.arange(1, batch.num_rows + 1) * CELLS)
        gaps = np.diff(seen % CELLS, prepend=0).astype(np.int32)
        sets = [_small(gaps[a:b], seen[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "words"])


def _small(gaps: np.ndarray, cells: np.ndarray) -> bytes:
    if not len(gaps):
        return b""
    gaps = gaps.copy()
    gaps[0] = cells[0] % CELLS
    return press(gaps)


def _counter(batches):
    """Of each task the cells with the numbers of toxic and other documents that hold them; at cell -1 those of all its documents."""
    counts, every = np.zeros((2, CELLS), np.int64), [0, 0]
    for batch in batches:
        for words, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            every[1 - y] += 1
            if words:
                counts[1 - y, np.cumsum(unpress(words, np.int32))] += 1
    cells = np.flatnonzero(counts.sum(0))
    if sum(every):
        columns = (np.append(cells, -1), np.append(counts[0, cells], every[0]), np.append(counts[1, cells], every[1]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cell", "bad", "good"])


def corpus_counts(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """cell, bad, good: toxic and other documents with each word that may learn, over all documents with a usable label; at cell -1 all of them.

    At most CELLS + 1 rows. What meets the labels is a document's set of words, not its text.
    """
    known = marked(labels, "toxic", usable).select("doc_id", "y").distinct()
    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(_word_sets, "doc_id long, words binary")
    rows = sets.join(known, "doc_id").select("words", "y").mapInArrow(_counter, "cell long, bad long, good long")
    rows = rows.groupBy("cell").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    return rows.where(f"cell < 0 OR (bad > 0 AND bad + good >= {LEAST_DOCS})")


def train(docs: DataFrame, labels: DataFrame, usable: Column, most: int = SAMPLE) -> bytes:
    """The weights as 32-bit floats, fitted in one task on the bounded sample; which words learn is told by all labelled documents."""

    def run(pdf: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        pdf, words, every = pdf.sort_values(["doc_id", "text"]), counts[counts["cell"] >= 0], counts[counts["cell"] < 0]
        told = None
        if len(every):
            told = (*(np.bincount(words["cell"], words[c], CELLS) for c in ("bad", "good")), int(every["bad"].iloc[0]), int(every["good"].iloc[0]))
        return pd.DataFrame({"weights": [fit([bytes(t) for t in pdf["text"]], pdf["y"].to_numpy(), told).astype(np.float32).tobytes()]})

    one = F.lit(0).alias("one")
    pair = sample(docs, labels, "toxic", usable, most).groupBy(one).cogroup(corpus_counts(docs, labels, usable).groupBy(one))
    row = pair.applyInPandas(run, "weights binary").first()
    return bytes(row["weights"]) if row else fit([], np.zeros(0)).astype(np.float32).tobytes()


def _scorer(blob):
    def score(batches):
        weights = np.frombuffer(blob.value, np.float32).astype(np.float64)
        for batch in slices(batches, "text"):
            raw, offs = text_bytes(batch.column(1))
            cells, first, rows, a, b = sentence_words(raw, offs)
            z = sentence_logits(weights, cells, first)
            total = np.bincount(rows, softplus(z), batch.num_rows)
            order = np.lexsort((-z, rows))
            lead = order[np.concatenate(([True], rows[order][1:] != rows[order][:-1]))] if len(order) else order
            spans = np.full((batch.num_rows, 2), -1)
            spans[rows[lead], 0], spans[rows[lead], 1] = a[lead] - offs[rows[lead]], b[lead] - offs[rows[lead]]
            worst = np.zeros(batch.num_rows)
            worst[rows[lead]] = 1 / (1 + np.exp(-z[lead]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(-np.expm1(-total)), pa.array(worst), *[pa.array(s, mask=s < 0) for s in spans.T]], ["doc_id", "score", "worst_score", "worst_start", "worst_end"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame, usable: Column, most: int = SAMPLE) -> DataFrame:
    """doc_id, score (0 to 1), and the worst sentence: worst_score and its byte span worst_start, worst_end.

    One row for every row of docs (doc_id, text). usable: which rows of labels (doc_id, toxic) may be
    learned from. A null, empty or wordless text has score 0 and a null span. Without both labels the
    scores are near 0. Repeated rows get equal scores; extra columns are ignored; empty tables stay empty.
    """
    blob = docs.sparkSession.sparkContext.broadcast(train(docs, labels, usable, most))  # 1 MB, whatever the input
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(blob), "doc_id long, score double, worst_score double, worst_start long, worst_end long")
