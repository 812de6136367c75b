"""Packing documents into token sequences along a space-filling curve.

A document's hashed token vector is projected to three numbers; their place on a Hilbert curve
orders the documents, so neighbours in a sequence are alike. Documents are laid end to end in that
order and cut at every ``length`` tokens: only the last sequence is short.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lintel.llm.common import cut, mix, slices, text_bytes

LENGTH, END_ID = 4096, 2
TOKENIZER = "word_bpe_49k.json"
#: Hashed dimensions of a document's vector, numbers it is projected to, bits of each on the curve.
HASHED, FEW, BITS = 512, 3, 8
#: Documents of a stretch of the curve whose running sums one task takes, on average.
STRETCH = 1000
#: Words whose ids a worker keeps, in each of two generations.
CACHE_WORDS = 200_000

TOKENS_SCHEMA = "row_id long, doc_id long, n_tokens long, ids binary, " + ", ".join(f"p{i} double" for i in range(FEW))
PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: The vocabulary's split of text, and how it writes bytes as characters: printable ones as themselves, the others from U+0100 on.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


class WordTokens:
    """Token ids of texts, word by word from a bounded cache.

    The vocabulary's pre-tokenizer never joins across white space, so a text's ids are those of its
    lower-cased words in turn, and a word's those of its pre-tokens. That is used where white space and lower-casing cannot differ
    between libraries (characters up to U+024F); other texts, and texts that may name a special
    token, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.new, self.old = {}, {}

    def part(self, s: str) -> bytes:
        """Ids of one pre-token, by the vocabulary's merges over its bytes."""
        if not (s.isascii() and s.isprintable()):
            s = s.encode().decode("latin-1").translate(BYTE_SIGNS)
        return array("H", [t.id for t in self.model.tokenize(s)]).tobytes()

    def learn(self, missing: set[str]) -> None:
        part, new, get = self.part, self.new, self.new.get
        for w in missing:
            if w.isalpha():
                new[w] = part(w)
            elif w[-1] in ".," and (core := w[:-1]).isalpha():
                new[w] = (get(core) or part(core)) + part(w[-1])
            else:
                new[w] = b"".join(map(part, PRE_TOKENS.findall(w)))

    def known(self, words: set[str]) -> None:
        """Afterwards every one of the words is in the new generation."""
        if len(self.new) > CACHE_WORDS:
            self.old, self.new = self.new, {}
        missing = words.difference(self.new)
        for w in missing & self.old.keys():
            self.new[w] = self.old[w]
        self.learn(missing.difference(self.old))

    def encode(self, texts: list[str], plain: np.ndarray) -> list[bytes]:
        """Little-endian 16-bit ids of each text. plain: no byte of it is above U+024F."""
        split = [t.lower().split() if p and "<|" not in t and "İ" not in t and not any(c in t for c in "\x1c\x1d\x1e\x1f") else None for t, p in zip(texts, plain, strict=True)]
        self.known(set().union(*[s for s in split if s]))
        get = self.new.__getitem__
        return [b"".join(map(get, s)) if s is not None else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t, s in zip(texts, split, strict=True)]


_HELD: dict[str, WordTokens] = {}


def word_tokens(path: str | None) -> WordTokens:
    """One tokenizer and cache a worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _HELD:
        _HELD[path] = WordTokens(path)
    return _HELD[path]


def _tokenizer(path: str | None):
    def tokenize(batches):
        tokens, row = word_tokens(path), TaskContext.get().partitionId() << 36
        rng = np.random.default_rng(17)
        table = rng.standard_normal((HASHED, FEW))[(mix(np.arange(65536, dtype=np.uint64)) % np.uint64(HASHED)).astype(int)]
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "text"):
            raw, offs = text_bytes(batch.column(1))
            top = np.maximum.reduceat(np.append(raw, np.uint8(0)), offs[:-1]) if batch.num_rows else raw
            top[offs[:-1] == offs[1:]] = 0
            coded = tokens.encode([t or "" for t in batch.column(1).to_pylist()], top < 0xC9)
            ids = [np.append(np.frombuffer(c, "<u2"), np.uint16(END_ID)).astype("<u2") for c in coded]
            n = np.array([len(i) for i in ids])
            few = np.add.reduceat(table[np.concatenate(ids)], np.concatenate(([0], np.cumsum(n)[:-1])), axis=0) / n[:, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(n))), batch.column(0).cast(pa.int64()), pa.array(n), pa.array([press.compress(i.tobytes()) for i in ids], pa.binary()), *[pa.array(few[:, k]) for k in range(FEW)]],
                ["row_id", "doc_id", "n_tokens", "ids", *[f"p{k}" for k in range(FEW)]],
            )
            row += len(n)

    return tokenize


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, dims), each coordinate below 2 ** bits."""
    x = points.astype(np.int64).T.copy()
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo the rotations from the coarsest cell inwards
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


@F.pandas_udf(LongType())
def curve_key(*z: pd.Series) -> pd.Series:
    """Hilbert key of standardised numbers, squeezed to the unit interval."""
    unit = 1 / (1 + np.exp(-1.7 * np.clip(np.stack([s.to_numpy(float) for s in z], 1), -20, 20)))
    return pd.Series(hilbert(np.minimum((unit * 2**BITS).astype(int), 2**BITS - 1)))


def _cutter(length: int):
    def cut_up(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc, at, n, packed in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "at", "n_tokens", "ids")), strict=True):
                ids, start = np.frombuffer(open_.decompress(packed), "<u2").astype("<u4"), 0
                while start < n:
                    seq, offset = divmod(at + start, length)
                    m = min(n - start, length - offset)
                    out.append((doc, start, m, zlib.crc32(ids[start : start + m]), n, seq, offset))
                    start += m
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return cut_up


def tokenized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """row_id, doc_id, n_tokens, ids (compressed) and the projected vector of every row; null text counts as empty, every row ends with END_ID."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenizer(path), TOKENS_SCHEMA)


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text) in sequences of at most ``length`` tokens.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; see PIECES_SCHEMA. Every row
    is packed, so repeated rows and rows of one doc_id (or of none) are each laid out; a null or
    empty text is the single END_ID. Very long texts run over many sequences. An empty table gives
    no pieces. Extra columns are ignored.
    """
    rows = cut(tokenized(docs, path))
    narrow = rows.drop("ids")
    marks = [f(f"p{i}").alias(f"{a}{i}") for i in range(FEW) for a, f in (("m", F.avg), ("s", F.stddev_pop))]
    mark = narrow.agg(F.count("*").alias("n"), *marks).first()  # one row of figures over all documents
    bits = FEW * BITS
    wide = max(0, bits - max(0, int(np.log2(max(1, mark["n"] / STRETCH)))))
    z = [(F.col(f"p{i}") - F.lit(mark[f"m{i}"] or 0.0)) / F.lit(mark[f"s{i}"] or 1.0) for i in range(FEW)]
    placed = narrow.select("row_id", "doc_id", "n_tokens", curve_key(*z).alias("key"))
    placed = placed.withColumn("cell", F.shiftright("key", wide))
    # a cell that holds far more rows than a stretch (copies share a key) is dealt out over lanes
    lanes = placed.groupBy("cell").agg(F.ceil(F.count("*") / (4 * STRETCH)).alias("lanes"))
    placed = cut(placed.join(lanes, "cell").withColumn("lane", F.pmod(F.xxhash64("row_id"), F.col("lanes"))).drop("lanes"))
    sums = placed.groupBy("cell", "lane").agg(F.sum("n_tokens").alias("tokens"))
    sums = sums.select("cell", "lane", (F.sum("tokens").over(Window.orderBy("cell", "lane")) - F.col("tokens")).alias("base"))
    inside = Window.partitionBy("cell", "lane").orderBy("key", "doc_id", "row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.withColumn("upto", F.sum("n_tokens").over(inside)).join(sums, ["cell", "lane"])
    laid = laid.select("row_id", (F.col("base") + F.col("upto") - F.col("n_tokens")).alias("at"))
    return rows.select("row_id", "doc_id", "n_tokens", "ids").join(laid, "row_id").select("doc_id", "at", "n_tokens", "ids").mapInArrow(_cutter(length), PIECES_SCHEMA)
