"""Byte-level BPE by a minimal acyclic transducer of the corpus's frequent words.

The words of all documents are counted; the most frequent are merged once and compiled into a
transducer: an acyclic automaton with one state for each different set of suffixes with their outputs,
whose arcs give token ids as early as they are certain. It is one flat file of arrays, memory-mapped in
each worker and walked for all words of a slice at once. Words that it does not accept are merged
exactly, so which words it holds changes the time and never the ids.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import slices, span_hashes, text_bytes

#: Words in the transducer, the most frequent of the corpus, and the bytes of the longest that may be.
LEXICON, LONGEST = 1 << 16, 48
#: Bytes of text handled at once; a longer document is taken in parts.
PART = 1 << 20
#: Different words a task counts before it hands them on.
COUNTED = 1 << 17

#: Rank of a pair that is never merged.
NEVER = 1 << 30

LETTER, NUMBER, BLANK, OTHER, SPECIAL, UNKNOWN = 0, 1, 2, 3, 4, 255


# ---------------------------------------------------------------- open hash tables

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _slots(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.astype(np.uint64) * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def hash_table(key: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits of the place, the table of keys (-1: free) and the place of each key; keys are different and not negative."""
    bits = max(4, (2 * len(key) + 1).bit_length())
    keys, slot, left = np.full(1 << bits, -1, np.int64), _slots(key, bits), np.arange(len(key))
    while len(left):
        free = left[keys[slot[left]] < 0]
        keys[slot[free]] = key[free]  # of several for one place the last stays
        left = left[keys[slot[left]] != key[left]]
        slot[left] = (slot[left] + 1) & ((1 << bits) - 1)
    return bits, keys, slot


def probe(keys: np.ndarray, bits: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key, and whether it is there."""
    slot = _slots(key, bits)
    have = keys[slot]
    while (off := np.flatnonzero((have != key) & (have >= 0))).size:
        slot[off] = (slot[off] + 1) & ((1 << bits) - 1)
        have[off] = keys[slot[off]]
    return slot, have == key


# ---------------------------------------------------------------- vocabulary


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself where it prints, else the next from 256 on."""
    out, beyond = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(beyond))
            beyond += 1
    return out


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        ids = spec["model"]["vocab"]
        self.byte_id = [ids[c] for c in byte_letters()]
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        tokens = {i: bytes(back[c] for c in t) for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.size = max(tokens) + 1
        self.tokens = [tokens.get(i, b"") for i in range(self.size)]
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[a], ids[b]] = (rank, ids[a + b])
        pairs = np.array([a << 32 | b for a, b in self.ranks], np.int64)
        self.bits, self.pairs, slot = hash_table(pairs)
        self.pair_rank, self.pair_id = np.full((2, len(self.pairs)), NEVER, np.int64)
        if len(pairs):
            self.pair_rank[slot], self.pair_id[slot] = np.array(list(self.ranks.values()), np.int64).T
        self.finder = regex.compile(b"|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Token ids of one word: the pair of least rank, of equal ones the first, is merged until none is left."""
        ids, ranks = [self.byte_id[b] for b in word], self.ranks
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if r := ranks.get((new, ids[after[j]])):
                    heapq.heappush(heap, (*r, i, new, ids[after[j]]))
            if before[i] >= 0 and (r := ranks.get((ids[before[i]], new))):
                heapq.heappush(heap, (*r, before[i], ids[before[i]], new))
        return tuple(t for t in ids if t >= 0)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and token of the merge of each pair; NEVER where there is none."""
        slot, have = probe(self.pairs, self.bits, left << 32 | right)
        return np.where(have, self.pair_rank[slot], NEVER), self.pair_id[slot]

    def merge_many(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many short words at once: their ids one after the other, and how many each has.

        In each round every word merges its pair of least rank, of equal ones the first; words without one are done.
        """
        sym, own = np.array(self.byte_id, np.int64)[raw], np.repeat(np.arange(len(lengths)), lengths)
        done = []
        rank = self._ranks(sym, own, np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(sym)), first)
            open_ = best >> 32 < NEVER
            at = best[open_] & 0xFFFFFFFF
            sym[at] = self.rank_of(sym[at], sym[np.minimum(at + 1, len(sym) - 1)])[1]
            stays = np.ones(len(sym), bool)
            stays[at + 1] = False
            live = np.repeat(open_, np.diff(np.append(first, len(sym))))
            done.append((sym[~live], own[~live]))
            keep = stays & live
            at = (np.cumsum(keep) - 1)[at]
            sym, own, rank = sym[keep], own[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                rank[i] = self._ranks(sym, own, i)
        ids, of = (np.concatenate(c) for c in zip(*done, strict=True)) if done else (sym, own)
        return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(lengths))

    def _ranks(self, sym: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        after = np.minimum(at + 1, max(len(sym) - 1, 0))
        return np.where((own[at] == own[after]) & (after > at), self.rank_of(sym[at], sym[after])[0], NEVER)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# ---------------------------------------------------------------- words


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point; UNKNOWN where this Python's tables have no character, to be asked of the tokenizers library."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            out[c] = LETTER
        elif kind[0] == "N":
            out[c] = NUMBER
        elif kind[0] == "Z":
            out[c] = BLANK
        elif kind == "Cn":
            out[c] = UNKNOWN
    out[[9, 10, 11, 12, 13, 0x85]] = BLANK
    return out


def _ask(c: int) -> int:
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    return next((k for k, left in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(left + chr(c))) == 1), BLANK)


def _class_of(raw: np.ndarray, lead: np.ndarray) -> np.ndarray:
    table = _classes()
    first = raw[lead]
    out = table[first]
    many = np.flatnonzero(first >= 0x80)
    if len(many):
        at = lead[many]
        more = np.minimum(at[:, None] + np.arange(4), len(raw) - 1)
        b = raw[more].astype(np.int64)
        tail = b & 0x3F
        code = np.select(
            [b[:, 0] < 0xE0, b[:, 0] < 0xF0],
            [(b[:, 0] & 0x1F) << 6 | tail[:, 1], (b[:, 0] & 0x0F) << 12 | tail[:, 1] << 6 | tail[:, 2]],
            (b[:, 0] & 0x07) << 18 | tail[:, 1] << 12 | tail[:, 2] << 6 | tail[:, 3],
        )
        kinds = table[code]
        if (kinds == UNKNOWN).any():
            for c in np.unique(code[kinds == UNKNOWN]).tolist():
                table[c] = _ask(c)
            kinds = table[code]
        out[many] = kinds
    return out


def split_words(raw: np.ndarray, offs: np.ndarray, finder=None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
    """Starts and ends of the words of each row, and (start, token) of the special tokens among them.

    The rule of byte-level BPE: a run of letters, of numbers or of other signs with the blank before it; after an
    apostrophe that begins a word s, t, m, d, re, ve and ll stand alone with it; of white space before
    anything else the last character stands apart. Rows and special tokens are never crossed.
    """
    none = np.zeros(0, np.int64)
    if not len(raw):
        return none, none, []
    found = []
    if finder is not None:
        for m in finder.finditer(raw.tobytes()):
            row = np.searchsorted(offs, m.start(), side="right") - 1
            if m.end() <= offs[row + 1]:
                found.append((m.start(), m.group()))
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    n = len(lead)
    kind, first = _class_of(raw, lead), raw[lead]
    edge = np.zeros(n + 4, bool)
    edge[n:] = True
    edge[np.searchsorted(lead, offs[:-1])] = True
    for at, token in found:
        a, b = np.searchsorted(lead, [at, at + len(token)])
        kind[a:b] = SPECIAL
        edge[a] = edge[b] = True
    start = np.concatenate(([True], kind[1:] != kind[:-1])) | edge[:n]
    follows = np.concatenate((kind[1:] != BLANK, [False])) & ~edge[1 : n + 1]
    last = (kind == BLANK) & follows
    start |= last
    glued = np.flatnonzero(last & (first == 32))
    start[glued + 1] = False
    mark = np.flatnonzero(start & (first == 39) & ~edge[1 : n + 1])
    if len(mark):
        pad = np.concatenate((first, np.zeros(3, np.uint8)))
        c1, c2 = pad[mark + 1], np.where(edge[mark + 2], 0, pad[mark + 2])
        short = np.isin(c1, np.frombuffer(b"stmd", np.uint8))
        long = ((c2 == ord("e")) & ((c1 == ord("r")) | (c1 == ord("v")))) | ((c1 == ord("l")) & (c2 == ord("l")))
        for these, size in ((mark[short], 2), (mark[long & ~short], 3)):
            for k in range(1, size):
                start[these + k] = False
            nxt = these + size
            start[nxt[nxt < n]] = True
    starts = lead[start]
    return starts, np.append(starts[1:], len(raw)), found


# ---------------------------------------------------------------- the transducer


class _State:
    __slots__ = ("final", "tail", "arcs", "number")

    def __init__(self):
        self.final, self.tail, self.arcs, self.number = False, (), [], -1


def _common(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def minimal_transducer(pairs) -> list[_State]:
    """States, the start last, of the minimal transducer of (word, ids), sorted by word and not empty.

    A state is settled, and shared with an equal one, as soon as no later word can change it; outputs that all
    words through an arc have in common move towards the start.
    """
    known, states = {}, []

    def settle(s: _State) -> _State:
        same = known.setdefault((s.final, s.tail, tuple((b, o, t.number) for b, o, t in s.arcs)), s)
        if same.number < 0:
            same.number = len(states)
            states.append(same)
        return same

    path, previous = [_State()], b""
    for word, out in pairs:
        p = len(os.path.commonprefix([word, previous]))
        for i in range(len(previous), p, -1):
            path[i - 1].arcs[-1][2] = settle(path[i])
        del path[p + 1 :]
        for i in range(1, p + 1):
            arc = path[i - 1].arcs[-1]
            k = _common(arc[1], out)
            rest, arc[1], out = arc[1][k:], arc[1][:k], out[k:]
            if rest:
                for later in path[i].arcs:
                    later[1] = rest + later[1]
                if path[i].final:
                    path[i].tail = rest + path[i].tail
        for i in range(p, len(word)):
            new = _State()
            path[-1].arcs.append([word[i], out if i == p else (), new])
            path.append(new)
        path[-1].final = True
        previous = word
    for i in range(len(previous), 0, -1):
        path[i - 1].arcs[-1][2] = settle(path[i])
    settle(path[0])
    return states


def compile_lexicon(words: list[bytes], vocab: Vocabulary) -> bytes:
    """The transducer of the words as one file: a header of five lengths, then arrays.

    Arcs lie in an open hash table by state and byte; outputs are numbered, 0 is the empty one.
    """
    states = minimal_transducer((w, vocab.merge(w)) for w in sorted(set(words)) if w)
    outs: dict[tuple, int] = {(): 0}
    arcs = [(s.number << 8 | b, t.number, outs.setdefault(o, len(outs))) for s in states for b, o, t in s.arcs]
    tails = [outs.setdefault(s.tail, len(outs)) if s.final else -1 for s in states]
    key, target, ref = np.array(arcs, np.int64).reshape(-1, 3).T
    bits, keys, slot = hash_table(key)
    place = np.zeros((2, 1 << bits), np.int32)
    place[:, slot] = target, ref
    flat = np.array([t for o in outs for t in o], np.int32)
    cuts = np.cumsum([0, *map(len, outs)]).astype(np.int64)
    head = np.array([bits, len(states), len(outs), len(flat), states[-1].number], np.int64)
    return b"".join(a.tobytes() for a in (head, keys, cuts, place, np.array(tails, np.int32), flat))


class Lexicon:
    """A compiled transducer, memory-mapped. The memory file has no name, so nothing is left behind on a machine."""

    def __init__(self, blob: bytes):
        file = os.memfd_create("lexicon")
        try:
            with os.fdopen(file, "wb") as f:
                f.write(blob)
                f.flush()
                self.map = mmap.mmap(f.fileno(), len(blob), access=mmap.ACCESS_READ)
        except OSError:  # pragma: no cover
            self.map = blob
        at = 0

        def take(n: int, dtype):
            nonlocal at
            out = np.frombuffer(self.map, dtype, n, at)
            at += out.nbytes
            return out

        self.bits, n_states, n_outs, n_ids, self.start = take(5, np.int64).tolist()
        self.keys, self.cuts = take(1 << self.bits, np.int64), take(n_outs + 1, np.int64)
        self.target, self.ref = take(1 << self.bits, np.int32), take(1 << self.bits, np.int32)
        self.tails, self.flat = take(n_states, np.int32), take(n_ids, np.int32)

    def walk(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, emits: np.ndarray) -> np.ndarray:
        """Writes into ``emits`` the number of the output at 2 x its byte (2 x end - 1 for that of a last state); returns the words not accepted."""
        word, state, at = np.arange(len(starts)), np.full(len(starts), self.start, np.int64), starts.copy()
        lost = []
        while len(word):
            slot, ok = probe(self.keys, self.bits, state << 8 | raw[at])
            lost.append(word[~ok])
            word, at, slot = word[ok], at[ok], slot[ok]
            state = self.target[slot].astype(np.int64)
            emits[2 * at] = self.ref[slot]
            at = at + 1
            done = at == ends[word]
            tail = self.tails[state[done]]
            lost.append(word[done][tail < 0])
            emits[2 * at[done] - 1] = np.maximum(tail, 0)
            word, at, state = word[~done], at[~done], state[~done]
        return np.sort(np.concatenate(lost)) if lost else np.zeros(0, np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)


# ---------------------------------------------------------------- encoding


class Encoder:
    def __init__(self, blob: bytes, path: str):
        self.vocab, self.lexicon = vocabulary(path), Lexicon(blob)

    def part(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all rows and n + 1 offsets of rows into them."""
        starts, ends, found = split_words(raw, offs, self.vocab.finder)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        emits = np.zeros(2 * len(raw) + 1, np.int32)
        lost = self.lexicon.walk(raw, starts, ends, emits)
        if found:
            lost = np.union1d(lost, np.searchsorted(starts, [a for a, _ in found]))
        emits[ragged(2 * starts[lost], 2 * (ends - starts)[lost])] = 0
        own, special = len(self.lexicon.cuts) - 1, dict(found)
        length = (ends - starts)[lost]
        alone = (length > LONGEST) | np.isin(starts[lost], list(special))
        few, many = lost[alone], lost[~alone]
        ids, n = self.vocab.merge_many(raw[ragged(starts[many], length[~alone])], length[~alone])
        more = [(self.vocab.special[special[a]],) if a in special else self.vocab.merge(raw[a:b].tobytes()) for a, b in zip(starts[few].tolist(), ends[few].tolist(), strict=True)]
        emits[2 * ends[np.concatenate((many, few))] - 1] = own + np.arange(len(lost))
        n = np.concatenate((n, np.array([len(m) for m in more], np.int64)))
        at = np.flatnonzero(emits)
        ref = emits[at]
        cuts = np.concatenate((self.lexicon.cuts, self.lexicon.cuts[-1] + np.cumsum(n)))
        flat = np.concatenate((self.lexicon.flat, ids, np.array([t for m in more for t in m], np.int64)))
        length = cuts[ref + 1] - cuts[ref]
        upto = np.concatenate(([0], np.cumsum(length)))
        return flat[ragged(cuts[ref], length)].astype(np.uint32), upto[np.searchsorted(at, 2 * offs)]

    def row(self, raw: np.ndarray) -> np.ndarray:
        """Token ids of one long text, taken in parts cut before a blank between two letters, where a word surely begins."""
        out, a = [], 0
        while a < len(raw):
            b = a + PART
            while b < len(raw):
                w = raw[b - 1 : b + PART + 1]
                low = (w | 32) - ord("a") < 26
                cut = np.flatnonzero(low[:-2] & (w[1:-1] == 32) & low[2:])
                if len(cut):
                    b += int(cut[0])
                    break
                b += PART
            out.append(self.part(raw[a:b], np.array([0, min(b, len(raw)) - a]))[0])
            a = b
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _encoder(blob, path: str):
    def encode(batches):
        e = Encoder(blob.value, path)
        for batch in slices(batches, "text", PART):
            raw, offs = text_bytes(batch.column(1))
            if batch.num_rows == 1 and len(raw) > 2 * PART:
                ids = e.row(raw)
                cuts = np.array([0, len(ids)])
            else:
                ids, cuts = e.part(raw, offs)
            cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((4 * cuts).astype(np.int64).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(cuts)), cells.cast(pa.binary())], ["doc_id", "n_tokens", "ids"])

    return encode


def _counter(path: str):
    """Of each task its words of at most LONGEST bytes with their counts."""

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in held.values()], pa.binary()), pa.array([n for _, n in held.values()], pa.int64())], ["word", "n"])

    def count(batches):
        finder, held = vocabulary(path).finder, {}
        for batch in slices(batches, "text", PART):
            raw, offs = text_bytes(batch.column(0))
            starts, ends, _ = split_words(raw, offs, finder)
            fit = ends - starts <= LONGEST
            starts, ends = starts[fit], ends[fit]
            h, at, n = np.unique(span_hashes(raw, starts, ends), return_index=True, return_counts=True)
            text = raw.tobytes()
            for k, a, b, c in zip(h.tolist(), starts[at].tolist(), ends[at].tolist(), n.tolist(), strict=True):
                old = held.get(k)
                held[k] = (text[a:b], c) if old is None else (old[0], old[1] + c)
            if len(held) >= COUNTED:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    return count


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """word (binary), n: how often the words of at most LONGEST bytes stand in all texts."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_counter(path), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, path: str, most: int = LEXICON) -> bytes:
    """The compiled transducer of the ``most`` most frequent words, built in one task; at most ``most`` words of LONGEST bytes."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"blob": [compile_lexicon([bytes(w) for w in pdf["word"]], vocabulary(path))]})

    top = word_counts(docs, path).orderBy(F.desc("n"), "word").limit(most)
    row = top.select("word").groupBy().applyInPandas(build, "blob binary").first()
    return bytes(row["blob"]) if row else compile_lexicon([], vocabulary(path))


def encode(docs: DataFrame, path: str, most: int = LEXICON) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every row of docs (doc_id, text).

    Ids are those of the tokenizer file at ``path``, a place every worker can read, without added
    special tokens; the strings of special tokens in a text are those tokens. A null or empty text has no ids. Any length is
    taken, in parts; repeated rows and null doc_ids are rows like any other; extra columns are ignored.
    """
    blob = docs.sparkSession.sparkContext.broadcast(lexicon(docs, path, most))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_encoder(blob, path), "doc_id long, n_tokens long, ids binary")


# ---------------------------------------------------------------- decoding


def _decoder(path: str):
    def decode(batches):
        tokens = vocabulary(path).tokens
        flat, cuts = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])
        for batch in slices(batches, "ids", 4 * PART):
            raw, offs = text_bytes(batch.column(batch.schema.get_field_index("ids")))
            ids = np.frombuffer(raw.tobytes(), "<u4").astype(np.int64)
            length = np.where(ids < len(tokens), np.diff(cuts)[np.minimum(ids, len(tokens) - 1)], 0)
            out = flat[ragged(cuts[np.minimum(ids, len(tokens) - 1)], length)].tobytes()
            at = np.concatenate(([0], np.cumsum(length)))[offs // 4].tolist()
            text = [out[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "text"])

    return decode


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and text: the tokens' bytes joined and read as UTF-8, what is none replaced by U+FFFD.

    Ids beyond the vocabulary give nothing; null ids give an empty text.
    """
    rows = encoded.select("doc_id", "n_tokens", F.coalesce("ids", F.lit(b"")).alias("ids"))
    return rows.mapInArrow(_decoder(path), "doc_id long, n_tokens long, ids binary, text string")


def round_trip(docs: DataFrame, path: str, most: int = LEXICON) -> DataFrame:
    """decode(encode(docs)) in one worker a task: doc_id, n_tokens, ids, text."""
    blob = docs.sparkSession.sparkContext.broadcast(lexicon(docs, path, most))
    there, back = _encoder(blob, path), _decoder(path)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lambda batches: back(there(batches)), "doc_id long, n_tokens long, ids binary, text string")
