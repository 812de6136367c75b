"""Exact substring de-duplication by a distributed, common-prefix-aware merge sort of suffixes.

Not every suffix is sorted. In each window of SPAN bytes the PREFIX-byte string with the least hash
is the anchor; equal windows have equal anchors at equal places, so only suffixes at anchors, with
the few bytes before them that their windows cover, can show a repeat. Runs (tens of MB of text) exchange first the hashes of
their anchors; anchors seen in one document only are dropped. The suffixes left are sorted in each
run, equal ones folded, front-coded and exchanged by anchor; a loser tree that carries
common-prefix lengths merges the runs, and those lengths tell which windows are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import _TABLE, _powers, cut, mix
from lintel.llm.runs import NONE, Run, gather, press, press_sorted, unpress, unpress_sorted

#: Bytes of a string that counts as repeated, and of an anchor.
SPAN, PREFIX = 50, 16
#: Bytes of text in a run. A task holds some forty bytes for each while it sorts and marks one.
RUN_BYTES = 12 << 20
#: Bytes that a window may have before its anchor.
BEFORE = SPAN - PREFIX


class TextRun(Run):
    """A run whose anchors can be found."""

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Places of all anchors in the run, ascending, the 48-bit hashes of their prefixes, and the bytes before and from each that its windows cover."""
        found = [(at + self.offs[a], *rest) for a, b in self.parts() for at, *rest in [anchors(self.raw[self.offs[a] : self.offs[b]], self.offs[a : b + 1] - self.offs[a])]]
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else anchors(self.raw, self.offs)


def anchors(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of the anchors of all windows that lie in one document, 48-bit hashes of the PREFIX bytes
    there, and how far the windows of each anchor reach: bytes before it, and bytes from it on."""
    if len(raw) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * up[:-1], out=sums[1:])
    h = mix((sums[PREFIX:] - sums[:-PREFIX]) * down[: len(raw) - PREFIX + 1])
    shift = max(20, int(len(raw)).bit_length())
    low = np.uint64((1 << shift) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # least hash, leftmost of equal ones
    width = 1
    while width * 2 <= BEFORE + 1:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if rest := BEFORE + 1 - width:
        m = np.minimum(m[:-rest], m[rest:])
    starts = np.arange(len(m))
    inside = starts + SPAN <= np.repeat(offs[1:], np.diff(offs))[: len(m)]
    at, windows = (m[inside] & low).astype(np.int64), starts[inside]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    at = at[first]
    reach = (at - windows[first]).astype(np.uint8), (windows[last] + SPAN - at).astype(np.uint8)
    return at, mix(h[at] + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16), *reach  # least hashes are small; spread them again


def _edges(buckets: int) -> np.ndarray:
    return np.array([(i << 48) // buckets for i in range(1, buckets)], np.uint64)


def _offers(buckets: int):
    """Each run's distinct anchor hashes by bucket, with a mark where the run has them in two documents."""

    def offer(batches):
        for batch in batches:
            for run, ids, sizes, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = TextRun(ids, sizes, text)
                at, h, _, _ = r.anchors()
                doc = r.ids[r.docs(at)]
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
                last = np.concatenate((first[1:], [len(h)])) - 1 if len(h) else first
                hashes, many = h[first], doc[first] != doc[last]
                cuts = [0, *np.searchsorted(hashes, _edges(buckets)), len(hashes)]
                rows = [(b, run, press_sorted(hashes[i:j]), np.packbits(many[i:j]).tobytes()) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "run", "hashes", "many"])

    return offer


def _survivors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: for each run, its hashes that stand in more than one document."""
    parts = [unpress_sorted(b) for b in pdf["hashes"]]
    marks = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(p)).astype(bool) for b, p in zip(pdf["many"], parts, strict=True)]
    every = np.concatenate(parts)
    values, counts = np.unique(every, return_counts=True)
    stay = counts > 1
    stay[np.searchsorted(values, every[np.concatenate(marks)])] = True
    rows = [(int(run), press_sorted(kept)) for run, p in zip(pdf["run"], parts, strict=True) if len(kept := p[stay[np.searchsorted(values, p)]])]
    return pd.DataFrame(rows, columns=["run", "kept"])


# ---------------------------------------------------------------- suffixes of a run


class Suffixes:
    """The distinct suffixes of a run at surviving anchors, in order of (bucket, right bytes, left bytes)."""

    def __init__(self, r: TextRun, kept: list[bytes], buckets: int):
        at, h, before, onward = r.anchors()
        good = np.sort(np.concatenate([unpress_sorted(b) for b in kept])) if kept else np.zeros(0, np.uint64)
        if len(good):
            i = np.minimum(np.searchsorted(good, h), len(good) - 1)
            stay = good[i] == h
        else:
            stay = np.zeros(len(h), bool)
        at, h, self.left_len, self.right_len = at[stay], h[stay], before[stay], onward[stay]
        doc = r.docs(at)
        bucket = np.searchsorted(_edges(buckets), h, side="right")
        padded = np.concatenate((np.zeros(BEFORE, np.uint8), r.raw, np.zeros(SPAN, np.uint8)))
        key = np.empty((len(at), SPAN + BEFORE + 2), np.uint8)
        for lo in range(0, len(at), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            view = padded[at[part, None] + np.arange(BEFORE + SPAN)]
            right = view[:, BEFORE:]
            right[np.arange(SPAN) >= self.right_len[part, None]] = 0
            left = view[:, :BEFORE][:, ::-1]
            left = np.where(np.arange(BEFORE) < self.left_len[part, None], left, 0)
            key[part, :SPAN], key[part, SPAN : SPAN + BEFORE] = right, left
        key[:, -2], key[:, -1] = self.right_len, self.left_len
        words = np.concatenate((key, np.zeros((len(key), -key.shape[1] % 8), np.uint8)), 1).view(">u8").astype(np.uint64)
        order = np.lexsort((*words.T[::-1], bucket))
        words, bucket, key = words[order], bucket[order].astype(np.int32), key[order]
        new = np.ones(len(key), bool)
        new[1:] = (words[1:] != words[:-1]).any(1) | (bucket[1:] != bucket[:-1])
        self.entry = np.cumsum(new) - 1  # of each place, in sorted order
        self.places, self.doc = at[order], doc[order]
        self.key, self.bucket = key[new], bucket[new]
        del words, key, padded
        first = np.flatnonzero(new)
        ids = r.order[self.doc]
        self.least = np.minimum.reduceat(ids, first) if len(first) else np.zeros(0, np.int64)
        self.most = np.maximum.reduceat(ids, first) if len(first) else np.zeros(0, np.int64)


def front_code(strings: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Common-prefix length of each sorted row with the row before, and what follows those prefixes."""
    if not len(strings):
        return np.zeros(0, np.uint8), b""
    differ = np.ones(strings.shape, bool)
    differ[1:] = strings[1:] != strings[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), strings.shape[1]).astype(np.uint8)
    lcp[0] = 0
    return lcp, strings[np.arange(strings.shape[1]) >= lcp[:, None]].tobytes()


def front_decode(lcp: np.ndarray, rest: bytes, width: int) -> np.ndarray:
    """The rows again: each byte comes from the last row that spelt its column out."""
    spelt = np.arange(width) >= lcp[:, None]
    place = np.cumsum(spelt.ravel()).reshape(spelt.shape) - 1
    row = np.where(spelt, place, -1)
    np.maximum.accumulate(row, axis=0, out=row)
    return np.frombuffer(rest, np.uint8)[row]


def _sorted_runs(buckets: int):
    def send(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                s = Suffixes(TextRun(row.ids, row.sizes, row.text), list(row.kept), buckets)
                cuts = np.concatenate(([0], np.searchsorted(s.bucket, np.arange(buckets), side="right")))
                out = []
                for b in np.flatnonzero(np.diff(cuts)):
                    part = slice(cuts[b], cuts[b + 1])
                    lcp, rest = front_code(s.key[part, :SPAN])
                    left_lcp, left = front_code(s.key[part, SPAN : SPAN + BEFORE])
                    out.append((int(b), row.run, int(cuts[b]), press(lcp), zstandard.compress(rest, 3), press(left_lcp), zstandard.compress(left, 3), press(np.ascontiguousarray(s.key[part, -2:])), press(s.least[part]), press(s.most[part] - s.least[part])))
                yield pd.DataFrame(out, columns=["bucket", "run", "base", "lcp", "rest", "left_lcp", "left", "lens", "least", "more"])

    return send


# ---------------------------------------------------------------- merging


_TAIL = [(1 << (8 * (SPAN - n))) - 1 for n in range(SPAN + 1)]


def merge(runs: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges sorted runs of (strings as big-endian numbers of SPAN bytes, common-prefix lengths within the run).

    Returns run, place in it and common-prefix length with the string before, in merged order. A
    loser tree: a contender's length is that with the last winner, so the longer one is the smaller
    string unseen, and only equal lengths compare bytes, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    end = 1 << (8 * SPAN)
    strings = [r[0] for r in runs] + [[]] * (size - len(runs))
    inner = [r[1] for r in runs] + [[]] * (size - len(runs))
    at = [0] * size
    value = [s[0] if s else end for s in strings]
    same = [0 if s else -1 for s in strings]  # an empty run loses to every other
    tree = [0] * size

    def winner(node: int) -> int:
        if node >= size:
            return node - size
        a, b = winner(2 * node), winner(2 * node + 1)
        w, lost = play(a, b)
        tree[node] = lost
        return w

    def play(a: int, b: int) -> tuple[int, int]:
        la, lb = same[a], same[b]
        if la > lb:
            return a, b
        if lb > la:
            return b, a
        if la < 0:
            return a, b
        mask = _TAIL[la]
        x, y = value[a] & mask, value[b] & mask
        n = SPAN - ((x ^ y).bit_length() + 7) // 8  # common prefix of the two
        if x <= y:
            same[b] = n
            return a, b
        same[a] = n
        return b, a

    top = winner(1) if size > 1 else 0
    total = sum(map(len, strings))
    out_run, out_at, out_lcp = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.uint8)
    for k in range(total):
        i = at[top]
        out_run[k], out_at[k], out_lcp[k] = top, i, same[top]
        own = strings[top]
        i += 1
        at[top] = i
        if i < len(own):
            value[top], same[top] = own[i], inner[top][i]
        else:
            same[top] = -1
        node = (top + size) >> 1
        while node:
            other = tree[node]
            la, lb = same[top], same[other]
            if lb > la:
                tree[node], top = top, other
            elif la == lb >= 0:
                w, lost = play(top, other)
                tree[node], top = lost, w
            node >>= 1
    return out_run, out_at, out_lcp


def _judge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: for each run, stretches of windows of its suffixes with the least document that holds them."""
    pieces, lists = [], []
    for row in pdf.itertuples(index=False):
        lcp = unpress(row.lcp, np.uint8)
        right = front_decode(lcp, zstandard.decompress(row.rest), SPAN)
        left = front_decode(unpress(row.left_lcp, np.uint8), zstandard.decompress(row.left), BEFORE)
        lens = unpress(row.lens, "V2").view(np.uint8).reshape(-1, 2)
        least = unpress(row.least, np.int64)
        pieces.append((left, lens, least, least + unpress(row.more, np.int64)))
        flat = right.tobytes()
        lists.append(([int.from_bytes(flat[i : i + SPAN]) for i in range(0, len(flat), SPAN)], lcp.tolist()))
    run, at, lcp = merge(lists)
    start = np.cumsum([0, *(len(p[1]) for p in pieces)])[:-1]
    order = start[run] + at
    left, lens, least, most = (np.concatenate(c)[order] for c in zip(*pieces, strict=True))
    right_len, left_len = lens[:, 0].astype(int), lens[:, 1].astype(int)
    if len(lcp):
        lcp[0] = 0
    best = np.full((len(order), BEFORE + 1), 2**63 - 1)
    # suffixes that share a prefix with no other and have one least and most document cannot matter
    group = np.cumsum(lcp < PREFIX)
    group_least, group_most = np.full(group.max() + 1 if len(group) else 1, 2**63 - 1), np.full(group.max() + 1 if len(group) else 1, NONE)
    np.minimum.at(group_least, group, least)
    np.maximum.at(group_most, group, most)
    live = group_least[group] < group_most[group]
    digest = np.zeros(len(order), np.uint64)
    for o in range(BEFORE + 1):  # windows that begin o bytes before the anchor
        if o:
            digest = mix(digest * np.uint64(0x9E3779B97F4A7C15) + left[:, o - 1] + np.uint64(1))
        ok = np.flatnonzero(live & (left_len >= o) & (right_len >= SPAN - o))
        if not len(ok):
            continue
        name = mix(np.cumsum(lcp < SPAN - o).astype(np.uint64)[ok] * np.uint64(0xD6E8FEB86659FD93) ^ digest[ok])
        by = np.argsort(name, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], name[by][1:] != name[by][:-1])))
        lowest = np.minimum.reduceat(least[ok][by], first)
        best[ok[by], o] = np.repeat(lowest, np.diff(np.append(first, len(by))))
    use = best < most[:, None]
    # runs of windows with one least document
    begins = use & np.concatenate((np.ones((len(use), 1), bool), (best[:, 1:] != best[:, :-1]) | ~use[:, :-1]), 1)
    ends = use & np.concatenate(((best[:, 1:] != best[:, :-1]) | ~use[:, 1:], np.ones((len(use), 1), bool)), 1)
    (i, lo), (_, hi) = np.nonzero(begins), np.nonzero(ends)
    entry = pdf["base"].to_numpy()[run[i]] + at[i] if len(i) else i
    rows = []
    for k, name in enumerate(pdf["run"]):
        mine = np.flatnonzero(run[i] == k)
        if len(mine):
            mine = mine[np.argsort(entry[mine], kind="stable")]
            rows.append((int(name), press(entry[mine].astype(np.int64)), press(np.stack((lo[mine], hi[mine]), 1).astype(np.uint8)), press(best[i[mine], lo[mine]])))
    return pd.DataFrame(rows, columns=["run", "entry", "reach", "least"])


def _removed(buckets: int, texts: bool):
    def remove(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                r = TextRun(row.ids, row.sizes, row.text)
                s = Suffixes(r, list(row.kept) if row.kept is not None else [], buckets)
                first = np.searchsorted(s.entry, np.arange(len(s.key) + 1))
                cover = np.zeros(len(r.raw) + 1, np.int32)
                for verdict in row.verdicts if row.verdicts is not None else []:
                    entry, least = unpress(verdict["entry"], np.int64), unpress(verdict["least"], np.int64)
                    reach = unpress(verdict["reach"], "V2").view(np.uint8).reshape(-1, 2).astype(np.int64)
                    n = first[entry + 1] - first[entry]
                    which = np.repeat(np.arange(len(entry)), n)
                    place = np.repeat(first[entry] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    hit = r.order[s.doc[place]] > least[which]
                    place, which = s.places[place[hit]], which[hit]
                    np.add.at(cover, place - reach[which, 1], 1)
                    np.add.at(cover, place - reach[which, 0] + SPAN, -1)
                gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
                del cover
                opens = gone & ~np.concatenate(([False], gone[:-1]))
                opens[r.offs[:-1][r.offs[:-1] < len(gone)]] = gone[r.offs[:-1][r.offs[:-1] < len(gone)]]
                n_gone, n_open = (np.concatenate(([0], np.cumsum([x[a:b].sum() for a, b in zip(r.offs[:-1], r.offs[1:], strict=True)], dtype=np.int64))) for x in (gone, opens))
                kept_bytes = r.raw[~gone].tobytes()
                to = r.offs - n_gone
                kept = [kept_bytes[a:b] for a, b in zip(to[:-1], to[1:], strict=True)]
                out = {
                    "doc_id": pd.array(r.ids, "Int64"), "n_bytes": np.diff(r.offs), "n_removed": np.diff(n_gone), "n_spans": np.diff(n_open), "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
                }
                out["doc_id"][r.ids == NONE] = pd.NA
                if texts:
                    out["kept"] = kept
                yield pd.DataFrame(out)

    return remove


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs (doc_id, text); with texts also the kept bytes.

    A byte goes when a string of SPAN bytes over it also starts in a document of smaller doc_id.
    Rows of one doc_id do not remove from each other; a null doc_id counts as the largest. Null and
    empty texts have no bytes, texts below SPAN bytes stay whole, very long ones are runs of their
    own. Repeated strings within one document stay. Extra columns are ignored; empty tables stay empty.
    """
    runs = cut(gather(docs, RUN_BYTES))
    buckets = max(1, -(-runs.count() // 2))
    offers = runs.mapInArrow(_offers(buckets), "bucket long, run long, hashes binary, many binary")
    kept = offers.groupBy("bucket").applyInPandas(_survivors, "run long, kept binary")
    kept = cut(kept.groupBy("run").agg(F.collect_list("kept").alias("kept")))  # of one run: no more than its own anchors
    # the lists of collected blobs come in any order; they are sorted where they are read
    sent = runs.join(kept, "run").mapInPandas(_sorted_runs(buckets), "bucket long, run long, base long, lcp binary, rest binary, left_lcp binary, left binary, lens binary, least binary, more binary")
    verdicts = sent.groupBy("bucket").applyInPandas(_judge, "run long, entry binary, reach binary, least binary")
    verdicts = cut(verdicts.groupBy("run").agg(F.collect_list(F.struct("entry", "reach", "least")).alias("verdicts")))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    return runs.join(kept, "run", "left").join(verdicts, "run", "left").mapInPandas(_removed(buckets, texts), schema)
