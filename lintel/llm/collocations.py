"""Phrase collocations by vertical partitioning of a depth-truncated suffix tree.

Texts become runs of word numbers. Words are counted over all runs, and where a word is rare a run is cut, for no
frequent phrase can hold it. Prefixes of two words are counted next; rare ones go, and one that stands more often
than the memory budget allows is made longer by a word, and again, until each is within the budget. The
prefixes left are put into groups within the budget. Each run then sends every group the sorted, front-coded
suffixes that begin with its prefixes, cut at the depth or before the first rare word or pair, with their counts.
A group merges them into its subtrees on its own and reads each phrase's frequency from the leaf totals
under its node. Scores, the containment rule and ranks are joins and windows over the frequent phrases.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.bpe_lexicon import ragged
from lintel.llm.common import LOWER, cut, mix, slices, span_hashes, text_bytes
from lintel.llm.runs import press, press_sorted, unpress, unpress_sorted

#: Words of the longest phrase, least frequency of a phrase, phrases reported for each lang.
DEPTH, LEAST, TOP = 5, 100, 2000
#: Suffixes that a group of prefixes holds at most, and words of a run.
BUDGET, RUN_WORDS = 1 << 20, 1 << 21

#: What ends a piece, and what parts words inside one.
_STOP = np.zeros(256, bool)
_STOP[[46, 44, 59, 58, 33, 63, 10, 11, 12, 13]] = True
_GAP = np.zeros(256, bool)
_GAP[[32, 9]] = True

RUN_SCHEMA = "run long, lang string, n long, lengths binary, words binary, seq binary"
CUT_SCHEMA = "run long, lang string, hashes binary, seq binary, lengths binary, words binary"


# ---------------------------------------------------------------- runs of word numbers


def piece_words(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word, and whether it begins a piece. low: bytes, lower-cased."""
    if not len(low):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, bool)
    stop = _STOP[low]
    ink = ~(stop | _GAP[low])
    edge = np.zeros(len(low) + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(ink & (~np.concatenate(([False], ink[:-1])) | edge[:-1]))
    ends = np.flatnonzero(ink & (~np.concatenate((ink[1:], [False])) | edge[1:])) + 1
    rows = np.searchsorted(offs, starts, side="right") - 1
    stops = np.concatenate(([0], np.cumsum(stop)))
    first = np.ones(len(starts), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (stops[starts[1:]] != stops[ends[:-1]])
    return starts, ends, rows, first


def with_lang(h: np.ndarray, lang: str) -> np.ndarray:
    """Hashes of a lang's words; 0 stands for none."""
    seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    return np.maximum(mix(h + seed), np.uint64(1))


class _Pile:
    """Words of one lang that wait to become a run: hashes, 0 between pieces, and each slice's different words."""

    def __init__(self, lang: str):
        self.lang, self.n, self.seq, self.words = lang, 0, [], []

    def add(self, low, starts, ends, first, h):
        h = with_lang(h, self.lang)
        seq = np.zeros(len(h) + int(first.sum()), np.uint64)
        seq[np.arange(len(h)) + np.cumsum(first)] = h
        self.seq.append(seq)
        each, at = np.unique(h, return_index=True)
        length = (ends - starts)[at]
        self.words.append((each, length, low[ragged(starts[at], length)]))
        self.n += len(h)

    def run(self, number: int) -> pa.RecordBatch:
        every = np.concatenate([w[0] for w in self.words])
        length, text = np.concatenate([w[1] for w in self.words]), np.concatenate([w[2] for w in self.words])
        each, at = np.unique(every, return_index=True)
        seq = np.concatenate(self.seq)
        place = np.searchsorted(each, seq[seq > 0])
        # numbered by how often they stand, so the numbers are small
        often = np.argsort(-np.bincount(place, minlength=len(each)), kind="stable")
        rank = np.empty(len(each), np.int32)
        rank[often] = np.arange(len(each), dtype=np.int32)
        at, words = at[often], rank[place]
        begin = (np.cumsum(length) - length)[at]
        seq = np.full(len(seq), -1, np.int32)
        seq[np.concatenate(self.seq) > 0] = words
        cells = (press(length[at].astype(np.int32)), zstandard.compress(text[ragged(begin, length[at])].tobytes(), 3), press(seq))
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([self.lang]), pa.array([self.n]), *[pa.array([c], pa.binary()) for c in cells]], [f.split()[0] for f in RUN_SCHEMA.split(", ")])


def _gather(most: int):
    def gather(batches):
        task, made, piles = TaskContext.get().partitionId(), 0, {}
        for batch in slices(batches, "text"):
            raw, offs = text_bytes(batch.column(1))
            low = LOWER[raw]
            starts, ends, rows, first = piece_words(low, offs)
            if not len(starts):
                continue
            h = span_hashes(low, starts, ends)
            langs = batch.column(0).dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)[rows]
            for c, lang in enumerate(langs.dictionary.to_pylist()):
                mine = np.flatnonzero(code == c)
                if len(mine):
                    piles.setdefault(lang, _Pile(lang)).add(low, starts[mine], ends[mine], first[mine], h[mine])
            while sum(p.n for p in piles.values()) >= most:
                full = max(piles.values(), key=lambda p: p.n)
                yield piles.pop(full.lang).run((task << 24) + made)
                made += 1
        for pile in piles.values():
            yield pile.run((task << 24) + made)
            made += 1

    return gather


def _text(row) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Hashes, n + 1 offsets and bytes of the words a row spells."""
    length = unpress(row["lengths"], np.int32)
    cuts = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))
    text = zstandard.decompress(row["words"]) if len(length) else b""
    return with_lang(span_hashes(np.frombuffer(text, np.uint8), cuts[:-1], cuts[1:]), row["lang"]), cuts, text


class _CutRun:
    """A run cut at rare words: hashes of its words, their numbers in order (-1 at cuts), and groups of its prefixes as far as they are told."""

    def __init__(self, row, answers=()):
        self.hashes, self.seq = unpress(row["hashes"], np.uint64), np.append(unpress(row["seq"], np.int32).astype(np.int64), np.full(DEPTH, -1))
        told = {}
        for a in answers:
            told.setdefault(a["level"], []).append((unpress_sorted(a["keys"]), unpress(a["groups"], np.int64)))
        self.told = {}
        for level, parts in told.items():
            keys, groups = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(keys)
            self.told[level] = keys[order], groups[order]

    def group_of(self, level: int, keys: np.ndarray) -> np.ndarray:
        """Group of each prefix; -1 where it must be longer, -2 where it is rare."""
        known, groups = self.told.get(level, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        if not len(known):
            return np.full(len(keys), -2)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, groups[at], -2)

    def prefixes(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places where a prefix of ``level`` words is to be counted, as the one of a word less must be longer; its key; and its group."""
        at = np.flatnonzero((self.seq[:-1] >= 0) & (self.seq[1:] >= 0))
        keys = self.hashes[self.seq[at]]
        for d in range(1, level):
            if d > 1:
                at, keys = at[group == -1], keys[group == -1]  # noqa: F821
            more = self.seq[at + d] >= 0
            at, keys = at[more], longer(keys[more], self.hashes[self.seq[at[more] + d]])
            group = self.group_of(d + 1, keys)
        return at, keys, group


def longer(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of prefixes one word longer."""
    return mix(keys * np.uint64(0x9E3779B97F4A7C15) + words)


# ---------------------------------------------------------------- vertical partitioning


def _by_bucket(row, buckets: int, keys, counts):
    """Rows of a run's sorted keys with counts, by bucket."""
    cuts = [0, *np.searchsorted(keys, np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)), len(keys)]
    rows = [(row["lang"], b, row["run"], press_sorted(keys[i:j]), press(counts[i:j].astype(np.int64))) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
    return pd.DataFrame(rows, columns=["lang", "bucket", "run", "keys", "counts"])


OFFERS = "lang string, bucket long, run long, keys binary, counts binary"


def _word_offers(buckets: int):
    def offer(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                seq, keys = unpress(row["seq"], np.int32), _text(row)[0]
                order = np.argsort(keys)
                yield _by_bucket(row, buckets, keys[order], np.bincount(seq[seq >= 0], minlength=len(keys))[order])

    return offer


def _prefix_offers(level: int, buckets: int):
    def offer(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                r = _CutRun(row, row["answers"] if level > 2 else ())
                yield _by_bucket(row, buckets, *np.unique(r.prefixes(level)[1], return_counts=True))

    return offer


def pack(totals: np.ndarray, budget: int) -> np.ndarray:
    """Bin of each total, none above the budget unless by a single total: largest first, a new bin when the next does not fit."""
    out, bin_, load = np.zeros(len(totals), np.int64), 0, 0
    for i in np.argsort(-totals, kind="stable").tolist():
        t = int(totals[i])
        if load and load + t > budget:
            bin_, load = bin_ + 1, 0
        out[i], load = bin_, load + t
    return out


def _settle(level: int, least: int, budget: int, depth: int):
    """Of one bucket, for each run what becomes of the frequent ones among its words or prefixes; and how often each word stands (run null).

    Of a word ``groups`` tells whether the run is the one to spell it (1, else 0); of a prefix its group, or -1 where
    it must be made longer or is of full depth.
    """

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpress_sorted(k) for k in pdf["keys"]]
        each, at, where = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        totals = np.bincount(where, np.concatenate([unpress(c, np.int64) for c in pdf["counts"]])).astype(np.int64)
        keep, group, spells = totals >= least, np.full(len(each), -1), np.zeros(len(where), np.int64)
        fits = keep & (totals <= budget)
        group[fits] = (level << 56) + (int(pdf["bucket"].iloc[0]) << 28) + pack(totals[fits], budget) if level < depth else -1
        spells[at] = 1
        lang, rows, upto = pdf["lang"].iloc[0], [], 0
        if level == 1:
            rows += [(lang, None, level, None, None, False, w, f) for w, f in zip(each[keep].view(np.int64).tolist(), totals[keep].tolist(), strict=True)]
        for run, p in zip(pdf["run"], parts, strict=True):
            here = where[upto : upto + len(p)]
            g, mine = spells[upto : upto + len(p)] if level == 1 else group[here], keep[here]
            upto += len(p)
            if mine.any():
                rows.append((lang, int(run), level, press_sorted(p[mine]), press(g[mine]), bool((g[mine] == -1).any()), None, 0))
        return pd.DataFrame(rows, columns=["lang", "run", "level", "keys", "groups", "open", "word", "f"], dtype=object)

    return settle


SETTLED = "lang string, run long, level int, keys binary, groups binary, open boolean, word long, f long"


def _cut_runs(batches):
    """Runs cut at their rare words, with the text of the words they are to spell."""
    for pdf in batches:
        out = []
        for _, row in pdf.iterrows():
            keys, cuts, text = _text(row)
            seq = unpress(row["seq"], np.int32)
            known, spells = (np.concatenate(c) for c in zip(*[(unpress_sorted(a["keys"]), unpress(a["groups"], np.int64)) for a in row["answers"]], strict=True))
            order = np.argsort(keys)
            at = order[np.searchsorted(keys[order], known)]
            number = np.full(len(keys) + 1, -1, np.int32)
            number[np.sort(at)] = np.arange(len(at))
            seq = number[seq]  # -1 stays -1
            seq = seq[(seq >= 0) | np.concatenate(([True], seq[:-1] >= 0))]
            mine = np.sort(at[spells == 1])
            length = np.diff(cuts)[mine]
            spelt = np.frombuffer(text, np.uint8)[ragged(cuts[mine], length)].tobytes()
            out.append((row["run"], row["lang"], press(keys[np.sort(at)]), press(seq), press(length.astype(np.int32)), zstandard.compress(spelt, 3)))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in CUT_SCHEMA.split(", ")])


# ---------------------------------------------------------------- subtrees


def front_code(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows of a matrix: columns shared with the row before, and the entries of the others."""
    same = np.zeros(rows.shape, bool)
    same[1:] = np.logical_and.accumulate(rows[1:] == rows[:-1], axis=1)
    return same.sum(1).astype(np.uint8), rows[~same]


def front_decode(shared: np.ndarray, entries: np.ndarray, depth: int) -> np.ndarray:
    new = np.arange(depth)[None, :] >= shared[:, None]
    rows = np.zeros((len(shared), depth), entries.dtype)
    rows[new] = entries
    last = np.maximum.accumulate(np.where(new, np.arange(len(shared))[:, None], 0), axis=0)
    return np.take_along_axis(rows, last, axis=0)


def order_rows(columns: list[np.ndarray], most: int) -> np.ndarray:
    """The order of rows of numbers from 0 to ``most`` by their columns."""
    bits = max(1, int(most).bit_length())
    keys = []
    for i in range(0, len(columns), 63 // bits):
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns[i : i + 63 // bits]:
            key = key << bits | c
        keys.append(key)
    return np.lexsort(keys[::-1])


def _suffixes(depth: int, buckets: int):
    """Of each run the suffixes of every group: their words, front-coded, and counts.

    A prefix that was made longer, or has full depth, goes by itself to a group that only counts such.
    """

    def cut_suffixes(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                r = _CutRun(row, row["answers"])
                joins, at, mine, limit = np.zeros(len(r.seq), bool), [], [], []
                for level in range(2, depth + 1):
                    places, keys, found = r.prefixes(level)
                    if level == 2:
                        joins[places] = found > -2
                    alone = (keys % np.uint64(buckets)).astype(np.int64) + (level << 56) + (1 << 55)
                    keep = found > -2
                    at.append(places[keep])
                    mine.append(np.where(found < 0, alone, found)[keep])
                    limit.append(np.where(found < 0, level, depth)[keep])
                at, mine, limit = np.concatenate(at), np.concatenate(mine), np.concatenate(limit)
                if not len(at):
                    continue
                columns, alive = [], np.ones(len(at), bool)
                for d in range(depth):
                    if d:
                        alive = alive & joins[at + d - 1] & (d < limit)
                    columns.append(np.where(alive, r.seq[at + d] + 1, 0))
                groups, g = np.unique(mine, return_inverse=True)
                order = order_rows([g, *columns], max(len(groups), len(r.hashes) + 1))
                rows, g = np.stack(columns, 1)[order], g[order]
                new = np.concatenate(([True], (g[1:] != g[:-1]) | (rows[1:] != rows[:-1]).any(1)))
                counts = np.diff(np.append(np.flatnonzero(new), len(new)))
                rows, g = rows[new], g[new]
                cuts, out = [*np.searchsorted(g, np.arange(len(groups))), len(g)], []
                for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    shared, entries = front_code(rows[i:j])
                    each, ids = np.unique(entries, return_inverse=True)
                    table = np.where(each > 0, r.hashes[np.maximum(each, 1) - 1], np.uint64(0))
                    out.append((row["lang"], int(groups[k]), press(table), press(shared), press(ids.astype(np.uint32)), press(counts[i:j].astype(np.uint32))))
                    if len(out) == 64:
                        yield pd.DataFrame(out, columns=["lang", "grp", "words", "shared", "ids", "counts"])
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=["lang", "grp", "words", "shared", "ids", "counts"])

    return cut_suffixes


def _subtree(least: int, depth: int):
    """Frequent phrases of one group: nodes of the merged subtree from its prefixes on, each with the total of the leaves under it."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        level = int(pdf["grp"].iloc[0]) >> 56
        tables = [unpress(w, np.uint64) for w in pdf["words"]]
        each, where = np.unique(np.concatenate([np.zeros(1, np.uint64), *tables]), return_inverse=True)
        rows, counts, upto = [], [], 1
        for t, shared, ids, n in zip(tables, pdf["shared"], pdf["ids"], pdf["counts"], strict=True):
            local = where[upto : upto + len(t)]
            upto += len(t)
            rows.append(front_decode(unpress(shared, np.uint8), local[unpress(ids, np.uint32)], depth))
            counts.append(unpress(n, np.uint32).astype(np.int64))
        rows, counts = np.concatenate(rows), np.concatenate(counts)
        order = order_rows(list(rows.T), len(each))
        rows, counts = rows[order], counts[order]
        out, new = [], np.zeros(len(rows), bool)
        new[0] = True
        for d in range(depth):
            new[1:] |= rows[1:, d] != rows[:-1, d]
            if d + 1 < level:
                continue
            node = np.flatnonzero(new)
            total = np.add.reduceat(counts, node)
            keep = (rows[node, d] > 0) & (total >= least)
            out += zip(each[rows[node[keep], : d + 1]].view(np.int64).tolist(), total[keep].tolist(), strict=True)
        lang = pdf["lang"].iloc[0]
        return pd.DataFrame([(lang, p, f) for p, f in out], columns=["lang", "phrase", "f"]).astype({"phrase": object})

    return merge


# ---------------------------------------------------------------- the miner


def _spelt(batches):
    for pdf in batches:
        out = []
        for _, row in pdf.iterrows():
            keys, cuts, text = _text(row)
            out += [(h, text[a:b].decode("utf-8", "replace")) for h, a, b in zip(keys.view(np.int64).tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        yield pd.DataFrame(out, columns=["h", "word"])


def frequent_phrases(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, budget: int = BUDGET, run_words: int = RUN_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All phrases of up to ``depth`` words (at least two) that stand ``least`` times in the texts of a lang, or more often.

    Returns phrases (lang, phrase: hashes of its words, f), words (h, word) of the frequent words, and
    sizes (lang, n: all words). Words are told by 64-bit hashes with the lang in them. ``depth`` is at most DEPTH.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    runs = cut(texts.mapInArrow(_gather(run_words), RUN_SCHEMA))
    sizes = runs.groupBy("lang").agg(F.sum("n").alias("n"))
    total = runs.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // budget))
    settle = lambda offers, level: cut(offers.groupBy("lang", "bucket").applyInPandas(_settle(level, least, budget, depth), SETTLED))
    # a run's answers hold no more than its own words and prefixes
    told = lambda settled: settled.where("run IS NOT NULL").groupBy("run").agg(F.collect_list(F.struct("level", "keys", "groups")).alias("answers"))
    words = settle(runs.mapInPandas(_word_offers(buckets), OFFERS), 1)
    runs = cut(runs.drop("n").join(told(words), "run").mapInPandas(_cut_runs, CUT_SCHEMA))
    bare = runs.select("run", "lang", "hashes", "seq")
    found, own = None, bare
    for level in range(2, depth + 1):
        settled = settle(own.mapInPandas(_prefix_offers(level, buckets), OFFERS), level)
        found = settled if found is None else found.union(settled)
        own = bare.join(told(found), "run")
        if not settled.where("open").limit(1).count():
            break
    subtrees = own.mapInPandas(_suffixes(depth, buckets), "lang string, grp long, words binary, shared binary, ids binary, counts binary").groupBy("lang", "grp")
    phrases = subtrees.applyInPandas(_subtree(least, depth), "lang string, phrase array<long>, f long")
    spelt = runs.select("lang", "lengths", "words").mapInPandas(_spelt, "h long, word string")
    single = words.where("run IS NULL").select("lang", F.array("word").alias("phrase"), "f")
    return cut(single.union(phrases)), spelt, sizes


def collocations(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, top: int = TOP, budget: int = BUDGET, run_words: int = RUN_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best ``top`` phrases of two to ``depth`` words of each lang.

    docs: lang, text; other columns are ignored. Texts are lower-cased (A-Z), null is empty, a null
    lang is ``und``. n: words of the lang; a: how often the phrase stands inside pieces; l, r: its first
    and last part at the cut of least floor(1000 a n / (l r)), the score. A phrase inside a longer one that
    stands as often goes. Ties: higher a, then the phrase by code point. Repeated rows count as often
    as they are there; an empty table, or no phrase that often, gives no rows.
    """
    phrases, words, sizes = frequent_phrases(docs, least, depth, budget, run_words)
    keyed = phrases.withColumn("key", F.xxhash64("phrase"))
    known = keyed.select("key", "f")
    size = F.size("phrase")
    cand = keyed.where(size >= 2)
    part = lambda a, b: F.xxhash64(F.slice("phrase", a, b))
    inner = cand.where(size >= 3).select("f", F.explode(F.array(part(F.lit(1), size - 1), part(F.lit(2), size - 1))).alias("key"))
    longest = inner.groupBy("key").agg(F.max("f").alias("longer"))
    left = cand.join(longest, "key", "left").where("longer IS NULL OR longer < f").drop("longer")
    cuts = left.select("lang", "key", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"lkey": F.xxhash64(F.slice("phrase", F.lit(1), F.col("k"))), "rkey": F.xxhash64(F.slice("phrase", F.col("k") + 1, size - F.col("k")))})
    cuts = cuts.join(known.select(F.col("key").alias("lkey"), F.col("f").alias("l")), "lkey").join(known.select(F.col("key").alias("rkey"), F.col("f").alias("r")), "rkey")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(sizes, "lang").withColumns({"over": whole("a") * whole("n") * F.lit(1000), "under": whole("l") * whole("r")})
    cuts = cuts.withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "key").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("s"), F.min("phrase").alias("phrase")).select("lang", "phrase", "s.*")
    ahead = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = cut(best.withColumn("place", F.rank().over(ahead)).where(F.col("place") <= top).drop("place"))
    spelt = best.select("lang", "phrase", F.posexplode("phrase").alias("i", "h")).join(words, "h")
    spelt = spelt.groupBy("lang", "phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("text"))
    out = best.join(spelt, ["lang", "phrase"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text")))
    return out.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
