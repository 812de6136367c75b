"""N-gram Jaccard join: near duplicates as components of documents whose word shingles agree.

Shingles are ordered by how many sets hold them, rarest first; two sets that agree enough share one
of their rarest. Sets joined by such shingles form candidate clusters. A cluster is cut into
size-banded tiles; in a tile hashed bitmap signatures bound each overlap from above by bit counts,
and what is left is decided by intersecting the sorted shingle arrays.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import LOWER, aside, back, components, cut, mix, span_hashes, window_hashes, words
from lintel.llm.runs import Run, gather, press, press_sorted, unpress, unpress_sorted

WORDS, PERCENT = 4, 85
#: Shingles (and 64 for each set) that a tile holds; the sets of a tile are compared in one task.
TILE = 3_000_000
#: Shingles whose hash is below this take part in the counting that orders them; the others come last, by hash.
COUNTED = np.uint64(1 << 63)
ENTRY_SCHEMA = "kind int, a long, b long, n long, crc long, shingles binary"


def shingle_sets(raw: np.ndarray, offs: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a row of fewer than k words has its whole sequence, one without words nothing."""
    low = LOWER[raw]
    starts, ends, of = words(low, offs)
    h = span_hashes(low, starts, ends)
    w = window_hashes(h, k)
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(w[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(window_hashes(np.append(h[a:b], np.uint64(b - a)), b - a + 1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_name(s: np.ndarray) -> int:
    """64-bit name of a set of hashes."""
    return int(mix(np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) + np.uint64(len(s))).astype(np.int64))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Of two sets that agree enough, the first so many shingles of either, in one order, share one."""
    return n - -(-n * percent // 100) + 1


def overlap_needed(n, m, percent: int = PERCENT):
    """Least intersection with 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def _offers(buckets: int, k: int):
    """Each run's shingles below COUNTED with the number of its distinct sets that hold them, by bucket."""

    def offer(batches):
        for batch in batches:
            for run, ids, sizes, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r, seen, sets = Run(ids, sizes, text), set(), []
                for a, b in r.parts():
                    for s in shingle_sets(r.raw[r.offs[a] : r.offs[b]], r.offs[a : b + 1] - r.offs[a], k):
                        if len(s) and (name := set_name(s)) not in seen:
                            seen.add(name)
                            sets.append(s[: np.searchsorted(s, COUNTED)])
                every, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                cuts = [0, *np.searchsorted(every, _edges(buckets)), len(every)]
                rows = [(b, run, press_sorted(every[i:j]), press(counts[i:j])) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "run", "hashes", "counts"])

    return offer


def _edges(buckets: int) -> np.ndarray:
    return np.array([i * int(COUNTED) // buckets for i in range(1, buckets)], np.uint64)


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: for each run, its shingles that several sets hold, with their counts over all runs."""
    parts = [unpress_sorted(b) for b in pdf["hashes"]]
    values, where = np.unique(np.concatenate(parts), return_inverse=True)
    totals = np.bincount(where, np.concatenate([unpress(b, np.int64) for b in pdf["counts"]])).astype(np.int64)
    rows, at = [], 0
    for run, p in zip(pdf["run"], parts, strict=True):
        t = totals[where[at : at + len(p)]]
        at += len(p)
        if (t > 1).any():
            rows.append((int(run), press_sorted(p[t > 1]), press(t[t > 1])))
    return pd.DataFrame(rows, columns=["run", "hashes", "counts"])


def _entries(k: int, percent: int):
    """Of each run: its documents (kind 0), its candidate sets (3), links of sets with the same rare shingle in the run (1) and one set for each such shingle (2)."""

    def find(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                r = Run(row.ids, row.sizes, row.text)
                shared = [(unpress_sorted(x["hashes"]), unpress(x["counts"], np.int64)) for x in (row.shared if row.shared is not None else [])]
                hashes = np.concatenate([s[0] for s in shared]) if shared else np.zeros(0, np.uint64)
                order = np.argsort(hashes)
                hashes, counts = hashes[order], np.concatenate([s[1] for s in shared])[order] if shared else np.zeros(0, np.int64)
                docs, seen, keys, owners, sizes = [], {}, [], [], {}
                wanted = []
                for a, b in r.parts():
                    for i, s in enumerate(shingle_sets(r.raw[r.offs[a] : r.offs[b]], r.offs[a : b + 1] - r.offs[a], k), a):
                        name = set_name(s) if len(s) else 0
                        docs.append((int(r.ids[i]), name, len(s), zlib.crc32(r.raw[r.offs[i] : r.offs[i + 1]])))
                        if not len(s) or name in seen:
                            continue
                        seen[name] = len(s)
                        prefix = rare_first(s, hashes, counts, prefix_length(len(s), percent))
                        if len(prefix):
                            keys.append(prefix)
                            owners.append(np.full(len(prefix), name, np.int64))
                            wanted.append((name, len(s), s.tobytes()))
                yield pd.DataFrame({"kind": 0, "a": [d[0] for d in docs], "b": [d[1] for d in docs], "n": [d[2] for d in docs], "crc": [d[3] for d in docs], "shingles": None})
                if keys:
                    key, owner = np.concatenate(keys), np.concatenate(owners)
                    by = np.lexsort((owner, key))
                    key, owner = key[by], owner[by]
                    new = np.concatenate(([True], key[1:] != key[:-1]))
                    head = owner[new][np.cumsum(new) - 1]
                    links = np.unique(np.stack((owner, head), 1)[owner != head], axis=0)
                    yield pd.DataFrame({"kind": 1, "a": links[:, 0], "b": links[:, 1], "n": 0, "crc": 0, "shingles": None})
                    yield pd.DataFrame({"kind": 2, "a": key[new].astype(np.int64), "b": owner[new], "n": 0, "crc": 0, "shingles": None})
                    for i in range(0, len(wanted), 500):
                        part = wanted[i : i + 500]
                        yield pd.DataFrame({"kind": 3, "a": 0, "b": [w[0] for w in part], "n": [w[1] for w in part], "crc": 0, "shingles": [w[2] for w in part]})

    return find


def rare_first(s: np.ndarray, hashes: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The shingles that other sets may share among the first ``length`` of a set.

    Order: counted shingles by count (those of one set only are not in ``hashes``), then by hash;
    after them the uncounted by hash.
    """
    low = s[: np.searchsorted(s, COUNTED)]
    if len(hashes) and len(low):
        i = np.minimum(np.searchsorted(hashes, low), len(hashes) - 1)
        known = hashes[i] == low
    else:
        known = np.zeros(len(low), bool)
    single = len(low) - int(known.sum())
    if single >= length:
        return low[:0]
    mine = low[known]
    if len(mine):
        mine = mine[np.argsort(counts[i[known]], kind="stable")]
    return np.concatenate((mine, s[len(low) :]))[: length - single]


# ---------------------------------------------------------------- tiles


def signatures(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One bitmap a set, in 64-bit words: the bits its shingles hash to."""
    out = np.zeros((len(sets), bits), bool)
    for i, s in enumerate(sets):
        out[i, (s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def tile_links(names: np.ndarray, sets: list[np.ndarray], comp: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between sets of a tile, enough to join all that agree: pairs already joined, also through others, are passed over.

    comp tells which sets are joined before. Sizes band the pairs: the larger set holds at most
    100 / percent times as many shingles. Each set bit of one signature that the other lacks is at
    least one shingle that the other set lacks, which bounds the overlap from above.
    """
    size = np.array([len(s) for s in sets])
    order = np.lexsort((names, size))
    names, size, comp = names[order], size[order], comp[order].copy()
    sets = [sets[i] for i in order]
    bits = min(1 << 14, max(256, 1 << int(size.max() * 2 - 1).bit_length())) if len(sets) else 256
    sig, out = signatures(sets, bits), []
    upto = np.searchsorted(size, size * 100 // percent, side="right")
    for i in range(len(sets)):
        left = np.flatnonzero(comp[i + 1 : upto[i]] != comp[i]) + i + 1
        for lo in range(0, len(left), 4096):
            c = left[lo : lo + 4096]
            need = overlap_needed(size[i], size[c], percent)
            bound = np.minimum(size[i] - np.bitwise_count(sig[i] & ~sig[c]).sum(1, dtype=np.int64), size[c] - np.bitwise_count(sig[c] & ~sig[i]).sum(1, dtype=np.int64))
            for j, least in zip(c[bound >= need].tolist(), need[bound >= need].tolist(), strict=True):
                if comp[j] == comp[i]:
                    continue
                a, b = sets[i], sets[j]
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                if int((b[at] == a).sum()) >= least:
                    out.append((int(names[i]), int(names[j])))
                    comp[comp == comp[j]] = comp[i]
    return out


def _link(percent: int):
    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("b")
        sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        links = tile_links(pdf["b"].to_numpy(), sets, pdf["comp"].to_numpy(), percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return link


def _relabel(sets: DataFrame, links: DataFrame) -> DataFrame:
    """sets with comp renewed by links between sets."""
    label = components(links).withColumnsRenamed({"node": "b", "root": "_root"})
    return sets.join(label, "b", "left").withColumn("comp", F.coalesce("_root", "comp")).drop("_root")


def cluster_links(sets: DataFrame, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """(a, b) links that join all agreeing sets of each cluster. sets: root, b (name), n, shingles; one row a set.

    A cluster of one tile is settled there. A larger one is cut by size band and, inside a band, by
    hash: first each tile joins its own sets; then one set of each component so far is compared
    across; last, pairs of tiles of neighbouring bands that still hold different components compare
    just the pairs not yet joined. So a huge group of near copies costs its size, not its square.
    """
    load = F.sum(F.col("n") + 64)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent))).cast("int")
    small = sets.groupBy("root").agg(load.alias("load")).withColumn("big", F.col("load") > tile).drop("load")
    placed = sets.join(small, "root").withColumn("band", F.when(F.col("big"), band).otherwise(0))
    lanes = placed.groupBy("root", "band").agg(F.ceil(load / tile).alias("lanes"))
    placed = placed.join(lanes, ["root", "band"]).withColumn("lane", F.pmod(F.xxhash64("b"), F.col("lanes"))).withColumn("comp", F.col("b")).drop("lanes")
    key, schema = ["root", "band", "lane"], "a long, b long"
    placed = cut(placed)
    links = cut(placed.groupBy(*key).applyInPandas(_link(percent), schema))
    if placed.where("big").limit(1).count() == 0:
        return links
    big = _relabel(placed.where("big"), links)
    heads = big.groupBy("root", "comp").agg(F.min("b").alias("b"))
    head_sets = big.drop("lane").join(heads.select("b"), "b", "left_semi")
    head_lanes = head_sets.groupBy("root", "band").agg(F.ceil(load / tile).alias("lanes"))
    head_sets = head_sets.join(head_lanes, ["root", "band"]).withColumn("lane", F.pmod(F.xxhash64("b", F.lit(1)), F.col("lanes"))).drop("lanes")
    links = cut(links.union(head_sets.groupBy(*key).applyInPandas(_link(percent), schema)))
    big = cut(_relabel(placed.where("big"), links))
    tiles = big.groupBy(*key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    # tiles that hold nothing but the largest component have nothing to settle among themselves
    main = big.groupBy("root", "comp").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    tiles = cut(tiles.join(main, "root").withColumn("odd", (F.col("lo") != F.col("main")) | (F.col("hi") != F.col("main"))).drop("main"))
    two = tiles.withColumnsRenamed({c: f"{c}2" for c in ("band", "lane", "lo", "hi", "odd")})
    near = F.abs(F.col("band") - F.col("band2")) <= 1
    here, there = F.struct("band", "lane"), F.struct(F.col("band2").alias("band"), F.col("lane2").alias("lane"))
    open_ = F.greatest("hi", "hi2") != F.least("lo", "lo2")
    pairs = tiles.where("odd").join(two, "root").where(near & open_ & (here != there) & (~F.col("odd2") | (here < there))).withColumn("pair", F.xxhash64("root", "band", "lane", "band2", "lane2"))
    sides = pairs.select(*key, "pair").union(pairs.select("root", "band2", "lane2", "pair"))
    last = big.join(sides, key).groupBy("pair").applyInPandas(_link(percent), schema)
    return links.union(last)


def _labelled(docs: DataFrame, k: int, percent: int, tile: int) -> DataFrame:
    """near_duplicates() with first: whether a row is the one of its component with the least (doc_id, text_crc32), null ids last; rows without words are on their own."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_crc32")
    runs = cut(gather(docs))
    buckets = max(1, runs.count())
    offers = runs.mapInArrow(_offers(buckets, k), "bucket long, run long, hashes binary, counts binary")
    shared = offers.groupBy("bucket").applyInPandas(_shared, "run long, hashes binary, counts binary")
    shared = shared.groupBy("run").agg(F.collect_list(F.struct("hashes", "counts")).alias("shared"))  # of one run: no more than its own shingles
    found = cut(runs.join(shared, "run", "left").mapInPandas(_entries(k, percent), ENTRY_SCHEMA))
    rows = found.where("kind = 0").select(F.when(F.col("a") != -(2**63), F.col("a")).alias("doc_id"), F.when(F.col("n") > 0, F.col("b")).alias("name"), F.col("n").alias("n_shingles"), F.col("crc").alias("text_crc32"))
    entries = found.where("kind = 2").select(F.col("a").alias("key"), "b")
    heads = entries.groupBy("key").agg(F.min("b").alias("head"))
    near = entries.join(heads, "key").where("b <> head").select(F.col("b").alias("a"), F.col("head").alias("b")).union(found.where("kind = 1").select("a", "b"))
    clusters = components(near)
    held = found.where("kind = 3").select("b", "n", "shingles").dropDuplicates(["b"])
    sets = held.join(clusters.withColumnRenamed("node", "b"), "b")
    label = components(cluster_links(sets, percent, tile)).withColumnsRenamed({"node": "name"})
    names = rows.where("name IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("least"), F.min(rank).alias("lead")).join(label, "name", "left").withColumn("root", F.coalesce("root", "name"))
    best = names.groupBy("root").agg(F.min("least").alias("component_id"), F.min("lead").alias("lead"))
    final = names.select("name", "root").join(best, "root").select("name", "component_id", "lead")
    alone = rows.where("name IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_crc32", F.lit(True).alias("first"))
    return rows.where("name IS NOT NULL").join(final, "name").select("doc_id", "n_shingles", "component_id", "text_crc32", rank.eqNullSafe(F.col("lead")).alias("first")).union(alone)


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id and text_crc32 of every row of docs (doc_id, text).

    Two documents link when 100 * intersection >= percent * union of their sets of k-word shingles;
    component_id is the smallest doc_id reachable by links. Null, empty and blank texts have no
    shingles, link with nothing and keep their own doc_id. Equal sets are one set throughout, so
    copies are never paired. Rows without doc_id take the component of their set. Very long texts
    are sets like any other; extra columns are ignored; empty tables stay empty.
    """
    return _labelled(docs, k, percent, tile).drop("first")


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component of docs, that of least doc_id and, among those, least crc32 of the text.

    Rows are told by doc_id and text, so rows of one doc_id with different texts are judged apart
    and wholly repeated rows count once. A row without doc_id comes after all with one. Texts
    without words are no duplicates: each different one of a doc_id stays.
    """
    named = _labelled(docs, k, percent, TILE)
    none = F.lit(-(2**63))
    rows = cut(named.groupBy(F.coalesce("doc_id", none).alias("id"), F.col("text_crc32").alias("crc")).agg(F.max("first").alias("kept"), (F.count("*") > 1).alias("again")).where("again OR NOT kept"))
    marked, place = aside(docs)
    marked = marked.select("*", F.coalesce(place["doc_id"], none).alias("id"), F.crc32(F.coalesce(place["text"], F.lit("")).cast("binary")).alias("crc"))
    if rows.where("kept").limit(1).count():
        left = marked.join(rows.select("id", "crc"), ["id", "crc"], "left_anti")
        left = left.union(marked.join(rows.where("kept").select("id", "crc"), ["id", "crc"], "left_semi").dropDuplicates(["id", "crc"]))
    else:
        left = marked.join(rows.select("id", "crc"), ["id", "crc"], "left_anti")
    return left.select(*back(place))
