"""Structure repair of conversations by lightest derivations (Knuth's generalisation of Dijkstra's algorithm).

A conversation is good when its roles read ``(s?(ua)+)?``. Edits of its rows and insertions between them are
axioms of a weighted deduction system: an item says that a stretch of rows leads from one state of that
expression to another, and weighs (cost, audit), the audit being the edits' initials. Two items of
neighbouring stretches deduce one of both: costs add up, audits join. An agenda pops the lightest item; it is
final then, because a deduction never weighs less than what it is made from; the goal's pop ends it.

Stretches of at most BLOCK rows are solved on their own; a longer conversation, cut wherever the sorted rows are
partitioned, is put together from the items of its stretches by the same deductions.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import cut

#: Rows of a stretch, and stretches put together at once.
BLOCK, FAN = 256, 64
#: fixed values: the costs of the edits
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a; it may end in the first and the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
GOOD_ENDS = (NOTHING, ASSISTANT)
#: Fault codes of a row; a row's sign is the letter at 4 * initial + fault, with s, u, a and any other as initials.
NONE, BLANK, DUPLICATE, CUT_SHORT = range(4)
SIGNS = "ABCDEFGHIJKLMNOP"
LEGAL = {(0, 1), (1, 2), (2, 1)}

Item = tuple[int, int, str]


# ---------------------------------------------------------------- deductions


def gap_axioms() -> dict[tuple[int, int], tuple[int, str]]:
    """Between rows: nothing, or inserted turns as far as they can be of use."""
    out = {(p, p): (0, "") for p in range(4)}
    for p in (NOTHING, SYSTEM, ASSISTANT):
        out[p, USER] = (INSERT, "I")
    out[USER, ASSISTANT] = (INSERT, "I")
    for p in (NOTHING, SYSTEM):
        out[p, ASSISTANT] = (2 * INSERT, "II")
    return out


def row_axioms(sign: str) -> dict[tuple[int, int], tuple[int, str]]:
    """What the edits of one row lead to."""
    initial, fault = divmod(SIGNS.index(sign), 4)
    out = {(p, p): (DELETE, "D") for p in range(4)}
    if fault in (BLANK, DUPLICATE):
        return out
    more = TRUNCATED if fault == CUT_SHORT else 0
    if initial == 0:
        out[NOTHING, SYSTEM] = (KEEP + more, "K")
    for p in (NOTHING, SYSTEM, ASSISTANT):
        out[p, USER] = (KEEP + more, "K") if initial == 1 else (REROLE + more, "R")
    out[USER, ASSISTANT] = (KEEP + more, "K") if initial == 2 else (REROLE + more, "R")
    return out


GAP = gap_axioms()
END = {(p, NOTHING): (0, "") for p in GOOD_ENDS}
ROW = {s: row_axioms(s) for s in SIGNS}


def derive(parts: list[dict], start: int, goal: int | None = None) -> dict[int, tuple[int, str]]:
    """Lightest (cost, audit) from ``start`` over all parts to each state, or just to ``goal``, whose pop ends the work.

    parts: items of neighbouring stretches, {(state before, state after): (cost, audit)}. An item
    (k, q) stands for parts 0 to k - 1; with the item (q, r) of part k it deduces (k + 1, r). The agenda is
    ordered by cost, then parts covered, then audit. On one item that is (cost, audit): audits of one
    stretch that cost the same never begin one another, as the letters left over would be insertions, so
    joining keeps their order. And a deduction covers more parts than each of its premises, so it never comes
    before them.
    """
    leads = [[[] for _ in range(4)] for _ in parts]
    for to, part in zip(leads, parts, strict=True):
        for (p, q), (cost, audit) in part.items():
            to[p].append((q, cost, audit))
    agenda, final, found = [(0, 0, "", start)], set(), {}
    while agenda:
        cost, covered, audit, state = heapq.heappop(agenda)
        if (covered, state) in final:
            continue
        final.add((covered, state))
        if covered < len(parts):
            for r, more, letters in leads[covered][state]:
                if (covered + 1, r) not in final:
                    heapq.heappush(agenda, (cost + more, covered + 1, audit + letters, r))
        else:
            found[state] = (cost, audit)
            if state == goal:
                break
    return found


def _parts(pattern: str) -> list[dict]:
    return [x for s in pattern for x in (GAP, ROW[s])]


@lru_cache(1 << 15)
def solve(pattern: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation given by its rows' signs."""
    return close(_parts(pattern))


def close(parts: list[dict]) -> tuple[int, str]:
    """The goal: all parts, what is inserted after them, and an end that the expression allows."""
    return derive([*parts, GAP, END], NOTHING, NOTHING)[NOTHING]


@lru_cache(1 << 10)
def stretch(pattern: str) -> dict[tuple[int, int], tuple[int, str]]:
    """All items of a stretch of rows."""
    return {(p, q): w for p in range(4) for q, w in derive(_parts(pattern), p).items()}


def compose(items: list[dict]) -> dict[tuple[int, int], tuple[int, str]]:
    """All items of neighbouring stretches put together."""
    return {(p, q): w for p in range(4) for q, w in derive(items, p).items()}


def illegal_pairs(pattern: str) -> int:
    kinds = [SIGNS.index(s) // 4 for s in pattern]
    return sum((a, b) not in LEGAL for a, b in zip(kinds, kinds[1:], strict=False))


# ---------------------------------------------------------------- rows


def _key(conv_id: Column) -> Column:
    return F.when(conv_id.isNull(), "").otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def signed_rows(rows: DataFrame) -> DataFrame:
    """key, turn, tag (orders rows of one turn), role, text and the fault each row shows by itself. Null role or text: one blank."""
    r = rows.select(_key(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    ink = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(ink == "", BLANK).when(F.substring(ink, -1, 1).isin(".", "!", "?"), NONE).otherwise(CUT_SHORT)
    tag = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    return r.withColumns({"fault": fault, "tag": tag})


def _marked(signed: DataFrame) -> DataFrame:
    """key, turn, tag, fault, initial and n: equal rows of a turn folded, repeats of an earlier row marked."""
    at = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    initial = F.when((F.col("role") == "") | (at == 0), 3).otherwise(at - 1)
    rows = cut(signed.select("key", "turn", "tag", "fault", initial.alias("initial")).groupBy("key", "turn", "tag", "fault", "initial").agg(F.count("*").alias("n")))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.where(f"fault <> {BLANK}").groupBy("key", "tag").agg(F.count("*").alias("places"), F.min(order).alias("first")).where("places > 1").drop("places")
    again = F.col("first").isNotNull() & ~order.eqNullSafe(F.col("first"))
    return rows.join(first, ["key", "tag"], "left").withColumn("fault", F.when(again & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault"))).drop("first")


def _stretches(block: int):
    """Sorted rows -> key, place and pattern of each stretch of at most ``block`` rows."""

    def cut_rows(batches):
        key, signs, made = None, [], 0
        for pdf in batches:
            out = []
            for k, initial, fault, n in zip(pdf["key"], pdf["initial"], pdf["fault"], pdf["n"], strict=True):
                if k != key:
                    if signs:
                        out.append((key, made, "".join(signs)))
                    key, signs, made = k, [], made + 1
                again = SIGNS[4 * initial + (BLANK if fault == BLANK else DUPLICATE)]
                sign = SIGNS[4 * initial + fault]
                while n:
                    take = min(n, block - len(signs))
                    signs.append(sign)
                    signs.extend([again] * (take - 1))
                    sign, n = again, n - take
                    if len(signs) >= block:
                        out.append((key, made, "".join(signs)))
                        signs, made = [], made + 1
            yield pd.DataFrame(out, columns=["key", "place", "pattern"])
        if signs:
            yield pd.DataFrame([(key, made, "".join(signs))], columns=["key", "place", "pattern"])

    return cut_rows


def _solved(batches):
    for pdf in batches:
        both = [solve(p) for p in pdf["pattern"]]
        yield pd.DataFrame({"key": pdf["key"], "illegal": [illegal_pairs(p) for p in pdf["pattern"]], "cost": [c for c, _ in both], "audit": [a for _, a in both]})


PLAN = "key string, illegal long, cost long, audit string"
ITEMS = "key string, i long, head string, tail string, illegal long, items array<struct<p:int,q:int,cost:long,audit:string>>"


def _listed(items: dict) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in items.items()]


def _read(items) -> dict:
    return {(x["p"], x["q"]): (x["cost"], x["audit"]) for x in items}


def _as_items(batches):
    for pdf in batches:
        out = [(k, i, p[0], p[-1], illegal_pairs(p), _listed(stretch(p))) for k, i, p in zip(pdf["key"], pdf["i"], pdf["pattern"], strict=True)]
        yield pd.DataFrame(out, columns=["key", "i", "head", "tail", "illegal", "items"])


def _joined(fan: int):
    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        between = sum(illegal_pairs(a + b) for a, b in zip(pdf["tail"].iloc[:-1], pdf["head"].iloc[1:], strict=True))
        row = (pdf["key"].iloc[0], int(pdf["i"].iloc[0]) // fan, pdf["head"].iloc[0], pdf["tail"].iloc[-1], int(pdf["illegal"].sum()) + between, _listed(compose([_read(x) for x in pdf["items"]])))
        return pd.DataFrame([row], columns=["key", "i", "head", "tail", "illegal", "items"])

    return join


def _closed(batches):
    for pdf in batches:
        both = [close([_read(x)]) for x in pdf["items"]]
        yield pd.DataFrame({"key": pdf["key"], "illegal": pdf["illegal"], "cost": [c for c, _ in both], "audit": [a for _, a in both]})


def _plans(marked: DataFrame, block: int, fan: int) -> DataFrame:
    """key, illegal, cost, audit of each conversation."""
    by = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("tag")]
    rows = marked.repartitionByRange(*by).sortWithinPartitions(*by).select("key", "initial", "fault", "n")
    found = rows.mapInPandas(_stretches(block), "key string, place long, pattern string").withColumn("task", F.spark_partition_id())
    found = cut(found)
    many = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    plans = found.join(many, "key", "left_anti").select("key", "pattern").mapInPandas(_solved, PLAN)
    if not many.limit(1).count():
        return plans
    # the numbering sorts a row for each stretch, not the rows
    long = found.join(many, "key", "left_semi").withColumn("i", (F.row_number().over(Window.partitionBy("key").orderBy("task", "place")) - 1).cast("long"))
    items = cut(long.select("key", "i", "pattern").mapInPandas(_as_items, ITEMS))
    while items.where("i > 0").limit(1).count():
        items = cut(items.groupBy("key", F.floor(F.col("i") / fan).alias("part")).applyInPandas(lambda pdf: _joined(fan)(pdf.drop(columns="part", errors="ignore")), ITEMS))
    return plans.union(items.mapInPandas(_closed, PLAN))


# ---------------------------------------------------------------- repaired rows


class Speaker:
    """Turns a conversation's audit and rows, one after the other, into repaired turns. It holds no more than the audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place, self.last = audit, 0, 0, ""

    def _say(self, edit: str, role: str, text: str):
        self.place += 1
        self.last = "user" if role[:1] == "u" else "assistant" if role[:1] == "a" else "system"
        return self.place - 1, role, text, edit

    def _next(self) -> str:
        return "assistant" if self.last == "user" else "user"

    def inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._say("I", self._next(), "")

    def row(self, role: str, text: str):
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield self._say("K", role, text)
        elif edit == "R":
            yield self._say("R", self._next(), text)


def _speak(batches):
    """(key, turns) in order; a conversation's audit comes before its rows, and its last turns are ended by None."""
    key, speaker = None, None
    for batch in batches:
        for k, kind, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if kind == 0:
                if speaker is not None:
                    yield key, speaker.inserted()
                    yield key, None
                key, speaker = k, Speaker(text)
            else:
                yield key, speaker.row(role, text)
    if speaker is not None:
        yield key, speaker.inserted()
        yield key, None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _turns(batches):
    schema = pa.schema([("key", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    out, held = [], 0
    for key, turns in _speak(batches):
        for turn in turns or ():
            out.append((key, *turn))
            held += len(turn[2]) + 64
        if held > 1 << 20:
            yield _batch(out, schema)
            out, held = [], 0
    if out:
        yield _batch(out, schema)


def _digests(batches):
    schema = pa.schema([("key", pa.string()), ("sha256", pa.string())])
    out, sha = [], hashlib.sha256()
    for key, turns in _speak(batches):
        if turns is None:
            out.append((key, sha.hexdigest()))
            sha = hashlib.sha256()
        else:
            for place, role, text, _ in turns:
                sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if len(out) == 10000:
            yield _batch(out, schema)
            out = []
    if out:
        yield _batch(out, schema)


def _told(signed: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows of whole conversations in order, each after its audit, streamed through one task at a time."""
    rows = signed.select("key", F.lit(1).alias("kind"), "role", "text", "turn", "tag")
    lead = plans.select("key", F.lit(0).alias("kind"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("tag"))
    both = lead.union(rows).repartition("key").sortWithinPartitions("key", "kind", F.col("turn").asc_nulls_first(), "tag")
    return both.select("key", "kind", "role", "text")


def plan(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """key, rows and faults of each conversation, and its cheapest edits: gaps, blank, duplicate, truncated, illegal, cost, audit."""
    marked = cut(_marked(signed_rows(rows)))
    spread = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    # the first of n equal rows shows its own fault, the others repeat it
    own = lambda fault: F.sum(F.when(F.col("fault") == fault, F.lit(1)).otherwise(0))
    copies = F.sum(F.when(F.col("fault") == BLANK, 0).otherwise(F.col("n") - 1))
    counts = marked.groupBy("key").agg(
        F.coalesce(spread, F.lit(0)).cast("long").alias("gaps"), F.coalesce(F.sum(F.when(F.col("fault") == BLANK, F.col("n"))), F.lit(0)).cast("long").alias("blank"),
        (own(DUPLICATE) + copies).cast("long").alias("duplicate"), own(CUT_SHORT).cast("long").alias("truncated"))
    return cut(counts.join(_plans(marked, block, fan), "key"))


def repair(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place, role, text, and edit (K kept, R new role, I inserted).

    rows: conv_id, turn, role, text; other columns are ignored. Rows go by turn, null first, those of one
    turn by a hash of role and text. Null roles and texts are one blank, so such texts are deleted; a null conv_id is a
    conversation. A conversation may be as long as the table: its edits are found stretch by stretch, and its
    turns are streamed in order. An empty table gives none.
    """
    told = _told(signed_rows(rows), plan(rows, block, fan)).mapInArrow(_turns, "key string, place long, role string, text string, edit string")
    conv_id = F.when(F.col("key") != "", F.substr("key", F.lit(2))).cast(rows.schema["conv_id"].dataType)
    return told.select(conv_id.alias("conv_id"), "place", "role", "text", "edit")


def report(rows: DataFrame, everyone: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row for each conv_id of ``everyone``: the counts of plan() and repaired_sha256, of the repaired turns as role:text joined by line ends.

    A conv_id without rows has zeros, an empty audit and the hash of nothing. The hash of one conversation is taken in
    its order, in one task that streams the rows.
    """
    plans = plan(rows, block, fan)
    sums = _told(signed_rows(rows), plans).mapInArrow(_digests, "key string, sha256 string")
    all_ = everyone.select("conv_id").distinct().withColumn("key", _key(F.col("conv_id")))
    out = all_.join(plans, "key", "left").join(sums, "key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations, damaged by crc32(conv_id:turn) % 20; nulls are one blank there and in role and text.

    0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    times = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.explode(times).alias("time"))
    return rows.drop("time")
