"""Conversation repair against trying every sequence of edits, and against a plain reading of the contract."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from lintel.llm import repair as rep

SCHEMA = "conv_id long, turn long, role string, text string, key string, n long, fault int, place int"
INK = re.compile(r"[^\x20\x09-\x0D]")


def every_edit(signs):
    """Least (cost, audit) over all edits of up to a few rows. signs: (initial, must be deleted, truncated)."""
    best = None
    choices = [["D"] if dead else ["K", "R", "D"] for _, dead, _ in signs]
    for edits in itertools.product(*choices):
        for gaps in itertools.product(range(3), repeat=len(signs) + 1):
            cost, audit, roles = 5 * sum(gaps), "I" * gaps[0], "x" * gaps[0]
            for (initial, _, short), e, g in zip(signs, edits, gaps[1:], strict=True):
                cost += {"K": 0, "R": 1, "D": 2}[e] + (5 if short and e != "D" else 0)
                audit += e + "I" * g
                roles += {"K": initial, "R": "x", "D": ""}[e] + "x" * g
            if best is not None and (cost, audit) >= best:
                continue
            if any(re.fullmatch("(s?(ua)+)?", "".join(p)) for p in itertools.product(*["ua" if c == "x" else c for c in roles])):
                best = (cost, audit)
    return best


def pattern_of(signs):
    return "".join(rep.SIGNS[4 * "sua".find(i) + (1 if dead else 3 if short else 0)] if i in "sua" else rep.SIGNS[12 + (1 if dead else 3 if short else 0)] for i, dead, short in signs)


def signs_of(rng, n):
    return [(rng.choice("ssuuaao"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]


def test_lightest_edits_match_trying_all():
    rng = random.Random(1)
    cases = [c for n in range(3) for c in itertools.product([(i, d, s) for i in "suao" for d in (False, True) for s in (False, True) if not (d and s)], repeat=n)]
    for signs in [*cases, *(signs_of(rng, rng.choice((3, 3, 4))) for _ in range(120))]:
        assert rep.solve(pattern_of(signs)) == every_edit(list(signs)), signs


def test_stretches_put_together_are_the_whole():
    rng = random.Random(2)
    for _ in range(300):
        pattern = pattern_of(signs_of(rng, rng.randint(1, 14)))
        cuts = sorted(rng.sample(range(1, len(pattern)), min(len(pattern) - 1, rng.randint(0, 4))))
        pieces = [pattern[a:b] for a, b in zip([0, *cuts], [*cuts, len(pattern)], strict=True)]
        whole = rep.compose([rep.stretch(p) for p in pieces])
        assert whole == rep.stretch(pattern)
        assert rep.close([whole]) == rep.solve(pattern)


def test_audit_ties_take_the_least_letters():
    # a user turn alone: an assistant turn is inserted (5) after it, or it is deleted (2)
    assert rep.solve("E") == (2, "D")
    # system alone: deleting it is cheaper than a pair of insertions
    assert rep.solve("A") == (2, "D")
    # user, user: one of them answers
    assert rep.solve("EE") == (1, "KR")
    # assistant, user: both change sides, or both go
    assert rep.solve("IE") == (2, "RR")
    assert rep.solve("") == (0, "")


def plain_report(rows, all_ids):
    """The contract read literally."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    tag = lambda r: hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()
    out = []
    for conv in all_ids:
        rows_ = sorted(convs[conv], key=lambda r: (r[0] is not None, r[0] or 0, tag(r)))
        turns = [r[0] for r in rows_ if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, role, text in rows_:
            ink = INK.findall(text)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in rows_]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        signs = [(i if i in ("s", "u", "a") else "o", f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults, strict=True)]
        cost, audit = rep.solve(pattern_of(signs))
        said, it = [], iter(rows_)
        for e in audit:
            nxt = "assistant" if said and said[-1][0].startswith("u") else "user"
            if e == "I":
                said.append((nxt, ""))
                continue
            _, role, text = next(it)
            if e != "D":
                said.append((role if e == "K" else nxt, text))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def conversations(seed=3):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 9)):
            text = rng.choice(["Yes.", "No", "Why?\n", " ", None, "Well... ", "done!", "ünd\x85", "a.b", "Yes."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["system", "user", "assistant", "user", "assistant", None, "tool", "", "s"]), text))
    rows += [(77, t % 40, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "So", "Ok?"]) + (str(t % 7) + "." if t % 3 else "")) for t in range(400)]
    rows += [(78, None, "user", "Again.")] * 70 + [(79, -3, "user", ""), (79, 5, "assistant", "x.")]
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("block,fan", [(rep.BLOCK, rep.FAN), (5, 2)])
def test_report_matches_the_contract(spark, block, fan):
    rows = conversations()
    docs = table(spark, rows)
    got = rep.report(rep.damage(docs), docs, block, fan)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0] is not None, r[0] or 0)) == plain_report(rows, {r[0] for r in rows})


def test_dropped_conversations_and_empty_tables(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    docs = table(spark, [(conv, 0, "user", "Hello.")])
    assert [tuple(r) for r in rep.report(rep.damage(docs), docs).collect()] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert rep.report(rep.damage(docs.limit(0)), docs.limit(0)).count() == 0
    assert rep.repair(docs.limit(0)).count() == 0


def test_repaired_turns_are_good_conversations(spark):
    rows = conversations(5)
    turns = defaultdict(list)
    for r in sorted(rep.repair(table(spark, rows), 7, 3).collect(), key=lambda r: r.place):
        turns[r.conv_id].append(r)
    assert {None, 77} <= set(turns)
    for said in turns.values():
        assert re.fullmatch("s?(ua)+", "".join(r.role[:1] for r in said))
        assert [r.place for r in said] == list(range(len(said)))
        assert all((r.text == "") == (r.edit == "I") for r in said)
