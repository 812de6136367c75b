"""Personal data: exact patterns, and a skip-chain conditional random field for further mentions.

The patterns find spans of four kinds. The tokens with digits or signs of every document form a
graph: neighbours in the text are linked, and so are tokens that repeat an earlier one and mentions,
of one token or several, whose joined digits are, end or nearly are those of a found span. Loopy
message passing with learned potentials then labels the tokens; whole mentions that a pattern missed
become spans too, if they agree with one it found or have the digits that their kind asks for.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import slices, text_bytes

KINDS = ("email", "ip", "card", "phone")
#: Documents whose spans train the potentials, about; they are the ones with the least hash of doc_id and text.
SAMPLE = 4000
#: Training passes and step; rounds and damping of message passing; probability from which a token is taken.
PASSES, STEP, ROUNDS, DAMP, SURE = 200, 0.5, 8, 0.5, 0.8
#: Digits that tell a number by its end; digits a number has where one may differ; most digits of a mention.
ENDING, NEARLY, LONGEST = 7, 9, 21
LABELS = 1 + len(KINDS)

# fixed values: the patterns and limits of the contract
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; each sign is tried once with the run of local characters before it, so long runs stay cheap."""
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        head = text[pos:at]
        start = pos + len(head.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        pos = m.end() if m else at + 1
        at = text.find("@", pos)
    return out


def card_digits(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def ip_parts(ip: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in ip.split("."))


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind by the contract's patterns."""
    digits = lambda s: "".join(DIGIT.findall(s))
    mail = emails(text) if "@" in text else []
    if not DIGIT.search(text):
        return [mail, [], [], []]
    ip = [m.span() for m in IP.finditer(text) if ip_parts(m.group())]
    card = [m.span() for m in CARD.finditer(text) if card_digits(digits(m.group()))]
    phone = [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15] if "+" in text else []
    return [mail, ip, card, phone]


# ---------------------------------------------------------------- the field

TOKEN = re.compile(r"\S+")
MARKED = re.compile(r"[0-9@]")
OUTER = ".,;:!?\"'*$%&#<>[]{}|"
#: The number inside a token that has letters too.
NUMBER = re.compile(r"[+(]?[0-9][0-9().-]*[0-9]")


def shape(token: str) -> int:
    """Number below 64 of a token's form: digits, length, and the signs in it."""
    n = sum("0" <= c <= "9" for c in token)
    bucket = 0 if n == 0 else 1 if n < 4 else 2 if n < 9 else 3
    alpha = any(c.isalpha() for c in token)
    return bucket * 16 + alpha * 8 + ("@" in token) * 4 + ("." in token) * 2 + ("-" in token or "(" in token or "+" in token)


def likeness(token: str) -> str | None:
    """What repeated or similar tokens have in common: their digits, or their letters where there are few digits."""
    digits = "".join(c for c in token if "0" <= c <= "9")
    if len(digits) >= 4 and not any(c.isalpha() for c in token):
        return digits
    return token.lower() if len(token) >= 6 else None


class Field:
    """Marked tokens of a text with their links. Tokens more than one word apart are not neighbours.

    mentions: (first token, last token, label, start, end) of what resembles a found span. like: a link
    from each token of the found span to each token of such a mention, with a weight that grows with
    the digits in which they agree.
    """

    def __init__(self, text: str, spans: list[list[tuple[int, int]]]):
        self.spans, self.shapes, self.chain, self.skip, self.known = [], [], [], [], []
        self.mentions, self.like = [], []
        beside = []  # whether a token follows the one before at once
        flat = sorted((a, b, k + 1) for k, part in enumerate(spans) for a, b in part)
        last, words_ago, j, seen = -1, 0, 0, {}
        for m in TOKEN.finditer(text):
            words_ago += 1
            if not MARKED.search(m.group()):
                continue
            core = m.group().strip(OUTER)
            a = m.start() + len(m.group()) - len(m.group().lstrip(OUTER))
            b = a + len(core)
            while j < len(flat) and flat[j][1] <= a:
                j += 1
            label = next((k for s, e, k in flat[j : j + len(KINDS)] if s < b and e > a), 0)
            node = len(self.spans)
            self.spans.append((a, b))
            self.shapes.append(shape(core))
            self.known.append(label)
            beside.append(last >= 0 and words_ago == 1)
            if last >= 0 and words_ago <= 2:
                self.chain.append((last, node))
            name = likeness(core)
            if name is not None:
                if name in seen:
                    self.skip.append((seen[name], node))
                seen[name] = node
            last, words_ago = node, 0
        if flat:
            self._resembling(text, spans, beside)

    def _resembling(self, text: str, spans: list[list[tuple[int, int]]], beside: list[bool]) -> None:
        """Finds mentions and like."""
        starts, same, near, mails = [a for a, _ in self.spans], {}, {}, {}

        def tokens(a: int, b: int, label: int) -> list[int]:
            i = max(0, bisect_right(starts, a) - 1)
            found = []
            while i < len(starts) and starts[i] < b:
                if self.spans[i][1] > a and self.known[i] == label:
                    found.append(i)
                i += 1
            return found

        numbers = [("".join(DIGIT.findall(text[a:b])), k + 1, tokens(a, b, k + 1)) for k in (KINDS.index("card"), KINDS.index("phone")) for a, b in spans[k]]
        for d, label, of in numbers:
            same.setdefault(d, (label, of))
        for d, label, of in numbers:
            for i in range(1, len(d) - ENDING + 1):
                same.setdefault(d[i:], (label, of))
        for d, label, of in numbers:
            for e in (d[i:] for i in range(len(d) - NEARLY + 1)):
                for i in range(len(e)):
                    near.setdefault(e[:i] + "?" + e[i + 1 :], (label, of))
        sizes = {len(x) for x in near}
        for a, b in spans[0]:
            mails.setdefault(text[a:b].lower().rpartition("@")[0], (1, tokens(a, b, 1)))

        def agrees(d: str):
            return same.get(d) or (same.get(d[2:]) if d.startswith("00") else None)

        def nearly(d: str):
            return next((near[x] for x in (d[:i] + "?" + d[i + 1 :] for i in range(len(d))) if x in near), None) if len(d) in sizes else None

        def link(i: int, j: int, a: int, b: int, hit, weight: float) -> None:
            self.mentions.append((i, j, hit[0], a, b))
            self.like += [(x, y, weight) for x in hit[1] for y in range(i, j + 1)]

        # stretches of tokens that follow each other at once and have digits and no letters
        runs, mixed = [], []
        for i, (a, b) in enumerate(self.spans):
            core = text[a:b]
            digits = "".join(DIGIT.findall(core))
            if self.known[i]:
                continue
            if any(c.isalpha() for c in core):
                local = core.lower().rpartition("@")[0]
                if len(local) >= 4 and local in mails:
                    link(i, i, a, b, mails[local], len(local))
                elif len(digits) >= ENDING:
                    mixed += [(i, a + m.start(), a + m.end(), "".join(DIGIT.findall(m.group()))) for m in NUMBER.finditer(core)]
            elif digits:
                if runs and beside[i] and runs[-1][-1][0] == i - 1:
                    runs[-1].append((i, digits))
                else:
                    runs.append([(i, digits)])
        if not numbers:
            return
        for i, a, b, d in mixed:
            if hit := agrees(d) or nearly(d):
                link(i, i, a, b, hit, len(d) if agrees(d) else len(d) / 2)
        for run in runs:
            free = [True] * len(run)
            for look, least, share in ((agrees, NEARLY, 1), (nearly, NEARLY, 2), (agrees, ENDING, 1)):
                at = 0
                while at < len(run):
                    best, d = None, ""
                    for j in range(at, len(run)):
                        d += run[j][1]
                        if not free[j] or len(d) > LONGEST:
                            break
                        if len(d) >= least and (hit := look(d)):
                            best = (j, hit, len(d) / share)
                    if best is None:
                        at += 1
                        continue
                    j, hit, weight = best
                    link(run[at][0], run[j][0], self.spans[run[at][0]][0], self.spans[run[j][0]][1], hit, weight)
                    free[at : j + 1] = [False] * (j + 1 - at)
                    at = j + 1


def fit(fields: list[Field]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unary (shape, label), chain and skip potentials that maximise the pseudo-likelihood of the pattern labels, kept small by a square penalty.

    A mention that no pattern found but that resembles a found one has no label to learn from: it takes no part.
    """
    shapes = np.concatenate([np.array(f.shapes, int) for f in fields]) if fields else np.zeros(0, int)
    y = np.concatenate([np.array(f.known, int) for f in fields]) if fields else np.zeros(0, int)
    at = np.cumsum([0, *(len(f.spans) for f in fields)])
    pairs = [np.array([(a + o, b + o) for f, o in zip(fields, at, strict=False) for a, b in edges(f)], int).reshape(-1, 2) for edges in (lambda f: f.chain, lambda f: f.skip)]
    told = np.ones(len(y), bool)
    for f, o in zip(fields, at, strict=False):
        for a, b, *_ in f.mentions:
            told[o + a : o + b + 1] = False
    pairs = [p[told[p].all(1)] for p in pairs]
    unary, chain, skip = np.zeros((64, LABELS)), np.zeros((LABELS, LABELS)), np.eye(LABELS)
    if not told.any():
        return unary, chain, skip
    for _ in range(PASSES):
        z = unary[shapes].copy()
        for w, p in ((chain, pairs[0]), (skip, pairs[1])):
            np.add.at(z, p[:, 1], w[y[p[:, 0]]])
            np.add.at(z, p[:, 0], w.T[y[p[:, 1]]])
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        g = (q - np.eye(LABELS)[y]) * told[:, None]
        gu = np.zeros_like(unary)
        np.add.at(gu, shapes, g)
        unary -= STEP * (gu / told.sum() * 20 + 1e-3 * unary)
        for w, p in ((chain, pairs[0]), (skip, pairs[1])):
            gw = np.zeros_like(w)
            np.add.at(gw, y[p[:, 0]], g[p[:, 1]])
            np.add.at(gw.T, y[p[:, 1]], g[p[:, 0]])
            w -= STEP * (gw / max(1, len(p)) + 1e-3 * w)
    return unary, chain, skip


def beliefs(f: Field, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Label probabilities of the tokens after loopy sum-product; tokens of a pattern's span are held at its kind."""
    unary, chain, skip = model
    n = len(f.spans)
    phi = unary[np.array(f.shapes, int)]
    for a, b, weight in f.like:  # a is held, so this is what it would send
        phi[b] += weight * skip[f.known[a]]
    phi = np.maximum(np.exp(phi - phi.max(1, keepdims=True)), 1e-12)
    known = np.array(f.known)
    phi[known > 0] = 1e-9
    phi[known > 0, known[known > 0]] = 1.0
    edges = np.array([*f.chain, *f.skip], int).reshape(-1, 2)
    kind = np.repeat([0, 1], [len(f.chain), len(f.skip)])
    psi = np.exp(np.stack((chain, skip)) - np.stack((chain, skip)).max((1, 2), keepdims=True))
    forth, back = np.full((2, len(edges), LABELS), 1.0 / LABELS)
    for _ in range(ROUNDS if len(edges) else 0):
        total = np.log(phi)
        np.add.at(total, edges[:, 1], np.log(forth))
        np.add.at(total, edges[:, 0], np.log(back))
        total = np.exp(total - total.max(1, keepdims=True))
        to_b = np.einsum("ei,eij->ej", total[edges[:, 0]] / back, psi[kind])
        to_a = np.einsum("ej,eij->ei", total[edges[:, 1]] / forth, psi[kind])
        forth = np.maximum(DAMP * forth + (1 - DAMP) * to_b / to_b.sum(1, keepdims=True), 1e-12)
        back = np.maximum(DAMP * back + (1 - DAMP) * to_a / to_a.sum(1, keepdims=True), 1e-12)
    total = np.log(phi)
    np.add.at(total, edges[:, 1], np.log(forth))
    np.add.at(total, edges[:, 0], np.log(back))
    out = np.exp(total - total.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True) if n else out


def plausible(text: str, kind: int) -> bool:
    """Whether a mention has what its kind asks for: an address around the sign, or the digits of the contract."""
    digits = "".join(DIGIT.findall(text))
    return (
        re.search(r"[A-Za-z0-9]@[A-Za-z0-9]", text) is not None if KINDS[kind] == "email"
        else IP.fullmatch(text) is not None and ip_parts(text) if KINDS[kind] == "ip"
        else card_digits(digits) if KINDS[kind] == "card"
        else 9 <= len(digits) <= 15
    )


def added_spans(text: str, spans: list[list[tuple[int, int]]], model) -> list[list[tuple[int, int]]]:
    """Spans of mentions that no pattern found: those that resemble a found one and that the field labels
    like it in any of their tokens, and what the field labels elsewhere if it repeats a token of a found
    one or has what its kind asks for."""
    out = [[] for _ in KINDS]
    f = Field(text, spans)
    if all(f.known):
        return out
    group = list(range(len(f.spans)))  # tokens that repeat each other, by their first
    for a, b in f.skip:
        group[b] = group[a]
    backed = {(group[i], k) for i, k in enumerate(f.known) if k}
    q = beliefs(f, model)
    label = q.argmax(1)
    label[(q.max(1) < SURE) | (np.array(f.known) > 0)] = 0
    for i, j, k, a, b in f.mentions:
        if (label[i : j + 1] == k).any():
            out[k - 1].append((a, b))
            label[i : j + 1] = 0
    chain = set(f.chain)
    runs = []
    for i, k in enumerate(label.tolist()):
        if k and runs and runs[-1][0] == k and runs[-1][-1] == i - 1 and (i - 1, i) in chain:
            runs[-1].append(i)
        elif k:
            runs.append([k, i])
    for k, *run in runs:
        whole = (f.spans[run[0]][0], f.spans[run[-1]][1])
        if plausible(text[slice(*whole)], k - 1):
            out[k - 1].append(whole)
            continue
        last = None
        for i in run:
            if (group[i], k) not in backed and not plausible(text[slice(*f.spans[i])], k - 1):
                continue
            a = out[k - 1].pop()[0] if last == i - 1 else f.spans[i][0]
            out[k - 1].append((a, f.spans[i][1]))
            last = i
    return out


# ---------------------------------------------------------------- Spark


def training(docs: DataFrame, share: float) -> DataFrame:
    """doc_id and text of about that share of the documents that have marked tokens, told by doc_id and text; repeated rows count once."""
    scale = 1 << 30
    marked = docs.where(F.col("text").rlike("[0-9@]")).select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(9)).alias("h"))
    return marked.where(F.pmod("h", F.lit(scale)) < F.lit(int(scale * share))).dropDuplicates(["doc_id", "h"]).select("doc_id", "text")


def train(docs: DataFrame, most: int = SAMPLE):
    """Potentials fitted in one task on about ``most`` documents."""
    n = docs.count()
    part = training(docs, min(1.0, most / max(1, n)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])
        model = fit([Field(t, base_spans(t)) for t in pdf["text"]])
        return pd.DataFrame({"w": [np.concatenate([m.ravel() for m in model]).tobytes()]})

    row = part.groupBy().applyInPandas(run, "w binary").first()
    flat = np.frombuffer(bytes(row["w"])) if row else np.concatenate([m.ravel() for m in fit([])])
    return flat[: 64 * LABELS].reshape(64, LABELS), flat[64 * LABELS : -LABELS * LABELS].reshape(LABELS, LABELS), flat[-LABELS * LABELS :].reshape(LABELS, LABELS)


def find(text: str, model) -> tuple[list, list]:
    """Base spans and all spans of a text, by kind."""
    base = base_spans(text)
    more = added_spans(text, base, model)
    return base, [sorted(b + m) for b, m in zip(base, more, strict=True)]


def listed(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, part in zip(KINDS, spans, strict=True) for a, b in part)


def masked(text: str, spans: list[list[tuple[int, int]]]) -> str:
    """The text with each stretch of overlapping spans replaced by the name of its first kind in brackets."""
    out, at = [], 0
    todo = sorted((a, b, k) for k, part in zip(KINDS, spans, strict=True) for a, b in part)
    for n, (a, b, k) in enumerate(todo):
        if a >= at or n == 0:
            out += [text[at:a], f"[{k}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def cleaned(text: str, model) -> str:
    """The text with all spans masked, again until nothing is found: a masked neighbour can lay a further number bare."""
    _, every = find(text, model)
    while any(every):
        text = masked(text, every)
        _, every = find(text, model)
    return text


def _suspects(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows that hold an at sign or at least four digits: no other can match."""
    digits = np.concatenate(([0], np.cumsum((raw >= 48) & (raw <= 57))))
    signs = np.concatenate(([0], np.cumsum(raw == 64)))
    return (np.diff(digits[offs]) >= 4) | (np.diff(signs[offs]) > 0)


EMPTY = hashlib.sha256(b"").hexdigest()


def _finder(model):
    def run(batches):
        for batch in slices(batches, "text"):
            n = batch.num_rows
            counts, digest, spans = np.zeros((len(KINDS), n), np.int64), [EMPTY] * n, [""] * n
            for i in np.flatnonzero(_suspects(*text_bytes(batch.column(1)))).tolist():
                base, every = find(batch.column(1)[i].as_py(), model)
                counts[:, i] = [len(b) for b in base]
                digest[i], spans[i] = hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find_pii(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row of docs (doc_id, text).

    Null and empty texts have no spans. Spans of different kinds may overlap. Repeated rows get equal
    results; whole texts are searched, however long; extra columns are ignored; empty tables stay empty.
    """
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_finder(train(docs, most)), schema)


def mask_pii(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The rows of docs with every span in text replaced by its kind in brackets; n_chars, if there, follows. Null texts stay null."""
    model = train(docs, most)
    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches, "text"):
            col = batch.column(at)
            hits = set(np.flatnonzero(_suspects(*text_bytes(col))).tolist())
            texts = [cleaned(t, model) if i in hits else t for i, t in enumerate(col.to_pylist())]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, col.type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
