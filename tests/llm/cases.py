"""A small corpus with every awkward case, and plain versions of the contracts to hold results against."""

import hashlib
import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, kind string, run long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnoé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    sentence = lambda k: " ".join(rng.choice(vocab) for _ in range(k)).capitalize() + "."
    passage = sentence(60)
    texts = [None, "", " \n\t", "one", "Two words", "three Little words", "a\x0bb\x0cc d", "The " * 400, "x" * 5000, passage]
    while len(texts) < n:
        base = "\n".join(sentence(rng.randint(5, 25)) for _ in range(rng.randint(1, 12)))
        texts.append(base)
        for _ in range(rng.choice([0, 0, 0, 1, 3])):
            words = base.split(" ")
            for _ in range(max(0, len(words) // 60) + rng.randint(0, 1)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words))
        if rng.random() < 0.2:
            texts.append(base)
        if rng.random() < 0.2:
            texts.append(base + "\n" + passage + "\n" + sentence(9))
    texts += [sentence(8000), "Mail me.Now@a-b.example.com or 10.0.0.300 1.2.3.4 4111 1111 1111 1111 +1 (888) 555-6841 again (888) 555-6841 ü", "@@ a@b a@b@c.de +12 999999999999999999999 4111-1111-1111-1112"]
    rows = [(i * 7 % 1009, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", "S9", None]), len(t or ""), 3, "x", 5) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def shingles(text, k=4):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_duplicates(rows, k=4, percent=85):
    sets = [(d, shingles(t, k)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 62)
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least[find(i)], d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def removed(rows):
    least = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            least[w] = min(d, least.get(w, d))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < d:
                gone[p : p + 50] = b"\x01" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def statistics(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0

    return [
        [m.span() for m in EMAIL.finditer(text)],
        [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        [m.span() for m in CARD.finditer(text) if 13 <= len(d := digits(m.group())) <= 19 and luhn(d)],
        [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15],
    ]
