"""The transducer lexicon against the tokenizers library and a plain reading of its own definition."""

import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lintel.llm import bpe_lexicon as bpe

from . import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = ["a", "b", "'", "s", "t", "re", "'ll", "'ve", "'d", " ", "  ", "\n", "\r\n", "\t", "1", "23", "é", "漢", "!", "?!", "<|endoftext|>", "<|endof", "\x1c", "\x85", "　", "ß", "\U0001f600", "\U0001ccf0", "Ᲊ", "́", "the ", " The", "²", "_", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def some_texts(n=1500, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", "x" * 3000, "the " * 2000, "'s" * 500]


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def digests(df):
    return df.select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2(F.col("text").cast("binary"), 256))


@pytest.mark.parametrize("words", [0, 20, 2000])
def test_ids_are_the_librarys_whatever_the_lexicon_holds(library, words):
    rng, vocab, texts = random.Random(1), bpe.vocabulary(PATH), some_texts()
    held = sorted({m for t in texts for m in t.encode().split(b"a")})
    encoder = bpe.Encoder(bpe.compile_lexicon(rng.sample(held, min(words, len(held))), vocab), PATH)
    data = [t.encode() for t in texts]
    ids, cuts = encoder.part(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == e.ids, texts[i]


def test_every_code_point_splits_as_in_the_library(library):
    encoder, points = bpe.Encoder(bpe.compile_lexicon([], bpe.vocabulary(PATH)), PATH), [c for c in range(1, sys.maxunicode + 1, 7) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in points[i : i + 400]) for i in range(0, len(points), 400)]
    data = [t.encode() for t in texts]
    ids, cuts = encoder.part(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == e.ids


def test_the_transducer_is_minimal_and_gives_each_words_ids():
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) for _ in range(400)} | {b"talking", b"walking", b"talk", b"walk"})
    outs = {w: tuple(rng.randint(0, 3) for _ in range(rng.randint(1, 3))) for w in words}
    states = bpe.minimal_transducer((w, outs[w]) for w in words)

    def run(word):
        state, out = states[-1], ()
        for b in word:
            arc = next((a for a in state.arcs if a[0] == b), None)
            if arc is None:
                return None
            state, out = arc[2], out + arc[1]
        return out + state.tail if state.final else None

    assert all(run(w) == outs[w] for w in words)
    assert run(b"abcabcabc") is None and run(b"tal") is None

    # two prefixes share a state just where the words that follow, with what is left of their ids, are the same
    def rest(prefix):
        under = [(w[len(prefix) :], outs[w]) for w in words if w.startswith(prefix)]
        lead = 0
        while all(len(o) > lead and o[lead] == under[0][1][lead] for _, o in under):
            lead += 1
        return frozenset((w, o[lead:]) for w, o in under)

    assert len(states) == len({rest(w[:i]) for w in words for i in range(len(w) + 1)} - {rest(b"")}) + 1
    shared = bpe.minimal_transducer([(b"talking", (1, 9)), (b"walking", (2, 9))])
    assert len(shared) == 8


def test_merging_takes_the_least_rank_first():
    vocab, rng = bpe.vocabulary(PATH), random.Random(3)
    for _ in range(300):
        word = bytes(rng.choice(b"thesandriow ") for _ in range(rng.randint(0, 25)))
        ids = [vocab.byte_id[b] for b in word]
        while pairs := [(vocab.ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in vocab.ranks]:
            _, i = min(pairs)
            ids[i : i + 2] = [vocab.ranks[ids[i], ids[i + 1]][1]]
        assert vocab.merge(word) == tuple(ids)
        flat, n = vocab.merge_many(np.frombuffer(word * 2 + b"the", np.uint8), np.array([len(word), 0, len(word), 3])[[0, 2, 3]])
        assert flat.tolist() == ids * 2 + [vocab.merge(b"the")[0]] and n.tolist() == [len(ids), len(ids), 1]


def test_encode_and_decode_tables(spark, library, monkeypatch):
    rows = cases.corpus() + [(5000 + i, t, "en", "s", 0, 3, "word", 1) for i, t in enumerate(some_texts(300))] + [(None, "null id", None, None, 0, 3, "ids", 1)] * 2
    docs = spark.createDataFrame(rows, cases.SCHEMA).withColumnsRenamed({"kind": "ids", "run": "n", "lang": "word"}).repartition(5)
    key = lambda r: (r[0] is None, r)
    want = sorted([(r[0], *expected(library, r[1])) for r in rows], key=key)
    for most in (0, 50, bpe.LEXICON):
        got = digests(bpe.decode(bpe.encode(docs, PATH, most), PATH)).collect()
        assert sorted(map(tuple, got), key=key) == want
    assert sorted(map(tuple, digests(bpe.round_trip(docs, PATH, 50)).collect()), key=key) == want
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).count() == 0


def test_long_texts_are_taken_in_parts(library, monkeypatch):
    text = " ".join(some_texts(800))
    monkeypatch.setattr(bpe, "PART", 500)
    encoder = bpe.Encoder(bpe.compile_lexicon([b" the", b"the"], bpe.vocabulary(PATH)), PATH)
    raw = np.frombuffer(text.encode(), np.uint8)
    assert encoder.row(raw).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(encoder.row(raw[:0])) == 0


def test_decoding_of_any_ids(spark, library):
    lists = [[], [50256], [1, 2, 3], [0, 128, 200, 129], [255, 220, 50300, 11], list(range(180, 256))]
    rows = [(i, len(x), bytearray(np.array(x, "<u4").tobytes())) for i, x in enumerate(lists)] + [(9, 0, None)]
    got = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, n_tokens long, ids binary"), PATH).collect()}
    assert got == {**{i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)}, 9: ""}


def test_word_counts_are_whole(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, " a"), (4, "y" * 100)], "doc_id long, text string").repartition(3)
    assert {bytes(r.word): r.n for r in bpe.word_counts(docs, PATH).collect()} == {b"a": 1, b" b": 1, b" a": 2}
