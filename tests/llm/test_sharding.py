"""The shuffle moves whole documents, and no bucket gathers many long texts."""

import zlib

from lintel.llm import queries, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_the_query_shuffles_whole_documents(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else "é" * (i % 5), "en", "a", i % 5) for i in range(100)], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen, plain = [], sharding.shuffle_shards
    monkeypatch.setattr(sharding, "shuffle_shards", lambda rows, *a, **k: seen.append(rows.columns) or plain(rows, *a, **k))
    got = {r["doc_id"]: r for r in queries.op8_shard_shuffle(spark, str(tmp_path)).collect()}
    assert seen == [["doc_id", "text", "lang", "source", "n_chars"]]
    for i in range(100):
        raw = ("" if i % 7 == 0 else "é" * (i % 5)).encode()
        assert (got[i]["size"], got[i]["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))


def test_long_texts_make_more_buckets(spark):
    rows = spark.createDataFrame([(i, "x" * 1000) for i in range(200)], "doc_id long, text string")
    assert sharding._buckets(rows, 4096, 1 << 24) == 1
    assert sharding._buckets(rows, 4096, 50000) == 4
    got = sharding.shuffle_shards(rows, 3, bucket_bytes=50000).collect()
    assert len({r["doc_id"] for r in got}) == 200
    for k in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(66 + (k < 2)))
