import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from tokenizers import Tokenizer

from staylens.llm import token_store
from staylens.llm.common import shared_dir

from .samples import DOCS

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_words_encode_as_whole_texts(library):
    texts = [t or "" for _, t, _ in DOCS] + ["İstanbul, Å क़ don't <|endoftext|>x ab.cd ... ΣΑΣ, x\x1cy\u2028z 12a, été. a\u0301, “q”."]
    coder = token_store.WordEncoder(PATH)
    got = [np.frombuffer(x, coder.width).tolist() for x in coder.encode([t.encode() for t in texts])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_rows_equal_brute_force(docs, library):
    start, want = 0, []
    for d, t, _ in sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    rows = token_store.round_trip(docs, PATH).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in rows), key=lambda r: r[1]) == want
    assert token_store.round_trip(docs.limit(0), PATH).count() == 0


def test_lookup(spark):
    folder = shared_dir(spark)
    docs = spark.createDataFrame([(i * 3 - 5000, f"doc number {i} " * 20) for i in range(4000)] + [(1000, "again")], "doc_id long, text string")
    manifest = token_store.write_shards(docs, PATH, folder).collect()
    fs, _ = pafs.FileSystem.from_uri(folder)
    shards = [token_store.Shard(fs.open_input_file(r.path)) for r in manifest]
    assert sum(s.n_docs for s in shards) == 4001
    assert max(len(s.blocks) for s in shards) > 1
    found = lambda k: [x.tolist() for s in shards for x in s.get(k)]
    assert len(found(1000)) == 2
    assert len(found(-5000)) == len(found(3 * 3999 - 5000)) == 1
    assert found(-4999) == found(99999) == []
    assert sum(s.may_have(token_store.key_of(3 * i + 1 - 5000)) for i in range(1000) for s in shards) < 0.1 * 1000 * len(shards)


def test_damage_is_seen():
    out = pa.BufferOutputStream()
    w = token_store.ShardWriter(out, np.dtype("<u2"))
    for i in range(50):
        w.add(token_store.key_of(i), b"\1\0" * i)
    w.close()
    data = bytearray(out.getvalue().to_pybytes())
    assert [len(v) for _, v in token_store.Shard(pa.BufferReader(bytes(data)))] == [2 * i for i in range(50)]
    data[10] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(token_store.Shard(pa.BufferReader(bytes(data))))
    with pytest.raises(ValueError, match="not a shard"):
        token_store.Shard(pa.BufferReader(bytes(data[:-3])))


@pytest.mark.parametrize("form", ["{0}", "z{0}.", "({0}x&&& a{0}", "'{0} {0}'s", "e{0}́, .{0}"])
def test_every_codepoint_encodes_as_in_the_library(library, form):
    coder = token_store.WordEncoder(PATH)
    points = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    for i in range(0, len(points), 20_000):
        texts = [form.format(x) for x in points[i : i + 20_000]]
        got = [np.frombuffer(x, coder.width).tolist() for x in coder.encode([t.encode() for t in texts])]
        assert got == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_shards_roll_and_rows_without_id_are_many_tasks(spark, library):
    folder = shared_dir(spark)
    rows = [(None, f"no id {i}") for i in range(3000)] + [(7, "same")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = token_store.write_shards(docs, PATH, folder, most_docs=500).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    made = spark.createDataFrame(shards)
    assert sum(r.n_docs for r in shards) == 6000 and max(r.n_docs for r in shards) == 500
    assert len({r.part for r in shards}) == 4
    back = token_store.read_shards(made, folder).orderBy("start").collect()
    assert [r.doc_id for r in back] == [r[0] for r in rows]
    assert [r.start for r in back] == np.cumsum([0, *(r.n_tokens for r in back)])[:-1].tolist()
    assert {tuple(np.frombuffer(r.ids, "<u4")) for r in back if r.doc_id} == {(*library.encode("same", add_special_tokens=False).ids, 2)}


def test_columns_of_clashing_names_are_left_alone(spark):
    docs = spark.createDataFrame([(2, "b", 1, "x", "y"), (1, "a", 2, "x", "y")], "doc_id long, text string, _row long, _digest string, ids string")
    assert [r.doc_id for r in token_store.round_trip(docs, PATH).orderBy("start").collect()] == [1, 2]
