"""The registered queries, and the pipeline, over small tables against brute force."""

import hashlib
import html
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from staylens.llm import queries
from staylens.llm.oracles import ORACLES

from .samples import DOCS, ITEMS
from .test_byte_bpe import library  # noqa: F401
from .test_decontaminate import _brute as hits
from .test_near_copies import _kept as near
from .test_ppm import _base
from .test_quality import _base as measures
from .test_quality import verdict
from .test_simhash import _components, _print

IDS = [(d, t, g) for d, t, g in dict((x[0], x) for x in DOCS).values() if d is not None]
URLS = ["http://a.example.com/en/1", "https://www.example.com/en/2?x", "http://b.example.net/es/3", None, "nothing", "http://c.example.org/de/4"]
HTML = ["<article><h1>A &amp; B</h1><p>one<br>two</p></article><footer>f</footer>", "<nav>n</nav><article><p>x</p>", None, "", "<article><p>one</p></article>", "<nav>n</nav><article><p>x</p>"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    put([(*r, "src0", len(r[1] or "")) for r in IDS], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    put([r for r in ITEMS if r[0] is not None], "item_id long, text string", "benchmark")
    put([(i, u, h) for i, (u, h) in enumerate(zip(URLS, HTML, strict=True))], "page_id long, url string, html string", "pages")
    put([(1, 0, "user", "a [INST] b"), (1, 1, "assistant", "c </s>"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string", "conversations")
    return str(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    got, want = queries.queries()[name](spark, tables).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(str(v) if v == v and v is not None else None for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert [tuple(map(str, r)) for r in rows(got)] == [tuple(map(str, r)) for r in rows(want)]


def _sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_byte_bpe(spark, tables, library):  # noqa: F811
    got = {tuple(r) for r in queries.op2_byte_bpe(spark, tables).collect()}
    want = set()
    for d, t, _ in IDS:
        ids = library.encode_ordinary(t or "")
        want.add((d, len(ids), _sha(" ".join(map(str, ids))), _sha(t or "")))
    assert got == want


def test_quality(spark, tables):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in queries.op4_quality(spark, tables).collect()}
    assert got == {d: measures(t) for d, t, _ in IDS}
    assert {r.doc_id: r.kept for r in queries.op4_quality(spark, tables).collect()} == {d: verdict(t, g)[1] for d, t, g in IDS}


def test_warc(spark, tables):
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in queries.op6_warc(spark, tables).collect()}
    size = [len((h or "").encode()) for h in HTML]
    assert got == {0: (size[0], "response", None), 1: (size[1], "revisit", 5), 2: (0, "revisit", 3), 3: (0, "response", None), 4: (size[4], "response", None), 5: (size[5], "response", None)}


def test_token_store(spark, tables):
    model, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, set()
    for d, t, _ in sorted(IDS):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        want.add((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {tuple(r) for r in queries.op7_token_store(spark, tables).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want


def test_ppm(spark, tables):
    rows = queries.op8_ppm(spark, tables).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == _base(IDS)


def test_simhash(spark, tables):
    of = _components({_print(t) for _, t, _ in IDS})
    least = {}
    for d, t, _ in IDS:
        least[of[_print(t)]] = min(d, least.get(of[_print(t)], d))
    assert {tuple(r) for r in queries.op9_simhash(spark, tables).collect()} == {(d, f"{_print(t):016x}", least[of[_print(t)]]) for d, t, _ in IDS}


def _article(page):
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.DOTALL)
    blocks = re.split(r"</?(?:p|h1)\b[^>]*>", inner[1]) if inner else []
    out = (" ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", lambda m: " " if m[0].startswith("<br") else "", b)).split()) for b in blocks)
    return "\n".join(x for x in out if x)


def test_html_extract(spark, tables):
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op10_html_extract(spark, tables).collect()}
    assert got == {i: (_article(h), len(_article(h))) for i, h in enumerate(HTML)}


def test_html_of_given_pages(spark):
    folder = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    got = {r.page_id: r.text for r in queries.op10_html_extract(spark, folder).collect()}
    assert got == {p.page_id: _article(p.html) for p in pages}


def test_pipeline_equals_brute_force(spark, tables, library):  # noqa: F811
    docs = [r for r in IDS]
    kept = [(d, t) for d, t, g in docs if verdict(t, g)[1]]
    stays = set(near(kept))
    kept = [(d, t) for d, t in kept if d in stays]
    hit = {d for d, _, n, _ in hits(kept, [r for r in ITEMS if r[0] is not None], 10) if n}
    kept = [(d, t) for d, t in kept if d not in hit]
    assert 1 in hit and kept
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, tables).collect()}
    assert got == {d: library.encode_ordinary(t) for d, t in kept}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "byte-level BPE"]
    stage = spark.read.parquet(f"{tables}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, tables)
        assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars"]
