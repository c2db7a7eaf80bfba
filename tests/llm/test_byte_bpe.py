import base64
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from staylens.llm import byte_bpe

from .samples import DOCS

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _own(texts):
    ids, counts = byte_bpe.encode_texts(texts, PATH)
    ids = ids.tolist()
    cut = [sum(counts[:i]) for i in range(len(texts) + 1)]
    return [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def test_random_strings_as_the_library(library):
    r = random.Random(3)
    parts = [*" \n\t'stmdrevl.,!12٣é漢😀A\x1c\x85_", "'re", "'ll", "  ", "\r\n", "'S", "a" * 50]
    texts = ["".join(r.choices(parts, k=r.randint(0, 60))) for _ in range(2000)]
    assert _own(texts) == [library.encode_ordinary(x) for x in texts]


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_any_string_as_the_library(text):
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    one = test_any_string_as_the_library.__dict__.setdefault("enc", tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    assert _own([text]) == [one.encode_ordinary(text)]


def test_round_trip_over_rows(docs, library):
    rows = byte_bpe.decode(byte_bpe.encode(docs, PATH), PATH).collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in rows) == Counter((d, (t or "").encode()) for d, t, _ in DOCS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter((d, tuple(library.encode_ordinary(t or ""))) for d, t, _ in DOCS)
    assert all(r.ends == [] or r.ends[-1] == len(r.decoded) for r in rows)
    assert byte_bpe.encode(docs.limit(0), PATH).count() == 0
