import hashlib
import re
from collections import Counter

import pytest

from staylens.llm import decontaminate

from .samples import DOCS, ITEMS, PASSAGE, prose

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _words(text):
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(docs, items, size):
    out = []
    windows = {(str(i) if i is not None else "", tuple(w[k : k + size])) for i, t in items if (w := _words(t)) for k in range(max(1, len(w) - size + 1))}
    for d, text, *_ in docs:
        w = _words(text)
        hit, found = set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(i)
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


@pytest.mark.parametrize(("size", "block"), [(10, 1 << 20), (3, 1 << 20), (10, 100)])
def test_equals_brute_force(spark, docs, size, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.find_matches(docs, items, size, block_bytes=block).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got) == _brute(DOCS, ITEMS, size)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)


def test_proximity_finds_a_word_put_in(spark):
    w = PASSAGE.split()
    text = prose(30, 4) + " " + " ".join([*w[:20], "unseenword", *w[20:]]) + " " + prose(30, 6)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(w[15:25]))], "item_id long, text string")
    assert decontaminate.find_matches(docs, items).first().n_hit == 0
    assert decontaminate.find_matches(docs, items, slop=1).first().n_hit > 0


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_matches(docs, none).count() == len(DOCS)
    assert decontaminate.find_matches(docs.limit(0), none).count() == 0


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
