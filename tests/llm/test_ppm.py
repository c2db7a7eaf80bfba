import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from staylens.llm import ppm

from .samples import DOCS


def _held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 1


def _base(docs):
    w = lambda t: [x.lower() if x.isascii() else x for x in (t or "").encode().translate(ppm._LOWER).decode().split(" ")]  # noqa: E731, F841
    split = lambda t: (t or "").encode().translate(ppm._LOWER).split() + [None]
    count = Counter(x for d, t, *_ in docs if not _held(d) for x in split(t))
    n, v = count.total(), len(count)
    return Counter((d, _held(d), len(split(t)), sum(count[x] > 0 for x in split(t)), n, round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in split(t)), 6)) for d, t, *_ in docs)


DEPTH = 4


def _bytes(text, depth):
    return (256,) * depth + tuple(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()) + (256,)


def _trie(docs, depth=DEPTH):
    nodes = defaultdict(Counter)
    for d, t, *_ in docs:
        if not _held(d):
            data = _bytes(t, depth)
            for i in range(depth, len(data)):
                for k in range(depth + 1):
                    nodes[data[i - k : i]][data[i]] += 1
    return nodes


def _score(nodes, text, depth=DEPTH):
    data, total = _bytes(text, depth), 0.0
    for i in range(depth, len(data)):
        offered, left = set(), 1.0
        for k in range(depth, -1, -1):
            node = {b: n for b, n in nodes[data[i - k : i]].items() if b not in offered} if data[i - k : i] in nodes else {}
            escapes = 0 if len(set(node) | offered) == 257 else len(node)
            size = sum(node.values()) + escapes
            if data[i] in node:
                total += math.log10(left * node[data[i]] / size)
                break
            if node:
                left *= escapes / size
                offered |= set(node)
        else:
            total += math.log10(left / (257 - len(offered)))
    return total


def _model_scores(texts, asked, depth):
    model = ppm.Model(list(ppm.levels(*ppm.grams([t.encode() for t in texts], depth), depth)))
    codes = np.unique(ppm.positions([t.encode() for t in asked], depth)[0])
    return ppm.summed(codes, model.log_probs(codes), [t.encode() for t in asked], depth)


def test_rows_equal_brute_force(docs):
    rows = ppm.score(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == _base(DOCS)
    nodes = _trie(DOCS)
    by = defaultdict(list)
    for d, t, _ in DOCS:
        if d is not None:
            by[d].append(_score(nodes, t))
    for r in rows:
        if r.doc_id is not None:
            assert any(math.isclose(r.score, x, rel_tol=1e-4, abs_tol=1e-4) for x in by[r.doc_id]), r.doc_id
    assert any(r.held_out for r in rows)


def test_held_out_prose_is_likelier_than_noise(spark):
    docs = [(i, f"the cat sat on the mat and the dog ran to the house number {i} " * 5) for i in range(60)] + [(1000 + i, "zq9 xj%k wv$q " * 20) for i in range(1) if _held(1000 + i)]
    noise = next(i for i in range(5000, 6000) if _held(i))
    rows = ppm.score(spark.createDataFrame([*docs, (noise, "zq9 xj%k wv$q " * 20)], "doc_id long, text string")).collect()
    per = {r.doc_id: r.score / r.n_tokens for r in rows}
    assert per[noise] < min(per[r.doc_id] for r in rows if r.held_out and r.doc_id < 1000)


def test_empty(docs):
    assert ppm.score(docs.limit(0)).count() == 0
    (told,) = _model_scores([], ["abc"], 4)
    assert math.isclose(told, -4 * math.log10(257), rel_tol=1e-9)


def test_any_depth_and_all_bytes_equal_brute_force():
    texts = [bytes(range(1, 256)).decode("latin-1"), "".join(map(chr, range(256))) * 2, "abracadabra", "", "ABRA cadabra \0 x"]
    for depth in (0, 1, 2, 5):
        docs = [(None, t) for t in texts]
        nodes = _trie(docs, depth)
        asked = [*texts, "something else altogether", "\u00ff\u00fe", "zzzz"]
        for t, got in zip(asked, _model_scores(texts, asked, depth), strict=True):
            assert math.isclose(got, _score(nodes, t, depth), rel_tol=1e-9, abs_tol=1e-9)


def test_no_partition_depth_or_size_changes_scores(spark):
    docs = [(None, "the cat sat on the mat and the dog ran to the house " * 9), (None, "a rare word here \0 and \0\0"), (1, "the cat ran"), (2, "a zebra\0"), (None, None)]
    told = next(i for i in range(3, 99) if _held(i))
    docs.append((told, "zebras sat \0\0 rarely"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for depth in (0, 1, 3, 4, 5):
        nodes = _trie(docs, depth)
        want = sorted(round(_score(nodes, t, depth), 9) for _, t in docs)
        for n in (1, 5):
            assert sorted(round(r.score, 9) for r in ppm.score(df.repartition(n), depth).collect()) == want


def test_probabilities_of_texts_with_zero_bytes_sum_to_less_than_one():
    told = _model_scores(["", "", ""], ["", "\0", "\0\0", "a"], 4)
    assert sum(10.0**x for x in told) < 1 and max(told) == told[0]


def test_longer_contexts_and_probabilities_of_all_texts(spark):
    """With two symbols seen, the probabilities of all texts of a length and of their beginnings sum to one or less."""
    texts = ["ab" * 20, "abba", "b"]
    model = ppm.Model(list(ppm.levels(*ppm.grams([t.encode() for t in texts], 3), 3)))
    each = np.arange(257)
    for context in (256, ord("a"), ord("a") << 18 | ord("b") << 9 | ord("a"), ord("q")):
        assert math.isclose(sum(10.0 ** model.log_probs(context << 9 | each)), 1.0, rel_tol=1e-9)
