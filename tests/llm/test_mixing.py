"""Mixing: targets by the rule, flows against all small flows, and documents taken so that quotas are met."""

import itertools
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from staylens.llm import mixing, queries

from .samples import DOCS


def _size(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def _targets(sizes, weights, share):
    """By the rule's own words: stop those above, share the excess again by weight, until none is above."""
    out, held = dict.fromkeys(sizes, Fraction(0)), set()
    left = Fraction(share) * sum(sizes.values())
    while len(held) < len(sizes) and left > 0:
        total = sum(w for s, w in weights.items() if s not in held)
        for s in sizes:
            if s not in held:
                out[s] += left * weights[s] / total
        left = Fraction(0)
        for s in sizes:
            if s not in held and out[s] >= 2 * sizes[s]:
                left += out[s] - 2 * sizes[s]
                out[s] = Fraction(2 * sizes[s])
                held.add(s)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_targets(seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.choice([0, 1, 7, 50, 1000]) for i in range(r.randint(1, 9))}
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    got = mixing.targets(sizes, weights)
    assert got == _targets(sizes, weights, mixing.SHARE)
    assert sum(got.values()) == mixing.SHARE * sum(sizes.values())


@pytest.mark.parametrize("seed", range(20))
def test_route_is_largest_and_cheapest(seed):
    r = random.Random(seed)
    patterns = {("a",): r.randint(0, 3), ("a", "b"): r.randint(0, 3), ("b",): r.randint(0, 2)}
    quotas = {"a": r.randint(0, 6), "b": r.randint(0, 6)}
    got = mixing.route(patterns, quotas, 2, 1)

    def price(size, n):
        return max(0, n - size)

    best = None
    for one, two, three, four in itertools.product(*(range(2 * patterns[p] + 1) for p in (("a",), ("a", "b"), ("a", "b"), ("b",)))):
        if two + three <= 2 * patterns["a", "b"] and one + two <= quotas["a"] and three + four <= quotas["b"]:
            cost = price(patterns["a",], one) + price(patterns["a", "b"], two + three) + price(patterns["b",], four)
            best = max(best or (-1, 0), (one + two + three + four, -cost))
    flows = [sum(got[p].values()) for p in patterns]
    assert (sum(flows), -sum(price(n, f) for n, f in zip(patterns.values(), flows, strict=True))) == best
    assert got["a",]["a"] + got["a", "b"]["a"] <= quotas["a"] and all(f <= 2 * n for f, n in zip(flows, patterns.values(), strict=True))


def test_overlapping_sources(spark):
    r = random.Random(3)
    kinds = [["a"], ["b"], ["a", "b"], ["b", "c", "b"], ["c"], [None], ["c", None], [], None]
    rows = [(i, "w " * r.randint(0, 30), r.choice(kinds)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own array<string>")
    found = mixing.mix(docs, mixing.words("text"), F.col("own")).collect()
    assert len(found) == len(rows)
    own = {i: tuple(sorted(set(s or []), key=lambda x: (x is None, x or ""))) for i, _, s in rows}
    sizes, patterns = defaultdict(int), Counter()
    for i, t, _ in rows:
        patterns[own[i]] += _size(t)
        for s in own[i]:
            sizes[s] += _size(t)
    goal = {s: t for x in found for s, t in zip(x.sources, x.target, strict=True)}
    taken = defaultdict(int)
    for x in found:
        assert tuple(x.sources) == own[x.doc_id] and x.size == _size(rows[x.doc_id][1]) and x.taken == sum(x.by_source) <= 2 * x.size and x.taken % max(x.size, 1) == 0
        assert x.source_size == [sizes[s] for s in x.sources]
        for s, n in zip(x.sources, x.by_source, strict=True):
            taken[s] += n
    assert all(abs(taken[s] - goal[s]) <= 3 for s in goal)
    whole = sum(n for p, n in patterns.items() if p)
    assert abs(sum(goal.values()) - 1.5 * whole) < 1e-6


def test_rows_that_are_odd(spark):
    rows = [(d, t, ("x", None, "é", "z")[i % 4]) for i, (d, t, _) in enumerate(DOCS)] + [(None, None, None)] * 40 + [(77, "same words here", "x")] * 200
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, _n long, size long").repartition(5)
    found = mixing.mix_by_source(docs)
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken"]
    got = Counter(tuple(r) for r in found.collect())
    assert got == Counter(tuple(r) for r in mixing.mix_by_source(docs.repartition(2)).collect())
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += _size(t)
    weights = {s: w for s, w in zip(sorted(sizes, key=lambda s: (s is None, s or "")), (5, 2, 1, 5), strict=True)}
    goal = _targets(sizes, weights, Fraction(3, 2))
    want = Counter((d, _size(t), sizes[s], float(goal[s])) for d, t, s in rows)
    assert Counter(r[:4] for r, n in got.items() for _ in range(n)) == want
    assert all(r[4] % max(r[1], 1) == 0 and r[4] <= 2 * r[1] for r in got)


def test_empty_table(spark):
    assert mixing.mix_by_source(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    only = mixing.mix_by_source(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string"))
    assert sorted(tuple(r) for r in only.collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_query_of_given_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = queries.op12_mixing(spark, folder).collect()
    sizes = defaultdict(int)
    for r in docs.values():
        sizes[r.source] += _size(r.text)
    names = sorted(sizes)
    goal = _targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, Fraction(3, 2))
    taken = defaultdict(int)
    for x in found:
        s = docs[x.doc_id].source
        assert (x.size, x.source_size, x.target) == (_size(docs[x.doc_id].text), sizes[s], float(goal[s]))
        taken[s] += x.taken
    assert len(found) == len(docs) and all(abs(taken[s] - goal[s]) <= 0.05 * goal[s] for s in names)
