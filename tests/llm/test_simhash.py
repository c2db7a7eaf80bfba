import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from staylens.llm import simhash

from .samples import DOCS


def _print(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(prints):
    group = {p: p for p in prints}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    every = list(prints)
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= 2:
                group[max(root(a), root(b))] = min(root(a), root(b))
    return {p: root(p) for p in every}


def _unsigned(x):
    return x & (1 << 64) - 1


def test_rows_equal_brute_force(docs):
    prints = {_print(t) for _, t, _ in DOCS}
    of = _components(prints)
    least = {}
    for d, t, _ in DOCS:
        if d is not None:
            least[of[_print(t)]] = min(d, least.get(of[_print(t)], d))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, _unsigned(r.fp), r.component_id) for r in got) == Counter((d, _print(t), least.get(of[_print(t)])) for d, t, _ in DOCS)


def test_links_of_dense_and_sparse_groups_equal_brute_force(spark):
    """Chains and balls of fingerprints around centres, so that keys are both paired and met."""
    r = random.Random(11)
    prints = set()
    for size, flips in ((400, 4), (60, 3), (30, 2), (200, 12)):
        x = r.getrandbits(64)
        for _ in range(size):
            y = x
            for b in r.sample(range(64), r.randint(0, flips)):
                y ^= 1 << b
            prints.add(y)
    of = _components(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    edges = simhash.links(df)
    assert edges.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    assert edges.filter("a >= b").count() == 0
    got = {_unsigned(x.node): x.label for x in simhash.components(edges).collect()}
    mine = {}
    for p in prints:
        mine.setdefault(got.get(p, simhash._signed(p)), set()).add(p)
    brute = {}
    for p in prints:
        brute.setdefault(of[p], set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, brute.values()))


def test_every_pair_of_sparse_keys_is_a_link(spark):
    r = random.Random(5)
    x = [r.getrandbits(64) for _ in range(50)]
    prints = {y ^ m for y in x for m in (0, 1 << r.randrange(64), (1 << r.randrange(64)) | (1 << r.randrange(64)))}
    want = {(a, b) for a in prints for b in prints if simhash._signed(a) < simhash._signed(b) and (a ^ b).bit_count() <= 2}
    got = {(_unsigned(e.a), _unsigned(e.b)) for e in simhash.links(spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")).collect()}
    assert got == want


def test_one_of_each_group_stays(docs):
    kept = simhash.keep_one(docs).collect()
    ids = [r.doc_id for r in kept]
    assert 7 in ids and 8 not in ids and ids.count(9) <= 1
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.keep_one(docs.limit(0)).count() == 0
