import random
import re

from staylens.llm import near_copies

from .samples import prose


def _set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _like(a, b):
    return a == b or len(a & b) * 5 >= len(a | b) * 4


def _kept(rows):
    """Ids of the first document of each component, by brute force."""
    sets, group = [_set(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if _like(a, sets[j]):
                x, y = sorted((root(i), root(j)))
                group[y] = x
    return sorted(rows[i][0] for i in range(len(rows)) if root(i) == i)


def _edited(text, n, r):
    w = text.split(" ")
    for i in r.sample(range(len(w)), n):
        w[i] = f"x{r.randrange(10**9)}"
    return " ".join(w)


def test_near_copies_equal_brute_force(spark):
    """Copies with words changed here and there, about the similarity and below, and one large group."""
    r = random.Random(3)
    texts = [prose(r.randint(1, 300), 1000 + i) for i in range(60)]
    texts += [_edited(t, r.randint(0, max(0, len(t.split(" ")) // 30)), r) for t in texts for _ in range(3)]
    base = prose(400, 77)
    texts += [_edited(base, r.randint(1, 10), r) for _ in range(60)] + ["", None, " ", "Zwei Wörter", "zwei Wörter"]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x.doc_id for x in got.collect()) == _kept(rows)


def test_pipeline_stage_takes_near_copies(spark):
    import corpus_pipeline

    base = prose(200, 8)
    words = base.split(" ")
    near = " ".join(["other", *words[1:60], "another", *words[61:]])
    assert _like(_set(base), _set(near))
    docs = spark.createDataFrame([(1, base), (2, near), (3, prose(200, 9))], "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]


def test_rows_that_share_an_id_are_told_apart(spark):
    rows = [(1, prose(50, 1)), (1, prose(50, 2)), (1, prose(50, 2)), (None, prose(50, 3)), (None, prose(50, 4)), (2, prose(50, 4)), (None, prose(50, 3))]
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([rows[0], rows[1], rows[3], rows[5]], "doc_id long, text string").collect()))


def test_band_of_many_sets_equals_brute_force(spark):
    """Groups of over 200 sets that share bands, with members that link to few of their group and to no lead, in blocks of few sets."""
    r = random.Random(11)
    base = prose(400, 500)
    texts = [_edited(base, r.randint(0, 9), r) for _ in range(330)]
    texts += [_edited(t, r.randint(1, 8), r) for t in r.sample(texts, 60)]
    other = prose(60, 501)
    texts += [_edited(other, r.randint(1, 3), r) for _ in range(240)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(x.doc_id for x in near_copies.keep_one(docs).collect())
    assert got == _kept(rows) and 20 < len(got) < len(rows) / 2


def test_blocks_give_the_links_of_all_pairs():
    import numpy as np
    import pyarrow as pa

    r = random.Random(2)
    sets = [sorted(r.sample(range(30), r.randint(1, 25))) for _ in range(80)]
    table = lambda ids: pa.table({"key": pa.array(ids, pa.int64()), "label": pa.array([i % 7 for i in ids], pa.int64()), "hashes": pa.array([sets[i] for i in ids], pa.list_(pa.int64()))})
    asked, held = range(30), range(20, 80)
    got = set(zip(*near_copies.block_links((4, 5), table(asked), table(held)).to_pydict().values(), strict=True))
    true = {(min(i, j), max(i, j)) for i in asked for j in held if i % 7 != j % 7 and len(set(sets[i]) & set(sets[j])) * 5 >= len(set(sets[i]) | set(sets[j])) * 4}
    assert got <= true and {(i, sets_of % 7) for i, sets_of in true} | {(j, i % 7) for i, j in true} >= {(i, j % 7) for i, j in got}
    linked = lambda pairs: {(i, j % 7) for i, j in pairs if i in asked} | {(j, i % 7) for i, j in pairs if j in asked and i in held}
    assert {x for x in linked(true)} == {x for x in linked(got)} and true and np.array(list(true)).shape[1] == 2
