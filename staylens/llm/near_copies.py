"""Near copies by the exact Jaccard similarity of word shingles, found over MinHash bands.

A document is the set of its shingles; documents of one set are folded. Two sets are candidates if their SimHash
fingerprints over the shingles link (simhash.links: pigeonring filtering within two bits). That finds copies with next to
nothing changed; most pairs of similarity 0.8 differ by three to a dozen bits of 64, for which no key is left that is
both short enough to be shared and long enough to be rare. So two sets are candidates too if all minima of one of BANDS
bands are equal, which pairs of similarity 0.8 miss with a chance of (1 - 0.8^ROWS)^BANDS = 4 in 10,000. Every candidate
is confirmed by the intersection of its sets, so that a link is never a guess.

A band with many sets (a large group of near copies) is not paired. Its sets are held against one of them, the same one in
all bands that it is in, so the work stays in proportion to the rows. That joins most of a group. A set that is then left
outside a band's largest component is held against all sets of that component, and against the others left out of the
band: these are dealt out in blocks of about BLOCK shingles on either side, a block's overlaps are counted in one task by
binary search, and only links leave it. So each two sets that share a band are held against each other or lie in one
component, whatever the size of the band, and no pair is a row before it is a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_first, lists, pieces, raw_texts, row_key, write_shared
from .simhash import components, majority, packed
from .simhash import links as ring_links

BANDS, ROWS, SEED, BLOCK = 20, 5, 42, 200_000
MOST_SENT = 500_000  # digests of eight bytes in a table that is sent to all tasks
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TURNS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_SETS = "key long, size long, fp long, bands array<long>"


def shingles(text: bytes, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of `width` words, ascending; of fewer words there is one shingle, of none none."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end + 1 - size
    n = max(1, len(words) - width + 1)
    cut = [joined[a:b] for a, b in zip(start[:n].tolist(), end[-n:].tolist(), strict=True)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, n))


def _key(found: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(found.tobytes(), SEED), "big", signed=True)


def _print(found: np.ndarray) -> int:
    """SimHash of a set of shingles; of an empty one zero."""
    return packed(majority(found.astype(">u8").view(np.uint8).reshape(-1, 8)), len(found))


def bands(found: np.ndarray) -> np.ndarray:
    """One signed hash for each band; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(len(_TURNS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 4096):
        mixed = found[None, i : i + 4096] * _TURNS
        least = np.minimum(least, (mixed ^ mixed >> np.uint64(29)).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _signed_up(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text"):
            sets = [shingles(x, width) for x in raw_texts(batch.column("text"))]
            filed = [bands(x) for x in sets]
            of_bands = lists(np.concatenate([np.zeros(0, np.int64), *filed]), np.array([len(x) for x in filed], np.int64), pa.int64())
            made = [pa.array([_key(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([_print(x) for x in sets], pa.int64()), of_bands]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), batch.column("digest"), *made], ["_row", "doc_id", "digest", "key", "size", "fp", "bands"])


def _sets(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and hashes of each set, once a task."""
    seen = set()
    for whole in batches:
        for batch in pieces(whole, "text"):
            sets = {k: x for x in (shingles(t, width) for t in raw_texts(batch.column("text"))) if (k := _key(x)) not in seen}
            seen |= sets.keys()
            flat = np.concatenate([*sets.values(), np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()) if sets else pa.array([], pa.int64()), lists(flat, np.array([len(x) for x in sets.values()], np.int64), pa.int64())], ["key", "hashes"])


def _could(a: Column, b: Column, similarity: tuple[int, int]) -> Column:
    """Sizes that allow the similarity."""
    return F.least(a, b) * similarity[1] >= F.greatest(a, b) * similarity[0]


def _fetched(keys: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """key and hashes of the sets of keys, read from one text of each."""
    wanted = write_shared(classes.select("key", "digest").join(keys.distinct(), "key").select("digest").distinct())
    few = F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted  # else all texts would be shuffled
    texts = docs.select("text", F.xxhash64("text").alias("digest")).join(few, "digest", "left_semi").select("text")
    return write_shared(texts.mapInArrow(lambda it: _sets(width, it), "key long, hashes array<long>").dropDuplicates(["key"]))


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b) of keys those whose sets are similar."""
    pairs = write_shared(pairs.distinct())
    sets = _fetched(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))), docs, classes, width)
    one, two = (sets.select(F.col("key").alias(x), F.col("hashes").alias(f"in_{x}")) for x in "ab")
    both = F.size(F.array_intersect("in_a", "in_b"))
    like = both * similarity[1] >= (F.size("in_a") + F.size("in_b") - both) * similarity[0]
    return write_shared(pairs.join(one, "a").join(two, "b").filter(like).select("a", "b"))


def _star(one: Column, two: Column) -> list[Column]:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def block_links(similarity: tuple[int, int], asked: pa.Table, held: pa.Table) -> pa.Table:
    """Links between the sets asked about and those of a block, of other components: for each asked set one to each component that it meets."""
    labels, keys = held["label"].to_numpy(), held["key"].to_numpy()
    column = held["hashes"].combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(keys)), sizes)[order]
    out: set[tuple[int, int]] = set()
    for key, label, hashes in zip(asked["key"].to_pylist(), asked["label"].to_pylist(), asked["hashes"], strict=True):
        own = hashes.values.to_numpy(zero_copy_only=False)
        first, n = np.searchsorted(flat, own), np.searchsorted(flat, own, "right")
        n -= first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(keys))
        like = (both * similarity[1] >= (len(own) + sizes - both) * similarity[0]) & (labels != label)
        for other in dict(zip(labels[like].tolist(), keys[like].tolist(), strict=True)).values():
            out.add((min(key, other), max(key, other)))
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def _dealt(rows: DataFrame, name: str, block: int) -> DataFrame:
    """rows (group, key, size, ...) with a part of their group, so many that each has about `block` shingles, and the number of parts."""
    sizes = rows.groupBy("group").agg(F.ceil(F.sum("size") / block).cast("int").alias(f"{name}_n"))
    return rows.join(sizes, "group").withColumn(name, F.pmod(F.xxhash64("key"), F.col(f"{name}_n")).cast("int"))


def _rest(many: DataFrame, found: DataFrame, docs: DataFrame, classes: DataFrame, width: int, similarity: tuple[int, int], block: int) -> DataFrame | None:
    """Links of the sets that are outside their band's largest component; none if there are no such sets."""
    labels = components(found).withColumnRenamed("node", "key")
    stood = write_shared(many.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")))
    main = stood.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("n_labels")).filter("n_labels > 1")
    out = write_shared(stood.join(main, "band").filter("label <> main").select("band", "key", "size", "label", "main"))
    if out.isEmpty():
        return None
    # against the largest component of each band, whichever band led there; and among those left out of a band
    by_label = lambda label: F.concat(F.lit("c"), F.col(label).cast("string")).alias("group")
    by_band = out.select(F.concat(F.lit("b"), F.col("band").cast("string")).alias("group"), "key", "size", "label")
    asked = out.select(by_label("main"), "key", "size", "label").distinct().union(by_band)
    groups = out.select(F.col("main").alias("label")).distinct()
    everyone = classes.filter("size > 0").select("key", "size").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    held = everyone.join(groups, "label").select(by_label("label"), "key", "size", "label").union(by_band)
    asked, held = write_shared(_dealt(asked, "q", block)), write_shared(_dealt(held, "m", block))
    sets = _fetched(asked.select("key").union(held.select("key")), docs, classes, width)
    each = lambda rows, other, n: rows.join(other.select("group", n).distinct(), "group")
    queries = each(asked, held, "m_n").withColumn("m", F.explode(F.sequence(F.lit(0), F.col("m_n") - 1))).join(sets, "key").select("group", "q", "m", "key", "label", "hashes")
    members = each(held, asked, "q_n").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("q_n") - 1))).join(sets, "key").select(*[F.col(c).alias(c) for c in ("group", "q", "m", "key", "label", "hashes")])
    met = queries.groupBy("group", "q", "m").cogroup(members.groupBy("group", "q", "m"))
    return write_shared(met.applyInArrow(lambda x, y: block_links(similarity, x, y), "a long, b long"))


def links(classes: DataFrame, docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (4, 5), most_paired: int = 12, block: int = BLOCK) -> DataFrame:
    """Links (a, b), a < b, between keys of classes (key, size, fp, bands, digest): those that link by fingerprint, all from
    bands of up to most_paired sets, and from larger bands enough of them to join whatever links."""
    filed = classes.select("key", "size", F.explode("bands").alias("band"))
    sizes = filed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("key", "size"), F.xxhash64("key")).alias("lead")).filter("n > 1")
    shared = write_shared(filed.join(sizes, "band"))

    few = shared.filter(F.col("n") <= most_paired).groupBy("band").agg(F.array_sort(F.collect_list(F.struct("key", "size"))).alias("sets"))
    one = few.select(F.explode("sets").alias("one"), "sets")
    paired = one.select(F.col("one.key").alias("a"), F.explode(F.filter("sets", lambda x: (x["key"] > F.col("one.key")) & _could(x["size"], F.col("one.size"), similarity))["key"]).alias("b"))
    many = shared.filter(F.col("n") > most_paired).select("band", "key", "size", "lead")
    stars = many.filter((F.col("key") != F.col("lead.key")) & _could(F.col("size"), F.col("lead.size"), similarity)).select(*_star(F.col("key"), F.col("lead.key")))
    prints = write_shared(classes.filter("size > 0").groupBy("fp").agg(F.min("key").alias("lead")))
    near = ring_links(prints.select("fp")).join(prints.select(F.col("fp").alias("a"), F.col("lead").alias("one")), "a").join(prints.select(F.col("fp").alias("b"), F.col("lead").alias("two")), "b").select(*_star(F.col("one"), F.col("two")))
    same = classes.filter("size > 0").join(prints, "fp").filter("key <> lead").select(*_star(F.col("key"), F.col("lead")))
    found = _confirmed(paired.union(stars).union(near).union(same), docs, classes, width, similarity)
    rest = _rest(many.drop("lead"), found, docs, classes, width, similarity, block)
    return found if rest is None else found.union(rest)


def keep_one(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row of each component of near copies, that of the smallest doc_id, with all columns of docs.

    Near copies are texts whose sets of shingles of `width` words (split at white space, A-Z as a-z) have a Jaccard
    similarity of similarity[0] / similarity[1] or more. Texts without a word are copies of each other. A row without a
    doc_id stays only if its component has none with one; of repeated rows one stays; an empty table stays empty.
    """
    rows = docs.select(row_key().alias("_row"), "doc_id", "text", F.xxhash64("text").alias("digest"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = write_shared(rows.mapInArrow(lambda it: _signed_up(width, it), f"_row binary, doc_id {kind}, digest long, {_SETS}"))
    classes = write_shared(found.groupBy("key").agg(*[F.first(x).alias(x) for x in ("size", "fp", "bands", "digest")]))
    labels = components(links(classes, docs, width, similarity)).withColumnRenamed("node", "key")
    return keep_first(docs, found.select("_row", "doc_id", "key"), labels)
