"""Language-model scoring by prediction by partial matching over bytes, beside a unigram base over words.

The model is a trie of byte contexts of up to `depth` bytes, trained on all training texts. A byte that was seen after
the longest context known has its share of that node's count plus escapes (as many as distinct symbols followed); any
other takes the escape and goes to the shorter context, in which the symbols already offered are excluded; at the root
all symbols not yet offered are alike. A text is followed by an end, a 257th symbol that no text holds, so that the
probabilities of all texts sum to one; the same symbol stands for what is before a text's start. Which symbols a context
excludes in the next shorter one is known when the trie is built, so a node keeps its count, its kinds and the count that
it excludes.

The corpus is gathered in blocks: a task writes each block of rows with its distinct words and its distinct (context,
symbol) pairs counted, so what is shuffled is one row for each of them and block; that grows with the corpus. The trie
is never in one place: its branches are dealt out by the last bytes of the context, each with the few shorter contexts
above it, and a branch scores the pairs that blocks asked of it. Word counts and scores of pairs then return to each block
that has them. Nothing is pruned, whatever the size of the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, join_common, pieces, raw_texts, write_shared

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
FOLDS, HELD_OUT = 5, 1


#: The symbol of the end of a text and of what is before its start, after those of the 256 bytes; and the bits of a symbol.
END, BITS = 256, 9


def mask(n: int) -> int:
    """The last n symbols of a number of positions()."""
    return (1 << BITS * n) - 1


def positions(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text, A-Z lower-cased, and its end: the `depth` symbols before it (END before the start) and
    itself as one number; and the number of these for each text."""
    size = np.array([len(x) + 1 for x in texts], np.int64)
    data = np.frombuffer(b"".join(bytes(depth) + x.translate(_LOWER) + b"\0" for x in texts), np.uint8).astype(np.int16)
    ends = np.cumsum(size + depth)
    data[ends - 1] = END
    for k in range(1, depth + 1):
        data[ends - size - k] = END
    code = np.zeros(max(0, len(data) - depth), np.int64)
    for k in range(depth + 1):
        code <<= BITS
        code |= data[k : len(code) + k]
    inside = np.ones(len(code), bool)
    for k in range(1, depth + 1):
        inside[ends[:-1] - k] = False  # those that reach into the next text
    return code[inside], size


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of positions() and their counts, over slices of the texts."""
    parts, start, held = [], 0, 0
    for i, x in enumerate([*texts, None]):
        if x is None or held > 4 << 20:
            parts.append(pa.array(positions(texts[start:i], depth)[0]))
            start, held = i, 0
        held += len(x or b"")
    found = pc.value_counts(pa.chunked_array(parts, pa.int64()))
    return found.field("values").to_numpy(), found.field("counts").to_numpy()


def levels(codes: np.ndarray, counts: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The nodes of each context length, from zero, that the longest ones come to."""
    for k in range(depth + 1):
        kept, at = np.unique(codes & mask(k + 1), return_inverse=True)
        yield kept, np.bincount(at, counts, len(kept)).astype(np.int64)


class Level:
    """Nodes of one context length: (context, symbol) and counts in order; contexts with their count, kinds, and what they exclude."""

    def __init__(self, k: int, codes: np.ndarray, counts: np.ndarray, shorter: Level | None):
        order = np.argsort(codes)
        self.mask, self.codes, self.counts = mask(k + 1), codes[order], counts[order]
        self.contexts, first, self.kinds = np.unique(self.codes >> BITS, return_index=True, return_counts=True)
        self.n = np.add.reduceat(self.counts, first) if len(first) else first
        if shorter is not None and len(first):
            self.excluded = np.add.reduceat(shorter.counts[np.searchsorted(shorter.codes, self.codes & shorter.mask)], first)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place of each context and whether it is known; place of each node and whether it is known."""
        at, node = np.searchsorted(self.contexts, code >> BITS), np.searchsorted(self.codes, code)
        at, node = np.minimum(at, max(0, len(self.contexts) - 1)), np.minimum(node, max(0, len(self.codes) - 1))
        return at, (self.contexts[at] == code >> BITS), node, (self.codes[node] == code)


class Model:
    """log10 probability of a symbol by those before it."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]]):
        self.levels: list[Level] = []
        for k, (codes, counts) in enumerate(nodes):
            self.levels.append(Level(k, codes, counts, self.levels[-1] if k else None))
        self.depth = len(nodes) - 1

    def log_probs(self, asked: np.ndarray) -> np.ndarray:
        """Of each number of positions(). asked is best in order."""
        out, todo = np.zeros(len(asked)), np.arange(len(asked))
        above = np.full(len(asked), -1)  # place of the context one longer, once one is known
        for k in range(self.depth, -1, -1):
            level = self.levels[k]
            if not len(level.codes) or not len(todo):
                continue
            at, known, node, hit = level.find(asked[todo] & level.mask)
            unknown, todo, at, node, hit = todo[~known], todo[known], at[known], node[known], hit[known]
            n, kinds, longer = level.n[at], level.kinds[at], above[todo]
            full = kinds == END + 1
            if k < self.depth and len(self.levels[k + 1].contexts):
                up = self.levels[k + 1]
                n = n - np.where(longer >= 0, up.excluded[longer], 0)
                kinds = kinds - np.where(longer >= 0, up.kinds[longer], 0)
            escapes = np.where(full, 0, kinds)
            whole = np.log10(np.maximum(n + escapes, 1))
            # where nothing is new to this context, it is passed through
            out[todo] += np.where(hit, np.log10(level.counts[node]) - whole, np.where(escapes > 0, np.log10(np.maximum(escapes, 1)) - whole, 0.0))
            above[todo] = at
            todo = np.concatenate([todo[~hit], unknown])
        kinds = self.levels[0].kinds[0] if len(self.levels[0].codes) else 0
        out[todo] -= np.log10(max(1, END + 1 - kinds))
        return out


def summed(codes: np.ndarray, told: np.ndarray, texts: list[bytes], depth: int) -> list[float]:
    """log10 probability of each text and its end, by that of each number of positions() that they hold."""
    code, size = positions(texts, depth)
    at = pc.index_in(pa.array(code), value_set=pa.array(codes, pa.int64())).to_numpy(zero_copy_only=False)
    return np.add.reduceat(told[at], np.cumsum(size) - size).tolist() if len(size) else []


def words(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def _gathered(depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in blocks, and for each block one row with its words and its pairs, each with its count in training texts."""
    names = ["block", "doc_id", "text", "held_out", "words", "counts", "codes", "times", "n_tokens", "n_docs"]
    kinds = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
    block = TaskContext.get().partitionId() << 32
    for whole in batches:
        for batch in pieces(whole, "text", 16 << 20):
            block, n = block + 1, batch.num_rows
            texts, held = raw_texts(batch.column("text")), batch.column("held_out").to_pylist()
            taught = [x for x, out in zip(texts, held, strict=True) if not out]
            asked = [x for x, out in zip(texts, held, strict=True) if out]
            counts: Counter[bytes] = Counter()
            for x in taught:
                counts.update(words(x))
            n_tokens = counts.total()
            for x in asked:
                counts.update(dict.fromkeys(words(x), 0))
            (codes, times), (more, _) = grams(taught, depth), grams(asked, depth)
            more = np.setdiff1d(more, codes)
            codes, times = np.concatenate([codes, more]), np.concatenate([times, np.zeros(len(more), np.int64)])
            nothing = [pa.nulls(n, k) for k in kinds]
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), batch.column("doc_id"), batch.column("text"), batch.column("held_out"), *nothing], names)
            told = [pa.array([list(map(bytes.decode, counts))], kinds[0]), pa.array([list(counts.values())], kinds[1]), pa.array([codes], kinds[2]), pa.array([times], kinds[3]), pa.array([n_tokens], pa.int64()), pa.array([len(taught)], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.nulls(1, batch.column("doc_id").type), pa.nulls(1, batch.column("text").type), pa.nulls(1, pa.bool_()), *told], names)


def _branch(upper: tuple[np.ndarray, np.ndarray], stem: int, depth: int, asked: pa.Table) -> pa.Table:
    """log10 probability of each pair asked of one branch: those whose contexts end in the same `stem` symbols."""
    code, n = asked.column("code").to_numpy(), asked.column("n").to_numpy()
    end = int(code[0]) >> BITS
    nodes = [(c[at], t[at]) for k, (c, t) in enumerate(levels(*upper, stem - 1)) for at in [c >> BITS == end & mask(k)]] if stem else []
    nodes += list(levels(code[n > 0], n[n > 0], depth))[stem:]
    order = np.argsort(code)
    told = np.empty(len(code))
    told[order] = Model(nodes).log_probs(code[order])
    return pa.Table.from_arrays([asked.column("code"), asked.column("blocks"), pa.array(told)], ["code", "blocks", "told"])


def probabilities(asked: DataFrame, depth: int) -> DataFrame:
    """code, blocks (rows that ask it) and told (its log10 probability) of each distinct code of asked (code, times).

    The trie's branches are grouped by the last symbols of their contexts, two of them for contexts of up to four; a
    group then has three symbols free, 257^3 pairs at most. The shorter contexts are common to many groups: of their
    pairs there are at most 257^2 (257^3 at depth 5), which are sent to all tasks.
    """
    stem = min(depth, max(2, depth - 2))
    top = write_shared(asked.groupBy("code").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("blocks")))
    upper = top.filter("n > 0").groupBy(F.col("code").bitwiseAND(F.lit(mask(stem))).alias("code")).agg(F.sum("n").alias("n")).toArrow() if stem else None
    few = (upper.column("code").to_numpy(), upper.column("n").to_numpy()) if stem else (np.zeros(0, np.int64),) * 2
    held = asked.sparkSession.sparkContext.broadcast(few)
    return write_shared(top.groupBy(F.shiftright("code", BITS).bitwiseAND(F.lit(mask(stem))).alias("end")).applyInArrow(lambda t: _branch(held.value, stem, depth, t), "code long, blocks long, told double"))


def _scored(n_tokens: int, n_kinds: int, n_docs: int, depth: int, rows: pa.Table, found: pa.Table) -> pa.Table:
    known, pairs = found.filter(pc.is_valid(found.column("word"))), found.filter(pc.is_valid(found.column("code")))
    codes, told = pairs.column("code").to_numpy(), pairs.column("told").to_numpy()
    names, counts = raw_texts(known.column("word").combine_chunks()), known.column("c").to_numpy()
    floor = n_tokens + 0.5 * (n_kinds + 1)
    share = dict(zip(names, np.log10((counts + 0.5) / floor).tolist(), strict=True))
    new = {names[i] for i in np.flatnonzero(counts == 0)}  # in held-out texts alone
    end = float(np.log10((n_docs + 0.5) / floor))
    out = []
    for batch in rows.combine_chunks().to_batches():
        for part in pieces(batch, "text", 4 << 20):
            texts = raw_texts(part.column("text"))
            for text, out_of, score in zip(texts, part.column("held_out").to_pylist(), summed(codes, told, texts, depth), strict=True):
                w = words(text)
                unknown = sum(map(new.__contains__, w)) if out_of and new else 0
                out.append((len(w) + 1, len(w) - unknown + (n_docs > 0), n_tokens, sum(map(share.__getitem__, w)) + end, score))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    made = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
    return pa.Table.from_arrays([rows.column("doc_id"), rows.column("held_out"), *made], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame, depth: int = 4) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs (doc_id, text).

    Rows whose crc32(doc_id as text) mod 5 is 1 are held out; all others train, those without a doc_id too. A-Z are
    lower-cased. Null and empty texts have the end alone, by either model. Without training rows every symbol has 1/257.
    Repeated rows each count and each give a row; an empty table gives none; further columns are left alone. depth is
    the length of the longest context, 0 to 5. A word or pair has one row a block; one in very many blocks is sent its
    answer where it is (see join_common()).
    """
    if not 0 <= depth <= 5:
        raise ValueError("depth must be 0 to 5")
    docs = docs.select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    kinds = {"block": T.LongType(), "doc_id": None, "text": None, "held_out": T.BooleanType(), "words": T.ArrayType(T.StringType()), "counts": T.ArrayType(T.LongType()), "codes": T.ArrayType(T.LongType()), "times": T.ArrayType(T.LongType()), "n_tokens": T.LongType(), "n_docs": T.LongType()}
    gathered = write_shared(docs.withColumn("held_out", held_out).mapInArrow(lambda it: _gathered(depth, it), T.StructType([field(docs, k, t) if t is None else T.StructField(k, t) for k, t in kinds.items()])))

    counted = gathered.filter("words is not null").select("block", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("block", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    everywhere = write_shared(counted.groupBy("word").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("blocks")))
    asked = gathered.filter("codes is not null").select("block", F.explode(F.arrays_zip("codes", "times")).alias("t")).select("block", F.col("t.codes").alias("code"), F.col("t.times").alias("times"))
    likely = probabilities(asked.select("code", "times"), depth)

    totals = gathered.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("d"), F.count("words").alias("blocks")).first()
    n_kinds = everywhere.filter("c > 0").count() + (totals.d > 0)
    n_tokens, n_docs = totals.n + totals.d, totals.d
    schema = T.StructType([field(docs, "doc_id"), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    n_blocks = max(1, totals.blocks)  # so that a task has a block or two, however many there are
    rows = gathered.filter("words is null").select("block", "doc_id", "text", "held_out").repartition(n_blocks, "block")
    of_words = join_common(counted.select("block", "word"), everywhere, "word", "blocks")
    of_pairs = join_common(asked.select("block", "code"), likely, "code", "blocks")
    found = of_words.unionByName(of_pairs, allowMissingColumns=True).withColumnRenamed("block", "asker").repartition(n_blocks, "asker")
    return rows.groupBy("block").cogroup(found.groupBy("asker")).applyInArrow(lambda a, b: _scored(n_tokens, n_kinds, n_docs, depth, a, b), schema)
