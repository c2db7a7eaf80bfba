"""Cross-tokenizer alignment: which tokens of two vocabularies lie over the same bytes, counted by documents.

Both tokenisers tile the bytes of a text. The union of their token ends cuts it into segments, and each segment is one
link: the A token and the B token that hold it. Where both end, a group ends. The count of an (A id, B id) pair is the
number of documents that hold it linked, which is found by spilling:

1. A task gathers (pair, document) records of a block of documents, sorts them by pair (A's id first) and document, deals
   them out by a radix of A's id and spills a zstd run for each: the pairs, how many documents have each, and apart from
   these the documents and how often each links the pair.
2. For each radix the runs of up to `fan` blocks are merged by a heap, which sums the documents of a pair. More blocks
   take more levels, so what one group holds has a bound at any size of the corpus.
3. The last level sees an A id's pairs one after another, so their highest count is known when the next A id begins; the
   counts then stream back to each run in the run's own order, down the levels to the blocks.
4. A block adds the counts of its runs up by document.

Runs and answers are rows of tables in the shared folder and shuffles of Spark, so a lost executor costs its tasks alone.
A common pair is one row a block and radix before it is shuffled, whatever share of the documents has it.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import field, pieces, str_texts, write_shared

RADIX = 256
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_RUN = "slice int, unit long, pairs binary, sizes binary"
#: The library that is faster on prose ends its process in longer runs of white space.
_LONG_SPACE = re.compile(r"\s{1000}")


@dataclass(frozen=True)
class Sides:
    """Files of the two vocabularies, which the workers can read, and the pattern that cuts a text for A."""

    a_path: str
    b_path: str
    pattern: str


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes (a fixed format): printable bytes stand for themselves, the others follow from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenisers, the bytes of their tokens, and what a group's text is put together from."""

    def __init__(self, sides: Sides):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.sides = sides
        with open(sides.a_path, encoding="utf-8") as f:
            told = json.load(f)
        letters, vocabulary = _byte_letters(), told["model"]["vocab"]
        spelt = {bytes(map(letters.__getitem__, token)): i for token, i in vocabulary.items()}
        merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in told["model"]["merges"]]
        # where ids follow the order of merges, the faster library gives the same ids
        self.fast = tiktoken.Encoding("a", pat_str=sides.pattern, mergeable_ranks=spelt, special_tokens={}) if merged == sorted(merged) and all(bytes([b]) in spelt for b in range(256)) else None
        self.bytes_a = [b""] * (max([*vocabulary.values(), *(x["id"] for x in told["added_tokens"])]) + 1)
        for token, i in spelt.items():
            self.bytes_a[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=sides.b_path)
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.vocab_size())]
        self.length_a, self.length_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        self.spelling = [*(f"{i}," for i in range(n_a)), *(f"{i}|" for i in range(n_a)), *(f"{i}," for i in range(n_b)), *(f"{i};" for i in range(n_b))]

    @functools.cached_property
    def slow(self) -> Tokenizer:
        out = Tokenizer.from_file(self.sides.a_path)
        out.encode_special_tokens = True
        return out

    def encode_a(self, text: str) -> list[int]:
        if self.fast is None or _LONG_SPACE.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of both sides, or none if either spells other bytes than a space and the text."""
        whole = " " + text
        if not text:
            return None
        a, b = self.encode_a(whole), self.b.encode(text, num_threads=1)
        want = whole.encode()
        return (a, b) if b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want else None


@functools.lru_cache(2)
def aligner(sides: Sides) -> Aligner:
    return Aligner(sides)


def align(model: Aligner, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """For each text its n_a, n_b, n_groups and n_links and the text of its groups; for each link its pair (A id * B's size + B id) and the text it is in."""
    coded = [model.encode(x) for x in texts]
    flat = [np.fromiter((i for x in coded if x for i in x[k]), np.int64) for k in (0, 1)]
    sizes = np.array([(len(x[0]), len(x[1])) if x else (0, 0) for x in coded], np.int64).reshape(-1, 2)
    ends = [np.cumsum(length[ids]) for length, ids in zip((model.length_a, model.length_b), flat, strict=True)]
    both = np.sort(np.concatenate(ends), kind="stable")
    last = np.ones(len(both), bool)
    last[:-1] = both[1:] != both[:-1]
    cut = both[last]  # ends of the segments
    shared = both[1:][both[1:] == both[:-1]]  # ends of the groups

    at = [np.searchsorted(e, cut) for e in ends]
    pair = flat[0][at[0]] * len(model.bytes_b) + flat[1][at[1]]
    upto = np.concatenate([[0], np.cumsum(sizes[:, 0])])
    text_of_a = np.repeat(np.arange(len(texts)), sizes[:, 0])
    text_of = text_of_a[at[0]]
    n_links = np.bincount(text_of, minlength=len(texts))
    group_ends = [np.searchsorted(e, shared) for e in ends]  # the last token of each group on either side
    n_groups = np.bincount(text_of_a[group_ends[0]], minlength=len(texts))

    n_a, n_b = len(model.bytes_a), len(model.bytes_b)
    code = [flat[0].copy(), flat[1] + 2 * n_a]
    code[0][group_ends[0]] += n_a
    code[1][group_ends[1]] += n_b
    group_of = [np.searchsorted(g, np.arange(len(ids))) for g, ids in zip(group_ends, flat, strict=True)]
    through = [np.concatenate([[0], g + 1]) for g in group_ends]
    order = np.empty(len(flat[0]) + len(flat[1]), np.int64)
    order[np.arange(len(flat[0])) + through[1][group_of[0]]] = code[0]
    order[np.arange(len(flat[1])) + through[0][group_of[1] + 1]] = code[1]
    starts = upto + np.concatenate([[0], np.cumsum(sizes[:, 1])])
    spelt = list(map(model.spelling.__getitem__, order.tolist()))
    groups = ["".join(spelt[a:b])[:-1] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    return np.column_stack([sizes, n_groups, n_links]), groups, pair, text_of


def _packed(values: np.ndarray, kind: str) -> bytes:
    """A zstd run of integers, their low bytes first together, then the next ones."""
    raw = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1)
    return zstandard.compress(np.ascontiguousarray(raw.T).tobytes(), 1)


def _unpacked(run: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(run), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def _keys(run: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(run, "<u8")).astype(np.int64)


def _key_run(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=0), "<u8")


def _slices(a: np.ndarray, radix: int) -> np.ndarray:
    """The radix of an A id: neighbouring ids, which are the commonest, lie apart."""
    return (a * np.int64(2654435761) >> 7) % radix


def _spilled(keys: np.ndarray, docs: np.ndarray, n_docs: int, n_b: int, radix: int) -> Iterator[dict]:
    """The runs of one block: records sorted by pair and document, one run a radix."""
    records, times = np.unique(keys * n_docs + docs, return_counts=True)
    keys, docs = records // n_docs, records % n_docs
    order = np.argsort(_slices(keys // n_b, radix), kind="stable")
    keys, docs, times = keys[order], docs[order], times[order]
    slices = _slices(keys // n_b, radix)
    edges = np.flatnonzero(np.diff(slices, prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = keys[a:b]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        yield {"slice": int(slices[a]), "pairs": _key_run(own[first]), "sizes": _packed(np.diff(first, append=b - a), "<u4"), "postings": _packed(np.concatenate([docs[a:b], times[a:b]]), "<u4")}


def _made(sides: Sides, radix: int, block_bytes: int, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document with its block and place in it, and the block's runs."""
    model = aligner(sides)
    unit, n_docs, held = TaskContext.get().partitionId() << 32, 0, 0
    keys, docs = [], []
    whole = lambda columns, n: pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def spill() -> Iterator[pa.RecordBatch]:
        if keys:
            for run in _spilled(np.concatenate(keys), np.concatenate(docs), n_docs, len(model.bytes_b), radix):
                yield whole({"block": pa.array([unit]), **{k: pa.array([v]) for k, v in run.items()}}, 1)

    for wide in batches:
        for batch in pieces(wide, "text", 1 << 20):
            texts = str_texts(batch.column("text"))
            counts, groups, pair, text_of = align(model, texts)
            place = np.arange(n_docs, n_docs + len(texts))
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            rows = {"block": pa.array(np.full(len(texts), unit)), "place": pa.array(place), "doc_id": batch.column("doc_id"), "groups_sha256": pa.array(digests, pa.string())}
            yield whole(rows | {c: pa.array(counts[:, k]) for k, c in enumerate(_COUNTS)}, len(texts))
            keys.append(pair)
            docs.append(text_of + n_docs)
            n_docs += len(texts)
            held += batch.column("text").nbytes
            if held >= block_bytes:
                yield from spill()
                unit, n_docs, held, keys, docs = unit + 1, 0, 0, [], []
    yield from spill()


def _merged(runs: list[np.ndarray]) -> Iterator[tuple[int, list[int]]]:
    """Each key of sorted runs once, in order, with the runs that have it: a k-way merge by a heap."""
    k = len(runs)
    key, owners = -1, []
    for x in heapq.merge(*[(run * k + r).tolist() for r, run in enumerate(runs)]):
        if x // k != key:
            if owners:
                yield key, owners
            key, owners = x // k, []
        owners.append(x % k)
    if owners:
        yield key, owners


def _summed(runs: list[np.ndarray], sizes: list[list[int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Each key with the documents of all its runs, and these runs."""
    at = [0] * len(runs)
    for key, owners in _merged(runs):
        total = 0
        for r in owners:
            total += sizes[r][at[r]]
            at[r] += 1
        yield key, total, owners


def _of(table: pa.Table) -> tuple[list[np.ndarray], list[list[int]]]:
    return [_keys(x) for x in table["pairs"].to_pylist()], [_unpacked(x, "<u4").tolist() for x in table["sizes"].to_pylist()]


def _fold(table: pa.Table) -> pa.Table:
    """The runs of a group as one run."""
    found = [(key, n) for key, n, _ in _summed(*_of(table))]
    keys, n = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
    return pa.table({"slice": table["slice"][:1], "unit": table["parent"][:1], "pairs": [_key_run(keys)], "sizes": [_packed(n, "<u4")]})


def _judge(n_b: int, table: pa.Table) -> pa.Table:
    """The last merge: what each run is told of its pairs, how many documents have them and whether that is the most of their A id."""
    runs, sizes = _of(table)
    counts, best = [[] for _ in runs], [[] for _ in runs]
    side, held = -1, []

    def back() -> None:
        most = max((n for n, _ in held), default=0)
        for n, owners in held:
            for r in owners:
                counts[r].append(n)
                best[r].append(n == most)

    for key, n, owners in _summed(runs, sizes):
        if key // n_b != side:
            back()
            side, held = key // n_b, []
        held.append((n, owners))
    back()
    return pa.table({"slice": table["slice"], "unit": table["unit"], "counts": [_packed(np.array(x, np.int64), "<u8") for x in counts], "best": [_packed(np.array(x, bool), "<u1") for x in best]})


def _pass_down(children: pa.Table, parents: pa.Table) -> pa.Table:
    """What a merged run was told, told to the runs that it was merged from."""
    told = [_unpacked(parents[c][0].as_py(), kind) for c, kind in (("counts", "<u8"), ("best", "<u1"))]
    keys = _keys(parents["pairs"][0].as_py())
    at = [np.searchsorted(keys, _keys(x)) for x in children["pairs"].to_pylist()]
    return pa.table({"slice": children["slice"], "unit": children["unit"], "counts": [_packed(told[0][i], "<u8") for i in at], "best": [_packed(told[1][i], "<u1") for i in at]})


def _answers(runs: DataFrame, n_units: int, n_b: int, fan: int) -> DataFrame:
    """slice, unit, counts and best for each run (slice, unit, pairs, sizes)."""
    told = "slice int, unit long, counts binary, best binary"
    if n_units <= fan:
        return runs.groupBy("slice").applyInArrow(lambda t: _judge(n_b, t), told)
    n_parents = -(-n_units // fan)
    children = runs.withColumn("parent", F.pmod(F.xxhash64("unit"), F.lit(n_parents)))
    parents = write_shared(children.groupBy("slice", "parent").applyInArrow(_fold, _RUN))
    heard = write_shared(_answers(parents, n_parents, n_b, fan)).join(parents, ["slice", "unit"]).withColumnRenamed("unit", "parent")
    return children.groupBy("slice", "parent").cogroup(heard.groupBy("slice", "parent")).applyInArrow(_pass_down, told)


def _added_up(schema: pa.Schema, docs: pa.Table, runs: pa.Table) -> pa.Table:
    """The documents of a block with n_best and count_sum."""
    n_best, count_sum = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
    order = np.argsort(docs["place"].to_numpy())
    for sizes, postings, counts, best in zip(*(runs[c].to_pylist() for c in ("sizes", "postings", "counts", "best")), strict=True):
        n = _unpacked(sizes, "<u4").astype(np.int64)
        places, times = np.split(_unpacked(postings, "<u4").astype(np.int64), 2)
        np.add.at(n_best, places, times * np.repeat(_unpacked(best, "<u1").astype(np.int64), n))
        np.add.at(count_sum, places, times * np.repeat(_unpacked(counts, "<u8").astype(np.int64), n))
    out = docs.take(order).append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))
    return out.select(schema.names).cast(schema)


def alignments(docs: DataFrame, sides: Sides, block_bytes: int = 4 << 20, radix: int = RADIX, fan: int = 256) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of docs (doc_id, text).

    n_best counts the links whose pair has its A id's highest count (ties included), count_sum adds the counts up over the
    links. Null and empty texts, and those whose tokens of either side spell other bytes than a space and the text, have
    no tokens: zeros and ''. Repeated rows and copies count as documents of their own; a null doc_id stays null; an empty
    table gives no rows; further columns are left alone. A block holds `block_bytes` of text, or one longer text.
    """
    docs = docs.select("doc_id", "text")
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    out = T.StructType([field(docs, "doc_id"), *longs(*_COUNTS, "n_best", "count_sum"), T.StructField("groups_sha256", T.StringType())])
    raw = [T.StructField(c, T.BinaryType()) for c in ("pairs", "sizes", "postings")]
    spilled = T.StructType([*longs("block", "place"), field(docs, "doc_id"), *longs(*_COUNTS), out["groups_sha256"], T.StructField("slice", T.IntegerType()), *raw])
    arrow = lambda kind: pa.schema([(f.name, {"long": pa.int64(), "integer": pa.int32(), "string": pa.string(), "binary": pa.binary()}.get(f.dataType.typeName()) or _arrow_type(f.dataType)) for f in kind])
    made_schema, out_schema = arrow(spilled), arrow(out)
    made = write_shared(docs.mapInArrow(lambda it: _made(sides, radix, block_bytes, made_schema, it), spilled))
    runs = made.filter("slice is not null")
    n_b = sentencepiece.SentencePieceProcessor(model_file=sides.b_path).vocab_size()
    n_units = runs.select("block").distinct().count()
    told = write_shared(_answers(runs.select("slice", F.col("block").alias("unit"), "pairs", "sizes"), n_units, n_b, fan))
    heard = runs.select(F.col("block").alias("unit"), "slice", "sizes", "postings").join(told, ["unit", "slice"])
    left = made.filter("slice is null").select("block", "place", "doc_id", *_COUNTS, "groups_sha256")
    return left.groupBy("block").cogroup(heard.groupBy("unit")).applyInArrow(lambda a, b: _added_up(out_schema, a, b), out)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
