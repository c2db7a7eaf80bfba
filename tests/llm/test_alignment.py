"""Alignment against the tokenizer libraries and plain counting, over nulls, repeats, odd texts and several levels of merges."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from staylens.llm import alignment, queries

from .samples import DOCS

ODD = [
    (30, "one ▁ two"),
    (31, "<|endoftext|> </s> <unk> <0x41>"),
    (32, " \t\n" * 900 + "after a long run of white space"),
    (33, "漢字とかな 🙂🙃 éé \x00\x01 ｆｕｌｌ ﬁ"),
    (34, "  leading and trailing  "),
    (35, "x"),
    (36, " "),
    (None, "x"),
]


def brute(rows):
    a_side, b_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_side.encode_special_tokens = True
    letters = alignment._byte_letters()
    assert sorted(letters.values()) == list(range(256)) and len(letters) == 256
    told, held = [], defaultdict(set)
    for i, (d, text) in enumerate(rows):
        whole = (" " + (text or "")).encode()
        a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a_side.id_to_token(t)) for t in a]
        bytes_b = [bytes([int(b_side.id_to_piece(t)[3:5], 16)]) if b_side.is_byte(t) else b_side.id_to_piece(t).replace("▁", " ").encode() for t in b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            told.append((d, 0, 0, 0, [], ""))
            continue
        links, groups, x, y, ends = [], [[[], []]], 0, 0, [0, 0]
        while x < len(a):
            links.append((a[x], b[y]))
            ea, eb = ends[0] + len(bytes_a[x]), ends[1] + len(bytes_b[y])
            if ea <= eb:
                groups[-1][0].append(a[x])
                x, ends[0] = x + 1, ea
            if eb <= ea:
                groups[-1][1].append(b[y])
                y, ends[1] = y + 1, eb
            if ea == eb:
                groups.append([[], []])
        spelt = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups[:-1])
        for link in links:
            held[link].add(i)
        told.append((d, len(a), len(b), len(groups) - 1, links, hashlib.sha256(spelt.encode()).hexdigest()))
    most = defaultdict(int)
    for (x, _), docs in held.items():
        most[x] = max(most[x], len(docs))
    return Counter((d, na, nb, ng, len(links), sum(len(held[k]) == most[k[0]] for k in links), sum(len(held[k]) for k in links), sha) for d, na, nb, ng, links, sha in told)


def _rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


@pytest.mark.parametrize(("block_bytes", "fan"), [(4 << 20, 256), (3000, 2)])
def test_equals_brute_force(spark, block_bytes, fan):
    rows = [(d, t) for d, t, _ in DOCS] + ODD
    docs = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, place long, pairs binary").repartition(3)
    found = alignment.alignments(docs, queries.SIDES, block_bytes=block_bytes, fan=fan)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute(rows)
    assert _rows(found) == want
    by_id = {r[0]: r for r in want}
    assert by_id[30][1:5] == (0, 0, 0, 0) and by_id[31][1] > 0 and by_id[32][1] > 2000


def test_empty_table(spark):
    assert alignment.alignments(spark.createDataFrame([], "doc_id string, text string"), queries.SIDES).collect() == []


def test_texts_without_tokens(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert sorted(tuple(r) for r in alignment.alignments(docs, queries.SIDES).collect()) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2, 3)]


def test_query_of_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert _rows(queries.op11_alignment(spark, folder)) == brute(rows)
