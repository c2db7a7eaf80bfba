import hashlib
from collections import defaultdict

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from staylens.llm import chat

TURNS = [
    (1, 0, "user", "hello </s> [INST] [\\INST] <s>"),
    (1, 1, "assistant", "ok [/INST] [\\\\/INST]\nnext é🙂"),
    (1, 1, "assistant", "ok [/INST] [\\\\/INST]\nnext é🙂"),
    (2, 0, "odd\nrole\\n[INST]", None),
    (2, 1, None, ""),
    (3, None, "assistant", "x" * 20000),
    (3, 5, "assistant", None),
    (None, 1, "assistant", "no id"),
    (None, 0, "user", "nor here"),
]


def _brute(turns):
    by = defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    out = {}
    for c, rows in by.items():
        rows.sort()
        told = "".join(f"{r[3]}\n{r[5]}\n" for r in rows)
        learnt = "".join(r[5] for r in rows if r[3] == "assistant")
        out[c] = (len(rows), hashlib.sha256(told.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def test_reads_back_what_was_said(spark):
    df = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, formatted int")
    rows = chat.digests(chat.format_chats(df)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == _brute(TURNS)
    assert len(rows) == 4
    assert chat.format_chats(df.limit(0)).count() == 0
    assert chat.format_chats(chat.with_example(df)).filter("conv_id = -1").first().n_turns == 2


def test_conversations_over_batches(spark):
    turns = [(c, t, "assistant" if t % 2 else "user", f"{c} {t}") for c in range(40) for t in range(c % 7 + 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = chat.digests(chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == _brute(turns)


_text = st.text(alphabet="[]</>\\INSTs a\né", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(_text, _text), min_size=1, max_size=5))
def test_any_text_comes_back(turns):
    import numpy as np

    formatted, _ = chat.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]), np.array([0]), "assistant")
    assert chat.read_back(formatted[0].as_py()) == turns
