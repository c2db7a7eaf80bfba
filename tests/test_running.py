import random
import time

import pytest

from staylens.functions.running import running_median


def _brute(rows, inclusive):
    out, seen = {}, {}
    for k, at, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        own = seen.setdefault(k, [])
        told = sorted(own + ([v] if inclusive and v is not None else []))
        n = len(told)
        out[k, at] = (told[(n - 1) // 2] + told[n // 2]) / 2 if n else None
        if v is not None:
            own.append(v)
    return out


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("shape", ["random", "rising", "falling", "few values", "holes"])
def test_chunks_equal_brute_force(spark, inclusive, shape):
    r = random.Random(4)
    value = {"random": lambda i: r.gauss(0, 10), "rising": lambda i: float(i), "falling": lambda i: float(-i), "few values": lambda i: float(r.randint(0, 3)), "holes": lambda i: r.random() if r.random() < 0.6 else None}[shape]
    rows = [(k, i, value(i)) for k, n in ((1, 400), (2, 3), (None, 90), (3, 65)) for i in range(n)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "k long, at long, v double")
    got = running_median(df, ["k"], ["at"], "v", "m", inclusive, short=10, chunk=16)
    assert got.columns == ["k", "at", "v", "m"]
    told = {(x.k, x.at): x.m for x in got.collect()}
    want = _brute(rows, inclusive)
    assert set(told) == set(want)
    assert all(told[k] == want[k] or abs(told[k] - want[k]) < 1e-9 for k in want if want[k] is not None or told[k] is not None)


def test_one_series_of_100_000_rows(spark):
    r = random.Random(9)
    rows = [(7, i, float(r.randint(0, 10**6))) for i in range(100_000)]
    began = time.time()
    got = {x.at: x.m for x in running_median(spark.createDataFrame(rows, "k long, at long, v double"), ["k"], ["at"], "v", "m", False).collect()}
    assert time.time() - began < 120 and len(got) == 100_000
    for at in (0, 1, 2, 4095, 4096, 4097, 50_000, 99_999):
        told = sorted(v for _, _, v in rows[:at])
        assert got[at] == ((told[(at - 1) // 2] + told[at // 2]) / 2 if at else None)
    assert running_median(spark.createDataFrame([], "k long, at long, v double"), ["k"], ["at"], "v", "m", True).collect() == []
