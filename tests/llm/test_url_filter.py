import re

import numpy as np

from staylens.llm import url_filter
from staylens.llm.queries import URL_RULES

URLS = ["http://a.com/x", "https://EXAMPLE.com/en/1?q=/es/", "http://www.example.com/en/2", "http://m.www.example.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/de/", "http://notcom/x", "http://b.com", "http://c.com?x", "no scheme.com/", None, "", "ftp://d.com/#y", "http://example.com/en", "http://é.com/ü", "x://y://z.com/", "http://a.net/es/\nz", "http://example.org/en/"]


def _brute(url):
    _, found, rest = (url or "").partition("://")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", rest)[0])
    path = re.split("[?#]", rest[len(host) :])[0] if found else ""
    fits = [(r, v) for r, v in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return (host if found else "", path, rule, verdict)


def test_mapped_and_joined_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, URLS[1]])], "page_id long, url string, host string")
    rules = spark.createDataFrame(URL_RULES, "entry string, verdict string")
    want = {i: _brute(u) for i, u in enumerate([*URLS, URLS[1]])}
    for most in (100, 0):
        rows = url_filter.judge(pages, rules, most_mapped=most).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == want
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_a_collision_does_not_decide(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda x: 7)
    url_filter.write_digests({b"a/": "block", b"b/": "allow"}, tmp_path / "d")
    listed = url_filter.Digests(tmp_path / "d")
    found = listed.find([b"a/", b"b/", b"c/"])
    assert found[2] == -1
    assert [int(listed.verdicts[x]) for x in found[:2]] == [1, 0]
    assert np.all(listed.keys == 7)


def test_one_rule_for_ties(spark):
    """Equally long entries: the longer host wins, then the greater string; however the list is held."""
    rules = spark.createDataFrame([("a.b.com/x", "block"), ("b.com/xyz", "allow"), ("d.net/ab", "block"), ("d.net/ab", "allow")], "entry string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b.com/xyz"), (2, "http://c.b.com/xyz"), (3, "http://d.net/abc")], "page_id long, url string")
    for most in (100, 3, 1):
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules, most_mapped=most).collect()}
        assert got == {1: ("a.b.com/x", "block"), 2: ("b.com/xyz", "allow"), 3: ("d.net/ab", "block")}


def test_many_ranges_find_what_one_file_finds(spark):
    rules = spark.createDataFrame([(f"h{i}.com/p{i % 7}", "block" if i % 2 else "allow") for i in range(500)], "entry string, verdict string")
    pages = spark.createDataFrame([(i, f"http://www.h{i}.com/p{i % 9}/x") for i in range(600)], "page_id long, url string")
    one, many = ({tuple(r) for r in url_filter.judge(pages, rules, most_mapped=m).collect()} for m in (1000, 40))
    assert one == many and sum(r[4] is not None for r in one) == sum(i % 9 == i % 7 for i in range(500))
