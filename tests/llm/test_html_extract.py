from staylens.llm import html_extract


def _page(body, tail="</body></html>"):
    return f"<!DOCTYPE html><html lang=en><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}{tail}"


NAV = '<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy <b>now</b></div>'
FOOT = "<footer>&copy; us</footer>"
CASES = [
    (_page(f"{NAV}<article><h1>A &amp; B</h1><p><b>One\n two<br><p>Three&nbsp;four</p></article>{FOOT}"), "A & B\nOne two\nThree four"),
    (_page(f"{NAV}<article><h1>A</h1><p>cut he", ""), "A\ncut he"),
    (_page(f"{NAV}<main><article><p>x</p><section class='comments'><p>nice!</p></section></article><aside>more</aside></main>"), "x"),
    (_page("<article></article>"), ""),
    (_page("<article><p>a</p><form><input value=x><p>mail</p></form><p>b &lt;c&gt;</p><p <p>d"), "a\nb <c>"),
    ("", ""),
    (None, ""),
    ("plain & simple", "plain & simple"),
    ("<div>one<div>two</div>three</div>", "one\ntwo\nthree"),
]


def test_known_pages(spark):
    df = spark.createDataFrame([(i, None, p, "x") for i, (p, _) in enumerate(CASES)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert {k: v for k, v in got.items() if k != 4} == {i: t for i, (_, t) in enumerate(CASES) if i != 4}
    assert got[4].startswith("a\nb <c>")
    assert html_extract.extract(df.limit(0)).count() == 0


def _unmarked(i):
    return f"<html><body><div class=top><span>Acme news portal</span></div><div class=story><p>Story number {i} tells of thing {i * 7}.</p><p>It goes on {i}.</p></div><div class=low><span>All the usual links</span></div></body></html>"


def test_branches_that_repeat_on_a_host_go(spark):
    df = spark.createDataFrame([(i, "http://acme.example/" + str(i), _unmarked(i)) for i in range(12)] + [(99, "http://one.example/", _unmarked(99))], "page_id long, url string, html string")
    want = {i: f"Story number {i} tells of thing {i * 7}.\nIt goes on {i}." for i in range(12)}
    for most in (1000, 0):
        got = {r.page_id: r.text for r in html_extract.extract(df, most_sent=most).collect()}
        assert {k: v for k, v in got.items() if k != 99} == want
        assert "Acme" in got[99]


def test_copies_of_an_article_stay(spark):
    page = _page(f"{NAV}<article><p>Same everywhere.</p></article>{FOOT}")
    df = spark.createDataFrame([(i, "http://h.example/", page) for i in range(10)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract(df).collect()} == {"Same everywhere."}


def test_deep_nesting():
    assert html_extract.main_text(html_extract.parse("<div>" * 5000 + "deep")) == "deep"


INSIDE = [
    ("<article><h1>T</h1><p>one</p><article class=comment><p>nice!</p></article></article>", "T\none"),
    ("<article><h1>T</h1><p>one</p><section class=comments><article><p>nice!</p></article></section></article>", "T\none"),
    ("<article class=comment><p>nice!</p></article><div><h1>T</h1><p>one</p></div>", "T\none"),
    ("<main><h1>T</h1><p>intro</p><article><p>one</p></article></main><p>outside</p>", "T\nintro\none"),
    ("<article><div class=header><h1>T</h1></div><header><p>by me</p></header><p>one</p></article>", "T\nby me\none"),
    ("<div class=header><p>brand</p></div><p>one</p>", "one"),
    ("<form id=f><main><h1>T</h1><p>one</p><button>go</button></main></form>", "T\none"),
    ("<form><input><p>mail us</p></form><article><p>one</p></article>", "one"),
    ("<aside><article><p>teaser</p></article></aside><div><p>one</p></div>", "one"),
    ("<div role=main><p>one</p></div><div>two</div>", "one"),
    ("<div class=menu>only this</div>", "only this"),
    ("<div hidden><article>x</article></div><p>one</p>", "one"),
    ("<header><h1>Site</h1></header><p>one</p>", "one"),
    ("<p>o<b>n</b>e <i>two</i><div>three</div>four", "one two\nthree\nfour"),
    ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", "a\nb\nc\nd\ne"),
    ("</article></div><p>one</x>", "one"),
]


def test_what_is_declared_inside_and_outside_landmarks():
    assert [html_extract.main_text(html_extract.parse(p)) for p, _ in INSIDE] == [t for _, t in INSIDE]


def _of_host(i, inner):
    return _page(f"{NAV}<article><h1>Same title</h1>{inner}<p>Text {i} of its own, <b>Update</b> {i * 3}.</p><ul class='box-{i}'><li>Follow us</li><li>Tell friends</li></ul></article>{FOOT}")


def test_what_repeats_inside_landmarks_goes_and_inline_parts_stay(spark):
    rows = [(i, f"http://h.example/{i}", _of_host(i, "<p class=hint>This site has moved.</p>")) for i in range(6)]
    rows += [(9, "http://alone.example/", rows[0][2]), (10, "http://two.example/", rows[0][2]), (11, "http://two.example/", rows[1][2])]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    short = {i: f"Same title\nText {i} of its own, Update {i * 3}." for i in range(6)}
    assert {i: got[i] for i in range(6)} == short
    assert got[9] == f"Same title\nThis site has moved.\n{short[0].partition('\n')[2]}\nFollow us\nTell friends"
    assert (got[10], got[11]) == (short[0], short[1])


def test_copies_count_once_and_near_copies_keep_their_text(spark):
    many = [(i, "http://h.example/", _page(f"<p>Nav</p><article><h1>T</h1><p>Copied.</p></article>{FOOT}")) for i in range(30)]
    other = [(99, "http://h.example/", _page("<article><h1>U</h1><p>Another.</p></article>"))]
    near = [(100 + i, "http://n.example/", _page(f"<article><h1>T{i}</h1>" + "".join(f"<p>Part {k}</p>" for k in range(20)) + "</article>")) for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(many + other + near, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(30)} == {"T\nCopied."} and got[99] == "U\nAnother."
    assert got[103] == "T3\n" + "\n".join(f"Part {k}" for k in range(20))


def test_importance_equals_brute_force(spark):
    import math

    pages = [(f"http://h.example/{i}", f"<div class=t>Top</div><div class=s>{i // 2}</div><div class=u>{i}</div>") for i in range(6)]
    rows = {round(r.importance, 9) for r in html_extract.importance(spark.createDataFrame(pages, "url string, html string")).collect()}
    want = {0.0, 1 - math.log(2) / math.log(6), 1.0}
    assert rows == {round(x, 9) for x in want}


def test_hostile_pages_take_time_in_proportion():
    import time

    deep = "<span>" * 20_000
    for source in ("<div>" * 20_000 + "x", deep + "</b>" * 20_000 + "x", deep + "<p>x</p>" * 20_000, "<ul>" + deep + "<li>x</li>" * 20_000, deep + "<h1>x</h1>" * 5_000, "<" * 100_000, "<a " * 50_000, "<a b='" * 20_000):
        began = time.process_time()
        html_extract.main_text(html_extract.parse(source))
        assert time.process_time() - began < 20


def test_depth_does_not_change_what_is_kept():
    page = lambda n: "<div>" * n + "<p>outside</p><article><h1>T</h1><p>one</p></article>" + "</div>" * n
    assert html_extract.main_text(html_extract.parse(page(15))) == html_extract.main_text(html_extract.parse(page(10_000))) == "T\none"


def _noted(i):
    return _page("<article><h1>T</h1>" + "".join(f"<p>Part {k} of story {i}.</p>" for k in range(3)) + "<p>Subscribe to our newsletter now</p>" + f"<h2>Of {i}</h2><p>Last words {i}.</p><h2>Sources</h2><p>Book {i}.</p></article>")


def test_a_text_in_ever_other_surroundings_goes_and_what_near_copies_share_stays(spark):
    rows = [(i, f"http://h.example/{i}", _noted(chr(97 + i) * 3)) for i in range(6)]
    rows += [(20 + i, f"http://few.example/{i}", _noted(chr(97 + i) * 3)) for i in range(3)]
    same = "".join(f"<p>Shared {k}.</p>" for k in range(9))
    rows += [(40 + i, f"http://near.example/{i}", _page(f"<article><h1>T</h1>{same}<p>By {chr(97 + i)}.</p>{same.replace('Shared', 'Further')}</article>")) for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        a = chr(97 + i) * 3
        assert got[i].split("\n") == ["T", *(f"Part {k} of story {a}." for k in range(3)), f"Of {a}", f"Last words {a}.", "Sources", f"Book {a}."]
    assert all("newsletter" in got[20 + i] for i in range(3))
    for i in range(8):
        assert [x for x in got[40 + i].split("\n") if x[:2] != "By"] == ["T", *(f"{w} {k}." for w in ("Shared", "Further") for k in range(9))]


PARTS = [
    ("<article><h1>T</h1><p>one</p><div class='comment-list'><p>nice!</p></div></article>", "T\none"),
    ("<article><h1>T</h1><p>one</p><section id='user-comments'><p>nice!</p></section></article>", "T\none"),
    ("<div class='site-header'><p>brand</p></div><p>one</p><div id=site_footer>imprint</div>", "one"),
    ("<article><h1>T</h1><div class=search><p>one</p></div></article>", "T\none"),
    ("<article><div class=search><p>one</p></div></article>", "one"),
    ("<article><section class=comments><p>nice!</p></section></article>", ""),
    ("<article><div class='has-comments'><p>one</p></div></article>", "one"),
]


def test_parts_of_words_and_words_that_may_name_the_text():
    assert [html_extract.main_text(html_extract.parse(p)) for p, _ in PARTS] == [t for _, t in PARTS]
