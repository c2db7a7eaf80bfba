import pytest

from staylens.llm.html_extract import main_text, parse


@pytest.mark.parametrize("name", ["class='site no-sidebar'", "class='layout has-sidebar'", "class='content with-comments'", "id='search-result-12'", "class='related'"])
def test_a_word_about_an_article_does_not_drop_it(name):
    assert main_text(parse(f"<body><div {name}><article><p>one</p></article></div></body>")) == "one"


def test_a_title_stays_and_whole_words_go():
    page = "<article><div class='entry-header'><h1>Title</h1></div><div class='box ad'>a</div><div class='ad-slot'>b</div><div class='share'>c</div><p>one</p></article>"
    assert main_text(parse(page)) == "Title\none"
