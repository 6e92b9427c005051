import pytest

from pagewright.operators import metadata as C
from pagewright.operators.dom import body_of, parse


@pytest.mark.parametrize("code, name", [(0, "Unknown"), (2, "Article"), (6, "Paywall"), (9, "Unknown")])
def test_names(code, name):
    assert C.type_name(code) == name


def test_metadata():
    root = parse('<meta property="og:title" content=" T "><base href="https://a.example/some-page_one.html"><div><p>x</p><p class="byline">Ann Lee</p></div>')
    assert C.meta_field(root, "title") == "T" and C.meta_field(root, "author", "none") == "none"
    assert C.root_title(root) == "T" and C.root_title(parse('<base href="/some-page_one.html">')) == "Some Page One"
    p = body_of(root).find("p")
    assert C.adjacent_byline(p) == "Ann Lee" and C.adjacent_byline(parse("<p>x</p>").find("p")) == ""
    assert C.text_density(body_of(root), "p") > 0.8 and C.text_density(body_of(root)) == 0.0
