"""Articles of several sections keep all their parts."""

from logwarden.llm.html_extract import main_text

LONG = "This is the longer part of it, with commas, and with words enough to count as prose; it goes on for a while. " * 6
SHORT = "A shorter closing part, which belongs to the same article, and has its own section."
MENU = '<nav><a href="/">Home</a></nav><div class="main-menu"><a href="/a">One</a> <a href="/b">Two</a></div>'


def page(article):
    return f'<html><body>{MENU}{article}<div id="comments"><p>Great, thanks! {LONG}</p></div><footer>F</footer></body></html>'


def test_sections():
    want = " ".join(["Title", *[LONG.strip()] * 3, SHORT])
    paragraphs = f"<p>{LONG}</p>" * 3
    assert main_text(page(f"<article><h1>Title</h1><section>{paragraphs}</section><section><p>{SHORT}</p></section></article>")) == want
    assert main_text(page(f"<main><h1>Title</h1><div class=lead>{paragraphs}</div><div class=body><p>{SHORT}</p></div></main>")) == want


def test_links_inside():
    refs = "".join(f'<li><a href="/{k}">Source {k}</a></li>' for k in range(3))
    text = main_text(page(f"<article><p>{LONG}</p><p>{LONG}</p><ul>{refs}</ul></article>"))
    assert text == f"{LONG.strip()} {LONG.strip()} Source 0 Source 1 Source 2"


def test_whole_class_names():
    for name in ("has-sidebar", "no-comments", "layout has-ads-removed"):
        assert main_text(page(f'<div class="{name}"><p>{LONG}</p><p>{SHORT}</p></div>')) == f"{LONG.strip()} {SHORT}"
