"""Articles planted in generated pages come back whole; pages of any depth take time in proportion to their length."""

from __future__ import annotations

import html
import random
import time

import pytest

from driftclust.llm.html_text import main_text


def sentence(r, words, n):
    return " ".join(r.choice(words) for _ in range(n)).capitalize() + r.choice([".", ".", "?", ", so it is."])


def page(seed):
    """(html, text of the article): boilerplate around an article, with up to a thousand comments."""
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("har", "bor", "lin", "mas", "tel", "ü") for b in ("ne", "ter", "gau", "ö", "sk")] + ["R&D", "<tag>", "it’s"]
    texts = [sentence(r, words, r.randint(12, 60)) for _ in range(r.randint(1, 8))]
    title = sentence(r, words, 5)
    paragraphs = "".join(f"<p>{html.escape(t)}{r.choice(['', '</p>', '</i></p>', '</span></b></p>'])}\n" for t in texts)
    inner = f"<h1>{html.escape(title)}</h1>{paragraphs}"
    body = r.choice([f"<article>{inner}</article>", f'<div class="post-content">{inner}</div>', f"<main>{inner}</main>", f'<main><div id="story">{inner}</div></main>', f'<div><div class="entry">{inner}</div></div>'])
    said = lambda: html.escape(sentence(r, words, r.randint(4, 40)))
    n = r.choice([0, 3, 60, 100, 1000])
    comments = r.choice(
        [
            lambda: '<div id="comments">' + "".join(f"<p>{said()}</p>" for _ in range(n)) + "</div>",
            lambda: '<ol class="commentlist">' + "".join(f"<li>{said()}" for _ in range(n)) + "</ol>",
            lambda: '<section class="comments-list">' + "".join(f'<article class="comment"><b>{said()}</b><p>{said()}</p></article>' for _ in range(n)) + "</section>",
            lambda: "".join(f'<div class="comment-body"><div><p>{said()}</div></div>' for _ in range(n)),
        ]
    )()
    links = lambda k: "".join(f'<a href="/{i}">{said()}</a> ' for i in range(k))
    before = r.choice(["", f"<nav>{links(9)}</nav>", f'<header><a href="/">{said()}</a></header>', f'<div class="cookie-notice"><p>{said()}</p></div>', f'<div class="menu">{links(5)}'  "</div>"])
    after = r.choice(["", f"<footer><p>{said()}</p></footer>", f'<div class="sidebar"><p>{said()}</p>{links(4)}</div>', f"<form><p>{said()}</p><input></form>", f'<div id="ad-slot-2"><p>{said()}</p></div>', "<script>var a = '<p>no</p>';</script>"])
    parts = [body, comments] if r.random() < 0.8 else [f'<div class="wrap">{body}{comments}</div>']
    return f"<!doctype html><html><head><title>x</title><style>p {{}}</style></head><body>{before}{''.join(parts)}{after}</body></html>", " ".join([title, *texts])


@pytest.mark.parametrize("seed", range(150))
def test_planted_articles_come_back_whole(seed):
    source, text = page(seed)
    assert main_text(source) == text


@pytest.mark.parametrize("n", [60, 100, 1000])
@pytest.mark.parametrize("shape", ['<div id="comments">{}</div>', '<ol class="commentlist">{}</ol>', '<div id="disqus_thread"><section class="comments">{}</section></div>'])
def test_comments_never_win_over_a_short_article(n, shape):
    kind = "li" if "<ol" in shape else "p"
    thread = shape.format(f"<{kind}>A reader says, at some length, what the reader thinks of it; and, by the way, of much else too.</{kind}>" * n)
    article = "An article of two hundred characters or so, which has no more to say than this, and then says it. " * 2
    assert main_text(f"<body><div><p>{article}</p></div>{thread}</body>") == article.strip()
    assert main_text(f"<body>{thread}</body>").startswith("A reader says")  # where nothing else is


@pytest.mark.parametrize("unit", ["<b>x</i>", "<font>x</span>", "<div><p>some, text", "<div>", "<ul><li>a", "<article><header><h2>x</h2>", "<table><tr><td>x", "<b><p>x", '<div class="comment"><p>x', "<main><p>t", "<form><p>x", "<a href=x>y", "< ", "</div>"])
@pytest.mark.parametrize("start", ["", "<i><div>"])
def test_malformed_and_deep_pages_take_linear_time(unit, start):
    took = []
    for n in (1 << 16, 1 << 18):
        source = start + unit * (n // len(unit))
        best = 1e9
        for _ in range(2):
            t = time.process_time()
            main_text(source)
            best = min(best, time.process_time() - t)
        took.append(best)
    assert took[1] < 8 * took[0] + 0.2 and took[1] < 6  # four times the length


def test_ends_that_are_left_out():
    assert main_text("<main><ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>e<p>f<div>g</div>h</main>") == "a b c d e f g h"
    assert main_text("<main><table><tr><td>a<td>b<tr><td>c<table><tr><td>d</table>e</table></main>") == "a b c d e"
    assert main_text("<main><p>x <b>y<div>z</b> w</div> v</main>") == "x y z w v"
    assert main_text("<main><h2>a<h3>b</h3><dl><dt>c<dd>d<dt>e</dl></main>") == "a b c d e"
