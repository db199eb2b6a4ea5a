"""Hand-written layouts that the labeller has not seen."""

import random
import time

import pytest

from vellumine.llm import html_text
from vellumine.llm.html_blocks import blocks

ONE, TWO, THREE = "The quick brown fox jumps over the lazy dog near the river bank.", "Second paragraph, with more words to read and understand fully.", "And a third one: it concludes the piece in a few plain sentences. Done."
BODY = f"<h1>My title here</h1><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p>"
WHOLE = f"My title here {ONE} {TWO} {THREE}"
PAGES = {
    "article": (f"<article>{BODY}</article>", WHOLE),
    "divisions": (f"<div id='header'><a href='/'>Site name</a></div><div class='mainNav'><ul><li><a href='/a'>Home</a><li><a href='/b'>News</a></ul></div><div class='mainContent'>{BODY}</div><div class='sideBar'><h3>Related</h3><ul><li><a href=x>One thing</a></ul></div><div id='footer'>&copy; 2024 Company</div>", WHOLE),
    "comments": (f"<header><h1>Blog</h1></header><main>{BODY}</main><section id='comments'><h2>Comments</h2><div class='comment'><p>I liked this one very much, thanks for it!</p></div><div class='comment'><p>Me too.</p></div></section><footer>All rights reserved.</footer>", WHOLE),
    "comments inside": (f"<article>{BODY}<div class='comments'><p>First! I liked this one very much.</p><p>Nope, this is wrong.</p></div></article>", WHOLE),
    "interrupted": (f"<div class='cookie-banner'><p>We use cookies to improve your experience on this site.</p><button>Accept</button></div><article><h1>My title here</h1><p>{ONE}</p><div class='ad'>Buy now, cheap things!</div><p>{TWO}</p><aside class='sidebar'><p>Also read this other piece.</p></aside><p>{THREE}</p></article><form action='/s'><p>Subscribe to our newsletter</p><input name=e><button>Go</button></form>", WHOLE),
    "columns": (f"<div class='wrapper'><div class='row'><div class='col-8'><div class='post'>{BODY}</div></div><div class='col-4'><div class='widget'><h3>Archive</h3><ul><li><a href=a>May</a></li><li><a href=b>June</a></li></ul></div></div></div></div><footer>x &middot; y</footer>", WHOLE),
    "short": ("<nav><ul><li><a href='/a'>A</a></li></ul></nav><div class='ad'>Zu und.</div><article><h1>Ti</h1><p>Ab.</p></article><footer>&copy; h &middot; Os los.</footer>", "Ti Ab."),
    "comment form": (f"<article>{BODY}</article><div class='comment-form'><form><label>Leave a reply</label><textarea>x</textarea><button>Send</button></form></div><ol class='comment-list'><li>Nice one, this is.</li></ol>", WHOLE),
    "nothing": ("<nav><ul><li><a href='/a'>A</a></li></ul></nav><footer>&copy; x</footer>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_layout(spark, name):
    page, text = PAGES[name]
    assert html_text.main_texts([f"<html><head><title>t</title></head><body>{page}</body></html>"], html_text.trained(spark)) == [text]


#: Pages whose markup never closes, nests without end or is cut: (page, number of blocks).
HOSTILE = {
    "nested": ("<div>x" * 50_000, 50_000),
    "nested inline": ("<b>x" * 50_000, 1),
    "open tags": ("<a " * 50_000, 1),
    "open quotes": ('<a href="x' * 50_000, 1),
    "open quotes, closed at the end": ('<a href="x' * 50_000 + ">y", 1),
    "odd quotes": ("<p title='\">x" * 30_001 + "<p>y", 10_002),
    "signs": ("<" * 200_000, 1),
    "open comment behind open tags": ("<a " * 50_000 + "<!-- x", 1),
    "closing tags that open nothing": ("</b></p></li>" * 50_000 + "x", 1),
    "paragraphs in spans": ("<p><span>" * 50_000 + "x", 1),
    "list in lists": ("<ul><li>x" * 25_000, 25_000),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_grows_with_the_page(name):
    page, n = HOSTILE[name]
    began = time.process_time()
    found = blocks(page)
    assert len(found) == n and time.process_time() - began < 10
    began = time.process_time()
    assert len(html_text.vectors(found)) == n and time.process_time() - began < 20


def test_batches_are_bounded_by_blocks(monkeypatch):
    sizes = []
    model = html_text.Labeller()
    pages = [html_text.vectors(blocks("<p>a word.</p>" * n)) for n in (3, 5000, 1, 40, 7, 0, 12)]
    alone = [model.label([p])[0].tolist() for p in pages]
    real = html_text.padded
    monkeypatch.setattr(html_text, "padded", lambda some: sizes.append(len(some) * max(map(len, some))) or real(some))
    monkeypatch.setattr(html_text, "SLICE", 7)
    assert [x.tolist() for x in model.label(pages, 100)] == alone
    assert sorted(sizes)[-1] == 5000 and sum(x > 100 for x in sizes) == 1


def test_every_word_of_a_block_counts():
    one, other = (html_text.vectors(blocks(f"<p>{'word ' * 100}{last}</p>"))[0] for last in ("alpha", "omega"))
    assert (one != other).any()


@pytest.mark.parametrize(
    "markup, want",
    [
        ('<article><p>one <svg class="i"/>two</p><p>three</p></article>', ["one two", "three"]),
        ('<article><p>one <svg><path d="x"/><g><text>no</text></g></svg>two</p><p>three</p></article>', ["one two", "three"]),
        ("<article><p>one <svg><svg>no</svg>no</svg>two</p></article>", ["one two"]),
        ("<article><p>one <svg><path d='x'>no</p><p>two</p></article>", ["one", "two"]),
        ("<article><p>one <svg><path d='x'>no<p>two</p></article>", ["one", "two"]),
        ("<article><p>one</p><svg><foreignObject><div>no</div></foreignObject></svg><p>two</p></article>", ["one", "two"]),
        ("<article><p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>no</annotation></math> is</p><math/><p>two</p></article>", ["Energy E=m is", "two"]),
        ("<article><p>one</p><div><object data='x'>no<b>no</b></div><p>two</p></article>", ["one", "two"]),
        ("<article><p>one</p><div><select><option>no<option>no</div><p>two</p><object>no</object><p>three</p></article>", ["one", "two", "three"]),
        ("<p>a<select><option>no</select>b", ["a", "b"]),
        ("<svg><title>no</title>no<script>no</script></svg>a", ["a"]),
    ],
)
def test_drawings_formulas_and_objects(markup, want):
    assert [b.text for b in blocks(markup)] == want


def test_text_of_random_markup_is_what_a_plain_reader_finds():
    """Words outside of muted elements, in order, for well-formed pages with self-closed and nested drawings."""
    r = random.Random(12)

    def part(depth, muted):
        nonlocal n
        out, told = "", []
        for _ in range(r.randint(1, 4)):
            kind = r.choice(("word", "word", "void", "p", "div", "b", "svg", "math", "select")) if depth else "word"
            if kind == "word":
                n += 1
                out += f" w{n} "
                told += [] if muted else [f"w{n}"]
            elif kind == "void":
                out += r.choice(("<svg/>", "<math />", "<br>", "<img src='x'>", "<svg class='a' />"))
            elif kind in ("p", "div") and muted is None:
                continue
            else:
                quiet = muted or kind in ("svg", "select")
                body, inner = part(depth - 1, quiet) if kind not in ("svg", "math", "select") and not quiet else simple(quiet)
                tag = "div" if kind == "p" else kind
                out += f"<{tag}>{body}</{tag}>"
                told += inner
        return out, told

    def simple(quiet):
        nonlocal n
        n += 1
        return f"<g><mi> w{n} </mi></g><path/>", [] if quiet else [f"w{n}"]

    for _ in range(300):
        n = 0
        page, want = part(4, False)
        assert " ".join(b.text for b in blocks(page)).split() == want, page
