"""Pages without the generator's marks, odd markup, and pages on which a reader could take very long."""

import time

import pytest

from entitystore.llm import html_extraction as H

LONG = " ".join(["word"] * 30)
THREE = f"<p>{LONG} one</p><p>{LONG} <a href=x>{LONG}</a> two</p><p>{LONG} three</p>"


@pytest.mark.parametrize(
    "page",
    [
        "<body><article>%s</article></body>", "<body>%s</body>", '<body class="has-sidebar">%s', '<body class="single comments-open"><article class="share">%s</article>', '<main class="no-sidebar sidebar">%s</main>',
        '<div class="post search-results"><article>%s</article></div>', "<article>%s</article><nav><a>x</a></nav>", "<div>%s</div><nav><a>x</a></nav>", "<nav><a>x</a> <a>y</a></nav><div class=search><article>%s</article></div>",
        "<aside><svg></aside>%s", "<svg>%s", "<title>%s", "<ul><li><a>x</a></li><li><a>y</a></li></ul><div>%s</div><ul><li><a>x</a></li><li><a>y</a></li></ul>",
    ],
)
def test_no_paragraph_is_lost(page):
    text = H.main_text(page % THREE)
    assert [x.split()[-1] for x in text.split("\n")] == ["one", "two", "three"]


def test_tree_uses_words_links_and_place():
    used = {H.FEATURES[n[0]] for n in H.tree() if n[0] >= 0}
    assert {"words", "links", "dropped", "article"} <= used
    x, y = H.table()
    assert H.keep(x) == [bool(v) for v in y]


def test_blocks_of_links_go():
    links = "".join(f"<li><a href=x>item {i}</a></li>" for i in range(5))
    assert H.main_text(f"<ul>{links}</ul><p>{LONG}</p><p>{LONG}</p><ul>{links}</ul>") == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("odd", ['<a "', '<a x=">" ', "<div>", "<nav>", '<div class="ad">', "<svg>", "<a b='\">", "</x", "<!--", "&", "<", "<nav></div>", "class="])
def test_reading_is_linear(odd):
    def took(size):
        page = f"<article><p>{LONG}</p>" + odd * (size // len(odd)) + f"<p>{LONG}</p></article>"
        t = time.process_time()
        H.main_text(page)
        return time.process_time() - t

    took(10_000)
    assert took(800_000) < 3 and took(800_000) < 0.2 + 16 * took(100_000)


def test_odd_markup():
    assert H.main_text("a < b & c <i>d</i>e &lt;f&gt;") == "a < b & c de <f>"
    assert H.main_text("one <b two") == "one" and H.main_text("one <b <i two") == "one <b"
    assert H.main_text("<p>x<!-- <p>y</p> -->z</p>") == "xz"
    assert H.main_text("<p title='a > b'>t</p>") == "t" and H.main_text("<SCRIPT>x</Script >y") == "y"
    assert H.main_text("") == ""
    whole = " ".join(["w"] * 500_000)
    assert H.main_text(f"<article><p>{whole}</p></article>") == whole
