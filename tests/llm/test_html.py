"""Main text of generated pages, of pages with misleading names and of broken ones."""
import html
import random
import time

import pytest

from helioscape.llm.html_extract import main_text

LONG = "<p>" + "Words of an article that goes on, and on, for quite a while. " * 4 + "</p>"
WORDS = "river stone cloud market window garden engine paper & < winter harbour signal".split()


def page_and_text(seed: int) -> tuple[str, str]:
    """A page made of an article and parts around it, and the article's blocks as they must come back."""
    rng = random.Random(seed)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)) + ", " + rng.choice(WORDS) + "."
    spaced = lambda t: html.escape(t).replace(" ", rng.choice([" ", "\n  ", "&#32;"]))
    blocks, text = [], []
    for _ in range(rng.randrange(3, 9)):
        kind = rng.choice(["p", "p", "p", "h2", "blockquote", "pre", "ul"])
        lines = [sentence(rng.randrange(20, 60) if kind == "p" else rng.randrange(3, 9)) for _ in range(3 if kind == "ul" else 1)]
        text += lines
        body = "".join(f"<li>{spaced(t)}" for t in lines) if kind == "ul" else spaced(lines[0])
        blocks.append(f"<{kind}>{body}</{kind}>" + rng.choice(["", "<script>var p = '<p>no</p>';</script>", "<!-- <p>no</p> -->",
                                                                  "<div class='advert'>Buy now</div>", "<form><p>Your name, please</p></form>"]))
    start, stop = rng.choice([("<article>", "</article>"), ("<div class='post-body'>", "</div>"), ("<div id=content>", "</div>"),
                              ("<div>", "</div>"), ("<main><div>", "</div></main>"), ("<div class='story related-news'>", "</div>")])
    before = ["<header><p>Name of the site</p></header>", "<nav><ul><li><a href='/'>Home</a></ul></nav>", "<div class='menu'><a href=a>One</a> <a href=b>Two</a></div>",
              "<div class='cookie-notice'>We use cookies, as all do.</div>"]
    after = ["<aside><p>Most read, this week</p></aside>", "<div id='comments'>" + "<p>I disagree, with all of it.</p>" * rng.randrange(1, 40) + "</div>",
             "<footer>Imprint</footer>", "<div class='sidebar'><p>About the author, in short</p></div>"]
    pick = lambda parts: "".join(rng.sample(parts, rng.randrange(len(parts) + 1)))
    return f"<html><head><title>T</title></head><body>{pick(before)}{start}{''.join(blocks)}{stop}{pick(after)}</body></html>", "\n".join(text)


def test_generated_pages_give_their_article():
    for seed in range(300):
        page, text = page_and_text(seed)
        assert main_text(page) == text, seed


@pytest.mark.parametrize("name", ["content right-sidebar", "post tags-politics", "entry search-result", "article share", "story related-news",
                                  "main-alert", "entry-header", "sidebar"])
def test_a_name_alone_does_not_drop_the_article(name):
    page = f"<body><div class=nav><a href=x>Home</a></div><div class='{name}'>{LONG * 3}</div><div class='comments'>{LONG}</div></body>"
    assert main_text(page) == "\n".join([LONG[3:-4].strip()] * 3)


def test_named_parts_that_are_small_or_beside_an_article_go():
    assert main_text(f"<body><article><p>Short one.</p></article><div class='post-widget'>{LONG * 9}</div></body>") == "Short one."
    assert main_text(f"<body><div class='post'>{LONG}<div class='post-tags'>a, b</div></div></body>") == LONG[3:-4].strip()
    assert main_text(f"<body><p>A short article, with words.</p><div class='post-comments'>{LONG * 9}</div></body>") == "A short article, with words."


def test_text_beside_an_unnamed_container_stays():
    page = f"<body><h1>Title</h1>Bare words.<div><h2>Head</h2><p>Short lead.</p><div>{LONG * 3}</div><p>Short end.</p></div><p><a href=x>More</a></p></body>"
    assert main_text(page).split("\n") == ["Title", "Bare words.", "Head", "Short lead.", *[LONG[3:-4].strip()] * 3, "Short end."]


@pytest.mark.parametrize("part,many,end", [
    ("<a ", 100_000, '"'), ("<p>x</p><b><i>", 20_000, ""), ("<b>", 30_000, "</u>" * 30_000), ("<b>", 30_000, "<li></li>" * 15_000),
    ('<a "x>"', 40_000, '"'), ("<", 300_000, ""), ("</", 200_000, ""), ("<!--", 200_000, ""), ("<blockquote>", 10_000, "<li></li>" * 10_000),
    ("<td><b>", 30_000, ""), ("<script>", 50_000, ""), ("<u><div>" + "<b>" * 20_000, 1, "</u>" * 20_000)])
def test_broken_pages_take_time_in_proportion(part, many, end):
    def seconds(n):
        page, start = part * n + end[:len(end) * n // many], time.process_time()
        main_text(page)
        return time.process_time() - start
    if many == 1:
        assert seconds(1) < 5
    else:
        assert seconds(many) < 16 * max(seconds(many // 4), 0.05)
