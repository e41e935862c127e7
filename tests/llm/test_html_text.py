"""Tag-path ratios against brute force, and pages on which they decide."""

import re
import time
from html.parser import HTMLParser

import pytest

from logspark.llm import html_text

SENTENCES = [f"<p>Sentence {i} of the story, which is long enough; it has marks, too.</p>" for i in range(6)]
MENU = "".join(f"<div>Entry {i}</div>" for i in range(120))
#: No element and no class says what is what.
PLAIN = f"<html><body><div><div>{MENU}</div><div><h2>The title</h2>{''.join(SENTENCES)}<p>End</p></div><div>{MENU}</div></div></body></html>"
FLAT = f"<html><body>{MENU}<h2>The title</h2>{''.join(SENTENCES)}<div>Aside</div><p>Last words, of it.</p>{MENU}</body></html>"
STORY = ["The title", *(re.sub("<.*?>", "", s) for s in SENTENCES)]


class Slow(HTMLParser):
    """Blocks of well-formed pages of block elements alone: (path of tags, text)."""

    def __init__(self):
        super().__init__()
        self.path, self.out = [], []

    def handle_starttag(self, tag, attrs):
        self.path.append(tag)

    def handle_endtag(self, tag):
        assert self.path.pop() == tag

    def handle_data(self, data):
        if data.strip():
            self.out.append((tuple(self.path), " ".join(data.split())))


def slow_ratios(page):
    parser = Slow()
    parser.feed(page)
    paths = list(dict.fromkeys(p for p, _ in parser.out))
    mean = lambda size: [sum(size(t) for q, t in parser.out if q == p) / sum(q == p for q, _ in parser.out) for p in paths]
    chars, marks = mean(len), [m + 0.1 for m in mean(lambda t: sum(c in ".,;:!?…。，！？" for c in t))]

    def smooth(x):
        side = html_text.KERNEL[0]
        return [side * x[max(0, i - 1)] + (1 - 2 * side) * v + side * x[min(len(x) - 1, i + 1)] for i, v in enumerate(x)]

    return [a * b for a, b in zip(smooth(chars), smooth(marks), strict=True)]


@pytest.mark.parametrize("page", [PLAIN, FLAT, "<div>one, two</div>", "<div><p>a.</p><ul><li>b</li><li>c, d</li></ul>e</div>"])
def test_ratios_agree_with_brute_force(page):
    assert list(html_text.path_ratios(html_text.read_page(page).blocks).values()) == pytest.approx(slow_ratios(page))


def test_the_ratios_find_an_article_that_nothing_declares(monkeypatch):
    assert html_text.main_text(PLAIN).split("\n") == [*STORY, "End"]
    assert html_text.main_text(FLAT).split("\n") == [*STORY, "Aside", "Last words, of it."]
    monkeypatch.setattr(html_text, "path_ratios", lambda blocks: {b.path: 1.0 for b in blocks})
    assert html_text.main_text(PLAIN) != "\n".join([*STORY, "End"])
    assert "Entry 7" in html_text.main_text(PLAIN) and "Entry 7" in html_text.main_text(FLAT)


def test_a_declared_article_is_kept_whole():
    page = f"<body>{MENU}<article><div>Short</div>{''.join(SENTENCES)}<div class=share>Share</div><div>Tail</div></article>{MENU}</body>"
    assert html_text.main_text(page).split("\n") == ["Short", *STORY[1:], "Tail"]


@pytest.mark.parametrize("page", [
    "<div>x" * 4000, "<b>x" * 8000, "<p>x" * 8000, "<li><b>x" * 4000, "<td><b>x" * 4000 + "<tr>y" * 4000, "<div><p>x</p>" * 4000,
    "<b>" * 4000 + "<li>x" * 4000, "<b>x" * 4000 + "</i>" * 4000, "<p title='" * 4000, '<p title="x>y' * 4001, "<table><tr><td>x" * 2000,
    "<!--" * 4000, "<script>" * 2000, "<a href=x>y" * 4000, "<article><header>x" * 2000])
def test_the_time_for_a_page_grows_with_its_length(page):
    def seconds(text):
        start = time.process_time()
        html_text.main_text(text)
        return time.process_time() - start

    html_text.main_text(page[:2000])
    once, four = seconds(page), seconds(page * 4)
    assert once < 1.5 and four < 8 * once + 0.5


def test_unclosed_quotes_end_with_their_tag():
    assert html_text.main_text('<p>Start, here. <a title="it>unclosed</a> text.</p>') == "Start, here. unclosed text."
    assert html_text.main_text("<p title='x>y</p><p>more \"quoted\" text.</p>").endswith('more "quoted" text.')
