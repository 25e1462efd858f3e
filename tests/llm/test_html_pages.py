"""Pages built from known content and known surroundings: the text is the content, whole and in order."""

import html
import random

import pytest

from sparkloom.llm import html_text

NOISE = [
    "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>More</a></li></ul></nav>",
    "<aside><h2>Side</h2><p>Something else entirely to read here.</p></aside>",
    "<div class='ad'>Buy this now, it is very good for you.</div>",
    "<div class='ad-banner'><h2>Buy this now</h2></div>",
    "<form><label>Mail</label><input><button>Send</button></form>",
    "<div id='comments'><h2>Comments</h2><div class='comment'><p>Nice text, thank you for it.</p></div></div>",
    "<div role='navigation'><a href='/a'>One</a> <a href='/b'>Two</a></div>",
    "<script>var a = '<p>x</p>';</script><style>p{}</style>",
    "<footer><p>Copyright by someone who wrote this page.</p></footer>",
    "<div class='cookie-notice'><p>We use cookies on this page, please accept.</p></div>",
]


def words(dice, n):
    return " ".join("".join(dice.choice("aeinorstéß&<") for _ in range(dice.randrange(2, 9))) for _ in range(n))


def article(dice):
    """Markup of an article and its blocks."""
    head = words(dice, 4)
    around = dice.choice(["<div class='post-header'>{}<p class='byline'>By Someone</p></div>", "<header>{}</header>", "<div class='page-header'>{}</div>", "{}"])
    parts, blocks = [around.format(f"<h1>{html.escape(head)}</h1>")], [head]
    for _ in range(dice.randrange(2, 9)):
        kind, text = dice.randrange(6), words(dice, dice.choice([1, 3, 20, 200]))
        safe = html.escape(text)
        if kind == 0:
            parts.append(f"<section><div class='section-header'><h2>{safe}</h2></div></section>")
        elif kind == 1:
            own = [words(dice, 2) for _ in range(3)]
            parts.append("<ul>" + "".join(f"<li>{html.escape(x)} <a href='/q'>more</a></li>" for x in own) + "</ul>")
            blocks += [f"{x} more" for x in own]
            continue
        elif kind == 2:
            parts.append(f"<p>{safe[:0]}<b>{safe}</b></p>")
        elif kind == 3:
            parts.append(f"<blockquote><p>\n {safe} \n</p></blockquote>")
        elif kind == 4:
            parts.append(f"<p>{safe}</p>" + dice.choice(NOISE[:9]))
        else:
            parts.append(f"<p>{safe}")
        blocks.append(text)
    return "".join(parts), blocks


@pytest.mark.parametrize("seed", range(60))
def test_content_of_built_pages(seed):
    dice = random.Random(seed)
    body, blocks = article(dice)
    tag = dice.choice(["article", "main"])
    before, after = ("".join(dice.sample(NOISE, dice.randrange(0, 5))) for _ in range(2))
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}<{tag}>{body}</{tag}>{after}</body></html>"
    assert html_text.main_text(page).split("\n\n") == [" ".join(b.split()) for b in blocks]


def test_a_form_around_the_page_is_its_frame():
    inner = "<div><h1>The Headline</h1>" + "".join(f"<p>{'some words of text ' * 9}{k}.</p>" for k in range(6)) + "</div>"
    frame = f"<body><form id='aspnetForm'><input type='hidden'>{inner}<div><button>Send</button></div></form></body>"
    got = html_text.main_text(frame).split("\n\n")
    assert got == html_text.main_text(f"<body><div>{inner}</div></body>").split("\n\n") and len(got) == 7
    beside = f"<body>{inner}<form><p>{'give us your name and mail ' * 9}</p></form></body>"
    assert "name" not in html_text.main_text(beside)


def test_heads_of_articles_and_lists_of_anchors_stay():
    assert html_text.main_text('<article><div class="post-header"><h1>The Headline</h1></div><p>Some text here.</p></article>') == "The Headline\n\nSome text here."
    assert html_text.main_text('<main><div class="page-header"><h1>The Headline</h1><span>by me</span></div><p>Some text here.</p></main>') == "The Headline\n\nSome text here."
    assert html_text.main_text("<article><ul><li><a>See</a></li><li><a>a b</a></li></ul></article>") == "See\n\na b"
