"""Main text: held-out pages with labelled blocks, links inside articles, names that only sound like furniture, large batches."""

import random

import pyarrow as pa
import pytest

from tomolake.llm import maintext

PROSE = "The council met on Tuesday and heard from people who had come a long way to be there, and who stayed until the end."


def w(r, n):
    return " ".join("".join(r.choice("abcdeghiklmnoprstu") for _ in range(r.randrange(2, 9))) for _ in range(n))


def page(r):
    """(html, kept texts, dropped texts): a page of a kind that the labelled table does not hold."""
    kept, dropped = [], []

    def keep(n):
        kept.append(w(r, n))
        return kept[-1]

    def drop(n):
        dropped.append(w(r, n))
        return dropped[-1]

    def link(n):
        return f"<a href='/{r.random()}'>{drop(n)}</a>"

    menu = "".join(f"<li>{link(r.randrange(1, 4))}</li>" for _ in range(r.randrange(2, 9)))
    top = r.choice([f"<nav class=main-nav><ul>{menu}</ul></nav>", f"<div role=navigation><ul>{menu}</ul></div>", f"<div id=top-menu><ul>{menu}</ul></div>", f"<ul>{menu}</ul>"])
    body = [f"<h1>{keep(r.randrange(3, 10))}</h1>"]
    for _ in range(r.randrange(3, 9)):
        body.append(
            r.choice(
                [
                    lambda: f"<p>{keep(r.randrange(15, 90))}</p>",
                    lambda: f"<p>{keep(r.randrange(20, 60))}</p>",
                    lambda: f"<h2>{keep(r.randrange(2, 8))}</h2><p>{keep(r.randrange(18, 70))}</p>",
                    lambda: f"<blockquote>{keep(r.randrange(10, 40))}</blockquote>",
                    lambda: f"<ul><li>{keep(r.randrange(4, 12))}</li><li>{keep(r.randrange(4, 12))}</li></ul>",
                    lambda: f"<div id={r.choice(['form-of-address', 'notice-of-motion', 'comment-period', 'search-for-water'])}><p>{keep(r.randrange(20, 60))}</p></div>",
                    lambda: f"<div class={r.choice(['ad-box', 'share-links', 'promo', 'newsletter', 'related-links', 'cookie-notice', 'social'])}><p>{drop(r.randrange(3, 30))}</p></div>",
                    lambda: f"<form><p>{drop(6)}</p><button>{drop(1)}</button></form>",
                ]
            )()
        )
    article = r.choice(["<article>{}</article>", "<main>{}</main>", "<div class=post-content>{}</div>", "<section id=story>{}</section>"]).format("".join(body))
    side = f"<aside><h3>{drop(2)}</h3><p>{drop(25)}</p></aside>" if r.random() < 0.5 else f"<div class='widgets right'><p>{drop(12)}</p><ul><li>{link(4)}</li></ul></div>"
    comments = "".join(f"<div class=comment><p>{drop(r.randrange(4, 50))}</p></div>" for _ in range(r.randrange(4)))
    foot = f"<footer><p>{drop(8)}</p><p>{link(2)}</p></footer>"
    return f"<html><body>{top}{article}<section id=comments>{comments}</section>{side}{foot}</body></html>", kept, dropped


def test_held_out_blocks():
    r = random.Random(21)
    right = total = whole = 0
    for _ in range(400):
        html, kept, dropped = page(r)
        lines = set(maintext.main_text(html).split("\n"))
        right += sum(t in lines for t in kept) + sum(t not in lines for t in dropped)
        total += len(kept) + len(dropped)
        whole += lines == set(kept)
    assert right / total > 0.99 and whole / 400 > 0.9


def test_the_tree_decides_by_neighbours_and_density():
    used = set()

    def walk(t):
        if not isinstance(t, bool):
            used.add(t[0])
            walk(t[2])
            walk(t[3])

    walk(maintext.TREE)
    assert {0, 1, 3, 5} <= used  # words, density, density before and after
    x, y = maintext.labelled()
    assert all(maintext.keeps(maintext.TREE, tuple(a)) == b for a, b in zip(x, y, strict=True))


def test_links_alone_inside_an_article_go():
    html = f"<article><h1>Title here</h1><p>{PROSE}</p><ul><li><a href=a>First story</a></li><li><a href=b>Second one</a></li></ul><p><a href=c>Next page</a></p><p>{PROSE} <a href=d>More</a></p></article>"
    assert maintext.main_text(html) == f"Title here\n{PROSE}\n{PROSE} More"


@pytest.mark.parametrize("name", ["form-of-government", "notice-period", "comment-law", "search-history", "has-sidebar"])
def test_names_that_only_sound_like_furniture(name):
    assert maintext.main_text(f"<article><p>{PROSE}</p><div id={name}><p>{PROSE}</p></div></article>") == f"{PROSE}\n{PROSE}"
    assert maintext.main_text(f"<article><p>{PROSE}</p><div class={name}><p>{PROSE}</p></div></article>") == f"{PROSE}\n{PROSE}"


@pytest.mark.parametrize("name", ["ad", "comments", "post-comments", "site-footer", "share_buttons", "newsletter", "cookie-banner wide"])
def test_furniture_by_name_goes(name):
    assert maintext.main_text(f'<article><p>{PROSE}</p><div class="{name}"><p>{PROSE}</p></div></article>') == PROSE


def test_hints():
    assert maintext.hint_of("form-of-government")[0] == pytest.approx(1 / 3) and maintext.hint_of("ad-slot") == (1.0, False) and maintext.hint_of("post-comments wide") == (1.0, False)
    assert maintext.hint_of("main-content") == (0.0, True) and maintext.hint_of("x") == (0.0, False)


def test_batches_are_bounded_by_bytes():
    pages = pa.array(["x" * 50, None, "y" * 200, "z", "z"] * 3)
    ranges = list(maintext._parts(pages, most=4, most_bytes=100))
    assert [a for a, _ in ranges] == [0, *[a + n for a, n in ranges][:-1]] and sum(n for _, n in ranges) == 15
    for a, n in ranges:
        assert n <= 4 and (n == 1 or sum(len(p or "") for p in pages.slice(a, n).to_pylist()) <= 100)
