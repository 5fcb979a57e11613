"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks (text between block-level tags). Each
block has its word count and link density, those of its neighbours, where it stands
(inside the page's article, outside it, or on a page without one), whether an element
around it is furniture by HTML's own meaning (tag, role, hidden), how far the words
of a class or id around it sound like furniture (a share, not a verdict), and whether
it is a heading. A CART tree, grown at import from the small pages below whose blocks
are labelled by hand, keeps or drops each block. Kept blocks are joined in page order.

Defined cases: null and empty pages have empty text; pages without tags are one
block; unclosed comments, scripts and quotes end with the page; very long pages are
read whole, in batches bounded by their bytes; blocks with equal features are treated
alike; repeated pages give equal rows; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.llm.textkit import lean

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:\-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:\-]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"([a-zA-Z\-:]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")

#: Elements whose content is no text of the page; fixed values.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "title", "math", "audio", "video", "textarea"}
#: Elements that part blocks; fixed values.
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "label", "legend", "li", "main",
    "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that are furniture wherever they stand; fixed values.
FURNITURE = {"nav", "aside", "footer", "form", "button", "select", "option", "optgroup", "label", "legend", "fieldset", "dialog", "menu", "head", "search"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Words of a class or id that sound like furniture, ones that say nothing, and ones that tell an article; fixed values.
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations"
    " comment comments commentlist reply replies disqus respond discussion feedback pagination pager widget widgets copyright disclaimer search form paywall".split()
)
NEUTRAL_WORDS = set("area bar bottom block box buttons container inner items left links list page panel posts right section site slot top wrap wrapper".split())
ARTICLE_WORDS = set("article post entry story content main maincontent".split())
_WORDS = re.compile(r"[a-z0-9]+")

#: The labelled table, as pages: each block begins with + (main text) or - (furniture); {n} stands for n words, [n] for a link of n words. Labelled by hand.
LABELLED = [
    "<header><p>-{3}</p></header><nav><ul><li>-[1]<li>-[2]<li>-[1]</ul></nav><article><h1>+{8}</h1><p>+{60}<p>+{45}<ul><li>+{2}<li>+{6}<li>+{1}</ul><p>+{80}</article><footer>-{9}</footer>",
    "<div class=ad>-{14}</div><article><h1>+{5}</h1><p>+{30}<p>+{3}<p>+{70}</article><div class=comments><p>-{25}<p>-{60}</div><footer><p>-{12}<p>-[3]</footer>",
    "<article><h2>+[6]</h2><p>+{40}<p>-[4]<p>+{55}<ul><li>-[3]<li>-[5]<li>-[4]</ul><p>+{62}</article>",
    "<article><p>+{50}<div class=share-buttons><span>-{2}</span></div><p>+{44}<div class=newsletter-signup><p>-{18}</div><p>+{35}<div class=related-posts><h3>-{2}</h3><ul><li>-[6]<li>-[7]</ul></div></article>",
    "<article><h1>+{7}</h1><section id=form-of-government><h2>+{3}</h2><p>+{48}<p>+{33}</section><section class=notice-period><p>+{28}</section><p>+{52}</article>",
    "<main><p>+{66}<div class='ad slot'><p>-{9}</div><p>+{41}<div id=comments><h3>-{1}</h3><p>-{30}<p>-{12}<p>-{55}</div></main>",
    "<div><div>-[1] [1] [2]</div><h1>+{6}</h1><p>+{75}<p>+{4}<p>+{58}<p>+{30}<div>-[1] [1]</div></div>",
    "<div><p>+{22}</p></div>", "<p>+{9}</p>", "<p>+{2}</p>", "<div>+{300}</div>", "<div>+{15} [2] {9}</div>",
    "<table><tr><td>-[1]<td>-[1]<td>-[1]</table><p>+{90}<p>+{35} [3] {20}<p>+{16}<table><tr><td>-{3}<td>-[2]<td>-[3]</table>",
    "<div class=menu><a>-[1]</a></div><div><h2>+{5}</h2><p>+{40}<p>+{26}</div><div class=footer-links><p>-[2]<p>-[3]</div><p>-{5}</p>",
    "<div><div class=cookie-banner><p>-{20}</div><p>+{55}<p>+{8}<p>+{38}<div class=copyright>-{6}</div></div>",
    "<article><div class='widget'><p>-{40}</div><p>+{64}<p>+{22} [5] {12}<blockquote>+{24}</blockquote><p>+{1}</article><aside><p>-{60}</aside>",
    "<article><p>+{33}<p>+{12} [4]<p>+[2] {30}<p>+{6}<p>+{47}</article><div><p>-{35}<p>-[5]<p>-[6]</div>",
    "<article><h1>+{4}</h1><div class=subscribe-box><form><label>-{2}</label><button>-{1}</button></form><p>-{11}</div><p>+{70}<nav><p>-[2]</nav></article>",
    "<div id=content><h1>+{9}</h1><p>+{36}<p>+{2}<p>+{3}<p>+{29}</div><div id=sidebar><p>-{45}<h3>-{2}</h3><p>-[4]</div>",
    "<section class=story><p>+{25}<div class=comment-period-rules><p>+{31}</div><p>+{42}</section><div class=pagination><p>-[1] [1] [1]</div>",
    "<div><p>-[2]<p>-{3}<p>-[3]<p>-{1}<p>-[2]<h2>-{2}</h2><p>-[4]</div>", "<div><h1>+{5}</h1><p>+{18}<h2>+{3}</h2><p>+{50}<h2>+{4}</h2><p>+{64}</div>",
    "<article><p>+{28}<p>-[1] [1] [2] [1]<p>+{31}<p>+{5}<p>-[7]</article>", "<article><ul><li>+{7}<li>+{9}<li>+{2}<li>+{4}</ul><dl><dt>+{1}<dd>+{14}</dl></article><p>-{70}</p>",
    "<article><p>+{40}<aside>-{6}</aside><p>+{52}<form><p>-{9}<label>-{2}</label></form><blockquote>+{8}</blockquote><aside><p>-{30}</aside><p>+{21}</article>",
    "<nav><p>-{12}<p>-{33}</nav><p>+{45}<p>+{31}<footer><p>-{25}<p>-{8}</footer>", "<aside><h2>-{3}</h2><p>-{50}<p>-{28}</aside><div><p>+{61}<p>+{44}</div>",
    "<div>-[1] [1]</div><h2>+{2}</h2><p>+{20}<p>+{2}<p>+{19}<div>-[1]</div>", "<div>-[2] [1]</div><h1>+{6}</h1><p>+{17}<p>+{5}<p>+{23}<div>-[2] [2]</div>",
    "<article><h2>+[3]</h2><p>+{58}<h2>+[5]</h2><p>+{27}</article><div><h3>-[4]</h3><p>-{20}<h3>-[5]</h3><p>-{16}</div>",
    "<div><h3>-[2]</h3><p>-[3]<h3>-[2]</h3><p>-[4]</div><div><h1>+{7}</h1><p>+{39}<p>+{46}</div>",
    "<nav><p>-[1]</nav><article><p>+{2}<p>+{1}<p>+{12}<p>+{3}</article><footer><p>-[1]<p>-[1]</footer>", "<div>-[2]</div><article><p>+{4}</article><div>-[2]</div>",
    "<div>-[1]</div><article><h1>+{3}</h1><p>+{20}<p>+{2}</article><div>-[3]</div>",
    "<article><p>+{40}<p>-[2]<p>+{20}</article>", "<article><p>+{31}<ul><li>-[2]<li>-[2]</ul><p>+{6}</article>",
]


def grow(rows: np.ndarray, keep: np.ndarray, depth: int = 8):
    """A CART tree by Gini impurity: a leaf's label, or (feature, threshold, left, right); left has values up to the threshold."""
    p = keep.mean()
    if depth == 0 or p in (0.0, 1.0):
        return bool(p >= 0.5)
    best = (2 * p * (1 - p), None, None)
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for a, b in zip(values[:-1], values[1:], strict=True):
            left = rows[:, f] <= (a + b) / 2
            gini = sum(m.mean() * 2 * keep[m].mean() * (1 - keep[m].mean()) for m in (left, ~left))
            if gini < best[0] - 1e-12:
                best = (gini, f, (a + b) / 2)
    if best[1] is None:
        return bool(p >= 0.5)
    left = rows[:, best[1]] <= best[2]
    return best[1], best[2], grow(rows[left], keep[left], depth - 1), grow(rows[~left], keep[~left], depth - 1)


def keeps(tree, row: tuple) -> bool:
    while not isinstance(tree, bool):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def hint_of(value: str) -> tuple[float, bool]:
    """(how far a class or id sounds like furniture, whether it tells an article): of the words of its best name the share that are furniture's or say nothing."""
    hint, article = 0.0, False
    for name in value.split():
        words = _WORDS.findall(name)
        known = [w in FURNITURE_WORDS for w in words]
        if any(known):
            hint = max(hint, sum(k or w in NEUTRAL_WORDS or w in ARTICLE_WORDS for k, w in zip(known, words, strict=True)) / len(words))
        else:
            article = article or any(w in ARTICLE_WORDS for w in words)
    return hint, article


def _kind(name: str, attrs: str) -> tuple[bool, float, bool]:
    """(furniture, hint, article) of an element by itself."""
    furniture, hint, article = name in FURNITURE, 0.0, name in ("article", "main")
    if attrs and ("=" in attrs or "hidden" in attrs):
        for m in ATTR.finditer(attrs):
            key = m[1].lower()
            value = (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                sounds, tells = hint_of(value)
                hint, article = max(hint, sounds), article or tells
            elif key == "role":
                furniture = furniture or value in ROLES
                article = article or value in ("main", "article")
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                furniture = True
    return furniture, hint, article and (name in ("article", "main") or not (furniture or hint >= 0.75))


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, float, bool]]:
    """(text, words, words in links, in an article, furniture, hint, heading) of each text block."""
    out: list[tuple[str, int, int, bool, bool, float, bool]] = []
    stack: list[tuple[str, bool, float, bool]] = []  # name, furniture, hint, article: with what stands above
    parts: list[str] = []
    links: list[str] = []
    in_link = False
    n, at = len(page), 0

    def flush() -> None:
        nonlocal in_link
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                _, furniture, hint, article = stack[-1] if stack else ("", False, 0.0, False)
                heading = any(x[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for x in stack[-3:])
                out.append((text, len(text.split()), len(_html.unescape(" ".join(links)).split()), article, furniture, hint, heading))
            parts.clear()
            links.clear()

    while at < n:
        m = TAG.search(page, at)
        end = m.start() if m else n
        if end > at:
            piece = page[at:end]
            parts.append(piece)
            if in_link:
                links.append(piece)
        if not m:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closing = bool(m["close"] or m["close2"])
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in RAW and not closing:
            if not attrs.endswith("/") or name in ("script", "style"):
                close = re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if name == "a":
            in_link = not closing
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK or (not closing and name not in VOID and "hidden" in attrs):
            flush()
            if name in VOID:
                continue
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            else:
                if name != "p" or stack and stack[-1][0] == "p":
                    while stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and name not in ("hgroup",):
                        stack.pop()
                if name == "li" and stack and stack[-1][0] == "li":
                    stack.pop()
                above = stack[-1] if stack else ("", False, 0.0, False)
                furniture, hint, article = _kind(name, attrs)
                if name == "header" and not above[3]:
                    furniture = True
                if name in ("html", "body"):
                    furniture, hint, article = False, 0.0, False
                stack.append((name, above[1] or furniture, max(above[2], hint), above[3] or article))
                in_link = False
    flush()
    return out


def rows_of(found: list) -> list[tuple]:
    """The tree's features of a page's blocks: words, density, those before and after, place, furniture, hint, heading."""
    has_article = any(b[3] and not b[4] for b in found)
    density = [min(1.0, b[2] / b[1]) if b[1] else 0.0 for b in found]
    out = []
    for k, (_, words, _, article, furniture, hint, heading) in enumerate(found):
        before = (found[k - 1][1], density[k - 1]) if k else (0, 0.0)
        after = (found[k + 1][1], density[k + 1]) if k + 1 < len(found) else (0, 0.0)
        place = 2 if article else 0 if has_article else 1
        out.append((words, density[k], *before, *after, place, int(furniture), hint, int(heading)))
    return out


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """(features, keep) of the labelled pages' blocks."""
    rows, keep = [], []
    for page in LABELLED:
        page = re.sub(r"\{(\d+)\}", lambda m: " ".join(["w"] * int(m[1])), page)
        page = re.sub(r"\[(\d+)\]", lambda m: f"<a href=x>{' '.join(['w'] * int(m[1]))}</a>", page)
        found = blocks(page)
        rows += rows_of(found)
        keep += [b[0][0] == "+" for b in found]
    return np.array(rows, float), np.array(keep)


TREE = grow(*labelled())


def main_text(page: str | None) -> str:
    """The kept blocks of a page, one a line."""
    found = blocks(page or "")
    return "\n".join(b[0] for b, row in zip(found, rows_of(found), strict=True) if keeps(TREE, row))


def _parts(column: pa.Array, most: int = 256, most_bytes: int = 64 << 20):
    """Ranges of rows of at most ``most`` pages and ``most_bytes`` (a longer page stands alone): what they return fits an Arrow array."""
    at, rows, total = 0, 0, 0
    for k, n in enumerate(pc.binary_length(column).to_pylist()):
        if rows and (rows == most or total + (n or 0) > most_bytes):
            yield at, rows
            at, rows, total = k, 0, 0
        rows, total = rows + 1, total + (n or 0)
    if rows:
        yield at, rows


@lean
def _extracted(batches):
    for batch in batches:
        for lo, n in _parts(batch.column("html")):
            part = batch.slice(lo, n)
            texts = [main_text(p) for p in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
