"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags. Each block is described by the
tags and class words of its ancestors and by its text; the chain rates main text against the rest and is
decoded by Viterbi. It is trained by maximum likelihood on labelled pages, which are laid out from the
lists below with the same kind of prose in every part, so that structure has to tell them apart.

Defined cases: null or empty html has no text; unclosed tags, comments and scripts end with the page; a
page without main blocks gives an empty text; nothing is cut from long pages; repeated rows stay.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Callable, Container, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import pick, table

#: Tags that end a block, tags without content, tags whose content is no text of the page.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = "script|style|noscript|template|svg|iframe|title|textarea"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW_TAGS})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*+>|\Z)|"
    r"<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*+(?:>|\Z)|</?[a-z][^>]*+(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(frozen=True)
class Block:
    text: str
    around: frozenset
    own: tuple


def _marks(tag: str, attrs: str) -> list[str]:
    out = [f"in:{tag}"]
    for m in _ATTR.finditer(attrs):
        out += [f"{'role' if m[1].lower() == 'role' else 'c'}:{w.lower()}" for w in _WORD.findall(m[2] or m[3] or m[4] or "") if len(w) > 1]
    return out


def _text_marks(text: str, linked: int, parent: str) -> tuple:
    n = text.count(" ") + 1
    share = linked / max(1, len(text))
    return (
        f"p:{parent}", f"n:{min(9, n.bit_length())}", f"link:{'all' if share > 0.9 else 'some' if share > 0.3 else 'few' if share else 'none'}",
        f"end:{text[-1] if text[-1] in '.!?:…' else 'x'}", f"commas:{min(3, text.count(','))}", "copy" if "©" in text else "nocopy", "bias")


def blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """Leaf blocks of a page in order, with decoded text and white space made single spaces.

    With ``known``, blocks are described by ancestor features of that vocabulary only, which bounds them on pages of any depth.
    """
    out: list[Block] = []
    stack: list[tuple[str, frozenset]] = []
    pieces: list[str] = []
    linked, links, around, parent = 0, 0, frozenset(), ""
    at = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, around, _text_marks(text, linked, parent)))
            pieces.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal links
        for tag, _ in stack[depth:]:
            links -= tag == "a"
        del stack[depth:]

    def words(piece: str) -> None:
        nonlocal around, parent, linked
        if not pieces:
            if not piece.strip():
                return
            around = stack[-1][1] if stack else frozenset()
            parent = next((t for t, _ in reversed(stack) if t in BLOCK_TAGS), "")
        pieces.append(piece)
        if links:
            linked += len(piece)

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            words(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        block = tag in BLOCK_TAGS
        if tag == "br":
            words(" ")
            continue
        if block:
            flush()
        if m["end"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
                if not block and stack[depth][0] in BLOCK_TAGS:
                    break  # an inline end tag doesn't reach over a block
            continue
        if block:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p" or tag == stack[depth][0] in ("li", "dt", "dd", "td", "th", "tr", "option"):
                    close(depth)
                    break
                if stack[depth][0] in BLOCK_TAGS:
                    break
        if tag in VOID_TAGS:
            continue
        above = stack[-1][1] if stack else frozenset()
        new = [x for x in _marks(tag, m["attrs"]) if x not in above and (known is None or x in known)] if block or m["attrs"] else []
        if new:
            above = above.union(new)
        stack.append((tag, above))
        links += tag == "a"
    if at < len(page):
        words(page[at:])
    flush()
    return out


@dataclass
class Chain:
    """weights rate main against other per feature; moves[a][b] rates label b after a."""

    weights: dict[str, float]
    moves: list[list[float]]

    def emit(self, block: Block, cache: dict[frozenset, float]) -> float:
        score = cache.get(block.around)
        if score is None:
            score = cache[block.around] = sum(self.weights.get(f, 0.0) for f in block.around)
        return score + sum(self.weights.get(f, 0.0) for f in block.own)

    def decode(self, scores: list[float]) -> list[int]:
        """Most likely labels (1 main) by Viterbi; ties go to 0."""
        if not scores:
            return []
        m, best, came = self.moves, (0.0, scores[0]), []
        for s in scores[1:]:
            to0, to1 = (best[0] + m[0][0], best[1] + m[1][0]), (best[0] + m[0][1], best[1] + m[1][1])
            came.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
            best = (max(to0), max(to1) + s)
        label = int(best[1] > best[0])
        out = [label]
        for c in reversed(came):
            label = c[label]
            out.append(label)
        return out[::-1]


def _log_sum(a: float, b: float) -> float:
    high = max(a, b)
    return high + math.log1p(math.exp(-abs(a - b)))


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> Chain:
    """Maximum likelihood by forward-backward and AdaGrad, page by page."""
    chain, squares = Chain({}, [[0.0, 0.0], [0.0, 0.0]]), {}
    rng = random.Random(seed)

    def step(key, value: float, gradient: float) -> float:
        gradient -= decay * value
        squares[key] = squares.get(key, 1e-6) + gradient * gradient
        return value + rate * gradient / math.sqrt(squares[key])

    for _ in range(epochs):
        order = list(range(len(pages)))
        rng.shuffle(order)
        for i in order:
            own, labels = pages[i]
            if not own:
                continue
            cache: dict[frozenset, float] = {}
            s, m, n = [chain.emit(b, cache) for b in own], chain.moves, len(own)
            ahead, back = [(0.0, s[0])], [(0.0, 0.0)] * n
            for t in range(1, n):
                a = ahead[-1]
                ahead.append((_log_sum(a[0] + m[0][0], a[1] + m[1][0]), _log_sum(a[0] + m[0][1], a[1] + m[1][1]) + s[t]))
            for t in range(n - 2, -1, -1):
                b = back[t + 1]
                back[t] = (_log_sum(m[0][0] + b[0], m[0][1] + s[t + 1] + b[1]), _log_sum(m[1][0] + b[0], m[1][1] + s[t + 1] + b[1]))
            total = _log_sum(*ahead[-1])
            moves = [[0.0, 0.0], [0.0, 0.0]]
            changes: dict[str, float] = {}
            for t in range(n):
                gap = labels[t] - math.exp(ahead[t][1] + back[t][1] - total)
                for f in (*own[t].around, *own[t].own):
                    changes[f] = changes.get(f, 0.0) + gap
                if t:
                    moves[labels[t - 1]][labels[t]] += 1
                    for x in (0, 1):
                        for y in (0, 1):
                            moves[x][y] -= math.exp(ahead[t - 1][x] + m[x][y] + (s[t] if y else 0.0) + back[t][y] - total)
            for f, g in changes.items():
                chain.weights[f] = step(f, chain.weights.get(f, 0.0), g)
            for x in (0, 1):
                for y in (0, 1):
                    m[x][y] = step((x, y), m[x][y], moves[x][y])
    return chain


#: Parts of the labelled pages: openings by kind of part. Fixed values.
LAYOUTS: dict[str, tuple[str, ...]] = {
    "main": ('<article>', '<main>', '<div class="content">', '<div id="content">', '<div class="post-content">', '<div class="entry-content">', '<section class="article-body">', '<div id="main">', '<div class="story">', '<article class="post">', '<div class="article">', '<main id="main-content">', '<div class="text">', '<div itemprop="articleBody">', '<div class="page-body">', '<section>', '<div>', '<div class="container"><div class="row">', '<main><article>', '<main class="main"><div class="post">', '<td class="content">'),
    "header": ('<header>', '<header class="site-header">', '<div id="header">', '<div class="masthead">', '<div class="top-bar">', '<div class="header">', '<div class="branding logo">', '<div role="banner">'),
    "menu": ('<nav>', '<ul class="menu">', '<div class="navbar">', '<div id="nav">', '<div class="navigation">', '<ul class="breadcrumbs">', '<div class="breadcrumb">', '<nav class="toc">', '<div class="topnav">', '<menu>', '<div role="navigation">', '<ul id="main-menu">', '<div class="pagination">', '<div class="tabs">', '<div class="links">'),
    "notice": ('<div class="cookie-banner">', '<div class="notice">', '<div id="gdpr-consent">', '<div class="alert">', '<div role="alert">', '<div class="cookies">', '<div class="popup modal">', '<div class="newsletter">', '<section class="notification">', '<div class="privacy-notice">', '<dialog>', '<div class="subscribe">', '<div class="paywall">', '<div class="disclaimer">', '<aside class="notice">'),
    "advert": ('<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="sponsored">', '<div class="promo">', '<div id="banner">', '<aside class="ad">', '<div class="ad-slot">', '<section class="sponsor">', '<div class="adsbygoogle">', '<div class="promotion">', '<div id="ad-top">', '<div class="commercial">'),
    "sidebar": ('<aside>', '<div class="sidebar">', '<div id="sidebar">', '<div class="widget">', '<section class="related">', '<div class="recommended">', '<aside class="sidebar">', '<div class="side">', '<div class="related-posts">', '<div class="popular trending">', '<div role="complementary">', '<div class="more-stories">', '<div class="tags">', '<div class="share social">', '<div class="author-bio">'),
    "form": ('<form>', '<form class="search">', '<div class="search-form"><form>', '<form id="signup">', '<div class="login">', '<form action="/send" class="contact-form">', '<fieldset>', '<div class="search-box">'),
    "comments": ('<section class="comments">', '<div id="comments">', '<ol class="commentlist">', '<div class="comment">', '<div class="replies">', '<div id="disqus_thread">', '<section id="responses">', '<div class="discussion">', '<div class="user-comments">', '<ul class="comment-list">', '<aside class="comments">', '<div class="comments-area">', '<section class="reader-comments">', '<div class="feedback reviews">', '<article class="comment">'),
    "footer": ('<footer>', '<div id="footer">', '<div class="footer">', '<footer class="site-footer">', '<div class="copyright">', '<div class="colophon">', '<div role="contentinfo">', '<div class="legal">', '<div class="bottom-bar">'),
}
SYLLABLES = "an be ci de el fo ga hi in jo ka le mi no or pa qui re sa ti un ve wi xa yo zu".split()


def labelled_page(rng: random.Random, layouts: dict[str, tuple[str, ...]] = LAYOUTS) -> tuple[str, list[int]]:
    """One page of the layouts and the label of each of its leaf blocks, in order."""
    labels: list[int] = []

    def prose(low: int, high: int) -> str:
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        text = "".join(w + (", " if rng.random() < 0.1 else ". " if rng.random() < 0.08 else " ") for w in words).strip(" ,")
        for tag in ("b", "em", "span", "a href='/x'"):
            if rng.random() < 0.1:
                text = f"<{tag}>{text}</{tag.split()[0]}>"
        return text[:1].upper() + text[1:] + rng.choice((".", ".", "!", "", "?"))

    def block(tag: str, text: str, label: int) -> str:
        labels.append(label)
        return f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if tag != "p" or rng.random() < 0.85 else "")

    def ending(opening: str) -> str:
        return "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z]+)", opening)))

    def part(kind: str) -> str:
        opening, inside = rng.choice(layouts[kind]), ""
        listed = kind == "menu" or rng.random() < (0.5 if kind == "sidebar" else 0.15)
        if listed:
            plain = rng.random() < 0.2
            links = "".join(block("li", w if plain else f'<a href="/{i}">{w}</a>', 0) for i, w in enumerate(prose(1, 3) for _ in range(rng.randint(2, 7))))
            inside = links if opening.startswith(("<ul", "<ol", "<menu")) else f"<ul>{links}</ul>"
        elif kind == "form":
            inside = block("label", prose(1, 3), 0) + '<input name="q">' + block(rng.choice(("button", "p", "option", "div")), prose(1, 12), 0)
        else:
            tags = ("li",) if opening.startswith(("<ul", "<ol")) else ("p", "p", "div", "h3", "h2", "span")
            for _ in range(rng.randint(1, 5 if kind == "comments" else 3)):
                tag = rng.choice(tags)
                if tag == "span":  # text right in the part
                    if not inside:
                        labels.append(0)
                        inside = prose(2, 40)
                    continue
                inside += block(tag, prose(1, 60 if rng.random() < 0.5 else 12), 0)
            if not inside:
                labels.append(0)
                inside = prose(2, 20)
        return opening + inside + ending(opening)

    def main() -> str:
        opening, inside = rng.choice(layouts["main"]), ""
        if rng.random() < 0.8:
            head = block("h1", prose(2, 12), 1)
            inside += f"<header>{head}</header>" if rng.random() < 0.1 else head
        for _ in range(rng.choice((0, 1, 2, 4, 7, 12))):
            roll = rng.random()
            if roll < 0.74:
                inside += block("p", prose(1, 8) if rng.random() < 0.25 else prose(10, 120), 1)
            elif roll < 0.8:
                inside += block(rng.choice(("h2", "h3")), prose(1, 8), 1)
            elif roll < 0.85:
                inside += "<ul>" + "".join(block("li", prose(1, 20), 1) for _ in range(rng.randint(1, 5))) + "</ul>"
            elif roll < 0.88:
                inside += block("blockquote", prose(5, 40), 1)
            elif roll < 0.91:
                inside += "<table><tr>" + "".join(block("td", prose(1, 6), 1) for _ in range(rng.randint(1, 5))) + "</tr></table>"
            elif roll < 0.93:
                inside += f'<figure><img src="x.png">{block("figcaption", prose(2, 12), 1)}</figure>'
            elif roll < 0.95:
                inside += block("pre", prose(3, 20), 1)
            elif roll < 0.965:
                inside += block("div", prose(5, 60), 1)
            else:
                inside += part(rng.choice(("advert", "sidebar", "notice", "form")))
        if rng.random() < 0.15:
            inside += part("comments")
        return opening + inside + ending(opening)

    page = "<html><head><title>t</title></head><body>" if rng.random() < 0.8 else ""
    for kind, chance in (("notice", 0.4), ("header", 0.6), ("menu", 0.8), ("advert", 0.5), ("sidebar", 0.2), ("form", 0.2)):
        page += part(kind) if rng.random() < chance else ""
    page += main()
    for kind, chance in (("advert", 0.2), ("comments", 0.5), ("sidebar", 0.5), ("form", 0.3), ("notice", 0.3), ("footer", 0.8)):
        page += part(kind) if rng.random() < chance else ""
    return page + ("</body></html>" if rng.random() < 0.9 else ""), labels


def trained(pages: int = 700, seed: int = 11, layouts: dict[str, tuple[str, ...]] = LAYOUTS) -> Chain:
    """The chain fitted on ``pages`` labelled pages of the layouts."""
    rng, data = random.Random(seed), []
    while len(data) < pages:
        page, labels = labelled_page(rng, layouts)
        own = blocks(page)
        if len(own) == len(labels):
            data.append((own, labels))
    return fit(data)


def main_text(page: str, chain: Chain, cache: dict[frozenset, float]) -> str:
    own = blocks(page, chain.weights)  # features without weight rate nothing
    labels = chain.decode([chain.emit(b, cache) for b in own])
    return "\n".join(b.text for b, label in zip(own, labels) if label)


def extract(pages: DataFrame, chain: Chain, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``pages`` columns id and url (if there) plus text and n_chars."""
    extra = ["url"] if "url" in pages.columns else []
    rows = pick(pages, id_col, *extra, html_col)
    schema = pages.select(id_col, *extra).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[frozenset, float] = {}
        for batch in batches:
            column, texts = batch.column(html_col), []
            for i in range(len(batch)):
                texts.append(main_text(column[i].as_py() or "", chain, cache))
                if len(cache) > 50_000:
                    cache.clear()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (id_col, *extra)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, *extra, "text", "n_chars"])

    return rows.mapInArrow(run, schema)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), trained()).select("page_id", "url", F.col("text"), "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_html_extraction": _query}
ORACLE: dict[str, str] = {}
