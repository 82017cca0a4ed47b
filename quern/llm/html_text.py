"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, in
page order.  Each has a vector of its tag path (tags, and the words of class,
id and role of all open elements, hashed), of its words (hashed) and of a few
measures.  A bidirectional LSTM in numpy reads the whole page's sequence in
both directions, so every block is labelled with the page around it in view.

The labeller is trained once a process, on pages that ``sample_pages`` makes
up from a seed: an article among menus, headers, footers, sidebars, notices,
adverts, forms and reader comments, in many arrangements and spellings.

Defined cases: a null or empty html has an empty text; scripts, styles,
comments and the head never become blocks; cut-off pages end where they end;
unclosed and stray tags are tolerated; repeated rows are extracted alike,
whatever their page_id or url, nulls included; other columns are ignored; an
empty table gives an empty result.  All of a block counts, however long.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.common import Adam, prepare, slices

PATH_BITS, WORD_BITS, MEASURES = 160, 24, 6
WIDTH = PATH_BITS + WORD_BITS + MEASURES
HIDDEN = 12
TRAINING_PAGES = 320
ROUNDS = 90

# Element names of the HTML standard by how they are read here.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe title head select button".split())
CLOSED_BY = {"p": {"p", "div", "article", "section", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "nav", "aside", "footer", "header", "form", "main", "blockquote", "pre", "figure"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
SCOPE = frozenset("ul ol table tr div article section main aside nav footer header form body blockquote".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|([^<]+|<)", re.S)
_NAMES = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int  # characters inside links


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks with their text (references decoded, white space single) and path tokens."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            path = [t for name, more in stack for t in (name, *more)]
            near = next((name for name, _ in reversed(stack) if name not in INLINE), "")
            out.append(Block(text, (*path, f"in {near}"), linked))
        held.clear()
        linked = 0

    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        if m[4] is not None:
            held.append(m[4])
            if any(name == "a" for name, _ in stack):
                linked += len(m[4].strip())
        elif m[2] is not None:
            name = m[2].lower()
            if name in INLINE:
                if m[1]:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == name:
                            del stack[k]
                            break
                        if stack[k][0] not in INLINE:
                            break
                elif name not in VOID:
                    stack.append((name, _names(m[3])))
                continue
            flush()
            if name in RAW and not m[1]:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif name in VOID:
                pass
            elif m[1]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if name in CLOSED_BY.get(stack[k][0], ()):
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPE:
                        break
                if not m[3].rstrip().endswith("/"):
                    stack.append((name, _names(m[3])))
        if at >= len(page):
            break
    flush()
    return out


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    return tuple(w.lower() for m in _NAMES.finditer(attributes) for w in _PIECES.findall(m[2] or m[3] or m[4] or ""))


@cache
def _slot(kind: str, word: str, size: int) -> int:
    return zlib.crc32(f"{kind}:{word}".encode()) % size


def _word_slot(word: str) -> tuple[int, float]:
    h = zlib.crc32(word.lower().encode("utf-8", "replace"))
    return PATH_BITS + h % WORD_BITS, 1.0 if h & 0x10000 else -1.0


def vectors(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), WIDTH))
    n = len(blocks)
    for i, b in enumerate(blocks):
        x[i, [_slot("path", t, PATH_BITS) for t in set(b.path)]] = 1
        words = b.text.split()
        for w in words:
            k, sign = _word_slot(w)
            x[i, k] += sign / (1 + len(words)) ** 0.5
        x[i, -MEASURES:] = (np.log1p(len(b.text)) / 6, min(1.0, b.linked / len(b.text)), i / n, float(b.text[-1] in ".!?…"), float("©" in b.text or "copyright" in b.text.lower()), sum(map(str.isdigit, b.text)) / len(b.text))
    return x


class Labeller:
    """One LSTM a direction and a logistic output on both states."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        # by direction: input, recurrent and bias weights of the gates in, forget, out, and of the new content
        self.weights = [w for _ in range(2) for w in (r.normal(0, 0.15, (WIDTH, 4 * HIDDEN)), r.normal(0, 0.25, (HIDDEN, 4 * HIDDEN)), np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]))]
        self.weights += [r.normal(0, 0.2, 2 * HIDDEN), np.zeros(1)]

    @staticmethod
    def _gates(z: np.ndarray) -> tuple[np.ndarray, ...]:
        s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
        return s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])

    def _read(self, x: np.ndarray, mask: np.ndarray, way: int) -> tuple[np.ndarray, list]:
        """States of one direction; x: (pages, blocks, WIDTH), mask: (pages, blocks).  Outside a page the state stands still."""
        wx, wh, b = self.weights[3 * way : 3 * way + 3]
        pages, steps, _ = x.shape
        z = x.reshape(-1, WIDTH) @ wx + b
        z = z.reshape(pages, steps, -1)
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        out, kept = np.zeros((pages, steps, HIDDEN)), []
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            i, f, o, g = self._gates(z[:, t] + h @ wh)
            m = mask[:, t, None]
            c2 = f * c + i * g
            th = np.tanh(c2)
            kept.append((t, h, c, i, f, o, g, th, m))
            h = np.where(m, o * th, h)
            c = np.where(m, c2, c)
            out[:, t] = h
        return out, kept

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._read(x, mask, 0)[0], self._read(x, mask, 1)[0]], 2)
        return 1 / (1 + np.exp(-np.clip(both @ self.weights[6] + self.weights[7], -30, 30)))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy, by back-propagation through both directions."""
        (fore, kept0), (back, kept1) = self._read(x, mask, 0), self._read(x, mask, 1)
        both = np.concatenate([fore, back], 2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.weights[6] + self.weights[7], -30, 30)))
        d = (p - y) * mask / mask.sum()
        out: list[np.ndarray] = []
        for way, kept in ((0, kept0), (1, kept1)):
            wh = self.weights[3 * way + 1]
            dout = d[:, :, None] * self.weights[6][way * HIDDEN : (way + 1) * HIDDEN]
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN))
            gh = np.zeros_like(wh)
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            for t, h, c, i, f, o, g, th, m in reversed(kept):
                dh = dh + dout[:, t]
                into = dc + dh * o * (1 - th * th)
                step = np.hstack([into * g * i * (1 - i), into * c * f * (1 - f), dh * th * o * (1 - o), into * i * (1 - g * g)]) * m
                dz[:, t] = step
                gh += h.T @ step
                dh = np.where(m, step @ wh.T, dh)
                dc = np.where(m, into * f, dc)
            flat = dz.reshape(-1, 4 * HIDDEN)
            out += [x.reshape(-1, WIDTH).T @ flat, gh, flat.sum(0)]
        return [*out, np.tensordot(d, both, ((0, 1), (0, 1))), np.array([d.sum()])]


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    most = max(map(len, pages))
    x, mask = np.zeros((len(pages), most, WIDTH)), np.zeros((len(pages), most), bool)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, True
    return x, mask


# Names that page authors give to the parts around an article.
AROUND = {
    "menu": ("nav", ["", 'class="menu"', 'class="main-nav"', 'id="navbar"', 'role="navigation"', 'class="breadcrumbs"', 'class="top-menu"', 'class="site-nav"']),
    "header": ("header", ["", 'class="site-header"', 'id="header"', 'class="masthead"', 'class="banner"', 'role="banner"', 'class="topbar"']),
    "footer": ("footer", ["", 'class="site-footer"', 'id="footer"', 'role="contentinfo"', 'class="bottom"', 'class="copyright"']),
    "sidebar": ("aside", ["", 'class="sidebar"', 'id="sidebar"', 'class="widget"', 'role="complementary"', 'class="related"', 'class="rail"', 'class="recommended"']),
    "notice": ("div", ['class="cookie-notice"', 'id="cookie"', 'class="cookie-banner"', 'class="notice"', 'class="alert"', 'class="popup"', 'class="consent"', 'role="alert"', 'class="newsletter"', 'class="paywall"']),
    "advert": ("div", ['class="ad"', 'class="ads"', 'id="ad-1"', 'class="advert"', 'class="advertisement"', 'class="sponsored"', 'class="promo"', 'class="ad-slot"', 'class="banner-ad"']),
    "form": ("form", ["", 'class="search"', 'action="/subscribe"', 'class="login"', 'class="signup"', 'id="contact"']),
    "comments": ("section", ['class="comments"', 'id="comments"', 'class="comment-list"', 'class="responses"', 'id="disqus"', 'class="reader-comments"', 'class="comment"']),
    "share": ("div", ['class="share"', 'class="social"', 'class="tags"', 'class="pagination"', 'class="byline-links"']),
}
PLACES = [("article", ""), ("article", 'class="post"'), ("main", ""), ("main", 'role="main"'), ("div", 'class="content"'), ("div", 'id="content"'), ("div", 'class="article-body"'), ("div", 'class="entry-content"'), ("section", 'class="story"'), ("div", 'itemprop="articleBody"'), ("div", 'class="text"')]


def sample_pages(n: int, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Made-up pages and, for each leaf block, whether it is of the article."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    letters = "etaoinshrdlucmfwypvbgkéèüößñ"

    def words(k: int) -> str:
        out = ["".join(pick(letters) for _ in range(int(r.integers(1, 11)))) for _ in range(max(1, k))]
        return (" ".join(out)).capitalize() + pick([".", "", ".", "!", "?"])

    def around(kind: str) -> tuple[str, int]:
        tag, attributes = AROUND[kind]
        tag = tag if r.random() < 0.7 else "div"
        attribute = pick([a for a in attributes if a or tag != "div"])
        k = int(r.integers(1, 6))
        if kind in ("menu", "share") or (kind in ("sidebar", "footer", "header") and r.random() < 0.4):
            body = "<ul>" + "".join(f'<li><a href="/{i}">{words(int(r.integers(1, 4)))}</a></li>' for i in range(k)) + "</ul>"
        elif kind == "form":
            body = "".join(f"<div><label>{words(2)}</label><input name=x></div>" for _ in range(k))
        elif kind == "comments":
            body = "".join(f'<{t}>{words(int(r.integers(2, 50)))}</{t}>' for t in [pick(["p", "li", "div"])] for _ in range(k))
        else:
            k = 1 if r.random() < 0.6 else k
            line = "&copy; " if kind == "footer" and r.random() < 0.7 else ""
            body = "".join(f"<p>{line}{words(int(r.integers(2, 30)))}</p>" for _ in range(k)) if r.random() < 0.5 else line + words(int(r.integers(2, 30)))
            k = body.count("<p>") or 1
        return f"<{tag}{' ' + attribute if attribute else ''}>{body}</{tag}>", k

    def article() -> tuple[str, int]:
        tag, attribute = pick(PLACES)
        parts, k = [], 0
        if r.random() < 0.8:
            h = f"<h1>{words(int(r.integers(1, 12)))}</h1>"
            parts, k = [h], 1
        for _ in range(int(r.integers(1, 14))):
            kind = r.random()
            body = words(int(r.integers(1, 90)))
            if kind < 0.7:
                parts.append(f"<p>{body}</p>" if r.random() < 0.8 else f"<p><b>{body}<br>")
                k += 1
            elif kind < 0.78:
                parts.append(f"<h2>{words(4)}</h2>")
                k += 1
            elif kind < 0.88:
                m = int(r.integers(1, 5))
                parts.append("<ul>" + "".join(f"<li>{words(8)}</li>" for _ in range(m)) + "</ul>")
                k += m
            elif kind < 0.94:
                parts.append(f"<blockquote>{body}</blockquote>")
                k += 1
            else:
                parts.append(f'<p>{words(6)} <a href="/x">{words(2)}</a> {words(5)}</p>')
                k += 1
        return f"<{tag}{' ' + attribute if attribute else ''}>{''.join(parts)}</{tag}>", k

    out = []
    while len(out) < n:
        before = [around(pick(["menu", "header", "notice", "advert", "form", "sidebar", "menu"])) for _ in range(int(r.integers(0, 4)))]
        after = [around(pick(["footer", "sidebar", "comments", "advert", "share", "form", "comments", "footer", "notice"])) for _ in range(int(r.integers(0, 4)))]
        body, k = article()
        truth = [False] * sum(m for _, m in before) + [True] * k + [False] * sum(m for _, m in after)
        if r.random() < 0.25 and "</p>" in body:  # a block of another kind amid the article
            cut = body.index("</p>") + 4
            more, m = around(pick(["advert", "notice", "share", "sidebar", "form"]))
            at = sum(x for _, x in before) + len(blocks_of(body[:cut]))
            body = body[:cut] + more + body[cut:]
            truth[at:at] = [False] * m
        inner = "".join(x for x, _ in before) + body + "".join(x for x, _ in after)
        if r.random() < 0.3:
            inner = f'<div class="{pick(["wrapper", "container", "page", "row"])}">{inner}</div>'
        page = f"<!DOCTYPE html><html><head><title>{words(3)}</title><script>var x=1;</script></head><body>{inner}</body></html>"
        if len(blocks_of(page)) == len(truth):
            out.append((page, truth))
    return out


@cache
def labeller() -> Labeller:
    """The trained labeller; the same in every process."""
    pages = sample_pages(TRAINING_PAGES)
    x, mask = _padded([vectors(blocks_of(p)) for p, _ in pages])
    y = np.zeros(mask.shape)
    for k, (_, truth) in enumerate(pages):
        y[k, : len(truth)] = truth
    model = Labeller()
    best = Adam([w.shape for w in model.weights], 0.02)
    for _ in range(ROUNDS):
        best.move(model.weights, model.gradients(x, mask, y))
    return model


def texts_of(model: Labeller, pages: list[str]) -> list[str]:
    """The main text of each page.  Pages are labelled together with others of about their length."""
    each = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(each) if b), key=lambda i: len(each[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and to - at < 64 and len(each[order[to]]) * (to - at + 1) < 4000:
            to += 1
        group = order[at:to]
        x, mask = _padded([vectors(each[i]) for i in group])
        p = model.probabilities(x, mask)
        for k, i in enumerate(group):
            out[i] = "\n".join(b.text for b, good in zip(each[i], p[k] > 0.5, strict=False) if good)
        at = to
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    prepare(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(labeller())  # about 20,000 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = texts_of(model.value, [h or "" for h in part.column("html").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
