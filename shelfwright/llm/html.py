"""Main text of web pages by a recurrent block labeller (operator 5).

A page is read as the sequence of its text blocks. Each block has a vector of its hashed tag path, its hashed
words and a few numbers, among them how it lies to its neighbours and to the element that holds most of the page's text;
a bidirectional LSTM in numpy reads the whole sequence and says of every block whether it belongs to the article. It is
trained on a bounded sample of the pages, labelled by their semantic tags, and on variants of them: the same texts in other
wrappers and as lists, tables, quotes or code, with sidebars, notices, forms and reader comments put in, which are told by where their texts
come from. Most wrappers of the variants have made-up names or none, so that place and shape tell what names don't.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pick, texts_of

#: Pages that the labeller learns from, at most, and the code points and blocks that such a page has at most. Longer ones teach nothing.
SAMPLE_PAGES, TRAIN_CHARS, TRAIN_BLOCKS = 200, 1_000_000, 1000
HIDDEN, PATH_DIM, WORD_DIM, NUMBERS = 16, 160, 24, 19
EPOCHS, BATCH, RATE, VARIANTS = 8, 32, 0.01, 8
#: The article's element holds this share of the page's text, and no smaller element in it does.
MAIN_SHARE = 0.4

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title|head)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>",
    re.S | re.I,
)
CLASS = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Tags that don't part blocks; those without content; and those that a new one of the same closes.
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
for _tag in ("div", "article", "section", "ul", "ol", "table", "form", "footer", "header", "nav", "aside", "main", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"):
    CLOSES[_tag] = {"p"}

#: Wrappers of the training variants, by what they hold.
ARTICLE = ('article', 'main', 'div class="content"', 'div class="post"', 'div class="entry-content"', 'div id="main-content"', 'div class="article-body"', 'section class="story"')
MENU = ('nav', 'div class="menu"', 'div class="navbar"', 'header', 'div id="navigation"', 'div class="breadcrumb"', 'ul class="nav"')
OTHER = (
    'footer', 'div class="footer"', 'div id="bottom"', 'aside', 'div class="sidebar"', 'div class="widget"', 'div class="related"', 'div class="ad"',
    'div class="advert"', 'div class="promo"', 'div class="sponsored"', 'div class="cookie-notice"', 'div class="notice"', 'div class="newsletter"', 'form',
    'div class="login"', 'div class="comments"', 'section id="comments"', 'div class="comment"', 'div class="share"', 'header', 'div class="header"', 'div class="banner"',
)
#: Class words of grids and utilities, for deep markup in training variants; made-up words are added.
GRID = ("container", "container-fluid", "row", "col", "col-12", "col-md-8", "col-lg-6", "offset-lg-1", "d-flex", "flex-column", "justify-content-center", "align-items-start", "gx-4", "px-3", "py-2", "mb-4", "mx-auto", "w-full", "grid", "inner", "wrap", "box", "block", "clearfix")
GOOD = re.compile(r"^(?:article|main)$")
BAD = re.compile(r"^(?:nav|header|footer|aside|form|menu|navbar|sidebar|ad|ads|advert|promo|sponsored|cookie|notice|newsletter|comments?|share|related|banner|widget|login|button|select)$")


class TagPath(list):
    """Names of the elements around a block; `open` has the elements' numbers in the page, the outer ones first, `kinds` what each is (tag and names),
    and `articles` the numbers of those that are article elements."""

    open: tuple[int, ...] = ()
    kinds: tuple[str, ...] = ()
    articles: tuple[int, ...] = ()


def blocks(page: str) -> list[tuple[str, TagPath, int]]:
    """Text blocks in page order: (text, tag path with class words, letters in links)."""
    out: list[tuple[str, TagPath, int]] = []
    stack: list[tuple[str, list[str], int]] = []
    held: list[str] = []
    linked, in_link, at, number = 0, 0, 0, 0

    def close() -> None:
        nonlocal linked
        text = "".join(held)
        if text and not text.isspace():
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                path = TagPath(w for _, names, _ in stack for w in names)
                path.open = tuple(n for tag, _, n in stack if tag not in INLINE)
                path.kinds = tuple(" ".join(names) for tag, names, _ in stack if tag not in INLINE)
                path.articles = tuple(n for tag, _, n in stack if tag == "article")
                out.append((text, path, linked))
        held.clear()
        linked = 0

    def add(part: str) -> None:
        nonlocal linked
        if part:
            held.append(part)
            if in_link:
                linked += len(part)

    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                close()
            continue
        tag = tag.lower()
        if tag not in INLINE:
            close()
        if m[2]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in VOID:
            continue
        if tag == "a":
            in_link += 1
        if tag in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE and stack[k][0] not in CLOSES[tag]:
                    break
        names = [tag]
        if m[4]:
            for c in CLASS.findall(m[4]):
                names += [w for w in re.split(r"[\s_-]+", "".join(c).lower()) if w]
        number += 1
        stack.append((tag, names, number))
    add(page[at:])
    close()
    return out


_word_bucket: dict[str, int] = {}


def bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


def shared(a: tuple[int, ...], b: tuple[int, ...]) -> float:
    """Share of the elements around two blocks that are around both."""
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return n / max(1, len(a), len(b))


def places(page: list[tuple[str, list[str], int]]) -> np.ndarray:
    """How each block lies in the page, as numbers: elements shared with the block before, behind, and with the first heading; share of
    the page's text in its own element and in the one around it; whether it is in the page's main element, and behind it; whether
    the page has an article tag, and the block is in it (1), or is not (-1); whether it is in the first article element and in none
    inside it (1), or in another (-1); how many elements like one around it, of several blocks each, stand beside that one; how many like its
    own element stand beside it; whether a heading of the first rank is in front of it; and whether the first such heading's own parent is around it, or none."""
    opens = [getattr(path, "open", ()) for _, path, _ in page]
    size: dict[int, int] = {}
    total = sum(len(text) for text, _, _ in page)
    for (text, _, _), o in zip(page, opens):
        for x in o:
            size[x] = size.get(x, 0) + len(text)
    main = max((x for x in size if size[x] >= MAIN_SHARE * total), default=0)  # inner elements have larger numbers
    inside = [main in o for o in opens]
    last = max((i for i, y in enumerate(inside) if y), default=len(page))
    heads = [o[:-1] for (_, path, _), o in zip(page, opens) if "h1" in path]
    tagged = [any(GOOD.match(w) for w in path) for _, path, _ in page]
    some = any(tagged)
    articles = [getattr(path, "articles", ()) for _, path, _ in page]
    first = next((a[0] for a in articles if a), 0)
    inner: dict[int, int] = {}
    beside: dict[tuple[int, str], set[int]] = {}
    for o, (_, path, _) in zip(opens, page):
        for up, x, kind in zip((0, *o), o, getattr(path, "kinds", ())):
            inner[x] = inner.get(x, 0) + 1
            beside.setdefault((up, kind), set()).add(x)
    several = {key: sum(inner[x] > 1 for x in xs) for key, xs in beside.items()}
    headed = np.cumsum(["h1" in path for _, path, _ in page]) > 0
    out = np.zeros((len(page), NUMBERS - 6), np.float32)
    for i, o in enumerate(opens):
        around = list(zip((0, *o), getattr(page[i][1], "kinds", ())))
        alike = max((several[key] for key in around), default=0)
        out[i, 8:] = (
            0 if not articles[i] else 1 if articles[i][-1] == first else -1, np.log1p(alike if alike > 1 else 0) / 2, np.log1p(len(beside[around[-1]]) - 1) / 4 if around else 0, headed[i],
            0 if not heads or not heads[0] else 1 if heads[0][-1] in o else -1,
        )
        out[i, :8] = (
            shared(opens[i - 1], o) if i else 0, shared(o, opens[i + 1]) if i + 1 < len(page) else 0, shared(heads[0], o[:-1]) if heads else -1,
            size[o[-1]] / total if o else 0, size[o[-2]] / total if len(o) > 1 else 0, inside[i], i > last, (1 if tagged[i] else -1) if some else 0,
        )
    return out


def vectors(page: list[tuple[str, list[str], int]]) -> np.ndarray:
    """One row of numbers for each block."""
    n = len(page)
    x = np.zeros((n, PATH_DIM + WORD_DIM + NUMBERS), np.float32)
    x[:, PATH_DIM + WORD_DIM + 6 :] = places(page)
    for i, (text, path, linked) in enumerate(page):
        for name in path:
            x[i, bucket(name, PATH_DIM)] = 1.0
        words = text.split(" ")
        ids = []
        for w in words:
            if (b := _word_bucket.get(w)) is None:
                if len(_word_bucket) > 300_000:
                    _word_bucket.clear()
                b = _word_bucket[w] = bucket(w, WORD_DIM)
            ids.append(b)
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(ids, minlength=WORD_DIM) / len(words)
        tail = text[-1]
        x[i, PATH_DIM + WORD_DIM : PATH_DIM + WORD_DIM + 6] = (np.log1p(len(words)) / 5, min(1.0, linked / len(text)), tail in ".!?", i / n, (n - i) / n, np.log1p(n) / 6)
    return x


class Labeller:
    """Bidirectional LSTM with one logistic output a block."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + NUMBERS
        self.p = {}
        for side in "fb":
            self.p["W" + side] = rng.normal(0, 0.1, (d + HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p["c" + side] = np.zeros(4 * HIDDEN, np.float32)
            self.p["c" + side][HIDDEN : 2 * HIDDEN] = 1.0
        self.p["o"] = rng.normal(0, 0.1, (2 * HIDDEN + d, 1)).astype(np.float32)
        self.p["z"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: (steps, pages, d). Steps where mask is 0 leave the state as it is."""
        steps, pages, _ = x.shape
        w, bias = self.p["W" + side], self.p["c" + side]
        d = x.shape[2]
        inner = x.reshape(-1, d) @ w[:d]
        inner = inner.reshape(steps, pages, -1) + bias
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, tape = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            a = inner[t] + h @ w[d:]
            s = 1 / (1 + np.exp(-a[:, : 3 * HIDDEN]))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                tape.append((t, i, f, o, g, c, h, tanh, m))
            c = m * new + (1 - m) * c
            h = m * (o * tanh) + (1 - m) * h
            out[t] = h
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, tf = self._run(x, mask, "f", keep)
        b, tb = self._run(x, mask, "b", keep)
        both = np.concatenate((f, b, x), 2)
        y = 1 / (1 + np.exp(-(both @ self.p["o"] + self.p["z"])[..., 0]))
        return y, both, tf, tb

    def gradients(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        y, both, tf, tb = self.forward(x, mask, True)
        dy = (y - target) * mask / max(1.0, mask.sum())
        grad = {"o": np.einsum("tpk,tp->k", both, dy)[:, None], "z": np.array([dy.sum()], np.float32)}
        dh_all = dy[..., None] * self.p["o"][:, 0]
        d = x.shape[2]
        for side, tape, lo in (("f", tf, 0), ("b", tb, HIDDEN)):
            w = self.p["W" + side]
            dw, db = np.zeros_like(w), np.zeros_like(self.p["c" + side])
            dh, dc = np.zeros_like(tape[0][6]), np.zeros_like(tape[0][5])
            for t, i, f, o, g, c, h, tanh, m in reversed(tape):
                dh = dh + dh_all[t][:, lo : lo + HIDDEN]
                dn = m * (dc + dh * o * (1 - tanh * tanh))
                da = np.concatenate((dn * g * i * (1 - i), dn * c * f * (1 - f), m * dh * tanh * o * (1 - o), dn * i * (1 - g * g)), 1)
                dw[:d] += x[t].T @ da
                dw[d:] += h.T @ da
                db += da.sum(0)
                dh, dc = da @ w[d:].T + (1 - m) * dh, dn * f + (1 - m) * dc
            grad["W" + side], grad["c" + side] = dw, db
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, epochs * max(1, len(pages) // BATCH)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(pages)), max(1, len(pages) // BATCH)):
                x, mask, target = padded([pages[k] for k in part])
                step += 1
                for k, g in self.gradients(x, mask, target).items():
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] -= (RATE * max(0.02, 1 - step / steps) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of each block of each page, pages of like length together."""
        out: list = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            size, longest = 0, len(pages[order[at]])
            while at + size < len(order) and size < 128 and len(pages[order[at + size]]) <= 1.3 * longest + 4:
                size += 1
            part = order[at : at + size]
            x, mask, _ = padded([(pages[k], np.zeros(len(pages[k]), np.float32)) for k in part])
            y = self.forward(x, mask)[0]
            for j, k in enumerate(part):
                out[k] = y[: len(pages[k]), j]
            at += size
        return out


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(x) for x, _ in pages)
    x = np.zeros((steps, len(pages), pages[0][0].shape[1]), np.float32)
    mask, target = np.zeros((steps, len(pages)), np.float32), np.zeros((steps, len(pages)), np.float32)
    for j, (v, t) in enumerate(pages):
        x[: len(v), j], mask[: len(v), j], target[: len(v), j] = v, 1, t
    return x, mask, target


def weak_label(path: list[str]) -> float | None:
    """By semantic tags: 1 in an article, 0 in what is not one, None where the tags don't tell."""
    if any(BAD.match(w) for w in path):
        return 0.0
    return 1.0 if any(GOOD.match(w) for w in path) else None


#: Wrappers of single replies in training variants.
REPLY = ('article class="reply"', 'article', 'li', 'div class="reply"', 'div class="comment-body"', "div", "section")


def variant(page: list[tuple[str, list[str], int]], labels: list[float | None], rng: np.random.Generator, others: list[str] | None = None) -> tuple[str, list[int]]:
    """The page's texts in other wrappers, as HTML, with the labels of its blocks: what was taken from the article is 1, wherever it stands and
    whatever it is (paragraphs, lists, tables, quotes, code); all else is 0, like the replies, which have texts of `others` (by default the page's own)."""
    e = entities.escape
    good = [t for (t, _, _), y in zip(page, labels) if y == 1.0] or [t for t, _, _ in page]
    others = others or good
    short = [" ".join(t.split()[:4]) for t, _, _ in page][:40]
    some = lambda xs: xs[rng.integers(len(xs))]
    parts: list[tuple[str, list[int]]] = []

    hidden = float(some((0.0, 0.6, 1.0)))  # how many wrappers of this page have names that tell nothing

    def wrap(tag: str, inside: str, plain: bool = False) -> str:
        if not plain and tag not in ("article", "main") and rng.random() < hidden:
            name = "".join(chr(97 + k) for k in rng.integers(0, 26, int(rng.integers(3, 12))))
            tag = some(("div", "div", "section")) + some(("", f' class="{name}"', f' class="{name}"', f' id="{name}"'))
        return f"<{tag}>{inside}</{tag.split()[0]}>"

    def grid() -> list[str]:
        """Class attributes of divs that stand in each other."""
        return [" ".join(some(GRID) if rng.random() < 0.8 else f"x{rng.integers(10**6)}" for _ in range(int(rng.integers(1, 6)))) for _ in range(int(rng.integers(1, 9)))]

    usual, deep = grid(), float(some((0.0, 0.5, 1.0)))

    def nested(inside: str) -> str:
        """Divs with many class words around what a wrapper holds, mostly those that the page has everywhere."""
        if rng.random() < deep:
            for words in usual if rng.random() < 0.7 else grid():
                inside = wrap(f'div class="{words}"', inside, True)
        return inside

    def menu(tag: str) -> tuple[str, list[int]]:
        k = int(rng.integers(2, 9))
        return wrap(tag, nested("<ul>" + "".join(f'<li><a href="/x">{e(some(short))}</a></li>' for _ in range(k)) + "</ul>")), [0] * k

    def aside(tag: str) -> tuple[str, list[int]]:
        k = int(rng.integers(1, 4))
        texts = [some(good) if rng.random() < 0.3 else some(others) if rng.random() < 0.4 else some(short) for _ in range(k)]
        inner = "".join((f"<p>{e(t)}</p>" if rng.random() < 0.6 else f"<div>{e(t)}</div>") for t in texts) if k > 1 or rng.random() < 0.5 else e(texts[0])
        return wrap(tag, nested(inner)), [0] * k

    def article() -> list[tuple[str, list[int]]]:
        """The article's texts as paragraphs, lists, tables, quotes, code, captions and headings. Some have nothing but a list behind the beginning."""
        if plain:
            return [(f"<p>{e(t)}</p>", [1]) for t in good]
        out, k, first = [], 0, rng.random() < 0.7
        listed = int(rng.integers(1, 4)) if rng.random() < 0.2 else len(good)
        while k < len(good):
            left = len(good) - k if k >= listed else min(len(good) - k, int(rng.integers(2, 6)))
            kind = "h1" if k == 0 and first else "list" if k >= listed else some(("p", "p", "p", "p", "p", "p", "list", "table", "quote", "pre", "div", "h2", "figure"))
            some_texts = [e(t) for t in good[k : k + left]]
            if kind == "list" and left > 1:
                tag = some(("ul", "ul", "ol"))
                out.append((f"<{tag}>" + "".join(f"<li>{t}</li>" for t in some_texts) + f"</{tag}>", [1] * left))
            elif kind == "table" and left > 1:
                out.append(("<table>" + "".join(f"<tr><td>{t}</td></tr>" if rng.random() < 0.5 else f"<tr><th>{t}</th></tr>" for t in some_texts) + "</table>", [1] * left))
            else:
                left = 1
                form = {"h1": "<h1>{}</h1>", "h2": "<h2>{}</h2>", "quote": some(("<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>")), "pre": some(("<pre>{}</pre>", "<pre><code>{}</code></pre>")), "div": "<div>{}</div>", "figure": "<figure><figcaption>{}</figcaption></figure>"}
                block = form.get(kind, "<p>{}</p>").format(some_texts[0])
                out.append((wrap(some(("header", "div")), block, True) if kind == "h1" and rng.random() < 0.2 else block, [1]))
            k += left
        if rng.random() < 0.25:
            out.insert(int(rng.integers(0, len(out) + 1)), aside(some(OTHER)))
        if rng.random() < 0.2:
            out.append(replies(True))
        return out

    def replies(apart: bool = False) -> tuple[str, list[int]]:
        """Reader comments: name, date, one or more paragraphs, perhaps a button, each in an element of its own or all in a row; often more text than the article.
        apart: in a wrapper of their own in any case."""
        inner, ys, each, tag, bare = "", [], rng.random() < 0.75, some(REPLY), rng.random() < 0.2
        for _ in range(int(rng.integers(1, 9))):
            told = [some(short) for _ in range(int(rng.integers(0, 3)))] + [some(others) for _ in range(int(rng.integers(1, 4)))] + ([some(short)] if rng.random() < 0.3 else [])
            told = [some(others)] if tag == "li" and bare else told
            part = e(told[0]) if len(told) == 1 and bare else "".join(f"<p>{e(t)}</p>" if len(t) > 40 or rng.random() < 0.5 else f"<div>{e(t)}</div>" for t in told)
            inner += wrap(tag, part, rng.random() < 0.5) if each else part
            ys += [0] * len(told)
        inner = f"<ul>{inner}</ul>" if each and tag == "li" else inner
        return (wrap(some(('div class="comments"', 'section id="comments"', 'div class="replies"', "div")), nested(inner)) if apart or rng.random() < 0.75 else nested(inner)), ys

    def strange(tag: str) -> tuple[str, list[int]]:
        """Paragraphs like the article's, in another wrapper."""
        k = int(rng.integers(1, max(2, min(5, len(good) // 2 + 1))))
        return wrap(tag, nested("".join(f"<p>{e(some(good if rng.random() < 0.5 else others))}</p>" for _ in range(k)))), [0] * k

    plain = rng.random() < 0.2  # paragraphs without a heading, and little else
    head = [menu(some(MENU))] if rng.random() < (0.2 if plain else 0.8) else []
    head += [] if plain else [aside(some(OTHER)) for _ in range(int(rng.integers(0, 3)))]
    tail = [strange(some(OTHER))] if plain else [replies() if rng.random() < 0.5 else aside(some(OTHER)) for _ in range(int(rng.integers(1, 4)))]
    inner = article()
    main = (wrap("article" if rng.random() < 0.25 else some(ARTICLE), nested("".join(h for h, _ in inner))), [y for _, ys in inner for y in ys])
    if rng.random() < 0.35:  # the article and what follows in one wrapper
        both = [main, *tail]
        main, tail = (wrap(some(("main", "main", "div", 'div class="content"', "article")), "".join(h for h, _ in both)), [y for _, ys in both for y in ys]), []
    parts = [*head, main, *tail]
    body = "".join(h for h, _ in parts)
    if rng.random() < 0.4:
        body = wrap(some(('div class="wrapper"', 'div id="page"', "div")), body, True)
    return f"<html><body>{body}</body></html>", [y for _, ys in parts for y in ys]


def train(sample: list[str], seed: int = 3) -> Labeller:
    """Learn from pages (HTML): their own semantic tags, and VARIANTS other wrappings of each, with replies made of other pages' texts."""
    rng = np.random.default_rng(seed)
    read = [(found, [weak_label(p) for _, p, _ in found]) for found in map(blocks, sample) if 0 < len(found) <= TRAIN_BLOCKS]
    texts = [t for found, labels in read for (t, _, _), y in zip(found, labels) if y == 1.0] or ["text"]
    examples = []
    for found, labels in read:
        if all(y is not None for y in labels):
            examples.append((vectors(found), np.array(labels, np.float32)))
        for _ in range(VARIANTS):
            text, ys = variant(found, labels, rng, texts)
            again = blocks(text)
            if len(again) == len(ys):
                examples.append((vectors(again), np.array(ys, np.float32)))
    model = Labeller()
    if examples:
        model.fit(examples)
    return model


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Labeller:
    """Train on `sample_pages` pages at most, chosen by a hash of their id; they are all that the driver gets. Pages of more than TRAIN_CHARS
    code points or TRAIN_BLOCKS blocks are not learned from."""
    known = pick(pages, "page_id", "html").where(F.length("html") <= TRAIN_CHARS)
    place = F.shiftrightunsigned(F.xxhash64("page_id", F.lit("sample")), 1)
    # a share that holds about twice the sample is sorted, not all pages
    some = known.where(place <= 2 * int(2**62 * min(1.0, (2 * sample_pages + 20) / max(1, known.count()))) - 1)
    rows = some.orderBy(place, "page_id").limit(sample_pages).collect()
    return train([r["html"] for r in rows])


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """Main text of every page, from its whole HTML: (page_id, url, text, n_chars, n_blocks, n_kept).

    Character references are decoded, white space inside a block becomes one space, blocks are joined in page order
    by one space. A null or empty page has the empty text. Repeated rows stay; no rows give no rows; other columns
    are not read.
    """
    pages = pick(pages, "page_id", "url", "html")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(t.decode("utf-8", "replace")) for t in texts_of(batch, "html")]
            labels = model.label([vectors(f) if f else np.zeros((0, 1), np.float32) for f in found])
            kept = [[b[0] for b, y in zip(f, ys) if y >= 0.5] for f, ys in zip(found, labels)]
            texts = [" ".join(k) for k in kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(map(len, kept), pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
            )

    return map_arrow(pages, run, f"page_id {kind}, url string, text string, n_chars long, n_blocks long, n_kept long")
