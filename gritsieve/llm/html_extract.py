"""Operator 8: HTML main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks: the text between block-level tags, without comments and without all that script, style,
template, noscript, svg, iframe and select elements hold (to the page's end if they aren't closed; a self-closed svg holds
nothing).
A block is a vector: hashed embeddings of its tag path (names, class and id words of the last ancestors) and of its folded
words, and shape numbers (length, links, punctuation, case, digits, place). A bidirectional LSTM in numpy reads the page's
whole sequence in both directions, so every label sees the whole document, and blocks with a probability of at least
``KEEP_FROM`` make up the text. The network is trained here, once for a process and always alike (fixed seed), on pages of a
generator (:func:`generated_page`) with known labels: articles of one block to dozens between mastheads, menus, crumbs,
bylines, teasers, notices, sponsored boxes, comments and footers, nested in elements drawn at random, with words of random
letters. Neither markup nor words are taken from the corpus.

Scale: one map over pages in Arrow batches, no shuffle; pages of like length are run together as one matrix. Defined cases:
null html gives null text and no blocks; empty or tagless html is text of one block or none; broken nesting is mended as
browsers do (an open p ends at the next block, unmatched ends are ignored); pages of any length are read whole; repeated rows
stay; null ids and urls stay null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .logreg import sigmoid
from .textkernel import Words, mix, need

EMBED, SHAPE, HIDDEN = 16, 8, 12
WIDTH = 2 * EMBED + SHAPE
KEEP_FROM = 0.5
SEED = 11
_U = np.uint64
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<svg\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>|<(script|style|template|noscript|svg|iframe|select)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_WORD = re.compile(r"[A-Za-z]+")


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked, inside = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(tuple(mark for name, mark in stack if name not in _INLINE)[-4:], text, linked))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        text = m.group(5)
        if text is not None:
            text = entities.unescape(text) if "&" in text else text
            parts.append(text)
            if inside:
                linked += len(text.strip())
            continue
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if name == "br":  # a break within a block
            parts.append(" ")
        elif name not in _INLINE:
            flush()
        if m.group(2):
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                del stack[at:]
        elif name not in _VOID and not m.group(4).endswith("/"):
            if name in _CLOSES_P and any(n == "p" for n, _ in stack):
                del stack[max(i for i, (n, _) in enumerate(stack) if n == "p") :]
            marks = [name]
            for a in _NAMES.findall(m.group(4)):
                marks += _WORD.findall("".join(a).lower())[:4]
            stack.append((name, " ".join(marks)))
        inside = sum(n == "a" for n, _ in stack)
    flush()
    return out


_TABLE = np.random.default_rng(SEED).choice([-1.0, 1.0], (4096, EMBED)).astype(np.float32)


@functools.lru_cache(1 << 14)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(EMBED, np.float32)
    for depth, mark in enumerate(reversed(path)):
        for word in mark.split():
            raw = np.frombuffer(word.encode(), np.uint8)
            out += _TABLE[int(Words(raw, np.array([0, len(raw)])).hash[0] >> _U(52))] / (1 + depth)
    return out / 2


def vectors(found: list[Block]) -> np.ndarray:
    """(blocks, WIDTH) float32 of one page."""
    n = len(found)
    out = np.zeros((n, WIDTH), np.float32)
    if not n:
        return out
    raw = [b.text.encode("utf-8", "replace") for b in found]
    size = np.array([len(r) for r in raw])
    off = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    words = Words(data, off)
    count = np.diff(words.first)
    total = np.concatenate([np.zeros((1, EMBED), np.float32), np.cumsum(_TABLE[(mix(words.hash) >> _U(52)).astype(np.int64)], axis=0)])
    out[:, EMBED : 2 * EMBED] = (total[words.first[1:]] - total[words.first[:-1]]) / np.sqrt(np.maximum(count, 1))[:, None] / 2
    norm = np.sqrt((out[:, EMBED : 2 * EMBED] ** 2).sum(1, keepdims=True))
    out[:, EMBED : 2 * EMBED] /= np.maximum(1, norm / 3)  # one word over and over isn't louder than prose
    for i, b in enumerate(found):
        out[i, :EMBED] = _path_vector(b.path)

    def share(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask)])
        return (run[off[1:]] - run[off[:-1]]) / np.maximum(size, 1)

    shape = out[:, 2 * EMBED :]
    shape[:, 0] = np.log1p(size) / 3 - 1
    shape[:, 1] = np.log1p(count) / 2 - 1
    shape[:, 2] = 2 * np.minimum(1, np.array([b.linked for b in found]) / np.maximum(size, 1))
    shape[:, 3] = 20 * share((data == 44) | (data == 46) | (data == 59))
    shape[:, 4] = 4 * share((data >= 65) & (data <= 90))
    shape[:, 5] = 4 * share((data >= 48) & (data <= 57))
    shape[:, 6] = np.arange(n) / n
    shape[:, 7] = size / max(1, size.max())
    return out


class Labeller:
    """A bidirectional LSTM with a logistic output for every step."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, 0.25, (WIDTH + HIDDEN, 4 * HIDDEN)) for _ in range(2)]
        self.b = [np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]) for _ in range(2)]
        self.out, self.bias = rng.normal(0, 0.25, 2 * HIDDEN), np.zeros(1)

    def params(self) -> list[np.ndarray]:
        return [*self.w, *self.b, self.out, self.bias]

    def _run(self, d: int, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        steps, rows, _ = x.shape
        h, c = np.zeros((rows, HIDDEN)), np.zeros((rows, HIDDEN))
        out = np.zeros((steps, rows, HIDDEN))
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            z = np.concatenate([x[t], h], 1) @ self.w[d] + self.b[d]
            gate = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            h2 = o * tc
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            h, c = m * h2 + (1 - m) * h, m * c2 + (1 - m) * c
            out[t] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(steps, rows) probabilities for (steps, rows, WIDTH) vectors."""
        kept = [[] if keep is not None else None for _ in range(2)]
        h = np.concatenate([self._run(d, x, mask, kept[d]) for d in range(2)], 2)
        if keep is not None:
            keep += [*kept, h]
        return sigmoid(h @ self.out + self.bias[0])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        keep: list = []
        p = self.forward(x, mask, keep)
        n = mask.sum()
        loss = -float((mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n)
        dz = mask * (p - y) / n
        h = keep[2]
        gw, gb = [], []
        for d in range(2):
            dout = dz[:, :, None] * self.out[d * HIDDEN : (d + 1) * HIDDEN]
            w, b = np.zeros_like(self.w[d]), np.zeros_like(self.b[d])
            dh, dc = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
            for t, h0, c0, i, f, o, g, tc, m in reversed(keep[d]):
                dh = dh + dout[t]
                a, e = m * dh, m * dc
                e = e + a * o * (1 - tc * tc)
                z = np.concatenate([e * g * i * (1 - i), e * c0 * f * (1 - f), a * tc * o * (1 - o), e * i * (1 - g * g)], 1)
                w += np.concatenate([x[t], h0], 1).T @ z
                b += z.sum(0)
                dh = (1 - m) * dh + (z @ self.w[d].T)[:, WIDTH:]
                dc = (1 - m) * dc + e * f
            gw.append(w)
            gb.append(b)
        return loss, [*gw, *gb, np.einsum("tr,trh->h", dz, h), np.array([dz.sum()])]

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 32, rate: float = 0.02, seed: int = SEED) -> Labeller:
        """Adam on (vectors, labels) pages, with a rate that falls to a twentieth."""
        rng = np.random.default_rng(seed)
        params = self.params()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, steps = 0, epochs * -(-len(pages) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for a in range(0, len(order), batch):
                own = [pages[i] for i in order[a : a + batch]]
                x, mask = _stack([v for v, _ in own])
                y = np.zeros(mask.shape)
                for r, (_, label) in enumerate(own):
                    y[: len(label), r] = label
                _, grads = self.gradients(x, mask, y)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
                step += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    g = g * min(1, 1 / (norm + 1e-9))
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (1 - 0.95 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probabilities of every block of every page; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 256 and len(pages[order[end]]) <= 1.2 * len(pages[order[at]]) + 2 and (end - at) * len(pages[order[end]]) < 40_000:
                end += 1
            own = order[at:end]
            p = self.forward(*_stack([pages[i] for i in own]))
            for r, i in enumerate(own):
                out[i] = p[: len(pages[i]), r]
            at = end
        return out


def _stack(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), WIDTH)), np.zeros((steps, len(pages)))
    for r, v in enumerate(pages):
        x[: len(v), r] = v
        mask[: len(v), r] = 1
    return x, mask


def _word(rng: random.Random) -> str:
    letters = rng.choice(("etaoinshrdlucmfwypvbgk", "aeiouéèàçlrnst", "eniriastdhulcgßüöä", "aeosrnidlctumpbñóí"))
    return "".join(rng.choice(letters) for _ in range(max(1, int(rng.gammavariate(3, 1.7)))))


def _phrase(rng: random.Random, low: int, high: int) -> str:
    return " ".join(_word(rng) for _ in range(rng.randint(low, high)))


def _sentence(rng: random.Random, low: int = 1, high: int = 26, noise: float = 0.04) -> str:
    words = [_word(rng) for _ in range(rng.randint(low, high))]
    for i in range(len(words)):
        r = rng.random()
        if r < noise:
            words[i] += "".join(rng.choice("!?#$%*+=~^@|") for _ in range(rng.randint(1, 3)))
        elif r < noise + 0.05:
            words[i] += rng.choice(",,,;:")
        elif r < noise + 0.07:
            words[i] = str(rng.randint(1, 3000))
    return " ".join([words[0].capitalize(), *words[1:]]) + rng.choice("....!?")


#: Words of classes and ids by which sites name what isn't the text, and what is; none of them is always there.
_CHROME_MARKS = "nav menu topbar masthead header navbar links crumbs breadcrumb sidebar widget rail ad ads advert sponsor sponsored promo banner teaser related more share social comments reply footer legal bottom cookie notice newsletter signup login search pager tags meta".split()
_TEXT_MARKS = "content main article post entry story body text copy page prose document column center inner wrap".split()


def generated_page(rng: random.Random) -> tuple[str, list[tuple[str, int]]]:
    """(html, (text, label) of every block in order) of a made-up page."""
    truth: list[tuple[str, int]] = []
    noise = rng.choice((0.0, 0.02, 0.02, 0.5))

    def say(text: str, label: int) -> str:
        truth.append((" ".join(text.split()), label))
        return entities.escape(text, quote=False)

    def mark(words: list[str], often: float = 0.7) -> str:
        if rng.random() > often:
            return ""
        return f' {rng.choice(("class", "class", "id", "role"))}="{" ".join(rng.sample(words, rng.randint(1, 2)))}"'

    def inside(body: str, words: list[str], tags: tuple[str, ...], often: float = 0.7) -> str:
        for _ in range(rng.randint(1, 2)):
            tag = rng.choice(tags)
            body = f"<{tag}{mark(words, often)}>{body}</{tag}>"
        return body

    def link(text: str) -> str:
        return f'<a href="/{_word(rng)}">{text}</a>'

    def menu() -> str:
        items = [say(rng.choice((_word(rng), _word(rng).capitalize(), _phrase(rng, 1, 3), _word(rng) + rng.choice(".,"))), 0) for _ in range(rng.randint(2, 12))]
        item = rng.choice(("li", "li", "div", "td", "p", "dd"))
        rows = "".join(f"<{item}>{link(x)}</{item}>" for x in items)
        return {"li": f"<ul>{rows}</ul>", "td": f"<table><tr>{rows}</tr></table>", "dd": f"<dl>{rows}</dl>"}.get(item, rows)

    def notice(tag: str = "") -> str:
        text = say(_sentence(rng, 1, 22) if rng.random() < 0.7 else _phrase(rng, 1, 6), 0)
        text = link(text) if rng.random() < 0.3 else text
        tag = tag or rng.choice(("p", "span", "div", "h3", ""))
        return f"<{tag}>{text}</{tag}>" if tag else text

    def legal() -> str:
        return f"<{(t := rng.choice(('p', 'small', 'span', 'div')))}>{say(rng.choice(('© ', '(c) ', '™ ', '')) + _sentence(rng, 2, 16), 0)}</{t}>"

    def chrome(first: bool, last: bool) -> str:
        kinds = [menu, notice, lambda: "".join(notice() + menu() for _ in range(1)), lambda: "".join(notice("h4") + notice("p") for _ in range(rng.randint(1, 4)))]
        body = rng.choice([menu, menu, notice] if first else [legal, legal, menu, notice] if last else kinds)()
        tags = ("nav", "header", "div", "div", "section", "ul") if first else ("footer", "footer", "div", "section") if last else ("aside", "aside", "div", "div", "section", "nav", "form")
        often = 1.0 if not first and not last else 0.6
        return inside(body, _CHROME_MARKS, tags, often)

    heading = _phrase(rng, 1, 10).capitalize() if rng.random() < 0.7 else _sentence(rng, 1, 10, noise)

    def prose() -> str:
        out = []
        if rng.random() < 0.85:
            level = rng.choice(("h1", "h1", "h1", "h2", "header"))
            out.append(f"<{level}>{say(heading, 1)}</{level}>")
        plain = rng.choice(("p", "p", "p", "div"))
        many = rng.choice((rng.randint(1, 3), rng.randint(1, 8), rng.randint(4, 25)))
        for at in range(many):
            kind = rng.random()
            if at == 0 and rng.random() < 0.2:
                text = heading  # the lead says the title again
            elif kind < 0.25:
                text = _sentence(rng, 1, 6, noise)
            else:
                text = " ".join(_sentence(rng, 1, 26, noise) for _ in range(rng.randint(1, 9)))
            if kind > 0.93:
                item = rng.choice(("li", "li", "td", "dd"))
                rows = "".join(f"<{item}>{say(_sentence(rng, 1, 14, noise) if rng.random() < 0.7 else _phrase(rng, 1, 3), 1)}</{item}>" for _ in range(rng.randint(1, 5)))
                out.append({"li": f"<{(l := rng.choice(('ul', 'ol')))}>{rows}</{l}>", "td": f"<table><tr>{rows}</tr></table>", "dd": f"<dl>{rows}</dl>"}[item])
                continue
            tag = plain if kind < 0.85 else rng.choice(("h2", "h3", "blockquote", "pre", "figcaption"))
            if tag[0] == "h":
                text = _phrase(rng, 1, 6)
            own = say(text, 1)
            if rng.random() < 0.25:
                cut = own.split(" ")
                k = rng.randrange(len(cut))
                if "&" not in cut[k]:
                    cut[k] = rng.choice(("<b>{}</b>", "<em>{}</em>", '<a href="#">{}</a>', "<code>{}</code>")).format(cut[k])
                own = " ".join(cut)
            out.append(f"<{tag}>{own}" + ("" if tag == "p" and rng.random() < 0.2 else f"</{tag}>"))
            if rng.random() < 0.03:
                out.append(inside(notice(), _CHROME_MARKS, ("aside", "div"), 1.0))
        return "".join(out)

    head = rng.choice(("<html><head>", "<!doctype html>\n<html>\n<head>", '<html class="no-js"><head><link rel="icon" href="i.png">'))
    title = heading if rng.random() < 0.4 else heading[: rng.randint(3, 60)].strip() if rng.random() < 0.4 else _phrase(rng, 1, 8)
    page = [head, f"<title>{say(title or 'x', 0)}</title>" if rng.random() < 0.9 else "", "</head><body>"]
    for k in range(before := rng.choice((0, 1, 1, 2, 2, 3))):
        page.append(chrome(k == 0, False))
    holder = rng.choice((("article",), ("article",), ("main",), ("main", "article"), ("div", "article"), ("div", "div"), ("section", "div"), ("td",), ()))
    body = prose()
    for tag in holder:
        body = f"<{tag}{mark(_TEXT_MARKS, 0.4 if tag in ('article', 'main') else 0.85)}>{body}</{tag}>"
    page.append(body)
    for k in range(after := rng.choice((0, 1, 1, 2, 3))):
        page.append(chrome(False, k == after - 1))
    page.append("</body></html>")
    del before
    return "".join(page), truth


def training_pages(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        page, truth = generated_page(rng)
        found = blocks(page)
        if [b.text for b in found] == [t for t, _ in truth]:
            out.append((vectors(found), np.array([y for _, y in truth], float)))
    return out


@functools.cache
def trained(pages: int = 1200, seed: int = SEED) -> Labeller:
    return Labeller(seed).fit(training_pages(pages, seed))


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(page_id, url, n_blocks, n_kept, text) of every page; kept blocks are the lines of the text."""
    labeller = model or trained()
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), 512):
                b = whole.slice(begin, 512)
                found = [blocks(h) if h is not None else [] for h in b["html"].to_pylist()]
                kept = [[x.text for x, p in zip(f, probability, strict=True) if p >= KEEP_FROM] for f, probability in zip(found, labeller.label([vectors(f) for f in found]), strict=True)]
                null = b["html"].is_null().to_numpy(zero_copy_only=False)
                text = pa.array([None if n else "\n".join(k) for k, n in zip(kept, null, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array([len(f) for f in found], pa.int32()), pa.array([len(k) for k in kept], pa.int32()), text], names=["page_id", "url", "n_blocks", "n_kept", "text"])

    return need(pages, "page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, n_blocks int, n_kept int, text string")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
