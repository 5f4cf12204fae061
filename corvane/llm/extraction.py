"""Main text of web pages by a recurrent labeller of blocks.

A page becomes its sequence of leaf blocks: runs of text between tags that aren't inline, with character
references decoded and white space joined, in page order. What never shows as text (scripts, styles,
titles, comments, drawings, choices of forms) is left out while reading. Each block is a vector: its
tag path (sums of vectors of hashed tags, classes, ids and roles, over all ancestors and for its own element),
the mean of the vectors of its hashed words, and its length, share of links and last character. A bidirectional LSTM in
numpy reads the whole sequence and gives every block a probability; those of one half or more are the
main text, joined by line breaks.

The labeller is trained on the driver before each run, from about TRAIN_PAGES pages of the
input (twice as many at most; spread over the whole table by hash; of each at most TRAIN_BLOCKS blocks and TRAIN_WORDS words a
block). Their words fill drawn layouts, whose blocks are known to be article or not: containers with and without
telling names, menus, headers, footers, sidebars, notices, adverts, forms, comments of readers, in
and around the article, with tags left open. Beside them stand the sampled pages themselves where they mark
an article by its tag. All draws are seeded by number and the sample is sorted, so equal inputs give equal models.

Labelling is one map-only pass over the pages: no shuffle, a broadcast of some hundred kilobytes, pages of
like length in one batch, and of a very long page only CHUNK blocks at a time. A lost executor costs the
tasks it held.

Cases: null or empty html, or a page without text, has an empty text; white space is what
Python's str.split takes for it; a line break tag is white space; a tag that never ends swallows the rest, as in
browsers; other tags may stay open or be closed twice; repeated rows get equal results; a null
id or url stays; with no page to learn from the drawn layouts use stand-in words; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import common

TRAIN_PAGES, TRAIN_BLOCKS, TRAIN_WORDS = 400, 64, 200
#: Buckets of hashed path tokens and words; sizes of their vectors; units a direction; steps, pages a step, rate.
TOKENS, WORDS, PATH, WORD, UNITS = 1 << 13, 1 << 10, 16, 8, 16
STEPS, PAGES, RATE = 400, 16, 0.01
#: Blocks that are read at a time: of one page, and of a batch of pages with what fills them up.
CHUNK, SLOTS = 1 << 15, 1 << 16

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes")}
_MUTED = frozenset("svg math template object canvas audio video select datalist".split())
_CELL, _ITEM = frozenset(("td", "th", "p")), frozenset(("li", "p"))
#: What a start tag closes if it stands open right above it.
_CLOSES = {"li": _ITEM, "td": _CELL, "th": _CELL, "tr": _CELL | {"tr"}, "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p"))}
_P = frozenset(("p",))


def element_tokens(tag: str, said: str) -> list[str]:
    """What names an element: its tag, and the words of its class, id and role with their first and last letters."""
    out = [f"<{tag}"]
    for m in _NAMED.finditer(said) if said else ():
        for word in _PARTS.findall(m[2] or m[3] or m[4] or ""):
            w = word.lower()
            out.append(w)
            if len(w) > 4:
                out += (f"{w[:4]}-", f"-{w[-4:]}")
    return out


class Paths:
    """Tag paths as nodes of a tree: parent and tokens of each."""

    def __init__(self):
        self.parent, self.tokens, self.known = [0], [[]], {}

    def node(self, parent: int, tag: str, said: str) -> int:
        key = (parent, tag, said)
        if (got := self.known.get(key)) is None:
            got = self.known[key] = len(self.parent)
            self.parent.append(parent)
            self.tokens.append([crc32(t.encode()) % TOKENS for t in element_tokens(tag, said)])
        return got


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def leaves(page: str, paths: Paths) -> list[tuple[int, str, int]]:
    """The blocks of a page: node, text, characters inside links."""
    out, parts, stack, here, links, linked, at = [], [], [], 0, 0, 0, 0
    opened: dict[str, int] = {}

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and here >= 0:
                out.append((here, text, min(linked, len(text))))
            parts, linked = [], 0

    def take(text):
        nonlocal linked
        if text and here >= 0:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text)

    def pop():
        nonlocal here
        tag, here = stack.pop()
        opened[tag] -= 1

    while (a := page.find("<", at)) >= 0:
        follows = page[a + 1 : a + 2]
        if follows == "!" or follows == "?" or (follows == "/" and not _letter(page[a + 2 : a + 3])):
            take(page[at:a])
            if page.startswith("<!--", a):
                b = a + 4 if page.startswith(">", a + 4) else page.find("-->", a + 4)
                at = len(page) if b < 0 else b + (1 if b == a + 4 and page[b] == ">" else 3)
            else:
                b = page.find(">", a)
                at = len(page) if b < 0 else b + 1
            continue
        if follows != "/" and not _letter(follows):
            take(page[at : a + 1])
            at = a + 1
            continue
        take(page[at:a])
        m = _TAG.match(page, a)
        if m is None:  # it never ends
            at = len(page)
            break
        at, tag = m.end(), m[2].lower()
        if tag in _INLINE:
            if tag == "a":
                links = 0 if m[1] else 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        links = 0
        if m[1]:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _RAW:
            b = _RAW[tag].search(page, at)
            at = b.start() if b else len(page)
            continue
        if tag in _VOID:
            continue
        closes = _CLOSES.get(tag, _P)
        while stack and stack[-1][0] in closes:
            pop()
        stack.append((tag, here))
        opened[tag] = opened.get(tag, 0) + 1
        here = -1 if here < 0 or tag in _MUTED else paths.node(here, tag, m[3])
    take(page[at:])
    flush()
    return out


class Blocks:
    """The blocks of several pages as arrays; ends tells where each page's blocks end."""

    def __init__(self, paths: Paths, pages: list[list[tuple[int, str, int]]], words: dict[str, int]):
        self.paths, flat = paths, [b for p in pages for b in p]
        self.ends = np.cumsum([len(p) for p in pages], dtype=np.int64)
        self.node = np.array([b[0] for b in flat], np.int64)
        if len(words) > 500_000:
            words.clear()
        ids, sizes = [], []
        for _, text, _ in flat:
            said = text.lower().split(" ")
            sizes.append(len(said))
            for w in said:
                if (k := words.get(w)) is None:
                    k = words[w] = crc32(w.encode("utf-8", "replace")) % WORDS
                ids.append(k)
        self.words, self.word_ends = np.array(ids, np.int32), np.cumsum(np.array(sizes, np.int64))
        chars = np.array([len(b[1]) for b in flat], np.float32)
        last = np.array([b[1][-1] in ".!?\"'”»" for b in flat], np.float32)
        self.plain = np.stack([np.log1p(np.array(sizes, np.float32)) / 4, np.log1p(chars) / 6, np.array([b[2] for b in flat], np.float32) / np.maximum(chars, 1), last], 1) if flat else np.zeros((0, 4), np.float32)


def _path_vectors(table: np.ndarray, paths: Paths) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each node's own element, and the sum over its path."""
    own = np.stack([table[t].sum(0) if t else np.zeros(PATH, np.float32) for t in paths.tokens])
    whole = own.copy()
    for k in range(1, len(whole)):  # a parent comes before its children
        whole[k] += whole[paths.parent[k]]
    return own, whole


def _inputs(model: dict, blocks: Blocks, own: np.ndarray, whole: np.ndarray, a: int, b: int) -> np.ndarray:
    """Vectors of the blocks from a to b."""
    first = blocks.word_ends[a - 1] if a else 0
    ends = blocks.word_ends[a:b] - first
    starts = np.append(0, ends[:-1])
    means = np.add.reduceat(model["words"][blocks.words[first : first + ends[-1]]], starts, axis=0) / (ends - starts)[:, None]
    node = blocks.node[a:b]
    return np.concatenate([whole[node], own[node], means, blocks.plain[a:b]], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _cell(model: dict, way: str, z: np.ndarray, c: np.ndarray) -> tuple:
    """One step of a direction from its summed inputs."""
    u = UNITS
    gates = _sigmoid(z[:, : 3 * u])
    new = np.tanh(z[:, 3 * u :])
    c_new = gates[:, u : 2 * u] * c + gates[:, :u] * new
    t = np.tanh(c_new)
    return gates, new, c_new, t, gates[:, 2 * u :] * t


def _probabilities(model: dict, blocks: Blocks) -> np.ndarray:
    """The probability of every block of every page."""
    own, whole = _path_vectors(model["tokens"], blocks.paths)
    starts = np.append(0, blocks.ends[:-1])
    sizes = blocks.ends - starts
    logit = np.full(len(blocks.node), model["bias"][0], np.float32)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and sizes[order[j]] * (j + 1 - i) <= SLOTS:
            j += 1
        group = order[i:j]
        i, n = j, int(sizes[group[-1]])
        for way in ("f", "b"):
            h = c = np.zeros((len(group), UNITS), np.float32)
            for p in range(0, n, CHUNK):
                steps = min(CHUNK, n - p)
                # the forward direction reads block p + t, the other one its mirror image from the end
                spans = [(p, min(p + steps, size)) if way == "f" else (max(size - p - steps, 0), max(size - p, 0)) for size in sizes[group].tolist()]
                x = np.zeros((steps, len(group), 4 * UNITS), np.float32)
                for k, (g, (a, b)) in enumerate(zip(group.tolist(), spans, strict=True)):
                    if b > a:
                        got = _inputs(model, blocks, own, whole, starts[g] + a, starts[g] + b) @ model[f"{way}x"]
                        x[: b - a, k] = got if way == "f" else got[::-1]
                out = np.zeros((steps, len(group)), np.float32)
                for t in range(steps):
                    _, _, c, _, h = _cell(model, way, x[t] + h @ model[f"{way}h"] + model[f"{way}b"], c)
                    out[t] = h @ model[f"{way}o"]
                for k, (g, (a, b)) in enumerate(zip(group.tolist(), spans, strict=True)):
                    if b > a:
                        logit[starts[g] + a : starts[g] + b] += out[: b - a, k] if way == "f" else out[: b - a, k][::-1]
    return _sigmoid(logit)


def _fresh(rng: np.random.Generator) -> dict:
    size = 2 * PATH + WORD + 4
    model = {"tokens": rng.normal(0, 0.05, (TOKENS, PATH)), "words": rng.normal(0, 0.05, (WORDS, WORD)), "bias": np.zeros(1)}
    for way in "fb":
        model |= {f"{way}x": rng.normal(0, size**-0.5, (size, 4 * UNITS)), f"{way}h": rng.normal(0, UNITS**-0.5, (UNITS, 4 * UNITS)), f"{way}b": np.repeat([0.0, 1.0, 0.0, 0.0], UNITS), f"{way}o": rng.normal(0, UNITS**-0.5, UNITS)}
    return {k: v.astype(np.float32) for k, v in model.items()}


def _gradients(model: dict, blocks: Blocks, labels: np.ndarray) -> dict:
    """Gradients of the mean log loss over a batch of pages, by steps back through time."""
    own, whole = _path_vectors(model["tokens"], blocks.paths)
    starts = np.append(0, blocks.ends[:-1])
    sizes = blocks.ends - starts
    n, m = int(sizes.max()), len(sizes)
    flat = _inputs(model, blocks, own, whole, 0, len(blocks.node))
    row, col = np.repeat(np.arange(m), sizes), np.arange(len(flat)) - np.repeat(starts, sizes)
    kept, logit = {}, np.full(len(flat), model["bias"][0], np.float32)
    for way in "fb":
        place = col if way == "f" else np.repeat(sizes, sizes) - 1 - col
        x = np.zeros((n, m, flat.shape[1]), np.float32)
        x[place, row] = flat
        h = c = np.zeros((m, UNITS), np.float32)
        steps = []
        for t in range(n):
            gates, new, c_new, squashed, h_new = _cell(model, way, x[t] @ model[f"{way}x"] + h @ model[f"{way}h"] + model[f"{way}b"], c)
            steps.append((h, c, gates, new, squashed, h_new))
            h, c = h_new, c_new
        out = np.stack([s[5] for s in steps])
        logit += out[place, row] @ model[f"{way}o"]
        kept[way] = (place, x, steps, out)
    d = (_sigmoid(logit) - labels) / len(flat)
    grad = {"bias": np.array([d.sum()], np.float32)}
    d_flat = np.zeros_like(flat)
    for way, (place, x, steps, out) in kept.items():
        grad[f"{way}o"] = out[place, row].T @ d
        above = np.zeros((n, m, UNITS), np.float32)
        above[place, row] = d[:, None] * model[f"{way}o"]
        dz_all = np.zeros((n, m, 4 * UNITS), np.float32)
        dh, dc = np.zeros((m, UNITS), np.float32), np.zeros((m, UNITS), np.float32)
        u = UNITS
        for t in range(n - 1, -1, -1):
            h, c, gates, new, squashed, _ = steps[t]
            dh = dh + above[t]
            i, f, o = gates[:, :u], gates[:, u : 2 * u], gates[:, 2 * u :]
            dc = dc + dh * o * (1 - squashed**2)
            dz = dz_all[t]
            dz[:, :u], dz[:, u : 2 * u] = dc * new * i * (1 - i), dc * c * f * (1 - f)
            dz[:, 2 * u : 3 * u], dz[:, 3 * u :] = dh * squashed * o * (1 - o), dc * i * (1 - new**2)
            dh, dc = dz @ model[f"{way}h"].T, dc * f
        before = np.stack([s[0] for s in steps])
        grad[f"{way}h"] = np.tensordot(before, dz_all, ((0, 1), (0, 1)))
        grad[f"{way}x"] = np.tensordot(x, dz_all, ((0, 1), (0, 1)))
        grad[f"{way}b"] = dz_all.sum((0, 1))
        d_flat += dz_all[place, row] @ model[f"{way}x"].T
    d_own, d_whole = np.zeros_like(own), np.zeros_like(whole)
    np.add.at(d_whole, blocks.node, d_flat[:, :PATH])
    np.add.at(d_own, blocks.node, d_flat[:, PATH : 2 * PATH])
    for k in range(len(whole) - 1, 0, -1):
        d_whole[blocks.paths.parent[k]] += d_whole[k]
    d_own += d_whole
    grad["tokens"] = np.zeros_like(model["tokens"])
    for k, t in enumerate(blocks.paths.tokens):
        np.add.at(grad["tokens"], t, d_own[k])
    counts = np.diff(np.append(0, blocks.word_ends))
    grad["words"] = np.zeros_like(model["words"])
    np.add.at(grad["words"], blocks.words, np.repeat(d_flat[:, 2 * PATH : 2 * PATH + WORD] / counts[:, None], counts, axis=0))
    return grad


#: Names of parts, with which drawn layouts call them (fixed values).
_NAMES = {
    "article": "article content post entry story main body text page blog news detail single copy",
    "menu": "nav menu navigation navbar topnav breadcrumb breadcrumbs tabs links sitemap toolbar pagination pager",
    "header": "header masthead banner top brand logo branding site-header page-header topbar",
    "footer": "footer foot bottom copyright legal site-footer colophon imprint",
    "sidebar": "sidebar aside side widget widgets rail left-column right-column secondary related recommended popular trending more-stories teaser",
    "notice": "cookie cookies notice consent gdpr banner alert popup modal overlay message warning subscribe paywall privacy",
    "advert": "ad ads advert advertisement adbox sponsor sponsored promo promotion banner-ad commercial partner",
    "form": "form search newsletter signup login contact subscribe-form search-form",
    "comments": "comments comment comment-list commentlist respond reply replies discussion thread disqus reader-comments responses",
    "share": "share social sharing follow tags tag-list byline meta author print tools",
}
_SEMANTIC = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}
_MAIN, _REST = "\ue000", "\ue001"


class _Layouts:
    """Pages drawn from words, each block's text marked as main or not."""

    def __init__(self, words: list[str], rng: random.Random):
        self.words, self.rng = words or ["the", "of", "and", "word", "text", "more"], rng

    def said(self, low: int, high: int) -> str:
        r = self.rng
        words = [r.choice(self.words) for _ in range(min(r.randint(low, high), TRAIN_WORDS))]
        return " ".join(words).capitalize() + r.choice(["", ".", ".", ".", "!", "?"])

    def named(self, part: str, tag: str) -> str:
        r, names = self.rng, _NAMES[part].split()
        name = r.choice(names) + r.choice(["", "", "", f"-{r.choice(['box', 'area', 'wrap', 'wrapper', 'section', 'inner', 'block', 'main'])}", str(r.randint(1, 9))])
        how = r.random()
        return f"<{tag} class=\"{name}\">" if how < 0.6 else f"<{tag} id='{name}'>" if how < 0.85 else f'<{tag} id="{name}" class="{r.choice(names)} c{r.randint(0, 99)}">'

    def paragraph(self, mark: str, low: int, high: int) -> str:
        r, text = self.rng, mark + self.said(low, high)
        kind = r.random()
        if kind < 0.1:
            return f"<p><b>{text}<br>"
        if kind < 0.2:
            words = text.split(" ")
            k = r.randrange(len(words))
            words[k] = f'<a href="/x">{words[k]}</a>' if k else words[k]
            return f"<p>{' '.join(words)}</p>"
        return f"<p>{text}</p>" if kind < 0.9 else f"<div>{text}</div>"

    def items(self, mark: str, linked: bool, most: int = 8) -> str:
        r = self.rng
        one = (lambda: f'<a href="/{r.randint(0, 99)}">{mark}{self.said(1, 3)}</a>') if linked else (lambda: f"{mark}{self.said(1, 25)}")
        return f"<ul>{''.join(f'<li>{one()}</li>' for _ in range(r.randint(1, most)))}</ul>"

    def part(self, kind: str) -> str:
        """A part of a page that isn't article."""
        r = self.rng
        tag = _SEMANTIC[kind] if kind in _SEMANTIC and r.random() < 0.6 else r.choice(["div", "div", "section"])
        opening = f"<{tag}>" if tag == _SEMANTIC.get(kind) and r.random() < 0.6 else self.named(kind, tag)
        if kind == "menu":
            inner = self.items(_REST, True, 9) if r.random() < 0.8 else "".join(f'<div><a href="/">{_REST}{self.said(1, 2)}</a></div>' for _ in range(r.randint(1, 6)))
        elif kind == "form":
            inner = f"<label>{_REST}{self.said(1, 5)}</label><input name='q'>{r.choice(['', '<p>' + _REST + self.said(2, 20) + '</p>'])}<button>{_REST}{self.said(1, 2)}</button>"
        elif kind == "comments":
            inner = (f"<h{r.randint(2, 4)}>{_REST}{self.said(1, 4)}</h3>" if r.random() < 0.5 else "") + "".join(r.choice(["<div class='comment'>{}</div>", "<li>{}</li>", "{}", "<article>{}</article>"]).format(("<b>" if r.random() < 0.5 else "<cite>") + f"{_REST}{self.said(1, 2)}</b></cite>" * (r.random() < 0.5) + self.paragraph(_REST, 1, 80)) for _ in range(r.randint(1, 6)))
        elif kind == "sidebar":
            inner = f"<h3>{_REST}{self.said(1, 4)}</h3>" + (self.items(_REST, r.random() < 0.7) if r.random() < 0.6 else "".join(self.paragraph(_REST, 1, 60) for _ in range(r.randint(1, 3))))
        elif kind == "share":
            inner = f"{_REST}{self.said(1, 3)} <span>{self.said(1, 3)}</span>" if r.random() < 0.5 else self.items(_REST, True, 4)
        elif kind == "header":
            inner = r.choice([f"<h1>{_REST}{self.said(1, 6)}</h1>", f"<div>{_REST}{self.said(1, 8)}</div>", f"<p>{_REST}{self.said(1, 12)}</p>{self.items(_REST, True, 5)}", f"{_REST}{self.said(1, 15)}"])
        else:
            inner = r.choice([f"{_REST}{self.said(1, 30)}", self.paragraph(_REST, 1, 50), f"<h4>{_REST}{self.said(1, 4)}</h4>{self.paragraph(_REST, 2, 60)}", f"{_REST}&copy; {self.said(2, 12)}"])
        return f"{opening}{inner}</{tag}>"

    def article(self) -> str:
        r = self.rng
        out = [f"<h{r.choice([1, 1, 1, 2])}>{_MAIN}{self.said(1, 12)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.8:
                out.append(self.paragraph(_MAIN, 1, r.choice([3, 30, 150])))
            elif kind < 0.86:
                out.append(f"<h{r.randint(2, 4)}>{_MAIN}{self.said(1, 8)}</h2>")
            elif kind < 0.9:
                out.append(self.items(_MAIN, False, 5))
            elif kind < 0.93:
                out.append(f"<blockquote>{self.paragraph(_MAIN, 3, 40)}</blockquote>")
            elif kind < 0.95:
                out.append(f"<table><tr>{''.join(f'<td>{_MAIN}{self.said(1, 4)}' for _ in range(r.randint(1, 4)))}</table>")
            elif kind < 0.97:
                out.append(f"<figure><img src='x'><figcaption>{_MAIN}{self.said(1, 15)}</figcaption></figure>")
            else:
                out.append(self.part(r.choice(["advert", "sidebar", "share", "form", "notice"])))
        body = "".join(out)
        if r.random() < 0.08:
            return body
        how = r.random()
        tag = "article" if how < 0.35 else "main" if how < 0.5 else "div" if how < 0.85 else "section"
        opening = f"<{tag}>" if tag in ("article", "main") and r.random() < 0.6 else self.named("article", tag) if r.random() < 0.9 else f"<{tag}>"
        if r.random() < 0.2:
            opening, body = opening + self.named("article", "div"), body + "</div>"
        return f"{opening}{body}</{tag}>"

    def page(self) -> str:
        r = self.rng
        if r.random() < 0.06:  # nothing but an article, or but its text
            alone = self.article() if r.random() < 0.5 else f"{_MAIN}{self.said(1, 60)}"
            return r.choice(["{}", "<div>{}</div>", "<body>{}", "<html><body>{}</body></html>"]).format(alone)
        draw = lambda kinds, most: [self.part(r.choice(kinds)) for _ in range(r.randint(0, most))]
        before = draw(["menu", "menu", "header", "notice", "advert", "form", "sidebar", "share"], 5)
        after = draw(["comments", "sidebar", "footer", "footer", "advert", "share", "menu", "form", "notice"], 5)
        middle = "".join(before) + self.article() + "".join(after)
        if r.random() < 0.4:
            middle = f"<div {r.choice(['class', 'id'])}=\"{r.choice(['wrapper', 'container', 'page', 'layout', 'row', 'site'])}\">{middle}"
        return r.choice(["<html><head><title>x</title></head><body>", "<html><body>", "<body>", ""]) + middle + r.choice(["</body></html>", ""])


def _marked(page: str, paths: Paths) -> tuple[list, np.ndarray]:
    """The blocks of a drawn page without their marks, and their labels."""
    found = [b for b in leaves(page, paths) if b[1].strip(_MAIN + _REST + " ")]
    labels = np.array([_MAIN in b[1] for b in found], np.float32)
    return [(n, t.replace(_MAIN, "").replace(_REST, ""), k) for n, t, k in found], labels


def sample(pages: DataFrame) -> list[dict]:
    """At most TRAIN_PAGES pages, spread by hash: of each block its path's tags, opening text, words and links."""
    n = pages.count()
    share = max(1, -(-n // TRAIN_PAGES))
    picked = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(share)) == 0).select("page_id", F.col("html").cast("string").alias("html"))

    def run(batches):
        for batch in common.slices(batches, "html"):
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                paths = _Kept()
                found = leaves(page or "", paths)[:TRAIN_BLOCKS]
                if found:
                    yield pa.RecordBatch.from_pydict({"key": [str(key)], "steps": [[paths.said(b[0]) for b in found]], "texts": [[" ".join(b[1].split(" ")[:TRAIN_WORDS]) for b in found]], "links": pa.array([[b[2] for b in found]], pa.list_(pa.int32()))})

    rows = picked.mapInArrow(run, "key string, steps array<array<string>>, texts array<string>, links array<int>").limit(2 * TRAIN_PAGES).collect()
    return sorted((r.asDict() for r in rows), key=lambda r: (r["key"], r["texts"]))


class _Kept(Paths):
    """Paths that remember the start tags of their nodes."""

    def __init__(self):
        super().__init__()
        self.own = [""]

    def node(self, parent, tag, said):
        got = super().node(parent, tag, said)
        if got == len(self.own):
            self.own.append(f"<{tag}{said[:200]}>")
        return got

    def said(self, node: int) -> list[str]:
        """The start tags of a path, outermost first; of a very deep one the innermost."""
        out = []
        while node and len(out) < 32:
            out.append(self.own[node])
            node = self.parent[node]
        return out[::-1]


def _batch(drawn: list[tuple[list, np.ndarray]], paths: Paths, words: dict) -> tuple[Blocks, np.ndarray]:
    drawn = [d for d in drawn if d[0]]
    return Blocks(paths, [d[0] for d in drawn], words), np.concatenate([d[1] for d in drawn])


def fit(rows: list[dict], steps: int = STEPS, seed: int = 11) -> dict:
    """The labeller's parameters, learnt from drawn layouts of the sampled words and from sampled pages that mark an article."""
    rng, drawing = random.Random(seed), np.random.default_rng(seed)
    pool = [w for r in rows for t in r["texts"] for w in t.split(" ")]
    layouts, model = _Layouts(sorted(rng.sample(pool, min(len(pool), 20_000))), rng), _fresh(drawing)
    inside = lambda path: any(s.startswith("<article") for s in path)
    outside = lambda path: any(re.match(r"<(?:nav|footer|aside|form)\b", s) for s in path)
    marked = [r for r in rows if any(map(inside, r["steps"]))]
    first, second, words = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, {}
    for step in range(1, steps + 1):
        paths = Paths()
        drawn = [_marked(layouts.page(), paths) for _ in range(PAGES - PAGES // 4)]
        for r in rng.sample(marked, min(len(marked), PAGES // 4)):
            blocks = []
            for path, text, links in zip(r["steps"], r["texts"], r["links"], strict=True):
                node = 0
                for s in path:
                    m = _TAG.match(s) or _TAG.match(s + '">') or _TAG.match("<div>")
                    node = paths.node(node, m[2].lower(), m[3])
                blocks.append((node, text, min(links, len(text))))
            drawn.append((blocks, np.array([inside(p) and not outside(p) for p in r["steps"]], np.float32)))
        grad = _gradients(model, *_batch(drawn, paths, words))
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = RATE * (1 - step / (steps + 1)) ** 0.5
        for k, g in grad.items():
            g = g / max(size, 1.0)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def texts(pages: list[str], model: dict, words: dict[str, int]) -> list[str]:
    """The main text of each page."""
    paths = Paths()
    found = [leaves(p, paths) for p in pages]
    blocks = Blocks(paths, found, words)
    keep = _probabilities(model, blocks) >= 0.5
    out, a = [], 0
    for page in found:
        out.append("\n".join(b[1] for b, k in zip(page, keep[a : a + len(page)].tolist(), strict=True) if k))
        a += len(page)
    return out


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points)."""
    held = pages.sparkSession.sparkContext.broadcast(fit(sample(pages)) if model is None else model)
    types = pages.schema
    schema = f"page_id {types['page_id'].dataType.simpleString()}, url {types['url'].dataType.simpleString()}, text string, n_chars long"

    def run(batches):
        words: dict[str, int] = {}
        for batch in common.slices(batches, "html"):
            got = texts([(raw or b"").decode("utf-8", "replace") for raw in common.text_bytes(batch.column(2))], held.value, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, schema)
