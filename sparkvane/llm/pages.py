"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks: runs of text between block-level tags, each with the path of its
open elements (tag names, words of class, id and role). A bidirectional LSTM in numpy reads, block by
block, the mean vector of the hashed path parts, the mean vector of the hashed words and a few plain
measures, and labels every block with the whole page as context. Blocks labelled main are kept, in
page order. Scripts, styles, markup, comments, hidden elements and the head are never text.

The labeller is trained here, on the driver, from pages that `sample_pages` invents (TRAIN_PAGES of
them, from a fixed seed); nothing of the corpus is learned. Its weights are kept in the shared folder
under a hash of this module, so later sessions with that folder read them. Parsing takes time linear
in a page's length, whatever its depth. Null and empty pages, and pages without
main blocks, give an empty text. Very long pages are read whole. Rows are kept as they are, repeated
or not; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, shared_dir, sliced, small_batches

PATH_BUCKETS, WORD_BUCKETS, PATH_DIM, WORD_DIM, PLAIN, HIDDEN = 2048, 4096, 20, 8, 8, 20
#: Bounds what is held at a time of very deep and very long pages.
SLOTS_AT_ONCE, STEPS_AT_ONCE = 1_000_000, 4096
#: Lifts the path's mean, in which one telling name stands among several.
PATH_GAIN = 4.0
TRAIN_PAGES, EPOCHS, BATCH, RATE, SEED = 5000, 4, 32, 0.008, 11

# Element names of the HTML standard.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "canvas", "audio", "video")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img"}
#: An opening tag of the first closes an open element of the second, unless one of BARRIERS is opened in between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIERS = ("ul", "ol", "dl", "table", "select", "div", "article", "section", "body")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_PART = re.compile(r"[a-z]+|\d+")


@lru_cache(maxsize=4096)
def attributes(tag: str) -> tuple[tuple[str, ...], bool]:
    """Of an opening tag's attributes: the parts of its class, id and role, and whether it is hidden."""
    own: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag):
        own.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    parts = tuple(p for k, v in own.items() if k in ("class", "id", "role") for p in _PART.findall(v.lower()))
    hidden = "hidden" in own and not own["hidden"].strip().lower().startswith(("false", "until"))
    return parts, hidden or own.get("aria-hidden", "").strip().lower() == "true" or _NO_DISPLAY.search(own.get("style", "")) is not None


_PATH_SLOTS: dict[str, int] = {}
_WORD_SLOTS: dict[str, int] = {}


def _slot(kept: dict[str, int], word: str, size: int) -> int:
    if (s := kept.get(word)) is None:
        if len(kept) > 200_000:
            kept.clear()
        s = kept[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % size
    return s


class _Open:
    """The open elements of a page, with what a block needs to know of them kept up to date, so that a tag costs the same at any depth."""

    def __init__(self):
        self.names: list[str] = []
        self.own: list[tuple[list[int], bool]] = []
        #: Where the open elements of a name stand; under "" those of all block-level names.
        self.at: dict[str, list[int]] = {"": []}
        self.slots: dict[int, int] = {}
        self.last: list[str] = []
        self.hidden = 0

    def push(self, name: str, parts: tuple[str, ...], hidden: bool) -> None:
        slots = [_slot(_PATH_SLOTS, p, PATH_BUCKETS) for p in parts]
        for x in slots:
            self.slots[x] = self.slots.get(x, 0) + 1
        self.at.setdefault(name, []).append(len(self.names))
        if name not in INLINE:
            self.at[""].append(len(self.names))
        self.names.append(name)
        self.own.append((slots, hidden))
        self.last.append(parts)
        self.hidden += hidden

    def where(self, *names: str) -> int:
        """The place of the innermost open element of these names, -1 if there is none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def close(self, k: int) -> None:
        """Close the elements from place k on."""
        while len(self.names) > k:
            name, (slots, hidden) = self.names.pop(), self.own.pop()
            self.last.pop()
            self.at[name].pop()
            if name not in INLINE:
                self.at[""].pop()
            for x in slots:
                if self.slots[x] == 1:
                    del self.slots[x]
                else:
                    self.slots[x] -= 1
            self.hidden -= hidden

    def path(self) -> bytes:
        """The slots of the names on the path, at most PATH_BUCKETS, and of the innermost three as such; two bytes each."""
        inner: list[str] = []
        for parts in reversed(self.last):
            inner = [*parts[len(inner) - 3 :], *inner] if len(parts) > 3 - len(inner) else [*parts, *inner]
            if len(inner) == 3:
                break
        return array("h", (*self.slots, *{_slot(_PATH_SLOTS, f">{p}", PATH_BUCKETS) for p in inner}.difference(self.slots))).tobytes()


def blocks(page: str | None) -> list[tuple[bytes, str, int]]:
    """Path slots, text and characters inside links of each leaf block of a page, in page order."""
    if not page:
        return []
    out: list[tuple[bytes, str, int]] = []
    stack = _Open()
    text: list[str] = []
    linked = at = 0

    def end() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append((stack.path(), whole, linked))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if not stack.hidden:
            text.append(piece)
            if stack.at.get("a"):
                linked += len(piece)

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not (name := m[2]):
            continue
        name = name.lower()
        block = name not in INLINE
        if m[1]:
            if block:
                end()
            # An inline end tag closes nothing beyond the innermost block.
            if (k := stack.where(name)) >= 0 and (block or k > stack.where("")):
                stack.close(k)
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = close.end() if close else len(page)
            if block:
                end()
            continue
        if name == "br":
            add(" ")
            continue
        if block:
            end()
            if name not in ("li", "td", "th", "tr") and (k := stack.where("")) >= 0 and stack.names[k] == "p":
                stack.close(k)
            if name in CLOSES and (k := stack.where(*CLOSES[name])) > stack.where(*BARRIERS):
                stack.close(k)
        if name not in VOID and not m[3].endswith("/"):
            parts, hidden = attributes(m[3]) if m[3] else ((), False)
            stack.push(name, (name, *parts), hidden or name == "head")
    if at < len(page) and "<" != page[at]:
        add(page[at:])
    end()
    return out


class Inputs:
    """The inputs of one page's blocks: slots with the number of each block's, and plain measures."""

    def __init__(self, found: list[tuple[bytes, str, int]]):
        n = len(found)
        texts = [t.lower().split() for _, t, _ in found]
        words = [[_slot(_WORD_SLOTS, w.strip(".,;:!?()\"'"), WORD_BUCKETS) for w in ws] for ws in texts]
        self.n = n
        self.path, self.paths = np.frombuffer(b"".join([path for path, _, _ in found]), np.int16), np.array([len(path) // 2 for path, _, _ in found], np.int64)
        self.word, self.words = np.array([s for w in words for s in w], np.int16), np.array([len(w) for w in words], np.int64)
        self.plain = np.array(
            [
                (min(len(w), 400) ** 0.5 / 10, len(w) > 12, min(1.0, linked / max(len(t), 1)), t[-1] in ".!?:…\"'", (k + 1) / n, k == 0, any(c in t for c in "|©»›·"), t[:1].isupper())
                for k, ((_, t, linked), w) in enumerate(zip(found, texts, strict=True))
            ],
            np.float32,
        ).reshape(n, PLAIN)


def _sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of x and where its runs of equal values begin."""
    order = np.argsort(x, kind="stable")
    return order, np.flatnonzero(np.diff(x[order], prepend=-1))


class Pages:
    """Some pages side by side: what the labeller reads of them, block by block, and of the slots how they sum up."""

    def __init__(self, pages: list[Inputs], labels: list[np.ndarray] | None = None):
        self.sizes = np.array([p.n for p in pages])
        steps = int(self.sizes.max(initial=0))
        #: Step and page of each block.
        self.t, self.b = np.concatenate([np.arange(n) for n in self.sizes]), np.repeat(np.arange(len(pages)), self.sizes)
        self.mask = np.zeros((steps, len(pages)), bool)
        self.mask[self.t, self.b] = True
        self.plain = np.concatenate([p.plain for p in pages])
        self.slots = {}
        for name, slot, count in (("path", [p.path for p in pages], [p.paths for p in pages]), ("word", [p.word for p in pages], [p.words for p in pages])):
            slot, count = np.concatenate(slot), np.concatenate(count)
            self.slots[name] = slot, None if labels is None else np.repeat(np.arange(len(count)), count), count
        self.target = None if labels is None else np.concatenate(labels)
        self.order = {} if labels is None else {name: _sorted(slot) for name, (slot, _, _) in self.slots.items()}

    def mean(self, name: str, table: np.ndarray) -> np.ndarray:
        """The mean of each block's rows of the table, zero where it has none."""
        slot, _, count = self.slots[name]
        out, some = np.zeros((len(count), table.shape[1]), table.dtype), np.flatnonzero(count)
        ends, s = np.cumsum(count[some]), 0
        while s < len(some):
            first = ends[s - 1] if s else 0
            e = max(s + 1, int(np.searchsorted(ends, first + SLOTS_AT_ONCE)))
            own = some[s:e]
            out[own] = np.add.reduceat(table[slot[first : ends[e - 1]]], np.concatenate([[0], ends[s : e - 1] - first])) / count[own, None].astype(table.dtype)
            s = e
        return out

    def scattered(self, name: str, table: np.ndarray, dx: np.ndarray) -> np.ndarray:
        """The gradient of the table of mean() by that of its result."""
        slot, of, count = self.slots[name]
        out = np.zeros_like(table)
        if len(slot):
            order, heads = self.order[name]
            share = dx / np.maximum(count, 1)[:, None].astype(dx.dtype)
            out[slot[order[heads]]] = np.add.reduceat(share[of[order]], heads)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Labeller:
    """The bidirectional LSTM with its hashed embeddings. Both directions are scanned at once: index 0 forwards, 1 backwards."""

    def __init__(self, seed: int, kind: type = np.float32):
        rng = np.random.default_rng(seed)
        size = PATH_DIM + WORD_DIM + PLAIN
        p = {"path": rng.normal(0, 0.3, (PATH_BUCKETS, PATH_DIM)), "word": rng.normal(0, 0.01, (WORD_BUCKETS, WORD_DIM)), "v": rng.normal(0, 0.2, (2 * HIDDEN + size, 1)), "c": np.zeros(1)}
        p["w"], p["u"] = rng.normal(0, 0.2, (2, size, 4 * HIDDEN)), rng.normal(0, 0.2, (2, HIDDEN, 4 * HIDDEN))
        p["o"] = np.tile(np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)]), (2, 1, 1))
        self.p = {k: v.astype(kind) for k, v in p.items()}

    def _read(self, pages: Pages) -> np.ndarray:
        """The inputs, step x page x measure."""
        own = np.concatenate([PATH_GAIN * pages.mean("path", self.p["path"]), pages.mean("word", self.p["word"]), pages.plain.astype(self.p["v"].dtype)], axis=1)
        x = np.zeros((*pages.mask.shape, own.shape[1]), own.dtype)
        x[pages.t, pages.b] = own
        return x

    def _scan(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The hidden states, direction x step x page; steps of the second direction are counted from the end."""
        steps, n, size = x.shape
        on = np.stack([mask, mask[::-1]], axis=1)[..., None]
        h = c = np.zeros((2, n, HIDDEN), x.dtype)
        out = np.zeros((steps, 2, n, HIDDEN), x.dtype)
        for t in range(steps):
            if not (at := t % STEPS_AT_ONCE):
                own = np.stack([x[t : t + STEPS_AT_ONCE], x[::-1][t : t + STEPS_AT_ONCE]])
                fed = (own.reshape(2, -1, size) @ self.p["w"] + self.p["o"]).reshape(2, -1, n, 4 * HIDDEN).transpose(1, 0, 2, 3)
            g = fed[at] + h @ self.p["u"]
            s, z = _sigmoid(g[..., : 3 * HIDDEN]), np.tanh(g[..., 3 * HIDDEN :])
            new = s[..., :HIDDEN] * c + s[..., HIDDEN : 2 * HIDDEN] * z
            th = np.tanh(new)
            if keep is not None:
                keep.append((h, c, s, z, th))
            h, c = np.where(on[t], s[..., 2 * HIDDEN :] * th, h), np.where(on[t], new, c)
            out[t] = h
        return out.transpose(1, 0, 2, 3)

    def _top(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        h = self._scan(x, mask, keep)
        return np.concatenate([h[0], h[1][::-1], x], axis=2)

    def predict(self, pages: list[Inputs]) -> list[np.ndarray]:
        """The probability of being main text of each block of each page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k].n), key=lambda k: pages[k].n)
        while order:
            # Pages of about one length together; the longest alone, if need be.
            take = max(1, min(128, 60_000 // pages[order[-1]].n))
            own, order = order[-take:], order[:-take]
            side = Pages([pages[k] for k in own])
            y = _sigmoid(self._top(self._read(side), side.mask) @ self.p["v"] + self.p["c"])[:, :, 0]
            for i, k in enumerate(own):
                out[k] = y[: pages[k].n, i]
        return out

    def gradients(self, pages: Pages) -> tuple[dict[str, np.ndarray], float]:
        x, kept = self._read(pages), []
        top = self._top(x, pages.mask, kept)
        y = _sigmoid(top @ self.p["v"] + self.p["c"])[:, :, 0]
        dy = np.zeros_like(y)
        got = y[pages.t, pages.b]
        dy[pages.t, pages.b] = (got - pages.target) / len(got)
        steps, n, size = x.shape
        g = {"v": (top.reshape(steps * n, -1).T @ dy.reshape(-1, 1)), "c": dy.sum(keepdims=True).reshape(1)}
        dtop = dy[:, :, None] * self.p["v"][:, 0]
        dx = dtop[:, :, 2 * HIDDEN :].copy()
        part = np.stack([dtop[:, :, :HIDDEN], dtop[::-1, :, HIDDEN : 2 * HIDDEN]], axis=1)
        on = np.stack([pages.mask, pages.mask[::-1]], axis=1)[..., None]
        back = self.p["u"].transpose(0, 2, 1)
        dgs, hs = np.zeros((steps, 2, n, 4 * HIDDEN), x.dtype), np.stack([k[0] for k in kept])
        dh = dc = np.zeros((2, n, HIDDEN), x.dtype)
        for t in range(steps - 1, -1, -1):
            _, c, s, z, th = kept[t]
            dh = dh + part[t]
            live = np.where(on[t], dh, 0)
            f_, i_, o_ = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :]
            dnew = live * o_ * (1 - th * th) + np.where(on[t], dc, 0)
            dg = np.concatenate([dnew * c * f_ * (1 - f_), dnew * z * i_ * (1 - i_), live * th * o_ * (1 - o_), dnew * i_ * (1 - z * z)], axis=-1)
            dgs[t] = dg
            dh, dc = np.where(on[t], 0, dh) + dg @ back, np.where(on[t], dnew * f_, dc)
        g["w"], g["u"], g["o"] = np.zeros_like(self.p["w"]), np.zeros_like(self.p["u"]), np.zeros_like(self.p["o"])
        flat = x.reshape(steps * n, size)
        for d in (0, 1):
            mine = dgs[:, d] if d == 0 else dgs[::-1, d]
            mine = np.ascontiguousarray(mine).reshape(steps * n, -1)
            g["w"][d] = flat.T @ mine
            g["o"][d, 0] = mine.sum(0)
            g["u"][d] = hs[:, d].reshape(steps * n, -1).T @ dgs[:, d].reshape(steps * n, -1)
            dx += (mine @ self.p["w"][d].T).reshape(x.shape)
        own = dx[pages.t, pages.b]
        g["path"] = pages.scattered("path", self.p["path"], PATH_GAIN * own[:, :PATH_DIM])
        g["word"] = pages.scattered("word", self.p["word"], own[:, PATH_DIM : PATH_DIM + WORD_DIM])
        return g, float(-np.log(np.maximum(np.where(pages.target > 0, got, 1 - got), 1e-9)).mean())

    def fit(self, pages: list[Inputs], labels: list[np.ndarray], epochs: int, seed: int) -> None:
        """Adam over minibatches of pages of about one length."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        order, step = sorted(range(len(pages)), key=lambda k: pages[k].n), 0
        batches = [Pages([pages[k] for k in own], [labels[k] for k in own]) for own in (order[k : k + BATCH] for k in range(0, len(order), BATCH))]
        for epoch in range(epochs):
            for b in rng.permutation(len(batches)):
                g, _ = self.gradients(batches[b])
                step += 1
                rate = RATE * (0.3 if epoch >= epochs * 2 // 3 else 1.0)
                for k, v in self.p.items():
                    first[k] += 0.1 * (g[k] - first[k])
                    second[k] += 0.001 * (g[k] ** 2 - second[k])
                    v -= rate * (first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + 1e-4 * v)


# Names that invented pages give their elements.
MAIN_NAMES = ("article", "post", "entry", "content", "main", "story", "body", "text", "page", "single", "blog")
OTHER_NAMES = {
    "menu": ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "links", "tabs", "pagination", "pager", "toc"),
    "header": ("header", "masthead", "banner", "logo", "site", "top", "branding"),
    "footer": ("footer", "bottom", "copyright", "legal", "colophon", "imprint", "credits"),
    "sidebar": ("sidebar", "aside", "widget", "related", "recommended", "popular", "tags", "archive", "rail", "recent", "trending", "author", "bio"),
    "notice": ("cookie", "consent", "notice", "banner", "alert", "gdpr", "popup", "modal", "overlay", "privacy", "message"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "adsense"),
    "form": ("form", "search", "login", "newsletter", "subscribe", "signup", "contact", "feedback"),
    "comments": ("comments", "comment", "reply", "replies", "respond", "discussion", "disqus", "thread", "reader"),
    "share": ("share", "social", "sharing", "follow", "buttons", "toolbar", "meta", "byline"),
}
OTHER_TAGS = {"menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"), "notice": ("div", "section", "aside"), "ad": ("div", "aside", "ins", "section"), "form": ("form", "div"), "comments": ("section", "div", "ol", "ul"), "share": ("div", "ul", "section")}
_SYLLABLES = "an er the in on st ou re ti ed ha en es or wh ea le nt is sch ich un ein auf que ment tion ai eau de la el os ci do ra ña za lo vi pa mo ku ly to ng".split()


#: Stands before each main block of an invented page; a character of the private use area.
MARK = "\ue000"


def sample_pages(n: int, seed: int = SEED) -> list[str]:
    """Invented pages; MARK stands before the text of each main block."""
    rng = random.Random(seed)
    pick, upto = rng.choice, rng.randrange

    made = ["".join(pick(_SYLLABLES) for _ in range(upto(1, 4))) for _ in range(10 * n + 500)]

    def word() -> str:
        return pick(made)

    def words(a: int, b: int) -> str:
        out = " ".join([w + "," if rng.random() < 0.06 else w for w in rng.choices(made, k=upto(a, b))])
        return out[:1].upper() + out[1:]

    def label() -> str:
        out = words(1, 4)
        out = out.lower() if rng.random() < 0.5 else out
        return out + (pick((".", ",", ":", "!", "")) if rng.random() < 0.4 else "")

    def prose(long: bool) -> str:
        if (r := rng.random()) < 0.25:
            return label() if r < 0.12 else words(1, 5) + pick((".", ".", ".", "!", "?", ".***", " | " + word() + "."))
        out = " ".join(words(2, 14) + pick((".", ".", ".", "!", "?", "")) for _ in range(upto(1, (12 if r > 0.93 else 5) if long else 3)))
        return out if rng.random() < 0.8 else re.sub(r"(\w) ", lambda m: m[1] + pick(("*** ", " ", "%%% ", "### ", "&amp; ")), out)

    def names(kind: tuple[str, ...]) -> str:
        own = "-".join({pick(kind) for _ in range(upto(1, 3))})
        return f' {pick(("class", "class", "id", "role"))}="{own}{pick(("", "", " box", " c12", " inner", " row"))}"'

    def other(kind: str) -> str:
        tag = pick(OTHER_TAGS[kind])
        bare = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6
        head = f"<{tag}{'' if bare else names(OTHER_NAMES[kind])}>"
        if kind in ("menu", "share") or kind in ("sidebar", "footer", "header") and rng.random() < 0.5:
            inner = "".join(f'<li><a href="/{word()}">{label()}</a></li>' for _ in range(upto(2, 9)))
            inner = inner if tag == "ul" else f"<ul>{inner}</ul>" if rng.random() < 0.7 else re.sub(r"</?li>", " ", inner)
            inner = (f"<h3>{words(1, 4)}</h3>" if kind == "sidebar" else "") + inner
        elif kind == "comments":
            inner = f"<h3>{pick(('Comments', 'Kommentare', '3 comments', 'Commentaires', words(1, 3)))}</h3>" + "".join(f"<{c}{names(OTHER_NAMES[kind])}><b>{word()}</b> <p>{prose(rng.random() < 0.3)}</p></{c}>" for c in [pick(("div", "li"))] for _ in range(upto(1, 6)))
        elif kind == "form":
            inner = f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button>" + (f"<p>{prose(False)}</p>" if rng.random() < 0.4 else "")
        elif kind == "footer":
            inner = f"{pick(('&copy; ', '© ', 'Copyright ', ''))}{word()}.example.com &middot; {prose(False)}"
            inner = inner if rng.random() < 0.5 else f"<p>{inner}</p>"
        else:
            body = prose(rng.random() < 0.3)
            inner = body if rng.random() < 0.5 else f"<p>{body}</p>"
        return f"{head}{inner}</{tag}>"

    out = []
    for _ in range(n):
        kept = lambda text: MARK + text
        body = [f"<h1>{kept(words(2, 10))}</h1>"] if rng.random() < 0.85 else []
        for _ in range(upto(1, 22)):
            r = rng.random()
            if r < 0.62:
                body.append(f"<p>{kept(prose(True))}" + ("</p>" if rng.random() < 0.8 else ""))
            elif r < 0.74:
                body.append(f"<p><b>{kept(prose(True))}<br>")
            elif r < 0.8:
                body.append(f"<h{pick('234')}>{kept(words(1, 8))}".replace("<h", "<h", 1) + "</h3>")
            elif r < 0.86:
                body.append("<ul>" + "".join(f"<li>{kept(prose(False))}</li>" for _ in range(upto(2, 6))) + "</ul>")
            elif r < 0.9:
                body.append(f"<blockquote><p>{kept(prose(True))}</p></blockquote>")
            elif r < 0.93:
                body.append(f"<div>{kept(prose(True))}</div>")
            elif r < 0.97:
                body.append(f'<p>{kept(words(3, 9))} <a href="/{word()}">'.replace(" <a", "</p><!-- x --><p><a", 1) + f"{kept(words(1, 4))}</a></p>")
            else:
                body.append(other(pick(("ad", "share", "sidebar", "ad", "notice"))))
        shape = rng.random()
        tag = "article" if shape < 0.45 else "main" if shape < 0.6 else "div" if shape < 0.85 else "section"
        if shape < 0.97:
            name = names(MAIN_NAMES) if tag in ("div", "section") or rng.random() < 0.3 else ""
            center = f"<{tag}{name}>" + "".join(body) + f"</{tag}>"
            center = f"<div{names(('wrap', 'container', 'page', 'layout', 'outer'))}>{center}</div>" if rng.random() < 0.3 else center
        else:
            center = "".join(body)
        before = [other(k) for k in ("header", "menu", "notice", "ad", "menu", "share", "form") if rng.random() < 0.45]
        after = [other(k) for k in ("share", "sidebar", "comments", "ad", "form", "footer", "sidebar", "notice") if rng.random() < 0.4] + ([other("footer")] if rng.random() < 0.6 else [])
        if rng.random() < 0.3:
            before, after = [*before, *after[:2]], after[2:]
        out.append(f"<html><head><title>{words(2, 6)}</title></head><body>{''.join(before)}{center}{''.join(after)}</body></html>")
    return out


def labelled(page: str) -> tuple[Inputs, np.ndarray]:
    """The inputs of an invented page and which of its blocks are main."""
    found = blocks(page)
    return Inputs([(path, t.replace(MARK, ""), linked) for path, t, linked in found]), np.array([MARK in t for _, t, _ in found], float)


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The labeller, trained once a process; the same for the same arguments."""
    inputs, labels = zip(*(labelled(p) for p in sample_pages(pages, seed)), strict=True)
    model = Labeller(seed)
    model.fit(inputs, labels, epochs, seed)
    return model


def kept(spark: SparkSession) -> Labeller:
    """The trained labeller, from the shared folder if it is whole there."""
    with open(__file__, "rb") as own:
        path = f"{shared_dir(spark)}/page-labeller-{hashlib.sha256(own.read()).hexdigest()[:16]}"
    blank = Labeller(SEED)
    try:
        got = {r.name: np.frombuffer(r.value, np.float32) for r in spark.read.parquet(path).collect()}
    except AnalysisException:
        got = {}
    if {k: v.size for k, v in got.items()} == {k: v.size for k, v in blank.p.items()}:
        blank.p = {k: got[k].reshape(v.shape) for k, v in blank.p.items()}
        return blank
    model = trained()
    spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in model.p.items()], "name string, value binary").coalesce(1).write.mode("overwrite").parquet(path)
    return model


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages (page_id, url, html)."""
    small_batches(pages.sparkSession, 500)
    model = model or kept(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller.__new__(Labeller)
        own.p = sent.value
        for part, raw in sliced(batches, 2, 2_000_000):
            found = [blocks(p) for p in raw]
            main = own.predict([Inputs(f) for f in found])
            texts = ["\n".join(t for (_, t, _), y in zip(f, m, strict=True) if y >= 0.5) for f, m in zip(found, main, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select("page_id", F.col("url").cast("string").alias("url"), "html")
    return own.mapInArrow(run, f"page_id {own.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
