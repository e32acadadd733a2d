"""HTML extraction with a recurrent block labeller.

A page is cut into blocks, the leaves between block-level tags, in page order.
A block is a vector of its hashed tag path (tags, classes, ids and roles of all
open elements), its hashed words and a few counts. A bidirectional LSTM in numpy
reads the blocks of a page in both directions and labels each as main text or
not, so the verdict on a block rests on the whole page.

The model is trained on the driver from at most ``SAMPLE`` pages of any length,
chosen by the hash of their html: their own markup says what lies in the
article. Of a page with more than ``SAMPLE_CHARS`` characters of text it takes
neighbouring blocks of about that length around a border of the article, cut
out where the page lies. To be independent of one layout, these blocks
are also set in invented layouts (other containers, class names, menus,
notices, forms, comments, with words taken from other pages). Training has a
fixed seed. Pages are labelled in tasks of their own; nothing is shuffled, and
the weights (some ten thousand numbers) travel with the tasks.

Null or empty html gives an empty text; so does a page in which nothing is main
text. If no page has text to learn from, invented texts take its place in the
layouts. Repeated rows stay rows; an empty table gives no rows and, as there is
nothing to learn from, no training. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, SAMPLE_CHARS, LAYOUTS, EPOCHS = 240, 30_000, 3, 6
PATH, WORDS, HIDDEN = 96, 48, 24
#: Pages that are read together: at most so many, of at most so many steps with their padding.
TOGETHER, STEPS = 96, 1 << 16

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+|[^>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
CLOSED = re.compile(r"</\w+\s*>\Z")
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table "
    "tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends an open element of these.
ENDS = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
Block = tuple[str, tuple[str, ...], float]


def blocks_of(html: str) -> list[Block]:
    """(text, distinct names on the path, share of linked characters) of every leaf block in page order.

    The innermost name comes last. Deep pages cost what their tags cost: names and open tags are counted, not listed anew.
    """
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()
    path: dict[str, int] = {}
    out: list[Block] = []
    parts: list[str] = []
    linked = total = 0

    def leave(i: int) -> None:
        for tag, names in reversed(stack[i:]):
            opened[tag] -= 1
            for n in names:
                path[n] -= 1
                if not path[n]:
                    del path[n]
        del stack[i:]

    def close_block() -> None:
        nonlocal parts, linked, total
        text = " ".join(unescape("".join(parts)).split())
        if text:
            last = stack[-1][1][-1:] if stack else ()
            out.append((text, (*(n for n in path if n not in last), *last), linked / max(1, total)))
        parts, linked, total = [], 0, 0

    def add(piece: str) -> None:
        nonlocal linked, total
        if piece:
            parts.append(piece)
            total += len(piece)
            linked += len(piece) if opened["a"] else 0

    # nothing behind the last > can be a tag; only a comment may begin there
    cut = html.rfind(">") + 1
    rest = html[cut:].partition("<!--")[0]
    html, at, hidden = html[:cut], 0, False
    for m in MARKUP.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        hidden = at == cut and (m[0].startswith("<!--") and not m[0].endswith("-->") or m[1] is not None and not CLOSED.search(m[0]))
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
        elif m[2]:
            if tag in BLOCKS:
                close_block()
            if opened[tag]:
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
        else:
            if tag in BLOCKS:
                close_block()
                if tag in ENDS:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in ENDS[tag]:
                            leave(i)
                            break
                        if stack[i][0] in ("ul", "ol", "table", "dl", "div", "article", "section", "body"):
                            break
            if tag not in VOID and not m[4].endswith("/"):
                named = [w.lower() for a in NAMED.findall(m[4]) for w in re.split(r"[\s_-]+", "".join(a)) if w] if m[4] else []
                stack.append((tag, (tag, *named)))
                opened[tag] += 1
                for n in stack[-1][1]:
                    path[n] = path.get(n, 0) + 1
    add(html[at:])
    if not hidden:
        add(rest)
    close_block()
    return out


@lru_cache(maxsize=200_000)
def _slot(word: str, slots: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode())
    return h % slots, 1.0 if h & 0x10000 else -1.0


def vectors(blocks: list[Block], first: int = 0, total: int = 0) -> np.ndarray:
    """A row per block; ``blocks`` are those from ``first`` on of a page of ``total`` blocks, or a whole page."""
    total = total or len(blocks)
    out = np.zeros((len(blocks), PATH + WORDS + 8), np.float32)
    for i, (text, path, linked) in enumerate(blocks):
        row = out[i]
        for name in path:
            slot, sign = _slot(name, PATH)
            row[slot] += sign
        if path:
            slot, sign = _slot("last " + path[-1], PATH)
            row[slot] += sign
        words = text.lower().split()
        for w in words:
            slot, sign = _slot(w, WORDS)
            row[PATH + slot] += sign
        row[PATH : PATH + WORDS] /= len(words) or 1
        n = len(text)
        ends = sum(text.count(c) for c in ".!?")
        row[PATH + WORDS :] = (
            np.log1p(n) / 5, np.log1p(len(words)) / 4, linked, ends / (len(words) or 1), text[-1:] in ".!?\"'", (first + i) / total, 1 - (first + i) / total, np.log1p(len(path)) / 3,
        )
    return out


class Labeller:
    """Bidirectional LSTM with a logistic output for every step."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = PATH + WORDS + 8
        self.w = {}
        for d in "fb":
            self.w["x" + d] = (rng.standard_normal((size, 4 * HIDDEN)) / np.sqrt(size)).astype(np.float32)
            self.w["h" + d] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            self.w["c" + d] = np.zeros(4 * HIDDEN, np.float32)
            self.w["c" + d][HIDDEN : 2 * HIDDEN] = 1
        self.w["o"] = (rng.standard_normal((2 * HIDDEN, 1)) / 5).astype(np.float32)
        self.w["q"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        steps, rows = x.shape[:2]
        gates = x @ self.w["x" + d] + self.w["c" + d]
        h = np.zeros((rows, HIDDEN), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((steps, rows, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = gates[t] + h @ self.w["h" + d]
            s = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN]))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            old_h, old_c = h, c
            c = m * (f * c + i * u) + (1 - m) * c
            tc = np.tanh(c)
            h = m * (o * tc) + (1 - m) * h
            out[t] = h
            if keep is not None:
                keep.append((t, old_h, old_c, i, f, o, u, tc, m))
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f", None), self._run(x, mask, "b", None)], axis=2)
        return (both @ self.w["o"] + self.w["q"])[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, d, kept[d]) for d in "fb"], axis=2)
        p = 1 / (1 + np.exp(-(both @ self.w["o"] + self.w["q"])[:, :, 0]))
        e = ((p - y) * mask / mask.sum())[:, :, None]
        g = {"o": (both * e).sum(axis=(0, 1))[:, None], "q": e.sum(axis=(0, 1))}
        back = e * self.w["o"][:, 0]
        for n, d in enumerate("fb"):
            into = back[:, :, n * HIDDEN : (n + 1) * HIDDEN]
            dg = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            gh = np.zeros_like(self.w["h" + d])
            for t, old_h, old_c, i, f, o, u, tc, m in reversed(kept[d]):
                dh = dh + into[t]
                live = dh * m
                dcell = dc * m + live * o * (1 - tc * tc)
                part = dg[t]
                part[:, :HIDDEN] = dcell * u * i * (1 - i)
                part[:, HIDDEN : 2 * HIDDEN] = dcell * old_c * f * (1 - f)
                part[:, 2 * HIDDEN : 3 * HIDDEN] = live * tc * o * (1 - o)
                part[:, 3 * HIDDEN :] = dcell * i * (1 - u * u)
                gh += old_h.T @ part
                dh = dh * (1 - m) + part @ self.w["h" + d].T
                dc = dcell * f + dc * (1 - m)
            g["h" + d] = gh
            g["x" + d] = x.reshape(-1, x.shape[2]).T @ dg.reshape(-1, 4 * HIDDEN)
            g["c" + d] = dg.sum(axis=(0, 1))
        return g


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), PATH + WORDS + 8), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i] = p
        mask[: len(p), i] = 1
    return x, mask


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 7) -> Labeller:
    """Fit to (vectors, labels) of pages with Adam."""
    model, rng = Labeller(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for _ in range(epochs):
        noise = rng.permutation(len(pages))
        order = sorted(range(len(pages)), key=lambda i: (len(pages[i][0]) // 8, noise[i]))
        groups = [order[i : i + 16] for i in range(0, len(order), 16)]
        for k in rng.permutation(len(groups)):
            x, mask = padded([pages[i][0] for i in groups[k]])
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(groups[k]):
                y[: len(pages[i][1]), j] = pages[i][1]
            step += 1
            for name, g in model.gradients(x, mask, y).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                model.w[name] -= 0.01 * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return model


#: Where main text and everything else may stand in invented layouts.
INSIDE = ("<article>", "<main>", '<div class="content">', '<div id="post" class="entry-content">', '<section class="story">', '<div class="article-body">', '<main><article class="post">')
OUTSIDE = (
    ("<nav><ul>", "<li><a href=/x>{}</a></li>", "</ul></nav>"), ("<header>", "<div class=brand>{}</div>", "</header>"),
    ("<aside>", "<p>{}</p>", "</aside>"), ('<div class="sidebar">', "<li><a href=/y>{}</a></li>", "</div>"),
    ('<div class="ad">', "{}", "</div>"), ('<div class="cookie-notice">', "<p>We use cookies. {}</p>", "</div>"),
    ('<div class="advert banner">', "<p>{}</p>", "</div>"), ('<form action=/s class="newsletter">', "<label>Subscribe {}</label><button>Sign up</button>", "</form>"),
    ('<section id="comments" class="comments">', '<div class="comment"><p>{}</p></div>', "</section>"), ('<div class="related">', "<h3>{}</h3>", "</div>"),
    ('<ul class="menu">', "<li><a href=/z>{}</a></li>", "</ul>"), ("<footer>", "<p>&copy; {}</p>", "</footer>"), ('<div id="footer">', "{} &middot; All rights reserved", "</div>"),
)
MARK = "\x00"


def layout(texts: list[str], other: list[str], rng: np.random.Generator) -> str:
    """A page in an invented layout; blocks of main text begin with ``MARK``."""
    def some() -> str:
        words = other[rng.integers(len(other))].split()
        a = int(rng.integers(max(1, len(words))))
        return " ".join(words[a : a + int(rng.integers(1, 25))]) or "more"

    def outer() -> str:
        begin, item, end = OUTSIDE[rng.integers(len(OUTSIDE))]
        return begin + "".join(item.format(some()) for _ in range(int(rng.integers(1, 6)))) + end

    begin = INSIDE[rng.integers(len(INSIDE))]
    main = [f"<h1>{MARK}{texts[0]}</h1>"]
    for t in texts[1:]:
        kind = rng.integers(12)
        main.append(f"<p>{MARK}{t}</p>" if kind < 9 else f"<h2>{MARK}{t}</h2>" if kind < 10 else f"<ul><li>{MARK}{t}</li></ul>" if kind < 11 else f"<blockquote>{MARK}{t}</blockquote>")
        if rng.random() < 0.06:
            main.append(outer())
    top = "".join(outer() for _ in range(int(rng.integers(0, 4))))
    rest = "".join(outer() for _ in range(int(rng.integers(0, 5))))
    ends = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", begin)))
    return f"<html><head><title>{texts[0][:60]}</title></head><body>{top}{begin}{''.join(main)}{ends}{rest}</body></html>"


#: What is not main text though it stands inside the article.
WITHIN = frozenset("nav aside footer form button select ad advert comment comments related sidebar cookie menu title".split())


def _main(blocks: list[Block]) -> np.ndarray:
    return np.array([("article" in p or "main" in p) and not WITHIN.intersection(p) for _, p, _ in blocks], np.float32)


def excerpt(html: str, most: int = SAMPLE_CHARS) -> tuple[list[Block], int, int]:
    """(blocks, place of the first, blocks of the page): the page, or about ``most`` characters around a border of its main text."""
    blocks = blocks_of(html)
    sizes = [max(len(t), 30) for t, _, _ in blocks]  # a block costs something, however short
    if sum(sizes) <= most:
        return blocks, 0, len(blocks)
    borders = np.flatnonzero(np.diff(_main(blocks))) + 1
    h = zlib.crc32(html.encode("utf-8", "replace"))
    a = b = int(borders[h % len(borders)]) if len(borders) else h % len(blocks)
    left = {"before": most // 2, "after": most // 2}
    # the blocks on both sides of the border in any case, a longer one with its beginning
    while a > 0 and left["before"] > 0:
        a -= 1
        left["before"] -= sizes[a]
    while b < len(blocks) and left["after"] > 0:
        left["after"] -= sizes[b]
        b += 1
    return [(t[: most // 2], p, linked) for t, p, linked in blocks[a:b]], a, len(blocks)


#: Texts for the layouts when no page has any.
INVENTED = (
    ("A quiet harbour", "The boats came back before noon, and the market on the quay was already full of people.", "Nobody had expected so much fish after the storm, so prices fell within an hour."),
    ("How the bridge was built", "Work began in the spring, when the river was low enough to set the first stones.", "The engineers measured the arch again each week and wrote the figures in a small book.", "It was opened two years later."),
    ("Notes on winter gardens", "Most herbs survive the frost if their roots are covered with leaves.", "Water them in the morning only, since wet soil freezes at night."),
)


def labelled(pages: list[tuple[list[Block], int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training pages: excerpts as they are, where the markup names an article, and in invented layouts."""
    rng, out, texts = np.random.default_rng(11), [], []
    for blocks, first, total in pages:
        y = _main(blocks)
        if y.any() and not y.all():
            out.append((vectors(blocks, first, total), y))
        own = [t for (t, _, _), label in zip(blocks, y) if label] if y.any() else [t for t, _, linked in blocks if len(t) > 80 and linked < 0.3]
        if own:
            texts.append([re.sub("[<>&]", " ", t) for t in own[:60]])
    if not out and not texts:
        texts = [list(t) for t in INVENTED] * 8
    flat = [t for own in texts for t in own]
    for own in texts:
        for _ in range(LAYOUTS):
            blocks = blocks_of(layout(own, flat, rng))
            y = np.array([t.startswith(MARK) for t, _, _ in blocks], np.float32)
            out.append((vectors([(t.lstrip(MARK), p, linked) for t, p, linked in blocks]), y))
    return out


def _excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for h, html in zip(batch.column("h"), batch.column("html")):
            part = pa.array([pickle.dumps(excerpt(html.as_py()))], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([h.as_py()], pa.int64()), part], ["h", "part"])


def fit(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """Train on a bounded sample of distinct ``pages`` (html), chosen by hash; only the hashes are sorted."""
    full = pages.where("html != ''").select("html", F.xxhash64("html").alias("h"))
    chosen = [r["h"] for r in full.select("h").distinct().orderBy("h").limit(sample).collect()]
    if not chosen:
        return Labeller()
    parts = full.where(F.col("h").isin(chosen)).mapInArrow(_excerpts, "h long, part binary").dropDuplicates(["h"])
    return train(labelled([pickle.loads(r["part"]) for r in sorted(parts.collect(), key=lambda r: r["h"])]))


def main_text(model: Labeller, htmls: list[str]) -> list[str]:
    """Main text of every page, blocks joined by line ends; pages of like length are read together."""
    pages = [blocks_of(h) if h else [] for h in htmls]
    out = [""] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    k = 0
    while k < len(order):
        # the longest page of a group sets its padded length; a page beyond STEPS is read alone
        size = 1
        while size < TOGETHER and k + size < len(order) and (size + 1) * len(pages[order[k + size]]) <= STEPS:
            size += 1
        group = order[k : k + size]
        k += size
        x, mask = padded([vectors(pages[i]) for i in group])
        keep = model.scores(x, mask) > 0
        for j, i in enumerate(group):
            out[i] = "\n".join(b[0] for b, main in zip(pages[i], keep[:, j]) if main)
    return out


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    model = model or fit(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * TOGETHER):
                part = batch.slice(at, 4 * TOGETHER)
                texts = main_text(model, part.column("html").to_pylist())
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kinds = {n: pages.schema[n].dataType.simpleString() for n in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
