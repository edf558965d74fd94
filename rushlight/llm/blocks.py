"""Main text of web pages by a recurrent block labeller."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# -- blocks ---------------------------------------------------------------------------------------------------------

# Attributes as browsers read them: quotes open a string only right after the sign of equality; elsewhere they are letters.
_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?)?)*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|svg|textarea|iframe|title)(?=[\s/>]|\Z){_ATTRIBUTES}(?:>|\Z).*?(?:</(?P=raw)(?=[\s/>]|\Z)[^>]*(?:>|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>{_ATTRIBUTES})(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PIECES = re.compile(r"[A-Za-z]+")

#: Elements that stay inside the block around them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr img br".split()
)
#: Elements without content; the rest of these rules is that of common HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end where the next of the same kind begins.
CLOSED_BY_NEXT = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section "
    "table ul".split()
)


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # open elements from the outside, each as "tag" followed by its class, id and role words
    linked: float  # share of the characters inside links


def read_blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order: text between the edges of block elements, white space runs as one space.

    Comments, scripts, styles, titles and other raw elements have no text. Character references are decoded. Broken
    markup is read on: what is never closed ends with its parent or the page.
    """
    page = page or ""
    blocks: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    links, linked, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append(Block(text, tuple(label for _, label in stack), min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text)

    for m in _TOKEN.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                take(" ")
            elif tag == "a":
                links = max(0, links + (-1 if m["end"] else 1))
            continue
        flush()
        links = 0
        if m["end"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                del stack[depth:]
            continue
        if tag in ENDS_PARAGRAPH and any(t == "p" for t, _ in stack):
            del stack[next(i for i, (t, _) in enumerate(stack) if t == "p") :]
        if stack and stack[-1][0] in CLOSED_BY_NEXT.get(tag, ()):
            stack.pop()
        if tag not in VOID and not m["rest"].endswith("/"):
            words = " ".join(
                w.lower() for found in _NAMES.finditer(m["rest"]) for w in _PIECES.findall(next(g for g in found.groups() if g is not None))
            ) if m["rest"] else ""
            stack.append((tag, f"{tag} {words}".strip()))
    take(page[at:])
    flush()
    return blocks


# -- features -------------------------------------------------------------------------------------------------------

PATH_SLOTS, WORD_SLOTS, PLAIN = 256, 32, 8
WIDTH = PATH_SLOTS + WORD_SLOTS + PLAIN
class _Slots(dict):
    """Word -> hashed slot, remembered by the worker up to ``MEMO`` words."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % self.size
        return found


MEMO = 300_000
_path_slots, _word_slots = _Slots(PATH_SLOTS), _Slots(WORD_SLOTS)
_vectors: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    found = _vectors.get(path)
    if found is None:
        if len(_vectors) > 20_000:
            _vectors.clear()
        found = np.zeros(PATH_SLOTS, np.float32)
        for label in path:
            for word in label.split():
                found[_path_slots[word]] = 1.0
        _vectors[path] = found
    return found


def features(blocks: list[Block]) -> np.ndarray:
    """(blocks, WIDTH): tag path (hashed set of tag and attribute words), hashed words by share, and a few measures."""
    out = np.zeros((len(blocks), WIDTH), np.float32)
    for i, b in enumerate(blocks):
        out[i, :PATH_SLOTS] = _path_vector(b.path)
        words = b.text.split(" ")
        slots = np.bincount(np.fromiter(map(_word_slots.__getitem__, words), np.int64, len(words)), minlength=WORD_SLOTS)
        out[i, PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = slots / len(words)
        size = len(b.text)
        out[i, PATH_SLOTS + WORD_SLOTS :] = (
            np.log1p(size) / 10, np.log1p(len(words)) / 8, b.linked, b.text.endswith((".", "!", "?")), i / len(blocks),
            "©" in b.text, b.path[-1].startswith(("h1", "h2", "h3")) if b.path else 0.0, len(b.path) / 10,
        )
    return out


# -- model ----------------------------------------------------------------------------------------------------------


class BlockLabeller:
    """Bidirectional LSTM over a page's blocks with one logistic output per block."""

    def __init__(self, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {}
        for side in ("f", "b"):
            self.p[f"w{side}"] = (rng.standard_normal((WIDTH, 4 * hidden)) * 0.1).astype(np.float32)
            self.p[f"u{side}"] = (rng.standard_normal((hidden, 4 * hidden)) * 0.2).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1.0  # remember at first
            self.p[f"c{side}"] = bias
        self.p["v"] = (rng.standard_normal((2 * hidden, 1)) * 0.1).astype(np.float32)
        self.p["d"] = np.zeros(1, np.float32)

    def _walk(self, side: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """States (batch, time, hidden) of one direction; ``x`` and ``mask`` already run in that direction."""
        n, time, h = x.shape[0], x.shape[1], self.hidden
        driven = x @ self.p[f"w{side}"] + self.p[f"c{side}"]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, kept = np.zeros((n, time, h), np.float32), []
        for t in range(time):
            z = driven[:, t] + state @ self.p[f"u{side}"]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            on = mask[:, t, None]
            fresh = f * cell + i * g
            bent = np.tanh(fresh)
            kept.append((state, cell, i, f, o, g, bent, on))
            cell = np.where(on, fresh, cell)
            state = np.where(on, o * bent, state)
            out[:, t] = state
        return out, kept

    def _back(self, side: str, x: np.ndarray, kept: list, grad: np.ndarray, into: dict) -> None:
        h = self.hidden
        dstate, dcell = np.zeros((x.shape[0], h), np.float32), np.zeros((x.shape[0], h), np.float32)
        dz_all = np.zeros((x.shape[0], x.shape[1], 4 * h), np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            state, cell, i, f, o, g, bent, on = kept[t]
            total = dstate + grad[:, t]
            ds = np.where(on, total, 0)
            dfresh = np.where(on, dcell + ds * o * (1 - bent**2), 0)
            dz = np.concatenate(
                [dfresh * g * i * (1 - i), dfresh * cell * f * (1 - f), ds * bent * o * (1 - o), dfresh * i * (1 - g**2)], axis=1
            )
            dz_all[:, t] = dz
            into[f"u{side}"] += state.T @ dz
            dstate = dz @ self.p[f"u{side}"].T + np.where(on, 0, total)
            dcell = dfresh * f + np.where(on, 0, dcell)
        into[f"w{side}"] += np.tensordot(x, dz_all, axes=([0, 1], [0, 1]))
        into[f"c{side}"] += dz_all.sum(axis=(0, 1))

    @staticmethod
    def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        time = max(len(p) for p in pages)
        x = np.zeros((len(pages), time, WIDTH), np.float32)
        mask = np.zeros((len(pages), time), bool)
        for n, p in enumerate(pages):
            x[n, : len(p)] = p
            mask[n, : len(p)] = True
        return x, mask

    def predict(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for every block of every page; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((n for n in range(len(pages)) if len(pages[n])), key=lambda n: len(pages[n]))
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and end - start < 128 and (end - start + 1) * len(pages[order[end]]) <= 20_000:
                end += 1
            part = order[start:end]
            x, mask = self._pad([pages[n] for n in part])
            forth, _ = self._walk("f", x, mask)
            back, _ = self._walk("b", x[:, ::-1], mask[:, ::-1])
            z = np.concatenate([forth, back[:, ::-1]], axis=2) @ self.p["v"] + self.p["d"]
            p = 1 / (1 + np.exp(-np.clip(z[..., 0], -30, 30)))
            for row, n in enumerate(part):
                out[n] = p[row, : len(pages[n])]
            start = end
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], rounds: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the mean cross entropy of blocks; pages are shuffled by a fixed seed."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(rounds):
            order = rng.permutation(len(pages))
            order = order[np.argsort([len(pages[n]) // 8 for n in order], kind="stable")]
            starts = rng.permutation(np.arange(0, len(order), batch))
            for start in starts:
                part = order[start : start + batch]
                x, mask = self._pad([pages[n] for n in part])
                y = np.zeros(mask.shape, np.float32)
                for row, n in enumerate(part):
                    y[row, : len(labels[n])] = labels[n]
                forth, kf = self._walk("f", x, mask)
                xb, mb = np.ascontiguousarray(x[:, ::-1]), mask[:, ::-1]
                back, kb = self._walk("b", xb, mb)
                both = np.concatenate([forth, back[:, ::-1]], axis=2)
                z = (both @ self.p["v"] + self.p["d"])[..., 0]
                dz = np.where(mask, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0)[..., None] / mask.sum()
                grads = {k: np.zeros_like(v) for k, v in self.p.items()}
                grads["v"] = np.tensordot(both, dz, axes=([0, 1], [0, 1]))
                grads["d"] = dz.sum(axis=(0, 1))
                dboth = dz @ self.p["v"].T
                self._back("f", x, kf, dboth[:, :, : self.hidden], grads)
                self._back("b", xb, kb, dboth[:, ::-1, self.hidden :], grads)
                step += 1
                norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g**2
                    ahead = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.p[k] = (self.p[k] - rate * ahead).astype(np.float32)


# -- training pages ---------------------------------------------------------------------------------------------------

SAMPLE_PAGES = 300  # pages, about, that the labeller is trained on
SAMPLE_CHARS = 200_000  # longest page of the sample
SAMPLE_BLOCKS = 80  # blocks of one training stretch
VARIANTS = 4  # layouts that each sampled page's text is put into

#: What common page layouts call their parts: (element, class words). Fixed vocabulary.
MAIN_PARTS = (
    ("article", ""), ("main", ""), ("main", "content"), ("div", "content"), ("div", "main content"), ("div", "article body"),
    ("div", "post"), ("div", "post content"), ("div", "entry content"), ("div", "entry"), ("section", "article"),
    ("section", "content"), ("div", "story"), ("div", "story body"), ("div", "text"), ("div", "body"), ("div", ""),
    ("section", ""), ("div", "main"), ("div", "page"), ("article", "post"), ("div", "blog post"), ("", ""),
)
OTHER_PARTS = {
    "menu": (("nav", ""), ("ul", "menu"), ("div", "nav"), ("div", "navbar"), ("div", "menu"), ("div", "navigation"), ("div", "breadcrumb"),
             ("nav", "breadcrumbs"), ("div", "topnav"), ("ul", "nav"), ("div", "pagination"), ("div", "tags"), ("div", "toc")),
    "header": (("header", ""), ("div", "header"), ("div", "banner"), ("header", "site header"), ("div", "masthead"), ("div", "topbar"), ("div", "logo")),
    "footer": (("footer", ""), ("div", "footer"), ("div", "copyright"), ("footer", "site footer"), ("div", "bottom"), ("div", "legal"), ("div", "imprint")),
    "side": (("aside", ""), ("div", "sidebar"), ("aside", "sidebar"), ("div", "widget"), ("div", "related"), ("aside", "related"), ("div", "side"),
             ("div", "recommended"), ("div", "trending"), ("div", "popular"), ("section", "related posts"), ("div", "more"), ("div", "author bio")),
    "notice": (("div", "notice"), ("div", "cookie"), ("div", "cookie notice"), ("div", "cookies"), ("div", "consent"), ("div", "alert"), ("div", "gdpr"),
               ("div", "popup"), ("div", "modal"), ("div", "warning"), ("div", "paywall"), ("div", "announcement"), ("div", "message"), ("dialog", "")),
    "advert": (("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("aside", "ad"), ("div", "sponsored"), ("div", "promo"),
               ("div", "banner ad"), ("section", "promo"), ("div", "adsense"), ("div", "sponsor"), ("ins", "ad")),
    "form": (("form", ""), ("form", "search"), ("form", "newsletter"), ("div", "newsletter"), ("div", "subscribe"), ("form", "login"), ("div", "signup"),
             ("div", "search"), ("form", "contact"), ("fieldset", ""), ("div", "login"), ("div", "share"), ("div", "social")),
    "comments": (("div", "comments"), ("section", "comments"), ("ol", "comment list"), ("div", "comment"), ("div", "replies"), ("div", "reply"),
                 ("ul", "comments"), ("div", "discussion"), ("section", "responses"), ("div", "disqus thread"), ("div", "reader comments"), ("div", "feedback")),
}
_OTHER_WORDS = frozenset(
    w for parts in OTHER_PARTS.values() for tag, words in parts for w in (words.split() or [tag])
) - {"div", "section", "site", "list", "body", "thread", "author", "reader", "posts", "more", "message", "page"}
_MAIN_WORDS = frozenset({"article", "main", "content", "entry", "story", "post"})


def weak_labels(blocks: list[Block]) -> np.ndarray | None:
    """Main or not, by the names of the elements around each block; None where a page names no main part."""
    words = [{w for label in b.path for w in label.split()} for b in blocks]
    main = [bool(w & _MAIN_WORDS) and not (w & _OTHER_WORDS) for w in words]
    return np.array(main, np.float32) if any(main) else None


def lay_out(rng: np.random.Generator, paragraphs: list[str], others: list[str], title: str) -> tuple[list[Block], np.ndarray]:
    """A page of another layout from the same kinds of text: blocks and their labels."""
    blocks: list[Block] = []
    labels: list[float] = []
    outer = [(), ("html", "body"), ("html", "body"), ("html", "body", "div"), ("html", "body", "div wrapper"), ("html", "body", "div container")][rng.integers(6)]

    def text(pool: list[str], most: int) -> str:
        words = pool[rng.integers(len(pool))].split(" ") if pool else ["text"]
        start = int(rng.integers(max(1, len(words) - 3)))
        return " ".join(words[start : start + int(rng.integers(1, most + 1))]) or "text"

    def part(kind: str, inside: tuple[str, ...]) -> None:
        options = OTHER_PARTS[kind]
        tag, words = options[rng.integers(len(options))]
        path = (*inside, f"{tag} {words}".strip())
        count = int(rng.integers(1, {"menu": 9, "comments": 6, "side": 5}.get(kind, 3)))
        for _ in range(count):
            inner = [(), ("p",), ("div",), ("ul", "li"), ("span",), ("h3",), ("div", "p"), ("li",)][rng.integers(8)]
            inner = tuple(x for x in inner if x != "span")
            link = float(rng.random() < {"menu": 0.9, "side": 0.5, "footer": 0.3}.get(kind, 0.1))
            long = {"menu": 3, "comments": 60, "side": 15, "notice": 20, "advert": 15}.get(kind, 12)
            body = text(paragraphs if kind in ("comments", "side") or rng.random() < 0.3 else others or paragraphs, long)
            blocks.append(Block(("© " if kind == "footer" and rng.random() < 0.5 else "") + body, (*path, *inner), link))
            labels.append(0.0)

    kinds = list(OTHER_PARTS)
    for kind in ("menu", "header", "advert", "notice", "side", "form"):
        if rng.random() < 0.4:
            part(kind, outer)
    tag, words = MAIN_PARTS[rng.integers(len(MAIN_PARTS))]
    main = (*outer, f"{tag} {words}".strip()) if tag else outer
    if rng.random() < 0.3 and tag in ("article", "section", "div"):
        main = (*outer, "main", main[-1])
    if rng.random() < 0.7:
        blocks.append(Block(title or "Title", (*main, ("h1", "h2")[rng.integers(2)]), 0.0))
        labels.append(1.0)
    for body in paragraphs:
        shape = [("p",), ("p",), ("p",), (), ("blockquote", "p"), ("ul", "li"), ("div",), ("h2",), ("h3",), ("section", "p"), ("table", "tr", "td"), ("pre",)][rng.integers(12)]
        blocks.append(Block(text([body], 12) if shape[-1:] in (("h2",), ("h3",)) else body, (*main, *shape), float(rng.random() < 0.03)))
        labels.append(1.0)
        if rng.random() < 0.06:
            part(kinds[rng.integers(len(kinds))], main)
    for kind in ("comments", "form", "side", "advert", "menu", "notice"):
        if rng.random() < 0.35:
            part(kind, main if rng.random() < 0.4 else outer)
    if rng.random() < 0.7:
        part("footer", outer)
    return blocks, np.array(labels, np.float32)


def train(pages: list[str], variants: int = VARIANTS, seed: int = 5, most: int = SAMPLE_BLOCKS) -> BlockLabeller:
    """A labeller from raw pages: their own layouts where they name a main part, and ``variants`` others of each."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    read = [read_blocks(p) for p in pages]
    pool = [b.text for blocks in read for b in blocks] or ["text"]
    for blocks in read:
        if not blocks:
            continue
        own = weak_labels(blocks)
        if own is not None:
            # a long page is learned from in stretches of its whole length
            read_as = features(blocks)
            xs += [read_as[i : i + most] for i in range(0, len(blocks), most)]
            ys += [own[i : i + most] for i in range(0, len(blocks), most)]
        main = [b.text for b, y in zip(blocks, own if own is not None else np.ones(len(blocks))) if y]
        rest = [b.text for b, y in zip(blocks, own if own is not None else np.zeros(len(blocks))) if not y]
        for _ in range(variants):
            made, labels = lay_out(rng, main[: int(rng.integers(1, 12))], rest + [pool[rng.integers(len(pool))]], main[0])
            read_as = features(made)
            xs += [read_as[i : i + most] for i in range(0, len(made), most)]
            ys += [labels[i : i + most] for i in range(0, len(made), most)]
    model = BlockLabeller()
    if xs:
        model.fit(xs, ys)
    return model


# -- operator -------------------------------------------------------------------------------------------------------


def extract_main_text(
    pages: DataFrame,
    key: str = "page_id",
    page: str = "html",
    text: str = "text",
    sample_pages: int = SAMPLE_PAGES,
    sample_chars: int = SAMPLE_CHARS,
    sample_blocks: int = SAMPLE_BLOCKS,
) -> DataFrame:
    """``pages`` without ``page`` but with ``text`` (main text, blocks joined by a line feed), ``n_chars`` (its code
    points) and ``n_blocks`` (blocks taken); one row in, one row out, no shuffle.

    Every page is read whole into leaf blocks; a bidirectional LSTM reads each block's tag path (hashed names of the
    elements around it, with their class, id and role words), hashed words and measures, and labels all blocks
    of the page together. The labeller is trained on about ``sample_pages`` pages of at most ``sample_chars`` characters,
    chosen by a hash of the key, in stretches of ``sample_blocks`` blocks, on the driver: their own layouts, labelled by the names of their parts, and other
    layouts made of their text. The sample is bounded, fixed by the keys, and only the labeller depends on it.

    A null, empty or textless page has the text '' and 0 blocks. Repeated rows each get their text. Columns of ``pages``
    with the names of added ones are replaced; all others stay.
    """
    spark = pages.sparkSession
    total = max(pages.count(), 1)
    unit = F.pmod(F.xxhash64(F.col(key), F.lit("blocks")), F.lit(1 << 30)) / float(1 << 30)
    chosen = pages.filter((unit < min(1.0, sample_pages / total)) & (F.length(page) <= sample_chars))
    sample = sorted((r[0], r[1]) for r in chosen.select(F.coalesce(F.col(key).cast("string"), F.lit("")), page).collect())
    model = spark.sparkContext.broadcast(train([html_text for _, html_text in sample], most=sample_blocks))
    added = (text.lower(), "n_chars", "n_blocks")
    kept = [c for c in pages.columns if c.lower() not in added and c.lower() != page.lower()]
    narrow = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{page}`"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]], f"`{text}` string", "n_chars bigint", "n_blocks int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = model.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                read = [read_blocks(p) for p in batch.column(len(kept)).to_pylist()]
                odds = labeller.predict([features(b) for b in read])
                taken = [[b.text for b, p in zip(blocks, probable) if p >= 0.5] for blocks, probable in zip(read, odds)]
                texts = ["\n".join(t) for t in taken]
                made = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, taken), pa.int32())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], [*kept, text, "n_chars", "n_blocks"])

    return narrow.mapInArrow(run, schema)
