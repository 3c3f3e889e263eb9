"""Main-text extraction by a recurrent block labeller.

A page becomes its sequence of leaf blocks (text between block-level tags, with the path of open elements). Each
block is a vector: hashed tokens of its tag path (tags, class and id words), hashed words of its text, and a few
numbers. A bidirectional LSTM in numpy reads the whole sequence, of any length, and labels every block as main
text or not, so a block's label depends on all of the page. The weights are fitted by html_train.py.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Comments, elements of raw text (to the end of the page if not closed), tags, declarations, and tags in which a quote is never closed: these end
#: at their first ">". An element's name ends at white space, "/" or ">".
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|iframe|textarea|title)(?=[\s/>])[^>]*(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?=[\s/>\"'])([^<>]*)>|</[^>]*>",
    re.S | re.I,
)
#: Other elements whose content is no text, with their ends. Where no end follows, the tag alone is left out.
SKIPPED = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("template", "svg", "object", "canvas", "audio", "video", "datalist")}
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[a-z]+", re.I)
CAMEL = re.compile(r"([a-z])([A-Z])")

#: Tags by how they bound text. Fixed values (HTML standard).
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr acronym".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A new element of the key's kind ends an open one of the listed kinds, up to the listed container.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",)), "option": (("option",), ("select",))}

PATH_SLOTS, WORD_SLOTS, NUMBERS = 1024, 1024, 8
#: A block's path names its outermost elements, about so many tokens of them, and its own tag: the labeller's view of very deep pages. Text is never cut.
PATH_TOKENS = 400


class Block:
    """A leaf block: text, the path's tokens, and how many of its characters are in links."""

    __slots__ = ("linked", "path", "tag", "text")

    def __init__(self, text: str, path: tuple[str, ...], tag: str, linked: int) -> None:
        self.text, self.path, self.tag, self.linked = text, path, tag, linked


def _names(attributes: str) -> tuple[str, ...]:
    """The words of class, id and role; a long word also gives its beginning."""
    out = []
    if "=" in attributes:
        for m in NAMED.finditer(attributes):
            value = CAMEL.sub(r"\1 \2", m[1] or m[2] or m[3] or "")
            for w in PARTS.findall(value):
                w = w.lower()
                out.append("." + w)
                if len(w) > 5:
                    out.append("." + w[:5] + "~")
    return tuple(out)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, with character references decoded and white space collapsed."""
    out: list[Block] = []
    page = page or ""
    stack: list[tuple[str, tuple[str, ...]]] = []
    path: tuple[str, ...] = ()
    paths: list[tuple[str, ...]] = [()]
    text: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                out.append(Block(words, path, stack[-1][0] if stack else "", linked))
            text.clear()
        linked = 0

    def pop_to(n: int) -> None:
        nonlocal path
        for gone, _ in stack[n:]:
            opened[gone] -= 1
        del stack[n:], paths[n + 1 :]
        path = paths[-1]

    at = 0
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()
    while m := TOKEN.search(page, at):
        if m.start() > at:
            part = page[at : m.start()]
            text.append(html.unescape(part))  # a reference does not reach over a tag
            if links:
                linked += len(part)
        at = m.end()
        ends, tag, attributes = m.group(2, 3, 4) if m[6] is None else m.group(5, 6, 7)
        if tag is None:
            if m[1]:
                flush()
            continue
        tag = tag.lower()
        if tag in SKIPPED and not ends:
            if not attributes.endswith("/") and tag not in unclosed:
                if end := SKIPPED[tag].search(page, at):
                    at = end.end()
                else:
                    unclosed.add(tag)  # nor does an end follow any later one
            if tag != "svg":
                flush()
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if ends else 1
            continue
        flush()
        if ends:
            if opened[tag]:
                pop_to(max(k for k in range(len(stack)) if stack[k][0] == tag) if stack[-1][0] != tag else len(stack) - 1)
                links = 0
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] not in ("b", "i"):
                    break
        if tag in ENDS:
            kinds, until = ENDS[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in until:
                    break
                if stack[k][0] in kinds:
                    pop_to(k)
                    break
        if tag in VOID or (attributes or "").endswith("/"):
            continue
        own = (tag, *_names(attributes or ""))
        stack.append((tag, own))
        opened[tag] += 1
        path = path + own if len(path) < PATH_TOKENS else path
        paths.append(path)
    if at < len(page):
        rest = page[at:]
        cut = rest.rfind("<")
        text.append(html.unescape(rest[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z!]", rest[cut:]) else rest))  # a tag cut off by the end
    flush()
    return out


class Slots(dict):
    """Hashed slots of tokens, kept for recent tokens."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size = size

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        k = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % self.size
        return k


def numbers(b: Block) -> list[float]:
    n = len(b.text)
    words = b.text.count(" ") + 1
    ends = b.text[-1]
    return [
        min(1.0, np.log1p(n) / 8), min(1.0, np.log1p(words) / 6), min(1.0, b.linked / max(1, n)), float(ends in ".!?…\"'”"), min(1.0, 10.0 * sum(map(b.text.count, ".,;:")) / max(1, n)),
        float(b.tag in ("p", "blockquote", "pre")), float(b.tag[:1] == "h" and b.tag[1:].isdigit()), float(b.tag in ("li", "td", "th", "dd", "dt")),
    ]


def features(pages: list[list[Block]], path_slots: Slots, word_slots: Slots) -> tuple[np.ndarray, ...]:
    """Flat features of all blocks: slots and ends of path tokens and of words, and the numbers."""
    get_p, get_w = path_slots.__getitem__, word_slots.__getitem__
    p, w, pe, we, num = [], [], [], [], []
    for page in pages:
        for b in page:
            p += map(get_p, b.path)
            p.append(get_p("^" + b.tag))
            w += map(get_w, b.text.lower().split())
            pe.append(len(p))
            we.append(len(w))
            num.append(numbers(b))
    return np.array(p, np.int32), np.array(pe, np.int64), np.array(w, np.int32), np.array(we, np.int64), np.array(num, np.float32).reshape(-1, NUMBERS)


def bag(table: np.ndarray, slots: np.ndarray, ends: np.ndarray, mean: bool) -> np.ndarray:
    """Sums (over the root of the count) or means of table rows for each run of slots."""
    starts = np.append(0, ends[:-1])
    out = np.zeros((len(ends), table.shape[1]), dtype=np.float32)
    for k in range(0, len(ends), 4096):
        lo, hi = starts[k], ends[min(len(ends), k + 4096) - 1]
        if hi > lo:
            sums = np.concatenate([np.zeros((1, table.shape[1]), np.float64), np.cumsum(table[slots[lo:hi]], axis=0, dtype=np.float64)])
            out[k : k + 4096] = sums[ends[k : k + 4096] - lo] - sums[starts[k : k + 4096] - lo]
    n = np.maximum(1, ends - starts)[:, None]
    return out / (n if mean else np.sqrt(n))


def lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Hidden states (batch, time, units) of one direction; beyond a sequence's end the state stays."""
    batch, steps, _ = x.shape
    units = wh.shape[0]
    h, c = np.zeros((batch, units), np.float32), np.zeros((batch, units), np.float32)
    z = x @ wx + b
    out = np.empty((batch, steps, units), np.float32)
    for t in range(steps):
        a = z[:, t] + h @ wh
        gate = 1 / (1 + np.exp(-a[:, : 3 * units]))
        new = gate[:, units : 2 * units] * c + gate[:, :units] * np.tanh(a[:, 3 * units :])
        live = mask[:, t : t + 1]
        c = np.where(live, new, c)
        h = np.where(live, gate[:, 2 * units :] * np.tanh(new), h)
        out[:, t] = h
    return out


class Labeller:
    """Probability of main text for every block of pages."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights
        self.path_slots, self.word_slots = Slots(PATH_SLOTS), Slots(WORD_SLOTS)

    def inputs(self, pages: list[list[Block]]) -> np.ndarray:
        p, pe, words, we, num = features(pages, self.path_slots, self.word_slots)
        return np.concatenate([bag(self.w["path"], p, pe, False), bag(self.w["word"], words, we, True), num], axis=1)

    def __call__(self, pages: list[list[Block]], cells: int = 20_000) -> list[np.ndarray]:
        """Pages of like length are run together, at most about cells blocks (with padding) at once."""
        sizes = [len(p) for p in pages]
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=sizes.__getitem__) if sizes[i]]
        while order:
            longest = sizes[order[-1]]
            some = order[-max(1, cells // longest) :]
            del order[-len(some) :]
            flat = self.inputs([pages[i] for i in some])
            x = np.zeros((len(some), longest, flat.shape[1]), np.float32)
            mask = np.arange(longest)[None, :] < np.array([sizes[i] for i in some])[:, None]
            x[mask] = flat
            fwd = lstm(x, self.w["f_wx"], self.w["f_wh"], self.w["f_b"], mask)
            bwd = lstm(x[:, ::-1], self.w["b_wx"], self.w["b_wh"], self.w["b_b"], mask[:, ::-1])[:, ::-1]
            z = fwd @ self.w["o_f"] + bwd @ self.w["o_b"] + x @ self.w["o_x"] + self.w["o"]
            prob = 1 / (1 + np.exp(-z))
            for k, i in enumerate(some):
                out[i] = prob[k, : sizes[i]]
        return out


def load_weights(file: str | None = None) -> dict[str, np.ndarray]:
    """The fitted weights beside this module, or another file of the same form."""
    with np.load(file or Path(__file__).with_name("html_weights.npz")) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def extract(pages: DataFrame, weights: dict[str, np.ndarray] | None = None, threshold: float = 0.5, batch_chars: int = 2_000_000) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page (page_id, url, html).

    text joins the blocks labelled as main text by single spaces, in page order; it is empty for a null or empty
    html or where no block is main text. Broken markup is read as far as it goes. Repeated rows keep a result
    each; other columns are ignored; an empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(load_weights() if weights is None else weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(shared.value)

        def told(rows: list[tuple], made: list[list[Block]]) -> pa.RecordBatch:
            texts = [" ".join(b.text for b, p in zip(bs, ps, strict=True) if p >= threshold) for bs, ps in zip(made, label(made), strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

        rows, made, chars = [], [], 0
        for batch in batches:
            for row in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), strict=True):
                page = row[2].as_py()
                rows.append(row[:2])
                made.append(blocks(page))
                chars += len(page or "")
                if chars >= batch_chars:
                    yield told(rows, made)
                    rows, made, chars = [], [], 0
        if rows:
            yield told(rows, made)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
