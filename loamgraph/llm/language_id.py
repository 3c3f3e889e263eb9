"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. A word's probability is the sum over all
its segmentations into pieces of the product of their probabilities (forward algorithm); a text's is the product
over its words. Piece probabilities are fitted by expectation maximisation with the same sums, on a bounded
sample. Words are scored in batches as arrays, and recent words' scores are kept, so the cost follows the
distinct words. Scoring needs no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm import common

#: A word: letters with the marks that belong to them.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
START = "▁"
UNKNOWN = 1e-8
UNDETERMINED = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ c) * _MIX
    return h ^ (h >> np.uint64(29))


@dataclass
class Pieces:
    """A vocabulary's pieces by rolling hash, for lookups of many substrings at once."""

    names: list[str]
    longest: int = 16
    tables: list[tuple[np.ndarray, np.ndarray, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        h = np.zeros(len(self.names), dtype=np.uint64)
        for i, name in enumerate(self.names):
            x = np.zeros(1, dtype=np.uint64)
            for c in name:
                x = _step(x, np.array([ord(c)], dtype=np.uint64))
            h[i] = x[0]
        rest = np.arange(len(h))
        for shift in (44, 24, 4):  # what collides in one table goes to the next
            slot = ((h[rest] >> np.uint64(shift)) & np.uint64((1 << 20) - 1)).astype(np.int64)
            _, at = np.unique(slot, return_index=True)
            keys, ids = np.zeros(1 << 20, dtype=np.uint64), np.full(1 << 20, -1, dtype=np.int32)
            keys[slot[at]], ids[slot[at]] = h[rest[at]], rest[at]
            self.tables.append((keys, ids, shift))
            rest = np.delete(rest, at)
            if not rest.size:
                break

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes; -1: none."""
        out = np.full(len(h), -1, dtype=np.int32)
        for keys, ids, shift in self.tables:
            slot = ((h >> np.uint64(shift)) & np.uint64((1 << 20) - 1)).astype(np.int64)
            out = np.where((keys[slot] == h) & (ids[slot] >= 0), ids[slot], out)
        return out


def vocabulary(model_file: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, in lower case, each once."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    names = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p for p in names if p == p.lower() and len(p) <= 16})


def units(token: str) -> list[str]:
    """The scored units of a token: its words, whole, with a start mark before each."""
    return [START + word for word in LETTERS.findall(token)]


def codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length: a row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), -1).astype(np.uint64)


def ending(pieces: Pieces, chars: np.ndarray) -> Iterator[np.ndarray]:
    """For each end 1, 2, ...: the piece numbers (-1: none) of the spans of words that end there, the longest first."""
    h = np.zeros((len(chars), 0), dtype=np.uint64)
    for j in range(chars.shape[1]):
        h = _step(np.concatenate([h[:, -(pieces.longest - 1) :], np.zeros((len(chars), 1), dtype=np.uint64)], axis=1), chars[:, j : j + 1])
        yield pieces.find(h.ravel()).reshape(h.shape)


def _probs(found: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Probabilities of the spans that end at one place; a character that is no piece by itself has a small one."""
    at = np.where((found >= 0)[..., None], probs[found], 0.0)
    at[:, -1] = np.where((found[:, -1] >= 0)[:, None], at[:, -1], UNKNOWN)
    return at


def forward(pieces: Pieces, chars: np.ndarray, probs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The forward algorithm, an end at a time: found, their probabilities, sums of the last ends (the newest last), log scale.

    A sum is that of all segmentations up to its end, divided by exp(log scale); the scale follows the sums, so words of
    any length stay within the range of a double, and only the last few ends are held.
    """
    sums = np.ones((len(chars), 1, probs.shape[1]))
    scale = np.zeros((len(chars), probs.shape[1]))
    for j, found in enumerate(ending(pieces, chars)):
        at = _probs(found, probs)
        sums = np.concatenate([sums[:, -(pieces.longest - 1) :], (sums[:, -at.shape[1] :] * at).sum(axis=1, keepdims=True)], axis=1)
        if j % 8 == 7:
            top = sums.max(axis=1)
            sums, scale = sums / top[:, None], scale + np.log(top)
        yield found, at, sums, scale


def by_length(words: Iterable[str], batch: int) -> Iterator[list[str]]:
    """Batches of words of one length, of about batch words of usual length; longer words go in smaller batches."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for n, same in groups.items():
        size = max(1, batch * 16 // max(16, n))
        for k in range(0, len(same), size):
            yield same[k : k + size]


def word_scores(pieces: Pieces, words: list[str], probs: np.ndarray, batch: int = 2048) -> np.ndarray:
    """Log probability of each unit (rows) in each language (columns): all segmentations summed."""
    out = np.zeros((len(words), probs.shape[1]))
    number = {w: i for i, w in enumerate(words)}
    for some in by_length(number, batch):
        for _, _, sums, scale in forward(pieces, codes(some), probs):
            pass
        out[[number[w] for w in some]] = np.log(sums[:, -1]) + scale
    return out[[number[w] for w in words]]


def expected_counts(pieces: Pieces, counts: Counter, probs: np.ndarray, batch: int = 2048) -> np.ndarray:
    """Expected number of each piece over all segmentations of the counted units, under one distribution (a column)."""
    total = np.zeros(len(pieces.names))
    for some in by_length(sorted(counts), batch):
        steps = list(forward(pieces, codes(some), probs))
        n, weight = len(steps), np.array([counts[w] for w in some])[:, None]
        ends = [(np.ones((len(some), 1)), np.zeros((len(some), 1))), *((sums[:, -1], scale) for _, _, sums, scale in steps)]
        whole = np.log(ends[n][0]) + ends[n][1]
        back: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros((len(some), 1)), np.zeros((len(some), 1)))] * n + [(np.ones((len(some), 1)), np.zeros((len(some), 1)))]
        for j in range(n, 0, -1):  # all that end at j have their sum of what follows when j is reached
            found, at, _, _ = steps[j - 1]
            rest, rest_scale = back[j]
            for k in range(at.shape[1]):
                i = j - at.shape[1] + k
                gain = at[:, k] * rest
                old, old_scale = back[i]
                scale = np.where(old > 0, np.maximum(old_scale, rest_scale), rest_scale)
                new = old * np.exp(np.minimum(0.0, old_scale - scale)) + gain * np.exp(np.minimum(0.0, rest_scale - scale))
                back[i] = (new, scale)
                has = found[:, k] >= 0
                if has.any():
                    share = ends[i][0] * gain * np.exp(ends[i][1] + rest_scale - whole) * weight
                    total += np.bincount(found[has, k], weights=share[has, 0], minlength=len(total))
            if (j - 1) % 8 == 0:
                for i in range(max(0, j - pieces.longest), j):
                    v, sc = back[i]
                    ok = np.where(v > 0, v, 1.0)
                    back[i] = (v / ok, sc + np.log(ok))
    return total


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    names: list[str]
    probs: np.ndarray


def fit(texts: dict[str, list[str]], names: list[str], rounds: int = 4, smoothing: float = 0.1) -> Model:
    """Fit one distribution a language by expectation maximisation; smoothed by the languages' mean and the uniform one."""
    pieces = Pieces(names)
    languages = tuple(sorted(texts))
    counted = [Counter(u for t in texts[k] for tok in t.lower().split() for u in units(tok)) for k in languages]
    probs = np.full((len(names), len(languages)), 1.0 / max(1, len(names)))
    for _ in range(rounds):
        for k, counts in enumerate(counted):
            c = expected_counts(pieces, counts, probs[:, k : k + 1])
            probs[:, k] = (c + 1e-3) / (c.sum() + 1e-3 * len(names))
    mean = probs.mean(axis=1, keepdims=True) if languages else probs
    return Model(languages, names, (1 - smoothing) * probs + smoothing * mean)


class Scorer:
    """Log probabilities of texts in each language; scores of recent tokens are kept (at most most_tokens)."""

    def __init__(self, model: Model, most_tokens: int = 150_000) -> None:
        self.model, self.pieces, self.most = model, Pieces(model.names), most_tokens
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages) + 1))

    def _learn(self, new: list[str]) -> None:
        cut = [units(t) for t in new]
        distinct = sorted({u for us in cut for u in us})
        number = {u: i for i, u in enumerate(distinct)}
        scores = word_scores(self.pieces, distinct, self.model.probs)
        first = len(self.known)
        while len(self.rows) < first + len(new):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        sizes = np.array([len(us) for us in cut])
        owner = np.repeat(np.arange(first, first + len(new)), sizes)
        at = np.array([number[u] for us in cut for u in us], dtype=np.int64)
        self.rows[first : first + len(new)] = 0.0
        np.add.at(self.rows[:, :-1], owner, scores[at])
        self.rows[first : first + len(new), -1] = sizes
        self.known.update((t, first + i) for i, t in enumerate(new))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """A row a text: log probability in each language, then the number of scored units."""
        cut = [(t or "").lower().split() for t in texts]
        if len(self.known) > self.most:
            self._clear()
        new = list(set().union(*cut).difference(self.known))
        if new:
            self._learn(new)
        get = self.known.__getitem__
        out = np.zeros((len(texts), self.rows.shape[1]))
        for i, words in enumerate(cut):
            if words:
                out[i] = self.rows[np.fromiter(map(get, words), dtype=np.int64, count=len(words))].sum(axis=0)
        return out


def fit_on(docs: DataFrame, model_file: str, most_docs: int = 300) -> Model:
    """Fit on about most_docs distinct texts (text, lang) a language, chosen by a hash of the text, alike in every run.

    Rows without text or language are left out, and copies of a text in a language count once, so neither the choice
    nor the sample's number of texts follows them. Texts drawn are learned from whole. A language
    that no text was drawn for is an error. The model holds a probability a piece and language.
    """
    own = docs.where("text is not null and lang is not null").select("text", "lang")
    counts = own.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")).withColumn("share", (F.least(F.lit(1.0), F.lit(most_docs) / F.col("n")) * F.lit(1 << 30)).cast("long"))
    shares = counts.select(F.col("lang").alias("known"), "share").collect()
    if not shares:
        return Model((), vocabulary(model_file), np.zeros((1, 0)))
    drawn = own.join(F.broadcast(docs.sparkSession.createDataFrame(shares)), F.col("lang") == F.col("known")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("share"))
    texts: dict[str, list[str]] = {r["known"]: [] for r in shares}
    for r in drawn.select("lang", "text").distinct().collect():
        texts[r["lang"]].append(r["text"])
    if missing := sorted(k for k, v in texts.items() if not v):
        raise ValueError(f"no text drawn for {', '.join(missing)}; most_docs {most_docs} is too small")
    return fit({k: sorted(v) for k, v in texts.items()}, vocabulary(model_file))


def annotate(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score (posterior of lang_pred, equal priors), from each whole text, or by other names.

    und (score 0) where the text is null or has no letter, or no language was learned. Ties go to the first
    language by name. Input columns of these two names are replaced. Texts and words of any length are scored whole;
    memory follows the longest text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        score = Scorer(own) if own.languages else None

        def run(texts: list[str | None]) -> list[pa.Array]:
            if score is None:
                return [pa.array([UNDETERMINED] * len(texts), pa.string()), pa.array([0.0] * len(texts), pa.float64())]
            out = score(texts)
            ll, scored = out[:, :-1], out[:, -1]
            best = np.where(scored > 0, np.round(1.0 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1), 9), 0.0)
            langs = [own.languages[k] if u > 0 else UNDETERMINED for k, u in zip(ll.argmax(axis=1), scored, strict=True)]
            return [pa.array(langs, pa.string()), pa.array(best, pa.float64())]

        return run

    return common.annotate(docs, make, [(names[0], "string"), (names[1], "double")])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every document (doc_id, text), as annotate() gives them.

    Repeated rows keep a result each; other columns are ignored; an empty table gives no rows.
    """
    return annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text")


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows of docs, all their columns unchanged, whose language is determined with at least least_score."""
    lang, score = common.free_names(docs, "lang_pred", "score")
    return annotate(docs, model, (lang, score)).where((F.col(lang) != UNDETERMINED) & (F.col(score) >= least_score)).select(*docs.columns)
