"""Best-fit packing: patterns of a few documents, fitted to the length histogram by non-negative least squares.

Stage 1 tokenises every text once and cuts what is longer than a sequence into pieces; the piece table is
small (a row of a few numbers a piece). Stage 2 deals the pieces into shards of bounded size and packs each
shard on its own: enumerate patterns of two to four lengths that fill a sequence, fit repeat counts to the
shard's histogram by non-negative least squares, round down, and place what is left by best fit. A shard
holds tens of thousands of pieces, so packing apart costs at most a few sequences a shard, and neither a
task nor the driver ever holds more than one shard.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.common import materialise, tidy

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"

#: Texts of these characters only can be cut into pre-tokens here; all other texts go to the tokenizer whole.
PLAIN = r"\A[\t\n\r\x20-;=-~À-ÖØ-öø-ÿ]*\z"
#: The vocabulary's own pre-token pattern, over the characters of PLAIN in lower case (fixed by the tokenizer file), but
#: for letter runs: blanks around all others leave just these.
NO_LETTERS = r"('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-zß-öø-ÿ0-9]+)"


class CachedEncoder:
    """The tokenizer's ids of texts, with the ids of recent pre-tokens kept.

    Pre-tokens of this vocabulary never cross white space and are encoded independently, so a text's ids are those of its
    pre-tokens in order. Texts are cut into numbers of distinct pre-tokens by Arrow, and ids are put together as
    arrays. New pre-tokens of a batch go to the tokenizer's model as one text, already normalised and parted, and are
    told apart by the ids that end one. At most most_tokens (or one batch's) pre-tokens are kept; beyond that those of
    the current batch stay, among which are the frequent ones.
    """

    def __init__(self, path: str, most_tokens: int = 600_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.most = most_tokens
        self.number: dict[str, int] = {"": 0}
        self.starts, self.ids = np.zeros(2, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the tokens, and where each token's end."""
        ids = np.asarray(self.model.encode_batch_fast([" ".join(tokens)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(tokens):  # a pre-token that the model parts otherwise: one by one
            each = self._raw(tokens)
            return np.concatenate(each), np.cumsum([len(x) for x in each])
        return ids, ends

    def _numbers(self, tokens: list[str]) -> np.ndarray:
        """The tokens' numbers; new ones are learned."""
        if len(self.number) > self.most:
            kept = ["", *(t for t in tokens if t and t in self.number)]
            at = np.fromiter(map(self.number.__getitem__, kept), dtype=np.int64, count=len(kept))
            self.ids, ends = gather(self.ids, self.starts[at], self.starts[at + 1] - self.starts[at])
            self.number, self.starts = {t: i for i, t in enumerate(kept)}, np.append(0, ends)
        fresh = [t for t in tokens if t not in self.number]
        if fresh:
            ids, ends = self._encode(fresh)
            self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh)), strict=True))
            self.starts = np.concatenate([self.starts, self.starts[-1] + ends])
            self.ids = np.concatenate([self.ids, ids])
        return np.fromiter(map(self.number.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), NO_LETTERS, r" \1 "))
        coded = parts.flatten().dictionary_encode()
        at = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ids, ends = gather(self.ids, self.starts[at], self.starts[at + 1] - self.starts[at])
        return ids, np.append(0, ends)[parts.offsets.to_numpy()[1:]]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls) in order, and where each text's end."""
        plain = pc.match_substring_regex(texts, PLAIN).to_numpy(zero_copy_only=False)
        if plain.all():
            return self._plain(texts)
        ids, ends = self._plain(texts.filter(pa.array(plain)))
        odd = self._raw(texts.filter(pa.array(~plain)).to_pylist())
        starts, sizes, from_odd = np.zeros(len(plain), dtype=np.int64), np.zeros(len(plain), dtype=np.int64), np.array([len(x) for x in odd])
        starts[plain], sizes[plain] = np.append(0, ends)[:-1], np.diff(ends, prepend=0)
        starts[~plain], sizes[~plain] = len(ids) + np.cumsum(from_odd) - from_odd, from_odd
        return gather(np.concatenate([ids, *odd]), starts, sizes)


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values one after another, and where each ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)], ends


def by_size(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most_bytes together; a longer text is a range of its own."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, side="right")))
        yield at, to
        at = to


#: A worker's encoders by file: what one task has learned, the worker's next tasks know.
_ENCODERS: dict[str, CachedEncoder] = {}


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, max_tokens: int = 2048, most_bytes: int = 8_000_000) -> DataFrame:
    """The pieces of every document (doc_id, text): its ids and end_id, cut into max_tokens ids; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = CachedEncoder(tokenizer_path)
        encode = _ENCODERS[tokenizer_path]
        for whole in batches:
            for i, j in by_size(whole.column("text"), most_bytes):
                ids, ends = encode(pc.fill_null(whole.column("text").slice(i, j - i), ""))
                ids = np.insert(ids, ends, end_id).astype("<u4")
                sizes = np.diff(ends, prepend=0) + 1
                pieces = -(-sizes // max_tokens)
                doc = np.repeat(np.arange(j - i), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start, first = piece * max_tokens, (np.cumsum(sizes) - sizes)[doc]
                length = np.minimum(max_tokens, sizes[doc] - start)
                raw, at, to = memoryview(ids.view(np.uint8)), (4 * (first + start)).tolist(), (4 * (first + start + length)).tolist()
                crc = np.fromiter((zlib.crc32(raw[x:y]) for x, y in zip(at, to, strict=True)), dtype=np.int64, count=len(doc))
                columns = [whole.column("doc_id").slice(i, j - i).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])
        tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def patterns(hist: np.ndarray, size: int, per_length: int = 4) -> np.ndarray:
    """Rows of up to four lengths (0: none) that fill a sequence exactly or nearly, from lengths that occur.

    For each length the partners are those that leave least room; then the rest is filled once or twice more.
    """
    have = np.flatnonzero(hist[: size + 1])
    have = have[(have > 0) & (have < size)]
    if not have.size:
        return np.zeros((0, 4), dtype=np.int64)
    out = []
    for parts in (2, 3, 4):
        # Split the sequence into a long length and parts - 1 shares; each share takes the largest length that fits.
        for j in range(per_length):
            room = size - have
            row = [have]
            for k in range(parts - 1):
                share = room if k == parts - 2 else (room * (j + 1)) // (per_length + 1)
                at = np.searchsorted(have, share, side="right") - 1 - (j if parts == 2 else 0)
                pick = np.where(at >= 0, have[np.maximum(at, 0)], 0)
                row.append(pick)
                room = room - pick
            out.append(np.stack(row + [np.zeros_like(have)] * (4 - parts), axis=1))
    rows = np.unique(np.sort(np.concatenate(out), axis=1)[:, ::-1], axis=0)
    room = size - rows.sum(axis=1)
    return rows[(rows[:, 1] > 0) & (room >= 0) & (room <= size // 64)]


def fit_repeats(rows: np.ndarray, hist: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths near the histogram: accelerated projected gradient on |Ax - h|^2."""
    used = rows > 0
    degree = np.bincount(rows[used], minlength=hist.size)
    step = 1.0 / max(1.0, 4.0 * degree.max())
    x = y = np.zeros(len(rows))
    for k in range(rounds):
        fill = np.bincount(rows[used], weights=np.repeat(y, 4).reshape(-1, 4)[used], minlength=hist.size)
        gap = fill - hist
        grad = (gap[rows] * used).sum(axis=1)
        new = np.maximum(0.0, y - step * grad)
        y, x = new + (k / (k + 3.0)) * (new - x), new
    return x


def pack_lengths(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; every sequence holds at most size tokens, gapless from 0."""
    n = len(lengths)
    seq, off = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    bounds = np.searchsorted(lengths[order], np.arange(size + 2))
    left = [order[bounds[v] : bounds[v + 1]].tolist() for v in range(size + 1)]
    hist = np.diff(bounds).astype(np.int64)
    free: list[list[int]] = [[] for _ in range(size + 1)]  # open sequences by the room they have
    used = 0
    for i in left[size]:
        seq[i] = used
        used += 1
    left[size] = []
    hist[size] = 0
    rows = patterns(hist, size)
    if len(rows):
        repeats = np.floor(fit_repeats(rows, hist.astype(np.float64)) + 0.25).astype(np.int64)
        for p in np.lexsort((rows.sum(axis=1), repeats))[::-1]:
            own = [int(v) for v in rows[p] if v]
            for _ in range(int(repeats[p])):
                if any(len(left[v]) < own.count(v) for v in set(own)):
                    break
                at = 0
                for v in own:
                    i = left[v].pop()
                    seq[i], off[i] = used, at
                    at += v
                if at < size:
                    free[size - at].append(used)
                used += 1
    room_of = np.array([len(f) for f in free])
    for v in range(size - 1, 0, -1):
        for i in left[v]:
            fits = np.flatnonzero(room_of[v:])
            if fits.size:
                room = v + int(fits[0])
                s = free[room].pop()
                room_of[room] -= 1
            else:
                room, s = size, used
                used += 1
            seq[i], off[i] = s, size - room
            if room > v:
                free[room - v].append(s)
                room_of[room - v] += 1
    return seq, off


def pack(pieces: DataFrame, shards: int, max_tokens: int = 2048) -> DataFrame:
    """Give every piece a sequence and an offset; pieces are dealt evenly over the shards, whatever their keys are."""

    def run(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        seq, off = pack_lengths(lengths, max_tokens)
        seq = seq + group.column("shard")[0].as_py() * (1 << 32)
        return group.drop_columns(["shard"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))
    return pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(run, PACKED)


def best_fit_pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 0, shard_pieces: int = 40_000) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most max_tokens ids.

    Returns a row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. An empty or null text is
    one piece of one id (the end id). Repeated rows and null ids are pieces like others. An empty table gives no
    rows. Extra columns are ignored. A very long text is tokenised whole; memory follows the longest one.
    """
    pieces = materialise(cut_documents(docs, tokenizer_path, end_id, max_tokens), "pieces")
    return pack(pieces, max(1, math.ceil(pieces.count() / shard_pieces)), max_tokens)
