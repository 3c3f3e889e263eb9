"""Language-model scoring: stupid backoff over corpus-wide count tables.

S(w | h) = c(h w) / c(h) where the bigram h w occurs at least cutoff times in the corpus, else 0.4 * c(w) / N. A
document's score is the sum of log S over its tokens. The tables cover every document.

Tasks take documents in chunks. A chunk counts its distinct words and bigrams and sends each once, packed by hash
bucket, so a word that every document has crosses once a chunk and no bucket grows with its occurrences. A bucket
(one hash partition of the count tables) sums the chunks' counts and answers each chunk for its own n-grams, in
the order asked; the chunk joins the answers to its documents' n-grams and sums per document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.common import materialise, plan_bytes, shuffle_partitions

PACKED = "key long, kind int, bucket long, chunk long, data binary"
SUMS = "doc_id long, n_tokens long, n_backoff long, log_counts double"
CHUNK, ASK, ANSWER = 0, 1, 2
_LOW = np.uint64((1 << 40) - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BYTES_A_TOKEN = 3.5


def _mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (h ^ (h >> np.uint64(31))) * _A + w
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """64-bit hashes of words, kept for recent words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


#: Stands before a document's first token.
BEGIN = np.uint64(xxhash.xxh3_64_intdigest(b"\x00begin"))


def tokens(text: str | None) -> list[bytes]:
    """ASCII white space parts tokens; A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Chunk:
    """Some documents as token numbers: words (distinct hashes, the begin mark last), seq (a number a token), ends (of documents)."""

    def __init__(self, ids: list, words: np.ndarray, seq: np.ndarray, ends: np.ndarray) -> None:
        self.ids, self.words, self.seq, self.ends = ids, words, seq, ends

    @classmethod
    def of(cls, ids: list, hashes: list[np.ndarray]) -> Chunk:
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        words, first, counts = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.argsort(-counts, kind="stable")  # frequent words get small numbers, which pack well
        number = np.empty(len(rank), dtype=np.uint32)
        number[rank] = np.arange(len(rank), dtype=np.uint32)
        return cls(ids, np.append(words[rank], BEGIN), number[first].astype(np.uint32), np.cumsum([len(h) for h in hashes]).astype(np.uint32))

    def pack(self) -> bytes:
        ids = pa.record_batch([pa.array(self.ids, pa.int64())], names=["doc_id"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, ids.schema) as out:
            out.write_batch(ids)
        head = sink.getvalue().to_pybytes()
        wide = 3 if len(self.words) <= 1 << 24 else 4  # bytes of a word's number
        planes = self.seq.view(np.uint8).reshape(-1, 4).T[:wide].tobytes()
        return np.array([len(head), len(self.words), len(self.seq), len(self.ends), wide], dtype="<u4").tobytes() + head + self.words.tobytes() + planes + self.ends.tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> Chunk:
        head, n_words, n_seq, n_docs, wide = np.frombuffer(raw, "<u4", 5).tolist()
        ids = pa.ipc.open_stream(raw[20 : 20 + head]).read_all().column("doc_id").to_pylist()
        at = 20 + head
        words = np.frombuffer(raw, np.uint64, n_words, at)
        at += 8 * n_words
        planes = np.zeros((n_seq, 4), dtype=np.uint8)
        planes[:, :wide] = np.frombuffer(raw, np.uint8, wide * n_seq, at).reshape(wide, -1).T
        return cls(ids, words, planes.view("<u4").ravel(), np.frombuffer(raw[at + wide * n_seq :], np.uint32, n_docs))

    def histories(self) -> np.ndarray:
        """The number of the word before each token."""
        h = np.empty(len(self.seq), dtype=np.uint32)
        h[1:] = self.seq[:-1]
        starts = np.append(0, self.ends[:-1])[np.diff(self.ends, prepend=0) > 0]
        h[starts] = len(self.words) - 1
        return h

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All n-grams of the chunk once: 64-bit keys and counts, words first and then bigrams; and each token's bigram as a number among bigrams."""
        h = self.histories()
        pair = h.astype(np.uint64) << np.uint64(32) | self.seq
        pairs, which, n = np.unique(pair, return_inverse=True, return_counts=True)
        bigram = _mix(self.words[(pairs >> np.uint64(32)).astype(np.int64)], self.words[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)])
        unigram = _mix(np.full(len(self.words), _B), self.words)
        uni_n = np.bincount(self.seq, minlength=len(self.words))
        uni_n[-1] = (np.diff(self.ends, prepend=0) > 0).sum()
        return np.concatenate([unigram, bigram]), np.concatenate([uni_n, n]), which

    @staticmethod
    def buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Each key's bucket, and the order in which buckets hold a chunk's keys."""
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        return bucket, np.argsort(bucket, kind="stable")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "kind", "bucket", "chunk", "data"])


def _ask(chunk: int, buckets: int, made: Chunk) -> Iterator[pa.RecordBatch]:
    yield _rows([(-1 - chunk, CHUNK, 0, chunk, made.pack())])
    keys, counts, _ = made.grams()
    if not made.seq.size:
        return
    bucket, order = Chunk.buckets(keys, buckets)
    bucket, low, counts = bucket[order], keys[order] & _LOW, counts[order].astype(np.uint32)
    cuts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1))).tolist()
    rows = []
    for i, j in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        k, n = low[i:j], counts[i:j]
        more = np.flatnonzero(n != 1).astype(np.uint32)
        data = np.array([j - i], dtype="<u4").tobytes() + k.astype(np.uint32).tobytes() + (k >> np.uint64(32)).astype(np.uint8).tobytes() + more.tobytes() + n[more].tobytes()
        rows.append((int(bucket[i]), ASK, int(bucket[i]), chunk, data))
    yield _rows(rows)


def _asked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    key = np.frombuffer(raw, np.uint32, n, 4).astype(np.uint64) | (np.frombuffer(raw, np.uint8, n, 4 + 4 * n).astype(np.uint64) << np.uint64(32))
    more = np.frombuffer(raw[4 + 5 * n :], np.uint32).reshape(2, -1)
    counts = np.ones(n, dtype=np.int64)
    counts[more[0]] = more[1]
    return key, counts


def _answer(table: pa.Table) -> pa.Table:
    """One hash partition of the count tables: sum the counts asked about, and answer every chunk in its order."""
    if table.column("key")[0].as_py() < 0:
        return table
    asked = [_asked(x) for x in table.column("data").to_pylist()]
    key = np.concatenate([k for k, _ in asked])
    distinct, which = np.unique(key, return_inverse=True)
    total = np.bincount(which, weights=np.concatenate([n for _, n in asked]), minlength=len(distinct)).astype(np.int64)[which]
    rows, at = [], 0
    for bucket, chunk, (k, _) in zip(table.column("bucket").to_pylist(), table.column("chunk").to_pylist(), asked, strict=True):
        rows.append((-1 - chunk, ANSWER, bucket, chunk, zlib.compress(total[at : at + len(k)].tobytes(), 1)))
        at += len(k)
    return pa.Table.from_batches([_rows(rows)])


def _score(buckets: int, cutoff: int):
    def run(table: pa.Table) -> pa.Table:
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        chunk = Chunk.unpack(next(d for k, d in zip(kinds, data, strict=True) if k == CHUNK))
        keys, _, which = chunk.grams()
        answers = {b: d for k, b, d in zip(kinds, table.column("bucket").to_pylist(), data, strict=True) if k == ANSWER}
        logs, known = np.zeros(len(chunk.seq)), np.zeros(len(chunk.seq), dtype=bool)
        if chunk.seq.size:
            _, order = Chunk.buckets(keys, buckets)
            total = np.empty(len(keys), dtype=np.int64)
            total[order] = np.concatenate([np.frombuffer(zlib.decompress(answers[b]), np.int64) for b in sorted(answers)])
            uni, bi = total[: len(chunk.words)], total[len(chunk.words) :][which]
            known = bi >= cutoff
            logs = np.where(known, np.log(bi) - np.log(np.maximum(1, uni[chunk.histories()])), np.log(uni[chunk.seq]))
        doc = np.repeat(np.arange(len(chunk.ends)), np.diff(chunk.ends, prepend=0))
        n = len(chunk.ends)
        return pa.table(
            {
                "doc_id": pa.array(chunk.ids, pa.int64()),
                "n_tokens": pa.array(np.diff(chunk.ends, prepend=0).astype(np.int64)),
                "n_backoff": pa.array(np.bincount(doc, weights=~known, minlength=n).astype(np.int64)),
                "log_counts": pa.array(np.bincount(doc, weights=logs, minlength=n).astype(np.float64)),
            }
        )

    return run


def stupid_backoff(docs: DataFrame, alpha: float = 0.4, cutoff: int = 2, chunk_docs: int = 8192, chunk_tokens: int = 1_500_000, bucket_grams: int = 4_000_000) -> DataFrame:
    """Scores of all documents (doc_id, text) under the bigram tables of all documents.

    Returns doc_id, n_tokens, n_backoff (tokens scored by their unigram), log_score (sum of natural logs) and
    mean_log_score. A text without tokens (or null) has log_score 0 and mean null, and adds nothing to the tables.
    Rows with a repeated or null doc_id are documents of their own. Other columns are ignored; an empty table gives
    no rows. Counts are exact up to collisions of 40-bit hashes within a bucket. The number of buckets follows the
    input, so none grows with it. A very long text is one chunk, whole; memory follows the longest one.
    """
    buckets = max(shuffle_partitions(docs), math.ceil(plan_bytes(docs) / BYTES_A_TOKEN / bucket_grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chunk = _Words(), TaskContext.get().partitionId() << 24
        ids, hashes, total = [], [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                some = whole.slice(at, 256)
                for doc, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    if ids and (len(ids) >= chunk_docs or total >= chunk_tokens):
                        yield from _ask(chunk, buckets, Chunk.of(ids, hashes))
                        chunk, ids, hashes, total = chunk + 1, [], [], 0
                    parts = tokens(text)
                    ids.append(doc)
                    hashes.append(np.fromiter(map(words.__getitem__, parts), dtype=np.uint64, count=len(parts)))
                    total += len(parts)
        if ids:
            yield from _ask(chunk, buckets, Chunk.of(ids, hashes))

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PACKED)
    answered = asked.groupBy("key").applyInArrow(_answer, PACKED)
    sums = materialise(answered.groupBy("chunk").applyInArrow(_score(buckets, cutoff), SUMS), "scores")
    tokens_all = sums.agg(F.sum("n_tokens")).first()[0] or 1
    log_score = F.col("log_counts") + F.col("n_backoff") * F.lit(math.log(alpha) - math.log(max(1, tokens_all)))
    return sums.select(
        "doc_id", "n_tokens", "n_backoff", F.round(log_score, 4).alias("log_score"),
        F.when(F.col("n_tokens") > 0, F.round(log_score / F.col("n_tokens"), 6)).alias("mean_log_score"),
    )
