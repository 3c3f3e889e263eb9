"""Exact Jaccard self-join of documents on word shingles, reported as components.

1. Each task cuts its documents into shingle sets and folds copies of a set within a chunk of documents. The
   chunks' shingle hashes travel once, packed by hash bucket: a bucket counts each shingle's documents and sends
   back only shingles that two or more documents have. A chunk sends a shingle once, however many of its documents
   have it, so a passage that a third of all documents share makes no large bucket. A shingle of one document can
   never link anything; it only counts among that document's first, rarest elements.
2. Rare-first prefix filter: with its shingles ordered by (document frequency, hash), a set of n shingles needs
   only the first n - ceil(0.75 n) + 1 as prefix. Sets that share no prefix shingle cannot link.
3. Links are wanted up to connectivity, so the sets with one prefix shingle are first compared with their least
   set, the pivot (linear in the entries, after the length and positional filters). Shingles whose sets are then
   still in different components are examined whole: sets that meet at one pivot, in blocks of bounded size and
   like lengths. Within two blocks, pairs come from the prefix shingles they share, pass the length and suffix
   filters as vector operations, and are verified on the whole sets in place. A pair belongs to the pivot of the
   first prefix shingle that both sets have, and pairs that were compared as set and pivot are left out, so each
   pair is verified once. The suffix filter bounds an overlap by the sets' bit signatures over hash classes.

Pairs are never emitted, only links between components that are still apart. No candidate is capped, and the result
is exact up to collisions of hashes of at least 40 bits within one pair of documents. What a hot pivot costs grows
with the square of its blocks of sets of like lengths that lie in different components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.common import free_names, materialise, plan_bytes, shuffle_partitions, tidy
from loamgraph.llm.components import connected_components

LOW = np.uint64((1 << 40) - 1)
#: Compressed bytes a shingle of input takes, about; only sizes the buckets.
BYTES_A_SHINGLE = 3.5
PACKED = "bucket long, chunk long, data binary"
DOCS = "doc_id long, row_hash long, digest binary, n long, unique_n long, keys array<long>, prefix int, signature binary"


class WordHashes(dict):
    """64-bit hashes of words, kept for recent words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingle_hashes(text: str | None, words: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; ASCII letters in lower case, words parted by ASCII white space."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(parts) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts))], dtype=np.uint64) if parts else np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(words.__getitem__, parts), dtype=np.uint64, count=len(parts))
    n = len(w) - size + 1
    h = w[:n] * _MULTIPLIERS[0]
    for k in range(1, size):
        h ^= h >> np.uint64(29)
        h = (h + w[k : n + k]) * _MULTIPLIERS[k % 8]
    h ^= h >> np.uint64(32)
    return np.unique(h)


def _pack_chunk(chunk: int, buckets: int, ids: list[tuple], sets: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """A chunk's rows: one with its documents, and one a bucket with the hashes of its distinct sets."""
    digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
    first: dict[bytes, int] = {}
    for i, d in enumerate(digests):
        first.setdefault(d, i)
    own = np.array([first[d] == i for i, d in enumerate(digests)])
    flat = np.concatenate([s for s, o in zip(sets, own, strict=True) if o] or [np.zeros(0, np.uint64)])
    keys, first_at, inverse, counts = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
    by_first = np.argsort(first_at, kind="stable")  # shingles are numbered as they first occur, so only recurrences must be kept
    number = np.empty(len(keys), dtype=np.uint32)
    number[by_first] = np.arange(len(keys), dtype=np.uint32)
    keys, counts, stream = keys[by_first], counts[by_first], number[inverse]
    again = np.ones(len(flat), dtype=bool)
    again[first_at] = False
    meta = pa.table({"doc_id": pa.array([i for i, _ in ids], pa.int64()), "row_hash": pa.array([h for _, h in ids], pa.int64()), "digest": pa.array(digests, pa.binary()), "n": pa.array([len(s) for s in sets], pa.int64()), "own": pa.array(own)})
    where = np.flatnonzero(again).astype(np.uint32)
    sink = pa.BufferOutputStream()
    sink.write(np.array([len(where)], dtype="<u4").tobytes() + where.tobytes() + stream[where].tobytes())
    with pa.ipc.new_stream(sink, meta.schema) as out:
        out.write_table(meta)
    yield -1 - chunk, chunk, sink.getvalue().to_pybytes()
    if not flat.size:
        return
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 65536 else bucket, kind="stable")
    bucket, low, counts = bucket[order], keys[order] & LOW, counts[order].astype(np.uint32)
    number = order.astype(np.uint32)
    cuts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1))).tolist()
    wide = 3 if len(keys) <= 1 << 24 else 4  # bytes of a number
    for i, j in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        k, n = low[i:j], counts[i:j]
        more = np.flatnonzero(n > 1).astype(np.uint32)
        planes = number[i:j].view(np.uint8).reshape(-1, 4).T[:wide]
        parts = (np.array([j - i, wide], dtype="<u4"), k.astype(np.uint32), (k >> np.uint64(32)).astype(np.uint8), planes, more, n[more])
        yield int(bucket[i]), chunk, b"".join(x.tobytes() for x in parts)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, ["bucket", "chunk", "data"], [pa.int64(), pa.int64(), pa.binary()])


def _asked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's hashes in a bucket, their numbers in the chunk, and in how many of its sets each is."""
    n, wide = np.frombuffer(raw, "<u4", 2).tolist()
    key = np.frombuffer(raw, np.uint32, n, 8).astype(np.uint64) | (np.frombuffer(raw, np.uint8, n, 8 + 4 * n).astype(np.uint64) << np.uint64(32))
    planes = np.zeros((n, 4), dtype=np.uint8)
    planes[:, :wide] = np.frombuffer(raw, np.uint8, wide * n, 8 + 5 * n).reshape(wide, -1).T
    more = np.frombuffer(raw[8 + (5 + wide) * n :], np.uint32).reshape(2, -1)
    counts = np.ones(n, dtype=np.int64)
    counts[more[0]] = more[1]
    return key, planes.view("<u4").ravel(), counts


def _count_bucket(table: pa.Table) -> pa.Table:
    """Of a bucket's hashes, those that two or more sets have, by chunk, with their document frequency."""
    bucket = table.column("bucket")[0].as_py()
    if bucket < 0:
        return table
    chunks = table.column("chunk").to_pylist()
    asked = [_asked(x) for x in table.column("data").to_pylist()]
    distinct, which = np.unique(np.concatenate([k for k, _, _ in asked]), return_inverse=True)
    df = np.bincount(which, weights=np.concatenate([n for _, _, n in asked]), minlength=len(distinct)).astype(np.int64)[which]
    rows, at = [], 0
    for chunk, (k, number, _) in zip(chunks, asked, strict=True):
        mine = np.minimum(df[at : at + len(k)], 0xFFFFFFFF)
        at += len(k)
        shared = mine > 1
        if shared.any():
            rows.append((bucket, chunk, k[shared].tobytes() + mine[shared].astype(np.uint32).tobytes() + number[shared].tobytes()))
    out = pa.Table.from_batches([_packed_batch(rows)])
    del asked, distinct, which, df, rows
    tidy()
    return out


def signature(keys: np.ndarray) -> bytes:
    """A bit for each hash class that a key falls in: 1024 bits, or twice as many until there is one a key (at most 2^17)."""
    bits = 1024
    while bits < len(keys) and bits < 1 << 17:
        bits *= 2
    out = np.zeros(bits, dtype=bool)
    out[keys & np.uint64(bits - 1)] = True
    return np.packbits(out, bitorder="little").tobytes()


def _gather_chunk(percent: int):
    """The documents of a chunk with their shared shingles in rare-first order."""

    def run(table: pa.Table) -> pa.Table:
        raw = next(d for k, d in zip(table.column("bucket").to_pylist(), table.column("data").to_pylist(), strict=True) if k < 0)
        again = int(np.frombuffer(raw, "<u4", 1)[0])
        meta = pa.ipc.open_stream(raw[4 + 8 * again :]).read_all()
        docs, n_all = len(meta), meta.column("n").to_numpy()
        sizes = np.where(meta.column("own").to_numpy(zero_copy_only=False), n_all, 0)
        stream = np.zeros(int(sizes.sum()), dtype=np.int64)
        new = np.ones(len(stream), dtype=bool)
        where = np.frombuffer(raw, np.uint32, again, 4)
        new[where] = False
        stream[new] = np.arange(new.sum())
        stream[where] = np.frombuffer(raw, np.uint32, again, 4 + 4 * again)
        df_of, key_of = np.zeros(int(new.sum()), dtype=np.uint32), np.zeros(int(new.sum()), dtype=np.uint64)
        for bucket, raw in zip(table.column("bucket").to_pylist(), table.column("data").to_pylist(), strict=True):
            if bucket >= 0:
                k = len(raw) // 16
                number = np.frombuffer(raw, np.uint32, k, 12 * k)
                df_of[number] = np.frombuffer(raw, np.uint32, k, 8 * k)
                key_of[number] = np.frombuffer(raw, np.uint64, k) | (np.uint64(bucket) << np.uint64(40))
        at, df, key = np.repeat(np.arange(docs), sizes), df_of[stream], key_of[stream]
        at, df, key = at[df > 1], df[df > 1], key[df > 1]
        order = np.lexsort((key, df, at))
        key, cuts = key[order], np.searchsorted(at[order], np.arange(docs + 1))
        n, shared = n_all, np.diff(cuts)
        need = -(-percent * n // 100)
        prefix = np.maximum(0, np.minimum(shared, n - need + 1 - (n - shared)))
        live = meta.column("own").to_numpy(zero_copy_only=False) & (prefix > 0)
        own = [key[cuts[i] : cuts[i + 1]] if live[i] else None for i in range(docs)]
        del at, df, order, stream, new, df_of, key_of
        out = pa.table(
            {
                "doc_id": meta.column("doc_id"),
                "row_hash": meta.column("row_hash"),
                "digest": meta.column("digest"),
                "n": meta.column("n"),
                "unique_n": pa.array(n - shared, pa.int64()),
                "keys": pa.array([None if k is None else k.astype(np.int64) for k in own], pa.list_(pa.int64())),
                "prefix": pa.array(np.where(live, prefix, 0).astype(np.int32)),
                "signature": pa.array([None if k is None else signature(k) for k in own], pa.binary()),
            }
        )
        del own, key
        tidy()
        return out

    return run


def shared_shingles(docs: DataFrame, size: int = 5, percent: int = 75, chunk_docs: int = 8192, chunk_shingles: int = 300_000, bucket_shingles: int = 1_000_000) -> DataFrame:
    """Every document (doc_id, text) with a hash of its text, its set's digest and size and, once a chunk and set, its shared shingles and prefix length.

    The number of buckets follows the input, so a bucket holds about bucket_shingles at any size up to some 60 TB of
    compressed input (2^24 buckets, the bits a shingle's identity leaves; at 100 TB it holds 1.7 times as many). With
    very many buckets a chunk's rows hold a shingle each.
    """
    buckets = min(1 << 24, max(shuffle_partitions(docs), math.ceil(plan_bytes(docs) / BYTES_A_SHINGLE / bucket_shingles)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = WordHashes(), TaskContext.get().partitionId()
        chunk, ids, sets, total = part << 24, [], [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                some = whole.slice(at, 256)
                for doc, text, row in zip(*(some.column(c).to_pylist() for c in ("doc_id", "text", "row_hash")), strict=True):
                    if ids and (len(ids) >= chunk_docs or total >= chunk_shingles):
                        yield _packed_batch(list(_pack_chunk(chunk, buckets, ids, sets)))
                        chunk, ids, sets, total = chunk + 1, [], [], 0
                    ids.append((doc, row))
                    sets.append(shingle_hashes(text, words, size))
                    total += len(sets[-1])
        if ids:
            yield _packed_batch(list(_pack_chunk(chunk, buckets, ids, sets)))
        del words, ids, sets
        tidy()

    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row_hash")).mapInArrow(run, PACKED)
    counted = packed.groupBy("bucket").applyInArrow(_count_bucket, PACKED)
    return counted.groupBy("chunk").applyInArrow(_gather_chunk(percent), DOCS)


def verify(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """Of distinct pairs (a, b) of digests, those with 100 * intersection >= percent * union, on the whole sets.

    Only shared shingles can be in an intersection, so these are joined; the sizes are those of the whole sets.
    """
    left = sets.select(F.col("digest").alias("a"), F.col("n").alias("a_n"), F.col("keys").alias("a_keys"))
    right = sets.select(F.col("digest").alias("b"), F.col("n").alias("b_n"), F.col("keys").alias("b_keys"))
    both = F.size(F.array_intersect("a_keys", "b_keys"))
    met = pairs.distinct().join(left, "a").join(right, "b").withColumn("both", both)
    return met.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("a_n") + F.col("b_n") - F.col("both"))).select("a", "b")


def _block_links(percent: int):
    """Links between sets of two blocks that lie in different components: shared prefix shingles, length and suffix filters, then the whole sets.

    Only pairs whose first common prefix shingle has this pivot are looked at, and none of which one set is the pivot
    of a common prefix shingle: that one has been verified. The suffix filter bounds an overlap from above by the
    signatures' bits that only one of the two sets has. Sets that a link has just joined are not compared further.
    """

    def run(table: pa.Table) -> pa.Table:
        pivot, left_block, right_block = (table.column(c)[0].as_py() for c in ("pivot_hash", "left", "right"))
        block, n, unique_n, own_hash = (table.column(c).to_numpy() for c in ("block", "n", "unique_n", "own_hash"))
        raw = table.column("signature").to_pylist()
        bits = min(map(len, raw)) // 8
        sig = np.stack([np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, bits), axis=0) for x in raw])
        sets = table.column("keys").combine_chunks()
        ends = sets.offsets.to_numpy()
        _, key = np.unique(sets.values.to_numpy()[ends[0] : ends[-1]], return_inverse=True)
        ends = ends - ends[0]
        prefix = table.column("owners").combine_chunks()
        p_ends, owner = prefix.offsets.to_numpy(), prefix.values.to_numpy()
        owner, p_ends = owner[p_ends[0] : p_ends[-1]], p_ends - p_ends[0]
        p_size = np.diff(p_ends)
        p_key, of = key[_spans(ends[:-1], p_size)], np.repeat(np.arange(len(n)), p_size)
        # The sets of each shingle that belongs to this pivot, on the right side.
        on_right = np.flatnonzero((owner == pivot) & (block[of] == right_block))
        on_right = on_right[np.argsort(p_key[on_right], kind="stable")]
        by_key, members = p_key[on_right], of[on_right]
        size = int(key.max()) + 1
        marked, place_of = np.zeros(size, dtype=bool), np.full(size, -1, dtype=np.int64)
        place = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy().copy()
        digests = table.column("digest").to_pylist()
        out = []
        for i in np.flatnonzero(block == left_block):
            mine = slice(p_ends[i], p_ends[i + 1])
            asked = p_key[mine][owner[mine] == pivot]
            lo, hi = np.searchsorted(by_key, asked), np.searchsorted(by_key, asked, side="right")
            j = np.unique(members[_spans(lo, hi - lo)])
            j = j[j > i] if left_block == right_block else j
            j = j[(place[j] != place[i]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))]
            if not j.size:
                continue
            need = -(-percent * (n[i] + n[j]) // (100 + percent))
            only_i = np.bitwise_count(sig[i] & ~sig[j]).sum(axis=1) + unique_n[i]
            only_j = np.bitwise_count(sig[j] & ~sig[i]).sum(axis=1) + unique_n[j]
            good = np.minimum(n[i] - only_i, n[j] - only_j) >= need
            j, need = j[good], need[good]
            if not j.size:
                continue
            place_of[p_key[mine]] = np.arange(p_size[i])
            at = place_of[p_key[_spans(p_ends[j], p_size[j])]]
            place_of[p_key[mine]] = -1
            common, far = at >= 0, p_size[i]
            starts = np.append(0, np.cumsum(p_size[j])[:-1])
            first = np.minimum.reduceat(np.where(common, at, far), starts)
            its = np.where(common, owner[mine][np.maximum(at, 0)], 0)
            tried = np.logical_or.reduceat(common & ((its == own_hash[i]) | (its == np.repeat(own_hash[j], p_size[j]))), starts)
            good = (owner[mine][first] == pivot) & ~tried
            j, need = j[good], need[good]
            if not j.size:
                continue
            own = key[ends[i] : ends[i + 1]]
            marked[own] = True
            sizes = ends[j + 1] - ends[j]
            both = np.add.reduceat(marked[key[_spans(ends[j], sizes)]].astype(np.int64), np.append(0, np.cumsum(sizes)[:-1]))
            marked[own] = False
            for k in j[both >= need]:
                if place[k] != place[i]:
                    out.append((digests[i], digests[k]))
                    place[place == place[k]] = place[i]
        if table.nbytes > 4_000_000:
            tidy()
        return pa.table({"a": pa.array([p[0] for p in out], pa.binary()), "b": pa.array([p[1] for p in out], pa.binary())})

    return run


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _overlap_bound(a_n, a_pos, b_n, b_pos):
    """Positional filter: the most that two ordered sets can share if they share the elements at these positions."""
    return F.least(a_pos, b_pos) + F.least(a_n - a_pos, b_n - b_pos)


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 75, block: int = 1_000_000) -> DataFrame:
    """Every document (doc_id, text) with row_hash (of its text), n_shingles, digest (of its set), class_id and component_id.

    Words are what ASCII white space parts, with A-Z in lower case; a set is all distinct shingles of size words, or
    the whole sequence where there are fewer; a text without words (or null) has the empty set, links with nothing
    and is its own component. Two documents link when 100 * intersection >= percent * union; component_id is the
    least doc_id reachable by links, itself included. Equal sets link. Rows with a repeated or null doc_id are
    documents of their own; a null doc_id is never a component's least (null if there is no other). Other columns
    are ignored. An empty table gives no rows. A very long text is one set, whole; memory follows the longest text.
    """
    all_docs = materialise(shared_shingles(docs, size, percent), "shingles")
    sets = materialise(all_docs.where("prefix > 0").dropDuplicates(["digest"]).drop("doc_id", "row_hash"), "sets")
    entries = sets.select("digest", "n", "unique_n", "signature", F.posexplode(F.slice("keys", F.lit(1), F.col("prefix"))).alias("i", "key"))
    entries = entries.withColumn("pos", F.col("unique_n") + F.col("i") + 1)
    heads = entries.groupBy("key").agg(F.min(F.struct("digest", "n", "pos")).alias("pivot"), F.count("*").alias("size")).where("size > 1")
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("pivot.n")) / F.lit(100 + percent))
    tries = entries.select("key", "digest", "n", "pos").join(heads, "key").where(F.col("digest") != F.col("pivot.digest"))
    tries = tries.where(F.lit(100) * F.least("n", "pivot.n") >= F.lit(percent) * F.greatest("n", "pivot.n"))
    tries = tries.where(_overlap_bound(F.col("n"), F.col("pos"), F.col("pivot.n"), F.col("pivot.pos")) >= need)
    links = materialise(verify(tries.select(F.col("digest").alias("a"), F.col("pivot.digest").alias("b")), sets, percent), "links")
    near = connected_components(links)
    placed = entries.select("key", "digest").join(near, entries["digest"] == near["node"], "left").withColumn("component", F.coalesce("component", "digest"))
    mixed = placed.groupBy("key").agg(F.min("digest").alias("pivot"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    mixed = materialise(mixed.select("key", "pivot", F.xxhash64("pivot").alias("pivot_hash")), "mixed")
    # The pivot of each prefix shingle of a set that meets any, 0 where its sets are in one component.
    owners = entries.select("digest", "i", "key").join(mixed.select("key", "pivot_hash"), "key").groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("i", "pivot_hash"))).alias("m"))
    owned = sets.join(owners, "digest").withColumn("owners", F.transform(F.sequence(F.lit(0), F.col("prefix") - 1), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long")))).drop("m", "prefix")
    owned = materialise(owned.withColumn("own_hash", F.xxhash64("digest")), "owned")
    # Keys with one pivot are examined together: a set appears once a pivot, not once a key. Sets whose sizes differ by
    # more than the threshold allows never share a band or have neighbouring ones.
    band = F.floor(F.log(F.col("n")) / math.log(100.5 / percent)).cast("long")
    met = placed.join(mixed, "key").select("pivot_hash", "digest", "component").distinct()
    met = materialise(met.join(sets.select("digest", band.alias("band"), F.size("keys").alias("load")), "digest"), "met")
    spread = met.groupBy("pivot_hash", "band").agg(F.ceil(F.sum("load") / F.lit(block)).cast("int").alias("blocks"))
    spread = spread.groupBy("pivot_hash").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("of"))
    code = lambda band, number: F.shiftleft(band, 32) + number
    dealt = met.join(spread, "pivot_hash").withColumn("block", code(F.col("band"), F.pmod(F.xxhash64("digest"), F.col("of")[F.col("band")])))
    near_bands = F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)
    others = F.flatten(F.transform(near_bands, lambda b: F.when(F.col("of")[b] > 0, F.transform(F.sequence(F.lit(0), F.col("of")[b] - 1), lambda k: code(b, k))).otherwise(F.array().cast("array<bigint>"))))
    shared = dealt.select("*", F.explode(others).alias("other")).select("pivot_hash", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "digest", "component")
    rest = shared.join(owned, "digest")
    more = materialise(rest.groupBy("pivot_hash", "left", "right").applyInArrow(_block_links(percent), "a binary, b binary"), "links")
    whole = near if more.isEmpty() else connected_components(near.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    found = all_docs.select("doc_id", "row_hash", "n", "digest").join(whole, all_docs["digest"] == whole["node"], "left")
    found = found.select("doc_id", "row_hash", F.col("n").alias("n_shingles"), "digest", F.coalesce("component", "digest").alias("class_id"))
    least = found.where("n_shingles > 0").groupBy("class_id").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("documents")).where("documents > 1")
    alone = F.col("n_shingles") == 0
    return found.join(least, "class_id", "left").select(
        "doc_id", "row_hash", "n_shingles", "digest", "class_id", F.when(alone, F.col("doc_id")).otherwise(F.coalesce("least_id", "doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs, all their columns unchanged, of one document a component: the one with the least doc_id.

    Of repeated rows of that document one stays; of different texts under its doc_id one that belongs to the
    component. A null doc_id stays only where the component has no other. Documents without words all stay.
    """
    last = (1 << 63) - 1
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(last))
    found = jaccard_components(docs, size, percent).select(key.alias("key"), "row_hash", "class_id", "n_shingles")
    chosen = found.where("n_shingles > 0").groupBy("class_id").agg(F.min(F.struct("key", "row_hash")).alias("c")).select("c.key", "c.row_hash", F.lit(True).alias("once"))
    empty = found.where("n_shingles = 0").select("key", "row_hash").distinct().withColumn("once", F.lit(False))
    own, text, once = free_names(docs, "key", "hash", "once")
    stay = materialise(chosen.unionByName(empty), "kept").toDF(own, text, once)
    rows = docs.withColumns({own: key, text: F.xxhash64("text")}).join(stay, [own, text])
    several = rows.where(F.col(once)).dropDuplicates([own, text]).unionByName(rows.where(~F.col(once)))
    return several.select(*docs.columns)
