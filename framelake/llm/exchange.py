"""Totals of keys over all documents, returned to where the keys are needed.

Counting every n-gram of a corpus and looking the counts up again is a join of all tokens with all
n-grams. Done row by row it moves dozens of bytes per token, several times. Here documents are dealt to
chunks by a hash; a chunk keeps its distinct keys (64-bit hashes, sorted) with its own counts, and
sends each bucket of the key space one packed row. A bucket adds up what the chunks sent and answers
each chunk with the totals of just its keys, in the chunk's order. A frequent key is one entry per
chunk, so no key is hot; both sides are dealt by a hash, and the numbers of chunks and buckets follow
the bytes of text, so neither a chunk nor a bucket grows with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a chunk and in what a bucket stands for.
CHUNK_BYTES = 12 << 20
BUCKET_BYTES = 12 << 20
REQUEST = "chunk long, bucket int, keys binary, counts binary"
ANSWER = "chunk long, bucket int, totals binary, summary array<long>"


def sizes(docs: DataFrame) -> tuple[int, int]:
    """(chunks, buckets) for the texts of ``docs``, from their bytes."""
    total = docs.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    return max(1, math.ceil(total / CHUNK_BYTES)), max(1, math.ceil(total / BUCKET_BYTES))


def chunk_of(chunks: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(chunks)).cast("long")


def bounds(buckets: int) -> np.ndarray:
    """The first key of every bucket but the first."""
    return np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)


def packed(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences in planes of bytes: the high planes are mostly zero and compress."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def squeezed(counts: np.ndarray) -> bytes:
    """Counts, most of them small: bytes, where 255 refers to a list of large ones."""
    large = counts >= 255
    return _zip(np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes())


def spread(raw: bytes, n: int) -> np.ndarray:
    raw = _unzip(raw)
    out = np.frombuffer(raw, dtype=np.uint8, count=n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, dtype="<i8", offset=n)
    return out


def _zip(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True) + len(raw).to_bytes(8, "little")


def _unzip(raw: bytes) -> bytes:
    return pa.decompress(raw[:-8], decompressed_size=int.from_bytes(raw[-8:], "little"), codec="zstd", asbytes=True)


def requests(docs: DataFrame, buckets: int, keys_of: Callable[[pa.Table], tuple[np.ndarray, list[np.ndarray]]]) -> DataFrame:
    """What every chunk sends: ``keys_of`` gives its sorted distinct keys and one or more counts of each."""
    starts = bounds(buckets)

    def run(chunk: pa.Table) -> pa.Table:
        keys, counts = keys_of(chunk)
        cut = np.concatenate(([0], np.searchsorted(keys, starts), [len(keys)]))
        full = np.flatnonzero(np.diff(cut))
        number = chunk.column("chunk")[0].as_py()
        return pa.table({
            "chunk": pa.array(np.full(len(full), number, dtype=np.int64)),
            "bucket": pa.array(full.astype(np.int32)),
            "keys": pa.array([_zip(packed(keys[cut[b] : cut[b + 1]])) for b in full], pa.binary()),
            "counts": pa.array([_joined([squeezed(c[cut[b] : cut[b + 1]]) for c in counts]) for b in full], pa.binary()),
        })

    return docs.groupBy("chunk").applyInArrow(run, REQUEST)


def answers(sent: DataFrame, parts: int, summary: Callable[[np.ndarray, list[np.ndarray]], list[int]] | None = None) -> DataFrame:
    """The totals of the ``parts`` counts for the keys each chunk sent, bucket by bucket.

    ``summary`` sees each key once with its totals; its numbers come as one more row per bucket, of chunk -1.
    """

    def run(bucket: pa.Table) -> pa.Table:
        lists = [unpacked(_unzip(k)) for k in bucket.column("keys").to_pylist()]
        given = [[spread(c, len(k)) for c in _parted(raw)] for k, raw in zip(lists, bucket.column("counts").to_pylist())]
        flat = np.concatenate(lists)
        order = np.argsort(flat, kind="stable")
        new = np.append(True, flat[order][1:] != flat[order][:-1])
        group = np.empty(len(flat), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        sums = [np.add.reduceat(np.concatenate([g[part] for g in given])[order], first) for part in range(parts)]
        totals = [t[group] for t in sums]
        ends = np.cumsum([len(k) for k in lists])
        out = [_joined([squeezed(t[e - len(k) : e]) for t in totals]) for k, e in zip(lists, ends.tolist())]
        chunks, numbers, said = bucket.column("chunk").to_pylist(), bucket.column("bucket").to_pylist(), [None] * len(out)
        if summary is not None:
            chunks, numbers, out = [*chunks, -1], [*numbers, numbers[0]], [*out, None]
            said.append(summary(flat[order][first], sums))
        return pa.table({
            "chunk": pa.array(chunks, pa.int64()), "bucket": pa.array(numbers, pa.int32()),
            "totals": pa.array(out, pa.binary()), "summary": pa.array(said, pa.list_(pa.int64())),
        })

    return sent.groupBy("bucket").applyInArrow(run, ANSWER)


def received(answer: pa.Table, keys: np.ndarray, buckets: int, parts: int) -> list[np.ndarray]:
    """A chunk's answers as totals aligned with its keys."""
    cut = np.concatenate(([0], np.searchsorted(keys, bounds(buckets)), [len(keys)]))
    out = [np.zeros(len(keys), dtype=np.int64) for _ in range(parts)]
    for b, raw in zip(answer.column("bucket").to_pylist(), answer.column("totals").to_pylist()):
        for target, part in zip(out, _parted(raw)):
            target[cut[b] : cut[b + 1]] = spread(part, int(cut[b + 1] - cut[b]))
    return out


def _joined(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _parted(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out
