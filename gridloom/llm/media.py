"""Media columns stored as content-defined chunks.

A payload becomes a greyscale image (binary PGM, 24 samples a row), and is stored as a header and an ordered list of
chunks. A rolling gear hash of the last 32 bytes cuts chunks where its upper bits are zero, so that equal passages give
equal chunks wherever they stand. Chunk digests are compared through a Bloom filter of digests seen twice: chunks that
certainly occur once stay in their medium's row, and only possibly repeated ones go, once each, to a shared chunk table
that readers join by digest. Reading verifies every chunk and every payload against its digest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import load, one_segment, repeated_blocks
from .common import materialize, sliced, utf8

BLOCK, WIDTH, PAD = 576, 24, b"\xff"
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 512, 8192, 11
TAIL = 32
GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 bytes padded with 255 to a positive multiple of BLOCK, their number before padding)."""
    data = utf8(text)
    return data + PAD * (-len(data) % BLOCK or (0 if data else BLOCK)), len(data)


def header_of(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH)


def payload_in(medium: bytes) -> bytes:
    """The samples of a binary PGM image with 8 bits a sample."""
    kind, size, depth, samples = medium.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or width * height != len(samples):
        raise ValueError("not a greyscale image of 8 bits a sample")
    return samples


def cuts(payload: bytes) -> list[int]:
    """Ends of the payload's chunks."""
    h = GEAR[np.frombuffer(payload, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # sums of 2, 4, ... 32 shifted gear values
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
    ends, begin = [], 0
    for at in (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist():
        while at - begin > MAX_CHUNK:
            begin += MAX_CHUNK
            ends.append(begin)
        if at - begin >= MIN_CHUNK:
            ends.append(at)
            begin = at
    while len(payload) - begin > MAX_CHUNK:
        begin += MAX_CHUNK
        ends.append(begin)
    if begin < len(payload):
        ends.append(len(payload))
    return ends


def chunks(payload: bytes) -> list[tuple[bytes, bytes]]:
    """(SHA-256, bytes) of the payload's chunks in order."""
    out, begin = [], 0
    for end in cuts(payload):
        part = payload[begin:end]
        out.append((hashlib.sha256(part).digest(), part))
        begin = end
    return out


def _keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), np.int64)


def features(payload: bytes) -> str:
    """Mean and deviation of the samples, and a 64-bit hash of the 24 x 24 average block against its mean."""
    a = np.frombuffer(payload, np.uint8).astype(np.int64)
    small = a.reshape(-1, WIDTH, WIDTH).sum(axis=0).reshape(8, 3, 8, 3).sum(axis=(1, 3)).ravel()
    bits = np.packbits(small * 64 > small.sum()).tobytes().hex()
    mean = int(a.sum()) / len(a)
    return f"mean={mean:.4f};var={int((a * a).sum()) / len(a) - mean * mean:.4f};hash={bits}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(media, chunk table) written to shared storage.

    media: doc_id, n_bytes, media_key (SHA-256 of the payload), header, digests, inline: for every chunk its
    compressed bytes, or null if they are in the chunk table (digest, data). One row per input row; null text
    counts as empty.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches):
            yield pd.DataFrame({"k": _keys([d for t in pdf["text"] for d, _ in chunks(payload_of(t)[0])])})

    # a medium's chunks belong to all segments of a filter, so there is one: beyond its size more chunks go to the chunk table
    n_rows, n_bytes = src.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_keys = one_segment(n_rows + n_bytes // (1 << CUT_BITS))
    filt = load(repeated_blocks(src.select("text").mapInPandas(keys, "k long"), n_keys), n_keys)

    def repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for pdf in sliced(batches):
            seen: dict[bytes, bytes] = {}
            for text in pdf["text"]:
                parts = chunks(payload_of(text)[0])
                again = filt.again(_keys([d for d, _ in parts]))
                seen |= {d: p for (d, p), a in zip(parts, again.tolist(), strict=True) if a}
            yield pd.DataFrame({"digest": list(seen), "data": [pack(p) for p in seen.values()]})

    table = src.select("text").mapInPandas(repeated, "digest binary, data binary")
    table = materialize(table.groupBy("digest").agg(F.min("data").alias("data")), "chunk-table")

    def media(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for pdf in sliced(batches):
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                payload, n = payload_of(text)
                parts = chunks(payload)
                again = filt.again(_keys([d for d, _ in parts])).tolist()
                inline = [None if a else pack(p) for (_, p), a in zip(parts, again, strict=True)]
                out.append((doc, n, hashlib.sha256(payload).hexdigest(), header_of(payload), [d for d, _ in parts], inline))
            frame = pd.DataFrame(out, columns="doc_id n_bytes media_key header digests inline".split())
            yield frame.astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, media_key string, header binary, digests array<binary>, inline array<binary>"
    return materialize(src.mapInPandas(media, schema), "media"), table


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read_back(key: str, header: bytes, digests, inline, fetched: dict[int, bytes]) -> tuple:
    unpack = zstandard.ZstdDecompressor().decompress
    parts = []
    for i, digest in enumerate(digests):
        part = unpack(bytes(fetched[i] if inline[i] is None else inline[i]), max_output_size=MAX_CHUNK)
        if hashlib.sha256(part).digest() != bytes(digest):
            raise ValueError(f"chunk {i} of {key} is damaged")
        parts.append(part)
    medium = bytes(header) + b"".join(parts)
    payload = payload_in(medium)
    sha = hashlib.sha256(payload).hexdigest()
    if sha != key:
        raise ValueError(f"{key} is damaged")
    return len(payload), sha, zlib.crc32(payload[-TAIL:]), len(medium), hashlib.sha256(medium).hexdigest(), features(payload)


def read_media(media: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored bytes say: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature. Media without shared chunks are read where they lie; equal media with shared chunks are read once."""
    complete = ~F.exists("inline", lambda x: x.isNull())
    names = [c.split()[0] for c in READ.split(", ")]

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches):
            rows = [_read_back(r.media_key, r.header, r.digests, r.inline, {}) for r in pdf.itertuples(index=False)]
            yield pd.concat([pdf[["doc_id", "n_bytes"]], pd.DataFrame(rows, columns=names, index=pdf.index)], axis=1)

    whole = media.where(complete).mapInPandas(alone, f"doc_id long, n_bytes long, {READ}")
    refs = media.where(~complete)
    objects = materialize(
        refs.groupBy("media_key").agg(F.min(F.struct("header", "digests", "inline")).alias("o")).select("media_key", "o.*"), "media-objects"
    )
    needed = objects.select("media_key", F.posexplode(F.arrays_zip("digests", "inline")).alias("at", "c"))
    needed = needed.where("c.inline IS NULL").select("media_key", "at", F.col("c.digests").alias("digest"))
    fetched = needed.join(table, "digest").groupBy("media_key").agg(F.collect_list(F.struct("at", "data")).alias("fetched"))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches):
            rows = [
                (r.media_key, *_read_back(r.media_key, r.header, r.digests, r.inline, {x["at"]: x["data"] for x in r.fetched}))
                for r in pdf.itertuples(index=False)
            ]
            yield pd.DataFrame(rows, columns=["media_key", *names])

    read = objects.join(fetched, "media_key").mapInPandas(joined, f"media_key string, {READ}")
    read = materialize(read, "media-read")
    back = refs.select("doc_id", "n_bytes", "media_key").join(read, "media_key").drop("media_key")
    return whole.unionByName(back)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(*store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
