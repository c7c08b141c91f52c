"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A document is its token ids and one end id. Runs of ``length`` tokens are full sequences by themselves. What is left of
each document is dealt to shards of about SHARD_BYTES of text; a shard opens as many sequences as its tokens fill and
assigns its pieces in descending order, each to the sequence of least cost that has room for it, where a piece of n
tokens costs LINEAR * n + QUADRATIC * n * n (projections and attention). A piece that fits nowhere is cut to fill what
room is left, so that a shard pads less than one sequence.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
END_ID = 1
SHARD_BYTES = 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH
#: Texts on which the fast encoder must agree with the tokenizer file before it is used.
PROBES = ("", " ", "It's  a test.\n\n\tElle était là; ñandú, Straße 12345!", "x" * 300, "a b c \u001c \u0085", "漢字 😀 é")


@lru_cache(maxsize=2)
def _by_file(path: str | None):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    return model, lambda texts: [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


@lru_cache(maxsize=1)
def _by_ranks():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    model = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [model.encode_ordinary(t) for t in texts]


def encoder(path: str | None, ranks: bool, added: tuple[str, ...] = ()):
    """A function from texts to lists of the tokenizer file's ids, no special tokens being added.

    path: a tokenizer file, by default the public byte-level BPE. ranks: read the same vocabulary from its ranks, at
    about four times the speed and half the memory. Ranks know no added tokens; texts that hold the string of one (of
    ``added``) go to the file, which reads it as that token.
    """
    if not ranks:
        return _by_file(path)[1]

    def encode(texts: list[str]) -> list[list[int]]:
        out = _by_ranks()(texts)
        for i, text in enumerate(texts):
            if any(a in text for a in added):
                out[i] = _by_file(path)[1]([text])[0]
        return out

    return encode


@lru_cache(maxsize=4)
def added_strings(path: str | None) -> tuple[str, ...]:
    """The strings of the tokenizer file's added tokens; asked once, on the driver."""
    return tuple(sorted(t.content for t in _by_file(path)[0].get_added_tokens_decoder().values()))


@lru_cache(maxsize=1)
def ranks_agree() -> bool:
    """Whether the ranks give the default tokenizer file's ids on PROBES; asked once, on the driver."""
    return _by_ranks()(PROBES) == _by_file(None)[1](list(PROBES))


def assign(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in the piece, length, sequence, offset) for pieces shorter than capacity, in one shard."""
    total = int(lengths.sum())
    n_seq = -(-total // capacity)
    room, used = [capacity] * n_seq, [0] * n_seq
    heap = [(0.0, s) for s in range(n_seq)]
    out = []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        n, passed = int(lengths[piece]), []
        while heap and room[heap[0][1]] < n:
            passed.append(heapq.heappop(heap))
        if heap:
            parts = [(*heapq.heappop(heap), n)]
        else:  # cut: fill the widest gaps
            parts, rest = [], n
            for cost, s in sorted(passed, key=lambda x: (-room[x[1]], x[1])):
                if rest:
                    parts.append((cost, s, min(rest, room[s])))
                    rest -= parts[-1][2]
            cut = {s for _, s, _ in parts}
            passed = [x for x in passed if x[1] not in cut]
        start = 0
        for cost, s, k in parts:
            out.append((piece, start, k, s, used[s]))
            start, used[s], room[s] = start + k, used[s] + k, room[s] - k
            if room[s]:
                heapq.heappush(heap, (cost + LINEAR * k + QUADRATIC * k * k, s))
        for x in passed:
            if room[x[1]]:
                heapq.heappush(heap, x)
    return out


def pack(
    docs: DataFrame,
    length: int = LENGTH,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids); ids: little-endian unsigned 32-bit.

    Every id of every row lies in exactly one piece; the pieces of a sequence cover it from 0 without gaps. A null
    text counts as empty (the end id alone); rows that repeat are packed once each; extra columns are ignored; an
    empty table gives no rows. Equal rows spread evenly over the shards.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-n_bytes // SHARD_BYTES))
    ranks = tokenizer is None and ranks_agree()
    added = added_strings(tokenizer)
    # the default vocabulary's ids fit 16 bits, which halves what moves to the shards
    kind, width = ("<u2", 2) if tokenizer is None and end_id < 1 << 16 else ("<u4", 4)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """place: a hash of the task, the piece and, for pieces that repeat in a task, their number; so a task that is run
        again deals its pieces alike, whatever order its rows come in."""
        encode, task, seen = encoder(tokenizer, ranks, added), TaskContext.get().partitionId(), Counter()
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part, out = pdf.iloc[i : i + 256], []
                for doc, ids in zip(part["doc_id"], encode(part["text"].tolist()), strict=True):
                    ids = np.array([*ids, end_id], kind)
                    for start in range(0, len(ids), length):
                        piece = ids[start : start + length].tobytes()
                        place = xxhash.xxh64_intdigest(b"%d|%s|%d|" % (task, str(doc).encode(), start) + piece) >> 20
                        seen[place] += 1
                        out.append((doc, start, len(ids), (place << 19) | min(seen[place], (1 << 19) - 1), piece))
                yield pd.DataFrame(out, columns=["doc_id", "start", "doc_tokens", "place", "ids"]).astype({"doc_id": "Int64"})

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", kind="stable")
        data, size = pdf["ids"].tolist(), np.array([len(x) // width for x in pdf["ids"]])
        whole = np.flatnonzero(size == length)
        rest = np.flatnonzero(size < length)
        placed = [(p, 0, length, s, 0) for s, p in enumerate(whole.tolist())]
        placed += [(int(rest[p]), a, k, s + len(whole), o) for p, a, k, s, o in assign(size[rest], length)]
        at = [p[0] for p in placed]
        shard = int(pdf["shard"].iloc[0])
        out = pdf[["doc_id", "doc_tokens", "start"]].iloc[at].reset_index(drop=True)
        out["start"] += [p[1] for p in placed]
        out["length"] = [p[2] for p in placed]
        out["sequence_id"] = [p[3] * shards + shard for p in placed]
        out["offset"] = [p[4] for p in placed]
        out["ids"] = [np.frombuffer(data[p], kind, k, width * a).astype("<u4").tobytes() for p, a, k, _, _ in placed]
        return out[["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]]

    pieces = src.mapInPandas(cut, "doc_id long, start long, doc_tokens long, place long, ids binary")
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)))
    return pieces.groupBy("shard").applyInPandas(
        lambda pdf: fill(pdf),
        "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
    )


def pieces_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pieces_digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
