"""Substring deduplication with run-length compressed suffix indexes.

A byte goes if a LENGTH-byte string that covers it starts anywhere else in the corpus too. The corpus is cut into
pieces that can be indexed apart: the least hash among the GRAM-byte grams of a window is its anchor, equal windows have
equal anchors at equal places, and a run of windows with one anchor is an entry with a context of at most 337 bytes.
Entries whose anchor occurs once are dropped. Equal contexts collapse into one that counts them. An anchor with a single
context is decided by that count; the contexts of all other anchors that can match go to index shards, by anchor.

A shard sorts the suffixes of its contexts and keeps their Burrows-Wheeler transform as runs, with a sample at both ends of each
run: the suffix there and how far it matches its neighbour outside the run. Inside a run a suffix continues the match of the
position before it, one byte shorter; so one pass over the text streams the matching statistics of every position from the
samples, against the neighbours on both sides. Windows whose match reaches LENGTH are marked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import Filter, maybe_repeated, member_filter
from .common import materialize, sliced, utf8

LENGTH, GRAM = 200, 64
#: Bytes of contexts in a shard, and of anchors indexed together there (about 60 bytes of memory a byte); an anchor whose
#: contexts exceed HEAVY bytes compares hashed windows instead.
SHARD, INDEX, HEAVY = 1 << 20, 1 << 18, 2 << 20
#: Bytes of short texts hashed at a time, and of a long text.
BATCH, PART = 1 << 17, 1 << 23
_POSITION = np.uint64((1 << 24) - 1)
_TABLE = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _grams(b: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of all 64-byte grams: sums of 2, 4, ... 64 bytes by doubling."""
    h, power = _TABLE[b], _BASE
    for step in (1, 2, 4, 8, 16, 32):
        h = h[:-step] * np.uint64(power) + h[step:]
        power = power * power % (1 << 64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` keys, from running minima of blocks in both directions."""
    n = len(keys)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = keys
    block = full.reshape(-1, width)
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(block, axis=1).ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, anchor hash, first window, last window) of each run of windows with one anchor.

    Texts are taken together up to BATCH bytes, since short arrays cost more to call than to fill; windows that cross
    texts don't count. Texts below ``length`` bytes have no windows.
    """
    out, begin = [], 0
    own = np.array([len(t) for t in texts], np.int64)
    while begin < len(texts):
        end, size = begin + 1, int(own[begin])
        while end < len(texts) and size + own[end] <= BATCH:
            size, end = size + int(own[end]), end + 1
        for at in range(0, max(1, size), PART):  # a long text in parts, so that positions fit 24 bits
            data = b"".join(texts[begin:end])[at : at + PART + length - 1]
            if len(data) >= length:
                stop = np.cumsum(own[begin:end]) - at
                text = np.searchsorted(stop, np.arange(len(data) - length + 1), side="right")
                h = _grams(np.frombuffer(data, np.uint8))
                least = _least((h & ~_POSITION) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
                window = np.flatnonzero(np.arange(len(text)) + length <= stop[text])
                if len(window):
                    place, text = (least[window] & _POSITION).astype(np.int64), text[window]
                    change = (np.diff(place) != 0) | (np.diff(window) != 1) | (np.diff(text) != 0)
                    first = np.concatenate(([0], np.flatnonzero(change) + 1))
                    last = np.append(first[1:], len(place)) - 1
                    shift = (stop - own[begin:end])[text[first]]  # where the text begins
                    out.append((text[first] + begin, h[place[first]].astype(np.int64), window[first] - shift, window[last] - shift))
        begin = end
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def suffix_order(symbols: np.ndarray, rest: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ranks) of texts laid end to end, by prefix doubling; a suffix ends with its text.

    rest: bytes to the end of the text; owner: the number of the text, which orders suffixes that are equal.
    """
    n = len(symbols)

    def ahead(values: np.ndarray, step: int) -> np.ndarray:
        """What stands ``step`` places on in the same text, else 0."""
        out = np.zeros(n, values.dtype)
        out[: n - step] = values[step:]
        out[rest <= step] = 0
        return out

    key = symbols.astype(np.uint64) + np.uint64(1)  # seven symbols of nine bits, by doubling
    key = (key << np.uint64(9)) | ahead(key, 1)
    key = (key << np.uint64(18)) | ahead(key, 2)
    key = (key << np.uint64(27)) | (ahead(key, 4) >> np.uint64(9))
    rank, step = np.empty(n, np.int32), 7
    while True:
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        new = np.zeros(n, np.int32)
        np.cumsum(key[1:] != key[:-1], out=new[1:])
        rank[order] = new
        if new[-1] + 1 == n:
            return order, rank
        # a suffix that ends within the step is ordered by its owner, before all that go on
        key = rank * np.int64(2 * n + 2)
        key[: n - step] += rank[step:]
        key += n + 1
        short = rest <= step
        key[short] = rank[short] * np.int64(2 * n + 2) + owner[short]
        step *= 2


@dataclass(frozen=True)
class RunIndex:
    """A run-compressed Burrows-Wheeler transform of texts laid end to end, with samples at the ends of its runs.

    symbol, length: of each run; a byte before a text's first counts as a symbol of its own, so that no run crosses texts.
    head, tail: the first and last suffix of each run; above, below: how far they match the suffix above and below the run.
    ends: where the texts end; twins: whether a text stands for several equal ones.
    """

    symbol: np.ndarray
    length: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    above: np.ndarray
    below: np.ndarray
    ends: np.ndarray
    twins: np.ndarray


def run_index(texts: list[bytes], twins: np.ndarray) -> RunIndex:
    """The index of non-empty texts. Only the ends of runs are compared byte by byte."""
    sizes = np.array([len(t) for t in texts], np.int64)
    symbols = np.frombuffer(b"".join(texts), np.uint8)
    n, ends = len(symbols), np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    rest = (ends[owner] - np.arange(n, dtype=np.int32)).astype(np.int32)
    order, _ = suffix_order(symbols, rest, owner)
    before = symbols[order - 1].astype(np.int32)
    first = order == (ends - sizes)[owner[order]]
    before[first] = 256 + owner[order][first]
    change = np.flatnonzero(np.diff(before)) + 1
    heads, tails = np.concatenate(([0], change)), np.append(change - 1, n - 1)

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffix pairs, in strides of sixteen bytes and then one."""
        out, limit = np.zeros(len(a), np.int32), np.minimum(rest[a], rest[b])
        for width in (16, 1):
            live = np.arange(len(a))
            while len(live):
                i, j = a[live] + out[live], b[live] + out[live]
                fits = out[live] + width <= limit[live]
                live, i, j = live[fits], i[fits], j[fits]
                cols = np.arange(width)
                same = (symbols[i[:, None] + cols] == symbols[j[:, None] + cols]).all(axis=1)
                live = live[same]
                out[live] += width
        return out

    above, below = np.zeros(len(heads), np.int32), np.zeros(len(tails), np.int32)
    above[1:] = common(order[heads[1:]], order[heads[1:] - 1])
    below[:-1] = common(order[tails[:-1]], order[tails[:-1] + 1])
    return RunIndex(before[heads], np.diff(np.append(heads, n)), order[heads], order[tails], above, below, ends, np.asarray(twins, bool))


def matching_statistics(index: RunIndex) -> list[np.ndarray]:
    """For every position of every text the longest match with another position of the texts, streamed from the samples."""
    n = int(index.ends[-1])
    place, best = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    for suffixes, matched in ((index.head, index.above), (index.tail, index.below)):
        sample = np.full(n, -1, np.int32)
        sample[suffixes] = matched
        at = np.maximum.accumulate(np.where(sample >= 0, place, np.int32(0)))
        best = np.maximum(best, sample[at] - (place - at))
    out = np.split(best, index.ends[:-1])
    for i in np.flatnonzero(index.twins).tolist():  # a twin matches to its end
        out[i] = np.arange(len(out[i]), 0, -1, dtype=np.int32)
    return out


def match_lengths(texts: list[bytes], twins: np.ndarray | None = None) -> list[np.ndarray]:
    return matching_statistics(run_index(texts, np.zeros(len(texts), bool) if twins is None else twins))


def _spans(marked: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by the marked windows."""
    at = np.flatnonzero(marked)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.concatenate(([0], gap + 1))].tolist(), (at[np.append(gap, len(at) - 1)] + length).tolist(), strict=True))


MARKS = "gram long, digest long, spans array<struct<s: int, e: int>>"


def repeated_spans(docs: DataFrame, length: int = LENGTH, text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """(key, spans): for texts that hold repeated strings, ranges to remove; key is the first 16 bytes of the text's SHA-256.

    Texts that occur twice are one range if they have ``length`` bytes. Others' ranges may overlap.
    """
    src = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") >= length)
    src = src.select(F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("key"), "text")
    copies = src.groupBy("key").agg(F.count("*").alias("c"), F.min(F.octet_length("text")).alias("n")).where("c > 1")
    full = copies.select("key", F.array(F.struct(F.lit(0).alias("s"), F.col("n").alias("e"))).alias("spans"))
    full = materialize(full, "copied")

    def cut(pdf: pd.DataFrame, seen: set[bytes], filt: Filter | None) -> tuple[pd.DataFrame, list[bytes]]:
        """Entries of texts not seen before in this task, with an anchor that passes the filter, and their contexts.

        Copies in other tasks only raise counts of strings that repeat in any case.
        """
        fresh = {k: t for k, t in zip(pdf["key"], pdf["text"], strict=True) if k not in seen}
        seen.update(fresh)
        keys, datas = list(fresh), [utf8(t) for t in fresh.values()]
        text, gram, first, last = anchors(datas, length)
        if filt is not None:
            hit = filt.again(gram)
            text, gram, first, last = text[hit], gram[hit], first[hit], last[hit]
        at, i, j = text.tolist(), first.tolist(), (last + length).tolist()
        bodies = [datas[t][a:b] for t, a, b in zip(at, i, j, strict=True)]
        digest = np.array([xxhash.xxh3_64_intdigest(b) for b in bodies], np.uint64).view(np.int64)
        return pd.DataFrame({"gram": gram, "digest": digest, "key": [keys[t] for t in at], "first": i, "size": last + length - first}), bodies

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for pdf in sliced(batches):
            yield cut(pdf, seen, None)[0]

    every = materialize(src.mapInPandas(entries, "gram long, digest long, key binary, first int, size int"), "entries")
    again = materialize(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "repeated")
    found = every.where(maybe_repeated(F.col("gram"), member_filter(again, "gram")))
    contexts = materialize(found.groupBy("gram", "digest").agg(F.count("*").alias("n"), F.min("size").alias("size")), "contexts")
    mixed = contexts.groupBy("gram").agg(F.count("*").alias("m"), F.sum("size").alias("bytes"), F.min("n").alias("least"))
    mixed = materialize(mixed.where("m > 1 AND least = 1").select("gram", "bytes"), "mixed")
    n_bytes = mixed.agg(F.coalesce(F.sum(F.when(F.col("bytes") <= heavy, F.col("bytes"))), F.lit(0))).first()[0]
    shards = max(1, -(-int(n_bytes) // SHARD))
    wanted = member_filter(mixed, "gram")

    def contexts_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for pdf in sliced(batches):
            frame, bodies = cut(pdf, seen, wanted)
            yield frame[["gram", "digest"]].assign(body=bodies).drop_duplicates(["gram", "digest"])

    bodies = src.mapInPandas(contexts_of, "gram long, digest long, body binary").dropDuplicates(["gram", "digest"])
    counted = contexts.join(mixed, "gram").select("gram", "digest", "n", "bytes")
    bodies = materialize(bodies.join(counted, ["gram", "digest"]), "bodies")

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        """Anchors are indexed together up to INDEX bytes, so that memory is bounded."""
        pdf = pdf.sort_values("gram", kind="stable").reset_index(drop=True)
        size, gram, twins = pdf["body"].map(len).to_numpy(), pdf["gram"].to_numpy(), pdf["n"].to_numpy() > 1
        marked, begin = [], 0
        ends = np.append(np.flatnonzero(np.diff(gram)) + 1, len(gram))  # of each anchor's contexts
        for i, end in enumerate(ends.tolist()):
            if i + 1 == len(ends) or size[begin : ends[i + 1]].sum() > INDEX:
                matches = match_lengths([bytes(b) for b in pdf["body"].iloc[begin:end]], twins[begin:end])
                marked += [_spans(m[: len(m) - length + 1] >= length, length) for m in matches]
                begin = end
        out = pdf[["gram", "digest"]].assign(spans=[[{"s": s, "e": e} for s, e in x] for x in marked])
        return out[[bool(x) for x in marked]]

    light = bodies.where(F.col("bytes") <= heavy).withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards)))
    light = light.select("shard", "gram", "digest", "n", "body").groupBy("shard").applyInPandas(lambda pdf: index(pdf), MARKS)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, d, n, body in zip(pdf["gram"], pdf["digest"], pdf["n"], pdf["body"], strict=True):
                at = range(len(body) - length + 1)
                w = [xxhash.xxh3_128_digest(body[i : i + length]) for i in at]
                yield pd.DataFrame({"gram": g, "digest": [d] * len(at), "n": n, "at": list(at), "w": w})

    hashed = bodies.where(F.col("bytes") > heavy).select("gram", "digest", "n", "body")
    hashed = hashed.mapInPandas(windows, "gram long, digest long, n long, at int, w binary")
    twice = hashed.groupBy("w").agg(F.sum("n").alias("c")).where("c > 1").select("w")
    span = F.struct(F.col("at").alias("s"), (F.col("at") + length).alias("e"))
    plain = hashed.join(twice, "w").groupBy("gram", "digest").agg(F.collect_list(span).alias("spans"))

    alike = contexts.where("n > 1").join(mixed, "gram", "left_anti").select(
        "gram", "digest", F.array(F.struct(F.lit(0).alias("s"), F.col("size").alias("e"))).alias("spans")
    )
    marks = materialize(alike.unionByName(light).unionByName(plain), "marks")
    spans = found.join(marks, ["gram", "digest"]).select("key", "first", F.explode("spans").alias("x"))
    spans = spans.select("key", F.struct((F.col("first") + F.col("x.s")).alias("s"), (F.col("first") + F.col("x.e")).alias("e")).alias("x"))
    spans = spans.join(full.select("key"), "key", "left_anti").distinct()
    return materialize(full.unionByName(spans.groupBy("key").agg(F.collect_list("x").alias("spans"))), "cover")


def remove(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, bytes kept)."""
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, [s for s, _ in spans], 1)
    np.add.at(edge, [e for _, e in spans], -1)
    gone = np.cumsum(edge)[:-1] > 0
    runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
    return int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every input row; kept: the remaining bytes.

    Strings are judged on the input, within and across documents, and never cross documents. Null texts count as
    empty; texts below ``length`` bytes lose nothing; rows that repeat count as different documents. Extra columns
    are ignored and an empty table gives no rows.
    """
    cover = repeated_spans(docs, length, text_col, heavy)
    filt = member_filter(cover.select(F.xxhash64("key").alias("k")), "k")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = src.withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    src = src.withColumn("hit", maybe_repeated(F.xxhash64("key"), filt))
    zero = F.lit(0).cast("long")
    clean = src.where(~F.col("hit")).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.encode("text", "UTF-8").alias("kept")
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches):
            out = []
            for doc, text, spans in zip(pdf["doc_id"], pdf["text"], pdf["spans"], strict=True):
                data = utf8(text)
                out.append((doc, len(data), *remove(data, [] if spans is None else [(x["s"], x["e"]) for x in spans])))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
            yield frame.astype({"doc_id": "Int64"})

    hits = src.where("hit").select("doc_id", "text", "key").join(cover, "key", "left").select("doc_id", "text", "spans")
    return clean.unionByName(hits.mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
