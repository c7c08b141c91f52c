"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments (22, 21 and 21 bits), each a word of the perfect binary Golay code
of length 23. A word lies within 3 flips of exactly one codeword; a word at distance 3 lies within 4 flips of
five more. Two words one flip apart always share one of these one or six codewords: the codeword nearest to either
is within 4 flips of the other. Two fingerprints at most 2 bits apart have, by the pigeonhole principle, an
error-free segment whose next segment (cyclically) holds at most one error. So each fingerprint gets, for every
segment, keys made of that segment's exact bits and each codeword index of the next one; every linked pair shares a
key. Pairs that share a key are verified by their Hamming distance.

A key that more than DENSE fingerprints share is resolved without pairs: each of them emits itself and its 64 one-bit
neighbours. Two fingerprints emit a common word exactly if they differ in at most 2 bits, so linking all emitters of
a word to the least of them gives the same components with 65 rows a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations, combinations_with_replacement, pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import maybe_repeated, member_filter
from .common import LOWER_BYTES, materialize, sliced, utf8
from .components import components

#: Generator polynomial of the binary Golay code of length 23.
GOLAY = 0xC75
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_DISTANCE = 2
#: Members of a key up to which its pairs are compared one by one; 65 rows a member cost less beyond about twice this.
DENSE = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the lower-cased (A-Z) word shingles, repeats included; no words: 0; fewer words: all of them."""
    words = utf8(text).translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        spans = [(0, len(joined))]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer. Null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, shingle) for t in pdf["text"]], np.uint64).astype(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp})

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    if kind != "bigint":
        raise TypeError(f"{id_col} must be a bigint, not {kind}")
    return src.mapInPandas(run, "doc_id long, fp long")


def _remainders(words: np.ndarray) -> np.ndarray:
    """Syndromes: remainders of 23-bit words modulo the generator polynomial."""
    r = words.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where((r >> bit) & 1 == 1, r ^ (GOLAY << (bit - 11)), r)
    return r


@lru_cache(maxsize=1)
def error_patterns() -> np.ndarray:
    """For each syndrome the error patterns of weight <= 4: one, or six where the lightest has weight 3 (else -1)."""
    table = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], np.int64)
        for e, s in zip(errors.tolist(), _remainders(errors).tolist(), strict=True):
            table[s, used[s]] = e
            used[s] += 1
    return table


def golay_indices(words: np.ndarray) -> np.ndarray:
    """The 12-bit indices of all codewords within 4 flips of each 23-bit word, padded with -1 to six."""
    errors = error_patterns()[_remainders(words)]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in fps, keys): segment number, exact segment and codeword index of the next segment in one integer."""
    u = fps.astype(np.uint64)
    parts = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    where, keys = [], []
    for s, exact in enumerate(parts):
        index = golay_indices(parts[(s + 1) % 3])
        row, col = np.nonzero(index >= 0)
        where.append(row)
        keys.append((s << 40) | (exact[row] << 12) | index[row, col])
    return np.concatenate(where), np.concatenate(keys)


def _links(unique: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all of ``unique``'s fp at most MAX_DISTANCE bits apart, directly or by a path."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = pdf["fp"].to_numpy(np.int64)
            at, keys = fuzzy_keys(fps)
            yield pd.DataFrame({"key": keys, "fp": fps[at]})

    keyed = materialize(unique.select("fp").mapInPandas(emit, "key long, fp long"), "golay-keys")
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "golay-shared")
    members = materialize(keyed.join(shared, "key"), "golay-members")

    def verify(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            us, vs = [], []
            for fps in pdf["fps"]:
                fps = np.sort(np.asarray(fps, np.int64))
                bits = fps.view(np.uint64)  # of signed numbers bitwise_count takes the absolute value
                far = np.bitwise_count(bits[:, None] ^ bits[None, :])
                i, j = np.nonzero(np.triu(far <= MAX_DISTANCE, 1))
                us.append(fps[i])
                vs.append(fps[j])
            yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    sparse = (
        members.where(f"n <= {DENSE}")
        .groupBy("key")
        .agg(F.collect_list("fp").alias("fps"))
        .select("fps")
        .mapInPandas(verify, "u long, v long")
    )

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flips = np.concatenate(([0], 1 << np.arange(64, dtype=np.uint64))).astype(np.uint64)
        for pdf in batches:
            fps = pdf["fp"].to_numpy(np.int64)
            for i in range(0, len(fps), 4096):
                part = fps[i : i + 4096]
                mid = (part.astype(np.uint64)[:, None] ^ flips[None, :]).astype(np.int64)
                yield pd.DataFrame({"mid": mid.ravel(), "fp": np.repeat(part, 65)})

    dense = members.where(f"n > {DENSE}").select("fp").distinct().mapInPandas(neighbours, "mid long, fp long")
    dense = dense.groupBy("mid").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where("size(fps) > 1")
    dense = dense.select(F.col("fps")[0].alias("u"), F.explode(F.slice("fps", 2, 64)).alias("v"))  # 65 emitters at most
    return sparse.union(dense).distinct()


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every input row.

    Fingerprints at most 2 bits apart are linked, and so are equal ones; component_id is the least id reachable.
    Null and empty texts have fingerprint zero and are linked like any other. Null ids get a fingerprint and the
    least known id of their component. Repeated rows stay repeated; extra columns are ignored.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fps")
    unique = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps-unique")
    roots = components(_links(unique))
    joined = unique.join(roots, unique.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    joined = materialize(joined, "fps-roots")
    least = materialize(joined.groupBy("root").agg(F.min("least").alias("component_id")), "fps-least")
    ids = materialize(joined.join(least, "root").select("fp", "component_id"), "fps-components")
    return fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies by similarity: texts that share 0.8 of their five-word shingles


#: Orders of all shingles. The least shingle of a set in each order is a key; a pair of similarity s misses all keys once in
#: (1 - s) ** -ORDERS times, at 0.8 once in 15,000.
ORDERS = 6
#: Members of a block. A key's members are dealt over blocks by their hash and meet in every pair of blocks; BLOCKS of them move
#: together, so that a row of a key with n members moves n / (CROWD * BLOCKS) times.
CROWD, BLOCKS = 256, 8
#: Bits of 256 in which two sets of similarity 0.8 may differ: 39 are expected, with a deviation of 6. Sets below SMALL
#: shingles have coarser fingerprints and are compared as sets without asking them.
REACH, SMALL = 60, 32
#: Sets up to which all members of two blocks are compared in one place; larger ones meet pair by pair.
BIG = 1 << 16
#: One text of SAMPLE is read to find common shingles: in SAMPLE_SHARE or more of those, at most COMMON. Texts that hold one get
#: keys without them besides, which keeps boilerplate from hiding what else they share.
SAMPLE, SAMPLE_SHARE, COMMON = 64, 4, 1 << 17
_MIX = np.random.default_rng(11).integers(0, 1 << 64, (2, 2 * ORDERS + 4), dtype=np.uint64) | np.uint64(1)


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; fewer words: all of them; no words: none."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64))


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _mixed(shingles: np.ndarray, orders: range) -> np.ndarray:
    """A row of mixed hashes for each order."""
    at = list(orders)
    h = (shingles[None, :] ^ _MIX[0][at][:, None]) * _MIX[1][at][:, None]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def least_shingles(shingles: np.ndarray, common: np.ndarray) -> list[int]:
    """Keys of a set: its least shingle in each order and, if it holds common ones, its least others; common is sorted."""
    if not len(shingles):
        return []
    keys = _mixed(shingles, range(ORDERS)).min(axis=1)
    if len(common):
        rare = shingles[common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] != shingles]
        if 0 < len(rare) < len(shingles):
            keys = np.concatenate((keys, _mixed(rare, range(ORDERS, 2 * ORDERS)).min(axis=1)))
    return keys.astype(np.int64).tolist()


def set_fingerprint(shingles: np.ndarray) -> list[int]:
    """256 bits of a set as four signed integers: a bit is 1 if set in over half of the shingles' hashes."""
    ones = np.zeros(256, np.int64)
    for i in range(0, len(shingles), 1 << 14):
        part = _mixed(shingles[i : i + (1 << 14)], range(2 * ORDERS, 2 * ORDERS + 4)).T
        ones += np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(-1, 32), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(shingles)).view(np.int64).tolist()


def packed(shingles: np.ndarray) -> bytes:
    """The upper 40 bits of each hash: what moves to be compared. Of two sets of 400, one pair in ten million differs in that."""
    return np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return np.unique(out.view(np.uint64).ravel())


def similar(both, total):
    """Whether sets of ``total`` elements together, of which ``both`` in each, have Jaccard similarity 0.8 or more."""
    return 9 * both >= 4 * total


def _words(text: str | None) -> list[bytes]:
    return utf8(text).translate(LOWER_BYTES).split()


def _common_shingles(src: DataFrame, shingle: int) -> np.ndarray:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches):
            found = [shingle_set(_words(t), shingle) for t in pdf["text"]]
            yield pd.DataFrame({"h": np.concatenate([np.zeros(0, np.uint64), *found]).astype(np.int64)})

    some = src.where(F.pmod(F.xxhash64("tid"), F.lit(SAMPLE)) == 0).select("text").mapInPandas(read, "h long")
    top = some.groupBy("h").agg(F.count("*").alias("n")).where(f"n >= {SAMPLE_SHARE}").orderBy(F.desc("n"), "h").limit(COMMON)
    return np.sort(np.array([r.h for r in top.collect()], np.int64).view(np.uint64))


def _forest(far: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a least spanning forest of a symmetric boolean matrix ``linked`` with lengths ``far``."""
    cost = np.where(linked, far, 1 << 20)
    best, near, left = np.full(len(far), 1 << 20), np.full(len(far), -1), np.ones(len(far), bool)
    us, vs = [], []
    for _ in range(len(far)):
        i = int(np.argmin(np.where(left, best, 1 << 21)))
        if near[i] >= 0 and best[i] < 1 << 20:
            us.append(int(near[i]))
            vs.append(i)
        left[i] = False
        closer = left & (cost[i] < best)
        best[closer], near[closer] = cost[i][closer], i
    return np.array(us, np.int64), np.array(vs, np.int64)


def _possible(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits that differ, whether the nodes may be similar and differ in root) for all pairs of rows (node, root, size, f0 to f3)."""
    far = np.bitwise_count(x[:, None, 3:].view(np.uint64) ^ y[None, :, 3:].view(np.uint64)).sum(axis=2, dtype=np.int64)
    less, more = np.minimum(x[:, None, 2], y[None, :, 2]), np.maximum(x[:, None, 2], y[None, :, 2])
    return far, (x[:, None, 1] != y[None, :, 1]) & (5 * less >= 4 * more) & ((far <= REACH) | (less < SMALL))


_BITS = ["f0", "f1", "f2", "f3"]


def _runs(batches: Iterator[pd.DataFrame], by: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Groups of rows that are sorted by their first ``by`` columns: a matrix of the long columns, and the shingles if there are any."""
    rest = None
    for pdf in batches:
        rows = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        longs = rows.drop(columns="shingles", errors="ignore").to_numpy(np.int64)
        data = rows["shingles"].to_numpy() if "shingles" in rows else None
        cuts = [0, *(np.flatnonzero((longs[1:, :by] != longs[:-1, :by]).any(axis=1)) + 1).tolist()]
        for i, j in pairwise(cuts):
            yield longs[i:j], None if data is None else data[i:j]
        rest = rows.iloc[cuts[-1] :]
    if rest is not None and len(rest):
        yield rest.drop(columns="shingles", errors="ignore").to_numpy(np.int64), rest["shingles"].to_numpy() if "shingles" in rest else None


def _parts(arrays: Iterator[np.ndarray], columns: list[str], rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """The rows of many small arrays in frames of about so many."""
    out, n = [], 0
    for x in arrays:
        out.append(x)
        n += len(x)
        if n >= rows:
            yield pd.DataFrame(np.concatenate(out), columns=columns)
            out, n = [], 0
    if out:
        yield pd.DataFrame(np.concatenate(out), columns=columns)


def _longs(columns: list[str]) -> str:
    return ", ".join(f"{c} long" for c in columns)


def _forests(members: DataFrame) -> DataFrame:
    """Pairs (u, v) of a spanning forest of the nodes of each block of a key that may be similar, by size and fingerprint."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pairs():
            for x, _ in _runs(batches, 2):
                if len(x) > 1:
                    x = x[:, [2, 2, *range(3, x.shape[1])]]  # each node is its own root
                    i, j = _forest(*_possible(x, x))
                    yield np.column_stack((x[i, 0], x[j, 0]))

        return _parts(pairs(), ["u", "v"])

    rows = members.select("key", "block", "node", "size", *_BITS)
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "node").mapInPandas(link, _longs(["u", "v"]))


def _meetings(rooted: DataFrame) -> DataFrame:
    """(meeting, node, root, size, f0 to f3): all pairs of a key's nodes that may be similar and differ in root lie in a meeting.

    rooted: key, n, block, node, root, size, f0 to f3. A meeting has the nodes of two blocks that have such a partner in the other;
    a pair with a set beyond BIG has its own. Its number is a hash of its pairs, so that pairs found by several keys meet once.
    """
    values, together, most = ["node", "root", "size", *_BITS], BLOCKS, BIG

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def met(x, rows):
            number = xxhash.xxh3_64_intdigest(np.unique(np.sort(x[rows, 0], axis=1), axis=0).tobytes()) - (1 << 63)
            x = x[np.unique(rows)]
            return np.column_stack((np.full(len(x), number, np.int64), x))

        def meetings():
            for x, _ in _runs(batches, 3):
                lo, hi = x[0, 1:3].tolist()
                starts = np.flatnonzero(np.diff(x[:, 3], prepend=-1))
                blocks = [np.arange(i, j) for i, j in pairwise([*starts.tolist(), len(x)])]
                x, block = x[:, 4:], x[starts, 3]
                for a, b in combinations_with_replacement(range(len(blocks)), 2):
                    if block[a] // together != lo or block[b] // together != hi:
                        continue
                    i, j = np.nonzero(_possible(x[blocks[a]], x[blocks[b]])[1])
                    rows = np.column_stack((blocks[a][i], blocks[b][j]))
                    big = (x[rows, 2] > most).any(axis=1)
                    yield from (met(x, rows[k : k + 1]) for k in np.flatnonzero(big))
                    if not big.all():
                        yield met(x, rows[~big])

        return _parts(meetings(), ["meeting", *values])

    part = F.expr(f"block div {BLOCKS}")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CROWD * BLOCKS}")))
    rows = rooted.withColumn("part", part).withColumn("other", other)
    rows = rows.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "block", *values)
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "block", "node")
    return rows.mapInPandas(compare, _longs(["meeting", *values])).dropDuplicates(["meeting", "node"])


def _sets(compared: DataFrame, texts: DataFrame, src: DataFrame, shingle: int, label: str) -> DataFrame:
    """(node, shingles) of all nodes of ``compared``, and of a few others; read from one text of each."""
    wanted = materialize(texts.join(compared.select("node").distinct(), "node").groupBy("node").agg(F.min("tid").alias("tid")), f"{label}-wanted")
    # a filter lets the wanted texts through where they lie; the few others that pass find no pair
    filt = member_filter(wanted.select(F.xxhash64("tid").alias("k")), "k")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches):
            pdf = pdf[filt.again(pdf["k"].to_numpy(np.int64))]
            found = [shingle_set(_words(t), shingle) for t in pdf["text"]]
            yield pd.DataFrame({"node": [set_id(h) for h in found], "shingles": [packed(h) for h in found]})

    sets = src.select(F.xxhash64("tid").alias("k"), "text").mapInPandas(whole, "node long, shingles binary")
    return materialize(sets.dropDuplicates(["node"]), f"{label}-sets")


def _like(x: np.ndarray, y: np.ndarray) -> bool:
    return bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)))


def _confirmed(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """Those (u, v) whose whole shingle sets have Jaccard similarity 0.8 or more."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [_like(unpacked(x), unpacked(y)) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
            yield pdf.loc[np.array(ok, bool), ["u", "v"]]

    both = pairs.select("u", "v").join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("y")), "v").select("u", "v", "x", "y")
    return materialize(both.mapInPandas(confirm, "u long, v long"), f"{label}-edges")


def _confirmed_together(meetings: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """As _confirmed for all pairs of each meeting that may be similar; pairs that others connect are left out."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def edges():
            for x, data in _runs(batches, 1):
                x, own = x[:, 1:], [unpacked(d) for d in data]
                node, root = x[:, 0], x[:, 1].copy()
                for i, j in zip(*np.nonzero(np.triu(_possible(x, x)[1], 1)), strict=True):
                    if root[i] != root[j] and _like(own[i], own[j]):
                        yield np.array([[node[i], node[j]]])
                        root[root == root[j]] = root[i]

        return _parts(edges(), ["u", "v"])

    rows = meetings.join(sets, "node").select("meeting", "node", "root", "size", *_BITS, "shingles")
    rows = rows.repartition("meeting").sortWithinPartitions("meeting", "node")
    return materialize(rows.mapInPandas(confirm, _longs(["u", "v"])), f"{label}-edges")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def near_copy_groups(docs: DataFrame, text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(tid, root, n_rows): each distinct text (by its MD5), its group and how many rows of docs have the text.

    Texts of one set of shingles are one node. Nodes are linked if their sets have Jaccard similarity 0.8 or more, which whole
    sets confirm for every link. Candidates are, first, nodes whose fingerprints lie within MAX_DISTANCE bits, by Golay
    keys; then nodes that share a least shingle in one of several orders and whose wide fingerprints lie within REACH bits. A
    key's members are linked by spanning forests of blocks of about CROWD first, and in larger keys to one of them; what differs
    in root after that is compared pair by pair, in all pairs of blocks, however many members a key has.
    """
    src = docs.select(_text_id(F.col(text_col)).alias("tid"), F.col(text_col).alias("text"))
    common = _common_shingles(src, shingle)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches):
            found = [shingle_set(_words(t), shingle) for t in pdf["text"]]
            bits = np.array([set_fingerprint(h) for h in found], np.int64).reshape(-1, 4)
            yield pd.DataFrame({
                "tid": pdf["tid"], "node": [set_id(h) for h in found], "size": [len(h) for h in found],
                **{f"f{i}": bits[:, i] for i in range(4)}, "keys": [least_shingles(h, common) for h in found],
            })

    schema = "tid binary, node long, size long, f0 long, f1 long, f2 long, f3 long, keys array<long>"
    texts = materialize(src.mapInPandas(read, schema), "near-texts")
    values = ["size", *_BITS]
    nodes = texts.groupBy("node").agg(*[F.first(c).alias(c) for c in [*values, "keys"]])
    nodes = materialize(nodes, "near-nodes")

    keyed = nodes.select(F.explode("keys").alias("key"), "node", *values)
    counts = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-shared")
    block = F.pmod(F.xxhash64("node"), F.expr(f"(n + {CROWD - 1}) div {CROWD}"))
    members = materialize(keyed.join(counts, "key").withColumn("block", block), "near-members")
    crowds = members.where(f"n > {CROWD}")
    first = crowds.groupBy("key").agg(F.min(F.struct(F.xxhash64("node"), "node")).getField("node").alias("v"))
    first = materialize(first.join(nodes.select(F.col("node").alias("v"), *[F.col(c).alias(f"v{c}") for c in values]), "v"), "near-first")
    differ = reduce(Column.__add__, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"v{c}"))) for c in _BITS])
    less, more = F.least("size", "vsize"), F.greatest("size", "vsize")
    to_first = crowds.join(first, "key").where((5 * less >= 4 * more) & ((differ <= REACH) | (less < SMALL)))
    to_first = to_first.select(F.col("node").alias("u"), "v")

    # fingerprints of 64 bits within two bits: each links its nodes to the least of them, which stands for it
    heads = materialize(nodes.groupBy("f0").agg(F.min("node").alias("head")), "near-heads")
    close = _links(heads.select(F.col("f0").alias("fp")))
    close = close.join(heads.select(F.col("f0").alias("u"), F.col("head").alias("a")), "u").join(heads.select(F.col("f0").alias("v"), F.col("head").alias("b")), "v")
    equal = nodes.join(heads, "f0").select(F.col("node").alias("u"), F.col("head").alias("v"))
    known = [close.select(F.col("a").alias("u"), F.col("b").alias("v")), equal, to_first, _forests(members)]
    known = materialize(_ordered(reduce(DataFrame.union, known)).distinct(), "near-first-pairs")
    ends = known.select(F.col("u").alias("node")).union(known.select("v"))
    edges = _confirmed(known, _sets(ends, texts, src, shingle, "near-first"), "near-first")

    roots = materialize(components(edges), "near-roots")
    several = members.where("n > 2")  # the pair of a key of two is known
    rooted = several.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    rooted = materialize(rooted.join(mixed, "key", "left_semi"), "near-rooted")
    meetings = materialize(_meetings(rooted), "near-meetings")
    more = _confirmed_together(meetings, _sets(meetings, texts, src, shingle, "near-other"), "near-other")
    roots = materialize(components(edges.union(more)), "near-roots")
    found = texts.groupBy("tid").agg(F.first("node").alias("node"), F.count("*").alias("n_rows"))
    return found.join(roots, "node", "left").select("tid", F.coalesce("root", "node").alias("root"), "n_rows")


def _text_id(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """docs with one row of each group of near copies (see near_copy_groups): its least id; all columns kept.

    Null and wordless texts form one group. Rows with an equal id are told apart by their other columns; of
    wholly equal rows one stays. A row with a null id comes after all others of its group. Texts, not ids, say
    which group a row belongs to; rows that are alone in their group are not shuffled.
    """
    groups = materialize(near_copy_groups(docs, text_col, shingle), "near-texts")
    several = materialize(groups.groupBy("root").agg(F.sum("n_rows").alias("n")).where("n > 1").select("root"), "near-several")
    grouped = materialize(groups.join(several, "root").select("tid", "root"), "near-grouped")
    # rows of texts that are certainly alone pass straight through; what passes the filter is joined with its group
    filt = member_filter(grouped.select(F.xxhash64("tid").alias("k")), "k")
    rows = docs.select(F.struct("*").alias("row"), _text_id(F.col(text_col)).alias("tid"))
    rows = rows.withColumn("maybe", maybe_repeated(F.xxhash64("tid"), filt))
    joined = rows.where("maybe").join(grouped, "tid", "left")
    order = F.struct(
        F.col(f"row.`{id_col}`").isNull(),
        F.col(f"row.`{id_col}`"),
        F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c != id_col]),
    )
    best = joined.where("root IS NOT NULL").groupBy("root").agg(F.min_by("row", order).alias("row")).select("row.*")
    return rows.where("NOT maybe").select("row.*").unionByName(joined.where("root IS NULL").select("row.*")).unionByName(best)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
