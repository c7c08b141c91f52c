"""Registered queries against their SQL, and the others against brute force, on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from gridloom.llm import media, packing, simhash, suffix, toxicity
from gridloom.llm import queries as lq

from .. import oracle


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(lq.ORACLE))
def test_query_equals_sql(spark, sf, name):
    oracle.check(spark, sf, lq.QUERIES[name], lq.ORACLE[name])


def test_media_round_trip(spark, sf, texts):
    got = media.op3_media(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        data = texts[r.doc_id].encode()
        payload = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
        stored = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(data), len(payload), len(stored))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_sha256 == hashlib.sha256(stored).hexdigest()
        assert r.feature == naive_feature(payload)


def naive_feature(payload):
    """Mean, variance and the average block's hash, sample by sample."""
    mean = sum(payload) / len(payload)
    blocks = [[0] * 8 for _ in range(8)]
    for i, v in enumerate(payload):
        row, col = i // 24 % 24, i % 24
        blocks[row // 3][col // 3] += v
    bits = "".join("1" if 64 * x > sum(map(sum, blocks)) else "0" for line in blocks for x in line)
    return f"mean={mean:.4f};var={sum(v * v for v in payload) / len(payload) - mean * mean:.4f};hash={int(bits, 2):016x}"


def check_pieces(pieces, wanted):
    """Every id once, sequences gapless and within the limit; returns the filled share of sequences."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, want in wanted.items():
        own = sorted(docs[doc], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in own]).tolist() == want
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert all(r.doc_tokens == len(want) and r.length * 4 == len(r.ids) for r in own)
    for rows in sequences.values():
        rows = sorted(rows, key=lambda r: r.offset)
        assert [r.offset for r in rows] == [0, *np.cumsum([r.length for r in rows])[:-1].tolist()]
        assert sum(r.length for r in rows) <= packing.LENGTH
    return sum(map(len, wanted.values())) / (packing.LENGTH * len(sequences))


def test_packing_covers_every_token(spark, sf, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = {d: model.encode(t, add_special_tokens=False).ids + [1] for d, t in texts.items()}
    assert check_pieces(packing.pack(spark.read.parquet(f"{sf}/documents.parquet")).collect(), wanted) > 0.98


def naive_fingerprint(text, shingle=3):
    """By the definition, bit by bit, on text rather than bytes."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    spans = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_against_their_definition(texts):
    odd = ["", " \t", "One", "one TWO", "a b c d", "É é ı İ ß", "x\u00a0y z\u2003w v", "same same same same same", "line\x0b\x0cfeed \x1c word here", "漢字 かな 한글 テスト"]
    for text in [None, *odd, *list(texts.values())[:80]]:
        assert simhash.fingerprint(text) == naive_fingerprint(text)


def test_simhash_components(spark, sf, texts):
    got = {r.doc_id: r for r in simhash.op9_simhash(spark, sf).collect()}
    ids = sorted(texts)
    fps = np.array([naive_fingerprint(texts[i]) for i in ids], np.uint64)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2), strict=True):
        x, y = sorted((find(ids[a]), find(ids[b])))
        parent[y] = x
    for i, fp in zip(ids, fps.tolist(), strict=True):
        assert got[i].fingerprint == f"{fp:016x}" and got[i].component_id == find(i)


def brute_removed(datas, length=200):
    seen = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    return [suffix.remove(d, [(i, i + length) for i in range(len(d) - length + 1) if seen[d[i : i + length]] > 1]) for d in datas]


def test_repeated_substrings(spark, sf, texts):
    got = {r.doc_id: r for r in suffix.op7_suffix(spark, sf).collect()}
    for (doc, text), (gone, spans, kept) in zip(texts.items(), brute_removed([t.encode() for t in texts.values()]), strict=True):
        r = got[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(text.encode()), gone, spans, hashlib.sha256(kept).hexdigest())


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in toxicity.op8_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.predicted == (r.score >= 0.7) for r in rows)
    toxic, clean = [r for r in rows if labels[r.doc_id]], [r for r in rows if not labels[r.doc_id]]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
