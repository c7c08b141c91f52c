"""The pipeline's stages in order, on the smallest documents, each against brute force on its own input."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline as cp
from gridloom.llm import mixing, toxicity

from .test_edges import default_tokenizer, naive_features

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Each stage's input and output as frames, by name."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        before = docs
        docs = cp.materialize(stage(spark, docs, sf), f"test-{name}")
        out[name] = before.toPandas(), docs.toPandas()
    return out


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def rows(frame):
    return Counter(map(tuple, frame[COLUMNS].astype(object).where(frame.notna(), None).itertuples(index=False)))


def test_stages(stages):
    assert list(stages) == ["toxicity", "exact", "near", "mix", "pack"]
    assert all(list(after.columns) == COLUMNS for name, (_, after) in stages.items() if name != "pack")
    sizes = [len(before) for before, _ in stages.values()]
    assert sizes[0] > sizes[1] > sizes[2] and sizes[3] > 0


def test_toxicity_stage(spark, sf, stages):
    before, after = stages["toxicity"]
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    score = np.array([1 / (1 + np.exp(-np.clip(np.dot(naive_features(model, t), model.coef), -30, 30))) for t in before["text"]])
    assert rows(after) == rows(before[score < 0.7])


def test_exact_stage(stages):
    before, after = stages["exact"]
    keep = before.assign(k=before["text"].map(lower)).sort_values("doc_id").groupby("k").tail(1)
    assert rows(after) == rows(keep)


def test_near_stage(stages):
    """One document, the least, of each group of links of similarity 0.8 or more, by all pairs of all shingle sets."""
    before, after = stages["near"]
    sets = []
    for text in before["text"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(sets)))
    for j in range(len(sets)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group = [group[i] if g == group[j] else g for g in group]
    assert rows(after) == rows(before.assign(g=group).sort_values("doc_id").groupby("g").head(1))


def test_mix_stage(stages, tmp_path):
    before, after = stages["mix"]
    before.to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    want = {r.doc_id: r.taken for r in con.sql(mixing.SQL).df().itertuples()}
    got = Counter()
    for doc, text in zip(after["doc_id"], after["text"], strict=True):
        got[doc] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert {d: n for d, n in want.items() if n} == {d: n for d, n in got.items() if n}


def test_pack_stage(stages):
    before, after = stages["pack"]
    encode = default_tokenizer()
    tokens = Counter()
    for doc, text in zip(before["doc_id"], before["text"], strict=True):
        tokens[doc] += len(encode([text or ""])[0]) + 1
    assert after.groupby("doc_id")["length"].sum().to_dict() == dict(tokens)
    for _, piece in after.sort_values("offset").groupby("sequence_id"):
        assert piece["offset"].tolist() == [0, *piece["length"].cumsum().tolist()[:-1]] and piece["length"].sum() <= 2048


def test_run(spark, sf, stages):
    got = cp.run(spark, sf).toPandas()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    pieces = lambda f: Counter(f.groupby("doc_id")["length"].sum().items())
    assert pieces(got) == pieces(stages["pack"][1]) and set(columns) <= set(got.columns)


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf).count() == 0
