"""Each operator's query over whole tables next to a brute-force version."""

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

import brute
from wxspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs():
    d = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    d["text"] = d["text"].fillna("")
    return d


def run(spark, n, sf=SF):
    name = next(q for q in QUERIES if q.startswith(f"op{n}_"))
    return QUERIES[name](spark, sf).toPandas()


def test_packing(spark, docs):
    got = run(spark, 1).sort_values(["doc_id", "piece"])
    want = []
    for d, ids in zip(docs.doc_id, brute.tokens(docs.text, PATH)):
        ids = ids + [2]
        k = -(-len(ids) // 1024)
        head = len(ids) - 1024 * (k - 1)
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        want += [(d, i, a, b - a, brute.crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert want == list(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    n = brute.packed_well(got[["sequence_id", "offset", "length"]].itertuples(index=False, name=None), 1024)
    assert n <= 1.03 * -(-got.length.sum() // 1024) + 1


def test_secrets(spark, docs):
    got = run(spark, 3).sort_values("doc_id")
    for r, text in zip(got.itertuples(), docs.text):
        spans = brute.secrets(text)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    got = run(spark, 4, sf)
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    known = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    later = known[known.held_out]
    pos, neg = later[later.toxic == 1].score.to_numpy(), later[later.toxic == 0].score.to_numpy()
    auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    # A part of the labels is noise: toxic rows without any insult.
    assert auc > 0.8 and (neg >= 0.5).mean() < 0.02 and (pos >= 0.5).mean() > 0.65
    print("auc", auc, "clean flagged", (neg >= 0.5).mean(), "toxic found", (pos >= 0.5).mean())


def test_simhash(spark, docs):
    got = run(spark, 5).sort_values("doc_id")
    fps = [brute.simhash(t) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{f:016x}" for f in fps]
    roots = brute.components(fps)
    ids = docs.doc_id.tolist()
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, ids[i]), ids[i])
    assert got.component_id.tolist() == [least[r] for r in roots]


def test_topk(spark):
    got = run(spark, 6)
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    rows = [(i, np.floor(64 * np.asarray(v, float)).astype(int).tolist()) for i, v in zip(e.vec_id, e.embedding)]
    assert sorted(got[["query_id", "rank", "vec_id", "score"]].itertuples(index=False, name=None)) == brute.top(rows, 20, lambda i: i % 20 == 0)


def test_minhash(spark, docs):
    got = run(spark, 7).sort_values("doc_id")
    changed = brute.edited(docs.text.tolist())
    assert got.n_chars.tolist() == docs.text.str.len().tolist()
    assert got.edited_sha256.tolist() == [brute.sha(t) for t in changed]
    assert got.near_edited.mean() > 0.4 > got.near_next.mean() + 0.3
    assert got.groupby(docs.text.to_numpy()).fingerprint.nunique().max() == 1


def test_mixing(spark, docs):
    got = run(spark, 8).sort_values("doc_id")
    sizes = [len(brute.WORD.findall(t)) for t in docs.text]
    assert got["size"].tolist() == sizes
    per = dict(pd.Series(sizes).groupby(docs.source.to_numpy()).sum())
    goal = brute.targets(per)
    assert np.allclose(got.target, [goal[s] for s in docs.source])
    assert (got.taken <= 2 * got["size"]).all() and (got.source_size.to_numpy() == [per[s] for s in docs.source]).all()
    for s, rows in got.groupby(docs.source.to_numpy()):
        assert abs(rows.taken.sum() - goal[s]) <= max(5, 0.01 * goal[s])


def test_token_files(spark, docs):
    got = run(spark, 10).sort_values("doc_id")
    ids = [t + [2] for t in brute.tokens(docs.text, PATH)]
    n = np.array([len(t) for t in ids])
    assert got.n_tokens.tolist() == n.tolist() and got.start.tolist() == (np.cumsum(n) - n).tolist()
    assert got.ids_crc32.tolist() == [brute.crc(t) for t in ids]
