"""Each stage of the corpus pipeline, on what the stage before kept, next to a brute-force version."""

import re
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

import brute
import corpus_pipeline
from wxspark.llm import secret_ledger
from wxspark.llm.common import table
from wxspark.llm.queries import QUERIES
from wxspark.session import stored

SF = "/root/testdata/sf0.01"  # the smallest one has no secret left behind the first stages
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def stages(spark):
    """Name of each stage: its input and its output, both in pandas; the columns of documents hold until the last."""
    docs, out = table(spark, SF, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        made = stored(stage(spark, docs, SF), name)
        out[name] = docs.toPandas(), made.toPandas()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == columns
        docs = made
    return out


def texts(frame):
    return {d: None if pd.isna(t) else t for d, t in zip(frame.doc_id, frame.text)}


def masked(text):
    """A text with every base secret and every private key header replaced, overlapping ones together."""
    pem = [r.pattern for r in secret_ledger.EXTRA_RULES]
    spans = [s[1:] for s in brute.secrets(text)] + [m.span() for p in pem for m in re.finditer(p, text or "")]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:] if spans else text


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    scores = QUERIES["op4_toxicity"](spark, SF).toPandas()
    stay = set(scores.doc_id[scores.score < 0.5])
    assert texts(after) == {d: t for d, t in texts(before).items() if d in stay}
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").toxic
    clean = set(labels.index[labels == 0]) & set(before.doc_id)
    assert len(clean - set(after.doc_id)) <= 0.02 * len(clean)


def test_simhash(stages):
    before, after = stages["simhash"]
    roots = brute.components([brute.simhash(None if pd.isna(t) else t) for t in before.text])
    least = before.doc_id.groupby(np.array(roots)).min()
    assert len(least) < len(before)
    assert texts(after) == {d: t for d, t in texts(before).items() if d in set(least)} and len(after) == len(least)


def test_secrets(stages):
    before, after = stages["secrets"]
    want = {d: masked(t) for d, t in texts(before).items()}
    assert texts(after) == want and len(after) == len(before)
    assert want != texts(before)
    changed = after[[want[d] != t for d, t in zip(after.doc_id, after.doc_id.map(texts(before)))]]
    assert (changed.n_chars == changed.text.str.len()).all()


def test_mixing(stages):
    before, after = stages["mixing"]
    size = {d: len(brute.WORD.findall(t or "")) for d, t in texts(before).items()}
    source = dict(zip(before.doc_id, before.source))
    copies = Counter(after.doc_id)
    assert set(copies) <= set(size) and max(copies.values()) <= 2
    assert texts(after) == {d: t for d, t in texts(before).items() if d in copies}
    per, taken = Counter(), Counter()
    for d, n in size.items():
        per[source[d]] += n
        taken[source[d]] += n * copies[d]
    for s, goal in brute.targets(per).items():
        assert abs(taken[s] - goal) <= max(5, 0.01 * goal)


def test_packing(stages):
    before, after = stages["packing"]
    want = []
    for d, ids in zip(before.doc_id, brute.tokens(before.text.fillna(""), PATH)):
        ids = ids + [2]
        head = len(ids) - 1024 * (-(-len(ids) // 1024) - 1)
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        want += [(d, i, a, b - a, brute.crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(after[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    n = brute.packed_well(after[["sequence_id", "offset", "length"]].itertuples(index=False, name=None), 1024)
    assert n <= 1.03 * -(-after.length.sum() // 1024) + 1
