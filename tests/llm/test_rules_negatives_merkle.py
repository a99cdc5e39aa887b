"""Quality rules, hard negatives and the Merkle manifest next to plain versions of their contracts, and their odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import brute
from odd_rows import TEXTS, empty, odd  # noqa: F401
from wxspark.llm import hard_negatives, merkle, quality_rules
from wxspark.llm.queries import QUERIES
from wxspark.session import stored

SF = "/root/testdata/sf0.001"


def base_counts(text):
    text = text or ""
    words = brute.WORD.findall(text)
    lines = [x for x in text.split("\n") if brute.WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def full_verdict(text):
    """Words of broken rules, worked out with fractions in place of the compiled table."""
    n, chars, symbols, dup, repeat, failed = base_counts(text)
    words, lines = brute.WORD.findall(text or ""), [x for x in (text or "").split("\n") if brute.WORD.search(x)]
    stops = sum(w.strip(".,;:!?\"'()").lower() in quality_rules.ALL_STOP_WORDS for w in words)
    out = (["few_words"] if n < 50 else []) + (["repeated_words"] if n and repeat / n > 0.5 else [])
    if n:
        out += ["word_length"] if not 2 <= chars / n <= 12 else []
        out += ["symbols"] if symbols / n > 0.5 else []
        out += ["shouts"] if sum(c in "!?" for c in text) / n > 0.8 else []
        out += ["stop_words"] if stops / n < 0.04 else []
        out += ["dup_lines"] if dup / len(lines) > 0.5 else []
        out += ["bullet_lines"] if sum(x.lstrip(" \t\x0b\x0c\r")[0] in "-*•" for x in lines) / len(lines) > 0.9 else []
        out += ["ellipsis_lines"] if sum(x.rstrip(" \t\x0b\x0c\r").endswith(("...", "…")) for x in lines) / len(lines) > 0.3 else []
    return ",".join(out)


ODD_TEXTS = [
    "a b c " * 40, "a b c a b c", "a b a b a b a b", "x " * 60, "- one\n- two\n* three\n• four", "wait...\nso…\n end", "# $ % & | < > *", "!!!!!? " * 60,
    "the of and to " * 30 + "\n" + "the of and to " * 30, " ".join(f"the w{i}" for i in range(60)), "line\nline\nline\n\n \nother", "nul\x00word \x1cone\x85two three", "q r s t q r s u q r",
]


@pytest.mark.parametrize("source", ["table", "odd"])
def test_quality_rules(spark, odd, source):
    if source == "table":
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        got = QUERIES["op11_quality_rules"](spark, SF).collect()
    else:
        texts = dict(enumerate([*TEXTS, *ODD_TEXTS]))
        got = quality_rules.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(texts[r.doc_id]), r.doc_id
        assert r.broken == full_verdict(texts[r.doc_id]) and r.kept == (not r.broken) and not (r.kept and r.base_failed)


def test_quality_rules_find_junk_and_keep_the_rest(spark):
    known = quality_rules.report(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    good, bad = known[(known.quality == 1) & ~known.base_failed], known[known.quality == 0]
    assert good.kept.mean() > 0.995 and bad.kept.mean() < 0.1


def test_rule_table_compiles(spark):
    rules = (quality_rules.Rule("long", "n_words", None, most=200), quality_rules.Rule("symbols", "n_symbols", "n_words", least=10, most=20))
    df = spark.createDataFrame([("a b c",), ("a #",), ("a b c d e f g #",), (None,)], "text string")
    got = [r.quality.broken for r in quality_rules.judged(df, rules=rules, base=()).collect()]
    assert got == ["long,symbols", "symbols", "long", ""]


def test_quality_rules_keep_columns(odd, empty):
    got = quality_rules.judged(odd)
    assert got.columns == [*odd.columns, "quality"] and got.count() == odd.count()
    assert quality_rules.judged(empty).count() == 0
    table = odd.sparkSession.read.parquet(f"{SF}/documents.parquet")
    plan = quality_rules.judged(table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def plain_negatives(rows, positives=5, negatives=3):
    """rows: (vec_id, label, numbers), usable ones only."""
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    out = []
    for i, (a, la, va) in enumerate(rows):
        if a is None or a % 50:
            continue
        scored = [(-dot(va, v), c, j, lab) for j, (c, lab, v) in enumerate(rows) if j != i and len(v) == len(va)]
        near = sorted((s, c, j) for s, c, j, lab in scored if lab == la)[:positives]
        for s, p, _ in near:
            hard = sorted((t, c, j) for t, c, j, lab in scored if lab != la and 50 * -s <= 100 * -t <= 95 * -s)[:negatives]
            out += [(a, p, r + 1, c, -s, -t) for r, (t, c, _) in enumerate(hard)]
    return sorted(out)


NEGATIVES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives(spark):
    import pandas as pd

    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    rows = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, np.floor(256 * np.asarray(v, float)).astype(int).tolist()) for i, lab, v in zip(e.vec_id, e.label, e.embedding)]
    got = QUERIES["op12_hard_negatives"](spark, SF).select(*NEGATIVES).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows)


def test_hard_negatives_odd_rows(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, rnd.randrange(3), [float(rnd.randrange(-3, 9)) for _ in range(4)], "x") for i in range(0, 900, 10)]
    rows += [(1000 + i, i % 2, [2.0, 2.0, 2.0, 2.0], "same") for i in range(60)]  # ties
    rows += [(2000, 1, [], "no"), (2050, 1, [], "no"), (2051, 2, [], "no"), (2100, 0, [1.0, 2.0], "short"), (2101, 0, [3.0, 4.0], "short"), (2102, 1, [2.0, 2.5], "short")]
    rows += [(3000, None, [1.0] * 4, "n"), (3050, 1, None, "n"), (3100, 1, [1.0, None, 1.0, 1.0], "n"), (3150, 1, [float("nan")] * 4, "n"), (3200, 1, [float("inf")] * 4, "n")]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, block string").repartition(3).persist()
    want = plain_negatives([(i, lab, [int(x) for x in v]) for i, lab, v, _ in rows if lab is not None and v is not None and all(x is not None and abs(x) < 100 for x in v)])
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 7)
    monkeypatch.setattr(hard_negatives, "SLICE", 4)
    for group, run in ((4096, 16), (5, 2)):
        monkeypatch.setattr(hard_negatives, "GROUP_ROWS", group)
        monkeypatch.setattr(hard_negatives, "RUN", run)
        got = hard_negatives.mined(hard_negatives.prepared(df, 1), "vec_id % 50 = 0").select(*NEGATIVES).collect()
        assert sorted(map(tuple, got)) == want
    assert hard_negatives.mined(hard_negatives.prepared(df.limit(0), 1), "vec_id % 50 = 0").count() == 0
    # Repeated and null ids are rows of their own.
    few = spark.createDataFrame([(50, 1, [2.0]), (50, 1, [2.0]), (None, 1, [3.0]), (None, 2, [1.5]), (7, 2, [1.0])], "vec_id long, label int, embedding array<double>")
    got = hard_negatives.mined(hard_negatives.prepared(few, 10), "vec_id % 50 = 0").select(*NEGATIVES).collect()
    both = [(50, None, 1, None, 600, 300), (50, 50, 1, None, 400, 300), (50, 50, 2, 7, 400, 200)]
    assert sorted(map(tuple, got), key=str) == sorted(both * 2, key=str)


@pytest.mark.parametrize(("dim", "low", "high", "n"), [(64, -120, 120, 37), (3, -5, 5, 1), (8, -(2**20), 2**20, 10), (4, -(2**26), 2**27, 70), (5, -(2**29), 2**29, 33), (0, -1, 1, 3), (6, 0, 1, 9)])
def test_packed_products_are_exact(dim, low, high, n):
    rnd = np.random.default_rng(dim)
    a, c = rnd.integers(low, high, (4, dim)), rnd.integers(low, high, (n, dim))
    want = np.array([[sum(x * y for x, y in zip(p, q)) for q in c.tolist()] for p in a.tolist()], object).reshape(4, n)
    assert (hard_negatives.products(a, c) == want).all() and (hard_negatives.products(a, c, 1) == want).all()


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, more=0):
    n = None if r["n_chars"] is None else r["n_chars"] + more
    return digest(*map(said, (r["doc_id"], r["source"], r["lang"], n, r["text"])))


def plain_tree(nodes, k):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + k]) for i in range(0, len(levels[-1]), k)])
    return levels


def plain_manifest(rows, k=2):
    by = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))):
        by.setdefault(r["lang"], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([leaf_of(r) for r in by[x]], k) for x in langs}
    top = plain_tree([trees[x][-1][0] for x in langs], k)
    root, out = top[-1][0], []
    for g, x in enumerate(langs):
        for i, r in enumerate(by[x]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            now, proof = leaf_of(r, int(hit)), []
            for levels, at in ((trees[x], i), (top, g)):
                for nodes in levels[:-1]:
                    start = at // k * k
                    run = nodes[start : start + k]
                    proof += run[: at - start] + run[at - start + 1 :]
                    now = digest(*run[: at - start], now, *run[at - start + 1 :])
                    at //= k
            out.append((r["doc_id"], leaf_of(r), trees[x][-1][0], root, digest(*proof), now, now == root))
    return sorted(out, key=str)


MERKLE = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_merkle(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op13_merkle_manifest"](spark, SF).select(*MERKLE).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_merkle_odd_rows(spark, odd, empty, fanout):
    plain = [r.asDict() for r in odd.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    clash = odd.withColumn("_key", odd.rank).withColumn("digest", odd.text).withColumn("pos", odd.length).withColumn("tree", odd.length)
    got = merkle.report(clash, fanout).select(*MERKLE).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(plain, fanout)
    assert merkle.report(empty, fanout).count() == 0
    one = odd.where("doc_id = 0")
    got = merkle.report(one, fanout).first()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == digest()


def test_a_changed_row_changes_the_root(spark, odd):
    def root(df):
        return bytes(merkle.manifest(df, ["doc_id", "text"], "doc_id", "lang").first()["root"])

    small = stored(odd.select("doc_id", "text", "lang").where("doc_id < 9"))
    assert root(small) == root(small.repartition(5)) != root(small.where("doc_id <> 3"))
