"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from odd_rows import TEXTS, empty, odd  # noqa: F401
from wxspark.llm import chat, licenses, minhash, mixing, packing, secret_ledger, simhash, token_files, tokens, topk, toxicity
from wxspark.session import scratch, stored

PATH = public_tokenizers.path("byte_bpe_50k.json")


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_encoder_matches_plain_encoding():
    rnd = np.random.default_rng(5)
    bits = ["a", "Bc", " ", "  ", "\n", "\r\n", "'s", "'", "1", "é", "\t", "x.", "!", "<|endoftext|>", "　", "\x1c", "日本", "𝒳"]
    texts = ["".join(rnd.choice(bits, rnd.integers(0, 25))) for _ in range(3000)] + [t or "" for t in TEXTS]
    e = tokens.Encoder(PATH)
    ids, n = e.encode(pa.array(texts))
    assert [a.tolist() for a in np.split(ids, np.cumsum(n)[:-1])] == brute.tokens(texts, PATH)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_of_other_vocabularies(name):
    path = public_tokenizers.path(name)
    ids, n = tokens.Encoder(path).encode(pa.array(["Hello  World", "", "a b"]))
    assert [a.tolist() for a in np.split(ids, np.cumsum(n)[:-1])] == brute.tokens(["Hello  World", "", "a b"], path)


def test_plan_is_exact_and_close_to_full():
    rnd = np.random.default_rng(3)
    for capacity, sizes in ((10, rnd.integers(1, 11, 60)), (1024, rnd.integers(1, 1025, 5000)), (7, [7, 7]), (9, [3] * 7), (5, [])):
        counts = {int(s): int((np.array(sizes) == s).sum()) for s in set(np.array(sizes).tolist())}
        made, n = packing.plan(counts, capacity)
        placed, seen = [], dict.fromkeys(counts, 0)
        for size, first, stop, base, each, offset in made:
            seen[size] += stop - first
            placed += [(base + q // each, offset + q % each * size, size) for q in range(stop - first)]
        assert seen == counts and brute.packed_well(placed, capacity) == n
        assert n >= -(-sum(s * c for s, c in counts.items()) // capacity)
        large = [s for s, _, size in placed if 3 * size > capacity]
        assert max(np.unique(large, return_counts=True)[1], default=0) <= 2


def test_packing(odd, empty):
    made = stored(packing.pieces(odd, PATH, 64, 2))
    assert made.select("doc_id", "piece").count() == made.count()
    whole = {(d, p): i for d, p, i in rows(made, "doc_id", "piece", "ids") if d in range(len(TEXTS))}
    for d, t in enumerate(TEXTS):
        if d == 5:  # this id stands for several texts
            continue
        joined = b"".join(whole[k] for k in sorted(k for k in whole if k[0] == d))
        assert np.frombuffer(joined, "<u4").tolist() == brute.tokens([t], PATH)[0] + [2]
    placed = stored(packing.pack(made, 64, ["doc_id", "piece", "start", "ids"]))
    assert placed.count() == made.count()
    n = brute.packed_well(rows(placed, "sequence_id", "offset", "length"), 64)
    full = packing.sequences(placed).collect()
    assert len(full) == n and all(len(r.ids) == 4 * sum(r.lengths) <= 256 for r in full)
    assert packing.pack(packing.pieces(empty, PATH, 64, 2), 64, ["doc_id", "piece"]).count() == 0
    odd_sizes = odd.sparkSession.createDataFrame([(1, None), (2, 0), (3, 4)], "k int, length int")
    assert sorted(rows(packing.pack(odd_sizes, 4, ["k"]), "k", "sequence_id", "offset")) == [(1, None, None), (2, None, None), (3, 0, 0)]
    with pytest.raises(ValueError):
        packing.pack(odd_sizes, 3, ["k"])


def test_secrets(spark, odd, empty):
    got = {}
    for d, spans in rows(secret_ledger.report(odd, scratch(spark, "ledger")), "doc_id", "spans"):
        got.setdefault(d, set()).add(spans)
    for d, t in enumerate(TEXTS):
        if d != 5 and "BEGIN" not in (t or ""):
            assert got[d] == {",".join(f"{k}:{a}:{b}" for k, a, b in brute.secrets(t))}
    assert got[16] == {"pem:0:31"}
    path = scratch(spark, "ledger")
    assert secret_ledger.report(odd, path).count() == odd.count()
    # Two runs filled the ledger: every pair is there once, and base pairs of the first run's contents are not scanned again.
    pairs = secret_ledger.ledger(spark, path).withColumn("file", F.input_file_name()).collect()
    assert len(pairs) == len({(p.blob, p.rule, p.version) for p in pairs}) == len({p.blob for p in pairs}) * len(secret_ledger.RULES)
    base = {r.kind for r in secret_ledger.BASE_RULES}
    early = {p.file for p in pairs if p.blob < "8" and p.rule in base}
    assert early and not early & {p.file for p in pairs if p.blob >= "8" or p.rule not in base}
    assert secret_ledger.report(empty, scratch(spark, "ledger")).count() == 0


def test_ledger_scans_a_pair_once(spark, odd):
    path = scratch(spark, "ledger")
    blobs = odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert secret_ledger.scan(odd, path).count() == blobs * len(secret_ledger.RULES)
    assert secret_ledger.scan(odd, path).count() == blobs * len(secret_ledger.RULES)
    more = odd.select("doc_id", "text").union(spark.createDataFrame([(999, "a new version")], "doc_id long, text string"))
    newer = (*secret_ledger.RULES[:3], secret_ledger.Rule("pem", "BEGIN", version=2))
    after = secret_ledger.scan(more, path, newer)
    assert after.where("version = 2").count() == blobs + 1 and after.where("version = 1 and rule = 'hex'").count() == blobs + 1
    assert after.where("version = 1 and rule = 'pem'").count() == blobs
    assert {r.found[0].kind for r in secret_ledger.findings(after, newer).where("found[0].kind = 'pem'").collect()} == {"pem"}


def test_masking(spark, odd):
    found = secret_ledger.findings(secret_ledger.scan(odd, scratch(spark, "ledger")))
    got = {r.doc_id: r for r in secret_ledger.attach(odd, found).withColumn("masked", secret_ledger.masked()).collect()}
    assert got[0].masked is None and got[1].masked == "" and got[9].masked == TEXTS[9]
    for d in (10, 11, 12):
        want, at = "", 0
        for _, a, b in brute.secrets(TEXTS[d]):
            if a >= at:
                want += TEXTS[d][at:a] + "[SECRET]"
            at = max(at, b)
        assert got[d].masked == want + TEXTS[d][at:]


def test_toxicity(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)] + [(None, 1, "x"), (3, None, "x"), (4, 7, "x")], "doc_id long, toxic int, text string")
    many = odd.select("doc_id", "text").union(spark.range(20, 40).selectExpr("id", "CASE WHEN id % 2 = 1 THEN 'you stupid idiot' ELSE 'a plain text' END"))
    got = toxicity.report(many, labels)
    assert got.count() == many.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.report(odd, labels.limit(0)).where("predicted = 0 and score = 0").count() == odd.count()
    assert toxicity.report(empty, labels).count() == 0
    # The sample holds the smallest hashes, whether or not a bound on the hash comes before the sort.
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 1 THEN concat('you stupid idiot ', id) ELSE concat('a plain text ', id) END AS text")
    given = spark.range(3000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    bounded = toxicity.scored(docs, given, sample=400).where(f"({toxicity.SCORE} >= 0.5) <> (doc_id % 2 = 1)")
    assert bounded.isEmpty()
    assert toxicity.features(None, {}) == toxicity.features(" \n", {}) == [0.0] * len(toxicity.FEATURES)
    # Words of any length are learned and read through their disguise.
    long = "x" * 60 + "vile"
    told = spark.createDataFrame([(f"you {long} number{i}" if i % 2 else f"plain number{i}", i % 2) for i in range(200)], "text string, label int")
    learned = toxicity.learn_words(told)
    assert long in learned
    assert toxicity.features("x" * 60 + "v1l3", learned)[toxicity.FEATURES.index("obfuscated_insults")] == 1
    f = dict(zip(toxicity.FEATURES, toxicity.features("YOU are a 1d10t, idiot!", {})))
    assert f["insults"] == 1 and f["obfuscated_insults"] == 1 and f["near_second_person"] == 1 and f["exclaimed_share"] > 0


def test_simhash(odd, empty):
    got = simhash.components(odd)
    plain = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    fps = [brute.simhash(t) for _, t in plain]
    roots = brute.components(fps)
    least = {}
    for (d, _), r in zip(plain, roots):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    want = sorted(((d, f"{f:016x}", least[r]) for (d, _), f, r in zip(plain, fps, roots)), key=str)
    assert sorted(rows(got, "doc_id", simhash.hexadecimal("fingerprint"), "component_id"), key=str) == want
    kept = simhash.one_per_component(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(roots))
    assert simhash.components(empty).count() == 0 and simhash.one_per_component(empty).count() == 0


@pytest.mark.parametrize("radius,bands", [(3, 2), (3, 3), (3, 4), (2, 2), (1, 2)])
def test_simhash_links_are_complete(spark, radius, bands):
    rnd = np.random.default_rng(radius * 10 + bands)
    base = rnd.integers(0, 2**64, 12, np.uint64)
    fps = set(base.tolist()) | {0, 2**64 - 1}
    for b in base.tolist():
        for _ in range(25):
            for bit in rnd.choice(64, rnd.integers(1, 5), replace=False).tolist():
                b ^= 1 << bit
            fps.add(b)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fingerprint long")
    found = [(a % 2**64, b % 2**64) for a, b in rows(simhash.links(df, radius, bands), "a", "b")]
    assert all((a ^ b).bit_count() <= radius for a, b in found)
    want, index, parent = brute.components(fps, radius), {f: i for i, f in enumerate(fps)}, list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in found:
        parent[find(index[a])] = find(index[b])
    groups = {}
    for i, r in enumerate(want):
        groups.setdefault(r, set()).add(find(i))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({find(i) for i in range(len(fps))})


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    data = [(i, [float(i % 3), -0.5, i / 7]) for i in range(30)]
    data += [(20, [1.0, 1.0, 1.0]), (None, [2.0, 0.0, 1.0]), (40, None), (41, [1.0, None, 0.0]), (42, [nan, 0.0, 0.0]), (43, [inf, 0.0, 0.0]), (60, [1.0, 2.0]), (61, [3.0, 4.0]), (80, []), (100, [1e6, -1e6, 3e5])]
    df = spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<float>, score int")
    got = sorted(rows(topk.top_k(topk.quantised(df, 64), "vec_id % 20 = 0", 4), "query_id", "rank", "vec_id", "score"), key=str)
    usable = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int).tolist()) for i, v in data if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    low = -(2**63)
    want = brute.top([(low if i is None else i, v) for i, v in usable], 4, lambda i: i != low and i % 20 == 0)
    assert got == sorted(((q, r, None if c == low else c, s) for q, r, c, s in want), key=str)
    assert topk.top_k(topk.quantised(df.limit(0), 64), "vec_id % 20 = 0", 4).count() == 0


def test_topk_bounds_never_lose_a_candidate():
    rnd = np.random.default_rng(1)
    q, c = rnd.integers(-90, 90, (40, 64)), np.concatenate([rnd.integers(-90, 90, (3000, 64)), np.repeat(rnd.integers(-90, 90, (1, 64)), 50, axis=0)])
    for level in topk.LEVELS:
        (qm, qd), (cm, cd) = topk.statistics(q.astype(float), level), topk.statistics(c.astype(float), level)
        assert (qm @ cm.T + qd @ cd.T + 1e-6 >= q @ c.T).all()
    ids = np.arange(len(c))
    for i, at, s in topk.block_top(q, c, ids, np.full(40, -1), 20, np.full(40, -np.inf)):
        assert at.tolist() == topk.best(c @ q[i], ids, 20).tolist() and s.tolist() == (c @ q[i])[at].tolist()


def test_minhash(odd, empty):
    got = minhash.report(odd)
    plain = sorted(((d, t or "") for d, t in rows(odd, "doc_id", "text")), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted(((d, len(t), brute.sha(e)) for (d, t), e in zip(plain, brute.edited([t for _, t in plain]))), key=str)
    assert sorted(rows(got, "doc_id", "n_chars", "edited_sha256"), key=str) == want
    assert got.where("near_edited < 0 or near_edited > 1 or near_next is null").count() == 0
    assert minhash.report(empty).count() == 0


def test_minhash_near_duplicates(spark, odd, empty):
    def similarity(a, b):
        x, y = set(minhash.shingles(a, 5).tolist()), set(minhash.shingles(b, 5).tolist())
        return len(x & y) / len(x | y) if x | y else 1.0

    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words[:100]), " ".join(words[:104]), " ".join([*words[:96], "z"]), " ".join(words[4:112]), "short", "short", "", None, " ".join(words[60:])]
    got = dict(rows(minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "doc_id", "class_id"))
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                old, new = parent[i], parent[j]
                parent = [new if p == old else p for p in parent]
    least = {r: min(i for i, p in enumerate(parent) if p == r) for r in parent}
    assert got == {i: least[p] for i, p in enumerate(parent)}
    assert minhash.near_duplicates(odd).count() == odd.count() and minhash.near_duplicates(empty).count() == 0


def test_mixing(odd, empty):
    got = mixing.report(odd)
    plain = rows(odd, "doc_id", "text", "source")
    per = {}
    for _, t, s in plain:
        per[s] = per.get(s, 0) + len(brute.WORD.findall(t or ""))
    goal = brute.targets(per)
    assert got.count() == odd.count() and got.where("taken > 2 * size").count() == 0
    out = [tuple(r) for r in got.select("size", "source_size", "target", "taken").collect()]
    assert sorted(o[0] for o in out) == sorted(len(brute.WORD.findall(t or "")) for _, t, _ in plain)
    assert {round(o[2], 6) for o in out} == {round(v, 6) for v in goal.values()}
    # A source of one huge document and few small ones can miss its target by half the huge one.
    taken, largest = dict.fromkeys({o[1] for o in out}, 0), dict.fromkeys({o[1] for o in out}, 0)
    for size, source, _, words in out:
        taken[source] += words
        largest[source] = max(largest[source], size)
    assert all(abs(taken[per[s]] - goal[s]) <= largest[per[s]] / 2 + 1 for s in goal)
    assert rows(mixing.report(odd), "doc_id", "taken").sort(key=str) == rows(got, "doc_id", "taken").sort(key=str)
    copies = mixing.copied(odd)
    assert copies.columns == odd.columns and copies.groupBy("doc_id", "text", "source").count().count() <= odd.distinct().count()
    assert mixing.report(empty).count() == 0 and mixing.copied(empty).count() == 0


def test_licenses(odd, empty):
    got = {r.doc_id: r for r in licenses.report(odd).collect() if r.doc_id in (14, 15, 9)}
    assert got[14].licences == "MIT" and got[14].spans == "MIT:0:30"
    assert got[15].licences == "Apache-2.0" and got[15].spans == "Apache-2.0:0:46" and got[9].n_licences == 0
    assert licenses.report(odd).count() == odd.count() and licenses.report(empty).count() == 0


def test_license_rules():
    r = licenses.Recogniser({"a": "first one", "b": "second", "c": "third here"}, (("AB", ("a", "b")), ("A", ("a",)), ("ABC", ("a", "b", "c"))), gap=1)
    said = lambda t: [(x[0], t[x[1] : x[2]]) for x in r.licences(t)]
    assert said("First ONE. Second! third\nhere") == [("ABC", "First ONE. Second! third\nhere")]
    assert said("First one. noise. Second. noise. noise. Third here.") == [("AB", "First one. noise. Second")]
    assert said("Second. first one.") == [("A", "first one")] and said("") == [] and r.licences(None) == []


def test_token_files(spark, odd, empty):
    folder = scratch(spark, "tokens")
    token_files.write(odd, folder, PATH, 2)
    plain = sorted(((d, t or "") for d, t in rows(odd, "doc_id", "text")), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for (d, _), ids in zip(plain, brute.tokens([t for _, t in plain], PATH)):
        want.append((d, at, len(ids) + 1, brute.crc(ids + [2])))
        at += len(ids) + 1
    assert sorted(rows(token_files.read(spark, folder), "doc_id", "start", "n_tokens", F.crc32("ids")), key=lambda r: r[1]) == want
    none = scratch(spark, "tokens")
    token_files.write(empty, none, PATH, 2)
    assert token_files.read(spark, none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_token_words(n):
    rnd = np.random.default_rng(n)
    for top in (1, 2, 300, 50257, 2**32):
        ids = rnd.integers(0, top, n).astype("<u4")
        words, starts = token_files.pack_words(ids)
        assert (token_files.unpack_words(words, starts, n) == ids).all()
    mixed = np.where(np.arange(n) % 7 == 0, 2**32 - 1, np.arange(n) % 3).astype("<u4")
    assert (token_files.unpack_words(*token_files.pack_words(mixed), n) == mixed).all()


def test_chat(spark):
    call = lambda i, name, args: (i, name, args)
    data = [
        (1, 0, "user", "hi \"you\"\n", None, None), (1, 1, "assistant", "é", [call("a", "search", '{"query": "x", "limit": 5}'), call("b", "lookup", '{"id": "7"}')], None),
        (1, 2, "tool", "r", None, "a"), (1, 3, "tool", "s", None, "b"), (1, 4, "tool", "again", None, "a"), (1, 5, "tool", None, None, "nobody"),
        (2, 0, "tool", "early", None, "k"), (2, 1, "assistant", None, [call("k", "note", '{"text": "t", "more": 1}')], None), (2, 2, "assistant", "", [call("k", "nope", "not json")], None),
        (2, 3, "assistant", "later", [call("m", "search", '{"limit": 99}'), call(None, "search", None)], None),
        (3, 0, "assistant", "loop", [call("p", "note", '{"text": {"$ref": "q"}}')], None), (3, 1, "tool", "for p", [call("q", "note", '{"text": "1"}')], "p"), (3, 2, "tool", "for q", None, "q"),
        (None, None, None, None, None, None), (None, None, None, None, None, None), (4, 0, "user", "", [], None),
    ]
    df = spark.createDataFrame([(*r, 1) for r in data], f"conv_id long, turn int, role string, text string, calls {chat.CALLS}, result_for string, position int")
    out = {(r.conv_id, r.turn, r.json): r for r in chat.link(df, chat.TOOLS).collect()}
    got = sorted(out.values(), key=lambda r: (str(r.conv_id), r.position))
    of = lambda c: [(r.turn, r.status, r.n_calls, r.n_valid) for r in got if r.conv_id == c]
    assert of(1) == [(0, "message", 0, 0), (1, "call", 2, 1), (2, "result", 0, 0), (3, "result", 0, 0), (4, "repeated_result", 0, 0), (5, "orphan", 0, 0)]
    assert of(2) == [(1, "call", 1, 0), (0, "result", 0, 0), (2, "reused", 1, 0), (3, "pending", 2, 0)]
    assert {r.status for r in got if r.conv_id == 3} == {"cycle"}
    assert of(4) == [(0, "message", 0, 0)]
    lines = {(r.conv_id, r.turn): r.json for r in got}
    assert lines[1, 0] == '{"content":"hi \\"you\\"\\n","role":"user"}'
    assert lines[1, 1] == '{"content":"é","role":"assistant","tool_calls":[{"arguments":{"limit":5,"query":"x"},"id":"a","name":"search"},{"arguments":{"id":"7"},"id":"b","name":"lookup"}]}'
    assert lines[2, 2] == '{"content":"","role":"assistant","tool_calls":[{"arguments":"not json","id":"k","name":"nope"}]}'
    assert lines[1, 5] == '{"role":"tool","tool_call_id":"nobody"}' and lines[None, None] == "{}"
    assert chat.link(df, chat.TOOLS).count() == len(data)
    assert chat.link(df.limit(0), chat.TOOLS).count() == 0


def test_stages(spark, odd, empty, tmp_path):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, str(tmp_path)), name)
            if name != "packing":
                assert out.columns == odd.columns and out.dtypes == odd.dtypes
                docs = out
    assert out.count() == 0


def test_stages_leave_columns_alone(spark, tmp_path):
    """User columns called like anything a stage uses inside come back with their own values."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    inner = ["_content", "_dup_id", "_dup_content", "n", "stays", "_blob", "_found", "_found_blob", "_secrets", "_masked", "_mix_size", "_mix_id", "_mix_copy", "_mix_copies",
             "_tox_score", "_tox_margin", "features", "label", "size", "copies", "fingerprint", "kept__0", "blob", "found", "odd name", "dotted.name"]
    data = [(i, f"text {i} with words {i * 7} and password=abcdef{i}", "en", f"s{i % 2}", 30, *[f"{c}-{i}" for c in inner]) for i in range(8)]
    docs = spark.createDataFrame(data, ["doc_id", "text", "lang", "source", "n_chars", *inner])
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            for r in out.collect():
                assert all(r[c] == f"{c}-{r.doc_id}" for c in inner)
            docs = out
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and not out.isEmpty()
