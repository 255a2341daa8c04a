"""Operators 11 to 13 against brute force on small rows."""

import hashlib
import json
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from rillflow.llm import alignment, minhash, whitening

DOCS = "doc_id long, text string, lang string, seg string, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 7) for i, t in rows], DOCS)


# 11: cross-tokenizer alignment


def brute_alignment(texts):
    a, a_bytes = alignment.byte_tokenizer(open(alignment.BYTE_BPE, "rb").read())
    b, b_bytes = alignment.piece_tokenizer(open(alignment.PIECES, "rb").read())
    every, pairs = [], Counter()
    for t in texts:
        p, q = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw = (" " + (t or "")).encode()
        if not t or b"".join(a_bytes[i] for i in p) != raw or b"".join(b_bytes[i] for i in q) != raw:
            every.append(None)
            continue
        spans = []
        for ids, sizes in ((p, a_bytes), (q, b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(sizes[i]), i))
                at += len(sizes[i])
            spans.append(out)
        links, j = [], 0
        for s, e, i in spans[0]:
            while j and spans[1][j - 1][1] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][0] < e:
                if spans[1][j][1] > s:
                    links.append((i, spans[1][j][2]))
                j += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for e in cuts:
            groups.append("|".join(",".join(str(i) for s, f, i in side if low <= s and f <= e) for side in spans) if len(cuts) < 400 else None)
            low = e
        pairs.update(links)
        every.append((len(p), len(q), len(groups), links, groups))
    top = {}
    for (_, y), n in pairs.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for x in every:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, ng, links, groups = x
        digest = None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((na, nb, ng, len(links), sum(pairs[k] == top[k[1]] for k in links), sum(pairs[k] for k in links), digest))
    return out


def compare_alignment(spark, rows, **more):
    got = alignment.aligned(docs(spark, rows), **more)
    key = lambda r: (r[0] is None, *map(str, r))
    got = sorted((tuple(r) for r in got.collect()), key=key)
    want = sorted(((d, *x) for (d, _), x in zip(rows, brute_alignment([t for _, t in rows]), strict=True)), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:-1] == w[:-1]
        assert w[-1] is None or g[-1] == w[-1]


def odd_texts():
    rng = random.Random(3)
    signs = "ab é,.' \n\t  x0 　​▁日本\U0001f600ﬁ<|>s_-\x00\x1c\x85"
    made = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(150)]
    fixed = [None, "", " ", "  ", "a ", " a", "<|endoftext|> and <|endoftext|>", "don't  stop\n\n now ", "x▁y z", "the the the", "the the the", "\n", "a  b", "a   b", "b" * 3000, "word " * 1500, "Zażółć gęślą jaźń", "été éte"]
    return fixed + made


def test_alignment_matches_whole_text_encoding(spark):
    texts = odd_texts()
    compare_alignment(spark, [(i, t) for i, t in enumerate(texts)] + [(3, "again a"), (3, "again a"), (None, "again a")])


def test_alignment_of_rare_stretches_by_shuffle(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts()[:60])]
    compare_alignment(spark, rows, frequent=10)
    compare_alignment(spark, rows, frequent=0)


def test_link_counts_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(alignment, "WORDS", 50)
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", 3)
    compare_alignment(spark, [(i, t) for i, t in enumerate(odd_texts()[:60])])


def test_alignment_without_separable_rules(spark, monkeypatch):
    monkeypatch.setattr(alignment, "separable", lambda a, b: False)
    compare_alignment(spark, [(i, t) for i, t in enumerate(odd_texts()[:60])])


def test_alignment_of_no_rows_and_rules(spark):
    assert alignment.aligned(docs(spark, [(1, "a")]).limit(0)).count() == 0
    assert alignment.aligned(docs(spark, [(1, None)])).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")
    a, b = (open(p, "rb").read() for p in (alignment.BYTE_BPE, alignment.PIECES))
    assert alignment.separable(a, b)
    rules = json.loads(a)
    rules["pre_tokenizer"]["use_regex"] = False
    assert not alignment.separable(json.dumps(rules).encode(), b)


def test_stretches_end_where_both_tokenizers_do():
    texts = [None if t is None else " " + t if t else t for t in odd_texts()]
    cut = re.compile(r"(?<=[^\W_])(?=[!-/:-@\[-`{-~\x00-\x20])|(?<=[!-~]\n)(?=[!-~])", re.ASCII)
    for some in (texts, texts[7:], [], [None], ["", None]):
        words, ends = alignment.stretches(pa.array([None, *some], pa.string())[1:], False)
        words, ends = words.to_pylist(), [0, *ends.tolist()]
        assert len(ends) == len(some) + 1 and ends[-1] == len(words)
        for t, low, high in zip(some, ends, ends[1:], strict=False):
            assert "".join(words[low:high]) == (t or "") and all(words[low:high])
            if t and t.isascii():
                assert words[low:high] == cut.split(t)
        whole, ends = alignment.stretches(pa.array(some, pa.string()), True)
        assert whole.to_pylist() == [t for t in some if t] and len(ends) == len(some)
    # beside characters that old tables do not know, and beyond the first plane, nothing is cut
    assert alignment.stretches(pa.array([" a\U0001f600.\ua7ae. b"]), False)[0].to_pylist() == [" a\U0001f600.\ua7ae. b"]


def test_numbers_of_stretches_come_back():
    rng = np.random.default_rng(4)
    numbers = np.r_[0, 32767, 32768, (1 << 30) - 1, rng.integers(0, 1 << 17, 500)].astype(np.int32)
    ends = np.array([0, 0, 1, 3, 250, 250, 504])
    units, stops = alignment.packed(numbers, ends)
    back, same = alignment.unpacked(units, np.r_[0, stops])
    assert (back == numbers).all() and same.tolist() == [0, *ends]


def test_texts_are_not_read_again_for_the_result(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    rows = [(i, t) for i, t in enumerate([*odd_texts()[:40], "x y " * 20_000])]
    docs(spark, rows).write.parquet(path)
    found = alignment.aligned(spark.read.parquet(path), frequent=10)
    assert not [x for x in found.inputFiles() if path in x]
    assert found.count() == len(rows)


def test_texts_with_broken_characters(spark):
    broken = spark.createDataFrame([(1,), (2,)], "doc_id long").selectExpr("doc_id", "cast(x'612062ff2e' as string) text")
    want = docs(spark, [(1, "a b\ufffd."), (2, "a b\ufffd.")])
    assert sorted(map(tuple, alignment.aligned(broken).collect())) == sorted(map(tuple, alignment.aligned(want).collect()))


def test_alignment_of_the_given_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    compare_alignment(spark, rows)


# 12: whitening


def check_whitening(rows, given, width):
    """rows: what whiten gives; given: [(id, vector)] that count."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in given]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    dev = [sum((n * r[k] - s[k]) ** 2 for k in range(d)) for r in x]
    m = np.array([[float(Fraction(n * r[k] - s[k], n)) for k in range(d)] for r in x])
    cov = m.T @ m / n
    e = np.linalg.eigvalsh(cov)[::-1]
    by = {}
    for r in rows:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert len(rows) == n * min(d, width) and {r.n for r in rows} == {n}
    for (i, _), want in zip(given, dev, strict=True):
        assert any((r.deviation if r.deviation is not None else int(r.deviation_exact)) == want for r in by[i, 1])
    w = np.zeros((n, min(d, width)))
    ids = [i for i, _ in given]
    if len(set(ids)) == n:
        for r in rows:
            w[ids.index(r.vec_id), r.component - 1] = np.nan if r.whitened is None else r.whitened
        for k in range(w.shape[1]):
            assert by[ids[0], k + 1][0].explained == pytest.approx(e[k] / np.trace(cov) if np.trace(cov) else 0, rel=1e-6, abs=1e-12)
            if np.isnan(w[:, k]).any():
                assert np.isnan(w[:, k]).all() and e[k] <= 1e-10 * max(e[0], 1e-300)
                continue
            assert (w[:, k] ** 2).mean() == pytest.approx(1, abs=1e-6)
            # the direction that gives it is an eigenvector of the covariance
            u = m.T @ w[:, k]
            assert np.allclose(cov @ u, e[k] * u, rtol=1e-6, atol=1e-9 * np.abs(u).max() * e[0])
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-6


VECTORS = "vec_id long, embedding array<float>, label int, n long"


def test_whitening_matches_exact_arithmetic(spark):
    rng = np.random.default_rng(5)
    given = [(i, [float(np.float32(c)) for c in rng.normal(size=40) * 3]) for i in range(300)]
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (901, []), (902, [1.0] * 39 + [nan]), (903, [inf] + [1.0] * 39), (904, [None] + [1.0] * 39), (905, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in given + odd], VECTORS).repartition(5)
    check_whitening(whitening.whiten(frame).collect(), given, 32)
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame.where("vec_id = 900")).count() == 0


def test_whitening_of_few_equal_and_huge_vectors(spark):
    same = [(i, [1.0, 2.0, 3.0]) for i in range(5)]
    rows = whitening.whiten(spark.createDataFrame([(i, v, 1, 2) for i, v in same], VECTORS)).collect()
    assert len(rows) == 15 and all(r.whitened is None and r.deviation == 0 and r.identity_error == 0 for r in rows)
    flat = [(i, [float(i % 7), 1.0, float(i % 7) * 2, float(i % 3)]) for i in range(50)]
    check_whitening(whitening.whiten(spark.createDataFrame([(i, v, 1, 2) for i, v in flat], VECTORS)).collect(), flat, 32)
    rng = np.random.default_rng(6)
    huge = [(i, [float(np.float32(c)) for c in rng.normal(size=5) * 1e11]) for i in range(60)]
    check_whitening(whitening.whiten(spark.createDataFrame([(i, v, 1, 2) for i, v in huge], VECTORS)).collect(), huge, 32)
    twice = [(i // 2, [float(i), float(i * i % 11)]) for i in range(40)] + [(None, [3.0, 4.0])]
    check_whitening(whitening.whiten(spark.createDataFrame([(i, v, 1, 2) for i, v in twice], VECTORS)).collect(), twice, 32)


def test_scatter_is_exact_at_all_sizes():
    rng = np.random.default_rng(7)
    for most in (3, 1 << 19, 1 << 21, 1 << 45, 1 << 62):
        y = rng.integers(-most, most, (3000, 4))
        total = sum(m * (1 << p) for p, m in whitening.scatter(y))
        z = np.c_[np.ones(len(y), np.int64), y].astype(object)
        assert (total == z.T @ z).all()
        n, s = len(y), [int(v) for v in z[:, 1:].sum(axis=0)]
        assert whitening.deviations(y[:50], n, s) == [sum((n * v - t) ** 2 for v, t in zip(r, s, strict=True)) for r in y[:50].tolist()]


# 13: circulant MinHash


def shingle_set(text):
    words = [w for w in (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)} | {c: " " for c in "\t\n\x0b\x0c\r"})).split(" ") if w]
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute_minhash(rows):
    sets, parent = [shingle_set(t) for _, t in rows], {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (p, _) in enumerate(rows):
        for j in range(i):
            q, a, b = rows[j][0], sets[i], sets[j]
            if p is not None and q is not None and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(p), find(q)
                parent[max(x, y)] = min(x, y)
    out = []
    for (p, _), s in zip(rows, sets, strict=True):
        root = None if p is None else find(p)
        out.append((p, len(s), root, None if p is None else p == root))
    return out


def check_minhash(spark, rows):
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in minhash.minhash_components(docs(spark, rows)).collect()), key=key)
    assert got == sorted(brute_minhash(rows), key=key)


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_minhash_matches_brute_force(spark):
    rng = random.Random(11)
    texts = [None, "", " \n ", "one two", "One  TWO", "one two three", "Été deux trois", "été deux trois", "a b c " * 200]
    for base in range(8):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 300))]
        texts += [edited(rng, words, rng.randrange(0, 2 + len(words) // 25)) for _ in range(12)]
    common = [f"c{i}" for i in range(80)]
    texts += [" ".join(common + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 60))]) for _ in range(60)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [(500, texts[20]), (500, texts[20]), (500, texts[40]), (501, texts[30]), (501, ""), (502, ""), (None, texts[20]), (None, "never seen"), (None, "never seen")]
    check_minhash(spark, rows)


def test_minhash_of_chains_long_texts_and_no_rows(spark):
    rng = random.Random(12)
    words, rows = [f"w{i}" for i in range(400)], []
    for i in range(30):  # each differs a little from the one before
        rows.append((100 - i, " ".join(words)))
        at = rng.randrange(380)
        words[at : at + 6] = [f"n{i}_{k}" for k in range(6)]
    long = [f"l{rng.randrange(50_000)}" for _ in range(60_000)]
    rows += [(200, " ".join(long)), (201, edited(rng, long, 1000)), (202, edited(rng, long, 4000))]
    check_minhash(spark, rows)
    assert minhash.minhash_components(docs(spark, rows).limit(0)).count() == 0
    check_minhash(spark, [(1, None), (2, ""), (3, "")])


def test_minhash_of_a_hot_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(13)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, edited(rng, base, rng.randrange(0, 5))) for i in range(120)] + [(200 + i, " ".join(base)) for i in range(40)]
    check_minhash(spark, rows)


def test_queries_give_their_columns(spark, sf_dir):
    found = whitening.op12_whitening(spark, sf_dir)
    assert found.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check_whitening(found.collect(), [(i, v) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)], 32)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = minhash.op13_circulant_minhash(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(brute_minhash(rows))
    assert got.where(F.col("kept")).count() < len(rows)
