"""The pipeline's stages on the smallest tables."""

import corpus_pipeline
from rillflow.llm import oracles

from tests.compare import oracle_rows, spark_rows


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], sf_dir).cache()
        assert out.columns == docs.columns and out.count() <= kept[-1].count()
        kept.append(out)
    ids = [{r.doc_id for r in k.collect()} for k in kept]
    assert ids[3] == ids[4]
    # each document that went repeats one that stayed, and no two that stayed are alike
    stayed = {r.doc_id: shingles(r.text) for r in kept[2].collect()}
    before = {r.doc_id: shingles(r.text) for r in kept[1].collect()}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert all(any(alike(before[d], s) for s in stayed.values()) for d in ids[1] - ids[2])
    left = list(stayed.items())
    assert not [(a, b) for i, (a, x) in enumerate(left) for b, y in left[:i] if len(x) > 20 and alike(x, y)]
    packed = corpus_pipeline.run(spark, sf_dir)
    pieces = {}
    for r in packed.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.text))
    assert set(pieces) == ids[4]
    texts = {r.doc_id: r.text or "" for r in kept[4].collect()}
    assert {d: "".join(t for _, t in sorted(p)) for d, p in pieces.items()} == texts


ODD = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "s", 35, "mine"),
    (1, "alpha beta gamma delta epsilon zeta", "en", "s", 35, "mine"),
    (2, "alpha beta gamma delta epsilon zeta", "en", "s", 35, "other"),
    (None, "no id here at all", None, None, None, None),
    (3, None, None, None, None, None),
    (4, "", "en", "s", 0, ""),
    (5, "one two three " * 9000, "en", None, 126000, "long"),
    (6, "password = abcdefghijkl12 here", "en", "s", 30, "x"),
]


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empties, repeats, a long text and columns with clashing names, in every stage."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, row string")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        kept[name] = sorted((tuple(r) for r in out.collect()), key=str)
    full = sorted((tuple(r) for r in docs.collect()), key=str)
    assert kept["toxicity"] == full and kept["decontamination"] == full
    # of equal texts, and of null and empty ones, the smallest doc_id stays once
    assert [r[0] for r in sorted(kept["near_dedup"], key=lambda r: (r[0] is None, r[0] or 0))] == [1, 3, 5, 6, None]
    assert {r[0]: r[1] for r in kept["secrets"]}[6] == "<secret> here"
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sum(r["size"] for r in packed) == sum(len(r[1] or "") for r in ODD)
    assert "".join(r.text for r in sorted((r for r in packed if r.doc_id == 5), key=lambda r: r.piece)) == ODD[6][1]
    assert sum(r.doc_id == 1 for r in packed) == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_repeats_oracle(spark, sf_dir):
    from rillflow.llm.repeats import op6_recompression

    assert spark_rows(op6_recompression(spark, sf_dir)) == oracle_rows(oracles.REPEATS, sf_dir)
