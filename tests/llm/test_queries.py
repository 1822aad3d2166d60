"""Registered corpus queries against their SQL, and the pipeline."""

from __future__ import annotations

from collections import Counter

import pytest

from ledgerloom.llm import queries
from tests.compare import both

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    names, mine, other_names, other = both(spark, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert names == other_names and mine and mine == other


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    expect = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(repr, expect.collect())) == sorted(map(repr, got.collect()))
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_toxic_rows_go_by_row(spark, monkeypatch):
    import numpy as np

    import corpus_pipeline
    from ledgerloom.llm import toxicity

    told = np.unique(toxicity.features(np.frombuffer(b"moron", np.uint8), np.array([0, 5]))[1])
    monkeypatch.setattr(toxicity, "fit", lambda *_: toxicity.Score(told, np.full(len(told), 20.0), -5.0))
    rows = [(None, "a moron", "en", "a", 7), (None, "a friend", "en", "a", 8), (1, "a moron", "en", "a", 7), (1, "a friend", None, "b", 8), (2, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    got = corpus_pipeline.toxic(spark, docs, SF)
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((r for r in rows if "moron" not in (r[1] or "")), key=repr)


def test_mixed_rows_have_their_own_share(spark):
    import corpus_pipeline

    rows = [(i % 40 if i % 7 else None, "w " * (i % 23), "en", "abc"[i * i % 3], i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.mixed(spark, docs, SF).collect()
    size = {i: len(t.split()) for _, t, _, _, i in rows}
    assert all(0 < r.taken <= 2 * size[r.n_chars] and (r.doc_id, r.text, r.lang, r.source, r.n_chars) == rows[r.n_chars] for r in got)
    assert len({r.n_chars for r in got}) == len(got) and abs(sum(r.taken for r in got) - 1.5 * sum(size.values())) <= 3


ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n\x0b\f\r ", "en", "b", 6),
    (5, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "b", 1),
    (6, "one", None, "c", 3),
    (6, "one", None, "c", 3),
    (7, "lorem ipsum dolor " * 150_000, "en", "c", 2_700_000),
    (8, "x" * 1_000_000, "en", "c", 1_000_000),
    (9, "é漢字 🙂 ΣΑΣ İx\x00y naïve", "xx", "é", 5),
    (None, "no id here but words enough to be read by all of it", "en", "a", 1),
]


def test_stages_on_odd_rows(spark):
    """Nulls, empty, blank and very long texts (2.7 MB, one word of 1 MB), repeated
    rows, a row without an id, and columns that no stage knows."""
    import corpus_pipeline

    docs = spark.createDataFrame([(*r, "k", 7, "t") for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, key string, h long, target string").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda name: sorted((r.doc_id for r in stages[name](spark, docs, SF).select("doc_id").collect()), key=repr)
    every = sorted((r[0] for r in ODD), key=repr)
    without = lambda *gone: [i for i in every if i not in gone]
    assert ids("toxicity") == every
    # Copies lose all lines and go; a row without an id stays as it is.
    assert ids("line_dedup") == without(5)
    assert ids("near_duplicates") == without(5)
    assert ids("decontamination") == every
    # Texts without a word can't be taken from.
    assert set(ids("mixing")) <= set(without(2, 3, 4))


def test_stages_match_brute_force(spark):
    """Each stage but the classifier's on the smallest table, by plain Python."""
    import corpus_pipeline
    from tests.llm.test_operators import brute_components, brute_hits, distance

    stages, sf = dict(corpus_pipeline.STAGES), SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    blank = " \t\n\x0b\f\r"
    seen, by_size, expect = set(), {}, {}
    for i in sorted(rows):
        kept = []
        for raw in (rows[i].text or "").split("\n"):
            x = raw.strip(blank)
            near = len(x) >= 20 and any(distance(x, y) <= 2 for n in range(len(x) - 2, len(x) + 3) for y in by_size.get(n, ()) if not Counter(x).total() or sum(((Counter(x) - Counter(y)) + (Counter(y) - Counter(x))).values()) <= 4)
            if not x or not (x in seen or near):
                kept.append(raw)
            if x:
                seen.add(x)
                if len(x) >= 20:
                    by_size.setdefault(len(x), set()).add(x)
        text = "\n".join(kept)
        if rows[i].text is not None and len(kept) < len(rows[i].text.split("\n")):
            if text.strip(blank):
                expect[i] = text
        else:
            expect[i] = rows[i].text
    assert {r.doc_id: r.text for r in stages["line_dedup"](spark, docs, sf).collect()} == expect
    found = brute_components([(i, r.text) for i, r in rows.items()], 5, 80)
    assert {r.doc_id for r in stages["near_duplicates"](spark, docs, sf).collect()} == {i for i, (_, top) in found.items() if i == top}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i, r in rows.items() for n, hit, _ in [brute_hits(r.text, items, 13)] if not (hit and 20 * hit >= n)}
    assert {r.doc_id for r in stages["decontamination"](spark, docs, sf).collect()} == clean
    plan = {r.doc_id: r.taken for r in queries.op6_mixing(spark, sf).collect()}
    assert {r.doc_id: r.taken for r in stages["mixing"](spark, docs, sf).collect()} == {i: n for i, n in plan.items() if n}
