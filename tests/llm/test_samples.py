"""What the classifiers bring to the driver is bounded, whatever is repeated or long."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.llm import quality_model, toxicity


def test_repeated_ids_are_one_row(spark, monkeypatch):
    docs = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("some words "), (F.col("id") % 5).cast("string")).alias("text")).unionByName(spark.createDataFrame([(2, "other words here"), (3, None)], "doc_id long, text string")).repartition(7)
    rated = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (3, 2), (4, 1), (5, 9)], "doc_id long, grade int")
    seen = []
    monkeypatch.setattr(quality_model.CumulativeLink, "fit", classmethod(lambda cls, row, bin_, value, grade, grades, bits: seen.append((len(row), sorted(grade.tolist())))))
    quality_model.fit(docs, rated, 3, sample=10)
    assert seen[0][1] == [0, 0, 1, 2]
    some = seen[0][0]
    quality_model.fit(docs, rated, 3, sample=10, cells=some // 2)
    assert 0 < seen[1][0] <= some // 2
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    restorer = type("Plain", (), {"text": staticmethod(lambda x: x)})()
    assert toxicity.sample_features(docs, labels, restorer, 10).groupBy("toxic").count().orderBy("toxic").collect() == [(0, 2), (1, 1)]


def test_reruns_and_orders_agree(spark):
    data = [(i, f"word{i % 7} and word{i % 11} " * (i % 4 + 1)) for i in range(200)]
    rated = spark.createDataFrame([(i, i % 3) for i in range(200)], "doc_id long, grade int")
    fits = [quality_model.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), rated, 3) for rows, n in ((data, 2), (data[::-1], 5))]
    assert (fits[0].weights == fits[1].weights).all() and (fits[0].thresholds == fits[1].thresholds).all()


def test_lines_of_one_hash_stay_apart(spark, monkeypatch):
    """Different lines under one 64-bit hash aren't taken for equal."""
    from ledgerloom.llm import line_dedup

    lines_of = line_dedup.lines_of
    monkeypatch.setattr(line_dedup, "lines_of", lambda docs, n: lines_of(docs, n).withColumn("h", F.when(F.col("line").startswith("clash"), F.lit(7)).otherwise(F.col("h"))))
    docs = spark.createDataFrame([(1, "clash one is the first of all lines"), (2, "clash two has other words altogether"), (3, "clash two has other words altogether\nsome words that nobody else has"), (4, "clash one is the first of all lines")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: "clash one is the first of all lines", 2: "clash two has other words altogether", 3: "some words that nobody else has", 4: ""}


def test_very_long_texts(spark):
    """Some MB of text and one word of a MB through the operators without a test of it elsewhere."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from ledgerloom.llm import quality_rules, secret_scan, token_counts

    long, word = "lorem ipsum dolor " * 150_000, "x" * 1_000_000
    docs = spark.createDataFrame([(1, long), (2, word), (3, " ".join([word, "AKIA" + "Z9" * 8, word]))], "doc_id long, text string")
    rules = {r.doc_id: r for r in quality_rules.ledger(docs).collect()}
    assert [(rules[i].n_words, rules[i].word_chars) for i in (1, 2)] == [(450_000, 2_250_000), (1, 1_000_000)]
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.scan_secrets(docs).collect()}
    assert spans == {1: [], 2: [], 3: [("access", 1_000_001, 1_000_021)]}
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs.where("doc_id < 3"), path).collect()}
    assert counts == {i: (len(t), len(own.encode(t, add_special_tokens=False).ids), True) for i, t in ((1, long), (2, word))}
    rated = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, grade int")
    got = quality_model.score(docs, quality_model.fit(docs, rated, 2)).collect()
    assert len(got) == 3 and all(0 <= r.expected_grade <= 1 for r in got)
