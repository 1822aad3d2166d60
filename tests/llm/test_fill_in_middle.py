"""Fill-in-the-middle against plain Python, pieces against whole texts, odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import fill_in_middle as fim
from tests.llm.test_operators import LONG, none, odd, odd_rows  # noqa: F401 (fixtures)


def brute(doc_id, text):
    text = text or ""
    units = re.findall(fim.UNIT, text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def checked(rows, docs):
    cut = fim.fill_in_middle(docs)
    got = cut.withColumn("restored", fim.restore(F.col("output"), F.col("form"))).collect()
    order = lambda x: sorted(x, key=repr)
    assert order((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == order((i, *brute(i, t)) for i, t in rows)
    assert order((r.doc_id, r.restored) for r in got) == order((i, t or "") for i, t in rows)
    return {r.form for r in got}


def test_matches_plain_python(spark):
    rng = random.Random(5)
    parts = ["ab", "Z", "é", "漢", "🙂", "\n", "\r\n", "\x00", " ", "<", ">", "<P", "S>", "P", "<S", "M>", "<M>", "<P>", "<S>", "1", "aé", "ſ", "K"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(1500)]
    assert checked(rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == {"plain", "psm", "spm"}


def test_odd_rows(spark, odd, none):  # noqa: F811
    rows = [(r[0], r[1]) for r in odd_rows()]
    checked(rows, odd)
    assert fim.fill_in_middle(none).collect() == []


def test_very_long_texts(spark):
    rows = [(i, t) for i, t in enumerate(["lorem ipsum é dolor " * 150_000, "x" * 1_000_000, "7" * 300_000, LONG])]
    checked(rows, spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("piece", [1, 2, 7])
def test_pieces_give_the_units_of_the_whole(monkeypatch, piece):
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(fim.UNIT), "isolated")
    monkeypatch.setattr(fim, "PIECE", piece)
    rng = random.Random(piece)
    for _ in range(300):
        text = "".join(rng.choice("abZ \né🙂1-") for _ in range(rng.randrange(40)))
        expect = [m.start() for m in re.finditer(fim.UNIT, text)] + [len(text)]
        assert np.array_equal(fim.unit_starts(split, text), expect)
