"""Quality rules as a bitmask ledger, native.

Every rule is evaluated once a document. The ledger row keeps its measurements
and one bit for each rule that failed. A policy is a version, a mask of the
rules that count and how many of them may fail; applying one, comparing two or
taking a rule away reads the ledger only, never a text.

A document is one row from scan to ledger: arrays of its words, window hashes
and lines are built inside the row, and nothing is shuffled. Repeated windows
are told by a 64-bit hash among the windows of one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACE_RUN, WORD, let, words

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements


#: Bit i of the mask is rule i. Rules are only ever added at the end.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "5 * n_symbols > 2 * n_words"),
    Rule("shouting", "10 * n_bangs > 3 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("digits", "100 * n_digits > 30 * word_chars"),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]
    allowed: int = 0

    @property
    def mask(self) -> int:
        return mask_of(self.rules)


def mask_of(rules) -> int:
    names = [r.name for r in RULES]
    return sum(1 << names.index(x) for x in rules)


POLICIES = {p.version: p for p in (Policy("base", BASE), Policy("v1", tuple(r.name for r in RULES)), Policy("lenient", tuple(r.name for r in RULES), 1))}


def repeat_words(hashes: Column, size: int = WINDOW) -> Column:
    """Words inside windows whose hash occurs twice or more: hashes sorted with
    their places, places of equal neighbours, and the stretch they cover."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

    def covered(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.get(s, i)["at"]))
        step = lambda a, x: F.struct((a["n"] + F.least(F.lit(size), x + size - a["stop"])).alias("n"), (x + size).alias("stop"))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop")), step, lambda a: a["n"])

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements, longs."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("t"), words(F.col("text")).alias("w"))
    hashes = let(F.col("w"), lambda w: F.transform(F.when(F.size(w) >= WINDOW, F.sequence(F.lit(1), F.size(w) - WINDOW + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(F.slice(w, i, WINDOW))))
    rows = rows.select("doc_id", "t", F.size("w").alias("n_words"), F.array(hashes).alias("h"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    left = lambda pattern: F.length(F.regexp_replace("t", pattern, ""))
    counts = {
        "n_words": F.col("n_words"),
        "word_chars": left(SPACE_RUN),
        "n_symbols": left(r"[^#*$%&|<>]+"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": F.transform("h", lambda h: repeat_words(h))[0],
        "n_lines": F.size(F.split("t", "\n")),
        "n_bangs": left("[^!]+"),
        "n_digits": left("[^0-9]+"),
    }
    return rows.select("doc_id", *[c.cast("long").alias(n) for n, c in counts.items()])


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, measurements, failed (bit i: rule i failed).

    A null text is an empty one: no words, so it fails ``few_words``. Repeated
    rows are measured each; an empty table gives an empty ledger.
    """
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    return measure(docs).withColumn("failed", sum(bits[1:], bits[0]).cast("long"))


def verdict(policy: Policy, failed: str = "failed") -> Column:
    return F.bit_count(F.col(failed).bitwiseAND(F.lit(policy.mask))) <= policy.allowed


def apply_policy(kept: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with the policy's version and verdict."""
    return kept.withColumn("policy", F.lit(policy.version)).withColumn("kept", verdict(policy))


def ablation(kept: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: how many documents fail it, fail it alone, and
    would be kept without it. Masks are counted first, so what is left to
    compute has one row a distinct mask."""
    masks = kept.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rules = [(i, r.name) for i, r in enumerate(RULES) if r.name in policy.rules]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).alias("bit")) for i, n in rules]))
    each = masks.select("failed", "n", rows.alias("r"))
    counted = F.col("failed").bitwiseAND(F.lit(policy.mask))
    without = counted.bitwiseAND(F.bitwise_not(F.col("r.bit").cast("long")))
    total = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(name)
    return each.groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit")).agg(
        total(counted.bitwiseAND(F.col("r.bit")) != 0, "n_failed"), total(counted == F.col("r.bit"), "n_only"), total(F.bit_count(counted) <= policy.allowed, "n_kept"), total(F.bit_count(without) <= policy.allowed, "n_kept_without")
    )
