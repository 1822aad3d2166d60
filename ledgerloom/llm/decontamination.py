"""Benchmark decontamination by normalised n-grams, native.

A document word inside any occurrence of a benchmark window (``window``
consecutive words of an item; all words of a shorter one) is hit.

1. Scan. Each document is split into words once. Its windows are scanned by
   probes: of windows of n words every one holds a probe, that is a gram of
   n + 1 - s words that starts at a multiple of s = (n + 1) div 2; so one hash for
   every s words is enough to meet all windows. Probes are written as hashes, an
   array a row, beside the number of words.
2. Candidates. Probes are looked up in the hash set of all such grams of the
   benchmark, broadcast after its size was summed (past ``broadcast_bytes`` the
   probes are joined by a shuffle).
3. Verification. Only documents with a candidate are read again. The windows around
   a candidate are looked up by hash in the set of benchmark windows and compared
   word by word. Candidates are dealt in chunks, so a long document that is all
   hits is many small rows.
4. Hits become stretches by a running maximum over a document's hits, and meet the
   narrow rows of step 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, UPPER, materialize, small_enough, unused

WINDOW = 13
SHARE = 20
BROADCAST_BYTES = 32 << 20
#: Candidates of one document that are verified as one row.
CHUNK = 2048
# Words of text in either case, and what stands between them.
CASED_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def grid(n: int) -> tuple[int, int]:
    """(words of a probe, distance of probes) for windows of n words."""
    step = (n + 1) // 2
    return n + 1 - step, step


def grams(w: Column, n: int, step: int = 1) -> Column:
    """Hashes of the grams of n words, from every step-th word on."""
    at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(w, i, n)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, len, gram (words, one space between), hash of every distinct window
    of every item."""
    some = benchmark.select("item_id", terms(F.col("text")).alias("w")).withColumn("len", F.least(F.lit(window), F.size("w"))).where("len > 0")
    each = some.select("item_id", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))).alias("gram"))
    return each.select("item_id", "len", F.concat_ws(" ", "gram").alias("gram"), F.xxhash64("gram").alias("hash")).distinct()


def _looked_up(places: DataFrame, table: DataFrame, keys: list[str], row_bytes: Column, limit: int) -> DataFrame:
    return places.join(F.broadcast(table) if small_enough(table, row_bytes, limit) else table, keys)


def scan(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, id (as text), text_hash, n_words and for windows of each length
    the probes' hashes, p<length>; written."""
    held = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), terms(F.col("text")).alias("w"))
    probes = [grams(F.col("w"), *grid(n)).alias(f"p{n}") for n in lengths]
    return materialize(held.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text_hash", F.size("w").cast("long").alias("n_words"), *probes), "probes")


def benchmark_hits(docs: DataFrame, scanned: DataFrame, windows: DataFrame, lengths: list[int], broadcast_bytes: int) -> DataFrame:
    """id, text_hash, at (0-based word), stop, item_id: verified occurrences; written."""
    wanted = None
    for n in lengths:
        gram, step = grid(n)
        w = F.split("gram", " ")
        held = materialize(windows.where(F.col("len") == n).select(F.explode(grams(w, gram)).alias("hash")).distinct(), "probe_set")
        places = scanned.select("id", "text_hash", F.posexplode(f"p{n}").alias("pos", "hash"))
        found = _looked_up(places, held, ["hash"], F.lit(24), broadcast_bytes).select("id", "text_hash", F.lit(n).alias("len"), (F.col("pos") * step).alias("at"))
        wanted = found if wanted is None else wanted.unionByName(found)
    chunked = wanted.groupBy("id", "text_hash", F.floor(F.col("at") / F.lit(CHUNK)).alias("chunk")).agg(F.collect_set(F.struct("len", "at")).alias("probes"))
    chunked = materialize(chunked, "candidates")
    again = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    held = _looked_up(again, chunked, ["id", "text_hash"], F.lit(64) + F.size("probes") * 16, broadcast_bytes).select("id", "text_hash", terms(F.col("text")).alias("w"), "probes")
    # The windows that hold a probe start up to a probe's distance before it.
    starts = lambda p: F.sequence(F.greatest(F.lit(0), p["at"] + 1 - F.floor((p["len"] + 1) / 2).cast("int")), F.least(p["at"], F.size("w") - p["len"]))
    around = F.flatten(F.transform(F.filter("probes", lambda p: F.size("w") >= p["len"]), lambda p: F.transform(starts(p), lambda i: F.struct(p["len"].alias("len"), i.alias("at")))))
    each = F.transform(F.array_distinct(around), lambda x: F.struct(x["len"].alias("len"), x["at"].alias("at"), F.concat_ws(" ", F.slice("w", x["at"] + 1, x["len"])).alias("gram"), F.xxhash64(F.slice("w", x["at"] + 1, x["len"])).alias("hash")))
    places = held.select("id", "text_hash", F.inline(each))
    found = _looked_up(places, windows, ["len", "hash", "gram"], F.length("gram") + 64, broadcast_bytes)
    return materialize(found.select("id", "text_hash", "at", (F.col("at") + F.col("len")).alias("stop"), "item_id"), "hits")


def stretches(hits: DataFrame) -> DataFrame:
    """id, text_hash, spans (first word, number; sorted, none touches another)."""
    rows = Window.partitionBy("id", "text_hash").orderBy("at", "stop")
    before = F.max("stop").over(rows.rowsBetween(Window.unboundedPreceding, -1))
    opened = hits.select("id", "text_hash", "at", "stop").distinct().withColumn("opens", F.coalesce(F.col("at") > before, F.lit(True)).cast("int"))
    islands = opened.withColumn("island", F.sum("opens").over(rows)).groupBy("id", "text_hash", "island").agg(F.min("at").alias("at"), (F.max("stop") - F.min("at")).alias("len"))
    return islands.groupBy("id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("at", "len"))).alias("spans"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text), (item_id, text) -> doc_id, text_hash, n_words, n_hit,
    items (ids of items with occurrences, sorted as strings), spans (stretches of hit
    words: first word, number), contaminated
    (some word is hit and ``share * n_hit >= n_words``).

    Null and blank texts have no words and are clean. Rows are known by their id
    and text together, so repeated ids are told apart unless they are the same
    row, which gets the same result. Empty tables give no hits. Other columns of
    either table are not read.
    """
    docs = docs.select("doc_id", "text")
    windows = materialize(benchmark_windows(benchmark, window), "benchmark_windows")
    lengths = [r["len"] for r in windows.select("len").distinct().orderBy("len").collect()]  # at most ``window`` numbers
    scanned = scan(docs, lengths)
    base = scanned.select("doc_id", "id", "text_hash", "n_words")
    spans, items = F.array().cast("array<struct<at:int,len:int>>"), F.array().cast("array<string>")
    if lengths:
        hits = benchmark_hits(docs, scanned, windows, lengths, broadcast_bytes)
        named = hits.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
        found = materialize(stretches(hits).join(named, ["id", "text_hash"]), "contaminated")
        small = small_enough(found, F.lit(64) + F.size("spans") * 16 + F.size("items") * 32, broadcast_bytes)
        base = base.join(F.broadcast(found) if small else found, ["id", "text_hash"], "left")
        spans, items = F.coalesce("spans", spans), F.coalesce("items", items)
    out = base.select("doc_id", "text_hash", "n_words", F.aggregate(spans, F.lit(0), lambda n, x: n + x["len"]).cast("long").alias("n_hit"), items.alias("items"), spans.alias("spans"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def without_spans(text: Column, spans: Column) -> Column:
    """The text less its hit words; what stands between words stays."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?:{BETWEEN})?{CASED_TERM}"), F.lit(0))
    tail = F.regexp_extract(text, rf"((?:{BETWEEN})?)$", 1)
    kept = F.transform(pieces, lambda x, i: F.when(F.exists(spans, lambda s: (s["at"] <= i) & (i < s["at"] + s["len"])), F.regexp_replace(x, CASED_TERM, "")).otherwise(x))
    return F.concat(F.array_join(kept, ""), tail)


def decontaminate(docs: DataFrame, benchmark: DataFrame, spans_only: bool = False, **options) -> DataFrame:
    """Documents, all their columns, without the contaminated ones; with
    ``spans_only`` all documents, without the hit words. A row without an id is
    judged as any other; repeated rows go or stay together; columns may have any
    names."""
    id_, mark, spans, out = (unused(docs, x) for x in ("id", "text_hash", "spans", "out"))
    found = contamination(docs, benchmark, **options).where("n_hit > 0")
    found = found.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(mark), F.col("spans").alias(spans), F.col("contaminated").alias(out)).dropDuplicates([id_, mark])
    found = materialize(found, "contaminated")
    if small_enough(found, F.lit(64) + F.size(spans) * 16, options.get("broadcast_bytes", BROADCAST_BYTES)):
        found = F.broadcast(found)
    match = docs["doc_id"].eqNullSafe(found[id_]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found[mark])
    if spans_only:
        text = F.when(F.col(spans).isNull(), docs["text"]).otherwise(without_spans(docs["text"], F.col(spans)))
        return docs.join(found, match, "left").select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])
    return docs.join(found.where(F.col(out)), match, "left_anti")
