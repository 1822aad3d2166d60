"""Near-duplicate lines by a segment-partition edit join, native.

A line is a ``\\n``-split part of a text, stripped of outer white space. An
occurrence goes if one before it, in order of (doc_id, line number), is equal or
within ``edits`` edits (Levenshtein). Edits are judged between lines of
``min_chars`` characters or more, equality between lines of ``exact_chars`` or
more; blank lines stay. Occurrences are judged on the input, not on what is left.

1. Equal lines are one: their hashes (96 bits of two kinds) and first occurrence,
   aggregated map-side. The search for near lines goes by the first hash alone; what
   it finds is verified on a line's text and holds for both its hashes.
2. A line is cut into ``edits + 1`` segments. After at most that many edits one
   segment of the shorter line is left whole in the longer one, at one of a few
   places that follow from the two lengths; so a line is known under the keys
   (length, segment number, segment) of its own and of those places, as 48 bits of
   their hash. Keys under which different lines are known, one of them by its own
   segment, are kept. This exchange of twelve rows a line is the largest, so a row is
   only key and hash (17 bytes as written): nearly all keys are one line's alone, and
   aggregating them first would make rows longer and none fewer.
3. These keys meet that exchange again, so lines aren't cut or sent twice; only the
   texts of lines under them are read again. A pair under one key must agree in a
   64-bit parity sketch of its character pairs (an edit changes four at most)
   before it leaves the join, so thousands of variants of one line that differ by
   a word don't come out as pairs.
4. What is left is verified by a banded bit-parallel edit distance, as a fold over
   the longer line's characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACES, WORD, materialize, salted, small_enough, unused

EDITS = 2
MIN_CHARS = 20
BROADCAST_BYTES = 32 << 20
KEY_BITS = 48
#: Lines of one key that meet the others in one task.
SALTED = 2000


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, t (hash of the text), no, line, h and g (its hashes) of the lines that count."""
    parts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_hash(F.col("text")).alias("t"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "raw"))
    lines = parts.select("doc_id", "t", "no", F.btrim("raw", F.lit(SPACES)).alias("line")).where(F.length("line") >= min_chars)
    return lines.withColumns({"h": F.xxhash64("line"), "g": F.hash("line")})


def places(edits: int) -> list[tuple[int, int, int]]:
    """(how much longer the probing line is, segment, shift) of the substrings
    that can hold a whole segment, 0-based segments."""
    out = []
    for more in range(edits + 1):
        for i in range(edits + 1):
            lo = max(-i, more - (edits - i))
            hi = min(i, more + (edits - i))
            out += [(more, i, shift) for shift in range(lo, hi + 1)]
    return out


def keyed(lines: DataFrame, edits: int) -> DataFrame:
    """``lines`` (h, line) with a row for each key; own: the key is one of the
    line's own segments. Lines are cut as four bytes a character, so a segment is
    found without walking the text. The places are rows, not twelve expressions:
    one small expression is compiled well, a huge one isn't compiled at all."""
    at = F.explode(F.array(*[F.struct(F.lit(more).alias("more"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for more, i, shift in places(edits)]))
    wide = lines.withColumn("wide", F.encode("line", "UTF-32")).withColumn("n", F.expr("octet_length(wide) div 4").cast("int"))
    each = wide.select("h", "line", "wide", "n", at.alias("p")).select("h", "line", "wide", "n", "p.*")
    each = each.withColumn("start", F.expr(f"int((n - more) * i div {edits + 1})")).withColumn("width", F.expr(f"int((n - more) * (i + 1) div {edits + 1})") - F.col("start"))
    each = each.where("start + shift >= 0 and start + shift + width <= n and width > 0")
    key = F.xxhash64(F.col("n") - F.col("more"), "i", F.expr("substring(wide, (start + shift) * 4 + 1, width * 4)"))
    return each.select("h", "line", key.bitwiseAND(F.lit((1 << KEY_BITS) - 1)).alias("key"), (F.expr("more = 0 and shift = 0")).alias("own"))


def pair_sketch(line: Column) -> Column:
    """Parity bits of the hashed character pairs of a line, in a long."""
    chars = F.split(line, "")
    bits = F.transform(F.arrays_zip(F.slice(chars, 1, F.size(chars) - 1).alias("a"), F.slice(chars, 2, F.size(chars)).alias("b")), lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(x["a"], x["b"]), F.lit(64))))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """Levenshtein distance of two strings if it is ``edits`` at most, else some
    greater number.

    Bits 0 .. 2 * edits of a long are the cells of one column within ``edits`` of
    the diagonal, as vertical differences +1 (vp) and -1 (vn). A column is made
    from the last by one addition and a few bit operations; the distance is
    followed down the lowest diagonal of the band, then along the last row.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    low = lambda x: x.bitwiseAND(F.lit(full).cast("long"))
    flip = lambda x: x.bitwiseXOR(F.lit(full).cast("long"))
    zero = F.lit(0).cast("long")
    both = F.array(F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("q"), F.length(a).alias("m"), F.length(b).alias("n")))

    def run(s: Column) -> Column:
        def column(st: Column, j: Column) -> Column:
            c = F.get(s["q"], j - 1)
            match = None
            for k in range(width):
                bit = F.when(F.get(s["p"], j - 1 - edits + k) == c, F.lit(1 << k).cast("long")).otherwise(zero)
                match = bit if match is None else match.bitwiseOR(bit)
            return F.transform(F.array(match), lambda pm: step(st, j, pm))[0]

        def step(st: Column, j: Column, pm: Column) -> Column:
            vp, vn = st["vp"], st["vn"]
            d0 = low((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn))
            return F.transform(F.array(d0), lambda d: after(st, j, d))[0]

        def after(st: Column, j: Column, d0: Column) -> Column:
            vp, vn = st["vp"], st["vn"]
            hp = low(vn.bitwiseOR(flip(d0.bitwiseOR(vp))))
            hn = d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            new_vp = low(hn.bitwiseOR(flip(down.bitwiseOR(hp))))
            new_vn = down.bitwiseAND(hp)
            # Row m lies below the band until column m - edits.
            row = s["m"] - j + edits
            diagonal = F.when(d0.bitwiseAND(F.lit(1 << (width - 1)).cast("long")) == 0, 1).otherwise(0)
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(row, F.lit(0)))
            flat = F.when(hp.bitwiseAND(bit) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(bit) != 0, 1).otherwise(0)
            moved = st["d"] + F.when(row >= width - 1, diagonal).otherwise(flat)
            return F.struct(new_vp.alias("vp"), new_vn.alias("vn"), moved.cast("int").alias("d"))

        first = F.struct(F.lit(full & ~((1 << edits) - 1)).cast("long").alias("vp"), zero.alias("vn"), F.lit(edits).alias("d"))
        return F.aggregate(F.sequence(F.lit(1), s["n"]), first, column, lambda st: st["d"])

    near = F.abs(F.length(a) - F.length(b)) <= edits
    usable = near & (F.length(a) >= edits) & (F.length(b) >= 1)
    short = F.levenshtein(a, b)
    return F.when(~near, F.lit(edits + 1)).when(usable, F.transform(both, run)[0]).otherwise(short)


def near_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(a, ga, b, gb), both hashes of different lines within ``edits`` edits, a < b."""
    lines = lines_of(docs, min_chars)
    # The hash's last bit makes room for ``own`` (up to the verified pairs a line goes by the others); the key is last, so its zero bytes meet the next row's.
    marked = F.col("h").bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(F.col("own").cast("long"))
    known = keyed(lines, edits).select(marked.alias("m"), "key").repartition("key").select("key", F.shiftright("m", 1).alias("h"), (F.col("m").bitwiseAND(F.lit(1).cast("long")) == 1).alias("own"))
    shared = known.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("own").alias("own")).where("own and lo < hi").select("key")
    # Both sides of the join are the one exchange, read twice; the few keys are hashed, so nothing is sorted.
    found = materialize(known.join(shared.hint("shuffle_hash"), "key").groupBy("key", "h").agg(F.max("own").alias("own")), "line_members")
    hashes = materialize(found.select("h").distinct(), "line_hashes")
    wanted = F.broadcast(hashes) if small_enough(hashes, F.lit(16), broadcast_bytes) else hashes.hint("shuffle_hash")
    again = lines.select(F.shiftright("h", 1).alias("h"), "line").join(wanted, "h", "left_semi")
    texts = materialize(again.groupBy("h").agg(F.min("line").alias("line")).withColumn("sketch", pair_sketch(F.col("line"))), "line_texts")
    members = found.select("h", "key", "own").join(texts.select("h", "sketch"), "h")
    # A key of many lines is dealt over salts: each line meets all others, in several tasks.
    dealt = salted(members, SALTED, broadcast_bytes)
    side = lambda c, salt: dealt.select("key", salt.alias("salt"), F.col("h").alias(c), F.col("own").alias(f"own_{c}"), F.col("sketch").alias(f"s_{c}"))
    alike = F.bit_count(F.col("s_a").bitwiseXOR(F.col("s_b"))) <= 4 * edits
    left, right = side("a", F.pmod(F.col("h"), F.col("salts")).cast("int")), side("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    pairs = left.join(right, ["key", "salt"]).where((F.col("a") < F.col("b")) & (F.col("own_a") | F.col("own_b")) & alike).select("a", "b").distinct()
    full = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
    longer = F.length("x") >= F.length("y")
    distance = edit_distance(F.when(longer, F.col("y")).otherwise(F.col("x")), F.when(longer, F.col("x")).otherwise(F.col("y")), edits)
    return materialize(full.where(distance <= edits).select(F.xxhash64("x").alias("a"), F.hash("x").alias("ga"), F.xxhash64("y").alias("b"), F.hash("y").alias("gb")), "near_lines")


def removed_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES, exact_chars: int | None = None) -> DataFrame:
    """doc_id, t (hash of the text), lines array<int> (numbers of the lines that go),
    n_near (of those, the ones with no equal line before). Documents that keep all
    have no row."""
    near = near_lines(docs, edits, min_chars, broadcast_bytes)
    least = min_chars if exact_chars is None else max(min(exact_chars, min_chars), 1)
    seen = materialize(lines_of(docs, least).select("doc_id", "t", "no", "h", "g"), "line_places")
    firsts = materialize(seen.groupBy("h", "g").agg(F.min(F.struct("doc_id", "t", "no")).alias("first"), F.count(F.lit(1)).alias("n")), "line_firsts")
    end = lambda h, g, other: near.select(F.col(h).alias("h"), F.col(g).alias("g"), F.struct(F.col(other).alias("h"), F.col(f"g{other}").alias("g")).alias("other"))
    ends = end("a", "ga", "b").unionByName(end("b", "gb", "a"))
    before = ends.join(firsts.select(F.struct("h", "g").alias("other"), F.col("first").alias("theirs")), "other").groupBy("h", "g").agg(F.min("theirs").alias("theirs"))
    state = firsts.join(before, ["h", "g"], "left").select("h", "g", "first", "n", (F.coalesce(F.col("theirs") < F.col("first"), F.lit(False))).alias("near"))
    # Written, so that a hot line's places can be split over tasks by the next join.
    state = materialize(state.where("n > 1 or near").select("h", "g", "first", "near"), "line_state")
    if small_enough(state, F.lit(52), broadcast_bytes):
        state = F.broadcast(state)
    going = seen.join(state, ["h", "g"]).withColumn("again", F.struct("doc_id", "t", "no") != F.col("first")).where("again or near")
    return materialize(going.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("no")).alias("lines"), F.count_if(~F.col("again")).alias("n_near")), "going_lines")


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES, exact_chars: int | None = None) -> DataFrame:
    """All columns of ``docs`` with the text less its repeated lines, and n_lines,
    n_removed, n_near, which replace columns of these names; any other column may
    have any name. Without ``exact_chars`` equal lines count from ``min_chars``.

    A null text stays null and has no lines. Rows with one id and one text count
    once and get one result each; texts under one id follow each other in order of
    their hash. A row without an id keeps its lines, which count for nobody. Empty
    tables stay empty.
    """
    id_, t_, lines_, near_ = (unused(docs, x) for x in ("id", "t", "lines", "near"))
    going = removed_lines(docs.select("doc_id", "text"), edits, min_chars, broadcast_bytes, exact_chars).toDF(id_, t_, lines_, near_)
    # Past the broadcast texts are dealt by document, but not sorted.
    going = F.broadcast(going) if small_enough(going, F.lit(72) + F.size(lines_) * 4, broadcast_bytes) else going.hint("shuffle_hash")
    joined = docs.join(going, (docs["doc_id"] == going[id_]) & (text_hash(docs["text"]) == going[t_]), "left")
    kept = F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains(F.col(lines_), i))
    text = F.when(F.col(lines_).isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))
    total = F.when(docs["text"].isNull(), F.lit(0)).otherwise(F.size(F.split(docs["text"], "\n")))
    sizes = {"n_lines": total, "n_removed": F.greatest(F.coalesce(F.size(lines_), F.lit(0)), F.lit(0)), "n_near": F.coalesce(near_, F.lit(0))}
    columns = [text.alias(c) if c == "text" else docs[c] for c in docs.columns if c.lower() not in sizes]
    return joined.select(*columns, *[v.cast("long").alias(k) for k, v in sizes.items()])


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(WORD)
