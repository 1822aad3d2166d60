"""Fill-in-the-middle: documents cut at two units and put together anew, so that a
model learns to write what stands between.

Units are letter runs and single other characters. The tokenizers library's
``Split`` pre-tokenizer finds them with isolated matches, without a vocabulary or
training, and tells their code-point offsets; the length of the offset array is
the number of units, and two ranked offsets cut the text into prefix, middle and
suffix. A text is handed over in pieces of about ``PIECE`` code points, cut before
a character that isn't a letter, which always starts a unit: so the memory for
offsets stays bounded while the text is read whole.

Everything is a map over rows: nothing is shuffled, and a lost executor's batches
are made again alike, as the cuts follow from the id alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
NOT_LETTER = re.compile("[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PIECE = 1 << 15
#: Bytes of text after which a batch of results is handed on.
BATCH_BYTES = 4 << 20


def unit_starts(split, text: str) -> np.ndarray:
    """Code-point offsets at which the units of ``text`` start, and its length."""
    at, found = 0, []
    while at < len(text):
        ahead = NOT_LETTER.search(text, at + PIECE)
        stop = ahead.start() if ahead else len(text)
        units = split.pre_tokenize_str(text[at:stop])
        found.append(np.fromiter((span[0] for _, span in units), np.int64, len(units)) + at)
        at = stop
    return np.concatenate([*found, np.array([len(text)], np.int64)])


def draws(doc_id: Column, seed: int) -> Column:
    """Four unsigned 32-bit numbers of a document: the leading groups of eight hex
    digits of the SHA-256 of ``seed:doc_id``. A null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.transform(F.array(*[F.lit(1 + 8 * k) for k in range(4)]), lambda at: F.conv(digest.substr(at, F.lit(8)), 16, 10).cast("long"))


def fill_in_middle(docs: DataFrame, seed: int = 1, percent: int = 90, suffix_first: int = 20) -> DataFrame:
    """(doc_id, text) -> doc_id, n, form, prefix_chars, middle_chars, output.

    ``percent`` of the documents are rearranged, of these ``suffix_first`` percent
    as ``spm`` (suffix, prefix, middle) and the others as ``psm`` (prefix, suffix,
    middle); the rest stays ``plain``, as do texts that are empty or hold one of the
    three marks. n is the number of units; the character counts are code points,
    null for plain. A null text counts as an empty one; rows of one id are cut by
    the same draws, each in its own text; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Regex, pre_tokenizers

        split = pre_tokenizers.Split(Regex(UNIT), "isolated")
        schema = None
        for part in parts:
            schema = schema or pa.schema([pa.field("doc_id", part.schema.field(0).type), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
            rows, size, first = [], 0, 0
            for i in range(len(part)):
                text = part.column(1)[i].as_py() or ""
                rows.append(_arranged(split, text, part.column(2)[i].as_py(), percent, suffix_first))
                size += len(text)
                if size >= BATCH_BYTES or i == len(part) - 1:
                    yield pa.RecordBatch.from_arrays([part.column(0)[first : i + 1], *(pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)
                    rows, size, first = [], 0, i + 1

    return docs.select("doc_id", "text", draws(F.col("doc_id"), seed).alias("draws")).mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def _arranged(split, text: str, draw: list[int], percent: int, suffix_first: int) -> tuple:
    starts = unit_starts(split, text)
    n = len(starts) - 1
    if not text or draw[2] % 100 >= percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (int(starts[k]) for k in sorted((draw[0] % (n + 1), draw[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draw[3] % 100 < suffix_first:
        return n, "spm", len(prefix), len(middle), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", len(prefix), len(middle), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: Column, form: Column) -> Column:
    """The text an output was made of. A mark starts with a character that is nowhere
    else in a mark, so pieces put together make no further one, and each of the three
    stands once in an output."""
    part = lambda mark, until: F.substring_index(F.substring_index(output, mark, -1), until, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(part(PREFIX, SUFFIX), middle, part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), middle, part(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
