"""Token counts by overlap resynchronisation.

A text of up to ``chunk`` characters is encoded whole.  A longer one is encoded in overlapping
chunks with offsets, and neighbouring chunks are spliced at a boundary that is
  * stable: no rule of the tokenizer looks across it (see ``_stable``), and
  * common: both chunks start a token there, or have white space there.
Where an overlap has no such boundary it is widened, twofold each time, in the end to the whole
text; so counts equal those of the whole text, and a worker holds few chunks at a time.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

VOCABULARY = "word_bpe_49k.json"
CONTEXT = 2048


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def _specials(path: str) -> tuple[str, ...]:
    return tuple(x.content for x in tokenizer(path).get_added_tokens_decoder().values())


def _stable(s: str, p: int, specials: tuple[str, ...]) -> bool:
    """Whether tokens of s on either side of p do not depend on the other side.

    White space splits words and is dropped.  Else the right side must begin with an ASCII
    character, which never composes with what stands before it, and the pattern must end a match
    there: at a digit, or between a letter and a sign, unless an apostrophe could start a
    contraction or a special string lies across.
    """
    a, b = s[p - 1], s[p]
    if b in " \t\n\r" or (a in " \t\n\r" and b.isascii()):
        return True
    if not b.isascii() or not a.isascii():
        return False
    if not (a.isdigit() or b.isdigit() or (a.isalpha() and not b.isalpha()) or (b.isalpha() and not a.isalpha() and a != "'")):
        return False
    for x in specials:
        n = len(x) - 1
        at = s.find(x, max(0, p - n), p + n)
        if at >= 0 and at < p < at + len(x):
            return False
    return True


def _splice(s: str, left: tuple[int, list], right: tuple[int, list], low: int, high: int, specials: tuple[str, ...]) -> int:
    """A stable common boundary in [low, high), nearest the middle, or -1.

    left and right: a chunk's place in s and the starts of its tokens in s.
    """
    both = set(left[1]) & set(right[1])
    spots = sorted((p for p in both if low < p < high), key=lambda p: abs(2 * p - low - high))
    for p in spots:
        if _stable(s, p, specials):
            return p
    for p in range(low + 1, high):
        if s[p] in " \t\n\r":
            return p
    return -1


def count_long(s: str, path: str, chunk: int, overlap: int) -> int:
    """Tokens of one long text, by splicing chunks."""
    t, specials = tokenizer(path), _specials(path)

    def starts(a: int, b: int) -> list[int]:
        return [a + x for x, _ in t.encode(s[a:b], add_special_tokens=False).offsets]

    def between(of: list[int], a: int, b: int) -> int:
        return bisect_left(of, b) - bisect_left(of, a)

    total, begin, at, end = 0, 0, 0, min(len(s), chunk)
    have = starts(at, end)
    while end < len(s):
        lap = overlap
        while True:
            low = max(begin, end - lap)
            far = min(len(s), low + max(chunk, 2 * lap))
            more = starts(low, far)
            # The margins keep what a chunk's cut ends have changed out of the splice.
            margin = min(64, (end - low) // 4)
            p = _splice(s, (at, have), (low, more), low + margin, end - margin, specials)
            if p > begin:
                break
            if low == begin:  # widened to all that is left: encode on from the last splice
                low, far = begin, min(len(s), max(far, end + lap))
                more, p = starts(low, far), begin
                break
            lap *= 2
        total += between(have, begin, p)
        begin, at, end, have = p, low, far, more
    return total + between(have, begin, len(s) + 1)


def counts(texts: list[str], path: str, chunk: int, overlap: int) -> list[int]:
    out = [0] * len(texts)
    short = [i for i, s in enumerate(texts) if len(s) <= chunk]
    for part in common.slabs(short, lambda i: len(texts[i]), 1 << 19):
        for i, e in zip(part, tokenizer(path).encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
            out[i] = len(e)
    for i, s in enumerate(texts):
        if len(s) > chunk:
            out[i] = count_long(s, path, chunk, overlap)
    return out


def token_counts(docs: DataFrame, path: str, limit: int = CONTEXT, chunk: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of docs.

    Null or empty text: no bytes, no tokens.  Repeated rows: a row each.  Empty table: no rows.
    No shuffle; memory is bounded by an Arrow batch and the longest text.
    """
    common.ship(docs.sparkSession)

    def run(batches):
        for b in common.slices(batches):
            texts = b.column("text").to_pylist()
            n = counts(texts, path, chunk, overlap)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s.encode()) for s in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    from pyspark.sql import functions as F

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
