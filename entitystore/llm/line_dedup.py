"""Repeated runs of lines: a suffix array over line ids by distributed prefix doubling, in DataFrame functions only.

The lines of all documents that have a word are one sequence of ids, cut at document ends and at lines
that occur once in the corpus, as no repeated run crosses those; pieces of under ``least`` words drop
out.  Suffixes of what is left are ranked by their first 1, 2, 4, ... lines: each round sorts the pairs of
ranks (of a suffix and of the one 2^k lines on) in ranges over the cluster, and numbers them in order.
Suffixes whose prefix occurs once have no rank and drop out of later rounds.

Suffixes that share a prefix of m lines are an interval of the suffix array whose longest common prefix
is m or more; the ranks of two overlapping prefixes of 2^k lines name it.  The earliest suffix of each
interval stays and the rest are later copies.  A maximal repeated run of ``least`` words or more is the
union of the shortest runs of ``least`` words that start, and of those that end, at each of its lines, so
two intervals a line settle all runs.  Lines without a word are neither compared nor removed.

A round's keys are counted before they are shuffled, and rows of frequent keys (a license line, a run
that a third of all documents hold) meet their ranks and intervals by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEAST = 50
#: Fixed value: words, as elsewhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def _lines(docs: DataFrame) -> DataFrame:
    """k, h (document), p (number among its lines with a word), at (among all lines), w (its words), a and b (its id: 128 bits)."""
    split = docs.select(common.key().alias("k"), common.text().alias("text")).select("k", F.xxhash64("text").alias("h"), common.once(F.split("text", "\n", -1)).alias("lines"))
    told = F.transform("lines", lambda x, i: F.struct(i.alias("at"), F.regexp_count(x, F.lit(WORD)).alias("w"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    return split.select("k", "h", F.posexplode(common.once(F.filter(told, lambda x: x["w"] > 0))).alias("p", "x")).select("k", "h", "p", "x.*")


def _ranked(rows: DataFrame, by: list[str], rank: str, scratch: common.Scratch) -> DataFrame:
    """Rows with the rank of their key in the order of the keys; null if no other row has it, or if it has a null."""
    keys, _ = scratch.save(rows.where(F.col(by[1]).isNotNull()).groupBy(*by).agg(F.count("*").alias("times")).where("times > 1"))
    ranked, _ = scratch.save(common.numbered(keys, by, scratch, rank))
    return common.join_keyed(rows, ranked, by, rows.count(), how="left").drop(*by, "times")


def suffixes(docs: DataFrame, least: int, scratch: common.Scratch) -> DataFrame:
    """k, h, g (piece), p, at, onwards and backwards (lines of the shortest run from and up to this one, null if there is none), r0, r1, ... (ranks by the first 1, 2, ... lines)."""
    lines, path = scratch.save(_lines(docs))
    shared = _ranked(lines, ["a", "b"], "r0", scratch).where("r0 is not null")
    # Rows that repeat an id and a text give the same lines; the set makes them one.
    of_doc = shared.groupBy("k", "h").agg(F.array_sort(F.collect_set(F.struct("p", "at", "w", "r0"))).alias("x"))
    each = of_doc.select("k", "h", F.posexplode("x").alias("n", "x")).select("k", "h", (F.col("x.p") - F.col("n")).alias("g"), "x")
    piece = each.groupBy("k", "h", "g").agg(F.array_sort(F.collect_list("x")).alias("x"), F.sum("x.w").alias("words")).where(F.col("words") >= least)
    piece = piece.select("k", "h", "g", "x", common.once(F.col("x.w")).alias("w"))

    def shortest(w: Column) -> Column:
        """Lines up to ``least`` words; null if there are not as many words."""
        zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("m"))
        return F.aggregate(w, zero, lambda s, x: F.when(s["sum"] >= least, s).otherwise(F.struct((s["sum"] + x).alias("sum"), (s["m"] + 1).alias("m"))), lambda s: F.when(s["sum"] >= least, s["m"]))

    def told(x: Column, n: Column) -> Column:
        low = F.greatest(n - least + 1, F.lit(0))
        return F.struct(
            x["p"].alias("p"), x["at"].alias("at"), x["r0"].alias("r0"), F.when(x["w"] >= least, F.lit(1)).otherwise(shortest(F.slice("w", n + 1, least))).alias("onwards"),
            F.when(x["w"] < least, shortest(F.reverse(F.slice("w", low + 1, n - low + 1)))).alias("backwards"),
        )

    now, last = scratch.save(piece.select("k", "h", "g", F.explode(F.transform("x", told)).alias("x")).select("k", "h", "g", "x.*"))
    scratch.drop(path)
    for k in range(max(1, least.bit_length()) - 1):
        step = Window.partitionBy("k", "h").orderBy("p").rangeBetween(1 << k, 1 << k)
        pairs, mine = scratch.save(now.withColumns({"x": F.when(F.max(f"r{k}").over(step).isNotNull(), F.col(f"r{k}")), "y": F.max(f"r{k}").over(step)}).withColumn("y", F.when(F.col("x").isNotNull(), F.col("y"))))
        scratch.drop(last)
        now, last = scratch.save(_ranked(pairs, ["x", "y"], f"r{k + 1}", scratch))
        scratch.drop(mine)
    return now


def runs(docs: DataFrame, least: int, scratch: common.Scratch) -> DataFrame:
    """k, h (document), m, x, y (the interval), i, j (first and last line) of every shortest run of ``least`` words whose first and last lines are not alone."""
    levels = max(1, least.bit_length())
    ranks = [f"r{k}" for k in range(levels)]
    piece = suffixes(docs, least, scratch).groupBy("k", "h", "g").agg(F.array_sort(F.collect_list(F.struct("p", "at", "onwards", "backwards", *ranks))).alias("z"))
    both = F.concat(F.transform("z", lambda x, n: F.struct(n.alias("s"), x["onwards"].alias("m"))), F.transform("z", lambda x, n: F.struct((n - x["backwards"] + 1).alias("s"), x["backwards"].alias("m"))))
    each = piece.select("k", "h", "z", F.explode(common.once(F.array_distinct(F.filter(both, lambda x: x["m"].isNotNull())))).alias("run"))
    s, m = F.col("run.s"), F.col("run.m")

    def rank(first: bool) -> Column:
        """Of the prefix of 2^k lines that starts the run, or of the one that ends it; k is as large as the run allows."""
        pick = F.lit(None).cast("long")
        for k in range(levels):
            pick = F.when(m >= 1 << k, F.get("z", s if first else s + m - (1 << k))[f"r{k}"]).otherwise(pick)
        return pick

    out = each.select("k", "h", m.alias("m"), rank(True).alias("x"), rank(False).alias("y"), F.get("z", s)["at"].alias("i"), F.get("z", s + m - 1)["at"].alias("j"))
    return out.where("x is not null and y is not null")


def later_copies(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """k, h, i, j of the runs that also start earlier: in a smaller doc_id (then a smaller text hash), or earlier in the same text."""
    scratch = common.Scratch(docs.sparkSession)
    each, _ = scratch.save(runs(docs, least, scratch))
    place = F.struct("k", "h", "i")
    interval, _ = scratch.save(each.groupBy("m", "x", "y").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1"))
    return common.join_keyed(each, interval, ["m", "x", "y"], each.count()).where(place > F.col("first")).select("k", "h", "i", "j")


def line_dedup(docs: DataFrame, least: int = LEAST, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed, text (without later copies of repeated runs), and columns to keep, of every row.

    A line with a word goes if it lies in a run of lines of ``least`` words or more that also starts earlier.
    Null or empty text: one line, none removed, text empty.  Rows that repeat an id and a text are
    one text, and alike.  A null id is one id below all others and is shown as null.  Empty table: no rows.
    """
    gone, _ = common.Scratch(docs.sparkSession).save(common.stretches(later_copies(docs, least)))
    whole = docs.select(common.key().alias("k"), common.text().alias("_text"), *keep).withColumn("h", F.xxhash64("_text"))
    met = common.attach(whole, gone, ["k", "h"]).withColumn("lines", common.once(F.split("_text", "\n", -1)))

    def cut(x: Column, n: Column) -> Column:
        """The lines between the stretch before and this one, and those of this one that have no word."""
        low = F.when(n > 0, F.get("gone", n - 1)["j"] + 1).otherwise(0)
        return F.concat(F.slice("lines", low + 1, x["i"] - low), F.filter(F.slice("lines", x["i"] + 1, x["j"] - x["i"] + 1), lambda t: ~t.rlike(WORD)))

    tail = F.get("gone", F.size("gone") - 1)["j"] + 1
    met = met.withColumn("left", F.when(F.col("gone").isNotNull(), common.once(F.concat(F.flatten(F.transform("gone", cut)), F.slice("lines", tail + 1, F.size("lines"))))))
    removed = F.when(F.col("left").isNull(), 0).otherwise(F.size("lines") - F.size("left"))
    text = F.when(F.col("left").isNull(), F.col("_text")).otherwise(F.array_join("left", "\n"))
    return met.select(F.when(F.col("k") != common.NULL_ID, F.col("k")).alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), text.alias("text"), *keep)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(common.table(spark, sf_dir, "documents"))


#: DuckDB: all pairs of equal lines, joined into runs along their diagonals; the later side of a run of 50 words goes.
SQL = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
counted AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM raw),
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM counted WHERE w > 0),
pairs AS (SELECT x.doc_id AS d1, y.doc_id AS d2, x.p AS p1, y.p AS p2, y.i AS i2, y.w AS w FROM seq x JOIN seq y ON x.line = y.line AND (x.doc_id, x.p) < (y.doc_id, y.p)),
marked AS (SELECT *, p2 - row_number() OVER (PARTITION BY d1, d2, p2 - p1 ORDER BY p2) AS g FROM pairs),
runs AS (SELECT d2, i2, sum(w) OVER (PARTITION BY d1, d2, p2 - p1, g) AS words FROM marked),
gone AS (SELECT DISTINCT d2 AS doc_id, i2 AS i FROM runs WHERE words >= 50),
kept AS (SELECT raw.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, string_agg(line, chr(10) ORDER BY raw.i) FILTER (WHERE gone.i IS NULL) AS text
         FROM raw LEFT JOIN gone ON raw.doc_id = gone.doc_id AND raw.i = gone.i GROUP BY raw.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, coalesce(text, '') AS text FROM kept
"""
