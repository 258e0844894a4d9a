"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions only.

One pass over the corpus stores the index: a posting for every occurrence of a test term (term, document,
position, and a twelve-bit code of the next word, as in a nextword index), sorted by term in each of its
files.  A posting of the empty term gives a document's number of words.  All else reads the index.

Test windows are phrases.  Terms are ordered by the length of their lists.  A window's candidates are the
postings of its rarest term, adjusted by its offset, whose next word has the right code; the lists of all
its other terms, adjusted likewise, are intersected with those.  Only lists of documents with candidates
take part in that.  The result is phrase matches: document, start, size, items.  Sets of terms that must
be near each other are matched by the same index.

What is broadcast (terms, windows, documents with candidates) is counted first; beyond ``block`` rows it
meets the index by a shuffle, salted, as a third of all rows may be of one term or window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 8
BLOCK = 500_000
CODES = 4096
#: What separates words once A-Z are in lower case.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), SEPARATOR), lambda w: w != "")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """w (words of a window), items (the ids of the items that have it, sorted)."""
    n = F.size("words")
    cut = F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.slice("words", i + 1, size))).when(n > 0, F.array("words"))
    had = items.select(F.col("item_id").cast("string").alias("item"), words(common.text()).alias("words")).where("item is not null")
    return had.select("item", F.explode(cut).alias("w")).groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _code(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(CODES)).cast("short")


def index(docs: DataFrame, terms: DataFrame, scratch: common.Scratch, block: int = BLOCK) -> DataFrame:
    """term, k, h (document), pos, next (code of the next word) of all postings of some terms in whole texts, stored; the empty term's pos is the number of words."""
    none = docs.sparkSession.range(1).select(F.lit("").alias("term"))
    text = docs.select(common.key().alias("k"), F.xxhash64(common.text()).alias("h"), common.once(words(common.text())).alias("words"))
    each = text.select("k", "h", F.posexplode(F.arrays_zip(F.concat("words", F.array(F.lit(""))).alias("term"), F.slice("words", 2, F.size("words")).alias("after"))).alias("pos", "x")).select("k", "h", "pos", "x.term", "x.after")
    wanted = common.having(each, terms.select("term").distinct().unionByName(none), "term", "k", block)
    return scratch.save(wanted.select("term", "k", "h", "pos", _code(F.col("after")).alias("next")).sortWithinPartitions("term", "k", "h", "pos"))[0]


def _ordered(wanted: DataFrame, times: DataFrame, key: str) -> DataFrame:
    """Rows of wanted (key, w) with lists: their words by the length of their lists (times, at, term), the shortest first; rows with a word without postings go."""
    each = wanted.select(key, F.posexplode("w").alias("at", "term")).join(times, "term", "left")
    lists = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("times", "at", "term"))).alias("lists"))
    return wanted.join(lists, key).where(~F.exists("lists", lambda x: x["times"].isNull()))


def phrase_matches(postings: DataFrame, wanted: DataFrame, scratch: common.Scratch, block: int = BLOCK) -> DataFrame:
    """k, h (document), start, size, items of every place where a window of wanted (w, items) stands."""
    times = postings.where("term <> ''").groupBy("term").agg(F.count("*").alias("times"))
    known = common.numbered(wanted, ["w"], scratch, "id")
    plan, _ = scratch.save(_ordered(known, times, "id"))
    size = F.size("w")
    first = F.filter("lists", lambda x: (x["at"] < F.size("w") - 1) | (F.size("w") == 1))[0]  # the rarest that has a next word
    anchors = plan.select("id", first["term"].alias("term"), first["at"].alias("at"), _code(F.get("w", first["at"] + 1)).alias("code"), size.alias("size"))
    right = ((F.col("size") == 1) | (F.col("next") == F.col("code"))) & (F.col("pos") >= F.col("at"))
    found, _ = scratch.save(common.meet(postings, anchors, "term", "h", block).where(right).select("id", "k", "h", (F.col("pos") - F.col("at")).alias("start"), "at", "size").distinct())
    lists = common.having(postings, found.select("h").distinct(), "h", "k", block).select("term", "k", "h", "pos")
    others = common.meet(found.where("size > 1"), plan.select("id", "lists"), "id", "h", block)
    need = others.select("id", "k", "h", "start", "at", F.explode("lists").alias("x")).where("x.at <> at").select("id", "k", "h", "start", (F.col("start") + F.col("x.at")).alias("pos"), F.col("x.term").alias("term"))
    got = need.join(lists, ["k", "h", "term", "pos"], "left_semi").groupBy("id", "k", "h", "start").agg(F.count("*").alias("n"))
    whole = got.join(found, ["id", "k", "h", "start"]).where(F.col("n") == F.col("size") - 1).select("id", "k", "h", "start", "size")
    every = whole.unionByName(found.where("size = 1").select("id", "k", "h", "start", "size"))
    return common.meet(every, plan.select("id", "items"), "id", "h", block).select("k", "h", "start", "size", "items")


def near_matches(postings: DataFrame, wanted: DataFrame, within: int, scratch: common.Scratch, block: int = BLOCK) -> DataFrame:
    """k, h (document), id, pos of every place of the rarest term of a set (id, w) that has all the others at most ``within`` words away."""
    times = postings.where("term <> ''").groupBy("term").agg(F.count("*").alias("times"))
    plan, _ = scratch.save(_ordered(wanted, times, "id"))
    anchors = plan.select("id", F.col("lists")[0]["term"].alias("term"), F.size("lists").alias("size"))
    found, _ = scratch.save(common.meet(postings, anchors, "term", "h", block).select("id", "k", "h", "pos", "term", "size").distinct())
    wide = within + 1  # places at most ``within`` away lie in this stretch of so many words, or in one beside it
    lists = common.having(postings, found.select("h").distinct(), "h", "k", block).select("term", "k", "h", F.col("pos").alias("at"), F.floor(F.col("pos") / wide).alias("part"))
    need = common.meet(found.withColumnRenamed("term", "first"), plan.select("id", "lists"), "id", "h", block).select("id", "k", "h", "pos", "first", F.explode("lists").alias("x")).select("id", "k", "h", "pos", "first", F.col("x.term").alias("term")).where("term <> first")
    parts = need.withColumn("part", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("pos") / wide) + d)))
    got = parts.join(lists, ["k", "h", "term", "part"]).where(F.abs(F.col("at") - F.col("pos")) <= within).groupBy("id", "k", "h", "pos").agg(F.count_distinct("term").alias("n"))
    whole = got.join(found, ["id", "k", "h", "pos"]).where(F.col("n") == F.col("size") - 1)
    return whole.select("k", "h", "id", "pos").unionByName(found.where("size = 1").select("k", "h", "id", "pos"))


def _phrases(docs: DataFrame, items: DataFrame, size: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The index of the items' terms, and the phrase matches of their windows, stored."""
    scratch = common.Scratch(docs.sparkSession)
    wanted, _ = scratch.save(windows(items, size))
    postings = index(docs, wanted.select(F.explode("w").alias("term")), scratch, block)
    return postings, scratch.save(phrase_matches(postings, wanted, scratch, block))[0]


def _hits(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each document with matches: gone (ranges of its hit words), and items (sorted)."""
    return common.stretches(matches.select("k", "h", F.col("start").alias("i"), (F.col("start") + F.col("size") - 1).alias("j"))), matches.select("k", "h", F.explode("items").alias("item")).groupBy("k", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, least: int = 2, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_items >= least) of every row.

    Null or empty text: no words.  An item of fewer than size words is one window, one of none has
    none; items without an id have none.  Repeated rows: a row each, alike.  A null doc_id is shown as
    null.  Empty tables: no rows, or no hits.
    """
    postings, matches = _phrases(docs, items, size, block)
    gone, found = _hits(matches)
    per_doc = postings.where("term = ''").groupBy("k", "h").agg(F.count("*").alias("times"), F.max("pos").alias("n_words")).join(gone, ["k", "h"], "left").join(found, ["k", "h"], "left")
    hit = F.aggregate(F.coalesce("gone", F.array()), F.lit(0).cast("long"), lambda n, x: n + x["j"] - x["i"] + 1)
    held = F.coalesce("items", F.array().cast("array<string>"))
    out = per_doc.select(
        F.when(F.col("k") != common.NULL_ID, F.col("k")).alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(hit).alias("n_hit"), F.size(held).cast("long").alias("n_items"),
        F.sha2(F.array_join(held, ",").cast("binary"), 256).alias("items_sha256"), (F.size(held) >= least).alias("contaminated"), "times",
    )
    return out.withColumn("x", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("x", "times")


#: Fixed value: the words of a text as it stands.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def excise(docs: DataFrame, items: DataFrame, size: int = WINDOW, least: int = 2, block: int = BLOCK) -> DataFrame:
    """The rows of docs without those of ``least`` or more items; hit words of the others are cut from their texts.

    Rows without a hit stay as they are, with all columns of docs, a null text too.  Repeated rows
    stay each, alike; a null doc_id is one id.  Empty tables: no rows, or all rows as they are.
    """
    _, matches = _phrases(docs, items, size, block)
    gone, found = _hits(matches)
    hits, _ = common.Scratch(docs.sparkSession).save(gone.join(found, ["k", "h"]).select(F.col("k").alias("_k"), F.col("h").alias("_h"), F.col("gone").alias("_gone"), F.size("items").alias("_items")))
    met = common.attach(docs.withColumns({"_k": common.key(), "_h": F.xxhash64(common.text())}), hits, ["_k", "_h"]).where(f"_items is null or _items < {int(least)}")
    word, gap = F.regexp_extract_all("text", F.lit(WORD), 0), F.split("text", WORD, -1)
    met = met.withColumn("_g", F.when(F.col("_gone").isNotNull(), common.once(gap)))
    met = met.withColumn("_x", F.when(F.col("_gone").isNotNull(), common.once(F.zip_with(word, F.slice("_g", 2, F.size("_g")), lambda w, g: F.concat(w, g)))))
    tail = F.get("_gone", F.size("_gone") - 1)["j"] + 1

    def between(x: Column, n: Column) -> Column:
        low = F.when(n > 0, F.get("_gone", n - 1)["j"] + 1).otherwise(0)
        return F.slice("_x", low + 1, x["i"] - low)

    left = F.concat(F.flatten(F.transform("_gone", between)), F.slice("_x", tail + 1, F.size("_x")))
    cut = F.concat(F.get("_g", F.lit(0)), F.array_join(left, ""))
    return met.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(cut)).select(*docs.columns)


def proximity_matches(docs: DataFrame, wanted: DataFrame, within: int, block: int = BLOCK) -> DataFrame:
    """doc_id, id, pos: places of the rarest term of a set of terms that has all others at most ``within`` words away.

    wanted: id, w (an array of terms in lower case); ids differ.  Empty sets, sets without an id and
    sets with a term of no posting match nowhere.  Repeated rows of docs, and null
    and empty texts, add nothing; a null doc_id is shown as null.  Empty tables: no rows.
    """
    scratch = common.Scratch(docs.sparkSession)
    sets = wanted.where("id is not null").select("id", F.array_sort(F.array_distinct("w")).alias("w")).where(F.size("w") > 0)
    postings = index(docs, sets.select(F.explode("w").alias("term")), scratch, block)
    return near_matches(postings, sets, within, scratch, block).select(F.when(F.col("k") != common.NULL_ID, F.col("k")).alias("doc_id"), "id", "pos").distinct()


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


#: DuckDB: words by the same rule, windows of items, and every document window looked up among them.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(8, len(w)) AS n, array_to_string(list_slice(w, s, s + least(8, len(w)) - 1), ' ') AS p
        FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 7))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS p
       FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.r, dw.s, dw.n, win.item FROM dw JOIN win ON dw.p = win.p AND dw.n = win.n),
pos AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS x FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
