"""Information-theoretic sanitisation, in DataFrame functions only.

Base patterns find personal data: e-mail and IP addresses, card and phone numbers.  Each different value
is a protected entity.  Terms (words outside the base spans) that occur in its documents are weighed by
corpus co-occurrence: n(t) is the evidence for a term, n(e) for an entity, n(t, e) for both, N for all
texts, and t discloses e if
    n(t, e) >= support,   n(t, e) / n(t) >= share,   log2(n(t, e) N / (n(t) n(e))) >= bits.
Evidence counts different surroundings (the words before and after), at most one a text, so that copies
and near copies of a text count once.  Occurrences of disclosing terms become spans of kind "term";
``sanitise`` puts a general name in the place of every span, and removes terms.

Terms that are new in every text (keys, passwords) have no evidence of their own.  Those with a digit are
weighed as a class: which kinds of characters a term has, and its length by powers of two.  The entity is
then the credential that names like "token" announce, at most two terms before.  n(t) and n(t, e)
count different terms of the class, so copies count once, n(e) / N is the share of all words that are terms so
announced, and the same thresholds hold.  All terms of a disclosing class become spans.

Only counts by term, by class and by (term, entity) are shuffled; n(t) is counted over the whole corpus for terms
that pass the support.  Texts are shuffled only if more of them hold entities than may be broadcast, and
then copies of one are salted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

# What the kinds are, in order, and their patterns.  A look back, or the end of the last match,
# stands where every later start in the same run would fail as the first; it keeps long runs linear.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match holds, to skip texts cheaply.
HOLDS = {"email": "@", "ip": ".", "phone": "+"}
#: What a text must hold for a match of the pattern to count, where the pattern alone says little.
LEAST = {"card": r"[0-9](?:[\x20-]?[0-9]){13}"}
WORD = r"[^\x20\x09-\x0D]+"
MARKS = ".,;:!?\"'()[]{}<>|#*$%&/=_~`^+-"
SUPPORT, SHARE, BITS = 3, 0.5, 4.0
#: Names that announce a credential, a term with a digit, and one that stands right after such a name or with a word between.
CREDENTIALS = ("token", "password", "passwd", "pwd", "secret", "api_key", "apikey", "api-key", "access_key", "secret_key", "private_key", "auth", "authorization", "bearer", "credential", "credentials", "passphrase")
_IN = r"\p{L}\p{N}_+/.\-"
TERM = rf"(?<![{_IN}])[{_IN}&&[^0-9]]*+[0-9][{_IN}]*+"
NAME = rf"(?i)(?<![{_IN}])(?:{'|'.join(CREDENTIALS)})(?![{_IN}])"
AFTER_NAME = rf"{NAME}[^{_IN}]{{1,8}}+(?:[{_IN}&&[^0-9]]{{1,20}}+[^{_IN}]{{1,8}}+)?+({TERM})"


def _passes(kind: str, m: Column) -> Column:
    """Whether a match of a kind's pattern counts."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = F.transform(F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
        return F.forall(part, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
    if kind == "card":
        back = F.split(F.reverse(digits), "")
        value = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
        return F.length(digits).between(14, 19) & (F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _located(rows: DataFrame, text: str, pattern: str, holds: str | None = None) -> DataFrame:
    """Each match of a pattern in a text: the other columns of rows, value, start, end (code points).

    Matches and the gaps between them are counted up within the text.
    """
    names = [c for c in rows.columns if c != text]
    if holds:
        rows = rows.where(F.contains(F.col(text), F.lit(holds)))
    found = rows.withColumn("_m", F.regexp_extract_all(text, F.lit(pattern), 0)).where(F.size("_m") > 0)
    found = found.withColumn("_g", F.transform(F.split(text, pattern, -1), F.length))
    each = found.select(*names, F.posexplode(F.zip_with("_m", "_g", lambda m, g: F.struct(m.alias("m"), g.alias("g")))).alias("_p", "_x")).where("_x.m is not null")
    each = each.select(*names, "_p", F.col("_x.m").alias("value"), F.col("_x.g").alias("_gap"))
    end = F.sum(F.col("_gap") + F.length("value")).over(Window.partitionBy(*names).orderBy("_p"))
    return each.select(*names, "value", (end - F.length("value")).alias("start"), end.alias("end"))


def _blanked(text: str) -> Column:
    """A text of the same length with a space for each character of its base spans."""
    t = F.col(text)

    def piece(kind: str):
        """A gap and the match after it, if there is one."""
        return lambda g, m: F.concat(g, F.when(m.isNull(), F.lit("")).when(_passes(kind, m), F.repeat(F.lit(" "), F.length(m))).otherwise(m))

    parts = []
    for kind, pattern in PATTERNS.items():
        pieces = F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), 0), piece(kind))
        may = F.contains(t, F.lit(HOLDS[kind])) if kind in HOLDS else F.lit(True)
        parts.append(F.when(may & F.rlike(t, F.lit(LEAST.get(kind, pattern))), F.array_join(pieces, "")).otherwise(t))

    def both(a: Column, b: Column) -> Column:
        """Blank where either is; character by character only if both differ from the text."""
        each = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == " ", x).otherwise(y))
        return F.when(a == t, b).when((b == t) | (a == b), a).otherwise(F.array_join(each, ""))

    # One lambda's argument holds all parts, so that each is computed once.
    return F.aggregate(F.array(*parts), t, both)


def base_spans(docs: DataFrame) -> DataFrame:
    """k, h (document), kind, value, start, end of the base spans; rows that repeat an id and a text give them once."""
    rows = docs.select(common.key().alias("k"), common.text().alias("text")).withColumn("h", F.xxhash64("text"))
    parts = None
    for kind, pattern in PATTERNS.items():
        # A row's own number keeps rows that repeat an id and a text apart until their spans are made one.
        got = _located(rows.withColumn("_r", F.monotonically_increasing_id()), "text", pattern, HOLDS.get(kind)).drop("_r")
        got = got.where(_passes(kind, F.col("value"))).select("k", "h", F.lit(kind).alias("kind"), "value", "start", "end")
        parts = got if parts is None else parts.unionByName(got)
    return parts.distinct()


def _said(rows: DataFrame) -> DataFrame:
    """The other columns of rows, and each word of its text outside the base spans: term (lower case, no marks at its ends), before and after (the words beside it)."""
    bare = rows.withColumn("text", common.once(_blanked("text")))
    w = bare.withColumn("_w", common.once(F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0))).where(F.size("_w") > 0)
    none = F.array(F.lit(""))
    beside = w.withColumn("_x", F.explode(F.arrays_zip("_w", F.concat(none, "_w").alias("b"), F.concat(F.slice("_w", 2, F.size("_w")), none).alias("a"))))
    out = beside.select(*(c for c in rows.columns if c != "text"), F.btrim("_x._w", F.lit(MARKS)).alias("term"), F.col("_x.b").alias("before"), F.col("_x.a").alias("after"))
    return out.where(F.length("term") > 1)


def disclosing_terms(docs: DataFrame, spans: DataFrame, scratch: common.Scratch, support: int = SUPPORT, share: float = SHARE, bits: float = BITS) -> DataFrame:
    """term, entity, bits of the terms that disclose an entity (kind and value) of spans."""
    value = F.when(F.col("kind") == "email", F.lower("value")).otherwise(F.regexp_replace("value", "[^0-9.]", ""))
    entity = spans.select("h", F.concat_ws(":", "kind", value).alias("entity")).distinct()
    texts = entity.groupBy("entity").agg(F.count("*").alias("texts")).where(F.col("texts") >= support)
    shared, _ = scratch.save(common.join_keyed(entity, texts, "entity", entity.count(), "texts").select("h", "entity"))
    each = docs.select(common.key().alias("k"), common.text().alias("text")).withColumn("h", F.xxhash64("text"))
    # Only texts with a base span; the filter is by pattern, so that texts are not shuffled.
    held = each.where(reduce(lambda a, b: a | b, ((F.contains("text", F.lit(HOLDS[kind])) if kind in HOLDS else F.lit(True)) & F.rlike("text", F.lit(pattern)) for kind, pattern in PATTERNS.items())))
    context = F.min(F.xxhash64("before", "after")).alias("context")
    said = _said(common.having(held, shared.select("h").distinct(), "h", "k"))
    near, _ = scratch.save(said.groupBy("h", "term").agg(context))
    # No term with less evidence than the support can pass, so only the others meet the entities of their texts.
    able = near.groupBy("term").agg(F.count_distinct("context").alias("of_term"), F.count("*").alias("times")).where(F.col("of_term") >= support).drop("of_term")
    near, _ = scratch.save(common.join_keyed(near, able, "term", near.count()).drop("times"))
    pairs = near.join(shared, "h").groupBy("term", "entity").agg(F.count_distinct("context").alias("both")).where(F.col("both") >= support)

    def enough(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
        """Pairs whose share is large enough over some texts; over more texts it can only be less."""
        return pairs.join(evidence, "term").where(F.col("both") >= share * F.col("of_term"))

    def evidence(per_text: DataFrame) -> DataFrame:
        return per_text.groupBy("term").agg(F.count_distinct("context").alias("of_term"))

    def counted(rows: DataFrame, terms: DataFrame) -> DataFrame:
        """Evidence for some terms over the texts of rows; a bounded part of the terms is broadcast at a time."""
        parts = [_said(rows).join(F.broadcast(part), "term", "left_semi").groupBy("term", "h").agg(context) for part in common.blocks(terms, ["term"])]
        return evidence(reduce(DataFrame.unionByName, parts))

    # The share is tested over the entities' texts, then over all texts with a base span, then over the corpus.
    pairs, _ = scratch.save(enough(pairs, evidence(near)).drop("of_term"))
    for rows in (held, each):
        if not pairs.take(1):
            return pairs.select("term", "entity", F.lit(0.0).alias("bits"))
        pairs, _ = scratch.save(enough(pairs.drop("of_term"), counted(rows, pairs.select("term").distinct())))
    total = each.select(F.count_distinct("h")).first()[0]
    bits_of = F.log2(F.col("both") * F.lit(float(total)) / (F.col("of_term") * F.greatest("texts", "both")))
    return pairs.join(texts, "entity").withColumn("bits", bits_of).where(F.col("bits") >= bits).select("term", "entity", "bits")


def _class(term: Column) -> Column:
    """The class of a term: kinds of its characters, and its length by powers of two."""
    has = [F.when(F.rlike(term, F.lit(p)), F.lit(x)).otherwise(F.lit("")) for x, p in (("a", "[a-z]"), ("A", "[A-Z]"), ("9", "[0-9]"), ("o", "[^A-Za-z0-9]"))]
    return F.concat(*has, F.floor(F.log2(F.length(term))).cast("string"))


def disclosing_classes(docs: DataFrame, support: int = SUPPORT, share: float = SHARE, bits: float = BITS) -> DataFrame:
    """class, of_class, both, bits of the classes of terms that disclose a credential: at most 16 kinds for each power of two.

    Counts of different terms are estimates with a bounded sketch a class, exact but for rounding where they are small.
    """
    # Terms have a digit, so other texts are only counted.
    text = docs.select(common.text().alias("text")).select("text", common.once(F.when(F.rlike("text", F.lit("[0-9]")), _blanked("text"))).alias("bare"))
    empty = F.array().cast("array<string>")
    told = text.select(F.coalesce(F.regexp_extract_all("bare", F.lit(TERM), 0), empty).alias("all"), F.coalesce(F.regexp_extract_all("bare", F.lit(AFTER_NAME), 1), empty).alias("after"), F.regexp_count("text", F.lit(WORD)).alias("words"))
    # A text's row of counts, and a row for each of its terms.
    none = F.struct(F.lit(None).cast("string").alias("term"), F.lit(False).alias("near"), F.col("words").cast("long").alias("words"), F.size("after").cast("long").alias("names"))

    def rows(array: str, near: bool) -> Column:
        return F.transform(array, lambda t: F.struct(t.alias("term"), F.lit(near).alias("near"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("names")))

    each = told.select(F.explode(F.concat(F.array(none), rows("all", False), rows("after", True))).alias("x")).select("x.*")
    counted = each.groupBy(_class(F.col("term")).alias("class")).agg(F.approx_count_distinct("term", 0.02).alias("of_class"), F.approx_count_distinct(F.when(F.col("near"), F.col("term")), 0.02).alias("both"), F.sum("words").alias("words"), F.sum("names").alias("names"))
    total = Window.partitionBy()  # a row a class
    weighed = counted.withColumn("bits", F.log2(F.col("both") / F.col("of_class") * F.sum("words").over(total) / F.greatest(F.sum("names").over(total), F.lit(1)))).where("class is not null")
    return weighed.where((F.col("both") >= support) & (F.col("both") >= share * F.col("of_class")) & (F.col("bits") >= bits)).select("class", "of_class", "both", "bits")


def _of_classes(docs: DataFrame, classes: list[str]) -> DataFrame:
    """k, h, value, start, end of the terms of some classes; only texts that hold one are read term by term."""
    rows = docs.select(common.key().alias("k"), common.text().alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.where(F.rlike("text", F.lit("[0-9]"))).withColumn("text", common.once(_blanked("text"))).withColumn("_r", F.monotonically_increasing_id())
    held = rows.where(F.exists(F.regexp_extract_all("text", F.lit(TERM), 0), lambda x: _class(x).isin(*classes)))
    return _located(held, "text", TERM).drop("_r").where(_class(F.col("value")).isin(*classes)).distinct()


def find(docs: DataFrame, support: int = SUPPORT, share: float = SHARE, bits: float = BITS) -> DataFrame:
    """k, h, kind, value, start, end of the base spans and of the spans of disclosing terms."""
    scratch = common.Scratch(docs.sparkSession)
    base, _ = scratch.save(base_spans(docs))
    classes = sorted(r[0] for r in disclosing_classes(docs, support, share, bits).select("class").collect())  # so few by construction
    terms, _ = scratch.save(disclosing_terms(docs, base, scratch, support, share, bits).select("term").distinct())
    found = _of_classes(docs, classes).select("k", "h", "value", "start", "end") if classes else None
    if terms.take(1):
        rows = docs.select(common.key().alias("k"), common.text().alias("text")).withColumn("h", F.xxhash64("text"))
        hit = reduce(DataFrame.unionByName, [_said(rows.select("h", "text")).join(F.broadcast(part), "term", "left_semi").select("h") for part in common.blocks(terms, ["term"])]).distinct()
        words = _located(common.having(rows, scratch.save(hit)[0], "h", "k").withColumn("text", common.once(_blanked("text"))).withColumn("_r", F.monotonically_increasing_id()), "text", WORD).drop("_r").distinct()
        bare = F.btrim("value", F.lit(MARKS))
        lead = F.length("value") - F.length(F.ltrim("value", F.lit(MARKS)))
        cut = words.select("k", "h", (F.col("start") + lead).alias("start"), bare.alias("value"), F.lower(bare).alias("term"))
        more = cut.join(terms, "term", "left_semi").select("k", "h", "value", "start", (F.col("start") + F.length("value")).alias("end"))
        found = more if found is None else found.unionByName(more)
    if found is None:
        return base
    return base.unionByName(found.distinct().select("k", "h", F.lit("term").alias("kind"), "value", "start", "end"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, support: int = SUPPORT, share: float = SHARE, bits: float = BITS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, n_spans (of terms, of all kinds) of every row of docs.

    Words of one character are no terms.  Null or empty text: no spans.  Repeated rows: a row each, alike.  Empty table: no rows.
    """
    rank = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))[F.col("kind")]
    of_doc = find(docs, support, share, bits).groupBy("k", "h").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("all"))
    of_doc = of_doc.select(F.col("k").alias("k2"), F.col("h").alias("h2"), "all")
    ids = docs.select(common.key().alias("k"), F.xxhash64(common.text()).alias("h"))
    met = ids.join(of_doc, (F.col("k") == F.col("k2")) & (F.col("h") == F.col("h2")), "left")
    every = F.coalesce("all", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>"))
    count = {f"n_{kind}": F.size(F.filter(every, _is(kind))).cast("long") for kind in KINDS[:-1]}
    base = F.filter(every, lambda s: s["kind"] != "term")
    return met.select(F.when(F.col("k") != common.NULL_ID, F.col("k")).alias("doc_id"), *(c.alias(n) for n, c in count.items()), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"), F.size(F.filter(every, _is("term"))).cast("long").alias("n_term"), F.size(every).cast("long").alias("n_spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def sanitise(docs: DataFrame, support: int = SUPPORT, share: float = SHARE, bits: float = BITS) -> DataFrame:
    """docs with base spans generalised to <kind> and disclosing terms removed; where spans overlap, the first one counts.

    A null text stays null.  Repeated rows stay each, alike; a null doc_id is one id.  Further columns stay,
    whatever their names (those that begin with an underscore excepted).  Empty table: no rows.
    """
    of_doc = find(docs, support, share, bits).groupBy(F.col("k").alias("_k"), F.col("h").alias("_h")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_all"))
    met = docs.join(of_doc, (common.key() == F.col("_k")) & (F.xxhash64(common.text()) == F.col("_h")), "left")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        name = F.when(x["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("<"), x["kind"], F.lit(">")))
        between = F.substr(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))).otherwise(F.struct(x["end"].alias("at"), F.concat(s["out"], between, name).alias("out")))

    cut = F.aggregate("_all", zero, step, lambda s: F.concat(s["out"], F.substr(F.col("text"), (s["at"] + 1).cast("int"))))
    return met.withColumn("text", F.when(F.col("_all").isNull(), F.col("text")).otherwise(cut)).select(*docs.columns)


def op4_information_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(common.table(spark, sf_dir, "documents"))
