import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from entitystore.llm import common, cotraining, decontamination, line_dedup, sanitisation, simhash, suffix_dedup
from tests.conftest import DATA
from tests.llm.cases import docs, nothing, texts


def once(rows):
    return list(dict.fromkeys(rows))


def order(row):
    return (common.NULL_ID if row[0] is None else row[0],)


# -- SimHash ------------------------------------------------------------------------------------


def fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), t.encode()))
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps):
    """Least id reachable, by comparing all pairs."""
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(fps):
        for j, y in fps[a + 1 :]:
            if (x ^ y).bit_count() <= 3 and find(i) != find(j):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in fps}


@pytest.mark.parametrize("cell", [simhash.CELL, 2])
def test_simhash(spark, cell):
    rows = texts()
    got = simhash.simhash_groups(docs(spark, rows), cell).collect()
    fps = [(order(r)[0], fingerprint(r[1] or "")) for r in rows]
    comp = linked(fps)
    want = Counter((i, f"{fingerprint(t or ''):016x}", None if comp[order((i,))[0]] == common.NULL_ID else comp[order((i,))[0]]) for i, t in rows)
    assert Counter(map(tuple, got)) == want
    assert simhash.simhash_groups(nothing(spark)).count() == 0


def test_links_of_chains_and_clusters(spark):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 40, dtype=np.int64).astype(np.uint64)
    fps = set()
    for s in seeds.tolist():
        x = s
        for _ in range(25):
            fps.add(x)
            for b in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                x ^= 1 << b
            if rng.random() < 0.5:
                x = s ^ (1 << int(rng.integers(0, 64)))
    fps = sorted(fps)
    want = linked(list(enumerate(fps)))
    for cell in (simhash.CELL, 40, 4):
        classes = spark.createDataFrame([(x - 2**64 if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, id long")
        scratch = common.Scratch(spark)
        roots = {r.u: r.root for r in simhash.components(simhash.links(classes, scratch, cell), scratch).collect()}
        assert {i: roots.get(i, i) for i in range(len(fps))} == want


def test_links_of_a_cell_read_in_pieces(spark):
    """Pairs that meet in one cell only, which is large and comes in batches far smaller than it."""
    rng = np.random.default_rng(6)
    fps = set()
    for _ in range(60):
        x = sum(int(rng.integers(0, 2)) << b for b in range(32, 64))
        fps |= {x, x ^ (1 << 33) ^ (1 << 47) ^ (1 << 60)}
    fps = sorted(fps)
    rng.shuffle(fps)
    want = linked(list(enumerate(fps)))
    name, cell = "spark.sql.execution.arrow.maxRecordsPerBatch", 16
    old = spark.conf.get(name)
    try:
        for batch in (5, 17, 50):
            spark.conf.set(name, batch)
            classes = spark.createDataFrame([(x - 2**64 if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, id long")
            scratch = common.Scratch(spark)
            roots = {r.u: r.root for r in simhash.components(simhash.links(classes, scratch, cell), scratch).collect()}
            assert {i: roots.get(i, i) for i in range(len(fps))} == want, batch
    finally:
        spark.conf.set(name, old)


# -- suffixes -----------------------------------------------------------------------------------


def covered(rows, n):
    """Bytes covered by strings of n bytes that also start earlier, from a set of all strings."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=order):
        b = (t or "").encode()
        mark = np.zeros(len(b) + 1, int)
        for k in range(len(b) - n + 1):
            s = b[k : k + n]
            if s in seen:
                mark[k] += 1
                mark[k + n] -= 1
            seen.add(s)
        gone = np.cumsum(mark[:-1]) > 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.mark.parametrize("hot, slab, named", [(suffix_dedup.HOT, 1 << 13, 1), (3, 8, 1000), (3, 8, 0), (3, 8, 1)])
@pytest.mark.parametrize("length, gram", [(100, 24), (20, 5)])
def test_suffix_dedup(spark, hot, slab, named, length, gram):
    rows = texts()
    want = covered(once(rows), length)
    got = suffix_dedup.suffix_dedup(docs(spark, rows), length, gram, hot, slab, named=named).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == want[r.doc_id], r.doc_id
    assert suffix_dedup.suffix_dedup(nothing(spark)).count() == 0


def test_suffix_dedup_with_one_key_for_half_of_the_rows(spark):
    rng = np.random.default_rng(11)
    shared = "".join(rng.choice(list("abcdefgh "), 150))
    rows = [(i, "".join(rng.choice(list("abcdefgh "), 60)) + (shared if i % 2 else "") + "".join(rng.choice(list("xyz "), 40))) for i in range(120)]
    want = covered(rows, 100)
    got = suffix_dedup.suffix_dedup(docs(spark, rows), hot=8, slab=8, named=1).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got} == want


def test_suffixes_of_a_bucket_are_sorted():
    import pyarrow as pa

    text = [b"abcdefgh\0", b"bcdefgh\0\0", b"ABCDEFGHI", b"abcdefgh\0", b"ABCDEFGHX"]
    t = pa.table({"rank": [1] * 5, "k": range(5), "h": range(5), "far": pa.array([0] * 5, pa.int32()), "p": pa.array([0] * 5, pa.int32()), "n": pa.array([2] * 5, pa.int32()), "c": text})
    x = suffix_dedup.Bucket(t, 8)
    by, lead = x.sort()
    strings = [x.strings[i].tobytes() for i in by]
    assert strings == sorted(text[d][s : s + 8] for d in range(5) for s in range(2))
    assert all(strings[n] == x.strings[j].tobytes() and j == min(i for i in range(10) if x.strings[i].tobytes() == strings[n]) for n, j in enumerate(lead))
    a, b = x.hashes(np.arange(10))
    assert len(set(a.tolist())) == len(set(b.tolist())) == len(set(strings)) == 6


# -- SQL ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("query, sql", [(decontamination.op8_benchmark_decontamination, decontamination.SQL), (line_dedup.op10_line_dedup, line_dedup.SQL)])
def test_equals_sql(spark, duck, query, sql):
    got = query(spark, DATA)
    names = sorted(got.columns)
    want = duck.sql(sql).project(", ".join(names)).fetchall()
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want)


# -- decontamination ----------------------------------------------------------------------------


def told(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) if w]


def test_decontamination(spark):
    rows = texts()
    items = [(1, " ".join(told(rows[6][1])[2:20])), (2, " ".join(told(rows[6][1])[30:41]).upper()), (3, "x"), (4, ""), (5, None), (None, "null id"), (6, "null id"), (7, "aaaa aaaa aaaa"), (8, rows[7][1]), (8, rows[8][1])]
    got = decontamination.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block=3).collect()
    wins = {}
    for i, t in items:
        w = told(t)
        if i is not None:
            for s in range(max(1, len(w) - 7) if w else 0):
                wins.setdefault(tuple(w[s : s + 8]), set()).add(str(i))
    want = Counter()
    for i, t in rows:
        w, hit, found = told(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[tuple(w[s : s + n])]
        want[(i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)] += 1
    assert Counter(map(tuple, got)) == want
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(nothing(spark), none).count() == 0
    assert decontamination.decontaminate(docs(spark, rows), none).where("n_items > 0").count() == 0


def test_excise_and_proximity(spark):
    leak = "one two three four five six seven eight nine"
    rows = spark.createDataFrame([(1, f"Start, {leak.title()}; end.", "a"), (2, "clean text", "b"), (3, f"{leak} ten and A b c d e f g h", "c"), (4, None, "d")], "doc_id long, text string, lang string")
    items = spark.createDataFrame([(1, leak), (2, "a b c d e f g h")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontamination.excise(rows, items).collect()}
    assert got == {1: "Start, end.", 2: "clean text", 4: None}
    sets = spark.createDataFrame([("p", ["two", "five"]), ("q", ["two", "ten"]), ("r", ["two", "absent"])], "id string, w array<string>")
    near = {(r.doc_id, r.id) for r in decontamination.proximity_matches(rows, sets, 3).collect()}
    assert near == {(1, "p"), (3, "p")}


def test_proximity_of_odd_rows(spark):
    sets = spark.createDataFrame([("p", ["b", "a", "a"]), ("q", ["a"]), ("e", []), (None, ["a"]), ("n", ["a", "absent"])], "id string, w array<string>")
    rows = [(1, "a x b"), (1, "a x b"), (1, "b a"), (None, "A, x x b"), (2, None), (3, ""), (4, "b x x x x a")]
    got = Counter((r.doc_id, r.id, r.pos) for r in decontamination.proximity_matches(docs(spark, rows), sets, 2, block=2).collect())
    # Lists of a and b are equally long, so ties go to the first word of the set.
    assert got == Counter([(1, "p", 0), (1, "p", 1), (1, "q", 0), (1, "q", 1), (None, "q", 0), (4, "q", 5)])
    assert decontamination.proximity_matches(nothing(spark), sets, 2).count() == 0 and decontamination.proximity_matches(docs(spark, rows), sets.limit(0), 2).count() == 0


# -- lines --------------------------------------------------------------------------------------


def lines_left(rows, least):
    """Maximal runs from all pairs of equal lines."""
    seq = []
    for i, t in sorted(rows, key=order):
        x = (t or "").split("\n")
        seq.append((i, x, [(p, s, len(re.findall(r"[^\x20\x09-\x0D]+", s))) for p, s in enumerate(x) if re.search(r"[^\x20\x09-\x0D]", s)]))
    out = {}
    for b, (i, x, mine) in enumerate(seq):
        gone = set()
        for a in range(b + 1):
            other = seq[a][2]
            for q in range(len(mine)):
                for p in range(len(other)):
                    if (a == b and p >= q) or (p and q and other[p - 1][1] == mine[q - 1][1]):
                        continue
                    n = 0
                    while p + n < len(other) and q + n < len(mine) and other[p + n][1] == mine[q + n][1]:
                        n += 1
                    if n and sum(m[2] for m in mine[q : q + n]) >= least:
                        gone |= {m[0] for m in mine[q : q + n]}
        out[i] = (len(x), len(gone), "\n".join(s for p, s in enumerate(x) if p not in gone))
    return out


@pytest.mark.parametrize("least", [1, 7, 50])
def test_line_dedup(spark, least):
    rows = [*texts(), (900, "a b\nc d\n\ne f\na b\nc d\n\ne f"), (901, "zz\ne f\na b\nc d"), (902, "q\n" * 30)]
    want = lines_left(once(rows), least)
    got = line_dedup.line_dedup(docs(spark, rows), least).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_lines, r.n_removed, r.text) == want[r.doc_id], r.doc_id
    assert line_dedup.line_dedup(nothing(spark)).count() == 0


# -- personal data ------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    g = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(g))]
        return 14 <= len(g) <= 19 and sum(v - 9 * (v > 9) for v in twice) % 10 == 0
    return kind != "phone" or 10 <= len(g) <= 15


def test_sanitisation(spark):
    odd = [
        "🙂 a@b.c_x@d.e.f, a.b+c@x-y.co.uk. @b.c a@b", "1.2.3.4.5.6.7.8 999.1.1.1 0255.001.2.3 1..2.3.4", "card 4111 1111 1111 1111, 4111-1111-1111-1112 12345678901234567890123",
        "+1 (743) 555-3824) +49.30.123 +12345678901234567 +1+1 202 555 0199", "a" * 20000, "1" * 20000, "1." * 4000, "a.b@" * 500,
    ]
    rows = [*texts(), *((500 + i, t) for i, t in enumerate(odd)), (500, odd[0])]
    want = Counter()
    for i, t in rows:
        s = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, t or "") if passes(kind, m[0]))
        line = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in s)
        want[(i, *(sum(x[3] == kind for x in s) for kind in BASE), hashlib.sha256(line.encode()).hexdigest(), line, 0, len(s))] += 1
    assert Counter(map(tuple, sanitisation.personal_data(docs(spark, rows)).collect())) == want
    assert sanitisation.personal_data(nothing(spark)).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"plain p{i} and q{i} here r{i} there") for i in range(90)]
    rows += [(100 + i, f"n{i} Zorbulon, m{i} and {'here there'.split()[i % 2]} x{i} bob@corp.example.com y{i}") for i in range(5)]
    rows += [(200, "nobody but zorbulon: is here"), (201, rows[-1][1])]
    got = {r.doc_id: r.spans for r in sanitisation.personal_data(docs(spark, rows)).collect()}
    assert all("term:3:11" in got[100 + i] and got[100 + i].count("term") == 1 for i in range(5))
    assert got[200] == "term:11:19" and all(got[i] == "" for i in range(90))
    clean = {r.doc_id: r.text for r in sanitisation.sanitise(docs(spark, rows)).collect()}
    assert clean[200] == "nobody but : is here" and clean[100] == "n0 , m0 and here x0 <email> y0" and clean[0] == rows[0][1]


def test_disclosing_classes(spark):
    """Keys that differ in every text are found by what kind of term follows a credential's name; like terms that stand elsewhere are not."""
    rng = np.random.default_rng(9)
    key = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(12)]
    rows = [(i, f"plain p{i} and q{i} here token of words there {10**12 + i}") for i in range(90)]
    rows += [(100 + i, f'n{i} token = "{key[i]}"! and') for i in range(6)] + [(110, f"password:{key[6]}"), (111, f"no name {key[7]}"), (112, None), (113, ""), (113, ""), (None, f"x {key[8]}")]
    got = {r.doc_id: (r.spans, r.n_term, r.n_spans) for r in sanitisation.personal_data(docs(spark, rows)).collect()}
    assert all(got[100 + i] == ("term:12:52", 1, 1) for i in range(6)) and got[110][0] == "term:9:49" and got[111][0] == "term:8:48" and got[None][0] == "term:2:42"
    assert all(got[i] == ("", 0, 0) for i in (*range(90), 112, 113))
    clean = {r.doc_id: r.text for r in sanitisation.sanitise(docs(spark, rows)).collect()}
    assert clean[100] == 'n0 token = ""! and' and clean[112] is None and len(clean) == len({i for i, _ in rows})
    usual = [(i, f"word {key[i]} is") for i in range(12)] + [(20 + i, f"token {key[i][::-1]}") for i in range(5)]
    assert all(r.n_spans == 0 for r in sanitisation.personal_data(docs(spark, usual)).collect())
    assert sanitisation.sanitise(nothing(spark)).count() == 0


def test_disclosing_terms_that_form_an_address(spark):
    odd = ["🙂 a@b.c_x@d.e.f é +1 (743) 555-38244 x 4111 1111 1111 1111, 1.2.3.4", "+49 4111 1111 1111 1111 1", "1 22 333", "", "a.b@" * 500, "+1 202 555 0199 a@b.cc"]
    for r in spark.createDataFrame([(t,) for t in odd], "text string").withColumn("b", sanitisation._blanked("text")).collect():
        want = list(r.text)
        for kind, p in BASE.items():
            for m in re.finditer(p, r.text):
                if passes(kind, m[0]):
                    want[m.start() : m.end()] = " " * len(m[0])
        assert r.b == "".join(want)
    rows = [(i, f"plain p{i} and q{i} here r{i} there") for i in range(90)]
    rows += [(100 + i, f"n{i} Jane m{i} or k{i} Quux l{i} writes x{i} jane.doe@quux.example.org y{i}") for i in range(5)]
    got = {r.doc_id: (r.text, r.spans) for r in docs(spark, rows).select("doc_id", "text").join(sanitisation.personal_data(docs(spark, rows)).select("doc_id", "spans"), "doc_id").collect()}
    for i in range(5):
        text, spans = got[100 + i]
        found = {text[int(a) : int(b)] for kind, a, b in (s.split(":") for s in spans.split(",")) if kind == "term"}
        assert {"Jane", "Quux"} <= found and "jane.doe@quux.example.org" not in found
    assert all(got[i][1] == "" for i in range(90))


# -- classifier and pipeline --------------------------------------------------------------------


def test_classifier(spark):
    d = DATA.replace("sf0.001", "sf0.01")
    table, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    fit, held = labels.where("doc_id % 2 = 0"), {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.where("doc_id % 2 = 1").collect()}
    kept = {r.doc_id: r.kept for r in cotraining.classify(table, fit).collect()}
    good, bad = [kept[i] for i, g in held.items() if g], [kept[i] for i, g in held.items() if not g]
    assert np.mean(good) >= 0.95 and np.mean(bad) <= 0.45
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = cotraining.classify(docs(spark), none).collect()
    assert len(odd) == len(texts()) and all(r.kept for r in odd)
    assert cotraining.classify(nothing(spark), labels).count() == 0


def test_pipeline(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, _ = common.Scratch(spark).save(stage(spark, table, DATA))
        before, after = {r.doc_id: r for r in table.collect()}, {r.doc_id: r for r in out.collect()}
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(after) <= set(before), name
        if name == "quality_classifier":
            kept = {r.doc_id for r in cotraining.classify(table, spark.read.parquet(f"{DATA}/labels.parquet")).where("kept").collect()}
            assert set(after) == kept and all(before[i] == r for i, r in after.items())
        if name == "line_dedup":
            want = lines_left([(i, r.text) for i, r in before.items()], 50)
            assert {i: r.text for i, r in after.items()} == {i: t for i, (_, n, t) in want.items() if not n or t.split()}
        if name == "simhash_near_dedup":
            comp = linked([(i, fingerprint(r.text)) for i, r in sorted(before.items())])
            assert set(after) == set(comp.values()) and all(before[i] == r for i, r in after.items())
        table = out
    assert corpus_pipeline.run(spark, DATA).select("doc_id").distinct().count() == table.count()


def test_simhash_stage_with_repeated_ids(spark):
    """A document of each group stays, whatever ids repeat or are null."""
    rng = np.random.default_rng(8)
    prose = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(9)]
    near = prose[0] + " "
    rows = [(None, prose[0]), (None, prose[1]), (None, prose[2]), (None, prose[2]), (4, prose[3]), (4, prose[4]), (5, near), (6, prose[4]), (7, prose[5]), (4, prose[6]), (8, None), (None, "")]
    groups = {}
    for i, t in rows:
        groups.setdefault(fingerprint(t or ""), set()).add((order((i,))[0], i, t))
    assert len(linked([(n, x) for n, x in enumerate(groups)])) == len({*linked([(n, x) for n, x in enumerate(groups)]).values()}) == 8
    got = [(r.doc_id, r.text) for r in corpus_pipeline.simhash_near_dedup(spark, docs(spark, rows), DATA).collect()]
    want = [min(g, key=lambda x: (x[0], x[2] or ""))[1:] for g in groups.values()]
    assert Counter(got) == Counter(want)
    comp = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_groups(docs(spark, rows)).collect()}
    assert comp[4, f"{fingerprint(prose[3]):016x}"] == 4 == comp[6, f"{fingerprint(prose[4]):016x}"] and comp[7, f"{fingerprint(prose[5]):016x}"] == 7
    assert comp[5, f"{fingerprint(near):016x}"] is None


# -- hot keys -----------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [0, 1000])
def test_having(spark, block):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i % 5 * (i > 30)) for i in range(60)], "k long, h long")
    keys = spark.createDataFrame([(0,), (3,), (9,)], "h long")
    got = common.having(rows, keys, "h", "k", block)
    assert got.columns == ["h", "k"] or got.columns == ["k", "h"]
    assert sorted(r.k for r in got.collect()) == [i for i in range(60) if i % 7 and i % 5 * (i > 30) in (0, 3)]


def test_join_keyed(spark):
    rows = spark.createDataFrame([(i, 0 if i % 3 == 0 else i) for i in range(60)] + [(60, None)], "k long, h long")
    keyed = rows.groupBy("h").count().withColumnRenamed("count", "times").where("h is null or h <> 4")
    assert [r.h for r in common.frequent(keyed, 61).collect()] == [0]
    got = common.join_keyed(rows, keyed, "h", 61)
    want = [(i, 0 if i % 3 == 0 else i, 20 if i % 3 == 0 else 1) for i in range(60) if i != 4]
    assert sorted((r.k, r.h, r.times) for r in got.collect()) == want
