"""Exact dedup, spelling variants and collocations, against plain Python over whole texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from tagloom.llm import collocations, exact_dedup, spelling
from tagloom.llm.common import table
from tagloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.helpers import docs, lower_ascii

SF = "/root/testdata/sf0.001"


# exact dedup


def exact_groups(rows):
    """{doc_id: (keep_id, size, sha)} of rows with distinct ids."""
    own = defaultdict(list)
    for i, t in rows:
        own[lower_ascii(t)].append(i)
    return {i: (max(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in own.items() for i in ids}


def copies():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abÉé Z\n") for _ in range(r.randrange(4)))
    rows = [word() for _ in range(400)] + ["hot text É"] * 250 + ["HOT text É"] * 50 + [None, "", "x" * 300_000, "X" * 300_000, "İ", "i̇", "ÀB", "àb"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("parts", [1, 7, 90])
@pytest.mark.parametrize("rounds", [1, 5])
def test_exact_groups(spark, monkeypatch, parts, rounds):
    monkeypatch.setattr(exact_dedup, "ROUNDS", rounds)
    rows = copies()
    d = docs(spark, rows).repartition(parts).withColumns({c: F.lit(1) for c in ("row", "run", "sha", "n", "best", "kept")})
    got = exact_dedup.groups(d).collect()
    want = exact_groups(rows)
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == want
    assert len(got) == len(rows) and all(r.kept == (r.keep_id == r.doc_id) for r in got)


def test_exact_dedup_keeps_rows(spark):
    rows = copies()
    for keep, of in (("largest", max), ("smallest", min)):
        own = defaultdict(list)
        for i, t in rows:
            own[lower_ascii(t)].append(i)
        d = docs(spark, rows).repartition(6).withColumn("row", F.col("doc_id") * 2)
        got = exact_dedup.dedup(d, keep)
        assert got.columns == d.columns
        assert {(r.doc_id, r.text, r.row) for r in got.collect()} == {(of(ids), dict(rows)[of(ids)], 2 * of(ids)) for ids in own.values()}
    with pytest.raises(ValueError, match="keep"):
        exact_dedup.groups(docs(spark, []), "first")


def test_exact_cases(spark):
    assert exact_dedup.groups(docs(spark, [])).count() == 0 and exact_dedup.dedup(docs(spark, [])).count() == 0
    got = exact_dedup.groups(docs(spark, [(None, "A"), (3, "a"), (3, "a"), (None, "b"), (None, "B"), (7, None), (7, "")])).collect()
    told = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got)
    assert told == Counter({(None, 3, 3, False): 1, (3, 3, 3, True): 1, (3, 3, 3, False): 1, (None, None, 2, True): 1, (None, None, 2, False): 1, (7, 7, 2, True): 1, (7, 7, 2, False): 1})
    small = exact_dedup.groups(docs(spark, [(None, "A"), (3, "a"), (4, "a")]), "smallest").collect()
    assert {(r.doc_id, r.kept, r.keep_id) for r in small} == {(None, False, 3), (3, True, 3), (4, False, 3)}


def test_exact_dedup_is_native(spark, monkeypatch):
    plans = []
    real = exact_dedup.materialize
    monkeypatch.setattr(exact_dedup, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    exact_dedup.dedup(docs(spark, [(1, "a"), (2, "b")]))
    assert len(plans) >= 4 and not any(re.search("Python|Arrow|Pandas", p) for p in plans)


# spelling


def vocabulary(rows, least_length=6, least=5, drop=199):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower_ascii(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % drop == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least_length and k >= least}


def are_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spellings(rows, **args):
    """{word: (form, root, n, n_near, form_n)}, by all pairs."""
    n = vocabulary(rows, **args)
    beside = {w: [v for v in n if are_near(w, v)] for w in n}
    form = {}
    for w, own in beside.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(beside[w]), n.get(form[w]))
    return out


def misspelt(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abÀé") for _ in range(r.randrange(5, 10))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "×÷ÿéàa", "ababababab"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(60):
            w = base[min(r.randrange(44), r.randrange(44), r.randrange(44))]
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abé") + w[k:], w[:k] + r.choice("abé") + w[k + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", ", ", "1", "Ā"]).join(words)))
    return rows + [(None, "ababab abababa " * 9), (7, None), (8, ""), (9, ("long" * 3000 + " ") * 6 + ("long" * 2999 + "lon ") * 30), (9, "x�😀abcdef " * 7)]


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_variants(spark, seed, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 50 * seed)
    monkeypatch.setattr(spelling, "WORD_SLICE", 400)
    rows = misspelt(seed)
    d = docs(spark, rows).repartition(4).withColumns({c: F.lit(1) for c in ("word", "n", "id")})
    got = spelling.variants(d, drop_every=7).collect()
    want = spellings(rows, drop=7)
    assert len(got) == len(want) and {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert any(w[0] and w[1] != w[0] for w in want.values()) and any(w[3] > 20 for w in want.values())


def test_spelling_cases(spark):
    assert spelling.variants(docs(spark, [])).count() == 0
    assert spelling.variants(docs(spark, [(1, None), (2, ""), (3, "few words here")])).count() == 0
    got = spelling.variants(docs(spark, [(1, "letters " * 5), (2, "letterz " * 25), (1, "lettersy " * 125)]), drop_every=10**9).collect()
    assert {tuple(r) for r in got} == {("letters", "lettersy", "lettersy", 5, 2, 125), ("letterz", None, "letterz", 25, 1, None), ("lettersy", None, "lettersy", 125, 1, None)}


def test_spelling_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    n = vocabulary(rows)
    got = {r.word: r for r in QUERIES["op12_spelling_variants"](spark, SF).collect()}
    assert {w: r.n for w, r in got.items()} == n
    picked = sorted(n)[:: max(1, len(n) // 150)]
    for w in picked:
        own = [v for v in n if abs(len(v) - len(w)) <= 1 and are_near(w, v)]
        best = min(own, key=lambda v: (-n[v], v), default=None)
        best = best if best and n[best] >= 5 * n[w] else None
        assert (got[w].n_near, got[w].form, got[w].form_n) == (len(own), best, n.get(best))
        assert got[w].root == (got[best].root if best else w)


# collocations


def collocations_of(rows, least=30, longest=4, top=2000):
    """rows: (lang, text). Set of (lang, rank, phrase, a, l, r, n, score)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower_ascii(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[k : k + size])) for size in range(1, longest + 1) for k in range(len(w) - size + 1))
    often = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    gone = set()
    for (lang, p), a in often.items():
        for size in range(2, len(p)):
            gone |= {(lang, p[k : k + size]) for k in range(len(p) - size + 1) if 100 * a >= 80 * f[lang, p[k : k + size]]}
    told = defaultdict(list)
    for (lang, p), a in often.items():
        if (lang, p) not in gone:
            score, k = min((int(Fraction(2000000 * a, f[lang, p[:k]] + f[lang, p[k:]])), k) for k in range(1, len(p)))
            told[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, own in told.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)}


def spoken(seed):
    r = random.Random(seed)
    words = [*"abcdefgh", "É", "é", "\xa0x", "\x1cy", "Long", "a"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b"]) for _ in range(n))
    rows = [(r.choice(["en", "fr", None]), text(r.randrange(120))) for _ in range(80)]
    return rows + [("en", "new york city hall " * 40), ("en", "of the " * 90), ("de", "a a a a a a " * 20), ("fr", None), (None, ""), ("", "b b " * 40), ("xx", "zz " * 60_000 + "b c " * 29 + ".b c")]


@pytest.mark.parametrize(("block", "buckets"), [(8_000_000, 50_000), (150, 5)])
def test_collocations(spark, monkeypatch, block, buckets):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    monkeypatch.setattr(collocations, "CANDIDATES_PER_BUCKET", buckets)
    monkeypatch.setattr(collocations, "BUCKETS_MERGED", 2)
    rows = spoken(block)
    d = spark.createDataFrame(rows, "lang string, text string").repartition(3).withColumns({c: F.lit(1) for c in ("block", "word", "n", "pos", "id")})
    for top in (2000, 12):
        assert {tuple(r) for r in collocations.mine(d, top=top).collect()} == collocations_of(rows, top=top)


def test_numbers_take_more_bits_until_they_are_unique(spark, monkeypatch):
    """Numbers whose low bits are all alike: frequent words must not share one with any other word."""
    real = collocations.number_of
    monkeypatch.setattr(collocations, "number_of", lambda lang, word, seed: real(lang, word, seed) << 24 & (1 << 64) - 1)
    rows = spoken(1)
    d = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    words, _, _, bits = collocations.frequent_words(d, 30)
    assert bits > 24 and words.select("id").distinct().count() == words.count()
    assert {tuple(r) for r in collocations.mine(d).collect()} == collocations_of(rows)


def test_a_bitmap_that_lets_all_through_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    rows = spoken(2)
    d = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert {tuple(r) for r in collocations.mine(d).collect()} == collocations_of(rows)


def test_collocations_of_little(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.mine(spark.createDataFrame([("en", "a b"), (None, None)], "lang string, text string")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    out = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(str(x) for x in r) for r in df.select(*names).collect()) == Counter(tuple(str(x) for x in r) for r in out.fetchall())
