"""Decontamination, BPE, line dedup, WARC, the Jaccard join, sharding and the pipeline."""

import hashlib
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer
from pyspark.sql import functions as F

from tagloom.llm import bpe, components, decontaminate, fm_index, jaccard, line_dedup, sharding, warc
from tagloom.llm.common import table
from tagloom.llm.queries import vocabulary_path
from tests.llm import helpers
from tests.llm.helpers import docs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(4))
def test_fm_index(seed):
    r = np.random.default_rng(seed)
    s = r.integers(1, 2 + seed * 3, 400)
    s[::57] = 1
    index = fm_index.FmIndex(s)
    for width in (1, 2, 5):
        p = np.array([s[i : i + width] for i in r.integers(0, 400 - width, 20)] + [np.full(width, 99)])
        low, high = index.search(p)
        which, place = index.locate(low, high)
        for k in range(len(p)):
            want = [i for i in range(400 - width + 1) if (s[i : i + width] == p[k]).all()]
            assert sorted(place[which == k].tolist()) == want
    assert fm_index.FmIndex(np.array([], np.int64)).search(np.array([[1]]))[1].tolist() == [0]


def contaminated():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abAB") for _ in range(r.randrange(1, 3)))
    text = lambda n: " ".join(word() + r.choice(["", ",", ".", "\n"]) for _ in range(n))
    items = [(i, text(r.choice([3, 9, 12, 25]))) for i in range(12)] + [(90, "é1 2"), (91, None), (92, " .,"), (93, "é1 2"), (None, "only null id words here now")]
    rows = []
    for i in range(50):
        inner = r.choice(items[:12])[1] if i % 3 else ""
        rows.append((i, f"{text(30)} {inner.upper()} {text(20)}"))
    return rows + [(100, None), (101, ""), (102, "x É1, 2 é1 2"), (103, "z " * 5000 + "é1 2")], items


@pytest.mark.parametrize("block_bytes", [4_000_000, 150])
def test_decontamination(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    rows, items = contaminated()
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.find(docs(spark, rows), b).collect()}
    want = helpers.contamination(rows, items)
    assert len(got) == len(rows)
    for i, (n, hit, found) in want.items():
        assert (got[i].n_words, got[i].n_hit, got[i].items) == (n, len(hit), sorted(x for x in found if x is not None)), i
        assert {k for s in got[i].spans for k in range(s.start, s.end)} == hit
        text = dict(rows)[i]
        if hit:
            assert decontaminate.cut_text(text, [c.asDict() for c in got[i].cuts]) == helpers.cut(text, hit)
    clean = {r.doc_id: r.text for r in decontaminate.clean(docs(spark, rows), b).collect()}
    assert clean == {i: helpers.cut(t, want[i][1]) if want[i][1] else t for i, t in rows}


@pytest.mark.parametrize("block_bytes", [4_000_000, 150, 40])
def test_cleaning_does_not_depend_on_blocks(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    rows, items = contaminated()
    word = [f"w{i}" for i in range(60)]
    # items whose windows overlap or touch in a text, and one that stands there only after another is cut
    items += [(200 + k, " ".join(word[k : k + 12])) for k in range(0, 48, 6)] + [(300, "left1 left2 right1 right2"), (301, "mid1 mid2 mid3")]
    rows += [(200, "so " + ", ".join(word) + " on"), (201, "left1 left2 mid1 mid2 mid3 right1 right2"), (202, " ".join(word[3:40]))]
    want = helpers.contamination(rows, items)
    d = docs(spark, rows)
    got = decontaminate.clean(d, spark.createDataFrame(items, "item_id bigint, text string"))
    assert got.columns == d.columns
    assert {r.doc_id: r.text for r in got.collect()} == {i: helpers.cut(t, want[i][1]) if want[i][1] else t for i, t in rows}


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r.n_hit for r in decontaminate.find(docs(spark, [(1, "a b"), (None, None)]), none).collect()] == [0, 0]
    assert decontaminate.find(docs(spark, []), none).count() == 0


def strange_texts():
    r = random.Random(1)
    signs = "aabbcdeé'sTt 0129\n\t\r   \x1c\x85　  !!..,|日本語🙂́ñ"
    out = ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(600)] + ["".join(r.choice("etaoinshr") for _ in range(r.randrange(1, 60))) for _ in range(600)]
    return [*out, None, "", "a" * 3000, "a<|endoftext|>b<|endoftext|><|endoftext|> c", "<|endoftext|>", "abab" * 800, "I've don't 'S 'll", "=" * 999, " " * 300, "  x", "\n\n x ", "x" * 200_000, "été " * 20_000]


def test_bpe_equals_the_library(spark):
    lib = Tokenizer.from_file(vocabulary_path())
    texts = strange_texts() + [r.text for r in table(spark, SF, "documents").collect()]
    d = docs(spark, list(enumerate(texts))).withColumns({"ids": F.lit(1), "decoded": F.lit(2)})
    got = {r.doc_id: r for r in bpe.encode(spark, d, vocabulary_path(), decoded=True).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(got[i].ids) // 4}I", got[i].ids)) == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == lib.decode(ids, skip_special_tokens=False)
    assert {r.doc_id: r.decoded for r in bpe.decode(spark, spark.createDataFrame(list(got.values())).drop("decoded"), vocabulary_path()).collect()} == {i: r.decoded for i, r in got.items()}
    assert bpe.encode(spark, docs(spark, []), vocabulary_path(), digests=True).count() == 0


def test_bpe_paths_agree():
    b = bpe.Bpe(bpe.read_vocabulary(vocabulary_path()))
    r = random.Random(3)
    words = ["".join(r.choice("abthein g") for _ in range(r.randrange(1, 70))).encode() for _ in range(500)]
    assert b.merge_all(words) == [b.merge(w) for w in words]


def lined():
    r = random.Random(5)
    line = lambda: r.choice(["a", "b b", "", "  ", "long " * 51 + str(r.randrange(3)), f"x{r.randrange(4)}", "é"])
    return [(i, "\n".join(line() for _ in range(r.randrange(1, 9)))) for i in range(60)] + [(70, None), (71, ""), (72, "\n\n"), (73, "same\ntwo"), (74, "same\ntwo"), (75, "\n".join(str(k) for k in range(5000)))]


@pytest.mark.parametrize("long_line", [None, 50, 3])
def test_line_dedup(spark, long_line):
    rows = lined()
    d = docs(spark, rows).withColumn("n_removed", F.lit("old"))
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup(d, long_line=long_line).collect()}
    assert got == helpers.line_dedup(rows, long_line)
    assert line_dedup.dedup(docs(spark, [])).count() == 0
    twice = line_dedup.dedup(docs(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "a\nb\nc")])).collect()
    assert sorted((str(r.doc_id), r.text) for r in twice) == [("1", ""), ("1", ""), ("2", ""), ("None", "a\nb\nc")]


def test_line_dedup_columns_and_overlaps(spark):
    d = docs(spark, [(1, "a\na\na\na"), (2, "x\ny\nz"), (3, "q\nx\ny\nz\nr")]).withColumns({c: F.lit(7) for c in ("spans", "row", "pos")})
    got = line_dedup.dedup(d)
    assert got.columns == [*d.columns, "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r.n_removed, r.spans, r.row) for r in got.collect()} == {1: ("a", 3, 7, 7), 2: ("x\ny\nz", 0, 7, 7), 3: ("q\nr", 3, 7, 7)}


def test_line_dedup_of_two_line_passages(spark):
    passage = "\n".join(" ".join(f"{c}{k}" for k in range(26)) for c in "pq")  # 52 words
    short = "\n".join(" ".join(f"{c}{k}" for k in range(25)) for c in "rs")  # 50 words
    rows = [(i, f"top {i}\n{passage}\nmid {i}\n{short}\nend {i}") for i in range(3)] + [(3, passage), (4, f"{passage}\nlast")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup(docs(spark, rows), long_line=50).collect()}
    assert got == helpers.line_dedup(rows, 50)
    assert got == {0: (rows[0][1], 0)} | {i: (f"top {i}\nmid {i}\n{short}\nend {i}", 2) for i in (1, 2)} | {3: ("", 2), 4: ("last", 2)}


PAGE = "page_id bigint, url string, html string"


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc(spark, compression):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nX-Page-ID: 77\r\nContent-Length: {}\r\n\r\n"
    r = random.Random(7)
    pages = [(i, f"http://x/{i}", "é<p>" * r.randrange(60)) for i in range(80)]
    pages += [(100, "u", fake.format(3) + "abc\r\n\r\n" + "z" * 200), (101, "u", "q" * 120 + fake.format(10**6)), (102, None, None), (103, "a\r\nb", ""), (104, "v", "WARC/1.0\r\n" * 40), (105, "v", "\r\n\r\n"), (106, "w", "x" * 300_000), (107, "w", fake.format(10) + fake.format(0) * 5)]
    pages += [(200 + i, "copy", "c" * 150) for i in range(5)] + [(300 + i, "copy", "c" * 99) for i in range(3)]
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = {x.page_id: x for x in warc.round_trip(spark.createDataFrame(pages, PAGE), compression=compression).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    first = {}
    for i, _, h in sorted(pages, key=lambda p: p[0]):
        first.setdefault(h or "", i)
    assert len(got) == len(pages)
    for i, _, h in pages:
        raw = (h or "").encode()
        again = len(raw) >= 100 and first[h] != i
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None), i


def test_warc_repeated_and_null_ids(spark):
    copy = "c" * 120
    pages = [(5, "u", copy), (5, "u", copy), (5, "t", copy), (None, "a", copy), (7, "u", copy), (None, "n", "d" * 150), (None, "n", "d" * 150)]
    pages += [(1, "a\u2028X-Page-ID: 77\u0085b", "x"), (2, "v", "WARC/1.0\r\n" * 3000)]
    got = warc.round_trip(spark.createDataFrame(pages, PAGE)).collect()
    told = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got)
    assert told == Counter({(5, 120, "response", None): 1, (5, 120, "revisit", 5): 2, (None, 120, "revisit", 5): 1, (7, 120, "revisit", 5): 1, (None, 150, "response", None): 1, (None, 150, "revisit", None): 1, (1, 1, "response", None): 1, (2, 30_000, "response", None): 1})


def test_warc_record_ids_are_unique(spark, tmp_path):
    copy = "c" * 120
    pages = [(5, "u", copy), (5, "u", copy), (5, "u", "x"), (5, "u", "x"), (None, "u", copy), (None, None, copy), (5, None, "x"), (51, "", "x")]
    warc.write(spark.createDataFrame(pages, PAGE), f"{tmp_path}/w", "none")
    text = "".join(p.read_text() for p in (tmp_path / "w").glob("part-*"))
    assert len(set(re.findall("WARC-Record-ID: (.*)", text))) == len(pages)


def test_warc_edges(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], PAGE)).count() == 0
    head = "WARC/1.0\r\nWARC-Type: response\r\nX-Page-ID: {}\r\nContent-Length: {}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((head.format(1, 2) + "ab\r\n\r\n" + head.format(2, 50) + "cut").encode())
    (tmp_path / "b.warc").write_bytes(("junk" + head.format(3, 1) + "x\r\n\r\n").encode())
    assert [(r.page_id, r.payload_bytes) for r in warc.fields(warc.read(spark, str(tmp_path))).collect()] == [(1, 2)]


def similar(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    base, passage = [word() for _ in range(60)], [word() for _ in range(40)]
    rows = []
    for _ in range(420):  # one large group of near copies, few edits each
        w = list(base)
        for _ in range(r.randrange(3)):
            w[r.randrange(60)] = word()
        rows.append(" ".join(w))
    rows += [" ".join([word() for _ in range(r.randrange(3, 12))] + passage + [word() for _ in range(r.randrange(3, 12))]) for _ in range(60)]  # a passage that many share
    rows += [" ".join(word() for _ in range(r.randrange(1, 80))) for _ in range(60)]
    rows += [rows[k] for k in range(0, 540, 9)] + ["One Two", "one two", "one  two\n", "x y z", None, "", "  ", "q " * 30_000]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, seed):
    rows = similar(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, rows).repartition(5)).collect()}
    assert got == helpers.jaccard(rows)
    assert max(Counter(c for _, c in got.values()).values()) > 300


def test_jaccard_hot_shingles(spark):
    """Many near copies, long ones that only chains of links join, and a passage that many unlike texts share."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    texts = []
    for _ in range(90):
        t = list(base)
        for _ in range(rng.randrange(5)):
            t[rng.randrange(len(t))] = word()
        texts.append(t)
    texts += [passage + [word() for _ in range(rng.randrange(1, 30))] for _ in range(80)]
    texts += [base[k : k + 70] for k in range(0, 50, 3)] + [base[:k] for k in range(60, 120, 4)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, rows).repartition(3)).collect()}
    assert got == helpers.jaccard(rows)


def test_jaccard_run_in_parts(spark):
    """A run too long for one part: the few entries of its last part are passed on like the others."""
    n = 210_005
    entries = spark.range(n).select(F.lit(7).cast("long").alias("k"), F.lit(0).cast("long").alias("h"), F.col("id").alias("cid"), F.lit(9).alias("n"), F.lit(0).alias("pos"), F.lit(0).alias("cold"))
    got = jaccard.product(entries)
    assert got.where("h is null").count() == 0 and got.where("h = 7").select("a").distinct().count() == n


def test_bitmaps_never_differ_in_more_bits_than_sets_do_in_members():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64))
        b = np.union1d(a[rng.random(len(a)) < 0.8], rng.integers(0, 2**63, rng.integers(0, 300)).astype(np.uint64))
        differ = len(np.setxor1d(a, b))
        assert jaccard.differing_bits(jaccard.parity_bits(a), jaccard.parity_bits(b)) <= differ
        words = zip(jaccard.parity_words(a), jaccard.parity_words(b), strict=True)
        assert sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in words) <= differ


def test_jaccard_cases(spark):
    assert jaccard.join(docs(spark, [])).count() == 0
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.join(docs(spark, [(None, "a b"), (2, "a b"), (2, "c"), (1, "A b"), (3, None)])).collect())
    assert got == [("1", 1, "1"), ("2", 1, "1"), ("2", 1, "2"), ("3", 0, "3"), ("None", 1, "None")]


def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(200, 260)] + [(r.randrange(300, 360), r.randrange(300, 360)) for _ in range(40)]
    got = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {k: root(k) for k in parent}


@pytest.mark.parametrize("hot", [0, 300])
def test_shards(spark, hot):
    r = random.Random(9)
    rows = [(i, "x" * r.randrange(300)) for i in range(900)] + [(1000 + i, "same text " * 12) for i in range(hot)] + [(None, None), (5, "x"), (5, "x"), (7, "")]
    got = sharding.shard(docs(spark, rows).withColumn("slot", F.lit("old")), 16).collect()
    assert len(got) == len(rows)
    load, shards = Counter(), {}
    for x in got:
        assert x.size == len((x.text or "").encode()) + 1
        load[x.shard] += x.size
        shards.setdefault(x.shard, []).append(x.slot)
    assert set(load) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    mean = sum(load.values()) / 16
    assert max(abs(v - mean) for v in load.values()) <= 0.001 * mean + 2 * 301
    if hot:
        assert len({x.shard for x in got if x.text == "same text " * 12}) <= 6  # the group lies together, over neighbouring shards


def test_shards_of_little(spark):
    assert sharding.shard(docs(spark, []), 16).count() == 0
    assert [(x.slot) for x in sharding.shard(docs(spark, [(1, "a")]), 16).collect()] == [0]


def test_sharding_is_native(spark):
    assert "Python" not in sharding.shard(docs(spark, [(1, "a"), (2, "b")]), 4)._jdf.queryExecution().executedPlan().toString()


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline
    from tagloom.llm import quality_rules

    model = quality_rules.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    kept = []
    for i, t in rows:
        n, _, _, _, repeats = quality_rules.text_counts(t.encode())
        if n >= 50 and 100 * repeats <= 50 * n and quality_rules.content_words(t.encode(), model) >= 0.5 * n:
            kept.append((i, t))
    lined = helpers.line_dedup(kept)
    kept = [(i, t) for i, (t, gone) in sorted(lined.items()) if not gone or t.encode().split()]
    heads = helpers.jaccard(kept)
    kept = [(i, t) for i, t in kept if heads[i][1] == i]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    found = helpers.contamination(kept, items)
    want = {i: helpers.cut(t, found[i][1]) if found[i][1] else t for i, t in kept}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.text for r in got} == {i: t for i, t in want.items() if t.encode().split()}
    assert all(r.round_trip and r.n_chars == len(r.text) for r in got)
    lib = Tokenizer.from_file(vocabulary_path())
    assert all(list(struct.unpack(f"<{r.n_tokens}I", r.ids)) == lib.encode(r.text, add_special_tokens=False).ids for r in got)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null and empty values in every column, repeated rows, clashing columns; then tables without rows."""
    import corpus_pipeline

    r = random.Random(11)
    word = lambda: "".join(r.choice("aeioustrnlm") for _ in range(r.randrange(2, 9)))
    line = lambda: " ".join(word() for _ in range(14)).capitalize() + "."
    good, other, third = ("\n".join(line() for _ in range(9)) for _ in range(3))
    rows = [(1, good, None, None, None), (1, good, "en", "s", 5), (2, other, "en", "s", 5), (None, third, None, "", -1), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, " \n\t", "en", "s", 3), (6, "short", None, None, None)]
    d = spark.createDataFrame(rows, helpers.DOC).withColumns({c: F.lit("old") for c in ("row", "spans", "ids", "n_tokens", "size", "cid")})
    none = spark.createDataFrame([], helpers.DOC)
    labels, items = spark.createDataFrame([(1, None, 0), (None, 1, None), (2, 1, 1), (2, 0, 1)], "doc_id bigint, quality int, toxic int"), spark.createDataFrame([(None, good[:90]), (1, None), (2, "")], "item_id bigint, text string")
    for name, (docs_, labels_, items_) in {"odd": (d, labels, items), "none": (none, labels.limit(0), items.limit(0)), "no_labels": (d, labels.limit(0), items.limit(0))}.items():
        for table_name, df in (("documents", docs_), ("labels", labels_), ("benchmark", items_)):
            df.coalesce(1).write.parquet(f"{tmp_path}/{name}/{table_name}.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in got} <= {1, 2, None} and all(r.round_trip and r.text.strip() and r.n_chars == len(r.text) for r in got)
        assert (name == "none") == (not got)


def test_pipeline_deletes_its_stages(spark):
    import corpus_pipeline
    from tagloom.llm.common import _left, clear

    clear(spark)
    out = corpus_pipeline.run(spark, SF)
    assert sum("/stage-" in p for p in _left[spark.sparkContext.applicationId]) == 1 and out.count() > 0
