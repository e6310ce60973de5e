"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import bpe, collocations, decontaminate, exact_dedup, gam, html_text, jaccard, line_dedup, quality_rules, secrets, sharding, spelling, warc
from tagloom.llm.common import held_out, table


VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the driver finds a vocabulary file of the installed package of public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(spark, docs, vocabulary_path(), decoded=True, digests=True).drop("text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = gam.score(docs, gam.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op9_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return placed.select(
        "doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"), keep="largest")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_secret_scan, op3_bpe_round_trip, op4_line_dedup, op5_warc_round_trip, op6_ngram_jaccard_join, op7_quality_classifier, op8_quality_rules, op9_histogram_shards, op10_html_text, op11_exact_dedup, op12_spelling_variants, op13_phrase_collocations)}
ORACLE_SQL: dict[str, str] = {
    "op5_warc_round_trip": """
        with p as (select page_id, coalesce(html, '') as h from pages),
        q as (select *, strlen(h) >= 100 and page_id <> min(page_id) over (partition by h) as again, min(page_id) over (partition by h) as first from p)
        select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then first end as refers_to
        from q
    """,
    "op11_exact_dedup": """
        with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
        select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
               doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
        from t
    """,
    "op13_phrase_collocations": r"""
        with piece as (
            select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p
            from documents
        ),
        words as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from piece where p <> ''),
        total as (select lang, sum(len(w))::bigint as n from words group by lang),
        gram as (
            select lang, g from (
                select lang, unnest(list_transform(range(1, len(w) - size + 2), lambda k: w[k:k + size - 1])) as g
                from words, (select unnest([1, 2, 3, 4]) as size) s
                where len(w) >= size
            )
        ),
        f as (select lang, g, count(*) as a from gram group by lang, g having count(*) >= 30),
        cover as (
            select lang, part, max(a) as most
            from (
                select lang, a, unnest(list_transform(range(1, len(g) - size + 2), lambda k: g[k:k + size - 1])) as part
                from f, (select unnest([2, 3]) as size) s where len(g) > size
            )
            group by lang, part
        ),
        left_over as (
            select f.lang, f.g, f.a
            from f left join cover c on c.lang = f.lang and c.part = f.g
            where len(f.g) > 1 and (c.most is null or 100 * c.most < 80 * f.a)
        ),
        cut as (select lang, g, a, unnest(range(1, len(g))) as k from left_over),
        scored as (
            select c.lang, c.g, c.a, c.k, x.a as l, y.a as r, (2000000::hugeint * c.a) // (x.a + y.a) as score
            from cut c
            join f x on x.lang = c.lang and x.g = c.g[1:c.k]
            join f y on y.lang = c.lang and y.g = c.g[c.k + 1:len(c.g)]
        ),
        lowest as (select * from scored qualify row_number() over (partition by lang, g order by score, k) = 1),
        ranked as (
            select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank,
                   array_to_string(g, ' ') as phrase, a, l, r, score::bigint as score
            from lowest
        )
        select lang, rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= 2000
    """,
}
