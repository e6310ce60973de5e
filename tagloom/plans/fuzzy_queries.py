"""Tags matched to the catalog by likeness: the tags whose id 20 divides, against all rows.

The twins score all pairs, by the definitions: the longest common subsequence by bit sets in lists of numbers.
"""

from __future__ import annotations

from tagloom.functions.text import STOP_WORDS
from tagloom.operators import fuzzy
from tagloom.plans.registry import query
from tagloom.plans.text_queries import ean_sql
from tagloom.sources.adapters import view


def _lcs(a: str, b: str) -> str:
    full = f"((1::hugeint << length({a})) - 1)"
    places = f"list_transform(range(1, length({b}) + 1), lambda j: coalesce(list_sum(list_transform(range(1, length({a}) + 1), lambda i: case when substr({a}, i, 1) = substr({b}, j, 1) then 1::hugeint << (i - 1)::int else 0::hugeint end))::hugeint, 0::hugeint))"
    return f"(length({a}) - bit_count(list_reduce(list_prepend({full}, {places}), lambda row, hit: (((row + (row & hit)) | (row - (row & hit))) & {full}))))"


def _ratio(a: str, b: str) -> str:
    return f"(200.0 * {_lcs(a, b)} / (length({a}) + length({b})))"


def _sorted(words: str) -> str:
    return f"array_to_string(list_sort({words}), ' ')"


def _norm(name: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({name}), '[^a-z0-9а-яё_\\s\\-.,/]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _partial(pairs: str, key: str) -> str:
    """SQL for (key, part): the best ratio with a stretch, for rows (key, a, b) of ``pairs``."""
    stretches = "list_distinct(list_concat(list_transform(range(1, length(long) - length(short) + 2), lambda i: substr(long, i, length(short))), list_transform(range(1, length(short)), lambda i: substr(long, 1, i)), list_transform(range(1, length(short)), lambda i: substr(long, length(long) - i + 1, i))))"
    sides = f"select {key}, case when length(a) <= length(b) then a else b end as short, case when length(a) <= length(b) then b else a end as long from {pairs} union all select {key}, b, a from {pairs} where length(a) = length(b)"
    return f"select {key}, max({_ratio('short', 'u')}) as part from (select {key}, short, unnest({stretches}) as u from ({sides})) group by {key}"


_STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
_VOCABULARY = f"vocabulary as (select distinct word from (select unnest(regexp_extract_all({_norm('name')}, '[a-z]{{4,}}')) as word from catalog) where word not in {_STOP})"


def _brands(least: float) -> str:
    return (
        f"fragment as (select distinct f from (select unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) as f from tag_texts) where f not in {_STOP}), {_VOCABULARY}, "
        "both_words as (select f, word, f as a, word as b from fragment, vocabulary), "
        f"parts as ({_partial('both_words', 'f, word')}), "
        f"liked as (select f, word, {_ratio('f', 'word')} as whole, part from both_words join parts using (f, word)), "
        "brand as (select f, case when (w).s >= (p).s then (w).word else (p).word end as word from (select f, first({'s': whole, 'word': word} order by whole desc, word) as w, first({'s': part, 'word': word} order by part desc, word) as p from liked group by f) "
        f"where greatest((w).s, (p).s) >= {least})"
    )


def _asked(join: str) -> str:
    return (
        f"own as (select pos, text, list_filter(list_distinct(list_concat(regexp_extract_all(lower(text), '[a-z]{{3,}}'), regexp_extract_all(lower(text), '[а-яё]{{4,}}'))), lambda w: w not in {_STOP}) as own from tag_texts), "
        "brands as (select pos, list(distinct word) as brands from (select pos, unnest(own) as f from own) join brand using (f) group by pos), "
        f"asked as (select pos, text, list_distinct(list_concat(own, coalesce(brands, []))) as words from own {join} brands using (pos) where len(own) > 0), "
        f"named as (select distinct {_norm('name')} as name, list_distinct(regexp_extract_all({_norm('name')}, '[a-z]{{3,}}|[а-яё]{{4,}}')) as tokens from catalog), "
        "known as (select distinct pos from (select pos, unnest(words) as w from asked) where w in (select unnest(tokens) from named)), "
        "met as (select a.pos, a.text, n.name, a.words as x, list_distinct(string_split(n.name, ' ')) as y from asked a cross join named n left join known k on k.pos = a.pos "
        "where case when k.pos is not null then list_has_any(a.words, n.tokens) else len(list_filter(a.words, lambda w: regexp_matches(w, '^[a-z]{4,}$') and contains(n.name, w))) > 0 end)"
    )


#: For rows (pos, name, x, y) of ``met``, x and y being the words of both sides: the token-set ratio.
_SET = (
    "cut as (select pos, name, list_sort(list_intersect(x, y)) as i, list_sort(list_filter(x, lambda w: not list_contains(y, w))) as l, list_sort(list_filter(y, lambda w: not list_contains(x, w))) as r from met), "
    "joined as (select pos, name, len(i) as n, len(l) as nl, len(r) as nr, array_to_string(i, ' ') as b, array_to_string(list_concat(i, l), ' ') as lt, array_to_string(list_concat(i, r), ' ') as rt from cut), "
    f"scored as (select pos, name, case when n > 0 and (nl = 0 or nr = 0) then 100.0 else greatest({_ratio('lt', 'rt')}, case when n > 0 then 200.0 * length(b) / (length(b) + length(lt)) else 0 end, case when n > 0 then 200.0 * length(b) / (length(b) + length(rt)) else 0 end) end as score from joined)"
)
_CENTS = "list_filter(list_transform(regexp_extract_all(text, '\\b\\d{2,4}[.,]\\d{2}\\b'), lambda v: regexp_replace(v, '[.,]', '')::bigint), lambda v: v between 1000 and 999900)"
_NEAR = "(len({cents}) = 0 or price <= 0 or len(list_filter({cents}, lambda v: abs(v - price) <= {share} * greatest(price, 100))) > 0)"


def _ranked(least: float) -> str:
    """Catalog rows of each tag by score and part_id."""
    return f"ranked as (select s.pos, t.text, c.part_id, c.barcode, c.price, s.name, s.score, row_number() over (partition by s.pos order by s.score desc, c.part_id) as k from scored s join tag_texts t on t.pos = s.pos join (select *, {_norm('name')} as norm from catalog) c on c.norm = s.name where s.score >= {least})"


@query(f"with {_brands(84)} select f as fragment, word from brand", "tag_texts", "catalog")
def brand_words(spark, sf_dir):
    words = view(spark, sf_dir, "tag_texts").selectExpr("explode(regexp_extract_all(lower(text), '([a-z]{3,})')) as fragment")
    return fuzzy.brand_words(words.where(~words.fragment.isin(*STOP_WORDS)), fuzzy.brand_vocabulary(view(spark, sf_dir, "catalog")))


@query(
    f"with {_brands(84)}, {_asked('join')}, {_SET}, {_ranked(82)} select pos, part_id, round(score, 6) as score from ranked where k = 1 and {ean_sql('barcode')} and ({_NEAR.format(cents=_CENTS, share=0.2)} or score >= 92)",
    "tag_texts", "catalog",
)
def fuzzy_top1(spark, sf_dir):
    got = fuzzy.match(view(spark, sf_dir, "tag_texts"), view(spark, sf_dir, "catalog"), "text")
    return got.selectExpr("pos", "part_id", "round(score, 6) as score")


_WEIGHTED = (
    f"text_pair as (select pos, {_norm('text')} as a, name as b from picked where choice = 1), "
    "ordered as (select pos, array_to_string(list_sort(string_split(a, ' ')), ' ') as a, array_to_string(list_sort(string_split(b, ' ')), ' ') as b from text_pair), "
    f"parts_1 as ({_partial('text_pair', 'pos')}), parts_2 as ({_partial('ordered', 'pos')}), "
    # the first option shares a word with the text, or holds one of its words, so that the rests count 100 or are compared
    "rest as (select pos, array_to_string(list_sort(list_filter(list_distinct(string_split(a, ' ')), lambda w: not list_contains(string_split(b, ' '), w))), ' ') as a, array_to_string(list_sort(list_filter(list_distinct(string_split(b, ' ')), lambda w: not list_contains(string_split(a, ' '), w))), ' ') as b, list_has_any(string_split(a, ' '), string_split(b, ' ')) as shared from text_pair), "
    f"parts_3 as ({_partial('(select * from rest where not shared)', 'pos')}), "
    f"sure as (select t.pos, case when greatest(length(t.a), length(t.b)) < 1.5 * least(length(t.a), length(t.b)) then greatest({_ratio('t.a', 't.b')}, 0.95 * {_ratio('o.a', 'o.b')}, 0.95 * whole) "
    f"else greatest({_ratio('t.a', 't.b')}, scale * p1.part, 0.95 * scale * greatest(p2.part, case when r.shared then 100 else p3.part end)) end as weighted "
    "from (select *, case when greatest(length(a), length(b)) < 8 * least(length(a), length(b)) then 0.9 else 0.6 end as scale from text_pair) t join ordered o using (pos) join rest r using (pos) join parts_1 p1 using (pos) join parts_2 p2 using (pos) left join parts_3 p3 using (pos) join whole w using (pos))"
)
#: The token-set ratio of the whole text and the first option's name.
_WHOLE = _SET.replace("met)", "whole_met)").replace("cut as", "cut_2 as").replace("from cut)", "from cut_2)").replace("joined as", "joined_2 as").replace("from joined)", "from joined_2)").replace("scored as", "scored_2 as")


@query(
    f"with {_brands(82)}, {_asked('left join')}, {_SET}, {_ranked(72)}, "
    "distinct_codes as (select *, row_number() over (partition by pos order by k) as n from (select * from ranked where k <= 16 and length(trim(text)) >= 10 and substr(barcode, 1, 7) not in ('2099999', '2999999', '0000000') qualify row_number() over (partition by pos, barcode order by k) = 1)), "
    f"picked as (select *, row_number() over (partition by pos order by k) as choice from distinct_codes where n <= 8 and {ean_sql('barcode')} and {_NEAR.format(cents=_CENTS, share=0.18)}), "
    f"whole_met as (select pos, name, list_distinct(string_split({_norm('text')}, ' ')) as x, list_distinct(string_split(name, ' ')) as y from picked where choice = 1), {_WHOLE}, whole as (select pos, score as whole from scored_2), {_WEIGHTED} "
    "select pos, cast(choice as int) as choice, part_id, barcode, round(score, 6) as score, choice = 1 and score >= 90 and weighted >= 85 as accepted from picked join sure using (pos)",
    "tag_texts", "catalog",
)
def fuzzy_top8_by_price(spark, sf_dir):
    got = fuzzy.options(view(spark, sf_dir, "tag_texts"), view(spark, sf_dir, "catalog"), "text")
    return got.selectExpr("pos", "choice", "part_id", "barcode", "round(score, 6) as score", "accepted")


@query(
    f"with met as (select pos, name, list_distinct(string_split(a, ' ')) as x, list_distinct(string_split(name, ' ')) as y from (select pos, {_norm('text')} as a from tag_texts where length({_norm('text')}) >= 8) t cross join (select distinct {_norm('name')} as name from catalog) n), {_SET}, {_ranked(72)} "
    "select pos, cast(row_number() over (partition by pos order by k) as int) as choice, part_id, barcode, round(score, 6) as score from (select * from ranked where k <= 15 qualify row_number() over (partition by pos, barcode order by k) = 1) qualify row_number() over (partition by pos order by k) <= 5",
    "tag_texts", "catalog",
)
def fuzzy_full_top5(spark, sf_dir):
    got = fuzzy.reranked(view(spark, sf_dir, "tag_texts"), view(spark, sf_dir, "catalog"), "text")
    return got.selectExpr("pos", "choice", "part_id", "barcode", "round(score, 6) as score")
