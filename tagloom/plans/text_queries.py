"""Fields out of text, and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import scores as S
from tagloom.functions import text as T
from tagloom.operators.reporting import longest_words
from tagloom.plans.registry import query
from tagloom.sources.adapters import view

_FIX = f"translate(ocr_text, '{T.LOOK_ALIKES}', '{T.DIGITS}')"
_EAN = "((10 - (" + " + ".join(f"{3 if i % 2 == 0 else 1} * cast(substr({{0}}, {i}, 1) as int)" for i in range(1, 13)) + ") % 10) % 10)"


def ean_sql(code: str) -> str:
    return f"(regexp_full_match({code}, '[0-9]{{13}}') and cast(substr(case when regexp_full_match({code}, '[0-9]{{13}}') then {code} else '0000000000000' end, 13, 1) as int) = {_EAN.format(f'''(case when regexp_full_match({code}, '[0-9]{{13}}') then {code} else '0000000000000' end)''')})"


def _frames(spark, sf_dir, **columns):
    return view(spark, sf_dir, "ocr_frames").select("pos", *[c.alias(k) for k, c in columns.items()])


@query(f"select pos, {ean_sql('barcode')} as valid from detections", "detections")
def ean_checksum(spark, sf_dir):
    return view(spark, sf_dir, "detections").select("pos", T.ean_ok(F.col("barcode")).alias("valid"))


@query(f"select part_id, substr(barcode, 1, 12) || cast({_EAN.format('barcode')} as varchar) as barcode from catalog", "catalog")
def ean_complete12(spark, sf_dir):
    body = F.substring("barcode", 1, 12)
    return view(spark, sf_dir, "catalog").select("part_id", F.concat(body, T.ean_check_digit(body).cast("string")).alias("barcode"))


@query(
    f"select pos, case when length(d) between 12 and 13 then d else '' end as loose, case when length(d) = 13 and not {ean_sql('d')} then substr(d, 1, 12) when length(d) between 12 and 13 then d else '' end as strict "
    "from (select pos, regexp_replace(regexp_replace(trim(barcode || case when pos % 2 = 0 then '.0' else ' ' end), '[.]0+$', ''), '[^0-9]', '', 'g') as d from detections)",
    "detections",
)
def barcode_normalize(spark, sf_dir):
    raw = F.concat("barcode", F.when(F.col("pos") % 2 == 0, ".0").otherwise(" "))
    return view(spark, sf_dir, "detections").select("pos", T.normalize_barcode(raw).alias("loose"), T.normalize_barcode_strict(raw).alias("strict"))


@query(f"select pos, {_FIX} as fixed from ocr_frames", "ocr_frames")
def ocr_digit_fix(spark, sf_dir):
    return _frames(spark, sf_dir, fixed=T.fix_ocr_digits(F.col("ocr_text")))


@query("select pos, case when regexp_extract(ocr_text, '([1-9][0-9])\\s*%', 1) <> '' then '-' || regexp_extract(ocr_text, '([1-9][0-9])\\s*%', 1) || '%' when regexp_extract(ocr_text, '(^|[^0-9])[-−–—''~]\\s?([1-9][0-9])([^0-9]|$)', 2) <> '' then '-' || regexp_extract(ocr_text, '(^|[^0-9])[-−–—''~]\\s?([1-9][0-9])([^0-9]|$)', 2) || '%' else '' end as discount from ocr_frames", "ocr_frames")
def parse_discount(spark, sf_dir):
    return _frames(spark, sf_dir, discount=T.parse_discount(F.col("ocr_text")))


@query(
    "select pos, case when dd = '' then '' else lpad(dd, 2, '0') || '.' || lpad(mm, 2, '0') || '.' || case when length(yy) = 2 then '20' || yy else yy end || case when hh = '' then '' else ' ' || lpad(hh, 2, '0') || ':' || mi end end as printed from ("
    f"select pos, {', '.join(f'''coalesce(regexp_extract(t, '\\b([0-9]{{1,2}})\\s*[./\\-]\\s*([0-9]{{1,2}})\\s*[./\\-]\\s*([0-9]{{2,4}})(?:\\s+([0-9]{{1,2}})\\s*[:.]\\s*([0-9]{{2}}))?\\b', {k}), '') as {n}''' for k, n in enumerate(('dd', 'mm', 'yy', 'hh', 'mi'), 1))} from (select pos, {_FIX} as t from ocr_frames))",
    "ocr_frames",
)
def parse_datetime(spark, sf_dir):
    return _frames(spark, sf_dir, printed=T.parse_print_datetime(F.col("ocr_text")))


_PREFIX = "(270|370|470|170|570|770)"


@query(
    "select pos, case when a <> '' then a when b <> '' then regexp_replace(b, '[^0-9]', '', 'g') else c end as sku from (select pos, regexp_extract(t, '(^|[^0-9])([0-9]{12})([^0-9]|$)', 2) as a, "
    + "coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{p}(\\s?[0-9]{{3}}\\s?[0-9]{{6}}|\\s?[0-9]{{9}}|\\s?[0-9]{{3}}\\s?[0-9]{{3}}\\s?[0-9]{{3}})'), '')" for p in T.SKU_PREFIXES) + ", '') as b, "
    f"regexp_extract(t, '(^|[^0-9])([0-9]{{9,11}})([^0-9]|$)', 2) as c from (select pos, {_FIX} as t from ocr_frames))",
    "ocr_frames",
)
def parse_sku(spark, sf_dir):
    return _frames(spark, sf_dir, sku=T.parse_id_sku(F.col("ocr_text")))


@query(
    f"""select pos, case when raw = '' or regexp_matches(regexp_replace(raw, '[^0-9]', '', 'g'), '^{_PREFIX}') then 'нет' else raw end as code from (
select pos, case when regexp_matches(t, '(^|[^0-9])([0-9]{{1,2}})_(0[0-9]{{5}})\\s*[-–—]\\s*(0[0-9]{{5}})([^0-9]|$)')
  then regexp_extract(t, '(^|[^0-9])([0-9]{{1,2}}_0[0-9]{{5}})\\s*[-–—]\\s*(0[0-9]{{5}})([^0-9]|$)', 2) || ' - ' || regexp_extract(t, '(^|[^0-9])([0-9]{{1,2}}_0[0-9]{{5}})\\s*[-–—]\\s*(0[0-9]{{5}})([^0-9]|$)', 3)
  when regexp_matches(t, '(^|[^0-9])([0-9]{{1,2}}_0[0-9]{{5}})([^0-9]|$)') then regexp_extract(t, '(^|[^0-9])([0-9]{{1,2}}_0[0-9]{{5}})([^0-9]|$)', 2)
  when regexp_matches(t, '(^|[^0-9])(0[0-9]{{5}})\\s*[-–—]?\\s*(0[0-9]{{5}})([^0-9]|$)') then regexp_extract(t, '(^|[^0-9])(0[0-9]{{5}})\\s*[-–—]?\\s*(0[0-9]{{5}})([^0-9]|$)', 2) || ' - ' || regexp_extract(t, '(^|[^0-9])(0[0-9]{{5}})\\s*[-–—]?\\s*(0[0-9]{{5}})([^0-9]|$)', 3)
  else '' end as raw from (select pos, {_FIX} as t from ocr_frames))""",
    "ocr_frames",
)
def parse_code(spark, sf_dir):
    return _frames(spark, sf_dir, code=T.parse_code(F.col("ocr_text")))


_QR = lambda key: f"case when not regexp_matches(qr_raw, '(^|[;&])({key})=') then '' when regexp_extract(qr_raw, '(^|[;&])({key})=([^;&]*)', 3) = '' then 'нет' else regexp_extract(qr_raw, '(^|[;&])({key})=([^;&]*)', 3) end"


#: Half of the payloads as JSON objects, whose keys are the long names.
_PAYLOAD = "case when pos % 2 = 0 or qr_raw = '' then qr_raw || case when pos % 3 = 0 and qr_raw <> '' then ';wL1C=' || pos % 5 || '&wL1P= 12.50 ;aP=;b=' || pos % 7 else '' end else '{\"barcode\":\"' || pos || '\",\"price2\":\"' || score || '\",\"price4\":\"\",\"wholesaleLevel2Count\":\"' || pos % 4 || '\",\"actionPrice\":\" 7 \",\"actionCode\":\"x\"}' end"
_KEYED = lambda name, keys: (
    f"case when js then json_extract_string(p, '$.{keys[0]}') else list_last(list_transform(list_filter(parts, lambda x: trim(string_split(x, '=')[1]) = '{keys[0]}'), lambda x: substr(x, strpos(x, '=') + 1))) end as a_{name}, "
    f"case when js then json_extract_string(p, '$.{keys[1]}') else list_last(list_transform(list_filter(parts, lambda x: trim(string_split(x, '=')[1]) = '{keys[1]}'), lambda x: substr(x, strpos(x, '=') + 1))) end as b_{name}"
)


@query(
    "select pos, " + ", ".join(f"case when coalesce(a_{f}, b_{f}) is null then '' when trim(coalesce(a_{f}, b_{f})) = '' then 'нет' else trim(coalesce(a_{f}, b_{f})) end as {f}" for f in T.QR_FIELDS)
    + " from (select pos, " + ", ".join(_KEYED(f, keys) for f, keys in T.QR_FIELDS.items())
    + f" from (select pos, p, p like '{{%' as js, list_filter(string_split_regex(p, '[;&\\n]'), lambda x: contains(x, '=')) as parts from (select pos, {_PAYLOAD} as p from ocr_frames)))",
    "ocr_frames",
)
def parse_qr(spark, sf_dir):
    """All eleven fields, of payloads in either form."""
    return view(spark, sf_dir, "ocr_frames").select("pos", T.parse_qr(F.expr(_PAYLOAD)).alias("q")).select("pos", "q.*")


@query(f"select pos, {_QR('barcode|b')} as qr_code_barcode, {_QR('price1|p1')} as price1_qr, {_QR('actionCode|aC')} as action_code_qr, {_QR('price2|p2')} as price2_qr from ocr_frames", "ocr_frames")
def parse_qr_kv(spark, sf_dir):
    return view(spark, sf_dir, "ocr_frames").withColumn("q", T.parse_qr(F.col("qr_raw"))).select("pos", "q.qr_code_barcode", "q.price1_qr", "q.action_code_qr", "q.price2_qr")


@query(
    "select pos, cents from (select pos, unnest(regexp_extract_all(ocr_text, '\\b([0-9]{2,4}[.,][0-9]{2})\\b', 1)) as x from ocr_frames), lateral (select cast(regexp_replace(x, '[.,]', '') as bigint) as cents) where cents between 1000 and 999900",
    "ocr_frames",
)
def price_tokens(spark, sf_dir):
    return _frames(spark, sf_dir, cents=F.explode(T.price_tokens(F.col("ocr_text"))))


@query(
    "with d as (select pos, barcode_raw || ' ' || regexp_replace(qr_raw, '[^0-9]', '', 'g') as t, regexp_replace(barcode_raw || qr_raw, '[^0-9]', '', 'g') as g from ocr_frames) "
    "select distinct pos, run from (select pos, unnest(regexp_extract_all(t, '[0-9]+')) as run from d) where length(run) between 8 and 13 "
    "union select distinct pos, substr(g, cast(i as bigint), n) as run from d, (select unnest([10, 11, 12, 13]) as n), lateral (select unnest(generate_series(1, length(g) - n + 1)) as i) where length(g) >= n",
    "ocr_frames",
)
def digit_ngrams(spark, sf_dir):
    return _frames(spark, sf_dir, run=F.explode(T.digit_runs(F.concat_ws(" ", "barcode_raw", F.regexp_replace("qr_raw", r"\D", "")))))


# One-byte stand-ins for Cyrillic letters, since the twin's edit distance counts bytes.
_CYRILLIC, _STAND_INS = "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*+"
_SPARE = str.maketrans(_CYRILLIC, _STAND_INS)
_ROUNDED = "regexp_matches(low, 'п\\s*/?\\s*сух|полусух')"
_DRY = "regexp_matches(low, '(^|[^a-zа-яё0-9_/])кр\\.?\\s*сух')"
INFO_SQL = (
    f"select pos, case when {_DRY} and not {_ROUNDED} then 'Сухое' when regexp_extract(low, '([0-9]+)\\s*по\\s*цене\\s*([0-9]+)', 1) <> '' then regexp_replace(regexp_extract(low, '[0-9]+\\s*по\\s*цене\\s*[0-9]+'), '\\s*по\\s*цене\\s*', ' по цене ') || ' от цены без карты' "
    + " ".join(f"when contains(low, '{w}') or len(list_filter(toks, lambda t: levenshtein(t, '{w.translate(_SPARE)}') <= 1)) > 0 then '{label}'" for w, label in T.WINE_KINDS.items())
    + f" else 'нет' end as info, low from (select pos, low, list_transform(list_filter(list_transform(string_split_regex(low, '\\s+'), lambda t: regexp_replace(t, '[^a-zа-я0-9ё]', '', 'g')), lambda t: t <> ''), lambda t: translate(t, '{_CYRILLIC}', '{_STAND_INS}')) as toks from (select pos, lower(ocr_text) as low from ocr_frames))"
)


@query(
    "select pos, info, case when regexp_matches(low, '(^|[^a-zа-яё0-9_])п\\s*/\\s*сух([^a-zа-яё0-9_]|$)|полусух') then 'Полусухое' when regexp_matches(low, '(^|[^a-zа-яё0-9_])п\\s*/\\s*сл([^a-zа-яё0-9_]|$)|полуслад') then 'Полусладкое' else '' end as hint, "
    f"case when {_ROUNDED} then '' when {_DRY} then 'Сухое' else '' end as dry from ({INFO_SQL})",
    "ocr_frames",
)
def wine_kinds(spark, sf_dir):
    text = F.col("ocr_text")
    return _frames(spark, sf_dir, info=T.parse_additional_info(text), hint=T.wine_hint(text), dry=T.dry_hint(text))


#: К, Ш or Ц of the tokens of each frame.
MARK_SQL = (
    "select e.pos, coalesce(c, 'нет') as mark from (select distinct pos from ocr_frames) e left join (select pos, c, row_number() over (partition by pos order by count(*) desc, max(height) desc, min(idx)) as k from (select pos, idx, height, upper(regexp_replace(trim(text), '[^КШЦкшц]', '', 'g')) as c, trim(text) as t from tokens) "
    "where length(c) = 1 and length(t) <= 3 and not regexp_matches(t, '[0-9]') group by 1, 2) r on r.pos = e.pos and k = 1"
)


NAMED = "case when product_name = '' then '' when pos % 3 = 0 then 'Вино ' || product_name when pos % 3 = 1 then product_name || ' (Chile) 0.75' else 'Сыр ' || substr(product_name, 1, 4) || ' doc' end"
_LETTERS = "length(regexp_replace(s, '[^A-Za-zА-Яа-яЁё]', '', 'g'))"
_TOK = "list_filter(string_split_regex(s, '\\s+'), lambda t: t <> '')"
_LATIN = ", ".join(f"'{w}'" for w in T.LATIN_IN_NAMES)
_WEAK = f"""case when lower(s) in ('', 'нет', 'nan') or lower(s) like 'nan %' then true when regexp_full_match(s, '[0-9\\-+./\\\\]+') then true when regexp_matches(s, '^[0-9\\-+./\\\\]') and length(s) < 12 then true
when length(s) < 10 then true when regexp_matches(s, '[\\[\\]{{}}]') then true when ok then false when {_LETTERS} < 0.45 * length(s) then true
when len({_TOK}) <= 2 and len(list_filter({_TOK}, lambda t: length(t) >= 8)) = 0 then true
when len(list_filter({_TOK}, lambda t: regexp_matches(t, '[A-Za-z]') and regexp_matches(t, '[А-Яа-яЁё]'))) > 0 then true
when len(list_filter({_TOK}, lambda t: regexp_matches(t, '[А-Яа-яЁё]{{3,}}'))) > 0 and len(list_filter({_TOK}, lambda t: regexp_full_match(t, '[A-Za-z0-9.\\-/]{{2,}}') and length(t) >= 4 and lower(t) not in ({_LATIN}))) > 0 then true
when regexp_matches(s, '\\([A-Za-zА-Яа-я .\\-]{{3,30}}\\)\\s*([0-9]|$|\\.)') then false when regexp_matches(s, '(?i)^(Вино|Мед|Виски|Коньяк|Водка|Пиво|Сок|Чай|Кофе|Сыр|Масло)([^A-Za-zА-Яа-яЁё0-9_]|$)') then false
when {_LETTERS} > 0.5 * length(s) and length(regexp_replace(lower(s), '[^а-яё]', '', 'g')) >= 5 then false else true end"""


def _named(spark, sf_dir):
    return view(spark, sf_dir, "detections").withColumn("product_name", F.expr(NAMED))


@query(f"select pos, {_WEAK} as weak from (select pos, trim({NAMED}) as s, {ean_sql('barcode')} and pos % 2 = 0 as ok from detections)", "detections")
def weak_name(spark, sf_dir):
    return _named(spark, sf_dir).select("pos", T.weak_name(F.col("product_name"), T.ean_ok(F.col("barcode")) & (F.col("pos") % 2 == 0)).alias("weak"))


_FILLED = lambda c: f"lower(trim({c})) not in ('', 'nan', 'нет', 'no', 'n/a')"


@query(
    f"select pos, case when ok then 50 when length(barcode) >= 12 then 18 else 0 end + case when price_default > 0 then 30 else 0 end + case when {_FILLED('qr_code_barcode')} then 22 else 0 end + case when {_FILLED('id_sku')} then 8 else 0 end "
    f"+ case when {_FILLED('print_datetime')} then 5 else 0 end + case when not weak then 12 else 0 end as confidence from (select *, {_WEAK} as weak from (select *, trim({NAMED}) as s, {ean_sql('barcode')} as ok from detections))",
    "detections",
)
def confidence_score(spark, sf_dir):
    from tagloom.operators.finalize import confidence

    return confidence(_named(spark, sf_dir)).select("pos", "confidence")


@query("select pos from detections where price_default > 0 or length(barcode) >= 12 or length(qr_code_barcode) >= 12", "detections")
def signal_filter(spark, sf_dir):
    return view(spark, sf_dir, "detections").where(S.has_signal(F.col("price_default"), F.col("barcode"), F.col("qr_code_barcode"))).select("pos")


_PCT = "cast(floor((price_default - price_card) * 100.0 / price_default) as int)"


@query(f"select pos, case when pos % 7 = 0 then '-11%' when price_card * 100 < price_default * 98 and {_PCT} between 5 and 90 then '-' || cast({_PCT} as varchar) || '%' else '' end as discount_amount from detections", "detections")
def infer_discount(spark, sf_dir):
    old = F.when(F.col("pos") % 7 == 0, "-11%").otherwise("нет")
    return view(spark, sf_dir, "detections").select("pos", F.regexp_replace(S.infer_discount(old, F.col("price_default"), F.col("price_card")), "^нет$", "").alias("discount_amount"))


@query("select pos, case when qr_code_barcode = '' then barcode else qr_code_barcode end as qr_code_barcode, price_default as price1_qr, cast(case when (price_default * 95) % 10000 = 5000 then 2 * floor(floor(price_default * 95 / 10000.0) / 2 + 0.5) else floor((price_default * 95 + 5000) / 10000.0) end as bigint) * 100 - 1 as price2_qr, price_card as price4_qr from detections", "detections")
def qr_backfill(spark, sf_dir):
    d = view(spark, sf_dir, "detections")
    return d.select("pos", S.fill(F.col("qr_code_barcode"), F.nullif(F.col("barcode"), F.lit(""))).alias("qr_code_barcode"), F.col("price_default").alias("price1_qr"), S.second_price(F.col("price_default")).alias("price2_qr"), F.col("price_card").alias("price4_qr"))


@query("select d.pos, case when c.price is null then d.price_default when d.price_default is null or d.price_default <= 0 then c.price when abs(d.price_default - c.price) * 5 > c.price and d.price_default // 100 <> c.price // 100 then c.price else d.price_default end as price_default from (select pos, barcode, price_card as price_default from detections) d left join catalog c on d.barcode = c.barcode", "detections", "catalog")
def price_override(spark, sf_dir):
    d = view(spark, sf_dir, "detections").select("pos", "barcode", F.col("price_card").alias("price_default"))
    met = d.join(view(spark, sf_dir, "catalog").select("barcode", "price"), "barcode", "left")
    return met.select("pos", S.price_override(F.col("price_default"), F.col("price")).alias("price_default"))


_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(
    f"select doc_id, coalesce(array_to_string((select list(w order by -length(w), i) from (select w, i from (select unnest(ws) as w, generate_subscripts(ws, 1) as i) where not regexp_full_match(w, '[0-9]+') and lower(w) not in ({_STOPS}) qualify row_number() over (partition by lower(w) order by i) = 1))[1:5], ' '), '') as words "
    "from (select doc_id, regexp_extract_all(text, '[A-Za-zА-Яа-яЁё0-9]{4,}') as ws from documents)",
)
def longest_tokens(spark, sf_dir):
    return longest_words(view(spark, sf_dir, "documents"), "doc_id", "text")
