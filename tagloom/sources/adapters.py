"""Views that give the star-schema tables the shape of price-tag tables.

Each view is SQL that Spark and DuckDB read alike; ``{name}`` stands for a base table or an earlier
view. Money is in integer cents, and ``pos`` is the order of rows that first and last refer to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

_BODY = "'460' || lpad(cast(p_partkey as varchar(20)), 9, '0')"
_DIGIT = " + ".join(f"{3 if i % 2 == 0 else 1} * cast(substr(body, {i}, 1) as int)" for i in range(1, 13))

VIEWS: dict[str, str] = {
    "jobs": """
select o_orderkey as id, case o_orderstatus when 'F' then 'done' when 'O' then 'processing' else 'error' end as status,
  cast(o_custkey % 7 as int) as user_id, o_orderdate as created_at, o_orderdate + (o_orderkey % 3600) * interval '1' second as updated_at,
  case when o_orderkey % 11 = 0 then o_orderdate + interval '10' day end as files_deleted_at
from {orders}""",
    "catalog": f"""
select p_partkey as part_id, body || cast((10 - ({_DIGIT}) % 10) % 10 as varchar(1)) as barcode, p_name || ' ' || p_brand as name,
  cast(round(p_retailprice * 100) as bigint) as price, cast(floor((cast(round(p_retailprice * 100) as bigint) * 9 + 5) / 10) as bigint) as card_price
from (select *, {_BODY} as body from {{part}}) p""",
    "tag_texts": """
select part_id as pos, case cast(floor(part_id / 20) as bigint) % 5 when 0 then name || ' ' || rub || '.' || kop when 1 then substr(name, 1, 3) || substr(name, 5) || ' ' || less || '.' || kop
  when 2 then replace(replace(name, 'l', 'i'), 'o', '0') when 3 then replace(name, 'Brand', 'Brnd') || ' вино' else upper(substr(name, 1, length(name) - 9)) || ' напиток ' || less || '.' || kop end as text
from (select *, cast(cast(floor(price / 100) as bigint) as varchar(9)) as rub, cast(cast(floor(price * 7 / 1000) as bigint) as varchar(9)) as less, lpad(cast(price % 100 as varchar(2)), 2, '0') as kop from {catalog} where part_id % 20 = 0) p""",
    "detections": """
select ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey as pos, l_orderkey as job_id, cast(l_orderkey % 500 as int) as video,
  case when l_linenumber % 5 = 0 then '' when l_linenumber % 7 = 0 then substr(barcode, 1, 12) || cast((cast(substr(barcode, 13, 1) as int) + 1) % 10 as varchar(1)) else barcode end as barcode,
  case when l_linenumber % 6 = 0 then '' else p_name end as product_name,
  case when l_partkey % 13 = 0 then null else price end as price_default,
  cast(floor((price * (100 - cast(round(l_discount * 100) as bigint)) + 50) / 100) as bigint) as price_card,
  cast(round(l_discount * 100) as int) as discount, case l_returnflag when 'R' then 'red' when 'A' then 'yellow' else '' end as color,
  case when l_suppkey % 4 = 0 then 'K' when l_suppkey % 4 = 1 then '' else 'нет' end as special_symbols,
  case when l_linenumber % 3 = 0 then 'нет' when l_linenumber % 3 = 1 then '' else '270' || lpad(cast(l_partkey as varchar(20)), 9, '0') end as id_sku,
  case when l_suppkey % 2 = 0 then '12.05.2025 09:07' else '' end as print_datetime,
  case when l_linenumber % 4 = 1 then barcode else '' end as qr_code_barcode,
  cast(l_partkey * 37 % 20000 as bigint) as frame_timestamp, cast(l_suppkey * 53 % 3000 as int) as x_min, cast(l_partkey * 17 % 1500 as int) as y_min,
  cast(l_suppkey * 53 % 3000 + 40 + 4 * l_quantity as int) as x_max, cast(l_partkey * 17 % 1500 + 30 + 2 * l_quantity as int) as y_max
from {lineitem} join {part} on l_partkey = p_partkey join {catalog} on part_id = p_partkey""",
    "gt": """
select pos, video, barcode, case when pos % 4 = 0 then '' when pos % 4 = 1 then 'нет' else product_name end as product_name,
  case when pos % 5 = 0 then null else price_default + (pos % 3) * 40 end as price_default, price_card, color, special_symbols, id_sku, print_datetime,
  frame_timestamp + 700 as frame_timestamp, x_min + 5 as x_min, y_min + 3 as y_min, x_max + 5 as x_max, y_max + 3 as y_max
from {detections} where pos % 3 = 0""",
    "run_left": "select * from {detections} where job_id % 4 <> 0",
    "run_right": """
select pos, job_id, video, barcode, product_name, price_default + (pos % 2) * 100 as price_default, price_card, color, id_sku
from {detections} where job_id % 4 <> 1""",
    "ocr_frames": """
select event_id as pos, cast(user_id as int) as video, cast(floor(event_id / 5) as bigint) as track_id, cast(event_id % 5 as int) as rnk,
  cast(event_id * 40 as bigint) as frame_ts_ms, cast(event_id * 7 % 900 as int) as x0, cast(event_id * 11 % 500 as int) as y0, cast(event_id * 7 % 900 + 60 + event_id % 50 as int) as x1, cast(event_id * 11 % 500 + 40 + event_id % 30 as int) as y1,
  case when event_id % 6 = 0 then '' else 'b=46012345' || lpad(cast(event_id % 17 as varchar(4)), 4, '0') || cast(event_id % 10 as varchar(1)) || ';p1=' || cast(event_id % 900 + 10 as varchar(4)) || '.99&aC=' || cast(event_id % 4 as varchar(1)) end as qr_raw,
  case when event_id % 4 = 0 then '' else '46012345' || lpad(cast(event_id % 23 as varchar(4)), 4, '0') || cast(event_id % 10 as varchar(1)) end as barcode_raw,
  'no ' || cast(event_id % 900 + 10 as varchar(4)) || '.' || lpad(cast(event_id % 100 as varchar(2)), 2, '0') || case when event_id % 3 = 0 then ' -3O% ' when event_id % 3 = 1 then ' 5% ' else ' sale 25 % ' end
    || case when event_id % 2 = 0 then 'l2.05.25 9:07' else '7/11/2024' end || case event_id % 5 when 0 then ' 12_012345 - 067890' when 1 then ' 012345-067890' when 2 then ' 270 102 162817' when 3 then ' 270102 - 012345' else ' 3_0l2345' end
    || case cast(floor(abs(value)) as bigint) % 9 when 0 then ' Вино кр. сух 0,75' when 1 then ' вино полусухое' when 2 then ' 2 по цене 1' when 3 then ' бедое' when 4 then ' п/сух белое' when 5 then ' игристое, сладкое' else '' end as ocr_text,
  'нет' as none_text, event_type, cast(floor(abs(value)) as bigint) as score
from {events}""",
    "tokens": """
select event_id as pos, 0 as idx, cast(event_id % 970 + 10 as varchar(6)) as text, cast(40 + event_id % 30 as int) as height from {events}
union all select event_id, 1, lpad(cast(event_id * 3 % 100 as varchar(4)), 2, '0'), cast(event_id * 7 % 50 as int) from {events}
union all select event_id, 2, case when event_id % 3 = 0 then 'l' || cast(event_id % 9000 as varchar(6)) || ',' || lpad(cast(event_id % 100 as varchar(4)), 2, '0') || 'p' when event_id % 3 = 1 then 'no price' else '5' end, cast(20 + event_id % 40 as int) from {events}
union all select event_id, 3, 'I' || cast(event_id % 9 as varchar(2)) || 'O', cast(event_id % 4 * 15 as int) from {events}
union all select event_id, 4, cast(event_id % 89 + 10 as varchar(4)) || '.', cast(30 + event_id % 20 as int) from {events}
union all select event_id, 5, cast(event_id % 970 + 10 as varchar(6)), cast(90 - event_id % 60 as int) from {events} where event_id % 4 <> 0
union all select event_id, 6 + k, case when (event_id + k) % 4 = 0 then 'К' when cast(floor(abs(value)) as bigint) % 3 = 0 then 'ш.' when (event_id * k) % 5 = 1 then 'Ц1' else ' Ц' end, cast(floor(abs(value)) as int) % 60 + k * 3 from {events} cross join (select 0 as k union all select 1 union all select 2) n where event_id % 3 <> 0""",
    "track_codes": """
select e.event_id as pos, cast(floor(e.event_id / 6) as bigint) as track_id, cast(e.user_id as int) as video,
  case when e.event_id % 3 = 0 then 'EAN ' || c.barcode || ' ' when e.event_id % 3 = 1 then 'x' || substr(c.barcode, 1, 11) || 'O' || substr(c.barcode, 13, 1) || ' 12' else 'n' || substr(c.barcode, 2, 11) end as text,
  case when floor(e.event_id / 6) % 3 = 0 then c.barcode when e.event_id % 5 = 0 then substr(c.barcode, 1, 12) when e.event_id % 5 = 1 then '2999999' || substr(c.barcode, 8, 6) else '' end as barcode
from {events} e cross join (select count(*) as parts from {part}) n join {catalog} c on c.part_id = cast(floor(e.event_id / 6) as bigint) * 7919 % parts""",
    "tags23": """
select pos, video, product_name, price_default, price_card, price_card - 700 as price_discount, barcode, case when discount = 0 then 'нет' else '-' || cast(discount as varchar(4)) || '%' end as discount_amount, id_sku, print_datetime,
  case when pos % 4 = 0 then '' when pos % 4 = 1 then 'нет' else '12_012345' end as code, case when pos % 3 = 0 then 'Сухое' else 'нет' end as additional_info, color, special_symbols, qr_code_barcode,
  price_default as price1_qr, price_default - 300 as price2_qr, cast(null as bigint) as price3_qr, price_card as price4_qr, cast(pos % 12 as varchar(4)) as wholesale_level_1_count, price_card - 50 as wholesale_level_1_price,
  '' as wholesale_level_2_count, cast(null as bigint) as wholesale_level_2_price, case when pos % 2 = 0 then price_card end as action_price_qr, cast(pos % 3 as varchar(2)) as action_code_qr
from {detections}""",
    "gt23": """
select pos, video, case when pos % 4 = 0 then '' when pos % 4 = 1 then 'нет' else product_name end as product_name, case when pos % 5 = 0 then null else price_default + (pos % 7) * 40 end as price_default,
  price_card + (pos % 2) * 2000 as price_card, price_discount + pos % 100 as price_discount, barcode, case when pos % 11 = 0 then '-10%' else discount_amount end as discount_amount, id_sku, print_datetime,
  code, case when pos % 9 = 0 then ' сухое ' else additional_info end as additional_info, color, special_symbols, case when pos % 10 = 0 then '' else qr_code_barcode end as qr_code_barcode,
  price1_qr, price2_qr, price_card as price3_qr, price4_qr, case when pos % 6 = 0 then '3' else wholesale_level_1_count end as wholesale_level_1_count, wholesale_level_1_price,
  case when pos % 8 = 0 then '4' else '' end as wholesale_level_2_count, wholesale_level_2_price, action_price_qr, case when pos % 7 = 0 then '' else action_code_qr end as action_code_qr
from {tags23} where pos % 3 = 0""",
    "job_events": """
select event_id, user_id as job_id, ts as event_ts, case event_type when 'purchase' then 'done' when 'click' then 'processing' when 'view' then 'processing' else 'queued' end as status,
  cast(floor(abs(value)) as bigint) % 100 as progress from {events}""",
}

_COUNTED = "from {events} e cross join (select count(*) as parts from {part}) n join {catalog} c on c.part_id = cast(floor(e.event_id / 6) as bigint) * 7919 % parts"
_KEYED = "from (select *, cast(floor(event_id / 6) as bigint) * 7919 % (select nullif(count(*), 0) from {part}) as wanted from {events}) e join {catalog} c on c.part_id = e.wanted"

#: Views of the same rows in a form that Spark joins by key: a filter that names columns of both sides of a join with a
#: condition over three tables makes it multiply two of them first.
SPARK_VIEWS = {**VIEWS, "track_codes": VIEWS["track_codes"].replace(_COUNTED, _KEYED)}


#: Parts beyond which detections meet them by sorting: keys are so narrow in a file that millions would be broadcast.
MOST_PARTS = 2_000_000


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a base table, over the tables in ``sf_dir``."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = {n: view(spark, sf_dir, n) for n in (*BASE, *VIEWS) if "{" + n + "}" in SPARK_VIEWS[name]}
    if name == "detections" and needs["part"].count() > MOST_PARTS:
        needs |= {n: needs[n].hint("merge") for n in ("part", "catalog")}
    return spark.sql(SPARK_VIEWS[name], **needs)


def with_views(sql: str, *names: str) -> str:
    """``sql`` for DuckDB, after the definitions of the views that it names and of those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in VIEWS:
            if "{" + n + "}" in VIEWS[name]:
                add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    if not order:
        return sql
    plain = {n: n for n in (*BASE, *VIEWS)}
    head = ", ".join(f"{n} as ({VIEWS[n].format(**plain)})" for n in order)
    if sql.lstrip().lower().startswith("with recursive "):
        return f"with recursive {head}, {sql.lstrip()[15:]}"
    if sql.lstrip().lower().startswith("with "):
        return f"with {head}, {sql.lstrip()[5:]}"
    return f"with {head} {sql}"
