"""A catalog of products, and how tags find their products in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.geometry import area, box
from tagloom.functions.text import digit_runs, ean_ok
from tagloom.operators.joins import meet, saved


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def hybrid(base: DataFrame, priced: DataFrame | None, default_source: str = "db_hack") -> DataFrame:
    """``base`` (name, barcode) with price, card_price and source of the first row of each barcode in ``priced`` (with pos), if there is one."""
    if priced is None:
        return base.withColumns({"price": F.lit(None).cast("long"), "card_price": F.lit(None).cast("long"), "source": F.lit(default_source)})
    once = first_by(priced, ["barcode"], F.col("pos")).select("barcode", "price", "card_price", "source")
    return base.join(once, "barcode", "left").withColumn("source", F.coalesce("source", F.lit(default_source)))


def exact_match(tags: DataFrame, catalog: DataFrame, pos: str = "pos") -> DataFrame:
    """``tags`` with catalog_name, catalog_price and catalog_card_price of the last catalog row of their barcode (12 digits or more)."""
    last = first_by(catalog.where(F.length("barcode") >= 12), ["barcode"], F.col(pos).desc())
    last = last.select("barcode", F.col("name").alias("catalog_name"), F.col("price").alias("catalog_price"), F.col("card_price").alias("catalog_card_price"))
    # blank barcodes match nothing: they go past the join, where they would be one hot key
    coded, blank = tags.where("barcode <> ''"), tags.where("barcode is null or barcode = ''")
    return coded.join(last, "barcode", "left").unionByName(blank, allowMissingColumns=True)


def clear_repeated(tags: DataFrame, keys: list[str]) -> DataFrame:
    """Of the tags of a barcode the largest keeps it, the others lose it. Blank barcodes take no part, so they are no hot key."""
    order = Window.partitionBy(*keys, "barcode").orderBy(area(box()).desc(), "pos")
    named = tags.where("barcode <> ''").withColumn("__n", F.row_number().over(order)).withColumn("barcode", F.when(F.col("__n") == 1, F.col("barcode")).otherwise("")).drop("__n")
    return named.unionByName(tags.where("barcode is null or barcode = ''"))


def barcode_index(catalog: DataFrame) -> DataFrame:
    """Every barcode in full and as its first 12 digits."""
    return catalog.where(F.length("barcode").between(12, 13)).select(F.explode(F.array("barcode", F.substring("barcode", 1, 12))).alias("code")).distinct()


def gate(tags: DataFrame, catalog: DataFrame) -> DataFrame:
    """Barcodes that the catalog knows, in full or by 12 digits; 13 digits need a right check digit. Others are blanked."""
    index = barcode_index(catalog).withColumnRenamed("code", "__code")
    code = F.col("barcode")
    blank = tags.where("barcode is null or barcode = ''").withColumn("barcode", F.lit(""))
    probe = tags.where("barcode <> ''").withColumn("__probe", F.when(F.length(code) == 13, code).otherwise(F.substring(code, 1, 12)))
    known = probe.join(index, F.col("__probe") == F.col("__code"), "left")
    good = F.col("__code").isNotNull() & ((F.length(code) == 12) | ean_ok(code))
    return known.withColumn("barcode", F.when(good, code).otherwise("")).drop("__probe", "__code").unionByName(blank)


def prefix_postings(catalog: DataFrame) -> DataFrame:
    """prefix (10, 11 or 12 digits), barcode."""
    valid = catalog.where(ean_ok(F.col("barcode")) | F.col("barcode").rlike(r"^\d{12}$"))
    return valid.select("barcode", F.explode(F.transform(F.array(F.lit(10), F.lit(11), F.lit(12)), lambda n: F.substring(F.col("barcode"), F.lit(1), n))).alias("prefix")).distinct()


def complete_by_prefix(texts: DataFrame, catalog: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, barcode, votes: catalog codes that a run of 10 to 12 digits in the text begins."""
    runs = texts.select(*keys, F.explode(digit_runs(F.col(text))).alias("prefix")).where(F.length("prefix").between(10, 12))
    # a table's size tells nothing of the rows that it is exploded into: sent to all tasks, they would pass the driver
    return runs.hint("merge").join(prefix_postings(catalog).hint("merge"), "prefix").groupBy(*keys, "barcode").agg(F.count("*").alias("votes"))


def without_one_digit(body: Column) -> Column:
    """For each of 12 places the digits around it (rest) and the digit there."""
    place = lambda i: F.struct(i.cast("int").alias("place"), F.concat(F.substring(body, F.lit(1), i - 1), F.substring(body, i + 1, F.lit(12))).alias("rest"), F.substring(body, i, F.lit(1)).alias("digit"))
    return F.transform(F.sequence(F.lit(1), F.lit(12)), place)


def one_digit_apart(bodies: DataFrame, catalog: DataFrame) -> DataFrame:
    """__body, __found: catalog codes (with a right check digit) one digit away from the distinct ``bodies`` (__body, 12 digits).

    Bodies and catalog meet at the 11 digits around each place, twelve keys a row. Two codes meet once. Exploded tables
    are larger than their files tell, so no join sends them through the driver.
    """
    mine = bodies.select("__body", F.inline(without_one_digit(F.col("__body"))))
    theirs = catalog.where(ean_ok(F.col("barcode"))).select("barcode").distinct()
    theirs = theirs.select(F.col("barcode").alias("__found"), F.inline(without_one_digit(F.substring("barcode", 1, 12)))).withColumnRenamed("digit", "other")
    return meet(mine, theirs, ["place", "rest"]).where("digit <> other").select("__body", "__found")


def recover_one_digit(codes: DataFrame, catalog: DataFrame, keys: list[str], code: str) -> DataFrame:
    """keys, barcode: catalog codes (with a right check digit) one digit away from the first 12 digits of a code.

    Only distinct codes are met, so that what is found is distinct but for keys of several codes.
    """
    told = codes.where(F.col(code).rlike(r"^\d{12}")).withColumn("__body", F.substring(code, 1, 12))
    near = one_digit_apart(told.select("__body").distinct(), catalog)
    found = lambda asked: meet(asked, near, "__body").select(*keys, F.col("__found").alias("barcode"))
    if code in keys:
        return found(told.select(*keys, "__body").distinct())
    bodies = told.groupBy(*keys).agg(F.collect_set("__body").alias("__bodies"))
    one = bodies.where(F.size("__bodies") == 1).select(*keys, F.col("__bodies")[0].alias("__body"))
    several = bodies.where(F.size("__bodies") > 1).select(*keys, F.explode("__bodies").alias("__body"))
    return found(one).unionByName(found(several).distinct())


UNREAD = "?"
TAIL = 7  # the last places of a code, by whose read ones codes and catalog meet


def _digit(code: Column, place: int) -> Column:
    return F.substring(code, place, 1)


def complete_unread(codes: DataFrame, catalog: DataFrame, keys: list[str], code: str, least_known: int = 6) -> DataFrame:
    """keys, code, barcode: codes of 13 places, some of them unread (``?``), as the one catalog code that agrees in all places read.

    At least ``least_known`` places must be read, and the catalog's code must have a right check digit; a code that
    none or several agree with is left out. The catalog is indexed by the masks of read places among the last seven that
    occur, at most 128 a code, and codes that agree there are counted by the places before those: a read code meets
    each such beginning once, however many codes have it. Mask and digits are one number, so that the index stays narrow.
    """
    told = codes.where(F.col(code).rlike(r"^[\d?]{13}$")).select(F.col(code).alias("read")).distinct().where(F.length(F.replace("read", F.lit(UNREAD), F.lit(""))) >= least_known)
    size, tail = 10**TAIL, range(13 - TAIL + 1, 14)
    bits = [2 ** (13 - i) for i in tail]
    mask = sum((F.when(_digit(F.col("read"), i) != UNREAD, bit).otherwise(0) for i, bit in zip(tail, bits, strict=True)), F.lit(0))
    digits = F.translate(F.substring("read", tail[0], TAIL), UNREAD, "0").cast("int")
    told = saved(told.withColumn("mask", mask).withColumn("key", F.col("mask") * size + digits).select("read", "mask", "key"))
    valid = catalog.where(ean_ok(F.col("barcode"))).select("barcode").distinct()
    valid = valid.select(F.substring("barcode", 1, 13 - TAIL).alias("head"), F.substring("barcode", tail[0], TAIL).cast("int").alias("tail"), *[_digit(F.col("barcode"), i).cast("int").alias(f"d{i}") for i in tail])
    shown = sum((F.when(F.col("mask").bitwiseAND(bit) > 0, F.col(f"d{i}") * 10 ** (13 - i)).otherwise(0) for i, bit in zip(tail, bits, strict=True)), F.lit(0))
    every = valid.crossJoin(F.broadcast(told.select("mask").distinct())).select((F.col("mask") * size + shown).alias("key"), "head", "tail")
    index = every.groupBy("key", "head").agg(F.count("*").alias("n"), F.min("tail").alias("tail"))
    met = told.select("key", "read").hint("merge").join(index.hint("merge"), "key")
    for i in range(1, tail[0]):
        met = met.where((_digit(F.col("read"), i) == UNREAD) | (_digit(F.col("read"), i) == _digit(F.col("head"), i)))
    full = F.concat("head", F.lpad(F.col("tail").cast("string"), TAIL, "0"))
    one = met.groupBy("key", "read").agg(F.sum("n").alias("n"), F.min(full).alias("barcode")).where("n = 1")
    return codes.select(*keys, F.col(code).alias("read")).hint("merge").join(one.select("read", "barcode").hint("merge"), "read").select(*keys, F.col("read").alias(code), "barcode")
