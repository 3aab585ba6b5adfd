"""Writes as DataFrame transformations: each takes a table and a change, and returns the table after it.

Tables are files, so a write is a new version of the table; every function is set-based.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import with_suffix
from .numbering import numbered

def same(a: str, b: str, keys: Sequence[str], null_safe: bool = False) -> Column:
    eq = lambda k: F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) if null_safe else F.col(f"{a}.{k}") == F.col(f"{b}.{k}")
    return reduce(and_, [eq(k) for k in keys])


def insert_rows(table: DataFrame, rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """rows, however many, get the next keys in their order, nulls first."""
    last = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))
    new = numbered(rows, [F.col(c) for c in order], "_n").join(F.broadcast(last)).withColumn(key, F.col("_last") + F.col("_n")).drop("_n", "_last")  # one row
    return table.unionByName(new, allowMissingColumns=True)


def update_rows(table: DataFrame, delta: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Whole-row update by key; delta has one row per key."""
    d = delta.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = table.join(d, list(keys), "left")
    changed = {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(changed).select(*table.columns)


def delete_rows(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), list(on), "left_anti").select(*table.columns)


def delete_cascade(tables: dict[str, DataFrame], links: Sequence[tuple[str, str, str, str]], root: str, key: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Deletes keys of root and what hangs on them; links: (parent, its key, child, its column), parents first."""
    dead = {root: tables[root].join(gone.select(key).distinct(), key, "left_semi")}
    out = tables | {root: delete_rows(tables[root], gone, [key])}
    for parent, parent_key, child, column in links:
        if parent in dead:
            lost = dead[parent].select(F.col(parent_key).alias(column)).distinct()
            fallen = out[child].join(lost, column, "left_semi")
            dead[child] = dead[child].unionByName(fallen) if child in dead else fallen
            out[child] = out[child].join(lost, column, "left_anti").select(*tables[child].columns)
    return out


def deletable(table: DataFrame, key: str, *references: DataFrame) -> DataFrame:
    """Rows that no reference uses; each reference has a column of the key's name."""
    return reduce(lambda df, r: df.join(r.select(key).distinct(), key, "left_anti"), references, table)


def keep_latest(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Upsert that replaces: of the rows of a key the last of `order` wins, new before old. order: a column of rows."""
    both = table.withColumn("_new", F.lit(0)).withColumn("_at", F.lit(None).cast(rows.schema[order].dataType))
    both = both.unionByName(rows.withColumn("_new", F.lit(1)).withColumn("_at", F.col(order)).select(*table.columns, "_new", "_at"))
    row = F.struct(*table.columns)
    best = both.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, F.struct("_new", "_at")).alias("_row"))
    return best.select(*[F.col("_row")[c].alias(c) for c in table.columns])


def keep_existing(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert that does nothing for known keys; repeated new keys come in once."""
    new = rows.join(table.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))
    return table.unionByName(new.select(*table.columns))


def toggle(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members go, others come: the symmetric difference of edge tables."""
    rows = rows.select(*keys).distinct()
    return table.select(*keys).join(rows, list(keys), "left_anti").unionByName(rows.join(table.select(*keys), list(keys), "left_anti"))


def three_way(table: DataFrame, rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A null value deletes, another one updates or inserts; rows have one row per key."""
    rest = table.join(rows.select(*keys), list(keys), "left_anti")
    return rest.unionByName(rows.filter(F.col(value).isNotNull()).select(*table.columns))


def import_rows(table: DataFrame, rows: DataFrame, keys: Sequence[str], columns: Sequence[str], position: str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """An upload merged by null-safe keys, as a loop over its rows would: the table after it and one row of counters.

    Of rows with one key the last position wins; the first of them counts as added where
    the key is new, every other as updated; rows that aren't valid are skipped. Rows are combined by key
    before the shuffle, so a key with very many is no burden.
    """
    ok = rows.filter(F.coalesce(valid, F.lit(False)))
    sent = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max_by(F.struct(*columns), F.col(position)).alias("_last"))
    known = table.select(*keys, F.lit(True).alias("_known")).distinct()
    judged = sent.alias("s").join(known.alias("t"), same("s", "t", keys, null_safe=True), "left")
    n_new = F.count_if(F.col("_known").isNull())
    done = judged.agg(n_new.alias("added"), (F.coalesce(F.sum("_n"), F.lit(0)) - n_new).alias("updated"))
    skipped = rows.agg(F.count_if(~F.coalesce(valid, F.lit(False))).alias("skipped"))
    counters = done.crossJoin(skipped)  # one row each
    both = table.alias("t").join(sent.alias("s"), same("t", "s", keys, null_safe=True), "full")
    value = lambda c: F.when(F.col("_n").isNotNull(), F.col("_last")[c]).otherwise(F.col(f"t.{c}")) if c in columns else F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")) if c in keys else F.col(f"t.{c}")
    return both.select(*[value(c).alias(c) for c in table.columns]), counters


def sync_stock(stock: DataFrame, looked_up: DataFrame) -> DataFrame:
    """Stock (shop_id, product_id, size_id, price, quantity) after sheets that have been looked up: a row without a reason replaces price and quantity, or comes in.

    Of rows for one shop and size the last position counts. synced tells the rows that came from a sheet. To sync the same sheets again changes nothing.
    """
    keys = ["shop_id", "product_id", "size_id"]
    taken = looked_up.filter("reason IS NULL").groupBy(*keys).agg(F.max_by(F.struct("price", "quantity"), "position").alias("_v"))
    both = stock.select(*keys, "price", "quantity").join(taken, keys, "full")
    value = lambda c: F.when(F.col("_v").isNotNull(), F.col("_v")[c]).otherwise(F.col(c)).alias(c)
    return both.select(*keys, value("price"), value("quantity"), F.col("_v").isNotNull().alias("synced"))


def insert_unless_duplicate(table: DataFrame, rows: DataFrame, keys: Sequence[str], dated: str, position: str) -> DataFrame:
    """rows to add: those whose keys are new, once; rows without a date always come in."""
    keyed = rows.filter(F.col(dated).isNotNull()).join(table.select(*keys), list(keys), "left_anti")
    first = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(position))).filter("_rank = 1").drop("_rank")
    return first.unionByName(rows.filter(F.col(dated).isNull()))


def set_only(table: DataFrame, group: str, key: str, chosen: DataFrame, flag: str) -> DataFrame:
    """The flag of each chosen (group, key) is set and all others of its group are cleared."""
    c = chosen.select(F.col(group), F.col(key).alias("_chosen"))
    joined = table.join(c, group, "left")
    value = F.when(F.col("_chosen").isNull(), F.col(flag)).otherwise((F.col(key) == F.col("_chosen")).cast("int"))
    return joined.withColumn(flag, value).select(*table.columns)


def promote_next(table: DataFrame, group: str, key: str, flag: str, at: str) -> DataFrame:
    """Groups without a flagged row get their oldest row flagged."""
    best = table.groupBy(group).agg(F.max(flag).alias("_has"), F.min_by(F.col(key), F.struct(at, key)).alias("_oldest"))
    joined = table.join(best, group)
    value = F.when((F.col("_has") == 0) & (F.col(key) == F.col("_oldest")), 1).otherwise(F.col(flag))
    return joined.withColumn(flag, value).select(*table.columns)


def toggle_flag(table: DataFrame, chosen: Column, flag: str) -> DataFrame:
    """The 0/1 flag of the chosen rows is turned over."""
    return table.withColumn(flag, F.when(chosen, F.when(F.col(flag) == 1, 0).otherwise(1)).otherwise(F.col(flag)))


def check_then_write(table: DataFrame, rows: DataFrame, keys: Sequence[str], columns: Sequence[str], position: str) -> tuple[DataFrame, DataFrame]:
    """An upload merged by keys that have to be there: rows without one are skipped, and counted as such."""
    whole = reduce(and_, [F.col(k).isNotNull() for k in keys])
    return import_rows(table, rows, keys, columns, position, whole)


def with_followups(wishes: DataFrame, used: DataFrame, keys: Sequence[str], deals: DataFrame, shops: DataFrame) -> dict[str, DataFrame]:
    """What goes with two inserts: used items end the wishes with their keys, and each deal writes a note of its shop."""
    left = wishes.join(used.select(*keys).distinct(), list(keys), "left_anti").select(*wishes.columns)
    more = F.concat(F.lit("product "), F.col("product_id").cast("string"))
    message = with_suffix(F.concat(F.col("discount").cast("string"), F.lit("% off")), more)
    notes = deals.join(shops.select("shop_id", "name"), "shop_id").select("deal_id", "shop_id", F.lit("deal").alias("type"), F.concat(F.lit("New deal at "), F.col("name")).alias("title"), message.alias("message"))
    return {"wishes": left, "notes": notes}
