"""Matching names of an upload with the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import parse_count, parse_price
from ..functions.text import collapsed, join_present, plain, similarity
from .kept import kept
from .numbering import numbered

#: Rounds of a search, best first: the least similarity, and the length of the grams by which names meet.
ROUNDS = ((0.85, 2), (0.7, 2), (0.4, 1), (0.0, 1))
#: A row looks up so many grams more than it has to, and meets a text only by so many.
MEETINGS = 4
#: Matches of distinct texts go to each task of the wanted rows up to so many rows and bytes.
FEW_ROWS, FEW_BYTES = 20_000, 16 << 20
#: The index goes to each task up to so many characters of known texts.
FEW_CHARACTERS = 200_000
#: A task of a round gets about so many meetings of a wanted text's grams with the index; up to MOST_TASKS tasks, beyond which they grow.
MEETINGS_A_TASK, MOST_TASKS = 1_000_000, 20_000


def grams(names: DataFrame, key: str, q: int) -> DataFrame:
    """(key, text) -> key, gram, j: each run of q (1 or 2) characters, the j-th of its kind in the text."""
    letters = F.filter(F.split("text", ""), lambda c: c != "")
    runs = names.select(key, letters.alias("_c"))
    if q == 2:
        runs = runs.select(key, F.filter(F.zip_with("_c", F.slice("_c", 2, F.greatest(F.size("_c") - 1, F.lit(0))), lambda a, b: F.concat(a, b)), lambda g: g.isNotNull()).alias("_c"))
    counted = runs.select(key, F.explode("_c").alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("_n"))
    return counted.select(key, "gram", F.explode(F.sequence(F.lit(1), "_n")).alias("j"))


def best_match(wanted: DataFrame, known: DataFrame, least: float = 0.0) -> DataFrame:
    """(row, text) against (id, text), both plain: row, id, known and score of the most similar text of each row that has any.

    The same as comparing all with all, ties to the smallest id, scores of 0 or under `least` left out; but texts meet by an inverted index of
    grams. Of two texts with a similarity of s or more, the longer has M characters and they share at least M - q + 1 - q(1 - s)M
    grams, t say, so they share k of the row's rarest grams, all but t - k; k is MEETINGS or t. Rounds go from similar to unlike: a row
    whose best reaches the round's similarity is done, and only the others go on, so the frequent grams are looked up for few rows. Lengths bound
    the candidates, and the edit distance is worked out only up to what the round allows. Equal texts are looked up once; a frequent gram's rows are split
    by adaptive execution. Meetings are counted before they are made, and tasks follow them, as they grow with the product of the texts on both sides.
    """
    known = kept(known.filter("text <> ''").groupBy("text").agg(F.min("id").alias("id")))
    open_ = kept(wanted.filter("text <> ''").select("text").distinct())
    left, parts = open_.count(), int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done: list[DataFrame] = []
    texts, n_bytes = left, 0
    few = (known.agg(F.sum(F.length("text")).alias("n")).first().n or 0) <= FEW_CHARACTERS
    for similar, q in dict.fromkeys((max(similar, least), q) for similar, q in ROUNDS):
        index = grams(known, "id", q)
        often = index.groupBy("gram", "j").agg(F.count(F.lit(1)).alias("_often"))
        n = F.length("text")
        shared = F.ceil(n * (1 - q * (1 - similar)) - q + 1 - 1e-9) if similar > 0 else F.lit(1)
        asked = open_.withColumn("_least", F.least(shared, F.lit(MEETINGS))).filter("_least >= 1").withColumn("_keep", n - q + 1 - shared + F.col("_least"))
        ranked = grams(asked, "text", q).join(often, ["gram", "j"], "left").withColumn("_rank", F.row_number().over(Window.partitionBy("text").orderBy(F.asc_nulls_first("_often"), "gram", "j")))
        probes = ranked.join(asked.select("text", "_keep", "_least"), "text").filter("_rank <= _keep AND _often > 0").select("text", "gram", "j", "_least", "_often")
        probes = kept(probes)
        meetings = probes.agg(F.sum("_often").alias("n")).first().n or 0
        n_tasks = min(max(parts + 1, -(-meetings // MEETINGS_A_TASK)), MOST_TASKS)  # few bytes but much work: not to be coalesced, and a number of its own, as Spark leaves out a dealing that rows have already and coalesces that one
        probes, texts_known = probes.drop("_often"), known.withColumnRenamed("text", "known")
        if few:
            met = probes.repartition(n_tasks, "text").join(F.broadcast(index), ["gram", "j"])
        else:
            met = probes.join(index, ["gram", "j"]).select("text", "id", "_least").repartition(n_tasks, "text")
        pairs = met.groupBy("text", "id").agg(F.count(F.lit(1)).alias("_met"), F.first("_least").alias("_least")).filter("_met >= _least")
        both = pairs.join(F.broadcast(texts_known), "id") if few else pairs.repartition(n_tasks, "id").join(texts_known, "id")
        a, b = F.length("text"), F.length("known")
        near = both.filter((b >= a * similar - 1e-9) & (b * similar <= a + 1e-9))
        allowed = f"CAST(floor({1 - similar!r} * greatest(length(text), length(known)) + 1e-9) AS INT)"
        scored = near.withColumn("_d", F.expr(f"levenshtein(text, known, {allowed})")).filter("_d >= 0").withColumn("score", 1.0 - F.col("_d") / F.greatest(a, b))
        found = scored.filter("score > 0").groupBy("text").agg(F.max_by(F.struct("id", "known", "score"), F.struct("score", -F.col("id"))).alias("m"))
        done.append(kept(found.select("text", "m.*").repartition("text")))  # a few bytes from each of many tasks
        open_ = open_.join(done[-1], "text", "left_anti")
        size = done[-1].agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text") + F.octet_length("known")), F.lit(0)).alias("b")).first()
        left, n_bytes = left - size.n, n_bytes + size.b
        if not left:
            break
    matched = reduce(DataFrame.unionByName, done)  # never the wanted rows are sent to all tasks, however few Spark takes them for
    matched = F.broadcast(matched) if texts - left <= FEW_ROWS and n_bytes <= FEW_BYTES else matched.hint("merge")
    return wanted.select("row", "text").join(matched, "text").select("row", "id", "known", "score")


def fuzzy_best(upload: DataFrame, catalogue: DataFrame, least: float = 0.0) -> DataFrame:
    """(row, name) of an upload against (product_id, name): the most similar product of each row.

    Ties go to the smallest product_id; a score of 0 or under `least` is no match. Null names are like nothing.
    """
    names = catalogue.groupBy(plain(F.col("name")).alias("known")).agg(F.min_by("name", "product_id").alias("match_name"), F.min("product_id").alias("id"))
    best = best_match(upload.select("row", plain(F.col("name")).alias("text")), names.select("id", F.col("known").alias("text")), least)
    found = upload.join(best.join(names, ["id", "known"]), "row", "left")
    return found.select("row", "name", F.col("id").alias("product_id"), "match_name", F.floor(F.coalesce("score", F.lit(0.0)) * 100 + 0.5).alias("confidence"))


def import_preview(upload: DataFrame, products: DataFrame, sizes: DataFrame, least: float = 0.0) -> DataFrame:
    """An upload (position, brand, name, size, price, quantity; texts) as it is shown before it is imported.

    Rows without brand and name are passed over, and the others numbered from 0 in their order. A row's brand and name together meet the products' brand and name
    (product_id, brand, name), and its size, if any, the sizes of the product found (product_id, size_id, size_name).
    """
    texts = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("brand", "name", "size")}
    asked = upload.select("position", *[t.alias(c) for c, t in texts.items()], parse_price(F.col("price")).alias("price"), parse_count(F.col("quantity"), 0).alias("quantity"))
    rows = kept(numbered(asked.filter("brand <> '' OR name <> ''"), [F.col("position")], "row", start=0))
    catalogue = products.select(F.col("product_id").alias("id"), plain(F.concat(F.coalesce("brand", F.lit("")), F.lit(" "), F.coalesce("name", F.lit("")))).alias("text"))
    best = best_match(rows.select("row", plain(join_present(" ", F.col("brand"), F.col("name"))).alias("text")), catalogue, least)
    matched = kept(rows.join(best.select("row", F.col("id").alias("product_id"), "score"), "row", "left"))
    chosen = second_stage(matched.select("row", "product_id", "size"), sizes).drop("product_id")
    named = products.select("product_id", F.col("brand").alias("match_brand"), F.col("name").alias("match_name"))
    out = matched.join(chosen, "row", "left").join(named, "product_id", "left")
    confidence = F.floor(F.col("score") * 100 + 0.5).alias("confidence")
    return out.select("row", "brand", "name", "size", "price", "quantity", "product_id", "match_brand", "match_name", confidence, "size_id", "size_name", "size_confidence")


def second_stage(matched: DataFrame, sizes: DataFrame) -> DataFrame:
    """(row, product_id, size) of matched rows against (product_id, size_id, size_name): of the matched product's sizes the most similar one.

    Ties go to the smallest size_id; a row without a product, a size or any similarity has none.
    """
    pairs = matched.filter(F.coalesce("size", F.lit("")) != "").join(sizes, "product_id")
    scored = pairs.withColumn("score", similarity(plain(F.col("size")), plain(F.col("size_name")))).filter("score > 0")
    best = scored.groupBy("row").agg(F.max_by(F.struct("size_id", "size_name", "score"), F.struct("score", -F.col("size_id"))).alias("m"))
    out = matched.join(best, "row", "left")
    return out.select("row", "product_id", F.col("m.size_id").alias("size_id"), F.col("m.size_name").alias("size_name"), F.floor(F.col("m.score") * 100 + 0.5).alias("size_confidence"))


def sheet_lookup(rows: DataFrame, products: DataFrame, sizes: DataFrame) -> DataFrame:
    """A shop's sheet (position, brand, name, size, price, quantity; texts) against (product_id, brand, name) and (product_id, size_id, size_name).

    All three are compared in their collapsed forms; of equal products, and of equal sizes of the product, the smallest id is meant. Each row gets its product, size, price, quantity
    (null where it is blank) and the reason for which it isn't taken, the first that applies, or null: missing (brand, name or size), not found, size not in
    catalogue, invalid price (none, or 0). Rows without brand and name are passed over; other columns stay.
    """
    blank = lambda c: F.coalesce(collapsed(F.col(c)), F.lit(""))
    keyed = rows.withColumns({"_b": blank("brand"), "_n": blank("name"), "_s": blank("size")}).filter("_b <> '' OR _n <> ''")
    p = products.groupBy(blank("brand").alias("_b"), blank("name").alias("_n")).agg(F.min("product_id").alias("product_id"))
    z = sizes.groupBy("product_id", blank("size_name").alias("_s")).agg(F.min("size_id").alias("size_id"))
    found = keyed.join(p, ["_b", "_n"], "left").join(z, ["product_id", "_s"], "left")
    found = found.withColumns({"price": parse_price(F.col("price")), "quantity": parse_count(F.col("quantity"))})
    reason = (
        F.when((F.col("_b") == "") | (F.col("_n") == "") | (F.col("_s") == ""), "missing").when(F.col("product_id").isNull(), "not found")
        .when(F.col("size_id").isNull(), "size not in catalogue").when(F.col("price").isNull(), "invalid price")
    )
    return found.withColumn("reason", reason).select(*rows.columns, "product_id", "size_id", "reason")


def exact_lookup(rows: DataFrame, products: DataFrame, shops: DataFrame) -> DataFrame:
    """(row, product, shop, price) with a reason for each row: the first that applies of four, or matched.

    Names meet in their collapsed form; of products of one form the smallest id is meant.
    """
    p = products.groupBy(collapsed(F.col("name")).alias("_p")).agg(F.min("product_id").alias("product_id"))
    s = shops.groupBy(collapsed(F.col("name")).alias("_s")).agg(F.min("shop_id").alias("shop_id"))
    keyed = rows.withColumns({"_p": collapsed(F.col("product")), "_s": collapsed(F.col("shop"))})
    reason = (
        F.when(F.coalesce(F.col("_p"), F.lit("")) == "", "blank").when(F.col("product_id").isNull(), "unknown product")
        .when(F.col("shop_id").isNull(), "unknown shop").when(F.col("price").isNull(), "no price").otherwise("matched")
    )
    return keyed.join(p, "_p", "left").join(s, "_s", "left").select("row", "product_id", "shop_id", "price", reason.alias("reason"))
