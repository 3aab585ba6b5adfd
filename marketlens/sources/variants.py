"""Records anywhere in JSON documents, found level by level over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEEPEST = 8


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


class _Field:
    """A field of an object as the page's own script would read it."""

    def __init__(self, v: Column, name: str) -> None:
        self.value = F.try_variant_get(v, f"$.{name}", "variant")
        self.kind = _kind(self.value)
        self.text = F.try_variant_get(v, f"$.{name}", "string")
        self.truthy = F.coalesce(
            ~self.kind.isin("VOID", "STRING", "BOOLEAN") & F.coalesce(F.try_variant_get(v, f"$.{name}", "double") != 0, F.lit(True))
            | (self.kind == "STRING") & (self.text != "") | (self.kind == "BOOLEAN") & (self.text == "true"),
            F.lit(False),
        )
        self.string = F.when(self.kind == "STRING", self.text).otherwise("")


def _first(v: Column, *names: str, strings: bool = True) -> Column:
    """The first field that isn't empty, null, 0 or false; empty if it is no text and texts are asked for."""
    fields = [_Field(v, n) for n in names]
    return F.coalesce(*[F.when(f.truthy, f.string if strings else f.text) for f in fields], F.lit(""))


def _records(level: DataFrame) -> DataFrame:
    """Of the objects of a level those with a businessUrl and a name of 3 to 79 characters."""
    v = F.col("v")
    name = _Field(v, "name")
    site = F.regexp_replace(_first(v, "website", "websiteUrl"), r"\?.*$", "")
    found = level.filter((name.kind == "STRING") & F.length(name.text).between(3, 79) & _Field(v, "businessUrl").truthy)
    return found.select(
        "id", "path", "depth", name.text.alias("name"), _Field(v, "businessUrl").text.alias("url"), F.split(_first(v, "address", "formattedAddress"), "\n")[0].alias("address"), _first(v, "city").alias("city"), _first(v, "state").alias("state"),
        _first(v, "zip", "postalCode", strings=False).alias("zip"), _first(v, "phone", "phoneNumber", "formattedPhone").alias("phone"), site.alias("website"),
        _first(v, "rating", "businessRating", strings=False).alias("rating"), _first(v, "reviewCount", strings=False).alias("reviews"),
    )


def _down(rows: DataFrame) -> DataFrame:
    """rows (open: not gone into yet) and, one level down from the open ones, the objects and arrays among their values; a value's items if it is an array."""
    tvf = rows.sparkSession.tvf
    twice = rows.withColumn("_self", F.explode(F.array(F.lit(True), F.lit(False)))).filter("_self OR open")
    inner = F.when(~F.col("_self"), F.col("v"))
    below = twice.lateralJoin(tvf.variant_explode_outer(inner.outer())).select(*rows.columns, "_self", F.col("pos").alias("_at"), F.col("value").alias("_v"))
    array = F.coalesce(_kind(F.col("_v")).like("ARRAY%"), F.lit(False))
    below = below.withColumn("_array", array).filter(F.col("_self") | F.col("_array") | _kind(F.col("_v")).like("OBJECT%"))
    items = below.lateralJoin(tvf.variant_explode_outer(F.when(F.col("_array"), F.col("_v")).outer()))
    v = F.when(F.col("_self"), F.col("v")).when(F.col("_array"), F.col("value")).otherwise(F.col("_v"))
    path = F.when(F.col("_self"), F.col("path")).otherwise(F.concat("path", F.array("_at", F.coalesce("pos", F.lit(0)))))
    depth = F.col("depth") + F.when(F.col("_self"), 0).otherwise(1)
    out = items.select("id", path.alias("path"), depth.alias("depth"), v.alias("v"), (~F.col("_self")).alias("open"))
    return out.filter("NOT open OR schema_of_variant(v) LIKE 'OBJECT%' OR schema_of_variant(v) LIKE 'ARRAY%'")


def json_records(rows: DataFrame, depth: int = DEEPEST) -> DataFrame:
    """(id, json) -> id, path, depth and fields of the businesses up to `depth` levels down; null and malformed texts have none.

    A level is an object's or array's value; the items of an array that is a value are on that value's level. path orders a document's records from the top
    down: arrays keep their order, an object's fields go by name, as VARIANT keeps them. It is one pass without a shuffle: each level goes into
    the rows that the one before has opened.
    """
    found = rows.select("id", F.array().cast("array<int>").alias("path"), F.lit(0).alias("depth"), F.try_parse_json("json").alias("v"), F.lit(True).alias("open"))
    for _ in range(depth):
        found = _down(found)
    return _records(found)
