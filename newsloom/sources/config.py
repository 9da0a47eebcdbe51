"""Feed schedules and trusted sources, both kept as JSON arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fixed
from newsloom.functions.basics import is_blank, or_default, trimmed
from newsloom.functions.dates import valid_time

# every field is read as text first, so one odd value does not void its row
_RAW_FEED = (
    "array<struct<id:string,enabled:string,feed_url:string,time:string,quantity:string,"
    "category:string,translate:string,post_status:string,last_run:string>>"
)
_RAW_SOURCE = "array<struct<domain:string,name:string>>"


def truthy(value) -> Column:
    """JSON values that count as on: not null, false, 0, '0' or ''."""
    return ~(is_blank(value) | (value == "false"))


def leading_int(value: Column) -> Column:
    """The integer a text starts with, 0 when there is none."""
    digits = F.regexp_extract(value, r"^\s*([+-]?\d{1,9})", 1)
    return F.when(digits != "", digits.cast("int")).otherwise(
        F.when(value == "true", 1).otherwise(0)
    )


def clamp_quantity(value: Column) -> Column:
    return F.greatest(F.lit(fixed.QUANTITY_MIN), F.least(F.lit(fixed.QUANTITY_MAX), value))


def feed_config(table: DataFrame, json: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """Sanitized schedule rows, in array order (``feed_pos``).

    Entries without an address are dropped; a missing id is made from the
    entry's own text and place, so a second run gives the same one.
    """
    rows = table.select(
        *keep, F.posexplode(F.from_json(F.col(json), _RAW_FEED)).alias("_pos", "f")
    )
    f = F.col("f")
    raw = [F.coalesce(f[name], F.lit("")) for name in ("feed_url", "time", "quantity", "category", "post_status")]
    made_id = F.concat(F.lit("feed_"), F.md5(F.concat_ws("|", F.col("_pos").cast("string"), *raw)))
    url = F.when(~is_blank(f["feed_url"]), trimmed(f["feed_url"]))
    quantity = F.when(f["quantity"].isNull(), F.lit(1)).otherwise(clamp_quantity(leading_int(f["quantity"])))
    return rows.where(F.coalesce(url, F.lit("")) != "").select(
        *keep,
        F.col("_pos").cast("long").alias("feed_pos"),
        or_default(f["id"], made_id).alias("id"),
        truthy(f["enabled"]).alias("enabled"),
        url.alias("feed_url"),
        valid_time(or_default(f["time"], F.lit(fixed.DEFAULT_TIME))).alias("time"),
        quantity.cast("int").alias("quantity"),
        F.when(f["category"].isNull(), F.lit(0)).otherwise(leading_int(f["category"])).cast("int").alias("category"),
        truthy(f["translate"]).alias("translate"),
        or_default(f["post_status"], F.lit("publish")).alias("post_status"),
        or_default(f["last_run"], F.lit("")).alias("last_run"),
    )


def trusted_sources(table: DataFrame, json: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """Entries that have both a domain and a name."""
    rows = table.select(*keep, F.explode(F.from_json(F.col(json), _RAW_SOURCE)).alias("s"))
    return rows.where(F.col("s.domain").isNotNull() & F.col("s.name").isNotNull()).select(
        *keep, trimmed(F.col("s.domain")).alias("domain"), trimmed(F.col("s.name")).alias("name")
    )
