"""Small text and number expressions of reports, shards and text sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def escaped_line(text: Column) -> Column:
    r"""One line for each text: backslash, line feed and carriage return become \\, \n and \r."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def natural_key(name: str) -> list:
    """Sort key that compares runs of digits as numbers: shard_2 before shard_10."""
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", name) if x]


def natural_order(name: Column, width: int = 20) -> Column:
    """The same order as an expression: every run of digits padded with zeros."""
    runs = F.split(name, r"(?<=\D)(?=\d)|(?<=\d)(?=\D)")
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, width, "0")).otherwise(x)), "")


def throughput(n: Column, seconds: Column) -> Column:
    """Whole units a second; 0 when no time has passed."""
    return F.coalesce(F.floor(F.try_divide(n, seconds)), F.lit(0)).cast("bigint")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def shard_file(first: Column, last: Column) -> Column:
    return F.format_string("%010d-%010d.parquet", first, last)


def series_label(*parts: Column) -> Column:
    return F.concat_ws(" · ", *parts)


def config_label(backend: Column, dtype: Column, metric: Column, connectivity: Column, expansion_add: Column, expansion_search: Column, shards: Column) -> Column:
    """A series' name from its configuration: parts that are null are left out, expansions are shown together or not at all,
    and shards if there are several."""
    both = F.concat(F.lit("ef="), expansion_add.cast("string"), F.lit("/"), expansion_search.cast("string"))
    several = F.when(shards > 1, F.concat(shards.cast("string"), F.lit("s")))
    return series_label(F.coalesce(backend, F.lit("?")), dtype, metric, F.concat(F.lit("M="), connectivity.cast("string")), both, several)


def stored_key(name: Column, prefix: str) -> Column:
    """A key from its stored form; what cannot be read is the missing key 4294967295."""
    return F.coalesce(F.regexp_replace(name, f"^{re.escape(prefix)}", "").try_cast("bigint"), F.lit(4294967295))
