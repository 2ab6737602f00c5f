"""Column names made from JSON paths."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.once import let

# Names every table already has.
RESERVED = ["line_no", "raw"]


def sanitize_key(path: Column) -> Column:
    name = F.lower(F.btrim(F.regexp_replace(path, "[^A-Za-z0-9]+", "_"), F.lit("_")))

    def safe(n: Column) -> Column:
        return (
            F.when(n == "", "value")
            .when(F.substring(n, 1, 1).between("0", "9"), F.concat(F.lit("field_"), n))
            .when(n.isin(*RESERVED), F.concat(F.lit("json_"), n))
            .otherwise(n)
        )

    return let(name, safe)


def sanitized(path: list[str]) -> str:
    """The same rule for one discovered path, on the driver."""
    name = re.sub("[^A-Za-z0-9]+", "_", "_".join(path)).strip("_").lower() or "value"
    name = f"field_{name}" if name[0].isdigit() else name
    return f"json_{name}" if name in RESERVED else name


def column_order(name: str) -> str:
    """Sort key: underscore before digits before letters."""
    return name.replace("_", " ")
