"""Names: aliases that must fit exactly one entry, numbers as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_aliases(names: DataFrame, name: str, aliases: dict[str, list[str]]) -> DataFrame:
    """(canonical, name): the one entry of ``names`` that each canonical name's aliases fit, letters of either case, white space trimmed.

    Raises, when run, if the aliases of a name fit no entry or several. Aliases are a
    parameter, so their table is broadcast.
    """
    spark = names.sparkSession
    table = spark.createDataFrame([(c, a.strip().lower()) for c, list_ in aliases.items() for a in list_], "canonical string, _alias string")
    entries = names.select(F.col(name), F.lower(F.trim(name)).alias("_alias")).distinct()
    found = entries.join(F.broadcast(table), "_alias").groupBy("canonical").agg(F.count_distinct(name).alias("_n"), F.min(name).alias(name))
    asked = table.select("canonical").distinct().join(found, "canonical", "left")
    one = F.coalesce("_n", F.lit(0)) == 1
    checked = F.when(one, F.col(name)).otherwise(F.raise_error(F.concat(F.lit("aliases must fit exactly one entry: "), F.col("canonical"))))
    return asked.select("canonical", checked.alias(name))


def with_separators(x: Column, digits: int = 2) -> Column:
    """Thousands parted by commas and a fixed number of digits."""
    return F.format_number(x, digits)


def logit(p: Column, edge: float = 1e-9) -> Column:
    q = F.greatest(F.lit(edge), F.least(F.lit(1 - edge), p))
    return F.log(q / (1 - q))


def tempered(p: Column, by: list[str], temperature: float) -> Column:
    """Shares made flatter (temperature above 1) or steeper, adding to 1 within ``by``: p ** (1 / t), normalised."""
    from pyspark.sql import Window as W

    raised = F.pow(p, F.lit(1 / temperature))
    return raised / F.sum(raised).over(W.partitionBy(*by))
