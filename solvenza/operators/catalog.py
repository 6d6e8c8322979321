"""Company search, watchlist membership and managed lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from solvenza.functions import scalars as S
from solvenza.operators.skew import SPLIT_ROWS, join_split
from solvenza.session import spread, written


def search(catalog: DataFrame, query: str) -> DataFrame:
    """Companies whose name contains the query as literal text, whatever the case.

    A blank query finds nothing. Only the blank test trims: a leading space is
    part of what is searched for.
    """
    term = F.lit(query)
    return catalog.filter(~S.is_blank(term) & S.contains_ignoring_case(F.col("name"), term))


def search_count(catalog: DataFrame, query: str) -> DataFrame:
    return search(catalog, query).agg(F.count(F.lit(1)).alias("n_results")).withColumn(
        "is_empty", F.col("n_results") == 0
    )


def search_flagged(catalog: DataFrame, watchlist: DataFrame, query: str) -> DataFrame:
    """Search hits with a flag for those already on the watchlist."""
    listed = watchlist.select("name").distinct().withColumn("_listed", F.lit(True))
    return search(catalog, query).join(listed, "name", "left").select(
        "name", "industry", F.coalesce("_listed", F.lit(False)).alias("is_added")
    )


_LONGEST_GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)
    )


def _grams_of_sizes(text: Column, sizes: Column) -> Column:
    none = F.array().cast("array<string>")
    per_size = [
        F.when(F.array_contains(sizes, n) & (F.length(text) >= n), _grams(text, F.lit(n))).otherwise(none)
        for n in range(1, _LONGEST_GRAM + 1)
    ]
    return F.array_distinct(F.concat(*per_size))


def search_bulk(catalog: DataFrame, terms: DataFrame) -> DataFrame:
    """Every (term, company) pair that ``search`` would find, for many terms at once.

    An equi-join in place of comparing all pairs: names are cut into their character
    sequences of up to three characters, each term is looked up under its rarest one in
    the catalog, and the candidates are verified. Terms shorter than three characters are
    a whole sequence themselves, so no pair is missed.

    Sequences are counted in the tasks that cut the names. The names are then cut again,
    and only those sequences leave the task that a term is looked up under: these lie in
    tables whose size is known, so few go to every task and no name is shuffled; with many
    terms both sides are, and then the partition of a sequence that most names have is split.
    """
    wanted = terms.filter(~S.is_blank(F.col("term"))).select("term").distinct()
    wanted = wanted.withColumn("_needle", F.lower("term"))
    size = F.least(F.length("_needle"), F.lit(_LONGEST_GRAM))
    # At most three numbers: no sequences shorter than they have to be.
    sizes = wanted.agg(F.collect_set(size)).scalar()
    # Cut twice but read once.
    names = spread(written(catalog.select("name", F.lower("name").alias("_low")), "search-names"))
    every = names.select("*", F.explode(_grams_of_sizes(F.col("_low"), sizes)).alias("_gram"))
    asked = wanted.select("*", F.explode(F.array_distinct(_grams(F.col("_needle"), size))).alias("_gram"))
    frequency = every.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    rarest = (
        asked.join(frequency, "_gram", "left")
        .groupBy("term", "_needle")
        .agg(F.min_by("_gram", F.struct(n, "_gram")).alias("_gram"), F.min(n).alias("_n"))
    )
    # A sequence that no name has ends the search of its term.
    rarest = written(rarest.filter("_n > 0").drop("_n"), "search-rarest")
    used = written(rarest.select("_gram").distinct(), "search-sequences")
    return (
        every.join(used, "_gram", "left_semi")
        .join(rarest, "_gram")
        .filter(F.contains("_low", "_needle"))
        .select("term", "name")
    )


def classify_requests(
    requests: DataFrame, watchlist: DataFrame, catalog: DataFrame, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Outcome of each add request, as if they were applied one after the other.

    ``already_added`` when the name is on the list, else ``unknown`` when it is not
    in the catalog, else ``added``. The first request for a new name adds it, later
    ones find it there. The rule is decided once per name from a map-side combined
    minimum, and joined back with the requests of a frequent name split, so repeats of
    one name are neither sorted nor joined in one task.
    """
    first = written(requests.groupBy("name").agg(
        F.min_by("request_id", S.moment("request_ts", "request_id")).alias("_first_id"),
        F.count(F.lit(1)).alias("n"),
    ), "request-names")
    listed = watchlist.select("name").distinct().withColumn("_listed", F.lit(True))
    known = catalog.select("name").distinct().withColumn("_known", F.lit(True))
    rules = first.drop("n").join(listed, "name", "left").join(known, "name", "left")
    outcome = (
        F.when(F.col("_listed"), F.lit("already_added"))
        .when(F.col("_known").isNull(), F.lit("unknown"))
        .when(F.col("request_id") == F.col("_first_id"), F.lit("added"))
        .otherwise(F.lit("already_added"))
    )
    decided = join_split(requests, rules, first, "name", F.col("request_id"), split_rows)
    return decided.select("request_id", "request_ts", "name", outcome.alias("outcome"))


def on_watchlist(catalog: DataFrame, watchlist: DataFrame) -> DataFrame:
    return catalog.join(watchlist.select("name"), "name", "left_semi")


def not_on_watchlist(requests: DataFrame, watchlist: DataFrame) -> DataFrame:
    """The requested names, each once, that the watchlist does not hold."""
    return requests.select("name").distinct().join(watchlist.select("name"), "name", "left_anti")


def append_new(watchlist: DataFrame, requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """The watchlist after the requests: its rows, then each new catalog name once."""
    added = (
        requests.groupBy("name").agg(F.min("request_ts").alias("added_ts"))
        .join(watchlist.select("name"), "name", "left_anti")
        .join(catalog.select("name"), "name", "left_semi")
    )
    kept = watchlist.select("name", F.lit(None).cast("timestamp_ntz").alias("added_ts"))
    return kept.unionByName(added)


def add_to_managed(stored: Column, name: Column) -> Column:
    """The stored JSON list with ``name`` at its end unless it is in it already.

    NULL and empty text are an empty list. Text that is no JSON list of texts stays as it
    is: nothing is written over what can't be read.
    """
    empty = F.coalesce(S.trim_spaces(stored) == "", F.lit(True))
    names = F.when(empty, F.array().cast("array<string>")).otherwise(F.from_json(stored, "array<string>"))
    after = F.to_json(
        F.when(F.array_contains(names, name), names).otherwise(F.array_append(names, name))
    )
    return F.when(names.isNull(), stored).otherwise(after)
