"""Field search by an inverted index of trigrams.

``build`` writes the rows of all tables once, numbered inside their parts, and
postings: for each field and trigram, the numbers of its rows, sorted and
stored as differences, in folders by bucket of the trigram. ``search`` reads
only the buckets of the query's trigrams, starts with the rarest one, keeps
rows that hold the next, and applies the query's own rule to the rows that are
left, so that results equal those of the scan (``incidents.field_search``).
Terms of fewer than three characters and comparisons have no trigrams; a query
without any other term reads all rows.

Postings are dealt by bucket and part, so a trigram that every row has is spread
over all parts. Null values are in no posting; repeated rows and ids are
rows of their own; empty tables add nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.operators.incidents import field_search, parse_query

GRAM = 3
BUCKETS = 64


def _bucket(field: Column, gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(field, gram), F.lit(buckets)).cast("int")


def _grams(value: Column) -> Column:
    starts = F.sequence(F.lit(1), F.length(value) - (GRAM - 1))
    return F.array_distinct(F.transform(starts, lambda k: F.substring(value, k, F.lit(GRAM))))


def build(tables: dict[str, DataFrame], path: str, *, buckets: int = BUCKETS) -> None:
    """Index tables with columns id, title and any others under ``path``."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        fields = F.create_map(*(x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))))
        rows.append(df.select(F.lit(name).alias("table"), fields.alias("fields")))
    every = reduce(lambda a, b: a.unionByName(b), rows)
    every.select(F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("row"), "table", "fields").write.partitionBy("part").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    values = stored.select("part", "row", "table", F.explode("fields").alias("field", "value")).withColumn("value", F.lower("value")).filter(F.length("value") >= GRAM)
    grams = values.select("part", "row", "table", "field", F.explode(_grams(F.col("value"))).alias("gram"))
    out = grams.withColumn("bucket", _bucket(F.col("field"), F.col("gram"), buckets)).repartition("bucket", "part").sortWithinPartitions("bucket", "field", "gram", "table", "part", "row")
    # The second format version stores sorted numbers as differences; its statistics let a read skip other trigrams.
    out.write.option("parquet.writer.version", "PARQUET_2_0").partitionBy("bucket").parquet(f"{path}/postings")


def terms(query: str) -> list[tuple[str, str]]:
    """(field, trigram) of all terms that have trigrams."""
    named, free = parse_query(query)
    words = [(k, v) for k, v in named.items() if v[0] not in "<>"] + [("title", v) for v in free]
    return sorted({(k, v[i : i + GRAM]) for k, v in words for i in range(len(v) - GRAM + 1)})


def candidates(spark: SparkSession, path: str, query: str, *, buckets: int = BUCKETS, most: int = 4) -> DataFrame | None:
    """(table, part, row) of rows that hold the query's ``most`` rarest trigrams; None where it has none. The rest is for the query's rule."""
    wanted = terms(query)
    if not wanted:
        return None
    numbers = [r[0] for r in spark.createDataFrame(wanted, "field string, gram string").select(_bucket(F.col("field"), F.col("gram"), buckets)).distinct().collect()]
    postings = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(numbers))
    held = postings.filter(reduce(lambda a, b: a | b, ((F.col("field") == k) & (F.col("gram") == g) for k, g in wanted)))
    # One row for each trigram of the query.
    counts = {(r.field, r.gram): r.n for r in held.groupBy("field", "gram").agg(F.count("*").alias("n")).collect()}
    order = sorted(wanted, key=lambda t: (counts.get(t, 0), t))[:most]
    lists = [held.filter((F.col("field") == k) & (F.col("gram") == g)).select("table", "part", "row") for k, g in order]
    return reduce(lambda a, b: a.join(b, ["table", "part", "row"], "left_semi"), lists)


def search(spark: SparkSession, path: str, query: str, *, buckets: int = BUCKETS) -> DataFrame:
    """Rows (table, id, title) that the query finds."""
    rows = spark.read.parquet(f"{path}/rows")
    found = candidates(spark, path, query, buckets=buckets)
    if found is not None:
        rows = rows.join(found, ["table", "part", "row"], "left_semi")
    named, _ = parse_query(query)
    # A column that a table doesn't have is no empty value.
    has = reduce(lambda a, k: a & F.map_contains_key("fields", F.lit(k)), named, F.lit(True))
    flat = rows.filter(has).select("table", *(F.col("fields")[k].alias(k) for k in sorted({"id", "title", *named})))
    return field_search({"": flat.withColumnRenamed("table", "_table")}, query, name_col="_table")
