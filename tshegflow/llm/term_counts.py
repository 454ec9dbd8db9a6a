"""Occurrences and records of every distinct term, by last-seen counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Into how many parts the records of a term, and the occurrences of a record, are hashed, so that a term or a record that holds a third of all rows is counted by many tasks.
RECORD_BUCKETS, OCCURRENCE_BUCKETS = 64, 32
RARE_BELOW = 3
COMMON_SHARE = (1, 5)


def count_terms(rows: DataFrame, term: str, record: str, occurrence: str | None = None, buckets: int = RECORD_BUCKETS) -> DataFrame:
    """``(term, occurrences, records)`` for every distinct value of ``rows[term]``.

    Rows are combined to one for each term, record and part of the occurrence ids first; each part's rows are ordered by id, so that a counter only compares each
    id with the one it saw last. What is left is hash-partitioned by term and record bucket and ordered by record, and a counter for each term only compares each
    record with the one it saw last: no set of records or ids is ever held. A record falls into one bucket, hence the buckets' counts add up.

    ``occurrence`` names a row id: rows that repeat an id within a term and record count once. Rows with a null term are left out; the
    empty string is a term like any other. A null record adds occurrences but no record. A null occurrence id always counts. An empty table gives no rows.
    Other columns of ``rows`` are ignored, whatever their names. Records of a term, and ids of a term and record, are told apart by
    64-bit fingerprints: n of them are miscounted by one with a chance below n * n / 2 ** 65.
    """
    print_ = lambda name: F.when(F.col(name).isNotNull(), F.xxhash64(F.col(name).cast("string")))
    base = rows.where(F.col(term).isNotNull()).select(F.col(term).alias("term"), print_(record).alias("record"), (print_(occurrence) if occurrence else F.lit(None).cast("long")).alias("occurrence"))
    base = base.withColumn("bucket", F.pmod(F.xxhash64("record"), F.lit(buckets)).cast("int"))
    if occurrence is None:
        counted = base.groupBy("term", "bucket", "record").agg(F.count(F.lit(1)).alias("n"))
    else:
        parted = base.withColumn("part", F.pmod(F.xxhash64("occurrence"), F.lit(OCCURRENCE_BUCKETS)).cast("int"))
        last = Window.partitionBy("term", "bucket", "part").orderBy("record", "occurrence")
        same = F.col("occurrence").isNotNull() & F.lag("record").over(last).eqNullSafe(F.col("record")) & F.lag("occurrence").over(last).eqNullSafe(F.col("occurrence")) & (F.row_number().over(last) > 1)
        counted = parted.withColumn("again", same).where(~F.col("again")).groupBy("term", "bucket", "part", "record").agg(F.count(F.lit(1)).alias("n"))
    seen = Window.partitionBy("term", "bucket").orderBy("record")
    is_new = F.when(F.col("record").isNotNull() & ~F.lag("record").over(seen).eqNullSafe(F.col("record")), 1).otherwise(0)
    partial = counted.select("term", "bucket", "record", "n").withColumn("new", is_new).groupBy("term", "bucket").agg(F.sum("n").alias("occurrences"), F.sum("new").alias("records"))
    return partial.groupBy("term").agg(F.sum("occurrences").cast("long").alias("occurrences"), F.sum("records").cast("long").alias("records"))


def mark_terms(counts: DataFrame, total: DataFrame, rare_below: int = RARE_BELOW, common_share: tuple[int, int] = COMMON_SHARE) -> DataFrame:
    """``counts`` with ``is_rare`` (fewer than ``rare_below`` occurrences) and ``is_common`` (in more than ``common_share`` of all records).

    ``total`` holds one row with one column, the number of records; it is the only thing broadcast.
    """
    n, d = common_share
    one = total.select(F.col(total.columns[0]).alias("total_records"))
    return counts.crossJoin(F.broadcast(one)).select(
        "term", "occurrences", "records", (F.col("occurrences") < rare_below).alias("is_rare"), (F.col("records") * d > F.col("total_records") * n).alias("is_common")
    )


def term_frequencies(words: DataFrame, errors: DataFrame) -> DataFrame:
    """``(field, term, occurrences, records, is_rare, is_common)`` for ``word.times_seen`` and ``spell_errors.word``.

    ``error_word``: words as stored, the empty string left out, repeated rows (same ``id``) once, a record is a job.
    ``times_seen``: values as decimal strings, nulls left out, a record is a row.
    """
    named = errors.where(F.col("word") != "")
    jobs = errors.where(F.col("job_id").isNotNull()).groupBy("job_id").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("n"))
    by_word = mark_terms(count_terms(named, "word", "job_id", "id"), jobs).withColumn("field", F.lit("error_word"))
    valued = words.where(F.col("times_seen").isNotNull()).select(F.col("times_seen").cast("string").alias("value"), "id")
    by_seen = mark_terms(count_terms(valued, "value", "id"), valued.agg(F.count(F.lit(1)).alias("n"))).withColumn("field", F.lit("times_seen"))
    return by_word.unionByName(by_seen).select("field", "term", "occurrences", "records", "is_rare", "is_common")


def marked_terms(frequencies: DataFrame) -> DataFrame:
    """``(field, term, mark)``, one row for each mark that holds."""
    marks = F.array_compact(F.array(F.when(F.col("is_rare"), F.lit("rare")), F.when(F.col("is_common"), F.lit("common"))))
    return frequencies.select("field", "term", F.explode(marks).alias("mark"))
