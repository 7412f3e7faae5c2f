"""Bottom-k sketches of word shingles, on built-in Spark functions only.

A fingerprint is the ascending array of the k smallest distinct 64-bit hashes of a text's five-word
shingles (words: lower case, parted by white space). Sketches of parts merge into the sketch of the whole,
and two sketches estimate resemblance, containment and the number of distinct shingles.

Defined results: a null text is an empty text; a text without words has the empty sketch; one with fewer
words than a shingle has one shingle of all its words. Two empty sketches resemble each other by 1, an
empty and a non-empty one by 0. Up to k distinct shingles every estimate is exact. Repeated rows each keep
their own result. Columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORDS_PER_SHINGLE
from .ranges import bounds, bucket, first_key

K = 256
#: Buckets of neighbouring documents for each shuffle partition.
BUCKETS_PER_PARTITION = 4


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, n: int = WORDS_PER_SHINGLE) -> DataFrame:
    """Add the sketch of the column text as the column out.

    The word hashes get a projection of their own, as the lambda below uses them at several places.
    """
    hashes = f"__{out}_words"
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+")
    df = df.withColumn(hashes, F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))
    h = F.col(hashes)
    tuples = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, n)]))
    whole = F.slice(tuples, F.lit(1), F.greatest(F.size(h) - F.lit(n - 1), F.lit(1)))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(whole)), 1, k)).drop(hashes)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches describe."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1."""
    u = merge(a, b, k)
    both = F.size(F.array_intersect(u, F.array_intersect(a, b)))
    return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both.cast("double") / F.size(u))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1 (1 where a is empty)."""
    u = merge(a, b, k)
    mine = F.size(F.array_intersect(u, a))
    both = F.size(F.array_intersect(u, F.array_intersect(a, b)))
    return F.when(mine == 0, F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(both.cast("double") / mine)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    last = (F.get(a, F.lit(k - 1)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / last)


def encoded(a: Column) -> Column:
    """Text form of a sketch: 16 hexadecimal digits a hash, ascending."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def merge_parts(df: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """One sketch a key from the sketches of its parts.

    Only hashes that are among the k smallest of their group travel: the rank filter is applied before the
    shuffle too, first by key and salt, so one key may hold most of the rows.
    """
    rows = df.select(F.col(key), F.explode_outer(sketch).alias("__h"))
    rows = rows.distinct().withColumn("__salt", F.pmod(F.col("__h"), F.lit(64)))
    for by in ([key, "__salt"], [key]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("__h").asc_nulls_last()))
        rows = rows.withColumn("__r", rank).filter(F.col("__r") <= k).drop("__r")
    return rows.groupBy(key).agg(F.sort_array(F.collect_list("__h")).alias(sketch))


def with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (null: empty), next text in ascending doc_id (after the last: the first) and __order for later windows.

    Rows go to buckets of neighbours, so the text is shuffled once and no task sees more than its buckets. The
    bucket bounds are rows that exist; such a row is also copied, as a ghost, to the bucket before it. Null ids
    come first; equal ids are ordered by a hash of their text, and repeated rows follow one another.
    """
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("__h", F.xxhash64("text"))
    keys = ["doc_id", "__h"]
    of = bounds(rows, keys, BUCKETS_PER_PARTITION * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    rows = rows.withColumn("__b", bucket(of, keys))
    key = F.struct(*keys)
    is_bound = (F.col("__b") > 0) & F.coalesce(first_key(of, keys, F.col("__b")) == key, F.lit(False))
    places = F.array(F.struct(F.col("__b").alias("b"), F.lit(False).alias("ghost")))
    places = F.when(is_bound, F.concat(places, F.array(F.struct((F.col("__b") - 1).alias("b"), F.lit(True).alias("ghost"))))).otherwise(places)
    if of:
        wrap = F.array(F.struct(F.lit(len(of) - 1).alias("b"), F.lit(True).alias("ghost")))
        is_first = F.col("doc_id").eqNullSafe(F.lit(of[0][0])) & (F.col("__h") == F.lit(of[0][1]))
        places = F.when(is_first, F.concat(places, wrap)).otherwise(places)
    rows = rows.withColumn("__p", F.explode(places)).select("doc_id", "text", "__h", F.col("__p.b").alias("__b"), F.col("__p.ghost").alias("__ghost"))
    return rows.withColumn("next_text", F.lead("text").over(neighbours()))


def neighbours():
    """The order of with_next inside a bucket."""
    return Window.partitionBy("__b").orderBy(F.col("__ghost"), F.col("doc_id").asc_nulls_first(), F.col("__h"))


def fingerprints_with_edits(df: DataFrame, k: int = K) -> DataFrame:
    """Each text's sketch, the sketch of the text with its last quarter replaced from the next document, and the next document's.

    Columns: doc_id, n_chars, edited (the edited text), sketch, edited_sketch, next_sketch. One row for each row
    of df; an empty table gives an empty one. A text's own beginning stands in where it is the only document.
    """
    rows = with_next(df)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - cut), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), cut)))
    rows = with_sketch(with_sketch(rows, "text", "sketch", k), "edited", "edited_sketch", k)
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(neighbours()))
    return rows.filter(~F.col("__ghost")).select("doc_id", "n_chars", "edited", "sketch", "edited_sketch", "next_sketch")
