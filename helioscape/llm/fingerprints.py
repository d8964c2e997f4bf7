"""Document fingerprints: bottom-k sketches of word-shingle hashes as column expressions.

A sketch is the sorted array of the k smallest distinct 48-bit shingle hashes. Sketches of parts merge to the sketch of
the whole; they estimate resemblance, containment and the number of distinct shingles, and are exact for sets of up
to k shingles.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

K = 128
WIDTH = 5
HASH_BITS = 48
#: Bytes of text in one ordered bucket, and buckets per level of the two-level search for a bucket.
BUCKET_BYTES = 16 << 20
FAN_OUT = 64


def with_sketches(df: DataFrame, columns: dict[str, str], k: int = K, width: int = WIDTH) -> DataFrame:
    """Adds for every {new column: text column} the sketch of the text.

    Words are lower-cased and separated by ASCII white space. A shingle is `width` consecutive words, or the
    whole of a shorter text; null and blank texts have the empty sketch.
    """
    kept = df.columns
    words = lambda c: F.array_remove(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    split = df.select(*kept, *[words(t).alias(f"_w_{s}") for s, t in columns.items()])

    def hashes(s: str) -> Column:
        w = F.col(f"_w_{s}")
        # get() is null beyond the last word, and hashing skips nulls
        one = lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + j) for j in range(width)]), 64 - HASH_BITS)
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))), one)) \
            .otherwise(F.array().cast("array<bigint>"))

    hashed = split.select(*kept, *[hashes(s).alias(s) for s in columns])
    return hashed.select(*kept, *[smallest(F.array_distinct(F.col(s)), k).alias(s) for s in columns])


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets."""
    return smallest(F.array_union(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both sketches hold; 1 for two empty ones."""
    both = F.size(F.array_intersect(merged(a, b, k), F.array_intersect(a, b)))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / F.size(merged(a, b, k)))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    last = F.element_at(sketch, -1).cast("double") + 1
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit((k - 1) * 2.0**HASH_BITS) / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    j = resemblance(a, b, k)
    common = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def as_text(sketch: Column) -> Column:
    """The sketch as hexadecimal digits, 12 a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), HASH_BITS // 4, "0")), "")


def merge_sketches(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch per key from those of its parts. Ranks are limited before the shuffle, so a hot key sends k rows a task."""
    hashes = df.select(*keys, F.explode(sketch).alias("hash")).distinct()
    ranked = hashes.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))).where(F.col("rank") <= k)
    kept = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("hash")).alias(sketch))
    return df.select(*keys).distinct().join(kept, keys, "left").withColumn(sketch, F.coalesce(sketch, F.array().cast("array<bigint>")))


def _bucket(value: Column, bounds: list[int]) -> Column:
    """Number of bounds below the value, found on two levels of at most FAN_OUT comparisons."""
    below = lambda limits: F.size(F.filter(limits, lambda x: x < value))
    groups = [bounds[i:i + FAN_OUT] for i in range(0, len(bounds), FAN_OUT)]
    longs = lambda values: F.lit(values).cast("array<bigint>") if values else F.array().cast("array<bigint>")
    group = below(longs([g[-1] for g in groups]))
    return (group * FAN_OUT + F.coalesce(below(F.get(F.array(*[longs(g) for g in groups]), group)), F.lit(0))).cast("int")


def with_next(docs: DataFrame, id_col: str, text_col: str, k: int = K) -> DataFrame:
    """(id, text, sketch, next_text, next_sketch): each document and the next by descending id, after the last the first.

    Documents are dealt into ordered buckets whose limits are ids that occur; the first document of a bucket also goes
    to the bucket above it as a guest, so every next document is at hand after one shuffle and no row order spans
    buckets. Rows with equal ids follow each other by text; rows without an id come last. A single row is its own next.
    """
    low = -(1 << 63)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("_id"), F.col(text_col).alias("text"))
    total, top, rows = source.agg(F.sum(F.octet_length("text")), F.max("_id"), F.count("*")).first()
    if not rows:
        empty = with_sketches(source.select("id", "text"), {"sketch": "text"}, k)
        return empty.select("*", F.col("text").alias("next_text"), F.col("sketch").alias("next_sketch"))
    count = int(min(FAN_OUT * FAN_OUT, max(16, (total or 0) // BUCKET_BYTES)))
    cuts = source.agg(F.percentile_approx("_id", [i / count for i in range(1, count)], 100 * count)).first()[0]
    bounds = sorted({*cuts, top})
    own = _bucket(F.col("_id"), bounds)
    is_limit = F.col("_id") == F.get(F.lit(bounds).cast("array<bigint>"), F.col("_own"))
    homes = F.when(is_limit, F.array(F.struct(F.col("_own").alias("bucket"), F.lit(0).alias("guest")),
                                     F.struct(((F.col("_own") + 1) % len(bounds)).alias("bucket"), F.lit(1).alias("guest")))) \
        .otherwise(F.array(F.struct(F.col("_own").alias("bucket"), F.lit(0).alias("guest"))))
    dealt = source.withColumn("_own", own).select("id", "_id", "text", F.inline(homes)).repartition(len(bounds), "bucket")
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("_id"), F.col("text").asc_nulls_first())
    after = F.lead(F.struct("text", "sketch")).over(order)
    seen = with_sketches(dealt, {"sketch": "text"}, k).withColumn("_next", after).where("guest = 0")
    return seen.select("id", "text", "sketch", F.col("_next.text").alias("next_text"), F.col("_next.sketch").alias("next_sketch"))


def edited_likeness(docs: DataFrame, id_col: str, text_col: str, k: int = K) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and its likeness to the edited text and the next document.

    The edited text replaces the last half of the code points (rounded down) by the first as many of the next
    document. A null text is an empty one. Repeated rows give repeated rows.
    """
    rows = with_next(docs, id_col, text_col, k).select(
        F.col("id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("next_text", F.lit("")).alias("next_text"),
        "sketch", "next_sketch")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")) \
        .withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = with_sketches(rows, {"edited_sketch": "edited"}, k)
    return rows.select(F.col("doc_id"), "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
                       as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
                       resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
                       resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
                       distinct_shingles(F.col("sketch"), k).alias("distinct_shingles"))
