"""Threshold-scaled sketches of word shingles; DataFrame functions only.

A sketch holds every distinct hash of a five-word shingle below a fixed ``FRACTION`` of the hash space. Sketches of parts
merge by union, and as the fraction is the same for all documents, the share of a small document's sketch that is found in
a large one's estimates containment whatever their sizes.

Texts shorter than a shingle are one shingle. The fingerprint string is the sorted sketch in hexadecimal; if the sketch
is empty it is ``=`` and the hash of the word sequence, so that short texts still differ, and two fingerprints of
which one has no hashes are alike only if they are equal.

Successors: the documents in descending order of (id, hash of the text), nulls last; the last one is followed by the first.
Rows that repeat id and text count once in that order and share their successor.

Defined cases: null texts count as empty; empty texts have one fingerprint in common; a single document is its own
successor; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, stored, text_bytes

WORDS = 5
FRACTION = 1 / 4
_LEAST = -(1 << 63)


def sketch(hashes: Column, words: int = WORDS, fraction: float = FRACTION) -> Column:
    """Sorted distinct shingle hashes below the threshold, from the array of word hashes."""
    n = F.size(hashes)
    top = F.lit(_LEAST + int(fraction * (1 << 64)))
    runs = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(words)]))
    none = F.array().cast("array<bigint>")
    every = F.when(n == 0, none).when(n < words, F.array(F.xxhash64(hashes))).otherwise(runs)
    return F.array_sort(F.array_distinct(F.filter(every, lambda h: h < top)))


def word_hashes(text: Column) -> Column:
    spaced = F.translate(text_bytes(text), WHITE, " " * len(WHITE))
    return F.transform(F.filter(F.split(spaced, " "), lambda w: w != ""), lambda w: F.xxhash64(w))


def fingerprint(found: Column, sequence: Column) -> Column:
    """The string form of a sketch; ``sequence``: hash of the word sequence."""
    return F.when(F.size(found) == 0, F.concat(F.lit("="), F.hex(sequence))).otherwise(F.array_join(F.transform(found, lambda h: F.hex(h)), ","))


def likeness(a: str, a_sequence: str, b: str, b_sequence: str) -> Column:
    """Estimated Jaccard similarity of two sketches; if one is empty, whether the fingerprints are equal."""
    common = F.size(F.array_intersect(a, b))
    equal = (F.size(a) == 0) & (F.size(b) == 0) & (F.col(a_sequence) == F.col(b_sequence))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), equal.cast("double")).otherwise(common / (F.size(a) + F.size(b) - common))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second one has; null for an empty sketch."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merge(sketches: DataFrame, column: str, *keys: str) -> DataFrame:
    """Sketch of the union of the texts of each group of ``keys``."""
    return sketches.select(*keys, F.explode(column).alias("h")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("h")).alias(column))


def sketched(docs: DataFrame, text: str, out: str, sequence: str) -> DataFrame:
    """``docs`` with the sketch of a text column and the hash of its word sequence."""
    hashed = docs.withColumn(sequence, word_hashes(F.col(text))).withColumn(out, sketch(F.col(sequence)))
    return hashed.withColumn(sequence, F.xxhash64(sequence))


def successors(keys: DataFrame) -> DataFrame:
    """(id, th, m) and the next key (next_id, next_th) in descending order; keys are not null, and distinct.

    Keys are dealt by range and stored with their range's number, so the numbers stay what they are; the successor of the
    last key of a range is the first of the next range, found from one row for each range.
    """
    ranged = keys.distinct().repartitionByRange(F.desc("id"), F.desc("th")).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "order")
    inside = Window.partitionBy("part").orderBy(F.desc("id"), F.desc("th"))
    heads = ranged.groupBy("part").agg(F.max(F.struct("id", "th")).alias("head"))
    over = Window.orderBy("part")  # as many rows as there are ranges
    around = heads.select("part", F.coalesce(F.lead("head").over(over), F.first("head").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    led = ranged.withColumn("next", F.lead(F.struct("id", "th")).over(inside)).join(F.broadcast(around), "part")
    return led.select("id", "th", "m", F.coalesce("next", "head").alias("next")).select("id", "th", "m", F.col("next.id").alias("next_id"), F.col("next.th").alias("next_th"))


def compare_with_successors(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, whose last third is the successor's beginning.

    Columns: the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, kept_in_edited,
    next_id, next_n_chars.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc"), F.coalesce(F.col(id).cast("long"), F.lit(_LEAST)).alias("id"), text_bytes(F.col(text)).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text")).withColumn("n_chars", F.length("text").cast("long"))
    order = successors(rows.select("id", "th", F.floor(F.col("n_chars") / 3).cast("int").alias("m")))
    wanted = order.select(F.col("next_id").alias("id"), F.col("next_th").alias("th"), F.col("id").alias("to_id"), F.col("th").alias("to_th"), "m")
    # both joins read the same columns of ``rows`` by the same keys, so one exchange serves them; sketches, which do not
    # compress, are made from the text on either side of it instead of being shuffled with the text
    gifts = sketched(rows.join(wanted, ["id", "th"]), "text", "next_sk", "next_sq").select(
        F.col("to_id").alias("id"), F.col("to_th").alias("th"), F.substring("text", F.lit(1), F.col("m")).alias("gift"),
        "next_sk", "next_sq", F.col("doc").alias("next_doc"), F.col("n_chars").alias("next_chars"),
    )
    if rows.select(F.lit(1)).count() != order.select(F.lit(1)).count():  # some rows repeat id and text
        gifts = gifts.dropDuplicates(["id", "th"])
    whole = sketched(rows.join(gifts, ["id", "th"]), "text", "sk", "sq")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int")), F.col("gift"))
    out = sketched(whole.withColumn("edited", edited), "edited", "edited_sk", "edited_sq")
    return out.select(
        F.col("doc").alias(id),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sk"), F.col("sq")).alias("fingerprint"),
        fingerprint(F.col("edited_sk"), F.col("edited_sq")).alias("edited_fingerprint"),
        likeness("sk", "sq", "edited_sk", "edited_sq").alias("near_edited"),
        likeness("sk", "sq", "next_sk", "next_sq").alias("near_next"),
        containment(F.col("sk"), F.col("edited_sk")).alias("kept_in_edited"),
        F.col("next_doc").alias("next_id"),
        F.col("next_chars").alias("next_n_chars"),
    )
