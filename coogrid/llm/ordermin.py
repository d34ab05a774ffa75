"""Order MinHash fingerprints, in DataFrame operations alone.

The elements of a text are its k-mers of words, numbered by occurrence, so that a
repeated k-mer counts each time.  Every element has a place on a ring of hashes.
Each of ``HASHES`` marks on the ring selects the ``CHOSEN`` elements that follow it;
these are put back in text order and hashed together.  A signature agrees when both
the selected elements and their order agree, so likeness falls with edits and with
moves.  Marks on one ring take the place of as many rankings of all elements: a text
is hashed and sorted once, and short texts fill all signatures by going round.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a k-mer, signatures of a fingerprint, elements of a signature.
WORDS, HASHES, CHOSEN = 2, 64, 2
#: Low bits of a packed element hold its position in the text, the rest its hash.
_BITS = 30
_POSITION = (1 << _BITS) - 1
_HASH = ~_POSITION
_MARKS = ", ".join(f"{(k * (1 << 64) // HASHES - (1 << 63)) & _HASH | _POSITION}L" for k in range(HASHES))

# Packed elements by hash and position: the occurrences of a k-mer stand together, in text order.
_PACKED = (
    "sort_array(transform(__w, (w, i) -> (xxhash64(w, "
    + ", ".join(f"get(__w, i + {d})" for d in range(1, WORDS))
    + f") & {_HASH}L) | i))"
)
# Where the run of each element's k-mer begins: a running maximum that reaches twice as far
# with every step and ends when a step changes nothing.
_RUNS = f"""aggregate(sequence(0, {_BITS}),
    named_struct('a', transform(__s, (x, j) ->
        if(j = 0 or shiftright(x, {_BITS}) <> shiftright(get(__s, j - 1), {_BITS}), j, 0)), 'same', false),
    (held, p) -> if(held.same, held, element_at(transform(
        array(transform(held.a, (v, j) -> greatest(v, coalesce(get(held.a, j - shiftleft(1, p)), 0)))),
        next -> named_struct('a', next, 'same', next = held.a)), 1)),
    held -> held.a)"""
# The occurrence number is part of what places an element on the ring.  (Zipped, not looked up inside the
# lambda, where Catalyst would inline the runs and work them out anew for every element.)
_RING = f"""sort_array(concat(zip_with(__s, transform(__a, (a, j) -> j - a), (x, nth) ->
    (xxhash64(shiftright(x, {_BITS}), nth) & {_HASH}L) | (x & {_POSITION}L)), array({_MARKS})))"""
_ELEMENTS = f"filter(__r, x -> (x & {_POSITION}L) <> {_POSITION}L)"
_PLACES = f"filter(transform(__r, (x, i) -> if((x & {_POSITION}L) = {_POSITION}L, i, null)), i -> i is not null)"
# Selected elements as position and hash, sorted into text order; only the hashes enter the signature.
_SIGNATURES = f"""transform(__i, (i, k) -> cast(xxhash64(transform(
    sort_array(transform(sequence(0, {CHOSEN - 1}), q -> element_at(transform(
        array(get(__e, (i - k + q) % size(__e))),
        e -> shiftleft(e & {_POSITION}L, {64 - _BITS}) | shiftrightunsigned(e, {_BITS})), 1))),
    y -> y & {(1 << (64 - _BITS)) - 1}L)) & 65535 as int))"""


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the fingerprint of a text column: ``HASHES`` numbers of 16 bits.

    Words are what white space separates; a null text is empty, and an empty text
    has the fingerprint of its one empty word.
    """
    steps = {"__s": _PACKED, "__a": _RUNS, "__r": _RING, "__e": _ELEMENTS, "__i": _PLACES, out: _SIGNATURES}
    df = df.withColumn("__w", F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"\s+"))
    for name, step in steps.items():
        df = df.withColumn(name, F.expr(step))
    return df.drop("__w", "__s", "__a", "__r", "__e", "__i")


def likeness(a: str, b: str) -> Column:
    """Share of equal signatures, 0 to 1."""
    same = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda total, one: total + one
    )
    return same / F.lit(float(HASHES))


def as_text(fingerprint: str) -> Column:
    """A fingerprint as hex digits, four per signature."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def _buckets(docs: DataFrame) -> DataFrame:
    """Tag rows with ``__bucket``, which grows with the id: literal quantile bounds, a few per task; null ids are lowest."""
    n = 4 * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = F.coalesce(F.col("__id").cast("double"), F.lit(-1e300))
    ordered = docs.withColumn("__order", order)
    (cuts,) = ordered.select("__order").approxQuantile(["__order"], [i / n for i in range(1, n)], 0.25 / n) or [[]]
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) == 2:
        return ordered.withColumn("__bucket", F.lit(0.0)).drop("__order")
    return Bucketizer(splits=splits, inputCol="__order", outputCol="__bucket").transform(ordered).drop("__order")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every document beside its edited text and the next document, by descending id.

    The edited text is the document with its last ``n_chars // 2`` code points
    replaced by the first as many of the next document; after the last document
    comes the first.  Repeated ids follow each other by a hash of their texts, null
    ids come last.  Texts are shuffled once, into buckets of the id order; the first
    row of the bucket below stands at the end of each bucket as a row of its own, so
    nothing but bucket edges is read twice.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t")
    ).withColumn("__tie", F.xxhash64("__t"))
    rows = _buckets(rows)
    # One row per bucket: its highest id, then that id's first text.  Bounded by the number of buckets.
    low = F.lit(-(1 << 63)).cast("long")
    key = F.coalesce("__id", low)
    heads = rows.groupBy("__bucket").agg(F.max(key).alias("__top"))
    head_rows = rows.join(F.broadcast(heads), "__bucket").where(key == F.col("__top"))
    ties = head_rows.groupBy("__bucket").agg(F.max("__tie").alias("__tie"))
    first_texts = (
        head_rows.join(F.broadcast(ties), ["__bucket", "__tie"])
        .dropDuplicates(["__bucket"])
        .select(F.col("__bucket").alias("__from"), "__t", "__tie")
    )
    below = heads.select(
        "__bucket", F.lag("__bucket").over(Window.orderBy("__bucket")).alias("__below")
    )  # numbers of buckets, no rows of documents
    highest = heads.agg(F.max("__bucket").alias("__highest"))
    edges = below.join(F.broadcast(highest)).select("__bucket", F.coalesce("__below", "__highest").alias("__from"))
    edges = edges.join(first_texts, "__from").select(
        "__bucket", F.lit(None).cast("long").alias("__id"), "__t", "__tie", F.lit(1).alias("__edge")
    )
    own = rows.select("__bucket", "__id", "__t", "__tie", F.lit(0).alias("__edge"))
    both = with_fingerprint(own.unionByName(edges), "__t", "__fp")
    order = Window.partitionBy("__bucket").orderBy("__edge", F.col("__id").desc_nulls_last(), F.desc("__tie"))
    paired = both.select(
        "__id", "__t", "__fp", "__edge", F.lead("__t").over(order).alias("__next"), F.lead("__fp").over(order).alias("__nfp")
    ).where("__edge = 0")
    n = F.char_length("__t")
    paired = paired.withColumn("__n", n).withColumn("__half", F.expr("__n div 2").cast("int"))
    edited = F.concat(F.expr("substring(__t, 1, __n - __half)"), F.expr("substring(__next, 1, __half)"))
    paired = paired.withColumn("__edited", edited).select("__id", "__n", "__fp", "__nfp", "__edited")
    return with_fingerprint(paired, "__edited", "__efp").select(
        F.col("__id").alias("doc_id"),
        F.col("__n").cast("long").alias("n_chars"),
        F.sha2(F.encode("__edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text("__fp").alias("fingerprint"),
        as_text("__efp").alias("edited_fingerprint"),
        likeness("__fp", "__efp").alias("near_edited"),
        likeness("__fp", "__nfp").alias("near_next"),
    )


def ordermin_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
