"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize

# A document's place in its source's order: 60 bits, cut into 12 and 12 for the two histograms.
HASH_BITS, LEVEL_BITS = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters that are not ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_order(doc_id: Column, seed: str) -> Column:
    """A fixed draw in [0, 2^60) from the document's id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_epochs: float) -> DataFrame:
    """Per source (columns ``source``, ``skey``, ``source_size``) its ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times
    all words.  No target exceeds ``max_epochs`` times its source; what is cut off there goes to
    the others by weight.  That is one water level: sorted by cap over weight, the first source
    that stays below its cap fixes the level for all after it.  The windows run over one row per
    source.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    everything = W.partitionBy()
    sized = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    sized = sized.withColumn("wanted", F.lit(float(share)) * F.sum("source_size").over(everything))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = sized.withColumn("place", F.row_number().over(order)).withColumn("level", (F.col("wanted") - before) / rest)
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(everything)
    level = level.withColumn("first", first)
    target = F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("first.level") * F.col("weight"))
    )
    return level.select("source", "skey", "source_size", target.alias("target"))


def _running(df: DataFrame, key: str) -> DataFrame:
    """Words before (``low``) and up to (``high``) each ``key`` of a source, from a histogram of few rows per source."""
    order = W.partitionBy("skey").orderBy(key)
    running = F.sum("words").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return df.withColumn("high", F.col("low") + running).withColumn("low", F.col("high") - F.col("words"))


def _pieces(docs: DataFrame, seed: str, doc_id: str, text: str, source: str) -> DataFrame:
    """The narrow view of the documents that a mix is planned from."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        source_key(F.col(source)).alias("skey"),
        word_count(F.col(text)).alias("size"),
        document_order(F.col(doc_id), seed).alias("h"),
    )


def source_key(source: Column) -> Column:
    """A join key that also holds for a null source."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def mix_plan(pieces: DataFrame, weights: Sequence[int], share: float, max_epochs: float) -> DataFrame:
    """Per source its target, the whole epochs it gives, and the hash below which documents are given once more.

    The threshold is found without sorting: words by source and hash bucket, the one bucket in
    which the budget ends is cut into buckets again, and only the few hashes of that last bucket
    are put in order.
    """
    sizes = pieces.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    plan = source_targets(sizes, weights, share, max_epochs).withColumn("epochs", epochs)
    plan = materialize(plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-plan")

    bucket = lambda level: F.shiftright("h", HASH_BITS - LEVEL_BITS * level)
    ends_here = (F.col("low") <= F.col("budget")) & (F.col("budget") < F.col("high"))
    edge = plan.select("skey", "budget", F.lit(0).cast("long").alias("low"))
    inside = pieces.select("skey", "h", "size")
    for level in (1, 2):
        counts = inside.groupBy("skey", bucket(level).alias("bucket")).agg(F.sum("size").alias("words"))
        edge = _running(counts.join(edge.select("skey", "budget", "low"), "skey"), "bucket").where(ends_here)
        edge = materialize(edge.select("skey", "budget", "bucket", "low"), "mix-edge")
        # At most one bucket per source is left, about 1 in 4096 of its rows.
        found = edge.select("skey", "bucket")
        inside = inside.withColumn("bucket", bucket(level)).join(found, ["skey", "bucket"], "left_semi").select("skey", "h", "size")
    exact = inside.groupBy("skey", "h").agg(F.sum("size").alias("words"))
    last = _running(exact.join(edge, "skey"), "h")
    left_out = F.col("low") + F.col("high") > 2 * F.col("budget")
    beyond = F.shiftleft(F.first("bucket") + 1, HASH_BITS - 2 * LEVEL_BITS)
    cuts = last.groupBy("skey").agg(F.coalesce(F.min(F.when(left_out, F.col("h"))), beyond).alias("cut"))
    plan = plan.join(cuts, "skey", "left").withColumn("cut", F.coalesce("cut", F.lit(0).cast("long")))
    return materialize(plan.select("skey", "source_size", "target", "epochs", "cut"), "mix-cuts")


def copies() -> Column:
    return F.col("epochs") + (F.col("h") < F.col("cut")).cast("int")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Per document the words that a mix of the sources takes from it.

    Returns ``doc_id, source, size, source_size, target, copies, taken``.  A source gives all its
    documents ``floor(target / size)`` times, and once more those whose order hash lies below
    the source's threshold (``mix_plan``).  The document at the edge is taken if that brings
    the source nearer to its target, so the error is at most half a document.

    Null texts have size 0, a null source is a source of its own, last in the order.  Rows
    with the same id share one hash and are taken or left together; rows with a null id likewise.
    Other columns are ignored.  An empty table gives an empty result.
    """
    # Reading and counting the texts is done once; what follows reads a narrow table.
    pieces = materialize(_pieces(docs, seed, doc_id, text, source), "mix-pieces")
    mixed = pieces.join(mix_plan(pieces, weights, share, max_epochs), "skey").withColumn("copies", copies())
    taken = (F.col("copies") * F.col("size")).cast("long")
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", taken.alias("taken"))


def take_mix(
    docs: DataFrame, columns: Sequence[str], weights: Sequence[int] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix"
) -> DataFrame:
    """The given columns of the documents that the mix takes, with ``copies``, how often it takes them.

    The rows are filtered where they are; only the plan, one row per source, is joined to them.
    """
    pieces = materialize(_pieces(docs, seed, "doc_id", "text", "source"), "mix-pieces")
    plan = mix_plan(pieces, weights, share, max_epochs).select("skey", "epochs", "cut")
    rows = docs.select(*columns, source_key(F.col("source")).alias("skey"), document_order(F.col("doc_id"), seed).alias("h"))
    return rows.join(plan, "skey").withColumn("copies", copies()).where("copies > 0").select(*columns, "copies")
