"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

The elements are a text's paragraphs (lines).  A paragraph's vector has

* CHECK_LANES lanes of 32 bits cut from its SHA-256, summed modulo 2^32, and
* LIKE_LANES counters modulo 2^32, which count set hash bits over the
  paragraph's word triples, and the number of triples.

A fingerprint is the sum of the vectors, so the order of paragraphs has no part in
it, and adding or taking out a paragraph adds or subtracts its vector.  Twice a
counter less the number of triples is a sum of random signs, so the squared
distance of two fingerprints estimates how many triples they do not share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadbook.llm.successors import with_next

CHECK_LANES = 8
LIKE_LANES = 64
_PAIRS = LIKE_LANES // 2
_LOW = 0xFFFFFFFF
_PAIR = 0x1_0000_0001  # the lowest bit of both counters of a pair


def paragraph_vectors(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Sum the paragraph vectors of `text` by `keys`: columns check (longs), pairs (longs), triples.

    A pair holds two counters, the second in the upper 32 bits.  An empty text is one empty paragraph.
    """
    lines = rows.select(*keys, F.explode(F.split(F.col(text), "\n")).alias("__line"))
    digest = F.sha2(F.col("__line"), 256)
    lanes = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(CHECK_LANES)]
    words = lines.select(*keys, *(c.alias(f"__c{k}") for k, c in enumerate(lanes)), F.split("__line", " ").alias("__words"))
    triples = F.transform(
        "__words", lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2))
    )
    checks = [f"__c{k}" for k in range(CHECK_LANES)]
    hashed = words.select(*keys, *checks, F.posexplode(triples).alias("__i", "__h"))
    first = F.col("__i") == 0  # a paragraph's digest counts once, its triples each
    sums = [F.sum(F.when(first, F.col(c)).otherwise(F.lit(0).cast("long"))).alias(c) for c in checks]
    pairs = [
        F.sum(F.shiftrightunsigned("__h", k).bitwiseAND(F.lit(_PAIR))).alias(f"__p{k}") for k in range(_PAIRS)
    ]
    summed = hashed.groupBy(*keys).agg(*sums, *pairs, F.count("*").alias("triples"))
    return summed.select(
        *keys,
        F.array(*(F.col(c).bitwiseAND(F.lit(_LOW)) for c in checks)).alias("check"),
        F.array(*(F.col(f"__p{k}") for k in range(_PAIRS))).alias("pairs"),
        "triples",
    )


def as_text(check: Column, pairs: Column, triples: Column) -> Column:
    """A vector as lowercase hex: check lanes, number of triples, counters."""
    short = F.transform(check, lambda x: F.lpad(F.hex(x), 8, "0"))
    wide = F.transform(pairs, lambda x: F.lpad(F.hex(x), 16, "0"))
    return F.lower(F.concat(F.array_join(short, ""), F.lpad(F.hex(triples), 16, "0"), F.array_join(wide, "")))


def _numbers(text: Column, start: int, count: int, digits: int) -> Column:
    cut = lambda i: F.conv(F.substr(text, i * digits + start + 1, F.lit(digits)), 16, 10).cast("decimal(20,0)")
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), cut)


def combine(first: Column, second: Column, sign: int = 1) -> Column:
    """The fingerprint of two texts' paragraphs together (sign 1) or of the first without the second's (-1).

    Both are fingerprint texts of `as_text`; lanes are added modulo 2^32, so that
    `combine(combine(a, b), b, -1)` is `a`.
    """
    lanes = CHECK_LANES + 2 + LIKE_LANES
    module = F.lit(2**32).cast("decimal(20,0)")
    added = F.zip_with(_numbers(first, 0, lanes, 8), _numbers(second, 0, lanes, 8), lambda x, y: F.pmod(x + F.lit(sign) * y, module))
    return F.lower(F.array_join(F.transform(added, lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")), ""))


def _signs(pairs: Column, triples: Column) -> Column:
    both = F.transform(
        pairs,
        lambda x: F.array(
            (2 * x.bitwiseAND(F.lit(_LOW)) - triples).cast("double"),
            (2 * F.shiftrightunsigned(x, 32) - triples).cast("double"),
        ),
    )
    return F.flatten(both)


def _squares(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x * x)


def likeness(first: Column, second: Column) -> Column:
    """0 to 1, from two structs (check, pairs, triples): the estimated share of word triples in common.

    It is 1 for equal vectors, and about 2 |a and b| / (|a| + |b|) in squared
    multiplicities, with a standard error of 1 / sqrt(LIKE_LANES).
    """
    a, b = (_signs(v["pairs"], v["triples"]) for v in (first, second))
    apart = _squares(F.zip_with(a, b, lambda x, y: x - y))
    size = _squares(a) + _squares(b)
    near = F.when(size > 0, 1.0 - apart / size).otherwise((first["check"] == second["check"]).cast("double"))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), near))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last half of its code points (rounded down) replaced by
    as many from the start of the next document by doc_id; the last document's next
    is the first.  A null text is empty.  A document whose doc_id repeats precedes
    its twin by text order.  A row without doc_id has no next document: its half is
    dropped and near_next is 0.  Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int"))
    edited = F.concat(kept, F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    placed = with_next(rows).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("__edited", edited)
    placed = placed.withColumn("edited_sha256", F.sha2("__edited", 256))
    text, other = (F.struct(F.lit(k).alias("kind"), F.col(c).alias("body")) for k, c in ((0, "text"), (1, "__edited")))
    keys = ["range", "pos", "guard", "doc_id", "n_chars", "edited_sha256", "kind"]
    bodies = placed.withColumn("__one", F.explode(F.when(F.col("guard"), F.array(text)).otherwise(F.array(text, other))))
    vectors = paragraph_vectors(bodies.select(*keys[:-1], "__one.*"), keys, "body")
    vectors = vectors.select(*keys, F.struct("check", "pairs", "triples").alias("v"))
    order = Window.partitionBy("range").orderBy("pos", "kind")
    beside = vectors.select("*", F.lead("v", 1).over(order).alias("e"), F.lead("v", 2).over(order).alias("x"))
    fields = lambda v: (v["check"], v["pairs"], v["triples"])
    return beside.where((F.col("kind") == 0) & ~F.col("guard")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(*fields(F.col("v"))).alias("fingerprint"),
        as_text(*fields(F.col("e"))).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("e")).alias("near_edited"),
        F.coalesce(likeness(F.col("v"), F.col("x")), F.lit(0.0)).alias("near_next"),
    )
