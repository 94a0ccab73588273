"""Document fingerprints: a homomorphic multiset hash of paragraphs, by DataFrame operations only.

Every paragraph (line) is hashed to a wide vector, and the fingerprint of a text is the sum of its paragraphs' vectors,
lane by lane modulo a power of two. The order of paragraphs doesn't matter, and a paragraph is put in or taken out by adding
or subtracting its vector. A vector has

* 8 identity lanes of 32 bits, from four hashes of the whole paragraph: they decide equality;
* 64 likeness lanes of 24 bits: each pair of words of the paragraph (from its start, without overlap) is hashed
  to 64 signs, and the lanes sum them. The cosine of two texts' lanes estimates how much of their words' pairs they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.session import ready, stored

IDENTITY_SEEDS = (101, 102, 103, 104)
LANES = 64
LANE_BITS = 24
#: A word, and the next one of the same paragraph.
PIECE = r"[^\x20\x09-\x0D]+(?:[\x20\x09\x0B-\x0D]+[^\x20\x09-\x0D]+)?"
#: Two counters of 32 bits share a sum: bits k and k + 32 of a hash.
_PAIR = 0x0000000100000001
_LOW = 0xFFFFFFFF


def identity_lanes(text: Column) -> Column:
    """The identity lanes of a text: sums modulo 2**32 over its paragraphs, as hex."""
    def add(sums: Column, paragraph: Column) -> Column:
        hashes = [F.xxhash64(F.lit(s), paragraph) for s in IDENTITY_SEEDS]
        parts = [x for h in hashes for x in (h.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(h, 32))]
        return F.struct(*[(sums[f"i{k}"] + x).bitwiseAND(F.lit(_LOW)).alias(f"i{k}") for k, x in enumerate(parts)])

    zero = F.struct(*[F.lit(0).cast("long").alias(f"i{k}") for k in range(2 * len(IDENTITY_SEEDS))])
    return F.aggregate(F.split(text, "\n", -1), zero, add,
                       lambda s: F.concat(*[F.lpad(F.hex(s[f"i{k}"]), 8, "0") for k in range(2 * len(IDENTITY_SEEDS))]))


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def lane_sums(rows: DataFrame, keys: list[str], text: str, copies: str) -> DataFrame:
    """``keys`` with ``lanes``: signed sums of the signs of all pieces; rows that repeat ``copies`` times count once."""
    exploded = rows.select(*keys, copies, F.explode_outer(pieces(F.col(text))).alias("piece"))
    sign = F.xxhash64(F.lit(7), "piece")
    counters = [F.sum(F.when(F.col("piece").isNotNull(), F.shiftrightunsigned("sign", k).bitwiseAND(F.lit(_PAIR))).otherwise(F.lit(0).cast("long"))).alias(f"c{k}") for k in range(32)]
    sums = exploded.select(*keys, copies, "piece", sign.alias("sign")).groupBy(*keys, copies).agg(F.count("piece").alias("n"), *counters)
    ones = [F.col(f"c{k}").bitwiseAND(F.lit(_LOW)) for k in range(32)] + [F.shiftrightunsigned(f"c{k}", 32) for k in range(32)]
    lanes = F.array(*[((2 * x - F.col("n")) / F.col(copies)).cast("long") for x in ones])
    return sums.select(*keys, lanes.alias("lanes"))


def printed(identity: Column, lanes: Column) -> Column:
    """The fingerprint: identity lanes, then likeness lanes modulo 2**24, as hex."""
    digits = LANE_BITS // 4
    return F.concat(identity, F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(F.pmod(x, F.lit(1 << LANE_BITS))), digits, "0")), ""))


def likeness(identity_a: Column, lanes_a: str, identity_b: Column, lanes_b: str) -> Column:
    """1 for equal fingerprints, else the cosine of the likeness lanes, 0 at least."""
    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    cosine = F.try_divide(dot(lanes_a, lanes_b), F.sqrt(dot(lanes_a, lanes_a)) * F.sqrt(dot(lanes_b, lanes_b)))  # null without words
    return F.when(identity_a == identity_b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0)))))


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` (known, id, mark, ...; distinct) with ``next``: the first three of the row that follows, the first after the last.

    Rows are sorted in ranges; a range learns of the next range's first row from one line per range.
    """
    me = F.struct("known", "id", "mark")
    ranged = stored(rows.repartitionByRange("known", "id", "mark").withColumn("range", F.spark_partition_id()))
    firsts = ranged.groupBy("range").agg(F.min(me).alias("first"))
    every = Window.orderBy("range")  # a line per range
    firsts = firsts.withColumn("after", F.coalesce(F.lead("first").over(every), F.min("first").over(Window.partitionBy())))
    inside = Window.partitionBy("range").orderBy("known", "id", "mark")
    return ranged.withColumn("follows", F.lead(me).over(inside)).join(F.broadcast(firsts), "range") \
        .withColumn("next", F.coalesce("follows", "after")).drop("range", "first", "after", "follows")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the
    next text, by key, null keys first, equal keys by a hash of the text; after the last comes the first. A null
    text is empty. Rows with equal key and text are one document in that order and share their result. A single row is
    its own next. An empty table gives an empty result. Other columns are not used.
    """
    ready(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    zero = F.lit(0).cast(docs.schema[key].dataType)
    base = docs.select(F.col(key).isNotNull().alias("known"), F.coalesce(F.col(key), zero).alias("id"), body.alias("text"), F.xxhash64(body).alias("mark"))
    rid = ["known", "id", "mark"]
    order = stored(in_order(base.groupBy(*rid).agg(F.count(F.lit(1)).alias("copies"), F.max(F.char_length("text")).alias("n_chars"))))

    before = order.select(*[F.col(f"next.{c}").alias(c) for c in rid], F.struct(*rid).alias("prev"), (F.col("n_chars") / 4).cast("long").alias("quarter"))
    heads = base.join(before, rid).select(*[F.col(f"prev.{c}").alias(c) for c in rid], F.substring("text", F.lit(1), F.col("quarter").cast("int")).alias("head")).distinct()
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - (F.col("n_chars") / 4).cast("long")).cast("int"))
    pairs = base.join(heads, rid).join(order.select(*rid, "copies", "n_chars"), rid) \
        .select(*rid, "copies", "text", F.concat(kept, "head").alias("edited"))
    versions = pairs.select(*rid, "copies", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("version")) \
        .select(*rid, "copies", "version.kind", "version.text") \
        .select(*rid, "copies", "kind", "text", identity_lanes(F.col("text")).alias("identity"), F.when(F.col("kind") == 1, F.unhex(F.sha2("text", 256))).alias("sha"))
    prints = stored(lane_sums(versions, [*rid, "kind", "identity", "sha"], "text", "copies"))

    own = prints.where("kind = 0").select(*rid, "identity", "lanes")
    changed = prints.where("kind = 1").select(*rid, F.col("identity").alias("edited_identity"), F.col("lanes").alias("edited_lanes"), "sha")
    after = own.select(*[F.col(c).alias(f"next_{c}") for c in rid], F.col("identity").alias("next_identity"), F.col("lanes").alias("next_lanes"))
    follows = [F.col("next").getField(c) == F.col(f"next_{c}") for c in rid]
    result = order.join(own, rid).join(changed, rid).join(after, follows) \
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return result.select(
        F.when(F.col("known"), F.col("id")).alias(key), F.col("n_chars").cast("long").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"),
        printed(F.col("identity"), F.col("lanes")).alias("fingerprint"), printed(F.col("edited_identity"), F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("identity"), "lanes", F.col("edited_identity"), "edited_lanes").alias("near_edited"),
        likeness(F.col("identity"), "lanes", F.col("next_identity"), "next_lanes").alias("near_next"))
