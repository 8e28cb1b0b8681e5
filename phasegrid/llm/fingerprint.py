"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A paragraph (a line) hashes to a wide vector of two parts: PROOF lanes of 32 bits, drawn from the
paragraph as a whole, and LIKE lanes of 32 bits, to which each of its words adds or subtracts its
length in one lane. A document's fingerprint is the sum of its paragraphs' vectors, every lane modulo
2^32. The order of paragraphs doesn't matter, equal multisets have equal fingerprints, and a paragraph
is inserted or deleted by adding or subtracting its vector: see combine(). The cosine of the LIKE lanes
is an estimate of how much text two documents share.

DataFrame functions only. The document's next neighbour comes from ranges of doc_id: each range is one
window partition, and the first document of a range is copied behind the range before it, so no sort
over all rows happens in one task and the texts are shuffled once.

Defined results: null text is empty; empty text is one empty paragraph; null doc_ids sort first; rows
that share a doc_id are ordered by text and each is its own document; a single document is its own
neighbour; the likeness of two fingerprints without words is 1 if they are equal, else 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.llm.ranges import id_ranges

PROOF, LIKE = 8, 64
MOD = 1 << 32
HALF = LIKE // 2
SPACES = r"[\x20\x09-\x0D]+"
#: Documents in a range of doc_id.
RANGE_ROWS = 512
#: Ranges a task takes at most, about.
TASK_RANGES = 32


def _units(text: Column) -> Column:
    """Paragraphs, marked by a leading line feed, and words, which hold none."""
    paragraphs = F.transform(F.split(text, "\n"), lambda p: F.concat(F.lit("\n"), p))
    return F.concat(paragraphs, F.filter(F.split(text, SPACES), lambda w: w != ""))


def _sums() -> list[Column]:
    """Per document, over its exploded units in column u: the PROOF lanes, and the LIKE lanes, two in a long (high * 2^32 + low, both signed)."""
    whole = F.col("u").startswith("\n")
    proof = [F.sum(F.when(whole, F.xxhash64(F.lit(j), "u").bitwiseAND(F.lit(MOD - 1)))) for j in range(PROOF)]
    like = [F.sum(F.when(F.col("lane") == j, F.col("add"))) for j in range(HALF)]
    return [F.coalesce(c, F.lit(0)).alias(f"s{i}") for i, c in enumerate([*proof, *like])]


def lanes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys plus lanes array<long>: the vector of each text, every lane in [0, 2^32). Keys must tell rows apart."""
    units = rows.select(*keys, F.explode(_units(F.coalesce(text, F.lit("")))).alias("u"))
    h = F.xxhash64(F.lit(PROOF), "u")
    units = units.withColumn("h", F.when(~F.col("u").startswith("\n"), h))
    size = F.char_length("u").cast("long") * F.when(F.col("h") < 0, -1).otherwise(1)
    high = F.col("h").bitwiseAND(F.lit(HALF)) != 0
    units = units.withColumn("lane", F.col("h").bitwiseAND(F.lit(HALF - 1))).withColumn("add", F.when(high, size * MOD).otherwise(size))
    summed = units.groupBy(*keys).agg(*_sums())
    out = [F.col(f"s{i}").bitwiseAND(F.lit(MOD - 1)) for i in range(PROOF)]
    for i in range(PROOF, PROOF + HALF):
        low = F.col(f"s{i}").bitwiseAND(F.lit(MOD - 1))
        # the high lane lost one where the low one was negative
        out += [F.shiftright(F.col(f"s{i}"), 32) + F.shiftrightunsigned(low, 31), low]
    return summed.select(*keys, F.array(*[x.bitwiseAND(F.lit(MOD - 1)) for x in out]).alias("lanes"))


def to_hex(vector: Column) -> Column:
    """Eight lowercase hex digits a lane."""
    return F.lower(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def from_hex(text: Column) -> Column:
    n = PROOF + LIKE
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.conv(F.substring(text, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint vectors after inserting (sign 1) or deleting (sign -1) the paragraphs of b."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(MOD)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two vectors: the cosine of their LIKE lanes, negative ones counting as 0; 1 for equal vectors."""

    def signed(x: Column) -> Column:
        return F.when(x >= MOD // 2, x - MOD).otherwise(x).cast("double")

    def dot(x: Column, y: Column) -> Column:
        pair = F.zip_with(F.slice(x, PROOF + 1, LIKE), F.slice(y, PROOF + 1, LIKE), lambda p, q: signed(p) * signed(q))
        return F.aggregate(pair, F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a) * dot(b, b))
    cosine = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(cosine)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, lanes, edited (its text with the last quarter replaced by the next document's beginning), edited_lanes, next_lanes, near_edited, near_next."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = id_ranges(docs, "doc_id", F.lit(1), RANGE_ROWS)
    dealt = ranged(docs, "part").withColumn("ghost", F.lit(0))
    # the first document of each range goes behind the range before; that of the first behind the last
    one = Window.partitionBy(F.lit(0)).orderBy("part")
    firsts = ranged(docs.select("doc_id"), "part").groupBy("part").agg(F.min_by("doc_id", F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("head_id"))
    firsts = firsts.select("head_id", F.coalesce(F.lag("part").over(one), F.last("part").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("part"))
    heads = docs.join(F.broadcast(firsts), docs.doc_id.eqNullSafe(firsts.head_id)).groupBy("doc_id", "part").agg(F.min("text").alias("text")).withColumn("ghost", F.lit(1))
    w = Window.partitionBy("part").orderBy("ghost", "doc_id", "text")
    # work on a text costs far more than moving it: as many tasks as the session has shuffle partitions, none merged, and some ranges each
    slots = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ranged.count // TASK_RANGES)
    rows = dealt.unionByName(heads).repartition(slots, "part").withColumn("row", F.row_number().over(w)).withColumn("follows", F.lead("text").over(w))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("text", n - quarter), F.left(F.coalesce("follows", F.lit("")), quarter))
    rows = rows.select("part", "ghost", "doc_id", "row", n.cast("long").alias("n_chars"), F.explode(F.when(F.col("ghost") == 0, F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), edited.alias("body")))).otherwise(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body"))))).alias("v")).select("*", "v.*").drop("v")
    keys = ["part", "row", "ghost", "doc_id", "n_chars", "which", "sha"]
    vectors = lanes(rows.withColumn("sha", F.when(F.col("which") == 1, F.sha2("body", 256))), keys, "body")
    both = vectors.groupBy("part", "row", "ghost", "doc_id", "n_chars").agg(F.max(F.when(F.col("which") == 0, F.col("lanes"))).alias("lanes"), F.max(F.when(F.col("which") == 1, F.col("lanes"))).alias("edited_lanes"), F.max("sha").alias("edited_sha256"))
    after = both.withColumn("next_lanes", F.lead("lanes").over(Window.partitionBy("part").orderBy("row"))).filter("ghost = 0")
    return after.select("doc_id", "n_chars", "edited_sha256", "lanes", "edited_lanes", "next_lanes", likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"), likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"))
