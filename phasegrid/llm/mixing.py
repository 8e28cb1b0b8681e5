"""Mixing sources to target weights, by Sainte-Laguë apportionment of equal-token blocks.

Targets: sources share all words by weight; a target stops at `cap` times its source's size and the
excess goes to the others by weight (a water level over the sources sorted by where they stop).
Whole passes over a source are taken as such. What is left of each target is bought in blocks of
`block` words: Sainte-Laguë quotients give each source an integer number of blocks, and then each of
its shards (hash buckets of documents; a source's words run through its shards in order). Each shard
takes that many consecutive blocks of its seeded document order from a seeded block on, around the end.

DataFrame functions only. The documents are shuffled once, by (source, shard), so a hot source is
spread over its shards, which follow the bytes of text; everything per source works on a row a shard.

Defined results: null text has size 0; the null source is a source of its own, after all others;
sources without words get target 0; rows with equal doc_id count as different documents, and their order
depends on their columns only, so that the same rows in any order give the same mix; other columns pass whatever
their names, and the operator's own (size, source_size, target, taken, epochs, extra) replace any of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.llm.store import packed, row_hash, unpacked

WORD = r"[^\x20\x09-\x0D]+"
OWN = ("size", "source_size", "target", "taken", "epochs", "extra")
#: Shards of a source: at least so many, and one for so many bytes of text.
SHARDS, SHARD_BYTES = 256, 256 << 20


def apportion(rows: DataFrame, group: list[str], name: list[str], votes: str, seats: str, into: str) -> DataFrame:
    """rows plus the long column `into`: `seats` (one value a group) dealt out by highest quotients votes / (2k + 1).

    The first guess rounds each share; what it misses by is settled among the next (or last) quotients
    of each row, of which a row can win at most its share of the difference and a little more.
    """
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    share = F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(0.0)
    guess = rows.withColumn("_all", F.sum(votes).over(g).cast("double")).withColumn("_share", share).withColumn("_guess", F.floor(F.col("_share") * F.col(seats) + 0.5).cast("long"))
    guess = guess.withColumn("_miss", F.when(F.col("_all") > 0, F.col(seats) - F.sum("_guess").over(g)).otherwise(0).cast("long"))
    few = F.when(F.col("_miss") > 0, F.ceil(F.col("_miss") * F.col("_share")) + 2).otherwise(F.least(F.ceil(-F.col("_miss") * F.col("_share")) + 2, "_guess"))
    offers = guess.filter((F.col("_miss") != 0) & (F.col(votes) > 0) & (few > 0)).select(*group, *name, votes, "_guess", "_miss", F.explode(F.sequence(F.lit(1), few.cast("int"))).alias("_k"))
    seat = F.when(F.col("_miss") > 0, F.col("_guess") + F.col("_k") - 1).otherwise(F.col("_guess") - F.col("_k"))
    quotient = F.col(votes) / (2 * seat + 1)
    ranked = offers.withColumn("_r", F.row_number().over(g.orderBy(F.when(F.col("_miss") > 0, -quotient).otherwise(quotient), *name)))
    won = ranked.filter(F.col("_r") <= F.abs("_miss")).groupBy(*group, *name).agg(F.sum(F.signum("_miss")).cast("long").alias("_won"))
    return guess.join(won, [*group, *name], "left").withColumn(into, F.col("_guess") + F.coalesce("_won", F.lit(0))).drop("_all", "_share", "_guess", "_miss", "_won")


def targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """sources (_null, _src, source_size) plus weight, target (double), epochs (whole passes) and rest (words beyond them)."""
    one = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(one.orderBy("_null", "_src")) - 1
    t = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    t = t.withColumn("_stop", cap * F.col("source_size") / F.col("weight"))
    up = one.orderBy("_stop", "_null", "_src").rowsBetween(Window.unboundedPreceding, -1)
    full = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words, weight = F.sum("source_size").over(full), F.sum("weight").over(full)
    level = (words - cap * F.coalesce(F.sum("source_size").over(up), F.lit(0))) / (weight - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
    t = t.withColumn("_stops", level >= F.col("_stop"))
    left = F.sum(F.when(~F.col("_stops"), F.col("weight"))).over(full)
    share = (words - cap * F.coalesce(F.sum(F.when(F.col("_stops"), F.col("source_size"))).over(full), F.lit(0))) / left
    t = t.withColumn("target", F.when(F.col("_stops"), cap * F.col("source_size").cast("double")).otherwise(share * F.col("weight")))
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    return t.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))).drop("_stop", "_stops")


def _overlap(a: Column, b: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0), F.least(b, high) - F.greatest(a, low))


def _planned(docs: DataFrame, weights: tuple[int, ...], cap: int, block: int, shards: int | None, seed: int) -> DataFrame:
    """row (all columns but text), text, the OWN columns and the plan's, which begin with a line."""
    docs = docs.drop(*OWN)
    if shards is None:
        shards = max(SHARDS, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    sized = docs.select(
        packed(docs, "text"), "text",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col("source").isNull().alias("_null"),
        F.coalesce("source", F.lit("")).alias("_src"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(shards)).cast("int").alias("_shard"),
        F.xxhash64(F.lit(seed + 1), "doc_id").alias("_first"), F.col("doc_id").alias("_id"), row_hash(docs).alias("_last"),
    )
    cells = sized.groupBy("_null", "_src", "_shard").agg(F.sum("size").alias("_words"))
    sources = targets(cells.groupBy("_null", "_src").agg(F.sum("_words").alias("source_size")), weights, cap)
    all_seats = F.round(F.sum("rest").over(Window.partitionBy(F.lit(0))) / block).cast("long")
    sources = apportion(sources.withColumn("_seats", all_seats), [], ["_null", "_src"], "rest", "_seats", "quota").drop("_seats")
    own, before = Window.partitionBy("_null", "_src").orderBy("_shard"), (Window.unboundedPreceding, -1)
    cells = cells.join(sources, ["_null", "_src"])
    cells = cells.withColumn("_off", F.coalesce(F.sum("_words").over(own.rowsBetween(*before)), F.lit(0)))
    cells = cells.withColumn("_nb", F.ceil((F.col("_off") + F.col("_words")) / block) - F.ceil(F.col("_off") / block)).withColumn("_edge", F.ceil(F.col("_off") / block) * block)
    cells = apportion(cells, ["_null", "_src"], ["_shard"], "_nb", "quota", "_q").withColumn("_q", F.least("_q", "_nb"))
    cells = cells.withColumn("_rot", F.when(F.col("_nb") > 0, F.pmod(F.xxhash64(F.lit(seed), "_src", "_shard"), "_nb")).otherwise(0))
    last = F.when(F.col("_nb") > 0, F.pmod(F.col("_nb") - 1 - F.col("_rot"), "_nb") < F.col("_q"))
    cells = cells.withColumn("_enter", F.coalesce(F.last(last, True).over(own.rowsBetween(*before)), F.lit(False)))
    order = Window.partitionBy("_null", "_src", "_shard").orderBy("_first", "_id", "_last").rowsBetween(*before)
    placed = sized.withColumn("_at", F.coalesce(F.sum("size").over(order), F.lit(0)))
    met = placed.join(cells.drop("_words", "weight", "rest", "quota"), ["_null", "_src", "_shard"]).withColumn("_at", F.col("_at") + F.col("_off"))
    a, b, edge = F.col("_at"), F.col("_at") + F.col("size"), F.col("_edge")
    over = F.col("_rot") + F.col("_q") - F.col("_nb")
    extra = F.when(F.col("_enter"), F.greatest(F.lit(0), F.least(b, edge) - a)).otherwise(0)
    extra = extra + _overlap(a - edge, b - edge, F.col("_rot") * block, F.least(F.col("_rot") + F.col("_q"), "_nb") * block) + _overlap(a - edge, b - edge, F.lit(0), over * block)
    return met.withColumn("extra", extra.cast("long")).withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block: int = 16, shards: int | None = None, seed: int = 7) -> DataFrame:
    """docs (doc_id, text, source, ...) plus size, source_size, taken, epochs, extra (long) and target (double).

    taken = epochs * size + extra; see taken_words() for the words that extra counts.
    """
    met = _planned(docs, weights, cap, block, shards, seed)
    return met.select(*unpacked(docs.drop(*OWN).columns, "text"), *OWN)


def taken_words(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block: int = 16, shards: int | None = None, seed: int = 7) -> DataFrame:
    """The mix itself, with the columns of docs: each document `epochs` times whole, and once more with its extra words
    (joined by one space unless that is all of them); n_chars, if there, follows the text."""
    mixed, names = _planned(docs, weights, cap, block, shards, seed), [c for c in docs.columns if c not in OWN]
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    place = F.col("_at") - F.col("_edge")

    def chosen(_w: Column, i: Column) -> Column:
        p = place + i
        return F.when(p < 0, F.col("_enter")).otherwise(F.pmod(F.floor(p / block) - F.col("_rot"), F.greatest(F.col("_nb"), F.lit(1))) < F.col("_q"))

    part = F.when(F.col("extra") == F.col("size"), F.col("text")).when(F.col("extra") > 0, F.array_join(F.filter(words, chosen), " "))
    copies = F.concat(F.array_repeat(F.lit(True), F.col("epochs").cast("int")), F.when(F.col("extra") > 0, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    out = mixed.withColumn("_whole", F.explode(copies)).withColumn("text", F.when(F.col("_whole"), F.col("text")).otherwise(part))
    out = out.select(unpacked(names, "text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in names else out
