"""Mixing sources to target weights with pivotal dependent rounding.

Each source gets a target of words: a share of all words by weight, at most ``most`` times
its own words, what is above reshared by weight among the others. A document's expected
copies are target / words of its source; the whole part is taken as it is and the fraction
is rounded by the pivotal method: two fractional units meet, mass moves at random from one
to the other until one of them is 0 or 1, and the rest goes on. So a source's number of
copies is its expected one, and as units meet in order of size, so is its number of words
but for a few documents.

The rounding is a reduction tree. Documents of a source are ranked by size class and
hash and cut into chunks of 64; a chunk leaves one residual unit, 64 chunks' residuals meet
in the next level, and so on up to one unit for each source. All documents of a chunk have
the same fraction, so a chunk is rounded from its length alone, and only residuals are ever
gathered, 64 at a time. Draws are hashes of (seed, source, level, chunk, place): reruns agree.
Masses are integers of 2^-40, so none is lost.

Only DataFrame expressions are used. Defined cases: null sizes are 0; a null source is a source, the last
one; documents without words may be taken, which adds none; repeated rows and null ids
are documents of their own; no rows give no rows. Other columns pass through; ``source_size``,
``target`` and ``copies`` replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions.ranking import with_rank
from flowmill.llm.graph import small_enough
from flowmill.session import save_and_reload

FAN = 64
ONE = 1 << 40
SOURCES, CHUNKS = 10_000, 100_000  # most rows that are broadcast


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, *, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_no, source_size, source_rows, target): water filling below the caps.

    With sources in order of cap / weight, those before the first one that stays below its
    cap are at their caps. One row for each source is ordered in one task.
    """
    total = sized.groupBy("_source").agg(
        F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    total = total.withColumn("source_no", F.row_number().over(by_name))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") - 1) % len(weights) + 1)
    everything = Window.partitionBy(F.lit(0))
    total = total.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    total = total.withColumn("all", F.sum("source_size").over(everything) * F.lit(float(share)))
    filling = Window.orderBy(F.col("cap") / F.col("w"), "source_no")
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    total = total.withColumn("level", (F.col("all") - before) / rest).withColumn("at", F.row_number().over(filling))
    below = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("at", "level"))
    total = total.withColumn("reached", F.min(below).over(everything)["level"])
    target = F.when(F.col("reached").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("reached") * F.col("w")))
    return total.select("_source", "source_no", "source_size", "source_rows", target.alias("target"))


def _rounded(units: Column, seed: int, level: int) -> Column:
    """Pivotal rounding of an array of (place, mass): (place, mass left, places that became 1)."""
    draw = f"(pmod(xxhash64({seed}L, {level}, source_no, parent, u.place), {1 << 52}L) / {float(1 << 52)}D)"
    step = f"""
      (a, u) -> case
        when u.mass = 0 then a
        when a.mass = 0 then named_struct('place', u.place, 'mass', u.mass, 'ones', a.ones)
        when a.mass + u.mass < {ONE}L then named_struct(
          'place', if({draw} * (a.mass + u.mass) < a.mass, a.place, u.place), 'mass', a.mass + u.mass, 'ones', a.ones)
        when {draw} * ({2 * ONE}L - a.mass - u.mass) < {ONE}L - u.mass then named_struct(
          'place', u.place, 'mass', a.mass + u.mass - {ONE}L, 'ones', concat(a.ones, array(a.place)))
        else named_struct(
          'place', a.place, 'mass', a.mass + u.mass - {ONE}L, 'ones', concat(a.ones, array(u.place)))
      end"""
    start = "named_struct('place', -1, 'mass', 0L, 'ones', cast(array() as array<int>))"
    return F.expr(f"aggregate({units}, {start}, {step})")


def _chunks(sources: DataFrame, seed: int) -> DataFrame:
    """(source_no, id, place, mass, ones): what each chunk of documents leaves and decides."""
    wide = FAN * 4096
    far = sources.select(
        "source_no", "source_rows", "fraction",
        F.explode(F.expr(f"sequence(0L, (source_rows - 1) div {wide})")).alias("far"))
    near = far.repartition("source_no", "far").select(
        "source_no", "fraction", "source_rows",
        F.explode(F.expr(f"sequence(far * 4096, least(far * 4096 + 4095, (source_rows - 1) div {FAN}))")).alias("parent"))
    rows = F.expr(f"cast(least({FAN}, source_rows - parent * {FAN}) as int)")
    filled = near.withColumn("rows", rows).withColumn(
        "units", F.expr("transform(sequence(0, rows - 1), i -> named_struct('place', i, 'mass', fraction))"))
    rounded = filled.withColumn("got", _rounded("units", seed, 0))
    return rounded.select("source_no", F.col("parent").alias("id"), "got.place", "got.mass", "got.ones")


def _decided(below: DataFrame, rows: int, seed: int, level: int = 1) -> DataFrame:
    """(source_no, id, won): whether the residual unit of a node becomes 1."""
    if rows <= 1:
        draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(-1), "source_no"), F.lit(ONE))
        return below.select("source_no", "id", (draw < F.col("mass")).alias("won"))
    units = below.select("source_no", F.expr(f"id div {FAN}").alias("parent"),
                         F.expr(f"cast(id % {FAN} as int)").alias("place"), "mass")
    met = units.groupBy("source_no", "parent").agg(F.sort_array(F.collect_list(F.struct("place", "mass"))).alias("units"))
    met = met.withColumn("got", _rounded("units", seed, level)).select(
        "source_no", F.col("parent").alias("id"), "got.place", "got.mass", "got.ones")
    above = _decided(met, -(-rows // FAN), seed, level + 1)
    known = met.join(above, ["source_no", "id"]).select(
        "source_no", F.col("id").alias("parent"), F.col("place").alias("last"), "ones", "won")
    won = F.array_contains("ones", F.col("place")) | ((F.col("place") == F.col("last")) & F.col("won"))
    return units.join(known, ["source_no", "parent"]).select(
        "source_no", (F.col("parent") * FAN + F.col("place")).alias("id"), won.alias("won"))


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size",
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 0,
) -> DataFrame:
    """``docs`` with source_size, target (both of its source) and copies (0 to ``most``)."""
    if most < share or most < 1:
        raise ValueError("the targets do not fit: most must be at least share")
    given = docs.drop("source_size", "target", "copies")
    stored = save_and_reload(given.withColumns({
        "_source": F.col(source_col).cast("string"), "_size": F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)),
    }), "sized")
    targets = source_targets(stored, weights=weights, share=share, most=most)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    expected = F.round(expected * ONE).cast("bigint")
    targets = save_and_reload(targets.withColumns({
        "whole": F.expr("0L") + F.floor(expected / F.lit(ONE)), "fraction": F.pmod(expected, F.lit(ONE))}), "targets")
    longest = targets.agg(F.max("source_rows")).first()[0] or 0
    chunks = save_and_reload(_chunks(targets, seed), "chunks")
    won = _decided(chunks.select("source_no", "id", "mass"), -(-longest // FAN), seed)
    chunks = chunks.join(won, ["source_no", "id"]).select(
        "source_no", F.col("id").alias("_chunk"), F.col("place").alias("_last"), "ones", "won")

    by_name = small_enough(targets.withColumnRenamed("_source", "_name"), SOURCES)
    known = stored.join(by_name, F.col("_source").eqNullSafe(F.col("_name")))
    drawn = F.xxhash64(F.lit(seed), F.col(id_col))
    known = known.withColumn("_hash", drawn).withColumn(
        "_class", -F.floor(64 * F.log2(F.col("_size") + 1)).cast("int"))
    # 16 parts of a size class, by the leading bits of the hash, are the buckets that are ranked alone.
    ranked = with_rank(
        known, ["source_no"], [F.col("_class"), F.col("_hash"), F.col("_size"), F.col(id_col)],
        F.col("_class") * 16 + F.shiftright("_hash", 60) + 8, rank="_rank")
    placed = ranked.withColumn("_chunk", F.expr(f"_rank div {FAN}")).withColumn(
        "_place", F.expr(f"cast(_rank % {FAN} as int)"))
    placed = placed.join(small_enough(chunks, CHUNKS), ["source_no", "_chunk"])
    one = F.array_contains("ones", F.col("_place")) | ((F.col("_place") == F.col("_last")) & F.col("won"))
    copies = (F.col("whole") + one.cast("bigint")).alias("copies")
    return placed.select(*given.columns, "source_size", "target", copies)
