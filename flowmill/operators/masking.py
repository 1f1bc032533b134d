"""Masking of encoded sequences for pre-training.

Everything is an array expression on one row: a sequence has at most a few
hundred tokens, so no position is ever shuffled. Draws are hashes of (seed,
purpose, row identity, position): the same row gives the same mask on every
run, and another ``seed``, ``dup`` or epoch gives another mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions.arrays import let, no_ints, pad_to, repeat_int
from flowmill.functions.rng import hash_key, uniform
from flowmill.operators.encode import CLS, MASK, PAD, RESERVED, SEP, UNK

# Fixed values.
SHARE, KEEP_AS_MASK, KEEP_AS_RANDOM = 0.15, 0.8, 0.9
SPAN_P, SPAN_MAX = 0.2, 10
TARGETS = "array<struct<pos:int,token:int>>"


def used_length(seq: Column) -> Column:
    """Length without the padding; PAD occurs nowhere else in a sequence."""
    return F.size(F.array_remove(seq, PAD))


def budget(seq: Column) -> Column:
    """How many tokens to mask: 15% of the used length, half to even, at least one."""
    return F.greatest(F.lit(1), F.rint(used_length(seq) * F.lit(SHARE)).cast("int"))


def _candidate(token: Column) -> Column:
    return ~token.isin(PAD, CLS, SEP)


def _keys(seq: Column, seed, ident: list[Column]) -> Column:
    """Random sort key per position; null where the token cannot be masked."""
    return F.transform(
        seq, lambda x, i: F.when(_candidate(x), hash_key(seed, "mask", *ident, i))
    )


def _cut(keys: Column, n: Column) -> Column:
    """The key of the last position picked."""
    present = F.sort_array(F.filter(keys, lambda k: k.isNotNull()))
    return let(present, lambda p: F.try_element_at(p, F.least(n, F.size(p))))


def _random_id(u: Column, vocab_size: int) -> Column:
    """Uniform over the ids that may replace a token: UNK and the non-reserved ones."""
    r = F.floor(u * (vocab_size - RESERVED + 1)).cast("int")
    return let(r, lambda k: F.when(k == 0, UNK).otherwise(k + RESERVED - 1).cast("int"))


def _replace(token: Column, draw: Column, other: Column, vocab_size: int) -> Column:
    return let(draw, lambda d: (
        F.when(d < KEEP_AS_MASK, F.lit(MASK).cast("int"))
        .when(d < KEEP_AS_RANDOM, _random_id(other, vocab_size))
        .otherwise(token)
    ))


def picked_positions(seq: Column, seed, ident: list[Column]) -> Column:
    """The mask plan: sorted positions to mask."""
    return let(seq, lambda s: _plan(s, seed, ident))


def _plan(seq, seed, ident):
    return let(
        F.struct(_keys(seq, seed, ident).alias("keys"), budget(seq).alias("n")),
        lambda s: let(
            F.struct(s["keys"].alias("keys"), _cut(s["keys"], s["n"]).alias("cut")),
            lambda c: F.filter(
                F.transform(c["keys"], lambda k, i: F.when(k <= c["cut"], i)),
                lambda i: i.isNotNull(),
            ),
        ),
    )


def _spread(seq: Column, plan: Column, cell) -> Column:
    """The sequence with ``cell(i)`` at the planned positions.

    Put together from the runs between them, so only planned positions are
    evaluated. ``plan`` is sorted.
    """
    runs = F.transform(plan, lambda i, k: let(
        F.coalesce(F.get(plan, k - 1), F.lit(-1)),
        lambda before: F.concat(F.slice(seq, before + 2, i - before - 1), F.array(cell(i))),
    ))
    last = F.coalesce(F.try_element_at(plan, F.lit(-1)), F.lit(-1))
    return F.flatten(F.concat(runs, F.array(F.slice(seq, last + 2, F.size(seq)))))


def _targets(seq: Column, plan: Column) -> Column:
    return F.transform(
        plan, lambda i: F.struct(i.alias("pos"), F.get(seq, i).alias("token"))
    ).cast(TARGETS)


def _apply(seq: Column, plan: Column, seed, salt: str, ident: list[Column], vocab_size: int) -> Column:
    """(masked, targets) of a sequence for planned positions, one draw per position."""
    masked = _spread(seq, plan, lambda i: _replace(
        F.get(seq, i), uniform(seed, salt + "draw", *ident, i),
        uniform(seed, salt + "token", *ident, i), vocab_size,
    ))
    return F.struct(masked.alias("masked"), _targets(seq, plan).alias("targets"))


def mask_tokens(seq: Column, vocab_size: int, seed, ident: list[Column]) -> Column:
    """Independent token masking: struct(masked, targets sorted by position)."""
    return let(seq, lambda s: let(
        _plan(s, seed, ident), lambda plan: _apply(s, plan, seed, "", ident, vocab_size)
    ))


def mask_synchronized(
    size: Column, iat: Column, size_vocab: int, iat_vocab: int, seed, ident: list[Column]
) -> Column:
    """Mask sizes, and IATs at the same positions with draws of their own."""
    return let(F.struct(size.alias("size"), iat.alias("iat")), lambda s: let(
        _plan(s["size"], seed, ident),
        lambda plan: F.struct(
            _apply(s["size"], plan, seed, "", ident, size_vocab).alias("size"),
            _apply(s["iat"], plan, seed, "iat-", ident, iat_vocab).alias("iat"),
        ),
    ))


def _span_cumulative(p: float, longest: int) -> list[float]:
    weights = [p * (1 - p) ** (k - 1) for k in range(1, longest + 1)]
    total, run, out = sum(weights), 0.0, []
    for w in weights[:-1]:
        run += w
        out.append(run / total)
    return out


def span_length(u: Column, p: float = SPAN_P, longest: int = SPAN_MAX) -> Column:
    """Truncated geometric length 1..longest from a uniform draw."""
    steps = F.array(*[F.lit(c) for c in _span_cumulative(p, longest)])
    return let(u, lambda v: F.size(F.filter(steps, lambda c: v >= c)) + 1)


# Spans are kept as one int each while they are chosen: position * SLOT + length.
SLOT = 64


def _pos(span: Column) -> Column:
    return F.floor(span / SLOT).cast("int")


def _len(span: Column) -> Column:
    return span.bitwiseAND(F.lit(SLOT - 1))


def candidate_spans(seq: Column, seed, ident: list[Column], p: float, longest: int) -> Column:
    """Left to right, non-overlapping spans that start on maskable tokens."""
    if longest >= SLOT:
        raise ValueError(f"spans are shorter than {SLOT}")

    def step(acc, e):
        start = _candidate(e["x"]) & (e["i"] >= acc["free"])
        length = span_length(uniform(seed, "span", *ident, e["i"]), p, longest)
        grown = let(length, lambda n: F.struct(
            (e["i"] + n).cast("int").alias("free"),
            F.concat(acc["spans"], F.array(
                (e["i"] * SLOT + F.least(n, e["used"] - e["i"])).cast("int")
            )).alias("spans"),
        ))
        return F.when(start, grown).otherwise(acc)

    items = let(
        used_length(seq),
        lambda used: F.transform(
            F.slice(seq, 1, used),
            lambda x, i: F.struct(x.alias("x"), i.alias("i"), used.alias("used")),
        ),
    )
    start = F.struct(F.lit(0).cast("int").alias("free"), no_ints().alias("spans"))
    return F.aggregate(items, start, step, lambda acc: acc["spans"])


def chosen_spans(spans: Column, n: Column, seed, ident: list[Column]) -> Column:
    """Spans in random order that fit the budget; one that would overflow it is skipped.

    Returned in position order.
    """
    shuffled = F.sort_array(F.transform(
        spans, lambda s: F.struct(hash_key(seed, "mask", *ident, _pos(s)).alias("k"), s.alias("s"))
    ))

    def step(acc, e):
        grown = acc["used"] + _len(e["s"])
        return F.when(grown <= acc["n"], F.struct(
            grown.cast("int").alias("used"), acc["n"].alias("n"),
            F.concat(acc["spans"], F.array(e["s"])).alias("spans"),
        )).otherwise(acc)

    start = F.struct(
        F.lit(0).cast("int").alias("used"), n.cast("int").alias("n"), no_ints().alias("spans")
    )
    return F.sort_array(F.aggregate(shuffled, start, step, lambda acc: acc["spans"]))


def mask_spans(
    seq: Column, vocab_size: int, seed, ident: list[Column],
    p: float = SPAN_P, longest: int = SPAN_MAX,
) -> Column:
    """Span masking: one 80/10/10 draw per span, a fresh random id per position."""
    return let(seq, lambda s: let(
        candidate_spans(s, seed, ident, p, longest),
        lambda spans: let(
            chosen_spans(spans, budget(s), seed, ident),
            lambda chosen: _mask_spans(s, chosen, vocab_size, seed, ident),
        ),
    ))


def _mask_spans(seq, chosen, vocab_size, seed, ident):
    cells = F.flatten(F.transform(chosen, lambda s: F.transform(
        F.sequence(_pos(s), _pos(s) + _len(s) - 1),
        lambda i: F.struct(i.alias("pos"), _pos(s).alias("span")),
    )))

    def build(c):
        places = F.transform(c, lambda x: x["pos"])
        fresh = F.transform(c, lambda x: _replace(
            F.get(seq, x["pos"]), uniform(seed, "draw", *ident, x["span"]),
            uniform(seed, "token", *ident, x["pos"]), vocab_size,
        ))
        return let(F.struct(places.alias("at"), fresh.alias("new")), lambda m: F.struct(
            _spread(seq, m["at"], lambda i: F.get(m["new"], F.array_position(m["at"], i).cast("int") - 1)).alias("masked"),
            _targets(seq, m["at"]).alias("targets"),
        ))

    return let(cells, build)


def dense_targets(targets: Column, length: int) -> Column:
    """Sparse targets -> array of ``length`` with 0 where nothing was masked."""
    def spread(t):
        runs = F.transform(t, lambda e, k: F.concat(
            repeat_int(0, e["pos"] - F.coalesce(F.get(t, k - 1)["pos"], F.lit(-1)) - 1),
            F.array(e["token"]),
        ))
        return F.when(F.size(t) > 0, F.flatten(runs)).otherwise(no_ints())

    return pad_to(let(targets, spread), length, 0)


def static_masking(df: DataFrame, seed=7, spans: bool = False) -> DataFrame:
    """Masks fixed when rows are built: one variant per ``dup``."""
    return _mask_rows(df, seed, [F.col("flow_key"), F.col("dup")], spans)


def dynamic_masking(df: DataFrame, epoch: int, seed=7, spans: bool = False) -> DataFrame:
    """Masks drawn when rows are read: another set per epoch; stored rows stay clean."""
    return _mask_rows(df, seed, [F.col("flow_key"), F.lit(f"epoch{epoch}")], spans)


def _mask_rows(df, seed, ident, spans):
    from flowmill.operators.encode import VOCAB_IAT, VOCAB_RAW, VOCAB_SIZE

    if spans:
        size = mask_spans(F.col("src_size"), VOCAB_SIZE, seed, ident)
        out = df.withColumn("_size", size).withColumn(
            "_iat",
            let(
                F.struct(
                    F.transform("_size.targets", lambda t: t["pos"]).alias("plan"),
                    F.col("src_iat").alias("iat"),
                ),
                lambda s: _apply(s["iat"], s["plan"], seed, "iat-", ident, VOCAB_IAT),
            ),
        )
    else:
        both = mask_synchronized(
            F.col("src_size"), F.col("src_iat"), VOCAB_SIZE, VOCAB_IAT, seed, ident
        )
        out = df.withColumn("_both", both).withColumns({
            "_size": F.col("_both.size"), "_iat": F.col("_both.iat")
        }).drop("_both")
    out = out.withColumns({
        "size_masked": F.col("_size.masked"), "iat_masked": F.col("_iat.masked"),
        "tgt_size": F.col("_size.targets"), "tgt_iat": F.col("_iat.targets"),
    }).drop("_size", "_iat")
    return out


def mask_raw(df: DataFrame, seed=7, spans: bool = False) -> DataFrame:
    """Stage-1 raw rows: masked bytes and their targets (stage 2 never masks bytes)."""
    from flowmill.operators.encode import VOCAB_RAW

    ident = [F.col("flow_key"), F.col("dup")]
    mask = mask_spans if spans else mask_tokens
    return df.withColumn("_m", mask(F.col("src"), VOCAB_RAW, seed, ident)).withColumns({
        "src_masked": F.col("_m.masked"), "tgt": F.col("_m.targets")
    }).drop("_m")


CLEAN_AND_MASKED = (
    "src", "packet_ids", "directions", "src_size", "src_iat",
    "size_masked", "iat_masked", "tgt_size", "tgt_iat",
)


def clean_and_masked(df: DataFrame, length: int = 256, also: tuple[str, ...] = ()) -> DataFrame:
    """The nine-column training row, targets dense; columns named in ``also`` pass through."""
    return df.withColumns({
        "tgt_size": dense_targets(F.col("tgt_size"), length),
        "tgt_iat": dense_targets(F.col("tgt_iat"), length),
    }).select("flow_key", *[c for c in ("dup",) if c in df.columns], *CLEAN_AND_MASKED, *also)


def masked_token_count(df: DataFrame, batch: str = "batch_id", targets: str = "tgt_size") -> DataFrame:
    """Masked tokens per batch; batches without any are left out."""
    return (
        df.groupBy(batch).agg(F.sum(F.size(targets)).cast("bigint").alias("masked"))
        .filter(F.col("masked") > 0)
    )
