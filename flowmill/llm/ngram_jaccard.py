"""N-gram Jaccard join with a count-vector R-tree.

A document is the set of its distinct word shingles. Shingles are hashed into groups; the
group counts of a set are a point. Two sets overlap by at most the sum of the smaller
coordinates, so an R-tree over points, whose nodes keep the largest coordinates and the
smallest set below them, finds all partners that can still reach the similarity. Survivors
are screened with a finer point, of about one coordinate for two shingles, and what is left is
verified on the shingles themselves.

Where trees are built. One tree over all points would be one task, and a search of all leaves
quadratic, so the root's children are keyed by content. Two sets that differ in at most d
shingles agree wholly in at least e + 1 of d + e + 1 ranges of the hash space. Each set is therefore
put below one key per range: (size level, range, sum of the hashes in the range). Ranges
without shingles are no key: if at most e of a set's are empty, one that agrees with any given
partner is not. A set with more empty ranges is keyed again with another hash function, and so is
each partner that shares only empty ranges with it. So every pair that links shares a key, keys of
unrelated texts are distinct, and each key's members are one small tree.

Large groups. Equal sets are one class from the start. Members of a key are dealt into
stripes of bounded size and each looks for its nearest partners there; after the links found
are contracted, a few members of each component look for each other; last, all pairs of a
key that are still in different components and pass the tree's bound are verified, stripe
against stripe. Pairs inside a component are never listed, and no link between components
is lost. The last two rounds search with the finer points, so that a pair that cannot link is not listed
below each of the keys it shares.

Defined cases: null text, or text without words: empty set, linked with nothing. Null id: the row is
kept, links with nothing and has no component. Repeated rows: each keeps its row. An id
with several texts is one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.graph import components, small_enough
from flowmill.llm.words import mix, slices
from flowmill.session import drop_saved, save_and_reload

_U = np.uint64
GROUPS, MOST_GROUPS = 64, 4096  # coordinates of a point, a power of two
GROUP_SHINGLES = 8  # in a coordinate on average, up to MOST_GROUPS of them
FINE = 4  # coordinates of the point that screens pairs, for each one in the trees
STRIPE = 256  # most members searched together
CROSSED = 2048  # most members of two stripes that are searched against each other
LEAF = 16  # entries of a tree node
NEAREST = 2  # partners a member asks for in the first rounds
DELEGATES = 8  # members of a component that look for other components
BROADCAST_ROWS = 1_000_000  # rows of two or three longs
SALTS = 12
_MULTIPLIERS = [_U(m) for m in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93)]


class Rule:
    """Link when 100 * intersection >= percent * union; sets of ``width``-word shingles."""

    def __init__(self, width: int = 3, percent: int = 90):
        if not (1 <= width and 50 <= percent <= 100):
            raise ValueError("width >= 1 and 50 <= percent <= 100")
        self.width, self.percent = width, percent
        self._ranges: dict[int, tuple[int, int]] = {}
        #: Sizes are cut into levels; a level serves pairs whose larger set is in it.
        self.level_from = [1]
        while self.level_from[-1] < 1 << 40:
            low = self.level_from[-1]
            self.level_from.append(max(low + 1, low * 10_000 // (percent * percent)))

    def differ(self, larger: int) -> int:
        """Most shingles in which a set of this size and a linked, smaller one differ.

        100 I >= p U with |A| + |B| = I + U gives U - I <= (|A| + |B|) (100 - p) / (100 + p).
        """
        return 2 * larger * (100 - self.percent) // (100 + self.percent)

    def ranges(self, level: int) -> tuple[int, int]:
        """(ranges, spare) of a level: ``spare`` of a set's ranges may be empty without hiding a partner.

        As many ranges as leave the smallest sets keyed here enough that are not empty.
        """
        if level not in self._ranges:
            d = self.differ(self.level_from[level + 1] - 1)
            least = -(-self.percent * self.level_from[level] // 100)
            best = (d + 2, 1)
            for n in range(d + 1, 2 * d + 3):
                empty = n * math.exp(-least / n)
                if n - d - 1 >= empty + 2 * math.sqrt(empty):
                    best = (n, n - d - 1)
                    break
            self._ranges[level] = best if d else (0, 0)
        return self._ranges[level]

    def levels(self, size: int) -> list[tuple[int, int, int]]:
        """(level, ranges, spare) at which a set of this size is keyed; none where only equality links."""
        own = int(np.searchsorted(self.level_from, size, side="right")) - 1
        found = []
        for level in range(own, len(self.level_from) - 1):
            if level > own and 100 * size < self.percent * self.level_from[level]:
                break
            if self.ranges(level)[0]:
                found.append((level, *self.ranges(level)))
        return found

    def linked(self, overlap, a, b):
        return 100 * overlap >= self.percent * (a + b - overlap)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z are lower-cased."""
    for part in slices(column):
        words = part.hashes(lower=True)
        n = len(words)
        parts = [words[i : max(i, n - width + 1 + i)] * _MULTIPLIERS[i % 6] + _U(i) for i in range(width)]
        whole = mix(np.sum(parts, axis=0, dtype=_U)) if n >= width else np.zeros(0, dtype=_U)
        for low, high in zip(part.word_bounds[:-1], part.word_bounds[1:]):
            if high - low >= width:
                yield np.unique(whole[low : high - width + 1])
            elif high > low:
                short = words[low:high] * np.array(_MULTIPLIERS, dtype=_U)[np.arange(high - low) % 6]
                yield mix(np.array([short.sum(dtype=_U) + _U(high - low)], dtype=_U))
            else:
                yield np.zeros(0, dtype=_U)


def _edges(ranges: int, kept: dict[int, np.ndarray] = {}) -> np.ndarray:
    """Where ``ranges`` equal ranges of the hash space begin, without the first 0."""
    got = kept.get(ranges)
    if got is None:
        got = np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=_U)
        if ranges <= 1 << 12 and len(kept) < 1 << 10:
            kept[ranges] = got
    return got


def _cuts(sorted_set: np.ndarray, ranges: int) -> np.ndarray:
    cuts = np.empty(ranges + 1, dtype=np.int64)
    cuts[0], cuts[-1] = 0, len(sorted_set)
    cuts[1:-1] = np.searchsorted(sorted_set, _edges(ranges), side="left")
    return cuts


def _tag(number: int) -> np.uint64:
    return _U(number * 0x9E3779B97F4A7C15 % (1 << 64))


def keys_of(shingles: np.ndarray, rule: Rule) -> np.ndarray:
    """The keys of a set: any two linked, unequal sets have one in common."""
    found = []
    salted = {}
    for level, ranges, spare in rule.levels(len(shingles)):
        for salt in range(SALTS):
            if salt not in salted:
                own = shingles if salt == 0 else np.sort(mix(shingles + _tag(salt)))
                sums = np.zeros(len(own) + 1, dtype=_U)
                np.cumsum(mix(own ^ _MULTIPLIERS[1]), out=sums[1:])
                salted[salt] = own, sums
            own, sums = salted[salt]
            cuts = _cuts(own, ranges)
            full = cuts[1:] > cuts[:-1]
            place = np.flatnonzero(full if salt < SALTS - 1 else np.ones_like(full)).astype(_U)
            content = (sums[cuts[1:]] - sums[cuts[:-1]])[place.astype(np.int64)]
            found.append(mix(content + mix(place + _tag(level * SALTS + salt))))
            if (~full).sum() <= spare:
                break
    return np.concatenate(found) if found else np.zeros(0, dtype=_U)


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _class_of(shingles: np.ndarray) -> np.uint64:
    size = np.array([len(shingles)], dtype=_U) * _MULTIPLIERS[2]
    return mix(mix(shingles).sum(dtype=_U) ^ size)[0]


def _groups(size: int) -> int:
    """Coordinates for a set of this size. Unrelated large sets would agree in every few coordinates."""
    groups = GROUPS
    while groups < MOST_GROUPS and groups * GROUP_SHINGLES < size:
        groups *= 2
    return groups


def _packed(shingles: np.ndarray, finer: int = 1) -> bytes:
    """A set's point, in as few bytes as its largest coordinate needs."""
    counts = np.diff(_cuts(shingles, _groups(len(shingles)) * finer))
    top = int(counts.max())
    return counts.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def _points(packed: list[bytes], sizes: np.ndarray, finer: int = 1) -> np.ndarray:
    """Points as rows of one matrix, all in the coordinates of the smallest set: ranges are halves of ranges."""
    groups = [_groups(size) * finer for size in sizes.tolist()]
    least = min(groups)
    if least == max(groups) and len(packed[0]) == least and len({len(p) for p in packed}) == 1:
        return np.frombuffer(b"".join(packed), dtype="u1").reshape(-1, least)
    out = np.empty((len(packed), least), dtype=np.uint32)
    for i, (p, g) in enumerate(zip(packed, groups)):
        out[i] = np.frombuffer(p, dtype=f"<u{len(p) // g}").reshape(least, -1).sum(1)
    return out


def _featured(rule: Rule):
    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0), batch.num_rows
            sizes, classes = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=_U)
            points = [b""] * rows
            for i, own in enumerate(shingle_sets(batch.column(1), rule.width)):
                sizes[i] = len(own)
                if len(own):
                    classes[i] = _class_of(own)
                    points[i] = _packed(own)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(sizes), pa.array(_long(classes)),
                pa.array(points, type=pa.binary())], names=["id", "size", "hash", "counts"])

    return run


def _keyed(rule: Rule):
    """(hash, class, text) -> (class, keys) where the text is one of the class.

    An id may have several texts, of which only one is meant.
    """

    def run(batches):
        for batch in batches:
            wanted, found, kept = batch.column(0).to_numpy(), [], []
            for i, own in enumerate(shingle_sets(batch.column(2), rule.width)):
                if len(own) and _class_of(own).view(np.int64) == wanted[i]:
                    kept.append(i)
                    found.append(keys_of(own, rule))
            at = np.concatenate([[0], np.cumsum([len(k) for k in found])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, dtype=_U)
            rows = pa.array(kept, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(rows), pa.ListArray.from_arrays(pa.array(at), pa.array(_long(flat)))],
                names=["class", "keys"])

    return run


class Tree:
    """An R-tree over points, packed by size and then by the coordinates in turn."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((points.argmax(1), sizes))
        self.order, high, low = order, points[order], sizes[order]
        self.levels = [(high, low)]
        while len(high) > LEAF:
            at = np.arange(0, len(high), LEAF)
            high, low = np.maximum.reduceat(high, at), np.minimum.reduceat(low, at)
            self.levels.append((high, low))

    def search(self, points: np.ndarray, sizes: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, bound) of all entries that can still be linked with a query."""
        top = len(self.levels) - 1
        n = len(self.levels[top][1])
        query, node = np.repeat(np.arange(len(points)), n), np.tile(np.arange(n), len(points))
        for level in range(top, -1, -1):
            high, low = self.levels[level]
            kept_q, kept_n, kept_b = [], [], []
            step = max(1, (1 << 21) // points.shape[1])
            for at in range(0, len(query), step):
                q, e = query[at : at + step], node[at : at + step]
                bound = np.minimum(points[q], high[e]).sum(1, dtype=np.int64)
                # The smallest set below a node asks least of the overlap.
                other = np.maximum(low[e], -(-sizes[q] * rule.percent // 100))
                ok = rule.linked(np.minimum(bound, sizes[q]), sizes[q], other)
                kept_q.append(q[ok]), kept_n.append(e[ok]), kept_b.append(bound[ok])
            query, node, bound = map(np.concatenate, (kept_q, kept_n, kept_b))
            if level:
                below = len(self.levels[level - 1][1])
                children = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
                query = np.repeat(query, LEAF)[children < below]
                node = children[children < below]
        return query, self.order[node], bound


def _stripe_pairs(rule: Rule, nearest: int | None, finer: int = 1):
    """Candidate pairs (a < b) of each stripe; rows come sorted by stripe, with points ``finer`` than the trees'."""

    def overlap(points, q, e):
        step = max(1, (1 << 21) // points.shape[1])
        return np.concatenate([np.minimum(points[q[at : at + step]], points[e[at : at + step]]).sum(1, dtype=np.int64)
                               for at in range(0, max(1, len(q)), step)])

    def near(found, fine, sizes, classes, comps, side):
        q, e, bound = found
        ok = (q != e) & (comps[q] != comps[e]) & (classes[q] != classes[e])
        if side is not None:
            ok &= side[q] != side[e]
        if nearest is None:
            ok &= q < e
        q, e, bound = q[ok], e[ok], bound[ok]
        ok = rule.linked(np.minimum(bound, np.minimum(sizes[q], sizes[e])), sizes[q], sizes[e])
        q, e, bound = q[ok], e[ok], bound[ok]
        if finer > 1 and len(q):
            bound = overlap(fine, q, e)
            ok = rule.linked(np.minimum(bound, np.minimum(sizes[q], sizes[e])), sizes[q], sizes[e])
            q, e, bound = q[ok], e[ok], bound[ok]
        if nearest is not None and len(q) > 1:
            likely = bound / (sizes[q] + sizes[e] - bound)
            order = np.lexsort((e, -likely, q))
            q, e = q[order], e[order]
            first = np.searchsorted(q, q, side="left")
            ok = np.arange(len(q)) - first < nearest
            q, e = q[ok], e[ok]
        return np.stack([np.minimum(classes[q], classes[e]), np.maximum(classes[q], classes[e])])

    def search(fine, sizes, *of):
        points = fine if finer == 1 else fine.reshape(len(fine), -1, finer).sum(2, dtype=np.uint32)
        if len(sizes) == 2:
            both = np.array([0, 1]), np.array([1, 0]), overlap(points, np.array([0, 1]), np.array([1, 0]))
            pairs = near(both, fine, sizes, *of)
        else:
            tree, found = Tree(points, sizes), []
            for at in range(0, len(sizes), STRIPE):
                q, e, bound = tree.search(points[at : at + STRIPE], sizes[at : at + STRIPE], rule)
                found.append(near((q + at, e, bound), fine, sizes, *of))
            pairs = np.concatenate(found, axis=1)
        return np.unique(pairs, axis=1) if pairs.shape[1] else pairs

    def groups(batches):
        """Whole stripes; a stripe may reach over the end of a batch."""
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            stripe = table.column("stripe").to_numpy()
            changes = np.flatnonzero(np.diff(stripe))
            last = int(changes[-1]) + 1 if len(changes) else 0
            if last:
                yield table.slice(0, last)
                held = table.slice(last).to_batches()
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches):
        for table in groups(batches):
            stripe = table.column("stripe").to_numpy()
            classes = table.column("class").to_numpy()
            comps, sizes = table.column("comp").to_numpy(), table.column("size").to_numpy()
            side = table.column("side").to_numpy()
            packed = table.column("counts").to_pylist()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(stripe)) + 1, [len(stripe)]])
            found = []
            for low, high in zip(cuts[:-1], cuts[1:]):
                if high - low < 2:
                    continue
                own = slice(low, high)
                split = side[own] if side[low] >= 0 else None
                pairs = search(_points(packed[own], sizes[own], finer), sizes[own], classes[own], comps[own], split)
                if pairs.shape[1]:
                    found.append(pairs)
            if found:
                a, b = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _candidates(members: DataFrame, rule: Rule, nearest: int | None, finer: int = 1) -> DataFrame:
    """Distinct candidate pairs of members (stripe, side, class, comp, size, counts)."""
    rows = members.select("stripe", "side", "class", "comp", "size", "counts")
    dealt = rows.repartition("stripe").sortWithinPartitions("stripe", "class")
    return dealt.mapInArrow(_stripe_pairs(rule, nearest, finer), "a bigint, b bigint").distinct()


def _verified(rule: Rule):
    def run(batches):
        for batch in batches:
            sets_a = shingle_sets(batch.column(2), rule.width)
            sets_b = shingle_sets(batch.column(3), rule.width)
            ok = []
            for a, b in zip(sets_a, sets_b):
                both = np.concatenate([a, b])
                both.sort()
                overlap = int((both[1:] == both[:-1]).sum())
                ok.append(bool(overlap) and bool(rule.linked(overlap, len(a), len(b))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ok, type=pa.bool_())], names=["a", "b", "linked"])

    return run


def _screened(rule: Rule):
    """Pairs whose finer points still allow a link."""

    def run(batches):
        for batch in batches:
            size_a, size_b = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            ok = []
            for a, b, m, n in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), size_a, size_b):
                points = _points([a, b], np.array([m, n]), FINE)
                bound = int(np.minimum(points[0], points[1]).sum(dtype=np.int64))
                ok.append(bool(rule.linked(min(bound, m, n), m, n)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ok, type=pa.bool_())], names=["a", "b", "open"])

    return run


def _verify(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, linked), stored, for pairs of classes; ``texts`` holds (class, size, fine, text).

    Only texts of pairs that pass the screen of finer points are moved.
    """
    def of(end):
        return texts.select(F.col("class").alias(end), F.col("size").alias(f"size_{end}"), F.col("fine").alias(f"fine_{end}"))

    pointed = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "size_a", "fine_a", "size_b", "fine_b")
    screened = save_and_reload(pointed.mapInArrow(_screened(rule), "a bigint, b bigint, open boolean"), "screened")
    open_ = screened.filter("open").select("a", "b")
    ends = save_and_reload(open_.select("a").union(open_.select("b")).distinct().withColumnRenamed("a", "class"), "ends")
    own = texts.select("class", "text").join(small_enough(ends, BROADCAST_ROWS), "class", "left_semi")
    left = open_.join(own.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(own.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    verified = both.select("a", "b", "text_a", "text_b").mapInArrow(
        _verified(rule), "a bigint, b bigint, linked boolean")
    tested = save_and_reload(verified.union(
        screened.filter("not open").select("a", "b", F.lit(False).alias("linked"))), "tested")
    drop_saved(screened, ends)
    return tested


def shingle_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, percent: int = 90
) -> DataFrame:
    """(id, n_shingles, component_id) for each row; see the module for the method and cases."""
    rule = Rule(width, percent)
    ids = F.col(id_col).cast("bigint")
    wide = docs.select(ids.alias("id"), F.col(text_col).cast("string").alias("text"))
    features = save_and_reload(wide.mapInArrow(
        _featured(rule), "id bigint, size bigint, hash bigint, counts binary"), "features")
    named = features.filter("id is not null and size > 0")
    # Equal sets are one class from here on, numbered so that its number packs well in shuffles.
    points = named.groupBy("hash", "size", "counts").agg(F.min("id").alias("id"))
    points = save_and_reload(points.withColumn("class", F.monotonically_increasing_id()), "points")
    chosen = small_enough(points.select("id", "hash", "class"), BROADCAST_ROWS)
    keyed = save_and_reload(wide.join(chosen, "id").select("hash", "class", "text").mapInArrow(
        _keyed(rule), "class bigint, keys array<bigint>"), "keyed")
    pairs, blocks = _blocks(keyed)
    drop_saved(keyed)
    members = save_and_reload(blocks.join(points.select("class", "size", "counts"), "class"), "members")
    own = members.withColumn("comp", F.col("class"))
    # The pair of a key of two is known; larger keys have a tree each.
    first = save_and_reload(
        pairs.union(_candidates(_striped(own), rule, NEAREST)).distinct(), "candidates")
    # Texts are only needed of classes that share a key with another.
    ends = members.select("class").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = small_enough(save_and_reload(points.join(ends, "class").select("id", "hash", "class"), "wanted"), BROADCAST_ROWS)
    texts = save_and_reload(_class_texts(wide.join(wanted, "id"), rule), "texts")

    tested = _verify(first, texts, rule)
    comps = components(tested.filter("linked"))
    fine = texts.select("class", F.col("fine").alias("counts"))
    for delegates in (DELEGATES, None):
        open_ = _open_members(members.drop("counts"), comps)
        if open_.isEmpty():
            break
        if delegates:
            pairs = _candidates(_delegates(open_, delegates).join(fine, "class"), rule, NEAREST, FINE)
        else:
            pairs = _candidates(_crossed(open_.join(fine, "class")), rule, None, FINE)
        pairs = save_and_reload(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "candidates")
        tested = tested.union(_verify(pairs, texts, rule))
        comps = components(tested.filter("linked"))

    # From classes to rows: a class's copies share its component.
    rooted = points.join(comps.withColumnRenamed("node", "class"), "class", "left").select(
        "hash", "id", F.coalesce("component", "class").alias("root"))
    rooted = save_and_reload(rooted, "rooted")
    drop_saved(blocks, members, texts, first)
    least = rooted.groupBy("root").agg(F.min("id").alias("least"))
    of_hash = _joined_by_ids(named, rooted.select("hash", "root").join(least, "root").select("hash", "least"))
    out = features.select("id", "size", F.when(F.col("size") > 0, F.col("hash")).alias("hash"))
    out = out.join(of_hash, "hash", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"))


def _joined_by_ids(named: DataFrame, of_hash: DataFrame) -> DataFrame:
    """Ids with several texts tie the components of these texts together."""
    several = named.groupBy("id").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).filter("a <> b")
    if several.isEmpty():
        return of_hash
    ties = named.select("id", "hash").join(several.select("id"), "id").join(of_hash, "hash").select("id", "least").distinct()
    pairs = ties.join(ties.groupBy("id").agg(F.min("least").alias("a")), "id").select("a", F.col("least").alias("b"))
    merged = components(pairs).select(F.col("node").alias("least"), "component")
    return of_hash.join(merged, "least", "left").select("hash", F.coalesce("component", "least").alias("least"))


def _blocks(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of keys of two classes, and (block, members, class) of larger keys; both stored.

    A key's least and largest class tell its pair from the sums alone; only larger keys
    are joined with their members. Keys with equal members are one block.
    """
    each = keyed.select(F.explode("keys").alias("key"), "class")
    shared = each.groupBy("key").agg(
        F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("n"))
    shared = save_and_reload(shared.filter("lo <> hi"), "shared")
    pairs = save_and_reload(
        shared.filter("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct(), "pairs")
    many = small_enough(shared.filter("n > 2").select("key"), BROADCAST_ROWS)
    below = save_and_reload(each.join(many, "key").distinct(), "below")
    print_ = below.groupBy("key").agg(
        F.bit_xor(F.xxhash64("class")).alias("block"), F.count(F.lit(1)).alias("members"))
    blocks = save_and_reload(below.join(print_, "key").select("block", "members", "class").distinct(), "blocks")
    drop_saved(shared, below)
    return pairs, blocks


def _class_texts(named_texts: DataFrame, rule: Rule) -> DataFrame:
    """(class, size, fine, text): one text per class. An id may have several texts: take the one of the class."""

    def run(batches):
        for batch in batches:
            wanted = batch.column(0).to_numpy()
            kept, sizes, fine = [], [], []
            for i, own in enumerate(shingle_sets(batch.column(2), rule.width)):
                if len(own) and _class_of(own).view(np.int64) == wanted[i]:
                    kept.append(i), sizes.append(len(own)), fine.append(_packed(own, FINE))
            rows = pa.array(kept, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(rows), pa.array(sizes, type=pa.int64()), pa.array(fine, type=pa.binary()),
                 batch.column(2).take(rows)], names=["class", "size", "fine", "text"])

    checked = named_texts.select("hash", "class", "text").mapInArrow(
        run, "class bigint, size bigint, fine binary, text string")
    return checked.dropDuplicates(["class"])


def _striped(members: DataFrame) -> DataFrame:
    """Members of a block in stripes of about STRIPE at most."""
    stripes = F.ceil(F.col("members") / STRIPE)
    own = F.pmod(F.xxhash64("class", F.lit("stripe")), stripes)
    return members.withColumn("stripe", F.xxhash64("block", own)).withColumn("side", F.lit(-1))


def _open_members(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of blocks that hold more than one component."""
    known = comps.withColumnRenamed("node", "class")
    now = members.join(known, "class", "left").withColumn("comp", F.coalesce("component", "class")).drop("component")
    now = save_and_reload(now, "open")
    mixed = now.groupBy("block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    return now.join(mixed.select("block"), "block")


def _delegates(open_: DataFrame, most: int) -> DataFrame:
    """A few members of each component in a block, in stripes of bounded size.

    Chosen by hash: the least of each of ``most`` residues, so counting and choosing is a
    sum over what the tasks have seen.
    """
    part = F.pmod(F.xxhash64("class", F.lit("delegate")), F.lit(most))
    least = open_.groupBy("block", "comp", part.alias("part")).agg(F.min("class").alias("class"))
    least = save_and_reload(least.select("block", "comp", "class"), "delegates")
    count = least.groupBy("block").agg(F.count(F.lit(1)).alias("members"))
    rows = least.join(count, "block").join(
        open_.select("block", "class", "size"), ["block", "class"])
    return _striped(rows)


def _crossed(open_: DataFrame) -> DataFrame:
    """All members, each stripe of a block beside each other one and beside itself."""
    stripes = F.ceil(F.col("members") * 2 / CROSSED)
    rows = open_.withColumn("stripes", stripes.cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class", F.lit("stripe")), F.col("stripes")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)))
    alone = F.col("own") == F.col("other")
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return rows.withColumn("stripe", F.xxhash64("block", low, high)).withColumn(
        "side", F.when(alone, F.lit(-1)).otherwise(F.when(F.col("own") < F.col("other"), 0).otherwise(1)))
