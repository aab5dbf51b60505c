"""Documents whose shingle sets are similar, by PartEnum signatures.

Sizes are cut into bands. For a band, all pairs that can link differ in at most ``k``
shingles. The domain of shingles is cut into more than ``k`` parts, so two such sets agree on
all shingles of some part: each part of a set is a signature, and sets that share one are
candidates. (These are PartEnum's subsets of all parts of a first-level partition but none:
the choice with the fewest signatures for sets this large.) There are so many more parts
than ``k`` that agreeing on empty parts alone is rare; a set of which that can hold says so in one
more signature, which keeps the join complete.

Equal sets are one set from the start. Each set is first compared with a few members of its
groups, and again with others in components it is not linked to. Sets that are linked
need no further comparison, so a group of near copies does not become all its pairs. Sets of
one group that are still not linked are then compared with all others of it, but for
pairs that a bound on the difference excludes.

That makes the components. All links lie inside them, so the links of a component are found by
counting what all pairs of its sets share, block by block, unless those known are all pairs already.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import if_small, mix64, tidy, unused
from .graph import components, components_after
from .substrings import LAST
from .words import WordReader, Words, constants, shared_groups, sums_by_text

SHINGLE = 5
SIMILARITY = 80  # percent
WIDTH = 1.6  # the largest size of a band against its smallest
BUCKETS = 256  # of the counts that bound the difference of two sets
MEMBERS_AT_ONCE = 1024
PAIRS_AT_ONCE = 1000
PAIRS_HELD = 300_000
# Of a block of a component whose pairs are all compared, and how columns of it are counted.
SHINGLES_AT_ONCE = 1 << 19
FEW = 32
COLUMNS_AT_ONCE = 1024
# Before groups are compared completely: how often sets are tried, and against how many others.
# A round that adds less than a part in WORTHWHILE to the links is the last one.
ROUNDS = 3
TRIED = 6
WORTHWHILE = 20


@dataclass
class Sets:
    """Sorted distinct shingles of a run of texts, and the first of each text, with the end."""

    shingles: np.ndarray
    first: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def signature(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each set."""
        n = self.sizes.astype(np.uint64)
        c = constants(2, 17)
        return tuple(mix64(sums_by_text(mix64(self.shingles ^ x), self.first) + n) for x in c)

    def buckets(self) -> np.ndarray:
        """How many shingles of each set fall into each bucket, at most 255."""
        where = np.repeat(np.arange(len(self.sizes)), self.sizes) * BUCKETS + (self.shingles >> np.uint64(56)).astype(np.int64)
        return np.minimum(np.bincount(where, minlength=len(self.sizes) * BUCKETS), 255).astype(np.uint8).reshape(-1, BUCKETS)


def shingle_sets(words: Words, length: int = SHINGLE) -> Sets:
    """Distinct runs of ``length`` words; of a shorter text all its words; of none nothing."""
    grams, fits = words.runs(length, 11)
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < length))
    for n in range(1, length):
        some = short[counts[short] == n]
        if len(some):
            at = words.first[some]
            grams[at] = mix64(words.runs(n, 11 + n)[0][at] + np.uint64(n))
            fits[at] = True
    per_text = np.add.reduceat(np.append(fits, False).astype(np.int64), np.minimum(words.first[:-1], len(fits)))
    per_text[counts == 0] = 0
    grams = grams[fits]
    first = np.concatenate(([0], np.cumsum(per_text)))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    new[first[:-1][per_text > 0]] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    return Sets(grams[new], kept[first])


@dataclass(frozen=True)
class Band:
    """Sizes from ``low`` to ``high`` against themselves and what can be similar above."""

    number: int
    low: int
    high: int
    reach: int
    differ: int
    parts: int


def bands(largest: int, similarity: int = SIMILARITY, width: float = WIDTH) -> list[Band]:
    """Bands over all sizes up to ``largest``; those whose sets must be equal are left out."""
    out, low, number = [], 1, 0
    while low <= largest:
        high = max(low, int(low * width))
        reach = high * 100 // similarity
        # Of two sets of r and s shingles at least (r + s) * similarity / (100 + similarity) are shared.
        differ = (high + reach) * (100 - similarity) // (100 + similarity)
        if differ:
            out.append(Band(number, low, high, reach, differ, int(1.2 * differ) + 4))
        low, number = high + 1, number + 1
    return out


def part_signatures(sets: Sets, similarity: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text) of all parts of all sets that are not empty."""
    sizes, found = sets.sizes, []
    for band in bands(int(sizes.max(initial=0)), similarity):
        texts = np.flatnonzero((sizes >= band.low) & (sizes <= band.reach))
        if not len(texts):
            continue
        n = sizes[texts]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(sets.first[texts], n)
        own = sets.shingles[at]
        part = (mix64(own + np.uint64(band.number + 1)) >> np.uint64(33)).astype(np.int64) % band.parts
        place = np.repeat(np.arange(len(texts), dtype=np.int64), n) * band.parts + part
        order = np.argsort(place)
        place, own = place[order], own[order]
        begins = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        total = np.add.reduceat(own, begins)
        which = place[begins]
        text, part = which // band.parts, (which % band.parts).astype(np.uint64)
        salt = mix64(part + np.uint64((band.number + 1) << 40))
        found.append((mix64(total + salt), texts[text]))
        empty = band.parts - np.bincount(text, minlength=len(texts))
        hollow = texts[empty >= band.parts - band.differ]
        found.append((np.full(len(hollow), mix64(np.array([(band.number + 1) << 20], np.uint64))[0]), hollow))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _described(docs: DataFrame, length: int) -> DataFrame:
    """id and text key, number of shingles, signature and bucket counts of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = WordReader(fold_case=True)
        for batch in batches:
            for i, words in read.texts(batch.column(2)):
                sets = shingle_sets(words, length)
                a, b = sets.signature()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, len(a)), batch.column(1).slice(i, len(a)), pa.array(sets.sizes.astype(np.int64)),
                        pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                        pa.array([row.tobytes() for row in sets.buckets()], pa.binary()),
                    ],
                    names=["id", "mark", "n", "a", "b", "counts"],
                )

    return docs.mapInArrow(tidy(run), "id long, mark long, n long, a long, b long, counts binary")


def _signed(docs: DataFrame, length: int, similarity: int) -> DataFrame:
    """(part signature, set) for the sets of each task; equal sets in a task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, seen = WordReader(fold_case=True), set()
        for batch in batches:
            for _, words in read.texts(batch.column(2)):
                sets = shingle_sets(words, length)
                name = sets.signature()[0].view(np.int64)
                fresh = np.array([s not in seen and not seen.add(s) for s in name.tolist()], bool)
                sign, text = part_signatures(sets, similarity)
                keep = fresh[text]
                if keep.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sign[keep].view(np.int64)), pa.array(name[text[keep]])], names=["h", "a"]
                    )

    return docs.mapInArrow(tidy(run), "h long, a long")


def _grouped(keys: DataFrame) -> DataFrame:
    """Sets that share a signature, each with another set of its group; one shuffle."""
    ordered = keys.repartition("h").sortWithinPartitions("h", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, member, partner in shared_groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(member), pa.array(partner)], names=["h", "a", "partner"])

    return ordered.mapInArrow(tidy(run), "h long, a long, partner long")


def far_apart(n1, counts1, n2, counts2, similarity: int) -> np.ndarray:
    """Which pairs can't be similar: their sizes or their bucket counts differ too much.

    Two sets differ in at least the sum of what their counts differ by.
    """
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    out = 100 * small < similarity * large
    near = np.flatnonzero(~out)
    for i in range(0, len(near), 1 << 14):
        some = near[i : i + (1 << 14)]
        apart = np.abs(counts1[some].astype(np.int16) - counts2[some]).sum(axis=1, dtype=np.int64)
        out[some] = apart > (n1[some] + n2[some]) * (100 - similarity) // (100 + similarity)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BUCKETS)


def _plausible(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs that no bound excludes."""
    x = sets.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("counts").alias("cx"))
    y = sets.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("counts").alias("cy"))
    both = pairs.join(x, "x").join(y, "y").select("x", "y", "nx", "ny", "cx", "cy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = far_apart(
                batch.column(2).to_numpy(), _matrix(batch.column(4)), batch.column(3).to_numpy(), _matrix(batch.column(5)),
                similarity,
            )
            yield batch.select(["x", "y"]).filter(pa.array(~far))

    return both.mapInArrow(tidy(run), "x long, y long")


def _verified(texts: DataFrame, pairs: DataFrame, length: int, similarity: int) -> DataFrame:
    """The pairs (x, y) of classes whose sets are similar enough.

    A text moves once for each pair it is the larger one of, and once as the smaller one,
    whose set alone is held while the others pass. A text may be there twice. A hub of many pairs is dealt over
    several tasks.
    """
    hubs = pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / PAIRS_AT_ONCE).cast("int").alias("salts"))
    roles = (
        pairs.join(hubs, "y")
        .select(F.col("x").alias("id"), F.col("y").alias("hub"), F.pmod(F.xxhash64("x"), "salts").cast("int").alias("salt"))
        .unionByName(hubs.select(
            F.col("y").alias("id"), F.col("y").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
        ))
    )
    # Each pair has two roles at most; ``pairs`` is a stored table, so it is counted cheaply.
    sent = texts.join(if_small(roles, 2 * pairs.count()), "id").select("hub", "salt", (F.col("id") != F.col("hub")).alias("other"), "id", "text")
    ordered = sent.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "other", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = WordReader(fold_case=True)
        hub, mine, last = None, np.empty(0, np.uint64), None
        for batch in batches:
            hubs, other, ids = (batch.column(k).to_pylist() for k in range(3))
            xs, ys = [], []
            for i, words in read.texts(batch.column(3)):
                sets = shingle_sets(words, length)
                for k in range(len(sets.sizes)):
                    own = sets.shingles[sets.first[k] : sets.first[k + 1]]
                    again, last = last == (hubs[i + k], ids[i + k]), (hubs[i + k], ids[i + k])
                    if not other[i + k]:
                        hub, mine = hubs[i + k], own.copy()
                    elif again:
                        continue
                    elif hub == hubs[i + k] and len(own) and len(mine):
                        at = np.minimum(np.searchsorted(mine, own), len(mine) - 1)
                        both = int((mine[at] == own).sum())
                        if 100 * both >= similarity * (len(own) + len(mine) - both):
                            xs.append(ids[i + k])
                            ys.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    return ordered.select("hub", "other", "id", "text").mapInArrow(tidy(run), "x long, y long")


def pairs_in_groups(key, block, other, ids, label, n, counts, similarity: int) -> np.ndarray:
    """(larger id, smaller id) of pairs of rows with one key that aren't linked and no bound excludes.

    The rows come sorted by key. Where a group's two blocks differ, only rows of different
    blocks are paired. All groups advance together, by the distance of the two rows.
    """
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.repeat(np.append(starts[1:], len(key)), np.diff(np.append(starts, len(key))))
    left = np.arange(len(key))
    xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = 1
    while True:
        left = left[left + step < ends[left]]
        if not len(left):
            break
        right = left + step
        open_ = (label[left] != label[right]) & ((block[left] != block[right]) | (block[left] == other[left]))
        p, q = left[open_], right[open_]
        near = ~far_apart(n[p], counts[p], n[q], counts[q], similarity)
        xs.append(np.maximum(ids[p], ids[q])[near])
        ys.append(np.minimum(ids[p], ids[q])[near])
        step += 1
    return np.unique(np.stack((np.concatenate(xs), np.concatenate(ys))), axis=1)


def _open_pairs(rows: DataFrame, similarity: int) -> DataFrame:
    """Pairs to be compared inside the groups of ``rows`` (h, m, id, component, n, counts), see ``_open_groups``.

    A group of more than MEMBERS_AT_ONCE rows is cut into blocks, and each pair of blocks is
    a group of its own, so a task holds a bounded number of rows whatever a group's size.
    """
    blocks = F.ceil(F.col("m") / MEMBERS_AT_ONCE).cast("int")
    cut = rows.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn(
        "with", F.explode(F.sequence(F.lit(0), blocks - 1))
    )
    ordered = cut.select(
        "h", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "with",
        "id", "component", "n", "counts",
    ).repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sets share many groups, so a task's pairs are made distinct before they move.
        held, found, waiting = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            held = whole if held is None else pa.concat_tables([held, whole])
            h, i, j = (held.column(k).to_numpy() for k in range(3))
            cut = int(np.flatnonzero((h == h[-1]) & (i == i[-1]) & (j == j[-1]))[0])
            if cut:
                found.append(pairs(held.slice(0, cut)))
                held, waiting = held.slice(cut), waiting + found[-1].shape[1]
            if waiting > PAIRS_HELD:
                yield distinct(found)
                found, waiting = [], 0
        if held is not None:
            yield distinct([*found, pairs(held)])

    def pairs(rows: pa.Table) -> np.ndarray:
        h, i, j, block, with_, ids, label, n = (rows.column(k).to_numpy() for k in range(8))
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        return pairs_in_groups(
            np.cumsum(new), block, np.where(i == j, block, -1), ids, label, n, _matrix(rows.column(8)), similarity
        )

    def distinct(found: list[np.ndarray]) -> pa.RecordBatch:
        x, y = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])

    return ordered.mapInArrow(tidy(run), "x long, y long").distinct()


def _open_groups(groups: DataFrame, label: DataFrame) -> DataFrame:
    """(h, id, component) of groups whose members are not all linked.

    Sets that share one part share many as a rule, and a passage of many texts makes many groups of
    about the same sets. Groups with the same member by least hash become one, of all their members: groups are
    likely to be joined by as much as they have in common, and each pair of a group is still in some group.
    """
    members = groups.select("h", "id").join(label, "id", "left").select(
        "h", "id", F.coalesce("component", "id").alias("component")
    )
    open_ = members.groupBy("h").agg(
        F.min("component").alias("p"), F.max("component").alias("q"), F.min(F.xxhash64("id")).alias("least")
    ).where("p <> q").select("h", "least")
    return members.join(open_, "h").select(F.col("least").alias("h"), "id", "component").distinct()


def _unlinked(met: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (id, other) that no links connect yet."""
    own = label.select("id", F.col("component").alias("p"))
    theirs = label.select(F.col("id").alias("other"), F.col("component").alias("q"))
    both = met.join(own, "id", "left").join(theirs, "other", "left")
    return both.where(F.coalesce("p", "id") != F.coalesce("q", "other")).select("id", "other", "times")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right``; without it, with each later one.

    Shingles of few sets are counted by the distance of two sets in their list, and
    the others by products of matrices.
    """
    both = left if right is None else left + right
    off, wide = (0, len(left)) if right is None else (len(left), len(right))
    sizes = [len(x) for x in both]
    row = np.repeat(np.arange(len(both)), sizes)
    values = np.concatenate(both) if both else np.empty(0, np.uint64)
    order = np.argsort(values, kind="stable")  # rows of one shingle stay in order
    values, row = values[order], row[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
    each = np.diff(np.append(starts, len(values)))
    out = np.zeros(len(left) * wide, np.int64)

    few = np.repeat((each > 1) & (each <= FEW), each)
    near, ends = np.flatnonzero(few), np.repeat(starts + each, each)
    step = 1
    while len(near := near[near + step < ends[near]]):
        p, q = row[near], row[near + step]
        if right is not None:
            inside = (p < off) & (q >= off)
            p, q = p[inside], q[inside]
        if len(p) * 8 > len(out):
            out += np.bincount(p * wide + q - off, minlength=len(out))
        else:
            np.add.at(out, p * wide + q - off, 1)
        step += 1
    out = out.reshape(len(left), wide)

    many = np.flatnonzero(each > FEW)
    for i in range(0, len(many), COLUMNS_AT_ONCE):
        some = many[i : i + COLUMNS_AT_ONCE]
        n = each[some]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[some], n)
        there = np.zeros((len(both), len(some)), np.float32)
        there[row[at], np.repeat(np.arange(len(some)), n)] = 1
        out += (there[: len(left)] @ there[off:].T).astype(np.int64)
    return np.triu(out, 1) if right is None else out


def _links_inside(texts: DataFrame, members: DataFrame, length: int, similarity: int, counted: bool) -> DataFrame:
    """All links (x, y) between ``members`` (id, component, m, words) of one component; ``counted``: (id, n) of them.

    A component of ``m`` sets and ``words`` shingles is cut into blocks, and each pair of blocks
    is compared in one task; each pair of sets meets once.
    """
    blocks = F.ceil(F.greatest(F.col("m") / MEMBERS_AT_ONCE, F.col("words") / SHINGLES_AT_ONCE)).cast("int")
    cut = members.select("id", "component", blocks.alias("blocks"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn(
        "with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    ordered = texts.join(cut, "id").select(
        "component", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "text"
    ).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "block", "id")

    def links(key: tuple, rows: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids = np.array([r[1] for r in rows], np.int64)
        n = np.array([len(r[2]) for r in rows], np.int64)
        k = len(rows) if key[1] == key[2] else sum(r[0] == key[1] for r in rows)
        sets = [r[2] for r in rows]
        right = None if key[1] == key[2] else sets[k:]
        off = 0 if right is None else k
        shared = shared_counts(sets[:k], right)
        near = (shared > 0) & (100 * shared >= similarity * (n[:k, None] + n[None, off:] - shared))
        if counted:
            got = np.zeros(len(rows), np.int64)
            got[:k] += near.sum(axis=1)
            got[off:] += near.sum(axis=0)
            some = got > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(got[some])], names=["id", "n"])
            return
        for at in range(k):  # a set at a time, so no more pairs are held than a block has sets
            other = ids[off:][near[at]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.maximum(ids[at], other)), pa.array(np.minimum(ids[at], other))], names=["x", "y"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, key, held = WordReader(fold_case=True), None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            block, ids = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i, words in read.texts(batch.column(5)):
                sets = shingle_sets(words, length)
                for k in range(len(sets.sizes)):
                    if keys[i + k] != key:
                        if held:
                            yield from links(key, held)
                        key, held = keys[i + k], []
                    if held and held[-1][1] == ids[i + k]:
                        continue  # a text that is there twice
                    held.append((block[i + k], ids[i + k], sets.shingles[sets.first[k] : sets.first[k + 1]].copy()))
        if held:
            yield from links(key, held)

    return ordered.mapInArrow(tidy(run), "id long, n long" if counted else "x long, y long")


@dataclass
class Linked:
    """Tables of one run: sets of all rows, classes of equal sets, texts that can link, and what is known of links."""

    described: DataFrame
    classes: DataFrame
    sets: DataFrame
    texts: DataFrame
    links: DataFrame
    component: DataFrame


def _all_links(found: Linked, length: int, similarity: int, counted: bool) -> DataFrame:
    """All links (x, y) between classes; ``counted``: (id, n_links) of every class that has some."""
    of = found.component.join(found.sets.select("id", "n"), "id")
    sizes = of.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("words"))
    placed = found.links.join(found.component.withColumnRenamed("id", "x"), "x")
    known = placed.groupBy("component").agg(F.count(F.lit(1)).alias("known"))
    open_ = sizes.join(known, "component").where(F.col("m") * (F.col("m") - 1) > 2 * F.col("known")).drop("known")
    settled = placed.join(open_, "component", "left_anti")
    inside = _links_inside(found.texts, found.component.join(open_, "component"), length, similarity, counted)
    if not counted:
        return settled.select("x", "y").unionByName(inside)
    ends = settled.select(F.col("x").alias("id"), F.lit(1).cast("long").alias("n")).unionByName(
        settled.select(F.col("y").alias("id"), F.lit(1).cast("long").alias("n"))
    )
    return ends.unionByName(inside).groupBy("id").agg(F.sum("n").alias("n_links"))


def _shown(c):
    return F.when(c != LAST, c)


def _rows(found: Linked, degree: DataFrame | None = None) -> DataFrame:
    """id, mark, n, first and least (id and mark, of the class and of the component) and n_links of all rows."""
    classes = found.classes.drop("counts").join(found.component, "id", "left")
    least = classes.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("least"))
    classes = classes.join(least, "component", "left").select(
        F.col("id").alias("class"), "a", "b", "n", "first", F.coalesce("least", "first").alias("least")
    )
    if degree is not None:
        classes = classes.join(degree.withColumnRenamed("id", "class"), "class", "left")
    itself = F.struct("id", "mark")
    return found.described.drop("counts").join(classes, ["a", "b", "n"], "left").select(
        "id", "mark", "n", F.coalesce("first", itself).alias("first"), F.coalesce("least", itself).alias("least"),
        *([] if degree is None else [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]),
    )


def similar_documents(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = SHINGLE, similarity: int = SIMILARITY
) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, class_id, component_id, n_links.

    ``class_id`` is the smallest id with the same set of shingles, ``component_id`` the smallest
    id reachable over links of at least ``similarity`` percent. ``n_links`` counts the other
    classes that the class links with; ``similar_pairs`` has them. Texts are folded
    to lower case (A to Z). A text of fewer words than a shingle is one shingle; null, empty
    and blank texts have none and link with nothing: each row is alone.

    Rows are told apart by their sets, not by their ids. A null id counts as larger than all
    others, and rows that share one (or repeat an id) with different texts have nothing to do
    with each other; ``class_id`` and ``component_id`` are null where all ids are. Sets are compared
    by 64-bit hashes of shingles. Other columns are ignored.
    """
    found = _linked(df, id_column, text, length, similarity)
    rows = _rows(found, _all_links(found, length, similarity, counted=True))
    return rows.select(
        _shown(F.col("id")).alias(id_column), F.col("n").alias("n_shingles"), _shown(F.col("first.id")).alias("class_id"),
        _shown(F.col("least.id")).alias("component_id"), "n_links",
    )


def similar_pairs(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = SHINGLE, similarity: int = SIMILARITY
) -> DataFrame:
    """Every link of ``similar_documents`` once: class_id and the smaller other_id, the least ids of two classes."""
    found = _linked(df, id_column, text, length, similarity)
    links = _all_links(found, length, similarity, counted=False)
    names = [found.classes.select(F.col("id").alias(c), F.col("first.id").alias(f"{c}_id")) for c in ("x", "y")]
    named = links.join(names[0], "x").join(names[1], "y")
    return named.select(
        _shown(F.greatest("x_id", "y_id")).alias("class_id"), _shown(F.least("x_id", "y_id")).alias("other_id")
    )


def _marked(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """id (a null one as LAST), text, and a hash that tells texts of one id apart."""
    return df.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text")
    )


def _linked(df: DataFrame, id_column: str, text: str, length: int, similarity: int) -> Linked:
    spark = df.sparkSession
    docs = _marked(df, id_column, text)

    def stored(frame: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    described = stored(_described(docs, length), "jaccard-sets")
    # A class of equal sets goes by half of its signature; its first row lends the text.
    classes = described.where("n > 0").groupBy("a", "b", "n").agg(
        F.min(F.struct("id", "mark")).alias("first"), F.first("counts").alias("counts")
    ).withColumn("id", F.col("a"))
    groups = stored(
        _grouped(_signed(docs, length, similarity)).select("h", F.col("a").alias("id"), F.col("partner").alias("other")),
        "jaccard-groups",
    )
    live = groups.select("id").distinct()
    sets = stored(classes.join(live, "id", "left_semi").select("id", "n", "counts", "first"), "jaccard-bounds")
    wanted = sets.select(F.col("id").alias("class"), F.col("first.id").alias("id"), F.col("first.mark").alias("mark"))
    texts = docs.join(if_small(wanted, sets.count()), ["id", "mark"]).select(F.col("class").alias("id"), "text")
    texts = stored(texts, "jaccard-texts")
    # Each set against a few others, and again while that links sets that were not linked yet.
    met = stored(
        groups.where("id <> other").groupBy("id", "other").agg(F.count(F.lit(1)).alias("times")), "jaccard-met"
    )
    tested = links = label = None
    known = 0
    for _ in range(ROUNDS):
        some = met
        if label is not None:
            some = _unlinked(met, label).join(tested.select(F.col("x").alias("id"), F.col("y").alias("other")), ["id", "other"], "left_anti")
            some = some.join(tested.select(F.col("y").alias("id"), F.col("x").alias("other")), ["id", "other"], "left_anti")
        order = F.sort_array(F.collect_list(F.struct("times", F.xxhash64("id", "other").alias("r"), "other")), False)
        chosen = some.groupBy("id").agg(F.slice(order, 1, TRIED).alias("others")).select("id", F.explode("others.other").alias("other"))
        pairs = stored(chosen.select(F.greatest("id", "other").alias("x"), F.least("id", "other").alias("y")).distinct(), "jaccard-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        near = stored(_plausible(pairs, sets, similarity), "jaccard-near")
        new = stored(_verified(texts, near, length, similarity), "jaccard-links")
        links = new if links is None else links.unionByName(new)
        label = components(new) if label is None else components_after(label, new)
        found = new.count()
        known += found
        if found * WORTHWHILE <= known:
            break
    # Groups of sets that are not all linked yet, completely.
    waiting = stored(_open_groups(groups, label), "jaccard-open")
    waiting = waiting.join(waiting.groupBy("h").agg(F.count(F.lit(1)).alias("m")), "h").join(sets.select("id", "n", "counts"), "id")
    more = _open_pairs(waiting, similarity).join(tested, ["x", "y"], "left_anti")
    last = stored(_verified(texts, stored(more, "jaccard-more"), length, similarity), "jaccard-last")
    links = links.unionByName(last).distinct()
    return Linked(described, classes, sets, texts, links, components_after(label, last))


def one_of_each(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that of the smallest id, with all its columns.

    Of different texts with that id one stays. A row stored twice, id and text, stays twice.
    """
    found = _linked(df, id_column, text, SHINGLE, SIMILARITY)
    kept = _rows(found).where(F.struct("id", "mark") == F.col("least")).select("id", "mark").distinct()
    own, key = unused(df, "jaccard_id", "jaccard_mark")
    kept = kept.select(F.col("id").alias(own), F.col("mark").alias(key))
    same = (F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)) == F.col(own)) & (F.xxhash64(F.col(text)) == F.col(key))
    return df.join(kept, same, "left_semi")
