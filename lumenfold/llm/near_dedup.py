"""MinHash near-duplicates by a chosen-path set similarity join.

Documents with the same set of word shingles are one class. Each class has a sketch of 64 minwise
tokens. A tree sends a class down by chosen minwise tokens: the root by one position of the sketch, a
node with too many members to three children, each by three further positions at once that the node itself
picks. A pair at the threshold goes down with a child with probability 0.8 ** 3, so it is expected 1.5 times
in a level, and its chance of a tree does not fade with depth (with two children it would). Small nodes are
compared exhaustively. Twelve trees miss a pair whose sketches agree in 0.8 of the positions with probability 7e-6
at any depth. The trees share one sketch, which agrees in less for some pairs: over the binomial distribution of
its agreement, a pair of similarity 0.8 is missed with probability 0.4% at 5 levels and 1.2% at 11.

The comparison has two steps. On sketches, each node keeps the components of the pairs that may be
similar enough (64 positions, four standard deviations below the threshold), and their components
are the candidate groups. On the full sets, recomputed from the whole texts of the candidates only, each
group is compared exhaustively, pair by pair; a group too large for a task is compared by pairs of its blocks, or
node by node of the trees where that is fewer rows. What leaves a task is an edge from each member to the first of its component in the group, never all pairs.

Large groups of near copies are contracted before the trees branch: the members of a large root are dealt
to blocks, a few of them (pivots) stand in every block, and the links found there, confirmed on full sets, give
components. A pair within one component is known, so the trees and both steps of the comparison only look for pairs across components: a node of one component ends, and a large node with few members outside its largest
component compares these with all its members, block by block. Nothing is dropped by this.

A node with a child that hardly shrinks (its members are alike, yet not linked) is compared in full itself: every
two of its blocks that do not lie in one component meet in a task of their own. A comparison in full misses
nothing that its node holds, and it is done in every tree, so that no node goes unread.

Defined cases: null text, or text without a word, has an empty set, links with nothing and is kept;
fewer words than a shingle has make one shingle; very long texts are shingled whole; rows that repeat an id and
its text are kept or dropped together; a null id links with nothing and is kept; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.graph import components

from .shared import give_back, rows_of, small_batches, written
from .words import U, hashed_words, mix

SKETCH = 64
TREES = 12
NODE = 400
CHILDREN, POSITIONS = 3, 3
PIVOTS = 8
#: Values of a slice of the exact comparison.
SLICE = 4096
#: A child with more of its node's members than this shows that branching does not help.
TIGHT = 0.7
#: Trees whose large roots are contracted.
CONTRACT = 2
_draw = np.random.default_rng(20)
_FACTOR = _draw.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * U(2) + U(1)
_SHIFT = _draw.integers(0, 1 << 63, SKETCH, dtype=np.uint64)
_PLACE = _draw.integers(0, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)


def shingles(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text: of ASCII lower case, words of the blanks between them."""
    word, first, upto = hashed_words(texts)
    many = max(0, len(word) - width + 1)
    rolled = np.zeros(many, np.uint64)
    for i in range(width):
        rolled += word[i : i + many] * _PLACE[i]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first.tolist(), upto.tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mix((word[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens of sets that are not empty, a row for each."""
    flat = np.concatenate(sets)
    begin = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), SKETCH), np.uint32)
    for i in range(SKETCH):
        out[:, i] = np.minimum.reduceat((flat * _FACTOR[i] + _SHIFT[i]) >> U(32), begin)
    return out.view(np.int32)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.md5(s.tobytes(), usedforsecurity=False).digest()


def sketched(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, n_shingles, class, sketch) of each row; class and sketch are null for empty sets and null ids. Ids are of any type that has an order."""
    kind = df.select(F.col(key).alias("id")).schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in rows_of(batches, text):
            sets = shingles(texts, width)
            ids = part.column("id")
            use = [i for i, s in enumerate(sets) if len(s) and ids[i].is_valid]
            mins = iter(sketch([sets[i] for i in use]) if use else [])
            rows: list = [None] * len(sets)
            names: list = [None] * len(sets)
            for i in use:
                rows[i], names[i] = next(mins), _digest(sets[i])
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(map(len, sets)), pa.int64()), pa.array(names, pa.binary()), pa.array(rows, pa.list_(pa.int32()))], ["id", "n_shingles", "class", "sketch"])

    return df.select(F.col(key).alias("id"), F.col(text).alias(text)).transform(small_batches).mapInArrow(run, f"id {kind}, n_shingles long, class binary, sketch array<int>")


def roots(classes: DataFrame, trees: int, first: int) -> DataFrame:
    """(class, lab, node, over, up) of each class in the first trees: a root is named by one minwise token."""
    places = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(t * SKETCH // trees % SKETCH).alias("p")) for t in range(first)))
    rows = classes.withColumn("_root", F.explode(places))
    none = F.lit(None).cast("long")
    return rows.select("class", "lab", F.xxhash64(F.col("_root.t"), F.element_at("sketch", F.col("_root.p") + 1)).alias("node"), none.alias("over"), none.alias("up"))


def unfinished(rows: DataFrame) -> DataFrame:
    """rows of the nodes that hold more than one label, with n, the members of the node, was, those of its parent,
    top, the label that most members have, and rest, the number of the others."""
    part = rows.groupBy("node", "lab").agg(F.count("*").alias("_many"), F.max("up").alias("_up"))
    size = part.groupBy("node").agg(F.sum("_many").alias("n"), F.max("_up").alias("was"), F.max("_many").alias("_most"), F.max_by("lab", "_many").alias("top"))
    size = size.where("n > _most").select("node", "n", "was", "top", (F.col("n") - F.col("_most")).alias("rest"))
    return rows.join(size, "node").select("node", "class", "lab", "over", "n", "was", "top", "rest")


def pivot_blocks(large: DataFrame, node: int) -> DataFrame:
    """(unit, class): the members of a large node in blocks, a few of them standing in every block."""
    blocks = F.ceil(F.col("n") / (node - PIVOTS)).cast("long")
    named = lambda b: F.xxhash64("node", F.lit("block"), b).alias("unit")
    own = large.select(named(F.pmod(F.xxhash64("node", "class"), blocks)), "class")
    draws = [F.min(F.struct(F.xxhash64("node", F.lit(k), "class").alias("h"), F.col("class").alias("c"))) for k in range(PIVOTS)]
    drawn = large.groupBy("node").agg(F.max("n").alias("n"), F.array(*draws).alias("_drawn")).withColumn("class", F.explode(F.array_distinct("_drawn.c")))
    shown = drawn.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select(named(F.col("_b")), "class")
    return own.unionByName(shown).distinct()


def block_pairs(stuck: DataFrame, block: int) -> DataFrame:
    """(unit, class): every two blocks of a node that are not in one component, as a unit. stuck: node, class, lab, top.

    A component of some size in a node has blocks of its own, the others share blocks. Two blocks of the
    largest component are never paired, so a node with few others gives units in proportion to its members.
    A unit compares all its members, so a block needs no unit of its own unless its node has no other.
    """
    part = stuck.groupBy("node", "lab", "top").agg(F.count("*").alias("_many"))
    total = part.groupBy("node").agg(F.sum(F.when(2 * F.col("_many") < block, F.col("_many")).otherwise(0)).alias("_shared"))
    own = F.when(2 * F.col("_many") >= block, F.col("lab"))
    spread = F.when(own.isNull(), F.pmod(F.xxhash64("node", "lab"), F.ceil(F.col("_shared") / block))).otherwise(F.pmod(F.xxhash64("node", "class"), F.ceil(F.col("_many") / block)))
    known = stuck.join(part.drop("top").join(total, "node"), ["node", "lab"])
    dealt = written(known.select("node", "class", own.alias("own"), F.coalesce(own == F.col("top"), F.lit(False)).alias("most"), F.xxhash64(own, spread).alias("block")), "dealt")
    blocks = dealt.groupBy("node", "own", "most", "block").count().drop("count")
    alone = blocks.groupBy("node").agg((F.count("*") == 1).alias("_alone"))
    other = blocks.join(alone, "node").select("_alone", "node", F.col("own").alias("_own"), F.col("most").alias("_most"), F.col("block").alias("_block"))
    same = F.coalesce(F.col("own") == F.col("_own"), F.lit(False))
    pairs = blocks.where("not most").join(other, "node").where((F.col("_most") | (F.col("block") < F.col("_block")) | F.col("_alone")) & ~same)
    unit = F.xxhash64("node", "block", "_block").alias("unit")
    both = pairs.select("node", unit, F.explode(F.array_distinct(F.array("block", "_block"))).alias("block"))
    return dealt.join(both, ["node", "block"]).select("unit", "class")


def leaves(classes: DataFrame, trees: int, node: int) -> DataFrame:
    """(unit, class): the members of every small node of the trees, and of the block pairs of large nodes
    that hold few members outside one component or that branching does not shrink. classes: class, sketch, lab."""
    rows, parts, parents, depth, block = roots(classes, trees, trees), [], None, 0, max(1, 3 * node // 4)
    while True:
        level = written(unfinished(rows), "level")
        if parents is not None:
            tight = written(level.where((F.col("n") > TIGHT * F.col("was")) & (F.col("rest") > node)).select("over").distinct(), "tight")
            if tight.limit(1).count():
                parts.append(block_pairs(parents.join(tight, F.col("node") == F.col("over"), "left_semi"), block))
                level = level.join(tight, "over", "left_anti")
        parts.append(level.where(F.col("n") <= node).select(F.col("node").alias("unit"), "class"))
        large = level.where(F.col("n") > node)
        few = (F.col("rest") <= node) | F.lit(depth >= SKETCH)
        stuck = large.where(few)
        if stuck.limit(1).count():
            parts.append(block_pairs(stuck, block))
        parents = written(large.where(~few).select("node", "class", "lab", "top", "n"), "parents")
        if not parents.limit(1).count():
            break
        turn = parents.join(classes.select("class", "sketch"), "class").withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(CHILDREN - 1))))
        spots = [F.pmod(F.xxhash64("node", "_i", F.lit(k)), F.lit(SKETCH)).cast("int") for k in range(POSITIONS)]
        tokens = [F.element_at("sketch", p + 1) for p in spots]
        rows = turn.select("class", "lab", F.xxhash64("node", "_i", *tokens).alias("node"), F.col("node").alias("over"), F.col("n").alias("up"))
        depth += 1
    return reduce(DataFrame.unionByName, parts)


def _stars(many: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """An edge from each of the members 0 to many - 1 to the first of its component, where that is another one."""
    top = list(range(many))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        top[max(ra, rb)] = min(ra, rb)
    return [(root(x), x) for x in range(many) if root(x) != x]


def _grouped(df: DataFrame, group: str, column: str, decode: Callable[[pa.Array], list], compare: Callable[[list, np.ndarray], list[tuple[int, int]]]) -> DataFrame:
    """Edges (group, a, b) that compare() finds among the values and labels of each group, whose members come in order. Groups are of
    bounded size; a partition is read in the order of its groups, one in memory at a time beside the batch. A group of one label is not compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[int, bytes, bytes]] = []

        def close() -> None:
            labels = np.array([h[3] for h in held], np.int64)
            if len(held) > 1 and (labels != labels[0]).any():
                names = [h[1] for h in held]
                out.extend((held[0][0], names[i], names[j]) for i, j in compare([h[2] for h in held], labels) if names[i] != names[j])
            held.clear()

        def emit() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.binary(), pa.binary())
            batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], [group, "a", "b"])
            out.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                for row in zip(part.column(group).to_pylist(), part.column("class").to_pylist(), decode(part.column(column)), part.column("lab").to_pylist(), strict=True):
                    if held and held[0][0] != row[0]:
                        close()
                    held.append(row)
            yield emit()
        close()
        yield emit()
        give_back()

    return df.select(group, "class", column, "lab").repartition(group).sortWithinPartitions(group, "class").transform(small_batches).mapInArrow(run, f"{group} long, a binary, b binary")


def _alike_sketches(least: int) -> Callable[[list, np.ndarray], list[tuple[int, int]]]:
    def compare(rows: list, labels: np.ndarray) -> list[tuple[int, int]]:
        """Stars of the pairs of different labels."""
        if len(rows) == 2:
            return [(0, 1)] if (rows[0] == rows[1]).sum() >= least else []
        block = np.array(rows)
        found = []
        for i in range(len(block) - 1):
            same = (block[i + 1 :] == block[i]).sum(1)
            found += [(i, i + 1 + int(j)) for j in np.flatnonzero((same >= least) & (labels[i + 1 :] != labels[i]))]
        return _stars(len(block), iter(found))

    return compare


def _alike_sets(percent: int) -> Callable[[list, np.ndarray], list[tuple[int, int]]]:
    def compare(rows: list, labels: np.ndarray) -> list[tuple[int, int]]:
        """Exact, for pairs of different labels: the sizes of all intersections, as products of slices of the 0/1 matrix of rows and shared values."""
        size = np.array([len(r) for r in rows])
        flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        first = np.flatnonzero(new)
        shared = np.repeat(np.diff(np.append(first, len(flat))) > 1, np.diff(np.append(first, len(flat))))
        owner, value = owner[shared], np.cumsum(new[shared]) - 1
        many = int(value[-1]) + 1 if len(value) else 0
        both = np.zeros((len(rows), len(rows)))
        for low in range(0, many, SLICE):
            a, b = np.searchsorted(value, [low, low + SLICE])
            has = np.zeros((len(rows), min(SLICE, many - low)), np.float32)
            has[owner[a:b], value[a:b] - low] = 1
            both += has @ has.T
        fine = np.triu((100 * both >= percent * (size[:, None] + size[None, :] - both)) & (labels[:, None] != labels), 1)
        return _stars(len(rows), zip(*(x.tolist() for x in np.nonzero(fine)), strict=True))

    return compare


def ends(edges: DataFrame) -> DataFrame:
    """(unit, class) of the members that edges (unit, a, b) touch."""
    return edges.select("unit", F.explode(F.array("a", "b")).alias("class")).distinct()


def confirming(maybe: DataFrame, groups: DataFrame, node: int) -> DataFrame:
    """(unit, class): what full sets are compared in. maybe: unit, a, b; groups: the components of these edges as class, group, lab.

    A small group is one unit. A large one has its block pairs, which hold each two members once, or the units
    that its edges come from, which hold them again in each tree: whichever has fewer rows. Both hold every edge.
    """
    block = max(1, 3 * node // 4)
    part = groups.groupBy("group", "lab").agg(F.count("*").alias("_many"))
    size = part.groupBy("group").agg(F.sum("_many").alias("n"), F.max("_many").alias("_most"), F.max_by("lab", "_many").alias("top"))
    drawn = maybe.join(groups.select(F.col("class").alias("b"), "group"), "b").groupBy("group").agg(F.count("*").alias("_edges"))
    full = 2 * block * F.ceil(F.col("n") / block) * F.ceil((F.col("n") - F.col("_most")) / block)
    way = F.when(F.col("n") <= node, "one").when(full <= F.col("_edges"), "full").otherwise("units")
    sized = written(groups.join(size.join(drawn, "group").select("group", "top", way.alias("way")), "group"), "groups")
    parts = [sized.where("way = 'one'").select(F.xxhash64("group").alias("unit"), "class")]
    if sized.where("way = 'full'").limit(1).count():
        parts.append(block_pairs(sized.where("way = 'full'").select(F.xxhash64("group").alias("node"), "class", "lab", "top"), block))
    if sized.where("way = 'units'").limit(1).count():
        parts.append(ends(maybe.join(sized.where("way = 'units'").select(F.col("class").alias("b")), "b", "left_semi")))
    return reduce(DataFrame.unionByName, parts)


def links(df: DataFrame, rows: DataFrame, key: str, text: str, width: int, percent: int, trees: int, node: int) -> DataFrame:
    """(a, b) between classes that confirmed links join, enough of them to hold every component together."""
    classes = rows.where("class is not null").groupBy("class").agg(F.first("sketch").alias("sketch"), F.min("id").alias("first"))
    classes = written(classes, "classes")
    sketches = classes.select("class", "sketch")
    texts = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    j = percent / 100
    least = max(1, int(SKETCH * (j - 4 * (j * (1 - j) / SKETCH) ** 0.5)))
    values = lambda a: list(np.asarray(a.values[a.offsets[0].as_py() : a.offsets[-1].as_py()] if len(a) else a.values, np.int32).reshape(-1, SKETCH))
    unpack = lambda a: [np.frombuffer(x, np.uint64) for x in a.to_pylist()]

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in rows_of(batches, "text"):
            sets = shingles(found, width)
            here = [(c, s.tobytes()) for c, s in zip(part.column("class").to_pylist(), sets, strict=True) if _digest(s) == c]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in here], pa.binary()), pa.array([s for _, s in here], pa.binary())], ["class", "set"])

    def exact(units: DataFrame, named: DataFrame) -> DataFrame:
        """Links of different labels among the members of units (unit, class) on full sets."""
        wanted = units.select("class").distinct().join(classes.select("class", F.col("first").alias("id")), "class")
        sets = texts.join(wanted, "id").select("class", "text").transform(small_batches).mapInArrow(full, "class binary, set binary").join(named.select("class", "lab"), "class")
        return written(_grouped(units.join(sets, "class"), "unit", "set", unpack, _alike_sets(percent)).select("a", "b"), "links")

    def maybe(units: DataFrame, named: DataFrame) -> DataFrame:
        """Stars (unit, a, b) of the members of different labels that may have a link in their unit."""
        return written(_grouped(units.join(named, "class"), "unit", "sketch", values, _alike_sketches(least)), "maybe")

    def confirmed(units: DataFrame, named: DataFrame) -> DataFrame:
        """Links of different labels among the members of units: candidates on sketches, then each group of them on full sets."""
        found = maybe(units, named)
        groups = components(found.select("a", "b")).select(F.col("node").alias("class"), F.col("label").alias("group"))
        return exact(confirming(found, groups.join(named.select("class", "lab"), "class"), node), named)

    named = sketches.withColumn("lab", F.xxhash64("class"))
    large = written(unfinished(roots(named, trees, min(trees, CONTRACT))).where(F.col("n") > node), "large")
    if not large.limit(1).count():
        return confirmed(written(leaves(named, trees, node), "leaves"), named)
    found = exact(ends(maybe(pivot_blocks(large, node), named)), named)
    label = components(found).select(F.col("node").alias("class"), "label")
    named = written(sketches.join(label, "class", "left").select("class", "sketch", F.xxhash64(F.coalesce("label", "class")).alias("lab")), "named")
    return found.unionByName(confirmed(written(leaves(named, trees, node), "leaves"), named))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, trees: int = TREES, node: int = NODE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of df.

    Rows are linked if their sets of `width`-word shingles have a Jaccard similarity of percent / 100 or more;
    component_id is the smallest id that links lead to, kept says that it is the row's own.
    """
    rows = written(sketched(df, key, text, width), "sketches")
    found = written(links(df, rows, key, text, width, percent, trees, node), "links")
    label = components(found).withColumnRenamed("node", "class")
    first = rows.where("class is not null").groupBy("class").agg(F.min("id").alias("first"))
    joined = first.join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
    lowest = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    named = joined.join(lowest, "label").select("class", "component_id")
    whole = rows.select("id", "n_shingles", F.coalesce("class", F.xxhash64("id", F.rand(1)).cast("string").cast("binary")).alias("class"))
    out = whole.join(named, "class", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
