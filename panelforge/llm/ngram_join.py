"""Near duplicates by an exact n-gram Jaccard join with a count-vector R-tree.

A text is the set of its 5-word shingles; two texts link at a Jaccard similarity of 0.8 or more. Equal sets are one
class with one representative. Representatives meet in blocks: a pair with that similarity must share one of the first
n - ceil(0.8 n) + 1 shingles of either set in any common order, and the order puts shingles that many documents hold
last, so blocks stay small. Blocks with the same members are one block.

In a block every set is the point of its counts in G groups of hashed shingles. An R-tree over the points bounds the
overlap of two boxes, a box and a point, or two points by the sum of the smaller coordinates; what can't reach the
overlap that similarity 0.8 needs is dropped. Surviving pairs are verified on the whole sets. Only connectedness is
asked for, so first rounds verify each point's most promising partners, and a last one all surviving pairs whose ends
are still in different components: no link between components is lost, and large groups of near copies don't become
all their pairs. Count vectors only go to blocks that still hold two components and pairs that were not proposed.

How many documents hold a shingle is counted over all documents in a sketch of fixed size. It decides the order and
which shingles are split; any order and any split give the same links.
"""

from __future__ import annotations

import zlib
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_IDS, cut, mixed, modest_batches, shingle_sets, table, without_ids
from .components import components

WIDTH, NUM, DEN = 5, 4, 5  # words of a shingle; similarity 4/5
LEAST_GROUPS, MOST_GROUPS = 64, 4096  # of a count vector: the power of two next to the set's size
SKETCH_BITS, SKETCH_PARTS = 19, 32  # counters of each of the sketch's two rows; parts it is added up in
STEPS = 8  # of a count's logarithm to one power of two
FLUSH, FLUSH_PAIRS = 1_000_000, 200_000
BLOCK = 2048  # members of a block of one very common shingle
LEAF = 16
SLICE = 256  # documents whose shingles are dealt together
FULL = 15  # counts are kept in four bits
ENDLESS = 1 << 20  # stands for FULL: more than any set has in a group that matters
KNOWN_CODES = 200_000  # sets that a task remembers as already dealt
ROUNDS = 1  # with one partner for each point and other component, before all pairs of components


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1 if n else 0


def _packed_keys(keys: np.ndarray) -> bytes:
    """The upper 48 bits of each: enough to meet by, as shared keys only propose pairs."""
    return np.ascontiguousarray((keys >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _keys(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).reshape(-1)


def _places(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's counter in either row of the sketch, from its upper 48 bits."""
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), (s >> np.uint64(63 - 2 * SKETCH_BITS)).astype(np.int64) & ((1 << SKETCH_BITS) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> this task's counters, by part."""
    counts, parts, held = np.zeros((2, 1 << SKETCH_BITS), np.int64), [], 0

    def flush() -> None:
        for row, at in enumerate(_places(np.concatenate(parts))):
            counts[row] += np.bincount(at, minlength=1 << SKETCH_BITS)

    for batch in batches:
        for s in shingle_sets(batch.column(0), WIDTH):
            parts.append(s)
            held += len(s)
            if held >= FLUSH:
                flush()
                parts, held = [], 0
    if held:
        flush()
    if counts.any():
        packed = [zlib.compress(x.astype(np.min_scalar_type(int(x.max()))).tobytes(), 1) for x in np.split(counts.reshape(-1), SKETCH_PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(packed, pa.binary())], names=["part", "counts"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    size = 2 * (1 << SKETCH_BITS) // SKETCH_PARTS
    for batch in batches:
        for part, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = zlib.decompress(packed)
            sums[part] = sums.get(part, 0) + np.frombuffer(raw, f"u{len(raw) // size}").astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])


def shingle_sketch(texts: DataFrame) -> np.ndarray:
    """(2, counters) of uint8: the logarithm, in STEPS to one power of two, of how many documents hold the shingles of
    each counter beyond the usual number. A shingle has the smaller of its two. Counted over all documents; the size is
    fixed, so with more documents only shingles in ever more of them stand out."""
    rows = texts.select("text").mapInArrow(_count, "part int, counts binary").repartition("part").mapInArrow(_add_up, "part int, counts binary").collect()  # a fixed size
    counts = np.zeros(2 << SKETCH_BITS, np.int64)
    size = len(counts) // SKETCH_PARTS
    for r in rows:
        counts[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["counts"], np.int64)
    counts = counts.reshape(2, -1)
    beyond = np.maximum(counts - np.median(counts, 1, keepdims=True), 0)
    return np.minimum(STEPS * np.log2(1 + beyond), 255).astype(np.uint8)


def commonness(sketch: np.ndarray, s: np.ndarray) -> np.ndarray:
    a, b = _places(s)
    return np.minimum(sketch[0][a], sketch[1][b])


def groups_for(n: int) -> int:
    return min(MOST_GROUPS, max(LEAST_GROUPS, 1 << (n - 1).bit_length())) if n else LEAST_GROUPS


def count_vector(s: np.ndarray) -> bytes:
    """How many shingles fall into each group of their lowest bits, two groups a byte; FULL where that many or more
    do."""
    g = groups_for(len(s))
    x = np.minimum(np.bincount((s & np.uint64(g - 1)).astype(np.int64), minlength=g), FULL).astype(np.uint8)
    return (x[0::2] | (x[1::2] << np.uint8(4))).tobytes()


def same_groups(vectors: list[bytes]) -> np.ndarray:
    """The vectors with as many groups as the shortest has: groups whose low bits agree are added up."""
    g = 2 * min(map(len, vectors))
    out = np.empty((len(vectors), g), np.int32)
    for row, v in zip(out, vectors, strict=True):
        x = np.empty(2 * len(v), np.int32)
        packed = np.frombuffer(v, np.uint8)
        x[0::2], x[1::2] = packed & 15, packed >> 4
        x[x == FULL] = ENDLESS  # cut off, so no bound
        row[:] = x.reshape(-1, g).sum(0)
    return out


def _signed(sketch, parts: int, block: int) -> object:  # noqa: ANN001
    """Mapper: (doc_id, text) -> rows (part, doc_id, n, m1, m2, vector) of documents, and rows (part, keys, codes) of
    what each range of shingles gets from the prefixes of this batch. m1 and m2 are the set's digest, m1 its code."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                docs = {"n": [], "m1": [], "m2": [], "vector": []}
                prefixes, codes = [], []
                for s in shingle_sets(batch.column(1), WIDTH):
                    n = len(s)
                    m1 = int(s.sum(dtype=np.uint64).view(np.int64))
                    docs["n"].append(n)
                    docs["m1"].append(m1)
                    docs["m2"].append(int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                    docs["vector"].append(count_vector(s))
                    if n and m1 not in known:  # equal sets need to be dealt once
                        if len(known) >= KNOWN_CODES:
                            known.clear()
                        known.add(m1)
                        prefixes.append(s[np.argsort(commonness(sketch.value, s), kind="stable")[: prefix_length(n)]])
                        codes.append(m1)
                rows = batch.num_rows
                home = (mixed(np.array(docs["m1"], np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int32)
                none = pa.nulls(rows, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(home), batch.column(0), *(pa.array(docs[c], pa.int64()) for c in ("n", "m1", "m2")), pa.array(docs["vector"], pa.binary()), none, none], names=_SIGNED)
                if prefixes:
                    yield _dealt(np.concatenate(prefixes), np.repeat(np.array(codes, np.int64), [len(p) for p in prefixes]), sketch.value, parts, block)

    return sign


_SIGNED = ["part", "doc_id", "n", "m1", "m2", "vector", "keys", "codes"]
_SIGNED_TYPES = "part int, doc_id long, n long, m1 long, m2 long, vector binary, keys binary, codes binary"
_MET_TYPES = "doc_id long, n long, m1 long, m2 long, vector binary, block long, code long"


def _dealt(keys: np.ndarray, who: np.ndarray, sketch: np.ndarray, parts: int, block: int) -> pa.RecordBatch:
    """Prefix shingles with their sets' codes, packed by range. Members of a very common shingle meet in all pairs of
    blocks of about `block`, so no task gathers them."""
    common = commonness(sketch, keys)
    hot = np.flatnonzero(common >= STEPS * np.log2(block))
    if len(hot):
        cold = np.ones(len(keys), bool)
        cold[hot] = False
        more_keys, more_who = [keys[cold]], [who[cold]]
        for i in hot:
            blocks = -(-int(2.0 ** ((int(common[i]) + 1) / STEPS)) // block)
            own = int(mixed(who[i : i + 1].view(np.uint64))[0] % np.uint64(blocks))
            other = np.arange(blocks)
            pair = (np.minimum(own, other) * blocks + np.maximum(own, other)).astype(np.uint64)
            more_keys.append(mixed((keys[i] >> np.uint64(16)) ^ mixed(pair + np.uint64(1))))
            more_who.append(np.full(blocks, who[i]))
        keys, who = np.concatenate(more_keys), np.concatenate(more_who)
    part = (mixed(keys >> np.uint64(16)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    keys, who, bounds = keys[order], who[order], np.searchsorted(part[order], np.arange(parts + 1))
    full = [k for k in range(parts) if bounds[k + 1] > bounds[k]]
    rows = len(full)
    packed = [pa.array([_packed_keys(keys[bounds[k] : bounds[k + 1]]) for k in full], pa.binary()), pa.array([who[bounds[k] : bounds[k + 1]].tobytes() for k in full], pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.nulls(rows, pa.int64()) for _ in range(4)), pa.nulls(rows, pa.binary()), *packed], names=_SIGNED)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows of _signed: documents go on as they are; shingles with their members become (block, code),
    one block for each distinct list of two members or more."""
    keys, codes = [], []
    for batch in batches:
        docs = batch.filter(batch.column(2).is_valid())
        if docs.num_rows:
            yield _met_rows([docs.column(k) for k in range(1, 6)], docs.num_rows)
        dealt = batch.filter(batch.column(6).is_valid())
        keys += [_keys(x) for x in dealt.column(6).to_pylist()]
        codes += [np.frombuffer(x, np.int64) for x in dealt.column(7).to_pylist()]
    if not keys:
        return
    k, r = np.concatenate(keys), np.concatenate(codes)
    del keys, codes
    order = np.lexsort((r, k))
    k, r = k[order], r[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    k, r = k[new], r[new]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    sizes = np.diff(np.append(starts, len(k)))
    several = np.repeat(sizes > 1, sizes)
    r, sizes = r[several], sizes[sizes > 1]
    if not len(r):
        return
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    block = mixed(np.add.reduceat(mixed(r.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)), starts) + sizes.astype(np.uint64))
    _, first = np.unique(block, return_index=True)
    chosen = np.zeros(len(sizes), bool)
    chosen[first] = True
    rows = np.repeat(chosen, sizes)
    names, r = np.repeat(block, sizes)[rows].view(np.int64), r[rows]
    for i in range(0, len(names), 100_000):
        yield _met_rows(None, len(names[i : i + 100_000]), pa.array(names[i : i + 100_000]), pa.array(r[i : i + 100_000]))


def _met_rows(docs: list[pa.Array] | None, rows: int, block: pa.Array | None = None, code: pa.Array | None = None) -> pa.RecordBatch:
    docs = docs or [*(pa.nulls(rows, pa.int64()) for _ in range(4)), pa.nulls(rows, pa.binary())]
    ends = [pa.nulls(rows, pa.int64()) if x is None else x for x in (block, code)]
    return pa.RecordBatch.from_arrays([*docs, *ends], names=["doc_id", "n", "m1", "m2", "vector", "block", "code"])


def _least_overlap(n: np.ndarray) -> np.ndarray:
    """Of two sets with n shingles together: at least 4/9 of them are shared at similarity 4/5."""
    return -(-NUM * n // (NUM + DEN))


class RTree:
    """Points (count vectors) in leaves of LEAF, packed by recursive halving along the widest coordinate; each leaf has
    the upper corner of its box and its least and largest set size."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray) -> None:
        self.vectors, self.sizes = vectors, sizes
        self.leaves: list[np.ndarray] = []
        stack = [np.arange(len(sizes))]
        while stack:
            rows = stack.pop()
            if len(rows) <= LEAF:
                self.leaves.append(rows)
                continue
            v = vectors[rows]
            by_size = sizes[rows].max() * NUM > sizes[rows].min() * DEN  # sizes too far apart to link are split first
            key = sizes[rows] if by_size else v[:, np.argmax(v.max(0) - v.min(0))]
            order = rows[np.argsort(key, kind="stable")]
            stack += [order[: len(rows) // 2], order[len(rows) // 2 :]]
        self.upper = np.stack([vectors[x].max(0) for x in self.leaves])
        self.least = np.array([sizes[x].min() for x in self.leaves])
        self.most = np.array([sizes[x].max() for x in self.leaves])

    def _near(self, k: int, others: np.ndarray) -> np.ndarray:
        """Leaves among others that the bounds admit for leaf k."""
        bound = np.minimum(self.upper[others], self.upper[k]).sum(1)
        fits = (self.least[others] * NUM <= self.most[k] * DEN) & (self.least[k] * NUM <= self.most[others] * DEN)
        return others[(bound >= _least_overlap(self.least[others] + self.least[k])) & fits]

    def _points(self, k: int, o: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        leaf, other = self.leaves[k], self.leaves[o]
        over = np.minimum(self.vectors[leaf][:, None, :], self.vectors[other][None, :, :]).sum(2)
        a, b = self.sizes[leaf][:, None], self.sizes[other][None, :]
        need = _least_overlap(a + b)
        fine = (over >= need) & (NUM * np.maximum(a, b) <= DEN * np.minimum(a, b))
        if o == k:
            fine &= np.arange(len(leaf))[:, None] < np.arange(len(other))[None, :]
        i, j = np.nonzero(fine)
        return leaf[i], other[j], (over / need)[i, j]

    def pairs(self, roots: np.ndarray | None = None, reach: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, share): point pairs that the bounds admit, with the bound on their overlap over the needed one. With
        roots, only pairs of different ones; with reach, only with that many leaves after a point's own."""
        count = len(self.leaves)
        one = None if roots is None else np.array([roots[x[0]] if (roots[x] == roots[x[0]]).all() else -1 for x in self.leaves])
        for k in range(count):
            others = np.arange(k, count if reach is None else min(count, k + 1 + reach))
            if one is not None and one[k] != -1:
                others = others[one[others] != one[k]]
            if len(others):
                for o in self._near(k, others):
                    i, j, share = self._points(k, o)
                    if roots is not None:
                        apart = roots[i] != roots[j]
                        i, j, share = i[apart], j[apart], share[apart]
                    if len(i):
                        yield i, j, share


def _best(key: np.ndarray, i: np.ndarray, j: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), the one with the largest share for each (i, key)."""
    order = np.lexsort((j, -share, key, i))
    i, j, key = i[order], j[order], key[order]
    first = np.ones(len(i), bool)
    first[1:] = (i[1:] != i[:-1]) | (key[1:] != key[:-1])
    return i[first], j[first]


class _Proposed:
    """Pairs to verify, made distinct now and then, and blocks that hold further ones, as rows (a, b, block)."""

    def __init__(self) -> None:
        self.pairs: list[np.ndarray] = []
        self.unfinished: list[int] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
        self.held += len(a)

    def taken(self) -> Iterator[pa.RecordBatch]:
        pairs = np.unique(np.concatenate(self.pairs), axis=0) if self.pairs else np.empty((0, 2), np.int64)
        n, m = len(pairs), len(self.unfinished)
        columns = [pa.concat_arrays([pa.array(pairs[:, k]), pa.nulls(m, pa.int64())]) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(self.unfinished, pa.int64())])], names=["a", "b", "block"])
        self.pairs, self.unfinished, self.held = [], [], 0


def _search(turn: int, reps: np.ndarray, roots: np.ndarray, tree: RTree, out: _Proposed) -> Generator[pa.RecordBatch, None, bool]:
    """Adds a block's pairs to out, and gives out what has gathered. The last value is whether all pairs that the bounds
    admit were added: then the block is finished, as components only ever merge."""
    found = tree.pairs(None, 1) if not turn else tree.pairs(roots)
    if turn > ROUNDS:
        for i, j, _ in found:
            out.add(reps[i], reps[j])
            if out.held >= FLUSH_PAIRS:
                yield from out.taken()
        return True
    found = list(found)
    if not found:
        return bool(turn) or len(tree.leaves) <= 2
    i, j, share = (np.concatenate(x) for x in zip(*found, strict=True))
    admitted = len(i)
    if not turn:
        i, j = _best(np.zeros(len(i), int), np.maximum(i, j), np.minimum(i, j), share)
        whole = len(i) == admitted and len(tree.leaves) <= 2
    else:
        i, j, share = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([share, share])
        i, j = _best(roots[j], i, j, share)
        whole = len(np.unique(np.minimum(i, j) * len(reps) + np.maximum(i, j))) == admitted
    out.add(reps[i], reps[j])
    return whole


def _candidates(turn: int):  # noqa: ANN202
    """Mapper over sorted (block, rep, n, vector, root): pairs to verify, and blocks that another turn must search.

    Turn 0: each point's most promising partner among the points of its leaf and the next one. Turns up to ROUNDS: for
    each point, the most promising partner in each other component. After that: all admitted pairs of components, given
    out as they are found."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = _Proposed(), []

        def blocks() -> Iterator[pa.Table]:
            nonlocal held
            for batch in batches:
                names = batch.column(0).to_numpy()
                cuts = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else []
                for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True):
                    part = batch.slice(a, b - a)
                    if held and held[0].column(0)[0] != part.column(0)[0]:
                        yield pa.Table.from_batches(held)
                        held = []
                    held.append(part)
            if held:
                yield pa.Table.from_batches(held)

        for block in blocks():
            reps, n, roots = (block.column(c).to_numpy() for c in ("rep", "n", "root"))
            if len(reps) < 2 or (turn and (roots == roots[0]).all()):
                continue
            finished = yield from _search(turn, reps, roots, RTree(same_groups(block.column("vector").to_pylist()), n), out)
            if not finished:
                out.unfinished.append(block.column("block")[0].as_py())
            if out.held >= FLUSH_PAIRS:
                yield from out.taken()
        yield from out.taken()

    return mapper


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fine = []
        for x, y in zip(shingle_sets(batch.column(2), WIDTH), shingle_sets(batch.column(3), WIDTH), strict=True):
            both = np.sort(np.concatenate([x, y]))
            shared = int((both[1:] == both[:-1]).sum())
            fine.append(DEN * shared >= NUM * (len(both) - shared))
        kept = pa.array(fine, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar. Texts travel to the pairs: compressed, they are smaller than
    their sets."""
    ids = cut(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct())
    few = ids.count() <= BROADCAST_IDS
    wanted = texts.join(F.broadcast(ids) if few else ids, texts["doc_id"] == ids["rep"], "left_semi")
    joined = pairs.join(wanted.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(wanted.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long")


def _memberships(met: DataFrame, reps: DataFrame) -> DataFrame:
    """(block, rep, n), distinct, of blocks where a member's next smaller or larger one is near enough in size. A code
    that several classes share stands for each of them."""
    rows = met.where("block IS NOT NULL").select("block", "code").join(reps.select(F.col("m1").alias("code"), "rep", "n"), "code")
    by = Window.partitionBy("block").orderBy("n", "rep")
    rows = rows.select("block", "rep", "n").distinct()
    near = (F.lag("n").over(by) * DEN >= F.col("n") * NUM) | (F.col("n") * DEN >= F.lead("n").over(by) * NUM)
    return rows.withColumn("near", F.coalesce(near, F.lit(False))).where("near").drop("near")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Null texts, empty texts and texts without words have no shingles and link with nothing. Rows that repeat an id are
    one node: what one of them links with, all do. Rows without an id link with nothing and have a null component_id.
    No rows give no rows. Other columns are ignored."""
    spark = docs.sparkSession
    modest_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known_texts = texts.where("doc_id IS NOT NULL")
    sketch = spark.sparkContext.broadcast(shingle_sketch(texts))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = cut(texts.mapInArrow(_signed(sketch, parts, BLOCK), _SIGNED_TYPES).repartition("part").mapInArrow(_met, _MET_TYPES))
    signed = met.where("n IS NOT NULL").drop("block", "code")
    digest = ["n", "m1", "m2"]
    linkable = signed.where("doc_id IS NOT NULL AND n > 0")
    reps = cut(linkable.groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.first("vector").alias("vector")))
    members = cut(_memberships(met, reps))

    links, tried, roots = None, None, None
    for turn in range(ROUNDS + 2):
        if roots is None:
            live = members.withColumn("root", F.col("rep"))
        else:
            live = members.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
            several = live.groupBy("block").agg((F.min("root") != F.max("root")).alias("several")).where("several").select("block")
            live = live.join(several, "block", "left_semi")
        ordered = live.join(reps.select("rep", "n", "vector"), ["rep", "n"]).select("block", "rep", "n", "vector", "root").repartition("block").sortWithinPartitions("block", "n", "rep")
        proposed = cut(ordered.mapInArrow(_candidates(turn), "a long, b long, block long"))
        members = members.join(proposed.where("block IS NOT NULL").select("block"), "block", "left_semi")
        pairs = proposed.where("a <> b").select("a", "b").distinct()
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        if not pairs.isEmpty():
            tried = pairs if tried is None else tried.union(pairs)
            found = cut(_verified(pairs, known_texts))
            if not found.isEmpty():
                links = found if links is None else links.union(found)
                roots = components(links)
        if members.isEmpty():
            break
    if roots is None:
        roots = spark.createDataFrame([], "node long, root long")
    same_id = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*digest)).alias("d"), F.max(F.struct(*digest)).alias("e")).where("d <> e")
    classes = reps.join(roots, reps["rep"] == roots["node"], "left").select(*digest, F.coalesce("root", "rep").alias("root"))
    if not same_id.isEmpty():  # ids that stand for several texts tie the classes of these together
        tied = linkable.join(same_id.select("doc_id"), "doc_id", "left_semi").join(classes, digest).select(F.col("doc_id").alias("a"), F.col("root").alias("b"))
        roots = components(classes.join(reps, digest).select(F.col("rep").alias("a"), F.col("root").alias("b")).union(tied))
        classes = reps.join(roots, reps["rep"] == roots["node"], "left").select(*digest, F.coalesce("root", "rep").alias("root"))
    out = signed.select("doc_id", *digest).join(classes, digest, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't near duplicates of one with a smaller id, with all their columns. Rows without an
    id stay."""
    return without_ids(docs, near_duplicates(docs, id_col, text_col).where("doc_id <> component_id").select("doc_id"), id_col)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda k: array_to_string(w[k + 1 : k + 5], ' ')) ELSE [array_to_string(w, ' ')] END) AS g
  FROM d WHERE len(w) > 0),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN z p ON p.doc_id = x JOIN z q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other)
SELECT r.doc_id, coalesce(max(z.n), 0) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN z ON z.doc_id = r.doc_id GROUP BY r.doc_id
"""
