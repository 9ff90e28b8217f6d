"""Near-duplicate join on word shingles by parity sketches.

A document's set holds the hashes of its distinct `SHINGLE`-word shingles.  Sets that reach the similarity differ in at
most d elements, d from their sizes.  Sets of one size band (and of two adjoining ones) are cut into m > d segments by
an element's hash; a segment's parity is the XOR of its elements' hashes.  One differing element changes one segment, so
two sets within d agree in at least m - d segments: joining on segments loses no pair.  An empty segment says nothing;
it counts only for a set that has m - d of them or more.  Pairs that share a segment are filtered by parity sketches, whose
Hamming distance is at most the symmetric difference, and then verified on the whole sets.  A sketch has two to four bits
an element, a power of two of them; of two, the longer is folded to the shorter's length.

Sets, not documents, are joined: copies collapse to one entity first, inside the tasks and again after the exchange.
Sets are verified in rounds, as only components are asked for: each with its nearest candidate first, then the pairs that
are still in different components.  A segment that many sets share is not expanded into pairs: its members are paired
with one of them, the pivot that most such segments hold.  All the members of a pivot are its star.  A star is searched in
tiles, first by sketches for the members that may have a partner in it, then, where those are still in different
components after the rounds, by sets: a task multiplies the incidence matrices of a tile's sets, or of two tiles', so that
it knows every intersection exactly, and returns a spanning forest of the links it finds.

Documents without words, null or empty, are linked with nothing.  With fewer than `SHINGLE` words the whole sequence is
the one shingle.  Shingles are compared by 48-bit hashes, sets by 64-bit sums of them.  Rows without a doc_id take the
component of their set, or none.  Extra columns are ignored; repeated rows are rows of one set.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jobs
from .components import components
from .textops import SPACED, U64, Words, mix64, window_hashes

SHINGLE, PERCENT = 5, 80
#: Members of a segment's group that are compared pairwise at once; larger groups go by a pivot first.
PAIRWISE = 8
#: Sets and bytes of sets in a tile of a star, about, and sketches and their bytes.
TILE, TILE_BYTES, SKETCH_TILE, SKETCH_BYTES = 512, 2 << 20, 2048, 1 << 20
#: Bytes of a shingle's id in a stored set, and columns of an incidence matrix.
_ID, _COLUMNS = 6, 4096
#: Words of 64 bits of the longest sketch.
_LONGEST = 1024
_SEED = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 48-bit shingle ids of a batch, distinct in each row and sorted by row, then id."""
    rows = words.row_of()
    grams = window_hashes(words.hashes, width)
    n = len(grams)
    ok = rows[:n] == rows[width - 1 :] if n else np.zeros(0, bool)
    row, gram = rows[:n][ok].astype(U64), grams[ok]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        whole = np.empty(len(short), U64)
        with np.errstate(over="ignore"):
            for k, r in enumerate(short.tolist()):
                h = U64(words.counts[r])
                for x in words.hashes[words.rows[r] : words.rows[r + 1]]:
                    h = h * U64(_SEED[0]) + x
                whole[k] = h
        row, gram = np.append(row, short.astype(U64)), np.append(gram, mix64(whole))
    both = np.sort((row << U64(48)) | (gram >> U64(16)))
    if len(both):
        both = both[np.append(True, both[1:] != both[:-1])]
    return (both >> U64(48)).astype(np.int64), both & U64((1 << 48) - 1)


@lru_cache(4)
def bands(percent: int, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sizes of the bands, and of each band's join (with itself and the next band) the bound d and the segments m."""
    first = [1]
    while first[-1] < most:
        first.append(max(first[-1] + 1, -(-first[-1] * 100 // percent)))
    d, m = [], []
    for low_end, high_end in zip(first[1:-1], first[2:], strict=True):
        a = low_end - 1
        b = min(high_end - 1, a * 100 // percent)
        d.append((a + b) * (100 - percent) // (100 + percent))
        m.append(d[-1] + 1 + -(-d[-1] // 10))
    return np.array(first, np.int64), np.array(d, np.int64), np.array(m, np.int64)


def _segments(row: np.ndarray, mixed: np.ndarray, size: np.ndarray, join: np.ndarray, percent: int):
    """Keys of the segments of each row in the size join `join` (-1: none): the row of each key, and the key."""
    _, d, m = bands(percent)
    rows = np.flatnonzero(join >= 0)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    parts = np.zeros(len(size), np.int64)
    parts[rows] = m[join[rows]]
    at = np.cumsum(parts) - parts
    mine = parts[row] > 0
    r, x = row[mine], mixed[mine]
    part = ((x >> U64(32)) * parts[r].astype(U64)) >> U64(32)
    slot = at[r] + part.astype(np.int64)
    parity = np.zeros(int(parts.sum()), U64)
    np.bitwise_xor.at(parity, slot, mix64(x ^ U64(_SEED[1])))
    full = np.zeros(len(parity), bool)
    full[slot] = True
    owner = np.repeat(np.arange(len(size)), parts)
    place = np.arange(len(parity)) - at[owner]
    empty = np.bincount(owner[~full], minlength=len(size))
    odd = np.zeros(len(size), bool)
    odd[rows] = empty[rows] >= m[join[rows]] - d[join[rows]]
    use = full | odd[owner]
    with np.errstate(over="ignore"):
        salt = mix64((join[owner].astype(U64) << U64(40)) + place.astype(U64) + U64(1))
        keys = mix64(parity + salt)
    return owner[use], keys[use]


def _sketches(row: np.ndarray, mixed: np.ndarray, size: np.ndarray) -> list[bytes]:
    """The parity sketch of each row's elements."""
    words = 1 << np.clip(np.ceil(np.log2(np.maximum(size, 1) / 32)), 0, int(np.log2(_LONGEST))).astype(np.int64)
    ends = np.cumsum(words)
    bit = (mixed & (words[row] * 64 - 1).astype(U64)).astype(np.int64)
    count = np.bincount((ends - words)[row] * 64 + bit, minlength=int(ends[-1]) * 64 if len(ends) else 0)
    raw = np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[8 * a : 8 * b] for a, b in zip((ends - words).tolist(), ends.tolist(), strict=True)]


def _folded(sketches: list[bytes], words: int) -> np.ndarray:
    """Sketches as rows of so many words, which each has at least."""
    out = np.zeros((len(sketches), words), U64)
    sizes = np.array([len(x) // 8 for x in sketches], np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        rows = np.frombuffer(b"".join(sketches[i] for i in at.tolist()), "<u8").reshape(len(at), size // words, words)
        out[at] = np.bitwise_xor.reduce(rows, axis=1)
    return out


_KEY = ["<u4", "<u2", "<u8"]


def _entities(ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set."""
    sums = np.append(U64(0), np.cumsum(mix64(mix64(ids + U64(_SEED[0]))), dtype=U64))
    ends = np.cumsum(size)
    with np.errstate(over="ignore"):
        return mix64(sums[ends] - sums[ends - size] + size.astype(U64))


def _pack(n: int, width: int, percent: int):
    def run(batches):
        first, _, _ = bands(percent)
        for batch in jobs.slices(batches):
            words = Words(batch.column("text"), SPACED, True)
            rows = len(words.counts)
            row, ids = shingle_sets(words, width)
            size = np.bincount(row, minlength=rows)
            mixed = mix64(ids + U64(_SEED[0]))
            entity = _entities(ids, size)
            # one row of each set in this batch stands for its copies
            _, one = np.unique(entity, return_index=True)
            stands = np.zeros(rows, bool)
            stands[one] = True
            stands &= size > 0
            band = np.searchsorted(first, size, side="right") - 1
            r, x = row[stands[row]], mixed[stands[row]]
            got = [_segments(r, x, size, np.where(stands, j, -1), percent) for j in (band, band - 1)]
            owner = np.concatenate([g[0] for g in got])
            key = np.concatenate([g[1] for g in got])
            out = list(jobs.packed(((key >> U64(48)).astype(np.int64) * n >> 16).astype(np.int32), n, [key.astype("<u4"), ((key >> U64(32)) & U64(0xFFFF)).astype("<u2"), entity[owner].astype("<u8")]))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(out), np.int32)), pa.array(np.array([b for b, _ in out], np.int32)), jobs.binaries([x for _, x in out]), *[pa.nulls(len(out), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]], _NAMES)
            to = (entity % U64(n)).astype(np.int32)
            blob = _sketches(row, mixed, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, np.int32)), pa.array(to), pa.nulls(rows, pa.binary()), batch.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(entity.view(np.int64)), jobs.binaries(blob)], _NAMES)

    return run


_NAMES = ["kind", "bucket", "blob", "doc_id", "n_shingles", "entity", "sketch"]
_PACKED = "kind int, bucket int, blob binary, doc_id long, n_shingles long, entity long, sketch binary"
_GROUPED = "kind int, a long, b long, doc_id long, n_shingles long, entity long, sketch binary"
_GROUPED_NAMES = ["kind", "a", "b", "doc_id", "n_shingles", "entity", "sketch"]


def _pair_batch(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([a, b], 1), axis=0)
    k = len(both)
    return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), *[pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]], _GROUPED_NAMES)


def _members(key: np.ndarray, entity: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, member) of large groups; equal groups of several segments are one."""
    index = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    first = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        print_ = np.add.reduceat(mix64(entity[index].view(U64)), first)
    _, one = np.unique(print_, return_index=True)
    kept = np.zeros(len(start), bool)
    kept[one] = True
    kept = np.repeat(kept, size)
    return key[index][kept].view(np.int64), entity[index][kept]


def _groups(batches):
    """Kind 0: the rows of the documents.  Kind 1: pairs of entities that share a segment.  Kind 2: large groups and their members."""
    blobs = []
    for batch in batches:
        is_meta = pc.equal(batch.column("kind"), 0)
        meta = batch.filter(is_meta)
        blobs += batch.column("blob").drop_null().to_pylist()
        if meta.num_rows:
            k = meta.num_rows
            yield pa.RecordBatch.from_arrays([meta.column("kind"), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), *[meta.column(c) for c in _NAMES[3:]]], _GROUPED_NAMES)
    if not blobs:
        return
    low, high, entity = jobs.unpacked(blobs, _KEY)
    del blobs
    key = (high.astype(U64) << U64(32)) | low
    order = np.lexsort((entity, key))
    key, entity = key[order], entity[order]
    keep = np.append(True, (key[1:] != key[:-1]) | (entity[1:] != entity[:-1]))
    key, entity = key[keep], entity[keep].view(np.int64)
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    pairs = []
    for s in range(2, PAIRWISE + 1):
        at = start[size == s]
        i, j = np.triu_indices(s, 1)
        pairs.append(np.stack([entity[(at[:, None] + i).ravel()], entity[(at[:, None] + j).ravel()]], 1))
    both = np.sort(np.concatenate(pairs), axis=1)
    if len(both):
        yield _pair_batch(1, both[:, 0], both[:, 1])
    large = size > PAIRWISE
    if large.any():
        yield _pair_batch(2, *_members(key, entity, start[large], size[large]))


_NEAR_NAMES = ["a", "b", "ra", "rb", "na", "nb"]
_NEAR = "a long, b long, ra long, rb long, far int"


def _close(percent: int):
    """The pairs of sets whose sizes and sketches allow the similarity, with the distance of their sketches."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch.column(c).to_pylist() for c in ("sa", "sb"))
            na, nb = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
            words = np.minimum([len(x) for x in a], [len(x) for x in b]) // 8
            far = np.zeros(len(a), np.int64)
            for w in np.unique(words).tolist():
                at = np.flatnonzero(words == w).tolist()
                far[at] = np.bitwise_count(_folded([a[i] for i in at], w) ^ _folded([b[i] for i in at], w)).sum(1, dtype=np.int64)
            ok = pa.array((far * (100 + percent) <= (na + nb) * (100 - percent)) & (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(ok) for c in ("a", "b", "ra", "rb")), pa.array(far.astype(np.int32)).filter(ok)], ["a", "b", "ra", "rb", "far"])

    return run


_SETS = "entity long, rep long, ids binary, partner long, partner_rep long"


def _sets(width: int):
    """The sets of documents that stand for an entity, once each; rows of one doc_id come together."""

    def run(batches):
        seen: tuple[int | None, set[int]] = (None, set())
        for batch in jobs.slices(batches):
            words = Words(batch.column("text"), SPACED, True)
            row, ids = shingle_sets(words, width)
            ends = np.searchsorted(row, np.arange(len(words.counts) + 1))
            raw = np.ascontiguousarray(ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_ID])
            names = _entities(ids, np.diff(ends)).view(np.int64)
            keep, blobs = [], []
            for k in np.flatnonzero(names == np.asarray(batch.column("entity"))).tolist():
                doc = batch.column("rep")[k].as_py()
                if doc != seen[0]:
                    seen = (doc, set())
                if int(names[k]) not in seen[1]:
                    seen[1].add(int(names[k]))
                    keep.append(k)
                    blobs.append(raw[ends[k] : ends[k + 1]].tobytes())
            kept = batch.take(pa.array(np.array(keep, np.int64)))
            yield pa.RecordBatch.from_arrays([kept.column("entity"), kept.column("rep"), jobs.binaries(blobs), kept.column("partner"), kept.column("partner_rep")], ["entity", "rep", "ids", "partner", "partner_rep"])

    return run


def _read_set(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // _ID, 8), np.uint8)
    wide[:, :_ID] = np.frombuffer(blob, np.uint8).reshape(-1, _ID)
    return wide.view("<u8").ravel()


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("ia").to_pylist(), batch.column("ib").to_pylist(), strict=True)):
                both = np.sort(np.concatenate([_read_set(x), _read_set(y)]))
                shared = int((both[1:] == both[:-1]).sum())
                ok[k] = 100 * shared >= percent * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("ra").filter(pa.array(ok)), batch.column("rb").filter(pa.array(ok))], ["a", "b"])

    return run


def _shared(sets: list[np.ndarray], cut: int) -> np.ndarray:
    """Sizes of the intersections of the first `cut` sets with the others, by products of incidence matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1  # an element of one set is in no intersection
    use = count[code] > 1
    owner, code = owner[use], column[code[use]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((cut, len(sets) - cut), np.float32)
    for a in range(0, int(code[-1]) + 1 if len(code) else 0, _COLUMNS):
        i, j = np.searchsorted(code, [a, a + _COLUMNS])
        held = np.zeros((len(sets), _COLUMNS), np.float32)
        held[owner[i:j], code[i:j] - a] = 1
        out += held[:cut] @ held[cut:].T
    return np.rint(out).astype(np.int64)


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of pairs that join different trees, in order."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            up[x] = y
            kept.append(k)
    return np.array(kept, np.int64)


def _across(percent: int):
    """A spanning forest of the links between sets of different components in two tiles."""

    def run(batches):
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                if not right.is_valid:  # a whole star
                    left = right = left.values
                else:
                    left, right = left.values, right.values
                rep, component = (np.concatenate([np.asarray(x.field(k)) for x in (left, right)]) for k in "rc")
                sets = [_read_set(x) for side in (left, right) for x in side.field("s").to_pylist()]
                size, cut = np.array([len(x) for x in sets]), len(left)
                shared = _shared(sets, cut)
                close = 100 * shared >= percent * (size[:cut, None] + size[None, cut:] - shared)
                i, j = np.nonzero(close & (component[:cut, None] != component[None, cut:]))
                kept = _forest(component[i], component[cut + j])
                if len(kept):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[i[kept]]), pa.array(rep[cut + j[kept]])], ["a", "b"])

    return run


def _may_link(percent: int):
    """(t, e) of the members of a star that another one's size and sketch allow to be similar, of two tiles or a whole star."""

    def run(batches):
        for batch in batches:
            for t, left, right in zip(batch.column("t").to_pylist(), batch.column("left"), batch.column("right"), strict=True):
                left = left.values
                right = right.values if right.is_valid else left
                (ea, na), (eb, nb) = ((np.asarray(x.field("e")), np.asarray(x.field("n"))) for x in (left, right))
                sketches = [x.field("s").to_pylist() for x in (left, right)]
                words = min(len(x) for side in sketches for x in side) // 8
                sa, sb = (_folded(x, words) for x in sketches)
                found = [np.zeros(0, np.int64)]
                for i in range(len(ea)):
                    j = np.flatnonzero((ea[i] != eb) & (np.minimum(nb, na[i]) * 100 >= np.maximum(nb, na[i]) * percent))
                    far = np.bitwise_count(sb[j] ^ sa[i]).sum(1, dtype=np.int64)
                    j = j[far * (100 + percent) <= (nb[j] + na[i]) * (100 - percent)]
                    if len(j):
                        found += [ea[i : i + 1], eb[j]]
                e = np.unique(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), t, np.int64)), pa.array(e)], ["t", "e"])

    return run


def _tile_pairs(star: DataFrame, payload: list[str], tile: int, tile_bytes: int) -> DataFrame:
    """Rows (t, left, right) of two tiles of a star, or a whole one (right is null).

    star: t, e (a member), odd, size (bytes), and the payload.  Members that are not odd are compared with the odd ones
    only.  A tile meets the others by their numbers, so that a large star's pairs spread over tasks.
    """
    need = lambda rows: F.ceil(F.greatest(F.count_if(rows) / tile, F.sum(F.when(rows, F.col("size")).otherwise(0)) / tile_bytes)).cast("int")
    parts = star.groupBy("t").agg(need(F.lit(True)).alias("parts"), need(F.col("odd")).alias("odd_parts"), need(~F.col("odd")).alias("even_parts"))
    mine = star.join(parts.filter("odd_parts > 0"), "t").withColumn("k", F.pmod(F.xxhash64("e"), F.when(F.col("parts") == 1, 1).when(F.col("odd"), F.col("odd_parts")).otherwise(F.col("even_parts"))).cast("int"))
    mine = mine.withColumn("odd", F.col("odd") | (F.col("parts") == 1))
    tiles = jobs.stored(mine.groupBy("t", "odd", "k", "parts", "odd_parts", "even_parts").agg(F.collect_list(F.struct(*payload)).alias("m")), "tiles")
    whole = tiles.filter("parts = 1").select("t", F.col("m").alias("left"), F.lit(None).cast(tiles.schema["m"].dataType).alias("right"))
    cut = tiles.filter("parts > 1")
    later = F.transform(F.sequence(F.col("k"), F.col("odd_parts") - 1), lambda u: F.struct(F.lit(True).alias("odd"), u.alias("k")))
    even = F.when(F.col("even_parts") > 0, F.transform(F.sequence(F.lit(0), F.col("even_parts") - 1), lambda u: F.struct(F.lit(False).alias("odd"), u.alias("k")))).otherwise(F.array().cast("array<struct<odd:boolean,k:int>>"))
    left = cut.filter("odd").select("t", F.col("m").alias("left"), F.explode(F.concat(later, even)).alias("to")).select("t", "to.odd", "to.k", "left")
    return whole.unionByName(left.join(cut.select("t", "odd", "k", F.col("m").alias("right")).hint("merge"), ["t", "odd", "k"]).select("t", "left", "right"))


def _nearest(near: DataFrame) -> DataFrame:
    """Each entity of the candidates with its nearest by sketch (x, rx, y, ry); of two that are each other's, one has none."""
    both = near.select(F.col("a").alias("x"), F.col("ra").alias("rx"), F.col("b").alias("y"), F.col("rb").alias("ry"), "far")
    both = both.unionByName(near.select(F.col("b").alias("x"), F.col("rb").alias("rx"), F.col("a").alias("y"), F.col("ra").alias("ry"), "far"))
    best = both.groupBy("x").agg(F.first("rx").alias("rx"), F.min_by(F.struct("y", "ry"), F.struct("far", F.xxhash64("y"))).alias("to")).select("x", "rx", "to.y", "to.ry")
    mutual = best.filter("x > y").join(best.select(F.col("y").alias("x"), F.col("x").alias("y")), ["x", "y"], "left_semi").select("x", F.lit(True).alias("twice"))
    return best.join(mutual, "x", "left").select("x", "rx", *[F.when(F.col("twice").isNull(), F.col(c)).alias(c) for c in ("y", "ry")])


def _pivots(groups: DataFrame) -> DataFrame:
    """(t, e): for each member e of a large group, the group's pivot t, the member of the most large groups.

    groups: g, e.  Both aggregates combine before their shuffle, so that a hot group's rows don't meet in one task.
    """
    held = groups.groupBy("e").agg(F.count("*").alias("held"))
    pivot = groups.join(held, "e").groupBy("g").agg(F.max_by("e", F.struct("held", F.xxhash64("e"))).alias("t"))
    return groups.join(pivot, "g").filter("e <> t").select("t", "e").distinct()


def _labelled(rows: DataFrame, label: DataFrame, column: str, name: str) -> DataFrame:
    """The rows with the component of a column's document; without links it is its own."""
    known = label.select(F.col("node").alias(column), F.col("component").alias(name))
    return rows.join(known, column, "left").withColumn(name, F.coalesce(name, column))


def jaccard_links(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, tile: int = TILE, tile_bytes: int = TILE_BYTES, sketch_tile: int = SKETCH_TILE, sketch_bytes: int = SKETCH_BYTES) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, n_shingles, rep) and the verified links (a, b) between representatives of distinct sets.

    A representative is the smallest doc_id of a set.  Links between sets of one component may be left out.
    """
    spark = docs.sparkSession
    n = jobs.partitions(spark)
    docs = docs.select("doc_id", "text")
    packed = docs.mapInArrow(jobs.tidy(_pack(n, width, percent)), _PACKED).repartitionById(n, F.col("bucket"))
    grouped = jobs.stored(packed.mapInArrow(jobs.tidy(_groups), _GROUPED), "segments")
    meta = grouped.filter("kind = 0").select("doc_id", "n_shingles", "entity", "sketch")
    reps = jobs.stored(meta.filter("n_shingles > 0").groupBy("entity").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("s")).filter("rep is not null"), "representatives")
    of = lambda x, *columns: reps.select(F.col("entity").alias(x), *[F.col(c).alias(c[0] + x) for c in columns])

    # candidates: pairs of a small segment, pivots and members of large ones
    stars = jobs.stored(_pivots(grouped.filter("kind = 2").select(F.col("a").alias("g"), F.col("b").alias("e"))), "stars")
    pairs = grouped.filter("kind = 1").select("a", "b").unionByName(stars.select(F.col("t").alias("a"), F.col("e").alias("b"))).distinct()
    pairs = pairs.join(of("a", "rep", "n", "s"), "a").join(of("b", "rep", "n", "s"), "b").select(*_NEAR_NAMES, "sa", "sb")
    near = jobs.stored(pairs.mapInArrow(jobs.tidy(_close(percent)), _NEAR), "candidates")
    large = not stars.isEmpty()
    if large:
        whole = stars.unionByName(stars.select("t", F.col("t").alias("e")).distinct()).withColumn("odd", F.lit(True))
        sketched = whole.join(reps.select(F.col("entity").alias("e"), "n", "s", F.octet_length("s").alias("size")), "e")
        members = jobs.stored(_tile_pairs(sketched, ["e", "n", "s"], sketch_tile, sketch_bytes).mapInArrow(jobs.tidy(_may_link(percent)), "t long, e long").distinct(), "members")

    # the sets of documents that may link; sets and texts move by joins of one form at every size
    ends = near.select(F.explode(F.array("a", "b")).alias("entity"))
    ends = (ends.unionByName(members.select(F.col("e").alias("entity"))) if large else ends).distinct()
    wanted = ends.join(_nearest(near).withColumnRenamed("x", "entity"), "entity", "left").join(reps.select("entity", "rep"), "entity")
    wanted = wanted.select(F.col("rep").alias("doc_id"), "entity", "rep", F.col("y").alias("partner"), F.col("ry").alias("partner_rep"))
    sets = jobs.stored(docs.join(wanted.hint("merge"), "doc_id").drop("doc_id").mapInArrow(jobs.tidy(_sets(width)), _SETS), "sets")
    other = lambda key, ids: sets.select(F.col("entity").alias(key), F.col("ids").alias(ids)).hint("merge")
    verified = lambda rows: jobs.stored(rows.select("ra", "rb", "ia", "ib").mapInArrow(jobs.tidy(_verify(percent)), "a long, b long"), "links")

    first = sets.filter("partner is not null").select(F.col("rep").alias("ra"), F.col("partner_rep").alias("rb"), F.col("ids").alias("ia"), F.col("partner").alias("b"))
    links = verified(first.join(other("b", "ib"), "b"))
    label = components(links)
    apart = jobs.stored(_labelled(_labelled(near.select("a", "b", "ra", "rb"), label, "ra", "ca"), label, "rb", "cb").filter("ca <> cb").drop("ca", "cb"), "apart")
    links = links.unionByName(verified(apart.join(other("a", "ia"), "a").join(other("b", "ib"), "b")))
    if large:
        star = _labelled(members.join(reps.select(F.col("entity").alias("e"), F.col("rep").alias("r"), "n"), "e"), components(links), "r", "c")
        home = star.groupBy("t").agg(F.mode("c").alias("home"), F.count_distinct("c").alias("components")).filter("components > 1").select("t", "home")
        star = star.join(home, "t").select("t", "e", "r", "c", (F.col("c") != F.col("home")).alias("odd"), (F.col("n") * _ID).alias("size"))
        held = star.join(sets.select(F.col("entity").alias("e"), F.col("ids").alias("s")).hint("merge"), "e")
        more = _tile_pairs(held, ["r", "c", "s"], tile, tile_bytes).mapInArrow(jobs.tidy(_across(percent)), "a long, b long")
        links = links.unionByName(jobs.stored(more, "links"))
    return meta.join(reps.select("entity", "rep"), "entity", "left").select("doc_id", "n_shingles", "rep"), links


def jaccard_components(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable over links) of every document."""
    rows, links = jaccard_links(docs, width, percent)
    label = components(links)
    return rows.join(label, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
