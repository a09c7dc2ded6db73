"""Jaccard join of documents on distinct word shingles: size-banded tiles with hashed bitmap signatures.

1. Each text becomes a set of 64-bit shingle hashes. Equal sets are one set from here on (their documents are one class).
2. A set's prefix is its first hashes in a global order, so many that two sets that link share one. Prefix hashes are shuffled as
   packed arrays; sets that share one are a tile, and tiles with much the same sets are put together.
3. Within a tile sets are ordered by size, and a set is compared only with the band of sizes that can link. Each set has a bitmap
   of the parities of its hashes, as wide as its size asks for. The bits that differ are at most the hashes that differ, so their
   count bounds the overlap from above; pairs that cannot reach the threshold go. A tile of more than BLOCK sets is dealt to blocks,
   and a task holds two of them.
4. The pairs left are verified by intersecting the sorted hash arrays. In a first round a set is verified only against the first
   set that passes the bound in its tile's block 0 or else in its own block; in a second round, of tiles whose sets are not yet in one
   component, any two blocks meet and pairs of different components that pass are verified. So a large group of near copies costs
   about a pair for each member, and no link between components is lost.
5. Pairs meet the array of their second set by groups of at most about GROUP pairs of one such set: the array is sent once to each
   group, and the arrays of the first sets stream past it.

The global order puts hashes that are frequent in a bounded sample last. It decides the work only, not the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import documents, last_long, small_batches, stored, tidied
from cinelake.llm.components import components

WORDS = 5
#: Two sets link when LINK[0] * union <= LINK[1] * intersection.
LINK = (80, 100)
#: Sets whose shingles tell which are frequent, about, and in how many of them a shingle is.
SAMPLE, FREQUENT = 4096, 8
#: Sets of a tile's block, and pairs that meet one copy of their smaller set's array, about.
BLOCK, GROUP = 2048, 256
#: Bits of the filter of ids for each id, at most in all as a power of two (128 MB), and in a page (as Spark's bitmaps have).
PER_ID, MOST, PAGE = 16, 30, 32768
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACES = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        _powers["up"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _BASE)]))
        _powers["down"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _INVERSE)]))
    return _powers["up"], _powers["down"]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``words`` words. With fewer words the whole sequence is one; without, none."""
    raw = np.frombuffer((text or "").encode().lower() + b" ", dtype=np.uint8)  # bytes.lower() changes A-Z alone
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(space, prepend=True))  # starts and ends of words in turn
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(up[: len(raw)] * (raw.astype(np.uint64) + np.uint64(1)))])
    word = _mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))
    if len(word) < words:
        places = np.cumprod(np.full(len(word), _PLACES[0]))
        return _mixed(np.array([(word * places).sum() + np.uint64(len(word))], dtype=np.uint64))
    places = _PLACES[:words] if words <= len(_PLACES) else np.cumprod(np.full(words, _PLACES[0]))
    h = np.zeros(len(word) - words + 1, dtype=np.uint64)
    for k in range(words):
        h += word[k : k + len(h)] * places[k]
    return np.unique(_mixed(h))


def _set_id(hashes: np.ndarray) -> int:
    return int.from_bytes(blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _width(n: int) -> int:
    """64-bit words of the bitmap of a set of n hashes: at least two bits for each."""
    return max(1, 1 << max(0, (2 * n - 1).bit_length() - 6))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Parities of the number of hashes by their low bits."""
    bits = _width(len(hashes)) * 64
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(text.as_py()) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_set_id(h) for h in found], pa.int64()), pa.array([len(h) for h in found], pa.int64()), pa.array([bitmap(h).tobytes() if len(h) else b"" for h in found], pa.binary())], names=["id", "set", "n", "bits"])


def _least_shared(n: int) -> int:
    """Hashes that a set of n shares with any set that it links with, at least."""
    return -(-n * LINK[0] // LINK[1])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of the prefix hashes of a partition: key (smallest set) and packed sets."""
    by_bucket: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for bucket, hashes, sets in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            by_bucket.setdefault(bucket, []).append((np.frombuffer(hashes, np.uint64), np.frombuffer(sets, np.int64)))
    groups: list[np.ndarray] = []
    for parts in by_bucket.values():
        hashes, sets = np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])
        order = np.lexsort((sets, hashes))
        hashes, sets = hashes[order], sets[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (sets[1:] != sets[:-1])
        hashes, sets = hashes[new], sets[new]
        cuts = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] ^ np.uint64(1)))
        sizes = np.diff(cuts, append=len(hashes))
        groups += [sets[c : c + n] for c, n in zip(cuts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True)]
    yield _tiles(together(groups))


def together(groups: list[np.ndarray]) -> list[list[int]]:
    """Groups of sets, put together where one has half of another: every pair of a group is in a group of the result."""
    groups = list({x.tobytes(): x for x in groups}.values())
    groups.sort(key=lambda x: (-len(x), x[0]))
    out: list[set[int]] = []
    where: dict[int, list[int]] = {}
    for group in groups:
        own = group.tolist()
        votes: dict[int, int] = {}
        for x in own:
            for at in where.get(x, ()):
                votes[at] = votes.get(at, 0) + 1
        best = max(votes, key=lambda k: (votes[k], -k), default=-1)
        if best < 0 or 2 * votes[best] < len(own):
            best = len(out)
            out.append(set())
        held = out[best]
        for x in own:
            if x not in held:
                held.add(x)
                where.setdefault(x, []).append(best)
    return [sorted(x) for x in out]


def _tiles(groups: list[list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in groups], pa.int64()), pa.array([np.array(x, np.int64).tobytes() for x in groups], pa.binary())], names=["key", "sets"])


def _again(table: pa.Table) -> pa.Table:
    """Tiles with the same smallest set, put together where they overlap, each set in a row."""
    groups = together([np.frombuffer(x, np.int64) for x in table.column("sets").to_pylist()])
    key = table.column("key")[0].as_py()
    name = [int.from_bytes(blake2b(np.array(x, np.int64).tobytes() + key.to_bytes(8, "little", signed=True), digest_size=8).digest(), "little", signed=True) for x in groups]
    return pa.table({"tile": pa.array(np.repeat(np.array(name, np.int64), [len(x) for x in groups])), "set": pa.array([y for x in groups for y in x], pa.int64())})


def _passing(n: np.ndarray, bits: list[bytes], allowed: Callable[[int, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, in order of size, the earlier ones whose bitmap leaves room for a link. n ascends. ``allowed`` marks, of places
    before a place, those that are to be compared with it."""
    width = np.array([len(x) // 8 for x in bits])
    total = LINK[0] + LINK[1]
    rows = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
    table = {w: np.frombuffer(b"".join(bits[k] for k in at.tolist()), np.uint64).reshape(-1, w) for w, at in rows.items()}
    for w, at in rows.items():
        for other in (w // 2, w):
            if other not in rows or not other:
                continue
            mine, theirs, place = table[w], table[other], rows[other]
            if other < w:  # a parity of the narrow bitmap is that of two bits of the wide one
                mine = mine[:, :other] ^ mine[:, other:]
            sizes = n[place]
            for k, x in enumerate(at.tolist()):
                low = int(np.searchsorted(sizes, -(-int(n[x]) * LINK[0] // LINK[1])))
                high = int(np.searchsorted(place, x))
                if low >= high:
                    continue
                near, least, rest = place[low:high], sizes[low:high], theirs[low:high]
                if allowed is not None:
                    wanted = allowed(x, near)
                    if not wanted.any():
                        continue
                    near, least, rest = near[wanted], least[wanted], rest[wanted]
                differ = np.bitwise_count(rest ^ mine[k]).sum(axis=1, dtype=np.int64)
                # |A| + |B| - 2 I <= (|A| + |B|) (LINK[1] - LINK[0]) / (LINK[0] + LINK[1]) where they link
                ok = near[differ * total <= (least + n[x]) * (LINK[1] - LINK[0])]
                if len(ok):
                    yield x, ok


def _compared(first: bool):
    """Pairs of each task to verify. Rows come by tile and task: tile, task, set, n, bits, block, own (whether
    the row meets others of its block in this task) and root.

    The first round gives one pair for each set, with the first set of block 0 that passes or, where none does, of its own block; and
    each set that passes with any other as a pair with itself."""

    def pairs(rows: list[tuple]) -> list[tuple[int, int]]:
        rows = sorted(set(rows), key=lambda x: (x[3], x[2]))
        n, block, own = (np.array([x[k] for x in rows], dtype=np.int64) for k in (3, 5, 6))
        root = np.array([x[7] for x in rows], dtype=np.int64)
        if not first and (root == root[0]).all():
            return []
        found: list[tuple[int, int]] = []
        later = rows[0][1] > 0  # a task of the first round in which block 0 only waits for the others

        def allowed(x: int, places: np.ndarray) -> np.ndarray:
            meets = (block[places] != block[x]) | (own[x] > 0)
            return meets if first else meets & (root[places] != root[x])

        none = len(rows)
        hub, near, touched = np.full(none, none), np.full(none, none), np.zeros(none, dtype=bool)
        for x, earlier in _passing(n, [x[4] for x in rows], allowed):
            if not first:
                found += [(rows[x][2], rows[y][2]) for y in earlier.tolist()]
                continue
            touched[earlier] = touched[x] = True
            if later and block[x] == 0:
                hub[earlier] = np.minimum(hub[earlier], x)
                continue
            waits = later & (block[earlier] == 0)
            for best, places in ((hub, earlier[waits]), (near, earlier[~waits])):
                if len(places):
                    best[x] = min(best[x], places.min())
        partner = np.where(hub < none, hub, near)
        found += [(rows[x][2], rows[partner[x]][2]) for x in np.flatnonzero(partner < none).tolist()]
        return found + [(rows[x][2], rows[x][2]) for x in np.flatnonzero(touched).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []
        out: list[tuple[int, int]] = []

        def done() -> pa.RecordBatch:
            own = set(out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in own], pa.int64()), pa.array([b for _, b in own], pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if row[:2] != task:
                    if len(held) > 1:
                        out += pairs(held)
                        if len(out) > 50_000:
                            yield done()
                    task, held = row[:2], []
                held.append(row)
        if len(held) > 1:
            out += pairs(held)
        yield done()

    return run


def _dealt(tiles: DataFrame, first: bool) -> DataFrame:
    """The sets of ``tiles`` (tile, set, n, bits, root) by task. Tiles of more than BLOCK sets are cut to blocks by a hash of the set.

    First round: a task for each block, where it meets itself and block 0. Second round: a task for any two blocks."""
    sizes = tiles.groupBy("tile").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    # only what tiles of many sets need is looked up; a small tile in one component is told by the task that gets it
    hot = stored(sizes.where(F.col("size") > BLOCK).select("tile", "size", (F.col("low") < F.col("high")).alias("open")), "jaccard-hot")
    rows = tiles.join(hot, "tile", "left").where(F.coalesce("open", F.lit(True)))
    rows = rows.withColumn("m", F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")).withColumn("block", F.pmod(F.xxhash64("set"), "m").cast("int"))
    if first:
        rows = rows.withColumn("task", F.explode(F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("m") - 1)).otherwise(F.array("block"))))
        own = (F.col("task") == 0) | (F.col("block") != 0)
    else:
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("task", F.least("block", "other") * F.col("m") + F.greatest("block", "other"))
        own = F.col("block") == F.col("other")
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("tile", "task", "set", "n", "bits", "block", own.cast("int").alias("own"), "root").repartition(n, "tile", "task").sortWithinPartitions("tile", "task")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that link. Rows come by second set and group: its own array first (role 0), then those of the first sets."""
    b, q = None, None
    for batch in batches:
        found = []
        for name, group, role, x, hashes in zip(*(batch.column(k) for k in ("b", "part", "role", "a", "hashes")), strict=True):
            p = np.frombuffer(hashes.as_buffer(), np.uint64)
            if role.as_py() == 0:
                b, q = (name.as_py(), group.as_py()), p.copy()
            elif (name.as_py(), group.as_py()) == b:
                shared = len(np.intersect1d(p, q, assume_unique=True))
                if LINK[1] * shared >= LINK[0] * (len(p) + len(q) - shared):
                    found.append((x.as_py(), b[0]))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def _verify(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) that link. ``pairs`` is a written table. A set that is the ``b`` of many pairs has many groups."""
    many = stored(pairs.groupBy("b").agg(F.count("*").alias("size")).where(F.col("size") > GROUP), "jaccard-many")
    parts = F.coalesce(F.ceil(F.col("size") / GROUP), F.lit(1))
    placed = pairs.join(many, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), parts).alias("part"))
    large = placed.join(arrays.withColumnRenamed("set", "a"), "a").select("b", "part", F.lit(1).alias("role"), "a", "hashes")
    small = placed.select("b", "part").distinct().join(arrays.withColumnRenamed("set", "b"), "b").select("b", "part", F.lit(0).alias("role"), F.col("b").alias("a"), "hashes")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = large.union(small).repartition(n, "b", "part").sortWithinPartitions("b", "part", "role")
    return met.mapInArrow(tidied(_verified), "a long, b long")


def _frequent(texts: DataFrame, known: DataFrame) -> np.ndarray:
    """The hashes that FREQUENT or more of about SAMPLE sets have, sorted; which sets is told by their names alone."""
    total = known.count()
    some = known.where(F.pmod(F.xxhash64("set"), F.lit(max(1, total))) < SAMPLE).select("set", "rep").collect()  # SAMPLE rows, about
    wanted = frozenset(row["set"] for row in some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _arrays(batches):
            for name, hashes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name in wanted:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(hashes.as_buffer(), np.int64))], names=["hash"])

    ids = texts.sparkSession.createDataFrame(sorted({(row["rep"],) for row in some}), "id long")
    found = texts.join(F.broadcast(ids), "id", "left_semi").mapInArrow(tidied(run), "hash long").groupBy("hash").count()
    return np.sort(found.where(F.col("count") >= FREQUENT).select("hash").toArrow().column(0).to_numpy().view(np.uint64))


def _sifted(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose id is in ``ids``, a written table, and few others: by a bitmap of hashed ids, PER_ID bits for each,
    in pages of PAGE bits. At most 2 ** MOST bits are broadcast; beyond that more texts pass."""
    slots = min(1 << MOST, max(PAGE, 1 << (PER_ID * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64("id"), F.lit(slots))
    pages = ids.groupBy(F.floor(slot / PAGE).alias("page")).agg(F.bitmap_construct_agg(slot % PAGE).alias("held"))
    byte = F.conv(F.hex(F.substring("held", F.floor(slot % PAGE / 8) + 1, F.lit(1))), 16, 10).cast("int")
    return texts.join(F.broadcast(pages), F.floor(slot / PAGE) == F.col("page")).where(F.getbit(byte, (slot % 8).cast("int")) == 1).select(*texts.columns)


def _arrays_of(texts: DataFrame, known: DataFrame, names: DataFrame) -> DataFrame:
    """The sorted hashes of the sets ``names``: from the text of one document of each. Few other texts are shuffled."""
    ids = stored(known.join(names, "set").select(F.col("rep").alias("id")).distinct(), "jaccard-wanted")
    # ids are distinct; an inner join, as Spark would put a semi join below that of the filter
    found = _sifted(texts, ids).join(ids.hint("shuffle_hash"), "id").mapInArrow(tidied(_arrays), "set long, hashes binary")
    # an id may have several rows with different texts: the set tells which is meant
    return stored(found.join(names, "set", "left_semi").dropDuplicates(["set"]), "jaccard-arrays")


def link(docs: DataFrame) -> DataFrame:
    """One row per distinct id: ``id`` (long; a null doc_id as the largest), ``n_shingles`` (long), ``component`` (smallest linked id).

    Two documents link when their sets of distinct shingles have a Jaccard similarity of at least 0.8; equal sets link, empty sets
    link with nothing. Rows of the same id are one document, with the smallest of their sets' hashes deciding which; other columns
    are ignored. An empty table gives an empty result.
    """
    texts = small_batches(docs).select(last_long("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    sets = stored(texts.mapInArrow(tidied(_sets), "id long, set long, n long, bits binary"), "jaccard-sets")
    ids = sets.groupBy("id").agg(F.min(F.struct("set", "n")).alias("s")).select("id", "s.set", "s.n")
    known = stored(sets.where("n > 0").groupBy("set").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")), "jaccard-known")
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(texts, known))  # at most 1 / FREQUENT of the sample's shingles

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(12, (16 * n - 1).bit_length())  # buckets by leading bits, several for each partition

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, sent = frequent.value, set()
        for batch in batches:
            own, of = [], []
            for text in batch.column(0):
                h = shingles(text.as_py())
                name = _set_id(h)
                if not len(h) or name in sent:
                    continue
                if len(sent) < 200_000:
                    sent.add(name)
                if len(often):
                    late = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h
                    h = np.concatenate([h[~late], h[late]])
                own.append(h[: len(h) - _least_shared(len(h)) + 1])
                of.append(np.full(len(own[-1]), name, dtype=np.int64))
            if own:
                h, of = np.concatenate(own), np.concatenate(of)
                bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                h, of, bucket = h[order], of[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array([x.tobytes() for x in np.split(h, cuts[1:])], pa.binary()), pa.array([x.tobytes() for x in np.split(of, cuts[1:])], pa.binary())], names=["bucket", "hashes", "sets"])

    packed = texts.select("text").mapInArrow(tidied(prefixes), "bucket long, hashes binary, sets binary").repartition(n, "bucket")
    groups = packed.mapInArrow(tidied(_grouped), "key long, sets binary").groupBy("key").applyInArrow(_again, "tile long, set long")
    tiles = stored(groups.join(known.select("set", "n", "bits"), "set").select("tile", "set", "n", "bits"), "jaccard-tiles")
    dealt = _dealt(tiles.withColumn("root", F.col("set")), True)
    found = stored(dealt.mapInArrow(tidied(_compared(True)), "a long, b long").distinct(), "jaccard-pairs")
    pairs, named = found.where("a != b"), found.where("a = b").select(F.col("a").alias("set"))
    arrays = _arrays_of(texts, known, named)
    links = stored(_verify(pairs, arrays), "jaccard-links")
    roots = components(links)
    rooted = stored(tiles.join(roots.select(F.col("node").alias("set"), "root"), "set", "left").select("tile", "set", "n", "bits", F.coalesce("root", "set").alias("root")), "jaccard-rooted")
    rest = _dealt(rooted, False).mapInArrow(tidied(_compared(False)), "a long, b long").distinct()
    rest = stored(rest.join(pairs, ["a", "b"], "left_anti"), "jaccard-rest")
    # sets of blocks that did not meet in the first round
    unknown = stored(rest.select(F.col("a").alias("set")).union(rest.select("b")).distinct().join(named, "set", "left_anti"), "jaccard-unknown")
    if not unknown.isEmpty():
        arrays = arrays.union(_arrays_of(texts, known, unknown))
    more = _verify(rest, arrays)
    roots = components(links.union(more))
    reps = known.join(roots.select(F.col("node").alias("set"), "root"), "set", "left").select("set", "rep", F.coalesce("root", "set").alias("root"))
    least = reps.groupBy("root").agg(F.min("rep").alias("component"))
    of_set = reps.join(least, "root").select("set", "component")
    return ids.join(of_set, "set", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(text.as_py()) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([pa.array([_set_id(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], names=["set", "hashes"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
places AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM words),
shingles AS (
  SELECT doc_id, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' || lead(word, 3) OVER p || ' ' || lead(word, 4) OVER p AS g
  FROM places WHERE n >= 5 WINDOW p AS (PARTITION BY doc_id ORDER BY k)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4),
members AS (SELECT DISTINCT doc_id, md5_number_lower(g) AS g FROM shingles WHERE g IS NOT NULL),
sizes AS (SELECT doc_id, CAST(count(g) AS BIGINT) AS n FROM documents LEFT JOIN members USING (doc_id) GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM members a JOIN members b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, n AS n_shingles, component_id FROM sizes JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""
