"""Removal of long strings that occur more than once, by sorting suffixes (deep-shallow sorting) at sampled places.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere is removed. Not all suffixes are sorted:

1. In each window of LENGTH bytes the place with the least hash of the GRAM bytes from it on is the window's anchor. Equal windows
   have their anchor at the same offset, so windows need to be compared only with windows of anchors with the same gram. An anchor
   owns a run of windows; the bytes of the run are its context.
2. Anchors are counted by gram. Where all contexts of a repeated gram are equal, all windows of its anchors repeat. Likewise for
   each context that occurs twice.
3. For the other anchors of repeated grams one context of each kind is cut from the texts. By gram, the suffixes from the anchors
   on are sorted: multikey quicksort to a shallow depth, then a blind trie for each group that is still tied. The trie gives
   common prefixes; with the order of what is before the anchors, each anchor gets the windows that it shares with any other.
   Sets of suffixes are joined from the longest common prefix down, small into large, so no pairs are listed.
4. A gram with more than WIDE kinds of contexts (the edge of a passage that very many documents share) is not sorted in one task:
   equal windows have their anchor at the same offset, so its contexts are cut to slices of SLICES[0] offsets, each with a narrower
   gram, the bytes that all windows of the slice have; slices are settled like anchors, by steps 2 and 3. What is still wide is cut
   to single windows, which are equal or not.
5. The runs of repeated windows come back to their documents, where the bytes that they cover are removed.

Grams are counted by aggregates, which sum up hot keys before the shuffle, and met again by joins of plain tables, which Spark splits
where a key is hot. No task holds more than WIDE kinds of one gram.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import chunks, documents, last_long, stored

LENGTH = 400
GRAM = 128
#: Places of a window that may be its anchor.
PLACES = LENGTH - GRAM + 1
#: Bytes after the gram that multikey quicksort looks at.
SHALLOW = 16
#: Kinds of contexts of one gram that are sorted together, at most, and the offsets of a slice of a gram with more, step by step.
WIDE, SLICES = 4096, (16, 1)
#: Bytes of one text that are looked at together, at most, and the bits of a place in them.
PIECE, PLACE_BITS = 8_000_000, 24
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base)])) for base in (_BASE, _INVERSE)]
    return _powers


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima from both sides of blocks."""
    n = len(x)
    rows = np.concatenate([x, np.full(-n % width, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of the texts ``raw[at[k]:at[k+1]]``: text, gram hash, context hash, anchor, first and last window that it owns; by pieces."""
    low = 0
    while low + LENGTH <= len(raw):
        piece = raw[low : low + PIECE]
        up, down = _power(len(piece) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(up[: len(piece)] * (piece.astype(np.uint64) + np.uint64(1)))])
        n = len(piece) - GRAM + 1
        gram = _mixed((total[GRAM:] - total[:n]) * down[:n])
        places = np.arange(n, dtype=np.uint64)
        mask = np.uint64((1 << PLACE_BITS) - 1)
        owner = (_sliding_least(gram & ~mask | places, PLACES) & mask).astype(np.int64)
        window = np.arange(len(owner))
        text = np.searchsorted(at, window + low, side="right") - 1
        whole = window + low + LENGTH <= at[text + 1]
        new = np.ones(len(owner), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new & whole)
        # the windows of a text that fit into it are its first ones, so a run of an owner ends before the next run or the last window
        last = np.minimum(np.append(np.flatnonzero(new), len(owner))[np.searchsorted(np.flatnonzero(new), first, side="right")] - 1, at[text[first] + 1] - low - LENGTH)
        a, text = owner[first], text[first]
        context = _mixed((total[last + LENGTH] - total[first]) * down[first] + _mixed(((a - first) << 32 | (last - first)).astype(np.uint64)))
        start = at[text] - low
        yield text, gram[a], context, a - start, first - start, last - start
        if low + len(piece) >= len(raw):
            break
        low += len(piece) - LENGTH + 1


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of anchors. Columns in: id, th, text."""
    for batch in batches:
        for part, raw, at in chunks(batch, 2):
            for text, gram, context, a, first, last in anchors(raw, at):
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(a.astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                    names=["id", "th", "gram", "context", "a", "first", "last"],
                )


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class _Branch:
    __slots__ = ("depth", "below")

    def __init__(self, depth: int) -> None:
        self.depth, self.below = depth, {}


def blind_trie(texts: list[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    """``members`` in the order of their texts, and the common prefix of each but the first with the one before it.

    A branch holds only its depth and, by the byte there (-1 at a text's end), what is below. A text is sent down without looking at
    what it skips; comparing it with the text where it arrives tells where it belongs. Equal texts share a leaf.
    """
    root: _Branch | list[int] = [members[0]]
    for member in members[1:]:
        text, node = texts[member], root
        while isinstance(node, _Branch):
            byte = text[node.depth] if node.depth < len(text) else -1
            node = node.below[byte] if byte in node.below else next(iter(node.below.values()))
        other = texts[node[0]]
        depth = common(text, other)
        if depth == len(text) == len(other):
            node.append(member)
            continue
        above, node = None, root
        while isinstance(node, _Branch) and node.depth < depth:
            above, node = (node, text[node.depth]), node.below[text[node.depth]]
        if not (isinstance(node, _Branch) and node.depth == depth):
            branch = _Branch(depth)
            branch.below[other[depth] if depth < len(other) else -1] = node
            if above is None:
                root = branch
            else:
                above[0].below[above[1]] = branch
            node = branch
        node.below[text[depth] if depth < len(text) else -1] = [member]
    order: list[int] = []
    prefix: list[int] = []
    stack: list[tuple[_Branch | list[int], int]] = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if isinstance(node, _Branch):
            down = [node.below[byte] for byte in sorted(node.below)]
            stack += [(x, node.depth) for x in down[:0:-1]]
            stack.append((down[0], depth))
        else:
            prefix += [depth] + [len(texts[node[0]])] * (len(node) - 1)
            order += node
    return order, prefix[1:]


def multikey_quicksort(keys: np.ndarray, small: int = 24) -> np.ndarray:
    """The order of the rows of ``keys``, column by column: rows equal to the pivot go on to the next column. Few rows are sorted at once."""
    out: list[int] = []
    stack = [(np.arange(len(keys)), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) <= small or depth == keys.shape[1]:
            own = rows.tolist()
            if depth < keys.shape[1] and len(own) > 1:
                tails = dict(zip(own, keys[rows, depth:].tolist(), strict=True))
                own.sort(key=tails.__getitem__)
            out += own
            continue
        column = keys[rows, depth]
        pivot = np.sort(column[[0, len(rows) // 2, -1]])[1]
        low, high = column < pivot, column > pivot
        stack += [(rows[high], depth), (rows[~(low | high)], depth + 1), (rows[low], depth)]
    return np.array(out, dtype=np.int64)


def deep_shallow(texts: list[bytes], groups: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """For each run of equal ``groups`` (ascending) its texts' places in order, and their common prefixes with the one before.

    Multikey quicksort takes SHALLOW bytes of all texts, eight at a time; what is tied then goes to a blind trie.
    """
    wide = np.zeros((len(texts), SHALLOW), dtype=np.uint8)
    for k, text in enumerate(texts):
        wide[k, : min(SHALLOW, len(text))] = np.frombuffer(text[:SHALLOW], dtype=np.uint8)
    words = wide.view(">u8").astype(np.uint64)
    size = np.minimum(np.array([len(x) for x in texts]), SHALLOW)
    key = np.column_stack([groups.astype(np.uint64), words, size.astype(np.uint64)])
    order = multikey_quicksort(key)
    key = key[order]
    tied = np.append(False, (key[1:] == key[:-1]).all(axis=1))
    out: list[tuple[list[int], list[int]]] = []
    cuts = np.append(np.flatnonzero(~tied), len(order)).tolist()
    group = None
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[low:high].tolist()
        own, prefix = blind_trie(texts, own) if len(own) > 1 else (own, [])
        if groups[own[0]] != group:
            group = groups[own[0]]
            out.append((own, prefix))
        else:
            held = out[-1]
            held[1].append(common(texts[held[0][-1]], texts[own[0]]))
            held[1].extend(prefix)
            held[0].extend(own)
    return out


def shared_windows(order: list[int], prefix: list[int], before: list[bytes]) -> dict[int, list[tuple[int, int]]]:
    """For each member the pairs (common bytes before the anchor, common bytes from it on) that it has with others, but for pairs that
    others of its own outdo. ``order`` and ``prefix`` are of the bytes from the anchor on; ``before`` is reversed."""
    rank = {x: k for k, x in enumerate(sorted(order, key=lambda x: before[x]))}
    by_rank = sorted(order, key=rank.__getitem__)
    set_of = list(range(len(order)))
    held: list[list[int]] = [[rank[x]] for x in order]
    out: dict[int, list[tuple[int, int]]] = {x: [] for x in order}

    def root(k: int) -> int:
        while set_of[k] != k:
            set_of[k] = set_of[set_of[k]]
            k = set_of[k]
        return k

    for k in sorted(range(len(prefix)), key=lambda k: -prefix[k]):
        small, large = root(k), root(k + 1)
        if len(held[small]) > len(held[large]):
            small, large = large, small
        ranks = held[large]
        for x in held[small]:
            at = bisect_left(ranks, x)
            for near in ranks[max(0, at - 1) : at + 1]:
                p, q = by_rank[x], by_rank[near]
                pair = (common(before[p], before[q]), prefix[k])
                out[p].append(pair)
                out[q].append(pair)
        held[large] = sorted(ranks + held[small]) if len(held[small]) > 8 else _inserted(ranks, held[small])
        held[small] = []
        set_of[small] = large
    return out


def _inserted(ranks: list[int], more: list[int]) -> list[int]:
    for x in more:
        ranks.insert(bisect_left(ranks, x), x)
    return ranks


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs of windows. Rows come by gram: gram, id, th, times, a, first, last, bytes."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        grams = np.array([x[0] for x in rows], dtype=np.int64)
        groups = np.cumsum(np.append(0, grams[1:] != grams[:-1]))
        after = [x[7][x[4] - x[5] + GRAM :] for x in rows]
        before = [x[7][: x[4] - x[5]][::-1] for x in rows]
        found = []
        for order, prefix in deep_shallow(after, groups):
            if len(order) < 2:
                continue
            for x, pairs in shared_windows(order, prefix, before).items():
                _, name, th, times, a, first, last, _ = rows[x]
                if times > 1:
                    continue
                # a window that starts d before the anchor is shared where d <= bytes before, LENGTH - d <= bytes from the anchor on
                runs = sorted((max(first, a - left), min(last, a - LENGTH + GRAM + right)) for left, right in pairs)
                joined: list[list[int]] = []
                for low, high in runs:
                    if low <= high:
                        if joined and low <= joined[-1][1] + 1:
                            joined[-1][1] = max(joined[-1][1], high)
                        else:
                            joined.append([low, high])
                found += [(name, th, low, high) for low, high in joined]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["id", "th", "first", "last"])

    held: list[tuple] = []
    for batch in batches:
        held += zip(*(column.to_pylist() for column in batch.columns), strict=True)
        if len(held) > 20_000 and held[0][0] != held[-1][0]:
            cut = next(k for k in range(len(held) - 1, 0, -1) if held[k - 1][0] != held[-1][0])
            yield done(held[:cut])
            held = held[cut:]
    if held:
        yield done(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of the wanted anchors. Columns in: id, th, text, wanted."""
    for batch in batches:
        for k in range(batch.num_rows):
            raw = (batch.column(2)[k].as_py() or "").encode()
            rows = [(x["gram"], x["times"], x["a"], x["first"], x["last"], raw[x["first"] : x["last"] + LENGTH]) for x in batch.column(3)[k].as_py()]
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], pa.int64()), pa.array([batch.column(0)[k].as_py()] * n, pa.int64()), pa.array([batch.column(1)[k].as_py()] * n, pa.int64()), pa.array([x[1] for x in rows], pa.int64()), *[pa.array([x[c] for x in rows], pa.int32()) for c in (2, 3, 4)], pa.array([x[5] for x in rows], pa.binary())],
                names=["gram", "id", "th", "times", "a", "first", "last", "bytes"],
            )


def _sliced(width: int):
    """Contexts of the wanted anchors cut to slices of ``width`` offsets, as anchors of their own: the windows of a slice start at most
    ``width`` - 1 bytes apart, and the slice's gram is a hash of the bytes that all of them have. Columns in: id, th, text, wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for k in range(batch.num_rows):
                raw = (batch.column(2)[k].as_py() or "").encode()
                grams, contexts, places = [], [], []
                for x in batch.column(3)[k].as_py():
                    a, first, last = x["a"], x["first"], x["last"]
                    for part in range((a - last) // width, (a - first) // width + 1):
                        low, high = max(first, a - part * width - width + 1), min(last, a - part * width)
                        grams.append(digest(raw[a - part * width : a - part * width - width + 1 + LENGTH] + b"%d %d" % (x["gram"], part)))
                        contexts.append(digest(raw[low : high + LENGTH] + b"%d %d" % (a - low, high - low)))
                        places.append((a, low, high))
                n = len(grams)
                hashes = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (grams, contexts)]
                numbers = np.array(places, dtype=np.int32).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(c)[k].as_py()] * n, pa.int64()) for c in (0, 1)] + hashes + [pa.array(numbers[:, c]) for c in range(3)], names=["id", "th", "gram", "context", "a", "first", "last"])

    return run


ANCHORS = "id long, th long, gram long, context long, a int, first int, last int"


def repeated(texts: DataFrame) -> DataFrame:
    """Runs of windows that also start elsewhere: ``id``, ``th``, ``first``, ``last``; ``texts`` has ``id``, ``th``, ``text``."""
    return stored(_settled(texts, stored(texts.mapInArrow(_found, ANCHORS), "suffix-found"), SLICES), "suffix-runs")


def _settled(texts: DataFrame, found: DataFrame, slices: tuple[int, ...]) -> DataFrame:
    """The repeated runs of the anchors ``found``. Tables that are met by a hot key are written first, so that Spark can split it."""
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("least"), F.max("context").alias("most")).where("n > 1")
    grams = stored(grams.select("gram", (F.col("least") < F.col("most")).alias("several")), "suffix-grams")
    again = stored(found.join(grams, "gram"), "suffix-anchors")
    whole = again.where("not several").select("id", "th", "first", "last")
    several = again.where("several")
    kinds = several.groupBy("gram", "context").agg(F.count("*").alias("times"), F.min(F.struct("id", "th", "a", "first", "last")).alias("x"))
    kinds = stored(kinds.select("gram", "context", "times", "x.*"), "suffix-kinds")
    twice = stored(kinds.where("times > 1").select("gram", "context"), "suffix-twice")
    out = whole.union(several.join(twice, ["gram", "context"], "left_semi").select("id", "th", "first", "last"))
    if not slices:
        return out  # grams of single windows are the windows themselves
    wide = stored(kinds.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > WIDE).select("gram"), "suffix-wide")
    if not wide.isEmpty():
        cut = _with_text(texts, kinds.join(wide, "gram", "left_semi")).mapInArrow(_sliced(slices[0]), ANCHORS)
        out = out.union(_settled(texts, stored(cut, "suffix-slices"), slices[1:]))
        kinds = kinds.join(wide, "gram", "left_anti")
    contexts = _with_text(texts, kinds).mapInArrow(_cut, "gram long, id long, th long, times long, a int, first int, last int, bytes binary")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.union(contexts.repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(_sorted, "id long, th long, first int, last int"))


def _with_text(texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """The texts that hold the chosen context of a kind, with these as ``wanted``."""
    wanted = kinds.groupBy(F.col("id").alias("wid"), F.col("th").alias("wth")).agg(F.collect_list(F.struct("gram", "times", "a", "first", "last")).alias("wanted"))
    return texts.join(wanted.hint("shuffle_hash"), (F.col("id") == F.col("wid")) & (F.col("th") == F.col("wth"))).select("id", "th", "text", "wanted")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (long) and ``kept`` (binary, what remains).

    A byte goes where a string of LENGTH bytes that covers it also starts at another place of any text, also overlapping and in the
    same text; rows with the same id or text are texts of their own. Ties are none: of equal strings all go, the first one too. A null
    text is empty; texts shorter than LENGTH are kept whole; a very long one is looked at in overlapping pieces. A null id is returned
    as it is. Other columns, however they are named, are ignored. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), last_long("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("th", F.xxhash64("id", "text"))
    runs = repeated(texts.where(F.octet_length("text") >= LENGTH).select("id", "th", "text"))
    runs = runs.groupBy(F.col("id").alias("rid"), F.col("th").alias("rth")).agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    joined = texts.join(runs.hint("shuffle_hash"), (F.col("id") == F.col("rid")) & (F.col("th") == F.col("rth")), "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                rows = []
                for text, own in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                    raw = text.encode()
                    spans: list[list[int]] = []
                    for low, high in sorted((x["first"], x["last"] + LENGTH) for x in own.as_py() or ()):
                        if spans and low <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], high)
                        else:
                            spans.append([low, high])
                    edges = [0, *(x for span in spans for x in span), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((len(raw), len(raw) - len(kept), len(spans), kept))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([x[k] for x in rows], pa.int64()) for k in range(3)], pa.array([x[3] for x in rows], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
