"""Near-duplicate texts as multisets of words: weighted minwise signatures, bands, exact overlap.

Every unit of weight of a word drives its own Poisson process of points, each
point falling on one place of the signature; a place keeps its earliest point.
Two texts then agree in a place with the probability of their weighted Jaccard
similarity, and a process need not be followed beyond the latest kept point.
"""

from __future__ import annotations

import gc
import time as clock
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainsieve.llm.components import connected_components
from chainsieve.session import checkpoint_dir

#: Passes, each with signatures of its own, so that only the entries of one pass lie on
#: disk at a time; bands of a pass and places of a band.  A pair that agrees to three
#: quarters has weighted Jaccard 0.6 at least, one that agrees to nine tenths 0.81.
PASSES, BANDS, ROWS = 2, 36, 5
#: Places of which an entry carries one bit each, and how many of them must be equal.  Of
#: two texts of similarity 0.6 in the mean 102 are, of two of similarity 0.2 in the mean 77.
CARRIED, CARRIED_ALIKE = 128, 94
#: Places of a text's sketch, one byte each, and the share that must be equal.
SKETCH, ALIKE = 64, 0.45
#: Share of equal places from which a row of a batch may stand for another one in a bucket:
#: what is like the one is then like the other.
SAME = 0.9
#: Lengths share a cell of a band up to this ratio; where its edges lie differs from band to band.
CELL = 2.0
#: Bytes of source that one task of the bucket stage is given the entries of.
PART_BYTES = 4 << 20
#: Texts whose words agree to this share are near-duplicates: cases agree to 0.75 and
#: more, all other pairs to less than 0.70.
AGREE = 0.725
#: Members of one block of a group.
BLOCK = 256

_G1, _G2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bags(texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Row and element of every unit of weight: the n-th copy of a word is an element of its own.

    Words are cut and numbered by column functions, so no word but a distinct one is
    touched by itself.
    """
    column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
    plain = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(column), r"[^\p{L}\p{N}]+", " "), " ")
    # Rows without words are null here and so have no parts.
    lists = pc.split_pattern(pc.if_else(pc.equal(plain, ""), None, plain), " ")
    rows = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(lists.flatten())
    unit = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    both = (np.repeat(np.arange(len(column), dtype=np.int64), rows) << 32) | unit
    both.sort()
    row, unit = both >> 32, both & 0xFFFFFFFF
    start = np.ones(len(both), bool)
    start[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(start)
    copy = np.arange(len(both)) - np.repeat(at, np.diff(np.append(at, len(both))))
    return row, _mix(hashes[unit] + copy.astype(np.uint64) * _G1) if len(both) else np.zeros(0, np.uint64)


def signatures(row: np.ndarray, element: np.ndarray, rows: int, size: int) -> np.ndarray:
    """The earliest point of each of ``size`` places for every row; infinite for rows without words."""
    kept = np.full(rows * size, np.inf)
    process, which = np.unique(element, return_inverse=True)
    time = np.zeros(len(process))
    step = 0
    base, owner, limit = row * size, row, None
    while len(which):
        for _ in range(min(32, max(1, 100_000 // len(which)))):
            step += 1
            drawn = _mix(process + np.uint64(step * int(_G1) & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((drawn >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52)
            place = (((_mix(drawn) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
            at = time[which]
            if limit is None:
                np.minimum.at(kept, base + place[which], at)
            else:
                near = np.flatnonzero(at < limit)
                np.minimum.at(kept, base[near] + place[which[near]], at[near])
        latest = kept.reshape(rows, size).max(axis=1)
        if limit is None and np.isinf(latest).all():
            continue
        limit = latest[owner]
        live = np.flatnonzero(at < limit)
        which, base, owner, limit = which[live], base[live], owner[live], limit[live]
        used = np.zeros(len(process), bool)
        used[which] = True
        if used.sum() * 2 < len(used):  # follow only the processes still needed
            which = (np.cumsum(used) - 1)[which]
            process, time = process[used], time[used]
    return kept.reshape(rows, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per row and band."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64) * _G1), (len(signature), bands)).copy()
    for k in range(rows):
        key = _mix(key * _G2 + bits[:, :, k])
    return key


def _distinct(a: np.ndarray, b: np.ndarray, inverse: bool = False):
    """The distinct pairs of two columns, as two rows, and where each pair went."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    pairs = np.stack([a[first], b[first]])
    if not inverse:
        return pairs
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(first) - 1
    return pairs, back


#: One entry of a bucket: what is left of its key, the text's node, and the carried bits.
ENTRY = np.dtype([("key", "<u4"), ("node", "<i8"), ("bits", "<u8", (CARRIED // 64,))])
#: One near-certain link, and one sketch.
TIE = np.dtype([("a", "<i8"), ("b", "<i8")])
DRAWN = np.dtype([("node", "<i8"), ("sketch", "u1", (SKETCH,))])


def bits_of(signature: np.ndarray) -> np.ndarray:
    """One bit of each of the first ``CARRIED`` places, in 64-bit numbers."""
    low = (_mix(signature[:, :CARRIED].view(np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(low, axis=1).view("<u8")


def length_cells(lengths: np.ndarray, bands: int) -> np.ndarray:
    """Row and band -> cell of the row's length; the edges of the cells are drawn for every band."""
    edge = (_mix(np.arange(1, bands + 1, dtype=np.uint64) * _G2) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return np.floor((np.log(np.maximum(lengths, 1)) / np.log(CELL))[:, None] + edge).astype(np.uint64)


def _entries(parts: int, bands: int, rows: int, turn: int, collapse: bool, batch_rows: int = 10_000):
    """Batches of (node, text) -> rows (part, kind, blob): entries, links and sketches, packed.

    A text has one entry per band, all entries of a bucket go to one part.  Of the rows
    of a batch that share a bucket and are almost the same only the first goes on
    under it (``collapse``); the others are linked to that one here.  So a bucket that
    holds a large part of all rows reaches no task as more than a few entries per batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                part = whole.slice(at, batch_rows)
                node = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                row, element = bags(part.column(1))
                lengths = np.bincount(row, minlength=len(node))
                full = lengths > 0
                place = np.cumsum(full) - 1
                node, lengths, n = node[full], lengths[full], int(full.sum())
                if not n:
                    continue
                own = _mix(element + np.uint64(turn * int(_G2) & 0xFFFFFFFFFFFFFFFF)) if turn else element
                signature = signatures(place[row], own, n, max(bands * rows, CARRIED, SKETCH))
                keys = band_keys(signature[:, : bands * rows].copy(), bands, rows)
                keys = _mix(keys + length_cells(lengths, bands) * _G1).reshape(-1)
                mine = np.repeat(np.arange(n), bands)
                goes_on, ties = np.ones(len(keys), bool), np.zeros((2, 0), np.int64)
                if collapse:
                    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
                    lead = mine[first][back]
                    behind = np.flatnonzero(lead != mine)
                    pair, of = _distinct(mine[behind], lead[behind], inverse=True)
                    alike = np.zeros(pair.shape[1], bool)
                    for lo in range(0, pair.shape[1], 20_000):
                        a, b = pair[:, lo : lo + 20_000]
                        alike[lo : lo + 20_000] = (signature[a] == signature[b]).mean(axis=1) >= SAME
                    goes_on[behind[alike[of]]] = False
                    ties = node[pair[:, alike]]
                entry = np.zeros(int(goes_on.sum()), ENTRY)
                entry["key"] = keys[goes_on] & np.uint64(0xFFFFFFFF)
                entry["node"] = node[mine[goes_on]]
                entry["bits"] = bits_of(signature)[mine[goes_on]]
                where = ((keys[goes_on] >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(where, kind="stable")
                entry, where = entry[order], where[order]
                edges = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(where)]])
                out = [(where[lo], 0, entry[lo:hi].tobytes()) for lo, hi in zip(edges[:-1], edges[1:]) if hi > lo]
                home = int(_mix(node[:1].astype(np.uint64))[0] % np.uint64(parts))
                if ties.shape[1]:
                    tie = np.zeros(ties.shape[1], TIE)
                    tie["a"], tie["b"] = ties
                    out.append((home, 1, tie.tobytes()))
                if not turn:
                    drawn = np.zeros(n, DRAWN)
                    drawn["node"] = node
                    drawn["sketch"] = (_mix(signature[:, :SKETCH].view(np.uint64)) & np.uint64(255)).astype(np.uint8)
                    out.append((home, 2, drawn.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int8(), pa.binary()))],
                    names=["part", "kind", "blob"],
                )

    return run


def _links(cross: bool):
    """All blobs of a part -> candidate links ``a > b``; sketches pass through as ``a`` with their bytes.

    Every entry is compared with all others of its bucket, ``cross``: with those of the
    other side, which the lowest bit of a node tells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, found = [], [np.zeros((2, 0), np.int64)]
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2)):
                data = blob.as_buffer()
                if kind == 0:
                    entries.append(np.frombuffer(data, ENTRY))
                elif kind == 1:
                    tie = np.frombuffer(data, TIE)
                    found.append(np.stack([tie["a"], tie["b"]]))
                else:
                    drawn = np.frombuffer(data, DRAWN)
                    flat = pa.array([x.tobytes() for x in drawn["sketch"]], pa.binary())
                    yield _link_batch(drawn["node"].copy(), None, flat)
        if entries:
            entry = np.concatenate(entries)
            entries.clear()
            order = np.argsort(entry["key"], kind="stable")
            key = entry["key"][order]
            start = np.ones(len(key), bool)
            start[1:] = key[1:] != key[:-1]
            shared = ~(start & np.append(start[1:], True))
            order, start = order[shared], start[shared]
            if len(order):
                node, bits = entry["node"][order], np.ascontiguousarray(entry["bits"][order].T)
                head = np.flatnonzero(start)[np.cumsum(start) - 1]
                place = np.arange(len(order)) - head
                at = np.flatnonzero(place)
                for back in range(1, int(place.max()) + 1):
                    at = at[place[at] >= back]
                    for lo in range(0, len(at), 100_000):
                        one = at[lo : lo + 100_000]
                        other = one - back
                        differ = sum(np.bitwise_count(word[one] ^ word[other]).astype(np.int16) for word in bits)
                        near = np.flatnonzero(differ <= CARRIED - CARRIED_ALIKE)
                        a, b = node[one[near]], node[other[near]]
                        ok = ((a ^ b) & 1 == 1) if cross else a != b
                        found.append(np.stack([a[ok], b[ok]]))
        a, b = np.concatenate(found, axis=1)
        pair = _distinct(np.maximum(a, b), np.minimum(a, b))
        yield _link_batch(pair[0], pair[1], None)

    return run


def _link_batch(a: np.ndarray, b: np.ndarray | None, sketch: pa.Array | None) -> pa.RecordBatch:
    b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)
    sketch = pa.nulls(len(a), pa.binary()) if sketch is None else sketch
    return pa.RecordBatch.from_arrays([pa.array(a), b, sketch], names=["a", "b", "sketch"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sketch of a, sketch of b) -> the links whose sketches agree."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH) for k in (2, 3))
        ok = pa.array((x == y).mean(axis=1) >= ALIKE)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])


def _parts(df: DataFrame) -> int:
    """Tasks of the bucket stage: as many as the size of the source asks for, where it is known."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-size // PART_BYTES)) if size < 1 << 50 else least


def _free(df: DataFrame) -> None:
    """Lets the driver drop the shuffle files of a pass before the next one writes its own."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    clock.sleep(0.3)


def candidate_links(
    df: DataFrame, node: str, text: str, bands: int = BANDS, rows: int = ROWS, cross: bool = False
) -> DataFrame:
    """Distinct links ``a > b`` between 64-bit ``node`` numbers whose texts share a bucket and whose sketches agree.

    Within a bucket every entry is compared with every other.  Texts that share a
    bucket by chance pass neither the carried bits nor the sketch, so groups do not
    grow together as the collection grows.  ``cross``: only links between even and
    odd nodes.  Null, empty and wordless texts have no links.
    """
    checkpoint_dir(df.sparkSession)
    source = df.select(node, text)
    parts = _parts(source)
    turns = []
    for turn in range(PASSES):
        packed = source.mapInArrow(_entries(parts, bands, rows, turn, not cross), "part int, kind tinyint, blob binary")
        placed = packed.repartitionById(parts, F.col("part"))
        turns.append(placed.mapInArrow(_links(cross), "a bigint, b bigint, sketch binary").checkpoint())
        del packed, placed
        _free(df)
    found = reduce(DataFrame.unionByName, turns)
    links = found.where("b is not null").select("a", "b").distinct()
    sketch = found.where("b is null").groupBy("a").agg(F.first("sketch").alias("sketch"))
    both = links.join(sketch.withColumnRenamed("sketch", "sa"), "a").join(
        sketch.select(F.col("a").alias("b"), F.col("sketch").alias("sb")), "b"
    )
    return both.select("a", "b", "sa", "sb").mapInArrow(_alike, "a bigint, b bigint")


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns and a text at last -> the same columns and the text's elements as sorted 64-bit numbers."""
    for batch in batches:
        row, element = bags(batch.column(batch.num_columns - 1))
        number = element.view(np.int64)
        order = np.lexsort((number, row))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(number[order]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "bag"])


def agreeing(bag: list[np.ndarray], side: np.ndarray, agree: float) -> Iterator[tuple[int, int]]:
    """Positions ``i < j`` whose bags have ``agree`` of the longer one in common.

    Where both sides 0 and 1 occur only pairs across them are given.
    """
    n = len(bag)
    size = np.array([len(b) for b in bag], np.int64)
    _, code = np.unique(np.concatenate(bag) if n else np.zeros(0), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    shared = np.zeros((n, n), np.float32)
    width = 4096
    for lo in range(0, int(code.max(initial=-1)) + 1, width):
        pick = (code >= lo) & (code < lo + width)
        dense = np.zeros((n, width), np.float32)
        np.add.at(dense, (owner[pick], code[pick] - lo), 1)
        shared += dense @ dense.T
    longer = np.maximum(size[:, None], size[None, :])
    hit = shared >= agree * longer
    hit &= (size > 0)[:, None] & np.triu(np.ones((n, n), bool), 1)
    if side.any() and not side.all():
        hit &= side[:, None] != side[None, :]
    yield from zip(*(x.tolist() for x in np.nonzero(hit)))


def _compared(agree: float, pairs: bool):
    """Rows sorted by group, pair of blocks and id -> agreeing pairs of ids, or what classes need of them.

    ``pairs``: every pair (``id``, ``other``).  Else one row for every link of a spanning
    forest, and one with a null ``other`` and the number ``n`` of its partners for every id
    that has any: no more rows than come in.
    """

    def flush(rows: list[tuple[str, np.ndarray, int]]) -> list[tuple[str, str | None, int]]:
        if len(rows) < 2:
            return []
        side = np.array([s for _, _, s in rows])
        found = {
            (min(a, b), max(a, b))
            for i, j in agreeing([b for _, b, _ in rows], side, agree)
            if (a := rows[i][0]) != (b := rows[j][0])
        }
        if pairs:
            return [(a, b, 1) for a, b in sorted(found)]
        partners: Counter = Counter(x for pair in found for x in pair)
        root = {x: x for x in partners}

        def top(x: str) -> str:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out: list[tuple[str, str | None, int]] = [(x, None, n) for x, n in partners.items()]
        for a, b in found:
            if (x := top(a)) != (y := top(b)):
                root[max(x, y)] = min(x, y)
                out.append((a, b, 0))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            out: list[tuple] = []
            lists = batch.column(5)
            flat = lists.values.to_numpy(zero_copy_only=False)
            offsets = lists.offsets.to_numpy()
            heads = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            for k, (head, name, block) in enumerate(
                zip(heads, batch.column(4).to_pylist(), batch.column(3).to_pylist())
            ):
                if head != group:
                    out += flush(rows)
                    group, rows = head, []
                bag = flat[offsets[k] : offsets[k + 1]].copy()
                if rows and rows[-1][0] == name and np.array_equal(rows[-1][1], bag):
                    continue
                rows.append((name, bag, int(block != head[1])))
            if out:
                yield _pair_batch(out)
        if rows:
            yield _pair_batch(flush(rows))

    return run


def _pair_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64())
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["id", "other", "n"])


def _linked_bags(rows: DataFrame, node: str, text: str, links: DataFrame, agree: float) -> tuple[DataFrame, DataFrame]:
    """The elements of every text that has a link, and the links whose texts agree.

    Texts are cut again only where a candidate link needs them; both results are read
    several times and are therefore cut from their past.
    """
    links = links.checkpoint()
    _free(rows)
    ends = links.select(F.col("a").alias("end")).unionByName(links.select(F.col("b").alias("end"))).distinct()
    needed = rows.join(ends, F.col(node) == F.col("end"), "left_semi")
    names = [c for c in rows.columns if c != text]
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "bag array<bigint>"])
    bag = needed.select(*names, text).mapInArrow(_elements, schema).checkpoint()
    # Half of every number is enough here: what chance lets through, the exact comparison stops.
    short = bag.select(F.col(node).alias("end"), F.transform("bag", lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int")).alias("short"))
    both = links.join(short.select(F.col("end").alias("a"), F.col("short").alias("x")), "a").join(
        short.select(F.col("end").alias("b"), F.col("short").alias("y")), "b"
    )
    shared = F.size(F.array_intersect("x", "y")) >= F.lit(agree) * F.greatest(F.size("x"), F.size("y"))
    return bag, both.where(shared).select("a", "b")


def _within_groups(df: DataFrame, key: str, text: str, agree: float, pairs: bool) -> DataFrame:
    """Every two texts of a group compared exactly, in blocks: rows of ``_compared``.

    A group is what hangs together by links that agree, so texts that are alike by
    chance never make groups grow together.
    """
    source = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull())
    source = source.select("id", F.xxhash64("id").alias("node"), "text")
    bag, links = _linked_bags(source, "node", "text", candidate_links(source, "node", "text"), agree)
    members = connected_components(df.sparkSession, links.distinct())
    found = bag.join(members, "node").select("grp", "id", "bag")
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * BLOCK)
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    placed = found.join(sizes, "grp", "left").withColumn("blocks", blocks)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    copies = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "grp",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "block",
        "id",
        "bag",
    )
    ordered = copies.repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high", "id")
    return ordered.mapInArrow(_compared(agree, pairs), "id string, other string, n bigint")


def near_duplicate_pairs(df: DataFrame, key: str, text: str, agree: float = AGREE) -> DataFrame:
    """``id_a < id_b``: different keys whose texts have ``agree`` of the longer one's words in common.

    The order of the words is ignored.  Signatures only gather the texts into
    groups; every pair within a group is then counted exactly, in blocks, so no
    link between texts of one group is lost.  Null, empty and wordless texts are
    in no pair; repeated rows count once; exact copies are pairs like others.
    Keys compare by code points; null keys take no part.
    """
    found = _within_groups(df, key, text, agree, True)
    return found.select(F.col("id").alias("id_a"), F.col("other").alias("id_b"))


def near_duplicate_classes(df: DataFrame, key: str, text: str, agree: float = AGREE) -> DataFrame:
    """``key``, ``class_id`` and ``n_links`` of every row's key: one row per key.

    ``class_id`` is the least key among those reached through near-duplicate pairs,
    the key itself where there are none; ``n_links`` is the number of its own pairs.
    Pairs are counted where they are compared and never written out: a block gives
    a spanning forest of its links and a count per key.
    """
    checkpoint_dir(df.sparkSession)
    found = _within_groups(df, key, text, agree, False).checkpoint()
    numbered = found.where("other is not null").select(F.xxhash64("id").alias("x"), F.xxhash64("other").alias("y"))
    links = numbered.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    classes = connected_components(df.sparkSession, links)
    linked = found.where("other is null").groupBy("id").agg(F.sum("n").alias("n")).withColumn("node", F.xxhash64("id"))
    named = linked.join(classes, "node")
    least = named.groupBy("grp").agg(F.min("id").alias("class_id"))
    found = named.join(least, "grp").select(F.col("id").alias("_id"), "class_id", "n")
    every = df.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct()
    return every.join(found, F.col(key) == F.col("_id"), "left").select(
        key, F.coalesce("class_id", key).alias("class_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links")
    )


def pairs_across(rows: DataFrame, node: str, text: str, agree: float = AGREE) -> DataFrame:
    """``even`` and ``odd``: nodes of two sides whose texts agree; the lowest bit of a node tells its side.

    Only entries of different sides are ever compared, and every pair found is
    counted exactly.  Nodes must be unique; null and wordless texts match nothing.
    """
    rows = rows.select(node, text)
    bag, links = _linked_bags(rows, node, text, candidate_links(rows, node, text, cross=True), agree)
    both = links.join(bag.select(F.col(node).alias("a"), F.col("bag").alias("x")), "a").join(
        bag.select(F.col(node).alias("b"), F.col("bag").alias("y")), "b"
    )
    exact = F.size(F.array_intersect("x", "y")) >= F.lit(agree) * F.greatest(F.size("x"), F.size("y"))
    is_even = F.col("a").bitwiseAND(1) == 0
    return both.where(exact).select(
        F.when(is_even, F.col("a")).otherwise(F.col("b")).alias("even"),
        F.when(is_even, F.col("b")).otherwise(F.col("a")).alias("odd"),
    )
