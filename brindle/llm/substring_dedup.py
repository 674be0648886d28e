"""Operator 5: near-duplicate passages by compact windows over min-hashes of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .near_dedup import _bitmap, _text_key
from .runtime import partitions, stored
from .words import Hasher, mix, slices, texts, windows

#: Words of a shingle, least words of a passage, hash functions, and how many must meet.
WIDTH, PASSAGE, HASHES, ENOUGH = 5, 50, 4, 2
SPAN = PASSAGE - WIDTH + 1
#: Functions whose lists are compared: of any two that meet one is among them.
LISTED = HASHES - ENOUGH + 1
#: Words that a passage may have before its anchor, and words of an anchor's context.
REACH = SPAN - 1
CONTEXT = REACH + PASSAGE
#: Least similarity of 80%: a common shingle outweighs a quarter of one that only one side has.
MISS = 4
#: Common shingles of ``SPAN`` that make a pair of contexts a candidate, and how far a passage may drift by inserted or deleted words.
ALIKE, DRIFT, JUMP = 36, 2, 5
#: Groups of context words that a seed may leave out, words of a block of a group, words of a band beside the anchor.
GROUPS, BLOCK, BAND = 4, 3, 15
#: Anchors compared at a time; lists with more are dealt out by seed. Pairs of contexts looked at in one go.
BATCH, LIST, AT_ONCE = 1 << 14, 1 << 15, 1 << 13

_HASH = Hasher()
_ODD = np.random.default_rng(65537).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(271828).integers(1, 1 << 63, CONTEXT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _least(values: np.ndarray, borders: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values with their places as low bits, text of each place, places that are the least of some ``span`` in a row)."""
    n = len(values)
    owner = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    if n < span:
        return values, owner, np.zeros(0, np.int64)
    places = np.uint64((1 << max(24, n.bit_length())) - 1)
    packed = (values & ~places) | np.arange(n, dtype=np.uint64)
    least, width = packed, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: n - span + 1], least[span - width : n - width + 1])
    at = (least[owner[: n - span + 1] == owner[span - 1 :]] & places).astype(np.int64)
    return packed, owner, at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def compact_windows(values: np.ndarray, borders: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r): every subsequence of text i that holds c within [l, r] has its minimum at c.

    ``values`` are the min-hash values of all texts' shingles, text i's from borders[i] to
    borders[i + 1] - 1. Only windows of at least ``span`` positions are made: their centres
    are the places that are the least of some ``span`` in a row, and l and r follow from
    the Cartesian tree over those centres (the nearest smaller place on either side of a
    centre is a centre itself). Equal values: the first is the smaller.
    """
    packed, owner, centres = _least(values, borders, span)
    left, right = borders[owner[centres]].tolist(), (borders[owner[centres] + 1] - 1).tolist()
    stack: list[int] = []  # the rightmost path of the tree
    keys, places, texts_ = packed[centres].tolist(), centres.tolist(), owner[centres].tolist()
    for i, (v, p, t) in enumerate(zip(keys, places, texts_, strict=True)):
        while stack and (texts_[stack[-1]] != t or keys[stack[-1]] > v):
            top = stack.pop()
            if texts_[top] == t:
                right[top] = p - 1
        if stack:
            left[i] = places[stack[-1]] + 1
        stack.append(i)
    return np.array(left, np.int64), centres, np.array(right, np.int64)


def _list_key(values: np.ndarray, f: int) -> np.ndarray:
    """The posting list of a function's minimal shingle; the lowest bit is free for a mark."""
    return (mix(values + np.uint64(f)) & ~np.uint64(1)).view(np.int64)


_POST = "key long, text_key long, times long"


def _posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The posting lists that the windows of each (text_key, text) belong to; windows that follow with the same list are one row."""
    for batch in batches:
        names = batch.column(0).to_numpy()
        data, offsets = texts(batch.column(1))
        for lo, hi in slices(offsets):
            hashes, _, words = _HASH.rows(data, offsets[lo : hi + 1])
            shingles, borders = windows(hashes, words, WIDTH)
            made = []
            for f in range(HASHES):
                values = mix(shingles * _ODD[f])
                _, owner, c = _least(values, borders, SPAN)
                key, of = _list_key(values[c], f), owner[c]
                first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])) if len(c) else c
                made.append((key[first], names[lo:hi][of[first]], np.diff(np.append(first, len(key)))))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*made, strict=True)], names=["key", "text_key", "times"])


_ENTRY = "key long, text_key long, c int, context binary"


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def _matrix(column: pa.Array) -> np.ndarray:
    data, offsets = texts(column)
    return data[offsets[0] : offsets[-1]].view(np.uint16).reshape(len(column), CONTEXT) if len(column) else np.zeros((0, CONTEXT), np.uint16)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text_key, keys, text): the anchors of shared windows that meet one of another function, with their contexts.

    The interval join: a window holds the passages that start in an interval; where such
    intervals of ``ENOUGH`` functions overlap, the passages share so many minimal shingles
    with others. The context has the words of these passages as 16-bit hashes around the
    anchor, 0 beyond them.
    """
    for batch in batches:
        names = batch.column(0).to_numpy()
        sizes = np.diff(batch.column(1).offsets.to_numpy())
        flat, begins = batch.column(1).flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
        data, offsets = texts(batch.column(2))
        for lo, hi in slices(offsets):
            yield from _met_in(names[lo:hi], flat[begins[lo] : begins[hi]], sizes[lo:hi], data, offsets[lo : hi + 1])


def _met_in(names: np.ndarray, flat: np.ndarray, sizes: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    hashes, _, words = _HASH.rows(data, offsets)
    shingles, borders = windows(hashes, words, WIDTH)
    short = np.maximum(hashes >> np.uint64(48), np.uint64(1)).astype(np.uint16)
    salt = mix(np.arange(1, len(names) + 1, dtype=np.uint64))
    wanted = mix((flat.view(np.uint64) & ~np.uint64(1)) ^ np.repeat(salt, sizes))
    order = np.argsort(wanted)
    wanted, flat = wanted[order], flat[order]
    if not len(wanted):
        return
    starts, shared = np.zeros(len(shingles) + 1, np.int32), []
    for f in range(HASHES):
        values = mix(shingles * _ODD[f])
        left, c, right = compact_windows(values, borders)
        of = np.searchsorted(borders, c, "right") - 1
        probe = mix(_list_key(values[c], f).view(np.uint64) ^ salt[of])
        at = np.minimum(np.searchsorted(wanted, probe), len(wanted) - 1)
        hit = wanted[at] == probe
        low, high = np.maximum(left, c - REACH)[hit], np.minimum(c, right - REACH)[hit]
        starts[low] += 1
        starts[high + 1] -= 1
        if f < LISTED:
            shared.append((flat[at[hit]], of[hit], c[hit], low, high))
    enough = np.flatnonzero(np.cumsum(starts[:-1]) >= ENOUGH)
    key, of, c, low, high = (np.concatenate(v) for v in zip(*shared, strict=True))
    first, last = np.searchsorted(enough, low), np.searchsorted(enough, high, "right") - 1
    keep = np.flatnonzero(first <= last)
    for k in range(0, len(keep), AT_ONCE):
        some = keep[k : k + AT_ONCE]
        base = (words[:-1] - borders[:-1])[of[some]]
        index = (c[some] + base)[:, None] + np.arange(-REACH, PASSAGE)
        inside = (index >= (enough[first[some]] + base)[:, None]) & (index < (enough[last[some]] + base + PASSAGE)[:, None])
        context = np.where(inside, short[np.clip(index, 0, len(short) - 1)], np.uint16(0))
        yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(names[of[some]]), pa.array((c[some] - borders[of[some]]).astype(np.int32)), _binary(context)], names=["key", "text_key", "c", "context"])


def seeds(context: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(name, rows, value) of ways to split a list: contexts with one name and value have the same words at chosen places.

    For each of the ``SPAN`` passages around the anchor: all of its words, and its words
    without one group of blocks, so that a changed word is passed over by one of them. Then
    the words beside the anchor on either side, for passages with an inserted word, and the
    list as a whole.
    """
    words = mix(context.T.astype(np.uint64)) * _PLACES[:, None]
    zero = np.zeros((1, len(context)), np.uint64)
    gaps = np.concatenate([zero, np.cumsum(context.T == 0, axis=0, dtype=np.uint64)])
    group = np.arange(CONTEXT) // BLOCK % GROUPS
    parts = [np.concatenate([zero, np.cumsum(np.where((group == g)[:, None], words, np.uint64(0)), axis=0)]) for g in range(GROUPS)]
    ways = [(o, o + PASSAGE, range(GROUPS)) for o in range(SPAN)] + [(REACH - BAND, REACH, ()), (REACH + WIDTH, REACH + WIDTH + BAND, ())]
    for i, (a, b, left_out) in enumerate(ways):
        rows = np.flatnonzero(gaps[a] == gaps[b])
        if len(rows):
            sums = [p[b, rows] - p[a, rows] for p in parts]
            whole = sum(sums[1:], sums[0])
            yield i * (GROUPS + 1), rows, whole
            for g in left_out:
                yield i * (GROUPS + 1) + 1 + g, rows, whole - sums[g]
    yield len(ways) * (GROUPS + 1), np.arange(len(context)), np.zeros(len(context), np.uint64)


def star(bucket: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, its partner) that tie all rows of a bucket: each to the bucket's first text, those of that text to the last.

    Rows are in order of their text. The k-th row of a text in a bucket is tied to the k-th
    of the other text, beginning anew if that has fewer. A bucket with one text has no pairs.
    """
    order = np.argsort(bucket, kind="stable")
    b, t = bucket[order], text[order]
    new = np.concatenate([[True], b[1:] != b[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(b)) - 1
    two = np.flatnonzero(np.repeat(t[first] != t[last], last - first + 1))
    if not len(two):
        return two, two
    run = np.concatenate([[True], new[1:] | (t[1:] != t[:-1])])
    begin = np.flatnonzero(run)
    length, which = np.diff(np.append(begin, len(b))), np.cumsum(run) - 1
    group = (np.cumsum(new) - 1)[two]
    rank = two - begin[which[two]]
    to = np.where(t[two] == t[first[group]], which[last[group]], which[first[group]])
    return order[two], order[begin[to] + rank % length[to]]


def stretches(p: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, drift, begin, end): runs of common shingles of pairs of contexts that may be near copies.

    Places are in the context of x, the same shingle stands ``drift`` words later in p. A
    pair passes if it has ``SPAN`` common shingles running, or if ``ALIKE`` of ``SPAN`` are
    common when words may drift by up to ``DRIFT``.
    """
    n = CONTEXT - WIDTH + 1

    def common(rows: np.ndarray, drift: int) -> np.ndarray:
        same = np.zeros((len(rows), CONTEXT), bool)
        a, b = max(0, -drift), min(CONTEXT, CONTEXT - drift)
        same[:, a:b] = (p[rows, a + drift : b + drift] == x[rows, a:b]) & (x[rows, a:b] != 0)
        out = same[:, :n].copy()
        for k in range(1, WIDTH):
            out &= same[:, k : k + n]
        return out

    def passes(grid: np.ndarray, least: int) -> np.ndarray:
        sums = np.zeros((len(grid), n + 1), np.int16)
        np.cumsum(grid, axis=1, out=sums[:, 1:])
        return (sums[:, SPAN:] - sums[:, :-SPAN]).max(1) >= least

    rows = np.arange(len(p))
    grid = common(rows, 0)
    good = passes(grid, SPAN)
    grids = [(rows[good], 0, grid[good])]
    if not good.all():
        rest = rows[~good]
        drifted = [(d, grid[~good] if d == 0 else common(rest, d)) for d in range(-DRIFT, DRIFT + 1)]
        good = passes(np.logical_or.reduce([g for _, g in drifted]), ALIKE)
        grids += [(rest[good], d, g[good]) for d, g in drifted]
    out = []
    for rows, drift, grid in grids:
        edge = np.diff(np.pad(grid.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        at, begin = np.nonzero(edge == 1)
        out.append((rows[at], np.full(len(at), drift), begin, np.nonzero(edge == -1)[1]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


_STRETCH = "p long, x long, shift int, low int, high int"
#: Stretches, or with a key the entries of long lists: text, place and context.
_MET = _STRETCH + ", key long, context binary"


def _stretch_rows(p: np.ndarray, x: np.ndarray, p_c: np.ndarray, x_c: np.ndarray, p_context: np.ndarray, x_context: np.ndarray) -> pa.RecordBatch:
    pair, drift, begin, end = stretches(p_context, x_context)
    low = x_c[pair].astype(np.int64) - REACH + begin
    shift = p_c[pair].astype(np.int64) + drift - x_c[pair]
    return pa.RecordBatch.from_arrays([pa.array(p[pair]), pa.array(x[pair]), *(pa.array(v.astype(np.int32)) for v in (shift, low, low + end - begin))], names=["p", "x", "shift", "low", "high"])


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: int, least: int = 1) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many, if there are, that end where a group of equal first columns ends."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        if sum(b.num_rows for b in rest) < least:
            continue
        same = np.ones(batch.num_rows, bool)
        for k in range(columns):
            values = batch.column(k).to_numpy()
            same &= values == values[-1]
        cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            rest[-1] = batch.slice(0, cut)
            yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            rest = [batch.slice(cut)] if cut < batch.num_rows else []
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From entries in order of (key, text_key, c): stretches of the pairs that tie the parts of each list; those of marked lists as they are."""
    names = ["p", "x", "shift", "low", "high", "key", "context"]
    for batch in _whole_groups(batches, 1, BATCH):
        long = pa.array((batch.column(0).to_numpy() & 1).astype(bool))
        if long.true_count:
            some = batch.filter(long)
            nothing = [pa.nulls(some.num_rows, t) for t in (pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([some.column(1), nothing[0], some.column(2), *nothing[1:], some.column(0), some.column(3)], names=names)
            batch = batch.filter(pc.invert(long))
        if not batch.num_rows:
            continue
        key, text, c = (batch.column(k).to_numpy() for k in range(3))
        context = _matrix(batch.column(3))
        lists = mix(key.view(np.uint64))
        before = np.full((GROUPS + 1, len(key)), -1)
        codes = []
        for name, rows, value in seeds(context):
            a, b = (rows[v] for v in star(value + lists[rows], text[rows]))
            # neighbouring passages mostly give the same pairs
            known = before[name % (GROUPS + 1)]
            other = known[a] != b
            a, b = a[other], b[other]
            known[a] = b
            codes.append(np.minimum(a, b) * len(key) + np.maximum(a, b))
        code = np.unique(np.concatenate(codes))
        for k in range(0, len(code), AT_ONCE):
            p, x = code[k : k + AT_ONCE] // len(key), code[k : k + AT_ONCE] % len(key)
            rows = _stretch_rows(text[p], text[x], c[p], c[x], context[p], context[x])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(rows.num_rows, pa.int64()), pa.nulls(rows.num_rows, pa.binary())], names=names)


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, key, text_key, c) of each entry and seed."""
    for batch in batches:
        key, text, c = (batch.column(k).to_numpy() for k in range(3))
        lists = mix(key.view(np.uint64))
        for name, rows, value in seeds(_matrix(batch.column(3))):
            bucket = mix(value + lists[rows] + np.uint64(name)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (bucket, key[rows], text[rows], c[rows])], names=["bucket", "key", "text_key", "c"])


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of (p, x, p_c, x_c, p_context, x_context)."""
    for batch in batches:
        for k in range(0, batch.num_rows, AT_ONCE):
            some = batch.slice(k, AT_ONCE)
            yield _stretch_rows(*(some.column(i).to_numpy() for i in range(4)), _matrix(some.column(4)), _matrix(some.column(5)))


def _dealt(entries: DataFrame) -> DataFrame:
    """Stretches of long lists: their seeds are grouped by the cluster, with the pairs of ``star``."""
    order = F.sort_array(F.collect_set("c"))  # at most the shingles of a text
    own = stored(entries.mapInArrow(_seed_rows, "bucket long, key long, text_key long, c int").groupBy("bucket", "key", "text_key").agg(order.alias("cs")), "seeds")
    ends = own.groupBy("bucket").agg(F.min_by("cs", "text_key").alias("first_cs"), F.min("text_key").alias("first"), F.max_by("cs", "text_key").alias("last_cs"), F.max("text_key").alias("last")).filter("first < last")
    rows = own.join(ends, "bucket").select("*", F.posexplode("cs").alias("rank", "c"), (F.col("text_key") == F.col("first")).alias("head"))
    to = F.when(F.col("head"), F.col("last_cs")).otherwise(F.col("first_cs"))
    rows = rows.select("key", "text_key", "c", F.when(F.col("head"), F.col("last")).otherwise(F.col("first")).alias("to_text"), F.get(to, F.col("rank") % F.size(to)).alias("to_c"))
    here, there = F.struct(F.col("text_key").alias("t"), "c"), F.struct(F.col("to_text").alias("t"), F.col("to_c").alias("c"))
    pairs = stored(rows.select("key", F.least(here, there).alias("p"), F.greatest(here, there).alias("x")).distinct(), "seed-pairs")
    side = lambda name: entries.select("key", F.struct(F.col("text_key").alias("t"), "c").alias(name), F.col("context").alias(f"{name}_context"))
    both = pairs.join(side("p"), ["key", "p"]).join(side("x"), ["key", "x"])
    return both.select("p.t", F.col("x.t").alias("u"), "p.c", F.col("x.c").alias("d"), "p_context", "x_context").mapInArrow(_pair_rows, _STRETCH)


def passages(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(begin, end, begin in p, end in p), in shingles, of the passages in stretches (shift, begin, end) of one pair of texts.

    A passage has at least ``PASSAGE`` words, begins and ends with a common shingle, and of
    the shingles of both sides together 80% are common. Stretches are joined over a gap
    that is worth less than either, or where neither is long enough alone; first those of
    one shift, then what is left over shifts that are at most ``JUMP`` apart.
    """

    def joined(some: list[tuple[int, int, int]]) -> Iterator[tuple[list, int, int, int, int]]:
        best: list[list] = []  # stretches, balance of common shingles against the others
        for one in some:
            best.append([[one], one[2] - one[1]])
            while len(best) > 1:
                (before, worth), (after, more) = best[-2:]
                (s, _, e), (t, b, _) = before[-1], after[0]
                gap = MISS * (max(0, b - e) + max(0, b + t - e - s))
                long = max(before[-1][2] - before[0][1], after[-1][2] - after[0][1]) >= SPAN
                if abs(s - t) > JUMP or b + t + WIDTH < e + s or worth + more < gap or (long and min(worth, more) < gap):
                    break
                best[-2:] = [[before + after, worth + more - gap]]
        for parts, _ in best:
            (s, b, _), (t, _, e) = parts[0], parts[-1]
            if min(e - b, e + t - b - s) >= SPAN:
                yield parts, b, e, b + s, e + t

    out, used = [], set()
    by_shift: dict[int, list] = {}
    for one in found:
        by_shift.setdefault(one[0], []).append(one)
    for some in by_shift.values():
        for parts, *ends in joined(some):
            used |= set(parts)
            out.append(tuple(ends))
    if len(by_shift) > 1:
        left, end = [], -1
        for one in sorted((o for o in found if o not in used), key=lambda o: (o[1], -o[2])):
            if one[2] > end:  # of stretches at one place the first that goes on
                one = (one[0], max(one[1], end), one[2])
                left.append(one)
                end = one[2]
        for parts, *ends in joined(left):
            if len({o[0] for o in parts}) > 1:
                out.append(tuple(ends))
    return out


_FOUND = "p long, x long, p_start int, p_end int, x_start int, x_end int"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From stretches in order of (p, x, shift, low): the passages of each pair of texts."""
    for batch in _whole_groups(batches, 2):
        p, x, shift, low, high = (batch.column(k).to_numpy().astype(np.int64) for k in range(5))
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (x[1:] != x[:-1])])
        line = np.cumsum(np.concatenate([[True], new[1:] | (shift[1:] != shift[:-1])])) << 32
        far = np.maximum.accumulate(line + high)
        begin = np.flatnonzero(np.concatenate([[True], (line + low)[1:] > far[:-1]]))
        high = np.maximum.reduceat(high, begin)
        pair = (np.cumsum(new) - 1)[begin]
        p, x, shift, low = p[begin], x[begin], shift[begin], low[begin]
        alone = (np.bincount(pair) == 1)[pair]
        easy = np.flatnonzero(alone & (high - low >= SPAN))
        rows = [np.column_stack([p[easy], x[easy], low[easy] + shift[easy], high[easy] + shift[easy], low[easy], high[easy]])]
        hard = np.flatnonzero(~alone)
        cuts = np.flatnonzero(np.diff(pair[hard])) + 1
        for some in np.split(hard, cuts) if len(hard) else []:
            for b, e, pb, pe in passages(list(zip(shift[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True))):
                rows.append(np.array([[p[some[0]], x[some[0]], pb, pe, b, e]]))
        out = np.concatenate(rows)
        out[:, [3, 5]] += WIDTH - 1
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1]), *(pa.array(out[:, k].astype(np.int32)) for k in range(2, 6))], names=["p", "x", "p_start", "p_end", "x_start", "x_end"])


def _wanted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size = shared.value
        for batch in batches:
            slot = batch.column(0).to_numpy() & (size - 1)
            yield batch.filter(pa.array(((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)))

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of at least 50 words that stand in two documents or more, 80% alike in 5-word shingles.

    Returns a row per document and passage: id, start_word, end_word (exclusive), one other
    document that holds it (partner_id, partner_start, partner_end), the passage's class
    and the number of documents in that class. Passages are in one class if they are alike
    or share 50 words of a text, directly or by way of others. Texts that are equal as a
    whole are compared as one; with 50 words or more they are a class of their own, over
    their whole length.

    The texts of a posting list of windows with one minimal shingle are split by the words
    of each passage around it (``seeds``), and every part is tied together by comparing all
    of it with one of its texts, so the work is linear in the list, and texts that share 50
    words are always tied. Lists of more than ``LIST`` anchors are split by the cluster.

    Null and short texts have no passage; null ids and repeated rows are documents of
    their own. Repeats inside one document alone are not reported. An empty table gives an
    empty result; other columns are ignored.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(_text_key(text_col).alias("text_key"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    posts, of_list = rows.mapInArrow(_posts, _POST), Window.partitionBy("key")
    posts = posts.select("key", "text_key", F.min("text_key").over(of_list).alias("a"), F.max("text_key").over(of_list).alias("b"), (F.sum("times").over(of_list) > LIST).cast("long").alias("long"))
    own = stored(posts.filter("a < b").groupBy("text_key").agg(F.collect_set(F.col("key").bitwiseOR(F.col("long"))).alias("keys"), F.max("long").alias("long")), "text-lists")
    entries = own.join(_whole_texts(rows, own), "text_key").select("text_key", "keys", "text").mapInArrow(_anchors, _ENTRY)
    # long lists are not brought together
    apart = F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, F.col("text_key")).otherwise(0)
    met = entries.repartition(n, "key", apart).sortWithinPartitions("key", "text_key", "c").mapInArrow(_compared, _MET)
    if not own.filter("long = 1").isEmpty():
        met = stored(met, "stretches")
        long = met.filter("key is not null").select("key", F.col("p").alias("text_key"), F.col("shift").alias("c"), "context")
        met = met.filter("key is null").select("p", "x", "shift", "low", "high").unionByName(_dealt(long))
    met = met.select("p", "x", "shift", "low", "high")
    found = stored(met.repartition(n, "p", "x").sortWithinPartitions("p", "x", "shift", "low").mapInArrow(_merged, _FOUND), "found")
    return _by_document(docs, *_classes(found), id_col, text_col)


def _whole_texts(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(text_key, text) of at least the texts that take part, one of each."""
    shared = rows.sparkSession.sparkContext.broadcast(_bitmap(keys, "text_key"))
    return rows.mapInArrow(_wanted(shared), "text_key long, text binary").groupBy("text_key").agg(F.first("text").alias("text"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of words in place of the text."""
    for batch in batches:
        data, offsets = texts(batch.column(2))
        counts = np.zeros(batch.num_rows, np.int32)
        for lo, hi in slices(offsets):
            counts[lo:hi] = np.diff(_HASH.starts(data, offsets[lo : hi + 1]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts)], names=["row_id", "text_key", "words"])


def _node(text: str, start: str, end: str) -> Column:
    """A passage of a text as a number, in the order of the texts, so that a list's first text is the least of what it ties."""
    low = (1 << 40) - 1
    return F.col(text).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(text, start, end).bitwiseAND(F.lit(low)))


def _classes(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans of texts, with one partner each; the class of each span)."""
    side = lambda a, b: F.struct(F.col(a).alias("text_key"), F.col(f"{a}_start").alias("start_word"), F.col(f"{a}_end").alias("end_word"), F.col(b).alias("other"), F.col(f"{b}_start").alias("other_start"), F.col(f"{b}_end").alias("other_end"))
    sides = found.select(F.inline(F.array(side("x", "p"), side("p", "x"))))
    spans = sides.groupBy("text_key", "start_word", "end_word").agg(F.min(F.struct("other", "other_start", "other_end")).alias("one")).withColumn("node", _node("text_key", "start_word", "end_word"))
    # of the spans of a text before this one that which ends last; a text has at most as many as its words allow
    before = Window.partitionBy("text_key").orderBy("start_word", "end_word").rowsBetween(Window.unboundedPreceding, -1)
    spans = stored(spans.withColumn("before", F.max(F.struct("end_word", "node")).over(before)), "spans")
    links = found.select(_node("p", "p_start", "p_end").alias("a"), _node("x", "x_start", "x_end").alias("b"))
    links = links.unionByName(spans.filter(F.col("before.end_word") - F.col("start_word") >= PASSAGE).select(F.col("before.node").alias("a"), F.col("node").alias("b")))
    return spans.drop("before"), components(links).toDF("node", "passage_class")


def _by_document(docs: DataFrame, spans: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Spans of texts to spans of documents, and the copies among the documents."""
    kind = docs.select(F.col(id_col)).schema.fields[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("row_id"), _text_key(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text"))
    keyed = stored(rows.mapInArrow(_counted, f"row_id {kind}, text_key long, words int"), "keyed")
    texts_ = stored(keyed.groupBy("text_key").agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.max("row_id").alias("last_id"), F.max("words").alias("words")), "texts")
    classed = spans.join(classes, "node").drop("node")
    sizes = classed.select("passage_class", "text_key").distinct().join(texts_.select("text_key", "n"), "text_key").groupBy("passage_class").agg(F.sum("n").alias("class_documents"))
    named = classed.join(texts_.select(F.col("text_key").alias("other"), F.col("first_id").alias("partner_id")), spans["one.other"] == F.col("other")).join(sizes, "passage_class")
    columns = ["start_word", "end_word", "partner_id", "partner_start", "partner_end", "passage_class", "class_documents"]
    named = stored(named.select("text_key", "start_word", "end_word", "partner_id", F.col("one.other_start").alias("partner_start"), F.col("one.other_end").alias("partner_end"), "passage_class", "class_documents"), "named")
    inside = keyed.select("row_id", "text_key").join(named, "text_key").select("row_id", *columns)
    copies = stored(texts_.filter((F.col("n") > 1) & (F.col("words") >= PASSAGE)).drop("words"), "copies")
    whole = keyed.join(copies, "text_key").select(
        "row_id",
        F.lit(0).alias("start_word"),
        F.col("words").alias("end_word"),
        F.when(F.col("row_id").eqNullSafe(F.col("first_id")), F.col("last_id")).otherwise(F.col("first_id")).alias("partner_id"),
        F.lit(0).alias("partner_start"),
        F.col("words").alias("partner_end"),
        F.xxhash64("text_key", F.lit(0)).alias("passage_class"),
        F.col("n").alias("class_documents"),
    )
    return inside.unionByName(whole).withColumnRenamed("row_id", id_col)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
