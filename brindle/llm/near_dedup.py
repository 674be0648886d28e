"""Operator 4: near duplicates by an inverted join of MinHash signature coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import cut, lean, stored, unused
from .words import Hasher, mix, slices, texts, windows

#: Coordinates of a signature; coordinates that a pair must share to be confirmed on its
#: full sets (a pair at the least similarity has fewer about once in 20,000); coordinates
#: shared with the head of a posting list that put a class into the head's group.
COORDINATES, MATCHES, GROUPED = 32, 16, 8
PERCENT = 80
#: Weight of a block of the comparison within groups: bytes of its sets, and some for each set.
BLOCK_WEIGHT, SET_WEIGHT = 4 << 20, 3000
BITMAP_BITS = (20, 28)

_HASH = Hasher()
_ODD = np.random.default_rng(104729).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_SALT = np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and where each text's begin.

    Fewer words than ``width`` make one shingle of them all; no words make none.
    """
    hashes, _, borders = _HASH.rows(data, offsets)
    runs, begins = windows(hashes, borders, width)
    counts, words = np.diff(begins), np.diff(borders)
    owner = np.repeat(np.arange(len(words)), counts)
    few = np.flatnonzero((words > 0) & (words < width))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for k in range(width - 1):
            has = words[few] > k
            whole[has] = mix(whole[has] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[borders[:-1][few[has]] + k])
        runs, owner = np.concatenate([runs, mix(whole + words[few].astype(np.uint64))]), np.concatenate([owner, few])
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    runs, owner = runs[new], owner[new]
    return runs, np.searchsorted(owner, np.arange(len(words) + 1))


def signatures(sets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A row per non-empty set: a 64-bit posting key for each coordinate and its minimal value."""
    full = np.flatnonzero(np.diff(begins))
    out = np.empty((len(full), COORDINATES), np.int64)
    if len(full):
        for c in range(COORDINATES):
            least = np.minimum.reduceat(sets * _ODD[c], begins[:-1][full])
            out[:, c] = mix(least + _SALT[c]).view(np.int64)
    return out


def _digest(part: np.ndarray) -> bytes:
    return hashlib.blake2b(part.tobytes(), digest_size=16).digest()


def _signer(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(2))
            for lo, hi in slices(offsets):
                sets, begins = shingle_sets(data, offsets[lo : hi + 1], width)
                sizes = np.diff(begins)
                names = [_digest(sets[a:b]) if b > a else None for a, b in zip(begins[:-1], begins[1:], strict=True)]
                keys = signatures(sets, begins)
                at = np.concatenate([[0], np.cumsum(np.where(sizes > 0, COORDINATES, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(names, pa.binary()), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel()))],
                    names=["row_id", "text_key", "cls", "n", "keys"],
                )

    return run


def _sets_of(width: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size = shared.value
        for batch in batches:
            slot = batch.column(0).to_numpy() & (size - 1)
            take = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
            some = batch.filter(pa.array(take.astype(bool)))
            data, offsets = texts(some.column(1))
            for lo, hi in slices(offsets):
                sets, begins = shingle_sets(data, offsets[lo : hi + 1], width)
                parts = [sets[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(p) for p in parts], pa.binary()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["cls", "set"])

    return run


def _bitmap(keys: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A bitmap of the low bits of a long column, at most 2 ** BITMAP_BITS[1] bits; only its pages reach the driver."""
    n = keys.count()
    size = 1 << min(BITMAP_BITS[1], max(BITMAP_BITS[0], (16 * n).bit_length()))
    slot = F.col(column).bitwiseAND(F.lit(size - 1))
    pages = keys.groupBy(F.floor(slot / F.lit(32768)).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot + 1)).alias("bits"))
    bits = np.zeros(size >> 3, np.uint8)
    # bitmap_bit_position takes numbers from 1 on
    for page, part in pages.collect():
        bits[page * 4096 : page * 4096 + 4096] = np.frombuffer(bytes(part), np.uint8)[: len(bits) - page * 4096]
    return bits, size


def _shared_keys(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        ok = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in pairs]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])


def block_links(ring: list[np.ndarray], members: list[np.ndarray]) -> list[np.ndarray]:
    """For each ring set the indexes of the member sets that it is linked with (exact, by common elements)."""
    lens = [len(s) for s in (*ring, *members)]
    elements, owner = np.concatenate([*ring, *members]), np.repeat(np.arange(len(lens)), lens)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    first = np.ones(len(elements), bool)
    first[1:] = elements[1:] != elements[:-1]
    number = np.cumsum(first) - 1
    common = np.bincount(number) > 1
    keep = common[number]
    column = (np.cumsum(common) - 1)[number[keep]]
    row, r = owner[keep], len(ring)
    both = np.zeros((r, len(members)), np.float32)
    width = 1024
    cuts = np.searchsorted(column, np.arange(0, int(common.sum()) + width, width))
    for k in range(len(cuts) - 1):
        part = slice(cuts[k], cuts[k + 1])
        grid = np.zeros((len(lens), width), np.float32)
        grid[row[part], column[part] - k * width] = 1
        both += grid[:r] @ grid[r:].T
    sizes = np.array(lens, np.float32)
    union = sizes[:r, None] + sizes[None, r:] - both
    return [np.flatnonzero(x) for x in 100 * both >= PERCENT * union]


def _compare(frame: pd.DataFrame) -> pd.DataFrame:
    """Links of a ring block with a member block, a spanning forest of them: one link to those already tied to the head, and links that join ring classes not yet joined here."""
    ring, members = frame[frame["side"] == 0], frame[frame["side"] == 1]
    if not len(ring) or not len(members):
        return pd.DataFrame({"a": [], "b": []})
    as_sets = lambda f: [np.frombuffer(s, np.uint64) for s in f["set"]]
    found = block_links(as_sets(ring), as_sets(members))
    names, others, tied = ring["cls"].tolist(), members["cls"].tolist(), members["tied"].to_numpy()
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for name, hits in zip(names, found, strict=True):
        anchor = b"" if tied[hits].any() else None
        for k in hits[~tied[hits]]:
            a, b = root(name), root(others[k])
            if a != b:
                parent[a] = b
                out.append((name, others[k]))
        if anchor is not None and root(name) != root(anchor):
            parent[root(name)] = root(anchor)
            out.append((name, others[int(hits[tied[hits]][0])]))
    return pd.DataFrame(out, columns=["a", "b"])


def _links(docs: DataFrame, signed: DataFrame, width: int, text_col: str) -> DataFrame:
    """Links (a, b) between classes of equal shingle sets; enough of them to join every component."""
    spark = docs.sparkSession
    classes = stored(signed.filter("cls is not null").groupBy("cls").agg(F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    posts = classes.select("cls", F.explode("keys").alias("key"))
    shared = stored(posts.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared-keys")
    own = stored(posts.join(shared, "key"), "posts")
    # prefix: a pair with MATCHES equal coordinates meets in the COORDINATES - MATCHES + 1
    # rarest of either; coordinates that no other class has come first and need no post
    ranked = own.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("all"))  # at most COORDINATES
    prefix = ranked.filter(F.size("all") >= MATCHES).select("cls", F.explode(F.slice("all", F.lit(1), F.size("all") - (MATCHES - 1))).alias("p")).select("cls", F.col("p.key").alias("key"))
    prefix = stored(prefix, "prefix-posts")
    heads = stored(prefix.groupBy("key").agg(F.min("cls").alias("head"), F.max("cls").alias("last")).filter("head < last").drop("last"), "heads")
    met = prefix.join(heads, "key").filter("cls <> head").select("head", "cls").distinct()
    keys = classes.select("cls", "keys")
    near = met.join(keys, "cls").join(keys.select(F.col("cls").alias("head"), F.col("keys").alias("head_keys")), "head")
    near = near.filter(_shared_keys("keys", "head_keys") >= GROUPED).select("head", "cls")
    # classes that are near a common head, directly or by way of others, form a group
    groups = stored(components(near.select(F.col("head").alias("a"), F.col("cls").alias("b"))).select(F.col("vertex").alias("cls"), F.col("root").alias("grp")), "groups")
    # pairs of one posting list whose classes fell into different groups
    lists = prefix.join(heads, "key").join(groups, "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))
    of_head = groups.select(F.col("cls").alias("head"), F.col("grp").alias("of"))
    lists = stored(lists.join(of_head, "head", "left").withColumn("minor", F.col("grp") != F.coalesce("of", "head")).select("key", "cls", "grp", "minor"), "lists")
    mixed = cut(lists.filter("minor").select("key").distinct())
    lists = stored(lists.join(mixed, "key").join(keys, "cls"), "mixed-lists")
    minor = lists.filter("minor").select("key", F.col("cls").alias("a"), F.col("grp").alias("a_grp"), F.col("keys").alias("a_keys"))
    apart = (F.col("a_grp") != F.col("grp")) & (~F.col("minor") | (F.col("a") < F.col("b"))) & (_shared_keys("a_keys", "keys") >= MATCHES)
    cross = minor.join(lists.withColumnRenamed("cls", "b"), "key").filter(apart)
    cross = stored(cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cross")
    # the full sets of all classes that take part
    part = groups.select("cls").union(cross.select("a")).union(cross.select("b")).distinct()
    wanted = stored(part.join(classes.select("cls", "text_key", "n"), "cls"), "wanted")
    shared_bits = spark.sparkContext.broadcast(_bitmap(wanted, "text_key"))
    rows = docs.select(_text_key(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text"))
    sets = rows.mapInArrow(lean(_sets_of(width, shared_bits)), "cls binary, set binary").groupBy("cls").agg(F.first("set").alias("set"))
    sets = stored(sets.join(wanted.select("cls"), "cls"), "sets")
    # within a group: every class against its head, the least of them
    a_set = sets.select(F.col("cls").alias("a"), F.col("set").alias("a_set"))
    b_set = sets.select(F.col("cls").alias("b"), F.col("set").alias("b_set"))
    confirmed = lambda pairs: pairs.join(a_set, "a").join(b_set, "b").select("a", "b", "a_set", "b_set").mapInArrow(lean(_confirm), "a binary, b binary, ok boolean")
    star = groups.filter("cls <> grp").select(F.col("grp").alias("a"), F.col("cls").alias("b"))
    star = stored(confirmed(star), "star")
    # then those not tied to it against all of the group, in blocks of bounded bytes
    member = star.select(F.col("a").alias("head"), F.col("b").alias("cls"), F.col("ok").alias("tied")).join(wanted.select("cls", "n"), "cls")
    blocks = lambda n: F.ceil(F.sum(F.when(n > 0, n * 8 + SET_WEIGHT).otherwise(0)) / BLOCK_WEIGHT).cast("int")
    sizes = member.groupBy("head").agg(F.count(F.lit(1)).alias("all"), blocks(F.col("n")).alias("nb"), blocks(F.when(~F.col("tied"), F.col("n")).otherwise(0)).alias("nr")).filter("`all` > 1 and nr > 0")
    member = stored(member.join(sizes, "head").drop("all", "n"), "members")
    slot = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    ringed = member.filter(~F.col("tied")).select("head", slot(F.col("nr")).alias("i"), F.explode(upto("nb")).alias("j"), "cls", "tied", F.lit(0).alias("side"))
    others = member.select("head", F.explode(upto("nr")).alias("i"), slot(F.col("nb")).alias("j"), "cls", "tied", F.lit(1).alias("side"))
    dealt = ringed.unionByName(others).join(sets, "cls")
    inner = dealt.groupBy("head", "i", "j").applyInPandas(_compare, "a binary, b binary")
    outer = confirmed(cross).filter("ok").select("a", "b")
    return star.filter("ok").select("a", "b").unionByName(inner).unionByName(outer)


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))


def near_duplicates(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (row_id, text_key, n_shingles, root, component_id): root names the component, null without words.

    Words are runs of non-blank characters, A-Z lower-cased; a document's set has its
    distinct runs of ``width`` words. Documents are linked if 100 * intersection is at
    least 80 * union, confirmed on full sets; the component id is the least id of all
    documents that links reach. Equal sets are one class, so copies add no pairs; within a
    group of near copies the classes are compared in blocks, and only links that join
    something are passed on.

    A null or blank text has no set and is linked with nothing. Null ids take part and are
    passed over when the least id is sought; a component of null ids alone has a null
    component id. Repeated rows are copies. An empty table gives an empty result; other
    columns are ignored.
    """
    ddl = docs.select(F.col(id_col)).schema.fields[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("row_id"), _text_key(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text"))
    signed = stored(rows.mapInArrow(lean(_signer(width)), f"row_id {ddl}, text_key long, cls binary, n long, keys array<long>"), "signed")
    roots = components(_links(docs, signed, width, text_col)).select(F.col("vertex").alias("cls"), "root")
    least = signed.filter("cls is not null").groupBy("cls").agg(F.min("row_id").alias("least"))
    named = least.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = stored(named, "named")
    ids = cut(named.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(named.join(ids, "root").select("cls", "root", "component_id"))
    joined = signed.select("row_id", "text_key", "cls", F.col("n").alias("n_shingles")).join(named, "cls", "left")
    return joined.select("row_id", "text_key", "n_shingles", "root", F.when(F.col("cls").isNull(), F.col("row_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near duplicates: of each component the row with the least id stays; blank ones all stay.

    Null ids come after all others; of rows equal in id and text one stays. Columns of any
    name are kept as they are; an empty table gives an empty result.
    """
    found = near_duplicates(docs, width, id_col, text_col).filter("root is not null")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("row_id").isNull().alias("none"), "row_id", "text_key")).alias("best"))
    best = cut(best.select(F.col("best.row_id").alias("best_id"), F.col("best.text_key").alias("best_key")))
    word = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    key = unused("best_key", docs.columns)
    full = docs.filter(word).withColumn(key, _text_key(text_col))
    kept = full.join(best, full[id_col].eqNullSafe(best["best_id"]) & (full[key] == best["best_key"]), "left_semi")
    return kept.dropDuplicates([id_col, key]).drop(key).unionByName(docs.filter(~word))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
    return found.select(F.col("row_id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("row_id") == F.col("component_id"), F.lit(False)).alias("kept"))
