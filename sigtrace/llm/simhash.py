"""SimHash near duplicates: pigeonhole blocks of the fingerprint, a join on blocks, then the Hamming distance.

Similar documents: an exact join on the rarest shingles, then the Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, in_one, lean, maybe_in, release, trim, written
from .components import components
from .tokens import forget

SEED = 42
#: Shingles counted at once: bounds the memory that one very long text takes.
CHUNK = 1 << 16


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text: A-Z lowered, words between ASCII white space, shingles with repeats.

    A text of fewer words is one shingle; null, empty and blank texts give zero.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n, digest, counts = len(parts) - words + 1, xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        spans = zip(start[at:to].tolist(), end[at + words - 1 : to + words - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "fingerprint") -> DataFrame:
    """keep columns and the fingerprint as a long, one row per input row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).cast("binary").alias("__text"))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.LongType())])

    def scan(batches):
        for b in batches:
            found = np.array([fingerprint(t, words) for t in b.column("__text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(found)], names=[*keep, out])

    return rows.mapInArrow(lean(scan), schema)


def block_keys(fp: Column, distance: int, blocks: int) -> Column:
    """Array of (table, key) numbers; two fingerprints within distance agree on at least one of them.

    Of ``blocks`` blocks at most ``distance`` can differ, so one choice of ``blocks - distance`` blocks is equal.
    """
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = 0
        for i in chosen:
            mask |= ((1 << (edges[i + 1] - edges[i])) - 1) << edges[i]
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(t).alias("table"), fp.bitwiseAND(F.lit(signed)).alias("key")))
    return F.array(*keys)


def links(fps: DataFrame, distance: int = 2, blocks: int = 4, crowd: int = 64) -> DataFrame:
    """fps(fp long, distinct) -> (u, v) links that connect exactly what all pairs within distance would connect.

    Blocks shared by at most ``crowd`` fingerprints are self-joined and verified pair by pair, so a row meets fewer than
    ``crowd`` others in each. In a more crowded block each member is spelled out at every value that differs from it in
    one bit or none; members that meet at a value are within two bits of each other, and members within two bits meet.
    Each then links to the smallest member there. So no block, however large, yields pairs in the square of its size.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), distance, blocks)).alias("b")).select("fp", "b.table", "b.key")
    sizes = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, ["table", "key"]), "blocks")
    few = shared.where(F.col("n") <= crowd).select("table", "key", "fp")
    pairs = few.withColumnRenamed("fp", "u").join(few.withColumnRenamed("fp", "v"), ["table", "key"]).where("u < v")
    pairs = pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance).select("u", "v")
    crowded = shared.where(F.col("n") > crowd).select("fp").distinct()
    if distance == 2:
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
        meets = crowded.select("fp", F.explode(F.transform(flips, lambda m: m.bitwiseXOR(F.col("fp")))).alias("value"))
        least = meets.groupBy("value").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("value", "v")
        stars = meets.join(least, "value").where("fp <> v").select(F.col("fp").alias("u"), "v")
    else:
        steps = [F.lit(0).cast("long")] + ([F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)] if distance else [])
        spelled = crowded.select(F.col("fp").alias("u"), F.explode(F.transform(F.array(*steps), lambda m: m.bitwiseXOR(F.col("fp")))).alias("v"))
        stars = spelled.join(crowded.withColumnRenamed("fp", "v"), "v").where("u < v").select("u", "v")
    out = pairs.unionByName(stars).distinct()
    out._written_to = shared._written_to  # discard() deletes what it reads
    return out


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fingerprint long, component_id): groups of documents whose fingerprints are linked within distance bits.

    component_id is the smallest id reachable, the document itself included; ids that are null never name a group that
    has others. Null, empty and blank texts share fingerprint zero and so one group. Repeated rows stay repeated. Equal
    fingerprints collapse to one before any comparison, so copies in any number cost one row.
    """
    prints = written(fingerprints(docs, words, text_col, (id_col,)), "prints")
    labels = linked_prints(prints.select("fingerprint", F.col(id_col).alias("least")), distance).withColumnRenamed("least", "component_id")
    return prints.join(labels, "fingerprint").select(id_col, "fingerprint", "component_id")


def linked_prints(prints: DataFrame, distance: int = 2, few: int = 0) -> DataFrame:
    """prints(fingerprint, least) -> each fingerprint once, with the least of the group it is linked to within distance bits.

    few is that of components().
    """
    classes = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("least").alias("least"))
    found = links(classes.select("fp"), distance)
    linked = components(found, few=few)
    rooted = linked.join(classes, linked["node"] == classes["fp"]).select("fp", "root", "least")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("named")), "root").select("fp", "named")
    labels = written(classes.join(named, "fp", "left").select(F.col("fp").alias("fingerprint"), F.coalesce("named", "least").alias("least")), "labels")
    for t in (found, linked):
        discard(t)
    return labels


def hex16(fp: str | Column) -> Column:
    """16 lower-case hex digits of a 64-bit value."""
    c = F.col(fp) if isinstance(fp, str) else fp
    return F.lower(F.lpad(F.hex(c), 16, "0"))


#: Bits of the parity map of a text's shingles, as longs.
MAP_LONGS = 8
#: Rows whose shingles are counted to tell common ones, and the most that are told; both only order the shingles.
ORDER_ROWS, ORDER_MOST = 20_000, 1 << 18
#: Members of a key that meet all others there in its second round; twice as many in each round after it.
CENTRES = 16
#: Links, and members of keys, that one task takes; and the pairs of members that it may meet. More are dealt to all tasks.
FEW, FEW_PAIRS = 1 << 17, 1 << 22


def shingles(parts: list[bytes], words: int) -> np.ndarray:
    """Sorted distinct XXH64 values of a text's shingles; a text of fewer words is one shingle, one of none has none."""
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(parts) - words + 1].tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(start, end[words - 1 :].tolist(), strict=True)], np.uint64))


def similar_documents(docs: DataFrame, words: int = 5, least: float = 0.8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, component_id) of every row: groups linked by a Jaccard similarity of word shingles of least or more.

    component_id is the smallest id of the group; null ids count as numbers made from the text. Repeated rows stay
    repeated.
    """
    return similar_rows(docs, words, least, text_col, id_col).select(id_col, "component_id")


def row_key(own: Column, text: str | Column) -> Column:
    """A number for a row's id and text: rows that repeat an id with another text have another number."""
    return F.xxhash64(own, F.col(text) if isinstance(text, str) else text)


def own_id(text_col: str = "text", id_col: str = "doc_id") -> Column:
    """The id, or a negative number made from the text where it is null."""
    return F.coalesce(F.col(id_col).cast("long"), -1 - F.shiftrightunsigned(F.xxhash64(F.col(text_col)), 1))


def similar_rows(docs: DataFrame, words: int = 5, least: float = 0.8, text_col: str = "text", id_col: str = "doc_id", distance: int | None = None) -> DataFrame:
    """(id, row, component_id, keeper) of every row: row_key() of it and of the row that stands for its group.

    Texts equal in their words collapse to a class. With a distance, classes are first grouped as near_duplicates() groups
    them, by all links of their fingerprints of three-word shingles within distance bits; only classes of different such
    groups are then compared, and links of either kind make one group.

    A text's shingles go in one order for all texts, rare ones first as
    far as a sample tells. Of two sets of n and m shingles with a similarity of least, one must be found among the first
    n - ceil(least * n) + 1 of the one and the like of the other, so classes that share none of these need not meet; the
    order bears on the work alone. Classes of a key meet as in linked_by_keys(); number and parity of shingles rule out
    most pairs, the exact similarity of the whole texts decides the others.
    """
    bounded_batches(docs.sparkSession)
    text = F.col(text_col).cast("binary")
    rows = docs.select(own_id(text_col, id_col).alias("id"), row_key(own_id(text_col, id_col), text_col).alias("row"), text.alias("text"))
    common, often = _common_shingles(rows, words)
    held = docs.sparkSession.sparkContext.broadcast((common, often))

    def scan(batches):
        forget()
        common, often = held.value
        for b in batches:
            h1, h2, fp, n, bits, first = [], [], [], [], [], []
            for t in b.column("text").to_pylist():
                parts = (t or b"").lower().split()
                both = xxhash.xxh3_128_digest(b" ".join(parts))
                h1.append(int.from_bytes(both[:8], "little", signed=True))
                h2.append(int.from_bytes(both[8:], "little", signed=True))
                fp.append(0 if distance is None else fingerprint(t))
                s = shingles(parts, words)
                n.append(len(s))
                bits.append(parity_map(s))
                first.append(prefix(s, least, common, often))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64()))], names=["id", "row", "h1", "h2", "fp", "n", "bits", "first"])

    prints = written(rows.mapInArrow(lean(scan), "id long, row long, h1 long, h2 long, fp long, n long, bits array<long>, first array<long>"), "prints")
    classes = prints.groupBy("h1", "h2").agg(F.min(F.struct("id", "row")).alias("rep"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("first").alias("first"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    if distance is None:
        start = written(classes.select("cid", F.col("cid").alias("root")), "start")
    else:
        labels = linked_prints(classes.select(F.col("fp").alias("fingerprint"), F.col("cid").alias("least")), distance, FEW)
        start = written(classes.select("cid", F.col("fp").alias("fingerprint")).join(labels, "fingerprint").select("cid", F.col("least").alias("root")), "start")
        discard(labels)
        release(docs.sparkSession)
    keyed = classes.select("cid", F.col("n").cast("int").alias("n"), "bits", "first").join(start, "cid").select("cid", "root", "n", "bits", F.posexplode("first").alias("at", "key"))
    # A pair's first common key is among the first of the smaller set, by how many it must share at its own size.
    early = F.col("at") <= F.col("n") * (1 - 2 * least / (1 + least)) + 1e-6
    shared = keyed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max(early).alias("early")).where("a < b and early")
    shared = written(shared.select("key"), "shared")
    members = keyed.where(maybe_in(shared, "key")(F.col("key"))).join(shared, "key")

    def spelled(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array([shingles((t or b"").lower().split(), words).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["cid", "s"])

    def verify(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column("su").to_pylist(), b.column("sv").to_pylist(), strict=True):
                a, c = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, c, assume_unique=True))
                total = len(a) + len(c) - both
                good.append(total == 0 or both >= least * total)
            yield b.select(["u", "ru", "v", "rv"]).take(pa.array(np.flatnonzero(good)))

    def similar(pairs: DataFrame) -> DataFrame:
        """Of pairs(u, ru, v, rv) those whose texts are similar."""
        near = written(pairs, "near")
        n = near.count()
        if not n:
            return near
        few = n <= FEW
        near = in_one(near) if few else near
        needed = near.select(F.col("u").alias("cid")).unionByName(near.select(F.col("v").alias("cid"))).distinct()
        # A few numbers go to all tasks, so that the classes need not move.
        needed = written(classes.select("cid", F.col("rep.row").alias("row")).join(F.broadcast(needed) if few else needed, "cid", "left_semi"), "needed")
        needed = in_one(needed) if few else needed
        texts = rows.join(F.broadcast(needed), "row") if few else rows.where(maybe_in(needed, "row")(F.col("row"))).join(needed, "row")
        texts = written(texts.select("cid", "text").mapInArrow(lean(spelled), "cid long, s binary").groupBy("cid").agg(F.first("s").alias("s")), "shingles")
        both = (F.broadcast(near) if few else near).join(texts.select(F.col("cid").alias("u"), F.col("s").alias("su")), "u").join(texts.select(F.col("cid").alias("v"), F.col("s").alias("sv")), "v")
        out = written(both.select("u", "ru", "v", "rv", "su", "sv").mapInArrow(lean(verify), "u long, ru long, v long, rv long"), "similar")
        for t in (near, needed, texts):
            discard(t)
        return out

    linked = linked_by_keys(members, similar, least, start)
    rooted = classes.select("h1", "h2", "rep", "cid").join(linked, F.col("cid") == F.col("node"), "left").select("h1", "h2", "rep", F.coalesce("root", "cid").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("rep").alias("head"))
    named = written(rooted.join(heads, "root").select("h1", "h2", F.col("head.id").alias("component_id"), F.col("head.row").alias("keeper")), "labels")
    for t in (classes, start, shared, linked):
        discard(t)
    out = written(prints.select("id", "row", "h1", "h2").join(named, ["h1", "h2"]).select(F.col("id").alias(id_col), "row", "component_id", "keeper"), "groups")
    for t in (prints, named):
        discard(t)
    release(docs.sparkSession)
    return out


def linked_by_keys(members: DataFrame, similar: Callable[[DataFrame], DataFrame], least: float, start: DataFrame, centres: int = CENTRES) -> DataFrame:
    """members(key, cid, root, n, bits, at) -> (node, root): the groups that all pairs sharing a key would form, root the smallest.

    start(cid, root) are the groups to begin with; a member has n keys in all, this one at place at of the common order,
    and the parity map bits of all. similar takes pairs(u, ru, v, rv) and returns those that are linked. Two members need
    not meet in a key that leaves too few places behind it for what they must share; a linked pair meets in the first key
    that both have. Nor need they if their maps differ in more cells than two sets that are similar enough in values: the
    join itself looks at the maps, so that of a family of unlike members few pairs become rows. In each round a key's centres meet all its
    members of other groups and leave the key, which is done once its members are one group. Of two members the one that
    leaves first has met the other, or was in its group, so no link between groups is lost. The first round has one
    centre a key, by which a group of near copies becomes one without pairs in the square of its size; the next rounds
    have centres of as many groups as CENTRES and twice as many each time, so a key of n unlike members takes about
    log n rounds. Rounds of few members and pairs are one task, without a shuffle.
    """
    held, most = written(members.select("key", "cid", "root", "n", "bits", "at"), "held"), 1
    links, read = start.where("cid <> root").select(F.col("cid").alias("u"), F.col("root").alias("v")), []
    while True:
        held, few = _few(held, most)
        live = held.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key")
        now = written(held.join(live, "key"), "held")
        discard(held)
        held, few = _few(now, most)
        if few == 0:
            break
        heads = held.groupBy("key", F.pmod(F.xxhash64("root"), F.lit(most)).alias("slot")).agg(F.min(F.struct("cid", "root", "n", "at", "bits")).alias("c"))
        heads = written(heads.select("key", F.col("c.cid").alias("v"), F.col("c.root").alias("rv"), F.col("c.n").alias("nv"), F.col("c.at").alias("atv"), F.col("c.bits").alias("bv")), "centres")
        heads = in_one(heads) if few else heads
        alike = F.least("n", "nv") >= least * F.greatest("n", "nv") - 1e-6
        enough = F.least(F.col("n") - F.col("at"), F.col("nv") - F.col("atv")) >= least / (1 + least) * (F.col("n") + F.col("nv")) - 1e-6
        odd = sum((F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("bv", F.lit(k)))) for k in range(MAP_LONGS)), F.lit(0))
        apart = (1 - least) / (1 + least) * (F.col("n") + F.col("nv")) + 1e-6
        pairs = held.join(heads, "key").where((F.col("root") != F.col("rv")) & alike & enough & (odd <= apart)).select(F.col("cid").alias("u"), F.col("root").alias("ru"), "v", "rv")
        swap = F.col("u") < F.col("v")
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.when(swap, F.col("rv")).otherwise(F.col("ru")).alias("ru"), F.least("u", "v").alias("v"), F.when(swap, F.col("ru")).otherwise(F.col("rv")).alias("rv")).distinct()
        found = similar(pairs)
        read.append(found)
        links = links.unionByName(found.select("u", "v"))
        joined = components(found.select(F.col("ru").alias("u"), F.col("rv").alias("v")), few=FEW)
        if few:
            joined = in_one(joined)
        left = held.join(heads.select("key", F.col("v").alias("cid")), ["key", "cid"], "left_anti")
        left = left.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
        now = written(left.select("key", "cid", F.coalesce("to", "root").alias("root"), "n", "bits", "at"), "held")
        for t in (held, heads, joined):
            discard(t)
        held, most = now, max(centres, 2 * most)
        release(members.sparkSession)
    out = components(links, few=FEW)
    for t in (held, *read):
        discard(t)
    return out


def _few(held: DataFrame, most: int) -> tuple[DataFrame, int | None]:
    """held, and its number of rows if one task takes a round of it with most centres a key (then in one partition), else None."""
    n = held.count()
    return (in_one(held), n) if n <= FEW and n * most <= FEW_PAIRS else (held, None)


def parity_map(s: np.ndarray) -> np.ndarray:
    """Which of 64 * MAP_LONGS cells hold an odd number of the values: two maps differ in no more cells than the sets in values."""
    cells = np.bincount((s & np.uint64(64 * MAP_LONGS - 1)).astype(np.int64), minlength=64 * MAP_LONGS) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def prefix(s: np.ndarray, least: float, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first n - ceil(least * n) + 1 of n shingles, by how often they are counted, then by value."""
    if not len(s):
        return s.view(np.int64)
    count = np.zeros(len(s), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        count = np.where(common[at] == s, often[at], 0)
    n = len(s) - math.ceil(least * len(s) - 1e-9) + 1
    return s[np.lexsort((s, count))[:n]].view(np.int64)


def _common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a bounded sample of rows(row, text) have, sorted, and in how many they are."""
    n = rows.count()
    at = F.shiftrightunsigned(F.xxhash64(F.lit(5), F.col("text")), 11) / F.lit(float(1 << 53))
    some = rows.where(at < min(1.0, ORDER_ROWS / max(1, n))).select("text")

    def spell(batches):
        for b in batches:
            parts = [(t or b"").lower().split() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(b" ".join(p)) >> 1 for p in parts], pa.int64()), pa.array([shingles(p, words).view(np.int64) for p in parts], pa.list_(pa.int64()))], names=["h", "s"])

    once = some.mapInArrow(lean(spell), "h long, s array<long>").groupBy("h").agg(F.first("s").alias("s"))
    counts = once.select(F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = counts.orderBy(F.col("n").desc(), "s").limit(ORDER_MOST).toArrow()
    common, often = found["s"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(common)
    common, often = common[order], often[order]
    del found
    trim()
    return common, often
