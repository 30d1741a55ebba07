"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters, and exact verification.

Documents with equal shingle sets form one class. Each class puts its prefix, the rarest n - ceil(t n) + 1 shingles, into
an index; the order comes from counts of all shingles in a fixed number of hash buckets, so rarity is a bounded table and
the order is the same everywhere. Classes that share a prefix shingle form a block. Blocks are not expanded into all
pairs. Each block has a centre, the least member by a hash that is the same in all blocks, so that the blocks of a group
of near copies mostly agree on it; members meet their blocks' centres only, and verified pairs are linked. In a
second round members meet four centres of other components, drawn in each block from its largest component by hashes that
are again the same in all blocks, so that a set meets few of them however many blocks it stands in. What could still join
two components then meets pairwise, in the first block that a pair shares. All pairs pass the length filter, the positional
filter and the suffix filter, which bounds the overlap by counts of shingles in 512 or more parts of the hash
space, before they are verified, once, on the whole sets. No pair that could join two components is left out, so
components are those of all links.

A shingle that stands in many of a few hundred neighbouring documents is spread by a salt, so that no task gets all its
rows. A row whose block, seen whole, has no set that fits it by length and position is left out at once.

Defined results: a document without words has no shingles and is its own component; rows with equal sets share a
component; a null id never names a component unless all ids of it are null; repeated rows each get their row; other
columns are ignored; an empty table gives no rows. Shingles are told apart by 64-bit hashes, sets by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, bit_map, bits_at, id_text, materialize, table, text_hash
from .components import connect
from .shingles import shingle_set

BUCKETS, PARTS, CHUNK, COMMON = 1 << 18, 512, 512, 32
#: Centres of a block in the second round; earlier shingles that a row carries in the last one.
CENTRES, EARLIER = 4, 64
LAST = (1 << 63) - 1
#: Buckets whose counts one row brings to the driver.
SLICE = 128
#: Bits of the map of ids whose sets are asked for.
ID_BITS = 1 << 26
#: Similarity as a fraction: 100 * intersection >= 75 * union.
NUMERATOR, DENOMINATOR = 75, 100


def needed(a, b):
    """Least overlap of sets of sizes a and b that are similar enough: o / (a + b - o) >= 3/4."""
    return F.ceil((F.col(a) + F.col(b)) * NUMERATOR / (NUMERATOR + DENOMINATOR))


def parts_of(s: np.ndarray) -> bytes:
    """Counts of a set's shingles in parts of the hash space, PARTS of them or, for larger sets, some four shingles a part; more parts if a count is over 255."""
    bits = max(PARTS.bit_length() - 1, (len(s) // 4).bit_length() - 1)
    while True:
        counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if counts.max() <= 255:
            return counts.astype(np.uint8).tobytes()
        bits += 1


def overlap_bound(x: bytes, y: bytes) -> int:
    """The most shingles that two sets can share, by their parts; the finer one's parts are added up to the other's."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if len(a) > len(b):
        a = a.reshape(len(b), -1).sum(1)
    elif len(b) > len(a):
        b = b.reshape(len(a), -1).sum(1)
    return int(np.minimum(a, b).sum())


def describe(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, text_hash, n, node (hash of the set), parts (counts for the suffix filter); and rows bucket, hits with shingle counts."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            out: dict = {"text_hash": b["text_hash"], "n": [], "node": [], "parts": []}
            for text in b["text"]:
                s = shingle_set(text)
                np.add.at(total, (s >> np.uint64(46)).astype(np.int64), 1)
                out["n"].append(len(s))
                out["node"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                out["parts"].append(parts_of(s) if len(s) else None)
            none = [None] * len(b["text"])
            yield {"doc_id": b["doc_id"], **out, "bucket": none, "hits": none}
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 65_536):
            own = at[lo : lo + 65_536]
            none = [None] * len(own)
            yield {"doc_id": none, "text_hash": none, "n": none, "node": none, "parts": none, "bucket": own, "hits": total[own]}

    return materialize(arrow_rows(docs.withColumn("text_hash", text_hash("text")), run, "doc_id long, text_hash long, n int, node binary, parts binary, bucket int, hits long"), "sets")


def bucket_counts(hits: DataFrame) -> np.ndarray:
    """The hits of each of BUCKETS buckets; hits: bucket, hits. Tasks add them up and pack SLICE buckets a row, so 8 bytes a bucket go to the driver."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = []
            for own in b["own"]:
                packed = np.zeros(SLICE, np.int64)
                packed[[x["bucket"] % SLICE for x in own]] = [x["hits"] for x in own]
                out.append(packed.tobytes())
            yield {"slice": b["slice"], "packed": out}

    summed = hits.groupBy("bucket").agg(F.sum("hits").alias("hits"))
    slices = summed.groupBy(F.floor(F.col("bucket") / SLICE).cast("int").alias("slice")).agg(F.collect_list(F.struct("bucket", "hits")).alias("own"))
    out = np.zeros(BUCKETS, np.int64)
    for r in arrow_rows(slices, run, "slice int, packed binary").collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["packed"], np.int64)
    return out


def prefix_index(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """shingle, salt, n, node, pos: the prefix of each set; copies that one task sees go in once.

    A shingle of COMMON sets of one chunk is salted by the set; two of its rows stay without salt, marked -1, so that a row of
    it elsewhere still meets another set, and is known to have more than it meets."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**32 - 1).astype(np.uint32))
    schema = "shingle long, salt int, n int, node binary, pos int"

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        counts, seen = shared.value, set()
        for b in batches:
            for lo in range(0, len(b["text"]), CHUNK):
                parts: list = []
                for text in b["text"][lo : lo + CHUNK]:
                    s = shingle_set(text)
                    if not len(s):
                        continue
                    node = xxhash.xxh3_128_digest(s.tobytes())
                    if node in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(node)
                    n = len(s)
                    many = n - -(-NUMERATOR * n // DENOMINATOR) + 1
                    order = np.lexsort((s, counts[(s >> np.uint64(46)).astype(np.int64)]))[:many]
                    parts.append((s[order], n, node))
                if not parts:
                    continue
                sizes = [len(p[0]) for p in parts]
                shingle = np.concatenate([p[0] for p in parts])
                order = np.argsort(shingle, kind="stable")
                first = np.r_[True, np.diff(shingle[order]) != 0]
                group = np.cumsum(first) - 1
                rank = np.arange(len(order)) - np.flatnonzero(first)[group]
                dense, stays = np.zeros((2, len(order)), bool)
                dense[order], stays[order] = np.bincount(group)[group] >= COMMON, rank < 2
                salt = np.repeat([1 + int.from_bytes(p[2][:3], "little") % 65_521 for p in parts], sizes)
                yield {"shingle": shingle.view(np.int64), "salt": np.where(dense, np.where(stays, -1, salt), 0), "n": np.repeat([p[1] for p in parts], sizes), "node": [p[2] for p, k in zip(parts, sizes, strict=True) for _ in range(k)], "pos": np.concatenate([np.arange(k) for k in sizes])}

    return arrow_rows(docs, run, schema)


def blocks(index: DataFrame) -> DataFrame:
    """shingle, n, node, pos: the rows of shingles that two or more sets share; one pass over partitions sorted by shingle."""
    spark = index.sparkSession
    spread = index.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("shingle"), F.greatest("salt", F.lit(0))).sortWithinPartitions("shingle")
    names = ["shingle", "n", "node", "pos"]

    def shared(t: pa.Table, open_key: int | None) -> pa.Table:
        """Without copies that several tasks saw, without shingles of one set but the salted, which are known to be shared, and
        without rows that no other of their block can fit by length and position; blocks that aren't seen whole (salted, or
        open_key, which goes on elsewhere) keep all rows."""
        t = t.group_by([*names, "salt"]).aggregate([])
        shingle, salt, n, pos = (t.column(c).to_numpy() for c in ("shingle", "salt", "n", "pos"))
        key = shingle.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.maximum(salt, 0).astype(np.uint64)
        key, where = np.unique(key, return_inverse=True)
        partly = np.bincount(where, salt != 0, minlength=len(key)) > 0
        if open_key is not None:
            partly[where[shingle == open_key]] = True
        # n, pos fits m if 3 n / 4 <= m and n - pos >= 3 (n + m) / 7
        low, high = -(-3 * n // 4), (7 * (n - pos)) // 3 - n
        step = np.int64(n.max(initial=0)) + 2
        place = np.sort(where * step + n)
        at = lambda x, side: np.searchsorted(place, where * step + np.clip(x, 0, step - 1), side)
        others = at(high, "right") - at(low, "left") - ((low <= n) & (n <= high))
        fits = np.where(partly[where], (np.bincount(where, minlength=len(key))[where] > 1) | (salt != 0), others > 0)
        return t.filter(pa.array(fits)).select(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the rows of the shingle that the last batch ended with, if it may go on
        cut: int | None = None  # the shingle whose block goes out in parts
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            key = t.column("shingle").to_numpy()
            start = int(np.searchsorted(key, key[-1]))
            if start:
                yield from shared(t.slice(0, start), cut).combine_chunks().to_batches()
                held = t.slice(start).combine_chunks()
            elif t.num_rows < 200_000:
                held = t
            else:  # a long block goes out in parts, each with two sets that were out already; repeats in a block are harmless
                cut = int(key[-1])
                out = shared(t, cut)
                yield from out.combine_chunks().to_batches()
                two = out.slice(0, 2)
                held = (two.append_column("salt", pa.nulls(len(two), pa.int32()).fill_null(0)).select(t.column_names) if len(two) else t.slice(0, 1)).combine_chunks()
        if held is not None:
            yield from shared(held, cut).combine_chunks().to_batches()

    return materialize(spread.mapInArrow(run, "shingle long, n int, node binary, pos int"), "blocks")


def open_blocks(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """shingle, n, node, pos, comp, size: the rows of blocks that hold two components or more; size is the component's number of classes."""
    sizes = materialize(labels.groupBy("label").agg(F.count("*").alias("size")), "sizes")
    own = labels.join(sizes, "label").select("node", F.xxhash64("label.rank", "label.node").alias("comp"), "size")
    labelled = rows.select("shingle", "n", "node", "pos").join(own, "node")
    split = labelled.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("shingle")
    return materialize(labelled.join(split, "shingle", "left_semi"), "open-blocks")


def fits():
    """The length filter and the positional filter on the rows a, b of one block."""
    alike = 4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b")
    return alike & (F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= needed("n_a", "n_b"))


def with_centres(rows: DataFrame, orders: list) -> DataFrame:
    """Distinct pairs a, b of each block's centres, the least member by each of orders, and its members of other components."""
    least = [F.min(F.struct(order.alias("order"), "node", "n", "pos", "comp")) for order in orders]
    centres = rows.groupBy("shingle").agg(F.array(*least).alias("all")).select("shingle", F.explode("all").alias("c"))
    centres = centres.select("shingle", F.col("c.node").alias("a"), *(F.col(f"c.{k}").alias(f"{k}_a") for k in ("n", "pos", "comp")))
    centres = materialize(centres, "centres")  # so that a block with many members can be split in the join
    met = rows.select("shingle", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), F.col("comp").alias("comp_b")).join(centres, "shingle")
    return met.filter((F.col("comp_a") != F.col("comp_b")) & fits()).select("a", "b").distinct()


def all_across(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of different components that pass all filters, each in the first block that they share.

    A row carries the first EARLIER of its set's shingles before its own; a pair that has one in common was met there."""
    own = rows.join(flagged(known), "node").groupBy("node").agg(F.min("n").alias("n"), F.min("comp").alias("comp"), *(F.min(f).alias(f) for f in FLAGS), F.array_sort(F.collect_set(F.struct("pos", "shingle"))).alias("at"))  # as many as a prefix has
    each = own.select("node", "n", "comp", *FLAGS, "at", F.posexplode("at").alias("k", "x"))
    each = each.select("node", "n", "comp", *FLAGS, F.col("x.pos").alias("pos"), F.col("x.shingle").alias("shingle"), F.transform(F.slice("at", 1, F.least("k", F.lit(EARLIER))), lambda e: e["shingle"]).alias("earlier"))
    each = materialize(each, "open-blocks")
    x, y = (each.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "pos", "comp", "earlier", *FLAGS))) for s in "ab")
    # a part that one set has and the other hasn't holds a shingle at least that they don't share
    alone = lambda p, q: sum((F.bit_count(F.col(f"{f}_{p}").bitwiseAND(F.bitwise_not(f"{f}_{q}"))) for f in FLAGS), F.lit(0))
    bound = F.least(F.col("n_a") - alone("a", "b"), F.col("n_b") - alone("b", "a"))
    apart = (F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b"))
    met = x.join(y, (x["shingle"] == y["shingle"]) & apart & fits() & (bound >= needed("n_a", "n_b")) & ~F.arrays_overlap("earlier_a", "earlier_b"))
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


#: Which of PARTS parts a set has, as bits of so many longs.
FLAGS = [f"flags{k}" for k in range(PARTS // 64)]


def flagged(known: DataFrame) -> DataFrame:
    """node and FLAGS."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            has = [np.frombuffer(p, np.uint8).reshape(PARTS, -1).any(1) for p in b["parts"]]
            longs = np.packbits(np.array(has, bool).reshape(-1, PARTS), axis=1).view(np.int64)
            yield {"node": b["node"], **{f: longs[:, k] for k, f in enumerate(FLAGS)}}

    return arrow_rows(known.select("node", "parts"), run, "node binary, " + ", ".join(f"{f} long" for f in FLAGS))


def suffix_filtered(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """a, b: pairs whose counts by part of the hash space allow the overlap they need."""
    side = lambda k: known.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("parts").alias(f"p_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            n = [p + q for p, q in zip(b["n_a"], b["n_b"], strict=True)]
            kept = [i for i, (x, y) in enumerate(zip(b["p_a"], b["p_b"], strict=True)) if (NUMERATOR + DENOMINATOR) * overlap_bound(x, y) >= NUMERATOR * n[i]]
            yield {"a": [b["a"][i] for i in kept], "b": [b["b"][i] for i in kept]}

    return arrow_rows(both.select("a", "b", "n_a", "n_b", "p_a", "p_b"), run, "a binary, b binary")


def sets_of(pairs: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
    """node, sorted (the set, 8 bytes a shingle) of the classes in pairs.

    Texts aren't shuffled: a bitmap of hashed ids of a fixed size goes to the tasks, which make the sets of the texts that it lets
    through; those that it lets through in vain go with the join on the set's hash."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = known.join(asked, "node", "left_semi")
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(LAST))), F.lit(ID_BITS)).cast("long")
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(wanted.select(place.alias("bit")), ID_BITS))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        seen: set[bytes] = set()
        for b in batches:
            out: dict = {"node": [], "sorted": []}
            for k in np.flatnonzero(bits_at(shared.value, np.array(b["bit"], np.int64))).tolist():
                s = shingle_set(b["text"][k])
                node = xxhash.xxh3_128_digest(s.tobytes())
                if not len(s) or node in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(node)
                out["node"].append(node)
                out["sorted"].append(s.tobytes())
            yield out

    made = arrow_rows(docs.select(place.alias("bit"), "text"), run, "node binary, sorted binary")
    return materialize(made.join(asked, "node", "left_semi").dropDuplicates(["node"]), "members")


def verified(pairs: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
    """a, b, similar: pairs whose sets are compared whole. a, which stands in many pairs, is joined first, so that its sets go out by b."""
    sets = sets_of(pairs, docs, known)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("sorted").alias("left")), "a").join(sets.select(F.col("node").alias("b"), F.col("sorted").alias("right")), "b")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            similar = []
            for left, right in zip(b["left"], b["right"], strict=True):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                similar.append(DENOMINATOR * same >= NUMERATOR * (len(x) + len(y) - same))
            yield {"a": b["a"], "b": b["b"], "similar": similar}

    return materialize(arrow_rows(both.select("a", "b", "left", "right"), run, "a binary, b binary, similar boolean"), "verified")


def linked(shared: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
    """node, label: the component of each class in a block after all links; rank is the least id, LAST if all are null."""
    labels = known.select("node", F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("rank"), F.col("node").alias("node")).alias("label"))
    both_ways = {"low": F.least("a", "b"), "high": F.greatest("a", "b")}
    tested = docs.sparkSession.createDataFrame([], "low binary, high binary")
    for turn in ("one centre", "more centres", "all"):
        if turn == "one centre":
            pairs = with_centres(shared.withColumn("comp", F.xxhash64("node")), [F.xxhash64("node")])
        else:
            shared = open_blocks(shared, labels)
            if shared.isEmpty():
                break
            orders = [F.struct(-F.col("size"), F.xxhash64("node", F.lit(k))) for k in range(CENTRES)]
            pairs = with_centres(shared, orders) if turn == "more centres" else all_across(shared, known)
            pairs = pairs.withColumns(both_ways).join(tested, ["low", "high"], "left_anti").select("a", "b")
        pairs = materialize(suffix_filtered(pairs, known), "pairs")
        if pairs.isEmpty():
            continue
        done = verified(pairs, docs, known)
        labels = connect(labels, done.filter("similar"))
        missed = done.filter(~F.col("similar")).withColumns(both_ways).select("low", "high")  # those alike are in one component now
        tested = tested.unionByName(missed)
    return labels


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash (which tells rows that share an id apart), leader (whether the row is of the class and id that name the component), node (hash of the set, null without words)."""
    docs = id_text(df, id_col, text_col)
    described = describe(docs)
    counts = bucket_counts(described.filter("bucket IS NOT NULL").select("bucket", "hits"))
    rows = described.filter("bucket IS NULL").select("doc_id", "text_hash", "n", "node", "parts")
    classes = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("parts").alias("parts"))
    shared = blocks(prefix_index(docs, counts))
    known = materialize(classes.join(shared.select("node").distinct(), "node", "left_semi"), "classes")
    named = linked(shared, docs, known).select("node", F.col("label.rank").alias("component"), (F.col("node") == F.col("label.node")).alias("leads"))
    smallest = classes.select("node", F.coalesce("doc_id", F.lit(LAST)).alias("own"))
    final = smallest.join(named, "node", "left").select("node", F.coalesce("component", "own").alias("component"), F.coalesce("leads", F.lit(True)).alias("leads"))
    final = materialize(final, "components")  # so that the last join deals both sides anew and a node with many copies can be split
    out = rows.join(final, "node", "left")
    component_id = F.when(F.col("component") == LAST, F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    leader = F.col("node").isNull() | (F.col("leads") & (F.coalesce("doc_id", F.lit(LAST)) == F.col("component")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component_id.alias("component_id"), "text_hash", leader.alias("leader"), "node")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op8_jaccard": op8_jaccard}
ORACLE: dict[str, str] = {}
