"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r every bit position gets a random non-zero vector of r + 1 bits;
each of the 2^(r+1) - 1 non-zero vectors v gives a table whose mask has the
positions with odd inner product.  Two fingerprints that differ in at most r
positions span at most r dimensions with the vectors there, so some v is
orthogonal to all of them: the pair has equal masked values in that table.  No
pair within the radius is missed.

Distinct fingerprints are dealt by (table, masked value); each task streams
its sorted share, compares within a bucket by xor and popcount and emits the
edges of a spanning forest, never all pairs.  A bucket over ``bucket_rows`` is
not compared there: its rows pass on, exactly, to a second deal by blocks of
the bits (r + 1 blocks: one of them must agree), and so on down; what is left
after the last level is cut into parts of ``bucket_rows``, and every two parts of
a bucket meet in a task of their own.  Components come from alternating large-
and small-star steps on the edge table, cut by tables in the shared folder.

Defined results: no words (null, empty or blank text) gives fingerprint zero,
linked like any other; a very long text is hashed whole; an empty table gives no rows; repeated ids are one document each row; a null id
never names a component unless all ids in it are null.  ``keep_one`` chooses by
row: each group keeps exactly one, whatever ids its rows share with others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import in_slices, stage_table

BITS = 64
CHUNK = 4096
EDGE = "a bigint, b bigint"


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles (XXH64); a bit is set if over half of the hashes have it."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()   # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:n - 1] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, "i8")
    stops = ends[shingle - 1:].tolist()
    for at in range(0, n, CHUNK):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[at:at + CHUNK], stops[at:at + CHUNK])], "<u8")
        ones += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp bigint): the fingerprint's 64 bits as a signed long."""
    return with_fingerprint(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), shingle)


def with_fingerprint(rows: DataFrame, shingle: int = 4) -> DataFrame:
    """``rows`` with the last column, the text, replaced by its fingerprint ``fp``."""
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in in_slices(b.column(len(kept)))], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=[*kept, "fp"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("fp", LongType())]))


def covering_masks(radius: int, bits: int = BITS, seed: int = 7) -> list[int]:
    """The 2^(radius+1) - 1 masks of a covering family."""
    rng = np.random.default_rng(seed)
    vec = rng.integers(1, 1 << (radius + 1), bits)
    return [int(sum(1 << i for i in range(bits) if bin(int(vec[i]) & v).count("1") & 1)) for v in range(1, 1 << (radius + 1))]


def block_masks(radius: int, level: int, bits: int = BITS, seed: int = 11) -> list[int]:
    """radius + 1 disjoint masks over all bits (another deal at each level)."""
    order = np.random.default_rng(seed + level).permutation(bits)
    return [int(sum(1 << int(i) for i in part)) for part in np.array_split(order, radius + 1)]


def forest(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph "at most radius bits apart" on distinct values.

    Breadth-first: each value is taken off the open set once, with one
    vectorised comparison, so memory is linear.
    """
    left, right, rest = [], [], x.copy()
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            near = np.bitwise_count(rest ^ here) <= radius
            got = rest[near]
            if len(got):
                left.append(np.full(len(got), here, x.dtype))
                right.append(got)
                queue.extend(got)
                rest = rest[~near]
    if not left:
        return x[:0], x[:0]
    return np.concatenate(left), np.concatenate(right)


def _links_in_sorted(keys: list[str], radius: int, bucket_rows: int | None):
    """mapInArrow body over rows (bucket keys..., fp) sorted by them.

    Emits (a, b, null...) edges; rows of an oversize bucket come out as
    (fp, null, keys...) for the next level.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("big", pa.int64())])

    def out(a, b, big):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()) if b is not None else pa.nulls(len(a), pa.int64()),
                                           pa.array(big, pa.int64()) if big is not None else pa.nulls(len(a), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, spilling = None, [], False   # the bucket that may go on in the next batch

        def finish():
            if spilling or not held:
                return None
            x = np.concatenate(held)
            if len(x) < 2:
                return None
            a, b = forest(x.view("u8"), radius)
            return out(a.view("i8"), b.view("i8"), None) if len(a) else None

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            edges = np.concatenate([[0], cuts, [len(fp)]])
            # buckets of one row that begin and end inside the batch need nothing
            many = np.flatnonzero((np.diff(edges) > 1) | (np.arange(len(edges) - 1) == 0) | (np.arange(len(edges) - 1) == len(edges) - 2))
            done_a, done_b = [], []
            for k in many.tolist():
                i, j = int(edges[k]), int(edges[k + 1])
                if bucket[i] != held_key:
                    if (r := finish()) is not None:
                        yield r
                    held_key, held, spilling = bucket[i], [], False
                if spilling:
                    yield out(fp[i:j], None, bucket[i:j])
                    continue
                held.append(fp[i:j])
                if bucket_rows and sum(map(len, held)) > bucket_rows:
                    x = np.concatenate(held)
                    yield out(x, None, np.full(len(x), held_key))
                    held, spilling = [], True
                elif j < len(fp):
                    x = np.concatenate(held)
                    if len(x) > 1:
                        a, b = forest(x.view("u8"), radius)
                        done_a.append(a.view("i8"))
                        done_b.append(b.view("i8"))
                    held_key, held = None, []
            if done_a and sum(map(len, done_a)):
                yield out(np.concatenate(done_a), np.concatenate(done_b), None)
        if (r := finish()) is not None:
            yield r

    return run


def _masked(masks: list[int], tables, salt) -> F.Column:
    """Bucket number of a row in each table: a hash of (table, carried bucket, masked value)."""
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.explode(F.array(*[F.xxhash64(F.lit(i), salt, F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)]))


def links(fps: DataFrame, radius: int = 4, *, bucket_rows: int = 8192, levels: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components equal those of all pairs within ``radius``.

    ``fps``: one column fp, distinct.  Two buckets may share a hashed number;
    every pair is compared on its full bits, so that only adds comparisons.
    """
    rows = fps.select(_masked(covering_masks(radius), radius, F.lit(0)).alias("bucket"), "fp")
    edges = None
    for level in range(levels + 2):
        pairs_of_parts = level > levels
        dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "fp")
        found = stage_table(dealt.mapInArrow(_links_in_sorted(["bucket"], radius, None if pairs_of_parts else bucket_rows), EDGE + ", big bigint"),
                            "simhash-links")
        own = found.where(F.col("b").isNotNull()).select("a", "b")
        edges = own if edges is None else edges.unionByName(own)
        big = found.where(F.col("big").isNotNull()).select(F.col("a").alias("fp"), "big")
        if pairs_of_parts or big.isEmpty():
            return edges
        if level < levels:
            rows = big.select(_masked(block_masks(radius, level), radius, F.col("big")).alias("bucket"), "fp")
        else:
            rows = part_pairs(big, bucket_rows)


def part_pairs(big: DataFrame, part_rows: int) -> DataFrame:
    """(bucket, fp): each bucket's rows in about ``part_rows`` a part, each part together with every other part of its bucket."""
    parts = big.groupBy("big").agg(F.greatest(F.lit(2), F.ceil(F.count("*") / part_rows)).cast("int").alias("parts"))   # one row a bucket
    own = F.pmod(F.xxhash64(F.lit(77), "fp"), F.col("parts")).cast("int")
    rows = big.join(parts, "big").withColumn("part", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("other <> part")
    return rows.select(F.xxhash64("big", F.least("part", "other"), F.greatest("part", "other")).alias("bucket"), "fp")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for nodes that have an edge.

    Alternating star steps: each node's neighbours are linked to the least one.
    The least neighbour is an aggregate and links are made by a join, so a node
    with very many neighbours is pre-aggregated and its join split.
    """
    now = stage_table(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "cc")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("u"), F.least("m", "hi").alias("m"))
        large = (both.where(F.col("lo") > F.col("hi")).join(least, F.col("hi") == F.col("u"))
                 .select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct())
        large = stage_table(large, "cc")
        low = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "u")
        small = (large.join(low, F.col("hi") == F.col("u"))
                 .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
                 .select("e.hi", "e.lo").where("hi != lo").distinct())
        now = stage_table(small, "cc")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root").unionByName(
                now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        seen = state


def with_root(groups: DataFrame, radius: int = 4, bucket_rows: int = 8192) -> DataFrame:
    """``groups`` (a row for each distinct fp) with ``root``, the least fingerprint that links reach."""
    cc = stage_table(components(links(groups.select("fp"), radius, bucket_rows=bucket_rows)), "simhash-components")
    # a fingerprint without links is its own component
    return (groups.join(cc, groups["fp"] == cc["node"], "left")
            .select(*[groups[c] for c in groups.columns], F.coalesce("root", groups["fp"]).alias("root")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4,
                    bucket_rows: int = 8192) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id that links reach, one row per input row."""
    d = stage_table(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "simhash-fp")
    joined = with_root(stage_table(d.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-groups"), radius, bucket_rows)
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return d.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """Exactly one row of each group: the one least by (doc_id, nulls last; hash of the text; hash of the row).

    Rows are told apart by a key that is written with them (columns starting
    with ``__simhash`` are reserved), so rows that share an id, or have none,
    are each judged by their own text.
    """
    rows = stage_table(docs.withColumn("__simhash_row", F.monotonically_increasing_id()), "simhash-rows")
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]   # maps have no hash
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"),
                     F.xxhash64(*plain).alias("row"), F.col("__simhash_row").alias("key"))
    marked = rows.select(order.alias("first"), F.col(text_col)).select("first.*", text_col)
    d = with_fingerprint(marked.toDF("no_id", "id", "text", "row", "key", "body"), shingle)
    groups = stage_table(d.groupBy("fp").agg(F.min(F.struct("no_id", "id", "text", "row", "key")).alias("first")), "simhash-groups")
    kept = with_root(groups, radius).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("__simhash_row"))
    return rows.join(kept, "__simhash_row", "left_semi").select(*docs.columns)
