"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop, save, small_enough, table
from .components import connected_components

SHINGLE_WORDS = 3
RADIUS = 2
#: Buckets of up to so many distinct fingerprints are compared inside one task; larger ones are dealt out further.
BUCKET = 4_096


def _bits_over_half(hashes: list[int]) -> int:
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = np.array(hashes[at : at + (1 << 15)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def shingle_fingerprint(text: bytes | None, k: int = SHINGLE_WORDS, seed: int = 42) -> int:
    """SimHash of the k-word shingles, repeats included. Fewer words: the whole sequence; none: 0."""
    words = (text or b"").lower().split()  # of bytes: A-Z and ASCII white space only
    if len(words) < k:
        return _bits_over_half([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [])
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return _bits_over_half([digest(join(s), seed) for s in zip(*(words[i:] for i in range(k)))])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, fingerprint=shingle_fingerprint) -> DataFrame:
    """id, fp (signed 64 bits) of every row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fps = np.array([fingerprint(t) for t in part.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks: for any radius or fewer positions, one of the masks has none of them.

    Every bit position i gets a nonzero vector a(i) of radius + 1 bits; the mask of a nonzero vector v holds the
    positions where <a(i), v> is odd. The vectors of radius positions do not span the space, so that some v is
    orthogonal to all of them. About half of the positions are in a mask; where there are more vectors than
    positions, the vectors are drawn such that the smallest mask is large.
    """
    full = (1 << (radius + 1)) - 1

    def masks(vectors):
        return [sum(1 << i for i, a in enumerate(vectors) if (a & v).bit_count() & 1) for v in range(1, full + 1)]

    if full <= bits:
        return masks([i % full + 1 for i in range(bits)])
    draws = (masks(random.Random(seed).sample(range(1, full + 1), bits)) for seed in range(64))
    return max(draws, key=lambda m: min(x.bit_count() for x in m))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Positions of links within the radius that span each connected part. Every fingerprint is compared with those
    that no link has reached, so that a dense bucket is done in few steps."""
    out, left = [], np.arange(len(fps))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= radius
            if near.any():
                found = left[near].tolist()
                out += [(i, j) for j in found]
                queue += found
                left = left[~near]
    return out


def _bucket_links(radius: int):
    """From rows (fp, keys...) sorted by the keys: the links of each run of equal keys."""

    def links(cols, final):
        """Links of all runs, but for the last one unless final; what is left over."""
        new = np.append(True, np.any([c[1:] != c[:-1] for c in cols[1:]], axis=0))
        starts = np.append(np.flatnonzero(new), len(new))
        stop = len(starts) - 1 if final else len(starts) - 2
        found = []
        for r in (np.flatnonzero(np.diff(starts)[:stop] > 1)).tolist():
            fps = cols[0][starts[r] : starts[r + 1]]
            pairs = np.array(forest(fps.view(np.uint64), radius), dtype=np.int64).reshape(-1, 2)
            found.append(fps[pairs])
        both = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"]), [c[starts[stop] :] for c in cols]

    def run(batches):
        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if len(cols[0]):
                found, held = links([np.concatenate(x) for x in zip(held, cols)] if held else cols, False)
                yield found
        if held:
            yield links(held, True)[0]

    return run


def hamming_links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (points: fp) that connect all that are within the radius of each
    other, directly or over others.

    Each mask of the covering is a table; fingerprints with equal masked bits share a bucket, and every pair within
    the radius shares one in some table. Buckets are counted first, and those with one fingerprint are left out. A
    bucket is compared inside one task and yields the links that span its parts, never all pairs. Buckets with more
    than BUCKET fingerprints are dealt out further, without loss: for radius 2 by common neighbours, as two
    fingerprints within 2 of each other are both within 1 of a third; for others by pairs of blocks of the bucket.
    """
    masks = covering_masks(radius)
    of = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    tables = points.select("fp", F.explode(of).alias("e")).select("e.t", "e.key", "fp")
    counts = save(tables.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = save(tables.join(counts, ["t", "key"]).select("t", "key", "fp", "n"), "candidates")
    small = shared.where(F.col("n") <= BUCKET).select("fp", "t", "key").repartition("t", "key").sortWithinPartitions("t", "key")
    links = small.mapInArrow(_bucket_links(radius), "a long, b long")
    large = shared.where(F.col("n") > BUCKET)
    if not large.isEmpty():
        links = links.union(_by_neighbours(large, masks) if radius == 2 else _by_blocks(large, radius))
    links = save(links.distinct(), "links")
    drop(counts)
    drop(shared)
    return links


def _by_neighbours(large: DataFrame, masks: list[int]) -> DataFrame:
    """Links of large buckets for radius 2. Those within 1 of a common neighbour are linked; there are few of them."""
    flips = [[0, *(_signed(1 << i) for i in range(64) if not m >> i & 1)] for m in masks]
    around = F.coalesce(*[F.when(F.col("t") == t, F.transform(F.lit(f), lambda x: F.col("fp").bitwiseXOR(x.cast("long")))) for t, f in enumerate(flips)])
    groups = large.select("t", "key", "fp", F.explode(around).alias("at")).groupBy("t", "key", "at").agg(F.collect_set("fp").alias("g")).where(F.size("g") > 1)
    return groups.select(F.array_min("g").alias("a"), F.explode("g").alias("b")).where("a <> b")


def _by_blocks(large: DataFrame, radius: int) -> DataFrame:
    """Links of large buckets for any radius: each pair of blocks of a bucket is compared by a task of its own."""
    blocks = F.ceil(F.col("n") * 2 / BUCKET).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    dealt = large.select("fp", "t", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    keys = ["t", "key", "i", "j"]
    dealt = dealt.select("fp", "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_bucket_links(radius), "a long, b long")


def fingerprint_parts(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, part of the distinct fingerprints (points: fp) that have a link: the connected parts."""
    return connected_components(hamming_links(points, radius)).select(F.col("node").alias("fp"), F.col("component").alias("part"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, fingerprint=shingle_fingerprint) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links) of every row.

    Documents with equal fingerprints are one point from the start, however many they are. Null and empty texts have
    fingerprint 0, linked like any other. A row with a null id gets its fingerprint and a null component and links
    nothing; repeated rows give a row each; ids are integers. Whole texts are used, other columns are ignored, and
    an empty table gives an empty result.
    """
    fps = save(fingerprints(docs, id_col, text_col, fingerprint), "fingerprints")
    points = save(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("node"), F.count("*").alias("n")), "points")
    linked = points.join(fingerprint_parts(points.select("fp"), radius), "fp")
    least = save(linked.groupBy("part").agg(F.min("node").alias("component")), "parts")
    linked = save(linked.select("fp", "part"), "linked")
    copies = points.where("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("node").alias("component"))
    # A component for each fingerprint that has a second document or a link; saved, so that a hot one can be split.
    known = save(linked.join(least, "part").select("fp", "component").union(copies), "components")
    out = fps.join(known, "fp", "left")
    return out.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


# -- near copies by similarity ----------------------------------------------------------------------------------------

SIMILARITY, SIMILAR_WORDS = 0.8, 5
#: Radius of the covering over fingerprints of SIMILAR_WORDS-word shingles.
NEAR_RADIUS = 3
#: Up to so many ids are broadcast; more are joined by a shuffle of the texts.
BROADCAST_IDS = 1_000_000
#: Shingles that a task counts at a time, and frequent ones that are known to all tasks. They set the order of
#: shingles in a prefix, which decides how much is compared, never what is found.
COUNT_ROWS, COMMON = 1 << 20, 1 << 19
#: Texts with a shingle in common are compared in one task up to so many; more are dealt out by pairs of blocks.
RUN_ROWS = 4_096
#: Partners of each text in a run that are verified in the first rounds, each time others: parts that these join need
#: no more comparisons. The last round has all that are left.
FIRST_PARTNERS = (2, 16)
#: Bits of a sketch.
SKETCH = 128


def shingle_set(text: bytes | None, k: int = SIMILAR_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words: the whole sequence; none: empty."""
    words = (text or b"").lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < k:
        return np.array([digest(join(words))] if words else [], dtype=np.uint64)
    return np.unique(np.array([digest(join(s)) for s in zip(*(words[i:] for i in range(k)))], dtype=np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH bits, each the parity of the number of elements that fall on it. Elements that two sets share cancel
    out, so that sketches differ in no more bits than the sets in elements."""
    odd = np.bincount((hashes % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _set_name(hashes: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(hashes.tobytes()))


def _texts(batches, column: int = 1, rows: int = 512):
    """Slices of batches and the shingle sets of the texts in a column."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, [shingle_set(t) for t in part.column(column).cast(pa.binary()).to_pylist()]


_SETS = "id long, hash long, node long, fp long, n int, s0 long, s1 long, token long, m long"


def shingle_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, hash (of the text), node (hash of the shingle set), its fingerprint fp, size n and sketch s0, s1 of each
    row; and rows with token and m, shingles that m of the different sets of a task hold, if more than one."""
    schema = pa.schema([(x.split()[0], pa.int32() if x.endswith("int") else pa.int64()) for x in _SETS.split(", ")])

    def counted(held):
        found, m = np.unique(np.concatenate(list(held.values())), return_counts=True)
        found, m = found[m > 1].view(np.int64), m[m > 1].astype(np.int64)
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(m), t) for t in schema.types[:-2]), pa.array(found), pa.array(m)], schema=schema)

    def run(batches):
        held, size = {}, 0
        for part, sets in _texts(batches, 2):
            nodes = [_set_name(s) for s in sets]
            sketches = np.array([sketch(s) for s in sets], dtype=np.int64).reshape(-1, 2)
            fps = np.array([_bits_over_half(s) for s in sets], dtype=np.uint64).view(np.int64)
            none = pa.nulls(len(nodes), pa.int64())
            cols = [part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(fps), pa.array([len(s) for s in sets], pa.int32()), pa.array(sketches[:, 0]), pa.array(sketches[:, 1]), none, none]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)
            for node, s in zip(nodes, sets):
                if node not in held:
                    held[node] = s
                    size += len(s)
            if size > COUNT_ROWS:
                yield counted(held)
                held, size = {}, 0
        if held:
            yield counted(held)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col)).mapInArrow(run, _SETS)


def _prefixes(common):
    """From rows (node, text): the first shingles of each set, rarest first, so many that two sets of the similarity
    share one at least. rest: size of the set from that shingle on."""

    def run(batches):
        tokens, classes = common.value
        for _, sets in _texts(batches):
            out = []
            for s in sets:
                n = len(s)
                if not n:
                    continue
                at = np.minimum(np.searchsorted(tokens, s), max(len(tokens) - 1, 0))
                often = np.where(tokens[at] == s, classes[at], 0) if len(tokens) else np.zeros(n, np.uint8)
                first = s[np.argsort(often, kind="stable")[: n - (4 * n + 4) // 5 + 1]]
                out.append((first.view(np.int64), np.full(len(first), _set_name(s)), n - np.arange(len(first))))
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.int32))], names=["token", "node", "rest"])

    return run


def _runs(keys: int, take):
    """Calls take(columns, starts) with whole runs of rows that are equal in the first columns, by which they are sorted."""

    def cut(cols, final):
        new = np.append(True, np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0))
        starts = np.append(np.flatnonzero(new), len(new))
        stop = len(starts) - 1 if final else len(starts) - 2
        at = int(starts[stop])
        return take([c[:at] for c in cols], starts[: stop + 1]), [c[at:] for c in cols]

    def run(batches):
        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if len(cols[0]):
                found, held = cut([np.concatenate(x) for x in zip(held, cols)] if held else cols, False)
                yield found
        if held and len(held[0]):
            yield cut(held, True)[0]

    return run


def _shared(cols, starts):
    """Of rows (token, node, rest) those whose token another set has too, and how many sets have it."""
    token, node = cols[:2]
    once = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))[: len(token)]  # a repeated id gives its rows twice
    sizes = np.add.reduceat(once.astype(np.int32), starts[:-1]) if len(starts) > 1 else np.empty(0, np.int32)
    sizes = np.repeat(sizes, np.diff(starts)).astype(np.int32)
    kept = once & (sizes > 1)
    return pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (*cols, sizes)], names=["token", "node", "rest", "m"])


def _partners(most: int | None, turn: int):
    """From runs of rows (token, i, j, node, rest, n, s0, s1, part): pairs (a, b) of nodes of different parts that may
    be as similar as SIMILARITY. With most, each node has so many partners at most, others in another turn, and runs
    where a node has more come as rows with token, i, j: only they have anything left for later rounds."""

    def take(cols, starts):
        node, rest, n, s0, s1, part = cols[3:]
        n, rest, s0, s1 = n.astype(np.int64), rest.astype(np.int64), s0.view(np.uint64), s1.view(np.uint64)
        a, b, left = [], [], []
        for r in np.flatnonzero(np.diff(starts) > 1).tolist():
            lo, hi = int(starts[r]), int(starts[r + 1])
            more = False
            own = part[lo:hi]
            if (own == own[0]).all():
                continue
            names, where, sizes = np.unique(own, return_inverse=True, return_counts=True)
            large = where == int(np.argmax(sizes))  # nodes of the largest part are only compared with others
            for k in np.flatnonzero(~large).tolist():
                x = lo + k
                may = own != own[k]
                may[k:] &= large[k:]
                # Half of the sizes less the differing bits bounds what two sets share; so does what follows the first shingle that both have.
                may &= 9 * (np.bitwise_count(s0[lo:hi] ^ s0[x]).astype(np.int64) + np.bitwise_count(s1[lo:hi] ^ s1[x])) <= n[lo:hi] + n[x]
                may &= 9 * np.minimum(rest[lo:hi], rest[x]) >= 4 * (n[lo:hi] + n[x])
                found = np.flatnonzero(may)
                if most is not None and len(found) > most:
                    more = True
                    found = np.roll(found, -(int(node[x]) * (2 * turn + 1) % len(found)))[:most]
                found += lo
                if len(found):
                    a.append(np.minimum(node[found], node[x])), b.append(np.maximum(node[found], node[x]))
            if more:
                left.append(lo)
        pairs = [pa.array(np.concatenate(x)) if x else pa.array([], pa.int64()) for x in (a, b)]
        runs = [pa.array(c[left]) for c in cols[:3]]
        none = [pa.nulls(len(pairs[0]), c.type) for c in runs]
        more = [pa.nulls(len(left), pa.int64())] * 2
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip([*pairs, *none], [*more, *runs])], names=["a", "b", "token", "i", "j"])

    return _runs(3, take)


def _some(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids


def verified(pairs: DataFrame, sets_of) -> DataFrame:
    """Pairs (a, b) of nodes whose sets have a similarity of SIMILARITY or more. sets_of gives the sets (node, hashes)
    of a table of nodes: those that a pair names."""
    named = save(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "named")
    sets = save(sets_of(named), "sets")
    of = lambda c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"s{c}"))

    def run(batches):
        for batch in batches:
            a, b, sa, sb = (c.to_pylist() for c in batch.columns)
            kept = [i for i in range(len(a)) if similarity(np.frombuffer(sa[i], np.uint64), np.frombuffer(sb[i], np.uint64)) >= SIMILARITY]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in kept], pa.int64()) for x in (a, b)], names=["a", "b"])

    found = save(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "verified")
    drop(sets)
    return found


def _covered(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are equal or linked by the covering."""
    points = save(nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("node")), "covered")
    same = nodes.where("n > 0").select("fp", F.col("node").alias("b")).join(points.select("fp", F.col("node").alias("a")), "fp").where("a < b").select("a", "b")
    of = lambda c, node: points.select(F.col("fp").alias(c), F.col("node").alias(node))
    linked = hamming_links(points.select("fp"), NEAR_RADIUS).join(of("a", "x"), "a").join(of("b", "y"), "b")
    return same.union(linked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, hash and first of every row: first is the (no_id, id, hash) that comes first in the row's group."""
    spark = docs.sparkSession
    rows = save(shingle_sets(docs, id_col, text_col), "shingle-sets")
    often = save(rows.where("token is not null").groupBy("token").agg(F.sum("m").alias("m")).withColumn("c", F.floor(F.log2("m"))), "often")
    # Whole classes of frequency, the highest ones first, as many as fit: nothing is sorted at the driver.
    least, known = 64, 0
    for c, n in sorted(map(tuple, often.groupBy("c").count().collect()), reverse=True):
        if known + n > COMMON:
            break
        least, known = c, known + n
    often = often.where(F.col("c") >= least).select("token", "m").toArrow()
    tokens, m = (often.column(c).to_numpy() for c in ("token", "m"))
    order = np.argsort(tokens.view(np.uint64))
    common = spark.sparkContext.broadcast((tokens.view(np.uint64)[order], np.log2(m[order]).astype(np.uint8)))
    rows = rows.where("token is null")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "hash"))
    nodes = save(rows.groupBy("node").agg(first.alias("first"), *(F.min(c).alias(c) for c in ("fp", "n", "s0", "s1"))), "nodes")

    def texts(which):
        """node and a text of each of the nodes; rows that repeat a node's id and text give it again."""
        key = which.select("node", F.col("first.id").alias("__id"), F.col("first.hash").alias("__hash"))
        found = docs.select(F.col(id_col).cast("long").alias("__i"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).alias("__text"))
        return found.join(_some(key), (F.col("__i").eqNullSafe(F.col("__id"))) & (found["__hash"] == key["__hash"])).select("node", "__text")

    def whole(batches):
        for part, sets in _texts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "hashes"])

    prefixes = texts(nodes).mapInArrow(_prefixes(common), "token long, node long, rest int")
    shared = prefixes.repartition("token").sortWithinPartitions("token", "node").mapInArrow(_runs(1, _shared), "token long, node long, rest int, m int")
    shared = save(shared, "shared")
    covered = save(_covered(nodes), "pairs")
    sets_of = lambda named: texts(nodes.join(_some(named), "node", "left_semi")).mapInArrow(whole, "node long, hashes binary")
    blocks = F.when(F.col("m") > RUN_ROWS, F.ceil(F.col("m") * 2 / RUN_ROWS)).otherwise(1).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = shared.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "rest")

    common.destroy()
    placed = nodes.withColumn("part", F.col("node"))
    pairs, tried, done = covered, None, False
    for turn, most in enumerate((*FIRST_PARTNERS, None, 0)):
        tried = tried.union(pairs) if tried else pairs
        found = verified(pairs, sets_of)
        if not found.isEmpty():  # links between parts join them
            of = lambda c: placed.select(F.col("node").alias(c), F.col("part").alias(f"p{c}"))  # noqa: E731, B023
            wider = connected_components(found.join(of("a"), "a").join(of("b"), "b").select("pa", "pb"), "pa", "pb")
            placed = placed.join(wider.select(F.col("node").alias("part"), "component"), "part", "left")
            placed = save(placed.withColumn("part", F.coalesce("component", "part")).drop("component"), "placed")
        if most == 0 or done:
            break
        runs = dealt.join(placed.select("node", "n", "s0", "s1", "part"), "node").select("token", "i", "j", "node", "rest", "n", "s0", "s1", "part")
        runs = runs.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "node")
        met = save(runs.mapInArrow(_partners(most, turn), "a long, b long, token long, i int, j int"), "partners")
        pairs = save(met.where("a is not null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        left = met.where("a is null").select("token", "i", "j")
        dealt = dealt.join(_some(left), ["token", "i", "j"], "left_semi")
        done = left.isEmpty()
    named = save(placed.join(placed.groupBy("part").agg(F.min("first").alias("of_part")), "part").select("node", "of_part"), "named")
    return rows.join(named, "node").select("id", "hash", F.col("of_part").alias("first"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id of every row: documents linked, directly or over others, by a Jaccard similarity of
    SIMILARITY or more of their SIMILAR_WORDS-word shingles. No link is missed. component_id is the smallest id of
    the group (null if it has none); null ids are compared like others.

    Documents with equal shingle sets are one node. The covering links nodes whose fingerprints differ in NEAR_RADIUS
    bits or fewer, and these links are verified exactly. Fingerprints of sets with a similarity of 0.8 differ in about
    10 bits, more than any covering with a bearable number of tables can reach, so that a second search makes the
    result whole: two sets of size n and more share one of the first n - ceil(0.8 n) + 1 shingles of each, in any
    order that is the same for all; here frequent shingles, as far as tasks have counted them, come last. Nodes that
    share such a shingle are compared exactly, but for those whose sizes, sketches or places of the shingle rule the
    similarity out and those that earlier links have joined, over whatever others. Each node is first compared with a
    few partners of a run of equal shingles, then with all that are left.

    Null and empty texts are one group. Other columns are ignored; an empty table gives an empty result.
    """
    return _groups(docs, id_col, text_col).select(F.col("id").alias("doc_id"), F.col("first.id").alias("component_id"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each of similar_groups: the one with the smallest id (null ids come last, then the
    smaller hash of the text decides), a repeated row once. Rows of one id with different texts are rows of their own.
    """
    rows = _groups(docs, id_col, text_col)
    kinds = rows.groupBy(F.col("id").alias("__id"), F.col("hash").alias("__hash")).agg(F.min("first").alias("first"), F.count("*").alias("n"))
    stays = F.col("first.id").eqNullSafe(F.col("__id")) & (F.col("first.hash") == F.col("__hash"))
    kinds = save(kinds.select("__id", "__hash", stays.alias("keep"), "n").where("not keep or n > 1"), "kinds")
    same = lambda k: F.col(id_col).cast("long").eqNullSafe(k["__id"]) & (F.xxhash64(text_col) == k["__hash"])
    gone, again = _some(kinds.where("not keep")), kinds.where("keep")
    out = docs.join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return out
    again = _some(again)
    once = out.withColumn("__key", F.xxhash64(text_col)).join(again, same(again), "left_semi").dropDuplicates([id_col, "__key"]).drop("__key")
    return out.join(again, same(again), "left_anti").union(once)
