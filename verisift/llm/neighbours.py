"""Nearest neighbours by inner product with collision-counting hashing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, table

K = 20
#: Queries of the registered query: every row whose id is divisible by it.
EVERY = 20
#: Hash functions, i.e. random projections, and how often a vector must collide with the query to be verified.
PROJECTIONS, THRESHOLD = 64, 50
#: Windows widen by this factor from round to round, up to REACH times the distance of the k-th found. A vector at that
#: distance lies in a window with probability 0.84 (a normal variable within 1.4 deviations), and so in THRESHOLD of
#: all with 0.9; nearer ones more often. Another REACH wants another THRESHOLD.
WIDEN, REACH = 1.4, 1.4
#: Share of a block that a window holds on average when collisions are first counted; narrower ones tell nothing.
FIRST_SHARE = 0.15
#: Stretches that a line of projections is cut into.
STRETCHES = 128
#: Queries whose collisions are counted at a time.
TOGETHER = 128
#: Vectors in a block of candidates and in a block of queries. An index is made for each pair of blocks, and every
#: vector is sent once for each block of the other kind.
CANDIDATE_BLOCK, QUERY_BLOCK = 16_384, 8_192
#: Share of the product of two lengths within which sums of the same terms in any order are equal.
ROUNDING = 1e-9
SEED = 20


def _kth(scores: np.ndarray, k: int) -> float:
    """The k-th largest."""
    return float(np.partition(scores, len(scores) - k)[len(scores) - k])


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digit and carry of the sums of three bits."""
    either = a ^ b
    return either ^ c, (a & b) | (either & c)


class Index:
    """Projections of a block's vectors as sets of bits. Vectors are lifted onto a sphere, where the largest inner product
    is the smallest distance.

    Each line of projections is cut into stretches with equally many vectors; before[j, t] has a bit for each vector that
    lies before stretch t of line j. A window, widened to whole stretches, is the difference of two such sets, and the
    collisions of 64 vectors are counted at a time by adders on whole words."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        self.ids, self.vectors, self.longest = ids, vectors, longest
        n = len(ids)
        lift = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
        self.planes = np.random.default_rng(SEED).normal(size=(vectors.shape[1] + 1, PROJECTIONS))
        hashed = (np.column_stack([vectors, lift]) @ self.planes).T.copy()
        values = np.sort(hashed, axis=1)
        self.edges = np.ascontiguousarray(values[:, :: max(1, -(-n // STRETCHES))])
        self.before = np.empty((PROJECTIONS, self.edges.shape[1] + 2, -(-n // 64)), np.uint64)
        #: How many vectors lie before a stretch.
        self.ranks = np.empty(self.before.shape[:2], np.int64)
        stretches = np.arange(self.before.shape[1], dtype=np.uint16)[:, None]
        bits = np.zeros((len(stretches), self.before.shape[2] * 8), np.uint8)
        for j, edges in enumerate(self.edges):
            at = np.searchsorted(edges, hashed[j], side="right").astype(np.uint16)
            bits[:, : -(-n // 8)] = np.packbits(at < stretches, axis=1, bitorder="little")
            self.before[j] = bits.view("<u8")
            self.ranks[j, 0], self.ranks[j, 1:] = 0, np.cumsum(np.bincount(at, minlength=len(stretches) - 1))
        spread = float((values[:, -1] - values[:, 0]).max())
        reach = spread + 2 * float(np.abs(hashed).max()) + longest * float(np.sqrt((self.planes**2).sum(axis=0)).max())
        first = max(spread * K / n / 2, reach * 1e-6)
        #: Half widths of the windows in each round; the last hold everything.
        self.halves = first * WIDEN ** np.arange(max(1, math.ceil(math.log(max(reach, 1e-300) / max(first, 1e-300)) / math.log(WIDEN))) + 1) if reach > 0 else np.array([1.0])
        #: How many vectors have been verified.
        self.verified = 0

    def _reach(self, score: float, size: float) -> float:
        """Half width that vectors with this inner product want."""
        return REACH * math.sqrt(max(0.0, 2 * self.longest**2 - 2 * self.longest * score / size))

    def _ends(self, centres: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """First and last + 1 stretch of windows: 2, projections, queries. halves: one for each query."""
        out = np.empty((2, PROJECTIONS, len(centres)), np.int64)
        lows, highs = (centres - halves[:, None]).T.copy(), (centres + halves[:, None]).T.copy()
        for j, edges in enumerate(self.edges):
            out[0, j] = np.searchsorted(edges, lows[j])  # vectors at the edge itself lie behind it
            out[1, j] = np.searchsorted(edges, highs[j], side="right") + 1
        return out

    def _colliding(self, ends: np.ndarray) -> np.ndarray:
        """Sets of the vectors that lie in THRESHOLD windows of a query or more: queries, words."""
        zero = np.zeros((ends.shape[2], self.before.shape[2]), np.uint64)
        # Sets yet to be added, by the power of 2 that each counts for.
        levels: list[list[np.ndarray]] = [[] for _ in range(PROJECTIONS.bit_length() + 1)]
        for before, first, end in zip(self.before, *ends):
            levels[0].append(before[end] ^ before[first])
            level = 0
            while len(levels[level]) == 3:
                digit, carry = _add(*levels[level])
                levels[level] = [digit]
                level += 1
                levels[level].append(carry)
        for level, sums in enumerate(levels):
            if len(sums) > 1:
                digit, carry = _add(*sums, *[zero] * (3 - len(sums)))
                levels[level] = [digit]
                levels[level + 1].append(carry)
        more, equal = zero, ~zero
        for level in reversed(range(len(levels))):
            digit = levels[level][0] if levels[level] else zero
            if THRESHOLD >> level & 1:
                equal = equal & digit
            else:
                more, equal = more | (equal & digit), equal & ~digit
        return more | equal

    def _rows(self, found: np.ndarray) -> np.ndarray:
        """The vectors in a set."""
        return np.flatnonzero(np.unpackbits(found.astype("<u8", copy=False).view(np.uint8), count=len(self.ids), bitorder="little").view(bool))

    def search(self, queries: np.ndarray, own: list[int], bounds: list[float | None], k: int):
        """For each query the rows and scores of the k nearest found, all if there are no more. own: for each query
        a row that takes no part, or -1. bounds: a score that all wanted have at least, or None."""
        sizes = np.sqrt((queries**2).sum(axis=1))
        centres = (queries * (self.longest / sizes)[:, None]) @ self.planes[:-1]
        done = np.zeros((len(queries), self.before.shape[2]), np.uint64)
        for q, row in enumerate(own):
            if row >= 0:
                done[q, row >> 6] = np.uint64(1) << np.uint64(row & 63)
        wants = [min(k, len(self.ids) - (row >= 0)) for row in own]
        found = self._widening(queries, centres, sizes, done, [q for q, b in enumerate(bounds) if b is None], wants)
        if bounded := [q for q, b in enumerate(bounds) if b is not None]:
            halves = np.array([self._reach(bounds[q], sizes[q]) for q in bounded])
            for q, new in zip(bounded, self._colliding(self._ends(centres[bounded], halves)) & ~done[bounded]):
                found[q] = self._verify(queries[q], new)
        for q, query in enumerate(queries):
            (rows, scores), bound = found[q], bounds[q]
            least = (_kth(scores, wants[q]) if wants[q] else math.inf) if bound is None else bound
            # Equal vectors get equal scores only if each is summed in the same way, as those are that may be wanted.
            rows = rows[~(scores < least - ROUNDING * sizes[q] * self.longest)]
            scores = (self.vectors[rows] * query).sum(axis=1)
            if bound is not None:
                rows, scores = rows[scores >= bound], scores[scores >= bound]
            best = np.lexsort((self.ids[rows], -scores))[:k]
            yield rows[best], scores[best]

    def _verify(self, query: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors in a set, and their scores but for the order of summation."""
        rows = self._rows(found)
        self.verified += len(rows)
        return rows, self.vectors[rows] @ query

    def _widening(self, queries: np.ndarray, centres: np.ndarray, sizes: np.ndarray, done: np.ndarray, active: list[int], wants: list[int]) -> dict:
        """Rows and scores of the active queries, verified while their windows widen. done: sets of those that are not
        looked at (any more)."""
        last, ending = len(self.halves) - 1, set()
        found = {q: (np.empty(0, np.int64), np.empty(0)) for q in active}
        rounds = dict(zip(active, self._first_rounds(centres[active]).tolist()))
        halves = {q: self.halves[r] for q, r in rounds.items()}

        def verify(q, new):
            found[q] = tuple(np.append(*x) for x in zip(found[q], self._verify(queries[q], new)))

        while active:
            colliding = self._colliding(self._ends(centres[active], np.array([halves[q] for q in active]))) & ~done[active]
            done[active] |= colliding
            still = []
            for q, new in zip(active, colliding):
                verify(q, new)
                r, want, scores = rounds[q], wants[q], found[q][1]
                half = self._reach(_kth(scores, want), sizes[q]) if want and len(scores) >= want else math.inf
                if q in ending or half <= halves[q]:
                    continue
                if r == last:
                    verify(q, ~done[q])
                    continue
                if half <= self.halves[r + 1]:  # the last round is as wide as it must be, no wider
                    ending.add(q)
                    halves[q] = half
                else:
                    rounds[q], halves[q] = r + 1, self.halves[r + 1]
                still.append(q)
            active = still
        return found

    def _first_rounds(self, centres: np.ndarray) -> np.ndarray:
        """For each query the first round whose windows hold FIRST_SHARE of the block on average, else the last."""
        low, high = np.zeros(len(centres), np.int64), np.full(len(centres), len(self.halves) - 1)
        lines = np.arange(PROJECTIONS)[:, None]
        while (low < high).any():
            middle = (low + high) // 2
            first, end = self._ends(centres, self.halves[middle])
            enough = (self.ranks[lines, end] - self.ranks[lines, first]).sum(axis=0) >= FIRST_SHARE * len(self.ids) * PROJECTIONS
            low, high = np.where(enough | (low == high), low, middle + 1), np.where(enough, middle, high)
        return low


def _search_block(k: int, longest: float):
    schema = pa.schema([("qrow", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def vectors(t: pa.Table) -> np.ndarray:
        return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def run(cands: pa.Table, queries: pa.Table) -> pa.Table:
        if not cands.num_rows or not queries.num_rows:
            return schema.empty_table()
        at = {r: i for i, r in enumerate(cands.column("rid").to_pylist())}
        index = Index(cands.column("id").to_numpy(), vectors(cands), longest)
        rids, ids, bounds, qs = *(queries.column(c).to_pylist() for c in ("rid", "id", "bound")), vectors(queries)
        out = ([], [], [], [])
        for a in range(0, len(qs), TOGETHER):
            found = index.search(qs[a : a + TOGETHER], [at.get(r, -1) for r in rids[a : a + TOGETHER]], bounds[a : a + TOGETHER], k)
            for rid, qid, (rows, scores) in zip(rids[a:], ids[a:], found):
                out[0].append(np.full(len(rows), rid))
                out[1].append(np.full(len(rows), qid))
                out[2].append(index.ids[rows])
                out[3].append(scores)
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in out], schema=schema)

    return run


def nearest(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query by inner product, ties to the smaller vec_id.

    Vectors are dealt by a hash of the row into blocks of bounded size, each with an index of its own: the block's
    vectors in order along PROJECTIONS random lines. In the block that a query lies in, windows around its projections
    widen step by step; vectors inside at least THRESHOLD of them are verified by their inner product in double
    precision, until the windows reach far enough for the k-th found. Its score bounds what can be among the nearest,
    so that one window for each projection does for every other block, of which only vectors above the bound come
    back, k at most. All windows together hold everything in the end, so that k are found wherever there are k. A
    partial top k precedes the last shuffle.

    Vectors that are null, zero, or hold null or non-finite components take no part, and so do null ids; vectors of
    another length than the query have no inner product with it. Repeated rows are candidates of their own; a query
    excludes its own row alone. Other columns are ignored; an empty table gives an empty result.
    """
    v = F.transform(vector_col, lambda x: x.cast("double"))
    fit = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.monotonically_increasing_id().alias("rid"))
    rows = save(rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fit), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, n_queries, longest = rows.agg(F.count("*"), F.count_if(is_query(F.col("id"))), F.max(norm)).first()
    n_blocks, n_query_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    block = lambda m: F.pmod(F.xxhash64("rid"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = rows.select("id", "v", "rid", F.size("v").alias("dim"), block(n_blocks).alias("cb"))
    queries, found = rows.where(is_query(F.col("id"))), "qrow long, query_id long, vec_id long, score double"
    run = _search_block(k, float(longest or 0))
    keys = ["cb", "dim"]
    home = queries.withColumn("bound", F.lit(None).cast("double"))
    at_home = save(rows.groupBy(*keys).cogroup(home.groupBy(*keys)).applyInArrow(run, found), "at-home")
    all_ = at_home
    if n_blocks > 1:
        bounds = at_home.groupBy(F.col("qrow").alias("rid")).agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
        bounds = queries.withColumnRenamed("cb", "home").join(bounds, "rid", "left")
        dealt = bounds.select("id", "v", "rid", "dim", "home", "bound", block(n_query_blocks).alias("qb"), every(n_blocks).alias("cb")).where("cb <> home").drop("home")
        keys = ["cb", "qb", "dim"]
        cands = rows.select("*", every(n_query_blocks).alias("qb"))
        cands, dealt = cands.toDF(*cands.columns), dealt.toDF(*dealt.columns)  # both come from rows
        all_ = at_home.union(cands.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(run, found))
    rank = F.row_number().over(Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id"))
    return all_.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % EVERY == 0)
