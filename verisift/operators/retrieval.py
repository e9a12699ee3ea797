"""BM25 retrieval over stemmed articles, term rarity, and weighted term overlap."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.tables import BROADCAST_ROWS, held, small, with_composed
from ..functions.text import col, content_terms, fold, joined_stems, stems, tokens

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
#: Bytes of stems looked up, sums made, and rows held back before the best are chosen, at a time: bounds of memory.
STRETCH, SUMS, HELD_BACK = 1 << 20, 2_000_000, 100_000
#: Words whose terms a task remembers.
WORDS = 200_000


def postings(articles: DataFrame, keys: list[str], text: str | Column = "text") -> DataFrame:
    """keys, term, tf, doc_len: the stems of each article with their numbers, and its length in stems."""
    rows = with_composed(articles.select(*keys, col(text).alias("__t")), "__t").select(*keys, stems(fold("__t")).alias("__s")).withColumn("doc_len", F.size("__s"))
    return rows.select(*keys, "doc_len", F.explode("__s").alias("term")).groupBy(*keys, "doc_len", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, id_col: str, text: str) -> DataFrame:
    """Distinct stems of over one character of each query: id, qterm."""
    terms = F.array_distinct(F.filter(stems(fold(text)), lambda s: F.length(s) > 1))
    return with_composed(queries, text).select(id_col, F.explode(terms).alias("qterm"))


def _bags(articles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bags array<struct<doc_len, stems>>: a row per key. The stems of an article, joined by blanks, are a bag;
    doc_len is null where it is their number. Rows that share their keys are merged: a bag for each length.

    Only the rows of repeated keys are shuffled; to find these, the keys are.
    """
    rows = with_composed(articles.select(*keys, F.col("text").alias("__t")), "__t").select(*keys, fold("__t").alias("__f"))
    rows = rows.select(*keys, joined_stems("__f").alias("stems"))
    one = F.array(F.struct(F.lit(None).cast("int").alias("doc_len"), "stems"))
    again = articles.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*(F.col(k).alias(f"__{k}") for k in keys))
    if again.isEmpty():
        return rows.select(*keys, one.alias("bags"))
    again = small(held(again))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    many = rows.join(again, same, "left_semi").withColumn("doc_len", F.size(F.array_remove(F.split(F.coalesce("stems", F.lit("")), " "), "")))
    many = many.groupBy(*keys, "doc_len").agg(F.array_join(F.collect_list("stems"), " ").alias("stems"))
    many = many.groupBy(*keys).agg(F.collect_list(F.struct("doc_len", "stems")).alias("bags"))
    return rows.join(again, same, "left_anti").select(*keys, one.alias("bags")).unionByName(many)


def _bags_of_postings(index: DataFrame, keys: list[str]) -> DataFrame:
    """The same of postings()."""
    said = index.select(*keys, F.col("doc_len").cast("int").alias("doc_len"), F.array_join(F.array_repeat("term", F.col("tf").cast("int")), " ").alias("stems"))
    said = said.groupBy(*keys, "doc_len").agg(F.array_join(F.collect_list("stems"), " ").alias("stems"))
    return said.groupBy(*keys).agg(F.collect_list(F.struct("doc_len", "stems")).alias("bags"))


class Prefixes:
    """Query terms by number, looked up as prefixes of the stems in bags."""

    def __init__(self, terms: list[str]):
        self.at = {t: i for i, t in enumerate(terms)}
        self.begun = {t[:n] for t in terms for n in range(1, len(t) + 1)}
        self.met: dict[str, tuple[int, ...]] = {}

    def of(self, word: str) -> tuple[int, ...]:
        """The terms that the word starts with; those of words met before are kept, up to a bound."""
        found, n = [], 1
        while n <= len(word) and (start := word[:n]) in self.begun:
            if start in self.at:
                found.append(self.at[start])
            n += 1
        if len(self.met) >= WORDS:
            self.met.clear()
        if len(word) <= 32:
            self.met[word] = tuple(found)
        return tuple(found)

    def hits(self, batch: pa.RecordBatch):
        """Of stretches of a batch: its first row, the row of each bag, the bags' lengths, and bag, term and tf of the hits."""
        bags = batch.column("bags")
        starts, texts, sizes = bags.offsets.to_numpy(), pc.fill_null(pc.struct_field(bags.values, "stems"), ""), pc.struct_field(bags.values, "doc_len")
        room = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
        row = 0
        while row < len(bags):
            stop = max(row + 1, int(np.searchsorted(room[starts], room[starts[row]] + STRETCH, "right")) - 1)
            stop, a = min(stop, len(bags)), starts[row]
            n = starts[stop] - a
            yield row, np.repeat(np.arange(stop - row), np.diff(starts[row : stop + 1])), *self._hits(texts.slice(a, n), sizes.slice(a, n))
            row = stop

    def _hits(self, texts: pa.Array, sizes: pa.Array):
        words = pc.split_pattern(texts, " ")
        coded = words.flatten().dictionary_encode()
        at, known = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        found = [self.of(w) if (f := self.met.get(w)) is None else f for w in known]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        terms = np.fromiter(chain.from_iterable(found), np.int64, counts.sum())
        bag = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        own = np.bincount(bag[at != pc.index(coded.dictionary, "").as_py()], minlength=len(texts))  # an empty text has no word
        lengths = pc.coalesce(sizes.cast(pa.int64()), pa.array(own, pa.int64())).to_numpy(zero_copy_only=False)
        bag = np.repeat(bag, counts[at])
        term = terms[_stretches((np.cumsum(counts) - counts)[at], counts[at])]
        both, tf = np.unique(bag * max(len(self.at), 1) + term, return_counts=True)
        return lengths, own.sum(), *np.divmod(both, max(len(self.at), 1)), tf


def _stretches(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count says."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _first(number: np.ndarray, place: np.ndarray, score: np.ndarray, keys: pa.Table, most: int):
    """The rows with the most first places of each number by place (falling), then keys; and the least such place of
    the numbers that have so many."""
    order = np.lexsort((-place, number))
    n, p = number[order], place[order]
    heads = np.flatnonzero(np.r_[True, n[1:] != n[:-1]]) if len(n) else np.array([], dtype=np.int64)
    counts = np.diff(np.r_[heads, len(n)])
    full = counts >= most
    last = np.full(len(heads), -np.inf)
    last[full] = p[heads[full] + most - 1]
    bound = np.repeat(last, counts)
    above = np.add.reduceat((p > bound).astype(np.int64), heads) if len(heads) else counts
    tied = order[p == bound]
    rows = [order[p > bound]]
    if len(tied):  # as many as there is room for
        named = keys.take(pa.array(tied)).append_column("__n", pa.array(number[tied]))
        tied = tied[pc.sort_indices(named, sort_keys=[("__n", "ascending"), *((k, "ascending") for k in keys.column_names)], null_placement="at_start").to_numpy()]
        t = number[tied]
        begun = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        nth = np.arange(len(t)) - np.repeat(begun, np.diff(np.r_[begun, len(t)]))
        rows.append(tied[nth < most - above[np.searchsorted(n[heads], t)]])
    return np.concatenate(rows), n[heads[full]], last[full]


def bm25(bags: DataFrame, n_docs: int, queries: DataFrame, keys: list[str], query_id: str, most: int | None, ranked: DataFrame | None = None) -> DataFrame:
    """query id, keys, score of the articles that have a term with one of a query's terms as prefix: of each query the
    most best of each task, by score and keys (None: all). A query term counts all terms of an article that start with
    it; its rarity comes from the number of articles that have any, with a floor for those in half of them or more.

    Articles are read twice, for the rarities and for the scores; a score is made where its article is, so that only
    sums of a task and its best articles are shuffled. queries: query id, qterm, distinct, BROADCAST_ROWS at most or
    of one query. ranked: bags of the articles that compete, if not all do.
    """
    said = queries.toArrow()
    ids, by = said.column(query_id).combine_chunks().dictionary_encode(null_encoding="encode"), said.column("qterm").combine_chunks().dictionary_encode()
    prefixes, n_queries = Prefixes(by.dictionary.to_pylist()), len(ids.dictionary)
    order = np.argsort(by.indices.to_numpy(), kind="stable")
    asked, named = ids.indices.to_numpy()[order].astype(np.int64), ids.dictionary
    per_term = np.bincount(by.indices.to_numpy(), minlength=len(by.dictionary))
    ask_from = np.cumsum(per_term) - per_term

    def count(batches):
        n, total = np.zeros(len(per_term), dtype=np.int64), 0
        for batch in batches:
            for *_, words, _, term, _ in prefixes.hits(batch):
                n += np.bincount(term, minlength=len(n))
                total += words
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.r_[-1, met], pa.int64()), "n": pa.array(np.r_[total, n[met]], pa.int64())})

    counted = dict(bags.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    average = counted.pop(-1, 0) / max(n_docs, 1) or 1.0
    n = np.array([counted.get(i, 0) for i in range(len(per_term))], dtype=float)
    odds = (n_docs - n + 0.5) / (n + 0.5)
    idf = np.where(odds > 1, np.log(np.maximum(odds, 1)), IDF_FLOOR)

    def scores(batches):
        held_back, size, kept, least = [], 0, 0, np.full(n_queries, -np.inf)

        def best():
            number, place, score = (np.concatenate([h[i] for h in held_back]) for i in range(3))
            table = pa.concat_tables([h[3] for h in held_back])
            at, full, bound = _first(number, place, score, table, most)
            least[full] = bound
            return number[at], place[at], score[at], table.take(pa.array(at))

        def out(number, _, score, table):
            for a in range(0, len(number), 10_000):
                part = table.slice(a, 10_000).combine_chunks()
                arrays = [named.take(pa.array(number[a : a + 10_000])), *(c.combine_chunks() for c in part.columns), pa.array(score[a : a + 10_000])]
                yield pa.RecordBatch.from_arrays(arrays, names=[query_id, *keys, "score"])

        for batch in batches:
            names = pa.Table.from_batches([batch.select(keys)])
            for first, row_of, lengths, _, bag, term, tf in prefixes.hits(batch):
                weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[bag] / average))
                row, room = row_of[bag], np.cumsum(per_term[term])
                a = 0
                while a < len(term):  # whole rows, about so many sums at a time
                    b = int(np.searchsorted(room, (room[a - 1] if a else 0) + SUMS, "right"))
                    b = len(term) if b >= len(term) else max(int(np.searchsorted(row, row[b])), int(np.searchsorted(row, row[a], "right")))
                    asks = per_term[term[a:b]]
                    cell = np.repeat((row[a:b] - row[a]) * n_queries, asks) + asked[_stretches(ask_from[term[a:b]], asks)]
                    cells, add = int(row[b - 1] - row[a] + 1) * n_queries, np.repeat(weight[a:b], asks)
                    if cells <= 4 * len(cell):
                        sums = np.bincount(cell, weights=add, minlength=cells)
                        cell = np.flatnonzero(sums)  # every weight is over 0
                        sums = sums[cell]
                    else:
                        cell, back = np.unique(cell, return_inverse=True)
                        sums = np.bincount(back, weights=add)
                    number, place = cell % n_queries, np.round(sums, 9)
                    if most is not None:
                        good = place >= least[number]
                        cell, number, place, sums = cell[good], number[good], place[good], sums[good]
                    if len(cell):
                        held_back.append((number, place, sums, names.take(pa.array(first + row[a] + cell // n_queries))))
                        size += len(cell)
                    a = b
                    if most is None:
                        for h in held_back:
                            yield from out(*h)
                        held_back, size = [], 0
                    elif size > kept + HELD_BACK:
                        held_back = [best()]
                        size = kept = len(held_back[0][0])
        if held_back:
            yield from out(*best())

    fields = [queries.schema[query_id], *(bags.schema[k] for k in keys), StructField("score", DoubleType())]
    return (bags if ranked is None else ranked).mapInArrow(scores, StructType(fields))


def search(articles: DataFrame, instruments: DataFrame, queries: DataFrame, query_id: str, text: str, areas: str | None = None, limit: int = 8, filter_first: bool = False, index: DataFrame | None = None) -> DataFrame:
    """The best articles of each query: query id, instrument_id, article_key, score, rank.

    All stored articles count for the statistics and, unless filter_first, compete for the first 4 * limit places;
    then those of unverified instruments go, and those of instruments with areas that lack the query's (column
    areas of queries). Ties are broken by instrument and article.
    index: postings() of the articles, if they are kept.
    """
    keys = ["instrument_id", "article_key"]
    bags = _bags(articles, keys) if index is None else _bags_of_postings(index, keys)
    allowed = instruments.where("verified").select(F.col("id").alias("instrument_id"), *(["practice_areas"] if areas else []))
    ranked = bags.join(allowed, "instrument_id", "left_semi") if filter_first else None
    most = 4 * limit if not filter_first else None if areas else limit  # areas are looked at below
    terms, n_docs = query_terms(queries, query_id, text).distinct(), articles.count()
    rows, n_queries = terms.agg(F.count("*"), F.count_distinct(query_id)).first()
    parts = max(1, -(-max(rows, n_queries * (most or 1)) // BROADCAST_ROWS))  # each a search of its own: the same scores
    scored = None
    for i in range(parts):
        own = terms.where(F.pmod(F.xxhash64(query_id), F.lit(parts)) == i)
        found = bm25(bags, n_docs, own, keys, query_id, most, ranked)
        scored = found if scored is None else scored.unionByName(found)
    # Equal sums may differ in the last bits by the order of addition.
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), *keys)
    if not filter_first:
        scored = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 4 * limit)
    kept = scored.drop("rank").join(allowed, "instrument_id")
    if areas:
        kept = kept.join(small(queries.select(query_id, F.col(areas).alias("__areas")).distinct()), query_id)
        kept = kept.where((F.size("practice_areas") == 0) | F.col("__areas").isNull() | (F.size("__areas") == 0) | F.arrays_overlap("practice_areas", "__areas"))
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(query_id, *keys, "score", "rank")


def term_idf(articles: DataFrame, text: str | Column = "text") -> DataFrame:
    """Rarity ln((N + 1) / (n + 0.5)) of the stems of words of over two letters: term, df, idf."""
    words = F.filter(tokens(fold("__t")), lambda w: F.length(w) > 2)
    rows = with_composed(articles.select(col(text).alias("__t")), "__t").select(F.explode(F.array_distinct(stems(F.array_join(words, " ")))).alias("term"))
    n = articles.count()
    return rows.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log((F.lit(n) + 1) / (F.col("df") + 0.5)))


def overlap(pairs: DataFrame, idf: DataFrame | None, keys: list[str], claim: str = "claim", article: str = "article") -> DataFrame:
    """pairs with overlap: the share of the claim's terms that the article has, weighted by rarity.

    A term that no article has weighs as much as the rarest; without rarities all weigh the same. 0 for a claim
    without terms. keys identify a pair.
    """
    rows = with_composed(pairs.withColumns({"__c": F.col(claim), "__a": F.col(article)}), "__c", "__a")
    rows = rows.withColumns({"__c": content_terms(fold("__c")), "__a": content_terms(fold("__a"))})
    if idf is None:
        share = F.size(F.array_intersect("__c", "__a")) / F.size("__c")
        return rows.withColumn("overlap", F.when(F.size("__c") > 0, share).otherwise(0.0)).drop("__c", "__a")
    top = idf.agg(F.max("idf")).first()[0]
    terms = rows.select(*keys, F.explode("__c").alias("term"), "__a").select(*keys, "term", F.array_contains("__a", F.col("term")).alias("__in"))
    terms = terms.join(small(idf.select("term", "idf")), "term", "left").withColumn("__w", F.coalesce("idf", F.lit(top), F.lit(1.0)))
    sums = terms.groupBy(*keys).agg((F.sum(F.when(F.col("__in"), F.col("__w")).otherwise(0.0)) / F.sum("__w")).alias("overlap"))
    return pairs.join(sums, keys, "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))


def candidates(found: DataFrame, item: str, term_index: str, keys: list[str], limit: int) -> DataFrame:
    """Hits of several searches for one item: distinct, in the order of the searches and ranks, the first limit."""
    first = found.groupBy(item, *keys).agg(F.min(F.struct(term_index, "rank")).alias("at"))
    order = Window.partitionBy(item).orderBy("at", *keys)
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("at")
