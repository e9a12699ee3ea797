"""Mixture-controlled packing of token sequences by deficit round-robin over source queues."""

from __future__ import annotations

import os
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, small_enough, table

WINDOW = 2_048
END_ID = 1
VOCABULARY = "byte_bpe_50k"
#: Tokens in a bin, the unit that one task packs, on average.
BIN_TOKENS = 1 << 20
#: Bins of a task, on average, at most.
TASK_BINS = 16
#: Parts of a queue for each bin: the queue is dealt out to bins part by part.
CELLS = 8
#: Up to so many parts are broadcast; more are joined by a shuffle.
BROADCAST_CELLS = 500_000
#: Neighbouring rows of a running sum that one task adds up at a time.
RUN_ROWS = 1 << 12
#: Texts are encoded in parts of about so many characters.
PART_CHARS = 1 << 18

#: Characters on which all implementations of the tokenizer's pattern agree; other texts take the slower library.
_COMMON = re.compile(r"[\t\n\r -~\xa1-\xac\xae-ɏΑ-Ωα-ωА-я‐-‧‰-›]*\Z")


class Encoder:
    """Ids of the ``tokenizers`` library with the given vocabulary, without added special tokens.

    Texts of common characters are encoded with the same vocabulary's ranks by ``tiktoken``, which yields the same
    ids in a third of the time.
    """

    def __init__(self, vocabulary: str = VOCABULARY, path=None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path
        self.exact = Tokenizer.from_file(path(f"{vocabulary}.json"))
        with open(path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if "<|" not in text and (text.isprintable() and text.isascii() or _COMMON.match(text)):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")


_TOKENS = "rid long, doc_id long, source string, n long, ids binary"


def tokenize(docs: DataFrame, id_col: str, text_col: str, source_col: str, encoder=Encoder) -> DataFrame:
    """rid, doc_id, source, n, ids (little-endian, 16 or 32 bits each, with END_ID, compressed) of every row."""

    def run(batches):
        encode, squeeze = encoder(), zstandard.ZstdCompressor(1).compress
        for batch in batches:
            start = 0
            texts = [t or "" for t in batch.column(3).to_pylist()]
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= PART_CHARS):
                    size += len(texts[stop])
                    stop += 1
                ids = [np.append(encode(t), np.uint32(END_ID)) for t in texts[start:stop]]
                part = batch.slice(start, stop - start)
                narrow = [x.astype("<u2") if x.max() < 1 << 16 else x for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([len(x) for x in ids], pa.int64()), pa.array([squeeze(x.tobytes()) for x in narrow], pa.binary())],
                    names=["rid", "doc_id", "source", "n", "ids"],
                )
                start = stop

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _TOKENS)


def deal(docs: list[tuple], shares: dict[str, float], owed: dict[str, float], window: int = WINDOW):
    """Pieces (document, start, length, sequence, offset) of one bin, by deficit round-robin.

    docs: (source, tokens) in order. Each turn adds a source's share of a window to its deficit; it then sends
    pieces from the head of its queue as long as the deficit covers them. A piece ends with its document or with the
    window. Deficits stay from window to window; owed is what earlier bins left.
    """
    queues: dict[str, deque] = {}
    for i, (source, n) in enumerate(docs):
        queues.setdefault(source, deque()).append([i, 0, n])
    turns = deque(sorted(queues))
    deficit = {s: owed.get(s, 0.0) for s in queues}
    sequence = used = 0
    while turns:
        active = sum(shares[s] for s in turns)
        # Rounds in which no queue could send anything are skipped at once.
        rounds = min((min(queues[s][0][2], window - used) - deficit[s]) / (shares[s] / active * window) for s in turns)
        if rounds > 1:
            for s in turns:
                deficit[s] += (int(rounds) - 1) * shares[s] / active * window
        for _ in range(len(turns)):
            s = turns[0]
            deficit[s] += shares[s] / active * window
            queue = queues[s]
            while queue:
                head = queue[0]
                n = min(head[2], window - used)
                if deficit[s] < n:
                    break
                yield head[0], head[1], n, sequence, used
                deficit[s] -= n
                used += n
                head[1] += n
                head[2] -= n
                if used == window:
                    sequence, used = sequence + 1, 0
                if not head[2]:
                    queue.popleft()
            if queue:
                turns.rotate(-1)
            else:
                turns.popleft()


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _pack_bin(window: int):
    names = [x.split()[0] for x in _PIECES.split(", ")]
    schema = pa.schema(list(zip(names, [pa.int64()] * 7 + [pa.string()])))

    def run(rows: pa.Table, plan: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        rows = rows.sort_by([("o", "ascending"), ("rid", "ascending")])
        docs, sources, queues, tokens, ids = (rows.column(c).to_pylist() for c in ("doc_id", "source", "queue", "n", "ids"))
        names_ = plan.column("queue").to_pylist()
        shares, owed = (dict(zip(names_, plan.column(c).to_pylist())) for c in ("share", "owed"))
        first = rows.column("b")[0].as_py() << 32
        unpack, out = zstandard.ZstdDecompressor().decompress, [[] for _ in names]
        opened: dict[int, np.ndarray] = {}
        for i, start, n, sequence, offset in deal(list(zip(queues, tokens)), shares, owed, window):
            if i not in opened:
                raw = unpack(ids[i])
                opened[i] = np.frombuffer(raw, f"<u{len(raw) // tokens[i]}")
            piece = opened[i][start : start + n].astype("<u4").tobytes()
            if start + n == tokens[i]:
                del opened[i]
            for x, v in zip(out, (docs[i], start, n, zlib.crc32(piece), tokens[i], first + sequence, offset, sources[i])):
                x.append(v)
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, schema.types)], schema=schema)

    return run


def _before(df: DataFrame, key: str, at: str, value: str, out: str) -> DataFrame:
    """Adds the sum of value over the rows of the same key with a smaller at. Stretches of RUN_ROWS are summed up on
    their own first, so that a key with very many rows is no single task."""
    df = df.withColumn("__run", F.floor(F.col(at) / RUN_ROWS))
    runs = df.groupBy(key, "__run").agg(F.sum(value).alias("__sum"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(key, "__run", F.coalesce(F.sum("__sum").over(earlier(Window.partitionBy(key).orderBy("__run"))), F.lit(0)).alias("__start"))
    inside = F.coalesce(F.sum(value).over(earlier(Window.partitionBy(key, "__run").orderBy(at))), F.lit(0))
    return df.withColumn(out, inside).join(runs, [key, "__run"]).withColumn(out, F.col(out) + F.col("__start")).drop("__run", "__start")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str, float] | None = None, window: int = WINDOW, bin_tokens: int = BIN_TOKENS, encoder=Encoder) -> DataFrame:
    """Pieces of all documents in sequences of window tokens: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, source.

    Every source is a queue, whose documents are in the order of a hash; with weights, sources that have none are
    one queue together. Tokens are written to the shared folder once. Bins are stretches of about bin_tokens tokens
    of what round-robin over all queues would send: a queue's documents go to bins by the tokens before them in the
    queue, divided by the queue's share (its weight, or else its share of the corpus). So every bin holds a part of
    each queue that is not yet empty, in proportion to the shares. A bin then fills its windows by deficit
    round-robin. What a queue lacks or has too much of after all bins before is known from their token counts by
    queue, a running sum in which every token is counted once, and the bin starts with that deficit. Only the last
    sequence of a bin is padded. A hot source is spread over all bins.

    Null texts count as empty: one piece with END_ID. A null source is the source "". Repeated rows and null ids are
    packed like others. Sources without a weight, or with one that is not above 0, get the smallest weight, all of
    them together. Other columns are ignored; an empty table gives no piece.
    """
    spark = docs.sparkSession
    tokens = save(tokenize(docs, id_col, text_col, source_col, encoder), "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-total // bin_tokens))
    bits = (bins * CELLS - 1).bit_length()
    weights = {k: float(w) for k, w in (weights or {}).items() if w > 0}
    queue = F.when(F.col("source").isin(*weights), F.concat(F.lit("="), "source")).otherwise("*") if weights else F.col("source")
    # The hash without its sign; its first bits are the cell.
    tokens = tokens.withColumn("queue", queue).withColumn("o", F.shiftrightunsigned(F.xxhash64("rid"), 1)).withColumn("cell", F.shiftright("o", 63 - bits))
    cells = save(tokens.groupBy("queue", "cell").agg(F.sum("n").alias("s")), "cells")
    sizes = cells.groupBy("queue").agg(F.sum("s").alias("size"))
    if weights:
        sizes = [(r["queue"], r["size"], weights.get(r["queue"][1:], min(weights.values()))) for r in sizes.collect()]  # as many as weights, and one
        all_ = sum(w for _, _, w in sizes)
        shares = spark.createDataFrame([(q, w / all_) for q, _, w in sizes], "queue string, share double")
        # Tokens that round-robin has sent when a queue with share 1 would have sent x.
        sent = lambda x: sum((F.least(F.lit(float(n)), F.lit(w / all_) * x) for _, n, w in sizes), F.lit(0.0))
    else:
        shares, sent = sizes.select("queue", (F.col("size") / total).alias("share")), lambda x: x
    shares = save(shares, "shares")
    cells = _before(cells, "queue", "cell", "s", "before").join(shares, "queue")
    cells = save(cells.withColumn("b", F.least(F.floor(sent(F.col("before") / F.col("share")) / bin_tokens), F.lit(bins - 1))), "dealt")
    sums = cells.groupBy("b", "queue", "share").agg(F.sum("s").alias("s"))
    of_bin = sums.groupBy("b").agg(F.sum("s").alias("t"), F.sum("share").alias("active"))
    lack = save(sums.join(of_bin, "b").select("b", "queue", "share", (F.col("share") / F.col("active") * F.col("t") - F.col("s")).alias("lack")), "lacks")
    plan = _before(lack, "queue", "b", "lack", "owed").select("b", "queue", "share", "owed")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bins // TASK_BINS))
    places = cells.select("queue", "cell", "b")
    places = F.broadcast(places) if small_enough(places, BROADCAST_CELLS) else places
    rows = tokens.join(places, ["queue", "cell"]).select("b", "o", "rid", "doc_id", "source", "queue", "n", "ids")
    return rows.repartition(tasks, "b").groupBy("b").cogroup(plan.repartition(tasks, "b").groupBy("b")).applyInArrow(_pack_bin(window), _PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
