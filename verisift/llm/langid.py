"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import math
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

#: Bounds of the training sample, for each language: documents, characters of each, characters in all.
SAMPLE_DOCS, SAMPLE_CHARS, TRAIN_CHARS = 256, 1_000, 30_000
#: More labels than this are not languages.
MAX_LANGUAGES = 256
#: Letters with a class of their own; rarer ones share one.
LETTERS = 43
#: Parsing starts afresh after so many characters, so that many stretches are parsed side by side.
LANE = 256
#: Characters that are parsed side by side at most, but for a longer text.
TOGETHER = 2_000_000
PAD, SPACE, DIGIT, SIGN, OTHER = range(5)
_STEP = 28  # bits of a transition's target; phrases that it closes are above
_LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text or ""))


def classes(texts: list[str]) -> np.ndarray:
    """Class of each code point: one for each of the LETTERS most frequent letters of texts, few for all others."""
    out = np.full(sys.maxunicode + 1, SIGN, np.uint8)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            out[i] = OTHER
        elif c.isspace():
            out[i] = SPACE
        elif c.isdigit():
            out[i] = DIGIT
    points, n = np.unique(np.frombuffer("".join(texts).lower().encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)
    letters = [p for _, p in sorted((-k, p) for p, k in zip(points.tolist(), n.tolist()) if out[p] == OTHER)][:LETTERS]
    for k, p in enumerate(letters):
        out[p] = OTHER + 1 + k
    return out


def codes(text: str, lut: np.ndarray) -> np.ndarray:
    return lut[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]


def automaton(seq: np.ndarray, width: int) -> np.ndarray:
    """Suffix automaton of seq as a table state * width + class -> target * width, with the phrases closed above bit _STEP.

    A missing transition ends the phrase; the next phrase starts with the present character, which is a phrase
    itself if it does not occur in seq. PAD leaves every state as it is.
    """
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in seq.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    n = len(nxt)
    out = np.full((n, width), -1, np.int64)
    for s, moves in enumerate(nxt):
        if moves:
            out[s, list(moves)] = list(moves.values())
    root = np.maximum(out[0], 0)
    closed = np.where(out[0] >= 0, 1, 2)[None, :] - (np.arange(n) == 0)[:, None]  # nothing is open at the root
    out = np.where(out >= 0, out * width, root[None, :] * width + (closed << _STEP))
    out[:, PAD] = np.arange(n) * width
    return out.astype(np.int32).reshape(-1)


def phrases(lanes: np.ndarray, moves: np.ndarray, width: int) -> np.ndarray:
    """Phrases in each column of lanes (a row for each position)."""
    n = lanes.shape[1]
    state, at, count, got = np.zeros(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64), np.empty(n, np.int32)
    for row in lanes:
        np.add(state, row, out=at)
        np.take(moves, at, out=got, mode="clip")
        count += got >> _STEP
        np.bitwise_and(got, (1 << _STEP) - 1, out=state)
    return count + (state > 0)


class Model:
    """langs: names; tables: an automaton for each; weights: bits that a phrase costs, log2 of the learned length."""

    def __init__(self, samples: dict[str, str]):
        samples = {k: v for k, v in sorted(samples.items()) if has_letter(v)}
        self.langs = list(samples)
        self.lut = classes(list(samples.values()))
        self.width = OTHER + 1 + LETTERS
        learned = [codes(v[:TRAIN_CHARS], self.lut) for v in samples.values()]
        self.tables = [automaton(s, self.width) for s in learned]
        self.weights = np.array([math.log2(len(s) + 1) for s in learned])

    @classmethod
    def of(cls, parts: dict) -> Model:
        """A model from its parts (vars of another), which need no import to be sent to executors."""
        out = cls.__new__(cls)
        vars(out).update(parts)
        return out

    def bits(self, texts: list[str]) -> np.ndarray:
        """Bits a character of each text in each language: phrases, normalised by both lengths."""
        seqs = [codes(t, self.lut) for t in texts]
        n_lanes = np.array([-(-len(s) // LANE) for s in seqs])
        flat = np.full(int(n_lanes.sum()) * LANE, PAD, np.uint8)
        starts = np.concatenate([[0], np.cumsum(n_lanes)])
        for s, a in zip(seqs, starts[:-1].tolist()):
            flat[a * LANE : a * LANE + len(s)] = s
        lanes = np.ascontiguousarray(flat.reshape(-1, LANE).T)
        sums = [np.add.reduceat(phrases(lanes, t, self.width), starts[:-1]) for t in self.tables]
        return np.array(sums).T * self.weights / np.array([len(s) for s in seqs])[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and 1 - best / second best bits of each text."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        todo = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        while todo:
            part, size = [], 0
            while todo and (not part or size + len(texts[todo[-1]]) <= TOGETHER):
                size += len(texts[todo[-1]])
                part.append(todo.pop())
            for i, b in zip(part, self.bits([texts[i] for i in part])):
                order = np.argsort(b, kind="stable")  # ties: the first name
                best = float(b[order[0]])
                out[i] = (self.langs[order[0]], 1 - best / float(b[order[1]]) if len(order) > 1 and b[order[1]] > 0 else 1.0)
        return out


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, str]:
    """Training text of each label: of every one of SAMPLE_DOCS parts that a hash of the id deals the labelled
    documents into, the document with the smallest hash, of it the first SAMPLE_CHARS characters. Held-out documents
    and those with a null id, text or label are left out."""
    h = F.xxhash64(F.col(id_col).cast("string"))
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    picked = known.select(F.col(lang_col).alias("lang"), h.alias("h")).groupBy("lang", F.pmod("h", F.lit(SAMPLE_DOCS)).alias("part")).agg(F.min("h").alias("h"))
    picked = picked.limit(SAMPLE_DOCS * MAX_LANGUAGES + 1).collect()
    if len(picked) > SAMPLE_DOCS * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    keys = docs.sparkSession.createDataFrame([(r["lang"], r["h"]) for r in picked], "lang string, h long")
    start = known.select(F.col(lang_col).alias("lang"), h.alias("h"), F.substring(text_col, 1, SAMPLE_CHARS).alias("text"))
    texts = start.join(F.broadcast(keys), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    out: dict[str, list] = {}
    for r in sorted(texts, key=lambda r: (r["lang"], r["h"])):
        out.setdefault(r["lang"], [])
        if r["text"] not in out[r["lang"]]:
            out[r["lang"]].append(r["text"])
    return {k: "\n".join(v) for k, v in out.items()}


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    A suffix automaton of labelled text is built for each label. Every whole text is parsed greedily into longest
    matches with each automaton; phrases times log2 of the learned length, by the text's length, estimate the cross
    entropy, and the smallest wins (ties: the first name). score is 1 - best / second best. lang, source and doc_id
    play no part in a prediction.

    Null texts and those without a letter are ``und`` with score 0, and so are all if nothing could be learned. Null
    ids count as not held out and are not learned from. Repeated rows give a row each. The model has a fixed largest
    size and is broadcast.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(vars(Model(sample(docs, id_col, text_col, lang_col))))

    def run(batches):
        own = Model.of(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                langs, scores = zip(*own.predict(part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of docs whose text has a language, with the prediction of identify() in lang_col. Rows that it calls
    ``und`` go, and with languages also those of any other language.

    Null and empty texts go, as they have no letter. A null label is filled and a wrong one replaced; a null id
    changes nothing. Repeated rows stay as often as they came. If nothing could be learned, no text has a language.
    All columns are returned, whatever their names; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(vars(Model(sample(docs, id_col, text_col, lang_col))))
    at, into = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        own = Model.of(model.value)
        for batch in batches:
            langs = [x for x, _ in own.predict(batch.column(at).to_pylist())]
            kept = pa.array([x != UNKNOWN and (languages is None or x in languages) for x in langs], pa.bool_())
            yield batch.set_column(into, batch.schema.field(into), pa.array(langs, batch.schema.field(into).type)).filter(kept)

    return docs.mapInArrow(run, docs.schema)
