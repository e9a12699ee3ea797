"""License scans: fuzzy search for short notices by pigeonhole seeds and bounded-error matching."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

#: Phrases that are counted exactly, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices that are searched with errors: label and words. Words in braces, names and versions, tell one licence
#: from another: they must be there as they are.
NOTICES = (
    ("apache-2.0", "licensed under the {apache} license version {2 0}"),
    ("apache-2.0", "spdx license identifier {apache 2 0}"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("bsd", "released under the {bsd} license"),
    ("cc-by", "licensed under {cc by 4 0}"),
    ("cc-by", "creative commons {attribution 4 0} international license"),
    ("cc-by-nc", "licensed under {cc by nc 4 0}"),
    ("cc-by-nc", "creative commons {attribution noncommercial}"),
    ("cc-by-sa", "licensed under {cc by sa 4 0}"),
    ("cc-by-sa", "creative commons {attribution sharealike}"),
    ("gpl", "licensed under the {gnu general public} license"),
    ("gpl", "spdx license identifier {gpl 3 0}"),
    ("lgpl", "gnu {lesser general public} license"),
    ("mit", "released under the {mit} license"),
    ("mit", "licensed under the {mit} license"),
    ("mit", "permission is hereby granted free of charge to any person"),
    ("mit", "spdx license identifier {mit}"),
    ("mpl-2.0", "{mozilla} public license version {2 0}"),
    ("public-domain", "released into the {public domain}"),
    ("reserved", "all rights reserved"),
)
_NO_BRACES = str.maketrans("", "", "{}")
#: Words that go on with an SPDX identifier, so that it names another licence.
SPDX_SUFFIXES = ("0", "advertising", "cmu", "enna", "feh", "festival", "khronos", "modern", "nfa", "open", "testregex", "wu")
#: An error (a character inserted, deleted or changed) is allowed for so many characters of a notice,
#: outside of the braces.
CHARS_PER_ERROR = 14

#: ASCII letters in lower case, digits and all bytes over 0x7F stay; other bytes become a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def _pattern(notice: str, k: int) -> regex.Pattern:
    """Best match of whole words with up to k errors outside of the braces."""
    parts = regex.split(r"( ?\{[^}]*\} ?)", notice)  # every second one is in braces
    parts = [regex.escape(x.translate(_NO_BRACES), literal_spaces=True) for x in parts]
    parts = [x if i % 2 or not x else f"(?:{x}){{e<={k}}}" for i, x in enumerate(parts)]
    after = f"(?! (?:{'|'.join(SPDX_SUFFIXES)})(?![^ ]))" if notice.startswith("spdx") else ""
    return regex.compile(f"(?b)(?<![^ ]){''.join(parts)}(?![^ ]){after}")


class Scanner:
    def __init__(self, notices=NOTICES, base=BASE, chars_per_error: int = CHARS_PER_ERROR):
        self.base = [(b" " + b"  ".join(p.encode().split()) + b" ", label) for p, label in base.items()]
        self.notices, self.seeds = [], ahocorasick.Automaton()
        places: dict[str, list] = {}
        for i, (label, notice) in enumerate(notices):
            phrase = notice.translate(_NO_BRACES)
            k = max(1, len(phrase) // chars_per_error)
            # k errors spoil at most k of k + 1 pieces: one is there as it is.
            cuts = [len(phrase) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places.setdefault(phrase[a:b], []).append((i, a))
            self.notices.append((label, len(phrase), k, _pattern(notice, k)))
        for piece, at in places.items():
            self.seeds.add_word(piece, (len(piece), at))
        self.seeds.make_automaton()

    def exact(self, words: list[bytes]) -> list[tuple[str, int]]:
        """Label and first word of each place of a base phrase."""
        joined, found = b" " + b"  ".join(words) + b" ", []
        for phrase, label in self.base:
            at = joined.find(phrase)
            while at >= 0:
                found.append((label, at))
                at = joined.find(phrase, at + 1)
        if not found:
            return []
        starts = np.cumsum([0, *(len(w) + 2 for w in words)])
        return list(zip((x for x, _ in found), np.searchsorted(starts, [at for _, at in found]).tolist()))

    def _matches(self, i: int, text: str, start: int, stop: int):
        """Matches of notice i between start and stop, both at word borders. The best match may lie between others, so
        that both sides of it are searched again."""
        _, length, k, pattern = self.notices[i]
        left = [(start, stop)]
        while left:
            start, stop = left.pop()
            m = pattern.search(text, start, stop) if stop - start >= length - k else None
            if m:
                if sum(m.fuzzy_counts) <= k:
                    yield m
                left += [(start, m.start() - 1), (m.end(), stop)]

    def fuzzy(self, words: list[bytes]) -> list[tuple[str, int, int, int, int]]:
        """Label, start and end (characters of the words joined by one space), errors and notice length of each match.

        Every seed has a window of its own, as long as the notice and its errors; a seed inside a match that was
        found before is passed over, so that the work is in proportion to the seeds.
        """
        text, out = b" ".join(words).decode("utf-8", "replace"), []
        ends: dict[int, int] = {}
        for end, (n, places) in self.seeds.iter(text):
            at = end + 1 - n
            for i, offset in places:
                label, length, k, _ = self.notices[i]
                done = ends.get(i, -1)
                if at < done:
                    continue
                start = max(done, at - offset - k, 0)
                start = text.rfind(" ", 0, start + 1) + 1 if start > done else start
                stop = text.find(" ", at - offset + length + k)
                for m in self._matches(i, text, start, stop if stop >= 0 else len(text)):
                    out.append((label, m.start(), m.end(), sum(m.fuzzy_counts), length))
                    ends[i] = max(ends.get(i, -1), m.end())
        return out

    def scan(self, text: bytes | None) -> dict:
        words = words_of(text)
        exact, fuzzy = self.exact(words), self.fuzzy(words)
        starts = [w for _, w in exact]
        return {
            "n_words": len(words),
            "n_base": len(exact),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted({x for x, _ in exact})),
            "labels": ",".join(sorted({x for x, _ in exact} | {x[0] for x in fuzzy})),
            "score": max([1.0 if exact else 0.0, *(1 - x[3] / x[4] for x in fuzzy)]),
            "spans": [{"label": x[0], "start": x[1], "end": x[2], "errors": x[3]} for x in sorted(fuzzy, key=lambda x: x[1:])],
        }


_FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, end: long, errors: long>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, base=BASE, chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """License notices of every row: doc_id, counts, labels, score and the spans of fuzzy matches.

    Words are runs of ASCII letters (lower-cased), digits and all other characters over 0x7F. Base phrases are
    counted where their words stand consecutively. Notices are searched in the words joined by one space with an
    error for each chars_per_error characters (one at least): a notice is cut into one piece more than errors, an
    Aho-Corasick automaton finds pieces, and windows around them are verified with the regex library's bounded-error
    matching of whole words, which yields the best match and its span; names and versions of licences allow no
    error. Matches of one notice do not overlap, and those on both sides of a better one are found, too. score is 1
    for a base phrase, else the largest share of a notice that matched, else 0.

    Null and empty texts have no words: counts 0, positions null, labels empty. Repeated rows give a row each, null
    ids stay, other columns are ignored; whole texts are scanned and the one pass needs no shuffle.
    """

    def run(batches):
        scanner = Scanner(notices, base, chars_per_error)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = pa.RecordBatch.from_pylist([scanner.scan(t) for t in part.column(1).cast(pa.binary()).to_pylist()], schema=_ARROW)
                yield pa.RecordBatch.from_arrays([part.column(0), *found.columns], names=["doc_id", *found.schema.names])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_FIELDS}")


_ARROW = pa.schema(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
     ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int64())])))]
)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
