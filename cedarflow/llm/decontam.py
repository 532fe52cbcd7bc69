"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised (A-Z lower-cased, words are runs of ASCII letters and
digits or anything beyond ASCII).  A window is 13 consecutive words of a benchmark
item, or the whole item if it is shorter.  The automaton's patterns are an item's
blocks of 7 words, one behind the other from its beginning: every window has one
such block whole.  Where a block occurs in a document, the words on both sides are
compared with the item's; 13 or more that agree in a row are hit.  A block that
stands in more than ``PLACES`` places would be compared with each; its windows are
patterns themselves instead.  So are items of fewer than 13 words.

Words of the benchmark are numbered; a word becomes three characters out of three
disjoint alphabets of 128, so that the automaton has at most 128 branches at a node
and matches can only begin and end at word boundaries.  A document's runs of known
words are scanned once; the matches' word offsets are mapped to code points of the
original.

The benchmark is the one thing sent to every executor.  Blocks make about three
nodes for each of its words, where windows would make 39 (measured with
all that is kept of the items: 30 MB a million bytes of text; by windows 195).  Its size is measured first; beyond
``block_bytes`` of text it is dealt into blocks, each scanned by a job of its own
whose result is written to the shared folder, so that no worker ever holds two.

Rows: a null or empty text has no words and is not contaminated; a null or
empty item has no windows; an item with a null id is one like others, only that
the digest of the items found leaves it out, as the SQL does; repeated documents,
and documents with equal or null ids, are each answered; items with equal texts are
all counted; a very long text is scanned whole; an empty table gives an empty one,
and an empty benchmark no hits.  Extra columns are kept, those named as the results
are replaced, and :func:`drop_contaminated` keeps every column as it came.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cedarflow.llm.common import discard, materialise, small_batches, spread, with_own_columns

WINDOW = 13
#: About 250 MB of automaton and items in a worker.
BLOCK_BYTES = 8 << 20
#: A block of words in more places than these gives way to its windows.
PLACES = 16
BASE = 128
UNKNOWN = "\0\0\0"
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """The normalised words, as UTF-8; split() takes only the blanks that TABLE left."""
    return (text or "").encode("utf-8", "replace").translate(TABLE).split()


def three(n: int) -> str:
    """A word's number as three characters out of three alphabets."""
    return chr(0x1000 + n % BASE) + chr(0x2000 + n // BASE % BASE) + chr(0x3000 + n // BASE // BASE)


class Matcher:
    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.codes: dict[bytes, str] = {}
        self.window = self.shortest = window
        self.items: list[tuple[str | None, list[str]]] = []
        step = (window + 1) // 2  # any window has a whole block of that many words
        places: dict[str, list[tuple[int, int]]] = {}
        whole: dict[str, set[str | None]] = {}
        for item, text in dict.fromkeys(items):
            words = words_of(text)
            if not words:
                continue
            coded = [self.codes.setdefault(w, three(len(self.codes))) for w in words]
            if len(words) < window:
                self.shortest = min(self.shortest, len(words))
                whole.setdefault("".join(coded), set()).add(item)
                continue
            for at in range(0, len(words) - step + 1, step):
                places.setdefault("".join(coded[at : at + step]), []).append((len(self.items), at))
            self.items.append((item, coded))
        for block in [b for b, at in places.items() if len(at) > PLACES]:
            for k, at in places.pop(block):
                item, coded = self.items[k]
                for i in range(max(0, at + step - window), min(at, len(coded) - window) + 1):
                    whole.setdefault("".join(coded[i : i + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for pattern in places.keys() | whole.keys():
            self.automaton.add_word(pattern, (len(pattern) // 3, tuple(places.get(pattern, ())), tuple(whole.get(pattern, ()))))
        self.any = bool(places or whole)
        if self.any:
            self.automaton.make_automaton()
        self.runs = re.compile(f"[^\\0]{{{3 * self.shortest},}}")

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Merged hit ranges of words, and the items that occur."""
        if not self.any or len(words) < self.shortest:
            return [], set()
        get, ranges, items = self.codes.get, [], set()
        coded = "".join([get(w, UNKNOWN) for w in words])
        for run in self.runs.finditer(coded):
            first, text = run.start() // 3, run[0]
            reached: dict[tuple[int, int], int] = {}  # by item and its place against the run's: where words agreed to
            for end, (length, blocks, found) in self.automaton.iter(text):
                last = end // 3 + 1
                if found:
                    ranges.append((first + last - length, first + last))
                    items.update(found)
                for k, at in blocks:
                    start = last - length
                    if reached.get((k, start - at), 0) >= last:
                        continue  # inside words that were compared already
                    item, theirs = self.items[k]
                    a, b = around(text, theirs, start, at, length)
                    reached[(k, start - at)] = b
                    if b - a >= self.window:
                        ranges.append((first + a, first + b))
                        items.add(item)
        return _merge(ranges), items


def around(text: str, theirs: list[str], start: int, at: int, length: int) -> tuple[int, int]:
    """How far the words around ``start`` in a run agree with an item's around ``at``."""
    a, i = start, at
    while a > 0 and i > 0 and text[3 * a - 3 : 3 * a] == theirs[i - 1]:
        a, i = a - 1, i - 1
    b, i, n = start + length, at + length, len(text) // 3
    while b < n and i < len(theirs) and text[3 * b : 3 * b + 3] == theirs[i]:
        b, i = b + 1, i + 1
    return a, b


@lru_cache(maxsize=1)
def matcher(items: tuple[tuple[str | None, str], ...], window: int) -> Matcher:
    return Matcher(list(items), window)


def blocks_of(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in blocks of about ``block_bytes`` each."""
    items = benchmark.select(F.col("item_id").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // block_bytes))
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``hit_words`` (merged ranges of word numbers), ``hit_spans``
    (the same in code points of the original), ``hit_items`` and ``n_words``.

    Clashing columns of these names are replaced.
    """
    spark = docs.sparkSession
    out = docs.drop("hit_words", "hit_spans", "hit_items", "n_words")
    empty = "cast(array() as array<struct<start:int,end:int>>)"
    out = spread(out, "text").withColumns({"hit_words": F.expr(empty), "hit_items": F.expr("cast(array() as array<string>)"), "hit_spans": F.expr(empty), "n_words": F.lit(0).cast("long")})
    schema = out.schema
    blocks, before = blocks_of(benchmark, block_bytes), None
    for number, block in enumerate(blocks):
        held = spark.sparkContext.broadcast(tuple((None if r["item_id"] is None else str(r["item_id"]), r["text"]) for r in block.collect()))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            found = matcher(held.value, window)
            for batch in small_batches(batches, "text"):
                hits, spans, items, counts = [], [], [], []
                earlier = (batch.column("hit_words").to_pylist(), batch.column("hit_items").to_pylist())
                for text, old, old_items in zip(batch.column("text").to_pylist(), *earlier, strict=True):
                    words = words_of(text)
                    ranges, new = found.scan(words)
                    if old:
                        ranges = _merge(ranges + [(r["start"], r["end"]) for r in old])
                    hits.append([{"start": a, "end": b} for a, b in ranges])
                    items.append(sorted(set(old_items) | new, key=lambda x: (x is not None, x)))
                    spans.append(_code_points(text, ranges))
                    counts.append(len(words))
                types = {f.name: f.type for f in batch.schema}
                new_columns = {"hit_words": hits, "hit_items": items, "hit_spans": spans, "n_words": counts}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(new_columns[n], types[n]) if n in new_columns else batch.column(n) for n in batch.schema.names], batch.schema.names
                )

        out = out.mapInArrow(run, schema)
        if number + 1 < len(blocks):
            out = materialise(out, "scanned")
            if before is not None:
                discard(before)
            before = out
    return out


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
    return merged


def _code_points(text: str | None, ranges: list[tuple[int, int]]) -> list[dict]:
    if not ranges:
        return []
    at = [(m.start(), m.end()) for m in WORD.finditer(text)]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges]


def is_contaminated(n_hit, n_words):
    """At least one word, and at least a twentieth of all words, is hit."""
    return (n_hit > 0) & (F.lit(20) * n_hit >= n_words)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, hit words, items found, their digest, the decision."""
    marked = mark_contamination(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda acc, r: acc + (r["end"] - r["start"]))
    return marked.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
        "hit_spans",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns as they came."""
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda acc, r: acc + (r["end"] - r["start"]))
    return with_own_columns(docs, lambda own: mark_contamination(own, benchmark).filter(~is_contaminated(n_hit, F.col("n_words"))))
