"""Line deduplication by content-defined chunks that overlap, in DataFrame functions.

A run of lines counts if it has ``MIN_RUN`` words or more and is several lines, or
one line of ``LONG_LINE`` words or more.  Words are parted by any white space, and
text without it is judged by its size (``WORD``).  From each line on, and from each line
back, the shortest run that counts is a chunk: both its ends are given by the lines
inside, so lines before or behind shift nothing, and of any run that counts the
chunks inside cover every line.  A run stands elsewhere if and only if its chunks
do.  A chunk's number is a hash rolled over its lines' hashes.  Chunks are counted
by it over the whole corpus; of those that occur again the bytes are compared.  Each
chunk but the first of its kind (smallest doc_id, then text, then place) goes, and
the first stays: where both overlap in one document, only what is behind the first
goes.

Chunks that lie side by side, with boundaries where a rolling hash falls below a
threshold, were tried before and do not give right results: a boundary has to fall
right at a passage's beginning, and a passage of few lines has few places for one.
Measured on planted pairs of passages of 60 words, nothing was removed of 41 % of
those of two lines, 19 % of three, 4 % of four, and of any of 60 lines of one word;
see the README.

Tables are written to the shared folder and deleted as soon as nothing reads them:
the chunks' numbers, those that occur again, the suspected ones by document, and
the first place of each.  Joins are on a chunk's number or on a document's key, never on
pairs, and every side of them is read from a table, so that run-time planning can
split a number or a document that very many rows have.  Each line counts as a word
at least, so a chunk has at most ``MIN_RUN`` lines, and a document at most two chunks
for each line: work is in proportion to the text.

Rows: a null or empty text has nothing to remove and stays as it is; documents
equal in doc_id and text are treated alike (neither is a repetition of the
other); a null doc_id comes before all others; a very long text is cut into lines
and chunks whole; an empty table gives an empty one.  Extra columns are kept;
columns named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarflow.llm.common import discard, materialise, with_own_columns

LONG_LINE = 50
MIN_RUN = 40
#: Scripts without blanks, two code points to a word (Han, kana) or four (Thai, Lao,
#: Myanmar, Khmer); of any other text, up to 24 code points without white space.
PAIRS = r"\u2E80-\u2FDF\u3005-\u3007\u3021-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}"
FOURS = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF"
WORD = rf"[^\s\x{{85}}\p{{Z}}{PAIRS}{FOURS}]{{1,24}}|[{PAIRS}]{{1,2}}|[{FOURS}]{{1,4}}"
#: A chunk's place is its first line times this, and by how many lines it reaches on.
WIDE = 64
KEYS = ("_k1", "_k2")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_in(line: Column) -> Column:
    """A line's words: what white space parts, or so much text without any."""
    return F.greatest(F.lit(1), F.regexp_count(line, F.lit(WORD)))


def reach(ws: Column, i: Column, w: Column, step: int) -> Column:
    """By how many lines the shortest run that counts goes on (``step`` 1) or back
    (-1) from line ``i`` of ``w`` words; null if the text ends before."""
    near, total = F.when(w >= LONG_LINE, 0), w
    for k in (1, 2, 3):
        total = total + F.get(ws, i + k * step)
        near = near.when(total >= MIN_RUN, k)
    far = F.slice(ws, i + 1, MIN_RUN) if step > 0 else F.reverse(F.slice(ws, F.greatest(F.lit(1), i + 2 - MIN_RUN), F.least(i + 1, F.lit(MIN_RUN))))
    # words times WIDE, and lines
    full = lambda acc: acc >= MIN_RUN * WIDE
    run = F.aggregate(far, F.lit(0), lambda acc, x: F.when(full(acc), acc).otherwise(acc + F.least(x, F.lit(MIN_RUN)) * WIDE + 1))
    return near.otherwise(let(run, lambda r: F.when(full(r) & (r % WIDE > 1), r % WIDE - 1)))


def windows_of(lines: Column) -> Column:
    """Structs of number and hash of each window."""

    def found(s: Column) -> Column:
        ws, hs = s["ws"], s["hs"]
        on = F.transform(ws, lambda w, i: i.cast("long") * WIDE + reach(ws, i, w, 1))
        back = F.transform(ws, lambda w, i: let(reach(ws, i, w, -1), lambda r: (i - r).cast("long") * WIDE + r))
        numbers = F.array_distinct(F.filter(F.concat(on, back), lambda c: c.isNotNull()))
        return F.transform(numbers, lambda c: F.struct(c.alias("c"), F.xxhash64(F.slice(hs, first_line(c) + 1, last_line(c) - first_line(c) + 1)).alias("h")))

    return let(F.struct(F.transform(lines, lambda x: words_in(x)).alias("ws"), F.transform(lines, lambda x: F.xxhash64(x)).alias("hs")), found)


def first_line(c: Column) -> Column:
    return F.shiftright(c, WIDE.bit_length() - 1).cast("int")


def last_line(c: Column) -> Column:
    return first_line(c) + (c % WIDE).cast("int")


def body_of(lines: Column, c: Column) -> Column:
    return F.array_join(F.slice(lines, first_line(c) + 1, last_line(c) - first_line(c) + 1), "\n")


def keyed(docs: DataFrame) -> DataFrame:
    """With the two numbers that stand for a document."""
    return docs.withColumns({"_k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")), "_k2": F.xxhash64("text")})


def suspected(docs: DataFrame) -> DataFrame:
    """By document key, ``_suspects``: place and number of the chunks whose numbers
    occur again."""
    rows = docs.filter(F.length("text") > 0).select(*KEYS, F.explode(let(F.split("text", "\n", -1), windows_of)).alias("w")).select(*KEYS, "w.*")
    windows = materialise(rows, "windows")
    again = materialise(windows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "again")
    both = windows.join(again.hint("merge"), "h", "left_semi")
    found = materialise(both.groupBy(*KEYS).agg(F.collect_set(F.struct("c", "h")).alias("_suspects")), "suspects")
    discard(windows)
    discard(again)
    return found


def repeated(docs: DataFrame) -> DataFrame:
    """By document key, the ranges of lines (first, last) to remove."""
    place = F.struct(*KEYS, "c")
    per_doc = suspected(docs)
    suspects = per_doc.select(*KEYS, F.explode("_suspects").alias("x")).select(*KEYS, "x.*")
    bodies = let(F.split("text", "\n", -1), lambda ls: F.transform("_suspects", lambda x: F.struct(x["c"].alias("c"), x["h"].alias("h"), body_of(ls, x["c"]).alias("body"))))
    rows = docs.join(per_doc.hint("merge"), list(KEYS)).select(*KEYS, F.explode(bodies).alias("x")).select(*KEYS, "x.*")
    firsts = materialise(rows.groupBy("h").agg(F.min(place).alias("first"), (F.min("body") != F.max("body")).alias("mixed")), "firsts")
    same = suspects.join(firsts.filter("not mixed").hint("merge"), "h").select(*KEYS, "c", "first")
    if not firsts.filter("mixed").isEmpty():  # different chunks with one number
        mixed = rows.join(firsts.filter("mixed").select("h").hint("merge"), "h")
        own = mixed.groupBy("h", "body").agg(F.min(place).alias("first"))
        same = same.unionByName(mixed.join(own.hint("merge"), ["h", "body"]).select(*KEYS, "c", "first"))
    within = F.struct(*KEYS) == F.struct(*[F.col("first")[k].alias(k) for k in KEYS])
    begin = F.when(within, F.greatest(first_line(F.col("c")), last_line(F.col("first")["c"]) + 1)).otherwise(first_line(F.col("c")))
    gone = same.filter(place != F.col("first")).select(*KEYS, F.struct(begin.alias("a"), last_line(F.col("c")).alias("b")).alias("r"))
    ranges = materialise(gone.groupBy(*KEYS).agg(F.collect_set("r").alias("_ranges")), "ranges")
    discard(per_doc)
    discard(firsts)
    return ranges


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text``, and ``removed_lines``
    (their numbers in the original), ``n_lines`` and ``original_text``."""
    out = docs.drop("removed_lines", "n_lines", "original_text")
    names = [c for c in out.columns if c != "text"]
    rows = keyed(out)
    joined = rows.join(repeated(rows.select(*KEYS, "text")).hint("merge"), list(KEYS), "left")
    lines = F.split("text", "\n", -1)
    gone = F.coalesce(F.sort_array(F.array_distinct(F.flatten(F.transform("_ranges", lambda r: F.sequence(r["a"], r["b"]))))), F.array().cast("array<int>"))
    kept = F.when(F.size("removed_lines") == 0, F.col("text")).otherwise(
        let(lines, lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "removed_lines"), lambda i: F.get(ls, i)), "\n"))
    )
    return joined.withColumn("removed_lines", gone).select(
        *names, kept.alias("text"), "removed_lines", F.when(F.length("text") > 0, F.size(lines)).otherwise(0).alias("n_lines"), F.col("text").alias("original_text")
    )


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, removed (line numbers), text."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"), F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed"), "text")


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines gone and ``n_chars`` counted anew; documents
    of which nothing but white space is left go, others stay."""

    def run(own: DataFrame) -> DataFrame:
        out = dedup_lines(own)
        left = out.filter("size(removed_lines) = 0 or text rlike '\\\\S'")
        if "n_chars" in own.columns:
            kind = own.schema["n_chars"].dataType
            left = left.withColumn("n_chars", F.when(F.size("removed_lines") == 0, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
        return left

    return with_own_columns(docs, run)
