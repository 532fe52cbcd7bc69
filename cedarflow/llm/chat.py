"""Chat formatting: layouts recognised by fingerprints of their field paths.

A layout's fingerprint is the hash of its sorted nested field paths
(``messages[].role`` and so on).  A table of declarative mappings, looked up by
fingerprint, says where role and text of each turn are; it covers rows of turns,
message lists, prompt with response, and instruction with input and output.  Paths
that no mapping names are left out of the fingerprint, so further fields do not
matter.  A JSON text's own paths are hashed, row by row, and the hash looked up.

Turns are written as ``<|turn|>role<|text|>text<|end|>``.  Control strings, and
those that other templates use, are broken inside roles and texts by a backslash
behind their first character; backslashes are doubled; so reading a formatted
conversation back gives exactly what went in.  The loss mask holds for each turn
how many code points are passed over and how many are learnt: the texts of
assistant turns.  All of it is DataFrame functions.

Rows: null texts and roles are empty; a null turn number comes first; equal turn
numbers stand in the order of role and text, and repeated rows are all kept;
rows without a conversation's id form one conversation of their own.  A
conversation is put together from blocks of turns, so that a long one is shared
out before its pieces meet; a very long text is escaped whole.  A JSON text that is
null, broken or of no known layout has null turns and a null layout.  An empty table
gives an empty one.  Extra columns are not read by :func:`chat_report` and
:func:`canonical_turns`; :func:`json_turns` keeps them and replaces those named as
its results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this and other templates.
CONTROL = ("<|", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>")
LEARNT = "assistant"
BLOCK = 64

#: Layouts: field paths -> how turns are taken.  ``rows``: a row is a turn;
#: ``list``: an array of turns; ``fields``: a turn for each (role, path) that is
#: not empty, paths of one turn joined by an empty line.
MAPPINGS = {
    ("conv_id", "role", "text", "turn"): ("rows", "conv_id", "turn", "role", "text"),
    ("messages[].content", "messages[].role"): ("list", "messages", "role", "content"),
    ("conversations[].from", "conversations[].value"): ("list", "conversations", "from", "value"),
    ("prompt", "response"): ("fields", ("user", ("prompt",)), ("assistant", ("response",))),
    ("prompt", "completion"): ("fields", ("user", ("prompt",)), ("assistant", ("completion",))),
    ("instruction", "output"): ("fields", ("user", ("instruction",)), ("assistant", ("output",))),
    ("input", "instruction", "output"): ("fields", ("user", ("instruction", "input")), ("assistant", ("output",))),
    ("system", "prompt", "response"): ("fields", ("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
}
#: Names that other data sets give to the same roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """The nested field paths of a type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(field_paths) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(p): m for p, m in MAPPINGS.items()}
KNOWN = sorted({p for field_paths in MAPPINGS for p in field_paths})


def mapping_of(schema: T.StructType, ignored: tuple[str, ...] = ()) -> tuple:
    """The mapping for a schema; columns that are ignored, and paths that no mapping
    names, do not count."""
    found = BY_FINGERPRINT.get(fingerprint(p for p in paths(schema) if p in KNOWN and p.split(".")[0].split("[")[0] not in ignored))
    if found is None:
        raise ValueError(f"no mapping for the fields {', '.join(sorted(paths(schema)))}")
    return found


TURNS = "array<struct<role:string,text:string>>"


def turns_column(mapping: tuple, field: Callable[[str], Column]) -> Column:
    """The turns of a record with one of the ``list`` or ``fields`` layouts."""
    turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if mapping[0] == "list":
        _, name, role, text = mapping
        named = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        out = F.transform(field(name), lambda m: turn(F.coalesce(F.try_element_at(named, F.coalesce(m[role], F.lit(""))), m[role]), m[text]))
    else:
        made = []
        for role, names in mapping[1:]:
            text = F.array_join(F.filter(F.array(*[field(n) for n in names]), lambda x: x.isNotNull() & (x != "")), "\n\n")
            made.append(turn(F.lit(role), text))
        out = F.filter(F.array(*made), lambda t: (t["text"] != "") | (t["role"] != "system"))
    return F.coalesce(out, F.array()).cast(TURNS)


def canonical_turns(df: DataFrame, key: str | None = None) -> DataFrame:
    """``key`` and ``turns`` of records that all have one layout, ``key`` aside."""
    mapping = mapping_of(df.schema, (key,) if key else ())
    if mapping[0] == "rows":
        return conversations(df, *mapping[1:])
    return df.select(*([key] if key else []), turns_column(mapping, lambda n: F.col(f"`{n}`")).alias("turns"))


def _prefixed(prefix: Column, names: Column) -> Column:
    return F.transform(names, lambda k: F.concat(prefix, k))


def json_turns(df: DataFrame, json_col: str) -> DataFrame:
    """``df`` with ``layout`` (a row's fingerprint) and ``turns`` (null where no
    mapping is known) of records given as JSON texts, each in its own layout."""
    jsons = {m: p for p, m in MAPPINGS.items() if m[0] != "rows"}
    lists = sorted(m[1] for m in jsons if m[0] == "list")
    known = [p for p in KNOWN if any(p in field_paths for field_paths in jsons.values())]
    record = F.from_json(json_col, "map<string,string>")
    out = df.withColumn("_record", record).withColumns({f"_list_{n}": F.from_json(F.col("_record")[n], "array<map<string,string>>") for n in lists})
    inner = [_prefixed(F.lit(f"{n}[]."), F.flatten(F.transform(F.filter(f"_list_{n}", lambda m: m.isNotNull()), lambda m: F.map_keys(m)))) for n in lists]
    own = F.concat(F.map_keys("_record"), *[F.coalesce(x, F.array()) for x in inner])
    named = F.filter(F.array_sort(F.array_distinct(own)), lambda p: p.isin(known))
    kinds = F.sha2(F.array_join(named, "\n"), 256)
    turns = F.lit(None).cast(TURNS)
    for mapping, field_paths in jsons.items():
        field = (lambda n: F.col(f"_list_{n}")) if mapping[0] == "list" else (lambda n: F.col("_record")[n])
        turns = F.when(F.col("layout") == fingerprint(field_paths), turns_column(mapping, field)).otherwise(turns)
    out = out.withColumn("layout", F.when(kinds.isin([fingerprint(p) for p in jsons.values()]), kinds)).withColumn("turns", turns)
    return out.drop("_record", *[f"_list_{n}" for n in lists])


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    """A backslash behind < or [ that no backslash follows was put there."""
    return F.replace(F.regexp_replace(text, r"([<\[])\\(?!\\)", "$1"), F.lit("\\\\"), F.lit("\\"))


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), escaped(role), F.lit(TEXT), escaped(text), F.lit(END))


def mask_of(role: Column, text: Column) -> Column:
    """Code points of a formatted turn that are passed over, and then learnt."""
    learnt = F.when(role == LEARNT, F.length(escaped(text))).otherwise(0)
    return F.struct((F.length(escaped(role)) + len(TURN) + len(TEXT)).alias("skip"), learnt.alias("take"))


def conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of turns put together: ``conv``, ``formatted``, ``loss_mask``."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    one = rows.select(
        F.col(conv).alias(conv), F.floor(F.col(turn) / BLOCK).alias("_block"),
        F.struct(F.col(turn).alias("turn"), r.alias("role"), t.alias("text"), format_turn(r, t).alias("formatted"), mask_of(r, t).alias("mask")).alias("_t"),
    )
    blocks = one.groupBy(conv, "_block").agg(F.sort_array(F.collect_list("_t")).alias("ts")).select(
        conv, F.struct("_block", F.array_join(F.transform("ts", lambda x: x["formatted"]), "").alias("formatted"), F.transform("ts", lambda x: x["mask"]).alias("mask")).alias("b")
    )
    whole = blocks.groupBy(conv).agg(F.sort_array(F.collect_list("b")).alias("bs"))
    return whole.select(conv, F.array_join(F.transform("bs", lambda b: b["formatted"]), "").alias("formatted"), F.flatten(F.transform("bs", lambda b: b["mask"])).alias("loss_mask"))


def segments(formatted: Column) -> Column:
    """A formatted conversation's turns, each without its end mark."""
    return F.filter(F.split(formatted, r"<\|end\|>"), lambda s: s != "")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    return F.transform(segments(formatted), lambda s: F.struct(
        unescaped(F.substring_index(F.substr(s, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"),
        unescaped(F.substring_index(s, TEXT, -1)).alias("text")))


def learnt(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.zip_with(segments(formatted), mask, lambda s, m: unescaped(F.substr(s, m["skip"] + 1, m["take"]))), "")


def chat_report(rows: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted text: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    made = canonical_turns(rows.select("conv_id", "turn", "role", "text"))
    turns = read_back(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = made.withColumns({"turns": turns, "learnt": learnt(F.col("formatted"), F.col("loss_mask"))})
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "formatted",
    )


def with_probe(rows: DataFrame) -> DataFrame:
    """The rows and one more conversation, -7, whose texts are control strings."""
    spark: SparkSession = rows.sparkSession
    text = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '{text}' AS text UNION ALL SELECT -7L, 1L, 'assistant', '{text}'")
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)
