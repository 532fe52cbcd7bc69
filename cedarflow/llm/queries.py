"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from cedarflow.llm import chat, decontam, fingerprint, langid, linededup, minhash, packing, pii, tokenbin, urlfilter
from cedarflow.llm.common import read_table


def op1_language_id(spark, sf_dir):
    return langid.langid_report(read_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark, sf_dir):
    return linededup.line_dedup_report(read_table(spark, sf_dir, "documents"))


def op3_pii(spark, sf_dir):
    return pii.pii_report(read_table(spark, sf_dir, "documents"))


def op4_url_filter(spark, sf_dir):
    return urlfilter.judge_urls(read_table(spark, sf_dir, "pages"))


def op5_near_duplicates(spark, sf_dir):
    return minhash.group_near_duplicates(read_table(spark, sf_dir, "documents"), 85)


def op6_fingerprints(spark, sf_dir):
    return fingerprint.fingerprint_report(read_table(spark, sf_dir, "documents"))


def op7_token_files(spark, sf_dir):
    return tokenbin.token_file_report(read_table(spark, sf_dir, "documents"))


def op8_chat_format(spark, sf_dir):
    return chat.chat_report(chat.with_probe(read_table(spark, sf_dir, "conversations")))


def op9_decontamination(spark, sf_dir):
    return decontam.contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("hit_spans")


def op10_packing(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_pii, op4_url_filter, op5_near_duplicates, op6_fingerprints, op7_token_files, op8_chat_format, op9_decontamination, op10_packing)}


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_TEXT = "</s>[INST] ok [/INST]"
_TURN = f"'{chat.TURN}' || er || '{chat.TEXT}' || ex || '{chat.END}'"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(table: str) -> str:
    return f"SELECT *, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"


ORACLES: dict[str, str] = {
    "op9_decontamination": f"""
WITH d AS ({_words("documents")}), b AS ({_words("benchmark")}),
bp AS (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - {decontam.WINDOW} + 2))) AS i FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, least(len(w), {decontam.WINDOW}) AS n, array_to_string(w[i:i + {decontam.WINDOW} - 1], ' ') AS win FROM bp),
sizes AS (SELECT DISTINCT n FROM wins),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM dp CROSS JOIN sizes WHERE i + n - 1 <= len(w)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, wins.item_id FROM dw JOIN wins ON dw.win = wins.win AND dw.n = wins.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op8_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{_TEXT}'
), e AS (SELECT *, {_escaped("r")} AS er, {_escaped("x")} AS ex FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN r = 'assistant' THEN length(x) ELSE 0 END), 0) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN r = 'assistant' THEN x ELSE '' END, '' ORDER BY turn, r, x)) AS loss_sha256,
  CAST(sum(length({_TURN})) AS BIGINT) AS formatted_chars,
  string_agg({_TURN}, '' ORDER BY turn, r, x) AS formatted
FROM e GROUP BY conv_id"""
}
