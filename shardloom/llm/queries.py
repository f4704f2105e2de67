"""Registered queries of this subpackage: ``QUERIES`` and ``SQL``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, dac, fim, fingerprint, linededup, neardup, packing, quality, suffixdedup, tokencount, toxicity
from ..session import read_table, ship_package
from .common import documents, staged

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode_documents(documents(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN)
    back = bpe.decode_documents(ids.drop("text"), BYTE_RANKS, public_tokenizers.PATTERN)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir), WORD_FILE).drop("text")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read_documents(dac.token_files(documents(spark, sf_dir), WORD_FILE, end_id=1))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = quality.cascade(quality.RULES, quality.measure_rules(docs))
    return quality.judge(docs, rules).drop("text", "rejected_by")


#: A conversation whose texts look like control strings.
CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.union(spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string"))
    formatted = staged(chat.render(chat.fold(chat.log_of_messages(rows))), "chat")
    return chat.digests(chat.read_back(formatted))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), WORD_FILE, end_id=2)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digests(documents(spark, sf_dir))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("lang", "text")
    return collocations.top_phrases(docs)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(documents(spark, sf_dir))


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


QUERIES = {
    f.__name__: _shipped(f)
    for f in (op1_byte_bpe, op2_near_duplicates, op3_toxicity, op4_token_counts, op5_fingerprints, op6_token_files, op7_quality, op8_chat, op9_packing, op10_repeats, op11_line_dedup, op12_collocations, op13_fill_in_middle)
}


def _escaped(column: str) -> str:
    """DuckDB's form of ``chat.escape``."""
    out = f"replace({column}, '\\', '\\b')"
    for s in chat.CONTROL:
        out = f"replace({out}, '{s}', '{chat._LETTER[s[0]] + s[1:]}')"
    return out


_BASE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM words),
by_word AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (regexp_matches(w, '\p{L}')) AS n_alpha FROM word GROUP BY doc_id),
window5 AS (SELECT doc_id, i, w AS w0, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4 FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM window5 WHERE w4 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, w0, w1, w2, w3, w4) > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM again) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM docs),
by_line AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(n_alpha, 0) AS n_alpha, coalesce(n_lines, 0) AS n_lines
  FROM docs LEFT JOIN by_word USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN by_line USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_alpha < 7 * n_words OR (n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines)) AS kept
FROM base"""

_CHAT = f"""
WITH rows AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES {', '.join(str(t) for t in CONTROL_TURNS)}) t(conv_id, turn, role, text)),
said AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS LAST, role, text), '') AS loss,
  sum({len(chat.START) + len(chat.END) + 2} + length(replace({_escaped('role')}, chr(10), '\\n')) + length({_escaped('text')}))::BIGINT AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM said"""

_REPEATS = f"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
starts AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * suffixdedup.LENGTH}) AS s FROM (SELECT doc_id, h, unnest(range(0, n - {suffixdedup.LENGTH - 1})) AS i FROM docs)),
first AS (SELECT s, min(doc_id) AS m FROM starts GROUP BY s),
hits AS (SELECT doc_id, i FROM starts JOIN first USING (s) WHERE m < doc_id),
runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + {suffixdedup.LENGTH})::INTEGER AS new FROM hits)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + {suffixdedup.LENGTH} AS b FROM runs GROUP BY doc_id, run),
parts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM parts JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_LINES = f"""
WITH docs AS (SELECT doc_id, coalesce(doc_id, -9223372036854775808) AS id, string_split(coalesce(text, ''), chr(10)) AS ls, row_number() OVER () AS r FROM documents),
line AS (SELECT r, id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM docs),
keyed AS (SELECT r, id, l, i, translate(trim(l, {_WHITE}), {_LOWER}) AS k FROM line),
often AS (SELECT k, max(id) AS last FROM keyed WHERE length(k) >= {linededup.MIN_CHARS} GROUP BY k HAVING count(DISTINCT id) >= {linededup.MIN_DOCS}),
judged AS (SELECT r, l, i, last IS NOT NULL AND last <> id AS gone FROM keyed LEFT JOIN often USING (k))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged JOIN docs USING (r) GROUP BY r"""

_PHRASES = f"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_LOWER}) AS t FROM documents),
piece AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(s, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS s FROM docs)),
word AS (SELECT lang, p, unnest(ws) AS w1, unnest(range(len(ws))) AS i FROM piece),
run AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM word WINDOW o AS (PARTITION BY p ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS f FROM run GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM run WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM run WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {collocations.MIN_COUNT}),
total AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
cut AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, 1 AS k, c.f AS a, x.f AS l, y.f AS r FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
  WHERE c.f >= {collocations.MIN_COUNT} AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = c.lang AND ((t.w1 = c.w1 AND t.w2 = c.w2) OR (t.w2 = c.w1 AND t.w3 = c.w2)) AND 100 * t.f >= 50 * c.f)
  UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 1, c.f, x.f, y.f FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 2, c.f, x.f, y.f FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3),
scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cut),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM least)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= {collocations.TOP}"""

_MIDDLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM docs),
cut AS (SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) - least(c1, c2) AS m,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {fim.TRANSFORMED} THEN 'plain' WHEN h4 % 100 < {fim.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
made AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, m) AS middle, substr(t, a + m + 1) AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM made"""

#: DuckDB's statements; the other operators need tokenizers, learnt weights or hashes that SQL lacks and are held against plain versions in the tests.
SQL: dict[str, str] = {"op7_quality": _BASE, "op8_chat": _CHAT, "op10_repeats": _REPEATS, "op11_line_dedup": _LINES, "op12_collocations": _PHRASES, "op13_fill_in_middle": _MIDDLE}
