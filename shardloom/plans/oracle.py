"""Independent DuckDB statements for the registered queries (the correctness
gate).  They recompute everything from the raw tables at token level (one
row per token), the plain definition of the stream that the Spark operators
avoid materialising."""

from __future__ import annotations

from .. import config as C
from . import queries as Q

S = Q.SHARD_TOKENS
T = Q.SEQ_T
EOT = C.WORD_EOT_ID
CAP = C.WORD_CAP
V = C.WORD_VOCAB_SIZE
W_TEL, A_TEL = Q.TEL.W, Q.TEL.A


def _split(col: str) -> str:
    a, b = Q.RATIO.training, Q.RATIO.training + Q.RATIO.validation
    return (f"CASE WHEN {col} % 10 < {a} THEN 'training' "
            f"WHEN {col} % 10 < {b} THEN 'validation' ELSE 'testing' END")


DOCS = "docs AS (SELECT 0::INTEGER AS source_ord, doc_id AS doc_ord, text FROM documents)"

PAIRS = """pairs AS (
  SELECT u.conv_id * 65536 + u.turn AS doc_ord, u.text AS instruction, a.text AS output
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def dtok(src: str = "docs") -> str:
    """Token ids of every document: words by rank, others spelled in bytes."""
    return f"""wtok AS (
  SELECT w.source_ord, w.doc_ord, w.i, {SPELL} AS ts FROM (
    SELECT source_ord, doc_ord, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i, unnest(string_split(text, ' ')) AS word
    FROM {src}) w LEFT JOIN vocab v USING (word)),
dtok AS (SELECT source_ord, doc_ord, list_concat([{EOT}], flatten(list(ts ORDER BY i))) AS ids FROM wtok GROUP BY source_ord, doc_ord)"""


def offs(src: str = "docs") -> str:
    return f"""{VOCAB}, {dtok(src)}, offs AS (
  SELECT source_ord, doc_ord, n,
         (sum(n) OVER (ORDER BY source_ord, doc_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n)::BIGINT AS g
  FROM (SELECT source_ord, doc_ord, len(ids)::BIGINT AS n FROM dtok))"""


def man(data_name: str = Q.DATA_NAME, shard: int = S) -> str:
    return f"""spans AS (
  SELECT doc_ord, g, n, unnest(range(g // {shard}, (g + n - 1) // {shard} + 1)) AS shard_id FROM offs),
man AS (
  SELECT '{data_name}' AS data_name, shard_id, printf('%s_%06d', '{data_name}', shard_id) AS shard_name,
         sum(least(g + n, (shard_id + 1) * {shard}) - greatest(g, shard_id * {shard}))::BIGINT AS n_tokens,
         count(*)::BIGINT AS n_docs,
         {_split('shard_id')} AS split
  FROM spans GROUP BY shard_id),
mani AS (SELECT *, shard_name || '_' || split AS file_name FROM man)"""


VOCAB = f"""words AS (SELECT unnest(string_split(text, ' ')) AS word FROM docs),
vocab AS (
  SELECT row_number() OVER (ORDER BY cnt DESC, word)::INTEGER AS id, word, cnt::BIGINT AS count
  FROM (SELECT word, count(*) AS cnt FROM words GROUP BY word)
  QUALIFY row_number() OVER (ORDER BY cnt DESC, word) <= {CAP})"""

# ids of one word: its rank, or 0 and its UTF-8 bytes
SPELL = f"""CASE WHEN v.id IS NOT NULL THEN [v.id] ELSE list_concat([0], list_transform(
    range(0, strlen(w.word)), lambda k: {EOT + 1} + ('0x' || substr(hex(encode(w.word)), 2 * k + 1, 2))::INTEGER)) END"""

TOKS = f"""toks AS (
  SELECT d.source_ord, d.doc_ord, o.g, unnest(range(0, len(d.ids))) AS i, unnest(d.ids) AS tok
  FROM dtok d JOIN offs o USING (source_ord, doc_ord)),
stream AS (
  SELECT source_ord, doc_ord, (g + i) // {S} AS shard_id, (g + i) % {S} AS pos, tok FROM toks),
slen AS (SELECT shard_id, count(*) AS L FROM stream GROUP BY shard_id)"""


def pairs_at(n: int) -> str:
    return f"""tpairs AS (
  SELECT {_split('s1.shard_id')} AS split, s1.shard_id, s1.pos, s1.tok AS a, s2.tok AS b
  FROM stream s1 JOIN stream s2 ON s2.shard_id = s1.shard_id AND s2.pos = s1.pos + {n}
  JOIN slen ON slen.shard_id = s1.shard_id
  WHERE (s1.pos // {T}) * {T} + {T} + {n} <= slen.L)"""


def counts_at(n: int) -> str:
    return f"""{pairs_at(n)},
counts AS (SELECT a, b, count(*)::BIGINT AS c FROM tpairs WHERE split = 'training' GROUP BY a, b),
ctx AS (SELECT a, sum(c)::BIGINT AS ca FROM counts GROUP BY a),
topk AS (SELECT a, row_number() OVER (PARTITION BY a ORDER BY c DESC, b)::INTEGER AS rnk, b, c FROM counts
         QUALIFY rnk <= {C.TOP_K}),
backoff AS (SELECT row_number() OVER (ORDER BY c DESC, b)::INTEGER AS rnk, b, c FROM
            (SELECT b, sum(c)::BIGINT AS c FROM counts GROUP BY b) QUALIFY rnk <= {C.TOP_K})"""


COUNTS = counts_at(Q.LM_N)
CORPUS = f"WITH {DOCS}, {offs()}, {TOKS}"

PROMPTS = f"""ptoks AS (
  SELECT item_id, flatten(list(ts ORDER BY i)) AS tokens FROM (
    SELECT item_id, w.i, {SPELL} AS ts FROM (
      SELECT item_id, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i,
             unnest(string_split(text, ' ')) AS word FROM benchmark) w
    LEFT JOIN vocab v USING (word)) GROUP BY item_id)"""

TEL = f"""ev AS (
  SELECT event_type AS run, ts, value AS loss,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i,
         count(*) OVER (PARTITION BY event_type) AS cnt FROM events),
tel AS (
  SELECT run, i // {W_TEL * A_TEL} AS step, (i // {W_TEL}) % {A_TEL} AS micro_step, i % {W_TEL} AS rank, loss, ts
  FROM ev WHERE i < (cnt // {W_TEL * A_TEL}) * {W_TEL * A_TEL}),
per_rank AS (SELECT run, step, rank, sum(loss / {float(A_TEL)}) AS loss FROM tel GROUP BY ALL),
sloss AS (SELECT run, step, avg(loss) AS loss FROM per_rank GROUP BY ALL),
dur AS (SELECT run, step, min(ts) AS t0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0 AS dt_ms
        FROM tel GROUP BY ALL),
lens AS (SELECT run, max(step) + 1 AS max_steps FROM tel GROUP BY run),
steps AS (
  SELECT s.run, s.step, s.loss, d.dt_ms,
         CASE WHEN d.dt_ms / 1000.0 > 0 THEN {float(Q.TEL.B * Q.TEL.T * Q.TEL.A * Q.TEL.W)} / (d.dt_ms / 1000.0) END AS tok_per_sec,
         l.max_steps,
         CASE WHEN s.step < {Q.TEL.warmup_steps} THEN {Q.TEL.max_lr!r} * (s.step + 1.0) / {float(Q.TEL.warmup_steps)}
              WHEN s.step > l.max_steps THEN {Q.TEL.min_lr!r}
              ELSE {Q.TEL.min_lr!r} + 0.5 * (1.0 + cos(pi() * (s.step - {float(Q.TEL.warmup_steps)}) / (l.max_steps - {float(Q.TEL.warmup_steps)}))) * ({Q.TEL.max_lr!r} - {Q.TEL.min_lr!r}) END AS lr,
         CASE WHEN (s.step + 1) / l.max_steps::DOUBLE < 1.0 / 3 THEN 1
              WHEN (s.step + 1) / l.max_steps::DOUBLE < 2.0 / 3 THEN 2 ELSE 3 END AS stage
  FROM sloss s JOIN dur d USING (run, step) JOIN lens l USING (run))"""

LOG_LINE = ("printf('step %5d | loss: %.6f | lr %.4e | norm: nan | dt: %.2fms | tok/sec: %.2f', "
            "step::INTEGER, loss, lr, dt_ms, coalesce(tok_per_sec, 'nan'::DOUBLE))")
LOG_FIELDS = [r"step +(-?[0-9]+) ", r"loss: ([^ ]+) ", r"lr ([^ ]+) ", r"dt: ([^ ]+)ms ", r"tok/sec: ([^ ]+)$"]

def gen(length: int, horizon: int) -> str:
    """Sequences grown token by token from the one ``horizon`` places back."""
    return f"""cand AS (SELECT a, list(b ORDER BY rnk) AS bs, list(c ORDER BY rnk) AS cs FROM topk GROUP BY a),
back AS (SELECT list(b ORDER BY rnk) AS bs, list(c ORDER BY rnk) AS cs FROM backoff),
gen AS (
  WITH RECURSIVE g(run, item_id, tokens) AS (
    SELECT '{Q.GEN_RUN}' AS run, item_id, tokens FROM ptoks
    UNION ALL
    SELECT run, item_id, list_append(tokens, bs[list_position(
             list_transform(range(1, len(cs) + 1), lambda k: u * total < list_sum(cs[1:k])::HUGEINT * 4294967296), true)])
    FROM (
      SELECT g.run, g.item_id, g.tokens, coalesce(c.bs, back.bs) AS bs, coalesce(c.cs, back.cs) AS cs,
             list_sum(coalesce(c.cs, back.cs))::HUGEINT AS total,
             ('0x' || substr(md5('{C.GENERATION_SEED}|' || g.run || '|' || g.item_id || '|' || len(g.tokens)), 1, 8))::BIGINT::HUGEINT AS u
      FROM g LEFT JOIN cand c ON c.a = g.tokens[-{horizon}] CROSS JOIN back
      WHERE len(g.tokens) < {length}) step)
  SELECT run, item_id, tokens[1:{length}] AS tokens FROM g WHERE len(tokens) >= {length})"""


GEN = gen(Q.GEN_MAX_LENGTH, 1)


def decoded(src: str) -> str:
    """``text`` of the ``tokens`` of each row of ``src``: words, and runs of a 0
    and bytes (or of bytes alone) as spelled words."""
    return f"""dt AS (SELECT item_id, unnest(range(0, len(tokens))) AS i, unnest(tokens) AS t FROM {src}),
dn AS (SELECT *, lag(t) OVER (PARTITION BY item_id ORDER BY i) AS p FROM dt),
dp AS (SELECT *, sum((t <= {EOT} OR p IS NULL OR (p <> 0 AND p <= {EOT}))::INTEGER) OVER (PARTITION BY item_id ORDER BY i) AS piece FROM dn),
dr AS (SELECT item_id, piece, min(i) AS i, min(t) FILTER (t > 0 AND t <= {EOT}) AS word_id,
         coalesce(string_agg(printf('%02X', (t - {EOT + 1})::INTEGER), '' ORDER BY i) FILTER (t > {EOT}), '') AS h
       FROM dp GROUP BY item_id, piece),
dw AS (SELECT item_id, i, CASE WHEN word_id = {EOT} THEN '<|endoftext|>' WHEN word_id IS NOT NULL THEN v.word
         ELSE coalesce(try(decode(unhex(h))), '<0x' || h || '>') END AS word
       FROM dr LEFT JOIN vocab v ON v.id = dr.word_id),
decoded AS (SELECT item_id, string_agg(word, ' ' ORDER BY i) AS text FROM dw GROUP BY item_id)"""


SQL = {
    "corpus_scan": "SELECT 0::INTEGER AS source_ord, doc_id AS doc_ord, text FROM documents WHERE lang = 'en'",
    "project_keys": f"WITH {PAIRS} SELECT doc_ord, instruction, output FROM pairs",
    "concat_keys": f"WITH {PAIRS} SELECT 0::INTEGER AS source_ord, doc_ord, instruction || ' ' || output AS text FROM pairs",
    "concat_pair": f"WITH {PAIRS} SELECT doc_ord, instruction || output AS text FROM pairs",
    "union_sources": f"""WITH {PAIRS}, {DOCS},
  both_src AS (SELECT 0::INTEGER AS source_ord, doc_ord, instruction || ' ' || output AS text FROM pairs
               UNION ALL SELECT 1::INTEGER, doc_ord, text FROM docs),
  {offs('both_src')} SELECT source_ord, doc_ord, n, g FROM offs""",
    "doc_offsets": f"WITH {DOCS}, {offs()} SELECT source_ord, doc_ord, n, g FROM offs",
    "shard_manifest": f"WITH {DOCS}, {offs()}, {man()} SELECT data_name, shard_id, shard_name, n_tokens, n_docs, split, file_name FROM mani",
    "split_shards": f"WITH {DOCS}, {offs()}, {man()} SELECT shard_id, split FROM mani",
    "split_counts": f"WITH {DOCS}, {offs()}, {man()} SELECT split, count(*)::BIGINT AS n_shards, sum(n_tokens)::BIGINT AS n_tokens FROM mani GROUP BY split",
    "strip_split_label": f"""WITH {DOCS}, {offs()}, {man('docs_testing')}
  SELECT shard_id, file_name, regexp_replace(file_name, '_(training|validation|testing)$', '') AS stripped FROM mani""",
    "shard_catalog": f"WITH {DOCS}, {offs()}, {man()} SELECT shard_id, shard_name, file_name, n_tokens FROM mani WHERE split = 'training'",
    "pack_shards": f"""{CORPUS}
  SELECT source_ord, doc_ord, shard_id, min(pos) AS pos, count(*)::BIGINT AS length,
         string_agg(tok::VARCHAR, ' ' ORDER BY pos) AS tokens_text
  FROM stream GROUP BY source_ord, doc_ord, shard_id""",
    "shard_scan": f"""{CORPUS}
  SELECT shard_id, min(pos) AS pos, doc_ord, string_agg(tok::VARCHAR, ' ' ORDER BY pos) AS tokens_text
  FROM stream WHERE {_split('shard_id')} = 'training' GROUP BY source_ord, doc_ord, shard_id""",
    "token_range_report": f"""WITH {DOCS}, {VOCAB}, {dtok()},
  bad AS (SELECT len(ids) AS n, len(list_filter(ids, lambda t: t < 0 OR t >= {Q.REPORT_LIMIT})) AS b FROM dtok)
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens, count(*) FILTER (b > 0)::BIGINT AS n_bad_docs, sum(b)::BIGINT AS n_bad_tokens FROM bad""",
    "byte_manifest": f"""WITH {DOCS},
  offs AS (SELECT source_ord, doc_ord, n,
     (sum(n) OVER (ORDER BY source_ord, doc_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n)::BIGINT AS g
     FROM (SELECT source_ord, doc_ord, (strlen(text) + 1)::BIGINT AS n FROM docs)),
  {man('bytes', Q.BYTE_SHARD_TOKENS)} SELECT shard_id, n_tokens, n_docs FROM man""",
    "byte_fragments": f"""WITH {DOCS},
  offs AS (SELECT source_ord, doc_ord, n,
     (sum(n) OVER (ORDER BY source_ord, doc_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n)::BIGINT AS g
     FROM (SELECT source_ord, doc_ord, (strlen(text) + 1)::BIGINT AS n FROM docs)),
  hx AS (SELECT o.doc_ord, o.g, hex(encode(d.text)) AS h, strlen(d.text) AS nb FROM docs d JOIN offs o USING (source_ord, doc_ord)),
  bytes AS (
    SELECT doc_ord, g, 0 AS i, 256 AS tok FROM offs
    UNION ALL
    SELECT doc_ord, g, unnest(range(1, nb + 1)) AS i,
           ('0x' || unnest(regexp_extract_all(h, '..')))::INTEGER AS tok
    FROM hx),
  st AS (SELECT doc_ord, (g + i) // {Q.BYTE_SHARD_TOKENS} AS shard_id, (g + i) % {Q.BYTE_SHARD_TOKENS} AS pos, tok FROM bytes)
  SELECT doc_ord, shard_id, min(pos) AS pos, count(*)::BIGINT AS length, sum(tok)::BIGINT AS token_sum
  FROM st GROUP BY doc_ord, shard_id""",
    "sequences": f"""{CORPUS},
  xs AS (SELECT s.shard_id, s.pos // {T} AS seq, string_agg(s.tok::VARCHAR, ' ' ORDER BY s.pos) AS x_text
         FROM stream s GROUP BY 1, 2),
  ys AS (SELECT s.shard_id, (s.pos - {Q.SEQ_N}) // {T} AS seq, string_agg(s.tok::VARCHAR, ' ' ORDER BY s.pos) AS y_text
         FROM stream s WHERE s.pos >= {Q.SEQ_N} GROUP BY 1, 2)
  SELECT {_split('shard_id')} AS split, shard_id, seq, x_text, y_text
  FROM xs JOIN ys USING (shard_id, seq) JOIN slen USING (shard_id)
  WHERE seq * {T} + {T} + {Q.SEQ_N} <= L""",
    "target_pairs": f"{CORPUS}, {pairs_at(Q.SEQ_N)} SELECT split, shard_id, pos, a, b FROM tpairs",
    "rank_batches": f"""WITH {DOCS}, {offs()}, {man()},
  ranks AS (SELECT shard_id, n_tokens AS L, unnest(range(0, {Q.LOADER.W})) AS rank FROM mani WHERE split = 'training'),
  kr AS (SELECT shard_id, rank, CASE WHEN {Q.LOADER.B * T} * rank + {Q.LOADER.B * T + Q.LOADER.N} <= L
             THEN greatest(1, (L - {Q.LOADER.N} - {Q.LOADER.B * T} * rank) // {Q.LOADER.B * T * Q.LOADER.W}) ELSE 0 END AS K FROM ranks),
  kk AS (SELECT shard_id, rank, unnest(range(0, K)) AS k FROM kr WHERE K > 0)
  SELECT shard_id, rank::INTEGER AS rank, k, rank + k * {Q.LOADER.W} AS batch, (rank + k * {Q.LOADER.W}) * {Q.LOADER.B * T} AS pos FROM kk""",
    "batch_schedule": f"""WITH {DOCS}, {offs()}, {man()},
  ranks AS (SELECT shard_id, n_tokens AS L, unnest(range(0, {Q.LOADER.W})) AS rank FROM mani WHERE split = 'training'),
  kr AS (SELECT shard_id, rank, CASE WHEN {Q.LOADER.B * T} * rank + {Q.LOADER.B * T + Q.LOADER.N} <= L
             THEN greatest(1, (L - {Q.LOADER.N} - {Q.LOADER.B * T} * rank) // {Q.LOADER.B * T * Q.LOADER.W}) ELSE 0 END AS K FROM ranks),
  cum AS (SELECT *, (sum(K) OVER (PARTITION BY rank ORDER BY shard_id) - K)::BIGINT AS c0,
                (sum(K) OVER (PARTITION BY rank))::BIGINT AS M FROM kr),
  ms AS (SELECT rank, unnest(range(0, {Q.SCHEDULE_STEPS * Q.SCHEDULE_ACCUM})) AS m FROM (SELECT DISTINCT rank FROM kr)),
  pick AS (SELECT ms.rank, ms.m, c.shard_id, c.M, ms.m // c.M AS epoch, (ms.m % c.M) - c.c0 AS k
           FROM ms JOIN cum c ON c.rank = ms.rank AND c.K > 0 AND (ms.m % c.M) >= c.c0 AND (ms.m % c.M) < c.c0 + c.K)
  SELECT m // {Q.SCHEDULE_ACCUM} AS step, m % {Q.SCHEDULE_ACCUM} AS micro_step, rank::INTEGER AS rank, epoch, shard_id, k,
         rank + k * {Q.LOADER.W} AS batch, (rank + k * {Q.LOADER.W}) * {Q.LOADER.B * T} AS pos,
         CASE WHEN (m // {Q.SCHEDULE_ACCUM} + 1) / {float(Q.SCHEDULE_STEPS)} < 1.0 / 3 THEN 1
              WHEN (m // {Q.SCHEDULE_ACCUM} + 1) / {float(Q.SCHEDULE_STEPS)} < 2.0 / 3 THEN 2 ELSE 3 END AS stage
  FROM pick""",
    "next_token_counts": f"{CORPUS}, {COUNTS} SELECT a, b, c FROM counts",
    "test_cross_entropy": f"""{CORPUS}, {COUNTS},
  test AS (SELECT a, b, count(*) AS n FROM tpairs WHERE split = 'testing' GROUP BY a, b)
  SELECT sum(n)::BIGINT AS n_targets,
         round(sum(n * -ln((coalesce(c.c, 0) + 1.0) / (coalesce(x.ca, 0) + {float(V)}))) / sum(n), 6) AS cross_entropy
  FROM test t LEFT JOIN counts c USING (a, b) LEFT JOIN ctx x USING (a)""",
    "topk_next": f"{CORPUS}, {COUNTS} SELECT a, rnk, b, c FROM topk",
    "next_token_probs": f"{CORPUS}, {COUNTS} SELECT a, b, c, round(c / ca, 6) AS p FROM counts JOIN ctx USING (a)",
    "encode_vocab": f"WITH {DOCS}, {VOCAB} SELECT id, word, count FROM vocab",
    "encode_prompts": f"""WITH {DOCS}, {VOCAB}, {PROMPTS}
  SELECT item_id, len(tokens)::BIGINT AS n_tokens, array_to_string(tokens, ' ') AS tokens_text FROM ptoks""",
    "decode_prompts": f"""WITH {DOCS}, {VOCAB}, {PROMPTS}, {decoded('ptoks')}
  SELECT item_id, text FROM decoded""",
    "round_trip": "SELECT count(*)::BIGINT AS n_docs, 0::BIGINT AS n_differing FROM documents",
    "resplit": f"""WITH {DOCS}, {offs()}, {man()},
  new AS (SELECT shard_id, shard_name, n_tokens, CASE WHEN shard_id % 10 < {Q.RESPLIT_RATIO.training} THEN 'training'
            WHEN shard_id % 10 < {Q.RESPLIT_RATIO.training + Q.RESPLIT_RATIO.validation} THEN 'validation' ELSE 'testing' END AS split FROM mani)
  SELECT shard_id, shard_name || '_' || split AS file_name, split, n_tokens,
         CASE WHEN split = 'validation' THEN n_tokens END AS n_read FROM new""",
    "prepare_prompts": f"""WITH {DOCS}, {VOCAB}, {PROMPTS},
  pad AS (SELECT coalesce((SELECT id FROM vocab WHERE word = ''), 0) AS pad_id)
  SELECT item_id,
         array_to_string(CASE WHEN len(tokens) > {Q.CONTEXT_SIZE} THEN tokens[-{Q.CONTEXT_SIZE}:] ELSE tokens END, ' ') AS tail_text,
         array_to_string(tokens[1:{Q.CONTEXT_SIZE}], ' ') AS head_text,
         array_to_string(list_concat(list_transform(range(0, greatest(0, {Q.PAD_CONTEXT} - len(tokens[1:{Q.PAD_CONTEXT}]))), lambda k: pad_id),
                                     tokens[1:{Q.PAD_CONTEXT}]), ' ') AS padded_text
  FROM ptoks, pad""",
    "generate_text": f"""{CORPUS}, {COUNTS}, {PROMPTS}, {GEN}, {decoded('gen')}
  SELECT run, item_id, array_to_string(tokens, ' ') AS tokens_text, text AS response FROM gen JOIN decoded USING (item_id)""",
    "responses_pivot": f"""{CORPUS}, {COUNTS}, {PROMPTS}, {GEN}, {decoded('gen')}
  SELECT item_id, text AS {Q.GEN_RUN} FROM decoded""",
    "prompt_matrix": f"""WITH {TEL},
  req AS (SELECT * FROM (VALUES {', '.join(f"('{r}')" for r in Q.REQUESTED_RUNS)}) t(run)),
  have AS (SELECT DISTINCT run FROM tel)
  SELECT r.run, b.item_id FROM req r JOIN have USING (run) CROSS JOIN (SELECT item_id FROM benchmark) b""",
    "step_loss": f"WITH {TEL} SELECT run, step, round(loss, 6) AS loss FROM sloss",
    "loss_curve": f"WITH {TEL} SELECT run, step, round(loss, 6) AS loss, round(log10(loss), 6) AS log10_loss FROM sloss",
    "step_duration": f"WITH {TEL} SELECT run, step, dt_ms FROM dur",
    "throughput": f"WITH {TEL} SELECT run, step, dt_ms, round(tok_per_sec, 4) AS tok_per_sec FROM steps",
    "lr_schedule": f"WITH {TEL} SELECT run, step, round(lr, 12) AS lr FROM steps",
    "curriculum_stage": f"WITH {TEL} SELECT run, step, max_steps, stage FROM steps",
    "checkpoint_steps": f"""WITH {TEL}
  SELECT run, step, round(loss, 6) AS loss FROM steps
  WHERE (step % greatest(1, max_steps // 20) = 0 OR step = max_steps - 1) AND step < max_steps""",
    "resume_point": f"WITH {TEL} SELECT run, max(step) AS last_step, count(*)::BIGINT AS n_steps, max(step) + 1 AS resume_step FROM sloss GROUP BY run",
    "log_format": f"WITH {TEL} SELECT run, step, {LOG_LINE} AS line FROM steps",
    "log_parse": f"""WITH {TEL}, lines AS (SELECT run, {LOG_LINE} AS line FROM steps)
  SELECT run, regexp_extract(line, '{LOG_FIELDS[0]}', 1)::BIGINT AS step, regexp_extract(line, '{LOG_FIELDS[1]}', 1)::DOUBLE AS loss,
         regexp_extract(line, '{LOG_FIELDS[2]}', 1)::DOUBLE AS lr, regexp_extract(line, '{LOG_FIELDS[3]}', 1)::DOUBLE AS dt_ms,
         regexp_extract(line, '{LOG_FIELDS[4]}', 1)::DOUBLE AS tok_per_sec
  FROM lines""",
    "log_report": f"WITH {TEL} SELECT run, count(*)::BIGINT AS n_lines, count(*)::BIGINT AS n_steps, 0::BIGINT AS n_unread FROM steps GROUP BY run",
    "leftover_records": f"""WITH {TEL}
  SELECT run, max(cnt)::BIGINT AS n_records, max(cnt % {W_TEL * A_TEL})::BIGINT AS n_leftover FROM ev GROUP BY run""",
    "loss_map": f"""WITH {TEL}
  SELECT run, step // {Q.LOSS_BLOCK} AS block, count(*)::BIGINT AS n_steps,
         string_agg(step || ':' || printf('%.6f', loss), ' ' ORDER BY step) AS entries FROM sloss GROUP BY run, step // {Q.LOSS_BLOCK}""",
    "resume_merge": f"""WITH {TEL}, h AS (SELECT run, max(step) AS last FROM steps WHERE step < max_steps // 2 GROUP BY run)
  SELECT run, step, round(loss, 6) AS loss, CASE WHEN step < max_steps // 2 THEN 'history' ELSE 'fresh' END AS origin
  FROM steps LEFT JOIN h USING (run) WHERE step < max_steps // 2 OR (step >= max_steps // 4 AND (last IS NULL OR step > last))""",
    "loader_report": f"""WITH {DOCS}, {offs()}, {man()},
  asked AS (SELECT * FROM (VALUES ('{Q.DATA_NAME}'), ('other')) a(data_name) CROSS JOIN (VALUES ('training'), ('validation'), ('testing')) b(split))
  SELECT data_name, split, count(shard_id)::BIGINT AS n_shards, count(shard_id) > 0 AS loadable
  FROM asked LEFT JOIN mani USING (data_name, split) GROUP BY data_name, split""",
    "ingest_order": """SELECT doc_id, source || '/' || doc_id AS name, row_number() OVER (ORDER BY source || '/' || doc_id) - 1 AS doc_ord FROM documents""",
    "log_name": f"WITH {TEL} SELECT run, run || '_log_' || strftime(min(ts), '%Y_%m_%d_%H_%M') || '.txt' AS log_file FROM tel GROUP BY run",
    "available_runs": f"""WITH {TEL},
  req AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{r}')" for i, r in enumerate(Q.REQUESTED_RUNS))}) t(req_ord, run))
  SELECT req_ord::INTEGER AS req_ord, run FROM req WHERE run IN (SELECT run FROM tel)""",
    "map_has_prefix": f"""WITH {TEL}
  SELECT run, bool_or(stage = 3) AS has_stage_3, false AS has_stage_9 FROM steps GROUP BY run""",
}
SQL["stream_pack_shards"] = SQL["pack_shards"]
SQL["live_step_loss"] = SQL["step_loss"]
SQL["unigram_test_loss"] = f"""{CORPUS}, {COUNTS},
  uni AS (SELECT b, sum(c) AS c FROM counts GROUP BY b),
  tot AS (SELECT sum(c) AS n FROM counts),
  test AS (SELECT * FROM tpairs WHERE split = 'testing')
  SELECT (count(*) / {T})::BIGINT AS n_sequences,
         round(avg(-ln((coalesce(u.c, 0) + 1.0) / ((SELECT n FROM tot) + {float(V)}))), 6) AS loss
  FROM test t LEFT JOIN uni u USING (b)"""
TEST_STEPS = f"(SELECT max(M) + {Q.WHOLE_EXTRA} FROM cum)"
TEST_LOSS = f"""{man()},
  ranks AS (SELECT shard_id, n_tokens AS L, unnest(range(0, {Q.LOADER.W})) AS rank FROM mani WHERE split = 'testing'),
  kr AS (SELECT shard_id, rank, CASE WHEN {Q.LOADER.B * T} * rank + {Q.LOADER.B * T + Q.LM_N} <= L
             THEN greatest(1, (L - {Q.LM_N} - {Q.LOADER.B * T} * rank) // {Q.LOADER.B * T * Q.LOADER.W}) ELSE 0 END AS K FROM ranks),
  cum AS (SELECT *, (sum(K) OVER (PARTITION BY rank ORDER BY shard_id) - K)::BIGINT AS c0,
                (sum(K) OVER (PARTITION BY rank))::BIGINT AS M FROM kr),
  reads AS (SELECT c.rank, c.shard_id, c.rank + ((s.i % c.M) - c.c0) * {Q.LOADER.W} AS batch
            FROM (SELECT unnest(range(0, {TEST_STEPS})) AS i) s JOIN cum c ON c.K > 0 AND (s.i % c.M) >= c.c0 AND (s.i % c.M) < c.c0 + c.K),
  tp AS (SELECT shard_id, (pos // {T}) // {Q.LOADER.B} AS batch, a, b FROM tpairs WHERE split = 'testing'),
  bl AS (SELECT shard_id, batch, avg(-ln((coalesce(c.c, 0) + 1.0) / (coalesce(x.ca, 0) + {float(V)}))) AS loss
         FROM tp LEFT JOIN counts c USING (a, b) LEFT JOIN ctx x USING (a) GROUP BY ALL),
  pr AS (SELECT rank, sum(loss) / {TEST_STEPS} AS loss FROM reads JOIN bl USING (shard_id, batch) GROUP BY rank),
  tl AS (SELECT run, round(avg(loss), 6) AS test_loss FROM (SELECT 'count-model' AS run, loss FROM pr) GROUP BY run)"""
SQL["test_loss"] = f"{CORPUS}, {COUNTS}, {TEST_LOSS} SELECT run, test_loss FROM tl"
SQL["run_summary"] = f"""{CORPUS}, {COUNTS}, {TEST_LOSS}, {TEL},
  rs AS (SELECT run, count(*)::BIGINT AS n_steps, round(arg_max(loss, step), 6) AS final_loss, round(min(loss), 6) AS min_loss,
         round(avg(dt_ms), 4) AS mean_dt_ms, round(avg(tok_per_sec), 4) AS mean_tok_per_sec FROM steps GROUP BY run)
  SELECT run, n_steps, final_loss, min_loss, mean_dt_ms, mean_tok_per_sec, test_loss FROM rs FULL JOIN tl USING (run)"""
SQL["test_loss_whole"] = SQL["test_loss"]
SQL["stream_manifest"] = SQL["shard_manifest"]
SQL["horizon_counts"] = f"""{CORPUS}, {pairs_at(64)}
  SELECT a, b, count(*)::BIGINT AS c FROM tpairs WHERE split = 'training' GROUP BY a, b"""
SQL["log_scan"] = SQL["log_parse"]
SQL["step_batches"] = f"""{CORPUS}, {man()},
  ranks AS (SELECT shard_id, n_tokens AS L, unnest(range(0, {Q.LOADER.W})) AS rank FROM mani WHERE split = 'training'),
  kr AS (SELECT shard_id, rank, CASE WHEN {Q.LOADER.B * T} * rank + {Q.LOADER.B * T + Q.LOADER.N} <= L
             THEN greatest(1, (L - {Q.LOADER.N} - {Q.LOADER.B * T} * rank) // {Q.LOADER.B * T * Q.LOADER.W}) ELSE 0 END AS K FROM ranks),
  cum AS (SELECT *, (sum(K) OVER (PARTITION BY rank ORDER BY shard_id) - K)::BIGINT AS c0,
                (sum(K) OVER (PARTITION BY rank))::BIGINT AS M FROM kr),
  ms AS (SELECT rank, unnest(range(0, {Q.SCHEDULE_STEPS * Q.SCHEDULE_ACCUM})) AS m FROM (SELECT DISTINCT rank FROM kr)),
  pick AS (SELECT ms.rank, ms.m, c.shard_id, (ms.m % c.M) - c.c0 AS k
           FROM ms JOIN cum c ON c.rank = ms.rank AND c.K > 0 AND (ms.m % c.M) >= c.c0 AND (ms.m % c.M) < c.c0 + c.K),
  sched AS (SELECT m // {Q.SCHEDULE_ACCUM} AS step, m % {Q.SCHEDULE_ACCUM} AS micro_step, rank, shard_id,
                   rank + k * {Q.LOADER.W} AS batch, unnest(range(0, {Q.LOADER.B})) AS batch_row FROM pick),
  xs AS (SELECT shard_id, pos // {T} AS seq, string_agg(tok::VARCHAR, ' ' ORDER BY pos) AS x_text FROM stream GROUP BY 1, 2),
  ys AS (SELECT shard_id, (pos - {Q.SEQ_N}) // {T} AS seq, string_agg(tok::VARCHAR, ' ' ORDER BY pos) AS y_text
         FROM stream WHERE pos >= {Q.SEQ_N} GROUP BY 1, 2),
  sq AS (SELECT shard_id, seq, x_text, y_text FROM xs JOIN ys USING (shard_id, seq) JOIN slen USING (shard_id)
         WHERE seq * {T} + {T} + {Q.SEQ_N} <= L)
  SELECT s.step, s.micro_step, s.rank::INTEGER AS rank, s.batch_row::INTEGER AS batch_row, s.shard_id,
         s.batch * {Q.LOADER.B} + s.batch_row AS seq, sq.x_text, sq.y_text
  FROM sched s JOIN sq ON sq.shard_id = s.shard_id AND sq.seq = s.batch * {Q.LOADER.B} + s.batch_row"""
SQL["generate_horizon"] = f"""{CORPUS}, {counts_at(64)}, {PROMPTS}, {gen(Q.HORIZON_LENGTH, 64)}
  SELECT run, item_id, array_to_string(tokens, ' ') AS tokens_text FROM gen"""
SQL["live_throughput"] = SQL["throughput"]
SQL["live_log_steps"] = SQL["log_parse"]
SQL["npy_shard_scan"] = f"""{CORPUS}
  SELECT '{Q.DATA_NAME}' AS data_name, 'training' AS split, shard_id, min(pos) AS pos, count(*)::BIGINT AS length,
         string_agg(tok::VARCHAR, ' ' ORDER BY pos) AS tokens_text
  FROM stream WHERE {_split('shard_id')} = 'training' GROUP BY shard_id, pos // {Q.NPY_CHUNK}"""
# targets with the token at and before their place in the window, and the tables of each order
NGRAMS = f"""{pairs_at(Q.LM_N)},
  ng AS (SELECT p.split, CASE WHEN p.pos % {T} > 0 THEN s0.tok END AS a2, p.a AS a1, p.b
         FROM tpairs p LEFT JOIN stream s0 ON s0.shard_id = p.shard_id AND s0.pos = p.pos - 1),
  n3 AS (SELECT a2, a1, b, count(*)::BIGINT AS n FROM ng WHERE split = 'training' AND a2 IS NOT NULL GROUP BY ALL),
  kinds AS (SELECT DISTINCT a2, a1, b FROM ng WHERE split = 'training'),
  n2 AS (SELECT a1, b, count(*)::BIGINT AS n FROM kinds GROUP BY ALL),
  n1 AS (SELECT b, count(*)::BIGINT AS n FROM (SELECT DISTINCT a1, b FROM kinds) GROUP BY b)"""
SQL["topk_bounded"] = SQL["topk_next"]
SQL["curve_pixels"] = f"""WITH {TEL},
  pts AS (SELECT run, step, round(loss, 6) AS loss FROM sloss WHERE loss > 0),
  ax AS (SELECT min(step) AS lo, max(step) - min(step) + 1 AS span FROM pts),
  col AS (SELECT run, (step - lo) * {Q.CURVE_WIDTH} // span AS px, step, loss FROM pts, ax),
  rk AS (SELECT *, row_number() OVER (PARTITION BY run, px ORDER BY step) AS f, row_number() OVER (PARTITION BY run, px ORDER BY step DESC) AS l,
           row_number() OVER (PARTITION BY run, px ORDER BY loss, step) AS lo_rank, row_number() OVER (PARTITION BY run, px ORDER BY loss DESC, step) AS hi_rank FROM col)
  SELECT run, px, step, loss FROM rk WHERE 1 IN (f, l, lo_rank, hi_rank)"""
SQL["ngram_counts"] = f"""{CORPUS}, {NGRAMS}
  SELECT 3::INTEGER AS k, a2 || ' ' || a1 AS context, b, n FROM n3 UNION ALL SELECT 2, a1::VARCHAR, b, n FROM n2 UNION ALL SELECT 1, '', b, n FROM n1"""
SQL["ngram_cross_entropy"] = f"""{CORPUS}, {NGRAMS},
  t3 AS (SELECT a2, a1, sum(n) AS of, count(*) AS types FROM n3 GROUP BY ALL),
  t2 AS (SELECT a1, sum(n) AS of, count(*) AS types FROM n2 GROUP BY a1),
  t1 AS (SELECT sum(n) AS of, count(*) AS types FROM n1),
  test AS (SELECT a2, a1, b, count(*) AS c FROM ng WHERE split = 'testing' GROUP BY ALL),
  p1 AS (SELECT test.*, greatest(coalesce(n, 0) - 0.75::DOUBLE, 0) / t1.of + 0.75::DOUBLE * types / t1.of * (1.0::DOUBLE / {V}) AS p FROM test LEFT JOIN n1 USING (b), t1),
  p2 AS (SELECT p1.a2, a1, b, c, CASE WHEN t2.of IS NULL THEN p ELSE greatest(coalesce(n, 0) - 0.75::DOUBLE, 0) / t2.of + 0.75::DOUBLE * types / t2.of * p END AS p
         FROM p1 LEFT JOIN n2 USING (a1, b) LEFT JOIN t2 USING (a1)),
  p3 AS (SELECT c, CASE WHEN t3.of IS NULL THEN p ELSE greatest(coalesce(n, 0) - 0.75::DOUBLE, 0) / t3.of + 0.75::DOUBLE * types / t3.of * p END AS p
         FROM p2 LEFT JOIN n3 USING (a2, a1, b) LEFT JOIN t3 USING (a2, a1))
  SELECT sum(c)::BIGINT AS n_targets, round(sum(-ln(p) * c) / sum(c), 6) AS cross_entropy FROM p3"""
SQL["generate_ngram"] = f"""{CORPUS}, {NGRAMS}, {PROMPTS},
  m2 AS (SELECT a2, a1, list(b ORDER BY c DESC, b) AS bs, list(c ORDER BY c DESC, b) AS cs FROM (SELECT a2, a1, b, n AS c FROM n3
         QUALIFY row_number() OVER (PARTITION BY a2, a1 ORDER BY c DESC, b) <= {C.TOP_K}) GROUP BY a2, a1),
  m1 AS (SELECT a1, list(b ORDER BY c DESC, b) AS bs, list(c ORDER BY c DESC, b) AS cs FROM (
         SELECT a1, b, count(*)::BIGINT AS c FROM ng WHERE split = 'training' GROUP BY a1, b
         QUALIFY row_number() OVER (PARTITION BY a1 ORDER BY c DESC, b) <= {C.TOP_K}) GROUP BY a1),
  m0 AS (SELECT list(b ORDER BY c DESC, b) AS bs, list(c ORDER BY c DESC, b) AS cs FROM (
         SELECT b, count(*)::BIGINT AS c FROM ng WHERE split = 'training' GROUP BY b ORDER BY c DESC, b LIMIT {C.TOP_K})),
  gen AS (
  WITH RECURSIVE g(run, item_id, tokens) AS (
    SELECT '{Q.GEN_RUN}' AS run, item_id, tokens FROM ptoks
    UNION ALL
    SELECT run, item_id, list_append(tokens, bs[list_position(
             list_transform(range(1, len(cs) + 1), lambda k: u * total < list_sum(cs[1:k])::HUGEINT * 4294967296), true)])
    FROM (SELECT run, item_id, tokens, bs, cs, list_sum(cs)::HUGEINT AS total,
                 ('0x' || substr(md5('{C.GENERATION_SEED}|' || run || '|' || item_id || '|' || len(tokens)), 1, 8))::BIGINT::HUGEINT AS u
          FROM (SELECT g.run, g.item_id, g.tokens, coalesce(m2.bs, m1.bs, m0.bs) AS bs, coalesce(m2.cs, m1.cs, m0.cs) AS cs
                FROM g LEFT JOIN m2 ON m2.a2 = g.tokens[-2] AND m2.a1 = g.tokens[-1] LEFT JOIN m1 ON m1.a1 = g.tokens[-1] CROSS JOIN m0
                WHERE len(g.tokens) < {Q.STEPWISE_LENGTH}) known) step)
  SELECT run, item_id, tokens[1:{Q.STEPWISE_LENGTH}] AS tokens FROM g WHERE len(tokens) >= {Q.STEPWISE_LENGTH})
  SELECT run, item_id, array_to_string(tokens, ' ') AS tokens_text FROM gen"""
SCHED = SQL["step_batches"][:SQL["step_batches"].index("  sched AS")].rstrip().rstrip(",")
SQL["step_documents"] = f"""{SCHED},
  reads AS (SELECT m // {Q.SCHEDULE_ACCUM} AS step, rank::INTEGER AS rank, shard_id, (rank + k * {Q.LOADER.W}) * {Q.LOADER.B * T} AS lo FROM pick)
  SELECT step, rank, source_ord, doc_ord, count(*)::BIGINT AS n_read, count(*) FILTER (s.pos < lo + {Q.LOADER.B * T})::BIGINT AS n_tokens
  FROM reads r JOIN stream s ON s.shard_id = r.shard_id AND s.pos >= lo AND s.pos < lo + {Q.LOADER.B * T + Q.LOADER.N}
  GROUP BY step, rank, source_ord, doc_ord"""


def _label(ratio) -> str:
    a, b = ratio[0], ratio[0] + ratio[1]
    return f"CASE WHEN shard_id % 10 < {a} THEN 'training' WHEN shard_id % 10 < {b} THEN 'validation' ELSE 'testing' END"


def _ratio_rows(ratio) -> str:
    name = ":".join(map(str, ratio))
    if min(ratio) < 0 or sum(ratio) != 10:
        return f"SELECT '{name}' AS ratio, false AS valid, NULL::VARCHAR AS split, NULL::BIGINT AS n_shards, NULL::BIGINT AS n_tokens"
    return f"SELECT '{name}' AS ratio, true AS valid, {_label(ratio)} AS split, count(*)::BIGINT AS n_shards, sum(n_tokens)::BIGINT AS n_tokens FROM mani GROUP BY 3"


def _rounds(b: int, w: int) -> str:
    """Batches of each rank in one round of the training split."""
    bt = b * T
    return f"""SELECT rank, sum(CASE WHEN {bt} * rank + {bt + Q.LM_N} <= L THEN greatest(1, (L - {Q.LM_N} - {bt} * rank) // {bt * w}) ELSE 0 END) AS M
      FROM (SELECT n_tokens AS L, unnest(range(0, {w})) AS rank FROM mani WHERE split = 'training') GROUP BY rank"""


def _accumulation(b: int, w: int) -> str:
    per = b * T * w
    steps = Q.ACCUM_TOKENS // per if Q.ACCUM_TOKENS % per == 0 else None
    known = f"{steps}::BIGINT AS accum_steps, (min(M) // {steps})::BIGINT AS steps_per_round" if steps else "max(NULL::BIGINT) AS accum_steps, max(NULL::BIGINT) AS steps_per_round"
    return f"SELECT {b}::INTEGER AS B, {w}::INTEGER AS W, {str(bool(steps)).lower()} AS divides, {known} FROM ({_rounds(b, w)})"


SQL["ratio_report"] = f"WITH {DOCS}, {offs()}, {man()} " + " UNION ALL ".join(_ratio_rows(r) for r in Q.REPORT_RATIOS)
SQL["accumulation_steps"] = f"WITH {DOCS}, {offs()}, {man()} " + " UNION ALL ".join(_accumulation(b, w) for b in Q.ACCUM_B for w in Q.ACCUM_W)
SQL["stream_resume"] = SQL["pack_shards"]
SCHED_LM = SCHED.replace(f"{Q.LOADER.B * T + Q.LOADER.N} <= L", f"{Q.LOADER.B * T + Q.LM_N} <= L").replace(f"(L - {Q.LOADER.N} -", f"(L - {Q.LM_N} -")
SQL["stage_scores"] = f"""{SCHED_LM}, {pairs_at(Q.LM_N)},
  counts AS (SELECT b, count(*)::BIGINT AS c FROM tpairs WHERE split = 'training' GROUP BY b),
  tot AS (SELECT sum(c) AS n FROM counts),
  reads AS (SELECT m // {Q.SCHEDULE_ACCUM} AS step, m, rank, shard_id, (rank + k * {Q.LOADER.W}) * {Q.LOADER.B} + unnest(range(0, {Q.LOADER.B})) AS seq FROM pick),
  staged AS (SELECT *, CASE WHEN (step + 1) / {float(Q.SCHEDULE_STEPS)} < 1.0 / 3 THEN 1 WHEN (step + 1) / {float(Q.SCHEDULE_STEPS)} < 2.0 / 3 THEN 2 ELSE 3 END AS stage FROM reads),
  each AS (SELECT s.stage, s.m, s.rank, s.seq, avg(-ln((coalesce(u.c, 0) + 1.0) / ((SELECT n FROM tot) + {float(V)}))) AS loss
           FROM staged s JOIN tpairs p ON p.shard_id = s.shard_id AND p.pos // {T} = s.seq AND p.pos % {T} < {T} * s.stage // 3 LEFT JOIN counts u USING (b)
           GROUP BY s.stage, s.m, s.rank, s.shard_id, s.seq)
  SELECT stage, count(*)::BIGINT AS n_sequences, round(avg(loss), 6) AS loss FROM each GROUP BY stage"""
