"""DuckDB SQL equal in meaning to each registered query (driver correctness gate).

Tables are the pre-registered views of the driver. Column names and types
match the Spark results; floating-point outputs are rounded to 6 decimals on
both sides.
"""

from __future__ import annotations

from vqaframe.functions.strings import REFERENCE_PROMPT, parse_template
from vqaframe.plans import tables as T


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[ \\t\\n\\r]+'), lambda w: w <> '')"


def _pad(x: str) -> str:
    s = f"CAST({x} AS VARCHAR)"
    return f"repeat('0', CAST(greatest(12 - length({s}), 0) AS BIGINT)) || {s}"


def _file(x: str) -> str:
    return f"'COCO_{T.SPLIT}2014_' || {_pad(x)} || '.jpg'"


_PRE, _SUF = parse_template(REFERENCE_PROMPT)
L = T.TEXT_LENGTH + T.NUM_PATCHES
NP = T.NUM_PATCHES

PAIRS = """pairs AS (
  SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer
  FROM conversations q JOIN conversations a
    ON q.conv_id = a.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant')"""

VOCAB = f"""bt AS (SELECT unnest({_tok('text')}) AS token FROM (
  SELECT text FROM documents UNION ALL SELECT text FROM conversations)),
bc AS (SELECT token, count(*) AS cnt FROM bt GROUP BY token),
words AS (
  SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token) - 1 + 4 AS INTEGER) AS id
  FROM bc WHERE token NOT IN ('<pad>', '<eos>', '<bos>', '<unk>')
  QUALIFY row_number() OVER (ORDER BY cnt DESC, token) <= 256000 - 4),
vocab AS (
  SELECT * FROM (VALUES ('<pad>', 0), ('<eos>', 1), ('<bos>', 2), ('<unk>', 3)) v(token, id)
  UNION ALL SELECT token, id FROM words)"""

VOCAB_X = VOCAB + """,
vocab_x AS (
  SELECT token, id FROM vocab
  UNION ALL
  SELECT '<image>', CAST(max(id) + 1 AS INTEGER) FROM vocab
  HAVING max(CASE WHEN token = '<image>' THEN 1 ELSE 0 END) = 0)"""

QA = f"""SELECT d.doc_id AS question_id, d.doc_id AS image_id,
  {_lit(_PRE)} || d.text || {_lit(_SUF)} AS question,
  CAST(l.quality AS VARCHAR) AS answer, {_lit(T.SPLIT)} AS split, {_lit(T.IMG_DIR)} AS img_path,
  {_lit(T.IMG_DIR + '/')} || {_file('d.doc_id')} AS image_file
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def _truncation(src: str, la: str, lb: str) -> str:
    """CTE body giving ka, kb (longest-first truncation to L) for every row of src."""
    s = f"least({la}, {lb})"
    lx = f"CASE WHEN {s} > {L} THEN {s} ELSE greatest({s}, {L} - {s}) END"
    both = f"({s} + {lx} > {L})"
    s2 = f"CASE WHEN {both} THEN {L // 2} ELSE {s} END"
    l2 = f"CASE WHEN {both} THEN {L - L // 2} ELSE {lx} END"
    return f"""SELECT *,
    CASE WHEN {la} + {lb} <= {L} THEN {la} WHEN {la} <= {lb} THEN {s2} ELSE {l2} END AS ka,
    CASE WHEN {la} + {lb} <= {L} THEN {lb} WHEN {la} <= {lb} THEN {l2} ELSE {s2} END AS kb
  FROM {src}"""


def _encoded(keys: str, src: str) -> str:
    """CTEs giving enc (keys, pos, input_id, token_type, attention_mask, label) for the rows of src (keys, qt, atk)."""
    return f"""ln AS (SELECT *, {NP} + len(qt) AS la, len(atk) AS lb FROM {src}),
k AS ({_truncation('ln', 'la', 'lb')}),
p AS (SELECT {keys}, qt, atk, ka, kb, unnest(range({L})) AS pos FROM k),
sg AS (SELECT *, CASE WHEN pos >= ka + kb THEN 0 WHEN pos < least({NP}, ka) THEN 1
                      WHEN pos < ka THEN 2 ELSE 3 END AS seg FROM p),
tok AS (SELECT {keys}, pos, seg,
          CASE WHEN seg = 2 THEN qt[pos - {NP} + 1] WHEN seg = 3 THEN atk[pos - ka + 1] END AS token
        FROM sg),
enc0 AS (
  SELECT {keys}, CAST(pos AS INTEGER) AS pos,
    CAST(CASE WHEN seg = 0 THEN 0
              WHEN seg = 1 THEN (SELECT id FROM vocab_x WHERE token = '<image>')
              ELSE coalesce(v.id, 3) END AS INTEGER) AS input_id,
    CAST(CASE WHEN seg = 3 THEN 1 ELSE 0 END AS INTEGER) AS token_type,
    CAST(CASE WHEN seg = 0 THEN 0 ELSE 1 END AS INTEGER) AS attention_mask
  FROM tok LEFT JOIN vocab_x v ON tok.token = v.token),
enc AS (SELECT *, CAST(CASE WHEN token_type = 1 THEN input_id ELSE -100 END AS INTEGER) AS label FROM enc0)"""


_FIELDS = ("input_id", "token_type", "attention_mask", "label")
_LISTED = ", ".join(f"string_agg(CAST({f} AS VARCHAR), ',' ORDER BY pos) AS {f}s" for f in _FIELDS)

PAIR_ENC = f"""WITH {PAIRS},
{VOCAB_X},
tk AS (SELECT conv_id, turn, {_tok('question')} AS qt,
              list_append({_tok('answer')}, '<eos>') AS atk FROM pairs),
{_encoded('conv_id, turn', 'tk')}"""

PAIR_IDS = f"""WITH {PAIRS},
tk AS (SELECT conv_id, turn, list_transform({_tok('question')}, lambda w: CAST(length(w) AS INTEGER)) AS qt,
              list_append(list_transform({_tok('answer')}, lambda w: CAST(length(w) AS INTEGER)), 1) AS atk
       FROM pairs),
ln AS (SELECT *, {NP} + len(qt) AS la, len(atk) AS lb FROM tk),
k AS ({_truncation('ln', 'la', 'lb')}),
p AS (SELECT conv_id, turn, qt, atk, ka, kb, unnest(range({L})) AS pos FROM k),
sg AS (SELECT *, CASE WHEN pos >= ka + kb THEN 0 WHEN pos < least({NP}, ka) THEN 1
                      WHEN pos < ka THEN 2 ELSE 3 END AS seg FROM p),
enc AS (
  SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos,
    CAST(CASE WHEN seg = 0 THEN 0 WHEN seg = 1 THEN {T.IMAGE_TOKEN_ID}
              WHEN seg = 2 THEN qt[pos - {NP} + 1] ELSE atk[pos - ka + 1] END AS INTEGER) AS input_id,
    CAST(CASE WHEN seg = 3 THEN 1 ELSE 0 END AS INTEGER) AS token_type,
    CAST(CASE WHEN seg = 0 THEN 0 ELSE 1 END AS INTEGER) AS attention_mask
  FROM sg)
SELECT conv_id, turn, pos, input_id, token_type, attention_mask,
       CAST(CASE WHEN token_type = 1 THEN input_id ELSE -100 END AS INTEGER) AS label FROM enc"""

DOC_IDS = f"""{VOCAB},
t AS (SELECT doc_id, {_tok('text')} AS tl FROM documents),
u AS (SELECT doc_id, unnest(range(len(tl))) AS pos, unnest(tl) AS token FROM t),
ids AS (SELECT u.doc_id, CAST(u.pos AS INTEGER) AS pos, CAST(coalesce(v.id, 3) AS INTEGER) AS token_id
        FROM u LEFT JOIN vocab v ON u.token = v.token)"""

BATCHED = f"""b AS (SELECT vec_id, embedding, label,
              (row_number() OVER (ORDER BY vec_id) - 1) AS idx FROM embeddings),
pb AS (SELECT idx // {T.EVAL_BATCH} AS batch_id,
              avg(CASE WHEN list_position(embedding, list_max(embedding)) - 1 = label
                       THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS acc,
              count(*) AS n
       FROM b GROUP BY idx // {T.EVAL_BATCH})"""

REQ = f"""{PAIRS},
req AS (SELECT conv_id, turn, text AS prompt, {T.NUM_COMPLETIONS} AS n,
               unnest(range({T.NUM_COMPLETIONS})) AS i
        FROM conversations WHERE role = 'user'),
reqk AS (SELECT *, sha256(to_json([CAST(n AS VARCHAR), CAST(i AS VARCHAR),
                                    {_lit(T.MODEL)}, md5(prompt)])::VARCHAR) AS cache_key FROM req),
cache0 AS (SELECT sha256(to_json(['{T.NUM_COMPLETIONS}', CAST(i AS VARCHAR),
                                   {_lit(T.MODEL)}, md5(question)])::VARCHAR) AS cache_key, answer AS output
           FROM (SELECT question, answer, unnest(range({T.NUM_COMPLETIONS})) AS i FROM pairs)),
cache AS (SELECT cache_key, min(output) AS output,
                 length(min(output)) / CAST(1000 AS DOUBLE) AS request_time
          FROM cache0 GROUP BY cache_key)"""


def _cut(x: str) -> str:
    e = _lit(T.EOS_STANDIN)
    return (f"CASE WHEN strpos({x}, {e}) > 0 THEN replace(replace(substr({x}, 1, strpos({x}, {e}) - 1),"
            f" '<bos>', ''), {e}, '') END")


SQL: dict[str, str] = {
    "qa_join": """SELECT d.doc_id AS question_id, d.doc_id AS image_id, d.text AS question,
  CAST(l.quality AS VARCHAR) AS answer
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",

    "qa_pairs": f"WITH {PAIRS} SELECT conv_id, turn, question, answer FROM pairs",

    "format_prompt": f"SELECT doc_id, {_lit(_PRE)} || text || {_lit(_SUF)} AS question FROM documents",

    "image_path": f"""SELECT doc_id,
  {_lit(T.IMG_DIR + '/')} || {_file('doc_id')} AS image_file,
  {_lit(T.IMG_DIR + '/')} || {_file('doc_id * CAST(10000000000 AS BIGINT)')} AS image_file_wide
FROM documents""",

    "qa_dataset": QA,

    "qa_train_split": f"""WITH j AS ({QA}),
r AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(question_id AS VARCHAR) || ':{T.SEED}'), question_id) AS rn,
             count(*) OVER () AS n FROM j)
SELECT question_id, image_id, question, answer, split, img_path, image_file, rn - 1 AS position,
       (rn - 1) // {T.TRAIN_BATCH} AS batch_id, CAST((rn - 1) % {T.TRAIN_BATCH} AS INTEGER) AS batch_pos
FROM r WHERE rn <= floor(n * CAST({T.TRAIN_P} AS DOUBLE))""",

    "dataset_roundtrip": QA,

    "exact_sample": f"""SELECT doc_id FROM (
  SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{T.SEED}'), doc_id) AS rn,
         count(*) OVER () AS n FROM documents)
WHERE rn <= floor(n * CAST({T.SAMPLE_P} AS DOUBLE))""",

    "eval_cap": f"""SELECT doc_id FROM (
  SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{T.SEED}'), doc_id) AS rn,
         count(*) OVER () AS n FROM documents)
WHERE rn <= least({T.EVAL_CAP}, n)""",

    "image_prefix": f"""SELECT d.doc_id, repeat('<image>', {NP}) || d.text AS prompt_text,
  CAST(l.quality AS VARCHAR) || '<eos>' AS label_text
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",

    "token_ids": f"WITH {DOC_IDS} SELECT doc_id, pos, token_id FROM ids",

    "extend_vocab": f"WITH {VOCAB_X} SELECT token, id FROM vocab_x",

    "pair_encode": PAIR_ENC + """
SELECT conv_id, turn, pos, input_id, token_type, attention_mask FROM enc""",

    "mask_labels": PAIR_ENC + """
SELECT conv_id, turn, pos, label FROM enc""",

    "pair_encode_user_tokenizer": PAIR_IDS,

    "image_mask_count": PAIR_ENC + """
SELECT conv_id, turn,
       CAST(count(*) FILTER (WHERE input_id = (SELECT id FROM vocab_x WHERE token = '<image>')) AS INTEGER) AS n_image_tokens,
       string_agg(CASE WHEN input_id = (SELECT id FROM vocab_x WHERE token = '<image>') THEN '1' ELSE '0' END, ''
                  ORDER BY pos) AS image_mask
FROM enc GROUP BY conv_id, turn""",

    "collate_batches": PAIR_ENC + f""",
ex AS (SELECT conv_id, turn, {_LISTED} FROM enc GROUP BY conv_id, turn),
b AS (SELECT *, row_number() OVER (ORDER BY md5(conv_id || chr(31) || turn || ':{T.SEED}'), conv_id, turn) - 1 AS idx FROM ex)
SELECT CAST(idx // {T.TRAIN_BATCH} AS BIGINT) AS batch_id, count(*) AS n_examples,
       string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY idx) AS conv_ids,
       string_agg(CAST(turn AS VARCHAR), ',' ORDER BY idx) AS turns,
       {", ".join(f"string_agg({f}s, '|' ORDER BY idx) AS {f}s" for f in _FIELDS)}
FROM b GROUP BY idx // {T.TRAIN_BATCH}""",

    "route_by_label": f"""WITH d AS (
  SELECT d.doc_id, {_tok('d.text')} AS qt, CAST(l.quality AS VARCHAR) AS answer
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
{VOCAB_X},
tr AS (SELECT doc_id, qt, list_append({_tok('answer')}, '<eos>') AS atk FROM d WHERE answer IS NOT NULL),
{_encoded('doc_id', 'tr')},
img AS (SELECT doc_id, unnest(range({NP})) - {NP} AS pos, (SELECT id FROM vocab_x WHERE token = '<image>') AS input_id
        FROM d WHERE answer IS NULL),
ask AS (SELECT doc_id, unnest(range(len(qt))) AS pos, unnest(qt) AS token FROM d WHERE answer IS NULL),
inf AS (SELECT doc_id, pos, input_id, 0 AS token_type, 1 AS attention_mask, -100 AS label FROM img
        UNION ALL
        SELECT doc_id, pos, coalesce(v.id, 3), 0, 1, -100 FROM ask LEFT JOIN vocab_x v ON ask.token = v.token)
SELECT doc_id, 'train' AS mode, count(*) AS n_input_ids, {_LISTED} FROM enc GROUP BY doc_id
UNION ALL
SELECT doc_id, 'infer' AS mode, count(*) AS n_input_ids, {_LISTED} FROM inf GROUP BY doc_id""",

    "missing_images": f"""SELECT doc_id, {_file('doc_id')} AS image_file FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE {_file('p.page_id')} = {_file('d.doc_id')})""",

    "batch_assembly": f"""WITH b AS (SELECT vec_id, label, (row_number() OVER (ORDER BY vec_id) - 1) AS idx FROM embeddings)
SELECT CAST(idx // {T.EVAL_BATCH} AS BIGINT) AS batch_id, count(*) AS n_rows,
       min(vec_id) AS first_vec_id, max(vec_id) AS last_vec_id,
       string_agg(CAST(label AS VARCHAR), ',' ORDER BY vec_id) AS labels
FROM b GROUP BY idx // {T.EVAL_BATCH}""",

    "batch_accuracy": f"""WITH {BATCHED}
SELECT CAST(batch_id % {T.NUM_RANKS} AS INTEGER) AS rank, CAST(batch_id AS BIGINT) AS batch_id,
       round(acc, 6) AS accuracy, n AS n_positions FROM pb""",

    "mean_batch_accuracy": f"""WITH {BATCHED}
SELECT round(coalesce(sum(acc) / count(acc), 0.0), 6) AS mean_accuracy, count(acc) AS n_batches FROM pb""",

    "metric_lines_mean": """WITH l AS (
  SELECT CASE WHEN event_type = 'error' THEN props ELSE CAST(value AS VARCHAR) END AS line FROM events),
p AS (SELECT TRY_CAST(trim(line) AS DOUBLE) AS v FROM l)
SELECT count(v) AS n_values, round(coalesce(sum(v) / count(v), 0.0), 6) AS mean_value
FROM p WHERE v IS NOT NULL""",

    "masked_cross_entropy": f"""WITH b AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e,
         CASE WHEN label = 0 THEN -100 ELSE label END AS label,
         row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings),
s AS (SELECT e, lead(label) OVER (PARTITION BY idx // {T.EVAL_BATCH} ORDER BY idx) AS nl FROM b),
x AS (SELECT e, list_max(e) AS m, nl FROM s WHERE nl IS NOT NULL AND nl <> -100),
y AS (SELECT m + ln(list_sum(list_transform(e, lambda v: exp(v - m)))) - e[nl + 1] AS nll FROM x)
SELECT round(coalesce(avg(nll), CAST('NaN' AS DOUBLE)), 6) AS loss, count(*) AS n_positions FROM y""",

    "next_token_pairs": f"""WITH t AS (SELECT item_id, {_tok('text')} AS tl FROM benchmark),
u AS (SELECT item_id, unnest(range(len(tl))) AS pos, unnest(tl) AS token FROM t),
w AS (SELECT item_id, pos, token, lead(token) OVER (PARTITION BY item_id ORDER BY pos) AS next_token FROM u)
SELECT item_id, CAST(pos AS INTEGER) AS pos, token, next_token FROM w WHERE next_token IS NOT NULL""",

    "bleu1": f"""WITH {PAIRS},
t AS (SELECT conv_id, turn, {_tok('answer')} AS hyp, {_tok('question')} AS ref FROM pairs),
h AS (SELECT conv_id, turn, g, count(*) AS hc FROM (SELECT conv_id, turn, unnest(hyp) AS g FROM t) GROUP BY ALL),
r AS (SELECT conv_id, turn, g, count(*) AS rc FROM (SELECT conv_id, turn, unnest(ref) AS g FROM t) GROUP BY ALL),
c AS (SELECT h.conv_id, h.turn, sum(least(hc, coalesce(rc, 0))) AS clip
      FROM h LEFT JOIN r ON h.conv_id = r.conv_id AND h.turn = r.turn AND h.g = r.g GROUP BY ALL)
SELECT t.conv_id, t.turn, CAST(len(hyp) AS BIGINT) AS hyp_len, CAST(len(ref) AS BIGINT) AS ref_len,
  CAST(coalesce(clip, 0) AS BIGINT) AS clip_1,
  round(CASE WHEN coalesce(clip, 0) = 0 THEN 0.0
             ELSE (CASE WHEN len(hyp) > len(ref) THEN 1.0 ELSE exp(1 - len(ref) / len(hyp)) END)
                  * exp(ln(clip / len(hyp))) END, 6) AS bleu1
FROM t LEFT JOIN c ON t.conv_id = c.conv_id AND t.turn = c.turn""",

    "bleu1_corpus": f"""WITH {PAIRS},
t AS (SELECT conv_id, turn, {_tok('answer')} AS hyp, {_tok('question')} AS ref FROM pairs),
h AS (SELECT conv_id, turn, g, count(*) AS hc FROM (SELECT conv_id, turn, unnest(hyp) AS g FROM t) GROUP BY ALL),
r AS (SELECT conv_id, turn, g, count(*) AS rc FROM (SELECT conv_id, turn, unnest(ref) AS g FROM t) GROUP BY ALL),
c AS (SELECT h.conv_id, h.turn, sum(least(hc, coalesce(rc, 0))) AS clip
      FROM h LEFT JOIN r ON h.conv_id = r.conv_id AND h.turn = r.turn AND h.g = r.g GROUP BY ALL),
s AS (SELECT sum(len(hyp)) AS c, sum(len(ref)) AS r, sum(coalesce(clip, 0)) AS m1, sum(len(hyp)) AS t1
      FROM t LEFT JOIN c ON t.conv_id = c.conv_id AND t.turn = c.turn)
SELECT round(CASE WHEN coalesce(m1, 0) = 0 THEN 0.0
                  ELSE (CASE WHEN c = 0 THEN 0.0 WHEN c > r THEN 1.0 ELSE exp(1 - r / c) END)
                       * exp(ln(m1 / t1)) END, 6) AS corpus_bleu1 FROM s""",

    "bleu4_corpus": f"""WITH {PAIRS},
t AS (SELECT conv_id, turn, {_tok('answer')} AS hyp, {_tok('question')} AS ref FROM pairs),
h1 AS (SELECT conv_id, turn, g, count(*) AS hc FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len(hyp) - 0 + 1), lambda i: array_to_string(list_slice(hyp, i, i + 0), ' '))) AS g FROM t) GROUP BY ALL),
r1 AS (SELECT conv_id, turn, g, count(*) AS rc FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len(ref) - 0 + 1), lambda i: array_to_string(list_slice(ref, i, i + 0), ' '))) AS g FROM t) GROUP BY ALL),
m1 AS (SELECT sum(least(hc, coalesce(rc, 0))) AS m FROM h1 LEFT JOIN r1 USING (conv_id, turn, g)),
h2 AS (SELECT conv_id, turn, g, count(*) AS hc FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len(hyp) - 1 + 1), lambda i: array_to_string(list_slice(hyp, i, i + 1), ' '))) AS g FROM t) GROUP BY ALL),
r2 AS (SELECT conv_id, turn, g, count(*) AS rc FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len(ref) - 1 + 1), lambda i: array_to_string(list_slice(ref, i, i + 1), ' '))) AS g FROM t) GROUP BY ALL),
m2 AS (SELECT sum(least(hc, coalesce(rc, 0))) AS m FROM h2 LEFT JOIN r2 USING (conv_id, turn, g)),
h3 AS (SELECT conv_id, turn, g, count(*) AS hc FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len(hyp) - 2 + 1), lambda i: array_to_string(list_slice(hyp, i, i + 2), ' '))) AS g FROM t) GROUP BY ALL),
r3 AS (SELECT conv_id, turn, g, count(*) AS rc FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len(ref) - 2 + 1), lambda i: array_to_string(list_slice(ref, i, i + 2), ' '))) AS g FROM t) GROUP BY ALL),
m3 AS (SELECT sum(least(hc, coalesce(rc, 0))) AS m FROM h3 LEFT JOIN r3 USING (conv_id, turn, g)),
h4 AS (SELECT conv_id, turn, g, count(*) AS hc FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len(hyp) - 3 + 1), lambda i: array_to_string(list_slice(hyp, i, i + 3), ' '))) AS g FROM t) GROUP BY ALL),
r4 AS (SELECT conv_id, turn, g, count(*) AS rc FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len(ref) - 3 + 1), lambda i: array_to_string(list_slice(ref, i, i + 3), ' '))) AS g FROM t) GROUP BY ALL),
m4 AS (SELECT sum(least(hc, coalesce(rc, 0))) AS m FROM h4 LEFT JOIN r4 USING (conv_id, turn, g)),
s AS (SELECT sum(len(hyp)) AS c, sum(len(ref)) AS r,
             sum(greatest(len(hyp) - 1, 0)) AS t2, sum(greatest(len(hyp) - 2, 0)) AS t3,
             sum(greatest(len(hyp) - 3, 0)) AS t4 FROM t)
SELECT round(CASE WHEN coalesce(m1, 0) = 0 OR coalesce(m2, 0) = 0 OR coalesce(m3, 0) = 0
                       OR coalesce(m4, 0) = 0 THEN 0.0
                  ELSE (CASE WHEN c = 0 THEN 0.0 WHEN c > r THEN 1.0 ELSE exp(1 - r / c) END)
                       * exp(ln(m1 / c) / 4 + ln(m2 / t2) / 4 + ln(m3 / t3) / 4
                             + ln(m4 / t4) / 4) END, 6) AS corpus_bleu4
FROM (SELECT *, (SELECT m FROM m1) AS m1, (SELECT m FROM m2) AS m2, (SELECT m FROM m3) AS m3,
             (SELECT m FROM m4) AS m4 FROM s)""",

    "assemble_prompt": """SELECT conv_id AS request_id,
  coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'user'), '') AS prompt_text
FROM conversations GROUP BY conv_id""",

    "last_media": """SELECT conv_id AS request_id,
  max_by(text, turn) FILTER (WHERE role = 'assistant' AND coalesce(length(text), 0) > 0) AS image_location
FROM conversations GROUP BY conv_id""",

    "media_validation": """SELECT conv_id AS request_id, turn AS pos,
  CASE role WHEN 'user' THEN 'text' WHEN 'assistant' THEN 'image' ELSE role END AS type,
  CASE WHEN role = 'assistant' AND coalesce(length(text), 0) > 0 THEN NULL
       WHEN role = 'assistant' THEN 'media type not supported: image'
       WHEN role = 'user' THEN
         (CASE WHEN text IS NULL THEN 'a text medium holds no text' END)
       ELSE 'media type not supported: ' || coalesce(role, 'None') END AS error
FROM conversations""",

    "expand_completions": """SELECT doc_id, num_completions, CAST(i AS INTEGER) AS i FROM (
  SELECT doc_id, quality + toxic AS num_completions, unnest(range(quality + toxic)) AS i FROM labels)""",

    "strip_prompt": f"""WITH {PAIRS},
t AS (SELECT conv_id, turn, {_tok('question')} AS q, {_tok('answer')} AS a FROM pairs),
g AS (SELECT conv_id, turn, list_concat(q, a) AS gen, len(q) AS k FROM t)
SELECT conv_id, turn, CAST(len(list_slice(gen, k + 1, len(gen))) AS INTEGER) AS n_kept,
       array_to_string(list_slice(gen, k + 1, len(gen)), ' ') AS kept_text FROM g""",

    "detokenize": f"""WITH {DOC_IDS}
SELECT ids.doc_id, string_agg(coalesce(v2.token, '<unk>'), ' ' ORDER BY ids.pos) AS text
FROM ids LEFT JOIN vocab v2 ON ids.token_id = v2.id GROUP BY ids.doc_id""",

    "cut_at_eos": f"""SELECT doc_id, {_cut('text')} AS output,
  CASE WHEN text IS NOT NULL AND strpos(text, {_lit(T.EOS_STANDIN)}) = 0 THEN 'substring not found' END AS error
FROM documents""",

    "token_structs": f"""WITH t AS (SELECT doc_id, {_tok('text')} AS tl FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(range(len(tl))) AS pos, unnest(tl) AS text FROM t)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, text, CAST(0 AS DOUBLE) AS logprob FROM u""",

    "cache_hits_misses": f"""WITH {REQ}
SELECT r.conv_id, r.turn, CAST(r.i AS INTEGER) AS i, r.cache_key, c.cache_key IS NOT NULL AS cached, c.output
FROM reqk r LEFT JOIN cache c ON r.cache_key = c.cache_key""",

    "result_assembly": f"""WITH {REQ},
comp AS (
  SELECT r.conv_id, r.turn, r.i, c.cache_key IS NOT NULL AS cached,
    CASE WHEN c.cache_key IS NOT NULL THEN c.output
         WHEN NOT list_contains({_tok('r.prompt')}, {_lit(T.FAILING_WORD)})
         THEN array_to_string(list_reverse({_tok('r.prompt')}), ' ') END AS output,
    CASE WHEN c.cache_key IS NULL AND list_contains({_tok('r.prompt')}, {_lit(T.FAILING_WORD)})
         THEN 'the stand-in refuses this prompt' END AS error,
    CASE WHEN c.cache_key IS NOT NULL THEN c.request_time ELSE CAST(0 AS DOUBLE) END AS request_time
  FROM reqk r LEFT JOIN cache c ON r.cache_key = c.cache_key),
g AS (
  SELECT conv_id, turn, bool_and(error IS NULL) AS ok, arg_max(cached, i) AS last_cached,
         arg_min(error, i) FILTER (WHERE error IS NOT NULL) AS first_error,
         arg_max(request_time, i) AS last_time, count(*) AS n,
         coalesce(string_agg(output, ' || ' ORDER BY i), '') AS txt
  FROM comp GROUP BY conv_id, turn)
SELECT conv_id, turn, ok AS success, CASE WHEN ok THEN last_cached ELSE false END AS cached,
  CASE WHEN NOT ok THEN first_error END AS error,
  CASE WHEN ok THEN round(last_time, 6) END AS request_time,
  CAST(CASE WHEN ok THEN n ELSE 0 END AS INTEGER) AS n_completions,
  CASE WHEN ok THEN txt ELSE '' END AS completion_text
FROM g""",

    "memoised_generation": f"""WITH {REQ},
two AS (SELECT *, unnest([conv_id, conv_id + 1]) AS image_id FROM req),
img AS (SELECT *, lpad(CAST(image_id AS VARCHAR), 12, '0') || '.jpg' AS image FROM two)
SELECT conv_id, turn, CAST(i AS INTEGER) AS i, image,
       sha256(to_json([CAST(n AS VARCHAR), CAST(i AS VARCHAR), {_lit(T.MODEL)},
                       md5(to_json([md5(prompt), image])::VARCHAR)])::VARCHAR) AS cache_key,
       array_to_string(list_concat([image], list_reverse({_tok('prompt')})), ' ') AS output, i = 0 AS cached FROM img""",

    "generation_bleu": f"""WITH {PAIRS},
t AS (SELECT conv_id, turn, {_tok('question')} AS hyp, {_tok('answer')} AS ref FROM pairs),
h AS (SELECT conv_id, turn, g, count(*) AS hc FROM (SELECT conv_id, turn, unnest(hyp) AS g FROM t) GROUP BY ALL),
r AS (SELECT conv_id, turn, g, count(*) AS rc FROM (SELECT conv_id, turn, unnest(ref) AS g FROM t) GROUP BY ALL),
c AS (SELECT h.conv_id, h.turn, sum(least(hc, coalesce(rc, 0))) AS clip
      FROM h LEFT JOIN r ON h.conv_id = r.conv_id AND h.turn = r.turn AND h.g = r.g GROUP BY ALL),
p AS (SELECT len(hyp) AS hl, len(ref) AS rl, coalesce(clip, 0) AS m,
        CASE WHEN coalesce(clip, 0) = 0 THEN 0.0
             ELSE (CASE WHEN len(hyp) > len(ref) THEN 1.0 ELSE exp(1 - len(ref) / len(hyp)) END)
                  * exp(ln(clip / len(hyp))) END AS b
      FROM t LEFT JOIN c ON t.conv_id = c.conv_id AND t.turn = c.turn),
s AS (SELECT sum(hl) AS c, sum(rl) AS r, sum(m) AS m1, avg(b) AS mb, count(*) AS n FROM p)
SELECT round(CASE WHEN coalesce(m1, 0) = 0 THEN 0.0
                  ELSE (CASE WHEN c = 0 THEN 0.0 WHEN c > r THEN 1.0 ELSE exp(1 - r / c) END)
                       * exp(ln(m1 / c)) END, 6) AS corpus_bleu1,
       round(mb, 6) AS mean_bleu1, n AS n_requests FROM s""",

    "row_map_prompt": f"""SELECT doc_id, {_lit(_PRE)} || coalesce(nfc_normalize(text), 'None') || {_lit(_SUF)} AS question
FROM documents""",

    "stream_accuracy": f"""WITH {BATCHED}
SELECT CAST(batch_id % {T.NUM_RANKS} AS INTEGER) AS rank, count(*) AS n_values,
       round(sum(acc), 6) AS sum_value, round(sum(acc) / count(*), 6) AS mean_value
FROM pb GROUP BY batch_id % {T.NUM_RANKS}""",

    "nested_json_roundtrip": """SELECT d.doc_id, lang, source, n_chars, md5(text) AS text_md5, quality, toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",

    "archive_entries": """SELECT page_id || '/page.html' AS entry, strlen(coalesce(html, '')) AS length,
       md5(coalesce(html, '')) AS content_md5, NULL::VARCHAR AS error FROM pages""",

    "archive_members": """SELECT page_id, 'url.txt' AS entry, strlen(coalesce(url, '')) AS length, md5(coalesce(url, '')) AS content_md5,
       NULL::VARCHAR AS error FROM pages
UNION ALL SELECT page_id, 'html.txt', strlen(coalesce(html, '')), md5(coalesce(html, '')), NULL FROM pages""",

    "image_lookup": """SELECT doc_id, strlen(coalesce(html, '')) AS image_bytes, md5(coalesce(html, '')) AS content_md5
FROM documents JOIN pages ON doc_id = page_id""",

    "log_roundtrip": """SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS loss,
       CASE WHEN event_type = 'error' THEN props END AS message, CASE WHEN event_type = 'click' THEN user_id END AS user_id,
       CASE WHEN event_type = 'click' THEN event_type END AS kind FROM events""",

    "metric_lines_consumed": f"""WITH {BATCHED}
SELECT CAST(1 + batch_id % 2 AS INTEGER) AS call, CAST(batch_id % {T.NUM_RANKS} AS INTEGER) AS rank, count(*) AS n_values,
       round(sum(acc), 6) AS sum_value FROM pb GROUP BY ALL""",
}
