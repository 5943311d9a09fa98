"""DuckDB SQL for the queries of ``queries``, built from shared parts."""

from __future__ import annotations

from lexweave.operators.permutation import ROUNDS

PAIRS = """
raw_lines AS (
  SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'zh_Hans' WHEN 'es' THEN 'pt_BR' WHEN 'fr' THEN 'pt_BR' END AS src_lang,
         string_split(text, chr(10)) AS l
  FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
pair_rows AS (SELECT doc_id, src_lang, l, unnest(range(0, len(l) // 2)) AS k FROM raw_lines WHERE src_lang IS NOT NULL),
pairs AS (
  SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS ord, src_lang, CASE WHEN src_lang = 'en' THEN 'pt_BR' ELSE 'en' END AS tgt_lang,
         l[2 * k + 1] AS src, l[2 * k + 2] AS tgt
  FROM pair_rows)"""


def _key(text: str) -> str:
    words = f"trim(regexp_replace(lower(nfc_normalize({text})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
    return f"CASE WHEN {words} = '' THEN trim(nfc_normalize({text})) ELSE {words} END"


KEYED = f""",
keyed AS (SELECT *, src_lang || chr(31) || {_key("src")} AS a, tgt_lang || chr(31) || {_key("tgt")} AS b FROM pairs),
nodes AS (SELECT a AS key FROM keyed UNION SELECT b FROM keyed)"""

_BYTES = "[(strpos('0123456789ABCDEF', substr(hex(encode({k})), 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode({k})), 2 * i + 2, 1)) - 1 FOR i IN range(0, octet_length(encode({k})))]"


def _fnv(key: str) -> str:
    values = _BYTES.format(k=key)
    return f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, {values}::UHUGEINT[]), lambda h, x: (xor(h, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


COMPONENTS = """,
links AS (SELECT a, b FROM keyed WHERE a <> b UNION SELECT b, a FROM keyed WHERE a <> b),
reach AS (SELECT key AS s, key AS t FROM nodes UNION SELECT reach.s, links.b FROM reach JOIN links ON links.a = reach.t),
least AS (SELECT s AS key, min(t) AS least FROM reach GROUP BY s)"""

SPLITS = f""",
hashed AS (SELECT least, CAST({_fnv("least")} % 1000 AS INTEGER) AS bucket FROM (SELECT DISTINCT least FROM least)),
assigned AS (
  SELECT keyed.*, least.least, CASE WHEN bucket < 10 THEN 'test' WHEN bucket < 20 THEN 'valid' ELSE 'train' END AS split
  FROM keyed JOIN least ON least.key = keyed.a JOIN hashed ON hashed.least = least.least)"""

_IDS = "[x + 1 FOR x IN " + _BYTES + "]"
TOKENS = f""",
tokens AS (SELECT ord, split, src_lang, tgt_lang, {_IDS.format(k="src")} AS src_tok, {_IDS.format(k="tgt")} AS tgt_tok FROM assigned)"""

VOCABULARY = """,
used AS (SELECT DISTINCT unnest(list_concat(src_tok, tgt_tok)) AS token_id FROM tokens),
vocabulary AS (
  SELECT CAST(unnest([0, 1, 2, 3, 4, 5]) AS INTEGER) AS compact_id, CAST(unnest([65530, 65531, 65532, 65533, 65534, 65535]) AS INTEGER) AS token_id
  UNION ALL SELECT CAST(row_number() OVER (ORDER BY token_id) + 5 AS INTEGER), CAST(token_id AS INTEGER) FROM used),
book AS (SELECT map_from_entries(list({'k': token_id, 'v': compact_id})) AS m FROM vocabulary),
encoded AS (SELECT ord, split, src_lang, tgt_lang, [m[x] FOR x IN src_tok] AS src_ids, [m[x] FOR x IN tgt_tok] AS tgt_ids FROM tokens, book)"""

ITEMS = """,
ways AS (
  SELECT ord, split, 0 AS dir, src_lang, tgt_lang, src_ids, tgt_ids, len(src_ids) + 2 AS src_len, len(tgt_ids) + 1 AS tgt_len FROM encoded
  UNION ALL SELECT ord, split, 1, tgt_lang, src_lang, tgt_ids, src_ids, len(tgt_ids) + 2, len(src_ids) + 1 FROM encoded),
judged AS (
  SELECT *, CASE WHEN len(src_ids) = 0 OR len(tgt_ids) = 0 THEN 'empty' WHEN src_len > 128 OR tgt_len > 128 THEN 'too_long' END AS dropped FROM ways),
items AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY ord, dir) - 1 AS item_idx FROM judged WHERE dropped IS NULL)"""


def _splitmix(x: str) -> str:
    m = "18446744073709551616::UHUGEINT"
    z0 = f"((({x})::UHUGEINT + 11400714819323198485::UHUGEINT) % {m})"
    step = lambda z, s, c: f"((xor({z}, {z} >> {s}) * {c}::UHUGEINT) % {m})"
    z2 = step(step(z0, 30, 13787848793156543929), 27, 10723151780598845931)
    return f"xor({z2}, {z2} >> 31)"


BATCHES = f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY src_len, tgt_len, {_splitmix("xor(item_idx, 42)")}) - 1 AS rank FROM items),
walk AS (
  SELECT split, rank, item_idx, 0::BIGINT AS batch_id, 0::BIGINT AS pos_in_batch, greatest(src_len, tgt_len) AS longest FROM ranked WHERE rank = 0
  UNION ALL
  SELECT r.split, r.rank, r.item_idx,
         CASE WHEN f THEN w.batch_id + 1 ELSE w.batch_id END, CASE WHEN f THEN 0 ELSE w.pos_in_batch + 1 END,
         CASE WHEN f THEN greatest(r.src_len, r.tgt_len) ELSE greatest(w.longest, r.src_len, r.tgt_len) END
  FROM walk w JOIN ranked r ON r.split = w.split AND r.rank = w.rank + 1,
       LATERAL (SELECT w.pos_in_batch + 1 = 128 OR (w.pos_in_batch + 2) * greatest(w.longest, r.src_len, r.tgt_len) > 3072 AS f)),
batched AS (SELECT i.*, w.batch_id, w.pos_in_batch FROM walk w JOIN items i ON i.split = w.split AND i.item_idx = w.item_idx)"""

LAYOUT = """,
wide AS (
  SELECT *, count(*) OVER b AS batch_size, max(src_len) OVER b AS bs, max(tgt_len) OVER b AS bt FROM batched WINDOW b AS (PARTITION BY split, batch_id)),
rows_ AS (
  SELECT *, list_concat([CASE tgt_lang WHEN 'en' THEN 3 WHEN 'pt_BR' THEN 4 ELSE 5 END], src_ids, [2]) AS s, list_concat([1], tgt_ids) AS ti, list_concat(tgt_ids, [2]) AS t FROM wide),
padded AS (
  SELECT split, batch_id, pos_in_batch, batch_size, bs, bt, list_concat(s, [0 FOR x IN range(len(s), bs)]) AS src, list_concat(ti, [0 FOR x IN range(len(ti), bt)]) AS tgt_in,
         list_concat(t, [0 FOR x IN range(len(t), bt)]) AS tgt_out FROM rows_)"""

LOSSES = """
logits AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, embedding AS raw, label AS target FROM embeddings),
sums AS (SELECT *, list_max(x) + ln(list_sum([exp(v - list_max(x)) FOR v IN x])) AS whole FROM logits),
token_losses AS (
  SELECT vec_id, vec_id % 12 AS epoch, (vec_id // 12) % 5 AS batch, CAST(target <> 0 AS INTEGER) AS valid, x[target + 1] - whole AS log_p,
         -(0.9 * (x[target + 1] - whole) + 0.1 * (list_avg(x) - whole)) AS smooth, CAST(list_position(raw, list_max(raw)) - 1 = target AS INTEGER) AS hit
  FROM sums),
batch_losses AS (
  SELECT epoch, batch, sum(smooth * valid) / greatest(sum(valid), 1) AS loss, -sum(log_p * valid) AS nll_sum, CAST(sum(hit * valid) AS BIGINT) AS correct, CAST(sum(valid) AS BIGINT) AS tokens
  FROM token_losses GROUP BY epoch, batch)"""

EPOCHS = """,
epochs AS (
  SELECT epoch, round(avg(loss), 6) AS loss FROM batch_losses GROUP BY epoch),
marked AS (SELECT *, min(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM epochs)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + "".join(parts)


_TO_KEYS = (PAIRS, KEYED)
_TO_SPLITS = (*_TO_KEYS, COMPONENTS, SPLITS)
_TO_CODES = (*_TO_SPLITS, TOKENS, VOCABULARY)
_TO_BATCHES = (*_TO_CODES, ITEMS, BATCHES)
_TO_ROWS = (*_TO_BATCHES, LAYOUT)
_text = lambda c: f"array_to_string({c}, ',')"
_bits = lambda c: f"array_to_string([CASE WHEN x = 0 THEN '1' ELSE '0' END FOR x IN {c}], '')"

ORACLES = {
    "q_pairs": _with(PAIRS) + " SELECT ord, src_lang, tgt_lang, src, tgt FROM pairs",
    "q_conversation_pairs": """
SELECT u.conv_id, u.turn, u.text AS src, a.text AS tgt FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""",
    "q_normalize_key": _with(PAIRS) + f"""
SELECT ord, CAST(0 AS INTEGER) AS side, {_key("src")} AS key FROM pairs UNION ALL SELECT ord, CAST(1 AS INTEGER), {_key("tgt")} FROM pairs""",
    "q_edges": _with(*_TO_KEYS) + " SELECT ord, a, b FROM keyed",
    "q_nodes": _with(*_TO_KEYS) + " SELECT key FROM nodes",
    "q_fnv1a": _with(*_TO_KEYS) + f"""
SELECT key, lpad(lower(to_hex(h)), 16, '0') AS hash, CAST(h % 1000 AS INTEGER) AS bucket FROM (SELECT key, CAST({_fnv("key")} AS UBIGINT) AS h FROM nodes)""",
    "q_components": _with(*_TO_KEYS, COMPONENTS) + """,
own AS (SELECT ord, least FROM keyed JOIN least ON least.key = keyed.a),
first AS (SELECT least, row_number() OVER (ORDER BY min(ord)) - 1 AS component FROM own GROUP BY least)
SELECT ord, least, component FROM own JOIN first USING (least)""",
    "q_split_assign": _with(*_TO_SPLITS) + " SELECT ord, split FROM assigned",
    "q_split_counts": _with(*_TO_SPLITS) + " SELECT split, count(*) AS pairs, count(DISTINCT least) AS components FROM assigned GROUP BY split",
    "q_tokens": _with(PAIRS) + f" SELECT ord, {_text(_IDS.format(k='src'))} AS ids FROM pairs",
    "q_detokenize": _with(PAIRS) + " SELECT ord, src AS text FROM pairs",
    "q_vocab": _with(*_TO_CODES) + " SELECT compact_id, token_id FROM vocabulary",
    "q_encode": _with(*_TO_CODES) + f" SELECT ord, {_text('src_ids')} AS src_ids, {_text('tgt_ids')} AS tgt_ids FROM encoded",
    "q_decode": _with(*_TO_CODES) + f" SELECT ord, {_text('src_tok')} AS src_tokens FROM tokens",
    "q_items": _with(*_TO_CODES, ITEMS) + """
SELECT split, item_idx, ord, CAST(dir AS INTEGER) AS dir, src_lang, tgt_lang, CAST(src_len AS INTEGER) AS src_len, CAST(tgt_len AS INTEGER) AS tgt_len FROM items""",
    "q_build_stats": _with(*_TO_CODES, ITEMS) + """
SELECT split, count(*) FILTER (dir = 0) AS pairs_in_split, count(*) FILTER (dropped IS NULL) AS items, count(*) FILTER (dropped = 'too_long') AS dropped_too_long,
       count(*) FILTER (dropped = 'empty') AS dropped_empty FROM judged GROUP BY split""",
    "q_splitmix": f"""
SELECT event_id, lpad(lower(to_hex(z)), 16, '0') AS hash, z >= 9223372036854775808 AS upper_half
FROM (SELECT event_id, CAST({_splitmix("xor(event_id, 42)")} AS UBIGINT) AS z FROM events)""",
    "q_bucketed": _with(*_TO_BATCHES) + " SELECT split, item_idx, batch_id, pos_in_batch FROM batched",
    "q_batches_any_length": _with(*_TO_CODES, ITEMS.replace("128", "2147483647"), BATCHES) + " SELECT split, item_idx, batch_id, pos_in_batch FROM batched",
    "q_batch_stats": _with(*_TO_BATCHES) + """,
each AS (SELECT split, batch_id, count(*) AS n, sum(src_len + tgt_len) AS real, max(src_len) + max(tgt_len) AS width FROM batched GROUP BY split, batch_id)
SELECT split, count(*) AS batches, max(n) AS largest_batch, CAST(sum(real) AS BIGINT) AS real_tokens, CAST(sum(n * width) AS BIGINT) AS padded_tokens FROM each GROUP BY split""",
    "q_epoch_order": _with(*_TO_BATCHES) + f""",
counted AS (SELECT n, half, (1::UBIGINT << half) - 1 AS mask FROM (SELECT n, greatest(1, (length(bin(greatest(1, n - 1))) + 1) // 2)::UBIGINT AS half FROM (SELECT max(batch_id) + 1 AS n FROM batched WHERE split = 'train'))),
turns AS (SELECT turn, CAST({_splitmix(f"turn + {42 ^ (1 << 32)}")} AS UBIGINT) AS k FROM range({ROUNDS}) t(turn)),
walked AS (
  SELECT id AS batch_id, 0 AS turn, (id::UBIGINT >> half) AS l, (id::UBIGINT & mask) AS r FROM (SELECT unnest(range(n)) AS id, half, mask FROM counted)
  UNION ALL
  SELECT batch_id, turn + 1, r, xor(l, CAST({_splitmix("xor(r, k)")} AS UBIGINT) & mask) FROM (
    SELECT walked.batch_id, walked.turn, walked.l, walked.r, turns.k, mask, half, n FROM walked JOIN turns ON turns.turn = walked.turn % {ROUNDS}, counted)
  WHERE turn = 0 OR turn % {ROUNDS} > 0 OR (l << half) + r >= n)
SELECT batch_id, CAST((l << half) + r AS BIGINT) AS place FROM walked, counted WHERE turn > 0 AND turn % {ROUNDS} = 0 AND (l << half) + r < n""",
    "q_pad": _with(*_TO_ROWS) + f" SELECT split, batch_id, pos_in_batch, {_text('src')} AS src, {_text('tgt_in')} AS tgt_in, {_text('tgt_out')} AS tgt_out FROM padded",
    "q_masks": _with(*_TO_ROWS) + f" SELECT split, batch_id, pos_in_batch, {_bits('src')} AS src_pad_mask, {_bits('tgt_in')} AS tgt_pad_mask FROM padded",
    "q_matrices": _with(*_TO_ROWS) + f"""
SELECT split, batch_id, batch_size, CAST(bs AS INTEGER) AS src_len, CAST(bt AS INTEGER) AS tgt_len, sha256(string_agg({_text('src')}, ',' ORDER BY pos_in_batch)) AS src_sha256,
       sha256(string_agg({_text('tgt_out')}, ',' ORDER BY pos_in_batch)) AS tgt_out_sha256 FROM padded GROUP BY split, batch_id, batch_size, bs, bt""",
    "q_causal_mask": """
SELECT n_nationkey, array_to_string([repeat('0', i) || repeat('1', n_nationkey - i) FOR i IN range(1, n_nationkey + 1)], '/') AS mask
FROM (SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey FROM nation)""",
    "q_log_softmax": "WITH " + LOSSES + " SELECT vec_id, CAST(unnest(range(0, len(x))) AS INTEGER) AS pos, round(unnest([v - whole FOR v IN x]), 6) AS value FROM sums",
    "q_argmax": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings",
    "q_smoothed_loss": "WITH " + LOSSES + " SELECT epoch, batch, round(loss, 6) AS loss, round(nll_sum, 5) AS nll_sum, correct, tokens FROM batch_losses",
    "q_accuracy": "WITH " + LOSSES + """
SELECT epoch, batch, round(100.0 * correct::DOUBLE / greatest(tokens, 1), 6) AS accuracy, round(exp(nll_sum / greatest(tokens, 1)), 4) AS perplexity FROM batch_losses""",
    "q_perplexity": "WITH " + LOSSES + """
SELECT epoch, round(100.0 * sum(correct)::DOUBLE / greatest(sum(tokens), 1), 6) AS accuracy, round(exp(sum(nll_sum) / greatest(sum(tokens), 1)), 4) AS perplexity,
       round(avg(loss), 6) AS loss, CAST(sum(tokens) AS BIGINT) AS tokens FROM batch_losses GROUP BY epoch""",
    "q_running_metrics": "WITH " + LOSSES + """
SELECT epoch, batch, round(100.0 * (sum(correct) OVER w)::DOUBLE / greatest(sum(tokens) OVER w, 1), 6) AS accuracy, round(exp(sum(nll_sum) OVER w / greatest(sum(tokens) OVER w, 1)), 4) AS perplexity,
       round(avg(loss) OVER w, 6) AS loss, CAST(sum(tokens) OVER w AS BIGINT) AS tokens
FROM batch_losses WINDOW w AS (PARTITION BY epoch ORDER BY batch ROWS UNBOUNDED PRECEDING)""",
    "q_early_stop": "WITH " + LOSSES + EPOCHS + """,
last AS (SELECT *, min(loss) OVER (ORDER BY epoch) AS best, max(CASE WHEN before IS NULL OR loss < before THEN epoch END) OVER (ORDER BY epoch) AS better FROM marked)
SELECT epoch, loss, best, epoch - better AS since, epoch - better >= 3 AS stop FROM last""",
}
