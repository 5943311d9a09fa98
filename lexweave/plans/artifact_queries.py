"""Queries for what the pair engine reads, writes and controls: vocabulary and pair files, the tokenizer with long tokens,
artifacts, single rows and batches, Unicode, the translation model and the run's settings. Each has its DuckDB SQL
beside it; those that write use the shared checkpoint folder."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.functions.text import is_blank, normalize_key, trim_unicode, with_nfc
from lexweave.functions.tokens import BOS, EOS, Tokenizer, is_special
from lexweave.operators import layout, store, translation
from lexweave.plans import fixtures, training
from lexweave.plans.config import ModelConfig, TrainingConfig, is_memory_error, with_smaller_batches
from lexweave.plans.corpus import Corpus
from lexweave.plans.oracles import ORACLES as _CORE, _TO_BATCHES, _TO_CODES, PAIRS, _key, _with
from lexweave.plans.session import ensure_checkpoint_dir
from lexweave.sources.jsonl import pairs_from_rows, read_config, read_pairs, read_vocabulary, write_config, write_vocabulary

#: The vocabulary of the registered queries: the bytes, then so many of the commonest words, alone and after a space.
WORDS = 1000
RUN = TrainingConfig.full_run()


def _folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/queries-{uuid.uuid4()}"


def _literal(data: bytes, escaped: bool) -> str:
    """A token as the vocabulary file writes it: quoted, with escapes or as it is, raw bytes where it is no text."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return repr(data)
    return ascii(text) if escaped or not text.isprintable() or set(text) & set("\\'") else f"'{text}'"


def _tokenizer(spark: SparkSession, sf_dir: str, words: int = WORDS) -> Tokenizer:
    """Through a vocabulary file: bytes and the commonest words of the documents."""
    word = F.explode(F.split("text", "[ \n]+")).alias("w")
    counted = fixtures.table(spark, sf_dir, "documents").select(word).where(F.octet_length("w").between(2, 16)).groupBy("w").count()
    common = [r["w"].encode() for r in counted.orderBy(F.desc("count"), "w").limit(words).collect()] if words else []
    table = [bytes([b]) for b in range(256)] + common + [b""] * (words - len(common)) + [b" " + w for w in common]
    lines = [(f"{i} {_literal(w, i % 2 == 0)} {len(w)}",) for i, w in enumerate(table, 1) if w]
    path = _folder(spark)
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(path)
    return Tokenizer.load(spark, path)


_VOCABULARY = f"""
common AS (
  SELECT w, row_number() OVER (ORDER BY n DESC, w) AS r FROM (
    SELECT w, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS w FROM documents WHERE text IS NOT NULL)
    WHERE octet_length(encode(w)) BETWEEN 2 AND 16 GROUP BY w)
  QUALIFY r <= {WORDS}),
known AS (
  SELECT CAST(b + 1 AS INTEGER) AS token_id, printf('%02X', b) AS x FROM range(256) t(b)
  UNION ALL SELECT CAST(256 + r AS INTEGER), hex(encode(w)) FROM common
  UNION ALL SELECT CAST({256 + WORDS} + r AS INTEGER), hex(encode(' ' || w)) FROM common)"""


def q_vocabulary_file(spark, sf_dir):
    return _tokenizer(spark, sf_dir).frame().select("token_id", F.hex("bytes").alias("hex"), F.octet_length("bytes").cast("long").alias("size"))


def q_tokens_long(spark, sf_dir):
    ids = _tokenizer(spark, sf_dir).encode(F.col("text"))
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


def q_detokenize_long(spark, sf_dir):
    """Ids with specials at both ends back to text."""
    t = _tokenizer(spark, sf_dir)
    ids = F.concat(F.array(F.lit(BOS)), t.encode(F.col("text")), F.array(F.lit(EOS), F.lit(0)))
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")).select("doc_id", t.decode(F.col("ids")).alias("text"))


def q_token_bytes(spark, sf_dir):
    token = (F.col("event_id") * 7 % 65536).cast("int")
    rows = fixtures.table(spark, sf_dir, "events").select("event_id", token.alias("token"))
    return rows.select("event_id", is_special(F.col("token")).alias("special"), F.hex(_tokenizer(spark, sf_dir).token_bytes(F.col("token"))).alias("hex"))


def _pair_file(spark: SparkSession, sf_dir: str) -> str:
    """The document pairs as JSON lines, a blank line after every tenth."""
    seg = F.col("ord").cast("decimal(20,0)") + F.lit("18446744073700000000").cast("decimal(20,0)")
    record = F.struct(
        F.concat(F.lit("p"), "ord").alias("id"), "src_lang", "tgt_lang", "src", "tgt", F.lit("documents").alias("corpus"),
        F.when(F.col("ord") % 3 != 0, F.col("src_lang")).alias("doc"), F.when(F.col("ord") % 2 == 0, seg.cast("decimal(20,0)")).alias("seg"),
    )
    line = F.concat(F.to_json(record), F.when(F.col("ord") % 10 == 9, "\n \t").otherwise(""))
    path = _folder(spark)
    fixtures.document_pairs(spark, sf_dir).orderBy("ord").select(line.alias("value")).write.text(path)
    return path


def q_jsonl_pairs(spark, sf_dir):
    return read_pairs(spark, _pair_file(spark, sf_dir)).withColumn("seg", F.col("seg").cast("string"))


def q_memory_pairs(spark, sf_dir):
    """The in-memory source: one pair for each nation, in the order of the keys."""
    nations = fixtures.table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 at any scale
    rows = [{"id": f"n{r['n_nationkey']}", "src_lang": "en", "tgt_lang": "pt_BR", "src": r["n_name"], "tgt": r["n_name"].lower(), "seg": r["n_nationkey"]} for r in nations]
    return pairs_from_rows(spark, rows).withColumn("seg", F.col("seg").cast("string"))


def q_corpus_summary(spark, sf_dir):
    """From the pair file and a vocabulary file of bytes to the corpus's figures."""
    return Corpus.load(spark, _pair_file(spark, sf_dir), _tokenizer(spark, sf_dir, words=0)).summary()


def q_vocabulary_sink(spark, sf_dir):
    """Written over another vocabulary, read again."""
    corpus, path = Corpus(fixtures.document_pairs(spark, sf_dir, numbered=False), Tokenizer(spark)), _folder(spark)
    write_vocabulary(spark.createDataFrame([(0, 65530), (1, 65531)], "compact_id int, token_id int"), path)
    write_vocabulary(corpus.vocabulary, path)
    return read_vocabulary(spark, path)


def q_config_sink(spark, sf_dir):
    """The settings and the sizes of the corpus that they are for, written over others and read again."""
    path = _folder(spark)
    counted = fixtures.table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).count().collect()  # a row for each language
    write_config(spark, {"old": 1}, path)
    write_config(spark, asdict(RUN) | {"documents": {r["lang"]: r["count"] for r in counted}}, path)
    read = read_config(spark, path)
    assert {k: v for k, v in read.items() if k != "documents"} == asdict(RUN)
    flat = {k: v for k, v in read.items() if not isinstance(v, dict)} | {f"{k}.{n}": v for k, x in read.items() if isinstance(x, dict) for n, v in x.items()}
    return spark.createDataFrame([(k, float(v)) for k, v in flat.items()] + [("max_tokens", float(RUN.max_tokens))], "name string, value double")


def _parameter(i: int, j: int) -> float:
    """A number that half precision holds exactly."""
    return ((i * 5 + j * 3) % 17 - 8) / 8


def _matrix(rows: int, columns: int) -> np.ndarray:
    return np.array([[_parameter(i, j) for j in range(columns)] for i in range(rows)])


def q_model_sink(spark, sf_dir):
    """A model of each label's mean embedding: checkpoints of two epochs and the model, the second over the first; read again."""
    path, out = _folder(spark), []
    entries = fixtures.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    means = entries.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("label", "dim").collect()  # labels by dimensions
    labels = sorted({r["label"] for r in means})
    matrix = np.array([r["x"] for r in means]).reshape(len(labels), -1)
    for epoch in range(2):
        training._save(spark, {"embedding": matrix * (epoch + 1), "labels": np.array(labels, dtype=float)}, f"{path}/checkpoints/{epoch}")
        training._save(spark, {"embedding": matrix * (epoch + 1), "labels": np.array(labels, dtype=float)}, f"{path}/model")
    for name in ("checkpoints/0", "checkpoints/1", "model"):
        out += [(name, k, i, round(float(x), 2) + 0.0) for k, v in training.load(spark, f"{path}/{name}").items() for i, x in enumerate(v.ravel())]
    return spark.createDataFrame(out, "file string, name string, place int, value double")


def q_random_access(spark, sf_dir):
    """Items and batches by number from a stored corpus, some beyond the end, and their numbers in all."""
    stored = Corpus(fixtures.document_pairs(spark, sf_dir), Tokenizer(spark)).save(_folder(spark), RUN, per_items=500, per_batches=8, per_tensors=8)
    out = stored.sizes().select(F.lit("len").alias("kind"), "split", F.col("items").alias("number"), F.lit(None).cast("long").alias("ord"), F.lit(None).cast("int").alias("dir"))
    for split, number in (("train", 0), ("train", 7), ("valid", 3), ("train", 10**9), ("nowhere", 0)):
        out = out.unionByName(stored.item(split, number).select(F.lit("item").alias("kind"), "split", F.col("item_idx").alias("number"), "ord", "dir"))
    for split, number in (("train", 1), ("valid", 0), ("train", 10**9)):
        out = out.unionByName(stored.batch(split, number).select(F.lit(f"batch {number}").alias("kind"), "split", F.col("pos_in_batch").alias("number"), "ord", "dir"))
    return out


def q_tensor_store(spark, sf_dir):
    """Every batch's matrices from tensor shards; a batch that is read by its number is the same."""
    path, per = _folder(spark), 8
    batched = Corpus(fixtures.document_pairs(spark, sf_dir), Tokenizer(spark)).batched(RUN)
    store.write_tensors(layout.batch_matrices(batched), path, per)
    stored = store.read_clustered(spark, path)
    one = store.at(stored, "batch_id", "train", 1, per)
    every = stored.drop("cluster").where("split <> 'train' OR batch_id <> 1").unionByName(one)

    def unpack(frames):
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                m = {k: hashlib.sha256(",".join(map(str, v.ravel().tolist())).encode()).hexdigest() for k, v in store.to_matrices(r).items()}
                rows.append((r["split"], r["batch_id"], r["batch_size"], r["src_len"], r["tgt_len"], m["src"], m["tgt_out"]))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in shape.split(", ")])

    shape = "split string, batch_id long, batch_size long, src_len int, tgt_len int, src_sha256 string, tgt_out_sha256 string"
    return every.mapInPandas(unpack, shape)


#: Around and after a name: white space of several kinds, letters with separate accents, blank text.
DECORATIONS = ("", " \t", "　 ", "é ", "Å\n", " \u0085")


def q_unicode(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "nation").select("n_nationkey", F.inline(F.array(*[
        F.struct(F.lit(i).alias("kind"), F.concat(F.lit(d), F.when(F.col("n_nationkey") % 5 == 4, "").otherwise(F.col("n_name")), F.lit(d[::-1] if d[:1].isspace() else d)).alias("text"))
        for i, d in enumerate(DECORATIONS)
    ])))
    formed = with_nfc(rows, "text")
    return formed.select("n_nationkey", "kind", F.hex(F.col("text").cast("binary")).alias("formed"), trim_unicode(F.col("text")).alias("trimmed"), is_blank(F.col("text")).alias("blank"), normalize_key(F.col("text")).alias("key"))


_SIGNS = {" ": 160, "\t": 9, "　": 12288, " ": 32, " ": 8195, "\n": 10, "\u0085": 133}
_SPACES = " || ".join(f"chr({x})" for x in _SIGNS.values())


def _sql_text(text: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in text) or "''"


_UNICODE = " UNION ALL ".join(
    f"SELECT n_nationkey, CAST({i} AS INTEGER) AS kind, nfc_normalize({_sql_text(d)} || CASE WHEN n_nationkey % 5 = 4 THEN '' ELSE n_name END || {_sql_text(d[::-1] if d[:1].isspace() else d)}) AS t FROM nation"
    for i, d in enumerate(DECORATIONS)
)

# --- the translation model

WIDTH, KINDS = 8, 9


def _by_nation(spark, sf_dir, run, schema: str) -> DataFrame:
    """``run`` gives the rows of (nation key, region key); the table has 25 rows at any scale."""

    def work(frames):
        for frame in frames:
            rows = [x for k, g in zip(frame["n_nationkey"], frame["n_regionkey"], strict=True) for x in run(int(k), int(g))]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])

    return fixtures.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").mapInPandas(work, schema)


def _model() -> translation.Model:
    """One layer of width 8 and two heads, all parameters by rule."""
    config = ModelConfig(KINDS, width=WIDTH, layers=1, heads=2, max_length=8, dropout=0.0)
    parameters = translation.initial(config, 0)
    return translation.Model(config, {k: np.reshape([_parameter(i, n) / 2 for i in range(v.size)], v.shape) for n, (k, v) in enumerate(sorted(parameters.items()))} | {"embedding": _matrix(KINDS, WIDTH)})


def _ids(key: int, region: int) -> np.ndarray:
    return np.array([[1 + key % 8, 1 + region, 1 + (key + region) % 8]])


def q_embed(spark, sf_dir):
    def run(key, region):
        x = _model()._embed(_ids(key, region)).data[0]
        return [(key, i, j, round(float(x[i, j]), 6) + 0.0) for i in range(x.shape[0]) for j in range(x.shape[1])]

    return _by_nation(spark, sf_dir, run, "n_nationkey int, pos int, dim int, value double")


def q_tied_output(spark, sf_dir):
    def run(key, region):
        hidden = translation.Value(np.array([[[_parameter(key, j) for j in range(WIDTH)]]]))
        return [(key, v, float(x)) for v, x in enumerate(_model().project(hidden).data[0, 0])]

    return _by_nation(spark, sf_dir, run, "n_nationkey int, token int, logit double")


def q_forward(spark, sf_dir):
    """Log-probabilities of the decoder, and of the encoder alone, for a batch of three source and two target ids."""

    def run(key, region):
        src, out = _ids(key, region), []
        for side, x in (("decoder", _model().logits(src, np.array([[1, 1 + region]])).data[0]), ("encoder", _model().logits(src).data[0])):
            log_p = x - x.max(axis=1, keepdims=True)
            log_p -= np.log(np.exp(log_p).sum(axis=1, keepdims=True))
            out += [(key, side, i, v, round(float(log_p[i, v]), 6)) for i in range(len(x)) for v in range(KINDS)]
        return out

    return _by_nation(spark, sf_dir, run, "n_nationkey int, side string, pos int, token int, log_p double")


def q_train_step(spark, sf_dir):
    """The loss of one batch before each of five steps, and without a step after them."""

    def run(key, region):
        model = _model()
        config, own, adam = model.config, {k: v.data.copy() for k, v in model.p.items()}, translation.Adam(0.01, beta_2=0.98)
        batch = {"src": _ids(key, region), "tgt_in": np.array([[1, 3]]), "tgt_out": np.array([[3, 2]])}
        stats = [translation.train_step(config, own, adam, batch, 0.1, seed) for seed in range(5)]
        stats.append(translation.valid_step(config, own, batch, 0.1))
        return [(key, i, round(float(s[0]), 5), int(s[3])) for i, s in enumerate(stats)]

    return _by_nation(spark, sf_dir, run, "n_nationkey int, step int, loss double, tokens long")


def q_adam(spark, sf_dir):
    def run(key, region):
        own, adam, out = {"x": np.array([key / 10])}, translation.Adam(RUN.learning_rate, beta_2=RUN.beta_2), []
        for t in range(1, 7):
            adam.step(own, {"x": np.array([((key + t) % 5 - 2) / 3])})
            out.append((key, t, round(float(own["x"][0]), 9)))
        return out

    return _by_nation(spark, sf_dir, run, "n_nationkey int, step int, value double")


# --- control

MESSAGES = ("CUDA error: Out Of Memory", "failed to ALLOCate", "out-of-memory", "java.lang.OutOfMemoryError", "disk full", "", "out_of_memory", "index out of range")


def q_control(spark, sf_dir):
    """Which messages of workers tell that memory ran out, and the batch size that a run ends with where so many items fit as a
    part is large."""
    said = fixtures.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), F.explode(F.array(*map(F.lit, MESSAGES))).alias("message"))
    told = F.pandas_udf(lambda messages: messages.map(lambda m: str(is_memory_error(m)).lower()), "string")
    messages = said.select(F.lit("message").alias("kind"), "key", told(F.concat("message", F.lit(" in worker "), F.col("key").cast("string"))).alias("outcome"), "message")

    def ends(limits: pd.Series) -> pd.Series:
        def run(config, limit):
            if config.batch_size > limit:
                raise MemoryError
            return config.batch_size

        return limits.map(lambda limit: str(with_smaller_batches(lambda c: run(c, limit), RUN)))

    part = fixtures.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("key"), F.col("p_size").cast("long").alias("size"))
    ladder = part.select(F.lit("ladder").alias("kind"), "key", F.pandas_udf(ends, "string")("size").alias("outcome"), F.lit("").alias("message"))
    return messages.unionByName(ladder)


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}

ORACLES = {
    "q_vocabulary_file": f"WITH {_VOCABULARY} SELECT token_id, x AS hex, CAST(len(x) // 2 AS BIGINT) AS size FROM known",
    # no token of this vocabulary goes on after a space or a line break, so the parts between them are followed one by one
    "q_tokens_long": f"""WITH RECURSIVE {_VOCABULARY},
texts AS (SELECT doc_id, row_number() OVER () AS r, text FROM documents),
parts AS (SELECT r, unnest(regexp_extract_all(text, ' ?[^ \\n]+| |\\n')) AS part, generate_subscripts(regexp_extract_all(text, ' ?[^ \\n]+| |\\n'), 1) AS p FROM texts),
step AS (
  SELECT part, hex(encode(part)) AS x, '' AS ids FROM (SELECT DISTINCT part FROM parts)
  UNION ALL
  SELECT part, substr(any_value(x), 1 + max(n)), any_value(ids) || CASE WHEN any_value(ids) = '' THEN '' ELSE ',' END || max_by(token_id, n)
  FROM (SELECT s.part, s.x, s.ids, known.token_id, len(known.x) AS n FROM (SELECT *, unnest(range(1, 18)) AS l FROM step WHERE x <> '') s JOIN known ON known.x = substr(s.x, 1, 2 * l) AND len(known.x) = 2 * l)
  GROUP BY part),
whole AS (SELECT r, string_agg(ids, ',' ORDER BY p) AS ids FROM parts JOIN (SELECT part, ids FROM step WHERE x = '') USING (part) GROUP BY r)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(ids, '') END AS ids FROM texts LEFT JOIN whole USING (r)""",
    "q_detokenize_long": "SELECT doc_id, text FROM documents",
    "q_token_bytes": f"""WITH {_VOCABULARY}
SELECT event_id, t = 0 OR t >= 65530 AS special, x AS hex FROM (SELECT event_id, event_id * 7 % 65536 AS t FROM events) LEFT JOIN known ON token_id = t""",
    "q_jsonl_pairs": _with(PAIRS) + """
SELECT ord, 'p' || ord AS id, src_lang, tgt_lang, src, tgt, 'documents' AS corpus, CASE WHEN ord % 3 <> 0 THEN src_lang END AS doc,
       CASE WHEN ord % 2 = 0 THEN CAST(18446744073700000000::HUGEINT + ord AS VARCHAR) END AS seg FROM pairs""",
    "q_memory_pairs": """
SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ord, 'n' || n_nationkey AS id, 'en' AS src_lang, 'pt_BR' AS tgt_lang, n_name AS src, lower(n_name) AS tgt, 'memory' AS corpus,
       CAST(NULL AS VARCHAR) AS doc, CAST(n_nationkey AS VARCHAR) AS seg FROM nation""",
    "q_corpus_summary": _with(*_TO_CODES) + """
SELECT 'pairs' AS name, count(*) AS value FROM assigned UNION ALL SELECT 'components', count(DISTINCT least) FROM assigned UNION ALL SELECT 'vocabulary', count(*) FROM vocabulary""",
    "q_vocabulary_sink": _with(*_TO_CODES) + " SELECT compact_id, token_id FROM vocabulary",
    "q_config_sink": """
SELECT * FROM (VALUES ('epochs', 50::DOUBLE), ('batch_size', 128), ('workers', 4), ('seed', 42), ('learning_rate', 0.0005), ('beta_2', 0.98), ('tokens_per_item', 24), ('patience', 5), ('smoothing', 0.1),
  ('split.test_per_mille', 10), ('split.valid_per_mille', 10), ('max_tokens', 3072)) t(name, value)
UNION ALL SELECT 'documents.' || coalesce(lang, 'none'), CAST(count(*) AS DOUBLE) FROM documents GROUP BY coalesce(lang, 'none')""",
    "q_model_sink": """
WITH e AS (SELECT label, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT label, dim, avg(x) AS x FROM e GROUP BY label, dim),
f AS (SELECT * FROM (VALUES ('checkpoints/0', 1), ('checkpoints/1', 2), ('model', 2)) t(file, f))
SELECT file, 'embedding' AS name, CAST(row_number() OVER (PARTITION BY file ORDER BY label, dim) - 1 AS INTEGER) AS place, round(x * f, 2) + 0.0 AS value FROM m, f
UNION ALL SELECT file, 'labels', CAST(row_number() OVER (PARTITION BY file ORDER BY label) - 1 AS INTEGER), CAST(label AS DOUBLE) FROM (SELECT DISTINCT label FROM m), f""",
    "q_random_access": _with(*_TO_BATCHES) + """
SELECT 'len' AS kind, split, count(*) AS number, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS INTEGER) AS dir FROM items GROUP BY split
UNION ALL SELECT 'item', split, item_idx, ord, CAST(dir AS INTEGER) FROM items WHERE (split, item_idx) IN (('train', 0), ('train', 7), ('valid', 3), ('train', 1000000000))
UNION ALL SELECT 'batch ' || batch_id, split, pos_in_batch, ord, CAST(dir AS INTEGER) FROM batched WHERE (split, batch_id) IN (('train', 1), ('valid', 0), ('train', 1000000000))""",
    "q_tensor_store": _CORE["q_matrices"],
    "q_unicode": f"""
WITH d AS ({_UNICODE})
SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, kind, hex(encode(t)) AS formed, trim(t, {_SPACES}) AS trimmed, trim(t, {_SPACES}) = '' AS blank,
       CASE WHEN {_key("t").split("WHEN ")[1].split(" = ''")[0]} = '' THEN trim(t, {_SPACES}) ELSE {_key("t").split("ELSE ")[1].removesuffix(" END")} END AS key FROM d""",
    "q_embed": f"""
WITH w AS (SELECT n_nationkey, [1 + n_nationkey % 8, 1 + n_regionkey, 1 + (n_nationkey + n_regionkey) % 8] AS ids FROM nation)
SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, CAST(p AS INTEGER) AS pos, CAST(j AS INTEGER) AS dim,
       round(((ids[p + 1] * 5 + j * 3) % 17 - 8) / 8.0 + CASE WHEN j % 2 = 0 THEN sin(p / pow(10000, 2 * (j // 2) / {WIDTH}.0)) ELSE cos(p / pow(10000, 2 * (j // 2) / {WIDTH}.0)) END, 6) + 0.0 AS value
FROM w, range(3) a(p), range({WIDTH}) b(j)""",
    "q_tied_output": f"""
SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, CAST(v AS INTEGER) AS token, sum(((n_nationkey * 5 + j * 3) % 17 - 8) / 8.0::DOUBLE * (((v * 5 + j * 3) % 17 - 8) / 8.0::DOUBLE)) AS logit
FROM nation, range({KINDS}) a(v), range({WIDTH}) b(j) GROUP BY n_nationkey, v""",
    "q_adam": f"""
WITH RECURSIVE s AS (
  SELECT CAST(n_nationkey AS INTEGER) AS k, 0 AS t, n_nationkey / 10.0::DOUBLE AS x, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM nation
  UNION ALL
  SELECT k, t, x - {RUN.learning_rate} * (m / (1 - pow(0.9::DOUBLE, t))) / (sqrt(v / (1 - pow({RUN.beta_2}::DOUBLE, t))) + 1e-5), m, v
  FROM (SELECT k, t + 1 AS t, x, 0.9 * m + (1 - 0.9) * g AS m, {RUN.beta_2} * v + (1 - {RUN.beta_2}) * g * g AS v
        FROM (SELECT *, ((k + t + 1) % 5 - 2) / 3.0::DOUBLE AS g FROM s WHERE t < 6)))
SELECT k AS n_nationkey, t AS step, round(x, 9) AS value FROM s WHERE t > 0""",
    "q_control": "SELECT 'message' AS kind, CAST(s_suppkey AS BIGINT) AS key, CASE WHEN regexp_matches(lower(message), 'out of memory|out-of-memory|outofmemory|out_of_memory|alloc') THEN 'true' ELSE 'false' END AS outcome, message "
    + "FROM supplier, (VALUES " + ", ".join(f"('{m}')" for m in MESSAGES) + """) t(message)
UNION ALL SELECT 'ladder', CAST(p_partkey AS BIGINT), CAST(CAST(pow(2, floor(log2(p_size))) AS BIGINT) AS VARCHAR), '' FROM part""",
}
