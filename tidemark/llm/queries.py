"""Registered queries of the training-data operators: one ``opN_<name>`` per
operator, over its whole table, with production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, embeddings, grammar, infill, language, lines, merkle, minhash, pieces, repeats, toxicity, urls
from tidemark.llm.store import folder
from tidemark.llm.text import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def digest(column: str):
    """Lowercase hex SHA-256 of the UTF-8 bytes; null reads as empty."""
    return F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", digest("text").alias("kept_sha256"))


ORACLES["op9_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), often AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20 AND doc_id IS NOT NULL
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id < o.last_doc, false) AS gone
  FROM keyed l LEFT JOIN often o ON l.k = o.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = (spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = (chat.format_chats(rows).withColumn("turns", chat.read_back(F.col("formatted")))
           .withColumn("learned", chat.loss_text(F.col("segments"))))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), digest("learned").alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def _escaped(text: str) -> str:
    """DuckDB SQL for the escaped form of an SQL expression."""
    out = f"replace({text}, chr(92), chr(92) || chr(92))"
    for c in chat.INSTRUCT.controls():
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


ORACLES["op6_chat_format"] = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), steps AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_escaped('text')}) + CASE role
{chr(10).join(f"         WHEN '{r}' THEN {len(a) + len(b)}" for r, a, b in chat.INSTRUCT.marks)}
         ELSE {sum(map(len, chat.OTHER))} + length({_escaped('role')}) END) AS BIGINT) AS formatted_chars,
       bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user')
                     ELSE (before || '>' || role) IN ('system>user', 'user>assistant', 'assistant>user') END
                AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM steps GROUP BY conv_id
"""

URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))


@query
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def _url_cases(value: int) -> str:
    """CASE arms over the rules, longest first; value 0: the rule, 1: its verdict."""
    order = sorted(URL_RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    arm = lambda h, p, v: (f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') "  # noqa: E731
                           f"THEN '{(h + p, v)[value]}'")
    return "CASE " + " ".join(arm(*r) for r in order) + (" END" if value == 0 else f" ELSE '{urls.DEFAULT}' END")


ORACLES["op10_url_rules"] = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
)
SELECT page_id, host, path, {_url_cases(0)} AS rule, {_url_cases(1)} AS verdict FROM parts
"""


@query
def op4_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.decode(pieces.encode(docs))
    return out.select("doc_id", F.size("ids").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
                      (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"), digest("decoded").alias("decoded_sha256"))


@query
def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "contaminated", "n_items", "item_ids")


MANIFEST = ("doc_id", "source", "lang", "n_chars", "text")


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*MANIFEST)
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    tampered = merkle.leaf([F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in MANIFEST])
    rows = merkle.manifest(docs, MANIFEST, "lang", "doc_id", {"tampered": F.when(touched, F.unhex(tampered))})
    start = F.coalesce(merkle.hexed(F.col("tampered")), F.col("leaf"))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.sha(merkle.hexed(F.col("proof"))).alias("proof_sha256"),
                       merkle.folded_root(start).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(column: str) -> str:
    return f"coalesce(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(n_chars if c == "n_chars" else c) for c in MANIFEST) + ")"


# CRC-32, bit by bit: the polynomial of the standard, reversed, over the decimal id.
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
  lambda acc, c: list_reduce([xor(acc, c)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
    lambda b, z: xor(b >> 1, 3988292384 * (b & 1)))), 4294967295)"""

ORACLES["op11_merkle"] = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, n_chars IS NOT NULL AND {_CRC} % 7 = 0 AS touched,
         {_leaf_sql('(n_chars + 1)')} AS other
  FROM documents
), placed AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves
), sub AS (
  SELECT tree, 0 AS height, idx, n, leaf AS digest FROM placed
  UNION ALL
  SELECT a.tree, a.height + 1, a.idx // 2, (a.n + 1) // 2, sha256(a.digest || coalesce(b.digest, ''))
  FROM sub a LEFT JOIN sub b ON a.tree = b.tree AND b.idx = a.idx + 1
  WHERE a.n > 1 AND a.idx % 2 = 0
), sub_nodes AS MATERIALIZED (SELECT * FROM sub),
subroots AS MATERIALIZED (SELECT tree, digest, (SELECT count(DISTINCT tree) FROM placed) AS trees FROM sub_nodes WHERE n = 1),
top AS (
  SELECT 0 AS height, tree AS idx, trees AS n, digest FROM subroots
  UNION ALL
  SELECT a.height + 1, a.idx // 2, (a.n + 1) // 2, sha256(a.digest || coalesce(b.digest, ''))
  FROM top a LEFT JOIN top b ON b.idx = a.idx + 1
  WHERE a.n > 1 AND a.idx % 2 = 0
), top_nodes AS MATERIALIZED (SELECT * FROM top),
climb AS (
  SELECT row_number() OVER () AS row, doc_id, tree, 0 AS at_top, 0 AS height, idx, n, CASE WHEN touched THEN other ELSE leaf END AS digest, '' AS proof, leaf
  FROM placed
  UNION ALL
  SELECT row, doc_id, c.tree, CASE WHEN c.n > 1 THEN at_top ELSE 1 END, CASE WHEN c.n > 1 THEN c.height + 1 ELSE 0 END,
         CASE WHEN c.n > 1 THEN c.idx // 2 ELSE c.tree END, CASE WHEN c.n > 1 THEN (c.n + 1) // 2 ELSE (SELECT any_value(trees) FROM subroots) END,
         CASE WHEN c.n = 1 THEN c.digest WHEN c.idx % 2 = 0 THEN sha256(c.digest || coalesce(s.digest, t.digest, ''))
              ELSE sha256(coalesce(s.digest, t.digest, '') || c.digest) END,
         proof || CASE WHEN c.n > 1 THEN coalesce(s.digest, t.digest, '') ELSE '' END, leaf
  FROM climb c
  LEFT JOIN sub_nodes s ON c.at_top = 0 AND c.n > 1 AND s.tree = c.tree AND s.height = c.height AND s.idx = xor(c.idx, 1)
  LEFT JOIN top_nodes t ON c.at_top = 1 AND c.n > 1 AND t.height = c.height AND t.idx = xor(c.idx, 1)
  WHERE c.n > 1 OR c.at_top = 0
)
SELECT c.doc_id, c.leaf, s.digest AS subroot, r.digest AS root, sha256(c.proof) AS proof_sha256, c.digest AS folded_root,
       c.digest = r.digest AS verified
FROM climb c JOIN subroots s ON s.tree = c.tree CROSS JOIN (SELECT digest FROM top_nodes WHERE n = 1) r
WHERE c.at_top = 1 AND c.n = 1
"""


@query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "tokens")
    grammar.write(table(spark, sf_dir, "documents"), path)
    return grammar.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"),
                      F.sha2(infill.restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

ORACLES["op13_infill"] = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{infill.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbers AS (
  SELECT doc_id, text, regexp_extract_all(text, '{_UNIT}') AS units,
         ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM hashed
), cut AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS z,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {infill.RATE} THEN 'plain'
              WHEN h4 % 100 < {infill.SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:z], ''), '') AS middle,
         coalesce(array_to_string(units[z + 1:n], ''), '') AS suffix
  FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
