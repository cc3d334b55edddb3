"""Queries of the corpus operators over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fim, fingerprints, langid, lm_scoring, mixing, near_dedup, packing, pii, prefix_trie, quality_net, quality_rules, sharding
from .common import table


#: Setting that holds the secret of the pseudonyms.
PII_KEY = "spark.rastrel.pii.key"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), "crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pair = F.array(*[F.struct(F.lit(-1).alias("conv_id"), F.lit(i).alias("turn"), F.lit(r).alias("role"), F.lit(SAID).alias("text")) for i, r in enumerate(("user", "assistant"))])
    extra = spark.range(1).select(F.inline(pair))
    extra = extra.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema])
    return chat.digest(rows.unionByName(extra))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(PII_KEY, "a key for synthetic tables"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.train(docs.where(langid.fold(3) != 1))
    return langid.identify(docs, net).select("doc_id", (langid.fold(3) == 1).alias("held_out"), "lang_pred", "score", "n_positions")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations")).drop(*prefix_trie.KEY)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(table(spark, sf_dir, "documents"))


def op13_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = langid.fold(3) != 1
    net = quality_net.train(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return quality_net.score(docs, net).select("doc_id", (langid.fold(3) == 1).alias("held_out"), "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_lm_scoring, op3_chat, op4_pii, op5_near_dedup, op6_packing, op7_quality, op8_language, op9_fingerprints, op10_sharding, op11_prefix_trie, op12_fill_in_middle, op13_quality_net, pipeline)}

ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|SEP\])', '\1\\\2\3', 'g')"
SAID = "</s>[INST] ok [/INST]"
CHAT_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{SAID}'), (-1, 1, 'assistant', '{SAID}')) x),
turns AS (SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS prev FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(4 + sum(length({ESCAPED.format('text')}) + CASE WHEN prev IS NULL THEN 16 + length({ESCAPED.format('role')}) WHEN prev <> role THEN 17 + length({ESCAPED.format('role')}) ELSE 5 END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


def _share(name: str, source: str, parent: str, budget: str, key: str, out: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""{name} AS (SELECT *, CASE WHEN fl THEN cap WHEN opn > 0 THEN ({budget} - given) * wt / opn ELSE 0 END AS {out} FROM (
  SELECT *, sum(CASE WHEN fl THEN cap ELSE 0::DOUBLE END) OVER ({part}) AS given, sum(CASE WHEN fl THEN 0::DOUBLE ELSE wt END) OVER ({part}) AS opn FROM (
  SELECT *, ratio * rest + bef <= {budget} AS fl FROM (
  SELECT *, coalesce(sum(cap) OVER ({part} ORDER BY ratio, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, sum(wt) OVER ({part} ORDER BY ratio, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM (SELECT *, cap / wt AS ratio FROM ({source}))))))"""


def _case(column: str, weights: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in weights.items()) + f" ELSE {mixing.OTHER}::DOUBLE END"


MIX_SQL = f"""
WITH rows AS (
  SELECT doc_id, {[*mixing.DOMAIN_WEIGHTS]}[coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS INT), 0) % {len(mixing.DOMAIN_WEIGHTS)} + 1] AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS DOUBLE) * 4 AS cap FROM rows GROUP BY ALL),
{_share("top", f"SELECT domain, sum(cap) AS cap, {_case('domain', mixing.DOMAIN_WEIGHTS)} AS wt, (SELECT CAST(sum(tokens) AS DOUBLE) FROM leaves) AS b0 FROM leaves GROUP BY domain", "", "b0", "domain", "b1")},
{_share("mid", f"SELECT l.domain, lang, sum(l.cap) AS cap, {_case('lang', mixing.LANG_WEIGHTS)} AS wt, any_value(b1) AS b1 FROM leaves l JOIN top ON top.domain = l.domain GROUP BY l.domain, lang", "domain", "b1", "lang", "b2")},
{_share("low", "SELECT l.*, 1::DOUBLE AS wt, b2 FROM leaves l JOIN mid ON mid.domain = l.domain AND mid.lang = l.lang", "domain, lang", "b2", "source", "b3")},
plan AS (SELECT domain, lang, source, tokens, CAST(floor(b3 + 1e-6::DOUBLE) AS BIGINT) AS budget FROM low),
placed AS (SELECT r.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE budget END AS rest FROM rows r JOIN plan p ON p.domain = r.domain AND p.lang = r.lang AND p.source = r.source WHERE budget > 0),
started AS (SELECT *, CAST(coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || whole || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_token FROM placed)
SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(NULL AS BIGINT) AS start_token, CAST(n_tokens AS BIGINT) AS take_tokens FROM started, range(0, 4) t(epoch) WHERE epoch < whole
UNION ALL SELECT doc_id, domain, lang, source, CAST(whole AS BIGINT), CAST(n_tokens AS BIGINT), start_token, CAST(least(n_tokens, rest - start_token) AS BIGINT) FROM started WHERE least(n_tokens, rest - start_token) > 0"""

# CRC-32 of a short ASCII string: a fold over its bytes, each folded bit by bit
CRC = "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT)), lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)))"
TRIE_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, {CRC.format("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM conversations)),
r AS (SELECT c.conv_id, 0 AS own, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos <= c.h UNION ALL SELECT c.conv_id, 1, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
k AS (SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w) AS key FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT *, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY depth), '') AS up FROM k UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
n AS (SELECT key, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(up) AS up, any_value(bytes) AS bytes, count(*) AS n_convs FROM p GROUP BY key),
kids AS (SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT a.key, sum(CASE WHEN kids.up IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved FROM n LEFT JOIN kids ON kids.up = n.key JOIN p a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.key),
ends AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS digest FROM (SELECT arg_max(key, depth) AS key, conv_id FROM p GROUP BY conv_id) GROUP BY key)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM n LEFT JOIN n u ON u.key = n.up LEFT JOIN kids ON kids.up = n.key JOIN below ON below.key = n.key LEFT JOIN ends ON ends.key = n.key"""

FIM_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
x AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM x"""

ORACLES: dict[str, str] = {"op1_mixing": MIX_SQL, "op3_chat": CHAT_SQL, "op11_prefix_trie": TRIE_SQL, "op12_fill_in_middle": FIM_SQL}
