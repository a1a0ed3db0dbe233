"""The numbered operators as registered queries, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citescan.llm import bpe, chat, conv_trie, exact_dedup, fill_middle, lm_score, mixing, ngram_join, nn_graph, pii, quality, suffix_dedup, url_filter
from citescan.session import keep

UPPER, LOWER = exact_dedup.UPPER, exact_dedup.LOWER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: the domains that the method blocks where no rule fits
BLOCKED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm", "therin", "ththre", "ththth", "thther")
BLOCKED_DOMAINS = [f"{name}.example.{top}" for name in BLOCKED_NAMES for top in ("com", "net", "org")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), URL_RULES, BLOCKED_DOMAINS)


def _rule_cases(result: str) -> str:
    longest_first = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    return " ".join(f"WHEN {fits.format(h=h, p=p)} THEN '{(h + p) if result == 'rule' else say}'" for say, h, p in longest_first)


OP1_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
seen AS (
  SELECT *, {' OR '.join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in BLOCKED_DOMAINS)} AS listed FROM parts)
SELECT page_id, host, path, CASE {_rule_cases('rule')} END AS rule,
       CASE {_rule_cases('verdict')} WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM seen
"""


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, similarity=90, links=True)


PLANTED_CHAT = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role")) for i, role in enumerate(("user", "assistant"))])
    own = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.inline(turns), F.lit(PLANTED_CHAT).alias("text"))
    chats = chat.conversations(chat.threads(rows.unionByName(own)))
    read = chats.withColumns({"turns": chat.read_back(F.col("formatted")), "learnt": chat.read_loss(F.col("formatted"), F.col("loss"))})
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escapes(column: str) -> str:
    return " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in ("\\", *chat.CONTROL))


OP3_SQL = f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED_CHAT}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED_CHAT}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(chat.START) + 1 + len(chat.END)} + length(role) + length(text) + {_escapes('role')} + {_escapes('text')}) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""

#: folder of the public tokenizers' files; None: where the installed package says
TOKENIZERS: str | None = None


def byte_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path of a file of ranks, and the pattern that goes with it."""
    import public_tokenizers

    return f"{TOKENIZERS}/{name}" if TOKENIZERS else public_tokenizers.path(name), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = byte_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = bpe.encode(docs, ranks, pattern)
    read = bpe.decode(tokens, ranks, text=None, raw="raw")
    return read.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), length=400, with_text=False)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_graph.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def _joined(kinds: tuple[str, ...]):
    """kind:start:end by kind, then start, comma-joined."""

    def named(kind: str):
        return lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])

    return F.array_join(F.concat(*[F.transform(k, named(k)) for k in kinds]), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(_joined(pii.KINDS), 256).alias("base_sha256"),
        _joined((*pii.KINDS, pii.FOUND)).alias("spans"),
        sum((F.size(k) for k in pii.KINDS), F.size(pii.FOUND)).cast("long").alias("n_spans"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copy_groups(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""

def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents"), cycle=(1, 2, 3), cap=3.0)
    return mix.select("doc_id", "size", "source", "source_size", "target", "taken", F.size("pieces").alias("n_pieces"))


#: score from which a document counts as good
GOOD = 0.3


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trained = lm_score.train(docs, folds=10)
    scores = lm_score.scored(docs, trained).withColumn("train_tokens", F.lit(trained.outputs.total).cast("long"))
    return scores.select("doc_id", quality.held_out(F.col("doc_id"), 10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = keep(conv_trie.digested(conv_trie.numbered(table(spark, sf_dir, "conversations"))), "turns")
    return conv_trie.trie(conv_trie.with_shared_heads(turns, every=100, most=6))


#: crc32 of the decimal conv_id, bit by bit
CRC_SQL = """
xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS UBIGINT)),
    lambda crc, b: list_reduce(CAST(range(8) AS UBIGINT[]), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, b)),
    CAST(4294967295 AS UBIGINT)), 4294967295)
"""

OP12_SQL = f"""
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS head, {CRC_SQL} % 6 AS h FROM (SELECT DISTINCT conv_id FROM numbered)),
rebuilt AS (
  SELECT c.conv_id, n.pos, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.head AND n.pos <= c.h
  UNION ALL SELECT n.conv_id, n.pos, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND n.pos > c.h),
placed AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM rebuilt),
paths AS (
  SELECT conv_id, depth, length(text) AS chars, list(struct_pack(r := role, t := text)) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM placed
  UNION ALL SELECT conv_id, 0, 0, CAST([] AS STRUCT(r VARCHAR, t VARCHAR)[]) FROM convs),
ending AS (SELECT conv_id, max(depth) AS last FROM paths GROUP BY conv_id),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = last) AS ends
  FROM paths JOIN ending USING (conv_id) GROUP BY path, depth),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
sums AS (
  SELECT path[1:k] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS k FROM known) GROUP BY 1)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(k.ends, '')) AS ends_sha256
FROM known k JOIN sums s ON s.path = k.path LEFT JOIN nodes p ON k.depth > 0 AND p.path = k.path[1:k.depth - 1]
"""


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = fill_middle.fill_in_middle(docs)
    return cut.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = f"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{fill_middle.UNIT}') AS u,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
drawn AS (
  SELECT *, len(u) AS n, {', '.join(f"CAST('0x' || substr(digest, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM units),
placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (
  SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:n], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_ngram_join": op2_ngram_join,
    "op3_chat_format": op3_chat_format,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_nearest": op6_nearest,
    "op7_pii": op7_pii,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_lm_score": op11_lm_score,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_fill_middle": op13_fill_middle,
}

ORACLE_SQL = {
    "op1_url_filter": OP1_SQL,
    "op3_chat_format": OP3_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op12_conversation_trie": OP12_SQL,
    "op13_fill_middle": OP13_SQL,
}
