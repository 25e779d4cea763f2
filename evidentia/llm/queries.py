"""Queries opN of the operators in this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import url_filter, url_vocabulary
from ._tables import table
from .chat_format import format_conversations, under_mask
from .exact_dedup import exact_duplicates
from .language_id import fit, held_out, identify
from .mixing import mix
from .near_dedup import near_duplicates
from .order_minhash import compare_with_next
from .packing import pack_documents
from .prefix_trie import prefix_trie
from .spelling import spelling_variants, vocabulary
from .substring_dedup import remove_repeated_bytes, remove_repeated_passages
from .token_counts import count_tokens

#: The rules that op6 applies before its vocabulary.
RULES = (
    url_filter.Rule("net/", allow=False),
    url_filter.Rule("example.net/en/", allow=True),
    url_filter.Rule("example.com/de/", allow=False),
    url_filter.Rule("org/fr/", allow=True),
)

#: What both turns of conversation -7 say.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, threshold=0.8)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_bytes(table(spark, sf_dir, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    found = format_conversations(rows).withColumn("learned", under_mask(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES, vocabulary=url_vocabulary.standard()).select("page_id", "host", "path", "rule", "verdict")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_passages(table(spark, sf_dir, "documents"), words=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return exact_duplicates(table(spark, sf_dir, "documents"), text_sha256=digest)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = held_out(F.col("doc_id"))
    return identify(docs, fit(docs.where(~apart)), held_out=apart).drop("likelihood", "grams")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"), fraction=0.5, power=0.5)
    return found.withColumn("probability", F.round("probability", 4))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(table(spark, sf_dir, "documents")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_order_minhash": op4_order_minhash,
    "op5_packing": op5_packing,
    "op6_url_filter": op6_url_filter,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_language_id": op9_language_id,
    "op10_mixing": op10_mixing,
    "op11_spelling": op11_spelling,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_counts": op13_token_counts,
}


def _url_sql() -> str:
    known = url_vocabulary.standard()
    links = ", ".join(f"('{w}', NULL, NULL)" for w in sorted((*known.links, *"0123456789")))
    forms = ", ".join(f"('{form}', '{term}', {str(strict).lower()})" for form, (term, strict) in sorted(known.forms.items()))
    fits = " UNION ALL ".join(
        f"SELECT '{r.place}' AS place, '{r.host}' AS rule_host, '{r.path}' AS rule_path, {str(r.allow).lower()} AS allow_it" for r in RULES
    )
    return f"""
    WITH RECURSIVE pieces(form, term, strict) AS (VALUES {links}, {forms}),
    runs AS (SELECT DISTINCT unnest(regexp_extract_all(lower(url), '[\\p{{L}}\\p{{N}}]+')) AS run FROM pages),
    starts AS (SELECT run, unnest(range(length(run))) AS s FROM runs),
    spans AS (SELECT run, s, unnest(range(s + 1, least(length(run), s + (SELECT max(length(form)) FROM pieces)) + 1)) AS e FROM starts),
    met AS (SELECT run, s, e, term, strict FROM spans JOIN pieces ON form = substr(run, s + 1, e - s)),
    filled(run, pos) AS (SELECT run, 0::BIGINT FROM runs UNION SELECT met.run, e FROM filled JOIN met ON met.run = filled.run AND s = pos),
    fills(run, pos) AS (SELECT run, length(run) FROM runs UNION SELECT met.run, s FROM fills JOIN met ON met.run = fills.run AND e = pos),
    hit AS (SELECT met.run, term, strict FROM met SEMI JOIN filled ON filled.run = met.run AND filled.pos = s SEMI JOIN fills ON fills.run = met.run AND fills.pos = e WHERE term IS NOT NULL),
    of_page AS (SELECT page_id, unnest(regexp_extract_all(lower(url), '[\\p{{L}}\\p{{N}}]+')) AS run FROM pages),
    counted AS (SELECT page_id, count(DISTINCT term) FILTER (strict) AS strict_hits, count(DISTINCT term) FILTER (NOT strict) AS soft_hits FROM of_page JOIN hit USING (run) GROUP BY page_id),
    parts AS (
      SELECT page_id, coalesce(url, '') AS url,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
      FROM pages),
    rules AS ({fits}),
    ruled AS (
      SELECT parts.*, (
        SELECT struct_pack(place := place, allow_it := allow_it) FROM rules
        WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        ORDER BY length(place) DESC, place DESC LIMIT 1) AS found
      FROM parts)
    SELECT page_id, host, path, found.place AS rule,
      CASE WHEN coalesce(found.allow_it, coalesce(strict_hits, 0) = 0 AND coalesce(soft_hits, 0) < {url_filter.SOFT_HITS})
        THEN 'allow' ELSE 'block' END AS verdict
    FROM ruled LEFT JOIN counted USING (page_id)"""


def _mixing_sql(fraction: float, sweeps: int) -> str:
    """Raking under the bound that no cell gives more than its tokens. A factor for amounts of a group, so that
    the sum of least(amount * factor, cap) is a target, is the largest at which the first k amounts (in order of
    amount / cap) times the factor and the caps of the others meet the target."""
    columns = ("source", "lang", "topic")

    def target(c: str) -> str:
        # a value's target is no more than all its tokens; the other values take the rest
        return f"""
    wish_{c} AS (SELECT {c}, sqrt(sum(tokens)) / sum(sqrt(sum(tokens))) OVER () AS wish, sum(tokens) / (SELECT wanted FROM size) AS held FROM cells GROUP BY {c}),
    line_{c} AS (
      SELECT *, (least(1.0, sum(held) OVER ()) - (sum(held) OVER () - sum(held) OVER upto)) / sum(wish) OVER upto AS line
      FROM wish_{c} WINDOW upto AS (ORDER BY wish / held, {c} ROWS UNBOUNDED PRECEDING)),
    to_{c} AS (SELECT {c}, least(wish * greatest(max(line) OVER (), 0.0), held) AS to_{c} FROM line_{c})"""

    fitted = "(SELECT * FROM fit WHERE it < {sweeps})".format(sweeps=sweeps)
    for c in columns:
        fitted = f"""(
        SELECT * REPLACE (least(weight * coalesce(max(line) OVER (PARTITION BY {c}), 0.0), cap * 1e12) AS weight) FROM (
          SELECT * REPLACE ((to_{c} - (sum(cap) OVER (PARTITION BY {c}) - sum(cap) OVER upto)) / nullif(sum(weight) OVER upto, 0.0) AS line)
          FROM {fitted} WINDOW upto AS (PARTITION BY {c} ORDER BY weight / cap, source, lang, topic ROWS UNBOUNDED PRECEDING)))"""
    return f"""
    WITH RECURSIVE docs AS (
      SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
        CASE WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '[0-9]') THEN 'record'
          WHEN strlen(coalesce(text, '')) < 500 THEN 'note' ELSE 'prose' END AS topic,
        greatest(ceil(strlen(coalesce(text, '')) / 4), 1)::BIGINT AS tokens
      FROM documents),
    cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL),
    size AS (SELECT {fraction} * sum(tokens) AS wanted FROM cells),{",".join(map(target, columns))},
    fit AS (
      SELECT 0 AS it, source, lang, topic, tokens, tokens / (SELECT wanted FROM size) AS cap, tokens AS weight, 0.0::DOUBLE AS line, to_source, to_lang, to_topic
      FROM cells JOIN to_source USING (source) JOIN to_lang USING (lang) JOIN to_topic USING (topic)
      UNION ALL
      SELECT it + 1, source, lang, topic, tokens, cap, weight, line, to_source, to_lang, to_topic FROM {fitted}),
    chance AS (SELECT source, lang, topic, least(least(weight, cap) / cap, 1.0) AS p FROM fit WHERE it = {sweeps})
    SELECT doc_id, source, lang, topic, tokens, round(p, 4) AS probability,
      ('0x' || substr(sha256(doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 < p AS kept
    FROM docs JOIN chance USING (source, lang, topic)"""


#: The 256 steps of CRC-32 by bytes, and the checksum of the bytes of a text.
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b))"


def _crc_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text; the row at hand has the column steps."""
    raw = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce({raw}, lambda c, x: xor(c // 256, steps[xor(c, x) % 256 + 1]), 4294967295))"


_SPELLING_SQL = f"""
    WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS steps),
    runs AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
    checked AS (
      SELECT run, times, {_crc_sql("doc_id || ':' || run")} AS h
      FROM (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 5 GROUP BY ALL), crc),
    left_over AS (
      SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM checked),
    words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM left_over WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
    cut AS MATERIALIZED (
      SELECT DISTINCT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS (
      SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b USING (head, tail) WHERE a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON b.word = a.head || a.tail
      UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON b.word = a.head || a.tail),
    best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM near GROUP BY word),
    formed AS MATERIALIZED (
      SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
      FROM words LEFT JOIN best USING (word)),
    path AS (
      SELECT word, word AS root, form AS next FROM formed
      UNION ALL SELECT path.word, path.next, formed.form FROM path JOIN formed ON formed.word = path.next)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM path WHERE next IS NULL) USING (word)"""

_TRIE_SQL = f"""
    WITH crc AS (SELECT {_CRC_TABLE} AS steps),
    turns AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
      FROM conversations),
    convs AS (SELECT conv_id, {_crc_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM conversations), crc),
    rebuilt AS (
      SELECT convs.conv_id, k, role, text FROM convs JOIN turns ON turns.conv_id = convs.conv_id - convs.conv_id % 20 AND k <= h
      UNION ALL SELECT convs.conv_id, k, role, text FROM convs JOIN turns ON turns.conv_id = convs.conv_id AND k > h),
    lines AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth, sha256(role || chr(10) || text) AS said,
        len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM rebuilt),
    path AS (
      SELECT conv_id, depth, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key, words FROM lines
      UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
    sized AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS is_last FROM path),
    node AS (
      SELECT key, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saves,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_last), '')) AS ends_sha256
      FROM sized GROUP BY key),
    held AS (
      SELECT path.key, node.key AS below, node.saves, node.depth - path.depth AS deeper
      FROM node JOIN path ON path.conv_id = node.conv_id AND path.depth <= node.depth),
    parent AS (SELECT below AS key, held.key AS up FROM held WHERE deeper = 1),
    child AS (SELECT up AS key, count(*) AS n_children FROM parent GROUP BY up),
    total AS (
      SELECT held.key, sum(saves)::BIGINT AS saved_tokens, count(*) FILTER (child.key IS NULL) AS n_leaves
      FROM held LEFT JOIN child ON child.key = held.below GROUP BY held.key)
    SELECT node.conv_id, node.depth, above.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, node.ends_sha256
    FROM node JOIN total USING (key) LEFT JOIN child USING (key) LEFT JOIN parent ON parent.key = node.key LEFT JOIN node above ON above.key = parent.up"""


ORACLES: dict[str, str] = {
    "op3_chat_format": f"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '{HARD_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{HARD_TEXT}'),
    sized AS (
      SELECT *, (length(text) - length(replace(text, '### ', ''))) // 4 + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS added,
        CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role)
          ELSE 1 + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), ':', '%3A')) END AS head
      FROM turns)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(length(text) + added + head + 15)::BIGINT AS formatted_chars
    FROM sized GROUP BY conv_id""",
    "op6_url_filter": _url_sql(),
    "op8_exact_dedup": """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op10_mixing": _mixing_sql(0.5, 100),
    "op11_spelling": _SPELLING_SQL,
    "op12_prefix_trie": _TRIE_SQL,
}
