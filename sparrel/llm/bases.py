"""What SQL can follow of the operators that learn: their base columns, over whole tables, each with its SQL.

The queries run the operators in full and leave out the columns that the method decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

# CRC-32 by its table: 256 numbers from the reflected polynomial, then a step for each byte of the id's decimal digits
_CRC = """t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
h AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c // 256)), 4294967295) % 7 = 2 AS held_out FROM documents, t)"""


@_query(f"""
WITH {_CRC},
d AS (SELECT doc_id, held_out, list_append({_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, '') AS tokens FROM documents JOIN h USING (doc_id)),
c AS (SELECT token, count(*) AS c FROM (SELECT unnest(tokens) AS token FROM d WHERE NOT held_out) GROUP BY 1),
n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + 1.0 * (v + 1)))), 3) AS base_score
FROM (SELECT doc_id, held_out, unnest(tokens) AS token FROM d) LEFT JOIN c USING (token), n GROUP BY ALL
""")
def base_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and base scores of the language model."""
    return catalog.op4_lm_scores(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


@_query(rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
spots AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM spots),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM twice WHERE n > 1) GROUP BY 1),
counted AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN repeated USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
""")
def base_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the quality rules and the base verdict."""
    return catalog.op5_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


_RULES = ", ".join(f"('{v}', '{name.partition('/')[0]}', '/{name.partition('/')[2]}')" for v, name in (line.split() for line in catalog.URL_RULES.split("\n") if line))


@_query(rf"""
WITH r AS (SELECT * FROM (VALUES {_RULES}) t(verdict, rule_host, rule_path)),
u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT page_id, host, path, verdict, rule_host || rule_path AS rule FROM s LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM m GROUP BY ALL
""")
def base_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, and the rule that wins with its verdict."""
    return catalog.op7_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def _matches(kind: int, name: str, pattern: str) -> str:
    """Matches with their places: what is between matches, and the matches before, say where each starts."""
    return f"""SELECT doc_id, {kind} AS kind, '{name}' AS name, unnest(list_transform(range(1, len(m) + 1), lambda k: struct_pack(s := coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0), m := m[k]))) AS f
FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM d)"""


_DIGITS = "regexp_replace(f.m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN reverse({_DIGITS})[k]::INT WHEN reverse({_DIGITS})[k]::INT > 4 THEN 2 * reverse({_DIGITS})[k]::INT - 9 ELSE 2 * reverse({_DIGITS})[k]::INT END)) % 10 = 0"


@_query(rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({_matches(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")}
UNION ALL SELECT * FROM ({_matches(1, "ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")}) WHERE list_bool_and(list_transform(string_split(f.m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(x AS HUGEINT), 0) <= 255))
UNION ALL SELECT * FROM ({_matches(2, "card", r"[0-9](?:[\x20-]?[0-9])+")}) WHERE length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}
UNION ALL SELECT * FROM ({_matches(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]")}) WHERE length({_DIGITS}) BETWEEN 8 AND 15),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone, string_agg(name || ':' || f.s || ':' || f.s + length(f.m), ',' ORDER BY kind, f.s) AS said FROM f GROUP BY 1)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(said, '')) AS base_sha256 FROM d LEFT JOIN g USING (doc_id)
""")
def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans."""
    return catalog.op9_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


@_query("""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, k, CASE WHEN k = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(k)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss FROM c GROUP BY 1)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256 FROM g
""")
def base_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and loss texts as read back from the formatted windows."""
    return catalog.op10_chat_format(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
