"""Registered queries of the operators, with production parameters, and the SQL that checks them where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from shelfline.llm import (
    exact_dedup,
    license_scan,
    line_dedup,
    mixing,
    packing,
    prefix_trie,
    quality,
    ranked_search,
    repeats,
    sharding,
    simhash,
    token_counts,
    warc,
)
from shelfline.llm.common import documents

SHARDS = 40
TARGET_MIX = mixing.Mix(
    weights={
        "domain0": 2,
        "domain1": 4,
        "domain2": 3,
        "domain0/de": 3,
        "domain1/fr": 3,
        "domain1/en": 2,
        "domain2/es": 5,
        "domain1/fr/src5": 6,
        "domain3/de/src3": 3,
    },
    share=(3, 5),
    max_epochs=2,
    seed=42,
)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(documents(spark, sf_dir)).drop("_row")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(documents(spark, sf_dir), TARGET_MIX).drop("_row")


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir), shards=SHARDS).drop("_row")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(documents(spark, sf_dir), min_chars=40, min_docs=5)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), least_bytes=0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = repeats.repeat_digest(documents(spark, sf_dir), length=400)
    return digest.withColumn("n_kept", F.col("n_bytes") - F.col("n_removed"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(documents(spark, sf_dir), words=3, bits=64, radius=2)
    return found.selectExpr("doc_id", "lower(hex(fp)) AS fingerprint", "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), every=5, heads=9)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("_row")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mix": op2_mix,
    "op3_shards": op3_shards,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts,
    "op8_repeats": op8_repeats,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_license_scan": op12_license_scan,
    "op13_ranked_search": op13_ranked_search,
    "pipeline": corpus_pipeline.run,
}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD_GAP = "[ \\t\\n\\x0b\\f\\r]+"

_OP1 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def _share_sql(source: str, parent: str, name: str, columns: str) -> str:
    """Budget of each child of ``source`` (parent columns, name, weight, cap, total)."""
    by = f"PARTITION BY {parent}" if parent else ""
    order = f"{by} ORDER BY cap::DOUBLE / weight::DOUBLE, {name}"
    return f"""
SELECT {columns}, CASE WHEN is_full THEN cap ELSE part + (CASE WHEN place <= odd THEN 1 ELSE 0 END) END AS budget
FROM (SELECT *, rest - sum(part) OVER ({by}) AS odd,
             sum(CASE WHEN is_full THEN 0 ELSE 1 END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS place
      FROM (SELECT *, CASE WHEN NOT is_full THEN (weight * rest) // open_weight END AS part
            FROM (SELECT *, total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({by}), 0) AS rest,
                         coalesce(sum(CASE WHEN NOT is_full THEN weight END) OVER ({by}), 1) AS open_weight
                  FROM (SELECT *, cap * onward <= weight * (total - before) AS is_full
                        FROM (SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                                     sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward
                              FROM {source})))))
"""


def _mix_sql(mix: mixing.Mix) -> str:
    weight = lambda path: (
        "CASE " + " ".join(f"WHEN {path} = '{k}' THEN {w}" for k, w in sorted(mix.weights.items())) + " ELSE 1 END::HUGEINT"
    )
    num, den = mix.share
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce('domain' || (try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INT) % 4), 'other') AS domain,
         len(list_filter(string_split_regex(coalesce(text, ''), '{_WORD_GAP}'), lambda x: x <> '')) AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens FROM d GROUP BY ALL),
caps AS (SELECT *, tokens * {mix.max_epochs} AS cap, {weight("domain")} AS w0, {weight("domain || '/' || lang")} AS w1,
                {weight("domain || '/' || lang || '/' || source")} AS w2 FROM leaf),
top AS (SELECT domain, sum(cap) AS cap, first(w0) AS weight,
               (SELECT least(sum(tokens) * {num} // {den}, sum(cap)) FROM caps) AS total FROM caps GROUP BY domain),
b0 AS ({_share_sql("top", "", "domain", "domain")}),
mid AS (SELECT domain, lang, sum(cap) AS cap, first(w1) AS weight, first(b0.budget) AS total
        FROM caps JOIN b0 USING (domain) GROUP BY domain, lang),
b1 AS ({_share_sql("mid", "domain", "lang", "domain, lang")}),
low AS (SELECT domain, lang, source, tokens, cap, w2 AS weight, b1.budget AS total FROM caps JOIN b1 USING (domain, lang)),
b2 AS ({_share_sql("low", "domain, lang", "source", "domain, lang, source, tokens")}),
plan AS (SELECT domain, lang, source, (budget // tokens)::BIGINT AS epochs, budget % tokens AS rest FROM b2 WHERE tokens > 0),
o AS (SELECT d.*, epochs, rest,
             coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
               ORDER BY md5(concat_ws(':', '{mix.seed}', epochs, doc_id)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, unnest(range(0, epochs)) AS epoch, n_tokens::BIGINT AS n_tokens, n_tokens::BIGINT AS taken_tokens FROM o
UNION ALL
SELECT doc_id, domain, lang, source, epochs, n_tokens::BIGINT, least(n_tokens, rest - before)::BIGINT FROM o WHERE rest > 0 AND before < rest
"""


_OP5 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
     k AS (SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     f AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
     m AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> f.keep, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     h AS (SELECT *, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS keep FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(sha, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM h
"""

_OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, trim(coalesce(text, ''), {_SPACE}) AS tt FROM documents),
     w AS (SELECT *, CASE WHEN tt = '' THEN [] ELSE string_split_regex(tt, '{_WORD_GAP}') END AS words FROM d),
     g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
           FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
     r AS (SELECT doc_id, gram FROM g GROUP BY ALL HAVING count(*) > 1),
     c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
           FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN r USING (doc_id, gram)) GROUP BY doc_id),
     l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
           FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE trim(line, {_SPACE}) <> '' GROUP BY doc_id),
     s AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
                  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
           FROM w LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM s
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# CRC-32 of the decimal id, bit by bit.
_CRC = """
xor(list_reduce(range(0, 9 * length(c)), lambda crc, k: CASE WHEN k % 9 = 0
      THEN xor(crc, ascii(substr(c, k // 9 + 1, 1))::BIGINT)
      ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END, 4294967295::BIGINT), 4294967295)
"""

_OP11 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || ':' || text)) AS turns
        FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, ({_CRC}) % 9 AS h FROM (SELECT *, conv_id::VARCHAR AS c FROM own)),
r AS (SELECT a.conv_id, coalesce(b.turns, [])[1:a.h] || a.turns[a.h + 1:] AS turns FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
p AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM r),
n AS (SELECT depth, turns[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '')) AS ends_sha256
      FROM p GROUP BY ALL),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(strlen(path[depth].text), 0) AS saved FROM n LEFT JOIN k USING (path)),
s AS (SELECT path[1:d] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
      FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM v) GROUP BY ALL)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM v JOIN s USING (path) LEFT JOIN n u ON v.depth > 0 AND u.depth = v.depth - 1 AND u.path = v.path[1:v.depth - 1]
"""


def _license_sql(templates: tuple[license_scan.Template, ...]) -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    keys = ",\n".join(
        f"('{t.label}', {quoted(p.split())}, {next(i for i in range(99) if t.notice.split()[i:][: len(p.split())] == p.split())}, {len(t.keys)})"
        for t in templates
        for p in t.keys
    )
    notices = ",\n".join(f"('{t.label}', {quoted(t.notice.split())}, {str(t.base).lower()})" for t in templates)
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
u AS (SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS i FROM w),
k(label, phrase, place, n_keys) AS (VALUES {keys}),
t(label, notice, base) AS (VALUES {notices}),
s AS (SELECT doc_id, label, phrase, n_keys, i - place AS spot FROM u JOIN k ON u.word = k.phrase[1] JOIN w USING (doc_id)
      WHERE words[i + 1:i + len(phrase)] = phrase),
a AS (SELECT doc_id, label, spot FROM s GROUP BY doc_id, label, spot, n_keys HAVING count(DISTINCT phrase) = n_keys),
f AS (SELECT doc_id, label, base, spot, len(list_filter(range(0, len(notice)), lambda j: spot + j >= 0 AND words[spot + j + 1] = notice[j + 1])) / len(notice) AS share
      FROM a JOIN t USING (label) JOIN w USING (doc_id)),
g AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(spot) FILTER (WHERE base) AS first_word, max(spot) FILTER (WHERE base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM f GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM w LEFT JOIN g USING (doc_id)
"""


_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

_OP13 = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
g AS (SELECT count(*) FILTER (WHERE len(terms) > 0)::BIGINT AS docs, sum(len(terms))::BIGINT AS total FROM d),
f AS (SELECT doc_id, len(terms)::BIGINT AS n, term, count(*) AS tf FROM (SELECT *, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM f, g GROUP BY term, docs),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
      FROM i JOIN f USING (term) JOIN w USING (term), g GROUP BY ALL)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""

ORACLES = {
    "op1_exact_dedup": _OP1,
    "op2_mix": _mix_sql(TARGET_MIX),
    "op5_line_dedup": _OP5,
    "op6_warc": _OP6,
    "op10_quality": _OP10,
    "op11_prefix_trie": _OP11,
    "op12_license_scan": _license_sql(license_scan.BASE + license_scan.NOTICES),
    "op13_ranked_search": _OP13,
}
