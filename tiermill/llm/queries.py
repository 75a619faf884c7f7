"""The corpus operators as named queries over a folder of tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermill.llm import (
    html_blocks,
    jaccard_partitions,
    language_mixture,
    license_scan,
    line_frequency,
    mixing_flow,
    packing_bm25,
    passage_chains,
    prefix_trie,
    simhash_pivots,
    spotsigs,
    url_rules,
    whitening,
)
from tiermill.llm.common import keep, read

# The rules that the URL query applies.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select("page_id", "url", "html")
    return html_blocks.extract(pages)


def op2_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return line_frequency.assess(read(spark, folder, "documents"))


def op3_passage_chains(spark: SparkSession, folder: str) -> DataFrame:
    found = passage_chains.passages(read(spark, folder, "documents"))
    return found.withColumnRenamed("partner", "partner_id")


def op4_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select("page_id", "url")
    judged = url_rules.judge(pages, url_rules.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_simhash_pivots(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_pivots.near_duplicates(read(spark, folder, "documents"))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(read(spark, folder, "documents")).drop("matches")


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing_flow.mix(read(spark, folder, "documents"))
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_lexical_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing_bm25.pack(read(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op9_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    names, table = language_mixture.fit(docs.where(~held_out))
    asked = docs.select("doc_id", "text", held_out.alias("held_out"))
    return language_mixture.identify(asked, names, table).select("doc_id", "held_out", "lang_pred", "score", "lang_mix")


def op10_spot_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.compare(read(spark, folder, "documents"))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whiten(read(spark, folder, "embeddings"), components=16)
    return white.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations rebuilt on the first turns of the one whose id is the multiple of five at or before theirs."""
    lined = keep(prefix_trie.paths(read(spark, folder, "conversations"), family=5, shared=9), "trie-lined", 2)
    return prefix_trie.trie(lined)


def op13_jaccard_partitions(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_partitions.near_duplicates(read(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_line_frequency,
        op3_passage_chains,
        op4_url_rules,
        op5_simhash_pivots,
        op6_license_scan,
        op7_source_mixing,
        op8_lexical_packing,
        op9_language_mixture,
        op10_spot_signatures,
        op11_embedding_whitening,
        op12_prefix_trie,
        op13_jaccard_partitions,
    )
}
URL_SQL = f"""
WITH rules AS (SELECT * FROM (VALUES {", ".join(map(str, URL_RULES))}) v(rule_host, rule_path, verdict)),
urls AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{url_rules.UPPER}', '{url_rules.UPPER.lower()}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (SELECT page_id, rule_host || rule_path AS rule, verdict FROM urls JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM urls u
LEFT JOIN (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY page_id) b
ON u.page_id = b.page_id"""
# CRC-32 by its definition, bit by bit over the bytes of a text of ASCII characters.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
  lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)"""
TRIE_SQL = f"""
WITH own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
asked AS (SELECT conv_id, turns, {CRC_SQL.format("conv_id::VARCHAR")} % 9 AS h FROM own),
paths AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS path
  FROM asked c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
members AS (SELECT conv_id, depth, path[1:depth] AS node, len(path) = depth AS ends
  FROM paths, (SELECT unnest(range(0, (SELECT max(len(path)) + 1 FROM paths))) AS depth) WHERE depth <= len(path)),
nodes AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE strlen(any_value(node[depth].text)) END AS saved
  FROM members GROUP BY depth, node),
children AS (SELECT depth - 1 AS depth, node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, node)),
above AS (SELECT d.depth, c.node[1:d.depth] AS node, sum((c.n_children = 0)::INT) AS n_leaves, sum(c.saved) AS saved_tokens
  FROM counted c JOIN (SELECT DISTINCT depth FROM nodes) d ON d.depth <= c.depth GROUP BY ALL)
SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children::BIGINT AS n_children,
  a.n_leaves::BIGINT AS n_leaves, a.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN above a USING (depth, node) LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.node = c.node[1:c.depth - 1]"""
CHECKS = {"op4_url_rules": URL_SQL, "op6_license_scan": license_scan.check_sql(), "op12_prefix_trie": TRIE_SQL}
