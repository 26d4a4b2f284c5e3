"""The operators' registered queries, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, divergence, langid, ngram_jaccard, quality, secret_scan, sharding, token_blocks, topk, url_filters, warc
from .shared import crc_mod

# Fixed values: (host, path, verdict).
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return url_filters.judge_urls(_table(spark, sf_dir, "pages"), labels, URL_RULES)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.passage_digest(decontaminate.find_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"))
    vectors = quality.word_vectors(docs)
    network = quality.train(docs, labels, vectors, crc_mod(F.col("id"), 3) != 1)
    scored = quality.score_documents(docs, vectors, network)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantise(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(rows.where(F.col("id") % 100 == 0), rows, 10)


def op7_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_blocks.token_checksums(token_blocks.tokenize_to_files(docs, public_tokenizers.path("word_bpe_49k.json"), 2))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.archive_pages(_table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_archives(manifest, with_html=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sample = langid.training_sample(docs, crc_mod(F.col("doc_id"), 4) != 2)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return langid.identify(docs.select("doc_id", "text"), sample).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(_table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place_documents(_table(spark, sf_dir, "documents"), 16)


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_decontamination": op3_decontamination,
    "op4_quality": op4_quality,
    "op5_secret_scan": op5_secret_scan,
    "op6_exact_topk": op6_exact_topk,
    "op7_token_blocks": op7_token_blocks,
    "op8_warc": op8_warc,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_language_id": op10_language_id,
    "op11_collocations": op11_collocations,
    "op12_divergence": op12_divergence,
    "op13_sharding": op13_sharding,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op11_collocations": rf"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
lengths as (select lang, w, unnest([1, 2, 3, 4]) as m from words),
grams as (
  select lang, m, unnest([w[i:i + m - 1] for i in range(1, len(w) - m + 2)]) as g from lengths where len(w) >= m),
f as (select lang, m, g, count(*)::hugeint as a from grams group by all having count(*) >= 30),
totals as (select lang, sum(len(w))::bigint as n from words group by lang),
cuts as (select lang, m, g, a, unnest(range(1, m)) as k from f where m > 1),
scored as (
  select c.lang, c.m, c.g, c.a, c.k, x.a as l, y.a as r, 2000000 * c.a // (x.a + y.a) as score
  from cuts c join f x on x.lang = c.lang and x.g = c.g[1:c.k] join f y on y.lang = c.lang and y.g = c.g[c.k + 1:c.m]),
best as (select * from scored qualify row_number() over (partition by lang, g order by score, k) = 1),
inner_grams as (
  select lang, a as longer, unnest(flatten([[g[i:i + j - 1] for i in range(1, m - j + 2)] for j in range(2, m)])) as g from f where m > 2),
covered as (select lang, g, max(longer) as longer from inner_grams group by all),
kept as (select b.*, array_to_string(b.g, ' ') as phrase from best b left join covered c on c.lang = b.lang and c.g = b.g where c.g is null or 100 * c.longer < 80 * b.a)
select kept.lang, row_number() over (partition by kept.lang order by score desc, a desc, phrase)::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from kept join totals using (lang) qualify rank <= 2000""",
    "op12_divergence": rf"""
with docs as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
words as (select id, lang, source, unnest(w) as term from docs),
kept as (select lang, term from words group by all having count(distinct id) >= 30),
vocabulary as (select lang, count(*) as v from kept group by lang),
cells as (select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by all),
whole as (select lang, term, sum(n) as n from cells group by all),
groups as (select distinct lang, source from docs),
sizes as (select g.lang, g.source, coalesce(sum(n), 0) as total from groups g left join cells c using (lang, source) group by all),
p as (
  select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (s.total + 5 * v) as p
  from sizes s join kept k on k.lang = s.lang join vocabulary o on o.lang = s.lang left join cells c on c.lang = s.lang and c.source = s.source and c.term = k.term),
lang_sizes as (select lang, sum(n) as total from whole group by lang),
q as (select w.lang, w.term, 1 + (1000000000::hugeint * (w.n + 5)) // (s.total + 5 * v) as q from whole w join lang_sizes s using (lang) join vocabulary using (lang)),
sums as (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
pairs as (select x.lang, x.source, y.source as item, coalesce(value, 0) as value from groups x join groups y on x.lang = y.lang and x.source <> y.source left join sums s on s.lang = x.lang and s.source = x.source and s.item = y.source),
both_parts as (
  select lang, source, 'pair' as part, item, value from pairs
  union all select p.lang, p.source, 'term', p.term, p.p - q.q from p join q on q.lang = p.lang and q.term = p.term where p.n > 0 and p.p > q.q)
select lang, source, part, item, value::bigint as value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
from both_parts qualify part = 'pair' or rank <= 50""",
}
