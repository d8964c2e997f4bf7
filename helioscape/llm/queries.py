"""Queries of the corpus operators over the whole given tables, each with the SQL text it is compared with, where there is one."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.spark_support import join_same
from . import conversations, decontaminate, fingerprints, html_extract, jaccard_join, licenses, manifest, packing, pieces, pii, quality, secrets, \
    structure_sql, url_filter
from .textkit import give_back

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Vocabulary of the piece queries; any SentencePiece model file that the driver can read.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Tokenizer of the packing query and the id that ends a text.
PACKING_MODEL, END_ID = "/opt/tokenizers/word_bpe_49k.json", 1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_ngram_jaccard_join", rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by 1),
pairs as (
  select a.doc_id as a, b.doc_id as b
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id
  join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  group by 1, 2, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))),
links as (select a, b from pairs union all select b, a from pairs),
reach(doc, seen) as (
  select doc_id, doc_id from documents union select r.doc, l.b from reach r join links l on r.seen = l.a)
select r.doc as doc_id, coalesce(max(s.n), 0)::bigint as n_shingles, min(r.seen) as component_id
from reach r left join sizes s on s.doc_id = r.doc group by r.doc
""")
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = jaccard_join.similar_sets(table(spark, sf_dir, "documents"), "doc_id", "text", width=5, threshold=0.75)
    return members.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def joined_spans(spans: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find_pii(docs, "doc_id", "text", pii.train_model(docs, "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in pii.KINDS],
                        F.sha2(joined_spans("base"), 256).alias("base_sha256"), joined_spans("spans").alias("spans"))


@query("op3_url_filters", rf"""
with parts as (
  select page_id, coalesce(url, '') as url, strpos(coalesce(url, ''), '://') as p from pages),
split as (
  select page_id, case when p = 0 then '' else substr(url, p + 3) end as rest from parts),
cut as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from split),
rules(rule, host, path, verdict) as (values ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
fits as (
  select c.page_id, c.host, c.path, arg_max(r.rule, length(r.rule)) as rule, arg_max(r.verdict, length(r.rule)) as said
  from cut c left join rules r on (c.host = r.host or ends_with(c.host, '.' || r.host)) and starts_with(c.path, r.path)
  group by all),
listed as (
  select distinct regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') as canonical from cut
  where regexp_matches(host, '(^|\.)(cheap-pills|spam-farm)\.')),
judged as (
  select f.*, case when host = '' then null else regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') end as canonical
  from fits f)
select page_id, host, path, rule, coalesce(said, case when l.canonical is null then 'allow' else 'block' end) as verdict,
       l.canonical is not null as listed
from judged j left join listed l on l.canonical = j.canonical
""")
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(url_filter.host_of("url").rlike(r"(^|\.)(cheap-pills|spam-farm)\."))
    judged = url_filter.judge_urls(pages, "url", listed, "url", url_filter.RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "listed")


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.QualityModel | None:
    """Grades 0 poor, 1 toxic, 2 good from the two labels."""
    graded = labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))
    return quality.fit_ratings(docs, "doc_id", "text", graded, "doc_id", "grade")


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return quality.grade_texts(docs.select("doc_id", "text"), "text", model).drop("text")


@query("op5_benchmark_decontamination", rf"""
with doc as (
  select doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item as (
  select item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
wins as (
  select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as s
  from (select item_id, w, least(len(w), 10) as size, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from item where len(w) > 0)),
runs as (
  select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as s
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from doc, (select distinct size from wins) where len(w) >= size)),
met as (select doc_id, i, r.size, item_id from runs r join wins using (size, s)),
hit as (select doc_id, count(distinct word) as n_hit from (select doc_id, unnest(range(i, i + size)) as word from met) group by 1),
found as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
  from met group by 1)
select doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit using (doc_id) left join found using (doc_id)
""")
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                     "doc_id", "text", "item_id", "text", width=10)
    hit = F.size("hit_words").cast("long")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def _licence_sql() -> str:
    """Counts of every sentence that is a rule by itself in the words of a text."""
    alone = [(name, licenses.SENTENCES[steps[0]]) for name, steps in licenses.RULES if len(steps) == 1]
    values = ", ".join(f"('{name}', ' {words} ')" for name, words in alone)
    return f"""
with words as (select doc_id, ' ' || regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '  ', 'g') || ' ' as w from documents),
plain as (select doc_id, regexp_replace(w, ' +', ' ', 'g') as w from words),
rules(license, words) as (values {values}),
met as (select doc_id, license, (length(w) - length(replace(w, words, ' '))) // (length(words) - 1) as n
        from plain, rules where contains(w, words))
select d.doc_id, coalesce(sum(n), 0)::bigint as n_licenses, coalesce(string_agg(distinct license, ',' order by license), '') as licenses
from documents d left join met on met.doc_id = d.doc_id group by d.doc_id"""


@query("op6_license_scans", _licence_sql())
def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licences(table(spark, sf_dir, "documents"), "doc_id", "text", anywhere=True)
    return found.select(F.col("id").alias("doc_id"), F.size("found").cast("long").alias("n_licenses"),
                        F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"))


def secret_model(docs: DataFrame) -> secrets.SecretModel:
    """Trained on findings of the rules and other candidates in the texts, and on made token shapes."""
    model = secrets.fit(secrets.labelled_findings(docs, "text") + secrets.made_findings())
    give_back()  # what the fit took of the driver
    return model


@query("op7_secret_scans")
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, "doc_id", "text", secret_model(docs))
    base = found.withColumn("base", F.filter("spans", lambda s: s["kind"] != "model"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return base.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"),
                       F.sha2(joined_spans("base"), 256).alias("base_sha256"), joined_spans("spans").alias("spans"))


@query("op8_document_fingerprints")
def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("op9_html_extraction")
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_pages(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.read_vocabulary(PIECE_MODEL)
    encoded = pieces.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary, check=True)
    return encoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


@query("op11_conversation_repair", structure_sql.REPAIR)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per conversation id, null included; repeated rows are turns of their own (duplicates), an empty table gives no rows."""
    damaged = conversations.damage(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    found = conversations.repair(damaged, "conv", "turn", "role", "text", dropped_col="dropped")
    return join_same(found.reports, found.digests(), ["conv"]).withColumnsRenamed({"conv": "conv_id", "digest": "repaired_sha256"})


@query("op12_packing")
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece; null and empty texts are the end mark alone, repeated rows are packed each, an empty table gives no rows."""
    pieces_ = packing.pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text", PACKING_MODEL, end_id=END_ID)
    return pieces_.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("tokens").alias("ids_crc32"),
                          F.col("text_tokens").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset")


@query("op13_merkle_manifest", structure_sql.manifest())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of documents, repeated ones too; a null doc_id is a leaf that nobody tampers with, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    row = lambda text: manifest.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    lowered = F.translate("text", _UPPER, _LOWER)
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    claim = F.when(hit, row(lowered)).otherwise(row(F.col("text")))
    proofs = manifest.build_manifest(docs, "doc_id", "lang", row(F.col("text")), claim).proofs()
    return proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"),
                         F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
