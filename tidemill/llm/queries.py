"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exactdedup import exact_duplicates
from .langid import identify
from .linededup import line_dedup
from .neardup import near_duplicates
from .packing import pack
from .segment import sample_segmentations
from .sharding import ShardStore
from .store import Scratch
from .topk import top_k
from .toxicity import toxicity
from .urlfilter import canonical, judge, parts

Query = Callable[[SparkSession, str], DataFrame]

RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Pages below these host names make up the list of single URLs.
LISTED_HOSTS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer())


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, arriving in five parts of unequal size (together the whole table), merged after each."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, Scratch(spark, "shards").root)
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    for first, last in ((0, 7), (8, 11), (12, 13), (14, 14), (15, 15)):
        store.append(docs.filter(lot.between(first, last)))
        store.compact(docs.schema)
    store.vacuum()
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    return store.read(docs.schema).select("doc_id", "lang", "source", "n_chars", sha.alias("text_sha256"), "shard", "shard_rows", "shard_bytes", F.lit(store.version()).alias("version"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = parts(F.col("url"))
    bad = F.lit(False)
    for name in LISTED_HOSTS:
        bad = bad | F.concat(F.lit("."), host).contains(f".{name}.")
    return judge(pages, RULES, pages.filter(bad).select(canonical(host, path).alias("key")))


def op4_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples of every document: their ids, and the CRC of what these decode to."""
    found = sample_segmentations(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return found.withColumn("ids_crc32", F.crc32("ids"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.length("text").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"), "removed_words", "runs")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = [op1_packing, op2_sharding, op3_url_filters, op4_sampled_segmentations, op5_near_dedup, op6_top_k, op7_line_dedup, op8_toxicity, op9_language_id, op10_exact_dedup]
    return {f.__name__: f for f in found}


def _op3_sql() -> str:
    listed = " or ".join(f"contains('.' || host, '.{x}.')" for x in LISTED_HOSTS)
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
with rests as (
  select page_id, url, case when contains(url, '://') then substr(url, instr(url, '://') + 3) end as rest from pages
), hosts as (
  select page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') as raw from rests
), parted as (
  select page_id, translate(raw, '{UPPER}', '{UPPER.lower()}') as host,
         coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') as path from hosts
), canon as (
  select page_id, host, path, regexp_replace(host, '^(www|m)[.]', '') || regexp_replace(path, '([.]html|/)$', '') as key from parted
), listed as (
  select distinct key from canon where {listed}
), rules(h, p, v) as (values {values}), fits as (
  select page_id, host, path, h || p as rule, v, row_number() over (partition by page_id order by length(h || p) desc, h || p) as n
  from parted join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
)
select c.page_id, c.host, c.path, f.rule, coalesce(f.v, case when l.key is not null then 'block' else 'allow' end) as verdict
from canon c left join (select * from fits where n = 1) f using (page_id) left join listed l on l.key = c.key
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filters": _op3_sql(),
        "op5_near_dedup": f"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') as w from documents
), sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from worded
), items as (
  select doc_id, unnest(s) as item from sets
), shared as (
  select a.doc_id as u, b.doc_id as v, count(*) as common from items a join items b on a.item = b.item and a.doc_id < b.doc_id group by all
), links as (
  select u, v from shared join sets a on a.doc_id = u join sets b on b.doc_id = v
  where 100 * common >= 80 * (len(a.s) + len(b.s) - common)
), edges as (
  select u, v from links union select v, u from links
), reach as (
  select doc_id as origin, doc_id as node from documents
  union
  select origin, v from reach join edges on u = node
)
select s.doc_id, len(s.s)::bigint as n_shingles, min(node) as component_id, s.doc_id = min(node) as kept
from sets s join reach on origin = s.doc_id group by s.doc_id, s.s
""",
        "op6_top_k": """
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from whole q join whole c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
""",
        "op10_exact_dedup": """
with whole as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, sha256(t) as text_sha256
from whole window same as (partition by t)
""",
    }
