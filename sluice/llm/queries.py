"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import read_table


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.ann import neighbours

    return neighbours(read_table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.mixing import mix

    return mix(read_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.media import payloads, store

    return payloads(store(read_table(spark, sf_dir, "documents"))).drop("error").withColumnRenamed("id", "doc_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.warc import page_id, read, write

    rows = read(write(read_table(spark, sf_dir, "pages")), payload=False).filter("kind <> 'warcinfo'")
    # A gap in what was just written is no result.
    rows = rows.withColumn("kind", F.when(F.col("kind") == "gap", F.raise_error(F.concat_ws(": ", "path", "reason"))).otherwise(F.col("kind")))
    return rows.select(page_id("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), page_id("refers_to").alias("refers_to"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.licenses import scan

    return scan(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), width=3, radius=2).select("doc_id", "fingerprint", "component_id")


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.idfiles import read, write

    return read(write(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.secrets import scan, spans

    rows = scan(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = spans(F.col("findings"))
    return rows.select(F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.langid import identify

    return identify(read_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.packing import pack, pieces

    rows = pack(pieces(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))
    return rows.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


_SPANS = """select doc_id, '{kind}' as kind, {rank} as rank, {least} as least, string_split_regex(text, '{r}') as gaps, regexp_extract_all(text, '{r}') as found, regexp_extract_all(text, '{r}', {group}) as worth from t"""
#: The hex rule asks for its length in the pattern here: runs are maximal either way, and only long ones count.
_RULES = (
    ("assign", 0, 12, 2, """((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", 1, 18, 0, "AKIA[A-Z0-9]+"),
    ("hex", 2, 16, 0, "[0-9a-f]{16,}"),
)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL can say the result. The others are tested against brute force, round trips or held-out rows."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digest = f"list_aggregate(list_transform(range(32), lambda i: substr('{alphabet}', cast(((('0x' || substr(sha1(p), cast(5 * (i // 4) + 1 as bigint), 5))::bigint >> (15 - 5 * (i % 4))) & 31) + 1 as bigint), 1)), 'string_agg', '')"
    op4 = f"""with t as (select page_id, coalesce(html, '') as p from pages), h as (select p, max(page_id) as head from t group by p)
select page_id, cast(strlen(p) as bigint) as payload_bytes, {digest} as payload_digest, case when page_id = head then 'response' else 'revisit' end as record_type, case when page_id <> head then head end as refers_to from t join h using (p)"""
    spans = " union all ".join(_SPANS.format(kind=k, rank=n, least=least, group=g, r=r) for k, n, least, g, r in _RULES)
    op8 = f"""with t as (select doc_id, coalesce(text, '') as text from documents), m as ({spans}), u as (select *, unnest(range(1, len(found) + 1)) as i from m),
s as (select doc_id, kind, rank, least, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) as a, length(found[i]) as n, length(worth[i]) as w from u),
f as (select doc_id, kind, rank, a, kind || ':' || cast(a as bigint) || ':' || cast(a + n as bigint) as span from s where w >= least),
g as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex, string_agg(span, ',' order by a, rank) as spans from f group by doc_id)
select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans from t left join g using (doc_id)"""
    from sluice.llm.licenses import oracle

    return {"op4_warc": op4, "op5_licenses": oracle(), "op8_secrets": op8}
