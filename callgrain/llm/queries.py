"""The queries op1 to op10 and the pipeline, as (spark, sf_dir) functions, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import BASE, as_text, scan_history

    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), F.col("text").alias("content"))
    _, ledger = scan_history(versions)
    found, _ = scan_history(versions, ledger)  # all pairs are in the ledger now: nothing is scanned again, findings come from it

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    return found.select(F.col("path").alias("doc_id"), *(count(r.kind) for r in BASE), F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    rows = table(spark, sf_dir, "embeddings")
    found = top_k(rows, rows.where("vec_id % 20 = 0"), k=20, scale=64)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .base import crc_mod
    from .toxicity import fit, score

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    out = score(documents, fit(labels.select("doc_id", "toxic"), documents))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def language_model(documents: DataFrame):
    """Learned from the documents whose crc32(doc_id as text) modulo 4 is not 2 and that have a lang."""
    import public_tokenizers

    from .base import crc_mod
    from .language_id import fit

    learn = documents.where((F.coalesce(crc_mod("doc_id", 4), F.lit(-1)) != 2) & F.col("lang").isNotNull())
    return fit(learn.select("lang", "text", F.col("doc_id").alias("key")), public_tokenizers.path("piece_bpe_32k.model"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .base import crc_mod
    from .language_id import predict

    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(documents.select("doc_id", "text"), language_model(documents))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"), width=3, percent=90)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def _secret_sql() -> str:
    """Offsets from the pieces between matches; the case of letters is spelt out, as (?i) is wider there."""
    fold = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
    rules = [
        ("assign", fold + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", True),
        ("access", "AKIA[A-Z0-9]{12,}", False),
        ("hex", "[0-9a-f]{32,}", False),
        ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", False),
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", False),
        ("github", "gh[pousr]_[A-Za-z0-9]{36,}", False),
    ]
    parts = []
    for rank, (kind, pattern, group) in enumerate(rules):
        value = f"regexp_extract(m[i], '{pattern}', 2)" if group else "m[i]"
        parts.append(f"""select doc_id, {rank} as rank, '{kind}' as kind, s[i] as start, s[i] + length(m[i]) as stop, length({value}) >= {8 if group else 1} as ok
            from (select doc_id, m, unnest(range(1, len(m) + 1)) as i, list_transform(range(1, len(m) + 1), lambda j: list_sum(list_transform(p[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0)) as s
                  from (select doc_id, regexp_extract_all(t, '{pattern}', 0) as m, regexp_split_to_array(t, '{pattern}') as p from d where regexp_matches(t, '{pattern}')))""")
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents),
        f as (select doc_id, rank, kind, start::bigint as start, kind || ':' || start::bigint || ':' || stop::bigint as s from ({' union all '.join(parts)}) where ok),
        g as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
              string_agg(s, ',' order by start, rank) filter (rank < 3) as base, string_agg(s, ',' order by start, rank) as spans from f group by doc_id)
        select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
               sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (doc_id)"""


_TOPK_SQL = """with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
        where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
    select query_id, rank, vec_id, score from r where rank <= 20"""

ORACLE_SQL: dict[str, str] = {"op1_exact_topk": _TOPK_SQL, "op5_secret_scan": _secret_sql()}
