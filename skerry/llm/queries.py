"""The queries of this subpackage, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import ann, bpe, licenses, lm, neardup, packing, passages, pii, toxicity, webp
from skerry.llm.textops import read_table


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"), "n_words", "n_hits")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())


def op2_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return webp.media(docs, keep_media=False).drop("text")


def op3_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a fixed one here, so that the result can be compared; a deployment passes its own."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, b"a key for tests").select("doc_id", "text", "pii_kinds", "n_pii")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).drop("text")


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), every=100)


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, vocabulary_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.dedup(docs, k=20).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, width=4, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_lossless_webp": op2_lossless_webp,
    "op3_feistel_pii": op3_feistel_pii,
    "op4_license_scan": op4_license_scan,
    "op5_deleted_interpolation": op5_deleted_interpolation,
    "op6_cross_polytope": op6_cross_polytope,
    "op7_prefix_bpe": op7_prefix_bpe,
    "op8_super_kmers": op8_super_kmers,
    "op9_toxicity": op9_toxicity,
    "op10_minmax": op10_minmax,
}
_WORDS = r"regexp_extract_all({}, '[^ \t\n\v\f\r]+')"

#: Queries that SQL can express. The others are tested against brute force in tests/llm.
SQL: dict[str, str] = {
    "op8_super_kmers": f"""with d as (select doc_id, {_WORDS.format("coalesce(text,'')")} w from documents),
        v as (select doc_id, unnest(range(1, len(w) - 18)) i, w from d where len(w) >= 20),
        x as (select doc_id, i, row_number() over (partition by array_to_string(w[i:i+19], ' ') order by doc_id, i) n from v),
        g as (select distinct doc_id, i + unnest(range(0, 20)) p from x where n > 1),
        e as (select doc_id, unnest(range(1, len(w) + 1)) p, unnest(w) y from d),
        k as (select doc_id, string_agg(y, ' ' order by p) t, count(*) n from e anti join g using (doc_id, p) group by 1)
        select doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join k using (doc_id)""",
    "op10_minmax": f"""with recursive d as (select doc_id, {_WORDS.format("translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')")} w from documents),
        s as (select doc_id, list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) sh from d),
        e as (select doc_id, unnest(sh) x from s),
        p as (select a.doc_id a, b.doc_id b, count(*) c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
        l as (select a, b from p join s m on m.doc_id = a join s n on n.doc_id = b where 100 * c >= 80 * (len(m.sh) + len(n.sh) - c)),
        u as (select a, b from l union all select b, a from l),
        r(v, t) as (select doc_id, doc_id from s union select r.v, u.b from r join u on u.a = r.t),
        k as (select v, min(t) t from r group by 1)
        select doc_id, len(sh)::bigint n_shingles, t component_id, t = doc_id kept from s join k on k.v = doc_id""",
}
