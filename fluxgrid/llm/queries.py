"""The queries of this subpackage, over whole tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm.common import Workspace


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fluxgrid.llm.chat_format import format_chats, read_back

    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.unionByName(more), tokenizer_path("byte_bpe_50k.json")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fluxgrid.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fluxgrid.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fluxgrid.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fluxgrid.llm.line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"), short_lines=True)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fluxgrid.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fluxgrid.llm.token_output import read_tokens, write_tokens

    folder = Workspace(spark, "tokens").root
    write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return read_tokens(spark, folder)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fluxgrid.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fluxgrid.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fluxgrid.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, digest=True)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fluxgrid.llm.alignment import align_report

    return align_report(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fluxgrid.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fluxgrid.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_chat_format, op2_decontamination, op3_ngram_join, op4_suffix_dedup, op5_line_dedup, op6_exact_dedup, op7_token_output)
    return {f.__name__: f for f in (*first, op8_quality, op9_secret_scan, op10_packing, op11_alignment, op12_topk, op13_divergence)}


ORACLES = {
    "op6_exact_dedup": r"""
        with d as (
            select doc_id, length(coalesce(text, '')) n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) h
            from documents)
        select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by h) as group_size,
               row_number() over w = 1 as kept, h as text_sha256
        from d window w as (partition by h order by n desc, doc_id nulls last)""",
    "op12_topk": r"""
        with v as (
            select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
            from embeddings
            where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
            from v q join v c on q.vec_id % 50 = 0 and q.r <> c.r)
        select query_id, (row_number() over (partition by r order by score desc, vec_id nulls last))::int as rank, vec_id, score
        from s qualify rank <= 5""",
    "op13_divergence": r"""
        with d as (
            select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
            from documents),
        t as (select lang, source, doc, unnest(terms) as term from d),
        kept as (select lang, term, count(*) as c from t group by all having count(distinct doc) >= 3),
        vocabulary as (select lang, count(*) as v, sum(c) as n from kept group by lang),
        g as (select distinct lang, source from d),
        counts as (select lang, source, term, count(*) as c from t semi join kept using (lang, term) group by all),
        sizes as (select lang, source, sum(c) as n from counts group by all),
        p as (
            select g.lang, g.source, kept.term, coalesce(counts.c, 0) as c,
                   1 + (1000000000::hugeint * (coalesce(counts.c, 0) + 1)) // (coalesce(sizes.n, 0) + v) as p,
                   1 + (1000000000::hugeint * (kept.c + 1)) // (vocabulary.n + v) as q
            from g join kept using (lang) join vocabulary using (lang) left join sizes using (lang, source)
            left join counts on counts.lang = g.lang and counts.source = g.source and counts.term = kept.term),
        f as (
            select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
            from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
        pair as (
            select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value
            from g a join g b on a.lang = b.lang and a.source <> b.source
            left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
        term as (
            select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value from p where c > 0 and p > q),
        everything as (select * from pair union all select * from term)
        select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
        from everything qualify part = 'pair' or rank <= 200""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
