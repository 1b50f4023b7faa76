"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontomill.llm import bpe, html_text, minhash, negatives, packing, periodic_runs
from ontomill.llm import preferences, secret_scan, substrings, topk
from ontomill.llm import quality as quality_rules
from ontomill.llm import toxicity, url_templates
from ontomill.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ROOM, END_ID = 4096, 1
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def _digests(ids: np.ndarray, text: str) -> tuple[int, str, str]:
    written = " ".join(map(str, ids.tolist())).encode()
    return len(ids), sha256(written).hexdigest(), sha256(text.encode()).hexdigest()


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return bpe.round_trip(docs, RANKS, PATTERN, _digests, columns)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, WORD_VOCABULARY, ROOM, END_ID), ROOM)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.neighbour_pairs(table(spark, sf_dir, "conversations"))
    spans = "cast(aggregate({0}, 0, (n, s) -> n + s.end - s.begin) as long) as {0}ed_chars"
    return preferences.format_preferences(pairs).select(
        "pair_id",
        F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        "prompt",
        "chosen",
        "rejected",
        F.expr(spans.format("chosen_mask")),
        F.expr(spans.format("rejected_mask")),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bands = quality_rules.fit(docs, quality_rules.learnable(table(spark, sf_dir, "labels")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        quality_rules.quality(docs, bands)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & F.col("in_band"))
    )


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    learned = pages.filter(~url_templates.held_out(F.col("page_id")))
    labels = url_templates.page_labels(learned, RULES)
    return url_templates.judge(pages, labels, RULES)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated(table(spark, sf_dir, "documents"), size=13).select(
        "doc_id",
        "n_words",
        "n_removed",
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    crc = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(crc % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= toxicity.LIMIT, 1).otherwise(0).alias("predicted"),
        F.col("limit").alias("language_limit"),
        "toxic",
    )


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    kinds = [rule.kind for rule in secret_scan.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))

    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    return found.select(
        "doc_id",
        *[
            F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long) as n_{kind}")
            for kind in kinds
        ],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: in one text of ten, told by crc32(doc_id), the words from some
    place on repeat with a period, as the contract of ``op12_runs`` has it."""
    docs = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.select(
        "doc_id", "text", F.expr("h div 10").alias("g"), F.when(F.col("h") % 10 == 0, words).alias("words")
    )
    docs = docs.withColumn("n", F.expr("nullif(size(words), 0)")).withColumn("a", F.expr("g % n"))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p as int)]))")
    text = F.when(F.col("words").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.runs(with_periods(table(spark, sf_dir, "documents")))
    kind = found.schema["runs"].dataType.elementType.simpleString()
    # Runs are in the order of start and period, so the first of equals is kept.
    best = f"""aggregate(runs, cast(null as {kind}), (b, r) ->
        if(b is null or r.length * b.period > b.length * r.period, r, b))"""
    listed = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    return found.withColumn("best", F.expr(best)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")),
    )
    return negatives.mine(rows, rows.filter("vec_id % 100 = 0"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_packing": op2_packing,
        "op3_html": op3_html,
        "op4_preferences": op4_preferences,
        "op5_quality": op5_quality,
        "op6_urls": op6_urls,
        "op7_minhash": op7_minhash,
        "op8_topk": op8_topk,
        "op9_substrings": op9_substrings,
        "op10_toxicity": op10_toxicity,
        "op11_secrets": op11_secrets,
        "op12_runs": op12_runs,
        "op13_negatives": op13_negatives,
        "pipeline": pipeline,
    }


#: DuckDB SQL for the operators that SQL expresses over whole tables.
SQL = {
    "op4_preferences": r"""
        with t as (
            select conv_id // 2 as pair_id, conv_id % 2 = 0 as even,
                   row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as at_turn,
                   coalesce(role, '') as role, coalesce(text, '') as text
            from conversations where conv_id is not null),
        p as (select distinct pair_id from t),
        b as (
            select coalesce(c.pair_id, r.pair_id) as pair_id, coalesce(c.at_turn, r.at_turn) as at_turn,
                   not coalesce(c.role = r.role and c.text = r.text, false) as differs
            from (select * from t where even) c full join (select * from t where not even) r
              on c.pair_id = r.pair_id and c.at_turn = r.at_turn),
        f as (select pair_id, min(case when differs then at_turn end) as first_diff, max(at_turn) as last_turn from b group by pair_id),
        n as (select pair_id, coalesce(first_diff - 1, last_turn) as n_prompt_turns from f),
        w as (select t.*, n_prompt_turns, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as line from t join n using (pair_id))
        select pair_id, max(n_prompt_turns) as n_prompt_turns,
               coalesce(string_agg(line, '' order by at_turn) filter (even and at_turn <= n_prompt_turns), '') as prompt,
               coalesce(string_agg(line, '' order by at_turn) filter (even and at_turn > n_prompt_turns), '') as chosen,
               coalesce(string_agg(line, '' order by at_turn) filter (not even and at_turn > n_prompt_turns), '') as rejected,
               cast(coalesce(sum(length(text) + 8) filter (even and at_turn > n_prompt_turns and role = 'assistant'), 0) as bigint) as chosen_masked_chars,
               cast(coalesce(sum(length(text) + 8) filter (not even and at_turn > n_prompt_turns and role = 'assistant'), 0) as bigint) as rejected_masked_chars
        from w group by pair_id""",
    "op8_topk": r"""
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
                   from embeddings
                   where vec_id is not null and embedding is not null
                     and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id,
                     cast(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1] * z[2], 0))), 0) as bigint) as score
              from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
        from s qualify rank <= 5""",
    "op13_negatives": r"""
        with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                          list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
                   from embeddings
                   where vec_id is not null and label is not null and embedding is not null
                     and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same,
                     cast(coalesce(list_sum(list_transform(list_zip(a.e, r.e), lambda z: coalesce(z[1] * z[2], 0))), 0) as bigint) as score
              from v a join v r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
        p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
              qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
        select p.anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
               cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as integer) as rank
        from p join s on s.anchor_id = p.anchor_id and not s.same
          and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
        qualify rank <= 5""",
}


def all_sql() -> dict[str, str]:
    return dict(SQL)
