"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, conversation_repair, languages, mixing, near_dup, order_minhash, page_wrappers, personal_data, prefix_trie, quality, substring_dedup, token_counts, word_table
from .common import cut, table, text_or_empty

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    """Where the public vocabulary file lies: $TOKENIZER_FILE, or the installed package of public tokenizers."""
    if found := os.environ.get("TOKENIZER_FILE"):
        return found
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def op1_page_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return page_wrappers.extract(pages).select("page_id", "url", "text", "n_chars")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = languages.learn(docs.where(~languages.held_out(F.col("doc_id"))))
    rows = languages.identify(docs.select("doc_id", languages.held_out(F.col("doc_id")).alias("held_out"), "text"), learned)
    return rows.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = personal_data.find(docs, personal_data.fitted(docs))

    def said(spans):
        names = F.array(*map(F.lit, personal_data.KINDS))
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))

    def count(kind: int):
        # The four kinds of the base are counted as base_sha256 lists them; what the tagger adds to them is in spans. Secrets are all added.
        return F.size(F.filter("found", lambda x: (x["kind"] == kind) & (x["base"] | (x["kind"] == personal_data.SECRET)))).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(personal_data.KINDS)]
    base = said(F.filter("found", lambda x: x["base"]))
    four = F.filter("found", lambda x: x["kind"] < personal_data.SECRET)
    return rows.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), said(four).alias("spans"), said(F.filter("found", lambda x: x["kind"] == personal_data.SECRET)).alias("secrets"))


def op5_warc_from_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    rows = order_minhash.with_next(docs, ["text", "own"], lambda df: order_minhash.fingerprint(df, "text", "own"))
    rows = rows.withColumn("edited", order_minhash.edited(F.col("text"), F.col("next_text")))
    rows = order_minhash.fingerprint(rows, "edited", "changed")
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash.digest(F.col("own")).alias("fingerprint"),
        order_minhash.digest(F.col("changed")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        order_minhash.likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = word_table.encode(docs, vocabulary_path(), keep=["doc_id"])
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = quality.judged(quality.cut_statistics(docs, ["doc_id"]))
    return rows.select("doc_id", *(F.col("stat")[x].alias(x) for x in quality.NAMES), "base_failed", "kept", "posterior")


def op9_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.components(docs).select("doc_id", near_dup.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("n_words"), F.xxhash64("text").alias("h"))
    rows, _ = mixing.plan(docs, F.col("n_words"), tie=F.col("h"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = conversation_repair.damaged(given)
    found = cut(conversation_repair.audits(turns))
    told = conversation_repair.line_digests(conversation_repair.repair(turns, found))
    ids = given.select(F.col("conv_id").alias("given_id")).distinct()
    rows = ids.join(found, F.col("given_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    rows = rows.join(told, F.col("given_id").eqNullSafe(F.col("conv_id")), "left").withColumn("conv_id", F.col("given_id"))
    counts = [F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(given)))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_page_wrappers, op2_language_id, op3_token_counts, op4_personal_data, op5_warc_from_arc, op6_order_minhash, op7_word_bpe, op8_quality_rules, op9_simhash_near_dup, op10_mixing, op11_conversation_repair, op12_prefix_trie, op13_substring_dedup)}

#: What SQL can say of the operators; the others are held to brute force in the tests.
ORACLE_SQL: dict[str, str] = {
    "op13_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS s FROM d, unnest(range(1, len(words) - 18)) t(i)),
        later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
        gone AS (SELECT doc_id, list(DISTINCT i + k) AS places FROM later, range(20) t(k) GROUP BY doc_id),
        k AS (SELECT doc_id, len(words) AS n_words, words, coalesce(places, []) AS places FROM d LEFT JOIN gone USING (doc_id)),
        w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, n_words + 1)) AS i FROM k),
        p AS (SELECT doc_id, unnest(places) AS i, true AS goes FROM k),
        left_ AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w LEFT JOIN p USING (doc_id, i) WHERE goes IS NULL GROUP BY doc_id)
        SELECT doc_id, n_words, CAST(len(places) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN left_ USING (doc_id)""",
}
