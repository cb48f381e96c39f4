"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import conversation_repair, decontaminate, fingerprint, language_id, mixing, ngram_join, quality, secrets, substring_dedup, suffix_dedup, token_file, warc, whitening
from framewise.llm.common import crc
from framewise.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; rows with crc32(doc_id) mod 3 = 1 (held out) teach nothing, nor
    does a null id. Null, empty and letterless texts: 'und'. Empty table: no rows."""
    docs = _read(spark, sf_dir, "documents")
    network = language_id.fit_languages(docs.where(crc("doc_id") % 3 != 1))  # a null id has no remainder
    return language_id.identify(docs, network).select("doc_id", (crc("doc_id") % 3 == 1).alias("held_out"), "lang_pred", "score")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans of every document. Null and empty texts have
    none; equal texts have equal spans, whatever their ids. Empty table: no rows."""
    docs = _read(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs, secrets.fit_formats(docs))

    def listed(keep: F.Column) -> F.Column:
        return F.array_join(F.transform(keep, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = listed(F.filter("spans", lambda s: s["kind"] != "format"))
    return found.select("doc_id", *(number(k) for k in secrets.KINDS[:3]), F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, see `edited_fingerprints` for null and repeated ids. A null
    text is an empty one. Empty table: no rows."""
    return fingerprint.edited_fingerprints(_read(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links of every document. Texts without words form one class; null ids count last; repeated rows
    link with each other. Empty table: no rows."""
    return ngram_join.jaccard_join(_read(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, items, similarity of every document row. Null, empty and short texts (under five words) match
    nothing, as do such items; rows of one id share their matches. No items: nothing is contaminated."""
    return decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document row. Null texts are empty, null ids lose nothing,
    rows of one id take nothing from each other. Empty table: no rows."""
    return suffix_dedup.repeated_spans(_read(spark, sf_dir, "documents")).drop("spans")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document row. A null source is a source of its own, null and empty
    texts have size 0 and are never taken; of equal rows any may be. Empty table: no rows."""
    return mixing.mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document row; labels of ids with crc32 mod 5 = 0 (held out) teach
    nothing. Null and empty texts get the score of an empty one. No labels: every score is 0.5."""
    docs = _read(spark, sf_dir, "documents")
    trees = quality.fit_quality(docs, _read(spark, sf_dir, "labels").where(crc("doc_id") % 5 != 0))
    return quality.score_quality(docs, trees).select("doc_id", (crc("doc_id") % 5 == 0).alias("held_out"), "score", "predicted")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the archives. A null
    html is empty; rows that share the least id of a payload are all responses. Empty table: no rows."""
    read = warc.read_archives(warc.write_archives(_read(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document row, read back from the files. A null text is empty (the end
    id alone); null ids come first, rows of one id by text. Empty table: no rows."""
    import public_tokenizers

    written = token_file.write_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_file.read_documents(written)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired rows of every conversation, after damage by crc32. Null roles and
    texts are one space, a null conv_id is a conversation of its own; one that keeps no row has an empty text. Empty table:
    no rows."""
    rows = conversation_repair.damage(_read(spark, sf_dir, "conversations"))
    plans = conversation_repair.plan_repairs(rows)
    return conversation_repair.with_digests(plans, conversation_repair.apply_repairs(rows, plans))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every embedding without nulls and non-finite entries, fitted on the distinct
    ones. Rows without a vector, or with a bad entry, go; repeated vectors count once in the fit and keep their rows; shorter
    vectors end in zeros; components without variance have no rows. Empty table: no rows."""
    vectors = whitening.finite_vectors(_read(spark, sf_dir, "embeddings"))
    return whitening.whiten(vectors, whitening.fit_whitening(vectors.select("x")))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document row. Null texts have no words, null ids lose nothing, rows of
    one id take nothing from each other. Empty table: no rows."""
    return substring_dedup.repeated_words(_read(spark, sf_dir, "documents")).drop("spans")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_secrets, op3_fingerprint, op4_ngram_join, op5_decontaminate, op6_suffix_dedup, op7_mixing, op8_quality, op9_warc, op10_token_file, op11_conversation_repair, op12_whitening, op13_substring_dedup)}
