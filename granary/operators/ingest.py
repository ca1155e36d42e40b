"""Ingestion: validation, content hashes, duplicate rejection, status rows, enrichment and embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest, extension, trimmed
from .tables import join_counted, written

# What may be uploaded.
EXTENSIONS = ("txt", "md", "markdown", "mdown", "mkd", "pdf", "doc", "docx", "html", "htm", "csv", "xls", "xlsx")
MIME_TYPES = ("text/plain", "text/csv", "text/markdown", "text/x-markdown", "text/html", "application/xhtml+xml", "application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/octet-stream")


def validated(uploads: DataFrame, most_mb: int = 50) -> DataFrame:
    """uploads (file_name, content, mime_type) with reject_reason, null for those that may pass."""
    size = F.length("content")
    mime = F.lower(F.btrim(F.split(F.coalesce("mime_type", F.lit("")), ";")[0]))
    reason = F.when(F.col("content").isNull() | (size == 0), "empty").when(size > most_mb * 1024 * 1024, "too large").when(~extension(F.col("file_name")).isin(*EXTENSIONS), "extension").when((mime != "") & ~mime.isin(*MIME_TYPES), "mime type")
    return uploads.withColumn("reject_reason", reason)


def hashed(docs: DataFrame, raw: str | None = None, text: str | None = "text") -> DataFrame:
    """docs with content_hash: of the raw bytes, else of the text, else of nothing."""
    own = [F.col(raw)] if raw else []
    own += [F.col(text).cast("binary")] if text else []
    return docs.withColumn("content_hash", digest(F.coalesce(*own) if own else F.lit(b"")))


def split_duplicates(new: DataFrame, existing: DataFrame | None, keys: list[str], order: str) -> DataFrame:
    """new (with content_hash) with duplicate_of_batch and duplicate: a live row of the same scope has the hash, or an earlier one in new.

    order must tell rows apart. Rows whose scope is null are never duplicates.
    """
    valid = F.lit(True)
    for k in keys:
        valid = valid & F.col(k).isNotNull()
    # one row a content: only these are compared with what is stored, and meet their own rows by `order`, so rows of one content never meet
    first = new.where(valid).groupBy("content_hash", *keys).agg(F.min(order).alias(order)).withColumn("_known", F.lit(False))
    if existing is not None:
        known = existing.where("deleted_flag = 0").select("content_hash", *keys).distinct().withColumn("_live", F.lit(True))
        first = first.join(known, ["content_hash", *keys], "left").withColumn("_known", F.coalesce("_live", "_known"))
    rows = new.withColumn("_valid", valid).join(first.select(order, "_known"), order, "left").select(*new.columns, "_valid", "_known")
    rows = rows.withColumn("duplicate_of_batch", F.col("_valid") & F.col("_known").isNull())
    return rows.withColumn("duplicate", F.col("_valid") & F.coalesce("_known", F.lit(True))).drop("_known", "_valid")


def deduplicated(docs: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """(content_hash, first, copies): the first id of each content. Partial aggregation leaves a row a hash and task to shuffle."""
    return hashed(docs, text=text).groupBy("content_hash").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))


def empty_reason(text: Column) -> Column:
    """Why a document gave no chunks."""
    n = F.length(trimmed(F.coalesce(text, F.lit(""))))
    return F.when(n == 0, F.lit("empty")).when(n < 20, F.concat(F.lit("short: "), n.cast("string"))).otherwise(F.concat(F.lit("not chunked: "), F.length(text).cast("string")))


def document_status(docs: DataFrame, chunks: DataFrame, basic: bool = False, id_col: str = "doc_id") -> DataFrame:
    """docs with status, chunk_count and message: success, or warning with its reason (the basic variant says success) where there are no chunks."""
    n = chunks.groupBy(id_col).agg(F.count(F.lit(1)).alias("chunk_count"))
    rows = docs.join(n, id_col, "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    none = F.col("chunk_count") == 0
    return rows.withColumn("status", F.when(none & F.lit(not basic), "warning").otherwise("success")).withColumn("message", F.when(none & F.lit(not basic), F.substring(empty_reason(F.col("text")), 1, 500)))


def enriched(chunks: DataFrame, documents: DataFrame, id_col: str = "doc_id", columns: tuple[str, ...] = ("tenant_id", "owner_user_id", "knowledge_base_id", "visibility")) -> DataFrame:
    return chunks.join(documents.select(id_col, *columns), id_col)


def without_document(rows: DataFrame, document_id, id_col: str = "doc_id", scope: dict[str, object] | None = None) -> DataFrame:
    """A vector or keyword table without a document's rows (of a scope)."""
    hit = F.col(id_col) == F.lit(document_id)
    for c, v in (scope or {}).items():
        hit = hit & (F.col(c) == F.lit(v))
    return rows.where(~F.coalesce(hit, F.lit(False)))


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], text_col: str = "content", size: int = 64, out: str = "embedding") -> DataFrame:
    """rows with a vector a text: `size` texts a call, equal texts once; a blank text has an empty vector.

    Distinct texts are embedded and joined back, so a repeated text costs one call wherever it stands.
    """
    keyed = rows.withColumn("_h", F.sha2(F.col(text_col).cast("binary"), 256))
    texts = keyed.where("_h is not null").groupBy("_h").agg(F.first(text_col).alias("_t"), F.count(F.lit(1)).alias("_n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            all_ = pdf["_t"].tolist()
            vectors: list[list[float]] = [[] for _ in all_]
            asked = [i for i, t in enumerate(all_) if t.strip()]
            for i in range(0, len(asked), size):
                part = asked[i : i + size]
                for j, v in zip(part, embed([all_[j] for j in part]), strict=True):
                    vectors[j] = [float(x) for x in v]
            yield pd.DataFrame({"_h": pdf["_h"], "_n": pdf["_n"], out: vectors})

    found = written(texts.mapInPandas(run, f"_h string, _n long, {out} array<float>"), "embedded")
    # rows meet vectors by the hash; those of a text with very many copies stay where they are
    return join_counted(keyed, found, ["_h"], "_n", "left").select(*rows.columns, F.coalesce(out, F.array().cast("array<float>")).alias(out))


def embedded_or_failed(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], text_col: str = "content", size: int = 64) -> DataFrame:
    """rows with embedding and error: `size` different texts a call; where a call fails each of its texts is asked alone, so only texts that have no vector keep an error.

    Equal texts of one Arrow batch are one text of a call; rows are not moved for it. A blank text has an empty vector. Errors are cut to 500 characters. What embed does when a
    provider fails (retries, another provider) is its own matter, see upload.Providers.
    """

    def ask(texts: list[str]) -> list[tuple[list[float], str | None]]:
        try:
            return [([float(x) for x in v], None) for v in embed(texts)]
        except Exception as e:  # noqa: BLE001  a provider may fail in any way; the document is told
            if len(texts) == 1:
                return [([], (str(e) or type(e).__name__)[:500])]
            return [one for t in texts for one in ask([t])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf[text_col]]
            asked = list(dict.fromkeys(t for t in texts if t.strip()))
            known = dict(zip(asked, [one for i in range(0, len(asked), size) for one in ask(asked[i : i + size])], strict=True))
            found = [known.get(t, ([], None)) for t in texts]
            yield pdf.assign(embedding=[f[0] for f in found], error=[f[1] for f in found])

    types = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, f"{types}, embedding array<float>, error string")
