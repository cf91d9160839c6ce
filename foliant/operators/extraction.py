"""From raw documents to cleaned text: extraction cascade, pages, routing, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.config import SUPPORTED_TYPES, ChunkingConfig
from foliant.functions import text as tx
from foliant.operators.chunking import chunk_documents
from foliant.runtime import spread


def within_size(length: Column, config: ChunkingConfig = ChunkingConfig()) -> Column:
    """At most ``max_file_size_mb``; exactly that size still passes."""
    return length <= config.max_file_bytes


def supported(file_type: Column, types: tuple[str, ...] = SUPPORTED_TYPES) -> Column:
    """Optional filter on the declared types (F7); ingest does not apply it by itself."""
    return file_type.isin(*types)


def clean_by_type(
    file_type: Column, content: Column, config: ChunkingConfig = ChunkingConfig()
) -> Column:
    """PDF text and everything else take different cleaners (S3)."""
    plain = tx.clean_text(content, config.remove_extra_whitespace)
    return F.when(file_type == "pdf", tx.clean_pdf_text(content)).otherwise(plain)


def placeholder(source_file: Column) -> Column:
    """Text of the single chunk of a document nothing could be extracted from."""
    return F.concat(
        F.lit("[PDF Document] "), source_file,
        F.lit(" - Could not extract text. May be encrypted or image-only PDF."),
    )


def extract_text(
    documents: DataFrame, config: ChunkingConfig = ChunkingConfig()
) -> DataFrame:
    """Choose among the outputs of the extraction tools.

    Columns ``layout_text``, ``raw_text``, ``page_text``, ``ocr_text``; NULL
    layout text means that the tool failed, which opens the raw and per-page
    fallbacks, while an empty one goes straight to OCR.
    """

    def limited(c: str) -> Column:
        return F.when(within_size(F.octet_length(c), config), F.col(c)).when(
            F.col(c).isNotNull(), F.lit("")
        )

    layout, raw = limited("layout_text"), limited("raw_text")
    ran = F.col("layout_text").isNotNull()
    candidates = [
        ("layout", ran, layout), ("raw", ~ran, raw),
        ("page", ~ran, F.col("page_text")), ("ocr", F.lit(True), F.col("ocr_text")),
    ]
    method = F.coalesce(
        *[F.when(allowed & (F.length(c) > 0), F.lit(name)) for name, allowed, c in candidates],
        F.lit("failed"),
    )
    content = F.coalesce(
        *[F.when(allowed & (F.length(c) > 0), c) for _, allowed, c in candidates],
        placeholder(F.col("source_file")),
    )
    return documents.withColumns({
        "content": content,
        "extraction_method": method,
        "extraction_failed": method == "failed",
    })


def assemble_pages(pages: DataFrame, config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """Join the texts of ``(source_file, page, text)`` in page order.

    Each non-empty page is followed by its marker; empty pages keep their
    number.  The result of a document is one string, so a group is bounded by
    the size of a document.
    """
    usable = pages.filter(
        (F.length("text") > 0) & within_size(F.octet_length("text"), config)
    )
    marked = F.concat(
        F.col("text"), F.lit("\n\n--- Page "), F.col("page").cast("string"), F.lit(" ---\n\n")
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col("page"), marked.alias("part"))))
    return usable.groupBy("source_file").agg(
        F.array_join(F.transform(ordered, lambda p: p["part"]), "").alias("content"),
        F.count(F.lit(1)).alias("n_pages"),
    )


def document_info(info: Column) -> Column:
    """The known lines of a key-value dump, each followed by a blank."""
    lines = F.filter(
        F.split(info, "\n"), lambda line: line.rlike(r"\A(Pages|Title|Author|Creator|Encrypted):")
    )
    return F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit(" "))), "")


def page_count(info: Column) -> Column:
    """Number after ``Pages:``, -1 where there is none."""
    digits = F.regexp_extract(info, r"Pages:\s*([0-9]+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(-1))


def typed_documents(
    documents: DataFrame, config: ChunkingConfig = ChunkingConfig()
) -> DataFrame:
    """Non-empty documents within the size limit, with type and failure flag."""
    failed = (
        F.col("extraction_failed") if "extraction_failed" in documents.columns else F.lit(False)
    )
    typed = documents.withColumns({
        "file_type": tx.detect_file_type("source_file"), "extraction_failed": failed,
    })
    return typed.filter(
        tx.not_empty("content") & within_size(F.octet_length("content"), config)
    )


def _cleaned(config: ChunkingConfig) -> Column:
    """Cleaned content; NULL for extracted text that is too short (S3, F2)."""
    cleaned = tx.let(clean_by_type(F.col("file_type"), F.col("content"), config), lambda c: F.when(
        tx.long_enough(F.col("file_type"), c, config.min_extracted_bytes), c
    ))
    return F.when(F.col("extraction_failed"), F.col("content")).otherwise(cleaned)


def cleaned_documents(
    documents: DataFrame, config: ChunkingConfig = ChunkingConfig()
) -> DataFrame:
    """Documents that survive the checks, with their text cleaned.

    Takes ``source_file`` and ``content``, optionally ``extraction_failed``
    (rows whose placeholder text bypasses cleaning).
    """
    typed = typed_documents(documents, config)
    return typed.withColumn("content", _cleaned(config)).filter(F.col("content").isNotNull())


def text_chunks(
    documents: DataFrame,
    config: ChunkingConfig = ChunkingConfig(),
    *,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Chunks of documents that are all treated as plain text."""
    kept = spread(documents.select("source_file", "content", *keep), "source_file").filter(
        tx.not_empty("content") & within_size(F.octet_length("content"), config)
    )
    cleaned = tx.clean_text("content", config.remove_extra_whitespace)
    return chunk_documents(kept.withColumn("content", cleaned), config, keep=keep)


def document_chunks(
    documents: DataFrame,
    config: ChunkingConfig = ChunkingConfig(),
    *,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Raw documents to chunk rows: the whole row-local part of an ingest.

    Rejected texts become NULL and give no chunks; a filter on the cleaned
    text would be pushed below it and clean every text twice.
    """
    typed = typed_documents(spread(documents, "source_file"), config)
    return chunk_documents(
        typed.withColumn("content", _cleaned(config)), config,
        keep=("file_type", *keep), whole="extraction_failed",
    )
