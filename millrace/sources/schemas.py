"""Declared tables: types, keys, allowed values and parents.

Tables are listed parents before children, which is also the order of a restore.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

VECTOR_DIM = 1024


@dataclass(frozen=True)
class Table:
    """A declared table; ``durable`` tables are mirrored and restored.

    ``names`` holds columns that the operators know by another name than the stored table.
    """

    ddl: str
    key: tuple[str, ...]
    parents: dict[str, tuple[str, str]] = field(default_factory=dict)
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    durable: bool = True
    names: dict[str, str] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


JOB_STATUSES = (
    "PENDING", "QUEUED", "RUNNING", "INTERRUPTED", "PAUSED_FOR_HITL", "COMPLETED", "PARTIAL", "PENDING_CALLBACK",
    "FAILED", "ABANDONED", "CANCELLING", "SKIPPED",
)
ITEM_STATUSES = ("PENDING", "RUNNING", "COMPLETED", "FAILED", "SKIPPED")
BATCH_STATUSES = ("PENDING", "PUBLISHING", "PARTIAL", "COMPLETED", "FAILED")
PUBLISH_STATUSES = ("PENDING", "TRANSLATING", "PUBLISHED_BRIEFING", "PUBLISHED_ARCHIVE", "FAILED", "SKIPPED")
EMBEDDING_STATUSES = ("PENDING", "EMBEDDED", "SKIPPED")

REGISTRY: dict[str, Table] = {
    "scraped_articles": Table(
        "id string, url string, title string, conclusion string, summary string, metadata_json string, "
        "embedding_status string, content_hash string, scraped_at timestamp, updated_at timestamp",
        ("id",), allowed={"embedding_status": EMBEDDING_STATUSES}),
    "scraped_articles_vec_backup": Table(
        "rowid bigint, article_id string, embedding array<float>, hashed_at timestamp",
        ("rowid",), {"article_id": ("scraped_articles", "id")}),
    "broadcast_batches": Table(
        "batch_id string, target_site string, article_count int, top10_count int, status string, source_job_id string, "
        "content_hash string, created_at timestamp, updated_at timestamp",
        ("batch_id",), allowed={"status": BATCH_STATUSES}),
    "broadcast_details": Table(
        "detail_id bigint, batch_id string, article_id string, is_top10 boolean, top10_rank int, publish_status string, "
        "translated_title string, translated_summary string, translated_conclusion string, content_hash string, "
        "created_at timestamp, updated_at timestamp",
        ("detail_id",), {"batch_id": ("broadcast_batches", "batch_id"), "article_id": ("scraped_articles", "id")},
        {"publish_status": PUBLISH_STATUSES}),
    "sn_filings": Table(
        "filing_id string, ticker string, form string, filing_date date, accession_no string, period_of_report date, "
        "company_name string, cik bigint, fiscal_year_end_month int, quarter int, year int, content_hash string, "
        "created_at timestamp, updated_at timestamp", ("filing_id",)),
    "sn_notes": Table(
        "note_id string, filing_id string, ticker string, form string, accession_no string, note_number int, title string, "
        "short_name string, narrative_text string, narrative_hash string, expands array<string>, "
        "expands_statements array<string>, table_count int, details_count int, quarter int, year int, "
        "quarterly_status string, version int, content_hash string, created_at timestamp, updated_at timestamp",
        ("note_id",), {"filing_id": ("sn_filings", "filing_id")}),
    "sn_detail_registry": Table(
        "registry_id string, ticker string, detail_table_name string, source_title string, source_note_number int, "
        "source_accession_no string, role_or_type string, available_concepts array<string>, tidy_schema_version int, "
        "row_count int, quarter int, year int, quarterly_status string, content_hash string, created_at timestamp, "
        "updated_at timestamp", ("registry_id",)),
    "sn_note_details": Table(
        "detail_id string, accession_no string, note_number int, detail_index int, ticker string, form string, "
        "concept string, label string, standard_concept string, level int, abstract boolean, dimension boolean, "
        "is_breakdown boolean, dimension_axis string, dimension_member string, dimension_member_label string, "
        "dimension_label string, balance string, weight string, preferred_sign string, parent_concept string, "
        "parent_abstract_concept string, period_raw string, period_end_date date, period_type string, value string, "
        "row_order int, content_hash string, extracted_at timestamp, created_at timestamp, updated_at timestamp",
        ("detail_id",), {"accession_no": ("sn_filings", "accession_no")}),
    "sf_tickers": Table(
        "ticker string, company_name string, cik bigint, fiscal_year_end_month int, fiscal_year_end_date string, "
        "latest_quarter string, latest_extraction_at timestamp, content_hash string, created_at timestamp, updated_at timestamp",
        ("ticker",)),
    "sf_quarterly_facts": Table(
        "ticker string, statement_type string, concept string, label string, quarter string, period_end date, "
        "fiscal_period string, fiscal_year int, numeric_value double, unit string, period_type string, depth int, "
        "is_total boolean, concept_order int, content_hash string, extracted_at timestamp, created_at timestamp, "
        "updated_at timestamp",
        ("ticker", "statement_type", "concept", "quarter"), {"ticker": ("sf_tickers", "ticker")}),
    "jobs": Table(
        "job_id string, session_id string, tool_name string, args_json string, status string, retry_count int, "
        "resume_count int, created_at timestamp, updated_at timestamp, result_json string",
        ("job_id",), allowed={"status": JOB_STATUSES}, durable=False),
    "job_items": Table(
        "item_id bigint, job_id string, item_metadata string, status string, input_data string, output_data string, "
        "updated_at timestamp",
        ("item_id",), {"job_id": ("jobs", "job_id")}, {"status": ITEM_STATUSES}, durable=False),
    "logs": Table(
        "id string, job_id string, tag string, level string, status_state string, message string, payload_json string, "
        "event_id string, error_json string, timestamp timestamp", ("id",), durable=False,
        names={"timestamp": "log_ts"}),
    "sync_ledger": Table(
        "operation_id string, table_name string, direction string, row_count bigint, state string, started_at timestamp, "
        "completed_at timestamp, error_message string, created_at timestamp",
        ("operation_id",),
        allowed={"direction": ("LOCAL_TO_CLOUD", "CLOUD_TO_LOCAL", "BIDIRECTIONAL"),
                 "state": ("PENDING", "IN_PROGRESS", "COMPLETED", "FAILED")}, durable=False),
    "dead_letter_queue": Table(
        "dlq_id string, table_name string, row_id string, row_data string, error_message string, created_at timestamp",
        ("dlq_id",), durable=False),
    "stock_prices": Table(
        "ticker string, date date, open double, high double, low double, close double, volume bigint",
        ("ticker", "date"), durable=False),
    "calculated_metrics": Table(
        "ticker string, date date, moving_avg_3y double, std_dev_3y double, pe_ratio double", ("ticker", "date"), durable=False),
    "raw_fundamentals": Table(
        "ticker string, statement_type string, period_end_date date, label string, concept string, value double, unit string, "
        "source string, extracted_at timestamp", ("ticker", "statement_type", "period_end_date", "concept"), durable=False),
    "execution_ledger": Table(
        "id bigint, session_id string, role string, content string, tool_call_id string, tool_calls_json string, "
        "attachment_metadata string, char_count bigint, attachment_char_count bigint", ("id",), durable=False),
}

DURABLE = tuple(name for name, t in REGISTRY.items() if t.durable)
