"""Schemas of the stored relations, enumerations and the job state machine."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, TS, B = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType(), T.BooleanType()


def relation(required: str, optional: str = "", kinds: dict[str, T.DataType] | None = None) -> T.StructType:
    """Columns are strings unless ``kinds`` says otherwise."""
    kinds = kinds or {}
    return T.StructType([T.StructField(c, kinds.get(c, S), c in optional.split()) for c in [*required.split(), *optional.split()]])


RELATIONS = {
    "jobs": relation(
        "id input_path output_path input_checksum source_language target_language display_order granularity provider model status total_segments completed_segments failed_segments accumulated_input_tokens accumulated_output_tokens created_at updated_at",
        "user_id estimated_cost last_run_at next_run_at error_message",
        dict.fromkeys("total_segments completed_segments failed_segments accumulated_input_tokens accumulated_output_tokens".split(), L) | dict.fromkeys("created_at updated_at last_run_at next_run_at".split(), TS) | {"estimated_cost": D},
    ),
    "segments": relation(
        "job_id id chapter_path element_locator order_index source_text source_html source_checksum status retry_count", "translated_text translated_html input_tokens output_tokens error_message", dict.fromkeys("order_index retry_count input_tokens output_tokens".split(), L)
    ),
    "translation_cache": relation("cache_key translated_text created_at", "", {"created_at": TS}),
    "usage_ledger": relation("id job_id provider model input_tokens output_tokens date_key month_key created_at", "", {"id": L, "input_tokens": L, "output_tokens": L, "created_at": TS}),
    "job_locks": relation("job_id holder_id acquired_at expires_at", "", {"acquired_at": TS, "expires_at": TS}),
    "users": relation("id email password_hash created_at", "free_translation_used_at stripe_customer_id", {"created_at": TS, "free_translation_used_at": TS}),
    "uploads": relation(
        "id user_id original_filename stored_path source input_checksum size_bytes chapter_count paragraph_count source_token_estimate estimated_output_tokens created_at", "", dict.fromkeys("size_bytes chapter_count paragraph_count source_token_estimate estimated_output_tokens".split(), L) | {"created_at": TS}
    ),
    "translation_orders": relation(
        "id user_id upload_id source_language target_language display_order estimated_input_tokens estimated_output_tokens amount_usd_cents is_free status created_at updated_at",
        "job_id stripe_checkout_session_id stripe_payment_intent_id error_message",
        dict.fromkeys("estimated_input_tokens estimated_output_tokens amount_usd_cents".split(), L) | {"is_free": B, "created_at": TS, "updated_at": TS},
    ),
    "schema_migrations": relation("id name applied_at", "", {"id": L, "applied_at": TS}),
}

# The allowed moves of a job.
TRANSITIONS = {
    "CREATED": ("EXTRACTING", "FAILED", "CANCELLED"),
    "EXTRACTING": ("SEGMENTING", "FAILED", "CANCELLED"),
    "SEGMENTING": ("READY", "FAILED", "CANCELLED"),
    "READY": ("TRANSLATING", "CANCELLED"),
    "TRANSLATING": ("PAUSED_BUDGET", "PAUSED_RATE_LIMIT", "RENDERING", "FAILED", "CANCELLED"),
    "PAUSED_BUDGET": ("TRANSLATING", "CANCELLED"),
    "PAUSED_RATE_LIMIT": ("TRANSLATING", "CANCELLED"),
    "RENDERING": ("VALIDATING", "FAILED", "CANCELLED"),
    "VALIDATING": ("COMPLETED", "FAILED", "CANCELLED"),
}
RUNNABLE = ("READY", "PAUSED_BUDGET", "PAUSED_RATE_LIMIT")
SERVER_RUNNABLE = (*RUNNABLE, "TRANSLATING")
SEGMENT_STATUSES = ("PENDING", "TRANSLATED", "FAILED")
ORDER_STATUSES = ("AWAITING_PAYMENT", "FREE_GRANTED", "PAID", "PAYMENT_FAILED", "CANCELLED")
