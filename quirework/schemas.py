"""Declared schemas of the tables that the library reads."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampType(), "m": T.MapType(T.StringType(), T.StringType()), "bin": T.BinaryType()}


def _schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (c.split(":") for c in columns.split())])


TABLES: dict[str, T.StructType] = {
    "files": _schema("id:s original_name:s stored_name:s content_type:s size:l sha256:s source_system:s created_at:t expires_at:t"),
    "jobs": _schema("id:s operation:s status:s progress:i input_file_ids_json:s output_file_id:s params_json:s error:s requested_by:s rq_job_id:s lease_epoch:i lease_token:s lease_expires_at:t created_at:t started_at:t finished_at:t"),
    "job_output_artifacts": _schema("job_id:s file_id:s role:s ordinal:i"),
    "artifact_write_journal": _schema("id:s job_id:s lease_epoch:i lease_token:s stored_name:s role:s state:s file_id:s created_at:t updated_at:t"),
    "archive_records": _schema("id:s file_id:s integration_name:s external_id:s status:s error:s created_at:t updated_at:t"),
    "webhook_deliveries": _schema("id:s job_id:s service_name:s url:s event:s status:s attempt_count:i max_attempts:i next_attempt_at:t last_error:s last_status_code:i created_at:t updated_at:t delivered_at:t"),
    "service_policies": _schema("service_name:s rate_limit_per_minute:i daily_job_limit:i max_storage_mb:i webhook_url:s"),
    "api_keys": _schema("id:s name:s key_hash:s scopes_json:s active:b last_used_at:t"),
    "storage_objects": _schema("area:s stored_name:s location:s size:l modified_at:t"),
    "audit_events": _schema("timestamp:t event:s actor:s resource_type:s resource_id:s details:m"),
    "http_requests": _schema("ts:t method:s route:s status:i duration_s:d"),
    "job_events": _schema("ts:t job_id:s queue_class:s operation:s state:s duration_s:d"),
    "metric_samples": _schema("metric:s labels:m ts:t value:d"),
    "doc_pages": _schema("doc_id:s page_no:i text:s width:d height:d rotation:i"),
    "spans": _schema("page_id:s seq:i x:d y:d text:s"),
    "rules": _schema("page_id:s axis:s pos:d lo:d hi:d"),
    "archive_members": _schema("archive_id:s seq:i name:s file_size:l compress_size:l compress_type:i mode:i flag_bits:i is_dir:b"),
}
