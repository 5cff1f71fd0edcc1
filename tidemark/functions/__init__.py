"""Column expressions; all are built-in Catalyst expressions."""

from tidemark.functions.terms import (
    bucket_ts_of_url,
    bucket_url_child,
    bucket_url_sibling,
    event_iri,
    expand_iri,
    is_container,
    joined_text,
    meta_url,
    query_hash,
    retarget_query,
    storage_root,
    stream_of_inbox,
)
from tidemark.functions.times import epoch_ms, epoch_us, iso_ms, time_cell

__all__ = [
    "bucket_ts_of_url", "bucket_url_child", "bucket_url_sibling", "epoch_ms", "epoch_us",
    "event_iri", "expand_iri", "is_container", "iso_ms", "joined_text", "meta_url", "query_hash",
    "retarget_query", "storage_root", "stream_of_inbox", "time_cell",
]
