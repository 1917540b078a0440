"""Schemas of the tables that operators pass on. The order of chunks is always carried in columns."""

from __future__ import annotations

CHUNKS = (
    "page_content string, source string, page int, total_pages int, chunk_index int, split_method string, context_headings string, "
    "content_types_in_chunk string, content_extracted string, rotated_degrees int, content_type string, file_type string, encoding string, "
    "content_format string, likely_delimiter string, extra map<string,string>"
)
BILLS = (
    "id string, source string, is_bill boolean, vendor string, category string, amount double, amount_raw string, amount_confident boolean, "
    "due_date string, due_date_raw string, due_date_confident boolean, issue_date string, issue_date_raw string, issue_date_confident boolean"
)
CHOICE = "is_bill boolean, vendor string, category string, total_due string, due_date string, issue_date string"
ENTITIES = "text string, type string"
