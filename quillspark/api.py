"""What users call."""

from .functions.casing import to_sentence_case
from .operators.abbrev import merge as merge_abbreviations
from .operators.parse import chunk_table, entries, entry_values, errors, field_table, fields, parse_bibtex, parse_text, pivot_fields, strings
from .options import MATRIX, Options
from .sources.files import read_fields, read_ordered_csv, read_text, read_titles, register, sentence_cased, write_golden, write_ordered_csv
from .streaming.files import stream_documents, stream_fields

__all__ = [
    "MATRIX", "Options", "chunk_table", "entries", "entry_values", "errors", "field_table", "fields", "merge_abbreviations", "parse_bibtex", "parse_text", "pivot_fields",
    "read_fields", "read_ordered_csv", "read_text", "read_titles", "register", "sentence_cased", "stream_documents", "stream_fields", "strings", "to_sentence_case", "write_golden", "write_ordered_csv",
]
