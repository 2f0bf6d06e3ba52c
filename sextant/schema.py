"""Tables of an index. A missing value is null; every table that is scanned in order carries `ord`.

Chunks are named by chunk_id, twelve hexadecimal digits of a hash of path, name and first line; vectors, references and
sources are keyed by it, never by position.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _table(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


TABLES = {
    "code_source": "chunk_id string, ord long, file_path string, module string, name string, kind string, start_line int, end_line int, content string, context string",
    "code_chunks": "chunk_id string, ord long, file_path string, module string, name string, kind string, start_line int, end_line int, summary string, signature string, extra map<string,string>",
    "code_vectors": "chunk_id string, code_emb array<float>, summary_emb array<float>",
    "imports": "file_path string, module string, line int, raw string",
    "type_refs": "file_path string, types array<string>",
    "signatures": "file_path string, name string, kind string, signature string, start_line int",
    "doc_source": "chunk_id string, ord long, file_path string, heading string, heading_path string, level int, start_line int, end_line int, content string, summary string, tags array<string>, out_links array<string>",
    "doc_sections": "chunk_id string, ord long, file_path string, heading string, heading_path string, level int, start_line int, end_line int, summary string, tags array<string>, link_count int, word_count int",
    "doc_links": "source_file string, source_heading string, target_path string, target_resolved string, link_text string, line int",
    "frontmatters": "file_path string, id string, title string, status string, tags array<string>, related array<string>, extra map<string,string>",
    "doc_vectors": "chunk_id string, emb array<float>",
    "file_hashes": "file_path string, sha256 string",
    "doc_hashes": "file_path string, sha256 string",
    "refs": "session string, ref_id string, chunk_id string",
    "invocations": "kind string, completed_at timestamp, message string, batches int, failed_batches int, duration_ms long, semantic_state string, chunks int, imports int, signatures int",
}


def schema(name: str) -> T.StructType:
    return _table(TABLES[name])


def chunk_id(path: Column, name: Column, line: Column) -> Column:
    joined = F.concat_ws("|", F.translate(path, "\\", "/"), F.coalesce(name, F.lit("")), line.cast("string"))
    return F.substring(F.sha2(joined, 256), 1, 12)
