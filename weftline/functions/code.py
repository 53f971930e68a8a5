"""Code files: language by suffix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by suffix.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".jsx": "javascript",
    ".tsx": "typescript",
    ".java": "java",
    ".cpp": "cpp",
    ".c": "c",
    ".cs": "csharp",
    ".go": "go",
    ".rs": "rust",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
}


def suffix(path: Column) -> Column:
    """The lower-case suffix of the last part of a path, with its dot; empty for names that only begin with one."""
    return F.regexp_extract(F.lower(path), r"[^/.][^/]*(\.[^./]+)$", 1)


def language(path: Column) -> Column:
    """The language of a code file, or null."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.element_at(table, suffix(path))
