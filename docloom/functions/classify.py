"""Basic types of files, by signature and extension."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import suffix

HEADER_BYTES = 16
#: Category, extensions, signatures in hex. The order decides.
RULES = (
    ("document", (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".txt", ".rtf", ".odt", ".md", ".html"), ("25504446", "D0CF11E0")),
    ("image", (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".heic"), ("FFD8FF", "89504E47", "47494638")),
    ("code", (".py", ".js", ".ts", ".java", ".c", ".cpp", ".go", ".rs", ".sh", ".json", ".yaml", ".yml", ".vue", ".scss", ".less"), ()),
    ("archive", (".zip", ".tar", ".gz", ".rar", ".7z"), ("504B0304", "1F8B")),
    ("executable", (".exe", ".dll", ".apk", ".jar", ".ipa", ".msi", ".deb", ".dmg"), ("4D5A", "7F454C46", "CFFAEDFE", "CEFAEDFE")),
    ("media", (".mp4", ".mov", ".avi", ".mkv", ".m4a", ".mp3", ".wav", ".flac"), ("494433", "52494646", "664C6143")),
    ("data", (".csv", ".tsv", ".log", ".jsonl", ".xml"), ()),
)


def header_hex(content: Column) -> Column:
    return F.hex(F.substring(content, 1, HEADER_BYTES))


def by_signature(header: Column, rules: tuple = RULES) -> Column:
    out = F.lit(None).cast("string")
    for category, _, signatures in reversed(rules):
        for s in signatures:
            out = F.when(header.startswith(s), category).otherwise(out)
    return out


def by_extension(path: Column, rules: tuple = RULES) -> Column:
    out = F.lit(None).cast("string")
    for category, extensions, _ in reversed(rules):
        out = F.when(suffix(path).isin(*extensions), category).otherwise(out)
    return out


def classify(path: Column, header: Column, rules: tuple = RULES) -> Column:
    """struct(basic_type, matched_by). A zip signature says little, so an extension of another type overrides it."""
    magic, ext = by_signature(header, rules), by_extension(path, rules)
    overridden = (magic == "archive") & ext.isNotNull() & (ext != "archive")
    kind = F.when(overridden, ext).otherwise(F.coalesce(magic, ext, F.lit("unknown")))
    by = F.when(overridden, "extension_override").when(magic.isNotNull(), "magic_bytes").when(ext.isNotNull(), "extension")
    return F.struct(kind.alias("basic_type"), by.alias("matched_by"))


def load_rules(path: str) -> tuple:
    """Rules of a JSON file, in their order: a list of objects with ``type``, ``extensions`` and ``signatures`` (hex); broken entries are an error."""
    with open(path, encoding="utf-8") as f:
        rows = json.load(f)
    for r in rows:
        if not r.get("type") or not isinstance(r.get("extensions", []), list) or not all(len(bytes.fromhex(x)) <= HEADER_BYTES for x in r.get("signatures", [])):
            raise ValueError(f"not a rule: {r}")
    return tuple((r["type"], tuple(e.lower() for e in r.get("extensions", [])), tuple(x.upper() for x in r.get("signatures", []))) for r in rows)
