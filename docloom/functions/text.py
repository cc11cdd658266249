"""Text functions as columns; white space is Unicode's, with U+001C to U+001F."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that a strip removes.
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0  -     　"
SPACES = f"[{SPACE}]"
#: The same but for the end of a line.
BLANKS = f"[{SPACE}&&[^\n]]"
#: Markdown links of images and of texts.
IMAGE_LINK, TEXT_LINK = r"!\[[^\]]*\]\([^)]*\)", r"\[([^\]]*)\]\([^)]*\)"
#: The note before a sampled text, and the marker of a sheet.
NOTE_HEAD, NOTE_TAIL = "（提示：原文共 ", " 字符，数量过多，这里是均匀抽样保留的代表性内容，不是完整原文）"
NOTE = r"^（提示：原文共 [0-9]+ 字符，数量过多，[^）]*）\n?"
SENTENCE_ENDS = ("。", "！", "？", "」", "》", ".", "!", "?")
TABULAR = r"^python-csv|^openpyxl|^xlrd|SpreadsheetML"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACES}+|{SPACES}+\\z", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACES}+", " ")


def normalize_text(c: Column) -> Column:
    """Without image links, with link texts only; each line stripped, runs of blank lines made one."""
    c = F.regexp_replace(c, IMAGE_LINK, "")
    c = F.regexp_replace(c, TEXT_LINK, "$1")
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, f"(?md)^{BLANKS}++|{BLANKS}++$", "")  # of each line
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def compact_text(c: Column, most: int = 220) -> Column:
    one = strip(collapse(c))
    return F.when(F.length(one) > most, F.concat(F.regexp_replace(F.substring(one, 1, most), f"{SPACES}+\\z", ""), F.lit("..."))).otherwise(one)


def spread_sample(c: Column, max_len: int, pieces: int = 5) -> Column:
    """Pieces from all over a text; a short text repeats itself."""
    size = max(max_len // pieces, 1)
    offset = lambda i: F.when(F.length(c) <= size, 0).otherwise(F.floor(i * (F.length(c) - size) / max(pieces - 1, 1))).cast("int")
    return strip(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(c, offset(i) + 1, F.lit(size))), "\n...\n"))


def sample_note(n_chars: Column) -> Column:
    return F.concat(F.lit(NOTE_HEAD), n_chars.cast("string"), F.lit(NOTE_TAIL))


def strip_note(c: Column) -> Column:
    return F.regexp_replace(c, NOTE, "")


def stored_text(c: Column, most: int = 3_000_000, pieces: int = 50) -> Column:
    """The text as kept in the index: a sample with a note where it is too long."""
    return F.when(F.length(c) > most, F.concat(sample_note(F.length(c)), F.lit("\n"), spread_sample(c, most, pieces))).otherwise(c)


def snippet(c: Column, path: Column, max_len: int = 1500) -> Column:
    """The part of a text that a tagger reads."""
    clean = strip(collapse(F.regexp_replace(strip_note(c), "<[^>]+>", " ")))
    kind = F.lower(F.substring_index(path, ".", -1))
    clean = F.when(kind.isin("html", "htm") & (F.length(clean) > 400), F.substring(clean, 201, 1 << 30)).when((kind == "pdf") & (F.length(clean) > 600), F.substring(clean, 351, 1 << 30)).otherwise(clean)
    return F.when(F.length(clean) > max_len * 10, spread_sample(clean, max_len)).otherwise(strip(F.substring(clean, 1, max_len)))


def looks_complete(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACES}+\\z", "").rlike("[" + "".join(SENTENCE_ENDS) + "]\\z")


def volume_label(path: Column) -> Column:
    return F.when(path.rlike("^/Volumes/[^/]+"), F.regexp_extract(path, "^/Volumes/([^/]+)", 1)).otherwise("本机")


def format_bytes(n: Column) -> Column:
    size = n.cast("double")
    shown = lambda x, unit: F.format_string(f"%.1f{unit}", F.bround(x, 1))  # noqa: E731  ties to even
    return F.when(size < 1024, F.concat(n.cast("string"), F.lit("B"))).when(size < 1024**2, shown(size / 1024, "KB")).when(size < 1024**3, shown(size / 1024**2, "MB")).otherwise(shown(size / 1024**3, "GB"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """The lower-case extension with its dot; a leading dot begins no extension."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]+)$", 1))


def report_tag(directory: Column) -> Column:
    """A directory's name and a short hash of its path, fit for a file name."""
    name = basename(directory)
    return F.concat(F.when(name == "", "root").otherwise(name), F.lit("_"), F.substring(F.sha2(directory, 256), 1, 8))


def report_tag_all(db_path: Column) -> Column:
    return F.concat(F.lit("全库_"), F.substring(F.sha2(db_path, 256), 1, 8))


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def is_tabular(extractor: Column) -> Column:
    return extractor.rlike(TABULAR)


def under(path: Column, directory: str) -> Column:
    """Whether a path is a directory or below it (case counts; % and _ are no wildcards)."""
    directory = directory.rstrip("/")
    return (path == directory) | path.startswith(directory + "/")
