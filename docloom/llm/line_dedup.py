"""Line dedup by a log-template tree, in DataFrame operations only.

A line is parsed at a fixed depth: its number of tokens, then its first ``DEPTH`` tokens, lead to a leaf; tokens with
a digit are variable fields. In a leaf of several lines a place is constant if one token has ``CONSTANT`` of it; if
``SHARE`` of the places after the leading tokens are constant, they are the leaf's template and the lines that agree
with them belong to it. Any other line is its own template.

A template is dropped if it recurs across documents that are not copies of each other: the documents that have it
must fall into ``MIN_FAMILIES`` families at least, and into one for each ``PER_FAMILY`` different texts. Each text that has a
template of ``MIN_FAMILIES`` texts is heard by its ``VOICES`` least hashes of shingles of three words. If at least a third of these are
in no other such text, much of the text is its own, and it is a family by itself, whatever block it shares: a block makes texts kin
only where little else is in them. Other texts are kin if they have two of their four least voices in common, and take the least voice
among their kin, and among the kin of their kin. So copies, however many and wherever edited, are one family or few.

Lines are hashed once, into a row for each document. Only lines of leaves with several lines, and texts with such templates, are read and
tokenised once more. What else is shuffled are the different texts of a template, their voices, and those lines.

Cases: lines without a token are never dropped; a null text stays null; a text may become empty; repeated rows count
once and are all cleaned; null ids are ids like others; an empty table gives an empty result; a column that is called
``n_dropped_lines`` is replaced; all other columns pass unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpoint, few, join_few, let, written

DEPTH = 3
CONSTANT = 0.8
SHARE = 0.6
MIN_FAMILIES = 5
PER_FAMILY = 200
VOICES = 32
KIN_VOICES = 4
SHINGLE = 3
#: A power of two.
EVERY = 4
#: Lines of a leaf below which it has no template.
MIN_LINES = 5
FIELD = "<*>"
#: One by one, which Java tests faster than ranges.
DIGIT, SPACE, OTHER_SPACE = "0123456789", r"\x20\x09\x0A\x0B\x0C\x0D", r"\x09\x0B\x0C\x0D"


def plain_lines(text: Column) -> Column:
    """The tokens of each line of a text, variable fields generalised, with one blank between them; most lines are so already."""
    field = f"(?<![^{SPACE}])[^{SPACE}{DIGIT}]*+[{DIGIT}][^{SPACE}]*+"  # from the first character of a token to its last one
    clean = F.when(text.rlike(f"[{DIGIT}{OTHER_SPACE}]"), F.regexp_replace(F.regexp_replace(text, f"[{OTHER_SPACE}]", " "), field, FIELD)).otherwise(text)
    blanks = lambda x: F.concat(F.lit(" "), x, F.lit(" ")).contains("  ")
    return F.transform(F.split(clean, "\n"), lambda x: F.when(blanks(x), F.array_join(F.array_remove(F.split(x, " "), ""), " ")).otherwise(x))


def tokens(line: Column) -> Column:
    """The tokens of a line of ``plain_lines`` that has some."""
    return F.split(line, " ")


def voices(words: Column) -> Column:
    """The least hashes of the shingles of a text, 15 hex digits of MD5 as a number, over the shingles whose first
    word has a first character and a length that sum up to a multiple of ``EVERY``; over all shingles if those are fewer than VOICES."""

    def of(ws: Column) -> Column:
        first = F.slice(ws, 1, F.greatest(F.size(ws) - SHINGLE + 1, F.lit(1)))
        after = lambda i: [F.get(ws, i + k) for k in range(1, SHINGLE)]
        whole = lambda w, i: F.concat(w, *[x for word in after(i) for x in (F.lit(" "), word)])  # noqa: E731  null in a text of fewer words
        some = F.filter(F.transform(first, lambda w, i: F.when((F.ascii(w) + F.length(w)).bitwiseAND(F.lit(EVERY - 1)) == 0, F.md5(whole(w, i)))), lambda h: h.isNotNull())
        hashes = let(some, lambda x: F.when(F.size(x) < VOICES, F.transform(first, lambda w, i: F.md5(F.concat_ws(" ", w, *after(i))))).otherwise(x))
        return F.transform(F.slice(F.sort_array(F.array_distinct(hashes)), 1, VOICES), lambda h: F.conv(F.substring(h, 1, 15), 16, 10).cast("long"))

    return let(words, lambda ws: F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).otherwise(of(ws)))


def parsed(docs: DataFrame) -> DataFrame:
    """(th, lines) of each text, lines with tokens as (at, leaf, own): hashes of the leaf and of the line."""

    def line(x: Column, i: Column) -> Column:
        return F.when(x != "", F.struct(i.alias("at"), F.xxhash64(F.size(tokens(x)), F.substring_index(x, " ", DEPTH)).alias("leaf"), F.xxhash64(x).alias("own")))

    lines = F.filter(F.transform(plain_lines(F.col("text")), line), lambda x: x.isNotNull())
    return docs.where("text is not null").select(F.xxhash64("text").alias("th"), lines.alias("lines"))


def worded(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """(th, at, leaf, words) of the lines spots (th, at, leaf) of over DEPTH tokens, each once: hashes of their tokens."""
    of = written(spots.groupBy("th").agg(F.collect_set(F.struct("at", "leaf")).alias("spots")))
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("th"), "text").join(few(of), "th")
    words = lambda x: F.transform(tokens(x), lambda t: F.hash(t))
    found = let(plain_lines(F.col("text")), lambda lines: F.transform("spots", lambda s: F.struct(s["at"].alias("at"), s["leaf"].alias("leaf"), words(F.get(lines, s["at"])).alias("words"))))
    return texts.select("th", F.explode(found).alias("x")).select("th", "x.at", "x.leaf", "x.words").where(F.size("words") > DEPTH).dropDuplicates(["th", "at"])


def heard(docs: DataFrame, speakers: DataFrame) -> DataFrame:
    """(th, voices) of the texts among speakers (th), each text once."""
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("th"), "text").join(few(speakers), "th", "left_semi")
    words = F.flatten(F.transform(F.filter(plain_lines(F.col("text")), lambda x: x != ""), tokens))
    return written(texts.select("th", voices(words).alias("voices")).dropDuplicates(["th"]))


def families(texts: DataFrame) -> DataFrame:
    """(th, family) of texts (th, voices): a text of its own is one; else the least voice of the kin of a text's kin."""
    each = texts.select("th", F.explode("voices").alias("voice"))
    single = each.groupBy("voice").agg(F.count(F.lit(1)).alias("n"), F.min("th").alias("th")).where("n = 1").groupBy("th").agg(F.count(F.lit(1)).alias("single"))
    alone = texts.join(single, "th").where(3 * F.col("single") >= F.size("voices")).select("th")
    own = alone.select("th", F.struct(F.lit(True).alias("own"), F.col("th").alias("of")).alias("family"))
    first = texts.join(alone, "th", "left_anti").select("th", F.slice("voices", 1, KIN_VOICES).alias("voices"))
    pairs = F.flatten(F.transform("voices", lambda v, i: F.transform(F.slice("voices", i + 2, F.lit(KIN_VOICES)), lambda w: F.xxhash64(v, w))))
    keys = F.when(F.size("voices") > 1, pairs).otherwise(F.transform("voices", lambda v: F.xxhash64(v)))
    of = first.select("th", F.explode(keys).alias("key"), F.array_min("voices").alias("family"))
    for last in (False, True):
        least = of.groupBy("key").agg(F.min("family").alias("least"))
        near = of.select("th", "key").join(least, "key").groupBy("th").agg(F.min("least").alias("family"))
        of = near if last else first.select("th", F.explode(keys).alias("key")).join(near, "th")
    return own.unionByName(of.select("th", F.struct(F.lit(False).alias("own"), F.col("family").alias("of")).alias("family")))


def leaf_templates(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(th, at, leaf) of the lines (th, at, leaf, own) of docs that belong to the template of their leaf."""
    different = lines.groupBy("leaf", "own", "th", "at").agg(F.count(F.lit(1))).groupBy("leaf", "own")  # equal texts count once
    several = different.agg(F.count(F.lit(1)).alias("n")).groupBy("leaf").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("owns")).where((F.col("n") >= MIN_LINES) & (F.col("owns") > 1)).select("leaf")
    found = written(worded(docs, join_few(lines, several, "leaf").select("th", "at", "leaf")))
    counts = found.select("leaf", F.posexplode("words").alias("place", "token")).groupBy("leaf", "place", "token").agg(F.count(F.lit(1)).alias("n"))
    places = counts.groupBy("leaf", "place").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("all"))
    constant = F.when(F.col("top.n") >= CONSTANT * F.col("all"), F.col("top.token"))
    share = F.avg(F.when(F.col("place") >= DEPTH, constant.isNotNull().cast("double")))
    shape = places.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("place", constant.alias("token")))).alias("shape"), share.alias("share")).where(F.col("share") >= SHARE)
    agrees = F.forall("shape", lambda s: s["token"].isNull() | (s["token"] == F.get("words", s["place"])))
    return join_few(found, shape, "leaf").where(agrees).select("th", "at", "leaf")


def recurring_lines(docs: DataFrame, min_families: int = MIN_FAMILIES) -> DataFrame:
    """(th, places) of the texts that have lines to drop; th is the text's hash."""
    texts = written(parsed(docs))
    lines = texts.select("th", F.explode("lines").alias("x")).select("th", "x.at", "x.leaf", "x.own")
    general = leaf_templates(docs, lines)
    of = lines.select("th", "at", "own").distinct().join(general, ["th", "at"], "left").select("th", "at", F.coalesce("leaf", "own").alias("template"))
    of = written(of.groupBy("th", "template").agg(F.collect_set("at").alias("places")))
    often = of.groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_families).select("template")
    of = written(join_few(of, often, "template"))
    # each family counts once for a template: texts are summed before families are counted
    kin = checkpoint(families(heard(docs, written(of.select("th").distinct()))))
    votes = of.select("th", "template").join(kin, "th").groupBy("template", "family").agg(F.count(F.lit(1)).alias("n"))
    recurring = votes.groupBy("template").agg(F.count(F.lit(1)).alias("families"), F.sum("n").alias("texts")).where((F.col("families") >= min_families) & (F.col("families") * PER_FAMILY >= F.col("texts")))
    return join_few(of, recurring.select("template"), "template").groupBy("th").agg(F.flatten(F.collect_list("places")).alias("places"))


def drop_recurring_lines(docs: DataFrame, min_families: int = MIN_FAMILIES) -> DataFrame:
    """docs with the recurring lines taken out of ``text``, and ``n_dropped_lines`` added under that name."""
    names = [c for c in docs.columns if c != "n_dropped_lines"]
    gone = few(checkpoint(recurring_lines(docs, min_families)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64("text").alias("th")).join(gone, "th", "left").select("row", "places")
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda _, i: ~F.array_contains("places", i)), "\n")
    text = F.when(F.col("places").isNull(), F.col("row.text")).otherwise(kept)
    return rows.select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names], F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped_lines"))
