"""Personal data: pattern matches, and terms that give away whom they belong to.

Base spans are matches of four patterns. An entity is the value of a base span; it is protected if several documents have it.
Terms near its mentions are weighed by information theory: over the whole corpus, a term whose presence makes an entity likely
gives it away. With N documents, n(c) that mention the entity c, n(t) that hold the term t and n(c, t) where t is near a mention of c,
the pointwise mutual information of c and t is log2(N n(c,t) / (n(c) n(t))), and it is at most the information of c itself, log2(N / n(c)).
A term that carries the share ``DISCLOSURE`` of it is generalised; a term that is never found elsewhere carries all of it and is removed.
The pair must be supported by surroundings as varied as ``MIN_CONTEXTS`` equally likely ones (the inverse of the chance that two mentions
near the term have the same), so that copies, edited or not, are no evidence; surroundings are told apart by the least digest of their runs
of three terms, which an edit seldom changes. In the documents
that mention an entity, all its disclosing terms become spans of the kind ``term`` wherever they stand outside base spans.

Only DataFrame functions are used. Positions come from the pieces between matches. Patterns are possessive and begin where a run of
their characters begins, which finds the same matches in one pass over a text of any length. Running sums and maxima of the spans of
a document take n ** 1.5 steps. Entities that few documents have go before any term is counted, pairs of terms and entities are taken
from windows around mentions only, and all counts are added up before the shuffle, so that an entity that a third of all documents mention
is never gathered. Candidate terms are broadcast only if their measured size allows.

Cases: a null or empty text has no spans; repeated rows each count as a document and have equal spans; spans of different kinds may
overlap (the sanitised text replaces their union once); equal starts are ordered by kind; an empty table gives no rows; other columns are
never read. Texts are processed whole; positions are code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import few, let, written

#: Kinds in order, and their patterns as Java reads them; possessive, and begun where a run begins, they match what the plain patterns match.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a valid match of a kind holds at least; cheaper than the pattern.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
TERM_KIND = "term"
#: A term is a run of ASCII letters and of whatever is not ASCII; what separates terms, one by one, which Java tests faster than ranges.
SEPARATORS = "[" + "".join(f"\\x{c:02x}" for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122)) + "]+"
TERMS = SEPARATORS.replace("[", "[^", 1)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_TERM = 3
#: Code points before and after a mention in which terms are near it.
WINDOW = 80
MIN_CONTEXTS = 3
SHINGLE = 3
#: Documents that mention a protected entity.
MIN_MENTIONS = 3
DISCLOSURE = 0.9
#: Code points of a block of a text that is cut into pieces.
BLOCK = 4096
SPAN = "array<struct<kind:string,start:int,stop:int,value:string,before:string,after:string>>"


def running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` makes of the values up to each one, in blocks of about the root of their number."""

    def blocks(a: Column, width: Column) -> Column:
        fold = lambda first, n: F.aggregate(F.slice(a, first, n), start, step)
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int")), lambda b: fold(b * width + 1, width))
        totals = lambda s: F.transform(s, lambda _, i: F.aggregate(F.slice(s, F.lit(1), i), start, step))
        at = lambda i: F.floor(i / width).cast("int")
        return let(let(sums, totals), lambda before: F.transform(a, lambda _, i: step(F.get(before, at(i)), fold(at(i) * width + 1, i - at(i) * width + 1))))

    return let(values, lambda a: F.when(F.size(a) == 0, a).otherwise(let(F.greatest(F.lit(1), F.floor(F.sqrt(F.size(a))).cast("int")), lambda w: blocks(a, w))))


def latest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def matches(text: Column, pattern: str, body: Callable[[Column, Column, Column], Column]) -> Column:
    """body of the matches of a pattern, the pieces around them (one more), and the matches' places."""

    def placed(found: Column, pieces: Column) -> Column:
        steps = F.transform(found, lambda _, i: F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0))
        return let(running(steps, F.lit(0), lambda a, b: a + b), lambda starts: body(found, pieces, starts))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda pieces: placed(found, pieces)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the last digit of a number checks the others."""
    doubled = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
    weight = lambda i: let(F.substring(F.reverse(number), i, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 0, doubled(d)).otherwise(d))
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda s, i: s + weight(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda n: (F.length(n) <= 3) & (F.coalesce(n.try_cast("int"), F.lit(0)) <= 255))
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        return let(digits(value), lambda n: F.when(F.length(n).between(13, 19), luhn(n)).otherwise(False))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def entity(kind: str, value: Column) -> Column:
    """One spelling for the values that are the same entity."""
    return F.translate(value, UPPER, LOWER) if kind == "email" else value if kind == "ip" else digits(value)


def base_spans(text: Column) -> Column:
    """SPAN: the valid matches of all kinds in order, with their entities and what is near them."""
    # a word that the edge of the window cuts is left out
    before = lambda piece: F.when(F.length(piece) > WINDOW, F.regexp_replace(F.right(piece, F.lit(WINDOW)), f"^{TERMS}", "")).otherwise(piece)
    after = lambda piece: F.when(F.length(piece) > WINDOW, F.regexp_replace(F.left(piece, F.lit(WINDOW)), f"{TERMS}$", "")).otherwise(piece)

    def of(kind: str) -> Column:
        def spans(found: Column, pieces: Column, starts: Column) -> Column:
            good = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: valid(kind, F.get(found, i)))
            rows = F.transform(good, lambda i: F.struct(F.lit(kind).alias("kind"), F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(F.get(found, i))).alias("stop"), entity(kind, F.get(found, i)).alias("value"), before(F.get(pieces, i)).alias("before"), after(F.get(pieces, i + 1)).alias("after")))
            return F.when(F.size(found) > 0, rows)

        hint = F.contains(text, F.lit(HINTS[kind])) if kind == "email" else F.rlike(text, F.lit(HINTS[kind]))
        return F.coalesce(F.when(hint, matches(text, PATTERNS[kind], spans)), F.array().cast(SPAN))

    return F.concat(*map(of, KINDS))


def terms(text: Column) -> Column:
    """The different terms of a text, lower-case."""
    return F.filter(F.array_distinct(F.split(F.translate(text, UPPER, LOWER), SEPARATORS)), lambda t: F.length(t) >= MIN_TERM)


def context(near: Column) -> Column:
    """What tells the surroundings of mentions apart."""
    words = F.filter(F.split(F.translate(near, UPPER, LOWER), SEPARATORS), lambda t: t != "")
    digest = lambda w: F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))), lambda i: F.md5(F.array_join(F.slice(w, i, SHINGLE), " "))))
    return let(words, digest)


def disclosures(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, term, removed): the terms that give a protected entity away, over found (row, spans) and docs (text)."""
    mentions = found.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", F.struct("s.kind", "s.value").alias("entity"), F.concat_ws("\n", "s.before", "s.after").alias("near"))
    known = written(mentions.select("row", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("mentioned")).where(F.col("mentioned") >= MIN_MENTIONS))
    near = mentions.join(few(known.select("entity")), "entity").select("row", "entity", context(F.col("near")).alias("context"), F.explode(terms(F.col("near"))).alias("term"))
    once = near.groupBy("entity", "term", "row").agg(F.min("context").alias("context"))
    by_context = once.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
    pairs = written(by_context.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.sum(F.col("n").cast("double") * F.col("n")).alias("same")).where(F.col("both").cast("double") * F.col("both") >= MIN_CONTEXTS * F.col("same")))
    candidates = written(pairs.select("term").distinct())
    held = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).join(few(candidates), "term").groupBy("term").agg(F.count(F.lit(1)).alias("held"))
    total = docs.count()
    rows = pairs.join(held, "term").join(few(known), "entity")
    likely = F.col("both") / F.col("held") >= F.pow(F.col("mentioned") / F.lit(float(max(total, 1))), F.lit(1 - DISCLOSURE))
    return written(rows.where(likely & (F.col("mentioned") < total)).select("entity", "term", (F.col("both") == F.col("held")).alias("removed")))


def term_spans(text: Column, base: Column, told: Column) -> Column:
    """array<struct<kind, start, stop, label>> of the told terms (term, removed) of a text outside its base spans."""

    def spans(found: Column, _: Column, starts: Column) -> Column:
        names = F.transform(found, lambda t: F.translate(t, UPPER, LOWER))

        def rows(lower: Column) -> Column:
            hits = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.array_contains(known, F.get(lower, i)))
            label = lambda t: F.when(F.array_contains(gone, F.translate(t, UPPER, LOWER)), "").when(F.rlike(t, F.lit(r"^\p{Lu}")), "<NAME>").otherwise("<TERM>")
            return F.transform(hits, lambda i: F.struct(F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(F.get(found, i))).alias("stop"), label(F.get(found, i)).alias("label"), F.lit(TERM_KIND).alias("kind")))

        return F.when(F.size(found) > 0, let(names, rows))

    known, gone = F.transform(told, lambda x: x["term"]), F.transform(F.filter(told, lambda x: x["removed"]), lambda x: x["term"])
    found = F.coalesce(matches(text, TERMS, spans), F.array().cast("array<struct<start:int,stop:int,label:string,kind:string>>"))
    mixed = F.array_sort(F.concat(F.transform(base, labelled), found))

    def apart(all_: Column) -> Column:
        is_base = lambda s: s["kind"] != TERM_KIND
        ends = running(F.transform(all_, lambda s: F.when(is_base(s), s["stop"]).otherwise(0)), F.lit(0), latest)
        starts = running(F.reverse(F.transform(all_, lambda s: F.when(is_base(s), s["start"]).otherwise(2**31 - 1))), F.lit(2**31 - 1), lambda a, b: F.least(a, b))
        clear = lambda e, b: F.filter(F.transform(all_, lambda s, i: F.when(~is_base(s) & (F.get(e, i) <= s["start"]) & (F.get(b, F.size(all_) - 1 - i) >= s["stop"]), s)), lambda s: s.isNotNull())
        return let(ends, lambda e: let(starts, lambda b: clear(e, b)))

    return let(mixed, apart)


def labelled(span: Column) -> Column:
    return F.struct(span["start"].alias("start"), span["stop"].alias("stop"), F.concat(F.lit("<"), F.upper(span["kind"]), F.lit(">")).alias("label"), span["kind"].alias("kind"))


def sanitised(text: Column, spans: Column) -> Column:
    """A text with labels in place of its labelled spans; spans that overlap are replaced together, under the first label."""

    def cut(blocks: Column, lo: Column, hi: Column) -> Column:
        first = lambda b: F.greatest(lo - b * BLOCK, F.lit(0))
        part = lambda b: F.substring(F.get(blocks, b), first(b) + 1, F.least(hi - b * BLOCK, F.lit(BLOCK)) - first(b))
        of = F.sequence(F.floor(lo / BLOCK).cast("int"), F.floor((hi - 1) / BLOCK).cast("int"))
        return F.when(hi > lo, F.array_join(F.transform(of, part), "")).otherwise("")

    def build(blocks: Column, all_: Column, ends: Column) -> Column:
        covered = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        parts = F.transform(all_, lambda s, i: F.concat(cut(blocks, covered(i), s["start"]), F.when(s["start"] >= covered(i), s["label"]).otherwise("")))
        return F.concat(F.array_join(parts, ""), cut(blocks, F.get(ends, F.size(all_) - 1), F.length(text)))

    whole = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda blocks: let(F.array_sort(spans), lambda all_: let(running(F.transform(all_, lambda s: s["stop"]), F.lit(0), latest), lambda ends: build(blocks, all_, ends))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def spelled(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added, sanitised_text): base spans (SPAN), added spans of terms, and the text without either (null where it has neither), for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", base_spans(F.col("text")).alias("spans")).withColumn("text", F.when(F.size("spans") > 0, F.col("text"))))
    telling = disclosures(found.select("row", "spans"), rows.select("text"))
    own = found.where(F.size("spans") > 0).select("row", F.explode(F.array_distinct(F.transform("spans", lambda s: F.struct(s["kind"], s["value"])))).alias("entity"))
    told = own.join(few(telling), "entity").groupBy("row", "term").agg(F.bool_or("removed").alias("removed")).groupBy("row").agg(F.collect_list(F.struct("term", "removed")).alias("told"))  # terms of one document
    added = F.when(F.col("told").isNotNull(), term_spans(F.col("text"), F.col("spans"), F.col("told")))
    out = found.join(few(written(told)), "row", "left").withColumn("added", F.coalesce(added, F.array().cast("array<struct<start:int,stop:int,label:string,kind:string>>")))
    return out.select("doc_id", F.col("spans").alias("base"), "added", sanitised(F.col("text"), F.concat(F.transform("spans", labelled), "added")).alias("sanitised_text"))


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base, added = spelled(F.col("base")), spelled(F.col("added"))
    return found.select("doc_id", *map(number, KINDS), F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.when(base != "", base), F.when(added != "", added)).alias("spans"))
