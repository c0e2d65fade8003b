"""Line dedup with a log-template tree, in DataFrame operations only.

The tree has a fixed depth: a line's token count, then its first LEADING
tokens, variable ones (with a digit) as ``<*>``. In a leaf the remaining tokens
are generalised by vote: a position is constant if most of the leaf's distinct
lines have the same token there. Where at least three in four positions are
constant, lines that agree with all of them share the leaf's template; other
lines are templates of their own.

A template is boilerplate if it recurs in at least ``min_docs`` unrelated
documents. Boilerplate is dropped everywhere but in the first document
(smallest id) that has it. Documents that equal each other up to variable
fields count once. So does a group of edited copies: a document is a copy if at
least three quarters of its words lie in lines that recur; its group is named
by its rarest recurring line, after the name that most copies with that line
have. Copies thus keep their text for near-duplicate detection, and lose only
lines that unrelated documents have too.

Defined cases: null text has no lines and stays null; blank lines, and lines of
fewer than MIN_TOKENS tokens, are never dropped; a null id ranks last; rows
that share an id and a text are one document; an empty table gives no rows.
Line breaks are line feeds; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import Workspace

LEADING, MIN_TOKENS, MIN_DOCS = 4, 3, 3
LAST = 2**63 - 1
_BLANK = r"\x20\x09-\x0D"


def templates_of(text: Column) -> Column:
    """Every line with variable fields as ``<*>`` and single spaces; empty if blank."""
    lines = F.split(text, "\n", -1)
    odd = F.lit(False)
    for blank in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | text.contains(blank)
    even = F.when(odd, F.transform(lines, lambda x: F.btrim(F.regexp_replace(x, rf"[{_BLANK}]+", " ")))).otherwise(F.transform(lines, lambda x: F.btrim(x)))
    # at a token's start, looking ahead for a digit: linear in the line
    return F.transform(even, lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"(?<![^ ])(?=[^ ]*[0-9])[^ ]+", "<*>")).otherwise(x))


def _count(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _words(text: Column) -> Column:
    """Words of a text: places where one begins."""
    return F.regexp_count(text, F.lit(rf"[^{_BLANK}]+"))


def _leaf(line: Column) -> Column:
    return F.xxhash64(_count(line), F.substring_index(line, " ", LEADING))


def _named(text: Column) -> Column:
    """A template's name: eight bytes of MD5, so that ties go as any engine breaks them."""
    return F.unhex(F.substring(F.md5(text), 1, 16))


def _general(lines: DataFrame, work: Workspace) -> DataFrame:
    """(t, general): templates that take their leaf's template."""
    wide = lines.select("leaf", "t").distinct().groupBy("leaf").agg(F.count("*").alias("of")).where("of > 1")
    rows = lines.join(wide, "leaf").groupBy("leaf", "of", "t").agg(F.min("line").alias("line"))
    # written as tokens, so that no later expression splits a line again
    rows = work.keep(rows.select("leaf", "of", "t", F.split("line", " ").alias("tokens")), "leaves")
    tokens = rows.select("leaf", "of", F.posexplode("tokens").alias("at", "token"))
    votes = tokens.groupBy("leaf", "of", "at", "token").agg(F.count("*").alias("n")).where("2 * n > of")
    kept = votes.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("constant"))
    found = rows.join(kept, "leaf")
    fits = (4 * F.size("constant") >= 3 * F.size("tokens")) & F.forall("constant", lambda c: F.get("tokens", c["at"]) == c["token"])
    leaf = F.concat(F.lit("G"), F.size("tokens").cast("string"), F.lit(" "), F.array_join(F.slice("tokens", 1, LEADING), " "))
    return found.where(fits).select("t", _named(leaf).alias("general"))


def _unrelated(named: DataFrame, counted: DataFrame, work: Workspace, min_docs: int) -> DataFrame:
    """(t, first): templates of at least min_docs unrelated documents."""
    often = counted.where(F.col("n") >= min_docs)
    # rows that share an id and a text are one document
    hits = named.join(often.select("t", "n"), "t").dropDuplicates(["id", "h", "at"])
    hits = work.keep(hits.select("id", "h", "shape", "words", "t", "n", "size"), "hits")
    docs = hits.groupBy("id", "h").agg(F.max("words").alias("words"), F.sum("size").alias("inside"), F.min(F.struct("n", "t"))["t"].alias("rarest"))
    copies = work.keep(docs.where("4 * inside >= 3 * words").select("id", "h", "rarest"), "copies")
    names = copies.select(F.col("rarest").alias("t")).distinct()
    votes = hits.select("id", "h", "t").join(names, "t").join(copies, ["id", "h"]).groupBy("t", "rarest").agg(F.count("*").alias("n"))
    group = votes.groupBy("t").agg(F.max(F.struct("n", "rarest"))["rarest"].alias("group"))
    copies = copies.join(group.withColumnRenamed("t", "rarest"), "rarest").select("id", "h", "group")
    units = hits.join(copies, ["id", "h"], "left").select("t", F.col("group").isNotNull().alias("copy"), F.when(F.col("group").isNull(), F.col("shape")).otherwise(F.xxhash64("group")).alias("unit")).distinct()
    return units.groupBy("t").agg(F.count("*").alias("units")).where(F.col("units") >= min_docs).join(often, "t").select("t", "first")


def recurring(docs: DataFrame, work: Workspace, min_docs: int, min_tokens: int) -> DataFrame:
    """(id, h, at): the lines to drop of documents (id, h, text)."""
    split = docs.select("id", "h", templates_of(F.col("text")).alias("lines"), _words(F.col("text")).alias("words"))
    split = split.select("id", "h", "words", F.xxhash64("lines").alias("shape"), "lines")
    # outer: Spark would else filter on the lines before and template every text twice
    each = split.select("id", "h", "shape", "words", F.inline_outer(F.transform("lines", lambda x, i: F.struct(i.alias("at"), x.alias("line")))))
    each = each.withColumn("size", _count(F.col("line"))).where(F.col("size") >= min_tokens)
    facts = ["shape", "words", "size"]
    each = each.select("id", "h", "at", _named(F.concat(F.lit("L"), "line")).alias("t"), _leaf(F.col("line")).alias("leaf"), *facts, "line")
    each = work.keep(each, "lines")
    general = work.keep(_general(each.where(_count(F.col("line")) > LEADING), work), "general")
    named = each.join(general, "t", "left").select("id", "h", "at", *facts, F.coalesce("general", "t").alias("t"))
    named = work.keep(named, "named")
    counted = named.groupBy("t", "shape").agg(F.min("id").alias("first")).groupBy("t").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    often = _unrelated(named, work.keep(counted.where(F.col("n") >= min_docs), "counted"), work, min_docs)
    return named.join(often, "t").where("id <> first").select("id", "h", "at")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(doc, text, n_lines, n_dropped): the row as it was, its text without boilerplate."""
    work = Workspace(docs.sparkSession, "templates")
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    drop = recurring(whole.select("id", "h", "text"), work, min_docs, min_tokens)
    drop = work.keep(drop.groupBy("id", "h").agg(F.collect_set("at").alias("drop")), "drop")
    rows = whole.join(drop.hint("shuffle_hash"), ["id", "h"], "left")
    lines = F.split("text", "\n", -1)
    # positions less the dropped ones, by hash: linear in the lines; the array of one splits the text once
    kept = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "drop"), lambda i: F.get(x, i))
    left = F.get(F.transform(F.array(lines), lambda x: F.array_join(kept(x), "\n")), 0)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return rows.select("doc", F.when(F.col("drop").isNull(), F.col("text")).otherwise(left).alias("text"), n_lines.alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))
