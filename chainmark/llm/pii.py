"""Personal data by weak supervision, in DataFrame operations only.

Candidates come from one pass of regular expressions: the strict pattern of
each kind and looser ones (mail addresses spelt out, in brackets or spaced, dots
of quads in brackets or spelt out, card digits with other separators, numbers
without a country code or with 00, digit runs and quads that fail their check). Labelers vote on
every candidate: its own check (regex), lists of domains, issuers and networks
(gazetteer), and the words before it and letters beside it (context); a
labeler may abstain. Candidates reduce to counts of vote patterns, at most
3 ** 3 a kind, on which expectation-maximisation estimates each labeler's
reliability and every pattern's probability. These probabilities train a naive
Bayes classifier over the votes and the candidate's shape, also from counts of
bounded size. A candidate it trusts is added; strict spans always stay.

Patterns are written so that a text is scanned in linear time: a match starts
where a run starts (or where the last match ended), and repeats are possessive.

Defined cases: null text counts as empty; rows that share an id and a text are
found once and each get the result; a null id is an id like any other. An empty
table gives no rows. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .work import Workspace

KINDS = ("email", "ip", "card", "phone")
TRUST = 0.9
ROUNDS = 50

_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: Strict patterns by kind, then looser ones: (kind, strict, what a text must hold, pattern).
PATTERNS: tuple[tuple[str, bool, str, str], ...] = (
    ("email", True, "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++"),
    ("ip", True, r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", True, r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", False, r"[\x20(\[][dD][oO][tT][\x20)\]]", rf"(?<!{_LOCAL}){_LOCAL}++\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?{_DOMAIN}++\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{{2,12}}(?![A-Za-z])"),
    # an address with one of its two signs spelt out or in brackets, or with blanks around the sign
    ("email", False, r"[(\[{]\x20?[aA][tT]\x20?[)\]}]", rf"(?<!{_LOCAL}){_LOCAL}++\x20?[(\[{{]\x20?[aA][tT]\x20?[)\]}}]\x20?{_DOMAIN}++(?:\.{_DOMAIN}++)++"),
    ("email", False, r"\x20@\x20", rf"(?<!{_LOCAL}){_LOCAL}++\x20@\x20{_DOMAIN}++(?:\.{_DOMAIN}++)++"),
    # quads with their dots in brackets or spelt out
    ("ip", False, r"[0-9]\x20?(?:[(\[]\.[)\]]|\x20dot\x20)\x20?[0-9]", r"(?<![0-9.])[0-9]++(?:\x20?(?:\[\.\]|\(\.\)|\x20dot\x20)\x20?[0-9]++){3}(?![0-9])"),
    # groups of card digits with other separators than one blank or dash
    ("card", False, r"[0-9]{4}(?:[./_*]|\x20-\x20|\x20\x20)[0-9]{4}", r"(?<![0-9])[0-9]{4}(?:(?:[./_*]|\x20-\x20|\x20\x20)[0-9]{4}){3}(?:[./_*]?[0-9]{1,3})?(?![0-9])"),
    # international numbers that begin with 00
    ("phone", False, r"00[\x20.-]?[1-9]", r"(?<![0-9A-Za-z_+.,-])00[\x20.-]?[1-9][0-9]{0,2}(?:[\x20.-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9])"),
    ("phone", False, r"[0-9]{3}[\x20.-][0-9]{4}", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)

# Common top-level domains, country calling codes, first digits of card issuers, words that announce a kind.
_DOMAINS = "com|org|net|edu|gov|mil|int|io|co|me|app|dev|ai|biz|info|name|eu|de|fr|es|it|nl|be|ch|at|se|no|dk|fi|pl|cz|pt|ie|uk|us|ca|mx|br|ar|cl|au|nz|jp|cn|kr|in|za|ru|ua|tr|gr|il"
_CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|60|61|62|63|64|65|66|81|82|84|86|90|91|92|94|98|212|213|234|254|351|352|353|354|358|359|370|371|372|380|385|386|420|421|852|886|966|971|972"
_ISSUERS = "4|5[1-5]|2[2-7]|3[0-9]|50|5[6-8]|6011|62|64|65|67"
_CUES = {"email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel)\b", "ip": r"(?i)\b(?:ip|host|server|address|addr|login)\b", "card": r"(?i)\b(?:card|visa|credit|karte|carte|tarjeta|payment)\b", "phone": r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|teléfono|tél)\b"}


def candidates(docs: DataFrame) -> DataFrame:
    """(id, h, kind, strict, start, end, value, before, after) of documents (id, h, text)."""

    def pieces(p: int, kind: str, strict: bool, needs: str, pattern: str) -> Column:
        text = F.col("text")
        has = text.contains(needs) if needs == "@" else text.rlike(needs)
        # one array of one struct, so that the text is matched and split once and not once a match
        once = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("between")))
        row = lambda between: lambda v, i: F.struct(F.lit(p).alias("p"), F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), i.alias("i"), F.length(F.get(between, i)).alias("gap"), v.alias("value"), F.right(F.get(between, i), F.lit(40)).alias("before"), F.left(F.get(between, i + 1), F.lit(1)).alias("after"))
        none = F.array().cast("array<struct<p:int,kind:string,strict:boolean,i:int,gap:int,value:string,before:string,after:string>>")
        return F.when(has, F.flatten(F.transform(once, lambda s: F.transform(s["values"], row(s["between"]))))).otherwise(none)

    every = F.concat(*[pieces(p, *x) for p, x in enumerate(PATTERNS)])
    rows = docs.where("text is not null").select("id", "h", F.explode(every).alias("c")).select("id", "h", "c.*")
    so_far = Window.partitionBy("id", "h", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(so_far)
    return rows.distinct().withColumn("end", end).withColumn("start", F.col("end") - F.length("value")).drop("p", "i", "gap")


def _digits() -> Column:
    return F.regexp_replace("value", "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def passes() -> Column:
    """Whether a candidate passes its kind's check."""
    n = F.length(_digits())
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    quad = F.regexp_replace("value", r"[^0-9]+", ".")
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", quad.rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(F.col("kind") == "card", F.when(n.between(13, 19), _luhn(_digits())).otherwise(False))
        .otherwise(n.between(9, 15))
    )


def votes() -> dict[str, Column]:
    """1 for, 0 against, null for abstaining."""
    kind, value, digits = F.col("kind"), F.lower("value"), _digits()
    # a loose address has nothing to check
    regex = F.when(F.col("strict") | (kind != "email"), F.col("sound").cast("int"))
    gazetteer = (
        F.when(kind == "email", value.rlike(rf"(?:\.|dot[)\]]?\x20?)(?:{_DOMAINS})$").cast("int"))
        .when(kind == "card", digits.rlike(rf"^(?:{_ISSUERS})").cast("int"))
        .when(kind == "ip", F.when(value.rlike(r"^(?:0|127|255)\."), 0))
        .otherwise(F.when(value.rlike(rf"^(?:\+|00[\x20.-]?)(?:{_CODES})(?![0-9]{{12}})"), 1).when(digits.rlike(r"^(?:000|123456|(.)\1+$)"), 0))
    )
    cue = F.lit(False)
    for k, words in _CUES.items():
        cue = F.when(kind == k, F.col("before").rlike(words)).otherwise(cue)
    beside = F.col("before").rlike("[A-Za-z0-9_]$") | F.col("after").rlike("^[A-Za-z0-9_]")
    context = F.when(beside, 0).when(cue, 1)
    return {"regex": regex, "gazetteer": gazetteer, "context": context}


def reliabilities(counts: list[Row]) -> dict[tuple, float]:
    """Probability of each (kind, votes) pattern, by expectation-maximisation over counts.

    ``counts`` has (kind, regex, gazetteer, context, n): at most 4 * 27 rows.
    """
    out: dict[tuple, float] = {}
    for kind in {r["kind"] for r in counts}:
        rows = [((r["regex"], r["gazetteer"], r["context"]), r["n"]) for r in counts if r["kind"] == kind]
        # right[c][j]: how often labeler j votes 1 on class c
        share, right = 0.5, [[0.2] * 3, [0.8] * 3]
        post: list[float] = []
        for _ in range(ROUNDS):
            post = []
            for v, _n in rows:
                odds = math.log(share / (1 - share))
                for j, x in enumerate(v):
                    if x is not None:
                        odds += math.log(right[1][j] / right[0][j]) if x else math.log((1 - right[1][j]) / (1 - right[0][j]))
                post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
            total = sum(n for _, n in rows)
            share = (sum(n * p for (_, n), p in zip(rows, post, strict=True)) + 1) / (total + 2)
            for c in (0, 1):
                for j in range(3):
                    seen = [(v[j], n * (p if c else 1 - p)) for (v, n), p in zip(rows, post, strict=True) if v[j] is not None]
                    # priors: a labeler is right four times in five, as ten candidates would say
                    right[c][j] = (sum(n for x, n in seen if x) + (8 if c else 2)) / (sum(n for _, n in seen) + 10)
        out |= {(kind, *v): p for (v, _), p in zip(rows, post, strict=True)}
    return out


def _classifier(counts: list[Row]) -> dict[tuple, float]:
    """Naive Bayes over votes and shape, trained on EM's probabilities; one value a pattern."""
    soft = reliabilities(counts)
    features = ("regex", "gazetteer", "context", "size", "spaced")
    mass: dict[tuple, float] = {}
    for r in counts:
        p = soft[r["kind"], r["regex"], r["gazetteer"], r["context"]]
        for c, w in ((1, p * r["n"]), (0, (1 - p) * r["n"])):
            mass[r["kind"], c] = mass.get((r["kind"], c), 1.0) + w
            for f in features:
                mass[r["kind"], c, f, r[f]] = mass.get((r["kind"], c, f, r[f]), 0.0) + w
    out = {}
    for r in counts:
        odds = math.log(mass[r["kind"], 1] / mass[r["kind"], 0])
        for f in features:
            if r[f] is not None:
                odds += math.log((mass[r["kind"], 1, f, r[f]] + 0.5) / (mass[r["kind"], 1] + 1)) - math.log((mass[r["kind"], 0, f, r[f]] + 0.5) / (mass[r["kind"], 0] + 1))
        out[tuple(r[f] for f in ("kind", *features))] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return out


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", trust: float = TRUST) -> DataFrame:
    """(doc_id, spans): spans are structs (kind, start, end, strict, p) sorted by kind and start."""
    spark = docs.sparkSession
    work = Workspace(spark, "pii")
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.lit(1), F.col(doc_id), text).alias("id"), F.xxhash64(F.lit(2), text, F.col(doc_id)).alias("h"), F.col(text).alias("text"))
    found = candidates(keyed.select("id", "h", "text")).withColumn("sound", passes()).withColumn("fine", F.col("strict") & F.col("sound"))
    shape = {"size": F.least(F.length("value") / 6, F.lit(4)).cast("int"), "spaced": F.col("value").contains(" ").cast("int")}
    found = work.keep(found.withColumns(votes() | shape).drop("before", "after"), "candidates")
    pattern = ["kind", "regex", "gazetteer", "context", "size", "spaced"]
    # at most 4 * 27 * 10 patterns, whatever the corpus
    counts = found.groupBy(*pattern).agg(F.count("*").alias("n"), F.count_if("fine").alias("fine")).collect()
    trusted = [key for key, p in _classifier(counts).items() if p >= trust]
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    table = spark.createDataFrame(trusted, ", ".join(f"t_{c} {kinds[c]}" for c in pattern))
    on = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in pattern]
    # a row a trusted pattern
    found = found.join(F.broadcast(table.withColumn("added", F.lit(True))), on, "left")
    added = F.coalesce("added", F.lit(False))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    chosen = found.where(F.col("fine") | added).select("id", "h", F.struct(rank.alias("rank"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "kind", F.col("fine").alias("strict")).alias("s"))
    spans = F.sort_array(F.collect_set("s"))
    grouped = chosen.groupBy("id", "h").agg(spans.alias("all")).withColumn("strict", F.filter("all", lambda s: s["strict"]))
    apart = lambda s: s["strict"] | ~F.exists("strict", lambda b: (b["rank"] == s["rank"]) & (b["start"] < s["end"]) & (s["start"] < b["end"]))
    grouped = grouped.select("id", "h", F.filter("all", apart).alias("all"))
    # of added spans that overlap the first stays, of those that begin together the longest
    hides = lambda b, x: (b["rank"] == x["rank"]) & (b["start"] < x["end"]) & (x["start"] < b["end"]) & ((b["start"] < x["start"]) | ((b["start"] == x["start"]) & (b["end"] > x["end"])))
    grouped = grouped.select("id", "h", F.filter("all", lambda x: x["strict"] | ~F.exists("all", lambda b: hides(b, x))).alias("spans"))
    none = F.array().cast(grouped.schema["spans"].dataType)
    return keyed.select("doc_id", "id", "h").join(grouped, ["id", "h"], "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def same(kind: str):
    """Keeps a kind in an array of kinds and nulls the others."""
    return lambda k: F.when(k == kind, k)
