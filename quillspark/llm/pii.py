"""Personal data: patterns, then information-theoretic sanitisation of what stands around them.

A protected entity is the value that a pattern finds. A term discloses an entity as far as it lowers
the entity's information content: PMI(term; entity) / IC(entity), from the numbers of documents of
the corpus that hold the entity, the term, and the term within CONTEXT characters of the entity. A
term at or over DISCLOSED becomes a span wherever it stands so near that entity; `sanitised`
generalises it to a placeholder, and removes it at or over REMOVED. A pair that fewer than LEAST_DOCS
documents show is no estimate and is left alone. A document without an entity has no spans.

All of it is DataFrame functions: matches come from one pattern used to extract and to split, so that
places are sums of lengths. Patterns are the contract's with runs taken whole, which finds the same
matches without trying a run again from each of its characters.

Results for odd rows: null and empty texts have no spans; texts of any length are scanned whole;
repeated rows count as often as they stand there and get the same spans; entities that tie in
disclosure are all counted; an empty table gives no rows; null and equal ids are kept as they are;
other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let

CONTEXT, LEAST_DOCS, DISCLOSED, REMOVED = 60, 3, 0.8, 0.95
#: Matches whose places are summed in one go.
STRETCH = 512

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
#: (pattern, what a text must have for it to be tried).
PATTERNS = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "[0-9][\\x20-]?[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: A term: letters between white space, with brackets and quotes before and marks after them.
TERM = r"""^(["'(\[]*)(\p{L}{3,40})[.,;:!?)\]"']*$"""
BLANK = r"[\x20\x09-\x0D]"
SPAN = "array<struct<start:bigint,end:bigint,kind:int,value:string>>"
NEAR = "array<struct<kind:int,value:string,term:string,start:bigint,end:bigint>>"


def lowered(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits' check sum holds."""
    n = F.length(number)
    digit = lambda i: F.substring(number, n - i, F.lit(1)).cast("int")
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    sums = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 2 == 1, double(digit(i))).otherwise(digit(i)))
    return F.aggregate(sums, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        return let(digits(match), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    return F.length(digits(match)).between(10, 15) if kind == "phone" else F.lit(True)


def value(kind: str, match: Column) -> Column:
    return lowered(match) if kind == "email" else digits(match) if kind in ("card", "phone") else match


def places(gaps: Column, found: Column) -> Column:
    """Where each match starts: sums of the lengths before it, by stretches, so that no long array is
    copied once a match."""
    zero = F.lit(0).cast("long")
    empty = F.array().cast("array<bigint>")

    def of(sizes: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / STRETCH).cast("int"))
        part = lambda b: F.slice(sizes, b * STRETCH + 1, F.lit(STRETCH))
        total = lambda b: F.aggregate(part(b), zero, lambda a, x: a + x["gap"] + x["size"])
        none = lambda start: F.struct(empty.alias("out"), start.alias("at"))
        before = lambda sums: F.aggregate(sums, none(zero), lambda a, x: F.struct(F.array_append(a["out"], a["at"]).alias("out"), (a["at"] + x).alias("at")))["out"]
        inner = lambda bases: F.flatten(F.transform(at, lambda b: F.aggregate(part(b), none(bases[b]), lambda a, x: F.struct(F.array_append(a["out"], a["at"] + x["gap"]).alias("out"), (a["at"] + x["gap"] + x["size"]).alias("at")))["out"]))
        return let(let(F.transform(at, total), before), inner)

    sizes = F.transform(found, lambda m, i: F.struct(F.length(gaps[i]).cast("long").alias("gap"), F.length(m).cast("long").alias("size")))
    return F.when(F.size(found) == 0, empty).otherwise(let(sizes, of))


def terms_of(side: Column, at: Column, cut_first: Column, cut_last: Column) -> Column:
    """term, start, end of the terms in `side`, a text that begins at `at`; its first or last token is
    left out where the text was cut there."""
    none = F.struct(F.array().cast("array<struct<token:string,at:bigint>>").alias("out"), at.alias("at"))
    tokens = lambda parts: F.aggregate(parts, none, lambda a, x: F.struct(F.array_append(a["out"], F.struct(x.alias("token"), a["at"].alias("at"))).alias("out"), (a["at"] + F.length(x) + 1).alias("at")))["out"]
    whole = lambda t: F.filter(t, lambda x, i: ~(cut_first & (i == 0)) & ~(cut_last & (i == F.size(t) - 1)) & x["token"].rlike(TERM))

    def term(x: Column) -> Column:
        core = F.regexp_extract(x["token"], TERM, 2)
        start = x["at"] + F.length(F.regexp_extract(x["token"], TERM, 1))
        return F.struct(lowered(core).alias("term"), start.alias("start"), (start + F.length(core)).alias("end"))

    return F.transform(let(let(F.split(side, BLANK), tokens), whole), term)


def scanned(text: Column, kind: str) -> Column:
    """spans and near of a text: its valid matches of a kind, and the terms around each."""
    pattern, needs = PATTERNS[kind]
    k = F.lit(KINDS.index(kind))

    def near(gaps: Column, start: Column, end: Column, i: Column, m: Column) -> Column:
        left, right = gaps[i], gaps[i + 1]
        size = lambda g: F.length(g).cast("long")
        cut = F.least(size(left), F.lit(CONTEXT + 1).cast("long"))
        both = F.concat(
            terms_of(F.right(left, F.lit(CONTEXT + 1)), start - cut, size(left) > CONTEXT, F.lit(False)),
            terms_of(F.left(right, F.lit(CONTEXT + 1)), end, F.lit(False), size(right) > CONTEXT),
        )
        return F.transform(both, lambda t: F.struct(k.alias("kind"), value(kind, m).alias("value"), t["term"].alias("term"), t["start"].alias("start"), t["end"].alias("end")))

    def of(x: Column) -> Column:
        found, gaps = x["found"], x["gaps"]
        rows = let(places(gaps, found), lambda at: F.transform(found, lambda m, i: F.struct(m.alias("m"), i.alias("i"), at[i].alias("start"), (at[i] + F.length(m)).alias("end"))))
        good = F.filter(rows, lambda r: valid(kind, r["m"]))
        spans = lambda g: F.transform(g, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), k.alias("kind"), value(kind, r["m"]).alias("value")))
        around = lambda g: F.flatten(F.transform(g, lambda r: near(gaps, r["start"], r["end"], r["i"], r["m"])))
        return let(good, lambda g: F.struct(spans(g).cast(SPAN).alias("spans"), around(g).cast(NEAR).alias("near")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    nothing = F.struct(F.array().cast(SPAN).alias("spans"), F.array().cast(NEAR).alias("near"))
    return F.when(F.contains(text, F.lit(needs)) if needs == "@" else text.rlike(needs), let(both, of)).otherwise(nothing)


def matches(docs: DataFrame, *keep: str) -> DataFrame:
    """A row a row of docs(doc_id, text): spans by place and kind, the terms near each, and a key that
    equal texts share."""
    rows = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.select("*", *[scanned(F.col("_text"), k).alias(f"_{k}") for k in KINDS])
    joined = lambda part: F.concat(*[F.col(f"_{k}.{part}") for k in KINDS])
    rows = rows.select("doc_id", *keep, "_text", F.array_sort(joined("spans")).alias("spans"), F.array_distinct(joined("near")).alias("near"))
    key = F.when(F.size("spans") > 0, F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))
    return rows.select("doc_id", *keep, "spans", "near", key.alias("key"))


def disclosures(docs: DataFrame, found: DataFrame, least: int = LEAST_DOCS, disclosed: float = DISCLOSED) -> DataFrame:
    """kind, value, term and ratio: how far each term reveals an entity, of the pairs that do so."""
    entity = ["kind", "value"]
    each = found.select(F.explode(F.array_distinct(F.transform("near", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), x["term"].alias("term"))))).alias("x")).select("x.*")
    pairs = each.groupBy(*entity, "term").agg(F.count("*").alias("together")).where(F.col("together") >= least)
    holds = found.select(F.explode(F.array_distinct(F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"))))).alias("x")).select("x.*")
    holds = holds.groupBy(*entity).agg(F.count("*").alias("n_value")).where(F.col("n_value") >= least)
    tokens = docs.select(F.explode(F.array_distinct(F.transform(F.array_distinct(F.split("text", BLANK)), lambda t: lowered(F.regexp_extract(t, TERM, 2))))).alias("term"))
    terms = tokens.where("term <> ''").groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") >= least)
    total = F.broadcast(docs.agg(F.count("*").alias("n")))
    rows = pairs.join(holds, entity).join(terms, "term").join(total).where("n > n_value")
    pmi = F.log(F.col("together").cast("double") * F.col("n") / F.col("n_term") / F.col("n_value"))
    return rows.select(*entity, "term", (pmi / F.log(F.col("n").cast("double") / F.col("n_value"))).alias("ratio")).where(F.col("ratio") >= disclosed)


def pii(docs: DataFrame, least: int = LEAST_DOCS, disclosed: float = DISCLOSED) -> DataFrame:
    """doc_id, spans and terms of each row of docs(doc_id, text): what the patterns find, as start, end
    (exclusive, in code points), kind and value, and the terms around it that disclose it."""
    scratch = Scratch(docs.sparkSession, "pii")
    return with_terms(scratch, docs, matches(docs), least, disclosed)


def with_terms(scratch: Scratch, docs: DataFrame, found: DataFrame, least: int, disclosed: float) -> DataFrame:
    found = scratch.put(found, "found")
    some = found.where("size(spans) > 0")
    known = scratch.put(disclosures(docs, some, least, disclosed), "disclosed")
    # Equal texts have equal spans, so a group of copies is looked up once.
    asked = some.select("key", F.explode("near").alias("x")).select("key", "x.*").distinct()
    met = asked.join(known, ["kind", "value", "term"]).groupBy("key", "start", "end").agg(F.max("ratio").alias("ratio"))
    lists = met.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "ratio"))).alias("terms"))
    kind = "array<struct<start:bigint,end:bigint,ratio:double>>"
    out = some.drop("near").join(lists, "key", "left").withColumn("terms", F.coalesce("terms", F.array().cast(kind)))
    rest = found.where("size(spans) = 0").drop("near").withColumn("terms", F.array().cast(kind))
    return out.unionByName(rest).drop("key")


def digest(docs: DataFrame) -> DataFrame:
    """What `pii` finds, counted by kind, and its spans as text."""
    name = lambda k: F.array(*map(F.lit, (*KINDS, "term")))[k]
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    bare = lambda c, kind: F.transform(c, lambda x: F.struct(x["start"].alias("start"), kind(x).alias("kind"), x["end"].alias("end")))
    base = bare("spans", lambda x: x["kind"])
    every = F.array_sort(F.concat(base, bare("terms", lambda _: F.lit(len(KINDS)))))
    return pii(docs).select("doc_id", *map(count, KINDS), F.sha2(line(F.array_sort(base)).cast("binary"), 256).alias("base_sha256"), line(every).alias("spans"))


def sanitised(docs: DataFrame, removed: float = REMOVED) -> DataFrame:
    """docs with its text made safe: an entity becomes its kind in brackets, a disclosing term [term], or
    nothing where its ratio is at or over `removed`. Of spans that overlap the first, then longest counts."""
    scratch = Scratch(docs.sparkSession, "sanitised")
    other = [c for c in docs.columns if c not in ("doc_id",)]
    rows = with_terms(scratch, docs, matches(docs.withColumn("_row", F.struct(*other)), "_row"), LEAST_DOCS, DISCLOSED)
    name = lambda k: F.array(*[F.lit(f"[{x}]") for x in KINDS])[k]
    part = lambda x, new: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), new.alias("new"))
    every = F.array_sort(F.concat(F.transform("spans", lambda x: part(x, name(x["kind"]))), F.transform("terms", lambda x: part(x, F.when(x["ratio"] >= removed, "").otherwise("[term]")))))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at"))

    def build(chars: Column) -> Column:
        cut = lambda a, b: F.array_join(F.slice(chars, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), "")
        add = lambda a, x: F.when(x["start"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], F.array(cut(a["at"], x["start"]), x["new"])).alias("out"), (-x["end"]).alias("at")))
        made = lambda a: F.concat(F.array_join(a["out"], ""), cut(a["at"], F.size(chars).cast("long")))
        return let(F.aggregate(every, start, add), made)

    safe = F.when(F.size("spans") == 0, F.col("_row.text")).otherwise(let(F.split(F.coalesce(F.col("_row.text"), F.lit("")), ""), build))
    return rows.select("doc_id", *[safe.alias("text") if c == "text" else F.col(f"_row.{c}") for c in other])
