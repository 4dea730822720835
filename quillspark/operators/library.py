"""Operators on libraries of entries: duplicates, cited and uncited entries, order, reuse,
validation, repair and keys. Every ordered input carries `pos`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import exact_unions
from ..functions.identifiers import abbreviate, author_key, clean_doi, normalize_url, title_for_bibtex, title_key


def duplicate_marks() -> dict[str, Column]:
    """What two entries share that are duplicates; null where an entry lacks it."""
    full = lambda c: F.nullif(c, F.lit(""))
    return {
        "doi": full(F.lower("doi")),
        "title": full(title_key(F.col("title"))),
        "who": F.when(full(author_key(F.col("author"))).isNotNull() & full(F.col("year")).isNotNull(), F.concat_ws("\u0001", author_key(F.col("author")), F.col("year"))),
    }


def marked_entries(entries: DataFrame) -> DataFrame:
    """(key, doi, title, who): the marks of each key's last entry. A title's mark is its digest, since
    titles may be whole texts."""
    marks = duplicate_marks() | {"title": F.sha2(duplicate_marks()["title"], 256)}
    rows = entries.select("key", "pos", *[v.alias(k) for k, v in marks.items()])
    one = Window.partitionBy("key").orderBy(F.desc("pos"))
    return rows.withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r", "pos")


def duplicate_pairs(entries: DataFrame) -> DataFrame:
    """(key1, key2) with key1 < key2 that share a DOI, a title, or author and year.

    An equi-join of marks instead of a join on OR, which would be a Cartesian product. A pair is given by
    the first of its marks alone, so no pair comes twice and none is looked for among the others: the
    pairs are neither dealt anew nor held. Their number is the result's own."""
    return marked_pairs(marked_entries(entries))


def marked_pairs(rows: DataFrame, *keep: str) -> DataFrame:
    """duplicate_pairs of marked entries, with the columns `keep` of the first entry."""
    marks = list(duplicate_marks())
    # A row a mark, with those before it in mind; equal rows on both sides share one exchange.
    one = lambda n: F.struct(F.lit(n).alias("kind"), F.col(marks[n]).alias("v"), *[(F.col(m) if i < n else F.lit(None).cast("string")).alias(f"_{m}") for i, m in enumerate(marks[:-1])])
    side = rows.select("key", *keep, F.explode(F.array(*[one(n) for n in range(len(marks))])).alias("m")).select("key", *keep, "m.*").where("v is not null")
    new = "".join(f" and coalesce(x._{m} <> y._{m}, true)" for m in marks[:-1])
    pairs = side.alias("x").join(side.alias("y"), F.expr(f"x.kind = y.kind and x.v = y.v and x.key < y.key{new}"))
    return pairs.select(F.col("x.key").alias("key1"), F.col("y.key").alias("key2"), *[F.col(f"x.{c}") for c in keep])


def shared_marks(rows: DataFrame) -> DataFrame:
    """key, sign and the marks of each of the seven sets of marks that a marked entry has whole, the
    others null. By inclusion and exclusion, sums with the sign over those who share a set count those
    who share any mark once."""
    marks = list(duplicate_marks())
    sets = [[m for i, m in enumerate(marks) if k >> i & 1] for k in range(1, 1 << len(marks))]
    kinds = dict(rows.dtypes)
    one = lambda s: F.struct(F.lit(1 if len(s) % 2 else -1).alias("sign"), F.lit("".join(s)).alias("set"), *[(F.col(m) if m in s else F.lit(None).cast(kinds[m])).alias(m) for m in marks])
    each = F.array(*[F.when(F.expr(" and ".join(f"{m} is not null" for m in s)), one(s)) for s in sets])
    return rows.select("key", F.explode(F.array_compact(each)).alias("s")).select("key", "s.*")


def duplicate_count(entries: DataFrame) -> DataFrame:
    """(n): the number of duplicate_pairs, from the sizes of the groups, without the pairs."""
    groups = shared_marks(marked_entries(entries)).groupBy("set", "sign", *duplicate_marks()).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.expr("sign * (n * (n - 1) div 2)")), F.lit(0)).alias("n"))


def dealt(rows: DataFrame) -> DataFrame:
    """A join's side that grows with the input: it is dealt by key, since a copy for each executor would
    pass through the driver, join after join."""
    return rows.hint("merge")


def cited_only(entries: DataFrame, cited: DataFrame) -> DataFrame:
    return entries.join(cited.select("key").distinct(), "key", "left_semi")


def missing_refs(cited: DataFrame, entries: DataFrame) -> DataFrame:
    return cited.select("key").distinct().join(entries.select("key"), "key", "left_anti")


def cite_order(entries: DataFrame, cited: DataFrame) -> DataFrame:
    """entries with cite_order: the last place at which cited(ord, key) has the key, null if none."""
    last = cited.groupBy("key").agg(F.max("ord").alias("cite_order"))
    return entries.drop("cite_order").join(last, "key", "left")


def in_cite_order(entries: DataFrame, none: int = 9999) -> DataFrame:
    """entries with `rank`, their place by cite_order (text or number), then pos; uncited ones, and
    those whose order is blank, as if `none`. Another order that is no integer is an error.

    The rank is global; see global_rank."""
    at = F.coalesce(F.nullif(F.trim(F.col("cite_order").cast("string")), F.lit("")).cast("int"), F.lit(none))
    return global_rank(entries.withColumn("_at", at), ["_at", "pos"], "rank").drop("_at")


#: Keys that are looked at for a range.
SAMPLED = 64


def cut_points(rows: DataFrame, keys: list[str], ranges: int) -> list:
    """Keys that cut rows into ranges of about equal size: from those with the smallest hashes, which
    are SAMPLED a range at most, whatever the number of rows."""
    found = rows.select(*keys).orderBy(F.xxhash64(*keys)).limit(SAMPLED * ranges).orderBy(*keys).collect()
    return found[len(found) // ranges :: len(found) // ranges][: ranges - 1] if len(found) >= ranges else []


def range_of(rows: DataFrame, keys: list[str], cuts: list) -> Column:
    """The number of cuts up to a row's keys, found among every few of them and then the few between."""
    kinds = dict(rows.dtypes)
    if not cuts:
        return F.lit(0)
    each = [F.struct(*[F.lit(x[k]).cast(kinds[k]).alias(k) for k in keys]) for x in cuts]
    step = max(1, int(len(each) ** 0.5))
    up_to = lambda part: F.size(F.filter(part, lambda x: x <= F.struct(*keys)))
    coarse = up_to(F.array(*each[step - 1 :: step]))
    return coarse * step + F.transform(F.array(coarse), lambda k: up_to(F.slice(F.array(*each), k * step + 1, F.lit(step))))[0]


def global_rank(rows: DataFrame, keys: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """rows with their place, from 1, by keys, which no two rows share and none lacks."""
    return total_before(rows, keys, F.lit(1), name, ranges).withColumn(name, F.col(name) + 1)


def total_before(rows: DataFrame, keys: list[str], amount: Column, name: str, ranges: int | None = None) -> DataFrame:
    """rows with the sum of amount, a whole number, over the rows before by keys, which no two rows
    share and none lacks.

    Rows are summed inside even ranges of the keys; a range's sum, one row each, gives the offset of
    those after it. Where the ranges end is read from the rows when the plan is made."""
    spark = rows.sparkSession
    ranges = ranges or max(16, min(256, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.withColumn("_range", range_of(rows, keys, cut_points(rows, keys, ranges))).withColumn("_amount", amount.cast("long"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_range").agg(F.sum("_amount").alias("_k")).withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    inner = F.coalesce(F.sum("_amount").over(Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_inner", inner).join(F.broadcast(sums), "_range").withColumn(name, F.col("_before") + F.col("_inner")).drop("_range", "_before", "_inner", "_amount")


def reuse(identifiers: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, key): for each id the first entry with its DOI, link or preprint number."""
    doi, url = F.lower(clean_doi(F.col("id"))), normalize_url(F.col("id"))
    ids = identifiers.select("id").distinct()
    low = lambda c: F.nullif(F.lower(clean_doi(F.col(c))), F.lit(""))
    ways = (
        (ids.select("id", doi.alias("v")), entries.select("pos", "key", low("doi").alias("v"))),
        (ids.where(F.col("id").rlike("^https?://")).select("id", url.alias("v")), entries.select("pos", "key", F.nullif(normalize_url(F.col("url")), F.lit("")).alias("v"))),
        (ids.select("id", doi.alias("v")), entries.select("pos", "key", F.nullif(F.lower("eprint"), F.lit("")).alias("v"))),
    )
    out = None
    for a, b in ways:
        got = a.join(dealt(b), "v").select("id", "pos", "key")
        out = got if out is None else out.union(got)
    return out.groupBy("id").agg(F.min_by("key", "pos").alias("key"))


def issues(author: Column, title: Column, journal: Column, year: Column, doi: Column, url: Column) -> Column:
    """What an entry lacks."""
    empty = lambda *cs: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs]).isNull()
    return F.array_compact(F.array(F.when(empty(author), F.lit("author")), F.when(empty(title), F.lit("title")), F.when(empty(journal, year), F.lit("journal or year")), F.when(empty(doi, url), F.lit("doi or url"))))


def backfill(fields: dict[str, Column], issue: Column, article_number: Column, page: Column) -> dict[str, Column]:
    """number, pages, title, journal and type of an entry, repaired from a metadata record."""
    full = lambda c: F.nullif(c, F.lit(""))
    return {
        "number": F.coalesce(full(fields["number"]), full(issue), F.lit("")),
        "pages": F.coalesce(full(fields["pages"]), full(article_number), full(page), F.lit("")),
        "title": title_for_bibtex(fields["title"]),
        "journal": abbreviate(fields["journal"]),
        "type": F.when(full(fields["eprint"]).isNotNull() & full(fields["journal"]).isNull(), "misc").otherwise("article"),
    }


def base_key(author: Column, year: Column, title: Column) -> Column:
    """First author's family name, year, and the start of the title, letters and digits only."""
    full = lambda c: F.nullif(c, F.lit(""))
    who = F.trim(F.split(F.split(F.coalesce(full(author), F.lit("Unknown")), " and ")[0], ",")[0])
    when_ = F.substring(F.coalesce(full(year), F.lit("2024")), 1, 4)
    words = F.filter(F.split(F.regexp_replace(F.coalesce(title, F.lit("")), r"""[{}'".,;:]""", ""), r"(?U)\s+"), lambda w: w != "")
    what = F.when(F.size(words) >= 2, F.concat(words[0], F.substring(F.get(words, F.lit(1)), 1, 3))).when(F.size(words) == 1, F.substring(F.get(words, F.lit(0)), 1, 7)).otherwise("Paper")
    return F.regexp_replace(F.concat(who, when_, what), "[^a-zA-Z0-9]", "")


SUFFIXES = "abcde"


def citation_keys(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """rows(pos, author, year, title), whose pos is unique, with base and citekey: the base, then base + a…e,
    then base + 1, 2, …, whichever first is neither in existing(key) nor given to a row before.

    The n-th row of a base takes its n-th free suffix: where the existing keys leave gaps is known
    beforehand, so ranks give all keys at once, however many rows share a base. Only bases of which one is
    another's suffixed form take keys from each other by turns; such groups are folded in order of pos."""
    exact_unions(rows.sparkSession)
    # Only places and bases are looked at again and again; the executors keep them, the rest is joined once.
    light = rows.select("pos", base_key(F.col("author"), F.col("year"), F.col("title")).alias("base")).persist()
    groups = meeting_bases(light.select("base").distinct())
    at = ranked_within(light.join(dealt(groups.select("base")), "base", "left_anti").select("base", "pos"), "base", "pos", "_n")
    given = None
    if existing is not None:
        given = existing.select("key").distinct().select("key", F.explode(F.array_append(parents(F.col("key")), F.col("key"))).alias("base"))
        at = free_places(at, given)
    alone = at.select("pos", "base", F.concat("base", suffix(F.col("_n"))).alias("citekey"))
    met = light.join(dealt(groups), "base")
    schema = "pos long, citekey string"

    def fold(here, there=None):
        used, at, out = set() if there is None else set(there["key"]), {}, []
        for base in here.sort_values("pos")["base"]:
            # What is taken stays taken, so a base's search goes on where it ended.
            k = at.get(base, 0)
            while (key := base + ("" if not k else SUFFIXES[k - 1] if k <= 5 else str(k - 5))) in used:
                k += 1
            at[base] = k + 1
            used.add(key)
            out.append(key)
        return here.sort_values("pos")[["pos"]].assign(citekey=out)

    asked = met.select("group", F.col("pos").cast("long").alias("pos"), "base").groupBy("group")
    if given is None:
        folded = asked.applyInPandas(lambda here: fold(here), schema)
    else:
        taken = given.join(dealt(groups), "base").select(F.col("group").alias("g"), "key").distinct()
        folded = asked.cogroup(taken.groupBy("g")).applyInPandas(lambda here, there: fold(here, there), schema)
    kind = rows.schema["pos"].dataType
    folded = met.select("pos", "base").join(dealt(folded.withColumn("pos", F.col("pos").cast(kind))), "pos")
    return rows.join(dealt(alone.unionByName(folded)), "pos")


def suffix(place: Column) -> Column:
    """The suffix at a place from 0: none, a letter, or a number."""
    return F.when(place == 0, "").when(place <= 5, F.substring(F.lit(SUFFIXES), place.cast("int"), F.lit(1))).otherwise((place - 5).cast("string"))


def ranked_within(rows: DataFrame, by: str, order: str, name: str, width: int = 16) -> DataFrame:
    """rows with their place from 0 by `order`, an integer, among those that agree on `by`. Places are
    counted inside ranges of the order and then over the ranges, so no task has all rows of one value."""
    rows = rows.withColumn("_range", F.shiftright(F.col(order).cast("long"), width))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(by, "_range").agg(F.count("*").alias("_k")).withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    inner = F.row_number().over(Window.partitionBy(by, "_range").orderBy(order)) - 1
    return rows.withColumn("_inner", inner).join(dealt(sums), [by, "_range"]).withColumn(name, F.col("_before") + F.col("_inner")).drop("_range", "_before", "_inner")


def free_places(at: DataFrame, given: DataFrame) -> DataFrame:
    """at(base, pos, _n) with _n, a row's place among its base's rows, made its place among those suffixes
    that given(base, key) leaves free.

    The j-th taken suffix at place t has t - j free ones before it. So taken suffixes and rows, in order
    of the free ones before them, stand as they stand in the sequence of all suffixes."""
    rest = F.substring("key", F.length("base") + 1, F.length("key"))
    number = F.when(rest.rlike("^[1-9][0-9]{0,17}$"), rest.try_cast("long") + 5)
    letter = F.when(rest.rlike(f"^[{SUFFIXES}]$"), F.instr(F.lit(SUFFIXES), rest).cast("long"))
    taken = given.join(dealt(at.select("base").distinct()), "base", "left_semi").select("base", F.when(rest == "", F.lit(0).cast("long")).otherwise(F.coalesce(letter, number)).alias("t")).where("t is not null").distinct()
    gaps = ranked_within(taken, "base", "t", "_j").select("base", F.lit(None).cast(at.schema["pos"].dataType).alias("pos"), ((F.col("t") - F.col("_j")) * 2).alias("v"))
    every = gaps.union(at.select("base", "pos", (F.col("_n") * 2 + 1).alias("v")))
    return ranked_within(every, "base", "v", "_n").where("pos is not null").select("base", "pos", "_n")


def parents(key: Column) -> Column:
    """The bases of which a key can be a suffixed form."""
    digits = F.length(F.regexp_extract(key, r"([0-9]*)$", 1))
    cut = lambda n: F.substring(key, F.lit(1), F.length(key) - n)
    numbered = F.when(digits > 0, F.transform(F.sequence(F.lit(1), F.greatest(digits, F.lit(1))), cut)).otherwise(F.array().cast("array<string>"))
    return F.concat(numbered, F.when(key.rlike(f"[{SUFFIXES}]$"), F.array(cut(F.lit(1)))).otherwise(F.array().cast("array<string>")))


def meeting_bases(bases: DataFrame) -> DataFrame:
    """(base, group) of the bases that suffixes can lead to from another base, and of those; a group is named
    by its shortest base. What suffixes add to a base are letters of theirs and digits, so a base's
    forebears are among its beginnings that only such stand behind."""
    tail = F.length(F.regexp_extract("base", f"([{SUFFIXES}0-9]*)$", 1))
    above = F.transform(F.sequence(F.lit(1), F.greatest(tail, F.lit(1))), lambda n: F.substring("base", F.lit(1), F.length("base") - n))
    up = bases.where(tail > 0).select("base", F.explode(above).alias("to")).join(dealt(bases.select(F.col("base").alias("to"))), "to")
    top = up.groupBy("base").agg(F.min_by("to", F.length("to")).alias("group"))
    return top.union(top.select(F.col("group").alias("base"), "group").distinct())


def set_field(entries: DataFrame, name: str, value: Column) -> DataFrame:
    kept = F.map_filter("fields", lambda k, _: k != name)
    return entries.withColumn("fields", F.when(value.isNull(), kept).otherwise(F.map_concat(kept, F.create_map(F.lit(name), value))))


def sync(entries: DataFrame, cited: DataFrame) -> DataFrame:
    """The library after a document's citations are read: orders set and removed, and ranked."""
    return in_cite_order(cite_order(entries, cited))


def upsert(entries: DataFrame, new: DataFrame) -> DataFrame:
    """entries and those of new whose DOI and key none of them has. Of new rows that share a DOI or a
    key with one another, the first by pos, or key, is added."""
    doi = F.nullif(F.lower(clean_doi(F.col("doi"))), F.lit(""))
    fresh = new.withColumn("_d", doi)
    fresh = fresh.join(entries.select(doi.alias("_d")).where("_d is not null").distinct(), "_d", "left_anti").join(entries.select("key").distinct(), "key", "left_anti")
    order = [c for c in ("pos", "key") if c in new.columns]
    first = lambda k: F.col(k).isNull() | (F.row_number().over(Window.partitionBy(k).orderBy(*order)) == 1)
    fresh = fresh.withColumn("_one", first("_d")).where("_one").withColumn("_one", first("key")).where("_one").drop("_one", "_d")
    return entries.unionByName(fresh, allowMissingColumns=True)


def duplicate_groups(entries: DataFrame) -> DataFrame:
    """key, kind (doi, title, who), representative and n: each entry's group of two or more by each
    way of being a duplicate. What duplicate_pairs says, in the size of the groups."""
    rows = entries.select("key", *[v.alias(k) for k, v in duplicate_marks().items()]).dropDuplicates(["key"])
    long = rows.select("key", F.explode(F.create_map(*[x for k in duplicate_marks() for x in (F.lit(k), F.col(k))])).alias("kind", "v")).where("v is not null")
    some = long.groupBy("kind", "v").agg(F.min("key").alias("representative"), F.count("*").alias("n")).where("n > 1")
    return long.join(some, ["kind", "v"]).select("key", "kind", "representative", "n")


def ordered_duplicates(entries: DataFrame) -> DataFrame:
    """duplicate_pairs with `place`, from 1 by (key1, key2), as a report lists them.

    How many pairs a key begins follows from its place in its groups, so the pairs before it are known
    without them; the pairs are made once and ordered within their first key."""
    rows = marked_entries(entries)
    after = Window.partitionBy("set", *duplicate_marks()).orderBy(F.desc("key"))
    begun = shared_marks(rows).select("key", (F.col("sign") * (F.row_number().over(after) - 1)).alias("n")).groupBy("key").agg(F.sum("n").alias("_n"))
    begun = total_before(begun.where("_n > 0"), ["key"], F.col("_n"), "_first").drop("_n")
    pairs = marked_pairs(rows.join(begun, "key", "left"), "_first")
    inner = F.row_number().over(Window.partitionBy("key1").orderBy("key2"))
    return pairs.select("key1", "key2", (F.col("_first") + inner).alias("place"))
