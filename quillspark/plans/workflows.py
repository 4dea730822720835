"""The toolkit's commands as lazy plans over tables: suggestions, finalised entries, extraction,
synchronised references, reports, and the findings of library management. What a command fetches
stands in a table of payloads that something else has filled; what it asks of a person is a row whose
status says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import text as T
from ..operators import library as L
from ..operators import matching as M
from ..sources import bibtex as B
from . import audit

#: Fields of an entry, beside pos, key and type.
FIELDS = B.ORDER


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


# Entries as candidates, and their DOIs

def candidates(entries: DataFrame) -> DataFrame:
    """Entries (pos, key, type, fields) as candidates of the local library."""
    f = lambda n: text(F.element_at("fields", n))
    return entries.select("pos", F.col("key").alias("cite_key"), f("doi").alias("doi"), T.strip_latex(f("title")).alias("title"), f("author").alias("authors"), f("year").alias("year"), F.coalesce(F.nullif(f("journal"), F.lit("")), f("booktitle")).alias("journal"), f("abstract").alias("abstract"), text(F.col("type")).alias("type"), F.lit("local-bib").alias("source"))


def bare_doi(doi: Column) -> Column:
    """A doi field's value without the link or the prefix it is written with."""
    d = F.trim(doi)
    linked = F.coalesce(F.nullif(F.regexp_extract(d, r"doi\.org/(10\.[^/\s]+/\S+)", 1), F.lit("")), d)
    return F.nullif(F.when(d.startswith("http"), linked).when(d.startswith("doi:"), F.trim(F.substring(d, F.lit(5), F.length(d)))).otherwise(d), F.lit(""))


def doi_for_keys(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, doi) of each of keys(key): from its first entry(pos, key, doi), null where that has none."""
    first = entries.groupBy("key").agg(F.min_by("doi", "pos").alias("doi"))
    return keys.select("key").distinct().join(first, "key", "left").select("key", bare_doi(F.col("doi")).alias("doi"))


# Gates

def without_arxiv(found: DataFrame) -> DataFrame:
    """Rows of found(source, doi, journal) that are no preprints: CrossRef's by DOI alone, those of other
    registries by journal too."""
    named = lambda c: F.contains(F.lower(text(F.col(c))), F.lit("arxiv"))
    return found.where(~named("doi") & ((F.col("source") == "CrossRef") | ~named("journal")))


def fetched(found: DataFrame, most: int) -> DataFrame:
    """Of each sentence and registry the first rows that a search for `most` suggestions asks for."""
    at = F.row_number().over(Window.partitionBy("sent_id", "tier").orderBy("pos"))
    return found.withColumn("_at", at).where(F.col("_at") <= max(2 * most, 6)).drop("_at")


# Entries from metadata

def entry_fields(meta: DataFrame) -> DataFrame:
    """meta(author, title, journal, volume, number, pages, year, doi, url, eprint, archiveprefix,
    abstract, issue, article_number, page) with its fields repaired and a type; missing columns are
    empty."""
    have = set(meta.columns)
    of = {n: text(F.col(n).cast("string")) if n in have else F.lit("") for n in (*FIELDS, "issue", "article_number", "page")}
    fixed = L.backfill({n: of[n] for n in FIELDS}, of["issue"], of["article_number"], of["page"])
    return meta.select(*[c for c in meta.columns if c not in (*FIELDS, "type", "issue", "article_number", "page")], *[(fixed[n] if n in fixed else of[n]).alias(n) for n in FIELDS], fixed["type"].alias("type"))


def bibtex(kind: str = "type", key: str = "key") -> Column:
    return B.build(F.col(kind), F.col(key), {n: F.col(n) for n in FIELDS})


def inline() -> Column:
    return I.inline_citation({n: F.col(n) for n in ("journal", "volume", "pages", "year", "eprint")})


# Commands

def extract(identifiers: DataFrame, library: DataFrame, payloads: DataFrame) -> DataFrame:
    """A row an identifier of identifiers(pos, id): its status, and the key of its entry.

    existing: an entry of library(pos, key, doi, url, eprint) has it. added: payloads(source, id and an
    entry's fields) has what the identifier leads to, which gets a key that the library and earlier
    rows lack. failed: neither. Of identifiers that lead to one payload each gets its row, and the
    first the new key."""
    have = L.reuse(identifiers, library)
    rows = identifiers.join(L.dealt(have), "id", "left").withColumn("route", I.route(F.col("id")))
    rows = rows.select("pos", "id", F.col("key").alias("have"), F.col("route.source").alias("source"), F.col("route.id").alias("ref"), F.lower("route.id").alias("_ref"))
    meta = one_payload(payloads).withColumnRenamed("id", "_ref")
    found = rows.where("have is null").drop("ref").join(L.dealt(meta), ["source", "_ref"])
    first = found.groupBy("source", "_ref").agg(F.min("pos").alias("pos")).select("pos")
    new = L.citation_keys(entry_fields(found.join(L.dealt(first), "pos", "left_semi").drop("have")), library).select("source", "_ref", "citekey")
    out = rows.join(L.dealt(new), ["source", "_ref"], "left")
    status = F.when(F.col("have").isNotNull(), "existing").when(F.col("citekey").isNotNull(), "added").otherwise("failed")
    return out.select("pos", "id", "source", "ref", status.alias("status"), F.coalesce("have", "citekey").alias("key"))


def one_payload(payloads: DataFrame) -> DataFrame:
    """One payload a source and id, in lower case, since registries' ids are the same in any; of several
    always the same one."""
    rest = [c for c in payloads.columns if c not in ("source", "id")]
    return payloads.groupBy("source", F.lower("id").alias("id")).agg(F.min(F.struct(*rest)).alias("_p")).select("source", "id", "_p.*")


def batch_counts(extracted: DataFrame) -> DataFrame:
    """(successful, failed) of an extraction."""
    return extracted.agg(F.count_if(F.col("status") != "failed").alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"))


def with_extracted(extracted: DataFrame, library: DataFrame, payloads: DataFrame) -> DataFrame:
    """The library after an extraction: its entries, then the added ones in order of pos, each once."""
    fresh = extracted.where("status = 'added'").groupBy("source", F.lower("ref").alias("_ref"), "key").agg(F.min("pos").alias("at"))
    fresh = entry_fields(fresh.join(L.dealt(one_payload(payloads).withColumnRenamed("id", "_ref")), ["source", "_ref"]))
    last = F.broadcast(library.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("_last")))
    fresh = fresh.join(last).withColumn("pos", F.col("_last") + 1 + F.col("at")).drop("_last", "at", "source", "_ref")
    return library.unionByName(fresh, allowMissingColumns=True)


def finalised(dois: DataFrame, library: DataFrame, payloads: DataFrame) -> DataFrame:
    """(doi, key, status) of dois(doi): an entry that the library has, or one that is added."""
    one = dois.select("doi").where("doi <> ''").distinct()
    at = F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("doi"), F.lit(1024))).orderBy("doi"))
    ids = one.select((at * 1024 + F.pmod(F.xxhash64("doi"), F.lit(1024))).alias("pos"), F.col("doi").alias("id"))
    return extract(ids, library, payloads).select(F.col("id").alias("doi"), "key", "status")


def suggest(sentences: DataFrame, local: DataFrame, found: DataFrame | None = None, most: int = 3, allow_arxiv: bool = False, finals: DataFrame | None = None, works: DataFrame | None = None) -> DataFrame:
    """Suggestions for sentences(sent_id, sentence): sent_id, source, pos, cite_key, doi, title, authors,
    year, score and rank, the best evidence, a note and the inline citation of each reference.

    local: candidates of the library. A sentence that none of them answers gets, from found(sent_id,
    tier, source, pos, cite_key, doi, title, authors, year, abstract, journal), the rows of the first
    registry that has any once preprints are out; pos is their order for that sentence. finals: `finalised`
    of the found DOIs, if suggestions must be entries; then those with another DOI, and found ones without
    any, are dropped. works(doi, journal, volume, pages, year, eprint): what DOIs are cited by; an entry of
    the library without a DOI is cited by its own fields, and what neither has by nothing."""
    columns = ["pos", "cite_key", "doi", "title", "authors", "year", "abstract", "journal", "source", *CITED]
    local = local.select("*", *[F.lit("").alias(c) for c in CITED if c not in local.columns])
    asks = M.asked(M.prepared_sentences(sentences))
    own = M.rank_asked(asks, local, most).select("sent_id", "pos", "score", "rank").join(local.select(*columns), "pos")
    out, texts = own.select("sent_id", "score", "rank", *columns), local.select("title", "abstract")
    if found is not None:
        rest = asks.join(own.select("sent_id").distinct(), "sent_id", "left_anti")
        # One dealing by sentence serves the registries' first rows and the first registry.
        far = fetched(found.where("sent_id is not null").repartition("sent_id"), most)
        far = far if allow_arxiv else without_arxiv(far)
        far = far.withColumn("_low", F.min("tier").over(Window.partitionBy("sent_id"))).where("tier = _low").drop("_low", "tier", *CITED)
        ranks = M.rank_given_asked(rest, far, most).select("sent_id", "score", "rank", "row")
        out = out.unionByName(ranks.select("sent_id", "score", "rank", *[f"row.{c}" if c not in CITED else F.lit("").alias(c) for c in columns]))
        texts = texts.union(found.select("title", "abstract"))
    if finals is not None:
        known = finals.where("status <> 'failed'").select("doi", F.col("key").alias("entry"))
        out = out.join(known, "doi", "left").where("entry is not null or (doi = '' and source = 'local-bib')")
        out = out.withColumn("cite_key", F.coalesce("entry", "cite_key")).drop("entry")
    out = with_inline(out, works)
    # Evidence is in a reference's own words, so equal texts are read once, whatever they answer.
    own_text = M.digest(F.to_json(F.struct("title", "abstract")))
    out = out.withColumn("_text", own_text).drop("abstract", *CITED)
    one = texts.distinct().select(own_text.alias("pos"), "title", "abstract")
    return out.join(M.best_evidence(one).withColumnRenamed("pos", "_text"), "_text", "left").drop("_text")


#: What an inline citation has beside journal and year.
CITED = ("volume", "pages", "eprint")


def with_inline(rows: DataFrame, works: DataFrame | None) -> DataFrame:
    """rows(doi, source, journal, year, …) with inline_citation; DOIs are the same in any case."""
    own = F.when((text(F.col("doi")) == "") & (F.col("source") == "local-bib"), inline())
    if works is None:
        return rows.withColumn("inline_citation", text(own))
    one = works.where("doi <> ''").groupBy(F.lower("doi").alias("_doi")).agg(F.min(F.struct("journal", "volume", "pages", "year", "eprint")).alias("w"))
    one = one.select("_doi", I.inline_citation({n: F.col(f"w.{n}") for n in ("journal", "volume", "pages", "year", "eprint")}).alias("_inline"))
    return rows.join(one, F.lower("doi") == F.col("_doi"), "left").withColumn("inline_citation", text(F.coalesce("_inline", own))).drop("_doi", "_inline")


def audited(docs: DataFrame, by: str, local: DataFrame, found: DataFrame | None = None, most: int = 3, audit_cited: bool = False, **options) -> DataFrame:
    """The audit of docs(by, text) with suggestions for each sentence that needs a citation and has search
    terms: audit.analyses with `suggestions`, best first. found is keyed by (by, idx); options are suggest's."""
    rows = audit.analyses(docs, audit_cited)
    # Only sentences that need a citation have search terms.
    need = rows.where("size(search_terms) > 0").select(F.struct(by, "idx").alias("sent_id"), "sentence")
    far = None if found is None else found.withColumn("sent_id", F.struct(by, "idx")).drop(by, "idx")
    return with_suggestions(rows, by, suggest(need, local, far, most, **options).select("sent_id.*", *[c for c in SUGGESTED], "rank"))


def sync_references(bbl: DataFrame, library: DataFrame, original: DataFrame, payloads: DataFrame) -> DataFrame:
    """The library after a document is compiled: entries with cite_order, rank and added.

    bbl(file, text) holds what the document cites. Cited keys that library(pos, key, doi, …) lacks take
    their DOI from original(pos, key, doi) and their entry, under the cited key, from payloads; those
    without a DOI or a payload stay missing."""
    cited = bbl.select("file", F.posexplode(B.bbl_keys(F.col("text"))).alias("at", "key"))
    before = Window.partitionBy("file").orderBy("at")
    return sync_cited(cited.select("key", F.row_number().over(before).alias("ord")), library, original, payloads)


def sync_cited(cited: DataFrame, library: DataFrame, original: DataFrame, payloads: DataFrame) -> DataFrame:
    """sync_references for cited(key, ord)."""
    lost = doi_for_keys(L.missing_refs(cited, library), original).where("doi is not null")
    meta = one_payload(payloads.where("source = 'crossref'")).drop("source")
    new = entry_fields(lost.join(meta.drop("doi"), F.lower("doi") == F.col("id")).drop("id"))
    # New entries stand behind the library's; among themselves their citation orders them.
    new = new.withColumn("pos", F.lit(1 << 40)).join(cited.groupBy("key").agg(F.min("ord").alias("_at")), "key").withColumn("pos", F.col("pos") + F.col("_at")).drop("_at")
    every = library.withColumn("added", F.lit(False)).unionByName(new.withColumn("added", F.lit(True)), allowMissingColumns=True)
    return L.sync(every, cited)


def missing_dois(cited: DataFrame, library: DataFrame, original: DataFrame) -> DataFrame:
    """(key) of the cited references for which a person must name an identifier."""
    return doi_for_keys(L.missing_refs(cited, library), original).where("doi is null").select("key")


def duplicates(files: DataFrame) -> DataFrame:
    """ordered_duplicates of the entries in files(file, content), whatever file they are in."""
    f = lambda n: F.element_at("fields", n).alias(n)
    return L.ordered_duplicates(B.parse(files).select("pos", "key", f("doi"), f("title"), f("author"), f("year")))


def validated(entries: DataFrame) -> DataFrame:
    """(key, issues) of entries(key, author, title, journal, year, doi, url) that lack something."""
    c = F.col
    return entries.select("key", L.issues(c("author"), c("title"), c("journal"), c("year"), c("doi"), c("url")).alias("issues")).where(F.size("issues") > 0)


def exit_code(findings: DataFrame) -> DataFrame:
    """(n, code): 1 if there are findings, else 0, as the command ends."""
    return coded(findings.agg(F.count("*").alias("n")))


def coded(number: DataFrame) -> DataFrame:
    """exit_code where the number of findings, (n), is known."""
    return number.select("n", F.when(F.col("n") > 0, 1).otherwise(0).alias("code"))


def manage(action: str, entries: DataFrame, cited: DataFrame | None = None, library: DataFrame | None = None) -> DataFrame:
    """The rows of a management action: pairs, a main bibliography, entries with issues, or a library
    with the entries moved into it."""
    if action == "check-duplicates":
        return L.ordered_duplicates(entries)
    if action == "sync-to-main":
        if cited is None:
            raise ValueError("sync-to-main needs the cited keys")
        return L.cited_only(entries, cited)
    if action == "validate-metadata":
        return validated(entries)
    if action == "migrate":
        return L.upsert(library, entries) if library is not None else entries
    raise ValueError(f"no such action: {action}")


# Reports

#: What a suggestion says in a report.
SUGGESTED = ("title", "authors", "year", "doi", "inline_citation", "best_evidence", "reference_note")


def analysed(docs: DataFrame, by: str, suggestions: DataFrame | None = None) -> DataFrame:
    """audit.analyses of docs(by, text) with the suggestions of suggestions(by, idx, …), best first."""
    return with_suggestions(audit.analyses(docs), by, suggestions)


def with_suggestions(rows: DataFrame, by: str, suggestions: DataFrame | None) -> DataFrame:
    kind = f"array<struct<{','.join(f'{n}:string' for n in SUGGESTED)}>>"
    if suggestions is None:
        return rows.withColumn("suggestions", F.array().cast(kind))
    one = F.struct(*[F.col(n) if n in suggestions.columns else F.lit("").alias(n) for n in SUGGESTED])
    lists = suggestions.groupBy(by, "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("s")))), lambda x: x["s"]).cast(kind).alias("suggestions"))
    return rows.join(lists, [by, "idx"], "left").withColumn("suggestions", F.coalesce("suggestions", F.array().cast(kind)))


def text_report(rows: DataFrame, by: str, show_ok: bool = False, needing: int = 20, fine: int = 10) -> DataFrame:
    """(by, report) of `analysed` rows: the counters, the first sentences that need citations, each with
    its search terms and up to three suggestions, and on request the first that need none."""
    start = lambda c, n: F.concat(F.substring(c, 1, n), F.lit("..."))
    line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    extra = lambda head, c: F.when(text(c) != "", line(f"\n      {head}: ", c)).otherwise("")
    cite = lambda s: line("\n    - ", start(text(s["title"]), 50), "\n      ", text(s["authors"]), " (", text(s["year"]), ")\n      DOI: ", text(s["doi"]), extra("Inline", s["inline_citation"]), extra("Note", s["reference_note"]))
    need = line(
        '\n• "', start(F.col("sentence"), 80), '"\n  Confidence: ', F.round(F.col("confidence") * 100).cast("int").cast("string"), "%\n  Reason: ", F.col("reason"),
        F.when(F.size("search_terms") > 0, line("\n  Search: ", F.array_join(F.slice("search_terms", 1, 4), " "))).otherwise(""),
        F.when(F.size("suggestions") > 0, line("\n  Suggestions:", F.array_join(F.transform(F.slice("suggestions", 1, 3), cite), ""))).otherwise(""),
    )
    ok = line('\n• "', start(F.col("sentence"), 60), '"\n  Reason: ', F.col("reason"))
    plain = ~F.col("needs_citation") & ~F.col("has_citation")
    # Sentences are judged once, for counters and lines; only the lines of the first rows of each kind are kept.
    kind = F.when(F.col("needs_citation"), "need").when(plain, "ok").otherwise("cited")
    at = F.row_number().over(Window.partitionBy(by, "kind").orderBy("idx"))
    lines = rows.withColumn("kind", kind).select(by, "idx", "kind", "has_citation", "needs_citation", F.when(F.col("kind") == "need", need).when((F.col("kind") == "ok") & F.lit(show_ok), ok).alias("line")).withColumn("at", at)
    first = lambda k, n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == k) & (F.col("at") <= n), F.struct("at", "line")))), lambda x: x["line"]), "\n").alias(f"{k}_lines")
    full = lines.groupBy(by).agg(*audit.counters(), first("need", needing), first("ok", fine))
    rule = "\n" + "-" * 60
    head = line("=" * 60, "\nCitation Need Analysis Report\n", "=" * 60, "\nTotal sentences: ", F.col("total").cast("string"), "\nSentences with citations: ", F.col("with_citations").cast("string"), "\nSentences needing citation: ", F.col("needing").cast("string"), "\nSentences OK (no citation needed): ", F.col("ok_n").cast("string"))
    part = lambda c, title: F.when(text(F.col(c)) != "", line(rule, f"\n{title}:", rule, "\n", F.col(c))).otherwise("")
    full = full.select(by, "total", "with_citations", "needing", F.col("total") - F.col("with_citations") - F.col("needing"), "need_lines", "ok_lines").toDF(by, "total", "with_citations", "needing", "ok_n", "need", "ok")
    return full.select(by, line(head, part("need", "Sentences Needing Citations"), part("ok", "Sentences Without Citation Need") if show_ok else F.lit("")).alias("report"))


def json_report(rows: DataFrame, by: str) -> DataFrame:
    """(by, report) of `analysed` rows: counters, analyses in order, and all suggestions, as JSON."""
    one = F.struct("sentence", "needs_citation", "confidence", "reason", "has_citation", "search_terms", "suggestions")
    full = rows.groupBy(by).agg(*audit.counters(), F.transform(F.array_sort(F.collect_list(F.struct("idx", one.alias("a")))), lambda x: x["a"]).alias("analyses"))
    body = F.struct(F.col("total").alias("total_sentences"), F.col("needing").alias("sentences_needing_citation"), F.col("with_citations").alias("sentences_with_citations"), F.col("ok").alias("sentences_ok"), "analyses", F.flatten(F.col("analyses.suggestions")).alias("suggested_citations"))
    return full.select(by, F.to_json(body).alias("report"))
