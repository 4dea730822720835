"""The registered queries. Inputs that the tables lack are made by SQL expressions that stand here
once and are used by a query and its check alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import attach
from ..functions import identifiers as I
from ..functions import scores as S
from ..functions import text as T
from ..operators import library as L
from ..operators import matching as M
from ..sources import bibtex as B
from ..sources import payloads as P
from . import audit
from . import workflows as W

BS = "chr(92)"
#: Made inputs, in SQL that Spark and DuckDB read alike.
MADE = {
    "cited": f"""concat(text, CASE doc_id % 9 WHEN 0 THEN concat(' ', {BS}, 'cite{{a,b}} x') WHEN 1 THEN concat(' ', {BS}, 'citep*{{c1}}') WHEN 2 THEN concat(' ', {BS}, 'citealp{{k}} y ', {BS}, 'autocite{{ z }}')
        WHEN 3 THEN ' see @smith:2020 and [Doe, 2019] ' WHEN 4 THEN ' (Miller et al., 2001b)' WHEN 5 THEN ' (Miller and Cook 1999)' WHEN 6 THEN concat(' ', {BS}, 'textcite{{t}}', {BS}, 'parencite{{p}}') ELSE '' END)""",
    "latex": f"concat({BS}, 'textbf{{', source, '}} ', {BS}, 'emph{{a ', text, '}} $x_', lang, '$ ', {BS}, 'alpha {{b}}')",
    "anchored": "concat(text, CASE doc_id % 7 WHEN 0 THEN ' Superconducting qubits and phonons' WHEN 1 THEN ' the NV centre, a spin defect' WHEN 2 THEN ' piezoelectric coupling of acoustic modes' WHEN 3 THEN ' mechanical resonators' ELSE '' END)",
    "identifier": """CASE doc_id % 10 WHEN 0 THEN concat('https://doi.org/10.', CAST(1000 + doc_id % 9000 AS STRING), '/', source, '/') WHEN 1 THEN concat('DOI:10.1234/', source, '.', lang) WHEN 2 THEN concat(' 10.5555/', source, '/ ')
        WHEN 3 THEN concat('https://pub.example/x?doi=10.7777/ab', CAST(doc_id AS STRING), '#top') WHEN 4 THEN concat('2106.', CAST(10000 + doc_id AS STRING), 'v2') WHEN 5 THEN concat('https://arxiv.org/pdf/2106.', CAST(10000 + doc_id AS STRING), '.pdf')
        WHEN 6 THEN CAST(30000000 + doc_id AS STRING) WHEN 7 THEN concat('https://pubmed.ncbi.nlm.nih.gov/', CAST(doc_id AS STRING), '/') WHEN 8 THEN concat('2106.', CAST(10000 + doc_id AS STRING)) ELSE concat('item ', source) END""",
    "title": f"""CASE p_partkey % 6 WHEN 0 THEN concat(p_name, ' of $T_c$ in ', p_brand) WHEN 1 THEN concat(p_name, ' of T_{{c}} in ', p_brand) WHEN 2 THEN concat('<i>', p_name, '</i>  in NbSe 2') WHEN 3 THEN concat(p_name, ' ', {BS}, '$T', {BS}, '_c', {BS}, '$ of ', p_brand)
        WHEN 4 THEN concat(p_name, ' $x$ of ', p_brand) ELSE concat('<mml:mi>He</mml:mi><mml:x/><mml:mn>3</mml:mn> ', p_name) END""",
    "authors": "concat(s_name, ' and Anna Maria ', replace(s_name, '#', ' '), ' AND Doe,  J.  and Plato')",
    "doi": "CASE s_suppkey % 4 WHEN 0 THEN concat('10.1/', s_name) WHEN 1 THEN concat('http://doi.org/10.1/', s_name) WHEN 2 THEN concat('doi:10.1/', s_name) ELSE concat('https://doi.org/10.1/', s_name) END",
    "journal": "CASE p_partkey % 5 WHEN 0 THEN 'Nature Communications' WHEN 1 THEN 'Physical Review B' WHEN 2 THEN 'Nano Letters' WHEN 3 THEN '' ELSE p_brand END",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def made(name: str):
    return F.expr(MADE[name])


def joined(terms):
    return F.array_join(terms, "|")


def q_sentence_split(spark, sf):
    return audit.sentence_rows(table(spark, sf, "documents").select("doc_id", "text"))


def q_citation_need(spark, sf):
    return audit.analyses(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "idx", "confidence", "needs_citation", "reason")


def q_audit_counts(spark, sf):
    return audit.counts(audit.analyses(table(spark, sf, "documents").select("lang", made("cited").alias("text"))), "lang")


def q_find_citations(spark, sf):
    return table(spark, sf, "documents").select("doc_id", joined(T.citations(made("cited"))).alias("citations"))


def q_search_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", joined(T.search_terms(F.col("text"))).alias("terms"))


def q_title_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", joined(F.sort_array(T.title_terms(F.col("text")))).alias("terms"))


def q_quant_claims(spark, sf):
    c = T.claims(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", joined(c["value"]).alias("vals"), joined(c["unit"]).alias("units"))


def q_claim_snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", joined(T.snippets(F.col("text"))).alias("snippets"))


def q_anchor_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", joined(T.anchor_terms(made("anchored"))).alias("anchors"))


def q_strip_latex(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.strip_latex(made("latex")).alias("plain"))


def q_titles(spark, sf):
    return table(spark, sf, "part").select("p_partkey", I.title_for_bibtex(made("title")).alias("bibtex"), I.title_plain(made("title")).alias("plain"))


def q_normalize_doi(spark, sf):
    x = made("identifier")
    return table(spark, sf, "documents").select("doc_id", I.normalize_to_doi(x).alias("norm"), I.clean_doi(x).alias("clean"), I.doi_of_url(x).alias("url_doi"), I.arxiv_of_url(x).alias("arxiv"), I.pmid_of_url(x).alias("pmid"))


def q_id_route(spark, sf):
    return table(spark, sf, "documents").select("doc_id", I.route(made("identifier")).alias("r")).select("doc_id", "r.source", "r.id")


def q_normalize_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", I.normalize_url(F.col("url")).alias("url"))


def q_normalize_title(spark, sf):
    return table(spark, sf, "documents").select("doc_id", I.title_key(F.col("text")).alias("title_key"), I.author_key(F.concat(F.lit(" "), F.col("source"), F.lit("  B "), F.col("lang"))).alias("author_key"))


ENTRY = {
    "key": "concat('k', CAST(doc_id AS STRING))", "doi": "CASE WHEN doc_id % 3 = 0 THEN concat(CASE WHEN doc_id % 2 = 0 THEN '10.1/X' ELSE '10.1/x' END, CAST(doc_id % 400 AS STRING)) ELSE '' END",
    "title": "text", "author": "concat(source, '  ', CAST(doc_id % 57 AS STRING), ' Au')", "year": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(1990 + doc_id % 31 AS STRING) END",
}


def entries(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), *[F.expr(e).alias(n) for n, e in ENTRY.items()])


def q_dup_pairs(spark, sf):
    return L.duplicate_pairs(entries(spark, sf))


def library(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))


def orders(spark, sf):
    return table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("key"), F.col("o_orderkey").alias("ord"))


def q_cited_semi(spark, sf):
    return L.cited_only(library(spark, sf), orders(spark, sf)).select("key", "name")


def q_missing_anti(spark, sf):
    return L.missing_refs(orders(spark, sf), library(spark, sf))


def q_cite_order(spark, sf):
    return L.cite_order(library(spark, sf), orders(spark, sf)).select("key", "cite_order")


def q_sort_cite_order(spark, sf):
    return L.sync(library(spark, sf), orders(spark, sf)).select("key", "cite_order", "rank")


def q_reuse_lookup(spark, sf):
    ids = table(spark, sf, "documents").select(made("identifier").alias("id"))
    lib = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.expr(ENTRY["key"]).alias("key"), F.expr("concat('10.1234/', source, '.', lang)").alias("doi"), F.expr("concat('HTTPS://PubMed.ncbi.nlm.nih.gov/', CAST(doc_id AS STRING), '?utm_a=1')").alias("url"), F.expr("concat('2106.', CAST(10003 + doc_id AS STRING))").alias("eprint"))
    return L.reuse(ids, lib)


def q_rerank_topn(spark, sf):
    sents = table(spark, sf, "documents").select(F.col("doc_id").alias("sent_id"), made("anchored").alias("sentence"))
    cands = table(spark, sf, "benchmark").select(F.col("item_id").alias("pos"), F.expr("concat('b', CAST(item_id AS STRING))").alias("cite_key"), F.expr("CASE item_id % 4 WHEN 0 THEN 'Acoustic modes of a phonon' WHEN 1 THEN 'A qubit at 3.2 K' ELSE '' END").alias("title"), F.col("text").alias("abstract"), F.lit("J").alias("journal"))
    return M.rank(sents, cands, 3).drop("pos")


def q_best_evidence(spark, sf):
    return M.best_evidence(table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'the and of' ELSE concat('This study of ', source) END").alias("title"), F.expr("CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END").alias("abstract"))).withColumnRenamed("pos", "doc_id")


def q_source_fallback(spark, sf):
    d = table(spark, sf, "documents")
    rows = table(spark, sf, "labels").select("doc_id", F.lit(0).alias("tier"), F.lit("local").alias("name"))
    rows = rows.union(d.where("n_chars > 2000").select("doc_id", F.lit(1), F.col("source"))).union(d.select("doc_id", F.lit(2), F.col("lang")))
    return M.first_source(rows, "doc_id", "tier")


def q_inverted_index(spark, sf):
    words = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("at", "word"))
    index = words.groupBy("conv_id", "turn", "word").agg(F.sort_array(F.collect_list("at")).alias("ats")).groupBy("conv_id", "turn").agg(F.map_from_entries(F.collect_list(F.struct("word", "ats"))).alias("index"))
    return index.select("conv_id", "turn", T.inverted_index_text(F.col("index")).alias("text"))


def q_validate(spark, sf):
    has = lambda n, c: F.expr(f"CASE WHEN o_orderkey % {n} = 0 THEN '' WHEN o_orderkey % {n} = 1 THEN NULL ELSE {c} END")
    i = L.issues(has(5, "o_orderpriority"), has(3, "o_orderpriority"), has(2, "o_orderstatus"), has(7, "o_orderstatus"), has(4, "o_orderstatus"), has(2, "o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", joined(i).alias("issues"), F.size(i).cast("long").alias("n"))


def q_fix_entries(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", I.fix_doi(made("doi")).alias("doi"), I.fix_authors(made("authors")).alias("authors"))


def q_backfill(spark, sf):
    fields = {"number": F.expr("CASE WHEN p_partkey % 3 = 0 THEN '9' ELSE '' END"), "pages": F.expr("CASE WHEN p_partkey % 4 = 0 THEN '1-2' END"), "title": F.col("p_name"), "journal": made("journal"), "eprint": F.expr("CASE WHEN p_partkey % 2 = 0 THEN '2511.05763' ELSE '' END")}
    got = L.backfill(fields, F.expr("CAST(p_size AS STRING)"), F.expr("CASE WHEN p_partkey % 5 = 0 THEN '4979' END"), F.lit("17"))
    return table(spark, sf, "part").select("p_partkey", *[c.alias(n) for n, c in got.items()])


def q_inline_citation(spark, sf):
    f = {"journal": I.abbreviate(made("journal")), "volume": F.expr("CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS STRING) END"), "pages": F.expr("CASE WHEN p_partkey % 3 = 0 THEN '12' END"), "year": F.expr("CASE WHEN p_partkey % 7 > 0 THEN '2025' END"), "eprint": F.expr("CASE WHEN p_partkey % 4 = 0 THEN '2511.05763' END")}
    return table(spark, sf, "part").select("p_partkey", I.inline_citation(f).alias("cite"))


def q_citation_key(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.expr("concat(source, ', X and Y')").alias("author"), F.expr("CASE WHEN doc_id % 4 = 0 THEN '' ELSE CAST(1990 + doc_id % 3 AS STRING) END").alias("year"), F.expr("CASE WHEN doc_id % 2 = 0 THEN lang ELSE text END").alias("title"))
    return L.citation_keys(rows).select(F.col("pos").alias("doc_id"), "citekey")


#: Bases of keys, and keys that a library has of them: some with suffixes, some with ends that are none.
KEYS = {"year": "CAST(1990 + doc_id % 3 AS STRING)", "end": "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'c' WHEN 2 THEN CAST(doc_id % 50 AS STRING) ELSE 'x' END"}


def q_citation_key_gaps(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("author"), F.expr(KEYS["year"]).alias("year"), F.col("lang").alias("title"), F.expr(KEYS["end"]).alias("end"))
    return L.citation_keys(rows.drop("end"), rows.select(F.concat("author", "year", "title", "end").alias("key"))).select(F.col("pos").alias("doc_id"), "citekey")


PARTS = {"author": "p_brand", "title": "concat('{', p_name, '} of ', p_type)", "year": "CAST(1950 + p_size AS STRING)", "doi": "concat('10.', CAST(p_partkey AS STRING), '/x')", "abstract": "CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type END"}


def parts_text(spark, sf):
    f = {n: F.expr(e) for n, e in PARTS.items()}
    return table(spark, sf, "part").select(F.col("p_partkey"), B.build(F.lit("article"), F.expr("concat('k-', CAST(p_partkey AS STRING))"), f).alias("content"))


def q_bibtex_build(spark, sf):
    return parts_text(spark, sf)


def q_bibtex_roundtrip(spark, sf):
    rows = B.parse(parts_text(spark, sf).withColumnRenamed("p_partkey", "file"))
    return rows.select(F.col("file").cast("long").alias("p_partkey"), "pos", "type", "key", *[F.coalesce(F.element_at("fields", n), F.lit("")).alias(n) for n in PARTS])


def q_bbl_keys(spark, sf):
    bbl = F.expr(f"concat({BS}, 'bibitem[', source, '(2021)]{{', source, '-', lang, '}} ', {BS}, 'entry{{e', CAST(doc_id AS STRING), '}}{{article}}{{}} ', {BS}, 'setentrytag{{ t }} ', {BS}, 'bibitem{{', lang, '}}')")
    return table(spark, sf, "documents").select("doc_id", joined(B.bbl_keys(bbl)).alias("keys"))


def q_list_files(spark, sf):
    listed = F.expr("concat('# head', chr(10), ' ', source, ' ', chr(10), chr(10), lang, chr(10), ' #x', chr(10), CAST(doc_id AS STRING))")
    tex = F.expr(f"concat({BS}, 'addbibresource[a=b]{{', source, '.bib}} ', {BS}, 'Bibliography{{', lang, ' , main,', lang, '}}')")
    return table(spark, sf, "documents").select("doc_id", joined(B.list_items(listed)).alias("items"), joined(B.bibliography_files(tex)).alias("files"))


def q_json_works(spark, sf):
    work = F.to_json(F.struct(F.expr("concat('10.1/', CAST(doc_id AS STRING))").alias("doi"), F.array("text").alias("title"), F.expr("array(named_struct('family', source, 'given', lang), named_struct('family', '', 'given', 'x'), named_struct('family', 'Solo', 'given', ''))").alias("author"), F.expr("named_struct('date-parts', array(array(CAST(1990 + doc_id % 30 AS INT), 5)))").alias("issued"), F.expr("CASE WHEN doc_id % 2 = 0 THEN named_struct('date-parts', array(array(2001))) END").alias("created")))
    return table(spark, sf, "documents").select("doc_id", P.crossref(work).alias("w")).select("doc_id", "w.doi", "w.title", "w.authors", "w.year")


def q_html_meta(spark, sf):
    html = F.expr("""concat('<head><meta name="citation_title" content=" A &amp; ', source, '"><META NAME="citation_author" CONTENT="Doe, J"><meta name="citation_author" content="', lang, '"/><meta name="citation_date" content="2024/05/01"></head>', text)""")
    return table(spark, sf, "documents").select("doc_id", P.arxiv_html(html, F.col("source")).alias("w")).select("doc_id", "w.author", "w.title", "w.year", "w.url")


def q_xml_authors(spark, sf):
    xml = F.expr("""concat('<feed><entry><title>', source, '</title><published>2023-01-02T00:00:00Z</published><author><name>Ada ', lang, ' King</name></author><author><name>Plato</name></author></entry></feed>')""")
    return table(spark, sf, "documents").select("doc_id", P.arxiv_atom(xml, F.col("lang")).alias("w")).select("doc_id", "w.author", "w.title", "w.year", "w.eprint")


# Commands

LIBRARY = {
    "key": "concat('c', CAST(c_custkey AS STRING))", "doi": "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('10.7000/c', CAST(c_custkey AS STRING)) END",
    "written": "CASE c_custkey % 4 WHEN 0 THEN concat('https://doi.org/10.7000/c', CAST(c_custkey AS STRING)) WHEN 1 THEN concat('doi: 10.7000/c', CAST(c_custkey AS STRING)) WHEN 2 THEN concat(' 10.7000/c', CAST(c_custkey AS STRING)) ELSE NULL END",
}


def shelf(spark, sf):
    """A library of two thirds of the customers, and the original file with all of them."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.expr(LIBRARY["key"]).alias("key"), F.expr(LIBRARY["doi"]).alias("doi"), F.expr(LIBRARY["written"]).alias("written"), F.col("c_name").alias("title"))
    return c.where("pos % 3 > 0").drop("written"), c.select("pos", "key", F.col("written").alias("doi"))


def works(spark, sf):
    """Payloads of the registry, fetched by DOI for some."""
    c = table(spark, sf, "customer").where("c_custkey % 7 > 0")
    return c.select(F.lit("crossref").alias("source"), F.expr("concat('10.7000/C', CAST(c_custkey AS STRING))").alias("id"), F.expr("concat('Doe', CAST(c_custkey AS STRING), ', J')").alias("author"), F.lit("Nano Letters").alias("journal"), F.lit("2020").alias("year"), F.col("c_name").alias("title"))


def q_doi_for_key(spark, sf):
    return W.doi_for_keys(orders(spark, sf).select(F.expr("concat('c', CAST(key DIV 2 AS STRING))").alias("key")), shelf(spark, sf)[1])


def q_sync_library(spark, sf):
    lib, original = shelf(spark, sf)
    cited = orders(spark, sf).select(F.expr("concat('c', CAST(key DIV 2 AS STRING))").alias("key"), F.col("ord"))
    return W.sync_cited(cited, lib, original, works(spark, sf)).select("key", "cite_order", "rank", "added", "journal", "type")


def q_bbl_sync(spark, sf):
    bbl = table(spark, sf, "nation").select(F.col("n_nationkey").alias("file"), F.expr(f"concat({BS}, 'bibitem{{c', CAST(n_nationkey * 3 AS STRING), '}} x ', {BS}, 'bibitem[a(2020)]{{c2}}')").alias("text"))
    lib, original = shelf(spark, sf)
    return W.sync_references(bbl.where("file > 0"), lib, original, works(spark, sf)).select("key", "cite_order", "added")


def q_missing_doi(spark, sf):
    lib, original = shelf(spark, sf)
    return W.missing_dois(orders(spark, sf).select(F.expr("concat('c', CAST(key DIV 2 AS STRING))").alias("key")), lib, original)


def asked(spark, sf):
    """Identifiers to extract, a library that has some, and payloads for others."""
    c = table(spark, sf, "customer")
    ids = c.select(F.col("c_custkey").alias("pos"), F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('https://doi.org/10.7000/C', CAST(c_custkey AS STRING)) WHEN 1 THEN concat('10.7000/C', CAST(c_custkey AS STRING)) WHEN 2 THEN CAST(40000000 + c_custkey AS STRING) ELSE concat('https://arxiv.org/abs/2301.', CAST(10000 + c_custkey AS STRING)) END").alias("id"))
    lib = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("pos"), F.expr(LIBRARY["key"]).alias("key"), F.expr("concat('10.7000/c', CAST(c_custkey AS STRING))").alias("doi"), F.lit("").alias("url"), F.lit("").alias("eprint"))
    other = c.where("c_custkey % 4 = 2 AND c_custkey % 5 > 0").select(F.lit("pubmed").alias("source"), F.expr("CAST(40000000 + c_custkey AS STRING)").alias("id"), F.expr("concat('Roe', CAST(c_custkey AS STRING))").alias("author"), F.lit("Science").alias("journal"), F.lit("2019").alias("year"), F.col("c_name").alias("title"))
    return ids, lib, works(spark, sf).unionByName(other)


def q_extract(spark, sf):
    return W.extract(*asked(spark, sf)).select("pos", "source", "ref", "status", "key")


def q_batch_counts(spark, sf):
    return W.batch_counts(W.extract(*asked(spark, sf)))


def q_finalise(spark, sf):
    ids, lib, payloads = asked(spark, sf)
    return W.finalised(ids.where("pos % 4 = 1").select(F.col("id").alias("doi")), lib, payloads).select("doi", "status")


def q_append(spark, sf):
    ids, lib, payloads = asked(spark, sf)
    done = W.extract(ids, lib, payloads)
    return W.with_extracted(done, lib, payloads).select("key", F.coalesce("journal", F.lit("")).alias("journal"))


def q_upsert(spark, sf):
    lib, _ = shelf(spark, sf)
    new = table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.expr("concat('n', CAST(c_custkey DIV 2 AS STRING))").alias("key"), F.expr("concat('doi:10.7000/C', CAST(c_custkey DIV 3 AS STRING))").alias("doi"))
    return L.upsert(lib, new).select("key", "pos")


def q_ordered_duplicates(spark, sf):
    return L.ordered_duplicates(entries(spark, sf))


def q_duplicate_count(spark, sf):
    return W.coded(L.duplicate_count(entries(spark, sf)))


def q_duplicate_groups(spark, sf):
    return L.duplicate_groups(entries(spark, sf))


def q_scan_duplicates(spark, sf):
    one = F.expr(f"concat('@article{{k', CAST(p_partkey AS STRING), ', title = {{', p_name, '}}, doi = \"10.1/', CAST(p_partkey % 50 AS STRING), '\"}}')")
    return W.duplicates(table(spark, sf, "part").where("p_partkey < 200").select(F.col("p_partkey").alias("file"), one.alias("content")))


def q_manage_validate(spark, sf):
    c = table(spark, sf, "customer").select(F.expr(LIBRARY["key"]).alias("key"), F.lit("A").alias("author"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'T' END").alias("title"), F.lit("").alias("journal"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN '2001' END").alias("year"), F.expr(LIBRARY["doi"]).alias("doi"), F.lit(None).cast("string").alias("url"))
    return W.manage("validate-metadata", c).select("key", joined(F.col("issues")).alias("issues"))


def q_validate_code(spark, sf):
    c = table(spark, sf, "customer").select(F.expr(LIBRARY["key"]).alias("key"), *[F.lit("x").alias(n) for n in ("author", "title", "journal", "year", "url")], F.expr(LIBRARY["doi"]).alias("doi"))
    return W.exit_code(W.validated(c))


def q_manage_main(spark, sf):
    lib, _ = shelf(spark, sf)
    return W.manage("sync-to-main", lib, orders(spark, sf).select(F.expr("concat('c', CAST(key DIV 4 AS STRING))").alias("key"))).select("pos", "key")


def q_manage_migrate(spark, sf):
    lib, original = shelf(spark, sf)
    return W.manage("migrate", original.where("pos % 2 = 0").withColumn("doi", F.coalesce("doi", F.lit(""))), library=lib.select("pos", "key", "doi")).select("pos", "key")


def q_candidates(spark, sf):
    rows = B.parse(parts_text(spark, sf).withColumnRenamed("p_partkey", "file"))
    return W.candidates(rows).select("cite_key", "title", "authors", "year", "doi", "abstract", "type", "source")


def q_render(spark, sf):
    rows = table(spark, sf, "supplier").select(F.lit("f").alias("file"), F.col("s_suppkey").alias("pos"), F.lit("misc").alias("type"), F.expr("concat('s', CAST(s_suppkey AS STRING))").alias("key"), F.expr("concat('title = {', s_name, '}')").alias("content"))
    return B.render(rows).select("pos", "value")


def q_set_field(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pos"), F.create_map(F.lit("cite_order"), F.lit("7"), F.lit("title"), F.col("s_name")).alias("fields"))
    new = F.when(F.col("pos") % 2 == 0, F.col("pos").cast("string"))
    return L.set_field(rows, "cite_order", new).select("pos", F.coalesce(F.element_at("fields", "cite_order"), F.lit("none")).alias("cite_order"), F.element_at("fields", "title").alias("title"), F.size("fields").cast("long").alias("n"))


def laid_out(text: str):
    return F.expr(f"concat('% kept ', lang, ', by hand\\n\\n@article{{', source, '-1,\\n  Title  =  {{A, {{B}}}},   % a note\\n    year = 2001,\\n{text}}}\\n@misc{{other, cite_order={{1}}}}\\n% tail ', source)")


def q_splice_field(spark, sf):
    """Changed, new and removed fields, and files without the key, with their layout."""
    docs = table(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 4 == 0, laid_out("")).otherwise(laid_out('  cite_order = "7",\\n'))
    files = docs.select(F.col("doc_id").alias("file"), text.alias("content"))
    key = F.when(F.col("doc_id") % 4 == 3, "absent").otherwise(F.concat("source", F.lit("-1")))
    value = F.when(F.col("doc_id") % 4 != 2, F.col("lang"))
    edits = docs.select(F.col("doc_id").alias("file"), key.alias("key"), F.lit("Cite_Order").alias("name"), value.alias("value"))
    return B.splice_fields(files, edits).select(F.col("file").cast("long").alias("doc_id"), "content")


def q_legacy_keys(spark, sf):
    text = F.expr("concat('@article{', source, '-1, x} @misc{', lang, ':2, title={a}} @book{', source, '-1, y}')")
    return table(spark, sf, "documents").select("doc_id", joined(B.legacy_keys(text)).alias("keys"))


def q_as_misc(spark, sf):
    text = F.expr("concat(CASE WHEN doc_id % 2 = 0 THEN ' @data{' ELSE '@article{' END, source, ', note = {@data{x}}}')")
    return table(spark, sf, "documents").select("doc_id", B.as_misc(text).alias("bibtex"))


def q_split_entries(spark, sf):
    text = F.expr("concat('@article{', source, ', a={b}}', chr(10), chr(10), '@misc{', lang, ', c={d}}')")
    return table(spark, sf, "documents").select("doc_id", joined(B.split_entries(text)).alias("entries"))


def q_crossref_search(spark, sf):
    work = F.to_json(F.struct(F.expr("concat('10.1/', CAST(doc_id AS STRING))").alias("DOI"), F.array("source").alias("title"), F.expr("transform(sequence(1, 2 + doc_id % 4), k -> named_struct('family', concat('F', CAST(k AS STRING)), 'given', lang))").alias("author"), F.expr("CASE WHEN doc_id % 2 = 0 THEN named_struct('date-parts', array(array(2001))) END").alias("published-online"), F.expr("named_struct('date-parts', array(array(1999)))").alias("issued"), F.array(F.lit("J")).alias("container-title")))
    return table(spark, sf, "documents").select("doc_id", P.crossref_search(work).alias("w")).select("doc_id", "w.doi", "w.title", "w.authors", "w.year", "w.journal", "w.source")


def q_openalex(spark, sf):
    work = F.to_json(F.struct(F.expr("concat('https://doi.org/10.2/', CAST(doc_id AS STRING))").alias("doi"), F.col("source").alias("title"), F.lit(2020).alias("publication_year"), F.expr("transform(sequence(1, 2 + doc_id % 4), k -> named_struct('author', named_struct('display_name', concat(lang, CAST(k AS STRING)))))").alias("authorships"), F.expr("map('b', array(1, 3), 'a', array(0, 2))").alias("abstract_inverted_index")))
    return table(spark, sf, "documents").select("doc_id", P.openalex(work).alias("w")).select("doc_id", "w.doi", "w.title", "w.authors", "w.year", "w.abstract", "w.source")


def q_scholar(spark, sf):
    work = F.to_json(F.struct(F.col("source").alias("title"), F.lit(2018).alias("year"), F.col("lang").alias("venue"), F.expr("CASE WHEN doc_id % 3 = 0 THEN named_struct('name', 'J') END").alias("journal"), F.expr("CASE WHEN doc_id % 2 = 0 THEN named_struct('DOI', concat('10.3/', CAST(doc_id AS STRING))) END").alias("externalIds")))
    return table(spark, sf, "documents").select("doc_id", P.scholar(work).alias("w")).where("w is not null").select("doc_id", "w.doi", "w.title", "w.year", "w.journal", "w.source")


def q_pubmed(spark, sf):
    one = "named_struct('LastName', source, 'ForeName', CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END, 'Initials', 'Q')"
    who = f"CASE WHEN doc_id % 3 = 0 THEN to_json({one}) ELSE to_json(array({one}, named_struct('LastName', '', 'ForeName', 'x', 'Initials', 'y'))) END"
    work = F.expr(f"concat('{{\"MedlineCitation\":{{\"Article\":{{\"ArticleTitle\":{{\"value\":\"T\"}},\"AuthorList\":{{\"Author\":', {who}, '}},\"Journal\":{{\"Title\":\"J\",\"JournalIssue\":{{\"Volume\":\"3\",\"PubDate\":{{\"Year\":\"2011\"}}}}}}}}}}}}')")
    return table(spark, sf, "documents").select("doc_id", P.pubmed(work).alias("w")).select("doc_id", "w.authors", "w.title", "w.journal", "w.volume", "w.year")


def q_without_arxiv(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN 'CrossRef' WHEN 1 THEN 'openalex' ELSE 'semantic-scholar' END").alias("source"), F.expr("CASE WHEN doc_id % 5 = 0 THEN '10.48550/ArXiv.1' WHEN doc_id % 5 = 1 THEN NULL ELSE '10.1/x' END").alias("doi"), F.expr("CASE WHEN doc_id % 4 = 0 THEN 'arXiv e-prints' ELSE 'J' END").alias("journal"))
    return W.without_arxiv(rows).select("doc_id")


def suggestions(spark, sf):
    """Sentences, local candidates (even items) and found ones (odd items, by sentence and registry)."""
    sents = table(spark, sf, "documents").select(F.col("doc_id").alias("sent_id"), made("anchored").alias("sentence"))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("pos"), F.expr("concat('b', CAST(item_id AS STRING))").alias("cite_key"), F.expr("CASE item_id % 4 WHEN 0 THEN 'Acoustic modes of a phonon' WHEN 1 THEN 'A qubit at 3.2 K' ELSE '' END").alias("title"), F.col("text").alias("abstract"), F.lit("J").alias("journal"), F.lit("A").alias("authors"), F.lit("2020").alias("year"), F.expr("CASE item_id % 7 WHEN 0 THEN '10.48550/arxiv.1' WHEN 1 THEN '' ELSE concat('10.7000/c', CAST(item_id AS STRING)) END").alias("doi"))
    far = sents.select("sent_id", (F.col("sent_id") % 10).alias("d")).join(items.where("pos % 2 = 1").withColumn("d", F.col("pos") % 10), "d").drop("d")
    # A registry's rows are numbered for each sentence, so one number is another work for another sentence.
    far = far.withColumn("pos", F.expr("pos DIV 10")).withColumn("tier", F.expr("CAST(pos % 3 AS INT)")).withColumn("source", F.expr("CASE tier WHEN 0 THEN 'CrossRef' WHEN 1 THEN 'openalex' ELSE 'semantic-scholar' END"))
    works = items.where("(pos % 3 > 0 OR pos % 12 = 0) AND pos % 7 > 0").select(F.upper("doi").alias("doi"), F.lit("Nano Lett.").alias("journal"), F.expr("CAST(pos AS STRING)").alias("volume"), F.expr("CASE WHEN pos % 2 = 0 THEN '12' ELSE '' END").alias("pages"), F.lit("2021").alias("year"), F.lit("").alias("eprint"))
    return sents, items.where("pos % 2 = 0 AND pos % 6 = 0").withColumn("source", F.lit("local-bib")), far, works


SUGGESTION = ["cite_key", "source", "score", "rank", "best_evidence", "reference_note", "inline_citation"]


def q_suggest(spark, sf):
    sents, local, far, works = suggestions(spark, sf)
    return W.suggest(sents, local, far, works=works).select("sent_id", *SUGGESTION)


def q_suggest_final(spark, sf):
    sents, local, far, works = suggestions(spark, sf)
    lib, _ = shelf(spark, sf)
    finals = lib.where("doi <> ''").select("doi", "key", F.lit("existing").alias("status"))
    return W.suggest(sents, local, far, finals=finals, works=works).select("sent_id", *SUGGESTION)


def q_audit_suggest(spark, sf):
    """The audit of all documents with the library's suggestions, a row a suggestion."""
    _, local, _, works = suggestions(spark, sf)
    docs = table(spark, sf, "documents").select("doc_id", made("anchored").alias("text"))
    rows = W.audited(docs, "doc_id", local, works=works).select("doc_id", F.col("idx").cast("long").alias("idx"), F.posexplode("suggestions").alias("place", "s"))
    return rows.select("doc_id", "idx", F.col("place").cast("long").alias("place"), "s.title", "s.doi", "s.best_evidence", "s.reference_note", "s.inline_citation")


def q_report(spark, sf):
    return W.text_report(W.analysed(table(spark, sf, "documents").select("doc_id", made("cited").alias("text")), "doc_id"), "doc_id")


def q_report_json(spark, sf):
    r = W.json_report(W.analysed(table(spark, sf, "documents").select("doc_id", made("cited").alias("text")), "doc_id"), "doc_id")
    # Read once, whatever is taken from it.
    counted = ("total_sentences", "sentences_needing_citation", "sentences_with_citations", "sentences_ok")
    r = r.select("doc_id", F.from_json("report", f"{', '.join(f'{n} long' for n in counted)}, analyses array<struct<sentence:string>>").alias("r"))
    return r.select("doc_id", *[f"r.{n}" for n in counted], F.size("r.analyses").cast("long").alias("n"), F.col("r.analyses")[0]["sentence"].alias("first"))


QUERIES = {n: f for n, f in globals().items() if n.startswith("q_")}
