"""BibTeX, .bbl, .tex and list files as DataFrames, and BibTeX text from fields.

Balanced braces are no regular language, so whole entries are scanned in Arrow batches; everything
else is built-in expressions. Differences from a naive scanner, all deliberate: keys may hold any
characters but commas and white space; a percent sign starts a comment only outside entries;
parenthesised entries end at their parenthesis; field names match whole names only.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import strip

HEAD = re.compile(r"@(\w+)\s*([{(])\s*([^,\s{}()]+)\s*,")
#: The head of an entry at the start of a line.
NEXT = re.compile(r"^[ \t]*" + HEAD.pattern, re.M)
NAME = re.compile(r"([A-Za-z][\w-]*)\s*=\s*")
ENTRY = "file string, pos int, type string, key string, content string, fields map<string,string>"


def scan(text: str):
    """(type, key, content) of each entry, in order. An entry that is never closed ends before the next
    line that starts one."""
    return ((kind, key, text[body:end].strip()) for kind, key, body, end in spans(text))


def spans(text: str):
    """(type, key, where the body starts, where it ends) of each entry, in order."""
    at = 0
    while m := HEAD.search(text, at):
        line = text.rfind("\n", 0, m.start()) + 1
        if re.search(r"(?<!\\)%", text[line : m.start()]):
            at = (text.find("\n", m.start()) + 1) or len(text)
            continue
        end = closing(text, m.end(), "})"[m[2] == "("])
        if end == len(text) and (after := NEXT.search(text, m.end())):
            end = after.start()
            yield m[1].lower(), m[3], m.end(), end
            at = end
            continue
        yield m[1].lower(), m[3], m.end(), end
        at = end + 1


def closing(text: str, at: int, last: str) -> int:
    """Where the entry whose body starts at `at` ends."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif c == last and depth == 0:
            return at
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
        at += 1
    return len(text)


def fields(content: str) -> list[tuple[str, str]]:
    """Names, in lower case, and values: in braces to any depth, in quotes, or bare; white space
    collapsed. Of a name given twice the last value stays."""
    out = {}
    for name, _, start, end in field_spans(content):
        cut = content[start:end]
        if cut[:1] == "{":
            cut = cut[1 : closing(cut, 1, "}")]
        elif cut[:1] == '"':
            cut = cut[1:].removesuffix('"')
        out.pop(name, None)
        out[name] = " ".join(cut.split())
    return list(out.items())


def field_spans(content: str):
    """(name in lower case, where the name starts, where the value starts, where it ends) of each field,
    the value with its braces or quotes."""
    at = 0
    while m := NAME.search(content, at):
        k = m.end()
        if content[k : k + 1] == "{":
            at = min(closing(content, k + 1, "}") + 1, len(content))
        elif content[k : k + 1] == '"':
            end = k + 1
            depth = 0
            while end < len(content) and (content[end] != '"' or depth):
                depth += (content[end] == "{") - (content[end] == "}")
                end += 1
            at = min(end + 1, len(content))
        else:
            at = k + len(re.match(r"[^,\n]*", content[k:])[0])
        yield m[1].lower(), m.start(), k, at


def parse(files: DataFrame, column: str = "content") -> DataFrame:
    """Entries of files(file, content): file, pos, type, key, content, fields."""

    def run(batches):
        for batch in batches:
            rows = [(f, p, *e, fields(e[2])) for f, t in zip(batch.column("file").to_pylist(), batch.column(column).to_pylist(), strict=True) for p, e in enumerate(scan(t or ""))]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
            names = ("file", "pos", "type", "key", "content", "fields")
            yield pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})

    return files.select(F.col("file").cast("string").alias("file"), column).mapInArrow(run, ENTRY)


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("content"))
    return parse(files)


class BibtexSource(DataSource):
    """spark.read.format("bibtex").load(path): a partition a file of the driver's listing."""

    @classmethod
    def name(cls) -> str:
        return "bibtex"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> DataSourceReader:
        return BibtexReader(self.options["path"])


class BibtexReader(DataSourceReader):
    """Lists and reads through pyarrow's file systems, so a path may be any URI that they know."""

    def __init__(self, path: str):
        self.path = path

    def place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self):
        from pyarrow import fs

        system, path = self.place()
        info = system.get_file_info(path)
        found = system.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info]
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if info is f or f.path.endswith(".bib")]

    def read(self, partition):
        with self.place()[0].open_input_stream(partition.value) as f:
            text = f.read().decode("utf-8")
        for pos, (kind, key, content) in enumerate(scan(text)):
            yield partition.value, pos, kind, key, content, dict(fields(content))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """file and text of .tex, .md and .txt documents, a row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def read_identifiers(spark: SparkSession, path: str) -> DataFrame:
    """id, a row a line of a list file that is neither blank nor a comment."""
    return spark.read.text(path).select(F.explode(list_items(F.col("value"))).alias("id"))


def read_cited_keys(spark: SparkSession, path: str) -> DataFrame:
    """The distinct keys of a file of cited keys, one a line."""
    return spark.read.text(path).select(strip(F.col("value")).alias("key")).where("key <> ''").distinct()


# Regular formats

def split_entries(text: Column) -> Column:
    """Raw entries, each up to the next that starts a line."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)@\w+\{.*?(?=\n@\w+\{|\z)"), F.lit(0)), strip)


def legacy_keys(text: Column) -> Column:
    """Distinct keys as the older command reads them: whatever stands between the brace and a comma."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"@(\w+)\{([^,]+),"), F.lit(2)))


def as_misc(bibtex: Column) -> Column:
    """Negotiated BibTeX, trimmed; a dataset becomes @misc."""
    return F.regexp_replace(strip(bibtex), r"^@data\{", "@misc{")


def bbl_keys(text: Column) -> Column:
    """Cited keys of a .bbl in document order, repeats kept."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?:\\bibitem(?:\[[^]]*\])?|\\entry(?=\{[^}]+\}\{)|\\setentrytag)\{([^}]+)\}"), F.lit(1)), strip)


def bibliography_files(tex: Column) -> Column:
    names = lambda p: F.flatten(F.transform(F.regexp_extract_all(tex, F.lit(p), F.lit(1)), lambda x: F.transform(F.split(x, ","), strip)))
    return F.array_distinct(F.concat(names(r"(?i)\\bibliography\{([^}]+)\}"), names(r"(?i)\\addbibresource(?:\[[^\]]*\])?\{([^}]+)\}")))


def list_items(text: Column) -> Column:
    """Identifiers of a list file: lines, trimmed, without blank ones and those that start with #."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: ~x.startswith("#"))
    return F.filter(F.transform(lines, strip), lambda x: x != "")


# Writing

ORDER = ("author", "title", "journal", "volume", "number", "pages", "year", "doi", "url", "eprint", "archiveprefix", "abstract")


def build(kind: Column, key: Column, values: dict[str, Column]) -> Column:
    """An entry's text: fields in fixed order, names padded, empty ones left out."""
    lines = []
    for name in ORDER:
        if name in values:
            padded = name.ljust(9 if name == "eprint" else 10)
            lines.append(F.when(F.coalesce(values[name], F.lit("")) != "", F.concat(F.lit(f"  {padded} = {{"), values[name], F.lit("}"))))
    body = F.array_compact(F.array(*lines))
    head = F.concat(F.lit("@"), kind, F.lit("{"), key)
    return F.when(F.size(body) > 0, F.concat(head, F.lit(",\n"), F.array_join(body, ",\n"), F.lit("\n}"))).otherwise(F.concat(head, F.lit("\n}")))


def render(entries: DataFrame) -> DataFrame:
    """Each entry's text, with its closing brace always, beside its own columns. A row without type or
    key is an error."""
    text = F.concat(F.lit("@"), F.col("type"), F.lit("{"), F.col("key"), F.lit(",\n"), F.col("content"), F.lit("\n}\n"))
    ok = F.col("type").isNotNull() & F.col("key").isNotNull()
    return entries.withColumn("value", F.when(ok, text).otherwise(F.raise_error(F.lit("an entry needs a type and a key"))))


def cuts(body: str, edits: dict[str, str | None]):
    """(start, end, text): what replaces which parts of an entry's body, so that its fields become as in
    edits. Of a name given twice the last is set, since readers take that; null removes all."""
    found = list(field_spans(body))
    last = {name: k for k, (name, *_) in enumerate(found)}
    for k, (name, at, start, end) in enumerate(found):
        if name not in edits:
            continue
        value = edits[name]
        if value is None:
            stop = re.compile(r"[ \t]*,?[ \t]*").match(body, end).end()
            line = body.rfind("\n", 0, at) + 1
            if line and not body[line:at].strip() and body[stop : stop + 1] == "\n":
                at, stop = line, stop + 1
            yield at, stop, ""
        elif k == last[name]:
            quoted = body[start : start + 1] == '"' and '"' not in value
            bare = end - len(body[start:end]) + len(body[start:end].rstrip())
            yield start, bare, f'"{value}"' if quoted else f"{{{value}}}"
    new = [(name, value) for name, value in sorted(edits.items()) if value is not None and name not in last]
    if new and found:
        _, at, start, end = found[-1]
        line = body.rfind("\n", 0, at) + 1
        gap = "\n" + body[line:at] if line and not body[line:at].strip() else " "
        end = start + len(body[start:end].rstrip())
        kept = edits.get(found[-1][0], "") is not None
        # Beside a last field that goes, its comma goes too, and the new ones bring their own.
        yield end, end, "".join(f",{gap}{n} = {{{v}}}" for n, v in new) if kept else "".join(f"{n} = {{{v}}},{gap}" for n, v in new)
    elif new:
        yield 0, 0, "".join(f"\n  {n} = {{{v}}}," for n, v in new)


def spliced(text: str, edits: dict[str, dict[str, str | None]]) -> str:
    """The text with the fields of the entries that edits names changed, all else as it is."""
    out, done = [], 0
    for _, key, start, end in spans(text):
        for a, b, new in sorted(cuts(text[start:end], edits[key])) if key in edits else ():
            a = max(start + a, done)
            out += [text[done:a], new]
            done = max(start + b, a)
    return "".join([*out, text[done:]])


def splice_fields(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files(file, content) with the changes of edits(file, key, name, value) made in place: comments,
    order, layout and entries that aren't named stay byte for byte. A null value removes the field, a
    new name goes after the last field in its layout. All entries of a file that share the key are
    changed; names are the same in any case; of several edits of one field the largest value counts.
    Edits of files, or keys, that aren't there do nothing; a null content stays null; further columns
    of either table are not read. A value that would unbalance braces is an error."""
    one = edits.where("file is not null and key is not null and name is not null").select(F.col("file").cast("string").alias("file"), "key", F.lower("name").alias("name"), F.col("value").cast("string").alias("value"))
    one = one.groupBy("file", "key", "name").agg(F.max("value").alias("value"))
    asked = one.groupBy("file").agg(F.collect_list(F.struct("key", "name", "value")).alias("edits"))

    def run(batches):
        for batch in batches:
            done = []
            for text, changes in zip(batch.column("content").to_pylist(), batch.column("edits").to_pylist(), strict=True):
                by: dict = {}
                for e in changes or ():
                    if e["value"] is not None and closing(e["value"] + "}", 0, "}") != len(e["value"]):
                        raise ValueError(f"unbalanced braces in {e['name']} of {e['key']}")
                    by.setdefault(e["key"], {})[e["name"]] = e["value"]
                done.append(spliced(text, by) if text is not None and by else text)
            yield pa.record_batch({"file": batch.column("file"), "content": pa.array(done, pa.string())})

    rows = files.select(F.col("file").cast("string").alias("file"), F.col("content").cast("string").alias("content"))
    return rows.join(asked, "file", "left").mapInArrow(run, "file string, content string")


def write_bibtex(entries: DataFrame, path: str, order: tuple[str, ...] = ("file", "pos")) -> None:
    """A folder of .bib parts in the given order."""
    render(entries).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def rewrite_bibtex(entries: DataFrame, path: str, order: tuple[str, ...] = ("file", "pos")) -> None:
    """write_bibtex over a folder that entries may be read from: the new parts are complete before the
    old ones go."""
    spark = entries.sparkSession
    write_bibtex(entries, path + ".new", order)
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".new"))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{path}.new could not take the place of {path}")
