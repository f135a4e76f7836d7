"""Reading poem volumes, name lists, corpora, graphs and crawl records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.text import strip

# Fixed formats: file names, headers, markers and rules of a volume file and of a name list.
TITLE = "全唐詩"
PREFIX = "全唐詩_第"
AUTHOR, CONTENT, UNKNOWN = "作者:", "內容:", "未知作者"
RULE = "-" * 30
#: What keeps the dashes of a field from being a rule in a volume: it follows the 29th of a run.
JOINER = "\u2060"
LIST_HEADERS = ("全唐詩", "=", "總計", "注意")
POEM = T.StructType([T.StructField("title", T.StringType()), T.StructField("volume", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("author", T.StringType())])
GRAPH = "metadata struct<total_nodes:long,total_edges:long>, nodes array<struct<id:string,weight:long,size:double>>, edges array<struct<source:string,target:string,weight:long>>"
FAILURES = "failed_volumes array<struct<volume:int,status:string,description:string,original_status:string>>, total_failed long"


def _sections(found: DataFrame) -> DataFrame:
    """What a scan with the rule as line separator has read, with the place of each section in its file."""
    at = F.struct(F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return found.select("*", F.col("_metadata.file_path").alias("path"), at.alias("at"))


def volume_sections(spark: SparkSession, folder: str) -> DataFrame:
    """(file, volume, at, section) of the volume files of a folder, a row for each section; ``at`` has their order within a file.

    Rules end records of the scan, so Spark splits a file of any length between its tasks and no row holds a file.
    """
    found = _sections(spark.read.option("pathGlobFilter", f"{PREFIX}*.txt").option("lineSep", RULE).text(folder))
    # the name in a path is percent-encoded; plus signs are plain there
    name = F.try_url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    return found.select(name.alias("file"), volume_number(name).alias("volume"), "at", F.col("value").alias("section"))


def volume_folders(spark: SparkSession, folder: str) -> DataFrame:
    """(file, volume, at, section) of volumes as ``writers.write_volumes`` leaves them: a folder for each, which may have several files."""
    found = _sections(spark.read.schema("value string, volume int").option("lineSep", RULE).text(folder))
    return found.select(F.format_string("volume=%d", "volume").alias("file"), "volume", "at", F.col("value").alias("section"))


def volume_number(file: Column) -> Column:
    n = F.regexp_extract(file, f"{PREFIX}(\\d+)卷", 1)
    return F.when(n == "", 0).otherwise(F.try_to_number(n, F.lit("999999999")).cast("int"))


def without_rules(field: Column) -> Column:
    """A field of a poem as it can stand in a volume: a joiner more after 29 dashes that another dash or a joiner follows."""
    return F.regexp_replace(field, f"-{{29}}(?:(?=-)|{JOINER}+)", f"$0{JOINER}")


def _with_rules(section: Column) -> Column:
    return F.regexp_replace(section, f"(-{{29}}{JOINER}*){JOINER}", "$1")


def parse_written(sections: DataFrame, drop_header_section: bool = True) -> DataFrame:
    """(title, volume, content, author, file, at) of sections that ``writers.write_volumes`` has written, as it got them.

    Every line has its place there, so white space, blank fields, rules and marks within a field are its own, which ``parse_sections`` can't
    know of published files.  An unknown author is null; titles and authors are one line.
    """
    body = F.ltrim(F.col("section"), F.lit("\n"))
    if drop_header_section:
        sections = sections.where(~F.startswith(body, F.lit(TITLE)))
    else:
        body = F.regexp_replace(body, f"\\A{TITLE} 第[^\\n]*\\n=+\\n\\n", "")
    section = sections.withColumn("lines", F.split(_with_rules(body), "\n", 4)).where(F.size("lines") == 4)
    own, text = F.substr(F.col("lines")[1], F.lit(len(f"   {AUTHOR} ") + 1)), F.col("lines")[3]
    content = F.substr(text, F.lit(1), F.length(text) - 1)  # less the end of its last line
    return section.select(F.col("lines")[0].alias("title"), "volume", content.alias("content"), F.nullif(own, F.lit(UNKNOWN)).alias("author"), "file", "at")


def parse_sections(sections: DataFrame, drop_header_section: bool = True) -> DataFrame:
    """(title, volume, content, author, file, at) of sections (file, volume, at, section).

    Sections end at a rule.  A section's first line is the title (its number stays), the first later line with the author mark
    has the author, and what follows the first content mark is the content.  Sections without a title or an author are left out.
    The header of a volume stands in its first section, so that section's poem is lost; with ``drop_header_section=False`` a
    header's lines go first and the poem is kept.
    """
    body = _with_rules(F.col("section"))
    if not drop_header_section:
        body = F.regexp_replace(body, f"(?s)\\A\\s*{TITLE}[^\\n]*\\n=+\\s*", "")
    section = sections.withColumn("lines", F.split(strip(body), "\n")).where(F.size("lines") >= 3)
    rest = F.slice("lines", 2, F.size("lines"))
    title = strip(F.col("lines")[0])
    named = F.filter(rest, lambda s: F.contains(s, F.lit(AUTHOR)))
    author = strip(F.split(F.get(named, F.lit(0)), AUTHOR)[1])
    marked = F.array_position(F.transform(rest, lambda s: F.contains(s, F.lit(CONTENT))), True).cast("int")  # 0 where there is no content
    after = F.filter(F.slice(rest, marked + 1, F.size("lines")), lambda s: ~F.contains(s, F.lit(CONTENT)))
    content = F.when(marked > 0, F.array_join(F.transform(after, lambda s: F.concat(s, F.lit("\n"))), "")).otherwise("")
    out = section.select(title.alias("title"), "volume", content.alias("content"), author.alias("author"), "file", "at")
    return out.where((F.col("title") != "") & ~F.startswith("title", F.lit(TITLE)) & (F.coalesce("author", F.lit("")) != ""))


def read_volumes(spark: SparkSession, folder: str, drop_header_section: bool = True) -> DataFrame:
    return parse_sections(volume_sections(spark, folder), drop_header_section)


def scan_authors(sections: DataFrame, text: str = "section", parity: bool = True) -> DataFrame:
    """(author): every author mark of the texts, one row each; with ``parity`` an empty mark takes the next line as the name."""
    gap = r"\s*" if parity else r"[ \t]*"
    found = F.regexp_extract_all(F.col(text), F.lit(f"{AUTHOR}{gap}(.+?)(?:\n|\\z)"), F.lit(1))
    return sections.select(F.explode(F.transform(found, strip)).alias("author")).where(~F.col("author").isin("", UNKNOWN))


def read_names(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """(name) of a numbered name list, without its headers; each once, of ``least`` characters or more."""
    line = strip(F.col("value"))
    rows = spark.read.text(path).select(line.alias("line")).where("line <> ''")
    for h in LIST_HEADERS:
        rows = rows.where(~F.startswith("line", F.lit(h)))
    name = F.when(F.contains("line", F.lit(". ")), strip(F.regexp_extract("line", r"(?s)^.*?\. (.*)$", 1))).otherwise(F.col("line"))
    return rows.select(name.alias("name")).where(F.length("name") >= least).distinct()


def read_quoted_names(spark: SparkSession, path: str) -> DataFrame:
    """(name): what stands in single quotes in a file of code."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit("'([^']+)'"), F.lit(1))).alias("name"))


def _json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException:
        return None


def read_corpus(spark: SparkSession, path: str, volumes: str | None = None) -> DataFrame:
    """Poems of a corpus object, or of the volume files where there is none.

    The object stands in one file, or line by line in a folder (see ``reports``), which is read in parallel.  One without poems is an error.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        if volumes is None:
            raise FileNotFoundError(path) from None
        return read_volumes(spark, volumes).select("title", "volume", "content", "author")
    if lines.where(F.startswith("value", F.lit('{"metadata"')) & F.endswith("value", F.lit('"poems": ['))).isEmpty():
        found = spark.read.schema(T.StructType([T.StructField("poems", T.ArrayType(POEM))])).json(path, multiLine=True)
        if found.where("poems IS NOT NULL").isEmpty():
            raise ValueError(f"no poems in {path}")
        return found.select(F.explode("poems").alias("p")).select("p.*")
    poems = lines.select(F.regexp_replace("value", "^,", "").alias("v")).where(F.startswith("v", F.lit('{"title"')))
    return poems.select(F.explode(F.from_json(F.concat(F.lit("["), F.col("v"), F.lit("]")), T.ArrayType(POEM))).alias("p")).select("p.*")


def _members(lines: DataFrame, first: str, kind: str) -> DataFrame:
    """The objects of a list that stands line by line, of those whose first field is ``first``."""
    own = lines.select(F.regexp_replace("value", "^,", "").alias("v")).where(F.startswith("v", F.lit(f'{{"{first}"')))
    return own.select(F.from_json("v", kind).alias("x")).select("x.*")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, weight, size) and edges (src, dst, weight) of a graph object, the edges with src < dst; it stands in one file, or line by line in a folder."""
    lines = spark.read.text(path)
    if lines.where(F.startswith("value", F.lit('{"metadata"')) & F.endswith("value", F.lit('"nodes": ['))).isEmpty():
        g = spark.read.schema(GRAPH).json(path, multiLine=True)
        nodes, edges = g.select(F.explode("nodes").alias("n")).select("n.*"), g.select(F.explode("edges").alias("e")).select("e.*")
    else:
        nodes, edges = _members(lines, "id", "id string, weight long, size double"), _members(lines, "source", "source string, target string, weight long")
    return nodes, edges.select(F.least("source", "target").alias("src"), F.greatest("source", "target").alias("dst"), "weight")


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Failed volumes; none if there is no file, or it can't be read."""
    kind = "volume int, status string, description string, original_status string"
    found = _json(spark, path, FAILURES)
    if found is None:
        return spark.createDataFrame([], kind)
    lines = spark.read.text(path)
    if not lines.where(F.col("value") == '{"failed_volumes": [').isEmpty():
        return _members(lines, "volume", kind)
    return found.select(F.explode("failed_volumes").alias("f")).select("f.*")


def read_catalog(spark: SparkSession, titles: str, details: str) -> DataFrame:
    """The catalog of a saved title list ({"books": [{title, urn}]}) and saved details (a line {urn, json} each)."""
    from ..operators.catalog import rows

    books = spark.read.schema("books array<struct<title:string,urn:string>>").json(titles, multiLine=True)
    listed = books.select(F.posexplode("books").alias("i", "b")).select((F.col("i") + 1).alias("ord"), "b.title", "b.urn")
    return rows(listed, spark.read.schema("urn string, json string").json(details))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(file, html) of saved pages, and what the names of their folders tell (<name>=<value>)."""
    found = spark.read.text(folder, wholetext=True)
    told = [c for c in found.columns if c != "value"]
    return found.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("html"), *told)


def read_page_lines(spark: SparkSession, folder: str, key: str, kind: str = "long") -> DataFrame:
    """(key, html) of pages as ``writers.write_page_lines`` leaves them; Spark splits files of any length between its tasks."""
    return spark.read.schema(f"`{key}` {kind}, html string").option("mode", "FAILFAST").json(folder)
