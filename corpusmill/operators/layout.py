"""From the spans of laid-out pages to running text.

Input rows: doc_id, page, block, line, span (all from 0), text, size (in halves), bold, x0, x1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.language import Languages

# Headings of what follows the text, marks of cover pages, lines of contents, keywords.
BACK_MATTER = (
    r"(?i)^(?:[\dIVX]+(?:\.\d+)*\.?\s*)?(?:Literatur(?:verzeichnis)?|Literatur-\s?und\s?Quellenverzeichnis|Quellen(?:verzeichnis)?|"
    r"Quellen-\s?und\s?Literaturverzeichnis|Bibliogra(?:ph|f)ie|References|Bibliography|Verwendete\s+Literatur|Zitierte\s+Literatur|"
    r"Anhang|Anhänge|Appendix|Anmerkungen|Endnoten|Register|Sachregister|Personenregister|Index)\s*:?$"
)
COVER_MARKERS = ("nutzungsbedingungen", "terms of use", "empfohlene zitierung", "suggested citation", "zur verfügung gestellt in kooperation mit")
TOC_LINE = r"(?:\.\s?){4,}\s*\d+\s*$|…+\s*\d+\s*$"
TOC_ENTRY = r"^(?:\d+(?:\.\d+)*\.?|[IVX]+\.)\s+\D{3,120}?\s\d{1,4}$"
KEYWORDS = r"(?i)^(?:Schlagw[oö]rte?|Stichw[oö]rte?r?|Keywords?|Key words|JEL)\s*:"


def line_text(spans: Column) -> Column:
    """The spans (text, size, x0, x1) of a line in order, with a space where a gap shows."""
    start = F.struct(F.lit("").alias("t"), F.lit(None).cast("double").alias("x"))

    def add(acc: Column, s: Column) -> Column:
        gap = (acc["t"] != "") & (s["x0"] - acc["x"] > s["size"] * 0.15) & ~F.substring(acc["t"], -1, 1).rlike(r"(?U)\s") & ~F.substring(s["text"], 1, 1).rlike(r"(?U)\s")
        return F.struct(F.concat(acc["t"], F.when(F.coalesce(gap, F.lit(False)), " ").otherwise(""), s["text"]).alias("t"), s["x1"].alias("x"))

    return F.aggregate(spans, start, add, lambda a: a["t"])


def join_lines(lines: Column) -> Column:
    """Lines as a paragraph; a word that a hyphen broke is joined unless a compound goes on."""
    stays = F.array(*map(F.lit, T.HYPHEN_STAYS))

    def add(acc: Column, line: Column) -> Column:
        word = F.regexp_extract(line, r"(?U)^(\S+)", 1)
        broken = acc.rlike("[A-Za-zÄÖÜäöüß]-$") & word.rlike(r"(?U)^\p{Ll}") & ~F.array_contains(stays, F.regexp_replace(F.lower(word), "[,.;:]+$", ""))
        return F.when(line == "", acc).when(acc == "", line).when(broken, F.concat(F.substr(acc, F.lit(1), F.length(acc) - 1), line)).otherwise(F.concat(acc, F.lit(" "), line))

    return F.aggregate(F.transform(lines, T.strip), F.lit(""), add)


def body_size(spans: DataFrame) -> DataFrame:
    """(doc_id, body_size): the size that most characters have; ties go to the first seen."""
    # a span's place as one number, which is aggregated by hash; of structs, all spans of a task would be sorted
    page, block, line, span = (F.col(c).cast("long") for c in ("page", "block", "line", "span"))
    upper, lower = page * 2**31 + block, line * 2**31 + span
    place = upper.cast("decimal(19,0)") * F.lit(2**62).cast("decimal(19,0)") + lower.cast("decimal(19,0)")
    sizes = spans.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("chars"), F.min(place).alias("first"))
    return sizes.groupBy("doc_id").agg(F.min_by("size", F.struct((-F.col("chars")).alias("c"), "first")).alias("body_size"), F.sum("chars").alias("chars"))


def lines_of(spans: DataFrame) -> DataFrame:
    """A row per line: its whole text, its text in the body's size, and whether that is all bold."""
    s = spans.where(F.trim("text") != "")
    # a hash join holds a narrow row for each document of a task; a merge join would sort all its spans
    s = s.join(body_size(s).select("doc_id", "body_size").hint("shuffle_hash"), "doc_id")
    own = F.struct("span", "text", "size", "x0", "x1", "bold")
    g = s.groupBy("doc_id", "page", "block", "line").agg(F.array_sort(F.collect_list(own)).alias("all"), F.first("body_size").alias("body_size"))
    body = F.filter("all", lambda x: F.abs(x["size"] - F.col("body_size")) <= 0.5)
    return g.select("doc_id", "page", "block", "line", T.strip(line_text(F.col("all"))).alias("full"), T.strip(line_text(body)).alias("kept"), (F.size(body) > 0).alias("has_body"), F.forall(body, lambda x: x["bold"]).alias("bold"))


def repeated_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, low): lines on at least a quarter of the pages, and on three, of five pages or more."""
    g = lines.groupBy("doc_id", F.lower("full").alias("low")).agg(F.countDistinct("page").alias("n")).join(pages, "doc_id")
    return g.where((F.col("n_pages") >= 5) & (F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("n_pages") * 0.25))) & (F.length("low") <= 120)).select("doc_id", "low")


def pdf_status(files: DataFrame, most_mb: int = 100, most_pages: int = 400) -> Column:
    """A reason to skip a file (columns length, head, encrypted, n_pages, chars), or null."""
    return (
        F.when(F.col("length") > most_mb * 1024 * 1024, "pdf_too_large")
        .when(F.col("head") != "%PDF", "pdf_not_a_pdf")
        .when(F.col("encrypted"), "pdf_encrypted")
        .when(F.col("n_pages") > most_pages, "pdf_too_many_pages")
        .when(F.coalesce("chars", F.lit(0)) < 20 * F.greatest(F.lit(1), F.col("n_pages")), "pdf_no_text_layer")
    )


def paragraphs(spans: DataFrame, n_pages: DataFrame, languages: Languages | None = None) -> DataFrame:
    """(doc_id, para, paragraph) after covers, back matter, contents, running heads, notes and
    headings are gone, and paragraphs that go on across a page are joined. `languages` judges
    paragraphs of 25 words or more: those of another language go."""
    lines = lines_of(spans)
    blocks = lines.groupBy("doc_id", "page", "block").agg(F.array_sort(F.collect_list(F.struct("line", "full"))).alias("ls")).select("doc_id", "page", "block", F.transform("ls", lambda x: x["full"]).alias("fulls"))
    page_text = blocks.groupBy("doc_id", "page").agg(F.lower(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "fulls"))), lambda b: b["fulls"])), " ")).alias("t"))
    marks = sum(F.contains("t", F.lit(m)).cast("int") for m in COVER_MARKERS)
    covers = page_text.where((F.col("page") < 2) & (marks >= 2)).select("doc_id", "page")
    b = blocks.join(n_pages, "doc_id").join(covers, ["doc_id", "page"], "left_anti")
    whole = T.strip(F.array_join("fulls", " "))
    b = b.withColumn("back", (F.col("page") >= F.col("n_pages") * 0.4) & whole.rlike(BACK_MATTER))
    b = b.withColumn("stop", F.min(F.when(F.col("back"), F.struct("page", "block"))).over(Window.partitionBy("doc_id")))
    b = b.where(F.col("stop").isNull() | (F.struct("page", "block") < F.col("stop")))
    numbered = F.size(F.filter("fulls", lambda x: x.rlike(r"\d+\s*$")))
    b = b.where(~F.exists("fulls", lambda x: x.rlike(TOC_LINE)) & ~((F.size("fulls") >= 3) & (F.try_divide(numbered, F.size("fulls")) >= 0.5)))
    body = lines.join(b.select("doc_id", "page", "block"), ["doc_id", "page", "block"], "left_semi")
    rep = repeated_lines(lines, n_pages)
    body = body.where("has_body and kept <> ''").join(rep, (body["doc_id"] == rep["doc_id"]) & (F.lower("full") == rep["low"]), "left_anti")
    body = body.where(~(F.col("bold") & ~F.col("kept").rlike("[.!?:]$")))
    p = body.groupBy("doc_id", "page", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "kept"))), lambda x: x["kept"]).alias("ls"))
    text = T.clean_pdf_paragraph(F.replace(T.clean_whitespace(join_lines(F.col("ls"))), F.lit("\n"), F.lit(" ")))
    p = p.select("doc_id", "page", "block", F.regexp_replace(text, r"^[\[(]\d{1,3}[\])]\s+", "").alias("t")).where("t <> ''")
    n = T.word_count(F.col("t"))
    p = p.where(~F.col("t").rlike(KEYWORDS) & ~((n < 8) & ~F.col("t").rlike("[.!?:]$")))
    if languages is not None:
        p = p.where((n < 25) | languages.not_other(F.when(n >= 25, F.col("t"))))
    order = Window.partitionBy("doc_id").orderBy("page", "block")
    goes_on = ~F.lag("t").over(order).rlike("[.!?:;\"“”»)]$") & F.col("t").rlike(r"(?U)^\p{Ll}")
    p = p.withColumn("para", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order))
    q = p.groupBy("doc_id", "para").agg(F.array_sort(F.collect_list(F.struct("page", "block", "t"))).alias("x"))
    q = q.select("doc_id", "para", F.when(F.size("x") > 1, T.clean_pdf_paragraph(join_lines(F.transform("x", lambda v: v["t"])))).otherwise(F.get("x", F.lit(0))["t"]).alias("paragraph"))
    return q.where(~((T.word_count(F.col("paragraph")) < 15) & ~F.col("paragraph").rlike("[.!?:;\"“”»)]$")) & ~F.col("paragraph").rlike(TOC_ENTRY))


def document_text(spans: DataFrame, n_pages: DataFrame, languages: Languages | None = None) -> DataFrame:
    """(doc_id, text, skip_reason): the cleaned text of each document, or why there is none."""
    p = paragraphs(spans, n_pages, languages).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "paragraph"))), lambda x: x["paragraph"]), "\n\n").alias("t"))
    size = spans.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"))
    j = n_pages.join(size, "doc_id", "left").join(p, "doc_id", "left").withColumn("text", T.clean_plain_text(F.col("t")))
    why = F.when(F.coalesce("chars", F.lit(0)) < 20 * F.greatest(F.lit(1), F.col("n_pages")), "pdf_no_text_layer").when(F.col("text") == "", "pdf_no_body_text")
    return j.select("doc_id", F.when(why.isNull(), F.col("text")).alias("text"), why.alias("skip_reason"))
