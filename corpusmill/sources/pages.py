"""Links of web pages, scored, as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def absolute(base, href):
    """A link made absolute: whole, scheme-less, root-relative, or relative to the page's folder."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(?:/.*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, href, label): the anchors of each page."""
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))
    a = pages.select("page_id", "url", F.explode(anchors).alias("a"))
    label = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("a", r"(?s)<[^>]*>", " "), r"\s+", " "), r"^\s+|\s+$", "")))
    return a.select("page_id", "url", F.regexp_extract("a", r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"']", 1).alias("href"), label.alias("label"))


def score(href, label):
    low = F.lower(href)
    hit = lambda c, terms: F.greatest(*[F.contains(c, F.lit(t)) for t in terms])
    pdf = F.when(F.contains(low, F.lit(".pdf")), 3).otherwise(0)
    named = F.when(hit(label, ("volltext", "download", "full text", "pdf")), 3).otherwise(0)
    cover = F.when(hit(low, ("cover", "deckblatt", "titelblatt")), -10).otherwise(0)
    return pdf + named + cover


def find_pdf_url(pages: DataFrame, must_contain: tuple[str, ...] = (".pdf", "bitstream")) -> DataFrame:
    """(page_id, pdf_url, score): the declared full text, else the link of highest (score, address)."""
    low = F.lower("href")
    fits = F.contains(low, F.lit(must_contain[0]))
    for term in must_contain[1:]:
        fits = fits | F.contains(low, F.lit(term))
    c = links(pages).where(fits).select("page_id", F.struct(score(F.col("href"), F.col("label")).alias("score"), absolute(F.col("url"), F.col("href")).alias("url")).alias("s"))
    best = c.groupBy("page_id").agg(F.max("s").alias("s"))
    meta = F.regexp_extract("html", r"(?is)<meta\b(?=[^>]*\bname\s*=\s*[\"']citation_pdf_url[\"'])[^>]*\bcontent\s*=\s*[\"']([^\"']+)[\"']", 1)
    declared = pages.select("page_id", F.when(meta != "", absolute(F.col("url"), meta)).alias("declared"))
    return declared.join(best, "page_id", "left").select("page_id", F.coalesce("declared", "s.url").alias("pdf_url"), F.when(F.col("declared").isNull(), F.col("s.score")).alias("score"))


def record_pdf_url(identifiers, host: str):
    """A struct (pdf, landing): the first direct file on the host, else the landing page to look at."""
    direct = F.try_element_at(F.filter(identifiers, lambda x: F.lower(x).endswith(".pdf") & F.contains(x, F.lit(host))), F.lit(1))
    landing = F.try_element_at(F.filter(identifiers, lambda x: F.contains(x, F.lit(host)) & x.startswith("http") & ~F.contains(x, F.lit("/pdf/"))), F.lit(1))
    return F.struct(direct.alias("pdf"), F.coalesce(direct, landing).alias("landing"))
