"""URL filters: longest-rule verdicts, and block decisions that spread over redirect and canonical-link equivalence."""

from __future__ import annotations

import html as html_entities
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.spread import connected_components, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark, number sign or the end, A-Z lower-cased; else empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    raw = F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(raw, UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, number sign or the end; empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def alias_key(url: Column) -> Column:
    """One number for the spellings of an address that always serve the same page: scheme and fragment are left out. Null
    without a host."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    query = F.regexp_extract(F.substr(url, at + 3), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.xxhash64(host_of(url), path_of(url), query))


def rule_for(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule; null without one. The rules are a list in the program, so the
    test is a chain of conditions in the scan's own stage; of equally long rules, allow goes first."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict != "block", r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


#: An address is matched possessively: giving its characters back one by one would take the square of a long one's length.
CANONICAL = (r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical["']?[^>]*\bhref\s*=\s*["']?([^"'\s>]++)""", r"""(?i)<link\b[^>]*\bhref\s*=\s*["']?([^"'\s>]++)["']?[^>]*\brel\s*=\s*["']?canonical\b""")
REFRESH = (r"""(?i)<meta\b[^>]*?\bhttp-equiv\s*=\s*["']?refresh["']?[^>]*?\burl\s*=\s*["']?([^"'\s>]++)""", r"""(?i)<meta\b[^>]*?\burl\s*=\s*["']?([^"'\s>]++)["']?[^>]*\bhttp-equiv\s*=\s*["']?refresh\b""")
BASE = r"""(?i)<base\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]++)"""
ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def without_dots(path: str) -> str:
    """A rooted path without its ``.`` and ``..`` segments (RFC 3986, 5.2.4)."""
    parts, out = path.split("/")[1:], []
    for x in parts:
        if x == "..":
            del out[-1:]
        elif x != ".":
            out.append(x)
    return "/" + "/".join(out + [""] * (parts[-1] in (".", "..") and bool(out)))


def resolve(base: str, link: str) -> str | None:
    """The address that a link on a page of address ``base`` names; null if it has no host."""
    link = ENTITY.sub(lambda m: html_entities.unescape(m[0]), link)
    if SCHEME.match(link):
        return link if "://" in link else None
    scheme, found, rest = base.partition("://")
    if not found:
        return None
    if link.startswith("//"):
        return f"{scheme}:{link}"
    host, path, query = re.match(r"([^/?#]*)([^?#]*)(\?[^#]*)?", rest).groups("")
    own, asked = re.match(r"([^?#]*)(\?[^#]*)?", link).groups()
    if own:
        path, query = without_dots(own if own[0] == "/" else (path.rpartition("/")[0] + "/" + own)), asked or ""
    elif asked is not None:
        query = asked
    return f"{scheme}://{host}{path}{query}"


def resolved(batches):
    """(source_url, base, t) -> (source_url, target_url)."""
    for b in batches:
        source, base, t = (b.column(i).to_pylist() for i in range(3))
        target = [resolve((resolve(s, x) if x else s) or s, y) for s, x, y in zip(source, base, t, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(target, pa.string())], names=["source_url", "target_url"])


def links_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """All redirect and canonical links that pages state: ``(source_url, target_url)``, absolute, or relative to the page's address or its
    ``<base>``. Entities that end in a semicolon are decoded."""
    h = F.col(html)
    found = F.concat(*(F.regexp_extract_all(h, F.lit(p), 1) for p in (*CANONICAL, *REFRESH)))
    some = pages.where(F.col(url).isNotNull() & h.rlike(r"(?i)\b(?:canonical|http-equiv)\b")).select(F.col(url).alias("source_url"), F.regexp_extract(h, BASE, 1).alias("base"), F.explode(F.array_distinct(F.filter(found, lambda x: x != ""))).alias("t"))
    return some.mapInArrow(resolved, "source_url string, target_url string").where("target_url IS NOT NULL")


def filter_urls(pages: DataFrame, rules: list[Rule], links: DataFrame | None = None, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages``.

    A page that a rule fits has the rule's verdict. Another is blocked if a page that redirect or canonical links join
    it to, over any number of steps, is blocked by a rule and none of those is allowed by one (an explicit allow goes before). Else it is
    allowed. ``links(source_url, target_url)``: further links, such as a crawler's redirects. Linked addresses that are
    no rows of ``pages`` count too. A null url, or one without ``://``, has an empty host and path and no links. Repeated rows each get the row's verdict. No rows give no rows.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, verdict = rule_for(rules, F.col("host"), F.col("path"))
    base = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), alias_key(F.col(url)).alias("__key")).withColumns({"rule": rule, "__said": verdict})
    stated = links_of(pages, url, html) if html in pages.columns else None
    if links is not None:
        stated = links.select("source_url", "target_url") if stated is None else stated.unionByName(links.select("source_url", "target_url"))
    if stated is not None:
        stated = settle(stated.distinct())
        edges = stated.select(alias_key(F.col("source_url")).alias("a"), alias_key(F.col("target_url")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
        ends = stated.select(F.explode(F.array("source_url", "target_url")).alias("u")).distinct()
        ends = ends.select(alias_key(F.col("u")).alias("node"), host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
        ends = ends.select("node", rule_for(rules, F.col("host"), F.col("path"))[1].alias("said"))
        groups = settle(connected_components(edges))
        blocked = ends.join(groups, "node").groupBy("component").agg((F.bool_or(F.coalesce(F.col("said") == "block", F.lit(False))) & ~F.bool_or(F.coalesce(F.col("said") == "allow", F.lit(False)))).alias("blocked")).where("blocked")
        nodes = groups.join(blocked, "component").select(F.col("node").alias("__key"), F.lit("block").alias("__spread")).distinct()
        base = base.join(nodes, "__key", "left")
    else:
        base = base.withColumn("__spread", F.lit(None).cast("string"))
    return base.select("page_id", "host", "path", "rule", F.coalesce("__said", "__spread", F.lit("allow")).alias("verdict"))
