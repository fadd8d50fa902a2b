"""Main text of web pages by a consensus of the pages of a host.

1. Every page scores the generalised tag-class paths of its containers (prose less links and
   page furniture, over all elements on the path) and votes for the best ones.
2. Votes are summed per host and path in Spark. Paths that a fifth of a host's pages
   back win, the strongest first.
3. Every page is read again with its host's winning paths: its text is that of all elements
   on the first path that holds most of the prose of the page's best one, in page order.
   A path with a little less (``LEAST_WEIGHT``) is taken too if what it leaves out is one
   element that the host does not know. A page where none does, because it follows
   another template, uses its own best path.

Pages never move while the table of winners is small; beyond that size a host that owns a
third of all pages is split into shares (``join_dimension``).

Defined results: null html counts as empty and gives an empty text of 0 characters; pages
without a readable URL form a host of their own, the empty one; null ids are passed on; a page takes time and
memory in proportion to its length, whatever tags, quotes or elements it leaves open; rows
that repeat an id are each given a row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import pick
from bindery.llm.html_blocks import NAMED_WEIGHT, Page, containers, read_page, text_below
from bindery.operators.joins import join_dimension
from bindery.session import store

CLOSE_TO_BEST = 0.8
BACKING = 0.2
MOST, LEAST_WEIGHT = 0.5, 0.4


def _by_path(page: Page) -> dict[str, tuple[float, list[int]]]:
    """Score and elements of every path, elements in page order. No two of a path are nested."""
    scores: dict[str, float] = {}
    elements: dict[str, list[int]] = {}
    for score, element in containers(page):
        path = page.paths[element]
        scores[path] = scores.get(path, 0.0) + score
        elements.setdefault(path, []).append(element)
    return {path: (score, elements[path]) for path, score in scores.items()}


def _prose(page: Page, elements: list[int]) -> float:
    """Prose of elements as their score counts it."""
    return sum(page.prose[n] * (NAMED_WEIGHT if page.within[n] else 1) for n in elements)


def _one_stranger(page: Page, own: list[int], elements: list[int], paths: list[str]) -> bool:
    """Whether what ``own`` holds beyond ``elements`` lies in a single element that no winning path leads to."""
    rest = sum(page.prose[n] for n in own) - sum(page.prose[n] for n in elements)
    inside = (n for a in own for n in range(a + 1, page.last[a] + 1))
    return any(page.prose[n] >= rest and page.paths[n] not in paths and not any(n <= e <= page.last[n] for e in elements) for n in inside)


def votes(html: str) -> list[tuple[str, float]]:
    """Paths of the page that come close to its best, each once, with their share of it."""
    scored = _by_path(read_page(html))
    top = max((score for score, _ in scored.values()), default=0.0)
    if top <= 0:
        return []
    return [(path, score / top) for path, (score, _) in scored.items() if score >= CLOSE_TO_BEST * top]


def extract(html: str, paths: list[str]) -> tuple[str, str]:
    """Main text and the path it was found by."""
    page = read_page(html)
    scored = _by_path(page)
    if not scored:
        return "", ""
    best = max(scored, key=lambda path: (scored[path][0], scored[path][1]))  # of equal ones the innermost
    own = scored[best][1]
    prose = _prose(page, own)
    for path in paths:
        score, elements = scored.get(path, (0.0, []))
        held = _prose(page, elements)
        if score > 0 and (held >= MOST * prose or held >= LEAST_WEIGHT * prose and _one_stranger(page, own, elements, paths)):
            return text_below(page, *elements), path
    return text_below(page, *own), best


def host(url):
    """Lower-case host name of a URL, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, paths``: the paths that win on each host, the strongest first."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            out = []
            for name, html in zip(frame.column(0), frame.column(1)):
                out += [(name.as_py(), path, vote) for path, vote in votes(html.as_py() or "")]
            columns = list(zip(*out)) or [(), (), ()]
            kinds = (pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "path", "vote"])

    rows = pick(pages, url=(url_col, "string"), html=(html_col, "string")).select(host(F.col("url")).alias("host"), "html")
    counted = rows.mapInArrow(run, "host string, path string, vote double").groupBy("host", "path").agg(F.sum("vote").alias("votes"), F.count(F.lit(1)).alias("pages"))
    counted = store(counted, "path-votes")
    most = counted.groupBy("host").agg(F.max("pages").alias("most"))
    backed = counted.join(most, "host").where(F.col("pages") >= F.lit(BACKING) * F.col("most"))
    ranked = F.sort_array(F.collect_list(F.struct("votes", F.length("path").alias("depth"), "path")), asc=False)
    return backed.groupBy("host").agg(ranked.getField("path").alias("paths"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, path`` for every row."""
    winners = store(winning_paths(pages, url_col, html_col), "winning-paths")
    rows = pick(pages, page_id=id_col, url=(url_col, "string"), html=(html_col, "string")).withColumn("host", host(F.col("url")))
    joined = join_dimension(rows, winners, ["host"], spread_by=["page_id", "url"], weight=F.length("html"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            found = [extract(h.as_py() or "", p.as_py() or []) for h, p in zip(frame.column(2), frame.column(3))]
            columns = [frame.column(0), frame.column(1), pa.array([t for t, _ in found], pa.string()), pa.array([p for _, p in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "path"])

    kind = rows.schema["page_id"].dataType.simpleString()
    out = joined.select("page_id", "url", "html", "paths").mapInArrow(run, f"page_id {kind}, url string, text string, path string")
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "path")


def op3_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
