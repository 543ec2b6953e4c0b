"""Link graph, scope, frontier and manifest."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import column, host_key, is_page_url, normalize_url, origin, output_file, template_key


def in_scope(rows: DataFrame, starts: DataFrame, url_col: str = "url", scope: str = "same_domain") -> DataFrame:
    """Rows whose URL is on the host (less www.) of a start URL, or of its origin. starts: (url)."""
    key = {"same_domain": host_key, "same_origin": origin}[scope]
    hosts = starts.select(key(normalize_url("url")).alias("_host")).distinct()
    return rows.join(hosts, key(F.col(url_col)) == F.col("_host"), "left_semi")


def outside(rows: DataFrame, known: DataFrame, url_col: str = "url") -> DataFrame:
    """Rows whose URL isn't among the known ones."""
    return rows.join(known.select(F.col("url").alias("_known")).distinct(), F.col(url_col) == F.col("_known"), "left_anti")


def edges_of(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(src, pos, dst) from links (page_id, url, doc_idx) and pages (page_id, url)."""
    return links.join(pages.select("page_id", normalize_url("url").alias("src")), "page_id").select("src", F.col("doc_idx").alias("pos"), F.col("url").alias("dst"))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(url, depth) of everything reachable, by levels. Each level is a join and an anti join; lineage is cut at each."""
    seen = starts.select("url").distinct().withColumn("depth", F.lit(0))
    level, depth = seen, 0
    arcs = edges.select("src", "dst").distinct()
    while True:
        depth += 1
        level = arcs.join(level.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct().join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth))
        level = level.checkpoint() if level.sparkSession.sparkContext.getCheckpointDir() else level.cache()
        if not level.limit(1).count():
            return seen
        seen = seen.unionByName(level)


class Planner:
    """Visit order of a bounded crawl: first in, first out, with URLs of a template that has been seen often put off.

    Put-off URLs come up one at a time, only while nothing else waits. The budget bounds the walk; a page's links are
    asked for when it is visited.
    """

    def __init__(self, max_pages: int = 50, template_sample: int = 3):
        self.max_pages, self.template_sample = max_pages, template_sample

    def walk(self, starts: Iterable[str], visit: Callable[[str], Iterable[str]], template: Callable[[str], str]) -> tuple[list[str], bool]:
        """(visited URLs in order, whether nothing was left)."""
        waiting = deque(dict.fromkeys(starts))
        met, later, often, order = set(waiting), deque(), Counter(), []
        while len(order) < self.max_pages and (waiting or later):
            fresh = bool(waiting)
            url = (waiting if fresh else later).popleft()
            kind = template(url)
            if fresh and self.template_sample and often[kind] >= self.template_sample:
                later.append(url)
                continue
            often[kind] += 1
            order.append(url)
            for target in visit(url):
                if target not in met:
                    met.add(target)
                    waiting.append(target)
        return order, not (waiting or later)


def frontier(edges: DataFrame, starts: list[str], max_pages: int = 50, template_sample: int = 3) -> tuple[DataFrame, str]:
    """((url, visit_seq), status). The driver holds only the links of visited pages: they are fetched as the walk asks,
    a wave of waiting URLs at a time, and max_pages bounds how many."""
    spark = edges.sparkSession
    arcs = edges.select("src", "pos", "dst", template_key("dst").alias("kind"))
    links: dict[str, list[str]] = {}
    kinds: dict[str, str] = {r["url"]: r["kind"] for r in spark.createDataFrame([(s,) for s in starts], "url string").select("url", template_key("url").alias("kind")).collect()}

    def fetch(urls: list[str]) -> None:
        found = arcs.where(F.col("src").isin(urls)).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("pos", "dst", "kind"))).alias("out"))
        got = {r["src"]: r["out"] for r in found.collect()}
        for u in urls:
            links[u] = [o["dst"] for o in got.get(u, [])]
            kinds.update((o["dst"], o["kind"]) for o in got.get(u, []))

    while True:
        asked: list[str] = []

        def visit(url: str) -> list[str]:
            if url not in links:
                asked.append(url)  # noqa: B023
                return []
            return links[url]

        order, done = Planner(max_pages, template_sample).walk(starts, visit, kinds.__getitem__)
        if not asked:
            rows = [(u, i) for i, u in enumerate(order)]
            return spark.createDataFrame(rows, "url string, visit_seq long"), "complete" if done else "max_pages_reached"
        fetch(asked)


def manifest(visits: DataFrame, by_structure: bool = True) -> DataFrame:
    """Pages of a crawl. visits: (visit_seq, url, structural_hash, page_type, status).

    The first visit of a URL counts; of pages with one structural hash the first is the page and later ones are its
    variants, in order. A page without a hash is nobody's variant. Gives (page_no, visit_seq, url, page_type,
    structural_hash, status, variant_urls, output_file).
    """
    first = visits.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("visit_seq"))).where("_n = 1").drop("_n")
    group = F.when(F.col("structural_hash").isNotNull() & F.lit(by_structure), F.col("structural_hash")).otherwise(F.concat(F.lit("url "), F.col("url")))
    rows = first.withColumn("_group", group).groupBy("_group").agg(
        F.min(F.struct("visit_seq", "url", "page_type", "structural_hash", "status")).alias("p"), F.array_sort(F.collect_list(F.struct("visit_seq", "url"))).alias("v")
    )
    rows = rows.select("p.*", F.transform(F.slice("v", F.lit(2), F.greatest(F.size("v") - 1, F.lit(0))), lambda x: x["url"]).alias("variant_urls"))
    return rows.withColumn("page_no", F.row_number().over(Window.orderBy("visit_seq"))).withColumn("output_file", output_file("page_no", "url"))


def aliases(pages: DataFrame) -> DataFrame:
    """(url, page_url): every URL a manifest knows, its own or a variant."""
    return pages.select(F.explode(F.concat(F.array("url"), "variant_urls")).alias("alias"), F.col("url").alias("page_url")).select(F.col("alias").alias("url"), "page_url")


def remaining(pages: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Pages still to extract: not extracted, or extracted with the file (output_file) gone."""
    todo = pages.where("status <> 'extracted'")
    if files is None:
        return todo
    return todo.unionByName(pages.where("status = 'extracted'").join(files.select("output_file"), "output_file", "left_anti").select(pages.columns))


def mark(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """Manifest with the statuses of changes (url, status); a URL the manifest doesn't know raises."""
    rows = pages.join(changes.select("url", F.col("status").alias("_new")), "url", "full_outer")
    known = F.when(F.col("page_no").isNull(), F.raise_error(F.concat(F.lit("no such page: "), F.col("url")))).otherwise(F.coalesce("_new", "status"))
    return rows.withColumn("status", known).select(pages.columns)


def counts(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count("*").alias("pages_discovered"), F.count_if(F.col("status") == "extracted").alias("pages_extracted"), F.count_if(F.col("status") == "failed").alias("pages_failed"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(url, structure_changed, type_changed) between two snapshots of (url, structural_hash, page_type)."""
    b = after.select("url", F.col("structural_hash").alias("_h"), F.col("page_type").alias("_t"))
    rows = before.join(b, "url").select("url", (~F.col("structural_hash").eqNullSafe(F.col("_h"))).alias("structure_changed"), (~F.col("page_type").eqNullSafe(F.col("_t"))).alias("type_changed"))
    return rows.where("structure_changed or type_changed")


def page_targets(href: Column | str) -> Column:
    """A link's target if it is a page, else null."""
    target = normalize_url(column(href))
    return F.when(is_page_url(target), target)
