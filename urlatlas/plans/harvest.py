"""Whole harvest: seeds + link table + fetched pages -> documents, frontier, rejects, counters."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, List, Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.documents import conform_or_reject, ok_pages, page_documents
from ..operators.frontier import expand
from ..operators.stats import sink_stats
from ..operators.util import cut_lineage, with_url_key
from ..spec import HarvestSpec


@dataclass
class HarvestResult:
    documents: DataFrame      # accepted URL documents of reached, fetched pages
    nodes: DataFrame          # every reached URL: url_hash, url, depth, referrer
    unfetched: DataFrame      # reached URLs with no page in the page table (next work)
    rejected: DataFrame       # records that failed the store checks, with reason
    stats: DataFrame          # processed / dropped / errors
    level_sizes: List[int]


def harvest(pages: DataFrame, links: DataFrame, seeds: DataFrame, spec: HarvestSpec = HarvestSpec(),
            now=None, on_documents: Optional[Callable[[DataFrame], DataFrame]] = None) -> HarvestResult:
    """Replay a harvest over tables: expand from the seeds, then turn every
    reached page into a URL document (depth and referrer from the walk,
    keywords from ``spec.keywords``). ``on_documents`` is the per-document
    hook: any ``DataFrame -> DataFrame`` applied before the store checks.
    """
    bfs = expand(seeds, links, spec)
    nodes = bfs.nodes
    fetched = ok_pages(pages)
    # keys first, page contents last: non-null keys ('' for a URL that does not
    # canonicalise) get no inferred filter that would recompute the canonical URL
    keyed = with_url_key(fetched.select("page_id", "url"), "url", "_n", "url_hash", algo=spec.hash_algo,
                         empty_for_invalid=True).drop("_n")
    # one page per canonical URL: the smallest page id (a plain min of two columns)
    first = (keyed.groupBy("url_hash").agg(F.min(F.struct("page_id", "url")).alias("_p"))
             .select("url_hash", F.col("_p.page_id").alias("page_id"), F.col("_p.url").alias("url")))
    reached = cut_lineage(first.join(nodes.select("url_hash", "depth", "source_url"), "url_hash")
                          .select("page_id", "url", "depth", "source_url"))
    docs = page_documents(fetched.join(reached, ["page_id", "url"]), spec.keywords, now, hash_algo=spec.hash_algo)
    if on_documents is not None:
        docs = docs.transform(on_documents)
    accepted, rejected = conform_or_reject(docs, now)
    unfetched = nodes.join(first.select("url_hash"), "url_hash", "left_anti")
    return HarvestResult(accepted, nodes, unfetched, rejected, sink_stats(docs), bfs.level_sizes)
