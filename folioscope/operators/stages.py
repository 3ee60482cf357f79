"""Idempotent stages and upserts: new tables are computed from old ones and a batch, then swapped in by the caller."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import urls
from folioscope.functions.dictionaries import SECTION_KEYWORDS
from folioscope.operators.catalog import PENDING, RESOLVED, top_per_group
from folioscope.operators.joins import attached, with_predecessor
from folioscope.sources.scratch import kept


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    cond = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def remaining(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows that a stage has not processed yet."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def restricted(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F8: rows of a subset of URLs."""
    return rows.join(wanted.select(*keys), list(keys), "left_semi")


def first_of(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the first in order."""
    rest = [c for c in batch.columns if c not in keys]
    picked = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col("_r").getField(c).alias(c) for c in batch.columns])


def insert_or_ignore(existing: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """K2: existing rows and the batch's rows with new keys (the first of each)."""
    return existing.unionByName(first_of(batch, keys, order).join(existing.select(*keys), list(keys), "left_anti"))


def insert_or_replace(existing: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """K4: the batch's last row of a key replaces the existing one."""
    rest = [c for c in batch.columns if c not in keys]
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    new = last.select(*[F.col(c) if c in keys else F.col("_r").getField(c).alias(c) for c in existing.columns])
    return existing.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def fill_nulls(existing: DataFrame, batch: DataFrame, keys: Sequence[str], filled: Sequence[str], order: Sequence[str]) -> DataFrame:
    """K3: old values win, nulls in the filled columns are taken from the batch; inserted tells new rows."""
    new = first_of(batch, keys, order)
    a, b = existing.alias("a"), new.alias("b")
    cond = F.col(f"a.{keys[0]}") == F.col(f"b.{keys[0]}")
    for k in keys[1:]:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    old = F.col(f"a.{keys[0]}").isNotNull()

    def value(c: str) -> Column:
        if c in keys or c in filled:
            return F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))
        return F.when(old, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))

    return a.join(b, cond, "full_outer").select(*[value(c).alias(c) for c in existing.columns], (~old).alias("inserted"))


def update_by_key(existing: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K5: columns of changes replace those of matching rows; other columns, and rows, stay. updated tells a match."""
    new = [c for c in changes.columns if c not in keys]
    marked = changes.select(*keys, F.struct(*new).alias("_c"))
    joined = existing.join(marked, list(keys), "left")
    return joined.select(*[F.when(F.col("_c").isNotNull(), F.col(f"_c.{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in existing.columns], F.col("_c").isNotNull().alias("updated"))


#: K6: allowed transitions of a sweep's status.
TRANSITIONS = {"iniciar": ("pendente", "rodando"), "concluir": ("rodando", "concluida"), "falhar": ("rodando", "falhou")}


def transition(rows: DataFrame, action: str, force: bool = False) -> DataFrame:
    """K6: compare-and-set of the status; moved tells which rows were in the state that the action starts from. force
    starts a row from any state; it means nothing to the other actions."""
    before, after = TRANSITIONS[action]
    may = F.lit(True) if force and action == "iniciar" else F.col("status") == before
    return rows.withColumns({"moved": may, "status": F.when(may, after).otherwise(F.col("status"))})


def enqueue(queue: DataFrame, batch: DataFrame, order: Sequence[str] = ("id",)) -> DataFrame:
    """K7: batch rows become pending unless their URL has a pending row (partial uniqueness)."""
    pending = queue.where(F.col("status") == PENDING).select("url")
    new = first_of(batch, ["url"], order).join(pending, "url", "left_anti").withColumn("status", F.lit(PENDING))
    return queue.unionByName(new, allowMissingColumns=True)


def decide(queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K8: (queue after the valid decisions, refused decisions with their problems).

    decisions: id, year, exclude, justification, author. Exactly one of year and exclude, both texts, pending rows only.
    """
    known = decisions.join(queue.select("id", F.col("status").alias("_s")), "id", "left")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    excludes = F.coalesce("exclude", F.lit(False))
    problems = F.filter(
        F.array(
            F.when(F.col("_s").isNull(), "inexistente"),
            F.when(F.col("_s") != PENDING, "nao_pendente"),
            F.when(F.col("year").isNotNull() == excludes, "ano_ou_exclusao"),
            F.when(F.col("year").isNotNull() & ~F.col("year").between(2019, 2026), "ano_fora_da_janela"),
            F.when(blank("justification"), "sem_justificativa"),
            F.when(blank("author"), "sem_autor"),
        ),
        lambda p: p.isNotNull(),
    )
    judged = known.withColumn("problems", problems)
    good = judged.where(F.size("problems") == 0).select("id", F.col("year").alias("decided_year"), excludes.alias("excluded"), F.lit(RESOLVED).alias("status"))
    return update_by_key(queue, good, ["id"]).drop("updated"), judged.where(F.size("problems") > 0).drop("_s")


def delete_where(rows: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """K9: (rows that stay, number of deleted ones)."""
    gone = F.coalesce(gone, F.lit(False))
    return rows.where(~gone), rows.where(gone).agg(F.count("*").alias("n"))


def sync(existing: DataFrame, wanted: DataFrame, key: str, fold: bool = True) -> DataFrame:
    """Full outer comparison by (case-insensitive) key: criado, atualizado, inalterado or ausente, and the new values."""
    k = (lambda c: F.upper(c)) if fold else (lambda c: F.col(c))
    rest = [c for c in wanted.columns if c != key]
    a = existing.select(k(key).alias("_k"), F.struct(key, *rest).alias("_a"))
    b = wanted.select(k(key).alias("_k"), F.struct(key, *rest).alias("_b"))
    joined = a.join(b, "_k", "full_outer")
    same = F.lit(True)
    for c in rest:
        same = same & F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))
    action = F.when(F.col("_a").isNull(), "criado").when(F.col("_b").isNull(), "ausente").when(same, "inalterado").otherwise("atualizado")
    return joined.select(F.coalesce(f"_a.{key}", f"_b.{key}").alias(key), *[F.coalesce(f"_b.{c}", f"_a.{c}").alias(c) for c in rest], action.alias("action"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def captures(arrivals: DataFrame) -> DataFrame:
    """Restored, alias, new version or new, for captures (portal_id, url, hash, seq) in the order they arrive.

    Restored: the URL's capture before has the same bytes. New version: it has others. Alias: the URL is new and the
    portal has these bytes already, from another URL, whose first capture it refers to. Else new.
    """
    arrivals = kept(arrivals)
    rows = with_predecessor(arrivals, "url", "seq", "hash", "_before")
    firsts = arrivals.groupBy("portal_id", "hash").agg(F.min(F.struct("seq", "url")).alias("_first"), F.count("*").alias("_n"))
    # a new URL's row comes after the first of its bytes, or is it; known URLs need no lookup
    new = attached(kept(rows.where(F.col("_before").isNull())), firsts, ["portal_id", "hash"], "_n")
    of = F.when(F.col("_first.seq") < F.col("seq"), F.col("_first.url"))
    found = new.select(*arrivals.columns, F.when(of.isNotNull(), "alias").otherwise("novo").alias("action"), of.alias("refers_to"))
    again = F.when(F.col("_before.value").eqNullSafe(F.col("hash")), "restaurado").otherwise("nova_versao")
    return rows.where(F.col("_before").isNotNull()).select(*arrivals.columns, again.alias("action"), F.lit(None).cast(arrivals.schema["url"].dataType).alias("refers_to")).unionByName(found)


def host_scope(targets: DataFrame, portals: DataFrame) -> DataFrame:
    """Portals (portal_id, urls array) whose hosts hold a URL: one, none, or several (ambiguous)."""
    hosts = portals.select("portal_id", F.explode("urls").alias("u")).select("portal_id", urls.scope_host(F.col("u")).alias("host")).distinct()
    found = targets.withColumn("host", urls.scope_host(F.col("url"))).join(hosts, "host", "left")
    counted = found.groupBy(*targets.columns).agg(F.count("portal_id").alias("n_portals"), F.min("portal_id").alias("portal_id"))
    status = F.when(F.col("n_portals") == 0, "fora_do_escopo").when(F.col("n_portals") == 1, "ok").otherwise("ambiguo")
    return counted.select(*targets.columns, "n_portals", F.when(F.col("n_portals") == 1, F.col("portal_id")).alias("portal_id"), status.alias("status"))


@dataclass(frozen=True)
class Explored:
    """found: url, class, depth, page (the first that links to it). visited: all pages ever read."""

    found: DataFrame
    visited: DataFrame


def explore(seeds: DataFrame, pages: DataFrame, max_depth: int = 3, page_cap: int | None = None, keywords: Sequence[str] = SECTION_KEYWORDS, visited: DataFrame | None = None) -> Explored:
    """Breadth-first discovery over stored pages (url, html) from seeds (url), which goes on where earlier runs ended.

    One join a level between the frontier and the pages; only links of the page's own site are followed. visited (page)
    are pages that earlier runs read: they are never read again. A page that isn't stored is a failed one and stays
    unvisited, for a later run. page_cap is the politeness limit of pages of each site in this run over all levels, taken
    in order of their URLs; more than page_cap pages of a site are cut off before any shuffle. Each level is written.
    """
    spark = pages.sparkSession
    known = pages.select(urls.canonical(F.col("url")).alias("page"), "html").where(F.col("page").isNotNull()).dropDuplicates(["page"])
    before = spark.createDataFrame([], "page string") if visited is None else visited.select("page").distinct()
    frontier = seeds.select(urls.canonical(F.col("url")).alias("page")).where(F.col("page").isNotNull()).distinct()
    planned, read = before, spark.createDataFrame([], "page string")
    taken = spark.createDataFrame([], "page string")
    found = spark.createDataFrame([], "page string, url string, class string, depth int")
    for depth in range(max_depth + 1):
        frontier = frontier.join(planned, "page", "left_anti")
        if page_cap is not None:
            seen = taken.groupBy(urls.scope_host(F.col("page")).alias("_site")).agg(F.count("*").alias("_seen"))
            near = top_per_group(frontier.withColumn("_site", urls.scope_host(F.col("page"))), ["_site"], [F.asc("page")], page_cap)
            place = F.row_number().over(Window.partitionBy("_site").orderBy("page"))
            frontier = near.withColumn("_place", place).join(seen, "_site", "left").where(F.col("_place") + F.coalesce("_seen", F.lit(0)) <= page_cap).select("page")
        frontier = kept(frontier)
        own = frontier.join(known, "page")
        level = own.select("page", F.explode(urls.links(F.col("html"))).alias("a"))
        level = level.where(urls.followable(F.col("a.href"))).select("page", F.col("a.anchor").alias("anchor"), urls.canonical(urls.resolve(F.col("page"), F.col("a.href"))).alias("url"))
        level = level.where(F.col("url").isNotNull() & (urls.scope_host(F.col("url")) == urls.scope_host(F.col("page"))))
        level = kept(level.withColumns({"class": urls.link_class(F.col("anchor"), F.col("url"), keywords), "depth": F.lit(depth)}).where(F.col("class").isNotNull()).select("page", "url", "class", "depth"))
        found, planned, taken = found.unionByName(level), planned.unionByName(frontier), taken.unionByName(frontier)
        read = read.unionByName(frontier.join(known.select("page"), "page", "left_semi"))
        frontier = level.where(F.col("class") == "secao").select(F.col("url").alias("page")).distinct()
        if level.isEmpty():
            break
    links = found.groupBy("url", "class").agg(F.min("depth").alias("depth"), F.min("page").alias("page"))
    return Explored(links, before.unionByName(read).distinct())


def discover(seeds: DataFrame, pages: DataFrame, max_depth: int = 3, page_cap: int | None = None, keywords: Sequence[str] = SECTION_KEYWORDS) -> DataFrame:
    """The links that a first run of explore() finds."""
    return explore(seeds, pages, max_depth, page_cap, keywords).found


def totals(rows: DataFrame, by: str, kinds: Sequence[str], column: str = "action") -> DataFrame:
    """Per-portal counters of outcomes."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(column) == k).alias(k) for k in kinds])
