"""Rule engines as Column expressions: dating, first-level classification, third axis, scanned pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import dictionaries as D
from folioscope.functions.text import alternation, anchor_evidence, evidence, fold_collapsed, has_any, has_term, let, python_fold
from folioscope.operators import runs


def dating(years: Column, order: Sequence[str] = D.DATING_ORDER) -> Column:
    """struct<year, method, reason> from a map of source to years.

    Two years or more are a divergence, none is no date, one that only the URL gives is of low confidence; else the
    year is accepted, by the most reliable source that gives it (O9).
    """
    source = lambda s: F.coalesce(F.try_element_at(years, F.lit(s)), F.array().cast("array<int>"))
    every = F.array_distinct(F.flatten(F.map_values(years)))
    producers = F.filter(F.array(*[F.when(F.size(source(s)) > 0, F.lit(s)) for s in order]), lambda s: s.isNotNull())
    accepted = (F.size(every) == 1) & F.exists(producers, lambda s: s != order[0])
    reason = F.when(F.size(every) >= 2, "divergencia").when(F.size(every) == 0, "sem_data").when(~accepted, "baixa_confianca_sourl")
    return F.struct(F.when(accepted, F.get(every, F.lit(0))).alias("year"), F.when(accepted, F.get(producers, F.lit(0))).alias("method"), reason.alias("reason"))


def matched(text: Column, signals: Sequence[str], dimensions: dict[str, Sequence[str]]) -> Column:
    """array<struct<name, dims>> of the signals that occur as whole tokens in a folded text, in the dictionary's order.

    One literal pattern a signal: the engine compiles each once.
    """
    of = {s: [d for d, own in dimensions.items() if s in own] for s in signals}
    entry = lambda s: F.struct(F.lit(s).alias("name"), F.array(*[F.lit(d) for d in of[s]]).cast("array<string>").alias("dims"))
    return let(text, lambda t: F.array_compact(F.array(*[F.when(has_term(t, python_fold(s)), entry(s)) for s in signals])))


def classify(rows: DataFrame, signals: Sequence[str], dimensions: dict[str, Sequence[str]], text: str = "text", anchor: str = "anchor") -> DataFrame:
    """Kind, method, signals, dimensions and anchor evidence: text first, then the link's anchor."""
    has_text = F.coalesce(F.col(text), F.lit("")).rlike(r"(?U)\S")
    found = rows.withColumn("_t", F.when(has_text, matched(fold_collapsed(F.col(text)), signals, dimensions))).withColumn("_a", matched(fold_collapsed(F.coalesce(F.col(anchor), F.lit(""))), signals, dimensions))
    by_text, by_anchor = F.coalesce(F.size("_t") > 0, F.lit(False)), F.size("_a") > 0
    used = F.when(by_text, F.col("_t")).otherwise(F.col("_a"))
    return found.select(
        *rows.columns,
        F.when(by_text | by_anchor, "inovacao").when(has_text, "nao_inovacao").otherwise("sem_texto").alias("kind"),
        F.when(by_text, "texto").when(by_anchor, "ancora").when(has_text, "texto").otherwise("sem_texto").alias("method"),
        F.transform(used, lambda s: s["name"]).alias("signals"),
        F.array_distinct(F.flatten(F.transform(used, lambda s: s["dims"]))).alias("dimensions"),
        F.when(~by_text & by_anchor, anchor_evidence(F.col(anchor))).alias("anchor_evidence"),
    )


def axis3(text: Column, triggers: Sequence[str] = D.AXIS3_TRIGGERS, targets: Sequence[str] = D.AXIS3_TARGETS, required: Sequence[str] = D.AXIS3_REQUIRED, vetoed: Sequence[str] = D.AXIS3_VETOED, window: int = D.EVIDENCE_WINDOW) -> Column:
    """E5: struct<code, signals, evidence>. Substantive (a trigger and a target) before instrumental (all required and none
    vetoed) before silence; the evidence surrounds the first pattern in the dictionary's order."""
    return let(fold_collapsed(F.coalesce(text, F.lit(""))), lambda plain: _axis3(text, plain, triggers, targets, required, vetoed, window))


def _axis3(text: Column, plain: Column, triggers: Sequence[str], targets: Sequence[str], required: Sequence[str], vetoed: Sequence[str], window: int) -> Column:
    def first(terms: Sequence[str]) -> Column:
        return F.coalesce(*[F.when(has_term(plain, python_fold(t)), F.struct(F.lit(t).alias("term"), F.lit(alternation([python_fold(t)])).alias("re"))) for t in terms])

    trigger, target = first(triggers), first(targets)
    every = F.lit(True)
    for t in required:
        every = every & has_term(plain, python_fold(t))
    instrumental = every & ~has_any(plain, [python_fold(t) for t in vetoed])
    substantive = trigger.isNotNull() & target.isNotNull()
    code = F.when(substantive, D.SUBSTANTIVE).when(instrumental, D.INSTRUMENTAL).otherwise(D.SILENCE)
    lead = F.when(substantive, trigger).when(instrumental, first(required))
    cut = evidence(text, F.regexp_instr(plain, lead["re"]), window)
    signals = F.when(substantive, F.array(trigger["term"], target["term"])).when(instrumental, F.array(*[F.lit(t) for t in required])).otherwise(F.array().cast("array<string>"))
    return F.struct(code.alias("code"), signals.alias("signals"), F.coalesce(cut, F.lit("")).alias("evidence"))


def scanned(chars: Column, pages: Column, all_failed: Column | None = None, threshold: int = 100) -> Column:
    """F16: fewer characters than threshold for each page, separators not counted; or no page could be read."""
    few = chars < threshold * F.greatest(pages, F.lit(1))
    return few if all_failed is None else few | all_failed


def ocr_rescue(pages: DataFrame, least: float = 60.0) -> DataFrame:
    """Pages (doc_id, page, words array<struct<word, conf>>): page means, accepted pages, mean of those."""
    valid = F.filter("words", lambda w: w["conf"] >= 0)
    mean = F.try_divide(F.aggregate(F.transform(valid, lambda w: w["conf"].cast("double")), F.lit(0.0), lambda a, x: a + x), F.size(valid))
    rows = pages.select("doc_id", "page", mean.alias("conf"))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("conf") >= least).alias("rescued"), F.round(F.avg(F.when(F.col("conf") >= least, F.col("conf"))), 1).alias("confidence"))


def consecutive(events: DataFrame, key: str, order: Sequence[str], hit: Column, width: float = runs.WIDTH) -> DataFrame:
    """For each event the number of hits in a row up to it; any other event resets it."""
    return runs.numbered(events, key, order, hit, width)


def suspended(events: DataFrame, key: str, order: Sequence[str], hit: Column, limit: int = 3, width: float = runs.WIDTH) -> DataFrame:
    """Keys with limit hits in a row, with their longest run."""
    return runs.longest(events, key, order, hit, width).where(F.col("longest") >= limit)


def reachable(targets: DataFrame, events: DataFrame, key: str, order: Sequence[str], hit: Column, limit: int = 3) -> DataFrame:
    """The targets whose key isn't suspended."""
    return targets.join(suspended(events, key, order, hit, limit).select(key), key, "left_anti")
