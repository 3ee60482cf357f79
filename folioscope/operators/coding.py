"""Second-level coding: contract validation of JSON answers, citation checks, batches by instrument signature."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from folioscope.functions.text import citation_page
from folioscope.sources.scratch import kept

NOT_APPLICABLE = "N/A"


@dataclass(frozen=True)
class Field:
    """A field of the codebook: ordinal (whole numbers) or nominal (labels)."""

    id: str
    ordinal: Sequence[int] = ()
    labels: Sequence[str] = ()
    allows_na: bool = False


@dataclass(frozen=True)
class Codebook:
    fields: Sequence[Field]
    gates: dict[str, bool] = field(default_factory=dict)

    def pending_gates(self) -> list[str]:
        """N6."""
        return [name for name, done in self.gates.items() if not done]


def json_object(raw: Column) -> Column:
    """From the first { to the last }."""
    return F.nullif(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0), F.lit(""))


_KEYS = ("valor", "citacao_documento", "citacao_trecho")


def problems(raw: Column, codebook: Codebook, documents: Column) -> Column:
    """All the ways in which an answer breaks the contract, as an array of texts; none if it keeps it.

    documents: array of the known document ids. Everything is JSON functions and array tests on the JVM.
    """
    text = json_object(raw)
    root = F.from_json(text, "map<string,string>")
    answers = F.from_json(root["campos"], "map<string,string>")
    shaped = root.isNotNull() & (F.size(F.map_keys(root)) == 1) & F.coalesce(F.get(F.map_keys(root), F.lit(0)) == "campos", F.lit(False)) & answers.isNotNull()
    ids = F.array(*[F.lit(f.id) for f in codebook.fields])
    found = [F.transform(F.array_except(ids, F.map_keys(answers)), lambda x: F.concat(F.lit("falta "), x)), F.transform(F.array_except(F.map_keys(answers), ids), lambda x: F.concat(F.lit("sobra "), x))]
    for f in codebook.fields:
        answer = answers[f.id]
        inner = F.from_json(answer, "map<string,string>")
        value, document, quote = (inner[k] for k in _KEYS)
        is_na = value == NOT_APPLICABLE
        # the raw JSON tells a number from a text or a boolean
        number = answer.rlike(r'"valor"\s*:\s*-?\d+\s*[,}]')
        string = answer.rlike(r'"valor"\s*:\s*"')
        fits = number & value.isin(*[str(v) for v in f.ordinal]) if f.ordinal else string & value.isin(*f.labels)
        valid = F.coalesce(F.when(is_na, F.lit(f.allows_na) & string).otherwise(fits), F.lit(False))
        blank = F.trim(F.coalesce(quote, F.lit(""))) == ""
        cited = F.array_contains(documents, document)
        say = lambda cond, what, f=f: F.when(F.coalesce(cond, F.lit(False)), F.lit(f"{f.id}: {what}"))
        own = F.array(
            say(inner.isNull(), "nao e objeto"),
            say(inner.isNotNull() & (F.size(F.array_except(F.map_keys(inner), F.array(*[F.lit(k) for k in _KEYS]))) > 0), "chave extra"),
            say(inner.isNotNull() & ~valid, "valor invalido"),
            say(valid & is_na & (document.isNotNull() | ~blank), "citacao em N/A"),
            say(valid & ~is_na & ~F.coalesce(cited, F.lit(False)), "documento desconhecido"),
            say(valid & ~is_na & blank, "sem trecho"),
        )
        found.append(F.when(F.map_contains_key(answers, f.id), F.filter(own, lambda p: p.isNotNull())).otherwise(F.array().cast("array<string>")))
    return F.when(~F.coalesce(shaped, F.lit(False)), F.array(F.lit("raiz invalida"))).otherwise(F.concat(*found))


def answers(rows: DataFrame, raw: str, codebook: Codebook, keys: Sequence[str]) -> DataFrame:
    """A row for each field of a valid answer."""
    parsed = F.from_json(F.from_json(json_object(F.col(raw)), "map<string,string>")["campos"], "map<string,struct<valor:string,citacao_documento:string,citacao_trecho:string>>")
    return rows.select(*keys, F.explode(parsed).alias("field", "a")).select(*keys, "field", F.col("a.valor").alias("value"), F.col("a.citacao_documento").alias("document"), F.col("a.citacao_trecho").alias("quote"))


def verify(coded: DataFrame, texts: DataFrame) -> DataFrame:
    """Quotes are looked up in the cited document: page and verification ('ok' or 'citacao_invalidada')."""
    joined = coded.join(texts.select(F.col("doc_id").cast("string").alias("document"), F.col("text").alias("_t")), "document", "left")
    page = citation_page(F.col("quote"), F.col("_t"))
    return joined.select(*coded.columns, page.alias("page"), F.when(F.col("value") == NOT_APPLICABLE, "ok").when(page.isNotNull(), "ok").otherwise("citacao_invalidada").alias("verification"))


def verify_many(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Quotes (quote_id, doc_id, quote) against texts (doc_id, text): quote_id, doc_id, page."""
    joined = quotes.join(texts, "doc_id")
    return joined.select("quote_id", "doc_id", citation_page(F.col("quote"), F.col("text")).alias("page"))


SIGNATURE = ("model", "model_version", "prompt_version", "prompt_sha256", "temperature", "seed", "codebook_sha256", "agent_version", "schema_version")


def find_batch(batches: DataFrame, signature: dict, keys: Sequence[str] = SIGNATURE) -> DataFrame:
    """The batch with exactly this signature, nulls equal; open ones first, then the newest. No row: open one."""
    clause = F.lit(True)
    for k in keys:
        clause = clause & F.col(k).eqNullSafe(F.lit(signature.get(k)))
    return batches.where(clause).orderBy(F.when(F.col("status") == "aberto", 0).otherwise(1), F.desc("id")).limit(1)


def open_batch(batches: DataFrame, signature: dict, keys: Sequence[str] = SIGNATURE) -> DataFrame:
    """The batches with that of this signature open: reopened if it was closed, new (with the next id) if there is none."""
    if missing := [k for k in keys if k not in signature]:
        raise ValueError(f"signature without {', '.join(missing)}")
    if extra := [k for k in signature if k not in keys]:
        raise ValueError(f"signature with unknown {', '.join(extra)}")
    own = find_batch(batches, signature, keys).select(F.col("id").alias("_own"))
    status = F.when(F.col("_own").isNotNull(), "aberto").otherwise(F.col("status"))
    kept = batches.join(F.broadcast(own), batches["id"] == F.col("_own"), "left").withColumn("status", status).drop("_own")  # one row
    last = batches.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    values = {"id": F.col("_last") + 1, "status": F.lit("aberto")} | {k: F.lit(signature[k]) for k in keys}
    new = last.join(F.broadcast(own), F.lit(True), "left_anti").select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in batches.schema.fields])
    return kept.select(*batches.columns).unionByName(new)


def match_batches(signatures: DataFrame, batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K10 for many signatures at once: the best batch of each signature, then a null-safe join."""
    best = batches.groupBy(*keys).agg(F.max_by("id", F.struct((F.col("status") == "aberto").cast("int"), "id")).alias("batch_id"))
    a, b = signatures.distinct().alias("a"), best.alias("b")
    clause = F.col(f"a.{keys[0]}").eqNullSafe(F.col(f"b.{keys[0]}"))
    for k in keys[1:]:
        clause = clause & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, clause).select("a.*", "b.batch_id")


def close_batch(batches: DataFrame, batch_id: int) -> DataFrame:
    """K11."""
    return batches.withColumn("status", F.when((F.col("id") == batch_id) & (F.col("status") == "aberto"), "concluido").otherwise(F.col("status")))


def inputs(documents: DataFrame, call: str = "call_id") -> DataFrame:
    """The sectioned input of each call: its texts in capture order, and the ids."""
    parts = F.sort_array(F.collect_list(F.struct("captured_at", "doc_id", "text")))
    rows = documents.groupBy(call).agg(parts.alias("parts"))
    section = lambda p: F.concat(F.lit("=== documento "), p["doc_id"].cast("string"), F.lit(" ===\n"), F.coalesce(p["text"], F.lit("")))
    return rows.select(call, F.array_join(F.transform("parts", section), "\n\n").alias("input"), F.transform("parts", lambda p: p["doc_id"].cast("string")).alias("documents"))


def sections(documents: DataFrame, budget: int | None = None) -> DataFrame:
    """The inputs of each call: call_id, input, documents. Documents (call_id, doc_id, captured_at, text) are taken in
    order; with a budget of characters the one that crosses it is cut there, and those after it are left out."""
    rows = documents.withColumn("text", F.coalesce("text", F.lit("")))
    if budget is not None:
        before = F.sum(F.char_length("text")).over(Window.partitionBy("call_id").orderBy("captured_at", "doc_id")) - F.char_length("text")
        rows = rows.withColumn("_before", before).where(F.col("_before") < budget).withColumn("text", F.substr("text", F.lit(1), (F.lit(budget) - F.col("_before")).cast("int")))
    return inputs(rows.select("call_id", "captured_at", "doc_id", "text"))


def ask(pending: DataFrame, client: Callable[[str, int], str], attempt: int) -> DataFrame:
    """pending with the client's raw answer to each input, null where it failed."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            raw = []
            for text in batch["input"]:
                try:
                    raw.append(client(text, attempt))
                except Exception:  # noqa: BLE001  the client is foreign code
                    raw.append(None)
            yield pd.DataFrame(batch).assign(raw=raw)

    return pending.mapInPandas(run, StructType([*pending.schema.fields, StructField("raw", StringType())]))


CODED, ALL_SCANNED, NO_TEXT, BY_PROVIDER, BY_CONTRACT = "codificado", "edital_escaneado_sem_ocr", "entrada_sem_texto_util", "provedor", "esquema"


@dataclass(frozen=True)
class Coded:
    """outcomes: call_id, outcome, attempts. fields: call_id, field, value, document, quote, page, verification."""

    outcomes: DataFrame
    fields: DataFrame


def code(documents: DataFrame, client: Callable[[str, int], str], codebook: Codebook, attempts: int = 3, budget: int | None = None) -> Coded:
    """Codes each call's documents (call_id, doc_id, captured_at, text, scanned, current).

    Scanned documents and those whose text isn't current are left out (F18). Each attempt is a written table of the
    calls without a valid answer so far; failures of the client and answers that break the contract use up the same
    budget of attempts (K21). Nothing of a call without a valid answer is kept. The client must be safe to ask again: a
    task that is run twice asks twice.
    """
    usable = ~F.coalesce("scanned", F.lit(False))
    readable = usable & F.coalesce("current", F.lit(False)) & F.col("text").isNotNull()
    state = documents.groupBy("call_id").agg(F.count_if(usable).alias("usable"), F.count_if(readable).alias("readable"))
    left_out = state.where("readable = 0").select("call_id", F.when(F.col("usable") == 0, ALL_SCANNED).otherwise(NO_TEXT).alias("outcome"), F.lit(0).alias("attempts"))
    texts = documents.where(readable)
    pending = kept(sections(texts, budget))
    names, outcomes, found = pending.columns, left_out, []
    for n in range(1, max(1, attempts) + 1):
        tried = kept(ask(pending, client, n).withColumn("problems", problems(F.col("raw"), codebook, F.col("documents"))))
        valid = F.col("raw").isNotNull() & (F.size("problems") == 0)
        found.append(tried.where(valid))
        outcomes = outcomes.unionByName(found[-1].select("call_id", F.lit(CODED).alias("outcome"), F.lit(n).alias("attempts")))
        failed = tried.where(~valid)
        if n == max(1, attempts) or failed.isEmpty():
            outcomes = outcomes.unionByName(failed.select("call_id", F.when(F.col("raw").isNull(), BY_PROVIDER).otherwise(BY_CONTRACT).alias("outcome"), F.lit(n).alias("attempts")))
            break
        pending = failed.select(*names)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return Coded(outcomes, verify(answers(every, "raw", codebook, ["call_id"]), texts))


def code_calls(prepared: DataFrame, client: Callable[[str], str], attempts: int = 3, accept: Callable[[str], bool] | None = None) -> DataFrame:
    """The injected client's raw answer for each input; failures, and answers that accept refuses, use up the same budget and
    leave null."""
    import pandas as pd

    names = prepared.columns

    def run(batches):
        for batch in batches:
            raw = []
            for text in batch["input"]:
                answer = None
                for _ in range(attempts):
                    try:
                        given = client(text)
                        if accept is None or accept(given):
                            answer = given
                            break
                    except Exception:  # noqa: BLE001  the client is foreign code
                        continue
                raw.append(answer)
            yield pd.DataFrame(batch).assign(raw=raw)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prepared.schema.fields if f.name in names) + ", raw string"
    return prepared.mapInPandas(run, schema)


def catalogued(coded: DataFrame) -> DataFrame:
    """Number of verified fields by batch."""
    return coded.where(F.col("verification") == "ok").groupBy("batch_id").agg(F.count("*").alias("n"))
