"""Readers and writers of the corpus's files: text trees, configuration, CSV and JSON exports."""

from __future__ import annotations

import hashlib
import json
import tomllib
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_LIMIT = 8000


def text_corpus(spark: SparkSession, path: str, limit: int | None = TEXT_LIMIT) -> DataFrame:
    """doc_id and text of the .txt files below a folder whose names are 12 hex digits; the last path of an id wins.

    Bytes that aren't UTF-8 are replaced. limit: leading characters kept (a setting of the dashboard; None keeps all).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("doc_id"), "path", F.col("content").cast("string").alias("text"))
    named = named.where(F.col("doc_id").rlike("^[0-9a-f]{12}$")).withColumn("text", F.make_valid_utf8("text"))
    if limit is not None:
        named = named.withColumn("text", F.substring("text", 1, limit))
    return named.groupBy("doc_id").agg(F.max_by("text", "path").alias("text"))


def texts_of(ids: DataFrame, corpus: DataFrame) -> DataFrame:
    """The texts of a list of ids; unknown ones are empty."""
    return ids.join(corpus.select("doc_id", "text"), "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def hashed_files(spark: SparkSession, path: str, max_bytes: int = 50 << 20) -> DataFrame:
    """Path, size, full hash and short id of PDF files within the size limit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= max_bytes)
    return files.where(F.substring("content", 1, 5) == F.lit(b"%PDF-")).select("path", "length", F.sha2("content", 256).alias("hash")).withColumn("id", F.substring("hash", 1, 12))


#: Quotes inside quoted values are doubled; a null is an empty value.
CSV = {"escape": '"', "nullValue": "", "emptyValue": ""}


def write_listing(rows: DataFrame, path: str, columns: Sequence[str], order: Sequence[Column | str] | None = None) -> None:
    """CSV parts whose names' order is the rows' order: put one after the other they are one file.

    The header is the first line of the first part, and all there is if there are no rows. Rows are dealt out by ranges of
    the order (the columns themselves, if none is given), so every task writes a part of its own.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in (order or columns)]
    text = lambda c: F.col(c).cast("string")
    lines = rows.select(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("k"), F.to_csv(F.struct(*[text(c).alias(c) for c in columns]), CSV).alias("value"))
    header = rows.sparkSession.createDataFrame([(",".join(columns),)], "value string").select(F.lit(None).cast(lines.schema["k"].dataType).alias("k"), "value")
    lines.unionByName(header).repartitionByRange("k").sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)


def read_listing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of write_listing(), of values without line breaks."""
    columns = spark.createDataFrame([], schema).columns
    return spark.read.text(path).where(F.col("value") != ",".join(columns)).select(F.from_csv("value", schema, CSV).alias("r")).select("r.*")


def write_custody(rows: DataFrame, path: str) -> None:
    """One JSON document a call."""
    rows.select("custody_json").write.mode("overwrite").text(path)


def word_list(path: str) -> list[str]:
    """Words of a text file, one or more a line; # starts a comment."""
    with open(path, encoding="utf-8") as f:
        return sorted({w for line in f for w in line.split("#")[0].split()})


class ConfigError(ValueError):
    """All problems of a configuration file."""


def read_config(raw: bytes, kind: str) -> tuple[dict, str]:
    """(tree, hash) of TOML, JSON or YAML; the hash is that of the very bytes parsed."""
    if kind == "toml":
        tree = tomllib.loads(raw.decode())
    elif kind == "json":
        tree = json.loads(raw)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("YAML files need the yaml library; TOML and JSON don't") from e
        tree = yaml.safe_load(raw)
    return tree, hashlib.sha256(raw).hexdigest()


def known_keys(tree: dict, allowed: Sequence[str], where: str = "") -> None:
    if extra := sorted(set(tree) - set(allowed)):
        raise ConfigError(f"unknown keys {where}: {', '.join(extra)}")


def portal_map(tree: dict) -> tuple[list[dict], list[str]]:
    """Flat (institution, portal, seed) rows in order, and all problems found."""
    rows, problems = [], []
    known_keys(tree, ["instituicao", "schema_version"])
    codes, urls = Counter(), Counter()
    for inst in tree.get("instituicao", []):
        known_keys(inst, ["sigla", "nome", "portal"], inst.get("sigla", ""))
        codes[inst["sigla"].upper()] += 1
        for portal in inst.get("portal", []):
            known_keys(portal, ["nome", "categoria", "url", "seeds", "dinamico", "profundidade_maxima"], portal.get("url", ""))
            urls[portal["url"]] += 1
            if portal.get("profundidade_maxima", 3) <= 0:
                problems.append(f"depth of {portal['url']}")
            for k, seed in enumerate(portal.get("seeds") or [portal["url"]]):
                rows.append({"code": inst["sigla"], "portal": portal["url"], "category": portal["categoria"], "seed": seed, "seed_no": k, "dynamic": portal.get("dinamico", False), "max_depth": portal.get("profundidade_maxima", 3)})
    seeds = Counter(r["seed"] for r in rows)
    for what, counted in (("institution", codes), ("portal", urls), ("seed", seeds)):
        problems += [f"{what} {k} occurs {n} times" for k, n in counted.items() if n > 1]
    return rows, problems


def crawl_delay(robots: str, agent: str) -> float | None:
    """The (fractional) crawl delay of robots.txt for an agent, its own group before that of all."""
    found: dict[str, float] = {}
    group: list[str] = []
    open_group = False
    for line in robots.splitlines():
        key, _, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            group = [*group, value.lower()] if open_group else [value.lower()]
            open_group = True
        elif key:
            open_group = False
            if key == "crawl-delay":
                try:
                    delay = float(value.replace(",", "."))
                except ValueError:
                    continue
                for g in group:
                    found.setdefault(g, delay)
    own = next((d for g, d in found.items() if g != "*" and g in agent.lower()), None)
    return own if own is not None else found.get("*")
