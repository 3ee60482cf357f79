"""URL and link functions as Column expressions. No URL parser of the engine is used: it refuses paths with spaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.dictionaries import CANDIDATE_WORDS, IGNORED_PREFIXES, SECTION_KEYWORDS
from folioscope.functions.text import fold, has_keyword, let

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
# Endings of files that are never sweep targets.
BINARY_ENDINGS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "zip", "rar", "7z", "tar", "gz")


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, n)


def path(url: Column) -> Column:
    return part(url, 3)


def hostname(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_extract(part(url, 2), r"^(?:.*@)?([^:]*)", 1))


def scope_host(url: Column) -> Column:
    """The host, with www. taken as the same site."""
    return F.regexp_replace(hostname(url), r"^www\.", "")


def origin(url: Column) -> Column:
    """Scheme, host and port."""
    return F.lower(F.concat(part(url, 1), F.lit("://"), F.regexp_replace(part(url, 2), r"^.*@", "")))


def _reencoded(text: Column) -> Column:
    """A query component decoded and encoded again, as HTML forms do."""
    return F.replace(F.url_encode(F.coalesce(F.try_url_decode(text), text)), F.lit("*"), F.lit("%2A"))


def canonical(url: Column) -> Column:
    """http(s) only: lower-case scheme and host, no default port, fragment, user or utm_ parameter (T14); else null."""
    scheme, host = F.lower(part(url, 1)), hostname(url)
    port = F.regexp_extract(part(url, 2), r":(\d+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    pairs = F.filter(F.split(part(url, 4), "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_"))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(_reencoded(F.substring_index(p, "=", 1)), F.lit("="), _reencoded(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, r"^[^=]*=", "")).otherwise("")))), "&")
    made = F.concat(scheme, F.lit("://"), host, F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), port)), path(url), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme.isin("http", "https") & (host != ""), made)


def slug(url: Column) -> Column:
    """File name as a slug of at most 80 characters."""
    name = F.element_at(F.split(path(url), "/"), -1)
    plain = fold(F.regexp_replace(F.coalesce(F.try_url_decode(name), name), r"(?i)\.pdf$", ""))
    cut = F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)
    return F.coalesce(F.nullif(F.regexp_replace(cut, "-+$", ""), F.lit("")), F.lit("documento"))


def call_id(code: Column, year: Column, slug_: Column) -> Column:
    """T24."""
    return F.concat_ws("-", F.lower(code), F.coalesce(year.cast("string"), F.lit("_sem_ano")), slug_)


def link_class(anchor: Column, url: Column, keywords: Sequence[str] = SECTION_KEYWORDS, words: Sequence[str] = CANDIDATE_WORDS) -> Column:
    """'candidato/pdf', 'candidato/pagina_edital', 'secao' or null."""
    lowered = F.lower(path(url))
    return (
        F.when(lowered.endswith(".pdf"), "candidato/pdf")
        .when(F.arrays_overlap(F.split(lowered, "[^a-z0-9]+"), F.array(*[F.lit(w) for w in words])), "candidato/pagina_edital")
        .when(has_keyword(anchor, keywords), "secao")
    )


def followable(href: Column) -> Column:
    """Whether a link target is worth resolving."""
    bad = F.lit(False)
    for prefix in IGNORED_PREFIXES:
        bad = bad | F.lower(F.trim(href)).startswith(prefix)
    return (F.trim(F.coalesce(href, F.lit(""))) != "") & ~bad


def is_file(url: Column, endings: Sequence[str] = BINARY_ENDINGS) -> Column:
    """F15."""
    return F.lower(path(url)).rlike(r"\.(" + "|".join(endings) + ")$")


def resolve(base: Column, href: Column) -> Column:
    """An href against its page's URL, for absolute, scheme-relative, rooted, query and plain relative references; dot
    segments are taken out."""
    scheme, host = part(base, 1), part(base, 2)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    root = F.concat(scheme, F.lit("://"), host)
    made = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, path(base), href))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), href))
    )
    return let(made, lambda url: F.when(path(url).rlike(r"/\.\.?(/|$)"), without_dots(url)).otherwise(url))


def without_dots(url: Column) -> Column:
    """The URL without . and .. segments; .. at the root goes."""
    parts = F.split(path(url), "/")
    step = lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
    joined = lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when((F.size(k) > 0) & F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))
    rest = F.regexp_extract(url, r"^[^:]+://[^/?#]*[^?#]*(.*)$", 1)
    return F.concat(part(url, 1), F.lit("://"), part(url, 2), let(kept, joined), rest)


def decoded(attribute: Column) -> Column:
    """An attribute's value with the character references that URLs hold decoded."""
    for name, char in (("&#38;", "&"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        attribute = F.replace(attribute, F.lit(name), F.lit(char))
    return attribute


def links(html: Column) -> Column:
    """array<struct<href, anchor>> of a page's anchors, by regular expression: href in double, single or no quotes."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)[^>]*>.*?</a>"), F.lit(0))
    value = lambda a: F.concat(*[F.regexp_extract(a, r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", k) for k in (1, 2, 3)])
    return F.transform(found, lambda a: F.struct(decoded(value(a)).alias("href"), F.trim(F.regexp_replace(a, "(?s)<[^>]*>", "")).alias("anchor")))
