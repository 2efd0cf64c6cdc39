"""URL predicates and scores as native column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from .fields import col

# Endings that are never followed, case-sensitive.
SKIPPED_ENDINGS = (".pdf", ".zip", ".tar.gz", ".jpg", ".png")

# Default weight of each focus signal.
FOCUS_WEIGHTS = {"anchor": 3.0, "url": 2.0, "meta": 1.0, "proximity": 1.0, "domain": 1.0}


def authority(url: Column | str) -> Column:
    """Host with user and port as written; empty when the url has none."""
    return F.coalesce(F.try_parse_url(col(url), F.lit("AUTHORITY")), F.lit(""))


def url_path(url: Column | str) -> Column:
    """Path with its query, as robots prefixes see it; at least ``/``."""
    path = F.regexp_replace(F.split(col(url), "#", 2)[0], r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    return F.when(path == "", "/").when(path.startswith("?"), F.concat(F.lit("/"), path)).otherwise(path)


def _without_dots(url: Column) -> Column:
    """A hierarchical url with the ``.`` and ``..`` segments of its path resolved."""
    root = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(url, r"([?#].*)$", 1)
    parts = F.split(F.substr(path, F.lit(2)), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc)
        .when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))),
    )
    folder = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    dotted = (root != "") & path.rlike(r"/\.\.?(?:/|$)")
    return F.when(dotted, F.concat(root, F.lit("/"), F.array_join(kept, "/"), folder, tail)).otherwise(url)


def join_url(base: Column | str, href: Column | str) -> Column:
    """Absolute form of a link: absolute, scheme-relative, root-relative or relative."""
    base, href = col(base), col(href)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    plain = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(
        plain == root, F.concat(root, F.lit("/"))
    ).otherwise(F.regexp_replace(plain, r"[^/]*$", ""))
    joined = (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(plain, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .otherwise(F.concat(folder, href))
    )
    # Links that stand as they are, whole, without scheme or empty, keep their dots.
    return F.when((href == "") | href.startswith("//") | href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), joined).otherwise(_without_dots(joined))


def follow_link(url: Column | str, base: Column | str) -> Column:
    """Same host (or none given) and not a document or image file."""
    url = col(url)
    host = authority(url)
    ending = F.lit(False)
    for tail in SKIPPED_ENDINGS:
        ending = ending | url.endswith(tail)
    return ((host == "") | (host == authority(base))) & ~ending


def url_patterns(url: Column | str, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Any include pattern (all when there is none) and no exclude pattern."""
    url = col(url)
    wanted = F.lit(not include)
    for pattern in include:
        wanted = wanted | url.rlike(f"(?U){pattern}")
    for pattern in exclude:
        wanted = wanted & ~url.rlike(f"(?U){pattern}")
    return wanted


@dataclass(frozen=True)
class FocusConfig:
    keywords: Sequence[str] = ()
    url_patterns: Sequence[str] = ()
    domain_whitelist: Sequence[str] = ()
    domain_blacklist: Sequence[str] = ()
    weights: Mapping[str, float] = field(default_factory=lambda: dict(FOCUS_WEIGHTS))


def _mentions(text: Column, keywords: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.lower(text).contains(word.lower())
    return F.coalesce(hit, F.lit(False))


def focus_score(
    url: Column | str,
    anchor: Column | str,
    meta: Column,
    referrer: Column | str,
    config: FocusConfig,
) -> Column:
    """Weighted link score with its breakdown; ``meta`` is a string map."""
    url = col(url)
    w = config.weights
    pattern_hit = F.lit(False)
    for pattern in config.url_patterns:
        pattern_hit = pattern_hit | url.rlike(f"(?iU){pattern}")
    host = authority(url)
    signals = {
        "anchor": _mentions(col(anchor), config.keywords).cast("int"),
        "url": pattern_hit.cast("int"),
        "meta": F.coalesce(
            F.exists(F.map_values(meta), lambda v: _mentions(v, config.keywords)), F.lit(False)
        ).cast("int"),
        "proximity": F.least(F.greatest(col(referrer).cast("double"), F.lit(0.0)), F.lit(1.0)),
        "domain": F.when(host.isin(list(config.domain_whitelist)), 1)
        .when(host.isin(list(config.domain_blacklist)), -1)
        .otherwise(0),
    }
    raw = F.lit(0.0)
    for name, signal in signals.items():
        raw = raw + F.lit(float(w[name])) * signal
    top = float(sum(v for v in w.values() if v > 0))
    norm = raw / F.lit(top) if top else F.lit(0.0)
    return F.struct(
        *[s.alias(n) for n, s in signals.items()],
        raw.alias("raw_score"),
        norm.alias("norm_score"),
    )
