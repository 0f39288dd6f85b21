"""URL expressions. Parts are cut by pattern, so odd input gives null or itself and never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query with its mark, 5 fragment with its mark; empty where absent."""
    return F.regexp_extract(url, _PARTS, n)


def is_absolute(url: Column) -> Column:
    return url.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+")


def host(url: Column) -> Column:
    """Lower-cased host without credentials and port."""
    return F.regexp_replace(F.regexp_replace(F.lower(part(url, 2)), r"^.*@", ""), r":\d*$", "")


def sorted_query(query: Column) -> Column:
    """Parameters by name, stable, each as name=value; the mark is kept if any is left."""
    pairs = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&", -1), lambda p: p != "")
    named = F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    text = F.array_join(F.transform(F.array_sort(named), lambda x: x["p"]), "&")
    return F.when(F.size(pairs) > 0, F.concat(F.lit("?"), text)).otherwise("")


def normalize(url: Column) -> Column:
    """Lower-case scheme and host, no default port, one trailing slash of the path dropped (the root keeps its own),
    parameters sorted, no fragment; what is no absolute URL comes back as it is."""
    scheme = F.lower(part(url, 1))
    authority = F.lower(part(url, 2))
    default = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    path = F.when(part(url, 3).isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(part(url, 3), "/$", ""))
    return F.when(is_absolute(url), F.concat(scheme, F.lit("://"), default, path, sorted_query(part(url, 4)))).otherwise(url)


def hash8(url: Column) -> Column:
    return F.substring(F.md5(normalize(url)), 1, 8)


def exact_host(url: Column, domains: list[str]) -> Column:
    return F.coalesce(is_absolute(url) & host(url).isin(domains), F.lit(False))


def in_scope(url: Column, domains: list[str], base: str = "") -> Column:
    """http(s), a host equal to or below one of the domains, and a plain prefix ``base`` (trailing slashes dropped)."""
    below = F.lit(False)
    for d in domains:
        below = below | (host(url) == d) | host(url).endswith("." + d)
    starts = url.startswith(base.rstrip("/")) if base else F.lit(True)
    return F.coalesce(is_absolute(url) & F.lower(part(url, 1)).isin("http", "https") & below & starts, F.lit(False))


def is_ignored(url: Column, substrings: list[str], patterns: list[str] | None = None) -> Column:
    hit = F.lit(False)
    for s in substrings:
        hit = hit | url.contains(s)
    for p in patterns or []:
        hit = hit | url.rlike(p)
    return F.coalesce(hit, F.lit(False))


def comparable(url: Column) -> Column:
    """For comparison with entry points: without query, fragment and one trailing slash."""
    return F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*$", ""), "/$", "")


def _fold(path: Column) -> Column:
    """Path with . and .. segments resolved."""
    def step(done: Column, s: Column) -> Column:
        return F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))

    body = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    slash = F.when(path.rlike(r"(^|/)\.{1,2}$"), "/").otherwise("")
    folded = F.array_join(F.aggregate(body, F.array().cast("array<string>"), step), "/")
    return F.concat(F.lit("/"), folded, F.when(folded.endswith("/") | (folded == ""), "").otherwise(slash))


def resolve(target: Column, page: Column) -> Column:
    """Targets that begin with //, /, ./ or ../ against a page; schemes, fragments and bare names pass unchanged."""
    origin = F.concat(F.lower(part(page, 1)), F.lit("://"), F.lower(part(page, 2)))
    tail = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    path = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    folder = F.regexp_extract(F.when(part(page, 3) == "", F.lit("/")).otherwise(part(page, 3)), r"(?s)^(.*/)", 1)
    return (
        F.when(target.startswith("//"), F.concat(F.lower(part(page, 1)), F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, _fold(path), tail))
        .when(target.rlike(r"^\.{1,2}/"), F.concat(origin, _fold(F.concat(folder, path)), tail))
        .otherwise(target)
    )


def resolve_srcset(srcset: Column, page: Column) -> Column:
    items = F.filter(F.transform(F.split(srcset, ",", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.transform(items, lambda x: F.concat(resolve(F.regexp_extract(x, r"^(\S+)", 1), page), F.regexp_extract(x, r"(?s)^\S+(.*)$", 1))), ", ")


def subfolder(url: Column) -> Column:
    kind, name = F.regexp_extract(url, r"/(app|pages)/([^/?#]+)", 1), F.regexp_extract(url, r"/(app|pages)/([^/?#]+)", 2)
    return F.when(kind != "", F.struct(kind.alias("type"), name.alias("name")))


def output_directory(url: Column) -> Column:
    sub = subfolder(url)
    return F.when(sub.isNotNull(), F.concat(sub["type"], F.lit("-"), sub["name"])).when(is_absolute(url), F.concat(host(url), F.lit("-docs"))).otherwise("misc-docs")


def padded(number: Column, width: int = 3) -> Column:
    """Zeros in front up to ``width``; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def output_name(url: Column, index: Column | None = None, hashed: bool = False) -> Column:
    last = F.element_at(F.filter(F.split(url, "/", -1), lambda s: s != ""), -1)
    name = F.regexp_replace(F.coalesce(last, F.lit("index")), r"[^a-zA-Z0-9\-_]", "-")
    if index is not None and not hashed:
        return F.concat(padded(index), F.lit("-"), name, F.lit(".pdf"))
    return F.concat(hash8(url), F.lit("-"), name, F.lit(".pdf")) if hashed else F.concat(name, F.lit(".pdf"))


def parse_name(file: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(file, "/", -1), -1), r"\.pdf$", "")
    prefix = F.when(stem.contains("-"), F.substring_index(stem, "-", 1))
    numeric = F.coalesce(prefix.rlike(r"^\d{3}$"), F.lit(False))
    return F.struct(
        prefix.alias("prefix"),
        F.when(prefix.isNotNull(), F.regexp_extract(stem, r"(?s)^[^-]*-(.*)$", 1)).otherwise(stem).alias("original_name"),
        numeric.alias("is_numeric_index"),
        F.coalesce(prefix.rlike(r"^[a-f0-9]{8}$"), F.lit(False)).alias("is_hash"),
        F.when(numeric, F.expr("1") * prefix.try_cast("int")).alias("index"),
    )


def with_suffix(url: Column, suffix: str = ".md") -> Column:
    """The suffix added to the path unless there; query kept, fragment dropped."""
    path = F.regexp_replace(part(url, 3), "/$", "")
    path = F.when(path.endswith(suffix), path).otherwise(F.concat(path, F.lit(suffix)))
    return F.when(is_absolute(url), F.concat(part(url, 1), F.lit("://"), part(url, 2), path, part(url, 4))).otherwise(url)


def domains(url: Column) -> Column:
    labels = F.split(host(url), r"\.", -1)
    return F.array_distinct(F.when(F.size(labels) > 2, F.array(host(url), F.array_join(F.slice(labels, -2, 2), "."))).otherwise(F.array(host(url))))


def slug(url: Column) -> Column:
    return F.replace(host(url), F.lit("."), F.lit("_"))


def friendly_name(folder: Column, day: str, special: dict[str, str]) -> Column:
    """<Domain>-<Type>_<day>.pdf from names like docs.example.com-api; ``special``: part of a folder name -> name."""
    first, last = F.substring_index(folder, "-", 1), F.substring_index(folder, "-", -1)
    labels = F.split(first, r"\.", -1)
    main = F.when(F.size(labels) > 1, F.element_at(labels, -2)).otherwise(first)
    name = F.when(~folder.contains("-"), F.initcap(F.replace(folder, F.lit("."), F.lit(" ")))).when(first.contains("."), F.concat(F.initcap(main), F.lit("-"), F.initcap(last))).otherwise(F.initcap(last))
    for k, v in reversed(special.items()):
        name = F.when(folder.contains(k), F.lit(v)).otherwise(name)
    return F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.lit(f"_{day}.pdf"))


def is_private(address: Column) -> Column:
    a = F.transform(F.split(address, r"\.", -1), lambda x: x.try_cast("int"))
    first, second = F.get(a, 0), F.get(a, 1)
    v4 = first.isin(0, 10, 127) | (first >= 224) | ((first == 169) & (second == 254)) | ((first == 172) & second.between(16, 31)) | ((first == 192) & (second == 168)) | ((first == 100) & second.between(64, 127))
    v6 = F.lower(address).rlike(r"^(::|::1|f[cd].*|fe[89ab].*|ff.*)$")
    return F.when(address.contains(":"), v6).otherwise(F.coalesce(v4, F.lit(True)))


#: Formats of images, by name, content type and file ending.
IMAGE_FORMATS = [("png", "image/png", ".png"), ("jpg", "image/jpeg", ".jpg"), ("webp", "image/webp", ".webp"), ("avif", "image/avif", ".avif"), ("gif", "image/gif", ".gif"), ("svg", "image/svg+xml", ".svg"), ("pdf", "application/pdf", ".pdf")]


def image_extension(url: Column, content_type: Column, detected: Column) -> Column:
    """Detected format, else content type, else the URL's ending, else .img."""
    form, kind = F.lower(F.coalesce(detected, F.lit(""))), F.lower(F.coalesce(content_type, F.lit("")))
    form = F.when(form == "jpeg", "jpg").otherwise(form)
    by_form = F.coalesce(*[F.when(form == n, F.lit(e)) for n, _, e in IMAGE_FORMATS])
    by_kind = F.coalesce(*[F.when(kind.contains(t), F.lit(e)) for _, t, e in IMAGE_FORMATS])
    ending = F.regexp_extract(part(F.coalesce(url, F.lit("")), 3), r"[^/.][^/]*(\.[^./]+)$", 1)
    return F.coalesce(by_form, by_kind, F.when(ending != "", ending), F.lit(".img"))


def needs_conversion(url: Column, content_type: Column, detected: Column) -> Column:
    """Whether an image is of a format that print doesn't take."""
    known = image_extension(F.lit(""), content_type, detected)
    return F.when(known.isin(".png", ".jpg", ".pdf"), False).when(known != ".img", True).otherwise(F.lower(part(F.coalesce(url, F.lit("")), 3)).rlike(r"\.(webp|avif|gif|svg)$"))


def is_inside(root: Column, target: Column) -> Column:
    """Target is the root or below it, by path segments."""
    a, b = _fold(root), _fold(target)
    a, b = F.regexp_replace(a, "/$", ""), F.regexp_replace(b, "/$", "")
    return (a == b) | b.startswith(F.concat(a, F.lit("/")))


def is_icon(url: Column) -> Column:
    name = F.element_at(F.split(part(url, 3), "/", -1), -1)
    return is_remote(url) & F.lower(name).rlike(r"(^|[-_])icon([-.]|$)")


def is_remote(url: Column) -> Column:
    return F.trim(url).rlike(r"(?i)^https?://")


#: Hosts of trackers.
TRACKERS = ["googletagmanager.com", "google-analytics.com", "googlesyndication.com", "doubleclick.net", "facebook.com/tr", "connect.facebook.net"]


def is_blocked(url: Column, kind: Column) -> Column:
    return is_ignored(url, TRACKERS) | (kind == "media")
