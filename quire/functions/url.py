"""Web addresses: resolving against a base, and telling what leads to another machine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)"
_SAFE = r"[!#-;=?-\[\]-_a-z|~%]"
#: Schemes whose addresses have a host and a path that can be resolved.
_PLAIN = ("http:", "https:", "ftp:")


def _encoded(part: Column) -> Column:
    """Characters that may not stand in an address as %XX of their UTF-8 bytes; what is encoded already stays."""
    runs = F.regexp_extract_all(part, F.lit(rf"{_SAFE}+|[^!#-;=?-\[\]-_a-z|~%]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(rf"^{_SAFE}"), r).otherwise(F.replace(F.url_encode(r), F.lit("+"), F.lit("%20")))), "")


def _without_dots(path: Column) -> Column:
    """A path, beginning with /, whose . and .. segments are followed."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(p == ".", done).otherwise(F.array_append(done, p)),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def resolved(href: Column, base: Column) -> Column:
    """An absolute address for a reference on a page at base, or null where neither is absolute."""
    href = F.regexp_replace(F.trim(href), r"[\t\n\r]", "")
    base = F.regexp_replace(F.trim(base), r"[\t\n\r]", "")
    scheme, base_scheme = F.lower(F.regexp_extract(href, _SCHEME, 1)), F.lower(F.regexp_extract(base, _SCHEME, 1))
    host = F.lower(F.regexp_extract(base, r"^[^:/?#]+:(//[^/?#]*)", 1))
    path = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    own_path, tail = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, r"^/", ""), r"[^/]*$", ""))

    def whole(scheme: Column, host: Column, path: Column, tail: Column) -> Column:
        return F.concat(scheme, host, _encoded(_without_dots(F.when(path == "", "/").otherwise(path))), _encoded(tail))

    absolute = whole(scheme, F.lower(F.regexp_extract(href, r"^[^:]+:(//[^/?#]*)", 1)), F.regexp_extract(href, r"^[^:]+://[^/?#]*([^?#]*)", 1), tail)
    relative = (
        F.when(own_path.startswith("//"), whole(base_scheme, F.lower(F.regexp_extract(href, r"^(//[^/?#]*)", 1)), F.regexp_extract(href, r"^//[^/?#]*([^?#]*)", 1), tail))
        .when(own_path.startswith("/"), whole(base_scheme, host, own_path, tail))
        .when(own_path == "", whole(base_scheme, host, path, F.when(tail.startswith("?"), tail).otherwise(F.concat(query, tail))))
        .otherwise(whole(base_scheme, host, F.concat(folder, own_path), tail))
    )
    return F.when(scheme != "", F.when(scheme.isin(*_PLAIN) & href.rlike("^[^:]+://[^/?#]"), absolute).when(~scheme.isin(*_PLAIN), href)).when(base_scheme.isin(*_PLAIN) & (host != "//") & (host != ""), relative)


def is_remote_picture(src: Column | str) -> Column:
    """Whether a picture's source leads to another machine, as a browser reads it: white space dropped, backslashes as slashes, a share as a host."""
    plain = F.lower(F.translate(F.regexp_replace(src, r"[\t\n\r]|^[\x00-\x20]+", ""), "\\", "/"))
    scheme = F.regexp_extract(plain, _SCHEME, 1)
    return F.when(scheme.isin("", "file:"), F.regexp_replace(plain, r"^file:", "").rlike("^//[^/]")).otherwise(scheme != "data:")
