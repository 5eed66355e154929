"""URL functions and predicates as Columns."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .patterns import BLOCKED_HOSTS, BLOCKED_SUFFIXES, PAGE_TYPES
from .text import _col, let

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def normalize_url(c: Column | str) -> Column:
    """Trimmed, with https:// where no scheme is given and without fragment; null where empty."""
    trimmed = F.trim(_col(c))
    schemed = F.when(F.contains(trimmed, F.lit("://")), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))
    return F.when(trimmed != "", F.regexp_replace(schemed, "#.*$", ""))


def scheme(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(c), _PARTS, 1))


def netloc(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), _PARTS, 2)


def host(c: Column | str) -> Column:
    """Lower-case host without user and port; brackets of an IPv6 address removed."""
    bare = F.regexp_replace(netloc(c), "^.*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r":\d*$", ""), r"^\[|\]$", ""))


def port(c: Column | str) -> Column:
    return F.regexp_extract(netloc(c), r":(\d+)$", 1).try_cast("int")


def path(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), _PARTS, 3)


def origin(c: Column | str) -> Column:
    return F.concat(scheme(c), F.lit("://"), netloc(c))


@F.pandas_udf(BooleanType())
def _blocked_ipv6(hosts: pd.Series) -> pd.Series:
    def blocked(h: str | None) -> bool:
        try:
            ip = ipaddress.ip_address(h or "")
        except ValueError:
            return False
        return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified

    return hosts.map(blocked)


def blocked_ipv4(h: Column) -> Column:
    """True for a dotted address that is not an ordinary public one."""
    dotted = F.when(h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.transform(F.split(h, r"\."), lambda x: x.cast("int")))
    return F.coalesce(let(dotted, _special_ipv4), F.lit(False))


def _special_ipv4(octets: Column) -> Column:
    a, b, c, d = (octets[i] for i in range(4))
    special = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & (c == 0) & ~d.isin(9, 10)) | ((a == 192) & (b == 0) & (c == 2)) | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    return special & (F.greatest(a, b, c, d) <= 255)


def unsafe_reason(c: Column | str, ipv6: bool = True) -> Column:
    """Why a URL must not be fetched, null where it may; names are not resolved."""

    def judge(url: Column, h: Column) -> Column:
        bad_ip = blocked_ipv4(h)
        if ipv6:
            bad_ip = bad_ip | F.coalesce(_blocked_ipv6(F.when(F.contains(h, F.lit(":")), h)), F.lit(False))
        suffix = F.lit(False)
        for s in BLOCKED_SUFFIXES:
            suffix = suffix | F.endswith(h, F.lit(s))
        return (
            F.when(url.isNull(), "empty url")
            .when(~scheme(url).isin("http", "https"), "unsupported scheme")
            .when(F.contains(netloc(url), F.lit("@")), "embedded credentials")
            .when(h == "", "no hostname")
            .when(h.isin(*BLOCKED_HOSTS) | suffix, "private hostname")
            .when(bad_ip, "private or reserved address")
        )

    if ipv6:  # a Python function cannot stand inside the expression below
        return judge(normalize_url(c), host(normalize_url(c)))
    return let(normalize_url(c), lambda url: let(host(url), lambda h: judge(url, h)))


def is_safe_url(c: Column | str, ipv6: bool = True) -> Column:
    return unsafe_reason(c, ipv6).isNull()


def same_origin(a: Column | str, b: Column | str) -> Column:
    return (scheme(a) == scheme(b)) & (host(a) == host(b)) & port(a).eqNullSafe(port(b))


def page_type(c: Column | str) -> Column:
    """Kind of page by the first rule with a word in the path; generic without."""
    p, out = F.lower(path(c)), None
    for name, words in PAGE_TYPES:
        hit = p.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("generic")


def is_member(c: Column | str, hosts: tuple[str, ...]) -> Column:
    """Host is one of a given set."""
    return host(c).isin(*hosts)
