"""Hosts, URLs and domains as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import bind

LARGE_UPLOAD = 5_000_000


def _last(parts: Column) -> Column:
    return F.element_at(parts, -1)


def url_host(url: Column) -> Column:
    """The authority's last part behind @, up to / \\ ? or #; the port stays. Null if it is empty."""
    rest = F.regexp_replace(url, "(?s)^.*?://", "")
    host = F.trim(_last(F.split(F.trim(F.regexp_extract(rest, "(?s)^([^/\\\\?#]*)", 1)), "@", -1)))
    return F.when(host != "", host)


def bare_host(url: Column) -> Column:
    """The host of a URL with ://, without user and port; null without one."""
    rest = F.get(F.split(url, "://", -1), F.lit(1))
    host = F.trim(F.get(F.split(_last(F.split(F.get(F.split(rest, "/", -1), F.lit(0)), "@", -1)), ":", -1), F.lit(0)))
    return F.when(host != "", host)


def normalize_host(host: Column) -> Column:
    """Trimmed, without trailing dots, lower case, without user and port; a bracketed address keeps its colons."""
    h = _last(F.split(F.lower(F.regexp_replace(F.trim(host), "[.]+$", "")), "@", -1))
    return F.when(h.endswith("]"), h).otherwise(F.regexp_replace(h, "(?s):[^:\\]]*$", ""))


def host_in_scope(observed: Column, entry: Column) -> Column:
    """Whether a host is an entry's or below it; blank never is."""
    o, e = normalize_host(observed), normalize_host(entry)
    return (o != "") & (e != "") & ((o == e) | o.endswith(F.concat(F.lit("."), e)))


def suffixes(host: Column) -> Column:
    """A host and all its parent domains, lower case: keys for an equal join with a domain list."""
    parts = F.split(F.lower(host), "[.]", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


#: Scheme, user and password, host, port, path and query of a web address.
WEB = r"^(?i:(https?))://(?:([^/?#@]*)@)?([^/?#:@]+)(?::([0-9]+))?(/[^?#]*)?(?:[?]([^#]*))?"


def _web(url: Column) -> Column:
    part = lambda i: F.regexp_extract(url, WEB, i)
    port = F.when(((F.lower(part(1)) == "https") & (part(4) == "443")) | ((F.lower(part(1)) == "http") & (part(4) == "80")), F.lit("")).otherwise(part(4))
    return F.struct(F.lower(part(1)).alias("scheme"), part(2).alias("user"), F.lower(part(3)).alias("host"), port.alias("port"), F.when(part(5) != "", part(5)).otherwise(F.lit("/")).alias("path"), part(6).alias("query"))


def minimize_url(url: Column) -> Column:
    """Scheme, host and path of a web address: user, query and fragment dropped, token-like path parts elided, the path cut to 120 characters. Empty for anything else."""

    def of(u: Column) -> Column:
        token = lambda p: (F.length(p) >= 16) & (p.rlike("^[0-9a-fA-F]{16,}$") | p.rlike("^[A-Za-z0-9_-]{20,}$"))
        path = F.array_join(F.transform(F.split(u["path"], "/", -1), lambda p: F.when(token(p), F.lit("…")).otherwise(p)), "/")
        cut = F.when(F.length(path) > 120, F.concat(F.substring(path, 1, 120), F.lit("…"))).otherwise(path)
        return F.when(u["scheme"] == "", "").otherwise(F.concat(u["scheme"], F.lit("://"), u["host"], F.when(u["port"] != "", F.concat(F.lit(":"), u["port"])).otherwise(F.lit("")), cut))

    return F.coalesce(bind(_web(url), of), F.lit(""))


def mail_provider(url: Column) -> Column:
    """'gmail' or 'outlook' for an https mail page without user and port, else empty."""
    ok = lambda u: (u["scheme"] == "https") & (u["user"] == "") & (u["port"] == "") & u["path"].rlike("^/mail(?:/|$)")
    name = lambda u: F.when(u["host"] == "mail.google.com", "gmail").when(u["host"].isin("outlook.live.com", "outlook.office.com", "outlook.office365.com"), "outlook").otherwise("")
    return F.coalesce(bind(_web(url), lambda u: F.when(ok(u), name(u)).otherwise("")), F.lit(""))


def classify_link(url: Column, label: Column) -> Column:
    """'mail_link' for a link that isn't plain https to the host that its label shows, behind two redirect wrappers at most; else empty. A mailto link only opens an editor."""

    def inner(u: Column) -> Column:
        """What a redirect wrapper leads to; null for other addresses, empty for a wrapper that leads nowhere."""
        name = F.when(u["host"].endswith(".safelinks.protection.outlook.com"), "url").when((u["host"] == "www.google.com") & (u["path"] == "/url"), "q")
        value = lambda n: F.url_decode(F.regexp_extract(u["query"], rf"(?:^|&){n}=([^&]*)", 1))
        return F.when(name == "url", value("url")).when(name == "q", value("q"))

    def final(step: Column) -> Column:
        shown = F.trim(F.coalesce(label, F.lit("")))
        other = lambda u: shown.rlike(r"^(?i:https?)://\S+$") & (_web(shown)["host"] != u["host"])
        return bind(_web(step["target"]), lambda u: F.when(step["bad"] | (u["scheme"] != "https") | (u["user"] != "") | other(u), "mail_link").otherwise(""))

    def follow(step: Column, i: int) -> Column:
        """The step behind wrapper i, if there is one; a third one is one too many."""
        lost = lambda to: to.isNotNull() & ((to == "") | (F.length(to) > 4096) | F.lit(i == 2))
        after = lambda to: F.struct(F.when(to != "", to).otherwise(step["target"]).alias("target"), (step["bad"] | lost(to)).alias("bad"))
        return bind(bind(bind(_web(step["target"]), inner), after), lambda s: follow(s, i + 1) if i < 2 else final(s))

    first = bind(F.struct(url.alias("target"), (F.length(url) > 4096).alias("bad")), lambda s: follow(s, 0))
    return F.when(url.isNull(), "mail_link").when(F.lower(url).startswith("mailto:"), "").otherwise(first)
