"""Page findings of a browser: gates, block rules, fingerprints, de-duplication, mail inspection and events."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.entities import luhn
from tidemark.functions.fields import recipients_complete
from tidemark.functions.text import bind
from tidemark.operators.scale import in_order, ranked

#: Findings that stop a page, what mails are searched for, and sizes.
BLOCKING = ("invisible_text", "prompt_injection", "breakout", "trap_fill", "deeplink_hijack")
INJECTION = (
    r"(?i)ignore\s+(?:(?:all|any|the)\s+)?(?:previous|prior)\s+instructions|system\s+override|忽略(?:之前|先前|以上|所有)的?(?:指令|指示)|無視(?:先前|之前)的?指示|"
    r"\[AG_(?:INVISIBLE_TEXT|TRANSPARENT_OVERLAY)\]"
)
SECRET = (
    r"(?i)-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----|\b(?:sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{20,}|AKIA[A-Z0-9]{16})\b|\b(?:password|passwd|api[_ -]?key|access[_ -]?token)\s*[:=]\s*\S{4,}|"
    r"(?:密码|密碼|口令)\s*[:：=]\s*\S{4,}"
)
NOT_ASCII = "[^\\x00-\\x7F]"
DROPPED = "[\\x{AD}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FEFF}\\x{E0000}-\\x{E001F}\\x{E007F}]"
MAX_TEXT, MAX_FINGERPRINTS, TEXT_PART, TITLE = 65_536, 500, 80, 120


@F.udf(T.StringType(), useArrow=False)
def _composed(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKC", text)


def nfkc(text: Column) -> Column:
    """Compatibility composition, which has no built-in expression. ASCII is the same in it and stays out of Python, and others go there a hundred rows at a time:
    long texts by Arrow's thousands would fill an executor."""
    return F.coalesce(_composed(F.when(text.rlike(NOT_ASCII), text)), text)


def composed_apart(rows: DataFrame, text: Column, f: Callable[[Callable[[Column], Column]], Column], out: str) -> DataFrame:
    """rows with a column out, f(compose), where text is what f composes. Rows wait for Python whole, in a queue that goes to disk, and short inputs let many of them wait:
    so only those go there whose text composition can change, of which few wait as their inputs are as long as they are."""
    may = F.coalesce(text.rlike(NOT_ASCII), F.lit(False))
    return rows.where(~may).select("*", f(lambda t: t).alias(out)).unionByName(rows.where(may).select("*", f(nfkc).alias(out)))


def inspection_text(value: Column, compose: Callable[[Column], Column] = nfkc) -> Column:
    """What mail checks read: compatibility characters composed, tag characters decoded, invisible ones dropped."""
    tags, shown = "".join(chr(0xE0000 + x) for x in range(0x20, 0x7F)), "".join(map(chr, range(0x20, 0x7F)))
    return F.regexp_replace(F.translate(compose(value), tags, shown), DROPPED, "")


def mail_card(value: Column) -> Column:
    """Whether a run of digits, blanks and dashes is a card number by its checksum, and not one digit repeated."""
    digits = F.regexp_replace(value, "[ -]", "")
    return digits.rlike("^[0-9]{13,19}$") & ~digits.rlike("^(.)\\1+$") & luhn(digits)


def short_text(value: Column) -> Column:
    return F.when(F.length(value) <= MAX_TEXT, value)


def inspect_text(value: Column, compose: Callable[[Column], Column] = nfkc) -> Column:
    """Kinds found in a mail's text: mail_uninspectable alone for null and over-long ones, else mail_injection and mail_sensitive."""

    def of(t: Column) -> Column:
        cards = F.exists(F.regexp_extract_all(t, F.lit("(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"), F.lit(0)), mail_card)
        return F.array_compact(F.array(F.when(t.rlike(INJECTION), F.lit("mail_injection")), F.when(t.rlike(SECRET) | cards, F.lit("mail_sensitive"))))

    return F.when(value.isNull() | (F.length(value) > MAX_TEXT), F.array(F.lit("mail_uninspectable"))).otherwise(bind(inspection_text(short_text(value), compose), of))


def mail_text(subject: Column, body: Column) -> Column:
    return F.concat(subject, F.lit("\n"), body)


def classify_send(complete: Column, attachments: Column, other_parts: Column, recipients: Column, subject: Column, body: Column, compose: Callable[[Column], Column] = nfkc) -> Column:
    """Why a mail has to be looked at, the first that applies: mail_uninspectable, mail_attachment, mail_recipients, or what its text holds; else empty."""
    too_long = subject.isNull() | body.isNull() | (F.length(subject) + F.length(body) > MAX_TEXT)
    return (
        F.when(~F.coalesce(complete, F.lit(False)), "mail_uninspectable").when((attachments > 0) | F.coalesce(other_parts, F.lit(False)), "mail_attachment").when(~recipients_complete(recipients), "mail_recipients")
        .when(too_long, "mail_uninspectable").otherwise(F.coalesce(F.get(inspect_text(mail_text(subject, body), compose), F.lit(0)), F.lit("")))
    )


def gate(findings: Column) -> Column:
    """The kind of the first finding (structs with a field kind) that blocks; null if none does."""
    return F.get(F.filter(findings, lambda f: f["kind"].isin(*BLOCKING)), F.lit(0))["kind"]


def block_rules(hosts: DataFrame, start: int = 1) -> DataFrame:
    """(id, host) of distinct trimmed lower-case hosts, numbered in order."""
    own = hosts.select(F.lower(F.trim("host")).alias("host")).where("host <> ''").distinct()
    return ranked(own, [F.col("host")], "id").select((F.col("id") + start - 1).alias("id"), "host")


def clamp_title(title: Column) -> Column:
    t = F.trim(F.coalesce(title, F.lit("")))
    return F.when(F.length(t) > TITLE, F.concat(F.substring(t, 1, TITLE), F.lit("…"))).otherwise(t)


def fingerprint(f: Column) -> Column:
    """kind, field, key and the first 80 characters of text or marker."""
    said = F.coalesce(F.when(f["text"] != "", f["text"]), f["marker"], F.lit(""))
    return F.concat_ws("|", F.coalesce(f["kind"], F.lit("")), F.coalesce(f["field_id"], F.lit("")), F.coalesce(f["profile_key"], F.lit("")), F.substring(said, 1, TEXT_PART))


class _Fingerprints:
    def __init__(self, most: int):
        self.most, self.seen = most, set()

    def step(self, x):
        if x in self.seen:
            return (False,)
        if len(self.seen) >= self.most:
            self.seen.clear()
        self.seen.add(x)
        return (True,)


def new_findings(findings: DataFrame, page: str = "page_id", order: str = "rowid", most: int = MAX_FINGERPRINTS) -> DataFrame:
    """findings (with a column fingerprint) with fresh: unseen on the page. The memory of a page is emptied when it is full, so each page is folded in order."""
    return in_order(findings, [page], [order], ["fingerprint"], lambda: _Fingerprints(most), {"fresh": "boolean"})


def prune_blocklist(rows: DataFrame, now_ms: int) -> DataFrame:
    """Block list rows (host, kind, expires_ms, ...) but for expired session hosts; what else they tell stays."""
    return rows.where((F.col("kind") != "session") | (F.col("expires_ms") > now_ms))


def findings_to_events(pages: DataFrame) -> DataFrame:
    """ui_tree_delta and form_fill events of pages (page_id, app, is_mail, findings: array of structs with kind, text, marker, profile_key); mail pages give none."""
    f = pages.where(~F.col("is_mail")).select("page_id", "app", F.posexplode("findings").alias("i", "f"))
    fill = F.col("f.kind") == "form_fill"
    meta = F.when(fill, F.create_map(F.lit("profile_key"), F.col("f.profile_key"))).otherwise(F.create_map(F.lit("ui_text"), F.coalesce("f.marker", "f.text")))
    return f.select(F.concat_ws("-", "page_id", "i").alias("event_id"), F.lit("browser").alias("platform"), F.when(fill, "form_fill").otherwise("ui_tree_delta").alias("event_type"), F.col("app").alias("source_app"), meta.alias("metadata"))


#: What this engine's messages put before a host.
BAD_DOMAIN, OUTSIDE = "Malicious domain blocked: ", "destination '"


def host_of_decision(rule_id: Column, message: Column) -> Column:
    """Struct (host, kind) that a decision about a malicious domain or a destination out of scope names; null for others and for hosts that can't be named."""
    bad = F.when(message.startswith(BAD_DOMAIN), F.regexp_extract(F.substring(message, len(BAD_DOMAIN) + 1, 1 << 20), "^\\s*(\\S+)", 1))
    outside = F.when(message.startswith(OUTSIDE), F.trim(F.get(F.split(F.substring(message, len(OUTSIDE) + 1, 1 << 20), "'", -1), F.lit(0))))
    made = lambda h, k: F.when((h != "") & (h != "<unnameable>"), F.struct(h.alias("host"), F.lit(k).alias("kind")))
    return F.when(rule_id == "INTEL-DOMAIN", made(bad, "malicious")).when(rule_id == "SCOPE-HOST", made(outside, "out_of_scope"))
