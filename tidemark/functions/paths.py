"""Paths, shell operands and verdicts as built-in expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import bind

#: System directories, where writing weighs; credentials, where reading does; names of block devices; verbs; what a shell reads.
SYSTEM_DIRS = (
    "/etc", "/bin", "/sbin", "/lib", "/lib64", "/usr", "/var", "/boot", "/sys", "/proc", "/dev", "/System", "/Library", "/Applications", "/private/etc", "/private/var",
    "/windows", "/program files", "/program files (x86)", "/programdata",
)
CREDENTIAL_DIRS = ("/.ssh", "/.aws", "/.gnupg", "/.kube", "/.docker/config.json", "/library/keychains", "/appdata/roaming/microsoft/crypto", "/.config/gh", "/.netrc", "/.pgpass", "/.git-credentials")
DEVICES = ("sd", "nvme", "hd", "disk", "vd")
DELETE_VERBS = ("rm", "rmdir", "unlink", "del", "erase", "rd", "shred", "srm", "wipe", "-delete", "--delete", "remove-item", "mkfs", "dd", "truncate", "delete_system", "delete", "trash")
WRITE_VERBS = ("write_file", "write", "tee", "cp", "copy", "mv", "move", "install", "touch", "mkdir", "chmod", "chown", "ln", "set-content", "add-content", "out-file", "patch")
HARD_SEQUENCES = ("$(", "${", "&&", "||", ">>", "<<", "\r\n")
HARD_CHARACTERS = (";", "|", "`", "\n", "\r", "\0", "<", ">")
#: How characters that don't show are named.
SHOWN = {"\n": "\\n", "\r": "\\r", "\0": "\\0"}


def resolve(operand: Column, home: Column, cwd: Column) -> Column:
    """The absolute path of an operand by its letters alone: ~ and relative paths put in place, '.' and '..' worked off. Null where that can't be
    told: empty, with wildcards, NUL, URL-like, or another user's home."""
    raw = F.trim(operand)
    full = F.when(raw == "~", home).when(raw.startswith("~/"), F.concat(home, F.substring(raw, 2, 8192))).when(raw.startswith("/"), raw).otherwise(F.concat(cwd, F.lit("/"), raw))

    def walk(path: Column) -> Column:
        parts = F.filter(F.split(path, "/", -1), lambda p: (p != "") & (p != "."))
        up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        return F.concat(F.lit("/"), F.array_join(up, "/"))

    usable = (raw != "") & (F.octet_length(raw) <= 8192) & ~raw.rlike("[*?\\[\\x00]") & ~raw.rlike("^~[^/]") & ~raw.contains("://")
    return F.when(usable, bind(full, walk))


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/", -1), lambda p: p != "")


def is_within(grant: Column, candidate: Column) -> Column:
    """Whether a path is a grant's or below it, component by component."""
    g, c = parts(grant), parts(candidate)
    return (F.size(c) >= F.size(g)) & (F.slice(c, F.lit(1), F.size(g)) == g)


def unix_view(path: Column) -> Column:
    """A path with a drive as one without: lower case, forward slashes. Other paths stay."""
    bare = F.regexp_replace(path, "^\\\\\\\\[?.]\\\\", "")
    return F.when(bare.rlike("^[A-Za-z]:(?:[\\\\/]|$)"), F.concat(F.lit("/"), F.regexp_replace(F.lower(F.translate(F.substring(bare, 3, 8192), "\\", "/")), "^/+", ""))).otherwise(path)


def holds_credentials(components: Column) -> Column:
    """Whether the lower-cased components of a path hold those of a credential directory side by side."""
    row = F.concat(F.lit("/"), F.array_join(components, "/"), F.lit("/"))
    out = F.lit(False)
    for d in CREDENTIAL_DIRS:
        out = out | row.contains(f"{d}/")
    return out


def sensitive_literal(operand: Column) -> Column:
    """Whether an operand, as it is written, goes through a credential directory, whatever its wildcards and homes stand for."""
    return holds_credentials(F.filter(F.split(F.lower(F.trim(operand)), "[/\\\\]", -1), lambda c: ~c.isin("", ".", "..")))


def sensitive_target(path: Column, writes: Column, home: Column) -> Column:
    """'root', 'home', 'system', 'credentials', 'device' or null, the first that applies."""

    def of(p: Column) -> Column:
        low = F.lower(p)
        # Temporary folders of single users lie in a system directory, five levels deep.
        scratch = low.rlike("^/(?:private/)?var/folders/+[^/]+/+[^/]+/+[^/]")
        row = F.concat(F.lit("/"), F.array_join(parts(p), "/"), F.lit("/"))
        system = bind(row, lambda r: functools.reduce(lambda a, d: a | r.startswith(f"{d}/"), SYSTEM_DIRS, F.lit(False)))
        device = low.rlike(f"^/dev/(?:{'|'.join(DEVICES)})[a-z0-9]*$") | F.lower(path).startswith("\\\\.\\physicaldrive")
        return F.when(F.size(parts(p)) == 0, "root").when((p == unix_view(home)) & writes, "home").when(writes & ~scratch & system, "system").when(holds_credentials(parts(low)), "credentials").when(device, "device")

    return bind(unix_view(path), of)


def infer_intent(verb: Column, args: Column) -> Column:
    """'delete', 'write' or 'read' by the words of a command."""
    tokens = F.split(F.lower(F.concat_ws(" ", verb, F.array_join(args, " "))), "[^\\p{IsAlphabetic}\\p{N}\\-_]+")
    has = lambda words: F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    return F.when(has(DELETE_VERBS), "delete").when(has(WRITE_VERBS), "write").otherwise("read")


def looks_like_path(operand: Column) -> Column:
    """Empty, absolute, home, with separators, a drive, or with a file's ending; flags by their value, URLs never."""
    s = F.trim(operand)
    value = F.when(s.startswith("-"), F.regexp_extract(s, "=(.*)$", 1)).otherwise(s)
    flag = s.startswith("-") & ~s.contains("=")
    shape = value.rlike("^[~/\\\\]") | value.rlike("[/\\\\]") | value.rlike("^[A-Za-z]:") | value.rlike("^.+[.][\\p{IsAlphabetic}\\p{N}]+$")
    return F.when(s == "", True).when(value.rlike("^[A-Za-z0-9+.\\-]+://"), False).when(flag, False).otherwise(shape)


#: One URL and nothing else: its & stand behind ? or #, and nothing in it is white space.
ONE_URL = "^(?i:https?)://[A-Za-z0-9\\-.:_\\[\\]@]+(?:/[^?#&]*)?(?:[?#].*)?$"


def shell_metachar(operand: Column, url: Column) -> Column:
    """The first construct that a shell would read: hard sequences, hard characters, variables, and & outside URLs. Null if there is none."""
    found = [F.when(operand.contains(x), F.lit(x)) for x in HARD_SEQUENCES] + [F.when(operand.contains(x), F.lit(SHOWN.get(x, x))) for x in HARD_CHARACTERS]
    variable = F.regexp_extract(operand, "(\\$[A-Za-z_])", 1)
    whole = F.trim(operand)
    return F.coalesce(*found, F.when(variable != "", variable), F.when(operand.contains("&") & ~(url & whole.rlike(ONE_URL) & ~whole.rlike("(?U)\\s")), F.lit("&")))


def path_claims(verb: Column, operands: Column, home: Column, cwd: Column) -> Column:
    """Structs (operand, resolved, intent) of the operands of a command that look like paths; resolved is null where it can't be told."""
    intent = infer_intent(verb, operands)
    return F.transform(F.filter(operands, looks_like_path), lambda o: F.struct(o.alias("operand"), resolve(o, home, cwd).alias("resolved"), intent.alias("intent")))


def filesystem_scope(path: Column, writes: Column, home: Column, read_grant: Column, write_grant: Column) -> Column:
    """FS-NO-PATH, FS-UNPROVABLE, FS-SENSITIVE, FS-UNSCOPED or FS-OUTSIDE, the first that applies to an operand and its resolved path; null if it is inside."""
    grant = F.when(writes, write_grant).otherwise(read_grant)
    blank = F.trim(F.coalesce(path["operand"], F.lit(""))) == ""
    return F.when(blank, "FS-NO-PATH").when(path["resolved"].isNull(), "FS-UNPROVABLE").when(sensitive_target(path["resolved"], writes, home).isNotNull(), "FS-SENSITIVE").when(grant.isNull(), "FS-UNSCOPED").when(~F.exists(grant, lambda g: is_within(g, path["resolved"])), "FS-OUTSIDE")


def shell_verdict(tool: Column, verb: Column, operands: Column, home: Column, cwd: Column, policy: dict) -> Column:
    """Struct (decision, rule_id) of a command under a policy of lists (denied, confirm, allowlisted, url_tools, read, write)."""
    t, v = F.lower(tool), F.lower(F.coalesce(verb, tool))
    lits = lambda k: F.array(*map(F.lit, policy.get(k, []))).cast("array<string>")
    within = lambda x, k: F.array_contains(lits(k), x)
    words = F.concat(F.array(tool, F.coalesce(verb, tool)), operands)
    url = within(t, "url_tools")
    meta = F.exists(words, lambda o: shell_metachar(o, url).isNotNull())
    writes = infer_intent(v, operands) != "read"
    claims = F.transform(F.filter(operands, looks_like_path), lambda o: F.struct(o.alias("operand"), resolve(o, home, cwd).alias("resolved")))

    def of(c: Column) -> Column:
        some = lambda f: F.exists(c, f)
        grant = F.when(writes, lits("write")).otherwise(lits("read"))
        sensitive = some(lambda p: sensitive_target(p["resolved"], writes, home).isNotNull()) | some(lambda p: p["resolved"].isNull() & sensitive_literal(p["operand"]))
        outside = some(lambda p: ~F.exists(grant, lambda g: is_within(g, p["resolved"])))
        r = lambda d, i: F.struct(F.lit(d).alias("decision"), F.lit(i).alias("rule_id"))
        scoped = F.lit("read" in policy or "write" in policy)
        return (
            F.when(meta, r("deny", "SHELL-METACHAR")).when(within(v, "denied") | within(t, "denied"), r("deny", "SHELL-DENIED-ACTION")).when(F.arrays_overlap(F.transform(operands, F.lower), lits("denied")), r("deny", "SHELL-DENIED-TARGET"))
            .when(sensitive, r("deny", "SHELL-PATH-SENSITIVE")).when(some(lambda p: p["resolved"].isNull()), r("ask", "SHELL-PATH-UNPROVABLE")).when((F.size(c) > 0) & ~scoped, r("ask", "SHELL-PATH-UNSCOPED")).when((F.size(c) > 0) & outside, r("deny", "SHELL-PATH-OUTSIDE"))
            .when(within(v, "confirm") | within(t, "confirm"), r("ask", "SHELL-CONFIRM")).when(within(t, "allowlisted"), r("allow", "SHELL-ALLOWLIST")).otherwise(r("ask", "SHELL-UNKNOWN-TOOL"))
        )

    return bind(claims, of)
