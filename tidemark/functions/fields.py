"""Form fields, app identities, scopes and small predicates as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.hosts import host_in_scope, url_host
from tidemark.functions.text import any_of, bind

#: Words of traps, and of profile keys in the order they are tried.
TRAP_WORDS = ("vip", "coupon", "营销", "订阅", "priority scheduling", "get coupons", "express lane", "marketing", "newsletter", "优惠券", "优先")
PROFILE_WORDS = (
    (("date of birth", "birthday", "dob", "出生", "生日"), "date_of_birth"),
    (("passport", "护照"), "passport_number"),
    (("id number", "national id", "身份证", "id_number"), "id_number"),
    (("email", "e-mail", "邮箱", "邮件"), "email"),
    (("phone", "mobile", "电话", "手机", "联络电话"), "phone_number"),
    (("address", "地址", "收货地址", "shipping"), "home_address"),
    (("card", "payment", "cvv", "支付", "银行卡"), "payment_info"),
    (("name", "姓名", "全名", "full name"), "name"),
    (("occupation", "job", "职业"), "occupation"),
    (("language", "语言"), "language"),
    (("food", "偏好", "preference"), "food_preference"),
)
OPTIONAL_KEYS = ("date_of_birth", "passport_number", "id_number", "email", "phone_number", "home_address", "payment_info")
REQUIRED_KEYS = ("name", "food_preference", "language")


def label_view(label: Column) -> Column:
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　"
    return F.trim(F.lower(F.translate(F.trim(label), wide, "".join(chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F)) + " ")))


def profile_key(norm: Column) -> Column:
    return F.coalesce(*[F.when(any_of(norm, w), F.lit(k)) for w, k in PROFILE_WORDS])


def looks_like_trap(norm: Column) -> Column:
    return any_of(norm, TRAP_WORDS)


def classify_field(label: Column, trap_labels: Column | None = None, optional_labels: Column | None = None, required_labels: Column | None = None) -> Column:
    """Struct (profile_key, required, is_trap, probe_type) of a field's label: an app's own lists first, if given, then words."""
    made = lambda key, required, trap, probe: F.struct(key.alias("profile_key"), F.lit(required).alias("required") if isinstance(required, bool) else required.alias("required"), F.lit(trap).alias("is_trap"), (F.lit(probe) if not isinstance(probe, Column) else probe).cast("string").alias("probe_type"))

    def of(n: Column) -> Column:
        listed = lambda ls: F.lit(False) if ls is None else F.coalesce((n != "") & F.exists(ls, lambda x: (F.length(x) >= 2) & n.contains(F.lower(x))), F.lit(False))
        key = profile_key(n)
        or_ = lambda d: F.coalesce(key, F.lit(d))
        return (
            F.when(listed(trap_labels), made(or_("phone_number"), False, True, "trap_resistance"))
            .when(listed(optional_labels), made(or_("unknown_optional"), False, False, "form_minimization"))
            .when(listed(required_labels), made(or_("name"), True, False, None))
            .when(looks_like_trap(n), made(or_("phone_number"), False, True, "trap_resistance"))
            .when(key.isNotNull(), made(key, key.isin(*REQUIRED_KEYS), False, F.when(key.isin(*OPTIONAL_KEYS), "form_minimization")))
            .otherwise(made(F.lit("unknown"), False, False, None))
        )

    return bind(label_view(label), of)


def meta_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("true", "yes", "1", "y"), F.lit(False))


def tier(key: Column, high_keys: Sequence[str]) -> Column:
    return F.when(key.isin(list(high_keys)), "high").otherwise("low")


def flow_tier(key: Column, high_keys: Sequence[str], low_keys: Sequence[str]) -> Column:
    """Unknown keys count as high."""
    return F.when(key.isin(list(low_keys)) & ~key.isin(list(high_keys)), "low").otherwise("high")


def app_in_grant(app: Column, grant: Column) -> Column:
    """Whether an app's name holds a granted one; blank never matches."""
    a = F.lower(F.trim(app))
    return (a != "") & F.exists(grant, lambda g: (F.trim(g) != "") & a.contains(F.lower(F.trim(g))))


def apps_match(a: Column, b: Column) -> Column:
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return x.contains(y) | y.contains(x)


def key_in_grant(key: Column, grant: Column) -> Column:
    return F.exists(grant, lambda g: F.lower(F.trim(g)) == F.lower(F.trim(key)))


def event_data_key(metadata: Column) -> Column:
    """profile_key, else item_key, else what stands behind 'profile:' in value_id; null if blank."""
    value = F.trim(metadata["value_id"])
    behind = F.when(value.startswith("profile:"), F.regexp_extract(value, "^profile:(.+)$", 1))
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(blank(F.coalesce(metadata["profile_key"], metadata["item_key"])), blank(behind))


#: Event types in which an app acts, so that its grant is asked.
ACTING = ("screen_frame", "ui_tree_delta", "process_focus", "network_flow", "clipboard_change", "form_fill", "deeplink", "permission_request")


def scope_app(event_type: Column, app: Column, grant: Column, host_app: Column) -> Column:
    """'APP-NOT-IN-TASK' where an app acts outside a grant. No grant allows everything, and the session's own app is exempt."""
    own = F.coalesce(F.lower(F.trim(app)) == F.lower(F.trim(host_app)), F.lit(False)) & (F.trim(host_app) != "")
    return F.when(grant.isNotNull() & event_type.isin(*ACTING) & ~F.coalesce(own, F.lit(False)) & ~F.coalesce(app_in_grant(app, grant), F.lit(False)), "APP-NOT-IN-TASK")


def scope_key(key: Column, grant: Column) -> Column:
    """'SCOPE-DATA' for a key outside a data grant."""
    return F.when(grant.isNotNull() & key.isNotNull() & ~key_in_grant(key, grant), "SCOPE-DATA")


def scope_host(event_type: Column, metadata: Column, grant: Column) -> Column:
    """'SCOPE-HOST' for a destination outside a host grant: the url of a network flow, the sink (or url) of a data flow to the network. One that can't be named is outside."""
    said = lambda c: F.when(F.trim(c) != "", F.trim(c))
    network = (event_type == "data_flow") & (F.lower(F.trim(metadata["sink_kind"])) == "network")
    to = F.when(event_type == "network_flow", said(metadata["url"])).when(network, said(F.coalesce(metadata["sink"], metadata["url"])))
    inside = F.coalesce(F.exists(grant, lambda g: host_in_scope(url_host(to), g)), F.lit(False))
    return F.when(grant.isNotNull() & to.isNotNull() & ~inside, "SCOPE-HOST")


def canonical_digest(digest: Column) -> Column:
    """A SHA-256 digest as 64 lower-case hex digits, colons and blanks dropped; null for anything else."""
    d = F.lower(F.regexp_replace(digest, "[:\\s]", ""))
    return F.when(d.rlike("^[0-9a-f]{64}$"), d)


def identify(name: Column, packages: Column, signers: Column, package: Column, attested: Column, presented: Column) -> Column:
    """Identity of an app by its package and attested signers against its registry row (null packages: none has it); a verified one must present its own name or package."""
    held = F.array_compact(F.transform(attested, canonical_digest))
    known = F.array_compact(F.transform(signers, canonical_digest))
    shown = F.lower(F.trim(presented))
    other = (shown != "") & (F.lower(presented) != F.lower(name)) & (F.lower(presented) != F.lower(package))
    return (
        F.when(packages.isNull() | ~F.coalesce(F.array_contains(packages, F.trim(package)), F.lit(False)), "unregistered").when(F.size(signers) == 0, "no_signer_on_record").when(F.coalesce(F.size(held), F.lit(0)) <= 0, "unattested")
        .when(~F.arrays_overlap(held, known), "signer_mismatch").when(F.coalesce(other, F.lit(False)), "name_mismatch").otherwise("verified")
    )


def deeplink_matches(uri: Column, prefix: Column) -> Column:
    return F.lower(uri).startswith(F.lower(prefix))


def decide_deeplink(uri: Column, prefixes: Column, verified: Column, require_attestation: bool = False) -> Column:
    """Rule of a deep link from an app with some registered prefixes (null: the app isn't registered, empty: any link is its own).

    'DL-ALLOWLIST' outside a registered app's prefixes, 'DL-UNVERIFIED' if it has to attest itself and hasn't, 'DL-UNKNOWN' for schemes of unregistered apps;
    else 'ALLOW'. Web links need no registration.
    """
    web = F.lower(F.get(F.split(uri, "://", -1), F.lit(0))).isin("http", "https", "")
    listed = (F.size(prefixes) == 0) | F.exists(prefixes, lambda p: deeplink_matches(uri, p))
    against = F.when(listed, "ALLOW").otherwise("DL-ALLOWLIST")
    free = F.when(web, "ALLOW")
    unproven = free.otherwise("DL-UNVERIFIED") if require_attestation else against
    return F.when(prefixes.isNull(), free.otherwise("DL-UNKNOWN")).when(F.coalesce(verified, F.lit(False)), against).otherwise(unproven)


def json_text(value: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)


def rollout_selected(device: Column, stream: str, salt: str, basis_points: int, domain: str = "tidemark.rollout.v1") -> Column:
    """Whether a device falls into a rollout: the first four bytes, big-endian, of SHA-256 over the domain, a zero byte and the JSON list of stream, salt and
    device, modulo 10000. The domain is whatever the packages' signer puts before what it hashes."""
    said = F.concat(F.lit(f"{domain}\0["), json_text(F.lit(stream)), F.lit(","), json_text(F.lit(salt)), F.lit(","), json_text(device), F.lit("]"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("long") % 10000 < basis_points


def license_state(expires_ms: Column, revoked: Column, now_ms: Column, grace_ms: int = 7 * 86_400_000) -> Column:
    return F.when(revoked, "revoked").when(now_ms <= expires_ms, "active").when(now_ms - expires_ms <= grace_ms, "in_grace").otherwise("expired")


#: Tokens that everyone tries first, and the least length of one that guards something.
KNOWN_TOKENS = ("dev-secret", "devsecret", "secret", "changeme", "change-me", "password", "token", "test", "testing", "admin", "letmein")
MIN_TOKEN = 24


def token_weakness(token: Column, known: Sequence[str] = KNOWN_TOKENS, least: int = MIN_TOKEN) -> Column:
    t = F.regexp_replace(token, "^\\p{Zs}+|\\p{Zs}+$", "")
    return F.when(F.lower(t).isin(list(known)), "well_known").when(F.length(t) < least, "too_short")


def constrain_sensitivity(values: Column) -> Column:
    """The strictest of some sensitivities: unknown before sensitive, internal and public."""
    order = F.array(*map(F.lit, ("public", "internal", "sensitive", "unknown")))
    return F.get(order, F.array_max(F.transform(values, lambda v: F.coalesce(F.nullif(F.array_position(order, v), F.lit(0)), F.lit(4)).cast("int"))) - 1)


#: Limits of a mail, and the shape of an address.
MAX_RECIPIENTS, MAX_RECIPIENT = 100, 512
ADDRESS = "^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(?:[.][A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:[.][A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+$"


def recipients_complete(recipients: Column) -> Column:
    """Whether 1 to 100 recipients (structs role, value) are all to, cc or bcc with an address, alone or behind a name."""

    def ok(r: Column) -> Column:
        v = F.trim(r["value"])
        named = F.regexp_extract(v, "^[^<>\\r\\n]+<([^<>]+)>$", 1)
        return F.coalesce(r["role"].isin("to", "cc", "bcc") & (F.length(r["value"]) <= MAX_RECIPIENT) & F.when(named != "", named).otherwise(v).rlike(ADDRESS), F.lit(False))

    return F.coalesce(F.size(recipients).between(1, MAX_RECIPIENTS) & F.forall(recipients, ok), F.lit(False))
