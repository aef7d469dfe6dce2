"""Sensitive entities in text, found by built-in expressions.

Each scanner gives array<struct<kind, redacted, verified>>; what is found is never carried along, only a redaction of it.
A cheap pattern guards each scanner, so texts without a candidate cost one pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import ALNUM, IGNORABLE, any_of, bind, redact_tail

A = f"[{ALNUM}]"
#: What stands before a match: up to 40 characters.
BEFORE = "(?s)(?<=(^.{0,39}|.{40}))"
ENTITY = "array<struct<kind:string,redacted:string,verified:boolean>>"
#: Key words, credential prefixes with the least length of what follows.
CARD_WORDS = ("card", "credit", "debit", "visa", "mastercard", "amex", "pan", "卡号", "卡", "银行卡", "信用卡", "カード")
PHONE_WORDS = ("phone", "phone no", "telephone", "tel", "mobile number", "mobile no", "mobile phone", "cellphone", "whatsapp", "手机", "电话")
PASSPORT_WORDS = ("passport", "护照", "passport no", "passport number")
BIRTH_WORDS = ("dob", "date of birth", "birthday", "birth date", "出生", "生日")
SECRETS = (("sk-", 20), ("sk_live_", 16), ("rk_live_", 16), ("ghp_", 36), ("gho_", 36), ("github_pat_", 22), ("xoxb-", 20), ("xoxp-", 20), ("AKIA", 16), ("ASIA", 16), ("AIza", 30))
SEPARATORS = "[ \\-.,/\\x{2013}\\x{2014}]"
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"


def scan_view(text: Column) -> Column:
    """Invisible separators dropped, special spaces and full-width letters and digits of four scripts folded to ASCII. Texts without any of them stay as they are."""
    dropped = IGNORABLE[:-1] + "\\x{2028}-\\x{202E}\\x{180B}-\\x{180E}]"
    pairs = {"\xa0": " ", "\u2007": " ", "\u202f": " "}
    pairs |= {chr(0xFF21 + i): chr(65 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
    for base in (0xFF10, 0x660, 0x6F0, 0x966):
        pairs |= {chr(base + i): str(i) for i in range(10)}
    folded = F.translate(F.regexp_replace(text, dropped, ""), "".join(pairs), "".join(pairs.values()))
    some = dropped[:-1] + "\\xA0\\x{2007}\\x{202F}\\x{FF10}-\\x{FF5A}\\x{660}-\\x{669}\\x{6F0}-\\x{6F9}\\x{966}-\\x{96F}]"
    return F.when(text.rlike(some), folded).otherwise(text)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _entity(kind: str, redacted: Column, verified: Column | bool) -> Column:
    return F.struct(F.lit(kind).alias("kind"), redacted.alias("redacted"), (F.lit(verified) if isinstance(verified, bool) else verified).alias("verified"))


def _none() -> Column:
    return F.array().cast(ENTITY)


def _guard(text: Column, pattern: str, found: Column) -> Column:
    return F.when(text.rlike(pattern), found.cast(ENTITY)).otherwise(_none())


def keyword_in(context: Column, words) -> Column:
    """Whether a context holds one of some key words; those of ASCII letters as whole words."""
    plain, other = [w for w in words if w.isascii()], [w for w in words if not w.isascii()]
    return F.lower(context).rlike(f"(?<!{A})(?:{'|'.join(plain)})(?!{A})" + "".join(f"|{w}" for w in other))


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def plausible_card(d: Column) -> Column:
    """Issuer prefixes by length; never one digit repeated."""
    first, two, three, four = (F.substring(d, 1, k) for k in (1, 2, 3, 4))
    by = (
        F.when(F.length(d) == 13, first == "4")
        .when(F.length(d) == 14, three.between("300", "305") | (four == "3095") | two.isin("36", "38", "39"))
        .when(F.length(d) == 15, two.isin("34", "37"))
        .when(F.length(d) == 16, (first == "4") | two.between("51", "55") | four.between("2221", "2720") | (four == "6011") | two.isin("62", "64", "65") | four.between("3528", "3589"))
        .when(F.length(d) == 19, (first == "4") | two.isin("62", "65"))
        .otherwise(False)
    )
    return by & ~d.rlike("^(.)\\1*$")


def card_window(groups: Column) -> Column:
    """The first single group, else the first run of neighbouring groups, that is a card number; null if there is none."""
    card = lambda d: luhn(d) & plausible_card(d)
    single = F.get(F.filter(groups, lambda g: F.length(g).between(13, 19) & card(g)), F.lit(0))

    def shaped(s: Column) -> Column:
        sizes = F.transform(s, F.length)
        first, last = F.get(sizes, F.lit(0)), F.size(sizes) - 1
        even = F.forall(F.transform(sizes, lambda x, i: (x == first) | ((i == last) & (x < first))), lambda x: x)
        return F.forall(sizes, lambda x: x.between(3, 6)) & ((sizes == F.array(F.lit(4), F.lit(6), F.lit(5))) | even)

    starts = F.sequence(F.lit(1), F.size(groups))
    spans = F.flatten(F.transform(starts, lambda a: F.transform(F.sequence(F.lit(3), F.lit(6)), lambda k: F.slice(groups, a, k))))
    whole = F.filter(spans, lambda s: F.length(F.array_join(s, "")).between(13, 19) & shaped(s))
    window = F.get(F.filter(F.transform(whole, lambda s: F.array_join(s, "")), card), F.lit(0))
    return F.coalesce(single, window)


#: Seven digits in a row, with or without separators: what every scanner of digits needs, and a text seldom has.
SEVEN = f"[0-9](?:{SEPARATORS}?[0-9]){{6}}"


def scan_digit_runs(text: Column) -> Column:
    """Payment cards (Luhn and issuer) and, failing that, phone numbers (after + or a key word)."""
    run = f"(?<!{A})[0-9]++(?:{SEPARATORS}[0-9]++)*+{A}?"
    found = F.arrays_zip(_all(text, run).alias("run"), _all(text, f"(?=[0-9])(?<!{A}){BEFORE}{run}", 1).alias("before"))

    def one(r: Column) -> Column:
        groups = F.split(r["run"], SEPARATORS, -1)
        digits = F.array_join(groups, "")
        sure = (F.size(groups) <= 5) | keyword_in(r["before"], CARD_WORDS)
        phone = (F.length(digits).between(8, 15) & r["before"].endswith("+")) | (F.length(digits).between(7, 13) & keyword_in(r["before"], PHONE_WORDS))
        card = F.when(F.length(digits) >= 13, card_window(groups))
        return bind(card, lambda c: F.when(c.isNotNull(), _entity("payment_card", redact_tail(c, 4), sure)).when(phone, _entity("phone_number", redact_tail(digits, 3), False)))

    return _guard(text, SEVEN, F.array_compact(F.transform(F.filter(found, lambda r: r["run"].rlike("[0-9]$")), one)))


def iban_checks(token: Column) -> Column:
    """Country letters, two digits, and 1 modulo 97 with letters as 10 to 35."""
    moved = F.concat(F.substring(token, 5, 40), F.substring(token, 1, 4))
    digits = F.filter(F.split(moved, ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(digits, F.lit(0), lambda acc, c: F.when(value(c) > 9, (acc * 100 + value(c)) % 97).otherwise((acc * 10 + value(c)) % 97))
    return token.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1)


#: Two letters with two digits behind them, the digits in the same token or the next one.
IBAN_HEAD = "(?<![A-Za-z0-9])(?=[A-Za-z]{2}(?:[0-9]{2}|[0-9]?[^A-Za-z0-9]+[0-9]))"


def scan_iban(text: Column) -> Column:
    """IBANs in one token, or in neighbouring tokens of two to four characters put together. Only what stands behind such a head is cut into tokens."""
    heads = _all(text, f"{IBAN_HEAD}(?=((?:[A-Za-z0-9]++[^A-Za-z0-9]++){{0,16}}+[A-Za-z0-9]*+))[A-Za-z]", 1)

    def readings(head: Column) -> Column:
        tokens = F.filter(F.split(F.upper(head), "[^A-Z0-9]+", -1), lambda x: x != "")
        joined = lambda t: F.transform(F.filter(F.transform(F.sequence(F.lit(4), F.lit(17)), lambda k: F.slice(t, F.lit(1), k)), lambda s: F.forall(s, lambda x: F.length(x).between(2, 4))), lambda s: F.array_join(s, ""))
        return bind(tokens, lambda t: F.filter(F.concat(F.slice(t, 1, 1), joined(t)), lambda x: F.length(x).between(15, 34) & iban_checks(x)))

    made = F.transform(F.array_distinct(F.flatten(F.transform(heads, readings))), lambda x: _entity("iban", F.concat(F.substring(x, 1, 2), F.lit("••"), redact_tail(x, 4)), True))
    return _guard(text, f"{IBAN_HEAD}[A-Za-z]", made)


def scan_national_id(text: Column) -> Column:
    """18 characters whose last one is the weighted check of the others."""
    ids = _all(text, f"(?<!{A})[0-9]{{17}}[0-9Xx](?!{A})")
    weights = F.array(*map(F.lit, ID_WEIGHTS))

    def valid(x: Column) -> Column:
        total = F.aggregate(F.zip_with(F.slice(F.split(x, ""), 1, 17), weights, lambda c, w: c.cast("int") * w), F.lit(0), lambda a, b: a + b)
        return F.substr(F.lit(ID_CHECKS), total % 11 + 1, F.lit(1)) == F.upper(F.right(x, F.lit(1)))

    made = F.transform(F.filter(ids, valid), lambda x: _entity("national_id_cn", F.concat(F.lit("••••••"), F.substring(x, 17, 1)), True))
    return _guard(text, "[0-9]{17}", made)


def scan_emails(text: Column) -> Column:
    """Addresses by their @; the top-level domain has 2 to 24 letters."""
    pattern = "([A-Za-z0-9._%+\\-]+)@(?=([A-Za-z0-9.\\-]*))"
    parts = F.arrays_zip(_all(text, pattern, 1).alias("local"), F.transform(_all(text, pattern, 2), lambda d: F.regexp_replace(d, "[.]+$", "")).alias("domain"))
    made = F.transform(F.filter(parts, lambda p: p["domain"].rlike("[.][A-Za-z]{2,24}$")), lambda p: _entity("email", F.concat(F.substring(p["local"], 1, 1), F.lit("…@"), p["domain"]), False))
    return F.when(text.contains("@"), made.cast(ENTITY)).otherwise(_none())


def scan_ssn(text: Column) -> Column:
    areas = _all(text, f"(?<!{A})((?!000|666|9)[0-9]{{3}})-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}(?!{A})", 1)
    return _guard(text, "[0-9]{3}-[0-9]{2}-[0-9]{4}", F.transform(areas, lambda a: _entity("ssn", F.concat(a, F.lit("-••-••••")), False)))


def scan_api_secrets(text: Column) -> Column:
    shapes = [f"{p}(?=[A-Za-z0-9_]{{{n}}})" for p, n in SECRETS]
    found = F.transform(_all(text, f"(?<![A-Za-z0-9_\\-])(?:{'|'.join(shapes)})"), lambda p: _entity("api_secret", F.concat(p, F.lit("…")), True))
    pem = F.when(text.contains("-----BEGIN") & text.contains("PRIVATE KEY-----"), F.array(_entity("api_secret", F.lit("pem_private_key"), True)).cast(ENTITY)).otherwise(_none())
    return F.concat(F.when(any_of(text, [p for p, _ in SECRETS]), found.cast(ENTITY)).otherwise(_none()), pem)


def scan_passports(text: Column) -> Column:
    """Tokens of 6 to 9 letters and digits, both, after a key word."""
    token = f"(?<!{A})[A-Za-z0-9]++"
    found = F.arrays_zip(_all(text, token).alias("t"), _all(text, f"(?=[A-Za-z0-9])(?<!{A}){BEFORE}{token}", 1).alias("before"))
    usable = F.filter(found, lambda r: r["t"].rlike("^[A-Za-z0-9]{6,9}$") & r["t"].rlike("[0-9]") & r["t"].rlike("[A-Za-z]") & keyword_in(r["before"], PASSPORT_WORDS))
    return _guard(text, "(?i)passport|护照", F.transform(usable, lambda r: _entity("passport_number", redact_tail(r["t"], 2), False)))


def scan_birth_dates(text: Column) -> Column:
    """Dates of 6 to 8 digits with two separators after a key word."""
    run = "(?<![0-9])[0-9]++(?:[\\-/.年月][0-9]++)*+"
    found = F.arrays_zip(_all(text, run).alias("t"), _all(text, f"(?=[0-9])(?<![0-9]){BEFORE}{run}", 1).alias("before"))
    digits = lambda t: F.length(F.regexp_replace(t, "[^0-9]", ""))
    usable = F.filter(found, lambda r: digits(r["t"]).between(6, 8) & (F.length(r["t"]) - digits(r["t"]) >= 2) & keyword_in(r["before"], BIRTH_WORDS))
    return _guard(text, "(?i)dob|birth|出生|生日", F.transform(usable, lambda r: _entity("date_of_birth", F.lit("date_near_birth_keyword"), False)))


#: The scanners behind one look each: those of digits, those of key words, and the others with a look of their own.
OF_DIGITS, OF_KEYWORDS, OTHERS = (scan_digit_runs, scan_national_id, scan_ssn), (scan_passports, scan_birth_dates), (scan_api_secrets, scan_iban, scan_emails)


def recognise(text: Column) -> Column:
    """All distinct entities of a text by (kind, redacted); empty for null and empty texts."""

    def of(t: Column) -> Column:
        some = lambda guard, scanners: F.when(t.rlike(guard), F.concat(*[s(t) for s in scanners])).otherwise(_none())
        return F.array_sort(F.array_distinct(F.concat(some(SEVEN, OF_DIGITS), some("(?i)passport|dob|birth|护照|出生|生日", OF_KEYWORDS), *[s(t) for s in OTHERS])))

    return bind(scan_view(F.coalesce(text, F.lit(""))), of)


def has_verified(entities: Column) -> Column:
    return F.exists(entities, lambda e: e["verified"])


def confidentiality(entities: Column) -> Column:
    """Rank of the most confidential entity (all kinds are high, 2); null if there is none."""
    return F.when(F.size(entities) > 0, F.lit(2))


def mask_tokens(text: Column) -> Column:
    """IBAN-shaped tokens and credentials masked but for their last four characters; a text with a private key goes as a whole."""
    token = "(?<![A-Za-z0-9_\\-])([A-Za-z]{2}[0-9]{2}[A-Za-z0-9]{7,26}|(?:sk-|sk_live_|rk_live_|ghp_|gho_|github_pat_|xoxb-|xoxp-|AKIA|ASIA|AIza)(?=[A-Za-z0-9_\\-]*)[A-Za-z0-9_\\-]+?)([A-Za-z0-9_\\-]{4})(?![A-Za-z0-9_\\-])"
    whole = lambda out: F.when(out.contains("-----BEGIN") & out.contains("PRIVATE KEY-----"), F.lit("[redacted: pem_private_key]")).otherwise(out)
    return bind(F.regexp_replace(text, token, "•••• $2"), whole)


def mask_runs(text: Column) -> Column:
    """mask_tokens, and runs of 13 and more digits masked but for their last four characters."""
    run = f"(?<!{A})(?=[0-9](?:{SEPARATORS}?[0-9]){{12}})[0-9](?:{SEPARATORS}?[0-9])*+"
    tail = lambda m: redact_tail(m, 4)
    masked = lambda hits: F.when(F.size(hits) > 0, F.aggregate(hits, text, lambda t, m: F.replace(t, m, tail(m)))).otherwise(text)
    return mask_tokens(bind(_all(text, run), masked))


#: Digits that a log line may show in a row.
PLAIN_DIGITS = 6


def log_safe(text: Column) -> Column:
    """Log hygiene: invisible characters dropped, control characters to spaces, credentials, token values and long digit runs masked."""
    named = ("token", "password", "passwd", "secret", "apikey", "api-key", "api_key", "bearer", "authorization")
    # Each pattern reads a text only behind a cheaper look for what it can't match without, and each step is made once.
    shown = F.when(text.rlike("[^\\x00-\\x7F]"), F.regexp_replace(text, IGNORABLE, "")).otherwise(text)
    plain = lambda t: F.regexp_replace(t, "[\\x00-\\x1F\\x7F]+", " ")
    jwt = lambda t: F.when(t.contains("eyJ"), F.regexp_replace(t, "eyJ[A-Za-z0-9_\\-]{8,}\\.[A-Za-z0-9_\\-]{8,}\\.[A-Za-z0-9_\\-]+", "[redacted: jwt]")).otherwise(t)
    value = lambda t: F.when(any_of(F.lower(t), named), F.regexp_replace(t, "(?i)\\b(token|password|passwd|secret|api[_-]?key|bearer|authorization)(\\s*[=:]\\s*|\\s+)(\"?)[A-Za-z0-9_\\-./+=]{8,}", "$1$2$3[redacted]")).otherwise(t)
    runs = lambda t: F.when(t.rlike("[0-9][^0-9]?[0-9]") | any_of(t, [p for p, _ in SECRETS]) | t.contains("-----BEGIN"), mask_runs(t)).otherwise(t)
    digits = lambda t: F.when(t.rlike(f"[0-9]{{{PLAIN_DIGITS + 1}}}"), F.regexp_replace(t, f"(?<![0-9A-Za-z_\\-•])[0-9]{{{PLAIN_DIGITS - 3},}}(?=[0-9]{{4}}(?![0-9A-Za-z_\\-]))", "•••• ")).otherwise(t)
    for step in (plain, jwt, value, runs, digits):
        shown = bind(shown, step)
    return shown
