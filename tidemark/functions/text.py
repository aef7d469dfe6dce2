"""Text views and text checks as built-in expressions: matching views, masks, anomalies, breakouts, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that a match ignores, tag characters, and what screens don't show.
IGNORABLE = "[\\x{AD}\\x{34F}\\x{61C}\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FEFF}\\x{FE00}-\\x{FE0F}\\x{E0000}-\\x{E007F}\\x{E0100}-\\x{E01EF}]"
TAGS = "[\\x{E0000}-\\x{E007F}]"
INVISIBLE = "[\\x{200B}\\x{2060}\\x{FEFF}\\x{180E}\\x{2061}-\\x{2064}\\x{206A}-\\x{206F}\\x{FFF9}-\\x{FFFB}\\x{3164}\\x{115F}-\\x{1160}\\x{2800}\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}\\x{E0000}-\\x{E007F}]"
SELECTORS = "\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}"
COMBINING = "[\\x{300}-\\x{36F}\\x{1AB0}-\\x{1AFF}\\x{1DC0}-\\x{1DFF}\\x{20D0}-\\x{20FF}\\x{FE20}-\\x{FE2F}]"
ALNUM = "\\p{IsAlphabetic}\\p{N}"
#: Strings known to upset tokenizers, and markers that forge a turn of conversation.
GLITCH_TOKENS = ("solidgoldmagikarp", "petertodd", "rawdownload", "cloneembedreportprint", "externaltoevaonly", "guiactivebounds", "davidjl", "attrot", "srfattach", "embedreportprint")
ROLE_MARKERS = ("<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "[inst]", "[/inst]", "<<sys>>", "<</sys>>", "###system:", "###instruction:")
#: The name of this engine's envelope around observed content.
ENVELOPE = "observed:content"
ANOMALY_RANK = {"invisible_text": 5, "bidi_override": 4, "homoglyph": 3, "glitch_token": 2, "combining_stack": 1, "oversized_token": 0}
MAX_TOKEN, MAX_STACK = 2048, 3


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def any_of(c: Column, needles) -> Column:
    """Whether c contains one of some fixed strings."""
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def normalize(text: Column) -> Column:
    """The view that matching reads: ignorable code points dropped, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, IGNORABLE, ""), "(?U)\\s+", " "))


def matching_views(text: Column) -> Column:
    """The normalised text, and each run of tag characters decoded; runs that spell one of the three tag flags are no text."""
    tag = lambda s: "".join(f"\\x{{{0xE0000 + ord(x):X}}}" for x in s)
    flags = "|".join(map(tag, ("gbeng", "gbsct", "gbwls")))
    plain = F.regexp_replace(text, f"\\x{{1F3F4}}(?:{flags})\\x{{E007F}}(?!{TAGS})", " ")
    hidden = F.regexp_extract_all(plain, F.lit(f"({TAGS}+)"), F.lit(1))
    shown = "".join(map(chr, range(0x20, 0x7F)))
    tags = "".join(chr(0xE0000 + ord(x)) for x in shown)
    lost = "".join(chr(x) for x in [*range(0xE0000, 0xE0020), 0xE007F])
    decoded = F.filter(F.transform(hidden, lambda h: F.translate(h, tags + lost, shown)), lambda h: h != "")
    return F.concat(F.array(normalize(text)), F.transform(decoded, normalize))


def redact_tail(value: Column, keep: int) -> Column:
    """Four dots and the last keep characters; the dots alone if there are no more than that."""
    return F.when(F.length(value) <= keep, F.lit("••••")).otherwise(F.concat(F.lit("•••• "), F.right(value, F.lit(keep))))


def escape_markup(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def wrap(origin: Column, source: Column, verified: Column, content: Column) -> Column:
    """Content in an envelope that tells its origin, source (if not null) and trust."""
    named = F.coalesce(F.concat(F.lit(' source="'), escape_markup(source), F.lit('"')), F.lit(""))
    trust = F.when(verified, "verified").otherwise("tainted")
    return F.concat(F.lit(f'<{ENVELOPE} origin="'), origin, F.lit('"'), named, F.lit(' trust="'), trust, F.lit('">\n'), escape_markup(content), F.lit(f"\n</{ENVELOPE}>"))


def decode_references(text: Column) -> Column:
    """Named and numeric character references decoded; others stay."""
    named = {"lt": "<", "gt": ">", "verbar": "|", "vert": "|", "num": "#", "colon": ":", "lbrack": "[", "rbrack": "]", "sol": "/"}
    parts = F.split(text, "(?=&)", -1)

    def one(p: Column) -> Column:
        body = F.lower(F.regexp_extract(p, "^&([^;]{1,10});", 1))
        rest = F.regexp_replace(p, "^&[^;]{1,10};", "")
        out = p
        code = F.when(body.rlike("^#x[0-9a-f]{1,6}$"), F.conv(F.substring(body, 3, 8), 16, 10)).when(body.rlike("^#[0-9]{1,7}$"), F.substring(body, 2, 8)).cast("int")
        usable = code.isNotNull() & (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        points = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        out = F.when(usable, F.concat(points, rest)).otherwise(out)
        for k, v in {**named, "amp": "&"}.items():
            out = F.when(body == k, F.concat(F.lit(v), rest)).otherwise(out)
        return out

    return F.when(text.contains("&") & text.contains(";"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def marker_view(text: Column) -> Column:
    """What marker checks read: references decoded, full-width signs narrowed, white space and ignorable code points dropped, lower case."""
    ignorable = "[\\x{AD}\\x{600}-\\x{605}\\x{61C}\\x{6DD}\\x{70F}\\x{8E2}\\x{180B}-\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FEFF}\\x{FFF9}-\\x{FFFB}\\x{110BD}\\x{110CD}\\x{13430}-\\x{1343F}\\x{1BCA0}-\\x{1BCA3}\\x{1D173}-\\x{1D17A}\\x{E0000}-\\x{E007F}\\x{115F}-\\x{1160}\\x{3164}\\x{FFA0}\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}\\x{300}-\\x{36F}\\x{1AB0}-\\x{1AFF}\\x{1DC0}-\\x{1DFF}\\x{20D0}-\\x{20F0}\\x{FE20}-\\x{FE2F}]"
    narrow = F.translate(decode_references(text), "＜＞｜［］＃：", "<>|[]#:")
    return F.lower(F.regexp_replace(F.regexp_replace(narrow, "(?U)\\s+", ""), ignorable, ""))


def detect_breakout(text: Column, envelope: str = ENVELOPE) -> Column:
    """'envelope_close', 'envelope_open', 'role_marker:<marker>' or null, the first that holds."""
    space = envelope.split(":")[0]

    def of(n: Column) -> Column:
        checks = [F.when(n.contains(f"</{space}:"), "envelope_close"), F.when(n.contains(f"<{space}:"), "envelope_open")]
        return F.coalesce(*checks, *[F.when(n.contains(m), f"role_marker:{m}") for m in ROLE_MARKERS])

    return bind(marker_view(text), of)


def scan_anomalies(text: Column) -> Column:
    """array<struct<kind, count>> of the anomalies of a text, in the fixed order of the checks; empty for null. A text of ASCII alone is read for two of
    the kinds only, and each other check runs behind a look at what it counts."""
    tag = lambda s: "".join(f"\\x{{{0xE0000 + ord(x):X}}}" for x in s)
    flags = "|".join(map(tag, ("gbeng", "gbsct", "gbwls")))
    latin, cyrillic = "[\\p{IsLatin}&&\\p{IsAlphabetic}]", "[\\p{IsCyrillic}&&\\p{IsAlphabetic}]"
    count = lambda t, p: F.coalesce(F.regexp_count(t, F.lit(p)), F.lit(0))
    longest = lambda t, p: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), F.length)), F.lit(0))
    behind = lambda guard, n: F.when(guard, n).otherwise(F.lit(0))

    def invisible(t: Column) -> Column:
        bare = F.when(t.contains("\U0001f3f4"), F.regexp_replace(t, f"\\x{{1F3F4}}(?:{flags})\\x{{E007F}}(?!{TAGS})", "")).otherwise(t)
        return bind(bare, lambda x: count(x, INVISIBLE) - count(x, f"(?<=[^\\x00-\\x7F{SELECTORS}])[{SELECTORS}]"))

    def homoglyphs(t: Column) -> Column:
        words = F.regexp_extract_all(t, F.lit("[\\p{IsAlphabetic}&&[\\p{IsLatin}\\p{IsCyrillic}]]+"), F.lit(0))
        mixed = lambda w: w.rlike(cyrillic) & (F.regexp_count(w, F.lit(latin)) >= 2)
        pure = lambda w: w.rlike(cyrillic) & ~w.rlike(latin)
        return bind(words, lambda w: F.size(F.filter(w, mixed)) + F.when(count(t, latin) > count(t, cyrillic), F.size(F.filter(w, pure))).otherwise(0))

    def of(s: Column) -> Column:
        t, odd = s["t"], s["odd"]
        glitch = bind(F.lower(t), lambda low: sum((low.contains(g).cast("int") for g in GLITCH_TOKENS), F.lit(0)))
        found = [
            ("invisible_text", behind(odd & t.rlike(INVISIBLE), invisible(t))), ("bidi_override", behind(odd, count(t, "[\\x{202D}\\x{202E}]"))), ("homoglyph", behind(odd & t.rlike(cyrillic), homoglyphs(t))),
            ("combining_stack", behind(odd & t.rlike(f"{COMBINING}{{{MAX_STACK}}}"), longest(t, f"{COMBINING}{{{MAX_STACK},}}"))), ("oversized_token", behind(F.length(t) > MAX_TOKEN, longest(t, f"(?U)(?<!\\S)\\S{{{MAX_TOKEN + 1},}}"))), ("glitch_token", glitch),
        ]
        rows = F.array(*[F.struct(F.lit(k).alias("kind"), n.cast("int").alias("count")) for k, n in found])
        return F.filter(rows, lambda a: a["count"] > 0)

    return bind(F.struct(text.alias("t"), text.rlike("[^\\x00-\\x7F]").alias("odd")), of)


def anomaly_rank(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, r in ANOMALY_RANK.items():
        out = F.when(kind == k, r).otherwise(out)
    return out


def worst_anomaly(found: Column) -> Column:
    """The kind of the highest rank; null if there is none."""
    return F.array_max(F.transform(found, lambda a: F.struct(anomaly_rank(a["kind"]).alias("rank"), a["kind"].alias("kind"))))["kind"]


def anomaly_summary(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda a: F.concat(a["kind"], F.lit(" ×"), a["count"].cast("string"))), ", ")


#: Words that tell of instructions, alone or two together.
STRONG_WORDS = ("ignore", "disregard", "instruction", "instructions", "override", "exfiltrate", "attacker", "mnemonic", "jailbreak", "忽略", "指令", "攻击", "助记", "私钥")
WEAK_WORDS = (
    "system", "prompt", "assistant", "previous", "transfer", "send", "email", "forward", "upload", "recovery", "codes", "code", "password", "passcode", "otp", "secret", "credential", "credentials", "wallet", "seed", "private", "key", "urgent", "immediately", "execute", "approve", "confirm", "pay", "payment",
    "转账", "汇款", "密码", "验证", "立即", "发送", "支付", "付款", "确认", "秘密", "钱包",
)
MIN_TOKENS, MIN_DIVERGENT, DIVERGENCE, MINORITY, BULK, MAX_LINES, LINE_JOIN = 4, 3, 0.5, 0.15, 16, 24, " / "
UNSEGMENTED = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{AC00}-\\x{D7AF}\\x{20000}-\\x{2EBEF}]"


def tokenize(text: Column) -> Column:
    """Sorted distinct lower-cased tokens of two letters or digits and more; tokens of mostly unsegmented script as pairs. Bracketed markers are no text."""
    raw = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\\[[A-Z]{2}_[A-Z0-9_]+\\]", " "), f"[^{ALNUM}]+"), lambda t: F.length(t) >= 2)
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.lower(F.substr(t, i, F.lit(2))))
    each = F.transform(raw, lambda t: F.when(F.regexp_count(t, F.lit(UNSEGMENTED)) * 2 > F.length(t), pairs(t)).otherwise(F.array(F.lower(t))))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def instruction_shape(tokens: Column) -> Column:
    weak = F.array_intersect(tokens, F.array(*map(F.lit, WEAK_WORDS)))
    return F.arrays_overlap(tokens, F.array(*map(F.lit, STRONG_WORDS))) | (F.size(weak) >= 2)


def compare_views(tree: Column, screen: Column) -> Column:
    """Struct of token counts, differences and Jaccard similarity of two texts; null if either has fewer than four tokens."""

    def of(s: Column) -> Column:
        a, b = s["a"], s["b"]
        shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
        return F.when(
            (F.size(a) >= MIN_TOKENS) & (F.size(b) >= MIN_TOKENS),
            F.struct(F.size(a).alias("tree_tokens"), F.size(b).alias("screen_tokens"), shared.alias("shared"), F.array_except(b, a).alias("screen_only"), F.array_except(a, b).alias("tree_only"), (shared / union).alias("jaccard")),
        )

    return bind(F.struct(tokenize(tree).alias("a"), tokenize(screen).alias("b")), of)


def view_findings(comparison: Column, screen: Column) -> Column:
    """Findings of compare_views: 'screen_text_not_in_tree' and 'tree_text_not_on_screen'; a screen text cut off in bulk proves nothing about the tree's."""

    def of(c: Column) -> Column:
        screen_only = (F.size(c["screen_only"]) >= MIN_DIVERGENT) & (F.size(c["screen_only"]) / c["screen_tokens"] > DIVERGENCE)
        tree_only = (F.size(c["tree_only"]) >= MIN_DIVERGENT) & (F.size(c["tree_only"]) / c["tree_tokens"] > MINORITY) & instruction_shape(c["tree_only"])
        lines = F.size(F.split(screen, F.lit(LINE_JOIN), -1))
        bulk = (lines >= MAX_LINES) & (F.size(c["tree_only"]) > BULK)
        return F.array_compact(F.array(F.when(screen_only, F.lit("screen_text_not_in_tree")), F.when(tree_only & ~bulk, F.lit("tree_text_not_on_screen"))))

    return bind(comparison, of)


#: Letters that look like ASCII ones, and digits that stand for letters.
LOOKALIKES = {
    "àáâãäåāăą": "a", "çćčĉċҫс": "c", "ďđԁ": "d", "èéêëēĕėęěеε": "e", "ғ": "f", "ĝğġģɡԍ": "g", "ĥħһн": "h", "ìíîïĩīĭįıіι": "i", "ĵј": "j", "ķкκ": "k", "ĺļľŀłӏ": "l", "м": "m", "ñńņňη": "n", "òóôõöøōŏőоο": "o",
    "рρ": "p", "ԛ": "q", "ŕŗř": "r", "śŝşšѕ": "s", "ţťŧтτ": "t", "ùúûüũūŭůűųυ": "u", "ѵν": "v", "ŵԝω": "w", "хχ": "x", "ýÿŷуγ": "y", "źżžζ": "z", "аα": "a", "вβ": "b",
}
LEET = {"0": "o", "1": "l", "3": "e", "5": "s", "7": "t"}


def fold_label(label: Column) -> Column:
    """A label folded for look-alike checks: narrow, lower case, lookalike letters and single digits between letters mapped, letters and digits only."""
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F))
    plain = F.lower(F.translate(F.regexp_replace(label, IGNORABLE, ""), wide, narrow))
    folded = F.translate(plain, "".join(LOOKALIKES), "".join(v * len(k) for k, v in LOOKALIKES.items()))
    folded = F.regexp_replace(folded, f"[^{ALNUM}]", "")
    for digit, letter in LEET.items():
        folded = F.regexp_replace(folded, f"(?<=\\p{{IsAlphabetic}}){digit}(?=\\p{{IsAlphabetic}})", letter)
    return F.substring(folded, 1, 65)


def label_weight(folded: Column) -> Column:
    """ASCII letters and digits weigh 1, all others 3."""
    narrow = F.coalesce(F.regexp_count(folded, F.lit("[A-Za-z0-9]")), F.lit(0))
    return narrow + (F.length(folded) - narrow) * 3


def _typos(folded: Column, seen: Column | None = None) -> Column:
    """The neighbour swaps, doubled letters and undoubled letters of a string; with seen, those of its length only."""
    n = F.length(folded)
    at = lambda i, k=1: F.substr(folded, i, F.lit(k))
    left = lambda i: F.substr(folded, F.lit(1), i - 1)
    swap = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(left(i), at(i + 1), at(i), F.substr(folded, i + 2)))
    double = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(left(i), at(i), at(i), F.substr(folded, i + 1)))
    single = F.transform(F.filter(F.sequence(F.lit(1), n - 1), lambda i: at(i) == at(i + 1)), lambda i: F.concat(left(i), F.substr(folded, i + 1)))
    if seen is None:
        return F.array_distinct(F.concat(swap, double, single))
    more = F.length(seen) - n
    return F.when(more == 0, swap).when(more == 1, double).when(more == -1, single)


def _typable(folded: Column) -> Column:
    return F.length(folded).between(5, 64) & (label_weight(folded) >= 5)


def typo_variants(folded: Column) -> Column:
    """Every neighbour swap, doubled letter and undoubled letter of a folded label of 5 to 64 characters, but for itself."""
    none = F.array().cast("array<string>")
    return bind(folded, lambda x: F.when(_typable(x), F.filter(_typos(x), lambda v: (v != x) & _typable(v))).otherwise(none))


def is_typo(folded: Column, seen: Column) -> Column:
    """Whether seen is one of the typo_variants of a folded label, without making all of them: its length tells which kind it could be. Null if seen is."""

    def of(s: Column) -> Column:
        x, v = s["x"], s["v"]
        hit = F.array_contains(_typos(x, v), v)
        return F.when(v.isNull(), F.lit(None).cast("boolean")).when((v == x) | (F.abs(F.length(v) - F.length(x)) > 1), False).otherwise(F.coalesce(_typable(x) & _typable(v) & F.coalesce(hit, F.lit(False)), F.lit(False)))

    return bind(F.struct(folded.alias("x"), seen.alias("v")), of)


def is_newer_version(new: Column, old: Column) -> Column:
    """Whether a version is greater by its numbers between dots, dashes and underscores; parts that aren't numbers don't count, missing ones are 0."""
    parts = lambda v: F.transform(F.filter(F.split(v, "[._-]", -1), lambda p: p.rlike("^[0-9]{1,18}$")), lambda p: p.cast("long"))
    pad = lambda a, b: F.concat(a, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.size(b) - F.size(a), F.lit(0))))
    return bind(F.struct(parts(new).alias("a"), parts(old).alias("b")), lambda s: pad(s["a"], s["b"]) > pad(s["b"], s["a"]))


def excerpt(text: Column, n: int) -> Column:
    """At most n characters, and how many were left out."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…(+"), (F.length(text) - n).cast("string"), F.lit(" chars)"))).otherwise(text)
