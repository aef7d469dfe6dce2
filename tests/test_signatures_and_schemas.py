"""Ed25519 against RFC 8032, signed logs with every kind of fault, and JSON Schema keyword by keyword."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ed25519, json_schema
from tidemark.operators import audit, signatures

h = bytes.fromhex
# Test vectors of RFC 8032, section 7.1 (secret, public key, message, signature).
VECTORS = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
]


@pytest.mark.parametrize("seed, key, message, signature", VECTORS)
def test_rfc_vectors(seed, key, message, signature):
    assert ed25519.public_key(h(seed)) == h(key) and ed25519.sign(h(seed), h(message)) == h(signature)
    assert ed25519.verified([(h(key), h(message), h(signature))]) == [True]


def test_batches_find_the_bad_ones():
    rng = random.Random(1)
    seeds = [rng.randbytes(32) for _ in range(3)]
    keys = [ed25519.public_key(s) for s in seeds]
    rows = [(keys[i % 3], b"%d" % i, ed25519.sign(seeds[i % 3], b"%d" % i)) for i in range(60)]
    assert ed25519.verified(rows) == [True] * 60 and ed25519.verified([]) == []
    bad = {3: (keys[0], b"other", rows[3][2]), 20: (keys[1], b"20", rows[20][2]), 31: (keys[1], b"31", rows[31][2][:32] + (int.from_bytes(rows[31][2][32:], "little") + ed25519.L).to_bytes(32, "little")), 40: (b"short", b"40", rows[40][2]), 41: (keys[2], b"41", b""), 42: (b"\xff" * 32, b"42", rows[42][2]), 59: (keys[2], b"59", rows[59][2][:32] + bytes(32))}
    assert ed25519.verified([bad.get(i, r) for i, r in enumerate(rows)]) == [i not in bad for i in range(60)]


def test_signed_logs(spark):
    seed, other = bytes(range(32)), bytes(32)
    rows = [(log, i, f"{log}{i}", i + 1 - 10 * (log == "b")) for log in ("a", "b") for i in range(10 * (log == "b"), 10 * (log == "b") + 8)]
    d = spark.createDataFrame(rows, "log_id string, rowid long, id string, seq long")
    for c in (*audit.FIELDS[1:], "attributed_agent"):
        d = d.withColumn(c, F.lit(7).cast("long") if c == "timestamp_ms" else F.lit("x"))
    d = signatures.signed(audit.chain(d, audit.canonical_content()), seed).cache()
    key = ed25519.public_key(seed)

    def states(rows, key=key):
        return {r["id"]: (r["state"], r["ok"]) for r in signatures.checked(rows, key).collect()}

    def report(rows):
        return {r["log_id"]: tuple(r)[1:] for r in signatures.verify_signatures(rows, key).collect()}

    good = (True, 8, 8, 0, 0, 8, None)
    assert report(d) == {"a": good, "b": good}
    only = lambda c, v: F.when(F.col("id") == "a3", v).otherwise(F.col(c))
    assert report(d.withColumn("record_sig", only("record_sig", F.lit(None)))) == {"a": (False, 8, 7, 1, 0, 7, "a3"), "b": good}
    assert report(d.withColumn("signer_key_id", only("signer_key_id", F.lit("feed")))) == {"a": (False, 8, 8, 0, 1, 7, "a3"), "b": good}
    assert states(d.withColumn("signer_key_id", only("signer_key_id", F.lit(""))))["a3"] == ("verified", True)
    assert states(d.withColumn("record_sig", only("record_sig", F.lit("zz"))))["a3"] == ("refused", False) and states(d.withColumn("record_sig", only("record_sig", F.lit("00"))))["a3"] == ("refused", False)
    assert states(d.withColumn("human_message", only("human_message", F.lit("edited"))))["a3"] == ("verified", False)  # the signature is over the hash, the hash over the row
    swapped = states(d.withColumn("log_id", F.when(F.col("id") == "b10", "a").otherwise(F.col("log_id"))))
    assert swapped["b10"][0] == "refused"  # another log's record
    gap = states(d.where("id not in ('a2', 'a5')"))
    assert [k for k, (_, ok) in gap.items() if not ok] == ["a3", "a6"] and gap["a4"] == ("verified", True)
    assert {s for s, _ in states(d.drop("record_sig", "signer_key_id").transform(lambda x: signatures.signed(x, other))).values()} == {"other_key"}
    assert {s for s, _ in states(signatures.signed(d, seed, domain="receipts")).values()} == {"refused"}
    assert signatures.verify_signatures(d.limit(0), key).count() == 0


CASES = [
    ({"type": "object", "required": ["items"], "additionalProperties": False, "properties": {"items": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 1, "maximum": 3}}, "additionalProperties": False}}}},
     [({"items": [{"n": 2}]}, None), ({}, ": required items"), ({"items": []}, "/items: minItems"), ({"items": [{"n": 1}, {"n": 1.0}]}, "/items: uniqueItems"), ({"items": [{"n": 1}, {"n": 4}]}, "/items/1/n: maximum"), ({"items": [{"n": 1.5}]}, "/items/0/n: type"), ({"items": [{"n": 1, "x": 0}]}, "/items/0/x: false"), ({"items": [{"n": 2}], "z/~": 1}, "/z~1~0: false"), ({"items": "x"}, "/items: type")]),
    ({"properties": {"a": {"type": ["string", "null"], "minLength": 2, "maxLength": 3, "pattern": "^[a-zé]+$"}}}, [({"a": None}, None), ({"a": "é"}, "/a: minLength"), ({"a": "éé"}, None), ({"a": "abcd"}, "/a: maxLength"), ({"a": "A1"}, "/a: pattern"), ({"a": 1}, "/a: type"), ({"b": 1}, None)]),
    ({"enum": [1, "1", None, {"b": 1, "a": [2]}]}, [(1, None), (1.0, None), ("1", None), (None, None), ({"a": [2], "b": 1}, None), (2, ": enum"), ([], ": enum")]),
    ({"const": False}, [(False, None), (0, ": const")]),
    ({"exclusiveMinimum": 0, "exclusiveMaximum": 10, "multipleOf": 0.5}, [(0, ": exclusiveMinimum"), (10, ": exclusiveMaximum"), (9.5, None), (9.7, ": multipleOf"), ("x", None)]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}], "not": {"const": 7}}, [("x", None), (6, None), (4, ": anyOf"), (7, ": not")]),
    ({"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}]}, [(2, None), (6, ": oneOf"), (5, ": oneOf")]),
    ({"allOf": [{"required": ["a"]}, {"properties": {"a": {"maximum": 1}}}]}, [({"a": 1}, None), ({}, ": required a"), ({"a": 2}, "/a: maximum")]),
    ({"contains": {"const": 1}, "maxItems": 2}, [([1], None), ([2], ": contains"), ([1, 1, 1], ": maxItems"), ({}, None)]),
    ({"patternProperties": {"^n": {"type": "number"}}, "additionalProperties": {"type": "string"}, "propertyNames": {"maxLength": 3}, "minProperties": 1, "maxProperties": 2}, [({"n1": 2}, None), ({"n1": "x"}, "/n1: type"), ({"o": 2}, "/o: type"), ({"long": "x"}, ": propertyNames"), ({}, ": minProperties"), ({"a": "", "b": "", "c": ""}, ": maxProperties")]),
    (False, [(1, ": false")]),
    (True, [(1, None)]),
    ({"title": "anything"}, [({"a": 1}, None)]),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_schema(spark, n):
    schema, rows = CASES[n]
    d = spark.createDataFrame([(i, json.dumps(v)) for i, (v, _) in enumerate(rows)], "i int, j string")
    got = [r["e"] for r in d.select("i", json_schema.violation(F.parse_json("j"), schema).alias("e")).orderBy("i").collect()]
    assert got == [e for _, e in rows]


def test_schema_refuses_what_it_cannot_hold():
    for schema in ({"$ref": "#/x"}, {"properties": {"a": {"$id": "x"}}}, {"format": "email"}, {"type": "text"}, {"items": [{"type": "string"}]}):
        with pytest.raises((ValueError, TypeError)):
            json_schema.violation(F.parse_json(F.lit("1")), schema)


def test_arguments(spark):
    deep = lambda n: "[" * n + "1" + "]" * n
    rows = [("t", '{"a": 1}', None), ("t", '{"a": "x"}', "/a: type"), ("u", "{}", ": tool"), (None, "{}", ": tool"), ("t", "[1]", ": json"), ("t", "nope", ": json"), ("t", None, ": json"), ("t", json.dumps({"b": "x" * 25_000}), ": bytes"), ("t", json.dumps({"b": [0] * 4095}), ": values"), ("t", json.dumps({"b": [0] * 4094}), None), ("t", '{"b": %s}' % deep(16), ": depth"), ("t", '{"b": %s}' % deep(15), None), ("t", json.dumps({"b": '[[[[,,"' * 30}), None), ("t", '{"b": [%s]}' % ", ".join(["[]"] * 40), None)]
    d = spark.createDataFrame([(i, t, a) for i, (t, a, _) in enumerate(rows)], "i int, tool string, args string")
    got = [r["e"] for r in d.select("i", json_schema.arguments_error(F.col("tool"), F.col("args"), {"t": {"type": "object", "properties": {"a": {"type": "integer"}}}}).alias("e")).orderBy("i").collect()]
    assert got == [e for *_, e in rows]


def test_tables_of_a_key_give_what_single_products_give():
    """Digits at their limits, points that differ by one of small order, and a bad signature among many."""
    for n in (0, 1, ed25519.HALF, ed25519.HALF + 1, ed25519.L - 1, 2**253 - 1):
        assert ed25519.same(ed25519.base_times(n), ed25519.times(n, ed25519.BASE))
    seed = b"k" * 32
    key, messages = ed25519.public_key(seed), [b"%d" % i for i in range(300)]
    rows = [(key, m, s) for m, s in zip(messages, ed25519.signed(seed, messages), strict=True)]
    assert rows[7][2] == ed25519.sign(seed, messages[7])
    rows[9] = (key, messages[8], rows[9][2])
    n, _ = ed25519._secret(seed)
    point = ed25519.packed(ed25519.add(ed25519.base_times(99), ed25519.unpacked((ed25519.P - 1).to_bytes(32, "little"))))
    rows[5] = (key, messages[5], point + ((99 + ed25519._number(point, key, messages[5]) * n) % ed25519.L).to_bytes(32, "little"))
    assert ed25519.verified(rows) == [i != 9 for i in range(300)] and ed25519.verified(rows[:12]) == [i != 9 for i in range(12)]
