"""Signatures of log records: who wrote a record, and that nothing was left out between them."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import ed25519
from tidemark.operators.audit import SEPARATOR, canonical_content, verified

#: Domain of record signatures, which keeps them from counting for anything else, and signatures that are checked together.
DOMAIN, TOGETHER = "tidemark-audit-record-v1", 4096


def key_id(public_key: bytes) -> str:
    """How rows name a key: the first 16 hex digits of its SHA-256."""
    return hashlib.sha256(public_key).hexdigest()[:16]


def record_message(signer: Column, log_id: Column, seq: Column, record_hash: Column, domain: str = DOMAIN) -> Column:
    """What a record's signature is over: domain, key, log, position and hash, joined by U+001F, which none of them can hold."""
    return F.encode(F.concat_ws(SEPARATOR, F.lit(domain), signer, log_id.cast("string"), seq.cast("string"), record_hash), "UTF-8")


def _added(rows: DataFrame, name: str, kind: T.DataType, make) -> DataFrame:
    """rows with a column that make(record batch) gives as a list; the columns __message and __sig are dropped."""
    kept = [c for c in rows.columns if c not in ("__message", "__sig")]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = pa.array(make(batch), pa.string() if isinstance(kind, T.StringType) else pa.bool_())
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], made], names=[*kept, name])

    return rows.mapInArrow(run, T.StructType([*[f for f in rows.schema.fields if f.name in kept], T.StructField(name, kind)]))


def signed(rows: DataFrame, seed: bytes, domain: str = DOMAIN) -> DataFrame:
    """rows (log_id, seq, record_hash) with record_sig and signer_key_id by the key of a secret seed."""
    public = ed25519.public_key(seed)
    mine = key_id(public)
    rows = rows.drop("record_sig", "signer_key_id").withColumn("__message", record_message(F.lit(mine), F.col("log_id"), F.col("seq"), F.col("record_hash"), domain))
    make = lambda b: [x.hex() for x in ed25519.signed(seed, b.column(b.schema.get_field_index("__message")).to_pylist(), public)]
    return _added(rows, "record_sig", T.StringType(), make).withColumn("signer_key_id", F.lit(mine))


def checked(rows: DataFrame, public_key: bytes, content: Column | None = None, domain: str = DOMAIN) -> DataFrame:
    """rows of logs (log_id, rowid, seq, prev_hash, record_hash, record_sig, signer_key_id and the chained fields) with state and ok.

    state: 'unsigned', 'other_key' (signed by a key of another name; not checked), 'verified' or 'refused'. ok: the record is verified, its hash follows from its content and the hash
    before it, and positions have no gap since the start of the log; after a gap they are counted on from where they stand.
    """
    mine = key_id(public_key)
    by = Window.partitionBy("log_id").orderBy("rowid")
    rows = verified(rows, canonical_content() if content is None else content).withColumnRenamed("ok", "__chained")
    nth = F.row_number().over(by)
    ahead = F.max(F.col("seq") - F.col("__n")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__n", nth).withColumn("__placed", F.col("seq") == F.col("__n") + F.greatest(F.coalesce(ahead, F.lit(0)), F.lit(0)))
    sig, signer = F.trim(F.coalesce("record_sig", F.lit(""))), F.coalesce("signer_key_id", F.lit(""))
    named = F.when(sig == "", "unsigned").when((signer != "") & (signer != mine), "other_key")
    rows = rows.withColumn("__named", named).withColumn("__message", F.when(named.isNull(), record_message(F.lit(mine), F.col("log_id"), F.col("seq"), F.col("record_hash"), domain))).withColumn("__sig", F.try_to_binary(sig, F.lit("hex")))

    def holds(batch: pa.RecordBatch) -> list[bool]:
        some = list(zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__message", "__sig")], strict=True))
        out = [False] * len(some)
        asked = [i for i, (m, s) in enumerate(some) if m is not None and s is not None]
        for a in range(0, len(asked), TOGETHER):
            part = asked[a : a + TOGETHER]
            for i, ok in zip(part, ed25519.verified([(public_key, *some[i]) for i in part]), strict=True):
                out[i] = ok
        return out

    rows = _added(rows, "__held", T.BooleanType(), holds)
    state = F.coalesce("__named", F.when(F.col("__held"), "verified").otherwise("refused"))
    rows = rows.withColumn("state", state).withColumn("ok", (state == "verified") & F.col("__chained") & F.coalesce("__placed", F.lit(False)))
    return rows.drop("__chained", "__n", "__placed", "__named", "__held")


def verify_signatures(rows: DataFrame, public_key: bytes, content: Column | None = None, domain: str = DOMAIN, id_col: str = "id") -> DataFrame:
    """One row a log: ok, total, signed, unsigned, other_key, verified, first_failure_id. A log isn't ok while any record is unsigned."""
    rows = checked(rows, public_key, content, domain)
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    out = rows.groupBy("log_id").agg(F.bool_and("ok").alias("ok"), F.count("*").alias("total"), count("unsigned"), count("other_key"), count("verified"), F.min_by(id_col, F.when(~F.col("ok"), F.col("rowid"))).alias("first_failure_id"))
    return out.select("log_id", "ok", "total", (F.col("total") - F.col("unsigned")).alias("signed"), "unsigned", "other_key", "verified", "first_failure_id")
