"""Text of office documents out of a table of files (path, content), with limits; digests of files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = {".docx": re.compile(r"word/document\.xml$"), ".xlsx": re.compile(r"xl/sharedStrings\.xml$"), ".pptx": re.compile(r"ppt/slides/slide\d+\.xml$")}
TEXT = re.compile(r"<(?:w:t|a:t|t)(?:\s[^>]*)?>([^<]*)</(?:w:t|a:t|t)>|(</(?:w:p|a:p|si)>)")
MAX_PART, MAX_PARTS = 16 << 20, 2000


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def digests(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("parts", T.IntegerType()), T.StructField("skipped", T.IntegerType()), T.StructField("error", T.StringType())]))
def office_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Text of DOCX, XLSX and PPTX files (path, content): paragraphs by lines, parts over the limit counted as skipped, damaged files as errors."""
    from html import unescape

    for paths, contents in batches:
        rows = []
        for path, content in zip(paths, contents, strict=True):
            wanted = next((p for e, p in PARTS.items() if (path or "").lower().endswith(e)), None)
            if wanted is None or content is None:
                rows.append((None, 0, 0, "unsupported"))
                continue
            try:
                out, n, skipped = [], 0, 0
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in sorted((i for i in z.infolist() if wanted.search(i.filename)), key=lambda i: (len(i.filename), i.filename)):
                        if info.file_size > MAX_PART or n >= MAX_PARTS:
                            skipped += 1
                            continue
                        n += 1
                        out += ["\n" if m[2] else unescape(m[1]) for m in TEXT.finditer(z.read(info).decode("utf-8", "replace"))]
                rows.append(("".join(out).strip(), n, skipped, None))
            except (zipfile.BadZipFile, EOFError, NotImplementedError, OSError) as e:
                rows.append((None, 0, 0, type(e).__name__))
        yield pd.DataFrame(rows, columns=["text", "parts", "skipped", "error"])


RECEIPT = "document_sha256 string, parser string, segments array<struct<index:int,text:string,sha256:string>>, pages_total int, pages_read int"


def check_receipts(receipts: DataFrame, value: str = "value") -> DataFrame:
    """Parser receipts (JSON in a column) with problem: 'malformed', 'coverage', 'order' or 'digest', null if sound."""
    r = F.from_json(value, RECEIPT)
    rows = receipts.withColumn("r", r)
    seg = F.col("r.segments")
    bad_digest = F.exists(seg, lambda s: F.sha2(s["text"], 256) != s["sha256"])
    order = F.transform(seg, lambda s: s["index"]) != F.sequence(F.lit(0), F.size(seg) - 1)
    problem = F.when(F.col("r.document_sha256").isNull() | seg.isNull() | (F.size(seg) == 0), "malformed").when(F.col("r.pages_read") > F.col("r.pages_total"), "coverage").when(order, "order").when(bad_digest, "digest")
    return rows.withColumn("problem", problem).drop("r")
