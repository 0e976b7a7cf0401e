"""Multipart credential linking, with DataFrame functions only.

Parts of credentials are found by kind and role. The base kinds are always reported:

    assign   secret     a keyword, a separator and a value of 12 or more
    access   identifier AKIA and capitals or digits, 18 or more
    hex      secret     16 or more lower-case hex digits

Weak kinds say little alone and are reported only where parts that complement them lie within the scope, which is `scope`
code points before or after the candidate:

    ident    identifier user, login, account, client or key id with a value: needs a secret
    opaque   secret     20 or more of the base64 letters, digits and letters mixed: needs an identifier
    endpoint endpoint   URL or IPv4 address: needs an identifier and a secret

Links are an interval join: candidates list the bins that their scope touches, parts the bins that they cover, and they meet on
(document, bin), so no document's parts are paired as a whole; semi joins keep one row per candidate whatever it meets.
Positions are code points, ends exclusive: a regular expression's gaps and matches are summed up in order. Only documents with
a hit leave the scan, with lengths, not texts.

Defined results: null and empty texts have no spans; rows that repeat a doc_id and text have the same spans; a weak candidate
with the very span of a base part is not repeated; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "opaque": "secret", "endpoint": "endpoint"}
BASE = KINDS[:3]
#: Fixed values: (pattern, group whose length counts, its least length, cheap test that a text can have one). A run of 16 or
#: more hex digits is found as such, since shorter runs can't hold it; likewise AKIA's.
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, r"(?i)password|passwd|secret|token|api_?key"),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18, r"AKIA"),
    "hex": (r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
    "ident": (r"""(?i)\b(?:user(?:_?name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", 1, 3, r"(?i)(?:user|user_?name|login|account|id)[\"']?\x20*[:=]"),
    "opaque": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 0, 20, r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20}"),
    "endpoint": (r"""[a-z][a-z0-9+.:-]*://[^\x20\x09-\x0D"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?![0-9.])""", 0, 4, r"://|[0-9]\.[0-9]{1,3}\.[0-9]"),
}


def _found(text: Column, kind: str) -> Column:
    """array<struct<kind_no, pos, gap, size, good>> of a kind's matches, all of them, in order; gap: code points since the match before."""
    pattern, group, least, test = PATTERNS[kind]
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    good = lambda x: (F.length(x) >= least) & (x.rlike("[0-9]") & x.rlike("[A-Za-z]") if kind == "opaque" else F.lit(True))
    zipped = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(part, good).alias("good"))
    rows = F.transform(F.slice(zipped, 1, F.size(whole)), lambda z, i: F.struct(F.lit(KINDS.index(kind)).alias("kind_no"), i.alias("pos"), z["gap"].alias("gap"), z["size"].alias("size"), z["good"].alias("good")))
    empty = F.expr("cast(array() as array<struct<kind_no: int, pos: int, gap: int, size: int, good: boolean>>)")
    return F.when(text.rlike(test), rows).otherwise(empty)


def parts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, mark (the text's hash), kind_no, start, end of every part of every kind, weak or not; repeated documents once."""
    texts = docs.select("doc_id", F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    can = texts.where(_any(F.col("text")))
    listed = can.select("doc_id", "mark", F.concat(*(_found(F.col("text"), k) for k in KINDS)).alias("found")).where(F.size("found") > 0).dropDuplicates(["doc_id", "mark"])
    rows = listed.select("doc_id", "mark", F.explode("found").alias("f")).select("doc_id", "mark", "f.*")
    order = W.partitionBy("doc_id", "mark", "kind_no").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(order))
    return ends.where("good").select("doc_id", "mark", "kind_no", (F.col("end") - F.col("size")).alias("start"), "end")


def _any(text: Column) -> Column:
    out = F.lit(False)
    for kind in KINDS:
        out = out | text.rlike(PATTERNS[kind][3])
    return out


def linked(found: DataFrame, scope: int = 200) -> DataFrame:
    """The weak parts that complementary ones meet within the scope."""
    numbers = lambda role: [KINDS.index(k) for k in KINDS if ROLES[k] == role]
    key = ["doc_id", "mark"]
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    covered = found.withColumn("bin", bins(F.col("start"), F.col("end"))).select(F.col("doc_id").alias("p_id"), F.col("mark").alias("p_mark"), "bin", F.col("kind_no").alias("p_kind"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    base = found.where(F.col("kind_no") < len(BASE)).select(*key, "start", "end")
    weak = found.where(F.col("kind_no") >= len(BASE)).join(base, [found["doc_id"].eqNullSafe(base["doc_id"]), *(found[c] == base[c] for c in ("mark", "start", "end"))], "left_anti")

    def near(candidates: DataFrame, role: str) -> DataFrame:
        touched = candidates.withColumn("bin", bins(F.col("start") - scope, F.col("end") + scope))
        c, p = touched.alias("c"), covered.where(F.col("p_kind").isin(numbers(role))).alias("p")
        met = F.col("c.doc_id").eqNullSafe(F.col("p.p_id")) & (F.col("c.mark") == F.col("p.p_mark")) & (F.col("c.bin") == F.col("p.bin"))
        within = (F.col("p.p_end") >= F.col("c.start") - scope) & (F.col("p.p_start") <= F.col("c.end") + scope)
        return c.join(p, met & within, "left_semi").drop("bin").distinct()

    of = lambda kind: weak.where(F.col("kind_no") == KINDS.index(kind))
    return near(of("ident"), "secret").union(near(of("opaque"), "identifier")).union(near(near(of("endpoint"), "secret"), "identifier"))


def secret_spans(docs: DataFrame, scope: int = 200, text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_<base kind>, n_linked, base_spans and spans (array<struct<start, kind_no, end>> by start, then kind)."""
    found = parts(docs, text_col)
    all_parts = found.where(F.col("kind_no") < len(BASE)).union(linked(found, scope))
    span = F.sort_array(F.collect_list(F.struct("start", "kind_no", "end")))
    per_doc = all_parts.groupBy("doc_id", "mark").agg(*(F.count_if(F.col("kind_no") == i).alias(f"n_{k}") for i, k in enumerate(BASE)), F.count_if(F.col("kind_no") >= len(BASE)).alias("n_linked"), span.alias("spans"))
    per_doc = per_doc.withColumnRenamed("doc_id", "s_id").withColumnRenamed("mark", "s_mark")
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("mark"))
    joined = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("mark") == F.col("s_mark")), "left")
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<start: bigint, kind_no: int, end: bigint>>)"))
    counts = [F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in (*BASE, "linked")]
    return joined.select("doc_id", *counts, F.filter(spans, lambda s: s["kind_no"] < len(BASE)).alias("base_spans"), spans.alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
