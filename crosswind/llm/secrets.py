"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone.

Base kinds are found by pattern in every whole text. Besides these, every long mixed string of key characters is a candidate. The value
of each find and candidate is hashed, and the hashes are counted over the corpus by distinct owners and
repositories. A value that more than OWNERS owners hold is an example that people copy; a value that stays with few owners and
looks alive (letters and digits mixed, no placeholder word) is a credential of its owner. Candidates of the latter sort become spans of
kind `owned`; base spans stay whatever their class.

Masking takes every base find but those whose value is shown to be an example: a placeholder as the whole value, or a value that is
widely copied, by more than OWNERS owners and by more than WIDELY of all owners. Length and looks do not excuse a base find; they only
choose among the other candidates.

Counting goes by (hash, owner, repository) first, so a value that a third of all rows holds is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswind.session import durable

# The patterns of the base kinds and the fewest characters of a find.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "owned")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
MIXED = r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])"
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|0000|1234567|abcdef"
#: A whole value that stands for a secret: a placeholder word with fillings around it, or one character repeated.
_STRONG = r"example|sample|dummy|change[-_.]?me|placeholder|your|x{4,}+"
STAND_IN = rf"(?i)^(?=.{{1,64}}$)(?=.*(?:{_STRONG}))(?:(?:{_STRONG}|my|password|passwd|secret|token|api|access|key|here|value|goes|0++|1234567(?:890?|89)?)[-_.=]*+)+$|^(.)\1*$"
OWNERS = 2
#: The share of all owners above which a value counts as widely copied.
WIDELY = 0.5
LEAST_LIVE = 16
MARK = "<secret>"

SPAN = "struct<start:int,kind:int,end:int,value:string>"


def finds(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end, value), places in code points.

    The text is split by the pattern: the pieces between the matches and the matches in turn give the places. Base
    pattern `assign` is taken without a least length, as shorter matches must still take up their place.
    """
    none = F.array().cast(f"array<{SPAN}>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))

    def step(acc, x):
        start = (acc["at"] + x["gap"]).cast("int")
        end = (start + F.length(x["hit"])).cast("int")
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"]
    return F.when(text.rlike(pattern), walked).otherwise(none)


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind; `value` is the secret itself."""
    assign = F.transform(
        finds(text, ASSIGN, 0), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.regexp_extract(x["value"], ASSIGN, 2).alias("value"))
    )
    assign = F.filter(assign, lambda x: F.length(x["value"]) >= ASSIGN_LEAST)
    return F.array_sort(F.concat(assign, finds(text, ACCESS, 1), finds(text, HEX, 2)))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def _alive(value: Column) -> Column:
    return (F.length(value) >= LEAST_LIVE) & value.rlike(MIXED) & ~value.rlike(PLACEHOLDER)


def scanned(docs: DataFrame, owner: str = "source", repository: str = "source") -> DataFrame:
    """Every row with its base spans and candidates, without its text: _row, doc_id, owner, repository, base, extra. Written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository")
    )
    rows = rows.withColumn("_row", row_key()).withColumn("base", base_spans(F.col("text")))
    apart = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    extra = F.filter(finds(F.col("text"), CANDIDATE, 3), lambda x: _alive(x["value"]) & apart(x))
    return durable(rows.withColumn("extra", extra).select("_row", "doc_id", "owner", "repository", "base", "extra"))


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def ownership(rows: DataFrame) -> DataFrame:
    """(hash, owners, repositories, owned): how widely each value is held."""
    values = rows.select("owner", "repository", F.explode(F.concat("base", "extra")).alias("x")).select("owner", "repository", F.col("x.value").alias("value"))
    held = values.groupBy(F.sha2("value", 256).alias("hash"), "owner", "repository").agg(F.max(_alive(F.col("value"))).alias("alive"))
    # one row for each owner and repository of a value is left here
    owners = held.groupBy("hash", "owner").agg(F.max("alive").alias("alive")).groupBy("hash").agg(F.count("*").alias("owners"), F.max("alive").alias("alive"))
    repositories = held.groupBy("hash", "repository").agg(F.max("alive").alias("r")).groupBy("hash").agg(F.count("*").alias("repositories"))
    return owners.join(repositories, "hash").select("hash", "owners", "repositories", ((F.col("owners") <= OWNERS) & F.col("alive")).alias("owned"))


def classified(rows: DataFrame) -> DataFrame:
    """One row for each span of base and extra: _row, doc_id, span, is_base, owned, owners, repositories."""
    spans = rows.where("size(base) + size(extra) > 0").select("_row", "doc_id", F.explode(F.concat("base", "extra")).alias("span")).distinct()
    spans = spans.withColumn("hash", F.sha2("span.value", 256))
    return spans.join(ownership(rows), "hash").select("_row", "doc_id", "span", (F.col("span.kind") < 3).alias("is_base"), "owned", "owners", "repositories")


def scan_documents(docs: DataFrame, owner: str = "source", repository: str = "source") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_examples.

    Null text counts as empty and has no spans; null owners are one owner. n_owned and n_examples count the values (base finds and
    candidates) that stay with few owners and those held by more than OWNERS. Repeated rows have the same finds. An empty table gives an
    empty result.
    """
    rows = scanned(docs, owner, repository)
    of = lambda when: F.count(F.when(when, 1))
    added = classified(rows).groupBy("_row", F.col("doc_id").alias("_id")).agg(
        F.collect_set(F.when(F.col("owned") & ~F.col("is_base"), F.col("span"))).alias("added"), of(F.col("owned")).alias("n_owned"), of(F.col("owners") > OWNERS).alias("n_examples")
    )
    joined = rows.join(added, (rows["_row"] == added["_row"]) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>"))))
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return joined.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"),
        F.coalesce("n_owned", F.lit(0)).cast("long").alias("n_owned"), F.coalesce("n_examples", F.lit(0)).cast("long").alias("n_examples"),
    )


def to_mask(rows: DataFrame) -> DataFrame:
    """One row for each span that masking takes: _row, doc_id, span."""
    owners = rows.select("owner").distinct().agg(F.count("*").alias("all_owners"))
    copied = (F.col("owners") > OWNERS) & (F.col("owners") > WIDELY * F.col("all_owners"))
    example = copied | F.col("span.value").rlike(STAND_IN)
    spans = classified(rows).crossJoin(owners)  # one row
    return spans.where(F.when(F.col("is_base"), ~example).otherwise(F.col("owned"))).select("_row", "doc_id", "span")


def masked(text: Column, spans: Column) -> Column:
    """The text with MARK in place of each run of overlapping spans (sorted by start)."""

    def step(acc, x):
        inside = x["start"] < acc["at"]
        # MySQL-like places start at 1
        gap = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        out = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(MARK)))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def mask_owned(docs: DataFrame, owner: str = "source", repository: str = "source") -> DataFrame:
    """All documents with their columns; base finds that are no examples and owned candidates are masked (and n_chars, if there, is the new length).

    Null and empty texts stay as they are, repeated rows are masked alike, and columns of any name pass through. An empty table stays empty.
    """
    rows = scanned(docs, owner, repository)
    owned = to_mask(rows).groupBy("_row", F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_set("span")).alias("_spans"))
    owned = durable(owned.withColumnRenamed("_row", "_key"))
    # the row travels as one struct, so that its names cannot meet those used here
    here = docs.select(F.struct(*docs.columns).alias("_doc"), row_key().alias("_row"))
    joined = here.join(owned, (F.col("_row") == F.col("_key")) & F.col("_doc.doc_id").cast("long").eqNullSafe(F.col("_id")), "left")
    found, text = F.col("_spans").isNotNull(), F.col("_doc.text")
    text = F.when(found, masked(text, F.col("_spans"))).otherwise(text)
    out = F.col("_doc").withField("text", text)
    if "n_chars" in docs.columns:
        out = out.withField("n_chars", F.when(found, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars")))
    return joined.select(out.alias("_doc")).select("_doc.*")
