"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import saved


@dataclass(frozen=True)
class Kind:
    """A pattern; ``value``: the group that holds the secret, which must end the
    match; matches whose value is shorter than ``least`` characters are dropped."""

    name: str
    pattern: str
    value: int
    least: int


#: In rank order. Patterns are written so that Java's and RE2's dialects agree.
KINDS = (
    Kind("assign", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
         "[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    # a run with fewer characters fails wherever it is cut, so the least length can stand in the pattern
    Kind("access", "AKIA[A-Z0-9]{14,}", 0, 18),
    Kind("hex", "[0-9a-f]{16,}", 0, 16),
)
#: Values with such a word in them are examples whatever their frequency.
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "placeholder", "your_", "your-", "xxxx")


def _found(text: Column, kind: Kind) -> Column:
    """array<struct<gap, size, length, sha, looks>> of the kind's matches: the
    characters between the last match and this one, its length in code points, the
    length and SHA-256 of the secret value, and whether that looks like a real one."""
    gaps, hits = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def one(gap: Column, hit: Column) -> Column:
        value = F.regexp_extract(hit, kind.pattern, kind.value) if kind.value else hit
        low = F.lower(value)
        looks = low.rlike("[a-z]") & low.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= 6) & ~low.rlike(
            "|".join(PLACEHOLDERS))
        return F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size"), F.length(value).alias("length"),
                        F.sha2(value, 256).alias("sha"), looks.alias("looks"))

    # there is one more gap than hits
    return F.when(text.rlike(kind.pattern), F.slice(F.zip_with(gaps, hits, one), F.lit(1), F.size(hits))).otherwise(
        F.array().cast("array<struct<gap:int,size:int,length:int,sha:string,looks:boolean>>"))


def scan(docs: DataFrame, owner: Column, repository: Column, max_owners: int = 1, max_repositories: int = 2,
         doc_id: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> tuple[DataFrame, DataFrame]:
    """(documents, spans).

    documents: rid, doc_id, one row per input row. spans: rid, kind, rank, start,
    end (code points, end exclusive), value_start, secret_sha256, owners,
    repositories, uses, live.

    Every candidate's hash is counted over the whole corpus: how many distinct
    owners and repositories hold it. ``live``: it belongs to at most ``max_owners``
    owners and ``max_repositories`` repositories, has letters and digits, at least
    6 different characters and no placeholder word. Widely copied values are
    examples.

    Only hashes and lengths leave the scan, to files or shuffles, never texts or secrets. Counts are
    pre-aggregated per (hash, owner, repository) in each task; a value that a third
    of all documents hold is a skewed join key between two plain scans, which can
    be split. Null texts are empty; a null owner or repository counts as one of its
    own; repeated rows are rows of their own; empty tables give empty results.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    # a name is marked, so that null stands apart from every name, the empty one too
    marked = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    ids = docs.select(F.col(doc_id).alias("doc_id"), marked(owner).alias("owner"), marked(repository).alias("repository"),
                      F.array(*[_found(t, k) for k in kinds]).alias("found"))
    # written once, so that row numbers and matches are fixed
    ids = saved(ids.withColumn("rid", F.monotonically_increasing_id()), "secrets")
    hits = ids.select("rid", "owner", "repository", F.posexplode("found").alias("rank", "list")).select(
        "rid", "owner", "repository", "rank", F.posexplode("list").alias("n", "m"))
    upto = Window.partitionBy("rid", "rank").orderBy("n")
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(upto)
    hits = hits.select("rid", "owner", "repository", "rank", end.cast("long").alias("end"), "m")
    least = F.element_at(F.array(*[F.lit(k.least) for k in kinds]), F.col("rank") + 1)
    names = F.element_at(F.array(*[F.lit(k.name) for k in kinds]), F.col("rank") + 1)
    spans = saved(hits.where(F.col("m.length") >= least).select(
        "rid", "owner", "repository", names.alias("kind"), "rank", (F.col("end") - F.col("m.size")).alias("start"), "end",
        (F.col("end") - F.col("m.length")).alias("value_start"), F.col("m.sha").alias("secret_sha256"), F.col("m.looks").alias("looks")),
        "spans")
    uses = spans.groupBy("secret_sha256", "owner", "repository").agg(F.count("*").alias("uses")).groupBy(
        "secret_sha256", "owner").agg(F.count("*").alias("repositories"), F.sum("uses").alias("uses")).groupBy(
        F.col("secret_sha256").alias("sha")).agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"),
                                                 F.sum("uses").alias("uses"))
    uses = saved(uses, "uses")
    live = F.col("looks") & (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    judged = spans.join(uses, F.col("secret_sha256") == F.col("sha")).select(
        "rid", "kind", "rank", "start", "end", "value_start", "secret_sha256", "owners", "repositories", "uses", live.alias("live"))
    return ids.select("rid", "doc_id"), judged


def digest(documents: DataFrame, spans: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row per document: doc_id, n_<kind> (base spans), n_live, n_example,
    base_sha256, spans. The method's own spans are of kind ``live``, over the
    secret value of a base span that is owner-specific."""
    last = len(kinds)
    one = F.struct("start", "rank", "end", "kind")
    extra = F.when(F.col("live"), F.struct(F.col("value_start").alias("start"), F.lit(last).alias("rank"), "end",
                                           F.lit("live").alias("kind")))
    lists = spans.groupBy("rid").agg(
        F.array_sort(F.collect_list(one)).alias("base"), F.array_sort(F.collect_list(extra)).alias("more"),
        *[F.sum((F.col("rank") == k).cast("long")).alias(f"n_{x.name}") for k, x in enumerate(kinds)],
        F.sum(F.col("live").cast("long")).alias("n_live"))

    def joined(spans_of: Column) -> Column:
        return F.array_join(F.transform(spans_of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    counts = [f"n_{k.name}" for k in kinds]
    out = documents.join(lists.withColumnRenamed("rid", "r"), F.col("rid") == F.col("r"), "left")
    base, every = joined(F.col("base")), joined(F.array_sort(F.concat("base", F.array_distinct("more"))))
    return out.select(
        "doc_id", *[zero(c) for c in counts], zero("n_live"),
        (sum((F.coalesce(F.col(c), F.lit(0)) for c in counts), F.lit(0)) - F.coalesce("n_live", F.lit(0))).cast("long").alias("n_example"),
        F.sha2(F.coalesce(base, F.lit("")), 256).alias("base_sha256"), F.coalesce(every, F.lit("")).alias("spans"))
