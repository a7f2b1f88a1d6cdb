"""Secret scan with corpus-wide ownership: who else holds a candidate tells copied examples from live credentials.

Only DataFrame functions: the regular expressions and the counting run in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup_join, whole_row, written

# The patterns of the base kinds.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
# What the method adds: a bare run of token characters with a digit.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "token")
LEAST_GROUP, TOKEN_RANK = 6, 3
#: Code points of a block of a text that is masked.
CHARS = 4096

HITS = "array<struct<rank:int,place:int,gap:int,size:int,value:string>>"
SPAN = "array<struct<start:int,rank:int,end:int,value:string,widely:boolean,past:int>>"


def hits(text: Column, pattern: str, rank: int, group: int = 0) -> Column:
    """All leftmost non-overlapping matches: their place, code points before each since the one before, size and value."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    steps = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), F.transform(found, F.char_length).alias("size"), values.alias("value"))
    return F.transform(steps, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("place"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value")))


def varied(value: Column, digits: int = 3, kinds: int = 10) -> Column:
    """Does a value look random: enough digits, and enough different characters?"""
    return (F.length(F.regexp_replace(value, "[^0-9]", "")) >= digits) & (F.size(F.array_distinct(F.split(value, ""))) >= kinds)


def candidates(found: DataFrame) -> DataFrame:
    """row, owner, repo, start, rank, end, value of every candidate span of found (row, _owner, _repo, hits); added ones overlap none of the base.

    Starts are running sums over a text's matches. An added span overlaps a base one that begins before it if that reaches beyond its start,
    and one that begins later if the next of them begins before its end: both are running values over a text's spans, so n of them take a
    sort and no comparison of pairs.
    """
    each = found.select("row", F.col("_owner").alias("owner"), F.col("_repo").alias("repo"), F.inline("hits")).repartition("row")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "rank").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    base, size = F.col("rank") < TOKEN_RANK, F.char_length("value")
    spans = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    spans = spans.filter(F.when(F.col("rank") == 0, size >= LEAST_GROUP).when(base, True).otherwise(varied(F.col("value"))))
    before = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reach", F.max(F.when(base, F.col("end"))).over(before)).withColumn("next", F.min(F.when(base, F.col("start"))).over(behind))
    clear = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return spans.filter(base | clear).select("row", "owner", "repo", "start", "rank", "end", "value", F.sha2("value", 256).alias("digest"))


def may_hold(whole: Column) -> Column:
    return whole.rlike(ASSIGN) | whole.rlike(ACCESS) | whole.rlike(HEX) | whole.rlike(TOKEN)


def ownership(spans: DataFrame) -> DataFrame:
    """digest, owners, repositories, most (repositories of one owner), documents: how widely each candidate is held.

    Counted in three steps, so that a value which a third of all documents hold is summed up before each shuffle.
    """
    repos = spans.groupBy("digest", "owner", "repo").agg(F.count("*").alias("docs"))
    owners = repos.groupBy("digest", "owner").agg(F.count("*").alias("repos"), F.sum("docs").alias("docs"))
    return owners.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repos").alias("repositories"), F.max("repos").alias("most"), F.sum("docs").alias("documents"))


def find_secrets(docs: DataFrame, text: str = "text", owner: str = "source", repo: tuple[str, ...] = ("source", "lang"), keep: tuple[str, ...] = ("doc_id",), copied_owners: int = 3, copied_repos: int = 3) -> DataFrame:
    """keep (columns of docs) with row (unique), base, spans and live, arrays of (start, rank, end, value, widely, past), for all documents.

    A candidate that at least copied_owners owners and copied_repos repositories hold, no one owner more than half of the
    repositories, is a widely copied example; the others are owner-specific: also one that an owner has in many repositories
    and that two others have picked up. Base spans always stay; an added token span (only those that look random are
    candidates) stays if it is owner-specific. live: the owner-specific spans, letters-only passwords too. A null owner or
    repository counts as one of its own name; a null text holds none; repeated rows are kept apart. keep must not name columns
    like the new ones. Texts are read once; what is written and joined are spans.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    inner = docs.select(*keep, F.col(text).alias("_text"), name(owner).alias("_owner"), F.concat_ws("/", *[name(c) for c in repo]).alias("_repo"))
    whole = F.coalesce("_text", F.lit(""))
    every = F.concat(*[hits(whole, pattern, rank, 2 if rank == 0 else 0) for rank, pattern in enumerate((ASSIGN, ACCESS, HEX, TOKEN))])
    held = inner.withColumn("hits", F.when(may_hold(whole), every).otherwise(F.array().cast(HITS))).drop("_text")
    found = written(held.withColumn("row", F.monotonically_increasing_id()), "secret-hits")
    spans = written(candidates(found.filter(F.size("hits") > 0).select("row", "_owner", "_repo", "hits")), "secret-candidates")
    wide = ownership(spans.select("row", "owner", "repo", "digest").distinct()).filter((F.col("owners") >= copied_owners) & (F.col("repositories") >= copied_repos) & (F.col("most") * 2 <= F.col("repositories")))
    wide = written(wide.select("digest", F.lit(True).alias("widely"), "documents"), "secret-copied")
    judged = lookup_join(spans.select("row", "start", "rank", "end", "value", "digest"), wide, "digest", ["row", "start"], "documents").withColumn("widely", F.coalesce("widely", F.lit(False)))
    # How far the live spans before one reach, for masking.
    past = F.max(F.when(~F.col("widely"), F.col("end"))).over(Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1))
    span = F.struct("start", "rank", "end", "value", "widely", F.coalesce("past", F.lit(0)).alias("past"))
    of = lambda which: F.sort_array(F.collect_list(F.when(which, span)))
    base, live = F.col("rank") < TOKEN_RANK, ~F.col("widely")
    by_row = judged.withColumn("past", past).groupBy("row").agg(of(base).alias("base"), of(base | live).alias("spans"), of(live).alias("live"))
    none = F.array().cast(SPAN)
    return found.select(*keep, "row").join(by_row, "row", "left").select(*keep, "row", *[F.coalesce(c, none).alias(c) for c in ("base", "spans", "live")])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["rank"] + 1), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: counts of base spans by kind, the digest of their list, and all spans."""
    found = find_secrets(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_whole"), "source", "lang"), "_whole")
    of = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["widely"])).cast("long").alias("n_copied"),
    )


def masked(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with the live credentials of each text replaced by mark; all rows and columns stay, whatever their names.

    Documents without a candidate are told by the patterns and pass straight through.
    """
    inner = docs.select(whole_row(docs).alias("_doc"), F.col(text).alias("_whole"), F.col("source").alias("_in0"), F.col("lang").alias("_in1"))
    may = may_hold(F.coalesce(F.col("_whole"), F.lit("")))
    found = find_secrets(inner.filter(may), "_whole", "_in0", ("_in0", "_in1"), ("_doc",))
    whole = F.col("_doc")[text]
    # The text in blocks, so that a piece of it is found without walking from its start; a generator, so that they are made once for each text.
    found = found.withColumn("_blocks", F.explode(F.array(F.when(F.size("live") > 0, F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0))))))

    def piece(a: Column, b: Column) -> Column:
        first = F.floor(a / CHARS).cast("int")
        return F.substr(F.array_join(F.slice("_blocks", first + 1, F.floor(b / CHARS).cast("int") - first + 1), ""), a % CHARS + 1, b - a)

    # A span that begins inside the one before is masked with it.
    gaps = F.transform(F.filter("live", lambda s: s["start"] >= s["past"]), lambda s: F.concat(piece(s["past"], s["start"]), F.lit(mark)))
    at = F.array_max(F.transform("live", lambda s: s["end"]))
    rest = F.substr(F.array_join(F.slice("_blocks", F.floor(at / CHARS).cast("int") + 1, F.size("_blocks")), ""), at % CHARS + 1, F.lit(2147483647))
    cut = F.concat(F.array_join(gaps, ""), rest)
    new = F.when(F.size("live") > 0, cut).otherwise(whole)
    some = found.select(*[new.alias(c) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns])
    return some.unionByName(inner.filter(~may).select("_doc.*"))
