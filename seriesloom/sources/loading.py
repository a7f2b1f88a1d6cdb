"""Reading observation, story and document files, and writing results with upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .scratch import kept

SERIES = "series_id string, name string, category string, frequency string, units string, seasonal_adjustment string, last_updated string, notes string, release struct<name:string,notes:string>, category_path string, observations array<struct<date:string,value:string>>"
STORY = "story_id long, created_utc string, title string, text_excerpt string, score long, num_comments long, url string, hn_permalink string, sentiment_score double, sentiment_label string, matched_queries array<string>"
CURATED = "id string, series_id string, title string, content string, source_url string"


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Rows of the JSON files under path (one value or array a file, or one value a line), with file, position and broken: the text that is no such value."""
    reader = spark.read.schema(f"{schema}, broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").option("recursiveFileLookup", True)
    return reader.json(path, multiLine=not lines).withColumns({"file": F.col("_metadata.file_path"), "position": F.monotonically_increasing_id()})


def file_errors(raw: DataFrame) -> DataFrame:
    """file, n_broken: how many values of each file could not be read. The other rows of the file count."""
    return raw.filter("broken is not null").groupBy("file").agg(F.count("*").alias("n_broken"))


def read_series_json(spark: SparkSession, path: str) -> DataFrame:
    """One row for each raw observation of the files under path, with file and the position in it; a row with broken for a file that is no JSON."""
    files = kept(read_json(spark, path, SERIES).drop("position"), "series-files")
    each = files.select("*", F.posexplode_outer("observations").alias("position", "obs"))
    return each.select("file", "broken", "series_id", "name", "category", "frequency", "units", "seasonal_adjustment", "last_updated", F.col("obs.date").alias("raw_date"), F.col("obs.value").alias("raw_value"), "position")


def in_order(raw: DataFrame) -> Column:
    """The place of a row: by file name, if there is one, then by position."""
    return F.struct(*[c for c in ("file", "position") if c in raw.columns])


def series_metadata(raw: DataFrame) -> DataFrame:
    """The first known value of each field, by file name and position."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), in_order(raw))).alias(c) for c in ("name", "category", "frequency", "units", "seasonal_adjustment", "last_updated")]
    return raw.filter("series_id is not null").groupBy("series_id").agg(*first)


def clean_observations(raw: DataFrame, cutoff: str | None = None) -> DataFrame:
    """series_id, date, value, value_adj: dated on or after cutoff, numeric, the first row of each series and date."""
    date, value = F.try_to_date("raw_date"), F.col("raw_value").try_cast("double")
    typed = raw.select("series_id", date.alias("date"), value.alias("value"), in_order(raw).alias("place")).filter(F.col("date").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    if cutoff:
        typed = typed.filter(F.col("date") >= F.lit(cutoff).cast("date"))
    first = typed.groupBy("series_id", "date").agg(F.min_by("value", "place").alias("value"))
    return first.withColumn("value_adj", F.col("value"))


def load_series_json(spark: SparkSession, path: str, cutoff: str | None = None) -> tuple[DataFrame, DataFrame]:
    raw = read_series_json(spark, path)
    return series_metadata(raw), clean_observations(raw, cutoff)


def load_stats(raw: DataFrame, cutoff: str | None = None) -> DataFrame:
    """series_id, inserted, skipped_null, skipped_date; the date is judged before the value, and repeats count as inserted."""
    early = F.coalesce(F.col("raw_date") < cutoff, F.lit(False)) if cutoff else F.lit(False)
    numeric = F.col("raw_value").try_cast("double").isNotNull()
    return raw.filter("raw_date is not null").groupBy("series_id").agg(F.count_if(~early & numeric).alias("inserted"), F.count_if(~early & ~numeric).alias("skipped_null"), F.count_if(early).alias("skipped_date"))


def history_cutoff(obs: DataFrame, as_of: str, years: int = 10) -> DataFrame:
    return obs.filter(F.col("date") >= F.add_months(F.lit(as_of).cast("date"), -12 * years))


def whole_stories(raw: DataFrame) -> DataFrame:
    """Stories with month: those with the required fields, the last of each id by file name and position."""
    needed = [F.col(c).isNotNull() for c in ("story_id", "created_utc", "title")]
    good = raw.filter(reduce(Column.__and__, needed)).withColumn("place", in_order(raw))
    columns = [c for c in raw.columns if c not in ("file", "position", "broken")]
    last = good.groupBy("story_id").agg(F.max_by(F.struct(*columns), "place").alias("s")).select("s.*")
    return last.withColumn("month", F.concat(F.substring("created_utc", 1, 7), F.lit("-01")).cast("date"))


def unscored() -> Column:
    return F.col("sentiment_score").isNull() | F.col("sentiment_label").isNull()


def complete_stories(raw: DataFrame) -> DataFrame:
    """whole_stories(), but none at all if any lacks its sentiment."""
    gate = raw.agg(F.count_if(unscored()).alias("_unscored"))
    return whole_stories(raw.crossJoin(F.broadcast(gate)).filter("_unscored = 0").drop("_unscored"))  # one row by construction


def load_stories_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return stories_and_counts(spark, path, lines)[0]


def stories_and_counts(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """(stories, counts) of the files under path; counts: rows, broken, unscored. Broken values are left out; any unscored story leaves out all.

    The counts are taken while the rows are written, so files are read once.
    """
    seen = Observation("stories")
    some = F.col("broken").isNull()
    raw = read_json(spark, path, STORY, lines).observe(seen, F.count_if(some).alias("rows"), F.count_if(~some).alias("broken"), F.count_if(some & unscored()).alias("unscored"))
    rows = kept(raw, "stories-read").filter("broken is null")
    counts = seen.get
    return whole_stories(rows if not counts["unscored"] else rows.limit(0)), counts


def filled(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def load_reference_docs(meta: DataFrame, as_of: str) -> DataFrame:
    """Up to three documents for each row (series_id, notes, release_notes, release_name, category_path, source_url); empty ones are left out."""
    kinds = F.array(
        F.struct(F.lit("series_notes").alias("doc_type"), filled(F.col("notes")).alias("content")),
        F.struct(F.lit("release_info").alias("doc_type"), F.coalesce(filled(F.col("release_notes")), filled(F.col("release_name"))).alias("content")),
        F.struct(F.lit("category_path").alias("doc_type"), filled(F.col("category_path")).alias("content")),
    )
    each = meta.select("series_id", "name", "source_url", F.explode(kinds).alias("d")).filter("d.content is not null")
    return each.select("series_id", "d.doc_type", F.col("name").alias("title"), "d.content", "source_url", F.lit(as_of).alias("fetched_at"))


def curated_docs(raw: DataFrame, meta: DataFrame, as_of: str) -> DataFrame:
    """Curated rows (with file) that have all fields and a known series; the first file of an id counts."""
    needed = reduce(Column.__and__, [filled(F.col(c)).isNotNull() for c in ("id", "series_id", "title", "content")])
    known = raw.filter(needed).join(meta.select("series_id").distinct(), "series_id", "left_semi")
    first = known.groupBy("id").agg(F.min_by(F.struct("series_id", "title", "content", "source_url"), "file").alias("d")).select("id", "d.*")
    return first.select("series_id", F.concat(F.lit("scholarly:"), "id").alias("doc_type"), "title", "content", "source_url", F.lit(as_of).alias("fetched_at"))


def concept_docs(raw: DataFrame, as_of: str) -> DataFrame:
    """Markdown texts (value, file): the first heading is the title, or else the file's stem."""
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    title = F.coalesce(filled(F.regexp_extract("value", r"(?m)^\s*# (.*)$", 1)), stem)
    return raw.select(F.lit("_CROSS_SERIES").alias("series_id"), F.concat(F.lit("concept:"), stem).alias("doc_type"), title.alias("title"), F.col("value").alias("content"), F.lit(None).cast("string").alias("source_url"), F.lit(as_of).alias("fetched_at"))


def load_curated_docs(spark: SparkSession, json_dir: str, md_dir: str, meta: DataFrame, as_of: str, lines: bool = False) -> DataFrame:
    """Documents of JSON and Markdown files; values that are no JSON are left out (file_errors() of read_json() names their files)."""
    files = read_json(spark, json_dir, CURATED, lines).filter("broken is null").drop("position", "broken")
    texts = spark.read.option("recursiveFileLookup", True).text(md_dir, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return curated_docs(files, meta, as_of).unionByName(concept_docs(texts, as_of))


def export_queries_csv(frames: dict[str, DataFrame], out_dir: str) -> dict[str, int]:
    """Writes each frame with a header and gives its row count, which is taken while it is written."""
    counts = {}
    for name, df in frames.items():
        seen = Observation(name)
        df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").option("header", True).csv(f"{out_dir}/{name}")
        counts[name] = seen.get["n"]
    return counts


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], mode: str = "replace", keep_cols: tuple[str, ...] = ()) -> DataFrame:
    """target with updates by keys: "replace" takes the update, but for keep_cols of rows that exist; "ignore" the row that exists.

    keys are unique in either input.
    """
    columns = target.columns
    both = target.withColumn("_new", F.lit(0)).unionByName(updates.select(*columns).withColumn("_new", F.lit(1)))
    rest = [c for c in columns if c not in keys]
    oldest = lambda c: F.min_by(F.struct(c), "_new").alias(c)
    newest = lambda c: F.max_by(F.struct(c), "_new").alias(c)
    picked = both.groupBy(*keys).agg(*[oldest(c) if mode == "ignore" or c in keep_cols else newest(c) for c in rest])
    return picked.select(*keys, *[F.col(f"{c}.{c}").alias(c) for c in rest]).select(*columns)


def prune_orphans(target: DataFrame, selection: DataFrame, key: str, family_prefix: str) -> DataFrame:
    """Without the rows whose key begins with family_prefix and is not selected."""
    family = F.coalesce(F.col(key).startswith(family_prefix), F.lit(False))
    chosen = selection.select(F.col(key)).distinct()
    return target.filter(~family).unionByName(target.filter(family).join(chosen, key, "left_semi"))

