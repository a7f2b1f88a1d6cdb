"""Claims about series, predictions and scenarios, graded against the tables; citations and narratives, checked.

Claims: claim_id, metric, aggregation, value, period_start, period_end (YYYY-MM), threshold, per_capita, use_raw.
Observations: metric, date, value, value_adj. people: metric, month, people.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import month_of, ratio, within_tolerance
from .ordered import running

BOUNDARY = ("latest", "change_pct", "pct_of_start", "direction")
COUNTS = ("count_below", "count_above")
PREDICTIONS = ("prediction_latest", "prediction_at_date", "prediction_count_above", "prediction_direction")
SCENARIOS = ("scenario_min", "scenario_max")
FEATURES = ("feature_red_count", "feature_value")
COUNT_SLACK = 2.0
RESULT = ["claim_id", "actual_value", "passed", "reason"]
NARRATIVE_RULES = (  # Fixed values: patterns, and what to say of them.
    (r"(?i)\b\d+(?:\.\d+)?\s*%\s+(?:likelihood|chance|probability)\b", "a score is worded as a probability"),
    (r"(?i)\blikelihood of (?:a )?recession\b", "a score is worded as a likelihood"),
    (r"(?i)\bprobability of (?:a )?recession\b", "a score is worded as a chance"),
    (r"(?i)\bdecline in productivity\b|\bproductivity decline\b", "employment is worded as productivity"),
    (r"(?i)per-capita (?:output|activity)\b", "an employment index is worded as output"),
    (r"(?i)\b(?:is|are)\s+(?:causing|driving|displacing)\b", "a causal verb"),
    (r"(?i)\b(?:is|are)\s+responsible for\b", "a causal statement"),
    (r"(?i)(?:quarterly|annualized|annual|monthly)\s+(?:expansion|growth|increase|gain)\s+of\s+\$\d", "a level is worded as growth"),
    (r"(?i)\$\d[\d,]*\s*B?\s+(?:expansion|gain|increase)", "a level is worded as a gain"),
)
# Fixed value: wording that needs a citation.
METHOD_WORDING = r"(?i)\b(published by|seasonally adjusted|as defined by|measured by|(?:the\s+)?(?:bls|bureau of labor statistics|bea|federal reserve))\b"


def first_day(month: str) -> Column:
    return F.to_date(F.concat(F.col(month), F.lit("-01")))


def steady_sum(c: str) -> Column:
    """Sum of doubles that does not hang on the order of the rows: of their decimal digits, where these hold all values."""
    exact = F.col(c).try_cast("decimal(38,18)")
    held = F.bool_and(F.coalesce(exact.cast("double") == F.col(c), F.col(c).isNull()))
    return F.coalesce(F.when(held, F.try_sum(exact).cast("double")), F.sum(c))


def monthly_parts(obs: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """metric, month, and for raw and adjusted values: first, last, sum, n; so a claim meets months, not observations."""
    of = lambda c, s: [F.min_by(c, "date").alias(f"first_{s}"), F.max_by(c, "date").alias(f"last_{s}"), steady_sum(c).alias(f"sum_{s}")]
    parts = obs.groupBy("metric", month_of(F.col("date")).alias("month")).agg(*of("value", "raw"), *of("value_adj", "adj"), F.count("value").alias("n"))
    return parts.join(people, ["metric", "month"], "left") if people is not None else parts.withColumn("people", F.lit(None).cast("double"))


def keyed(claims: DataFrame) -> DataFrame:
    """What measured() needs of claims; months as numbers of months since year 0."""
    month = lambda c: F.year(first_day(c)) * 12 + F.month(first_day(c))
    return claims.select("claim_id", "metric", "aggregation", "threshold", F.coalesce("per_capita", F.lit(False)).alias("pc"), F.coalesce("use_raw", F.lit(False)).alias("raw"), month("period_start").alias("low"), month("period_end").alias("high"))


def points(parts: DataFrame, keys: DataFrame) -> DataFrame:
    """metric, pc, raw, month (number), v1, v2 (first and last value), s (sum), n: of the ways to read a metric that some claim of keys asks for."""
    ways = F.explode(F.array(*[F.struct(F.lit(pc).alias("pc"), F.lit(raw).alias("raw")) for pc in (False, True) for raw in (False, True)]))
    each = parts.withColumn("way", ways).select("*", "way.pc", "way.raw")
    head = F.when(F.col("pc"), F.col("people")).otherwise(F.lit(1.0))
    value = lambda s: ratio(F.when(F.col("raw"), F.col(f"{s}_raw")).otherwise(F.col(f"{s}_adj")), head)
    each = each.select("metric", "pc", "raw", (F.year("month") * 12 + F.month("month")).alias("month"), value("first").alias("v1"), value("last").alias("v2"), value("sum").alias("s"), "n").filter("v1 is not null")
    return each.join(keys.select("metric", "pc", "raw").distinct(), ["metric", "pc", "raw"], "left_semi")


def ranged(keys: DataFrame, each: DataFrame) -> DataFrame:
    """claim_id, a, b, mean, months: first and last value within the claim's months, their mean, and how many of them have values.

    Claims stand in the order of the months as two marks, before their first month and behind their last: sums are differences of running
    sums, first and last values are the nearest ones to the marks. A sum over a value that is not finite is not a number.
    """
    ids = keys.schema["claim_id"].dataType
    finite = F.abs("s") < float("inf")  # not for NaN, which is above all numbers
    values = each.select("metric", "pc", "raw", "month", F.lit(1).alias("mark"), F.lit(None).cast(ids).alias("claim_id"), F.when(finite, F.col("s")).otherwise(0.0).alias("s"), F.when(finite, 0).otherwise(1).cast("long").alias("odd"), "n", F.lit(1).cast("long").alias("one"), F.struct("month", F.col("v1").alias("v")).alias("first"), F.struct("month", F.col("v2").alias("v")).alias("last"))
    marks = keys.withColumn("x", F.explode(F.array(F.struct(F.col("low").alias("month"), F.lit(0).alias("mark")), F.struct(F.col("high").alias("month"), F.lit(2).alias("mark")))))
    marks = marks.select("metric", "pc", "raw", "x.month", "x.mark", "claim_id").filter("month is not null")
    run = running(values.unionByName(marks, allowMissingColumns=True), ["metric", "pc", "raw"], ["month", "mark"], ("s", "odd", "n", "one"), ("last",), ("first",)).filter("mark != 1")
    difference = lambda c: F.sum(F.when(F.col("mark") == 2, F.col(f"{c}_sum")).otherwise(-F.col(f"{c}_sum")))
    at = lambda mark, c: F.max(F.when(F.col("mark") == mark, F.col(c)))
    found = run.groupBy("claim_id").agg(at(0, "first_next").alias("first"), at(2, "last_last").alias("last"), at(0, "month").alias("low"), at(2, "month").alias("high"), *[difference(c).alias(c) for c in ("s", "odd", "n", "one")])
    mean = F.when(F.col("odd") > 0, float("nan")).otherwise(F.col("s") / F.col("n"))
    return found.filter("one > 0 and low <= high").select("claim_id", F.col("first.v").alias("a"), F.col("last.v").alias("b"), mean.alias("mean"), F.col("one").alias("months"))


def dominated(keys: DataFrame, each: DataFrame) -> DataFrame:
    """claim_id, under: of the months within a claim's period, how many have a mean below its threshold (count_below) or not above it (count_above).

    The months before a bound are blocks of 1, 2, 4, ... months, one for each bit of their number; a month's mean stands in the block of each
    size that it lies in, and claims stand in the order of the means by their thresholds. So a claim costs two rows for each bit, whatever
    the number of months, and no claim meets the means.
    """
    ids = keys.schema["claim_id"].dataType
    asked = keys.filter(F.col("aggregation").isin(*COUNTS) & F.col("threshold").isNotNull() & (F.col("low") <= F.col("high")))
    span = each.agg(F.min("month").alias("low"), F.max("month").alias("high")).first()
    first, size = (span["low"], span["high"] - span["low"] + 1) if span["low"] is not None else (0, 0)
    levels = F.explode(F.sequence(F.lit(0), F.lit(size.bit_length())))
    block = lambda n: F.call_function("shiftright", n, F.col("level"))
    means = each.withColumn("level", levels).select("metric", "pc", "raw", "level", block(F.col("month") - first).alias("block"), (F.col("s") / F.col("n")).alias("value"), F.lit(1).alias("mark"), F.lit(1).cast("long").alias("one"), F.lit(None).cast(ids).alias("claim_id"), F.lit(None).cast("int").alias("sign"))
    bound = lambda c: F.greatest(F.lit(0), F.least(F.lit(size), c - first))
    ends = F.explode(F.array(F.struct(bound(F.col("low")).alias("to"), F.lit(-1).alias("sign")), F.struct(bound(F.col("high") + 1).alias("to"), F.lit(1).alias("sign"))))
    marks = asked.withColumn("x", ends).withColumn("level", levels).filter(F.getbit(F.col("x.to").cast("long"), F.col("level")) == 1)
    mark = F.when(F.col("aggregation") == "count_below", 0).otherwise(2)
    marks = marks.select("metric", "pc", "raw", "level", (block(F.col("x.to")) - 1).alias("block"), F.col("threshold").cast("double").alias("value"), mark.alias("mark"), F.lit(0).cast("long").alias("one"), "claim_id", F.col("x.sign").alias("sign"))
    run = running(means.unionByName(marks), ["metric", "pc", "raw", "level", "block"], ["value", "mark"], ("one",)).filter("claim_id is not null")
    return run.groupBy("claim_id").agg(F.sum(F.col("sign") * F.col("one_sum")).alias("under"))


def measured(claims: DataFrame, parts: DataFrame) -> DataFrame:
    """claim_id with a, b (first and last value of its period), mean, below, above: running sums and nearest values, no join of claims with months.

    claim_id is unique. below and above count months by their means; they are 0 without a threshold and only counted for the aggregation that asks.
    """
    keys = keyed(claims)
    each = points(parts, keys)
    both = ranged(keys, each).join(keys.select("claim_id", "aggregation", "threshold"), "claim_id").join(dominated(keys, each), "claim_id", "left")
    under = F.coalesce("under", F.lit(0).cast("long"))
    counted = lambda kind, n: F.when((F.col("aggregation") == kind) & F.col("threshold").isNotNull(), n).otherwise(F.lit(0).cast("long"))
    return both.select("claim_id", "a", "b", "mean", counted("count_below", under).alias("below"), counted("count_above", F.col("months") - under).alias("above"))


def computed() -> Column:
    """The value that a claim's aggregation has in the columns of measured()."""
    a, b, kind = F.col("a"), F.col("b"), F.col("aggregation")
    return (
        F.when(kind == "latest", b)
        .when(kind == "change_pct", ratio(b - a, a) * 100)
        .when(kind == "pct_of_start", ratio(b, a) * 100)
        .when(kind == "direction", F.when(b > a, 1.0).otherwise(-1.0))
        .when(kind == "average", F.col("mean"))
        .when(kind == "count_below", F.col("below").cast("double"))
        .when(kind == "count_above", F.col("above").cast("double"))
    )


def graded(rows: DataFrame, actual: Column, passed: Column, missing: str, digits: int = 2) -> DataFrame:
    """claim_id, actual_value, passed, reason"""
    known = actual.isNotNull()
    ok = F.coalesce(passed & known, F.lit(False))
    reason = F.when(~known, missing).when(ok, "within tolerance").otherwise("outside tolerance")
    return rows.select("claim_id", F.round(actual, digits).alias("actual_value"), ok.alias("passed"), reason.alias("reason"))


def judged_claims(claims: DataFrame, parts: DataFrame, kinds: tuple[str, ...], digits: int) -> DataFrame:
    some = claims.filter(F.col("aggregation").isin(*kinds))
    rows = some.join(measured(some, parts), "claim_id", "left").withColumn("_actual", computed())
    near = F.when(F.col("aggregation").isin(*COUNTS), F.abs(F.col("value") - F.col("_actual")) <= COUNT_SLACK)
    near = near.when(F.col("aggregation") == "direction", (F.col("value") > 0) == (F.col("_actual") > 0)).otherwise(within_tolerance(F.col("value"), F.col("_actual")))
    return graded(rows, F.col("_actual"), near, "no data, or nothing to start from", digits)


def verify_boundary_claims(claims: DataFrame, parts: DataFrame, digits: int = 2) -> DataFrame:
    return judged_claims(claims, parts, BOUNDARY, digits)


def verify_average_claims(claims: DataFrame, parts: DataFrame, digits: int = 2) -> DataFrame:
    return judged_claims(claims, parts, ("average",), digits)


def verify_count_claims(claims: DataFrame, parts: DataFrame, digits: int = 2) -> DataFrame:
    return judged_claims(claims, parts, COUNTS, digits)


def verify_prediction_claims(claims: DataFrame, predictions: DataFrame, grid: DataFrame, red_counts: DataFrame, digits: int = 4) -> DataFrame:
    """Claims about predictions (metric, date, probability), the scenario grid (probability) and red features (metric, red_count).

    A feature_value is accepted where its metric has features at all; where claims name a feature and red_counts has a column of
    that name, the column must have a value too.

    As-of lookups put claims among the predictions in the order of dates, counts put them in the order of probabilities by their thresholds:
    either is read off running values, so no claim meets the predictions, and a metric's rows may lie in many tasks.
    """
    of = claims.filter(F.col("aggregation").isin(*PREDICTIONS)).withColumn("_at", F.last_day(first_day("period_start")))
    ids = claims.schema["claim_id"].dataType
    rows = predictions.select("metric", "date", F.col("probability").cast("double").alias("probability"), F.lit(0).alias("mark"), F.lit(None).cast(ids).alias("claim_id"))
    marks = of.filter("_at is not null").select("metric", F.col("_at").alias("date"), F.lit(None).cast("double").alias("probability"), F.lit(1).alias("mark"), "claim_id")
    as_of = running(rows.unionByName(marks), ["metric"], ["date", "mark"], last=("probability",)).filter("mark = 1").select("claim_id", F.col("probability_last").alias("as_of"))
    whole = predictions.groupBy("metric").agg(F.max_by("probability", "date").alias("latest"), F.count("probability").alias("known"))
    scores = rows.filter("probability is not null").select("metric", "probability", "mark", F.lit(1).cast("long").alias("one"), "claim_id")
    asked = of.filter("aggregation = 'prediction_count_above' and threshold is not null").select("metric", F.col("threshold").cast("double").alias("probability"), F.lit(1).alias("mark"), F.lit(0).cast("long").alias("one"), "claim_id")
    under = running(scores.unionByName(asked), ["metric"], ["probability", "mark"], ("one",)).filter("mark = 1").select("claim_id", F.col("one_sum").alias("under"))
    rows = of.join(whole, "metric", "left").join(as_of, "claim_id", "left").join(under, "claim_id", "left")
    over = F.when(F.col("known").isNotNull(), F.when(F.col("threshold").isNull(), 0).otherwise(F.col("known") - F.col("under")))
    kind, value = F.col("aggregation"), F.col("value")
    actual = F.when(kind == "prediction_latest", F.col("latest")).when(kind == "prediction_at_date", F.col("as_of")).when(kind == "prediction_count_above", over.cast("double")).otherwise(F.when(F.col("latest") > F.col("as_of"), 1.0).otherwise(-1.0))
    rows = rows.withColumn("_actual", actual)
    near = F.when(kind == "prediction_count_above", F.abs(value - F.col("_actual")) <= COUNT_SLACK).when(kind == "prediction_direction", (value > 0) == (F.col("_actual") > 0)).otherwise(within_tolerance(value, F.col("_actual")))
    out = graded(rows, F.col("_actual"), near, "no prediction", digits)
    ends = grid.agg(F.min("probability").alias("_lo"), F.max("probability").alias("_hi"))
    scenario = claims.filter(F.col("aggregation").isin(*SCENARIOS)).crossJoin(F.broadcast(ends)).withColumn("_actual", F.when(kind == "scenario_min", F.col("_lo")).otherwise(F.col("_hi")))
    out = out.unionByName(graded(scenario, F.col("_actual"), within_tolerance(value, F.col("_actual")), "no scenarios", digits))
    red = claims.filter(F.col("aggregation").isin(*FEATURES)).join(red_counts, "metric", "left")
    there = F.col("red_count").isNotNull()
    if "feature" in claims.columns:
        for name in {"strongest_red", "strongest_green"} & set(red_counts.columns):
            there &= F.coalesce(F.col("feature") != name, F.lit(True)) | F.col(name).isNotNull()
    red = red.withColumn("_actual", F.when(kind == "feature_red_count", F.col("red_count").cast("double")).when(there, value))
    return out.unionByName(graded(red, F.col("_actual"), (kind == "feature_value") | (F.abs(value - F.col("_actual")) <= COUNT_SLACK), "no features", digits))


def verify_claims(claims: DataFrame, parts: DataFrame, predictions: DataFrame, grid: DataFrame, red_counts: DataFrame) -> DataFrame:
    """Every claim graded by its aggregation; one that is not known fails."""
    known = [*BOUNDARY, "average", *COUNTS, *PREDICTIONS, *SCENARIOS, *FEATURES]
    out = judged_claims(claims, parts, (*BOUNDARY, "average", *COUNTS), 2).unionByName(verify_prediction_claims(claims, predictions, grid, red_counts))
    other = claims.filter(~F.coalesce(F.col("aggregation").isin(*known), F.lit(False)))
    return out.unionByName(other.select("claim_id", F.lit(None).cast("double").alias("actual_value"), F.lit(False).alias("passed"), F.lit("unknown aggregation").alias("reason")))


def build_claims(spec: DataFrame, parts: DataFrame, digits: int = 2) -> DataFrame:
    """Claims from a spec: spec_id, metric, aggregation, rule (full, trailing or since), months, since (YYYY-MM), threshold, per_capita, use_raw."""
    bounds = parts.groupBy("metric").agg(F.min("month").alias("_first"), F.max("month").alias("_last"))
    start = F.when(F.col("rule") == "trailing", F.add_months("_last", 1 - F.col("months"))).when(F.col("rule") == "since", first_day("since")).otherwise(F.col("_first"))
    placed = spec.join(bounds, "metric").withColumns({"claim_id": F.col("spec_id"), "period_start": F.date_format(start, "yyyy-MM"), "period_end": F.date_format("_last", "yyyy-MM")})
    columns = ["claim_id", "metric", "aggregation", "period_start", "period_end", "threshold", "per_capita", "use_raw"]
    return placed.join(measured(placed, parts), "claim_id").withColumn("value", F.round(computed(), digits)).select(*columns, "value")


def claims_json(claims: DataFrame) -> DataFrame:
    return claims.select("claim_id", F.to_json(F.struct(*claims.columns)).alias("claims_json"))


def insight_status(insights: DataFrame, results: DataFrame) -> DataFrame:
    """insight_id, total, passed_count, all_verified (true without claims), status."""
    sums = results.groupBy("insight_id").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed_count"))
    out = insights.select("insight_id").join(sums, "insight_id", "left").fillna(0, subset=["total", "passed_count"])
    status = F.when(F.col("total") == F.col("passed_count"), "Verified").when(F.col("passed_count") > 0, "Partially Verified").otherwise("Unverified")
    return out.withColumns({"all_verified": F.col("total") == F.col("passed_count"), "status": status})


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def verify_citations(citations: DataFrame, docs: DataFrame, head: int = 60) -> DataFrame:
    """citations (ref_id, excerpt, ...) with ref_exists and excerpt_matches: the excerpt's beginning is part of the document (ref_id, content)."""
    part = squeezed(F.rtrim(F.substring("excerpt", 1, head), F.lit(". \t\n")))
    rows = citations.join(docs.select("ref_id", "content"), "ref_id", "left")
    return rows.select(*citations.columns, F.col("content").isNotNull().alias("ref_exists"), F.coalesce((part != "") & squeezed(F.col("content")).contains(part), F.lit(False)).alias("excerpt_matches"))


TAG = r"\[ref:(\d+)\]"


def extract_citations(narratives: DataFrame, provided: DataFrame, limit: int = 240) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(narrative_id, text without the valid tags), (narrative_id, ref_id, title, excerpt), (narrative_id, ref_id, warning) from [ref:N] tags.

    provided: narrative_id, ref_id, title, content. A tag is valid if its number was provided to its narrative.
    """
    cited = narratives.select("narrative_id", F.explode(F.regexp_extract_all("text", F.lit(TAG), F.lit(1))).alias("n")).select("narrative_id", F.col("n").try_cast("long").alias("ref_id"))
    known = cited.distinct().join(provided, ["narrative_id", "ref_id"])
    content = F.trim("content")
    excerpt = F.when(F.length(content) > limit, F.concat(F.rtrim(F.substring(content, 1, limit - 3)), F.lit("..."))).otherwise(content)
    records = known.select("narrative_id", "ref_id", "title", excerpt.alias("excerpt"))
    warnings = cited.join(provided.select("narrative_id", "ref_id"), ["narrative_id", "ref_id"], "left_anti").withColumn("warning", F.lit("cites what was not provided"))
    valid = known.groupBy("narrative_id").agg(F.array_join(F.sort_array(F.collect_set(F.col("ref_id").cast("string"))), "|").alias("_ids"))
    rows = narratives.join(valid, "narrative_id", "left")
    bare = F.when(F.col("_ids").isNull(), F.col("text")).otherwise(F.regexp_replace(F.col("text"), F.concat(F.lit(r"\[ref:0*(?:"), F.col("_ids"), F.lit(r")\]")), F.lit("")))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\S\n]{2,}", " "), r"[^\S\n]+([,.;:!?])", "$1"))
    return rows.select("narrative_id", tidy.alias("text")), records, warnings


def validate_narratives(narratives: DataFrame, rules=NARRATIVE_RULES, most: int = 2) -> DataFrame:
    """narrative_id, warnings; narratives: narrative_id, text, citations (number), had_refs."""
    text, n = F.col("text"), F.col("citations")
    checks = [F.when(text.rlike(p), F.lit(message)) for p, message in rules]
    checks.append(F.when(F.col("had_refs") & (n == 0) & text.rlike(METHOD_WORDING), F.lit("wording of methods without a citation")))
    checks.append(F.when(n > most, F.lit("too many citations")))
    return narratives.select("narrative_id", F.filter(F.array(*checks), lambda x: x.isNotNull()).alias("warnings"))


RESPONSE = "narrative string, claims array<struct<statement:string,metric_type:string,series_id:string,expected_value:string,date_range:array<string>,use_raw:boolean,per_capita:boolean,threshold:double>>"


def parse_responses(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, narrative), (id, claim columns) from texts that hold JSON: whole, fenced, or between the outermost braces.

    Claims without metric_type, series_id or a numeric expected_value are left out; only a date_range of two counts.
    """
    text = F.col("text")
    # Fixed value: the pattern of a fenced block.
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    parsed = [F.when(F.get_json_object(c, "$").startswith("{"), F.from_json(c, RESPONSE)) for c in (text, fenced, braces)]
    rows = raw.withColumn("_r", F.coalesce(*parsed))
    narratives = rows.select("id", F.coalesce("_r.narrative", "text").alias("narrative"))
    each = rows.select("id", F.posexplode("_r.claims").alias("position", "c")).select("id", "position", "c.*")
    value = F.col("expected_value").try_cast("double")
    claims = each.filter(F.col("metric_type").isNotNull() & F.col("series_id").isNotNull() & value.isNotNull()).withColumns({"expected_value": value, "date_range": F.when(F.size("date_range") == 2, F.col("date_range"))})
    return narratives, claims
