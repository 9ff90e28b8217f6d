"""Personal data: overlapping candidate spans, judged by boosted trees.

Base spans are the matches of fixed patterns that pass their checks; they always count.  Wider generators propose more
spans, which may overlap; trees boosted over features of a candidate's format and of the text around it score those that
pass their kind's check and touch no base span, and a candidate whose score reaches its kind's threshold is a span, too.
Of the chosen ones that overlap, the better stays.

Nothing is labelled by hand.  Positive are the base spans, and planted variants of them that no base pattern matches: an
address with its signs written out, a phone number without its plus, a card with other separators, an ip with blanks.
Negative are matches that fail their check, in either form, and base spans planted inside a longer token.  A kind's
threshold is the score that at most `FALSE_SHARE` of the negatives of a held-out fold reach, and at least `LEAST_SCORE`;
what is judged is in no fold.

Everything is DataFrame and SQL functions and Spark's own tree learner; no Python runs on the executors.  The learner and
the thresholds see every example: those of equal features are one row with their number as its weight, so that what the
learner reads grows with the forms that occur, not with the texts.

A null text is empty and has no spans.  Repeated rows each get their spans.  Rows without a doc_id are judged alike.
Extra columns are ignored, and kept by `redact` whatever their names.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jobs

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base spans, with quantifiers that give nothing back where giving back can't match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of more candidates.
WIDE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}){1,5}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?[.,]\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?\x20?\(?[0-9][0-9\x20().-]{7,18}[0-9](?![0-9])",
}
#: A second generator of phone numbers, in groups, which doesn't run on into a number that follows.
GROUPED = r"(?<![0-9A-Za-z.+-])(?:\+|00)?[0-9]{0,3}[\x20.-]{0,2}\(?[0-9]{2,4}\)?[\x20.-]{0,2}[0-9]{2,4}[\x20.-]{0,2}[0-9]{3,4}(?![.-]?[0-9])"
#: With so many bins every value of a feature is a possible split, and the learner looks for splits in all rows, up to the square of that.
TREES, DEPTH, BINS = 12, 4, 4096
LEAST_SCORE, FALSE_SHARE = 0.8, 0.01
#: One example in so many is in the held-out fold; characters of a match that features are taken from.
FOLDS, LONGEST = 4, 80
_MARK, _PLAIN = "\u0001", "\u0002"
#: Words before a span that speak for a kind.
_CUES = r"(?i)(mail|contact|tel|phone|call|mobile|fax|card|visa|credit|host|server|addr|ip)\W*$"


def _matches(text: Column, pattern: str, kind: str, base: bool) -> Column:
    """array<struct<kind, base, start, stop, match>> of a pattern's matches, in order.

    One pass marks the matches; the pieces between marks are gaps and matches by turns.
    """
    pieces = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    empty = F.array().cast("array<struct<kind:string,base:boolean,start:int,stop:int,match:string>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), empty.alias("out"))

    def step(s: Column, piece: Column) -> Column:
        stop = (s["at"] + F.length(piece)).cast("int")
        one = F.array(F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), s["at"].alias("start"), stop.alias("stop"), piece.alias("match")))
        return F.struct(stop.alias("at"), (~s["inside"]).alias("inside"), F.when(s["inside"], F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """True if the digits pass the check sum."""
    parts = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _checks(match: Column, kind: Column) -> tuple[Column, Column, Column]:
    """The digits of a match, whether it passes its kind's check, and whether its check sum is right."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    octets = F.forall(F.split(F.regexp_replace(match, r"\x20?[.,]\x20?", "."), r"\."), lambda p: F.regexp_like(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    sum_ok = (n > 0) & (n <= 30) & _luhn(F.substring(digits, 1, 30))
    ok = F.when(kind == "email", True).when(kind == "ip", octets).when(kind == "card", (n >= 14) & (n <= 19) & sum_ok).otherwise((n >= 10) & (n <= 15))
    return digits, F.coalesce(ok, F.lit(False)), F.coalesce(sum_ok, F.lit(False))


FEATURES = ("kind_id", "length", "n_digits", "n_groups", "first_group", "last_group", "plus", "brackets", "at_sign", "dots", "spaces", "hyphens", "letters", "sum_ok", "octets_ok", "closed", "opened", "cue", "assigned", "hex_near")


def candidates(docs: DataFrame) -> DataFrame:
    """Spans of the base patterns that pass or fail, and of the generators, with the text in and around them.

    docs: row_key, text.  Returns row_key, kind, start, stop, base, ok, match (its beginning), before and after.
    """
    text = F.translate(F.coalesce("text", F.lit("")), _MARK, _PLAIN)
    rows = docs.select("row_key", text.alias("t")).filter(F.col("t").contains("@") | F.col("t").rlike("[0-9]|at[)\\]]"))
    none = F.array().cast("array<struct<kind:string,base:boolean,start:int,stop:int,match:string>>")
    gate = {"email": F.col("t").contains("@"), "ip": F.col("t").rlike(r"[0-9]\.[0-9]"), "card": F.col("t").rlike(r"[0-9][\x20-]?[0-9]"), "phone": F.col("t").contains("+")}
    wide = {"email": F.col("t").rlike(r"@|[(\[]at[)\]]"), "ip": F.col("t").rlike(r"[0-9]\x20?[.,]\x20?[0-9]"), "card": F.col("t").rlike("(?:[0-9][\\x20.-]{0,2}){13}"), "phone": F.col("t").rlike(r"[0-9][0-9\x20().-]{7}")}
    plan = [(BASE[k], k, gate[k], True) for k in KINDS] + [(WIDE[k], k, wide[k], False) for k in KINDS] + [(GROUPED, "phone", wide["phone"], False)]
    found = [F.when(g, _matches(F.col("t"), p, k, b)).otherwise(none) for p, k, g, b in plan]
    spans = rows.select("row_key", "t", F.inline(F.concat(*found)))
    _, ok, _ = _checks(F.col("match"), F.col("kind"))
    before = F.substring(F.col("t"), F.greatest(F.col("start") - 19, F.lit(1)), F.least(F.col("start"), F.lit(20)))
    after = F.substring(F.col("t"), F.col("stop") + 1, 10)
    return spans.select("row_key", "kind", "start", "stop", "base", ok.alias("ok"), F.substring("match", 1, LONGEST).alias("match"), before.alias("before"), after.alias("after")).dropDuplicates(["row_key", "kind", "base", "start", "stop"])


def with_features(spans: DataFrame) -> DataFrame:
    """Candidates (kind, match, before, after) with the features that trees judge them by."""
    number = lambda c: c.cast("double")
    digits, _, sum_ok = _checks(F.col("match"), F.col("kind"))
    count = lambda pattern: number(F.length("match") - F.length(F.regexp_replace("match", pattern, "")))
    groups = F.filter(F.split("match", "[^0-9]+"), lambda g: F.length(g) > 0)
    size_at = lambda i: number(F.coalesce(F.length(F.try_element_at(groups, F.lit(i))), F.lit(0)))
    before, after = F.col("before"), F.col("after")
    return spans.withColumns({
        "kind_id": number(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))), "length": number(F.length("match")), "n_digits": number(F.length(digits)),
        "n_groups": number(F.size(groups)), "first_group": size_at(1), "last_group": size_at(-1), "plus": number(F.col("match").startswith("+")),
        "brackets": count(r"[()\[\]]"), "at_sign": count("@"), "dots": count(r"\."), "spaces": count(" "), "hyphens": count("-"), "letters": count("[A-Za-z]"),
        "sum_ok": number(sum_ok), "octets_ok": number(F.regexp_like("match", F.lit(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\x20?[.,]\x20?|$)){4}$"))),
        "closed": number(F.regexp_like(after, F.lit(r"^(?:\W|$)"))), "opened": number(F.regexp_like(before, F.lit(r"(?:\W|^)$"))), "cue": number(F.regexp_like(before, F.lit(_CUES))),
        "assigned": number(F.regexp_like(before, F.lit(r"[=:]\s*[\"']?$"))), "hex_near": number(F.regexp_like(F.concat(before, F.lit("|"), after), F.lit(r"[0-9a-f]\||\|[0-9a-f]"))),
    })


def _variants() -> Column:
    """How a match of each kind is also written."""
    at, dot = F.lit(" (at) "), F.lit(" (dot) ")
    by = {
        "email": [F.regexp_replace("match", F.lit("@"), at), F.regexp_replace(F.regexp_replace("match", F.lit("@"), at), F.lit(r"\.(?=[A-Za-z0-9-]*$)"), dot), F.regexp_replace("match", F.lit("@"), F.lit(" @ "))],
        "ip": [F.regexp_replace("match", F.lit(r"\."), F.lit(" . ")), F.regexp_replace("match", F.lit(r"\."), F.lit(", "))],
        "card": [F.regexp_replace("match", F.lit(r"[\x20-]"), F.lit(".")), F.regexp_replace("match", F.lit(r"([0-9]{4})[\x20-]?(?=[0-9])"), F.lit("$1.")), F.regexp_replace("match", F.lit(r"[\x20-]"), F.lit("  "))],
        "phone": [F.regexp_replace("match", F.lit(r"^\+"), F.lit("")), F.regexp_replace("match", F.lit(r"^\+"), F.lit("00")), F.regexp_replace("match", F.lit(r"^\+[0-9]{1,2}\x20"), F.lit("")), F.col("match")],
    }
    out = F.array().cast("array<string>")
    for kind, forms in by.items():
        out = F.when(F.col("kind") == kind, F.array(*forms)).otherwise(out)
    return out


def examples(spans: DataFrame) -> DataFrame:
    """All examples by kind, features, label and fold, with their number: base spans and their variants, matches that fail, and spans inside tokens."""
    good, bad = spans.filter("base and ok"), spans.filter("not ok").dropDuplicates(["row_key", "kind", "start", "stop"])
    forms = lambda df: df.withColumn("match", F.explode(F.array_distinct(F.concat(F.array("match"), _variants()))))
    token = F.sha1("match")
    inside = good.filter("kind <> 'email'").withColumns({"before": F.substring(token, 1, 19), "after": F.substring(token, 20, 10)})
    labelled = lambda df, y: forms(df).withColumn("label", F.lit(y))
    rows = labelled(good, 1.0).unionByName(labelled(bad, 0.0)).unionByName(labelled(inside, 0.0))
    rows = with_features(rows.withColumn("fold", F.pmod(F.xxhash64("row_key", "start"), F.lit(FOLDS))))
    return rows.groupBy("kind", "fold", "label", *FEATURES).agg(F.count("*").alias("n"))


def _judged(spans: DataFrame) -> DataFrame:
    """The generated candidates that pass their kind's check and touch no base span, nor a part of a long number that fails."""
    long = (F.col("kind") == "card") & (F.length(F.regexp_replace("match", "[^0-9]", "")) >= 13)
    base = spans.filter(F.col("base") & (F.col("ok") | long)).select("row_key", F.col("start").alias("s"), F.col("stop").alias("e"))
    wide = spans.filter("not base and ok")
    held = base.groupBy("row_key").agg(F.collect_list(F.struct("s", "e")).alias("held"))
    free = wide.join(held, "row_key", "left")
    touches = F.exists("held", lambda h: (h["s"] < F.col("stop")) & (F.col("start") < h["e"]))
    return free.filter(~F.coalesce(touches, F.lit(False))).drop("held")


def fit(rows: DataFrame) -> GBTClassificationModel | None:
    """Boosted trees over labelled examples, weighted by their number; None if either label is missing."""
    if rows.select("label").distinct().count() < 2:
        return None
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=BINS, weightCol="n").fit(table.select("features", "label", F.col("n").cast("double").alias("n")))


def _best(chosen: DataFrame) -> DataFrame:
    """Of the chosen spans of a document that overlap, the one of higher score, then the longer."""
    one = F.struct((-F.round("score", 6)).alias("rank"), (F.col("start") - F.col("stop")).alias("size"), "start", "stop", "kind")
    per = chosen.groupBy("row_key").agg(F.array_sort(F.collect_list(one)).alias("all"))
    none = F.array().cast("array<struct<kind:string,start:int,stop:int>>")
    add = lambda kept, x: F.when(F.exists(kept, lambda k: (k["start"] < x["stop"]) & (x["start"] < k["stop"])), kept).otherwise(F.concat(kept, F.array(F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))))
    return per.select("row_key", F.inline(F.aggregate("all", none, add))).withColumn("base", F.lit(False)).select("row_key", "kind", "start", "stop", "base")


def _scored(model: GBTClassificationModel, spans: DataFrame) -> DataFrame:
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(spans)
    return model.transform(table).withColumn("score", vector_to_array("probability")[1])


def find(docs: DataFrame) -> DataFrame:
    """row_key, kind, start, stop and base of the spans of docs (row_key, text)."""
    spans = jobs.stored(candidates(docs), "pii-candidates")
    base = spans.filter("base and ok").select("row_key", "kind", "start", "stop", F.lit(True).alias("base"))
    rows = jobs.stored(examples(spans), "pii-examples")
    model = fit(rows.filter("fold > 0"))
    if model is None:
        return base
    low = _scored(model, rows.filter("fold = 0 and label = 0")).groupBy("kind").agg(F.percentile("score", F.lit(1 - FALSE_SHARE), F.col("n")).alias("limit"))
    wide = _scored(model, with_features(_judged(spans))).select("row_key", "kind", "start", "stop", "score")
    more = wide.join(F.broadcast(low), "kind", "left").filter((F.col("score") >= LEAST_SCORE) & (F.col("score") > F.coalesce("limit", F.lit(0.0))))
    return base.unionByName(_best(more))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, and spans, of every document."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    one = F.struct("start", order.alias("order"), F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("stop").cast("string")).alias("s"))
    text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["s"]), ",")
    per = find(rows).groupBy("row_key").agg(*[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS], text(F.collect_list(F.when(F.col("base"), one))).alias("base"), text(F.collect_list(one)).alias("spans"))
    out = rows.select("doc_id", "row_key").join(per, "row_key", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; overlapping spans become the first one's kind."""
    key, spans = jobs.free_names(docs, "_key", "_spans")
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = find(rows.select(F.col(key).alias("row_key"), "text"))
    per = found.groupBy(F.col("row_key").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias(spans))
    both = rows.join(per.hint("merge"), key, "left")  # moves texts: one form at every size
    t = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.when(x["start"] > s["at"], F.substring(t, s["at"] + 1, x["start"] - s["at"])).otherwise(F.lit(""))
        new = F.when(x["start"] >= s["at"], F.concat(s["out"], gap, F.lit("["), x["kind"], F.lit("]"))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), new.alias("out"))

    redacted = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(t, s["at"] + 1, F.length(t))))
    text = F.when(F.col(spans).isNull(), t).otherwise(redacted)
    return both.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])
