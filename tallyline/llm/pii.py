"""Personal data in texts: exact base spans, and further spans chosen by boosted trees. DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.staging import stage

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that no position is tried twice: a run is matched from its beginning or from the
#: end of the last match, and never given back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of high recall, over what the base spans leave.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?\(at\)\x20?|\x20?\[at\]\x20?|\x20at\x20)[A-Za-z0-9-]++"
             r"(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?|\x20dot\x20)[A-Za-z0-9-]++)*+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]{1,3}+(?:\x20?[.,:]\x20?|\[\.\]|\(\.\))[0-9]{1,3}+(?:\x20?[.,:]\x20?|\[\.\]|\(\.\))[0-9]{1,3}+"
          r"(?:\x20?[.,:]\x20?|\[\.\]|\(\.\))[0-9]{1,3}+(?![0-9])",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20._/-]{0,2}[0-9]){12,18}+(?![0-9])",
    "phone": r"(?:\G|(?<![0-9]))\(?[0-9]{1,4}+\)?(?:[\x20./-]{0,2}\(?[0-9]{2,5}+\)?){1,5}+(?![0-9])",
}
#: Words that speak for a kind when they stand just before a span.
CUES = {"email": "mail|contact|write", "ip": "ip|host|server|addr", "card": "card|visa|credit|pay", "phone": "phone|call|tel|fax|mobile"}
CONTEXT = 24
TREES, DEPTH, PRECISION = 12, 3, 0.99
#: Scores are counted in steps of this size where a threshold is set.
STEPS = 1 << 16
_FILL = "\u0001"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _passes(kind: str, match: Column) -> Column:
    """The test a base match must pass."""
    digits = F.length(_digits(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        return F.when(digits.between(16, 19), F.call_function("luhn_check", _digits(match))).otherwise(False)
    if kind == "phone":
        return digits.between(8, 15)
    return F.lit(True)


def _worth(kind: str, text: Column) -> Column:
    """A cheap test that a text can hold the kind at all."""
    return F.contains(text, F.lit("@")) if kind == "email" else text.rlike("[0-9]")


def matches(text: Column, pattern: str) -> Column:
    """All matches as structs of start, end (code points, end exclusive) and the matched text.

    ``split`` gives what lies between the matches, so their lengths add up to the
    positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    both = F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("gap"), m.alias("text")))
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["text"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(
            start.alias("start"), end.alias("end"), x["text"].alias("text")))).alias("spans"))

    return F.aggregate(both, F.struct(F.lit(0).alias("at"), empty.alias("spans")), add, lambda acc: acc["spans"])


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,text:string>>")


def base_spans(df: DataFrame) -> DataFrame:
    """Adds ``base_<kind>``: the valid base spans of ``text``."""
    for kind in KINDS:
        found = F.filter(matches(F.col("text"), BASE[kind]), lambda s: _passes(kind, s["text"]))
        df = df.withColumn(f"base_{kind}", F.when(_worth(kind, F.col("text")), found).otherwise(_none()))
    return df


def _masked(text: Column, kind: str) -> Column:
    """The text with valid base matches of a kind replaced by filler of the same length."""
    found = F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0))
    pieces = F.split(text, BASE[kind], -1)
    joined = F.zip_with(pieces, found, lambda b, m: F.concat(b, F.when(m.isNull(), "").when(
        _passes(kind, m), F.repeat(F.lit(_FILL), F.length(m))).otherwise(m)))
    return F.array_join(joined, "")


def _features(kind: str, span: Column, text: Column) -> dict[str, Column]:
    """Format and context of a candidate. A leading plus is left out, so that numbers without one can still pass."""
    groups = F.split(F.trim(F.regexp_replace(span["text"], "[^0-9]+", " ")), " ")
    count = F.size(groups)
    before = F.lower(F.substring(text, F.greatest(F.lit(1), span["start"] + 1 - CONTEXT), F.least(span["start"], F.lit(CONTEXT))))
    after = F.substring(text, span["end"] + 1, 1)

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("double")

    return {
        "is_ip": F.lit(float(kind == "ip")), "is_card": F.lit(float(kind == "card")), "is_phone": F.lit(float(kind == "phone")),
        "digits": F.length(_digits(span["text"])).cast("double"),
        "groups": count.cast("double"),
        "last_group": F.length(F.element_at(groups, -1)).cast("double"),
        "group_before": F.when(count > 1, F.length(F.element_at(groups, -2))).otherwise(0).cast("double"),
        "longest_group": F.array_max(F.transform(groups, lambda g: F.length(g))).cast("double"),
        "largest": F.array_max(F.transform(groups, lambda g: F.least(F.coalesce(g.try_cast("double"), F.lit(0.0)), F.lit(1e6)))),
        "luhn": flag(F.when(F.length(_digits(span["text"])).between(12, 19), F.call_function("luhn_check", _digits(span["text"])))),
        "at_sign": flag(F.contains(span["text"], F.lit("@"))),
        "dots": F.length(F.regexp_replace(span["text"], r"[^.]", "")).cast("double"),
        "brackets": flag(span["text"].rlike(r"[()\[\]]")),
        "cue": flag(before.rlike(rf"\b(?:{CUES[kind]})")),
        "letter_before": flag(before.rlike(r"[\p{L}0-9]$")),
        "letter_after": flag(after.rlike(r"[\p{L}0-9]")),
    }


def _names() -> list[str]:
    return list(_features("email", F.struct(F.lit("").alias("text"), F.lit(0).alias("start"), F.lit(0).alias("end")), F.lit("")))


def _tree(lines: list[tuple[int, str]], at: int, value) -> tuple[Column, int]:
    """One printed tree as nested conditions; returns it and the line after it."""
    depth, line = lines[at]
    if line.startswith("Predict"):
        return F.lit(float(line.split(":")[1])), at + 1
    index, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low, at = _tree(lines, at + 1, value)
    high, at = _tree(lines, at + 1, value)
    return F.when(value(int(index)) <= float(bound), low).otherwise(high), at


class Chooser:
    """Boosted trees with a threshold for each kind; as column expressions they run inside the arrays of a row."""

    def __init__(self, trees: list[str], weights: list[float], thresholds: dict[str, float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def probability(self, value) -> Column:
        total = F.lit(0.0)
        for text, weight in zip(self.trees, self.weights):
            lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]
            total = total + weight * _tree(lines, 0, value)[0]
        return 1.0 / (1.0 + F.exp(-2.0 * total))

    def wanted(self, kind: str, span: Column, text: Column) -> Column:
        columns = list(_features(kind, span, text).values())
        return self.probability(lambda k: columns[k]) >= self.thresholds.get(kind, 2.0)


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap test that a text can hold a candidate of the kind."""
    return text.rlike(r"@|\bat\b|\(at\)|\[at\]") if kind == "email" else text.rlike("[0-9]")


def candidates(docs: DataFrame) -> DataFrame:
    """``kind, label, calibration, x, n``: how many candidates of all texts have the features ``x``.

    Candidates that overlap a valid base span have label 1. A third of all, by a hash, is for calibration.
    """
    marked = docs.where("text is not null").select("text", F.xxhash64("doc_id", "text").alias("mark"))
    spans = base_spans(marked)
    every = F.concat(*[F.col(f"base_{k}") for k in KINDS])
    arrays = []
    for kind in KINDS:
        found = F.when(_may_hold(kind, F.col("text")), matches(F.col("text"), LOOSE[kind])).otherwise(_none())
        arrays.append(F.transform(F.array_distinct(F.concat(found, F.col(f"base_{kind}"))), lambda s: F.struct(
            F.lit(kind).alias("kind"),
            F.exists(every, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])).cast("double").alias("label"),
            (F.pmod(F.xxhash64("mark", F.lit(kind), s["start"], s["end"]), F.lit(3)) == 0).alias("calibration"),
            F.array(*_features(kind, s, F.col("text")).values()).alias("x"))))
    rows = spans.select(F.explode(F.concat(*arrays)).alias("c")).select("c.*")
    return rows.groupBy("kind", "label", "calibration", "x").agg(F.count(F.lit(1)).alias("n"))


def fit(docs: DataFrame) -> Chooser:
    """Trees from all candidates of ``doc_id, text``; those that overlap a valid base span are the positive ones.

    Equal candidates are one row with their number as weight. Two thirds grow the
    trees; on the rest each kind's threshold is the least score, in ``STEPS``, above
    which ``PRECISION`` of the candidates are positive.
    """
    names = _names()
    counted = stage(candidates(docs).select("kind", "label", "calibration", F.col("n").cast("double").alias("n"),
                                            *[F.col("x")[k].alias(name) for k, name in enumerate(names)]), "pii-candidates")
    learn = counted.where("not calibration")
    seen = {r["label"] for r in learn.select("label").distinct().collect()}
    if len(seen) < 2:
        return Chooser([], [], {})
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(learn)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=5, labelCol="label", featuresCol="features", weightCol="n").fit(assembled)
    chooser = Chooser([t.toDebugString for t in model.trees], list(model.treeWeights), {})
    step = F.floor(chooser.probability(lambda k: F.col(names[k])) * STEPS).cast("int")
    scored = (counted.where("calibration").withColumn("step", step).where(F.col("step") > STEPS // 2)
              .groupBy("kind", "step").agg(F.sum(F.col("label") * F.col("n")).alias("right"), F.sum("n").alias("n")).collect())
    for kind in KINDS:
        right = total = 0.0
        for r in sorted((r for r in scored if r["kind"] == kind), key=lambda r: -r["step"]):
            right, total = right + r["right"], total + r["n"]
            if right / total >= PRECISION:
                chooser.thresholds[kind] = r["step"] / STEPS
    return chooser


def find(docs: DataFrame, chooser: Chooser | None = None) -> DataFrame:
    """Adds ``base_<kind>`` and ``all_spans`` (kind number, start, end; sorted) to rows with a ``text`` column, null as empty.

    Candidates come from the text with base spans blanked out, so added spans never
    touch them. Where candidates of two kinds overlap, the earlier kind's stays.
    """
    df = base_spans(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    added = []
    if chooser and chooser.thresholds:
        blank = F.col("text")
        for kind in KINDS:
            blank = F.when(F.size(f"base_{kind}") > 0, _masked(blank, kind)).otherwise(blank)
            df = df.withColumn("__blank", blank)
            blank = F.col("__blank")
        for kind in KINDS:
            if kind not in chooser.thresholds:
                continue
            found = F.filter(matches(F.col("__blank"), LOOSE[kind]), lambda s: chooser.wanted(kind, s, F.col("__blank")))
            free = F.filter(found, lambda s: ~F.contains(s["text"], F.lit(_FILL)))
            for other in added:
                free = F.filter(free, lambda s: ~F.exists(F.col(other), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
            df = df.withColumn(f"added_{kind}", F.when(_may_hold(kind, F.col("__blank")), free).otherwise(_none()))
            added.append(f"added_{kind}")
    numbered = [F.transform(F.col(f"{how}_{kind}"), lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
                for how in ("base", "added") for k, kind in enumerate(KINDS) if how == "base" or f"added_{kind}" in added]
    return df.withColumn("all_spans", F.array_sort(F.concat(*numbered))).drop("__blank", *added)


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``: one row per input row, no shuffle.

    The counts and the digest are those of the base spans; ``spans`` holds them and
    the added ones. Null and empty texts have none. Null ids and repeated rows stay.
    """
    plain = _plain(docs, id_col, text_col)
    found = find(plain, fit(plain))
    base = F.concat(*[F.transform(F.col(f"base_{kind}"), lambda s: F.struct(
        F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))) for k, kind in enumerate(KINDS)])
    return found.select("doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("all_spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, every column kept, with all spans of the text replaced by their kind in brackets.

    Overlapping spans are replaced together under the first one's kind. Null stays null.
    """
    chooser = fit(_plain(docs, id_col, text_col))
    other = [c for c in docs.columns if c != text_col]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in other]).alias("__row"), F.col(f"`{text_col}`").alias("text"),
                      F.col(f"`{text_col}`").isNull().alias("__null"))
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(F.col("all_spans"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cut(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["parts"], F.array(
            F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.element_at(labels, s["kind"] + 1)))).otherwise(acc["parts"]).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    text = F.aggregate(ordered, start, cut, lambda acc: F.array_join(F.concat(acc["parts"], F.array(
        F.substring(F.col("text"), acc["at"] + 1, F.length("text")))), ""))
    found = find(row, chooser).withColumn("text", F.when(~F.col("__null"), F.when(F.size("all_spans") > 0, text).otherwise(F.col("text"))))
    return found.select(*[F.col("text").alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns])
