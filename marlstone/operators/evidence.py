"""Evidence: units of text, the quality gate, claims against units, selection of units for a question."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ABSOLUTE, INDIRECT, NEGATION, QUANTITY, SENTENCE_END, claim_numbers, claim_terms, collapse, factual, let, strong_terms
from ..storage import materialize, small
from . import retrieval
from .inventory import first_rows

# Where a text is cut into sections, the length of a unit, labels that only guide.
SECTION_MARK = r"\[第\s*[0-9]+\s*页(?:/张)?(?:\s*OCR)?\]|\[幻灯片\s*[0-9]+\]|\n#{1,6}\s+"
PAGE_MARK = r"\[(?:第\s*([0-9]+)\s*页(?:/张)?(?:\s*OCR)?|幻灯片\s*([0-9]+))\]"
UNIT_CHARS = 1200
GUIDE_LABELS = ["title", "section_header", "heading"]
BODY_LABELS = ["table", "paragraph", "text_chunk", "list_item", "structured_column"]


def evidence_units(docs: DataFrame, unit: int = UNIT_CHARS) -> DataFrame:
    """docs: path, sha256, text. Units of each whole text, cut at page marks, headings and every ``unit`` characters."""
    sections = F.split(F.coalesce("text", F.lit("")), f"(?={SECTION_MARK})", -1)

    def paged(section: Column) -> Column:
        page = F.coalesce(F.nullif(F.regexp_extract(section, PAGE_MARK, 1), F.lit("")), F.nullif(F.regexp_extract(section, PAGE_MARK, 2), F.lit("")))
        return F.struct(page.cast("int").alias("page"), section.alias("body"))

    def cut(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(x["body"]) - 1, F.lit(0)), F.lit(unit))
        return F.transform(starts, lambda i: F.struct(x["page"].alias("page"), collapse(F.substring(x["body"], i + 1, F.lit(unit))).alias("text")))

    # a section's page is looked up once, not for each of its units
    units = F.filter(F.flatten(F.transform(F.transform(sections, paged), cut)), lambda u: u["text"] != "")
    out = docs.select("path", "sha256", F.posexplode(units).alias("seq", "u"))
    named = F.concat(F.lit("E-"), F.substring("sha256", 1, 10), F.lit("-"), F.lpad((F.col("seq") + 1).cast("string"), F.greatest(F.lit(5), F.length((F.col("seq") + 1).cast("string"))), F.lit("0")))
    return out.select("path", named.alias("evidence_id"), (F.col("seq") + 1).cast("long").alias("seq"), F.col("u.page").alias("page"), F.lit("text_chunk").alias("label"), F.col("u.text").alias("text"), F.col("sha256").alias("source_sha256"), F.sha2("u.text", 256).alias("content_sha256"))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, "^[ ：:;；。.]+|[ ：:;；。.]+$", "")


def _judged(bare: Column, stated: Column, numeric: Column, label: Column | None) -> Column:
    n = F.length(bare)
    guide = F.lower(label).isin(GUIDE_LABELS) if label is not None else F.lit(False)
    reason = (
        F.when(F.coalesce(n, F.lit(0)) < 6, "too_short")
        .when((n < 24) & ~stated, "short_without_fact")
        .when(guide, "guides_only")
        .when(F.substring(bare, -1, 1).isin("?", "？"), "question")
        .when((n < 55) & ~stated, "topic_phrase")
        .otherwise("eligible")
    )
    points = F.least(n, F.lit(360)) / 18.0 + F.regexp_count(bare, F.lit(SENTENCE_END)) * 2 + stated.cast("int") * 8 + numeric.cast("int") * 5
    penalty = F.when(reason.isin("too_short", "short_without_fact"), -80.0).when(reason == "guides_only", -75.0).when(reason == "question", -70.0).otherwise(-55.0)
    ok = reason == "eligible"
    return F.struct(ok.alias("eligible"), reason.alias("reason"), F.when(ok, F.round(points, 3)).otherwise(penalty).alias("score"), (ok & stated).alias("factual"), (ok & numeric).alias("numeric"))


def quality(text: Column, label: Column | None = None) -> Column:
    """Struct: eligible, reason, score, factual, numeric. text: collapsed. For few rows; ``gated`` looks at each text once."""
    bare = _bare(text)
    return _judged(bare, factual(bare), bare.rlike(QUANTITY), label)


def gated(units: DataFrame) -> DataFrame:
    """Units with ``quality``. What the rules ask of a text is found first, in steps that Spark doesn't fold into the rules."""
    found = units.withColumn("__bare", _bare(F.col("text"))).withColumns({"__fact": factual(F.col("__bare")), "__quantity": F.col("__bare").rlike(QUANTITY)})
    return found.withColumn("quality", _judged(F.col("__bare"), F.col("__fact"), F.col("__quantity"), F.col("label"))).drop("__bare", "__fact", "__quantity")


def corpus(units: DataFrame) -> DataFrame:
    """Eligible units, each text of a page once for each path (the first one)."""
    # equal texts have equal verdicts, so the gate may come last, where Spark doesn't work it out a second time to filter early
    return first_rows(gated(units), ["path", "page", "content_sha256", "label"], [F.col("seq")], 1).filter("quality.eligible and length(text) >= 2")


def matched_terms(terms: Column, text: Column, n: int = 8) -> Column:
    """The longest terms that stand in the text, at most n."""
    found = let(F.lower(text), lambda low: F.filter(terms, lambda t: F.contains(low, t)))
    ranked = F.array_sort(F.transform(found, lambda t: F.struct((-F.length(t)).alias("o"), t.alias("t"))))
    return F.slice(F.transform(ranked, lambda x: x["t"]), 1, n)


def verdict(claim: Column, text: Column, semantic: Column | None = None, terms: Column | None = None) -> Column:
    """Struct: status, score, relation of a claim (collapsed) to a unit's text (collapsed). Checks go in order."""
    semantic = F.lit(0.0) if semantic is None else F.coalesce(semantic, F.lit(0.0))
    terms = claim_terms(claim) if terms is None else terms
    q = quality(text)
    matched = matched_terms(terms, text)
    strong = F.size(strong_terms(matched))
    any_strong = F.size(matched_terms(strong_terms(terms), text)) > 0
    stated = factual(text)
    direct = (any_strong | ((F.size(matched) >= 2) & stated)) & ((strong >= 1) | ((F.size(matched) >= 2) & q["factual"]))
    numbers = claim_numbers(claim)
    row = lambda status, score, relation=None: F.struct(F.lit(status).alias("status"), (score if isinstance(score, Column) else F.lit(float(score))).alias("score"), F.lit(relation).cast("string").alias("relation"))
    return (
        F.when(~q["eligible"] | (F.coalesce(claim, F.lit("")) == ""), row("insufficient", 0))
        .when((F.size(numbers) > 0) & (F.size(F.array_except(numbers, claim_numbers(text))) > 0), row("insufficient", 0))
        .when(claim.rlike(ABSOLUTE) & ~text.rlike(ABSOLUTE), row("partially_supported", 0.3))
        .when(claim.rlike(NEGATION) != text.rlike(NEGATION), row("partially_supported", 0.35))
        .when(direct, row("supported", F.round(F.least(F.lit(1.0), 0.65 + 0.08 * strong + F.when(q["factual"], 0.12).otherwise(0.0)), 3), "direct"))
        .when(semantic >= 0.78, row("partially_supported", F.round(F.least(F.lit(0.75), semantic), 3), "semantic"))
        .otherwise(row("insufficient", 0))
    )


def quote(text: Column, terms: Column, n: int = 280) -> Column:
    """The sentence that says most about the terms."""
    sentences = F.filter(F.transform(F.split(text, f"(?<={SENTENCE_END})\\s*"), lambda s: F.regexp_replace(s, "^[ ，,；;]+|[ ，,；;]+$", "")), lambda s: s != "")
    held = lambda s: let(F.lower(s), lambda low: F.size(F.filter(terms, lambda t: F.contains(low, t))))
    points = lambda s: held(s) * 8 + factual(s).cast("int") * 6 + s.rlike("[0-9]").cast("int") * 3 + F.least(F.length(s), F.lit(220)) / 80.0
    best = F.array_max(F.transform(sentences, lambda s, i: F.struct(points(s).alias("p"), (-i).alias("i"), s.alias("s"))))["s"]
    return F.when(F.length(best) > n, F.concat(F.substring(best, 1, n), F.lit("..."))).otherwise(F.coalesce(best, F.substring(text, 1, n)))


def _overlaps(units: DataFrame, asked: DataFrame, max_items: int) -> DataFrame:
    """question_id, path, seq, overlap: terms in common, for all units that can be among a question's ``max_items`` best.

    A unit's score is ten for each term and for a quantity, and what its page and
    label add, so it is known here but for what signals can add, which is at most 20.
    Each task keeps the best of each question; then the tasks' best are held against
    each other, before any text is looked at.
    """
    spark, found = units.sparkSession, None
    kind = dict(asked.dtypes)["question_id"]
    extra = F.col("text").rlike(QUANTITY).cast("int") * 10.0 + F.col("page").isNotNull().cast("int") * 2 + F.when(F.col("label").isin(BODY_LABELS), 2).otherwise(0)
    own = materialize(units.select("path", "seq", extra.alias("extra"), claim_terms(F.col("text")).alias("terms")), "claim-terms")
    signalled = F.lit(False)
    for trigger in INDIRECT:
        signalled = signalled | F.contains(F.col("question"), F.lit(trigger))
    asked = asked.select(F.col("question_id").alias("query_id"), "terms", strong_terms(F.col("terms")).alias("strong"), signalled.alias("signalled"))
    for block in retrieval.blocks(asked):
        rows = block.select("query_id", "signalled").distinct().orderBy("query_id").toArrow()
        names, bonus = rows["query_id"].to_pylist(), 20.0 * rows["signalled"].to_numpy().astype(float)
        place = {q: i for i, q in enumerate(names)}
        every, strong = (retrieval.weights_of(block.select("query_id", F.explode(c).alias("term"), F.lit(1.0).alias("weight")).toArrow(), "term", place) for c in ("terms", "strong"))
        sent = spark.sparkContext.broadcast((every, strong, names, bonus))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            every, strong, names, bonus = sent.value
            best = retrieval.Running(len(names), max_items)
            for batch in retrieval.parts_of(batches):
                if not batch.num_rows or not names:
                    continue
                terms = [dict.fromkeys(t, 1.0) for t in batch.column(3).to_pylist()]
                overlap = np.array([every.by_word(t) for t in terms]).reshape(len(terms), len(names))
                firm = np.array([strong.by_word(t) for t in terms]).reshape(len(terms), len(names)) > 0
                score = overlap * 10 + batch.column(2).to_numpy()[:, None]
                best.add(batch.column(0), np.where(firm, score, 0), np.where(overlap > 0, score + bonus, 0), seq=np.broadcast_to(batch.column(1).to_numpy()[:, None], overlap.shape), overlap=overlap)
            kept = best.rows or {"seq": np.empty(0), "overlap": np.empty(0)}
            yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in best.question], retrieval.arrow_type(kind)), pa.array(best.path, pa.string()), pa.array(kept["seq"].astype(np.int64)), pa.array(kept["overlap"].astype(np.int64)), pa.array(best.low), pa.array(best.high)], names=["question_id", "path", "seq", "overlap", "low", "high"])

        one = own.mapInArrow(run, f"question_id {kind}, path string, seq long, overlap long, low double, high double")
        found = one if found is None else found.unionByName(one)
    found = materialize(found, "overlaps")
    each = first_rows(found.groupBy("question_id", "path").agg(F.max("low").alias("low")), ["question_id"], [F.desc("low")], max_items)
    least = each.groupBy("question_id").agg(F.when(F.count("*") >= max_items, F.min("low")).otherwise(0.0).alias("least"))
    return found.join(least, "question_id").filter("high >= least").select("question_id", "path", "seq", "overlap")


def select(units: DataFrame, questions: DataFrame, *, max_items: int = 24, per_source: int = 2) -> DataFrame:
    """Units for each question: diverse, on topic, with a verdict, a quote and why they are shown.

    units: the corpus. questions: question_id, question. A unit needs a term of the
    question; questions go to the units in blocks, and a unit leaves its task only
    for questions whose best it can be among. Each source gives at most
    ``per_source`` units; ``place`` is the order in which a question's units are shown.
    """
    asked = questions.select("question_id", collapse(F.col("question")).alias("question")).withColumn("terms", claim_terms(F.col("question")))
    shared = materialize(_overlaps(units, asked, max_items), "candidates")
    # few rows meet the texts, which stay where they are
    met = units.select("path", "evidence_id", "seq", "page", "label", "text").join(small(shared), ["path", "seq"]).join(small(asked), "question_id")
    signals = F.flatten(F.array(*(F.when(F.contains(F.col("question"), F.lit(t)), F.array(*map(F.lit, s))).otherwise(F.array().cast("array<string>")) for t, s in INDIRECT.items())))
    strong = F.size(matched_terms(strong_terms(F.col("terms")), F.col("text"))) > 0
    matched = F.size(matched_terms(F.col("terms"), F.col("text")))
    indirect = let(F.lower("text"), lambda low: F.exists(F.col("signals"), lambda s: F.contains(low, s)))
    kind = F.when(strong | ((matched >= 2) & factual(F.col("text"))), "direct").when(indirect, "indirect").otherwise("none")
    told = let(claim_terms(F.col("text")), lambda own: F.exists(F.col("signals"), lambda s: F.array_contains(own, s)))
    relevance = F.col("overlap") + F.when((F.size("signals") > 0) & told, 2).otherwise(0) + F.col("text").rlike(QUANTITY).cast("int")
    score = relevance * 10.0 + F.col("page").isNotNull().cast("int") * 2 + F.when(F.col("label").isin(BODY_LABELS), 2).otherwise(0)
    scored = materialize(met.withColumn("signals", signals).withColumns({"match": kind, "score": score}).filter("match <> 'none'").drop("signals"), "scored")
    order = [F.desc("score"), F.col("path"), F.col("seq")]
    best = first_rows(first_rows(scored, ["question_id", "path"], order, per_source), ["question_id"], order, max_items)
    v = verdict(F.col("question"), F.col("text"), terms=F.col("terms"))
    place = F.row_number().over(W.partitionBy("question_id").orderBy(*order)).cast("long")
    out = best.withColumns({"verdict": v, "quote": quote(F.col("text"), F.col("terms")), "place": place})
    return out.select("question_id", "place", "evidence_id", "path", "seq", "page", "match", "overlap", "score", F.col("verdict.status").alias("support_status"), F.col("verdict.score").alias("support_score"), "quote")


def bind_claims(claims: DataFrame, selected: DataFrame, max_items: int = 3) -> DataFrame:
    """One row for each claim: how it is supported by the units selected for it (question_id), one for each source at most."""
    best = first_rows(first_rows(selected, ["question_id", "path"], [F.desc("score"), F.col("seq")], 1), ["question_id"], [F.desc("score"), F.col("path")], max_items)
    each = best.groupBy("question_id").agg(F.count_if(F.col("support_status") == "supported").alias("supported"), F.count_if(F.col("support_status") == "partially_supported").alias("partial"), F.max("support_score").alias("best_score"))
    none = F.coalesce("supported", F.lit(0)) == 0
    status = F.when(~none, "direct").when(F.coalesce("partial", F.lit(0)) > 0, "partial").otherwise("insufficient")
    return claims.join(each, "question_id", "left").select("question_id", F.coalesce("supported", F.lit(0)).alias("supported"), F.coalesce("partial", F.lit(0)).alias("partial"), F.coalesce("best_score", F.lit(0.0)).alias("best_score"), status.alias("claim_status"))


def answer_status(claims: DataFrame) -> DataFrame:
    """Of several claims of one answer (node_id, claim_status): supported only if all are, partial if any is."""
    return claims.groupBy("node_id").agg(F.when(F.every(F.col("claim_status") == "direct"), "supported").when(F.some(F.col("claim_status").isin("direct", "partial")), "partial").otherwise("insufficient").alias("answer_status"))


def representative(units: DataFrame) -> DataFrame:
    """The first eligible unit of each path."""
    good = gated(units).filter("quality.eligible")
    return good.groupBy("path").agg(F.min_by(F.struct("evidence_id", F.substring("text", 1, 300).alias("text")), "seq").alias("x")).select("path", "x.*")


def node_evidence(judged: DataFrame, scopes: DataFrame) -> DataFrame:
    """Evidence below each node. judged: units with their quality; scopes: scope, path.

    Units are summed up for each path before they meet the nodes above it.
    """
    good = F.col("quality.eligible")
    each = judged.groupBy("path").agg(F.count("*").alias("units"), F.count_if(good).alias("eligible_units"), F.sum(F.when(good, F.col("quality.score"))).alias("points"))
    below = scopes.select(F.col("scope").alias("node_id"), "path").join(each, "path").groupBy("node_id")
    out = below.agg(F.sum("units").alias("units"), F.sum("eligible_units").alias("eligible_units"), F.count_if(F.col("eligible_units") > 0).alias("sources"), F.sum("points").alias("points"))
    return out.select("node_id", "units", "eligible_units", "sources", F.round(F.col("points") / F.nullif("eligible_units", F.lit(0)), 3).alias("mean_score"))


def best_of_nodes(judged: DataFrame, members: DataFrame, *, per_source: int = 2, limit: int = 5) -> DataFrame:
    """The best eligible units of each node's documents, in order. members: node_id, path."""
    good = judged.filter("quality.eligible").select("path", "evidence_id", "seq", F.col("quality.score").alias("score"))
    few = first_rows(good, ["path"], [F.desc("score"), F.col("seq")], per_source)
    order = [F.desc("score"), F.col("path"), F.col("seq")]
    best = first_rows(members.join(few, "path"), ["node_id"], order, limit)
    return best.withColumn("place", F.row_number().over(W.partitionBy("node_id").orderBy(*order)).cast("long")).select("node_id", "path", "evidence_id", "score", "place")


def latest_by_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The newest row of each key, as a store with upserts would give it."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(order.desc()))).filter("__r = 1").drop("__r")


def resolved(wanted: DataFrame, units: DataFrame) -> DataFrame:
    """wanted (any columns and evidence_id) with the unit's path and text. Ids that no unit has are left out, never replaced."""
    own = materialize(units.groupBy("evidence_id").agg(F.min(F.struct("path", "text")).alias("u")).select("evidence_id", F.col("u.path").alias("unit_path"), F.col("u.text").alias("unit_text")), "units")
    return wanted.join(own, "evidence_id")
