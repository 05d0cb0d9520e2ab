"""Claims, evidence and model replies joined into verdicts. Replies are a table: (doc_id, claim_index, attempt, reply, transport_error, fatal)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.functions import verdicts as V
from veriloom.functions.text import quote_in_abstract

REPLIES = "doc_id string, claim_index int, attempt int, reply string, transport_error string, fatal boolean"


def with_evidence(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with the evidence of their key; a claim without any is absent."""
    own = evidence.withColumnRenamed("key", "cite_key").withColumnRenamed("reason", "lookup_reason")
    out = claims.join(own, ["doc_id", "cite_key"], "left")
    return out.withColumns({"lookup_status": F.coalesce("lookup_status", F.lit("absent")), "title": F.coalesce("title", F.lit(""))})


def judging_order(claims: DataFrame) -> DataFrame:
    """Adds group_first: claims on one work are judged together, works in order of their first citation."""
    first = claims.groupBy("doc_id", "cite_key").agg(F.min("claim_index").alias("group_first"))
    return claims.join(first, ["doc_id", "cite_key"])


def prompts(claims: DataFrame) -> DataFrame:
    """(doc_id, claim_index, prompt) of the claims that a model is asked about, laid out so that equal prefixes are neighbours."""
    ask = judging_order(claims.filter("abstract is not null"))
    text = V.user_message(F.col("cite_key"), F.col("title"), F.col("abstract"), F.col("sentence"), F.col("context_before"))
    return ask.select("doc_id", "group_first", "claim_index", text.alias("prompt")).repartition("doc_id", "group_first").sortWithinPartitions("doc_id", "group_first", "claim_index")


def judge(claims: DataFrame, replies: DataFrame) -> DataFrame:
    """Verdict, evidence_quote and rationale of each claim.

    No abstract: no model is asked. A fatal failure leaves all later claims of
    its document unjudged. A second attempt counts where the first reply was
    not valid. A quote must stand in the abstract.
    """
    own = judging_order(claims)
    parsed = replies.withColumn("p", V.parse_reply(F.col("reply")))
    best = parsed.groupBy("doc_id", "claim_index").agg(
        F.min_by("p", F.when(F.col("p").isNotNull() & (F.col("attempt") <= 2), F.col("attempt"))).alias("p"),
        F.max("transport_error").alias("failure"), F.bool_or(F.coalesce("fatal", F.lit(False))).alias("fatal"), F.count(F.lit(1)).alias("tries"),
    )
    own = own.join(best, ["doc_id", "claim_index"], "left")
    asked = F.col("abstract").isNotNull()
    broken = own.filter(asked & F.col("fatal")).groupBy("doc_id").agg(F.min(F.struct("group_first", "claim_index", "failure")).alias("stop"))
    own = own.join(broken, "doc_id", "left")
    here = F.struct("group_first", "claim_index")
    late = asked & F.col("stop").isNotNull() & (here >= F.struct("stop.group_first", "stop.claim_index"))
    sent = asked & ~late & F.col("p").isNotNull()
    quoted = own.filter(sent).withColumn("found", quote_in_abstract("p.evidence_quote", "abstract"))
    done = quoted.withColumn("v", V.checked(F.col("p.verdict"), F.col("p.evidence_quote"), F.col("p.rationale"), F.col("found"))).drop("found")
    why = F.when(~asked, V.NO_ABSTRACT).when(late, F.concat(F.lit("Not judged: "), "stop.failure")).when(F.col("failure").isNotNull(), F.concat(F.lit("Not judged: "), "failure")).otherwise(V.INVALID)
    rest = own.filter(~F.coalesce(sent, F.lit(False))).withColumn("v", F.struct(F.lit("UNVERIFIABLE").alias("verdict"), F.lit("").alias("evidence_quote"), why.alias("rationale")))
    return done.unionByName(rest).select(*claims.columns, "v.*")


def failure_message(claims: DataFrame, replies: DataFrame) -> DataFrame:
    """(doc_id, failure): the fatal failure of a document, else how many requests failed."""
    per = replies.filter("transport_error is not null").groupBy("doc_id").agg(F.max(F.when(F.coalesce("fatal", F.lit(False)), F.col("transport_error"))).alias("f"), F.countDistinct("claim_index").alias("n"))
    many = F.concat(F.lit("model requests failed for "), F.col("n").cast("string"), F.lit(" claims, which are marked UNVERIFIABLE (not judged)"))
    return per.select("doc_id", F.coalesce("f", F.when(F.col("n") > 1, many).otherwise("the model request failed for 1 claim, which is marked UNVERIFIABLE (not judged)")).alias("failure"))


def summary(judged: DataFrame) -> DataFrame:
    """(doc_id, kind, value, n): claims by verdict (nulls left out) and by lookup status."""
    verdict = judged.filter("verdict is not null").groupBy("doc_id", F.lit("verdict").alias("kind"), F.col("verdict").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return verdict.unionAll(judged.groupBy("doc_id", F.lit("lookup_status").alias("kind"), F.col("lookup_status").alias("value")).agg(F.count(F.lit(1)).alias("n")))
