"""Model prompts, model replies and the check of quoted evidence."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

VERDICTS = ("SUPPORTED", "PLAUSIBLE", "SUSPICIOUS", "UNVERIFIABLE")
KEYS = ("verdict", "evidence_quote", "rationale")
#: Contract with the model: what it is given, the four verdicts, the rules, and the shape of its reply.
SCHEMA = {"type": "object", "properties": {"verdict": {"type": "string", "enum": list(VERDICTS)}, "evidence_quote": {"type": "string"}, "rationale": {"type": "string"}}, "required": list(KEYS), "additionalProperties": False}
INSTRUCTIONS = "\n".join(
    (
        "Decide whether the abstract of a cited work supports a sentence that cites it. Use the abstract alone, not what you know about the work.",
        "SUPPORTED: the abstract clearly says what the sentence attributes to the work.",
        "PLAUSIBLE: it is on topic and consistent with the sentence, but does not say that specific thing.",
        "SUSPICIOUS: it contradicts the sentence, or suggests that the work does not support it.",
        "UNVERIFIABLE: it does not hold enough information.",
        "evidence_quote is one contiguous passage copied exactly from the abstract, required for SUPPORTED, else possibly empty. rationale takes at most 80 words.",
        "Answer with one JSON object of this schema only: " + json.dumps(SCHEMA, sort_keys=True),
    )
)
REPAIR = "The last answer was no valid JSON object of the schema. Answer again with only that object."
NO_ABSTRACT = "No usable abstract was found for the cited work, so no model was asked."
INVALID = "model output invalid"


def source_block(cite_key: Column, title: Column, abstract: Column) -> Column:
    """The cited work; byte for byte the same for every claim on it, so that a model can reuse the prefix."""
    shown = F.coalesce(F.nullif(title, F.lit("")), F.lit("(no title)"))
    return F.concat(F.lit("CITED WORK\nCitation key: "), cite_key, F.lit("\nTitle: "), shown, F.lit("\nAbstract:\n"), abstract, F.lit("\n\n"))


def claim_block(sentence: Column, before: Column) -> Column:
    context = F.when(F.coalesce(before, F.lit("")) != "", F.concat(F.lit("Preceding sentence (context only): "), before, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("CLAIM TO CHECK\n"), context, F.lit("Citing sentence: "), sentence, F.lit("\n"))


def user_message(cite_key: Column, title: Column, abstract: Column, sentence: Column, before: Column) -> Column:
    return F.concat(source_block(cite_key, title, abstract), claim_block(sentence, before))


def parse_reply(reply: Column) -> Column:
    """(verdict, evidence_quote, rationale) of a valid reply, which may stand in a code fence; null for any other.

    Valid is an object of exactly the three keys, all strings, with a known verdict.
    """
    body = F.regexp_replace(reply, r"(?U)^\s+|\s+$", "")
    fenced = F.regexp_replace(F.regexp_replace(body, r"^```[^\n]*(?:\n|$)", ""), r"(?U)```\s*$", "")
    text = F.when(body.startswith("```"), fenced).otherwise(body)
    tree = F.try_parse_json(text)
    kinds = F.schema_of_variant(tree)
    wanted = "OBJECT<" + ", ".join(f"{k}: STRING" for k in sorted(KEYS)) + ">"
    part = {k: F.try_variant_get(tree, f"$.{k}", "string") for k in KEYS}
    return F.when((kinds == wanted) & part["verdict"].isin(*VERDICTS), F.struct(*[part[k].alias(k) for k in KEYS]))


def checked(verdict: Column, quote: Column, rationale: Column, found: Column) -> Column:
    """(verdict, evidence_quote, rationale) after the quote check.

    SUPPORTED needs a quote that stands in the abstract, else it becomes
    UNVERIFIABLE; other verdicts keep their label and lose a quote that isn't there.
    """
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    quote, rationale = trim(quote), trim(rationale)
    found = (quote != "") & F.coalesce(found, F.lit(False))
    out = lambda v, q, r: F.struct(v.alias("verdict"), q.alias("evidence_quote"), r.alias("rationale"))
    why = F.when(quote == "", "Downgraded from SUPPORTED because no evidence quote was given.").otherwise("Downgraded from SUPPORTED because the evidence quote was not found in the abstract.")
    downgraded = F.when(rationale != "", F.concat(why, F.lit(" Model rationale: "), rationale)).otherwise(why)
    note = F.lit("The quoted passage was not found in the abstract and was removed.")
    removed = F.when(rationale != "", F.concat(rationale, F.lit(" ("), note, F.lit(")"))).otherwise(note)
    return (
        F.when(found, out(verdict, quote, rationale))
        .when(verdict == "SUPPORTED", out(F.lit("UNVERIFIABLE"), F.lit(""), downgraded))
        .when(quote != "", out(verdict, F.lit(""), removed))
        .otherwise(out(verdict, F.lit(""), rationale))
    )
