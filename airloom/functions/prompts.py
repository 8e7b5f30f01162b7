"""Prompt and report texts. The sentences are fixed texts; the columns fill them in."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import numeric as N
from .index import band, band_advice, label_of

# Fixed texts.
LIVE_HEADER = ("\n---\n**Context — Live AQI readings for Delhi right now** "
               "(use only if relevant to my question):")
SOURCES_HEADER = ("\n**Context — Knowledge-base excerpts** "
                  "(cite as [Ref N] only when you actually use them):")
GUIDANCE = (
    "\n---\n**How to answer:**\n"
    "• Answer **exactly what I asked** — do NOT produce a generic AQI report unless I specifically asked for one.\n"
    "• Use the live data and references above only when they are relevant to my question; otherwise rely on your own "
    "knowledge.\n"
    "• If you reference external facts, include **clickable source links** in markdown: [text](https://url).\n"
    "• Use [Ref N] citations when referencing knowledge-base excerpts.\n"
    "• Use markdown formatting for readability.\n"
    "• Be detailed and helpful but stay on-topic."
)
REGENERATE_HEAD = ("IMPORTANT: Your previous answer did not cite any sources. "
                   "Please answer again with proper citations.\n\nQuestion: ")
REGENERATE_MIDDLE = ("\n\nYou MUST use [Ref N] citations from the sources below. "
                     "If a fact comes from a source, cite it inline.\n\nSources:\n")
REGENERATE_RULES = (
    "\n\nRules:\n1. Every factual claim must have a [Ref N] citation\n"
    "2. If you're unsure, say so rather than guessing\n3. Use markdown formatting\n4. Be concise but thorough"
)
FALLBACK_TAIL = "\n---\n*Add your free API key in the sidebar for detailed AI analysis.*"


def map_lines(snapshot: Column) -> Column:
    """``  • key: value`` per entry of a MAP<STRING, STRING>, keys in order."""
    entries = F.array_sort(F.map_entries(snapshot))
    return F.transform(entries, lambda e: F.concat(F.lit("  • "), e["key"], F.lit(": "), e["value"]))


def tool_result(tool: Column, timestamp: Column, data: Column) -> Column:
    head = F.concat(F.lit("**[Live API Data — "), tool, F.lit(" @ "), timestamp, F.lit("]**"))
    return F.array_join(F.concat(F.array(head), map_lines(data)), "\n")


def _reference(chunk: Column, position: Column) -> Column:
    """One excerpt. The leading text length is a fixed part of the prompt format."""
    topic = F.when(F.coalesce(chunk["topic"], F.lit("")) != "", F.concat(F.lit(" | topic="), chunk["topic"]))
    score = F.coalesce(chunk["final_score"], chunk["rerank_score"])
    shown = F.when(score.isNotNull(), F.concat(F.lit(" | relevance="), F.format_string("%.2f", F.bround(score, 2))))
    return F.concat(
        F.lit("\n[Ref "), (position + 1).cast("string"), F.lit("] ("),
        F.coalesce(chunk["doc_name"], F.lit("unknown")), F.coalesce(topic, F.lit("")), F.coalesce(shown, F.lit("")),
        F.lit("):\n"), F.substring(chunk["text"], 1, 1200),
    )


def build_prompt(question: Column, chunks: Column, snapshot: Column | None = None,
                 intent_name: Column | None = None, intent_confidence: Column | None = None,
                 tool_text: Column | None = None) -> Column:
    """User message: question, intent, live data (tool result or snapshot), excerpts, guidance."""
    lines = F.array(F.concat(F.lit("**My question:** "), question))
    nothing = F.array().cast("array<string>")
    if intent_name is not None:
        lines = F.concat(lines, F.array(F.concat(
            F.lit("\n*[Query intent: "), intent_name, F.lit(" (conf="),
            N.text0(intent_confidence * 100), F.lit("%)]*"))))
    live = nothing
    if snapshot is not None:
        live = F.when(F.size(snapshot) > 0, F.concat(F.array(F.lit(LIVE_HEADER)), map_lines(snapshot))).otherwise(
            nothing)
    if tool_text is not None:
        has_tool = F.coalesce(tool_text, F.lit("")) != ""
        live = F.when(has_tool, F.array(F.concat(F.lit("\n---\n"), tool_text))).otherwise(live)
    lines = F.concat(lines, live)
    excerpts = F.when(
        F.size(chunks) > 0, F.concat(F.array(F.lit(SOURCES_HEADER)), F.transform(chunks, _reference))
    ).otherwise(nothing)
    return F.array_join(F.concat(lines, excerpts, F.array(F.lit(GUIDANCE))), "\n")


def regeneration_prompt(question: Column, chunks: Column) -> Column:
    refs = F.transform(chunks, lambda c, i: F.concat(
        F.lit("\n[Ref "), (i + 1).cast("string"), F.lit("] ("), F.coalesce(c["doc_name"], F.lit("unknown")),
        F.lit("): "), F.substring(c["text"], 1, 1000), F.lit("\n")))
    return F.concat(F.lit(REGENERATE_HEAD), question, F.lit(REGENERATE_MIDDLE), F.array_join(refs, ""),
                    F.lit(REGENERATE_RULES))


def rule_answer(aqi: Column, category: Column, dominant: Column, sub_indices: Column, pm25: Column) -> Column:
    """Answer without a language model. ``sub_indices``: ARRAY<STRUCT<parameter, sub_index>>, highest first."""
    rows = F.transform(sub_indices, lambda s: F.concat(
        F.lit("- **"), label_of(s["parameter"]), F.lit("**: "), s["sub_index"].cast("string"), F.lit(" ("),
        band(s["sub_index"]), F.lit(")")))
    smoke = F.when(pm25 != 0, F.concat(
        F.lit("\n> Breathing this air is equivalent to **"), N.text1(pm25 / 22.0), F.lit(" cigarettes/day**")))
    head = F.array(
        F.concat(F.lit("## Air Quality: AQI "), aqi.cast("string"), F.lit(" -- "), category, F.lit("\n")),
        F.concat(F.lit("**Dominant pollutant**: "), F.upper(dominant), F.lit("\n")),
        F.lit("### Sub-Indices"))
    tail = F.array_compact(F.array(
        F.concat(F.lit("\n### Health Advisory\n"), band_advice(category)), smoke, F.lit(FALLBACK_TAIL)))
    return F.array_join(F.concat(head, rows, tail), "\n")
