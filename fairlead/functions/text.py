"""Text expressions: answers, numbers, stored lists, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of a failed response.
ERROR_MARKERS = (
    "Error processing query",
    "'NoneType' object is not subscriptable",
    "TypeError:",
    "KeyError:",
    "IndexError:",
)
REASONING_PREFIX = "Agent Reasoning and Response:"  # fixed value
# Section patterns of an answer in markdown.
ANSWER_SECTION = r"(?s)## Answer\s*(.*?)(?=\s*##|$)"
LOOSE_SECTION = r"(?s)(?:###|##)\s*(?:Answer|Key Details.*?)\s*(.*?)(?=\s*(?:###|##)|\z)"
HEADER_LINE = r"(?m)^###\s*.*?\n"
NUMBER = r"-?\d+(?:\.\d+)?"
SPACE = r"[ \t\n\r\f\x0B]"


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def is_error(text: Column) -> Column:
    hit = F.lit(False)
    for marker in ERROR_MARKERS:
        hit = hit | text.contains(marker)
    return hit


def extract_answer(response: Column) -> Column:
    """The last answer section; else a loose section; else what follows the analysis."""
    sections = F.regexp_extract_all(response, F.lit(ANSWER_SECTION), F.lit(1))
    body = F.when(
        response.contains(REASONING_PREFIX), strip(F.get(F.split(response, REASONING_PREFIX), F.lit(1)))
    ).otherwise(response)
    loose = F.regexp_extract_all(body, F.lit(LOOSE_SECTION), F.lit(1))
    answer = (
        F.when(F.size(sections) > 0, F.element_at(sections, -1))
        .when(F.size(loose) > 0, F.get(loose, F.lit(0)))
        .otherwise(F.substring_index(body, "## Analysis", -1))
    )
    # ``^`` needs no match after the final line, so the trailing text survives.
    return F.when(response.isNotNull(), _blank_to_empty(F.regexp_replace(strip(answer), HEADER_LINE, "")))


def _blank_to_empty(text: Column) -> Column:
    return F.when(text.rlike(r"\A\s*\z"), F.lit("")).otherwise(text)


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, NUMBER, 0).try_cast("double")


def all_numbers(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda n: n.try_cast("double"))


def clean_number(reply: Column) -> Column:
    """A numeric reply with everything but digits and points removed.

    The minus sign goes too, as the scoring it reproduces drops it.
    """
    digits = F.regexp_replace(reply, r"[^\d.]", "")
    return F.when(F.lower(strip(reply)) == "none", F.lit(None)).otherwise(digits.try_cast("double"))


def response_markdown(question: Column, statements: Column, answer: Column) -> Column:
    blocks = F.array_join(F.transform(statements, lambda s: F.concat(F.lit("```sql\n"), s, F.lit("\n```\n\n"))), "")
    return F.concat(
        F.lit("# Query Results\n\n## Question\n"), question, F.lit("\n\n"),
        F.when(F.size(statements) > 0, F.concat(F.lit("## SQL Queries\n"), blocks)).otherwise(""),
        F.lit("## Response\n"), answer, F.lit("\n\n"),
    )


def contexts(statements: Column, reasoning: Column) -> Column:
    return F.array_append(
        F.transform(statements, lambda s: F.concat(F.lit("SQL Query: "), s)),
        F.concat(F.lit(f"{REASONING_PREFIX} "), reasoning),
    )


def parse_statements(stored: Column) -> Column:
    """A stored statement list: ``{...}`` array text, a JSON array, or one statement."""
    empty = F.array().cast("array<string>")
    inner = F.regexp_replace(stored, r"^\{|\}$", "")
    braced = F.transform(F.split(inner, '",'), lambda q: F.regexp_replace(strip(q), r'^"|"$', ""))
    parsed = F.from_json(stored, "array<string>")
    return (
        F.when(stored.isNull() | (stored == ""), empty)
        .when(stored.startswith("{"), braced)
        .when(stored.rlike(r"^\s*\[") & parsed.isNotNull(), parsed)
        .otherwise(F.array(stored))
    )


def tool_names(calls: Column) -> Column:
    return F.transform(calls, lambda call: call["tool_name"])


def or_else(first: Column, second: Column) -> Column:
    """First value unless it is null or zero; a zero stays when there is no second."""
    return F.when(first != 0, first).otherwise(F.coalesce(second, first))


def relative_score(value: Column, truth: Column) -> Column:
    """1 for equal numbers, falling linearly to 0 at a relative error of 1."""
    error = F.abs(value - truth) / F.greatest(F.abs(truth), F.lit(1e-10))
    return F.when(value == truth, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - error))


def format_deviation(value: Column) -> Column:
    missing = value.isNull() | F.isnan(value)
    return F.when(missing, F.lit("N/A")).otherwise(F.format_string("%.3f", value))


def percent_done(done: Column, total: Column) -> Column:
    return F.floor(F.try_divide(done, total) * 100).cast("int")


def short_name(model: Column) -> Column:
    """``vendor/model`` to ``model``; names without a vendor stay."""
    return F.when(model.contains("/"), F.split_part(model, F.lit("/"), F.lit(2))).otherwise(model)


def title(name: Column) -> Column:
    """``a_b`` to ``A B``: first letters go up, the others stay."""
    words = F.transform(
        F.split(name, "_"),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))),
    )
    return F.array_join(words, " ")


def clip(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def parse_selection(spec: Column) -> Column:
    """``"1,3,7-10"`` to sorted distinct positions; malformed parts are skipped."""
    def positions(part: Column) -> Column:
        low = F.regexp_extract(part, r"^\s*\+?(\d+)", 1).try_cast("int")
        high = F.regexp_extract(part, r"-\s*\+?(\d+)\s*$", 1).try_cast("int")
        none = F.array().cast("array<int>")
        return (
            F.when(part.rlike(r"^\s*\+?\d+\s*$"), F.array(low))
            .when(part.rlike(r"^\s*\+?\d+\s*-\s*\+?\d+\s*$") & (low <= high),
                  F.sequence(low, F.greatest(low, high)))
            .otherwise(none)
        )
    parts = F.split(F.coalesce(spec, F.lit("")), ",")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, positions))))
