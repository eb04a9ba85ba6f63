"""What a model is asked and answers, as text: prompts, answers as JSON, and judging generated answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The meaning of the levels of a score.
LEVELS = (
    "1 = very poor: lowest quality, with severe visible degradation",
    "2 = poor: below-average quality, with clear degradation",
    "3 = fair: middle quality, with noticeable but limited defects",
    "4 = good: above-average quality, with only minor defects",
    "5 = excellent: highest quality, clean and visually pleasing",
)
# The lines of a prompt.
BOXES = "Box coordinates are normalized to 0-1000 as [x1,y1,x2,y2]. Match the referring expression against both the image and each candidate box."
JUDGE = "Judge perceptual image quality from blur, noise, exposure, color, compression, and overall appearance. The ordered levels are:\n" + "\n".join(LEVELS)


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def box_1000(box: Column, width: Column, height: Column) -> Column:
    """A box in whole thousandths of the picture, rounded half to even, inside 0..1000; one of fractions has size 1 x 1."""
    return F.transform(
        box, lambda v, i: F.greatest(F.lit(0), F.least(F.lit(1000), F.bround(v / F.when(i % 2 == 0, width).otherwise(height) * 1000).cast("int")))
    )


def option_lines(options: Column, width: Column, height: Column) -> Column:
    """One line an option: id, text and, if it has one, its box."""
    def line(o: Column) -> Column:
        box = F.concat(F.lit("; box_0_1000=["), F.array_join(box_1000(o["box"], width, height).cast("array<string>"), ","), F.lit("]"))
        return F.concat(F.lit("- "), o["id"], F.lit(": "), o["text"], F.coalesce(box, F.lit("")))

    return F.array_join(F.transform(options, line), "\n")


def prompt(task: Column, state: Column, history: Column, question: Column, options: Column, width: Column, height: Column) -> Column:
    """The question as a model reads it: task, state, numbered history, question, candidates, and how to answer.

    Empty parts are left out; null texts count as empty.
    """
    blank = F.lit("")
    trimmed = F.regexp_replace(F.coalesce(state, blank), r"(?U)^\s+|\s+$", "")
    steps = F.array_join(F.transform(history, lambda h, i: F.concat((i + 1).cast("string"), F.lit(". "), quoted(h))), "\n")
    some = F.coalesce(F.size(options) > 0, F.lit(False))
    asked = F.when(task == "noul", 'Return exactly {"noul":true} or {"noul":false}.').when(
        task == "score", F.lit(JUDGE + '\n\nReturn exactly {"score":<integer from 1 to 5>}.')
    )
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Task: "), task),
        F.when(trimmed != "", F.concat(F.lit("Visible state: "), trimmed)),
        F.when(F.size(history) > 0, F.concat(F.lit("Completed steps (oldest to newest):\n"), steps)),
        F.concat(F.lit("Question: "), F.coalesce(question, blank)),
        F.when(some, F.concat(F.lit("Candidates:\n"), option_lines(options, width, height))),
        F.when(some & F.exists(options, lambda o: o["box"].isNotNull()), F.lit(BOXES)),
        asked.otherwise(F.concat(F.lit('Return exactly {"'), task, F.lit('":"<candidate_id>"}.'))),
    )


def answer_json(task: Column, target: Column) -> Column:
    """The right answer as compact JSON: a boolean, the level of a score, or the first target id; null if unknown."""
    first = F.get(target["ids"], F.lit(0))
    level = F.regexp_extract(first, r"([^_]*)$", 1).try_cast("int")
    value = F.when(
        task == "noul", target["bool"].cast("string")
    ).when(task == "score", level.cast("string")).otherwise(F.when(first.isNotNull(), quoted(first)))
    return F.concat(F.lit('{"'), task, F.lit('":'), value, F.lit("}"))


def generated(task: Column, raw: Column, options: Column) -> Column:
    """The value that a generated text answers with: 'true' or 'false', 'score_n' or an option id; null if it is no answer.

    The text has to be a JSON object with the task as a field: a boolean for noul, a whole number from 1 to 5 for
    score, the id of an option otherwise. Numbers in quotes and booleans as numbers are no answers.
    """
    field = F.try_element_at(F.from_json(raw, "map<string,string>"), task)
    # from_json reads any scalar as its text, so whether it was quoted is seen in the text
    literal = F.regexp_extract(raw, r'"(?:noul|score)"\s*:\s*(true|false|-?[0-9]+)\s*[,}]', 1)
    level = F.when((literal == field) & field.rlike(r"^[1-5]$"), F.concat(F.lit("score_"), field))
    choice = F.when(F.exists(options, lambda o: o["id"] == field) & raw.rlike(r'^\s*\{\s*"[a-z]+"\s*:\s*"'), field)
    return F.when(task == "noul", F.when((literal == field) & field.isin("true", "false"), field)).when(task == "score", level).otherwise(choice)


def is_json_object(raw: Column) -> Column:
    """Whether a text is one JSON object; false for null."""
    return F.coalesce(F.from_json(raw, "map<string,string>").isNotNull() & raw.rlike(r"^\s*\{[\s\S]*\}\s*$"), F.lit(False))


def is_correct(task: Column, value: Column, target: Column) -> Column:
    """Whether a generated value is right: any of the target ids, or the boolean; a missing value is wrong."""
    right = F.when(task == "noul", value == target["bool"].cast("string")).otherwise(F.array_contains(target["ids"], value))
    return F.coalesce(right, F.lit(False))


def letter(index: Column) -> Column:
    """The letter of an option by its place, from 0: A to Z."""
    return F.when(index.between(0, 25), F.char(index + 65))


def cache_key(*parts: Column) -> Column:
    """A digest of named parts as JSON with their names in order, for results that are kept by what they were made of."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)
